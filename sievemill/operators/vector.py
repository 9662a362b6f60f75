"""Exact vector search: normalised vectors, squared distances, similarities, encoders."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from typing import Protocol

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .bm25 import top

#: Query vectors that are broadcast or make a block, and vectors of a block.
BLOCK, VECTOR_BLOCK = 2048, 1 << 16
TINY = 1e-12


def norm(v: Column) -> Column:
    return F.sqrt(F.aggregate(v, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))


def unit(v: Column) -> Column:
    """v by its length, which counts as 1e-12 at least."""
    n = F.greatest(norm(v), F.lit(TINY))
    return F.transform(v, lambda x: x.cast("double") / n)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_distance(a: Column, b: Column) -> Column:
    """Between the normalised vectors: 2 - 2 cos."""
    cos = dot(a, b) / (F.greatest(norm(a), F.lit(TINY)) * F.greatest(norm(b), F.lit(TINY)))
    return F.greatest(F.lit(0.0), 2.0 - 2.0 * cos)


def similarity(d2: Column) -> Column:
    return 1.0 / (1.0 + d2)


def check_dimension(vectors: DataFrame, dimension: int, column: str = "embedding") -> DataFrame:
    """The rows, or a failure while running if a vector has another size."""
    found = F.size(column)
    wrong = F.raise_error(F.format_string("vector of %d components, not %d", found, F.lit(dimension)))
    return vectors.withColumn(column, F.when(F.col(column).isNull() | (found == dimension), F.col(column)).otherwise(wrong.cast(vectors.schema[column].dataType)))


def _unit_rows(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), TINY)


def _rows(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """(rows, components) of an array column whose rows are equally long."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def _nearest(ids: np.ndarray, queries: np.ndarray, doc: np.ndarray, x: np.ndarray, k: int) -> Iterator[dict[str, np.ndarray]]:
    """The k nearest of each query among a few vectors at a time; as many as tie with the k-th stay,
    so that ties can be told apart later."""
    for at in range(0, len(doc), 4096):
        d2 = np.maximum(0.0, 2.0 - 2.0 * queries @ _unit_rows(x[at : at + 4096]).T)
        few = min(k, d2.shape[1])
        limit = np.partition(d2, few - 1, axis=1)[:, few - 1] + 1e-9
        i, j = np.nonzero(d2 <= limit[:, None])
        yield {"query_id": ids[i], "doc_id": doc[at + j], "d2": d2[i, j]}


def _against(held, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, queries = held.value
        for batch in batches:
            if batch.num_rows:
                for found in _nearest(ids, queries, batch.column(0).to_numpy(), _rows(batch.column(1)), k):
                    yield pa.record_batch(found)

    return run


def _block(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        parts = []
        if left.num_rows and right.num_rows:
            queries = _unit_rows(_rows(left["asked"]))
            parts = list(_nearest(left["query_id"].to_numpy(), queries, right["held_id"].to_numpy(), _rows(right["held"]), k))
        empty = {"query_id": np.zeros(0, np.int64), "doc_id": np.zeros(0, np.int64), "d2": np.zeros(0)}
        return pa.table({c: np.concatenate([p[c] for p in parts]) if parts else empty[c] for c in empty})

    return run


def distances_topk(queries: DataFrame, vectors: DataFrame, k: int) -> DataFrame:
    """Candidates (query_id, doc_id, d2) that hold each query's k nearest: every batch of vectors
    keeps its own k nearest of each query.

    Queries are a stated set.  Up to BLOCK of them are broadcast, and vectors stay where they are; more
    meet the vectors block by block, both sides' blocks of a bounded number of rows.
    """
    schema = "query_id long, doc_id long, d2 double"
    asked, held = queries.select("query_id", "embedding"), vectors.select("doc_id", "embedding")
    few = asked.limit(BLOCK + 1).collect()
    if len(few) <= BLOCK:
        if not few:
            return queries.sparkSession.createDataFrame([], schema)
        ids, x = np.array([r[0] for r in few], dtype=np.int64), _unit_rows(np.array([r[1] for r in few], dtype=np.float64))
        return held.mapInArrow(_against(queries.sparkSession.sparkContext.broadcast((ids, x)), k), schema)
    nq, nv = -(-asked.count() // BLOCK), max(1, -(-held.count() // VECTOR_BLOCK))

    def dealt(side: DataFrame, key: str, own: tuple[str, int], other: tuple[str, int]) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(other[1] - 1)))
        return side.withColumn(own[0], F.pmod(F.xxhash64(key), F.lit(own[1])).cast("int")).withColumn(other[0], every).groupBy("q", "v")

    asked = asked.select("query_id", F.col("embedding").alias("asked"))
    held = held.select(F.col("doc_id").alias("held_id"), F.col("embedding").alias("held"))  # queries may come from the same rows
    return dealt(asked, "query_id", ("q", nq), ("v", nv)).cogroup(dealt(held, "held_id", ("v", nv), ("q", nq))).applyInArrow(_block(k), schema)


def search(queries: DataFrame, vectors: DataFrame, k: int = 50) -> DataFrame:
    """(query_id, doc_id, d2, score, rank): the k nearest by similarity, ties to the smaller id."""
    found = distances_topk(queries, vectors, k)
    return top(found.withColumn("score", similarity(F.col("d2"))), k)


class Encoder(Protocol):
    """Turns a text column into an array<double> column; a model wraps itself in a pandas UDF."""

    dimension: int

    def encode(self, text: Column) -> Column: ...


class HashEncoder:
    """Words hashed to signed components, without Python."""

    def __init__(self, dimension: int = 384) -> None:
        self.dimension = dimension

    def encode(self, text: Column) -> Column:
        words = F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+")
        hashed = F.transform(F.filter(words, lambda w: w != ""), lambda w: F.xxhash64(w))
        zero = F.array_repeat(F.lit(0.0), self.dimension)

        def add(v: Column, h: Column) -> Column:
            at, sign = F.pmod(h, F.lit(self.dimension)), F.when(F.pmod(F.shiftright(h, 32), F.lit(2)) == 0, 1.0).otherwise(-1.0)
            return F.transform(v, lambda x, i: F.when(i == at, x + sign).otherwise(x))

        return F.aggregate(hashed, zero, add)


class ConceptEncoder:
    """One axis for each group of keywords that the text has one of; a last axis if it has none."""

    def __init__(self, groups: Sequence[Sequence[str]], dimension: int = 384) -> None:
        self.groups, self.dimension = groups, dimension

    def encode(self, text: Column) -> Column:
        low = F.lower(F.coalesce(text, F.lit("")))
        axes = []
        for group in self.groups:
            any_of = F.lit(False)
            for word in group:
                any_of = any_of | F.contains(low, F.lit(word))
            axes.append(any_of.cast("double"))
        none = F.when(sum(axes[1:], axes[0]) == 0, 1.0).otherwise(0.0)
        rest = F.array_repeat(F.lit(0.0), self.dimension - len(axes) - 1)
        return F.concat(F.array(*axes, none), rest)


class PandasEncoder:
    """Any function from a list of texts to a matrix, applied to Arrow batches."""

    def __init__(self, function, dimension: int) -> None:
        self.function, self.dimension = function, dimension

    def encode(self, text: Column) -> Column:
        function = self.function

        @F.pandas_udf("array<double>")
        def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            for texts in batches:
                yield pd.Series([np.asarray(v, dtype=float) for v in function(texts.fillna("").tolist())])

        return run(text)
