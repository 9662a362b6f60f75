"""Approximate nearest neighbours by adaptive dimension scans (operator 4).

The largest inner product is the smallest distance once candidates get one more component that
makes them all as long as the longest.  k-means lists over these vectors are learned on a bounded
sample; every row is in one list, and a query probes lists from the nearest, as many as reached the
target recall for sample queries, and more until they hold enough candidates.  Within a list, all
vectors are rotated by the same random matrix and scanned in blocks of columns: after each block a
test on the distance so far, scaled up to all dimensions, abandons candidates that would be farther
than the k-th nearest with high confidence.  What survives is scored exactly on the vectors given.
The nearest lists are probed first; the k-th score found there bounds the scans of the others, which
return nothing worse, so that what is returned does not grow with the number of lists.

Cases: invalid vectors (null, zero, null or non-finite components, another length) are neither
queries nor candidates; a query's own id is no candidate; fewer candidates than k are all returned;
ties go to the smaller id; repeated rows are candidates each, and of an id that several queries have
one is taken; an empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .base import drop_persisted, persist, ship
from .vectors import blocks, distances, kmeans, matrix, sample_for, sample_matrix, valid_vectors

TARGET_RECALL = 0.97
#: Columns of a block, and how far from the k-th distance an estimate must be to abandon (in units
#: of the estimate's spread).
COLUMNS, CONFIDENCE = 16, 2.1
#: Rows of a list on average, and the most lists: their centroids and sizes are broadcast (8 MB at 64
#: components).  Beyond 16 million rows lists grow with the table.
LIST_ROWS, MOST_LISTS = 1024, 1 << 14
#: Lists of a query that are probed before the others.
FIRST_LISTS = 2
_AT_ONCE = 512


def lengthen(x: np.ndarray, longest: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(longest**2 - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def rotation(d: int, seed: int = 3) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((d, d)))
    return q * np.sign(np.diag(r))


def adaptive_scan(q: np.ndarray, x: np.ndarray, k: int, columns: int = COLUMNS, confidence: float = CONFIDENCE, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, int]:
    """Pairs (query, candidate) of rotated vectors that no test abandoned, and the components read.

    Candidates come in chunks; the k-th smallest distance so far is each query's bound, or ``start``
    if that is less.
    """
    d = q.shape[1]
    best = np.full((len(q), k), np.inf)
    out_q, out_x, read = [], [], 0
    at, chunk = 0, max(64, k)
    while at < len(x):
        part = x[at : at + chunk]
        bound = best[:, -1] if start is None else np.minimum(best[:, -1], start)
        i, j = np.divmod(np.arange(len(q) * len(part)), len(part))
        so_far = np.zeros(len(i))
        for lo in range(0, d, columns):
            hi = min(d, lo + columns)
            read += len(i) * (hi - lo)
            if lo == 0:
                so_far = np.maximum(distances(q[:, :hi], part[:, :hi]), 0).ravel()
            else:
                diff = q[i, lo:hi] - part[j, lo:hi]
                so_far = so_far + np.einsum("ab,ab->a", diff, diff)
            if hi < d:
                keep = so_far * (d / hi) <= bound[i] * (1 + confidence / np.sqrt(hi)) ** 2
                i, j, so_far = i[keep], j[keep], so_far[keep]
        keep = so_far <= bound[i] * (1 + 1e-9)
        i, j, so_far = i[keep], j[keep], so_far[keep]
        out_q.append(i)
        out_x.append(j + at)
        order = np.lexsort((so_far, i))
        i, so_far = i[order], so_far[order]
        place = np.arange(len(i)) - np.searchsorted(i, i)
        few = place < k
        new = np.full((len(q), k), np.inf)
        new[i[few], place[few]] = so_far[few]
        best = np.sort(np.concatenate([best, new], axis=1), axis=1)[:, :k]
        at += len(part)
        chunk = 256
    return np.concatenate(out_q), np.concatenate(out_x), read


class Lists:
    """Centroids of the lists in lengthened space, their sizes, and how many a query probes."""

    def __init__(self, centroids: np.ndarray, longest: float, probes: int = 1) -> None:
        self.centroids, self.longest, self.probes = centroids, longest, probes
        self.sizes = np.ones(len(centroids), np.int64)

    def home(self, x: np.ndarray) -> np.ndarray:
        return distances(lengthen(x, self.longest), self.centroids).argmin(axis=1)

    def order(self, q: np.ndarray) -> np.ndarray:
        """Lists of each query from the nearest on."""
        return np.argsort(distances(np.concatenate([q, np.zeros((len(q), 1))], axis=1), self.centroids), axis=1, kind="stable")

    def probed(self, q: np.ndarray, least: int) -> list[list[int]]:
        order = self.order(q)
        held = np.cumsum(self.sizes[order], axis=1)
        n = np.maximum(self.probes, (held < least).sum(axis=1) + 1)
        return [row[:m].tolist() for row, m in zip(order, n.tolist())]

    def calibrate(self, x: np.ndarray, k: int, target: float, queries: int = 200) -> None:
        """Probes that give sample queries the target share of their k nearest in the sample."""
        q = x[:queries]
        home = self.home(x)
        score = q @ x.T
        score[np.arange(len(q)), np.arange(len(q))] = -np.inf
        k = min(k, len(x) - 1)
        if k < 1:
            return
        near = np.argpartition(-score, k - 1, axis=1)[:, :k]
        rank = np.argsort(self.order(q), axis=1, kind="stable")
        ranks = np.take_along_axis(rank, home[near], axis=1)
        self.probes = int(np.quantile(ranks, target)) + 1


def _search(held, turn: np.ndarray, k: int):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        lists = held()
        side, least = table["side"].to_numpy(), table["bound"].to_numpy()
        x, ids = matrix(table["vec"]), table["id"].to_numpy()
        c, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        content = lengthen(x[c], lists.longest) @ turn
        found = [(np.zeros(0, np.int64),) * 2 + (np.zeros(0),)]
        for at in range(0, len(v), _AT_ONCE):
            q = v[at : at + _AT_ONCE]
            turned = np.concatenate([x[q], np.zeros((len(q), 1))], axis=1) @ turn
            limit = (turned * turned).sum(axis=1) + lists.longest**2 - 2 * least[q]
            i, j, _ = adaptive_scan(turned, content, k + 1, start=limit * (1 + 1e-9) + 1e-9)
            a, b = q[i], c[j]
            other = ids[a] != ids[b]
            a, b = a[other], b[other]
            score = np.einsum("ab,ab->a", x[a], x[b])
            good = score >= least[a]
            a, b, score = a[good], b[good], score[good]
            order = np.lexsort((ids[b], -score, a))
            a, b, score = a[order], b[order], score[order]
            few = np.arange(len(a)) - np.searchsorted(a, a) < k
            found.append((ids[a[few]], ids[b[few]], score[few]))
        a, b, s = (np.concatenate([f[m] for f in found]) for m in range(3))
        return pa.table({"query_id": a, "vec_id": b, "score": s})

    return run


def nearest(table: DataFrame, is_query: Column, k: int = 20, target: float = TARGET_RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) of the k rows found with the largest inner product, for each
    distinct id that ``is_query`` (an expression over ``id``) chooses."""
    vectors = persist(valid_vectors(table, key, column), "vectors")
    norm = F.sqrt(F.aggregate("vec", F.lit(0.0), lambda a, x: a + x * x))
    n, longest = vectors.agg(F.count("*"), F.max(norm)).first()
    schema = "query_id long, rank int, vec_id long, score double"
    if not n:
        return table.sparkSession.createDataFrame([], schema)
    wanted = int(np.clip(n // LIST_ROWS, 1, MOST_LISTS))
    sample = sample_matrix(vectors, sample_for(wanted))
    lists = Lists(kmeans(lengthen(sample, longest), wanted), longest)
    lists.calibrate(sample, k, target)
    first = ship(table.sparkSession, lists)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = first()
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"id": batch.column(0), "cell": held.home(matrix(batch.column(1))), "vec": batch.column(1)})

    placed = persist(vectors.mapInArrow(place, "id long, cell long, vec array<double>"), "lists")
    sizes = np.zeros(len(lists.centroids), np.int64)
    for cell, size in placed.groupBy("cell").count().collect():  # one row a list
        sizes[cell] = size
    lists.sizes = sizes
    second = ship(table.sparkSession, lists)
    least = k + 1

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = second()
        for batch in batches:
            if batch.num_rows:
                yield pa.record_batch({"id": batch.column(0), "cells": pa.array(held.probed(matrix(batch.column(1)), least), pa.list_(pa.int64())), "vec": batch.column(1)})

    queries = vectors.filter(is_query).dropDuplicates(["id"])
    visitors = persist(queries.mapInArrow(probe, "id long, cells array<long>, vec array<double>"), "probes")
    content = placed.withColumn("bound", F.lit(0.0))
    turn = rotation(sample.shape[1] + 1)
    by = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")

    def scan(part: DataFrame) -> DataFrame:
        found = blocks(content, part).groupBy("cell", "cs", "vs").applyInArrow(_search(second, turn, k), "query_id long, vec_id long, score double")
        return found.withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)

    nothing = F.lit(float("-inf"))
    near = visitors.select("id", F.explode(F.slice("cells", 1, FIRST_LISTS)).alias("cell"), "vec", nothing.alias("bound"))
    near = persist(scan(near), "near")
    bounds = near.filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("kth"))
    far = visitors.filter(F.size("cells") > FIRST_LISTS).join(bounds, "id", "left")
    far = far.select("id", F.explode(F.slice("cells", FIRST_LISTS + 1, MOST_LISTS)).alias("cell"), "vec", F.coalesce("kth", nothing).alias("bound"))
    ranked = near.unionByName(scan(far)).drop("rank").withColumn("rank", F.row_number().over(by)).filter(F.col("rank") <= k)
    out = persist(ranked.select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_persisted(vectors, placed, visitors, near)
    return out
