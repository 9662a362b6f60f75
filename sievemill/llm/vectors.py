"""What the vector operators share: valid vectors, k-means, and blocks of bounded size.

A block is a slice of one cell's vectors with a slice of that cell's visitors (vectors that search
it).  Both slices are bounded, so a cell that holds a third of all rows becomes many blocks.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import persist

CONTENT_SLICE, VISITOR_SLICE = 2048, 4096
#: Vectors that codebooks are learned from: so many, or so many for each centroid; rounds of k-means,
#: and centroids from which they are learned in two levels.
SAMPLE, PER_CENTROID, ROUNDS, FLAT = 8192, 8, 8, 256


def valid_vectors(table: DataFrame, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(id, vec array<double>) of the rows with an id whose vectors can be compared: not null, not
    zero, all components finite, and as long as most such vectors are (of two lengths that are as
    common, the longer)."""
    v = F.col("vec")
    good = table.select(F.col(key).cast("long").alias("id"), F.col(column).cast("array<double>").alias("vec")).filter(
        F.col("id").isNotNull() & v.isNotNull() & ~F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))) & F.exists(v, lambda x: x != 0)
    )
    size = good.groupBy(F.size("vec").alias("size")).count().orderBy(F.desc("count"), F.desc("size")).first()
    return good.filter(F.size("vec") == (size[0] if size else 0))


def matrix(column: pa.Array) -> np.ndarray:
    """(rows, dimensions) of an array<double> column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


def sample_matrix(vectors: DataFrame, rows: int = SAMPLE) -> np.ndarray:
    """At most ``rows`` vectors, by hash of the id."""
    return matrix(vectors.orderBy(F.xxhash64("id"), "id").limit(rows).select("vec").toArrow()["vec"])


def sample_for(k: int) -> int:
    """Rows to learn k centroids from."""
    return max(SAMPLE, PER_CENTROID * k)


def kmeans(x: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """Centroids of k clusters; fewer if there are fewer distinct vectors.  Many clusters are made in
    two levels: clusters of clusters, each with its share of them."""
    r = np.random.default_rng(seed)
    x_distinct = np.unique(x, axis=0)
    k = min(k, len(x_distinct))
    if k > FLAT:
        top = kmeans(x, int(np.ceil(k**0.5)), seed)
        near = _nearest(x, top)
        sizes = np.bincount(near, minlength=len(top))
        share = np.maximum(1, np.floor(k * sizes / max(1, len(x)))).astype(int)
        return np.concatenate([kmeans(x[near == j], int(share[j]), seed + 1 + j) for j in range(len(top)) if sizes[j]])
    c = x_distinct[r.permutation(len(x_distinct))[:k]]
    for _ in range(ROUNDS):
        near = _nearest(x, c)
        counts = np.bincount(near, minlength=len(c))
        sums = np.stack([np.bincount(near, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        c = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], c)
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """The nearest centroid of each row, found for some rows at once."""
    return np.concatenate([distances(x[at : at + 4096], c).argmin(axis=1) for at in range(0, len(x), 4096)] or [np.zeros(0, np.int64)])


def distances(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Squared distances (rows, centroids)."""
    return (x * x).sum(axis=1)[:, None] + (c * c).sum(axis=1) - 2 * x @ c.T


def blocks(content: DataFrame, visitors: DataFrame) -> DataFrame:
    """Both sides dealt to blocks (cell, cs, vs); ``side`` is 0 for content and 1 for visitors.

    content and visitors have the same columns, among them cell and id; each cell's number of rows
    is counted, and the counts are broadcast: a row a cell, and the caller bounds the cells.
    """
    sizes = content.groupBy("cell").agg(F.count("*").alias("nc")).join(visitors.groupBy("cell").agg(F.count("*").alias("nv")), "cell")
    sizes = sizes.select("cell", F.ceil(F.col("nc") / CONTENT_SLICE).alias("nc"), F.ceil(F.col("nv") / VISITOR_SLICE).alias("nv"))
    sizes = persist(sizes, "cell-sizes")

    def dealt(side: DataFrame, own: str, other: str, names: tuple[str, str], kind: int) -> DataFrame:
        joined = side.join(F.broadcast(sizes), "cell")
        joined = joined.withColumn(names[0], F.pmod(F.xxhash64("id"), F.col(own))).withColumn(names[1], F.explode(F.sequence(F.lit(0).cast("long"), F.col(other) - 1)))
        return joined.select(*side.columns, F.col("cs").cast("long"), F.col("vs").cast("long"), F.lit(kind).alias("side"))

    return dealt(content, "nc", "nv", ("cs", "vs"), 0).unionByName(dealt(visitors, "nv", "nc", ("vs", "cs"), 1))
