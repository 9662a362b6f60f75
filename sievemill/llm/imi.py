"""Near-duplicate vectors by an inverted multi-index (operator 10).

Each half of the normalised vectors has its own codebook; a cell of their product grid is a pair of
centroids, and a vector lives in the cell of its nearest ones.  A multi-sequence traversal takes a
vector's cells in order of their distance (the sum of the two halves'), as many as it takes to
reach the target recall for pairs that are exactly as similar as the threshold; that number is
measured on a bounded sample of vectors with companions made at the threshold.  A pair is found if
either vector visits the other's cell, and its cosine is then verified in double precision.

Equal vectors are one class with a count.  Blocks count links and return a forest, never all pairs.
A pair that both sides find counts in the smaller cell alone.

Cases: invalid vectors (null, zero, null or non-finite components, another length) link with
nothing and are their own component; a null id gives a null component; repeated rows are copies, and
ties (equal vectors) link with each other; an empty table gives an empty result; other columns,
whatever their names, are not read.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_persisted, join_counted, persist, ship
from .components import components, smallest_labels
from .vectors import blocks, distances, kmeans, matrix, sample_matrix, valid_vectors

TARGET_RECALL = 0.97
#: Vectors a cell holds on average, and the most centroids of a half: the sizes of their 2 ** 18 cells
#: are broadcast (6 MB).  Beyond 8 million vectors cells grow with the table.
CELL_ROWS, MOST_CENTROIDS = 32, 512
_AT_ONCE = 256


def multi_sequence(first: np.ndarray, second: np.ndarray) -> Iterator[tuple[int, int]]:
    """Pairs of places in order of the sum of their distances, nearest first."""
    a, b = np.argsort(first, kind="stable"), np.argsort(second, kind="stable")
    heap, seen = [(first[a[0]] + second[b[0]], 0, 0)], {(0, 0)}
    while heap:
        _, i, j = heapq.heappop(heap)
        yield int(a[i]), int(b[j])
        for x, y in ((i + 1, j), (i, j + 1)):
            if x < len(a) and y < len(b) and (x, y) not in seen:
                seen.add((x, y))
                heapq.heappush(heap, (first[a[x]] + second[b[y]], x, y))


class Grid:
    """Two codebooks, and how many cells a vector visits."""

    def __init__(self, first: np.ndarray, second: np.ndarray, visits: int = 1) -> None:
        self.books, self.visits = (first, second), visits
        self.half = first.shape[1]

    def sums(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return distances(x[:, : self.half], self.books[0]), distances(x[:, self.half :], self.books[1])

    def cells(self, x: np.ndarray) -> np.ndarray:
        a, b = self.sums(x)
        return a.argmin(axis=1) * len(self.books[1]) + b.argmin(axis=1)

    def visited(self, x: np.ndarray) -> list[list[int]]:
        """The cells each vector visits, nearest first: its own is among them."""
        width = len(self.books[1])
        a, b = self.sums(x)
        out = []
        for p, q in zip(a, b):
            walk = multi_sequence(p, q)
            out.append([i * width + j for (i, j), _ in zip(walk, range(self.visits))])
        return out

    def calibrate(self, x: np.ndarray, cosine: float, target: float, seed: int = 2) -> None:
        """Visits by which either of two vectors at the threshold finds the other, often enough."""
        r = np.random.default_rng(seed)
        x = x[:1000]
        u = r.standard_normal(x.shape)
        u -= (u * x).sum(axis=1, keepdims=True) * x
        u /= np.maximum(np.linalg.norm(u, axis=1, keepdims=True), 1e-12)
        y = cosine * x + (1 - cosine**2) ** 0.5 * u
        width = len(self.books[1])

        def ranks(p: np.ndarray, home: np.ndarray) -> np.ndarray:
            a, b = self.sums(p)
            own = a[np.arange(len(p)), home // width] + b[np.arange(len(p)), home % width]
            return np.array([(s[:, None] + t[None, :] < o).sum() for s, t, o in zip(a, b, own)])

        rank = np.minimum(ranks(x, self.cells(y)), ranks(y, self.cells(x)))
        self.visits = int(np.quantile(rank, target)) + 1


def build_grid(vectors: DataFrame, n: int, cosine: float, target: float = TARGET_RECALL) -> Grid:
    x = sample_matrix(vectors)
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    half = max(1, x.shape[1] // 2)
    k = int(np.clip(round((n / CELL_ROWS) ** 0.5), 1, MOST_CENTROIDS))
    second = x[:, half:] if x.shape[1] > half else np.zeros((len(x), 0))
    grid = Grid(kmeans(x[:, :half], k), kmeans(second, k) if second.shape[1] else np.zeros((1, 0)))
    grid.calibrate(x, cosine, target)
    return grid


def _assign(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grid = held()
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(1))
            x = x / np.linalg.norm(x, axis=1, keepdims=True)
            yield pa.record_batch({"id": batch.column(0), "n": batch.column(2), "home": grid.cells(x), "visits": pa.array(grid.visited(x), pa.list_(pa.int64())), "vec": batch.column(1)})

    return run


def _verify(cosine: float):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        cell = key[0].as_py()
        side = table["side"].to_numpy()
        x = matrix(table["vec"])
        x = x / np.linalg.norm(x, axis=1, keepdims=True)
        ids, n, home = (table[c].to_numpy() for c in ("id", "n", "home"))
        c, v = np.flatnonzero(side == 0), np.flatnonzero(side == 1)
        visits = matrix(table["visits"].take(pa.array(c))) if len(c) else np.zeros((0, 0))
        own, links = np.zeros(len(ids), np.int64), [(np.zeros(0, np.int64),) * 2]
        for at in range(0, len(v), _AT_ONCE):
            q = v[at : at + _AT_ONCE]
            i, j = np.nonzero(x[q] @ x[c].T >= cosine)
            a, b = q[i], c[j]
            inside = home[a] == cell
            back = (visits[j] == home[a][:, None]).any(axis=1) if len(j) else inside
            good = np.where(inside, ids[a] < ids[b], ~back | (cell < home[a]))
            a, b = a[good], b[good]
            np.add.at(own, a, n[b])
            np.add.at(own, b, n[a])
            if len(a):
                node, low = smallest_labels(ids[a], ids[b])
                links.append((node[node != low], low[node != low]))
        a, b = (np.concatenate([x[k] for x in links]) for k in (0, 1))
        if len(a):
            a, b = smallest_labels(a, b)
            a, b = a[a != b], b[a != b]
        found = np.flatnonzero(own)
        return pa.table({"id": np.concatenate([ids[found], a]), "n": np.concatenate([own[found], np.zeros(len(a), np.int64)]), "other": pa.array([None] * len(found) + b.tolist(), pa.int64())})

    return run


def near_duplicates(table: DataFrame, cosine: float = 0.95, target: float = TARGET_RECALL, key: str = "vec_id", column: str = "embedding") -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of table."""
    vectors = persist(valid_vectors(table, key, column), "vectors")
    classes = persist(vectors.groupBy("vec").agg(F.min("id").alias("id"), F.count("*").alias("n")).select("id", "vec", "n"), "classes")
    # one vector may be a third of all rows: what many rows have is joined by a broadcast
    members = join_counted(vectors, classes.select("vec", F.col("id").alias("rep"), F.col("n").alias("copies"), F.col("n").alias("size")), ["vec"], "size")
    members = members.select("id", "rep", "copies").distinct()
    total, held_tables = classes.count(), [vectors, classes]
    if total:
        held = ship(table.sparkSession, build_grid(classes, total, cosine, target))
        placed = persist(classes.mapInArrow(_assign(held), "id long, n long, home long, visits array<long>, vec array<double>"), "cells")
        content = placed.withColumn("cell", F.col("home"))
        visitors = placed.withColumn("cell", F.explode("visits"))
        found = blocks(content, visitors).groupBy("cell", "cs", "vs").applyInArrow(_verify(cosine), "id long, n long, other long")
        found = persist(found, "links")
        counts = found.filter("other IS NULL").groupBy("id").agg(F.sum("n").alias("linked"))
        moved = components(found.filter("other IS NOT NULL").select("id", "other"))
        held_tables += [placed, found, moved]
        members = members.join(counts.withColumnRenamed("id", "rep"), "rep", "left").join(moved.withColumnRenamed("node", "rep"), "rep", "left")
    else:
        members = members.withColumns({"linked": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
    per_id = members.select("id", (F.coalesce("linked", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "rep").alias("component_id"))
    out = table.select(F.col(key).cast("long").alias("id")).join(per_id, "id", "left")
    out = out.select(F.col("id").alias("vec_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component_id", "id").alias("component_id"), (F.col("id") == F.coalesce("component_id", "id")).alias("kept"))
    out = persist(out, "near-vectors")
    drop_persisted(*held_tables)
    return out
