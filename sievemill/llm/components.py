"""Connected components of a table of links, by alternating large and small stars.

Each task first joins what its own links connect, so that few links are left; then every round
moves each node to the smallest neighbour it knows of.  Links stay in Spark tables throughout.  A
hub's links are spread over tasks: its smallest neighbour is aggregated before it is shuffled, and
comes back to the links by a broadcast of hubs, whose number is bounded.  Each round ends in a
scratch table, and the round before it is removed.

Cases: null ends and links of a node to itself are no links; repeated links count once; an empty
table gives an empty one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import drop_persisted, join_counted, persist

#: Links that a task joins at once.
BLOCK = 1 << 20


def smallest_labels(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and the smallest node that each reaches."""
    nodes, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        while True:
            jumped = new[new]
            if np.array_equal(jumped, new):
                break
            new = jumped
        if np.array_equal(new, label):
            return nodes, nodes[label]
        label = new


def _contract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: list[tuple[np.ndarray, np.ndarray]] = []

    def flush() -> pa.RecordBatch:
        nodes, low = smallest_labels(*(np.concatenate([h[i] for h in held]) for i in (0, 1)))
        moved = nodes != low
        held.clear()
        return pa.record_batch({"u": nodes[moved], "v": low[moved]})

    size = 0
    for batch in batches:
        if batch.num_rows:
            held.append((batch.column(0).to_numpy(), batch.column(1).to_numpy()))
            size += batch.num_rows
        if size >= BLOCK:
            yield flush()
            size = 0
    if held:
        yield flush()


def _large_star(links: DataFrame) -> DataFrame:
    both = links.union(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")).withColumn("low", F.least("u", "low"))
    low = persist(low, "lowest")
    out = join_counted(both, low, ["u"], "n").filter("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
    out = persist(out.distinct(), "large-star")
    drop_persisted(low)
    return out


def _small_star(links: DataFrame) -> DataFrame:
    low = persist(links.groupBy("u").agg(F.min("v").alias("low"), F.count("*").alias("n")), "lowest")
    out = join_counted(links, low, ["u"], "n").filter("v <> low").select(F.col("v").alias("u"), F.col("low").alias("v"))
    out = persist(out.union(low.select("u", F.col("low").alias("v"))).distinct(), "links")
    drop_persisted(low)
    return out


def components(links: DataFrame) -> DataFrame:
    """``links`` has two bigint columns.  Returns (node, component) for every node that is not the
    smallest of its component; nodes without links have no row, and null ends are no links."""
    a, b = links.columns[:2]
    links = links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v"))
    links = links.filter("u <> v").mapInArrow(_contract, "u long, v long")
    links, before = persist(links, "links"), None
    while True:
        now = links.agg(F.count("*"), F.sum(F.xxhash64("u", "v") % 1_000_000_007)).first()
        if not now[0] or now == before:
            return links.select(F.col("u").alias("node"), F.col("v").alias("component"))
        before = now
        wide = _large_star(links)
        drop_persisted(links)
        links = _small_star(wide)
        drop_persisted(wide)
