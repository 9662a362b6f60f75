"""What the operators share: scratch tables in the cluster's shared folder, and fast word splitting.

Scratch tables live under ``spark.checkpoint.dir``, which every executor can read; they replace
lineage, so a lost executor costs a reread and not a recomputation.
"""

from __future__ import annotations

import pickle
import sys
import tempfile
import types
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Keys with more rows than this, and than this part of all rows, are joined by a broadcast.
HOT_LEAST, HOT_SHARE = 500, 20_000
#: Rows of an Arrow batch of texts.
BATCH_ROWS = 2000
#: Bytes of text that a worker works on at once.
SLICE = 3 << 19


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.  A session on one machine that names none gets a
    temporary one; on a cluster that is an error, as no machine's own folder would do."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        held = spark.sparkContext._jsc.sc().getCheckpointDir()
        if held.isDefined():
            found = held.get()
        elif spark.sparkContext.master.split("[")[0] == "local":
            found = "file://" + tempfile.mkdtemp(prefix="sievemill-")
            spark.sparkContext.setCheckpointDir(found)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return found.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/sievemill/{name}-{uuid.uuid4().hex}"


def persist(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a scratch table and read it back: later uses read files, not the lineage."""
    path = scratch_path(df.sparkSession, name)
    with smaller_batches(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def fetch(df: DataFrame) -> pa.Table:
    """A table of bounded size, on the driver; texts on the way there go in small batches."""
    with smaller_batches(df.sparkSession):
        return df.toArrow()


def drop_persisted(*tables: DataFrame) -> None:
    """Remove the files of scratch tables once nothing reads them any more."""
    for df in tables:
        spark = df.sparkSession
        for path in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            if "/sievemill/" in path:
                at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
                at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def join_counted(many: DataFrame, one: DataFrame, keys: list[str], count: str, how: str = "inner") -> DataFrame:
    """``many`` joined with ``one``, which has a row for each value of the keys and how many rows of
    ``many`` have it.  Values that more than a ``HOT_SHARE`` of the rows have are few, so these are
    broadcast and leave the exchange; ``count`` does not come back."""
    total = one.agg(F.sum(count)).first()[0] or 0
    hot = one.filter(F.col(count) > max(HOT_LEAST, total // HOT_SHARE)).drop(count)
    few = hot.select(*keys)
    rest = one.filter(F.col(count) <= max(HOT_LEAST, total // HOT_SHARE)).drop(count)
    first = many.join(F.broadcast(hot), keys)
    second = many.join(F.broadcast(few), keys, "left_anti").join(rest, keys, how)
    return first.unionByName(second)


def ship(spark: SparkSession, model: object) -> Callable[[], object]:
    """Broadcast a model whose size does not depend on the data; the result gives it on an executor,
    where this package need not be installed."""
    held = spark.sparkContext.broadcast(cloudpickle.dumps(model))
    return lambda: pickle.loads(held.value)


def worker_cache(name: str, make: Callable[[], object]) -> object:
    """A value that outlives one task in a reused Python worker; made anew in any other worker."""
    store = sys.modules.get("_sievemill_worker_cache")
    if store is None:
        store = sys.modules["_sievemill_worker_cache"] = types.ModuleType("_sievemill_worker_cache")
    if not hasattr(store, name):
        setattr(store, name, make())
    return getattr(store, name)


def labelled_rows(docs: DataFrame, labels: DataFrame, values: list, rows: int) -> DataFrame:
    """(doc_id, text, label) of labelled documents, for classifiers that learn from a bounded number
    of rows: of each label in ``values`` at most ``rows``, by hash of the id, their texts whole.

    labels has (doc_id, label), one of its rows is taken for an id.  The ids are chosen first, each
    task keeping at most ``rows`` of a label, so that only the chosen texts leave the executors.
    """
    ids = labels.filter(F.col("label").isin(values)).groupBy("doc_id").agg(F.min("label").alias("label"))
    ids = ids.join(docs.select("doc_id"), "doc_id", "left_semi")
    # each label's ids below a threshold of their hash are somewhat more than ``rows``; the smallest of them are taken
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    enough = ids.groupBy("label").agg((F.lit(float(1 << 30)) * (1.3 * rows + 200) / F.count("*")).alias("enough"))
    few = ids.join(F.broadcast(enough), "label").filter(place < F.col("enough"))
    turn = F.row_number().over(Window.partitionBy("label").orderBy(place, "doc_id"))
    chosen = few.withColumn("turn", turn).filter(F.col("turn") <= rows).select("doc_id", "label")
    # an id that several rows have is learned from once, with the first of their texts
    texts = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return texts.groupBy("doc_id", "label").agg(F.min("text").alias("text")).select("doc_id", "text", "label")


def labelled_sample(docs: DataFrame, labels: DataFrame, values: list, rows: int) -> list[tuple[str, object]]:
    """(text, label) of ``labelled_rows``, in a fixed order."""
    found = fetch(labelled_rows(docs, labels, values, rows)).sort_by([("label", "ascending"), ("doc_id", "ascending")])
    return list(zip(found["text"].to_pylist(), found["label"].to_pylist()))


def as_text(column: pa.Array) -> pa.Array:
    """One string array without nulls (null text counts as empty)."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column.cast(pa.string()), "")
    return column


@contextmanager
def smaller_batches(spark: SparkSession, rows: int = BATCH_ROWS) -> Iterator[None]:
    """Arrow batches of at most so many rows for what runs inside: texts are long.  The session's own
    number comes back afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    own = spark.conf.get(name)
    if not 0 < int(own) <= rows:
        spark.conf.set(name, str(rows))
    try:
        yield
    finally:
        spark.conf.set(name, own)


def give_back() -> None:
    """Hand freed memory back to the system, where the C library can: idle workers hold on to it
    otherwise.  From the first call on, blocks of four megabytes are returned as soon as they are freed."""
    import ctypes

    pa.default_memory_pool().release_unused()
    try:
        libc = ctypes.CDLL("libc.so.6")
        worker_cache("mmap_threshold", lambda: libc.mallopt(-3, 4 << 20))
        libc.malloc_trim(0)
    except (OSError, AttributeError):
        pass


def keep_rows(docs: DataFrame, make: Callable[[], Callable[[pa.Array], np.ndarray]]) -> DataFrame:
    """The rows of docs whose text passes: ``make`` runs on the executor and gives a function from
    texts to a mask.  All columns come back as they are; nothing is shuffled."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        test = make()
        for batch in batches:
            part = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{k}" for k in range(batch.num_columns)])
            for piece in batches_of([part], f"c{at}", SLICE):
                out = piece.filter(pa.array(test(piece.column(at))))
                yield pa.RecordBatch.from_arrays(out.columns, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def batches_of(it: Iterable[pa.RecordBatch], column: str, limit: int = SLICE) -> Iterator[pa.RecordBatch]:
    """Slices of the batches whose ``column`` holds about ``limit`` bytes at most, or one row."""
    turn = 0
    for batch in it:
        n = batch.num_rows
        if not n:
            continue
        text = as_text(batch.column(batch.schema.get_field_index(column)))
        ends = np.cumsum(np.asarray(pc.binary_length(text)).astype(np.int64))
        at = 0
        while at < n:
            base = ends[at - 1] if at else 0
            to = max(at + 1, int(np.searchsorted(ends, base + limit, side="right")))
            yield batch.slice(at, to - at)
            at, turn = to, turn + 1
            if turn % 8 == 0:
                give_back()
    give_back()


_CHUNK = 1 << 18
_P = 0x9E3779B97F4A7C55
_M64 = (1 << 64) - 1


def _powers() -> tuple[np.ndarray, np.ndarray]:
    def table(x: int) -> np.ndarray:
        out = np.full(_CHUNK + 1, x, dtype=np.uint64)
        out[0] = 1
        return np.cumprod(out)

    return table(_P), table(pow(_P, -1, 1 << 64))


def _luts() -> tuple[np.ndarray, np.ndarray]:
    space = np.zeros(256, dtype=bool)
    space[[0x20, *range(0x09, 0x0E)]] = True
    lower = np.arange(256, dtype=np.uint8)
    lower[65:91] += 32
    return space, lower


class Words(NamedTuple):
    """``ids[bounds[d]:bounds[d + 1]]`` are the words of row d, as places in ``unique`` (bytes)."""

    unique: list
    ids: np.ndarray
    bounds: np.ndarray


def _tail_starts(b: np.ndarray, starts: np.ndarray, ends: np.ndarray, marks: bytes) -> np.ndarray:
    """Where the marks begin that end a word, of the words in which a letter or digit comes before them."""
    kind = np.zeros(256, dtype=bool)
    kind[list(marks)] = True
    few = np.flatnonzero(kind[b[ends - 1]])
    starts, tail = starts[few], ends[few] - 1
    more = np.arange(len(few))
    for _ in range(32):  # one mark further back, in the words that have one more
        more = more[tail[more] > starts[more]]
        more = more[kind[b[tail[more] - 1]]]
        if not len(more):
            break
        tail[more] -= 1
    for k in more.tolist():  # long runs
        letters = np.flatnonzero(~kind[b[starts[k] : tail[k]]])
        tail[k] = starts[k] + (letters[-1] + 1 if len(letters) else 0)
    inside = tail > starts
    tail, starts = tail[inside], starts[inside]
    alnum = np.array([chr(x).isalnum() and x < 128 for x in range(256)])
    one, two = b[tail - 1], b[np.maximum(tail - 2, 0)]
    latin = (tail - 2 >= starts) & (one >= 0x80) & (two >= 0xC3) & (two <= 0xC5) & ~((two == 0xC3) & ((one == 0x97) | (one == 0xB7))) & ~((two == 0xC4) & (one == 0xB0))  # signs; an I with a dot that lower case makes a mark
    return tail[alnum[one] | latin]


def split_words(text: pa.Array, lower: bool = True, marks: bytes = b"") -> Words:
    """Words ``[^\\x20\\x09-\\x0D]+`` of each row, A-Z lower-cased if asked; with ``marks``, those that
    end a word after a (Latin) letter or digit are a word of their own.

    Words are numbered through a 64-bit polynomial hash of their bytes, computed over the whole
    buffer at once, so that Python touches each distinct word of a batch once only.
    """
    text = as_text(text)
    n = len(text)
    offsets = np.frombuffer(text.buffers()[1], dtype=np.int32)[text.offset : text.offset + n + 1].astype(np.int64)
    data = np.frombuffer(text.buffers()[2], dtype=np.uint8)[: offsets[-1]] if text.buffers()[2] is not None and n else np.zeros(0, np.uint8)
    space, low = worker_cache("luts", _luts)
    power, inverse_power = worker_cache("powers", _powers)
    edges = np.unique(offsets)
    keys, starts, ends = [], [], []
    at, end = int(offsets[0]) if n else 0, int(offsets[-1]) if n else 0
    while at < end:
        to = min(at + _CHUNK, end)
        if to < end:  # cut where a word ends: after white space or between rows
            back = np.flatnonzero(space[data[at:to]])
            cut = max(at + int(back[-1]) + 1 if len(back) else at, int(edges[np.searchsorted(edges, to, side="right") - 1]))
            if cut > at:
                to = cut
            else:  # one word fills the chunk: take all of it
                stop = np.flatnonzero(space[data[to:end]])
                to = min(to + int(stop[0]) if len(stop) else end, int(edges[np.searchsorted(edges, to)]))
        b = data[at:to]
        if lower:
            b = low[b]
        solid = ~space[b]
        before, after = np.empty_like(solid), np.empty_like(solid)
        before[0] = after[-1] = False
        before[1:], after[:-1] = solid[:-1], solid[1:]
        cuts = edges[(edges > at) & (edges < to)] - at
        before[cuts] = False
        after[cuts - 1] = False
        s, e = np.flatnonzero(solid & ~before), np.flatnonzero(solid & ~after) + 1
        if len(s):
            if marks:
                tail = _tail_starts(b, s, e, marks)
                s, e = (np.sort(np.concatenate([x, tail]), kind="stable") for x in (s, e))  # two ascending runs
            if len(b) <= _CHUNK:
                c = np.zeros(len(b) + 1, dtype=np.uint64)
                np.cumsum((b.astype(np.uint64) + np.uint64(1)) * power[: len(b)], out=c[1:])
                h = (c[e] - c[s]) * inverse_power[s]
            else:
                raw = b.tobytes()
                h = np.array([_slow_hash(raw[x:y]) for x, y in zip(s.tolist(), e.tolist())], dtype=np.uint64)
            keys.append(h)
            starts.append(s + at)
            ends.append(e + at)
        at = to
    if not keys:
        return Words([], np.zeros(0, np.int32), np.zeros(n + 1, np.int64))
    h = np.concatenate(keys)
    h ^= h >> np.uint64(32)
    s, e = np.concatenate(starts), np.concatenate(ends)
    ids, distinct = pd.factorize(h)  # by a hash table: in order of appearance
    first = np.empty(len(distinct), np.int64)
    first[ids[::-1]] = np.arange(len(h))[::-1]
    raw = data.tobytes().lower() if lower else data.tobytes()
    unique = [raw[x:y] for x, y in zip(s[first].tolist(), e[first].tolist())]
    return Words(unique, ids.astype(np.int32), np.searchsorted(s, offsets))


def _slow_hash(word: bytes) -> int:
    h, p = 0, 1
    for x in word:
        h = (h + (x + 1) * p) & _M64
        p = p * _P & _M64
    return h


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Places start, start + 1, ... of each of the given runs, one after the other."""
    total = int(lengths.sum())
    if not total:
        return np.zeros(0, np.int64)
    ends = np.cumsum(lengths)
    out = np.arange(total, dtype=np.int64)
    out += np.repeat(starts - (ends - lengths), lengths)
    return out
