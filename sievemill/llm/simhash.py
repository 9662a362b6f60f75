"""SimHash near-duplicates, found with BK-trees (operator 7).

A fingerprint has 64 bits; bit i is 1 if it is set in over half of the document's shingle hashes.
Equal fingerprints are one entry with their smallest doc_id.  Two fingerprints within ``radius``
bits agree wholly on at least ``blocks - radius`` of ``blocks`` pieces of their bits, so a shard for
each choice of pieces and their value holds every pair that links.  Each shard is a BK-tree, with
children keyed by their integer Hamming distance to the parent, and a search follows only edges
within the radius.  Trees go to the task that holds their shard's queries rather than being
broadcast: together they hold the fingerprints of the whole corpus, so no bound on a broadcast would
hold, and they would have to pass through the driver.  The number of pieces grows with the number of
fingerprints so that shards stay small; shards that copies make large are dealt again by a second
choice of pieces, and what is then still large is cut into slices, each pair of which is a shard.

Cases: null text counts as empty; no words gives the zero fingerprint, linked like any other; null
doc_id takes no part in links and gets a null component; repeated rows get equal results, and of ties
the smallest id gives the component; a very long text is hashed whole, some thousand shingles at a
time; an empty table gives an empty result; other columns, whatever their names, are not read by
``near_duplicates`` and come back untouched from ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import as_text, batches_of, drop_persisted, give_back, join_counted, persist, worker_cache
from .components import components

#: Entries of a shard from which it is dealt again.
LARGE_SHARD = 4096
#: Shingles hashed at once.
_AT_ONCE = 1 << 16
#: Min-hashes of a sketch, four bits of each, and the bands of five of them that are shard keys: texts
#: with a similarity of 0.8 share one of the bands at a probability of 1 - (1 - 0.8 ** 5) ** 16 = 0.998.
_SKETCH, _BANDS, _BAND = 256, 16, 5


class Sketched(NamedTuple):
    bits: int
    sketch: bytes
    bands: list[int]


def fingerprint(text: bytes, words: int = 4, seed: int = 42, sketch: bool = False) -> int | Sketched:
    """The unsigned fingerprint of one UTF-8 text, and if asked a min-hash sketch of its shingles and
    the hashes of its bands."""
    from xxhash import xxh64_intdigest

    tokens = text.lower().split()
    if not tokens:
        return Sketched(0, bytes(_SKETCH // 2), [0] * _BANDS) if sketch else 0
    joined = b" ".join(tokens)
    sizes = np.fromiter(map(len, tokens), dtype=np.int64, count=len(tokens))
    ends = np.cumsum(sizes + 1) - 1
    starts, last = ends - sizes, max(0, len(tokens) - words)
    starts, ends = starts[: last + 1], ends[min(words, len(tokens)) - 1 :]
    ones, low = np.zeros(64, dtype=np.int64), np.full(_SKETCH, ~np.uint64(0))
    for at in range(0, len(starts), _AT_ONCE):
        spans = zip(starts[at : at + _AT_ONCE].tolist(), ends[at : at + _AT_ONCE].tolist())
        h = np.array([xxh64_intdigest(joined[s:e], seed) for s, e in spans], dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        if sketch:
            for k in range(0, len(h), 512):
                np.minimum(low, (h[k : k + 512, None] * _multipliers()).min(axis=0), out=low)
    bits = int(np.packbits(2 * ones > len(starts), bitorder="little").view("<u8")[0])
    if not sketch:
        return bits
    few = ((low >> np.uint64(20)) & np.uint64(15)).astype(np.uint8)
    band = np.zeros(_BANDS, np.uint64)
    for k in range(_BAND):
        band = (band ^ low[k : _BANDS * _BAND : _BAND]) * np.uint64(0x9E3779B97F4A7C15)
        band ^= band >> np.uint64(31)
    return Sketched(bits, (few[0::2] | few[1::2] << 4).tobytes(), band.view(np.int64).tolist())


def needed(similar: float) -> float:
    """Equal numbers among two sketches that stand for a similarity: one in sixteen is so by chance."""
    return _SKETCH * (similar + (1 - similar) / 16)


def _multipliers() -> np.ndarray:
    return worker_cache("multipliers", lambda: np.random.default_rng(3).integers(1, 1 << 63, _SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1))


def _fingerprints(words: int, seed: int, sketch: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text"):
            texts = as_text(batch.column(1)).cast(pa.binary())
            found = [fingerprint(t.as_py(), words, seed, sketch) for t in texts]
            out = {"doc_id": batch.column(0), "fp": np.array([x.bits if sketch else x for x in found], dtype=np.uint64).view(np.int64)}
            yield pa.record_batch(out | ({"sketch": pa.array([x.sketch for x in found], pa.binary()), "bands": pa.array([x.bands for x in found], pa.list_(pa.int64()))} if sketch else {}))

    return run


def fingerprints(docs: DataFrame, words: int = 4, seed: int = 42, sketch: bool = False) -> DataFrame:
    """(doc_id, fp) with fp as a signed bigint; with ``sketch``, also the sketch and its bands."""
    schema = "doc_id long, fp long" + (", sketch binary, bands array<long>" if sketch else "")
    return docs.select(F.col("doc_id").cast("long"), F.col("text")).mapInArrow(_fingerprints(words, seed, sketch), schema)


class BKTree:
    """Children of a node are keyed by their integer Hamming distance to it."""

    def __init__(self) -> None:
        self.codes: list[int] = []
        self.children: list[dict[int, int]] = []

    def insert(self, code: int) -> None:
        new = len(self.codes)
        self.codes.append(code)
        self.children.append({})
        at = 0
        while new:
            d = (code ^ self.codes[at]).bit_count()
            step = self.children[at].setdefault(d, new)
            if step == new:
                return
            at = step

    def within(self, code: int, radius: int) -> Iterator[int]:
        """Places (in order of insertion) of the codes within the radius."""
        codes, children = self.codes, self.children
        todo = [0] if codes else []
        while todo:
            at = todo.pop()
            d = (code ^ codes[at]).bit_count()
            if d <= radius:
                yield at
            for edge, child in children[at].items():
                if -radius <= edge - d <= radius:
                    todo.append(child)


def shard_links(codes: list[int], ids: list[int], radius: int, sketches: list[bytes] | None = None, similar: float = 0) -> list[tuple[int, int]]:
    """Links that join all of one shard's codes that links reach: a forest, not all pairs.  With
    sketches, a link also needs them to estimate a similarity of at least ``similar``."""
    tree, up, groups, out = BKTree(), list(range(len(codes))), 0, []
    table = np.frombuffer(b"".join(sketches), dtype=np.uint8).reshape(len(codes), -1) if sketches else None
    least = needed(similar)

    def alike(i: int, j: int) -> bool:
        other = table[i] ^ table[j]
        return _SKETCH - np.count_nonzero(other & 15) - np.count_nonzero(other & 240) >= least

    def root(i: int) -> int:
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    for new, code in enumerate(codes):
        groups += 1
        for old in tree.within(code, radius):
            a, b = root(new), root(old)
            if a != b and (table is None or alike(new, old)):
                up[a] = b
                groups -= 1
                out.append((ids[new], ids[old]))
                if groups == 1:  # all that is here is joined already
                    break
        tree.insert(code)
    return out


def _search(radius: int, similar: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, codes, ids, sketches, found = None, [], [], [], []

        def flush() -> None:
            if len(codes) > 1:
                found.extend(shard_links(codes, ids, radius, sketches or None, similar))
            codes.clear()
            ids.clear()
            sketches.clear()

        def out() -> pa.RecordBatch:
            a, b = zip(*found)
            found.clear()
            return pa.record_batch({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

        for batch in batches:
            columns = [batch.column(0).to_pylist(), batch.column(1).to_numpy().view(np.uint64).tolist(), batch.column(2).to_pylist()]
            if similar:
                columns.append(batch.column(3).to_pylist())
            for k, code, i, *sketch in zip(*columns):
                if k != key:
                    flush()
                    key = k
                codes.append(code)
                ids.append(i)
                sketches += sketch
            if len(found) > 100_000:
                yield out()
        flush()
        if found:
            yield out()
        give_back()

    return run


def _pieces(bits: list[int], n: int) -> list[int]:
    """Masks of n pieces of the given bits, as even as can be."""
    return [sum(1 << b for b in piece) for piece in np.array_split(np.array(bits), n) for piece in [piece.tolist()]]


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def blocks_for(n: int, radius: int) -> int:
    """Pieces such that shards of n random codes hold few: n / 2**bits kept under 64."""
    for blocks in range(radius + 1, radius + 6):
        if n >> (64 * (blocks - radius) // blocks) < 64:
            break
    return blocks


def _keys(blocks: int, radius: int) -> list[int]:
    pieces = _pieces(list(range(64)), blocks)
    return [sum(c) for c in combinations(pieces, blocks - radius)]


def _bands(codes: DataFrame, held: Column | None = None) -> DataFrame:
    """A row for each band, keyed by its number and hash (after the key held)."""
    keys = F.transform("bands", lambda x, i: F.xxhash64(*([held] if held is not None else []), i, x))
    return codes.select(F.explode(keys).alias("key"), *[c for c in codes.columns if c not in ("key", "bands")])


def _shards(codes: DataFrame, masks: list[int], held: Column | None = None) -> DataFrame:
    """A row for each mask, keyed by the mask's number and the masked code (after the key held)."""
    keys = [F.xxhash64(*([held] if held is not None else []), F.lit(i), F.col("fp").bitwiseAND(F.lit(_signed(m)))) for i, m in enumerate(masks)]
    rest = [c for c in codes.columns if c != "key"]
    return codes.select(F.explode(F.array(*keys)).alias("key"), *rest)


def link_codes(codes: DataFrame, radius: int, similar: float = 0) -> DataFrame:
    """Links (a, b) among (fp, id[, sketch, bands]) rows that join all pairs within the radius.

    Shard keys are hashes: a collision only puts two shards into one tree, which adds no link.  For
    wide radii (with ``similar``) pieces that surely agree are too short, so shards come from bands of
    the sketches' min-hashes: their recall follows from the similarity alone, whatever the rows.  A
    large shard of a band is not dealt by the other bands, which would lose links, but cut into slices.
    """
    if similar:
        shards = _bands(codes)
    else:
        first, second = _keys(blocks_for(codes.count(), radius), radius), _keys(radius + 2, radius)
        shards = _shards(codes, first)
    large = persist(shards.groupBy("key").count().filter(F.col("count") > LARGE_SHARD).select("key"), "large")
    out = shards
    if not large.isEmpty():
        again = shards.join(F.broadcast(large), "key", "left_semi")
        again = _sliced(again if similar else _shards(again, second, F.col("key")))
        out = shards.join(F.broadcast(large), "key", "left_anti").union(again)
    out = out.repartition("key").sortWithinPartitions("key", "id")
    return out.mapInArrow(_search(radius, similar), "a long, b long")


def _sliced(shards: DataFrame) -> DataFrame:
    """Shards that are still large, as a shard for each pair of their slices: every two entries meet
    in one of them, and none holds more than about ``LARGE_SHARD``."""
    rest = [c for c in shards.columns if c != "key"]
    sizes = shards.groupBy("key").agg(F.ceil(2 * F.count("*") / LARGE_SHARD).alias("m")).filter(F.col("m") > 2)
    sizes = persist(sizes, "still-large")
    if sizes.isEmpty():
        return shards
    own = F.pmod(F.xxhash64("id", F.lit(17)), F.col("m"))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("m") - 1), lambda j: F.xxhash64("key", F.least(j, own), F.greatest(j, own)))
    split = shards.join(F.broadcast(sizes), "key").select(F.explode(pairs).alias("key"), *rest)
    return shards.join(F.broadcast(sizes), "key", "left_anti").select("key", *rest).union(split)


def near_duplicates(docs: DataFrame, radius: int = 4, words: int = 4, seed: int = 42, similar: float = 0) -> DataFrame:
    """(doc_id, fp, component_id) for each row of ``docs`` (doc_id, text).

    ``similar`` asks for links that min-hash sketches of the same shingles confirm: the Jaccard
    similarity that they must estimate.  Equal fingerprints are then one entry only if their sketches
    are equal, too.
    """
    same = ["fp", "sketch"] if similar else ["fp"]
    fps = persist(fingerprints(docs, words, seed, bool(similar)), "fingerprints")
    more = [F.max("bands").alias("bands")] if similar else []
    counted = persist(fps.groupBy(*same).agg(F.min("doc_id").alias("id"), F.count("*").alias("n"), *more), "codes")
    codes = counted.filter("id IS NOT NULL").select("fp", "id", *(["sketch", "bands"] if similar else []))
    links = persist(link_codes(codes, radius, similar), "links")  # one Python worker a task at a time
    moved = components(links)
    ids = counted.join(moved, counted["id"] == moved["node"], "left").select(*same, "n", F.coalesce("component", "id").alias("component_id"))
    ids = persist(ids, "classes")
    out = join_counted(fps.drop("bands"), ids, same, "n")  # copies may be a third of all rows
    out = persist(out.select("doc_id", "fp", F.when(F.col("doc_id").isNotNull(), F.col("component_id")).alias("component_id")), "components")
    drop_persisted(fps, counted, links, moved, ids)
    return out


def keep_one(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is their component's, one row for each; null ids stay.

    Documents meet the ids that stay in one exchange, without a sort, at every size alike."""
    ids = found.filter("doc_id = component_id").select("doc_id")
    repeated = ids.groupBy("doc_id").count().filter("count > 1").limit(1).count()
    out = docs.join(ids.distinct().hint("shuffle_hash"), "doc_id", "left_semi")
    if repeated:
        out = out.dropDuplicates(["doc_id"])
    return out.union(docs.filter("doc_id IS NULL")).select(*docs.columns)


def hex16(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")
