"""Packing documents into sequences by lexical retrieval (operator 2).

Documents are tokenized once, each distinct word of a batch once, and kept as a scratch table.
Token counts over all documents give BM25's document frequencies and mean length.  Documents are
dealt to shards of about ``SHARD_TOKENS`` tokens by what they say: a random projection of their
tokens, rarer ones (by their rank in the vocabulary) weighing more, is kept with them and puts them
into a cluster, and a place along a line inside it, and shards are runs of these cells, so that a document's neighbours, and above all its copies, are in its
own shard however many shards there are.  Each shard has its own inverted index.  A window's seed (the
document that begins it) asks the index, with all of its terms, for its unused neighbours, which fill
the window best first; a document cut at the window's end seeds the next one.  What is left at the
end of a shard is cut into powers of two, so nothing needs padding.

Cases: null text counts as empty, and an empty document is its end id alone; rows are packed as
they are, repeated or with a null doc_id alike; ties of scores go to the row that comes first by id
and tokens; a document longer than a window fills several, and one longer than a shard is a shard; an
empty table gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import batches_of, give_back, persist, ragged, ship, split_words, worker_cache
from .vectors import distances, kmeans

WINDOW, END = 2048, 1
SHARD_TOKENS = 1 << 20
#: Neighbours that an answer of the index has; when a window needs more, the seed asks again.
NEIGHBOURS = 32
K1, B = 1.2, 0.75
#: Terms that more than this part of a shard's documents have are held as columns, not as postings.
COMMON = 4
#: Dimensions of the projection, documents that clusters are learned from, the most clusters, and the
#: places along a cluster's line.
DIMENSIONS, SAMPLE, MOST_CLUSTERS, PLACES = 16, 8192, 4096, 64
#: Strings after which a worker begins another generation of those it remembers.
REMEMBERED = 200_000
_MARKS = b".,;:!?#$%&*"
PIECE_SCHEMA = "doc_id {}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class WordTokens:
    """Ids of white-space separated words by a tokenizer whose words don't reach over white space.

    The tokenizer lower-cases and parts letters and digits from marks, so marks after these are tokenized
    apart.  Letters alone, and marks alone, are a single word of the tokenizer's model, which is asked
    directly; any other word goes through the whole tokenizer.  (Lower-cased, a dotted capital I is no
    letters alone, and goes there, too.)  A worker remembers the ids of what it met in its last ``REMEMBERED`` strings or more, in two
    generations.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.young, self.old = Tokenizer.from_file(path), {}, {}
        self.model = self.tokenizer.model
        # the model's letters for bytes: printable ones stand for themselves, the others follow from 256 on
        own = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [x for x in range(256) if x not in own]
        self.letters = {x: x for x in own} | {x: 256 + k for k, x in enumerate(rest)}

    def _learn(self, part: bytes) -> bytes:
        """Ids of a word, or of the marks after one."""
        text = None
        if part.isalpha() or not part.strip(_MARKS):
            text = part.decode().lower()
        elif max(part) < 0xC6 and (lower := part.decode().lower()).isalpha():  # Latin letters
            text = lower.encode().decode("latin-1").translate(self.letters)
        if text is not None:
            ids = [t.id for t in self.model.tokenize(text)]
        else:
            ids = self.tokenizer.encode(part.decode(), add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}I", *ids)

    def of(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all parts in a row, and how many each has."""
        if len(self.young) > REMEMBERED:
            self.young, self.old = {}, self.young
        young, old, learn = self.young, self.old, self._learn
        found = list(map(young.get, parts))
        for k, ids in enumerate(found):
            if ids is None:
                part = parts[k]
                ids = old.get(part)
                if ids is None:
                    ids = learn(part)
                young[part] = found[k] = ids
        return np.frombuffer(b"".join(found), dtype="<u4"), np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4


def tokenize(text: pa.Array, tokens: WordTokens, end: int = END) -> tuple[np.ndarray, np.ndarray]:
    """Ids of all rows in a row, each row's followed by ``end``, and the bounds of the rows."""
    w = split_words(text, lower=False, marks=_MARKS)
    flat, sizes = tokens.of(w.unique)
    flat, sizes = np.append(flat, np.uint32(end)), np.append(sizes, 1)
    starts = np.cumsum(sizes) - sizes
    word = np.insert(w.ids, w.bounds[1:], len(w.unique))
    out = flat[ragged(starts[word], sizes[word])]
    bounds = np.append(0, np.cumsum(sizes[word]))[np.append(0, w.bounds[1:] + np.arange(1, len(w.bounds)))]
    return out, bounds


def _tokenized(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, tokens, ids, vec) of every row, and one row a task whose ids are its document frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = worker_cache("tokens:" + path, lambda: WordTokens(path))
        weights = worker_cache("weights:" + path, lambda: projection(tokens.tokenizer.get_vocab_size()))
        seen = np.zeros(tokens.tokenizer.get_vocab_size(), dtype="<i8")
        there, kind = np.zeros((64, len(seen)), np.uint8), None
        for batch in batches_of(batches, "text", 4 << 20):
            ids, bounds = tokenize(batch.column(1), tokens)
            cut = bounds.tolist()
            for at in range(0, batch.num_rows, len(there)):
                rows = min(len(there), batch.num_rows - at)
                for k in range(rows):
                    there[k, ids[cut[at + k] : cut[at + k + 1]]] = 1
                seen += there[:rows].sum(axis=0, dtype=np.uint8)
                there[:rows] = 0
            small, kind = ids.astype("<u2") if len(seen) <= 1 << 16 else ids.astype("<u4"), batch.column(0).type
            yield pa.record_batch({"doc_id": batch.column(0), "tokens": np.diff(bounds), "ids": _binary(small, bounds), "vec": _binary(project(weights, ids, bounds), np.arange(len(bounds)) * DIMENSIONS)})
        give_back()
        if kind is not None:
            yield pa.record_batch({"doc_id": pa.nulls(1, kind), "tokens": np.array([-1]), "ids": pa.array([seen.tobytes()], pa.binary()), "vec": pa.nulls(1, pa.binary())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, tokens long, ids binary, vec binary")


def _binary(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """A binary column whose rows are the slices of ``flat`` between the bounds."""
    data = np.ascontiguousarray(flat)
    offsets = (bounds * data.itemsize).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(offsets), pa.py_buffer(data)])


def projection(terms: int, seed: int = 13) -> np.ndarray:
    """A random vector of each token, longer the further back its rank in the vocabulary is."""
    r = np.random.default_rng(seed)
    return (r.standard_normal((terms, DIMENSIONS)) * np.log1p(np.arange(terms) / 64)[:, None]).astype(np.float32)


def project(weights: np.ndarray, ids: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Unit vectors of documents (their ids with the end id, which does not count); zero of an empty one."""
    sizes = np.diff(bounds)
    out = np.zeros((len(sizes), DIMENSIONS), np.float32)
    at = 0
    while at < len(sizes):  # documents of some ten thousand ids at a time, or one
        to = max(at + 1, int(np.searchsorted(bounds, bounds[at] + (1 << 15), side="right")) - 1)
        out[at:to] = np.add.reduceat(weights[ids[bounds[at] : bounds[to]]], bounds[at:to] - bounds[at], axis=0)
        at = to
    out -= weights[ids[bounds[1:] - 1]]
    out[sizes <= 1] = 0
    return out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-9)


def _sum_vectors(parts: DataFrame) -> np.ndarray:
    """The sum of binary int64 vectors, added up in rounds so that few reach the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for x in batch.column(0):
                v = np.frombuffer(x.as_py(), dtype="<i8")
                total = v if total is None else total + v
        if total is not None:
            yield pa.record_batch({"ids": pa.array([total.tobytes()], pa.binary())})

    n = parts.count()
    while n > 64:
        n = max(1, n // 32)
        parts = persist(parts.repartition(n).mapInArrow(run, "ids binary"), "frequencies")
    found = parts.collect()
    return sum(np.frombuffer(r[0], dtype="<i8") for r in found) if found else np.zeros(0, np.int64)


class Bm25:
    """Inverted index of one shard; terms that many of its documents have are columns of a matrix."""

    def __init__(self, ids: np.ndarray, bounds: np.ndarray, idf: np.ndarray, mean_length: float) -> None:
        sizes = np.diff(bounds)
        self.n = len(sizes)
        pair, tf = np.unique(np.repeat(np.arange(self.n), sizes) * len(idf) + ids, return_counts=True)
        doc, term = (pair // len(idf)).astype(np.int32), (pair % len(idf)).astype(np.int32)
        del pair
        weight = (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * sizes[doc] / max(mean_length, 1e-9)))).astype(np.float32)
        self.terms, self.first = term, np.searchsorted(doc, np.arange(self.n + 1))  # each document's terms
        order = np.argsort(term, kind="stable")
        self.docs, self.weights = doc[order], weight[order]
        self.begin = np.searchsorted(term[order], np.arange(len(idf) + 1))
        held = np.diff(self.begin)
        common = np.flatnonzero(held > max(64, self.n // COMMON))
        self.column = np.full(len(idf), -1, np.int32)
        self.column[common] = np.arange(len(common))
        self.matrix = np.zeros((self.n, len(common)), np.float32)
        for k, t in enumerate(common.tolist()):
            at = slice(self.begin[t], self.begin[t + 1])
            self.matrix[self.docs[at], k] = self.weights[at]

    def scores(self, seed: int) -> np.ndarray:
        """BM25 of all documents for a query of all the seed's terms."""
        terms = self.terms[self.first[seed] : self.first[seed + 1]]
        column = self.column[terms]
        asked = np.zeros(self.matrix.shape[1], np.float32)
        asked[column[column >= 0]] = 1
        rare = terms[column < 0]
        at = ragged(self.begin[rare], self.begin[rare + 1] - self.begin[rare])
        return np.bincount(self.docs[at], weights=self.weights[at], minlength=self.n) + self.matrix @ asked

    def neighbours(self, seed: int, unused: np.ndarray) -> list[int]:
        """Unused documents that share a term with the seed, best first, ties to the earlier."""
        if self.first[seed] == self.first[seed + 1]:
            return []
        score = self.scores(seed) * unused
        top = np.flatnonzero(score >= np.partition(score, self.n - NEIGHBOURS)[self.n - NEIGHBOURS]) if self.n > 4 * NEIGHBOURS else np.arange(self.n)
        top = top[np.lexsort((top, -score[top]))][:NEIGHBOURS]
        return top[score[top] > 0].tolist()


def order_documents(index: Bm25, sizes: np.ndarray, window: int = WINDOW) -> list[int]:
    """All documents, in the order in which windows take them."""
    unused = np.ones(index.n, dtype=bool)
    out: list[int] = []
    filled, following, seed, near = 0, 0, None, []
    while len(out) < index.n:
        take = None
        if seed is not None:
            while near and not unused[near[0]]:
                near.pop(0)
            if not near:
                near = index.neighbours(seed, unused)
            if near:
                take = near.pop(0)
        if take is None:
            while not unused[following]:
                following += 1
            take = following
        unused[take] = False
        out.append(take)
        began = filled
        filled += int(sizes[take])
        if seed is None or filled // window > began // window:  # it begins a window, or goes on in one
            near = []
            seed = take if filled % window else None
    return out


def cut(sizes: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Where sequences begin in ``sizes.sum()`` ids: every window, then powers of two; with the end."""
    total = int(sizes.sum())
    full, rest = divmod(total, window)
    starts = list(range(0, full * window, window))
    at, bit = full * window, window
    while rest:
        bit >>= 1
        if rest & bit:
            starts.append(at)
            at, rest = at + bit, rest - bit
    return np.array([*starts, total], dtype=np.int64)


def _pack_shard(idf: np.ndarray, mean_length: float, window: int, wide: str):
    def run(key: tuple, table: pa.Table) -> pa.Table:
        table = table.sort_by([("doc_id", "ascending"), ("tokens", "ascending"), ("ids", "ascending")])
        ids = [np.frombuffer(x.as_py(), dtype=wide) for x in table["ids"].combine_chunks()] if table.num_rows else []
        sizes = table["tokens"].to_numpy()
        bounds = np.append(0, np.cumsum(sizes))
        flat = np.concatenate(ids)
        term = np.ones(len(flat), dtype=bool)
        term[bounds[1:] - 1] = False  # the end id is none
        index = Bm25(flat[term].astype(np.int64), bounds - np.arange(len(bounds)), idf, mean_length)
        order = np.array(order_documents(index, sizes, window))
        del index
        begin = np.cumsum(sizes[order]) - sizes[order]
        seq = cut(sizes, window)
        piece = np.union1d(begin, seq[:-1])
        ends = np.append(piece[1:], seq[-1])
        doc = np.searchsorted(begin, piece, side="right") - 1
        number = np.searchsorted(seq, piece, side="right") - 1
        start = piece - begin[doc]
        own = order[doc]
        at = bounds[own] + start
        size = ends - piece
        crc = [zlib.crc32(flat[a : a + n].astype("<u4").tobytes()) for a, n in zip(at.tolist(), size.tolist())]
        return pa.table({"doc_id": table["doc_id"].combine_chunks().take(pa.array(own)), "start": start, "length": size, "ids_crc32": np.array(crc, dtype=np.int64), "doc_tokens": sizes[own], "sequence_id": key[0].as_py() * (1 << 32) + number, "offset": piece - seq[number]})

    return run


class Cells:
    """Where documents are put by what they say: a cluster, and a place along a line inside it."""

    def __init__(self, centroids: np.ndarray, seed: int = 17) -> None:
        line = np.random.default_rng(seed).standard_normal(DIMENSIONS)
        self.line, self.centroids = line / np.linalg.norm(line), centroids

    def of(self, vectors: np.ndarray) -> np.ndarray:
        """cluster * PLACES + place."""
        near = distances(vectors, self.centroids).argmin(axis=1)
        along = (vectors - self.centroids[near]) @ self.line  # between -2 and 2, most of them near 0
        place = np.clip((np.arctan(4 * along) / np.pi + 0.5) * PLACES, 0, PLACES - 1).astype(np.int64)
        return near * PLACES + place


def _vectors(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.float32).reshape(-1, DIMENSIONS).astype(np.float64)


def _deal(texts: DataFrame, n: int, total: int, shard_tokens: int) -> DataFrame:
    """(shard, doc_id, tokens, ids) of every row.

    The tokens of each cell are counted; in order of cells, shards take as many as they hold.  A cell
    that holds more than a shard (many copies) is dealt to several by the rows' places in the table.
    """
    spark, cells = texts.sparkSession, Cells(np.zeros((1, DIMENSIONS)))
    sample = texts.select("vec").sample(min(1.0, 1.1 * SAMPLE / max(1, n)), 7).limit(SAMPLE).toArrow()["vec"]
    if len(sample):
        cells.centroids = kmeans(_vectors(sample), int(np.clip(2 * total // shard_tokens, 1, MOST_CLUSTERS)))
    held = ship(spark, cells)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held()
        size = np.zeros(len(own.centroids) * PLACES, np.int64)
        for batch in batches:
            if batch.num_rows:
                np.add.at(size, own.of(_vectors(batch.column(0))), batch.column(1).to_numpy())
        used = np.flatnonzero(size)
        yield pa.record_batch({"cell": used, "tokens": size[used]})

    found = texts.select("vec", "tokens").mapInArrow(count, "cell long, tokens long").groupBy("cell").agg(F.sum("tokens")).toArrow()
    size = np.zeros(len(cells.centroids) * PLACES, np.int64)
    size[found.column(0).to_numpy()] = found.column(1).to_numpy()
    parts = np.maximum(1, -(-size // shard_tokens))  # shards that a cell has for itself, or 1
    first, shard, filled = np.zeros(len(size), np.int64), 0, 0
    for c in np.flatnonzero(size).tolist():
        if filled and filled + size[c] > shard_tokens:
            shard, filled = shard + 1, 0
        first[c] = shard
        filled += size[c]
        if parts[c] > 1:
            shard, filled = shard + int(parts[c]), 0
    dealt = ship(spark, (first, parts))

    @F.pandas_udf("long")
    def shard_of(columns: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        own, (begin, several) = held(), dealt()
        for vec, row in columns:
            cell = own.of(_vectors(pa.array(vec, pa.binary())))
            yield pd.Series(begin[cell] + row.to_numpy() % several[cell])

    return texts.select(shard_of("vec", F.monotonically_increasing_id()).alias("shard"), "doc_id", "tokens", "ids")


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """Pieces of all rows of docs (doc_id, text); the window is a power of two."""
    table = persist(_tokenized(docs, tokenizer_path), "tokens")
    seen = _sum_vectors(table.filter("tokens < 0").select("ids"))
    texts = table.filter("tokens >= 0")
    n, total = texts.agg(F.count("*"), F.coalesce(F.sum("tokens"), F.lit(0))).first()
    idf = np.log1p((n - seen + 0.5) / (seen + 0.5)) if len(seen) else np.zeros(1)
    idf = np.maximum(idf, 0.0)
    kind = docs.schema["doc_id"].dataType.simpleString()
    wide = "<u2" if len(seen) <= 1 << 16 else "<u4"
    run = _pack_shard(idf, total / max(n, 1), window, wide)
    return _deal(texts, n, total, shard_tokens).groupBy("shard").applyInArrow(run, PIECE_SCHEMA.format(kind))
