"""Language-model scores by a subword lattice (operator 3).

Words are separated by white space, A-Z lower-cased, and each text ends with one end token.  Pieces
and their weights come from an existing vocabulary: its scores give each piece a probability, of
which a share of ``PRIOR`` stays, and the rest is fitted by one round of expectation-maximisation
over the distinct words of the training texts (with ``PRIOR`` 1 nothing is fitted).  A word (with the
space before it) has the sum of the probabilities of all its segmentations, by a forward recursion in
log space; single bytes are pieces, so every word has some.  The text's probability interpolates this
with the training texts' word counts: a word seen in training is one more edge over its whole length,
with its count less a discount; what the discounts leave is the share of the pieces.  No edge reaches
over a space, so a text's marginal probability is the product of its words' and the end's.  A plain
add-one unigram model over words comes beside it.

Word counts cover all training texts and are shuffled by word.  Scoring looks the ``HOT`` commonest
words up in a broadcast table of that size, which takes away the frequent keys, and joins the other
words of all texts with the table of counts.

Cases: null or empty text is its end token alone; a very long text is split in slices of whole rows
and counted like any other, and a very long word has a lattice of its length; a null doc_id counts as
the empty string for the split; repeated rows are scored each, and ties (equal texts) alike; without
training texts counts are zero and the pieces keep the vocabulary's probabilities; an empty table
gives an empty result; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches_of, persist, ship, split_words
from .packing import _sum_vectors

#: Commonest words that are broadcast; those of more bytes than this by their digests.
HOT, HOT_BYTES = 1 << 17, 64
#: Taken from each training word's count, for what is spelt in pieces.
DISCOUNT = 0.7
#: Added to the ranks that a vocabulary's scores stand for, before they weigh pieces.
ZIPF = 10.0
#: Share of the vocabulary's own probabilities in the pieces'; the rest is fitted.
PRIOR = 0.5
#: Rounds of fitting.
FITS = 2
#: The probability that all byte pieces share at first.
BYTES_SHARE = 1e-3


#: Bytes of a word from which it has a lattice of its own; cells of a matrix of words, about.
LONG, _CELLS = 128, 1 << 20
#: Natural logarithms that a double holds, with room for a product of three.
_REACH = 600.0
_FACTOR, _FILTER = np.uint64(0x9E3779B97F4A7C55), 20


def _hash(piece: bytes) -> int:
    h = 0
    for x in piece:
        h = (h * int(_FACTOR) + x + 1) & ((1 << 64) - 1)
    return h


def _place(hashes: np.ndarray) -> np.ndarray:
    return ((hashes * np.uint64(0xD1B54A32D192ED03)) >> np.uint64(64 - _FILTER)).astype(np.int64)


class Lattice:
    """Pieces (bytes, a space for the mark of a word's start) with natural log probabilities."""

    def __init__(self, pieces: list[bytes], logp: np.ndarray) -> None:
        self.pieces, self.logp = pieces, logp
        self._index()

    def _index(self) -> None:
        values = self.logp.tolist()
        self.of = {p: (k, values[k]) for k, p in enumerate(self.pieces)}
        self.longest: dict[bytes, int] = {}
        for p in self.pieces:
            self.longest[p[:2]] = max(self.longest.get(p[:2], 0), len(p))
        several = [k for k, p in enumerate(self.pieces) if len(p) > 1]
        hashes = np.array([_hash(self.pieces[k]) for k in several], dtype=np.uint64)
        place = _place(hashes)
        order = np.argsort(place, kind="stable")
        self.numbers = np.array(several, dtype=np.int32)[order]
        self.most = max((len(self.pieces[k]) for k in several), default=1)
        self.maybe = np.zeros(1 << _FILTER, dtype=bool)  # most parts of words are no pieces: a first test
        self.maybe[place] = True
        # pieces of one place follow each other; steps beyond the last stay on its hash, which is found before
        own, self.first = place[order], np.zeros(1 << _FILTER, dtype=np.int32)
        self.first[own[::-1]] = np.arange(len(own), dtype=np.int32)[::-1]
        self.chain = int(np.bincount(own).max()) - 1 if len(own) else 0
        self.hashes = np.concatenate([hashes[order], np.repeat(hashes[order][-1:], self.chain)])
        self.low = min(values[k] for k, p in enumerate(self.pieces) if len(p) == 1)
        self.high = max(max(values), 0.0)

    @classmethod
    def from_vocabulary(cls, pieces: list[str], scores: list[float]) -> Lattice:
        """The vocabulary's scores weigh the pieces: a score of 0 is the commonest, and weights fall by
        Zipf's law, 1 / (``ZIPF`` - score), as the scores of this kind of vocabulary are minus ranks.
        Bytes come first, then pieces without inner spaces."""
        texts: dict[bytes, float] = {}
        for p, s in zip(pieces, scores):
            b = p.replace("▁", " ").encode()
            if len(b) > 1 and b" " not in b[1:] and s <= 0:
                texts[b] = max(s, texts.get(b, -np.inf))
        known = sorted(texts)
        p = 1 / (ZIPF - np.array([texts[b] for b in known]))
        p *= (1 - BYTES_SHARE) / max(p.sum(), 1e-300)
        return cls([bytes([x]) for x in range(256)] + known, np.log(np.concatenate([np.full(256, BYTES_SHARE / 256), p])))

    def edges(self, word: bytes) -> list[list[tuple[int, int, float]]]:
        """For each place, the pieces that begin there: (end, piece, log probability)."""
        of, longest, n, out = self.of, self.longest, len(word), []
        for i in range(n):
            k, lp = of[word[i : i + 1]]
            here = [(i + 1, k, lp)]
            for j in range(i + 2, min(n, i + longest.get(word[i : i + 2], 0)) + 1):
                found = of.get(word[i:j])
                if found is not None:
                    here.append((j, *found))
            out.append(here)
        return out

    def log_probability(self, word: bytes) -> float:
        """The log of the sum over all segmentations of the word, the space before it included."""
        word = b" " + word
        alpha = [0.0] + [-math.inf] * len(word)
        for i, here in enumerate(self.edges(word)):
            a = alpha[i]
            for j, _, lp in here:
                x, y = a + lp, alpha[j]
                if x < y:
                    x, y = y, x
                alpha[j] = x if y == -math.inf else x + math.log1p(math.exp(y - x))
        return alpha[-1]

    def expect(self, word: bytes, count: float, total: np.ndarray) -> None:
        """Add the expected pieces of ``count`` such words."""
        word = b" " + word
        n = len(word)
        edges = self.edges(word)
        alpha, beta = [0.0] + [-math.inf] * n, [-math.inf] * n + [0.0]
        for i in range(n):
            for j, _, lp in edges[i]:
                x, y = alpha[i] + lp, alpha[j]
                if x < y:
                    x, y = y, x
                alpha[j] = x if y == -math.inf else x + math.log1p(math.exp(y - x))
        for i in range(n - 1, -1, -1):
            low = -math.inf
            for j, _, lp in edges[i]:
                x, y = beta[j] + lp, low
                if x < y:
                    x, y = y, x
                low = x if y == -math.inf else x + math.log1p(math.exp(y - x))
            beta[i] = low
        z = alpha[n]
        for i in range(n):
            for j, k, lp in edges[i]:
                total[k] += count * math.exp(alpha[i] + lp + beta[j] - z)

    # The same for many words of one length at once, as rows of a matrix of their bytes.  Words that are
    # short enough for their probabilities to stay within a double are summed up as such, others by logarithms.

    def _plain(self, n: int) -> bool:
        return n * self.low > -_REACH and n * (self.high + math.log(2)) < _REACH

    def _pieces(self, b: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each length l (from 1), where pieces begin, flat over places and rows, and which."""
        b = np.ascontiguousarray(b.T)
        n, m = b.shape
        own = b.astype(np.uint64) + np.uint64(1)
        out, h = [(np.arange(n * m), b.ravel())], own
        for size in range(2, min(n, self.most) + 1):
            h = h[: n - size + 1] * _FACTOR
            h += own[size - 1 :]
            flat = h.ravel()
            at = np.flatnonzero(self.maybe[_place(flat)])
            asked = flat[at]
            near = self.first[_place(asked)]
            for _ in range(self.chain):
                near += self.hashes[near] != asked
            same = self.hashes[near] == asked
            out.append((at[same], self.numbers[near[same]]))
        return out

    def _weights(self, pieces: list[tuple[np.ndarray, np.ndarray]], m: int, n: int, plain: bool) -> list[np.ndarray]:
        values = np.exp(self.logp) if plain else self.logp
        out = []
        for size, (at, k) in enumerate(pieces, 1):
            w = np.full((n - size + 1) * m, 0.0 if plain else -np.inf)
            w[at] = values[k]
            out.append(w.reshape(-1, m))
        return out

    def _sums(self, weights: list[np.ndarray], m: int, n: int, plain: bool, back: bool = False) -> np.ndarray:
        """For each place, the sum over all segmentations of what is before it (``back``: after it)."""
        out = np.full((n + 1, m), 0.0 if plain else -np.inf)
        out[n if back else 0] = 1 if plain else 0
        part = np.empty(m)
        for j in range(n - 1, -1, -1) if back else range(1, n + 1):
            sizes = range(1, min(n - j if back else j, len(weights)) + 1)
            if plain:
                for size in sizes:
                    np.multiply(out[j + size if back else j - size], weights[size - 1][j if back else j - size], out=part)
                    out[j] += part
            else:
                parts = np.stack([out[j + size] + weights[size - 1][j] if back else out[j - size] + weights[size - 1][j - size] for size in sizes])
                top = parts.max(axis=0)
                out[j] = top + np.log(np.exp(parts - top).sum(axis=0))
        return out

    def log_probabilities(self, words: pa.Array) -> np.ndarray:
        """``log_probability`` of each word of a binary column."""
        out = np.zeros(len(words))
        for at, b in same_lengths(words):
            if b is None:
                out[at] = [self.log_probability(w) for w in words.take(pa.array(at)).to_pylist()]
                continue
            plain = self._plain(b.shape[1])
            last = self._sums(self._weights(self._pieces(b), *b.shape, plain), *b.shape, plain)[-1]
            out[at] = np.log(last) if plain else last
        return out

    def expect_all(self, words: pa.Array, total: np.ndarray) -> None:
        """``expect`` for each word of a binary column, once."""
        for at, b in same_lengths(words):
            if b is None:
                for w in words.take(pa.array(at)).to_pylist():
                    self.expect(w, 1.0, total)
                continue
            m, n = b.shape
            pieces, plain = self._pieces(b), self._plain(n)
            weights = self._weights(pieces, m, n, plain)
            alpha, beta = self._sums(weights, m, n, plain), self._sums(weights, m, n, plain, back=True)
            shares = []
            for size, ((at, _), w) in enumerate(zip(pieces, weights), 1):
                before, after = alpha[: n - size + 1], beta[size:]
                share = before * w * (after / alpha[n]) if plain else np.exp(before + w + (after - alpha[n]))
                shares.append(share.ravel()[at])
            total += np.bincount(np.concatenate([k for _, k in pieces]), weights=np.concatenate(shares), minlength=len(total))


def gathered(batches: Iterator[pa.RecordBatch], rows: int = 1 << 16, size: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about so many, or so many bytes: few words have one length in a small batch."""
    held, n, filled = [], 0, 0
    for batch in batches:
        held.append(batch)
        n, filled = n + batch.num_rows, filled + batch.nbytes
        if n >= rows or filled >= size:
            yield pa.concat_batches(held)
            held, n, filled = [], 0, 0
    if held:
        yield pa.concat_batches(held)


def same_lengths(words: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Places of words of one length, and the matrix of their bytes after a space; some thousand at a
    time.  Words of over ``LONG`` bytes come without a matrix."""
    if isinstance(words, pa.ChunkedArray):
        words = words.combine_chunks()
    n = len(words)
    if not n:
        return
    offsets = np.frombuffer(words.buffers()[1], dtype=np.int32)[words.offset : words.offset + n + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2], dtype=np.uint8) if words.buffers()[2] is not None else np.zeros(0, np.uint8)
    sizes = np.diff(offsets)
    order = np.argsort(sizes, kind="stable")
    cuts = np.flatnonzero(np.diff(sizes[order])) + 1
    for group in np.split(order, cuts):
        size = int(sizes[group[0]])
        if size > LONG:
            yield group, None
            continue
        step = max(1, _CELLS // ((size + 1) * min(size + 1, 24)))
        for at in range(0, len(group), step):
            own = group[at : at + step]
            yield own, np.concatenate([np.full((len(own), 1), 32, np.uint8), data[offsets[own][:, None] + np.arange(size)]], axis=1)


def read_vocabulary(path: str) -> Lattice:
    """A sentencepiece model's pieces and scores; its control and byte pieces are left out."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    ids = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
    ids = [i for i in ids if model.get_score(i) > -1e8]
    return Lattice.from_vocabulary([model.id_to_piece(i) for i in ids], [model.get_score(i) for i in ids])


def _word_counts(docs: DataFrame, learn: Column) -> DataFrame:
    """(word, c): every word of docs, and how often training texts have it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches_of(batches, "text"):
            w = split_words(batch.column(0))
            train = np.repeat(np.asarray(batch.column(1).fill_null(False)), np.diff(w.bounds))
            yield pa.record_batch({"word": pa.array(w.unique, pa.binary()), "c": np.bincount(w.ids[train], minlength=len(w.unique))})

    counts = docs.select("text", learn.alias("learn")).mapInArrow(run, "word binary, c long")
    return counts.groupBy("word").agg(F.sum("c").alias("c"))


def _expected(words: DataFrame, lattice: Lattice) -> np.ndarray:
    """Expected pieces of the distinct training words, to a thousandth."""
    held, n = ship(words.sparkSession, (lattice.pieces, lattice.logp)), len(lattice.pieces)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total = Lattice(*held()), np.zeros(n)
        for batch in gathered(batches):
            model.expect_all(batch.column(0), total)
        yield pa.record_batch({"ids": pa.array([np.rint(total * 1e3).astype("<i8").tobytes()], pa.binary())})

    found = _sum_vectors(persist(words.filter("c > 0").select("word").mapInArrow(run, "ids binary"), "expected"))
    return found / 1e3 if len(found) else np.zeros(n)


def _with_lattice(words: DataFrame, lattice: Lattice, train_tokens: int, spelt: float, last: float) -> DataFrame:
    """(word, c, lp): log10 probabilities; ``spelt`` is the share of words in pieces, ``last`` the
    chance that a word ends with a piece, which the lattice's edges lack already."""
    held = ship(words.sparkSession, (lattice.pieces, lattice.logp))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Lattice(*held())
        for batch in gathered(batches):
            pieces = model.log_probabilities(batch.column(0))
            pieces += math.log(spelt * last / (1 - last))
            with np.errstate(divide="ignore"):
                whole = np.log(np.maximum(batch.column(1).to_numpy() - DISCOUNT, 0) / max(1, train_tokens))
            yield pa.record_batch({"word": batch.column(0), "c": batch.column(1), "lp": np.logaddexp(whole, pieces) / math.log(10)})

    return words.select("word", "c").mapInArrow(run, "word binary, c long, lp double")


def score(docs: DataFrame, learn: Column, vocabulary_path: str) -> DataFrame:
    """doc_id, learned, n_tokens, n_known, train_tokens, base_score, score for each row of docs
    (doc_id, text); ``learn`` says which rows are learned from."""
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text", F.coalesce(learn, F.lit(False)).alias("learn"))
    words = persist(_word_counts(docs, F.col("learn")), "words")
    n_docs = docs.filter("learn").count()
    row = words.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count_if(F.col("c") > 0)).first()
    train_tokens, distinct = row[0] + n_docs, row[1] + (n_docs > 0)

    lattice = read_vocabulary(vocabulary_path)
    own, total = np.exp(lattice.logp), 0.0
    for _ in range(FITS):
        counts = _expected(words, lattice)
        total = counts.sum()
        if total > 0:
            lattice = Lattice(lattice.pieces, np.log((1 - PRIOR) * counts / total + PRIOR * own))
    last = min(0.9, row[1] / total) if total > 0 else 0.3
    spelt = DISCOUNT * row[1] / train_tokens if row[1] else 0.5
    end = n_docs / train_tokens if n_docs else 0.5
    table = persist(_with_lattice(words, Lattice(lattice.pieces, lattice.logp + math.log1p(-last)), train_tokens, spelt, last), "word-scores")

    short = F.when(F.octet_length("word") <= HOT_BYTES, F.col("word")).otherwise(F.concat(F.lit(b" "), F.unhex(F.sha1("word"))))
    hot = table.select("c", "lp", short.alias("word")).orderBy(F.desc("c"), "word").limit(HOT).toArrow()
    known = ship(spark, (hot["word"].to_pylist(), hot["c"].to_numpy(), hot["lp"].to_numpy()))
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, c, lp = known()
        place = {w: k for k, w in enumerate(names)}
        value = np.stack([np.log10(c + 1.0), (c > 0).astype(float), lp], 1) if len(c) else np.zeros((0, 3))
        value = np.concatenate([value, np.zeros((1, 3))])
        for batch in batches_of(batches, "text"):
            n = batch.num_rows
            w = split_words(batch.column(1))
            at = np.fromiter((place.get(x if len(x) <= HOT_BYTES else b" " + hashlib.sha1(x).digest(), -1) for x in w.unique), dtype=np.int64, count=len(w.unique))
            row = np.repeat(np.arange(n), np.diff(w.bounds))
            sums = [np.bincount(row, weights=value[at, k][w.ids], minlength=n).astype(float) for k in range(3)]
            empty = pa.nulls(n, pa.binary())
            yield pa.record_batch({"row": batch.column(2), "doc_id": batch.column(0), "learn": batch.column(3), "n": np.diff(w.bounds), "word": empty, "tf": pa.nulls(n, pa.int64()), "logc": sums[0], "known": sums[1], "lp": sums[2]})
            rare = at[w.ids] < 0
            pair, tf = np.unique(row[rare] * max(1, len(w.unique)) + w.ids[rare], return_counts=True)
            if len(pair):
                unique = pa.array(w.unique, pa.binary())
                m, own = len(pair), pair // len(w.unique)
                zero = np.zeros(m)
                yield pa.record_batch({"row": batch.column(2).take(pa.array(own)), "doc_id": pa.nulls(m, batch.column(0).type), "learn": pa.nulls(m, pa.bool_()), "n": np.zeros(m, np.int64), "word": unique.take(pa.array(pair % len(w.unique))), "tf": tf, "logc": zero, "known": zero, "lp": zero})

    rows = docs.select("doc_id", "text", F.monotonically_increasing_id().alias("row"), "learn")
    parts = persist(rows.mapInArrow(run, f"row long, doc_id {kind}, learn boolean, n long, word binary, tf long, logc double, known double, lp double"), "parts")
    own = parts.filter("word IS NULL").select("row", "doc_id", "learn", "n", "logc", "known", "lp")
    rare = parts.filter("word IS NOT NULL").select("row", "word", "tf").join(table, "word")
    rare = rare.select("row", F.lit(None).cast(kind).alias("doc_id"), F.lit(None).cast("boolean").alias("learn"), F.lit(0).cast("long").alias("n"), (F.col("tf") * F.log10(F.col("c") + 1.0)).alias("logc"), F.when(F.col("c") > 0, F.col("tf")).otherwise(0).cast("double").alias("known"), (F.col("tf") * F.col("lp")).alias("lp"))
    out = own.unionByName(rare).groupBy("row").agg(F.max("doc_id").alias("doc_id"), F.max("learn").alias("learned"), F.sum("n").alias("n"), F.sum("logc").alias("logc"), F.sum("known").alias("known"), F.sum("lp").alias("lp"))
    below = math.log10(train_tokens + distinct + 1)
    return out.select(
        "doc_id", "learned", (F.col("n") + 1).alias("n_tokens"), (F.round("known").cast("long") + int(n_docs > 0)).alias("n_known"), F.lit(train_tokens).cast("long").alias("train_tokens"),
        (F.col("logc") + math.log10(n_docs + 1) - (F.col("n") + 1) * below).alias("base_score"), (F.col("lp") + math.log10(end)).alias("score"),
    )
