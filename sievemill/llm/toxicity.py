"""Toxicity by a bidirectional gated recurrent network with attention pooling (operator 1).

Inputs of a step are one word's: a learned vector of the word, the mean of learned vectors of its
character 3- and 4-grams (with marks at both ends), and how much likelier the word and its n-grams
are in toxic than in other training documents.  Both directions run over windows of ``WINDOW``
words that overlap by half and cover the whole text, so that any run of up to ``STRIDE`` words is
whole in some window; attention pools a window's states, and a document is as toxic as its most toxic
window.  All of it is trained in numpy on the driver, from a bounded number of labelled rows and
their whole texts; scoring never caps a text.

Cases: null or empty text scores as a window without words; a very long text has as many windows as
it takes, scored some thousands at a time; labels of null are not learned from; repeated rows and
ties get equal scores; without labels of both kinds every score is 0.5 before calibration and stays
there; an empty table gives an empty result; other columns, whatever their names, are not read by
``score`` and come back untouched from ``keep_clean``.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches_of, give_back, keep_rows, labelled_sample, ragged, ship, split_words

WINDOW, STRIDE = 32, 16
HIDDEN, EMBED = 12, 8
VOCABULARY, GRAMS = 4096, 1 << 13
#: Windows scored at once, and words whose n-grams are looked up at once.
AT_ONCE, WORDS_AT_ONCE = 1024, 1 << 13
#: The training sample: rows of either label at most.
SAMPLE_ROWS = 1500
STEPS, BATCH = 220, 64


def held_out(doc_id: Column, parts: int, part: int) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % parts == part


def gram_ids(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of the marked words, and where each word's begin."""
    marked = np.frombuffer(b"".join(b"<" + w + b">" for w in words), dtype=np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 2
    ends = np.cumsum(sizes)
    starts = ends - sizes
    mixed = []
    for n in (3, 4):
        h = np.full(len(marked), n, dtype=np.uint64)
        for k in range(n):
            h[: len(marked) - k] = (h[: len(marked) - k] * np.uint64(0x100000001B3)) ^ marked[k:]
        h *= np.uint64(0x9E3779B97F4A7C15)
        mixed.append((h >> np.uint64(40)) % np.uint64(GRAMS))
    threes, fours = np.maximum(sizes - 2, 1), np.maximum(sizes - 3, 1)
    at3, at4 = ragged(starts, threes), ragged(starts, fours)
    counts = threes + fours
    begin = np.cumsum(counts) - counts
    out = np.empty(int(counts.sum()), dtype=np.int64)
    out[ragged(begin, threes)] = mixed[0][at3]
    out[ragged(begin + threes, fours)] = mixed[1][at4]
    return out, begin


def _log_odds(present: Iterable[np.ndarray], toxic: np.ndarray, size: int) -> np.ndarray:
    """How much likelier each id is to be in a toxic document, smoothed; present: each one's ids."""
    counts = np.zeros((2, size))
    for ids, y in zip(present, toxic):
        counts[int(y), ids] += 1
    n = np.array([(toxic == 0).sum(), (toxic == 1).sum()])[:, None]
    p = (counts + 0.5) / (n + 1.0)
    return (np.log(p[1]) - np.log(p[0])).astype(np.float32)


class Net:
    """Weights, as a dict of float32 arrays, with what turns words into inputs."""

    def __init__(self, vocabulary: dict[bytes, int], word_odds: np.ndarray, gram_odds: np.ndarray, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        d, h = 2 * EMBED + 3, HIDDEN

        def w(*shape: int, scale: float = 0.0) -> np.ndarray:
            return (r.standard_normal(shape) * (scale or shape[0] ** -0.5)).astype(np.float32)

        self.vocabulary, self.word_odds, self.gram_odds = vocabulary, word_odds, gram_odds
        self.p = {"word": w(len(word_odds), EMBED, scale=0.1), "gram": w(GRAMS, EMBED, scale=0.1), "v": w(2 * h, scale=0.1), "o": w(2 * h), "ob": np.zeros(1, np.float32)}
        for side in "fb":
            self.p |= {f"W{side}": w(d, 3 * h), f"b{side}": np.zeros(3 * h, np.float32), f"U{side}": w(h, 3 * h), f"c{side}": np.zeros(h, np.float32)}
        self.p["word"][0] = 0
        self.slope, self.shift = 1.0, 0.0

    def inputs(self, words: list[bytes]) -> dict[str, np.ndarray]:
        """Word ids, n-gram ids and the odds of distinct words."""
        ids = np.fromiter((self.vocabulary.get(w, 0) for w in words), dtype=np.int64, count=len(words))
        grams, begin = gram_ids(words)
        odds = self.gram_odds[grams]
        sizes = np.diff(np.append(begin, len(grams)))
        most, mean = np.maximum.reduceat(odds, begin), np.add.reduceat(odds, begin) / sizes
        return {"ids": ids, "grams": grams, "begin": begin, "sizes": sizes, "odds": np.stack([self.word_odds[ids], most, mean], 1).astype(np.float32) * np.float32(0.5)}

    def features(self, x: dict[str, np.ndarray]) -> np.ndarray:
        n, begin, grams = len(x["ids"]), x["begin"], x["grams"]
        chars = np.empty((n, EMBED), self.p["gram"].dtype)
        for at in range(0, n, WORDS_AT_ONCE):
            lo, hi = begin[at], begin[at + WORDS_AT_ONCE] if at + WORDS_AT_ONCE < n else len(grams)
            chars[at : at + WORDS_AT_ONCE] = np.add.reduceat(self.p["gram"][grams[lo:hi]], begin[at : at + WORDS_AT_ONCE] - lo, axis=0)
        chars /= x["sizes"][:, None].astype(np.float32)
        return np.concatenate([self.p["word"][x["ids"]], chars, x["odds"]], axis=1)

    def table(self, features: np.ndarray, side: str) -> np.ndarray:
        """Inputs to the gates of each word; the last row is a pad, which leaves a state as it is."""
        pad = np.zeros((1, 3 * HIDDEN), np.float32)
        pad[:, HIDDEN : 2 * HIDDEN] = 40
        return np.concatenate([features @ self.p[f"W{side}"] + self.p[f"b{side}"], pad])

    def run(self, xp: np.ndarray, side: str, order: range, out: np.ndarray, kept: list | None = None) -> None:
        """xp: (steps, rows, 3h) or a function of the step; out: (steps, rows, h)."""
        h, U, c = HIDDEN, self.p[f"U{side}"], self.p[f"c{side}"]
        state = np.zeros(out.shape[1:], np.float32)
        for t in order:
            x = xp(t) if callable(xp) else xp[t]
            g = state @ U
            a = x[:, : 2 * h] + g[:, : 2 * h]
            np.clip(a, -40, 40, out=a)
            np.negative(a, out=a)
            np.exp(a, out=a)
            a += 1
            np.reciprocal(a, out=a)
            r, z = a[:, :h], a[:, h:]
            hn = g[:, 2 * h :] + c
            n = r * hn
            n += x[:, 2 * h :]
            np.tanh(n, out=n)
            if kept is not None:
                kept.append((t, state, r, z, n, hn))
            new = state - n
            new *= z
            new += n
            state = out[t] = new

    def pool(self, states: np.ndarray, real: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Attention weights (steps, rows), pooled states and logits; states: (steps, rows, 2h)."""
        e = np.where(real, states @ self.p["v"], np.float32(-1e9))
        e = np.exp(e - e.max(axis=0))
        e *= real
        a = e / np.maximum(e.sum(axis=0), np.float32(1e-9))
        pooled = np.einsum("tb,tbh->bh", a, states)
        return a, pooled, pooled @ self.p["o"] + self.p["ob"][0]

    def logits(self, tables: tuple[np.ndarray, np.ndarray], ids: np.ndarray, pad: int) -> np.ndarray:
        """ids: (rows, WINDOW) places in the tables, padded with ``pad``."""
        steps = ids.T
        states = np.empty((*steps.shape, 2 * HIDDEN), np.float32)
        for side, order, k in (("f", range(len(steps)), 0), ("b", range(len(steps) - 1, -1, -1), HIDDEN)):
            table = tables[k > 0]
            self.run(lambda t, table=table: table[steps[t]], side, order, states[:, :, k : k + HIDDEN])
        return self.pool(states, steps != pad)[2]

    def step(self, x: dict[str, np.ndarray], ids: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Loss and gradients of one batch of windows over the distinct words of x."""
        h, p = HIDDEN, self.p
        pad = len(x["ids"])
        features = self.features(x)
        steps = ids.T
        states = np.empty((*steps.shape, 2 * h), np.float32)
        kept = {"f": [], "b": []}
        tables = {s: self.table(features, s) for s in "fb"}
        self.run(tables["f"][steps], "f", range(len(steps)), states[:, :, :h], kept["f"])
        self.run(tables["b"][steps], "b", range(len(steps) - 1, -1, -1), states[:, :, h:], kept["b"])
        real = steps != pad
        a, pooled, logit = self.pool(states, real)
        prob = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        loss = float(-np.mean(y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7)))
        d = ((prob - y) / len(y)).astype(np.float32)
        g = {"ob": d.sum(keepdims=True), "o": pooled.T @ d}
        dp = d[:, None] * p["o"]
        da = np.einsum("tbh,bh->tb", states, dp)
        de = a * (da - (a * da).sum(axis=0))
        ds = a[:, :, None] * dp + de[:, :, None] * p["v"]
        g["v"] = np.einsum("tb,tbh->h", de, states)
        dx = np.zeros_like(features)
        for side, k in (("f", 0), ("b", h)):
            U = p[f"U{side}"]
            gU, gc = np.zeros_like(U), np.zeros_like(p[f"c{side}"])
            dtable = np.zeros((pad + 1, 3 * h), np.float32)
            carry = np.zeros((len(y), h), np.float32)
            for t, prev, r, z, n, hn in reversed(kept[side]):
                dh = ds[t][:, k : k + h] + carry
                dn = dh * (1 - z) * (1 - n * n)
                dz = dh * (prev - n) * z * (1 - z)
                dr = dn * hn * r * (1 - r)
                gate = np.concatenate([dr, dz], axis=1)
                dhn = dn * r
                gU[:, : 2 * h] += prev.T @ gate
                gU[:, 2 * h :] += prev.T @ dhn
                gc += dhn.sum(axis=0)
                carry = dh * z + gate @ U[:, : 2 * h].T + dhn @ U[:, 2 * h :].T
                np.add.at(dtable, steps[t], np.concatenate([gate, dn], axis=1))
            dtable = dtable[:pad]
            g |= {f"U{side}": gU, f"c{side}": gc, f"W{side}": features.T @ dtable, f"b{side}": dtable.sum(axis=0)}
            dx += dtable @ p[f"W{side}"].T
        g["word"], g["gram"] = np.zeros_like(p["word"]), np.zeros_like(p["gram"])
        np.add.at(g["word"], x["ids"], dx[:, :EMBED])
        g["word"][0] = 0
        np.add.at(g["gram"], x["grams"], np.repeat(dx[:, EMBED : 2 * EMBED] / x["sizes"][:, None], x["sizes"], axis=0))
        return loss, g


def windows(bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, first word, words) of every window; a document without words has one of none."""
    sizes = np.diff(bounds)
    n = np.maximum(0, -(-(sizes - WINDOW) // STRIDE)) + 1
    doc = np.repeat(np.arange(len(sizes)), n)
    k = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    first = np.minimum(k * STRIDE, np.maximum(sizes[doc] - WINDOW, 0))
    return doc, bounds[:-1][doc] + first, np.minimum(sizes[doc], WINDOW)


def window_ids(ids: np.ndarray, first: np.ndarray, size: np.ndarray, pad: int) -> np.ndarray:
    at = first[:, None] + np.arange(WINDOW)
    inside = np.arange(WINDOW) < size[:, None]
    return np.where(inside, np.append(ids, pad)[np.minimum(at, len(ids))], pad)


def _document_logits(net: Net, text: pa.Array) -> np.ndarray:
    w = split_words(text)
    pad = len(w.unique)
    features = net.features(net.inputs(w.unique)) if pad else np.zeros((0, 2 * EMBED + 3), np.float32)
    tables = (net.table(features, "f"), net.table(features, "b"))
    doc, first, size = windows(w.bounds)
    out = np.empty(len(doc), np.float32)
    for at in range(0, len(doc), AT_ONCE):
        s = slice(at, at + AT_ONCE)
        out[s] = net.logits(tables, window_ids(w.ids, first[s], size[s], pad), pad)
    starts = np.searchsorted(doc, np.arange(len(text)))
    return np.maximum.reduceat(out, starts) if len(text) else out


def text_scores(net: Net, text: pa.Array) -> np.ndarray:
    x = net.slope * _document_logits(net, text).astype(np.float64) + net.shift
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def train(rows: list[tuple[str, int]], seed: int = 7) -> Net:
    """Learn from (text, label) rows: windows of toxic documents that look most toxic are learned
    as toxic, others and those of clean documents as clean; thrice, each time ranked anew."""
    r = np.random.default_rng(seed)
    text, y = pa.array([t or "" for t, _ in rows], pa.string()), np.array([int(k) for _, k in rows])
    w = split_words(text)
    sets = [np.unique(w.ids[a:b]) for a, b in zip(w.bounds[:-1], w.bounds[1:])]
    seen = np.bincount(np.concatenate(sets), minlength=len(w.unique)) if sets else np.zeros(0, int)
    common = np.argsort(-seen, kind="stable")[: VOCABULARY - 1]
    common = common[seen[common] >= 3]
    vocabulary = {w.unique[i]: k + 1 for k, i in enumerate(common.tolist())}
    number = np.zeros(len(w.unique), np.int64)
    number[common] = np.arange(1, len(common) + 1)
    grams, begin = gram_ids(w.unique) if w.unique else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    ends = np.append(begin[1:], len(grams))
    word_odds = _log_odds([number[s] for s in sets], y, len(common) + 1)
    word_odds[0] = 0
    gram_odds = _log_odds((np.unique(grams[ragged(begin[s], ends[s] - begin[s])]) for s in sets), y, GRAMS)
    del grams, begin, ends
    net = Net(vocabulary, word_odds, gram_odds, seed)
    if not len(y) or y.min() == y.max():
        net.slope = 0.0
        return net
    x = net.inputs(w.unique)
    pad = len(w.unique)
    doc, first, size = windows(w.bounds)
    ids = window_ids(w.ids, first, size, pad).astype(np.int32)
    hint = np.append(np.maximum(x["odds"][:, 0], x["odds"][:, 1]), -9.0)
    rank = hint[ids].max(axis=1)
    moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in net.p.items()}
    count = 0
    for round_ in range(3):
        order = np.lexsort((-rank, doc))
        place = np.empty(len(doc), np.int64)
        place[order] = np.arange(len(doc)) - np.searchsorted(doc, doc)
        toxic = np.flatnonzero((y[doc] == 1) & (place < 1 + (rank > np.median(rank[place == 0])) * (place < 3) * 2))
        hard = np.flatnonzero((y[doc] == 0) & (place < 2))
        rest = np.flatnonzero(y[doc] == 0)
        for _ in range(STEPS):
            count += 1
            pick = np.concatenate([r.choice(toxic, BATCH // 2), r.choice(hard, BATCH // 4), r.choice(rest, BATCH // 4)])
            target = y[doc[pick]].astype(np.float32)
            _, g = net.step(*_local(x, ids[pick], pad), target)
            for k, v in g.items():
                m, s = moments[k]
                m += 0.1 * (v - m)
                s += 0.001 * (v * v - s)
                net.p[k] -= (0.01 * (m / (1 - 0.9**count)) / (np.sqrt(s / (1 - 0.999**count)) + 1e-8)).astype(np.float32)
        rank = np.concatenate([_window_logits(net, x, ids[at : at + AT_ONCE], pad) for at in range(0, len(ids), AT_ONCE)])
    top = np.maximum.reduceat(rank, np.searchsorted(doc, np.arange(len(y))))
    net.slope, net.shift = _calibrate(top.astype(float), y)
    return net


def _local(x: dict[str, np.ndarray], ids: np.ndarray, pad: int) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """The words of some windows alone, and the windows in their numbers."""
    u, inverse = np.unique(ids, return_inverse=True)
    real = u[u < pad]
    return _subset(x, real), np.where(ids < pad, inverse.reshape(ids.shape), len(real))


def _window_logits(net: Net, x: dict[str, np.ndarray], ids: np.ndarray, pad: int) -> np.ndarray:
    few, local = _local(x, ids, pad)
    features = net.features(few)
    return net.logits((net.table(features, "f"), net.table(features, "b")), local, len(few["ids"]))


def _subset(x: dict[str, np.ndarray], at: np.ndarray) -> dict[str, np.ndarray]:
    sizes = x["sizes"][at]
    return {"ids": x["ids"][at], "grams": x["grams"][ragged(x["begin"][at], sizes)], "begin": np.cumsum(sizes) - sizes, "sizes": sizes, "odds": x["odds"][at]}


def _calibrate(logit: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit with softened targets, so that separable data stay finite."""
    n1, n0 = (y == 1).sum(), (y == 0).sum()
    target = np.where(y == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    weight = np.where(y == 1, 0.5 / n1, 0.5 / n0)
    a, b = 1.0, 0.0
    for _ in range(60):
        q = 1 / (1 + np.exp(-np.clip(a * logit + b, -30, 30)))
        e, s = weight * (q - target), weight * q * (1 - q) + 1e-9
        grad = np.array([(e * logit).sum() + 1e-4 * (a - 1), e.sum()])
        hess = np.array([[(s * logit * logit).sum() + 1e-4, (s * logit).sum()], [(s * logit).sum(), s.sum()]]) + 1e-6 * np.eye(2)
        move = np.linalg.solve(hess, grad)
        a, b = a - np.clip(move[0], -1, 1), b - np.clip(move[1], -3, 3)
    return float(max(a, 1e-3)), float(b)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", rows: int = SAMPLE_ROWS) -> Net:
    """Train on at most ``rows`` documents of either label."""
    net = train(labelled_sample(docs, labels.select("doc_id", F.col(label).alias("label")), [0, 1], rows))
    give_back()
    return net


def score(docs: DataFrame, net: Net) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text)."""
    held = ship(docs.sparkSession, net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches_of(batches, "text"):
            yield pa.record_batch({"doc_id": batch.column(0), "score": text_scores(model, batch.column(1))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def _under(net: Net, limit: float, text: pa.Array) -> np.ndarray:
    return text_scores(net, text) < limit


def keep_clean(docs: DataFrame, net: Net, limit: float = 0.5) -> DataFrame:
    """The rows of docs that score below the limit, all columns as they are."""
    held = ship(docs.sparkSession, net)
    return keep_rows(docs, lambda: partial(_under, held(), limit))
