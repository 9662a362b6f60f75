"""Quality by random-indexing word vectors and a two-layer network (operator 8).

Every token bucket has a fixed sparse ternary index vector.  One pass over all documents adds up,
for each bucket, the index vectors of the tokens beside it: its context vector.  A word is three
tokens, read from the text alone: its stem without trailing marks, those marks, and its letter case.
A document is the mean of its tokens' vectors, by kind, with the length of that mean; a two-layer
numpy network turns it into a logit, and a temperature fitted on rows left out of its training
makes the sigmoid of the logit a probability.

Context vectors cover all documents; only the network learns from a bounded number of labelled rows,
whose whole texts are pooled on the executors, so that the driver gets a vector of each.
Cases: null or empty text pools to zero vectors and is scored like any other; a very long text is
pooled like any other; null labels are not learned from; repeated rows and ties get equal scores;
without labels of both kinds every score is 0.5; an empty table gives an empty result; other columns,
whatever their names, are not read by ``score`` and come back untouched from ``keep_good``.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .base import Words, batches_of, fetch, give_back, keep_rows, labelled_rows, ship, split_words, worker_cache

BUCKETS, DIMENSIONS, NONZERO = 1 << 13, 32, 4
HIDDEN, STEPS = 24, 900
#: The training sample: rows of either label at most.
SAMPLE_ROWS = 1500


def index_vectors(seed: int = 11) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs) of the nonzero parts of each bucket's index vector."""
    r = np.random.default_rng(seed)
    places = np.argsort(r.random((BUCKETS, DIMENSIONS)), axis=1)[:, :NONZERO]
    return places, r.choice(np.array([-1, 1]), (BUCKETS, NONZERO))


def _byte_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which bytes are marks; the case of each (1 upper, 2 lower); A-Z lower-cased, plus one."""
    marks = np.array([33 <= x < 127 and not chr(x).isalnum() for x in range(256)])
    case = np.array([1 if 65 <= x <= 90 else 2 if 97 <= x <= 122 else 0 for x in range(256)], dtype=np.uint8)
    lower = np.array([x + 32 if 65 <= x <= 90 else x for x in range(256)], dtype=np.uint64) + np.uint64(1)
    return marks, case, lower


def token_buckets(words: list[bytes]) -> np.ndarray:
    """(words, 3) buckets of stem (A-Z lower-cased), trailing marks and letter case of the stem."""
    if not words:
        return np.zeros((0, 3), np.int64)
    marks, case, lower = worker_cache("byte_kinds", _byte_kinds)
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    at = np.arange(len(data))
    stem = np.maximum.reduceat(np.where(marks[data], 0, at - np.repeat(starts, sizes) + 1), starts)  # its length
    value = lower[data]
    place = (at - np.repeat(starts, sizes)).astype(np.uint64)
    value *= (place * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    value ^= value >> np.uint64(29)
    value *= np.uint64(0xBF58476D1CE4E5B9)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(value, out=total[1:])
    kind = case[data]

    def count(which: int) -> np.ndarray:
        c = np.zeros(len(data) + 1, np.int64)
        np.cumsum(kind == which, out=c[1:])
        return c[starts + stem] - c[starts]

    up, low = count(1), count(2)
    first_up = (kind[starts] == 1) & (up == 1)
    shape = np.select([stem == 0, (up > 1) & (low == 0), first_up & (low > 0), (up == 0), first_up], [0, 1, 2, 3, 4], 5)

    def bucket(h: np.ndarray, salt: int) -> np.ndarray:
        h = (h ^ np.uint64(salt)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(31))) * np.uint64(0x94D049BB133111EB) >> np.uint64(40)).astype(np.int64) % BUCKETS

    return np.stack([bucket(total[starts + stem] - total[starts], 1), bucket(total[ends] - total[starts + stem], 2), bucket(shape.astype(np.uint64), 3)], 1)


def add_contexts(w: Words, kinds: np.ndarray, total: np.ndarray) -> None:
    """Add the index vectors of each token's neighbours (stem by stem, marks by marks, case by case)."""
    places, signs = worker_cache("index_vectors", index_vectors)
    if len(w.ids) < 2:
        return
    last = np.zeros(len(w.ids) + 1, dtype=bool)
    last[w.bounds[1:]] = True  # a word that begins another row
    left = np.flatnonzero(~last[1 : len(w.ids)])
    for k in range(3):
        few, inverse = np.unique(kinds[:, k], return_inverse=True)
        a, b = inverse[w.ids[left]], inverse[w.ids[left + 1]]
        if len(few) <= 512:
            pairs = np.bincount(a * len(few) + b, minlength=len(few) ** 2)
            pairs = pairs + pairs.reshape(len(few), -1).T.ravel()
            used = np.flatnonzero(pairs)
            sides = [(few[used // len(few)], few[used % len(few)], pairs[used])]
        else:
            sides = [(few[a], few[b], 1), (few[b], few[a], 1)]
        for own, other, count in sides:
            for j in range(NONZERO):
                total += np.bincount(own * DIMENSIONS + places[other, j], weights=signs[other, j] * count, minlength=total.size)


def context_table(docs: DataFrame) -> np.ndarray:
    """Context vectors of all buckets over all documents; of a size fixed by BUCKETS."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(BUCKETS * DIMENSIONS)
        for batch in batches_of(batches, "text"):
            w = split_words(batch.column(0), lower=False)
            add_contexts(w, token_buckets(w.unique), total)
        rows = total.reshape(BUCKETS, DIMENSIONS).astype(np.int64)
        used = np.flatnonzero(rows.any(axis=1))
        yield pa.record_batch({"bucket": used, **{f"c{k}": rows[used, k] for k in range(DIMENSIONS)}})

    names = [f"c{k}" for k in range(DIMENSIONS)]
    parts = docs.select("text").mapInArrow(run, "bucket long, " + ", ".join(f"{n} long" for n in names))
    found = fetch(parts.groupBy("bucket").agg(*[F.sum(n).alias(n) for n in names])).to_pandas()
    out = np.zeros((BUCKETS, DIMENSIONS))
    if len(found):
        out[found["bucket"].to_numpy()] = found[names].to_numpy()
    return out


def word_vectors(contexts: np.ndarray) -> np.ndarray:
    """Own index vector and context of each bucket, both of unit length, added."""
    places, signs = index_vectors()
    own = np.zeros_like(contexts)
    np.put_along_axis(own, places, signs.astype(float), axis=1)
    scaled = np.sign(contexts) * np.log1p(np.abs(contexts))
    scaled /= np.maximum(np.linalg.norm(scaled, axis=1, keepdims=True), 1e-9)
    return (own / NONZERO**0.5 + scaled).astype(np.float32)


def pool(vectors: np.ndarray, text: pa.Array) -> np.ndarray:
    """(rows, features): means of the vectors by kind, the lengths of these and of the text,
    and the share of distinct words."""
    w = split_words(text, lower=False)
    n = len(text)
    out = np.zeros((n, 3 * DIMENSIONS + 5), np.float32)
    if not len(w.ids):
        return out
    kinds = token_buckets(w.unique)
    full = np.flatnonzero(np.diff(w.bounds) > 0)
    starts = w.bounds[full]
    sizes = np.diff(w.bounds)[full][:, None]
    for k in range(3):
        table = vectors[kinds[:, k]]
        mean = np.empty((len(full), DIMENSIONS), np.float32)
        step = 256  # rows at once, so that what is gathered stays small
        for at in range(0, len(full), step):
            lo, hi = starts[at], w.bounds[full[min(at + step, len(full)) - 1] + 1]
            mean[at : at + step] = np.add.reduceat(table[w.ids[lo:hi]], starts[at : at + step] - lo, axis=0)
        mean /= sizes
        out[full, k * DIMENSIONS : (k + 1) * DIMENSIONS] = mean
        out[full, 3 * DIMENSIONS + k] = np.linalg.norm(mean, axis=1)
    row = np.repeat(np.arange(n), np.diff(w.bounds))
    distinct = np.unique(row * len(w.unique) + w.ids) // len(w.unique)
    out[:, -2] = np.bincount(distinct, minlength=n) / np.maximum(np.diff(w.bounds), 1)
    out[:, -1] = np.log1p(np.diff(w.bounds)) / 8
    return out


class Scorer:
    """Word vectors, and a network of two layers with its temperature."""

    def __init__(self, vectors: np.ndarray) -> None:
        self.vectors, self.temperature, self.shift = vectors, 1.0, 0.0
        self.mean = self.scale = None

    def train(self, x: np.ndarray, y: np.ndarray, shift: float = 0.0, seed: int = 5) -> None:
        """Adam on four fifths of the rows; the temperature is fitted on the other fifth."""
        self.shift = shift
        if not len(y) or y.min() == y.max():
            return
        r = np.random.default_rng(seed)
        left = r.permutation(len(y)) < len(y) // 5
        if len(set(y[left])) < 2 or len(set(y[~left])) < 2:
            left[:] = False
        self.mean, self.scale = x.mean(0), x.std(0) + 0.02
        z, t = (x[~left] - self.mean) / self.scale, y[~left].astype(float)
        weight = np.where(t == 1, 0.5 / max(1, (t == 1).sum()), 0.5 / max(1, (t == 0).sum()))
        p = {"a": r.standard_normal((z.shape[1], HIDDEN)) * z.shape[1] ** -0.5, "b": np.zeros(HIDDEN), "c": r.standard_normal(HIDDEN) * 0.2, "d": np.zeros(1)}
        m, s = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}
        for i in range(1, STEPS + 1):
            h = np.tanh(z @ p["a"] + p["b"])
            q = 1 / (1 + np.exp(-np.clip(h @ p["c"] + p["d"], -30, 30)))
            e = weight * (q - t)
            dh = np.outer(e, p["c"]) * (1 - h * h)
            g = {"a": z.T @ dh + 1e-3 * p["a"], "b": dh.sum(0), "c": h.T @ e + 1e-3 * p["c"], "d": e.sum(keepdims=True)}
            for k in p:
                m[k] += 0.1 * (g[k] - m[k])
                s[k] += 0.001 * (g[k] ** 2 - s[k])
                p[k] -= 0.01 * (m[k] / (1 - 0.9**i)) / (np.sqrt(s[k] / (1 - 0.999**i)) + 1e-9)
        self.weights = p
        held = left if left.any() else ~left
        logit, t = self.logits(x[held]), y[held].astype(float)
        grid = np.exp(np.linspace(np.log(0.2), np.log(10), 80))
        losses = [np.logaddexp(0, np.where(t == 1, -1, 1) * logit / T).mean() for T in grid]
        self.temperature = float(grid[int(np.argmin(losses))])

    def logits(self, x: np.ndarray) -> np.ndarray:
        p = self.weights
        return np.tanh((x - self.mean) / self.scale @ p["a"] + p["b"]) @ p["c"] + p["d"][0]

    def scores(self, text: pa.Array) -> np.ndarray:
        if self.mean is None:
            return np.full(len(text), 0.5)
        x = self.logits(pool(self.vectors, text).astype(np.float64)) / self.temperature + self.shift
        return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit(docs: DataFrame, train_docs: DataFrame, labels: DataFrame, label: str = "quality", rows: int = SAMPLE_ROWS) -> Scorer:
    """Word vectors from ``docs``; the network from at most ``rows`` labelled ``train_docs`` of either
    label.  The shares of the two labels are those of all of them."""
    scorer = Scorer(word_vectors(context_table(docs)))
    held = ship(docs.sparkSession, scorer.vectors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vectors = held()
        for batch in batches_of(batches, "text"):
            x = pool(vectors, batch.column(1))
            yield pa.record_batch({"doc_id": batch.column(0), "x": pa.array([row.tobytes() for row in x], pa.binary()), "label": batch.column(2)})

    kinds = labels.select("doc_id", F.col(label).cast("int").alias("label"))
    chosen = labelled_rows(train_docs, kinds, [0, 1], rows)
    found = fetch(chosen.mapInArrow(run, f"doc_id {chosen.schema['doc_id'].dataType.simpleString()}, x binary, label int"))
    found = found.sort_by([("label", "ascending"), ("doc_id", "ascending")])
    y = found["label"].to_numpy().astype(int)
    x = np.frombuffer(b"".join(found["x"].to_pylist()), dtype=np.float32).reshape(len(y), -1) if len(y) else np.zeros((0, 3 * DIMENSIONS + 5))
    counts = {r[0]: r[1] for r in kinds.join(train_docs.select("doc_id"), "doc_id", "left_semi").filter(F.col("label").isin(0, 1)).groupBy("label").count().collect()}
    shift = float(np.log(counts[1] / counts[0])) if counts.get(0) and counts.get(1) else 0.0
    scorer.train(x.astype(np.float64), y, shift)
    give_back()
    return scorer


def score(docs: DataFrame, scorer: Scorer) -> DataFrame:
    """(doc_id, score) for every row of docs (doc_id, text)."""
    held = ship(docs.sparkSession, scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches_of(batches, "text"):
            yield pa.record_batch({"doc_id": batch.column(0), "score": model.scores(batch.column(1))})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def _at_least(scorer: Scorer, least: float, text: pa.Array) -> np.ndarray:
    return scorer.scores(text) >= least


def keep_good(docs: DataFrame, scorer: Scorer, least: float = 0.7) -> DataFrame:
    """The rows of docs that score at least so much, all columns as they are."""
    held = ship(docs.sparkSession, scorer)
    return keep_rows(docs, lambda: partial(_at_least, held(), least))
