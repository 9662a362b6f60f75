"""Mixing sources to target weights with soft domain membership (operator 9).

A classifier learned from a labelled table gives every document posteriors over domains: a softmax
over the sum of its words' hashed weights, with the word counts' logarithms as features' scale.
Each document then gets a nonnegative rate, fitted by distributed projected-gradient least squares:
the expected tokens of domain k, the sum over documents of rate * tokens * posterior[k], are to
match the targets.  Distances between rates are weighed by tokens, so that a rate depends on what a
document is and not on its length, and residuals by the inverse of the documents' Gram matrix, under
which a step of length one is safe; only that matrix and one vector of domain totals per round, both of
the number of domains, reach the driver.  Rounds go on until the totals match or stand still; what
they then miss, if it is worth telling, is told by a warning.  Rates become whole copies by a hash of the document.

Cases: null or empty text has no tokens, the prior's posteriors and the rate of its posteriors; a
very long text is read whole, some megabytes at a time; a target for an unknown domain is an error;
domains without a target get zero; a wanted domain of which there is almost nothing keeps all it has
and does not shrink the others' targets; an empty table gives an empty result; rows are weighed as
they are, repeated ones alike, and ties (equal posteriors) get equal rates; extra columns pass through
``mix`` untouched.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .base import batches_of, fetch, give_back, labelled_rows, persist, ship, split_words

BUCKETS, STEPS = 1 << 14, 200
#: The labelled sample: rows of each domain at most; and how many domains there may be.
SAMPLE_ROWS, MOST_DOMAINS = 800, 256
#: Rounds go on until totals miss the targets by this share of all tokens at most, or change by a
#: tenth of it; rounds after which the rates so far are written, and after which a fit that still moves is an error.
CLOSE, WRITTEN_AFTER, MOST_ROUNDS = 1e-4, 8, 2000
#: A miss by more than this share of all tokens is told by a warning.
TOLD = 1e-3
#: A wanted domain that alone would shrink the result below this share of all tokens gets all it has.
SCARCE = 0.05


def _hashes(words: list[bytes]) -> np.ndarray:
    """A bucket of each word and of each of its ends (three bytes at most): (words, 3)."""
    from zlib import crc32

    return np.array([(crc32(w) % BUCKETS, crc32(b"<" + w[:3]) % BUCKETS, crc32(w[-3:] + b">") % BUCKETS) for w in words], dtype=np.int64).reshape(-1, 3)


class Domains:
    """Log-linear posteriors over domains."""

    def __init__(self, names: list[str]) -> None:
        self.names, self.weights, self.prior = names, np.zeros((BUCKETS, len(names))), np.full(len(names), 1.0 / max(1, len(names)))

    def train(self, features: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> None:
        """features: the buckets of each row and how often it has them; y: places in ``names``."""
        if not any(len(c) for c, _ in features):
            return
        n, k = len(y), len(self.names)
        rows = np.repeat(np.arange(n), [len(c) for c, _ in features])
        cols, tf = (np.concatenate([f[i] for f in features]) for i in (0, 1))
        value = tf / np.maximum(np.bincount(rows, weights=tf, minlength=n), 1)[rows]
        self.prior = (np.bincount(y, minlength=k) + 1) / (n + k)
        target = np.eye(k)[y]
        moment = np.zeros_like(self.weights)
        for _ in range(STEPS):  # diagonally scaled gradient steps
            p = self._softmax(np.stack([np.bincount(rows, weights=value * self.weights[cols, j], minlength=n) for j in range(k)], 1))
            e = p - target
            g = np.stack([np.bincount(cols, weights=value * e[rows, j], minlength=BUCKETS) for j in range(k)], 1) + 1e-6 * self.weights
            moment += g * g
            self.weights -= 2.0 * g / (np.sqrt(moment) + 1e-6)

    def _softmax(self, x: np.ndarray) -> np.ndarray:
        if not x.shape[1]:
            return x
        x = x + np.log(self.prior)
        x = np.exp(x - x.max(axis=1, keepdims=True))
        return x / x.sum(axis=1, keepdims=True)

    def posteriors(self, text: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, domains) posteriors, and the words of each row."""
        w = split_words(text)
        sums = np.zeros((len(text), len(self.names)))
        sizes = np.diff(w.bounds)
        full = np.flatnonzero(sizes > 0)
        if len(full):
            word = self.weights[_hashes(w.unique)].sum(axis=1)
            for j in range(len(self.names)):
                sums[full, j] = np.add.reduceat(word[:, j][w.ids], w.bounds[full])
        return self._softmax(sums / np.maximum(3 * sizes, 1)[:, None]), sizes


def features(text: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """The buckets that each row's words fall into, and how often."""
    w = split_words(text)
    kinds = _hashes(w.unique)
    out = []
    for a, b in zip(w.bounds[:-1], w.bounds[1:]):
        cols, tf = np.unique(kinds[w.ids[a:b]].ravel(), return_counts=True)
        out.append((cols.astype(np.int64), tf.astype(np.float64)))
    return out


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches_of(batches, "text"):
        f = features(batch.column(1))
        yield pa.record_batch({"doc_id": batch.column(0), "cols": pa.array([c.astype("<i4").tobytes() for c, _ in f], pa.binary()), "tf": pa.array([t.astype("<f4").tobytes() for _, t in f], pa.binary()), "label": batch.column(2)})


def fit_domains(docs: DataFrame, labelled: DataFrame, rows: int = SAMPLE_ROWS) -> Domains:
    """Learn from ``labelled`` (doc_id, domain): at most ``rows`` documents of each domain, by hash.

    Texts become counts of buckets on the executors, so that the driver gets a bounded number of rows
    of a bounded size.
    """
    found = labelled.filter("domain IS NOT NULL").groupBy("domain").count().orderBy("domain").select("domain").limit(MOST_DOMAINS + 1).collect()
    if len(found) > MOST_DOMAINS:
        raise ValueError(f"more than {MOST_DOMAINS} domains")
    out = Domains([r[0] for r in found])
    place = {name: k for k, name in enumerate(out.names)}
    chosen = labelled_rows(docs, labelled.select("doc_id", F.col("domain").cast("string").alias("label")), [str(n) for n in out.names], rows)
    kind = chosen.schema["doc_id"].dataType.simpleString()
    got = fetch(chosen.mapInArrow(_featured, f"doc_id {kind}, cols binary, tf binary, label string"))
    got = got.sort_by([("label", "ascending"), ("doc_id", "ascending")])
    if got.num_rows:
        sparse = [(np.frombuffer(c, "<i4").astype(np.int64), np.frombuffer(t, "<f4").astype(np.float64)) for c, t in zip(got["cols"].to_pylist(), got["tf"].to_pylist())]
        out.train(sparse, np.array([{str(n): k for n, k in place.items()}[x] for x in got["label"].to_pylist()]))
        give_back()
    return out


def memberships(docs: DataFrame, domains: Domains) -> DataFrame:
    """The rows of docs with ``n_tokens`` and ``p_0``, ``p_1``, ... added (under names not in use)."""
    held = ship(docs.sparkSession, domains)
    names = [f"p_{k}" for k in range(len(domains.names))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = held()
        for batch in batches_of(batches, "text"):
            p, n = model.posteriors(batch.column(1))
            digest = pc.fill_null(batch.column(2), 0)
            yield pa.record_batch({"doc_id": batch.column(0), "row_hash": digest, "n_tokens": n.astype(np.int64), **{x: np.ascontiguousarray(p[:, k]) for k, x in enumerate(names)}})

    kind = docs.schema["doc_id"].dataType.simpleString()
    columns = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("row_hash"))
    return columns.mapInArrow(run, ", ".join([f"doc_id {kind}, row_hash long, n_tokens long", *(f"{n} double" for n in names)]))


class Mixture:
    """Rates as a function of posteriors: the steps of the projected gradient, each from the last."""

    def __init__(self, most: float) -> None:
        self.most, self.steps = most, []

    def rates(self, p: np.ndarray) -> np.ndarray:
        rate = np.ones(len(p))
        for step in self.steps:
            rate = np.clip(rate - (p * step).sum(axis=1), 0.0, self.most)
        return rate


def solve(members: DataFrame, targets: np.ndarray, most: float) -> tuple[DataFrame, Mixture]:
    """``members`` with the ``rate`` of each row, and the same rates as a function.

    Every round needs the domain totals under the rates so far; a round is one scan that returns one
    row.  The rates are an expression in the totals of the rounds since they were last written.
    """
    k = len(targets)
    amount = [F.col("n_tokens") * F.col(f"p_{j}") for j in range(k)]
    sums = members.agg(F.sum("n_tokens"), *[F.sum(amount[i] * F.col(f"p_{j}")) for i in range(k) for j in range(k)], *[F.sum(a) for a in amount]).first()
    out = Mixture(most)
    if not sums[0]:
        return members.withColumn("rate", F.lit(1.0)), out
    scale = float(sums[0])
    gram = np.array([float(x) for x in sums[1 : 1 + k * k]]).reshape(k, k) / scale
    inverse = np.linalg.pinv(gram + 1e-9 * np.trace(gram) / k * np.eye(k))
    totals, rate = np.array([float(x) for x in sums[1 + k * k :]]), F.lit(1.0)
    names = members.columns
    for turn in range(1, MOST_ROUNDS + 1):
        miss = totals - targets
        if np.abs(miss).max() <= CLOSE * scale:
            break
        step = inverse @ (miss / scale)
        out.steps.append(step)
        move = sum((F.col(f"p_{j}") * F.lit(float(step[j])) for j in range(k)), F.lit(0.0))
        rate = F.greatest(F.lit(0.0), F.least(F.lit(float(most)), rate - move))
        before, totals = totals, np.array([float(x) for x in members.agg(*[F.sum(a * rate) for a in amount]).first()])
        if np.abs(totals - before).max() <= CLOSE * scale / 10:
            if np.abs(totals - targets).max() > TOLD * scale:
                warnings.warn(f"the nearest mixture misses its targets by {np.abs(totals - targets).max() / scale:.2%} of all tokens", stacklevel=3)
            break
        if turn % WRITTEN_AFTER == 0:
            members, rate = persist(members.select(*names, rate.alias("rate")), "rates"), F.col("rate")
    else:
        raise RuntimeError(f"rates still move after {MOST_ROUNDS} rounds")
    return members.select(*names, rate.alias("rate")), out


def target_tokens(available: np.ndarray, weights: np.ndarray, most: float) -> np.ndarray:
    """Domain totals in proportion to the weights, as large as the scarcest domain at rate
    ``most``, or the whole corpus, allows.  Domains that would shrink the result below ``SCARCE`` of
    the corpus are left out of that; their targets are all that they have."""
    share = weights / weights.sum()
    reach = np.where(share > 0, most * available / np.maximum(share, 1e-300), np.inf)
    counted = (share > 0) & (reach >= SCARCE * available.sum())
    total = min(reach[counted].min(), available.sum()) if counted.any() else available.sum()
    return np.minimum(share * total, most * available)


def fit_rates(docs: DataFrame, domains: Domains, weights: dict[str, float], most: float = 1.0) -> tuple[DataFrame, Mixture]:
    """(doc_id, row_hash, n_tokens, p_*, rate) for every row of docs (doc_id, text), and the rates as a
    function of posteriors."""
    unknown = set(weights) - set(domains.names)
    if unknown:
        raise ValueError(f"no labelled documents of: {sorted(unknown)}")
    members = persist(memberships(docs, domains), "memberships")
    k, same = len(domains.names), Mixture(most)
    if not k:
        return members.withColumn("rate", F.lit(1.0)), same
    sums = members.agg(*[F.sum(F.col("n_tokens") * F.col(f"p_{j}")) for j in range(k)]).first()
    available = np.array([float(x or 0) for x in sums])
    wanted = np.array([float(weights.get(n, 0.0)) for n in domains.names])
    if not available.sum() or not wanted.sum():
        return members.withColumn("rate", F.lit(1.0)), same
    return solve(members, target_tokens(available, wanted, most), most)


def rates(docs: DataFrame, domains: Domains, weights: dict[str, float], most: float = 1.0) -> DataFrame:
    """The table of ``fit_rates``."""
    return fit_rates(docs, domains, weights, most)[0]


def copies(rate: Column, row_hash: Column) -> Column:
    """Whole copies whose expectation over hashes is the rate."""
    return F.floor(rate + F.pmod(row_hash, F.lit(1 << 20)) / F.lit(float(1 << 20))).cast("int")


def mix(docs: DataFrame, domains: Domains, mixture: Mixture) -> DataFrame:
    """The rows of docs, as often as their rates say; columns as they are.  Each row's posteriors are
    taken from its text once more, so that no document moves."""
    held, at = ship(docs.sparkSession, (domains, mixture)), docs.columns.index("text")
    width = len(docs.columns)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, fitted = held()
        for batch in batches:
            names = batch.schema.names[:width]
            part = pa.RecordBatch.from_arrays(batch.columns, names=[f"c{k}" for k in range(batch.num_columns)])
            for piece in batches_of([part], f"c{at}"):
                rate = fitted.rates(model.posteriors(piece.column(at))[0])
                digest = piece.column(width).to_numpy()
                many = np.floor(rate + (digest % (1 << 20)) / float(1 << 20)).astype(np.int64)
                out = piece.take(pa.array(np.repeat(np.arange(piece.num_rows), many)))
                yield pa.RecordBatch.from_arrays(out.columns[:width], names=names)

    hashed = docs.select(*[docs[c] for c in docs.columns], F.xxhash64("doc_id", "text"))
    return hashed.mapInArrow(run, docs.schema)
