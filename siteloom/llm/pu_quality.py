"""Quality classifier by positive-unlabelled learning with the non-negative risk."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .blocks import text_batches
from .words import SPACE, mix, words

# byte classes: lower-case and non-ASCII letters, upper-case letters, digits, blanks, line feeds, each other sign
_CLASS = np.zeros(256, np.uint8)
_CLASS[0x41:0x5B], _CLASS[0x30:0x3A], _CLASS[0x20], _CLASS[0x0A] = 1, 2, 3, 4
_SIGNS = [b for b in range(0x80) if not (chr(b).isalnum() or b in (0x20, 0x0A))]
_CLASS[_SIGNS] = 5 + np.arange(len(_SIGNS)) % 64
_N = 5 + 64
N_FEATURES = _N * _N + 8
_AT_ONCE = 200  # texts; short ones would else make a wide table of many rows


def features(texts: list[bytes | None]) -> np.ndarray:
    """One row per text: frequencies of neighbouring byte classes, and how words repeat.

    Nothing but the text is used. A null or empty text has a row of zeros.
    """
    parts = [_features(texts[i : i + _AT_ONCE]) for i in range(0, len(texts), _AT_ONCE)]
    return np.concatenate(parts) if parts else np.zeros((0, N_FEATURES), np.float32)


def _features(texts: list[bytes | None]) -> np.ndarray:
    w = words(texts, SPACE)
    n = len(texts)
    size = np.fromiter((len(t or b"") for t in texts), np.int64, n)
    doc = np.repeat(np.arange(n), size + 1)
    kind = _CLASS[w.data].astype(np.int64)
    inner = doc[1:] == doc[:-1]
    code = (doc[:-1] * (_N * _N) + kind[:-1] * _N + kind[1:])[inner]
    pairs = np.bincount(code, minlength=n * _N * _N).reshape(n, -1)
    out = np.zeros((n, N_FEATURES), np.float32)
    out[:, : _N * _N] = np.log1p(100.0 * pairs / np.maximum(size, 1)[:, None])
    counts = w.counts
    many = np.maximum(counts, 1)
    of = np.repeat(np.arange(n), counts)
    if len(of):
        length = w.end - w.start
        upper = np.concatenate([[0], np.cumsum((w.data >= 0x41) & (w.data <= 0x5A))])
        shouted = (upper[w.end] - upper[w.start]) >= np.maximum(2, 0.6 * length)
        same = np.zeros(len(of), bool)
        same[1:] = (w.hash[1:] == w.hash[:-1]) & (of[1:] == of[:-1])
        twice = np.zeros(len(of), bool)
        twice[2:] = (w.hash[2:] == w.hash[:-2]) & (of[2:] == of[:-2])
        order = np.lexsort((w.hash, of))
        new = np.ones(len(of), bool)
        new[1:] = (w.hash[order][1:] != w.hash[order][:-1]) | (of[order][1:] != of[order][:-1])
        distinct = np.bincount(of[order][new], minlength=n)
        starts = np.flatnonzero(new)
        top = np.zeros(n, np.int64)
        np.maximum.at(top, of[order][starts], np.diff(np.append(starts, len(of))))
        for j, values in enumerate((same, twice, shouted)):
            out[:, _N * _N + j] = 3 * np.bincount(of, values, minlength=n) / many
        out[:, _N * _N + 3] = distinct / many
        out[:, _N * _N + 4] = 3 * top / many * (counts >= 20)
        out[:, _N * _N + 5] = np.bincount(of, length, minlength=n) / many / 10
        out[:, _N * _N + 6] = np.log1p(counts) / 10
        out[:, _N * _N + 7] = (distinct / many < 0.3) & (counts >= 20)
    return out


@dataclass
class Model:
    used: np.ndarray  # features that vary at all
    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray
    bias: float
    prior: float

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid((((x[:, self.used] - self.mean) / self.scale) @ self.weight).astype(np.float64) + self.bias)


@dataclass
class Moments:
    """Sums over rows of features that the squared loss needs: how many, their sum, their products."""

    n: float
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, x: np.ndarray) -> Moments:
        x = x.astype(np.float64)
        return cls(len(x), x.sum(axis=0), x.T @ x)

    def __add__(self, other: Moments) -> Moments:
        return Moments(self.n + other.n, self.first + other.first, self.second + other.second)

    def scaled(self, mean: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Mean and mean product of (x - mean) / scale, a constant 1 at the end."""
        m = (self.first / self.n - mean) / scale
        c = self.second / self.n - np.outer(mean, self.first / self.n) - np.outer(self.first / self.n, mean) + np.outer(mean, mean)
        q = np.empty((len(m) + 1, len(m) + 1))
        q[:-1, :-1] = c / np.outer(scale, scale)
        q[:-1, -1] = q[-1, :-1] = m
        q[-1, -1] = 1.0
        return np.append(m, 1.0), q


def _apart(positive, unlabelled, decay: float) -> np.ndarray:
    """Linear g that tells positives from unlabelled rows with the least squared loss, all in moments."""
    (mp, qp), (mu, qu) = positive, unlabelled
    ridge = decay * np.eye(len(mp))
    ridge[-1, -1] = 0.0
    return np.linalg.solve(qp + qu + 2 * ridge + 1e-9 * np.eye(len(mp)), mp - mu)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def _margin(n_positive: float, n_unlabelled: float) -> float:
    """How far two shares counted over so many rows may be off, at one chance in ten."""
    return float(np.sqrt(np.log(4 / 0.1) / 2) * (n_positive**-0.5 + n_unlabelled**-0.5))


def least_risk(positive: np.ndarray, prior: float, sums, decay: float, rounds: int) -> np.ndarray:
    """Linear g with the least non-negative risk

    prior * E_p[l(g)] + max(0, E_u[l(-g)] - prior * E_p[l(-g)]),   l logistic,

    by Newton's method: as l(g) - l(-g) = -g, the risk is convex where the bracket is not negative. ``sums(w)`` is one pass
    over the unlabelled rows: their number, loss, gradient and curvature at w. A step to where the bracket is negative,
    even for the least prior within its margin, is halved back. ``positive`` and the rows of ``sums`` are scaled, with a constant 1 at the end.
    """
    w = before = np.zeros(positive.shape[1])
    mean = positive.mean(axis=0)
    # the fewer positives for the features, the easier they are learnt by heart
    ridge = decay * (1 + 3 * len(w) / len(positive)) * np.eye(len(w))
    ridge[-1, -1] = 1e-6
    for _ in range(rounds):
        n, loss, first, second = sums(w)
        if loss / n < (prior - _margin(len(positive), n)) * np.logaddexp(0, positive @ w).mean():
            w = (before + w) / 2
            continue
        step = np.linalg.solve(second / n + ridge, first / n - prior * mean + ridge @ w)
        before, w = w, w - step
        if np.abs(step).max() < 1e-4:
            break
    return w


_BINS = 4000
_SPAN = 4.0  # values beyond it share the outer bins


def _histogram(g: np.ndarray) -> np.ndarray:
    spot = np.clip((g + _SPAN) / (2 * _SPAN) * _BINS, 0, _BINS - 1).astype(np.int64)
    return np.bincount(spot, minlength=_BINS)


def _class_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among the unlabelled, from histograms of their values: the least ratio, over thresholds, of
    unlabelled to positive mass above it, each with a margin for its sampling error."""
    p, u = (np.cumsum(h[::-1])[::-1] / h.sum() for h in (positive, unlabelled))
    margin = _margin(positive.sum(), unlabelled.sum())
    usable = np.flatnonzero(p >= 0.1)
    best = usable[np.argmin((u[usable] + margin) / p[usable])]
    return float(np.clip(u[best] / p[best], 0.02, 0.98))


def fit(positive: np.ndarray, halves: tuple[Moments, Moments], histogram, sums, decay: tuple[float, float] = (0.3, 0.05), rounds: int = 8) -> tuple:
    """(weights, bias, mean, scale, prior) from positives and all unlabelled rows, which are met in sums only.

    ``halves`` are their moments in two halves. Values of the second half under what was fitted to the first come from
    ``histogram(mean, scale, w)``; with those of the positives kept apart they give the class prior. Then the risk is
    taken over all rows, with ``sums(mean, scale, w)`` in each round.
    """
    every, half = Moments.of(positive), Moments.of(positive[::2])
    both = every + halves[0] + halves[1]
    mean = both.first / both.n
    scale = np.maximum(np.sqrt(np.maximum(np.diag(both.second) / both.n - mean**2, 0)), 0.05)
    z = _with_one(positive, mean, scale)
    prior = 0.5
    if len(positive) > 1 and halves[0].n and halves[1].n:
        w = _apart(half.scaled(mean, scale), halves[0].scaled(mean, scale), decay[0])
        prior = _class_prior(_histogram(z[1::2] @ w), histogram(mean, scale, w))
    w = least_risk(z, prior, lambda w: sums(mean, scale, w), decay[1], rounds)
    return w[:-1], float(w[-1]), mean, scale, prior


def _with_one(x: np.ndarray, mean: np.ndarray, scale: np.ndarray) -> np.ndarray:
    return np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], axis=1)


def risk_sums(z: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Number, loss l(-g), gradient and curvature of scaled rows, in one array."""
    g = z @ w
    s = _sigmoid(g)
    return np.concatenate([[len(z), np.logaddexp(0, g).sum()], s @ z, ((z * (s * (1 - s))[:, None]).T @ z).ravel()])


def _parts(sums: np.ndarray, d: int) -> tuple[float, float, np.ndarray, np.ndarray]:
    return float(sums[0]), float(sums[1]), sums[2 : 2 + d], sums[2 + d :].reshape(d, d)


def _scores(model: Model, texts: list[bytes | None]) -> np.ndarray:
    return np.concatenate([model.score(_features(texts[i : i + _AT_ONCE])) for i in range(0, len(texts), _AT_ONCE)])


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


FEATURES = "doc_id long, half int, places binary, x binary"


def _written(docs: DataFrame, label: str) -> DataFrame:
    """Features that are not zero (places, values) of every row of (doc_id, text), in two halves by a hash of the id."""

    def rows(batches):
        for names, texts in text_batches(batches):
            x = features(texts)
            places = [np.flatnonzero(r).astype(np.uint16) for r in x]
            values = [r[p].astype(np.float16).tobytes() for r, p in zip(x, places)]
            half = (mix(np.array([n or 0 for n in names], np.int64).view(np.uint64)) & np.uint64(1)).astype(np.int32)
            fields = [pa.array(names, pa.int64()), pa.array(half), pa.array([p.tobytes() for p in places], pa.binary()), pa.array(values, pa.binary())]
            yield pa.RecordBatch.from_arrays(fields, names=["doc_id", "half", "places", "x"])

    return cut_lineage(docs.mapInArrow(rows, FEATURES), label)


def _dense(places: list[bytes], values: list[bytes], columns: np.ndarray) -> np.ndarray:
    out = np.zeros((len(places), len(columns)), np.float32)
    for i, (p, x) in enumerate(zip(places, values)):
        p = np.frombuffer(p, np.uint16)
        at = np.searchsorted(columns, p)
        at[at == len(columns)] = 0
        own = columns[at] == p
        out[i, at[own]] = np.frombuffer(x, np.float16)[own]
    return out


def _portions(batches):
    for b in batches:
        for i in range(0, b.num_rows, 1000):
            part = b.slice(i, 1000)
            yield part.column("half").to_numpy(), part.column("places").to_pylist(), part.column("x").to_pylist()


def _gathered(rows: DataFrame, make) -> dict[tuple[int, int], np.ndarray]:
    """Arrays by (kind, half) that ``make(batches)`` yields once a task, added up in two stages of a bounded number of rows."""

    def each(batches):
        for kind, half, array in make(batches):
            yield pa.RecordBatch.from_arrays(
                [pa.array([kind], pa.int32()), pa.array([half], pa.int32()), pa.array([array.astype(np.float64).tobytes()], pa.binary())],
                names=["kind", "half", "body"],
            )

    def both(key, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in batches:
            for x in b.column("body"):
                own = np.frombuffer(x.as_py(), np.float64)
                total = own if total is None else total + own
        yield pa.RecordBatch.from_arrays(
            [pa.array([key[0].as_py()], pa.int32()), pa.array([key[1].as_py()], pa.int32()), pa.array([total.tobytes()], pa.binary())],
            names=["kind", "half", "body"],
        )

    def added(key: tuple[pa.Scalar, ...], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return both(key, batches)

    schema = "kind int, half int, body binary"
    # first in groups of tasks, then all: no task adds up what every task sent
    parts = rows.select("half", "places", "x").mapInArrow(each, schema).withColumn("by", F.pmod(F.spark_partition_id(), F.lit(64)))
    parts = parts.groupBy("kind", "half", "by").applyInArrow(added, schema)
    return {(r.kind, r.half): np.frombuffer(r.body, np.float64) for r in parts.groupBy("kind", "half").applyInArrow(added, schema).collect()}


def _usual(rows: DataFrame, at_most: int) -> np.ndarray:
    """Features that most rows have, ``at_most`` of them: counted over all rows."""

    def make(batches):
        count = np.zeros(N_FEATURES)
        for _, places, _ in _portions(batches):
            count += np.bincount(np.frombuffer(b"".join(places), np.uint16), minlength=N_FEATURES)
        yield 0, 0, count

    found = _gathered(rows, make).get((0, 0))
    if found is None:
        return np.zeros(0, np.int64)
    best = np.lexsort((np.arange(N_FEATURES), -found))[:at_most]
    return np.sort(best[found[best] > 0])


def _moments(rows: DataFrame, columns: np.ndarray) -> tuple[Moments, Moments]:
    def make(batches):
        total = [[0.0, np.zeros(len(columns)), np.zeros((len(columns), len(columns)))] for _ in range(2)]
        for half, places, values in _portions(batches):
            x = _dense(places, values, columns)
            for h in (0, 1):
                own = x[half == h]
                if len(own):
                    total[h][0] += len(own)
                    total[h][1] += own.sum(axis=0, dtype=np.float64)
                    total[h][2] += own.T @ own
        for h, (n, first, second) in enumerate(total):
            yield 0, h, np.concatenate([[n], first, second.ravel()])

    found = _gathered(rows, make)
    d = len(columns)
    empty = np.zeros(1 + d + d * d)
    parts = [found.get((0, h), empty) for h in (0, 1)]
    return tuple(Moments(float(x[0]), x[1 : 1 + d], x[1 + d :].reshape(d, d)) for x in parts)


def train(docs: DataFrame, labels: DataFrame, max_positive: int = 3000, max_features: int = 400) -> Model | None:
    """Model from trusted positives (``quality`` 1, not held out) and all documents without a label.

    The positives are a bounded sample: those of least id hash, ``max_positive`` of them. Of the unlabelled documents every
    one counts, at any size: features are written once, then summed up in a number of passes that does not grow with them - which of
    them are usual (``max_features``), their moments in two halves, the histogram of one half's values for the class prior, and
    at most eight rounds of the risk. What reaches the driver has the size of the moments. Other labels are not looked at. None without positives or
    unlabelled documents.
    """
    known = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "quality")
    trusted = known.where("quality = 1").where(~held_out()).select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_positive)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # features first, in one pass without a shuffle; only they are compared with the labels
    every = _written(texts.where("doc_id is not null"), "features")
    positives = every.join(F.broadcast(trusted), "doc_id")  # at most max_positive ids
    got = positives.select("doc_id", "places", "x").distinct().orderBy("doc_id", "places", "x").limit(max_positive).collect()
    unknown = cut_lineage(every.join(known.select("doc_id").distinct(), "doc_id", "left_anti"), "unlabelled")
    columns = _usual(unknown.select(*every.columns).unionByName(positives.select(*every.columns)), max_features)
    if not got or not len(columns):
        return None
    halves = _moments(unknown, columns)
    if not halves[0].n + halves[1].n:
        return None
    positive = _dense([r.places for r in got], [r.x for r in got], columns).astype(np.float64)

    def histogram(mean, scale, w):
        def make(batches):
            total = np.zeros(_BINS)
            for half, places, values in _portions(batches):
                x = _dense([p for p, h in zip(places, half) if h], [v for v, h in zip(values, half) if h], columns)
                if len(x):
                    total += _histogram(_with_one(x, mean, scale) @ w)
            yield 0, 1, total

        return _gathered(unknown, make)[0, 1]

    def sums(mean, scale, w):
        d = len(columns) + 1

        def make(batches):
            total = np.zeros(2 + d + d * d)
            for _, places, values in _portions(batches):
                total += risk_sums(_with_one(_dense(places, values, columns), mean, scale), w)
            yield 0, 0, total

        return _parts(_gathered(unknown, make)[0, 0], d)

    w, b, mean, scale, prior = fit(positive, halves, histogram, sums)
    return Model(columns, mean, scale, w, b, prior)


def quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3, **sizes: int) -> DataFrame:
    """Score of every document's whole text: the likelihood that ``labels.quality`` is 1.

    ``train`` fits a linear model on what the text looks like (neighbouring byte classes, repeated
    and shouted words) by the non-negative unbiased positive-unlabelled risk over all documents
    without label, with a class prior estimated from the same data. Labels of held-out documents (crc32 of the id as text, modulo
    5, is 0) are never read. Scoring is one pass without a shuffle.

    Returns all columns of ``docs`` plus held_out, score (double, 0 to 1) and predicted (1 if ``score >=
    threshold``, else 0); columns of these names are replaced. Null and empty texts get the score of a text
    without features; without training rows every score is 0.5. Null ids count as not held out.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in ("held_out", "score", "predicted")])
    model = train(docs, labels, **sizes)
    sent = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")

    def rows(batches):
        for batch in batches:
            done = 0
            numbered = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], names=["row", "text"])
            for ids, texts in text_batches([numbered]):
                part = batch.slice(done, len(ids))
                done += len(ids)
                score = np.full(len(ids), 0.5) if sent.value is None else _scores(sent.value, texts)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(score, pa.float64())], names=[*part.schema.names, "score"])

    scored = docs.mapInArrow(rows, docs.select("*", F.lit(0.5).alias("score")).schema)
    return scored.select(*docs.columns, held_out().alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
