"""Quality classification from positive and unlabelled texts (operator 4).

A small network on features of the whole text (shape of the bytes, repetition,
hashed words) is trained to the non-negative unbiased risk

    prior * E_pos[l(z)] + max(0, E_unl[l(-z)] - prior * E_pos[l(-z)])

with the sigmoid loss: trusted positives, unlabelled web text, and the class
prior, which is estimated as the least ratio of unlabelled to positive mass
above any score of a first network, on rows that this one has not seen. Where the second term falls under zero, its
gradient step is reversed, as the non-negative estimator asks. Scores are
scaled to probabilities (Platt) on labelled rows that training has not used.

Fitting uses at most about SAMPLE rows of each kind, chosen by hash of the id:
a bound on what the driver holds. Scoring is map-only and reads whole texts.

Defined results: null and empty texts get a score like any other; a table
without labelled positives gives every row the score 0.5; a doc_id that labels
repeat takes its largest label; columns named score or predicted are replaced,
all others are passed through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skald.llm.common import GOLDEN, SPACED, Words, buffers, extended, grams, inside_rows, mix, others, quoted, slices, spread, tidy
from skald.llm.language_id import held_out

SAMPLE, HIDDEN, HASHED, STEPS = 8000, 24, 128, 600
_CELLS = 98


def _kinds() -> np.ndarray:
    """A cell for each printable ASCII byte, letters A-Z and a-z as one each, white space, other control, not ASCII."""
    out = np.full(256, 97)
    out[:32] = 96
    out[32:127] = np.arange(95)
    out[[9, 10, 13]] = 95
    out[127] = 96
    out[65:91], out[97:123] = 33, 65
    return out


_KINDS = _kinds()
#: How many features a text has.
WIDTH = _CELLS + 10 + HASHED


def features(col: pa.Array) -> np.ndarray:
    """WIDTH features of each text."""
    raw, at = buffers(col)
    out = np.zeros((len(at) - 1, WIDTH), np.float32)
    for lo, hi in slices(at, 1 << 21):
        part, begin = raw[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        n, size = hi - lo, np.maximum(1, np.diff(begin))[:, None]
        cells = np.bincount(spread(begin) * _CELLS + _KINDS[part], minlength=n * _CELLS).reshape(n, _CELLS)
        words = Words(part, begin, SPACED)
        many = np.diff(words.at)
        row = spread(words.at)
        one = np.maximum(many, 1)

        def distinct(h: np.ndarray, r: np.ndarray) -> np.ndarray:
            _, first = np.unique(mix(h ^ (r.astype(np.uint64) * GOLDEN)), return_index=True)
            return np.bincount(r[first], minlength=n)

        triple = grams(words.hash, 3)
        inside = inside_rows(words.at, 3, len(triple))
        again = words.hash[1:] == words.hash[:-1]
        again &= row[1:] == row[:-1]
        length = (words.end - words.start).astype(float)
        mean = np.bincount(row, length, minlength=n) / one
        extra = [
            np.log1p(np.diff(begin)),
            np.log1p(many),
            mean,
            np.sqrt(np.maximum(0, np.bincount(row, length**2, minlength=n) / one - mean**2)),
            distinct(words.hash, row) / one,
            distinct(triple[inside], row[: len(triple)][inside]) / np.maximum(1, many - 2),
            np.bincount(row[1:][again], minlength=n) / one,
            cells[:, 33] / np.maximum(1, cells[:, 33] + cells[:, 65]),
            many == 0,
            np.log1p(cells[:, 95]),
        ]
        bag = np.bincount(row * HASHED + (words.hash >> np.uint64(57)).astype(np.int64), minlength=n * HASHED).reshape(n, HASHED)
        out[lo:hi] = np.concatenate([np.sqrt(cells / size), np.stack(extra, axis=1), np.sqrt(bag / one[:, None])], axis=1)
    return out


class Network:
    """Standardised features, one hidden layer, a score z; then a * z + b as log-odds."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.p = [rng.normal(0, 1 / np.sqrt(len(mean)), (len(mean), HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
        self.a, self.b = 1.0, 0.0

    def norm(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def z(self, x: np.ndarray) -> np.ndarray:
        w, c, v, d = self.p
        return np.maximum(0, x @ w + c) @ v + d[0]

    def gradient(self, x: np.ndarray, dz: np.ndarray) -> list[np.ndarray]:
        w, c, v, _ = self.p
        h = np.maximum(0, x @ w + c)
        dh = dz[:, None] * v * (h > 0)
        return [x.T @ dh, dh.sum(0), h.T @ dz, np.array([dz.sum()])]

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.z(self.norm(x)) + self.b, -30, 30)))


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The largest share of positives that the unlabelled scores allow: the least ratio of tail masses."""
    cuts = np.quantile(positive, np.linspace(0, 0.9, 91))
    p = np.array([(positive >= t).mean() for t in cuts])
    u = np.array([(unlabelled >= t).mean() for t in cuts])
    return float(np.clip(np.min((u + 1 / np.sqrt(len(unlabelled))) / p), 0.01, 0.99))


def fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float, *, steps: int = STEPS, batch: int = 1024, rate: float = 3e-3, seed: int = 5) -> Network:
    """Minimise the non-negative unbiased risk by Adam."""
    net = Network(unlabelled.mean(0), unlabelled.std(0) + 1e-3, seed)
    xp, xu = net.norm(positive), net.norm(unlabelled)
    rng = np.random.default_rng(seed)
    m, v = [np.zeros_like(q) for q in net.p], [np.zeros_like(q) for q in net.p]
    for step in range(1, steps + 1):
        p, u = xp[rng.integers(0, len(xp), min(batch, len(xp)))], xu[rng.integers(0, len(xu), min(batch, len(xu)))]
        g = risk_gradient(net, p, u, prior)
        for i, q in enumerate(net.p):
            grad = g[i] + 1e-4 * q
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.999 * v[i] + 0.001 * grad**2
            q -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    return net


def risk_gradient(net: Network, p: np.ndarray, u: np.ndarray, prior: float) -> list[np.ndarray]:
    """The gradient of the unbiased risk with the sigmoid loss; where its second term is under zero, that of minus this term."""
    loss = lambda z: 1 / (1 + np.exp(np.clip(z, -30, 30)))  # noqa: E731  l(z); l(-z) is 1 - l(z)
    lp, lu = loss(net.z(p)), loss(net.z(u))
    negative = (1 - lu).mean() - prior * (1 - lp).mean()
    # d l(z) / dz = -l (1 - l); d l(-z) / dz = l (1 - l)
    up, uu = net.gradient(p, lp * (1 - lp) / len(p)), net.gradient(u, lu * (1 - lu) / len(u))
    if negative >= 0:
        return [-2 * prior * a + b for a, b in zip(up, uu)]
    return [prior * a - b for a, b in zip(up, uu)]


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Log-odds a * z + b by regularised logistic regression with smoothed targets."""
    ones, zeros = y.sum(), (1 - y).sum()
    t = np.where(y > 0, (ones + 1) / (ones + 2), 1 / (zeros + 2))
    w, x = np.array([1.0, 0.0]), np.stack([z, np.ones(len(z))], axis=1)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), x.T @ (t - p))
        w = w + np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    return float(max(w[0], 1e-3)), float(w[1])


def train(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE, prior: float | None = None) -> Network | None:
    """A network from the labelled rows and a sample of all rows; None without labelled positives."""
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).alias("y")).filter("id is not null and y in (0, 1)").groupBy("id").agg(F.max("y").alias("y"))
    known = known.join(docs.select(F.col(id_col).alias("id")).filter("id is not null").distinct(), "id", "left_semi")
    counts = {int(r["y"]): r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    if not counts.get(1):
        return None
    place = F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(1_000_000)) / 1e6
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    many = rows.count()
    share = {y: min(1.0, sample / n) for y, n in counts.items()}
    most, own = max(share.values()), min(1.0, sample / many)
    schema = T.StructType([rows.schema["id"], T.StructField("x", T.BinaryType()), T.StructField("unlabelled", T.BooleanType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary()), batch.column(2)], names=schema.names)

    # the unlabelled sample stands for all rows, labelled or not
    described = rows.withColumn("unlabelled", F.coalesce(F.pmod(F.xxhash64("id", F.lit("unlabelled")), F.lit(1_000_000)) / 1e6 < own, F.lit(True))).filter(F.col("unlabelled") | (place < most)).mapInArrow(tidy(run), schema)
    y_share = F.create_map(*[x for y, s in share.items() for x in (F.lit(y), F.lit(s))])
    chosen = known.filter(place < F.element_at(y_share, F.col("y").cast("int")))
    got = described.join(chosen, "id", "left").filter("unlabelled or y is not null").withColumn("calibrates", F.pmod(F.xxhash64("id", F.lit("calibrate")), F.lit(4)) == 0).select("x", "unlabelled", "y", "calibrates").toPandas()
    if got.empty:
        return None
    x = np.frombuffer(b"".join(got["x"]), np.float32).reshape(-1, WIDTH).astype(float)
    y, unlabelled, calibrates = got["y"].to_numpy(float), got["unlabelled"].to_numpy(bool), got["calibrates"].fillna(False).to_numpy(bool)
    positive = (y == 1) & ~calibrates
    if not positive.any() or not unlabelled.any():
        return None
    if prior is None:
        prior = class_prior(x, positive, unlabelled & ~calibrates, (y == 1) & calibrates, unlabelled & calibrates)
    net = fit(x[positive], x[unlabelled], min(prior, 0.99))
    judged = calibrates & ~np.isnan(y)
    if judged.any() and len(np.unique(y[judged])) == 2:
        net.a, net.b = platt(net.z(net.norm(x[judged])), y[judged])
    return net


def class_prior(x: np.ndarray, positive: np.ndarray, unlabelled: np.ndarray, other_positive: np.ndarray, other_unlabelled: np.ndarray) -> float:
    """The share of positives among unlabelled rows: a network tells positive from unlabelled, its scores of other rows of both kinds (if there are 20 each) give the estimate."""
    if not unlabelled.any():
        unlabelled = other_unlabelled
    net = fit(x[positive], x[unlabelled], 0.5)
    if min(other_positive.sum(), other_unlabelled.sum()) >= 20:
        positive, unlabelled = other_positive, other_unlabelled
    return estimated_prior(net.z(net.norm(x[positive])), net.z(net.norm(x[unlabelled])))


def score(docs: DataFrame, net: Network | None, *, text_col: str = "text", threshold: float = 0.7) -> DataFrame:
    """docs with score and predicted; map-only."""
    kept = others(docs.columns, "score", "predicted")
    where = kept.index(text_col)
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(features(batch.column(where))) if shared.value else np.full(batch.num_rows, 0.5)
            cols = [*batch.columns, pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.RecordBatch.from_arrays(cols, names=[str(i) for i in range(len(cols))])

    new = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]
    return extended(docs.select(*[F.col(quoted(c)) for c in kept]), run, new)


def classify(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """Train on the rows that are not held out, then score all of docs from their text alone."""
    net = train(docs.filter(~held_out(id_col)), labels.filter(~held_out(id_col)), id_col=id_col, text_col=text_col, **options)
    return score(docs, net, text_col=text_col)
