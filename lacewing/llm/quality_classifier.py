"""Quality classifier by positive-unlabelled learning.

A linear model is fitted by minimising the non-negative unbiased risk: trusted positives
(rows labelled 1), unlabelled web text, and an estimate of the share of positives in it.
Labels 0 are not used. The prior is the best-bin estimate: a first classifier of positives
against unlabelled text ranks both, and the least ratio, over thresholds, of the unlabelled
and the positive share above it (with confidence bounds) is the share of positives.

Features are of form alone, cheap and open to any language: counts of 1- to 4-grams over
character classes (lower case or non-ASCII, upper case, digit, each other ASCII character
itself; runs cut to two), hashed, as square roots of relative frequencies; and a few
measures of length and repetition.

The model is fitted on the driver on at most ``most_rows`` positives and as many unlabelled
texts, the least by a hash of their ids (of an id that repeats, one text). The prior is a statistic
of all unlabelled training texts: two first models, each fitted on one half of the sample by a hash of the
id, score the half of the corpus that they haven't seen, and the shares above each threshold come
from a histogram of all scores. Every text is scored whole, in narrow maps.

Defined cases: null text is empty and is scored like an empty text; null labels are no labels; with no positive
rows every score is 0.5; repeated rows and null ids give a row each; an empty table gives
none; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import as_bytes, documents, id_remainder, map_arrow, parts

HASHED = 1024
EXTRA = 7
WIDTH = HASHED + EXTRA
THRESHOLD = 0.3


def _classes() -> np.ndarray:
    table = np.arange(256, dtype=np.uint8)
    table[ord("a") : ord("z") + 1] = ord("a")
    table[ord("A") : ord("Z") + 1] = ord("A")
    table[ord("0") : ord("9") + 1] = ord("0")
    table[128:] = ord("a")
    table[[9, 11, 12, 13]] = 32
    table[0] = 1  # 0 separates texts
    return table


_CLASSES = _classes()


def features(texts: list[bytes]) -> np.ndarray:
    """One row of WIDTH features for each text."""
    n = len(texts)
    out = np.zeros((n, WIDTH), np.float32)
    if not n:
        return out
    raw = np.frombuffer(b"\0".join(texts) + b"\0", np.uint8)
    sizes = np.array([len(t) + 1 for t in texts])
    c = _CLASSES[raw]
    ends = np.cumsum(sizes) - 1
    c[ends] = 0
    keep = np.ones(c.size, bool)
    keep[2:] = (c[2:] != c[1:-1]) | (c[2:] != c[:-2])
    keep[ends] = True
    text = np.repeat(np.arange(n, dtype=np.int64), sizes)[keep]
    c = c[keep].astype(np.uint32)
    flat = np.zeros(n * HASHED)
    key = np.zeros(c.size, np.uint32)
    for order in range(1, 5):
        key = key[: c.size - order + 1] * np.uint32(0x01000193) + c[order - 1 :] + np.uint32(order)
        slot = (key * np.uint32(0x9E3779B1)) >> np.uint32(22)
        whole = text[: slot.size] == text[order - 1 :]
        flat += np.bincount((text[: slot.size] * HASHED + slot)[whole], minlength=n * HASHED)
    counts = flat.reshape(n, HASHED)
    out[:, :HASHED] = np.sqrt(counts / np.maximum(counts.sum(1, keepdims=True), 1))
    for i, t in enumerate(texts):
        w, lines = t.split(), [s for s in t.split(b"\n") if s.strip()]
        k = len(w)
        out[i, HASHED:] = (
            np.log1p(k),
            len(set(w)) / k if k else 0,
            sum(map(len, w)) / k / 10 if k else 0,
            1 - len(set(lines)) / len(lines) if lines else 0,
            k / len(lines) / 100 if lines else 0,
            sum(map(bytes.__eq__, w, w[1:])) / k if k else 0,
            1 - len(set(zip(w, w[1:], w[2:]))) / (k - 2) if k > 2 else 0,
        )
    return out


class Linear:
    """Weights over standardised features."""

    def __init__(self, mean, scale, weights, bias):
        self.mean, self.scale, self.weights, self.bias = mean, scale, weights, bias

    def logits(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights + self.bias

    def scores(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x).astype(np.float64), -30, 30)))


def _descend(p, u, gradient, seed, epochs=40, batch=512, rate=0.01, decay=1e-3) -> tuple[np.ndarray, float]:
    """Adam over batches of positives and unlabelled rows; ``gradient`` gives the slope of
    the risk in the logits of both."""
    rng = np.random.default_rng(seed)
    w, b = np.zeros(p.shape[1]), 0.0
    m, v = np.zeros(w.size + 1), np.zeros(w.size + 1)
    steps = epochs * max(1, -(-max(len(p), len(u)) // batch))
    for k in range(1, steps + 1):
        i, j = rng.integers(0, len(p), batch), rng.integers(0, len(u), batch)
        xp, xu = p[i], u[j]
        gp, gu = gradient(xp @ w + b, xu @ w + b)
        g = np.append(xp.T @ gp + xu.T @ gu + decay * w, gp.sum() + gu.sum())
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = rate * (1 - 0.9 * k / steps) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.999**k)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, b


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def cuts_of(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Thresholds, ascending, among the logits of positives and of a sample of unlabelled rows."""
    return np.quantile(np.concatenate([p, u]), np.linspace(0, 0.99, 200))


def counts_above(logits: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many logits are at least each threshold."""
    return logits.size - np.searchsorted(np.sort(logits), cuts)


def estimate_prior(above_p: np.ndarray, n_p: int, above_u: np.ndarray, n_u: int) -> float:
    """The best-bin estimate from the numbers of positives and of unlabelled rows above each
    threshold, by models that weren't fitted on them: the least ratio of the shares, with
    confidence bounds."""
    bound = lambda n: np.sqrt(np.log(20) / (2 * n))
    qp, qu = above_p / n_p, above_u / n_u
    usable = qp > 3 * bound(n_p)
    if not usable.any():
        return float(np.clip(qu[0], 0.01, 0.99))
    ratio = (qu[usable] + bound(n_u)) / np.maximum(qp[usable] - bound(n_p), 1e-9)
    best = int(np.argmin(ratio))
    return float(np.clip(qu[usable][best] / qp[usable][best], 0.01, 0.99))


def against(zp: np.ndarray, zu: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The slope, in the logits, of the logistic loss of positives against unlabelled rows."""
    return -(1 - _sigmoid(zp)) / zp.size, _sigmoid(zu) / zu.size


def negative_risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The unbiased estimate of the negatives' risk: that of unlabelled rows as negatives, less
    the positives' share of it."""
    log_not = lambda z: -np.log(np.maximum(1 - _sigmoid(z), 1e-12)).mean()
    return float(log_not(zu) - prior * log_not(zp))


def risk(zp: np.ndarray, zu: np.ndarray, prior: float) -> float:
    """The non-negative unbiased risk."""
    return float(prior * -np.log(np.maximum(_sigmoid(zp), 1e-12)).mean() + max(0.0, negative_risk(zp, zu, prior)))


def risk_slope(zp: np.ndarray, zu: np.ndarray, prior: float) -> tuple[np.ndarray, np.ndarray]:
    """The slope of the unbiased risk in the logits; where its negative part is below zero, the
    step that brings that part back up instead."""
    sp, su = _sigmoid(zp), _sigmoid(zu)
    if negative_risk(zp, zu, prior) < 0:
        return prior * sp / zp.size, -su / zu.size
    return (-prior * (1 - sp) - prior * sp) / zp.size, su / zu.size


class Standard:
    """Feature rows with the mean and spread of unlabelled rows taken out."""

    def __init__(self, u: np.ndarray):
        self.mean, self.scale = u.mean(0, dtype=np.float64), u.std(0, dtype=np.float64) + 0.01

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean.astype(np.float32)) / self.scale.astype(np.float32)).astype(np.float32)


def first_models(p: np.ndarray, u: np.ndarray, side_p: np.ndarray, side_u: np.ndarray, standard: Standard, seed: int = 5) -> list[Linear] | None:
    """Positives against unlabelled rows, fitted on each of two sides; none if one is empty."""
    out = []
    for side in (0, 1):
        a, b = p[side_p == side], u[side_u == side]
        if not len(a) or not len(b):
            return None
        out.append(Linear(standard.mean, standard.scale, *_descend(standard(a), standard(b), against, seed)))
    return out


def across(models: list[Linear], x: np.ndarray, side: np.ndarray) -> np.ndarray:
    """Logits of each row by the model of the other side."""
    return np.where(side == 0, models[1].logits(x), models[0].logits(x))


def fit(p: np.ndarray, u: np.ndarray, prior: float, standard: Standard, seed: int = 6) -> Linear:
    """The classifier of least non-negative risk, from feature rows."""
    return Linear(standard.mean, standard.scale, *_descend(standard(p), standard(u), lambda zp, zu: risk_slope(zp, zu, prior), seed))


def _side(doc_id):
    """Column: one of two sides, by the id."""
    return F.pmod(F.xxhash64(F.lit(5), doc_id), F.lit(2)).cast("int")


def unlabelled_above(rows: DataFrame, models: list[Linear], cuts: np.ndarray) -> tuple[np.ndarray, int]:
    """Of all rows (side, text), how many have a logit of at least each threshold, and how many
    there are: counts of bins, combined in each task and before the driver."""

    def count(batches):
        bins = np.zeros(cuts.size + 1, np.int64)
        for part in parts(batches):
            z = across(models, features(as_bytes(part.column("text"))), part.column("side").to_numpy())
            bins += np.bincount(np.searchsorted(cuts, z, side="right"), minlength=bins.size)
        yield pa.record_batch([pa.array(np.arange(bins.size)), pa.array(bins)], names=["k", "v"])

    found = map_arrow(rows.select("side", "text"), count, "k long, v long").groupBy("k").agg(F.sum("v").alias("v")).collect()
    bins = np.zeros(cuts.size + 1, np.int64)
    for r in found:
        bins[r["k"]] = r["v"]
    return bins[::-1].cumsum()[::-1][1:], int(bins.sum())


def train(docs: DataFrame, labels: DataFrame, most_rows: int = 8192) -> tuple[Linear, float]:
    """Fits on rows whose crc32(id) modulo 5 is not 0; the prior is estimated from all of them."""
    spark = docs.sparkSession
    learn = id_remainder(F.col("doc_id")) != 0
    first = lambda df, kind: df.where(learn & F.col("doc_id").isNotNull()).select(
        F.col("doc_id").cast("long").alias("sample_id"), F.lit(kind).alias("sample_kind")
    ).distinct().orderBy(F.xxhash64(F.lit(3), "sample_id")).limit(most_rows)
    chosen = first(labels.where("quality = 1"), "p").union(first(docs, "u")).collect()
    keyed = docs.where(learn).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    empty = Linear(np.zeros(WIDTH), np.ones(WIDTH), np.zeros(WIDTH), 0.0), 0.5
    if not chosen:
        return empty
    sample = F.broadcast(spark.createDataFrame(chosen, "sample_id long, sample_kind string"))  # at most 2 * most_rows rows
    rows = keyed.join(sample, F.col("doc_id") == F.col("sample_id")).groupBy("sample_id", "sample_kind")
    # An id that many rows have gives one of its texts, so the sample is bounded by its ids.
    rows = rows.agg(F.min_by("text", F.xxhash64("text")).alias("text")).withColumn("side", _side(F.col("sample_id")))

    def compute(batches):
        for part in parts(batches):
            x = features(as_bytes(part.column("text")))
            blobs = pa.array([r.tobytes() for r in x], pa.binary())
            yield pa.record_batch([*(part.column(c) for c in ("sample_id", "sample_kind", "side")), blobs], names=["id", "kind", "side", "x"])

    found = map_arrow(rows.select("sample_id", "sample_kind", "side", "text"), compute, "id long, kind string, side int, x binary")
    found = found.toArrow().sort_by([("kind", "ascending"), ("id", "ascending"), ("x", "ascending")])
    n_p = found.column("kind").to_pylist().count("p")
    x = np.frombuffer(b"".join(found.column("x").to_pylist()), np.float32).reshape(-1, WIDTH)
    side = found.column("side").to_numpy()
    del found
    p, u = x[:n_p], x[n_p:]
    if not len(p) or not len(u):
        return empty
    standard = Standard(u)
    models, prior = first_models(p, u, side[:n_p], side[n_p:], standard), 0.5
    if models:
        zp = across(models, p, side[:n_p])
        cuts = cuts_of(zp, across(models, u, side[n_p:]))
        above, n_u = unlabelled_above(keyed.withColumn("side", _side(F.col("doc_id"))), models, cuts)
        prior = estimate_prior(counts_above(zp, cuts), len(zp), above, n_u)
    return fit(p, u, prior, standard), prior


def score(docs: DataFrame, model: Linear, threshold: float = THRESHOLD) -> DataFrame:
    """All columns of ``docs`` but for clashing names, and held_out, score, predicted."""
    rest = [c for c in docs.columns if c not in {"held_out", "score", "predicted"}]
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema}

    def compute(batches):
        for batch in parts(batches):
            s = model.scores(features(as_bytes(batch.column("text"))))
            new = [pa.array(s), pa.array((s >= threshold).astype(np.int32))]
            yield pa.record_batch([*(batch.column(c) for c in rest), *new], names=[*rest, "score", "predicted"])

    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in rest), "score double, predicted int"])
    return map_arrow(docs.select(*rest), compute, schema).withColumn("held_out", id_remainder(F.col("doc_id")) == 0)


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model, _ = train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score(docs.select("doc_id", "text"), model).select("doc_id", "held_out", "score", "predicted")
