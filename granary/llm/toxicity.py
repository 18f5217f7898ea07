"""Toxicity by maximum-scoring segments over token log-odds.

Fit: from a bounded sample of labelled rows, count in how many toxic and clean texts each token stands, and take the
log-odds ratio under an informative Dirichlet prior (the prior's mass is spread by the token's overall frequency).
A token scores its log-odds moved towards zero by its standard error, less a drift that makes ordinary text lose.
Apply: one linear scan per text yields every maximal scoring segment (Ruzzo and Tompa); segment scores are turned into
extreme-value bit scores with lambda and K from clean texts, and a text's score is a logistic function of its best
bit score and of the sum over its significant passages.

Cases: null text counts as empty text; empty text has no segment and gets the score of none. Rows with a null key are
scored but never learned from. Repeated rows are each scored; a key labelled twice counts as toxic if any label says so.
Without labels of both kinds the model has no tokens and all scores are below one half. Columns other than key, text
and label are not read, so clashing names don't matter; with_toxicity() replaces columns that have its output's names,
in any letter case.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Carried, Scratch, bounded_sample, by_chars, keyed, strings, trim, words

#: Labelled rows to learn from at most: those with the smallest hash of their key. All their significant tokens count.
MAX_LABELLED = 40_000
#: The Dirichlet prior's mass as a share of all counts, the least texts and z-score of a token, and the loss per token.
PRIOR_SHARE, MIN_TEXTS, MIN_Z, DRIFT = 0.05, 3, 4.0, 0.5
#: A passage is significant if so high a score is expected in fewer texts of its length than this.
SIGNIFICANT = 0.01

OUT = T.StructType(
    [
        T.StructField("score", T.DoubleType()),
        T.StructField("predicted", T.IntegerType()),
        T.StructField(
            "passages",
            T.ArrayType(T.StructType([T.StructField("first_word", T.IntegerType()), T.StructField("n_words", T.IntegerType()), T.StructField("bits", T.DoubleType())])),
        ),
    ]
)


@dataclass
class ToxicityModel:
    weights: dict = field(default_factory=dict)
    lam: float = 1.0
    log_k: float = 0.0
    coef: tuple = (-3.0, 0.0, 0.0)


def segments(s: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last + 1, score) of scores s, in linear time."""
    pos = np.flatnonzero(s > 0)
    if not len(pos):
        return []
    cum = np.concatenate(([0.0], np.cumsum(s)))
    cuts = np.flatnonzero(np.diff(pos) > 1) + 1  # runs of positive tokens are never split
    starts, ends = pos[np.concatenate(([0], cuts))], pos[np.concatenate((cuts - 1, [len(pos) - 1]))] + 1
    stack: list[list] = []  # first, end, sum before, sum at the end
    for a, b in zip(starts.tolist(), ends.tolist()):
        left, right = cum[a], cum[b]
        j = len(stack) - 1
        while True:
            while j >= 0 and stack[j][2] >= left:
                j -= 1
            if j < 0 or stack[j][3] >= right:
                break
            a, left = stack[j][0], stack[j][2]
            del stack[j:]
            j -= 1
        stack.append([a, b, left, right])
    return [(a, b, r - x) for a, b, x, r in stack]


def batch_scores(texts, weights: dict):
    """Each text's number of tokens and its maximal segments."""
    codes, offs, vocab = words(texts)
    w = np.fromiter((weights.get(t, 0.0) for t in strings(vocab)), np.float64, len(vocab)) - DRIFT
    s = w[codes] if len(codes) else np.zeros(0)
    hot = np.concatenate(([0], np.cumsum(s > 0)))
    for a, b in zip(offs[:-1].tolist(), offs[1:].tolist()):
        yield b - a, segments(s[a:b]) if hot[b] > hot[a] else []


def features(n: int, segs: list, lam: float, log_k: float) -> tuple[float, float, list]:
    """Logarithms of the best and of the summed bit scores, and the significant passages."""
    floor = log_k + math.log(max(n, 1))
    found = [(a, b, lam * x - floor) for a, b, x in segs]
    kept = [x for x in found if x[2] > -math.log(SIGNIFICANT)]
    best = max((x for *_, x in found), default=0.0)
    return math.log1p(max(best, 0.0)), math.log1p(sum(x for *_, x in kept)), kept


def _lambda(p: np.ndarray, s: np.ndarray) -> float:
    """The positive root of sum(p * exp(lambda * s)) = 1; 1 if no score is positive or the mean isn't negative."""
    if not (s[p > 0] > 0).any() or (p * s).sum() >= 0:
        return 1.0
    lo, hi = 0.0, 1.0
    while (p * np.exp(hi * s)).sum() < 1 and hi < 64:
        hi *= 2
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(mid * s)).sum() < 1 else (lo, mid)
    return max(lo, 1e-3)


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple:
    """Ridge logistic regression by Newton steps, halved while they don't improve it."""
    x = np.column_stack([np.ones(len(x)), x])
    w, ridge = np.zeros(x.shape[1]), np.diag([1e-3, 0.5, 0.5])

    def loss(w):
        z = x @ w
        return np.logaddexp(0, z).sum() - (y * z).sum() + 0.5 * w @ ridge @ w

    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge, x.T @ (p - y) + ridge @ w)
        t = 1.0
        while t > 1e-6 and loss(w - t * step) > loss(w):
            t /= 2
        w = w - t * step
    return tuple(w.tolist())


def fit(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", max_labelled: int = MAX_LABELLED) -> ToxicityModel:
    """Learn from the labelled rows, at most max_labelled of them: what reaches the driver is bounded by that."""
    scratch, lb = Scratch(docs.sparkSession), Carried(labels)
    k, y = F.col(lb.at(key)).cast("long"), F.col(lb.at(label)).cast("int")
    lab = lb.df.where(k.isNotNull() & y.isNotNull()).groupBy(k.alias("doc_id")).agg(F.max(y).alias("y"))
    lab = bounded_sample(lab, F.xxhash64("doc_id"), max_labelled)  # so few rows that they may be broadcast
    sample = keyed(docs, key, text).join(F.broadcast(lab), "doc_id")
    sample = sample.withColumn("h", F.md5("t")).dropDuplicates(["h", "y"])  # copies of a text teach as one
    sample = scratch.save(sample.select("t", "y"))

    def count(batches):
        for b in by_chars(batches, "t"):
            codes, offs, vocab = words(b.column("t"))
            y = np.array(b.column("y").to_pylist(), dtype=np.int64)
            doc = np.repeat(np.arange(len(y)), np.diff(offs))
            pair = np.unique(doc * max(len(vocab), 1) + codes)
            tok, cls = pair % max(len(vocab), 1), y[pair // max(len(vocab), 1)]
            bad, good = (np.bincount(tok[cls == v], minlength=len(vocab)) for v in (1, 0))
            out = pa.table({"token": vocab.cast(pa.string()), "bad": pa.array(bad), "good": pa.array(good)}) if len(vocab) else None
            if out is not None:
                yield from out.to_batches()

    counts = sample.mapInArrow(count, "token string, bad long, good long").groupBy("token").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    counts = scratch.save(counts.where(F.col("bad") + F.col("good") >= MIN_TEXTS))
    tot = counts.agg(F.sum("bad"), F.sum("good")).first()
    if not tot[0] or not tot[1]:
        scratch.drop()
        return ToxicityModel()
    nb, ng = float(tot[0]), float(tot[1])
    a, mass = (F.col("bad") + F.col("good")) * PRIOR_SHARE, PRIOR_SHARE * (nb + ng)
    odds = lambda y, n: F.log((y + a) / (n + mass - y - a))
    delta, sd = odds(F.col("bad"), nb) - odds(F.col("good"), ng), F.sqrt(1 / (F.col("bad") + a + 0.5) + 1 / (F.col("good") + a + 0.5))
    rows = counts.select("token", delta.alias("d"), sd.alias("sd"), "good").where(F.abs(F.col("d") / F.col("sd")) >= MIN_Z).collect()  # of a bounded sample
    rows.sort(key=lambda r: (-abs(r.d / r.sd), r.token))
    model = ToxicityModel({r["token"]: math.copysign(max(abs(r["d"]) - r["sd"], 0.0), r["d"]) for r in rows})
    s = np.array([model.weights[r["token"]] for r in rows] + [0.0]) - DRIFT
    good = np.array([r["good"] for r in rows], dtype=float)
    p = np.concatenate((good + 1e-3, [max(ng - good.sum(), 1.0)])) / (max(ng, good.sum() + 1.0) + 1e-3 * len(rows))
    model.lam = _lambda(p, s)

    weights, lam = model.weights, model.lam

    def maxima(batches):
        """y, number of tokens and best segment of each text."""
        for b in by_chars(batches, "t"):
            got = [(n, max((x for *_, x in g), default=0.0)) for n, g in batch_scores(b.column("t"), weights)]
            n, best = (list(x) for x in zip(*got)) if got else ([], [])
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), pa.array(n, pa.int32()), pa.array(best, pa.float64())], names=["y", "n", "best"])

    clean = [r for r in sample.mapInArrow(maxima, "y int, n int, best double").where("y = 0 and n > 0").collect()]  # max_labelled rows at most
    # Extreme values: over clean texts, lambda * best - ln(n) has mean ln K + 0.5772.
    log_k = model.log_k = max(math.fsum(lam * r.best - math.log(r.n) for r in clean) / len(clean) - 0.5772, -8.0) if clean else 0.0

    def describe(batches):
        for b in by_chars(batches, "t"):
            got = [features(n, g, lam, log_k)[:2] for n, g in batch_scores(b.column("t"), weights)]
            x, z = (list(v) for v in zip(*got)) if got else ([], [])
            yield pa.RecordBatch.from_arrays([b.column("y").cast(pa.int32()), pa.array(x, pa.float64()), pa.array(z, pa.float64())], names=["y", "x", "z"])

    got = sorted(map(tuple, sample.mapInArrow(describe, "y int, x double, z double").collect()))  # max_labelled rows at most
    scratch.drop()
    model.coef = _logistic(np.array([g[1:] for g in got]).reshape(-1, 2), np.array([g[0] for g in got], dtype=float))
    return model


def with_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """df with score (0 to 1), predicted (score >= 0.5) and passages (word positions and bit scores)."""
    c = Carried(df, *OUT.names)
    rows, text = c.with_text(text)
    weights, lam, log_k, (c0, c1, c2) = model.weights, model.lam, model.log_k, model.coef
    passage = pa.list_(pa.struct([("first_word", pa.int32()), ("n_words", pa.int32()), ("bits", pa.float64())]))

    def score(batches):
        for b in by_chars(batches, text):
            scores, passages = [], []
            for n, segs in batch_scores(b.column(text).cast(pa.string()), weights):
                best, total, kept = features(n, segs, lam, log_k)
                scores.append(1 / (1 + math.exp(-max(-500.0, min(500.0, c0 + c1 * best + c2 * total)))))
                passages.append([{"first_word": a, "n_words": e - a, "bits": x} for a, e, x in kept])
            s = pa.array(scores, pa.float64())
            cols = [*b.columns, s, pa.array([int(x >= 0.5) for x in scores], pa.int32()), pa.array(passages, passage)]
            yield pa.RecordBatch.from_arrays(cols, names=[*b.schema.names, *OUT.names])
            del cols, scores, passages, s
            trim()

    return c.back(rows.mapInArrow(score, T.StructType([*rows.schema.fields, *OUT.fields])), *OUT.names)
