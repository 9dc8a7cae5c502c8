"""Calibration of scores: thresholds moved by the training curve, and Bayesian binning into quantiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .metrics import equal_bins
from .order import running


def best_threshold(train: DataFrame, y01: str, score: str) -> float:
    """The score from which on calling positive gives the greatest sensitivity + specificity (the lowest one on ties)."""
    c = train.filter(F.col(score).isNotNull()).groupBy(score).agg(F.sum(y01).cast("long").alias("pos"), F.sum(1 - F.col(y01)).cast("long").alias("neg")).withColumn("_all", F.lit(1))
    r = running(c, ["_all"], score, ["pos", "neg"])
    gain = (F.col("all_pos") - F.col("before_pos")) / F.col("all_pos") + F.col("before_neg") / F.col("all_neg")
    row = r.select(score, F.round(gain, 12).alias("gain")).orderBy(F.desc("gain"), score).first()
    return float(row[0]) if row else 0.0


def shifted(df: DataFrame, score: str, threshold: float) -> DataFrame:
    """The score less the threshold, so that its sign decides."""
    return df.withColumn(score, F.col(score) - F.lit(threshold))


def fit_quantile_bins(train: DataFrame, y01: str, p: str, case: str, most: int | None = None, prior: float = 2.0) -> list[tuple[float, list[float], list[float]]]:
    """Binning models of 1 to `most` equal-count bins: (weight, upper bounds, probability of each bin).

    Each bin has a beta prior at its middle with strength prior / bins; a model's weight is its marginal
    likelihood. Bins are counted by Spark; a model is a few rows.
    """
    own = train.filter(F.col(p).isNotNull() & F.col(y01).isNotNull())
    n = own.count()
    most = most or max(1, int(min(50, 2 * n ** (1 / 3))))
    models, logs = [], []
    for b in range(1, most + 1):
        own_bins = equal_bins(own.withColumn("whole", F.lit(1)), ["whole"], p, case, b)
        rows = own_bins.groupBy("bin").agg(F.min(p).alias("lo"), F.max(p).alias("hi"), F.sum(y01).alias("pos"), F.count(F.lit(1)).alias("n")).orderBy("bin").collect()  # b rows
        edges = [(x["hi"] + z["lo"]) / 2 for x, z in zip(rows, rows[1:], strict=False)]
        ends = [0.0, *edges, 1.0]
        log, probs = 0.0, []
        for k, r in enumerate(rows):
            middle = min(max((ends[k] + ends[k + 1]) / 2, 1e-3), 1 - 1e-3)
            a0, b0 = prior / b * middle, prior / b * (1 - middle)
            m, t = float(r["pos"]), float(r["n"])
            log += math.lgamma(a0 + b0) - math.lgamma(t + a0 + b0) + math.lgamma(m + a0) - math.lgamma(a0) + math.lgamma(t - m + b0) - math.lgamma(b0)
            probs.append((m + a0) / (t + a0 + b0))
        models.append((edges, probs))
        logs.append(log)
    top = max(logs)
    weights = [math.exp(x - top) for x in logs]
    return [(w / sum(weights), e, q) for w, (e, q) in zip(weights, models, strict=True)]


def binned_probability(p: Column, models: list[tuple[float, list[float], list[float]]]) -> Column:
    """The models' probabilities of a score, averaged by weight."""
    out = F.lit(0.0)
    for w, edges, probs in models:
        if w < 1e-9:
            continue
        value = F.lit(probs[0])
        for e, q in zip(edges, probs[1:], strict=True):
            value = F.when(p > F.lit(e), F.lit(q)).otherwise(value)
        out = out + w * value
    return out / sum(w for w, _, _ in models if w >= 1e-9)


def fit_sigmoid(train: DataFrame, y01: str, score: str, rounds: int = 50) -> tuple[float, float]:
    """a, b of the probability 1 / (1 + exp(a score + b)), fitted to smoothed targets by Newton's steps, one pass each.

    Targets are (n+ + 1) / (n+ + 2) for positives and 1 / (n- + 2) for negatives.
    """
    own = train.filter(F.col(score).isNotNull() & F.col(y01).isNotNull()).select(F.col(score).cast("double").alias("s"), F.col(y01).alias("y"))
    pos, n = own.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count(F.lit(1))).first()
    high, low = (pos + 1) / (pos + 2), 1 / (n - pos + 2)
    own = own.withColumn("t", F.when(F.col("y") == 1, F.lit(float(high))).otherwise(F.lit(float(low))))
    a, b = 0.0, math.log((n - pos + 1) / (pos + 1))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(F.lit(a) * F.col("s") + F.lit(b)))
        w, d = p * (1 - p), F.col("t") - p
        r = own.agg(F.sum(d * F.col("s")).alias("ga"), F.sum(d).alias("gb"), F.sum(w * F.col("s") * F.col("s")).alias("aa"), F.sum(w * F.col("s")).alias("ab"), F.sum(w).alias("bb")).first()
        if r["bb"] is None:
            break
        aa, bb = r["aa"] + 1e-12, r["bb"] + 1e-12
        det = aa * bb - r["ab"] * r["ab"]
        da, db = (bb * r["ga"] - r["ab"] * r["gb"]) / det, (aa * r["gb"] - r["ab"] * r["ga"]) / det
        a, b = a - da, b - db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def sigmoid(score: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(F.lit(a) * score + F.lit(b)))
