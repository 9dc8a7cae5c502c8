"""Performance measures of a score against a label of +1 and -1 (0: the case is left out).

All counts of a group come from one aggregation; every measure is arithmetic on that row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation
from .order import running, with_bucket


def confusion(df: DataFrame, part: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """tp, fp, tn, fn by the sign of the score, and n, n_pos (labelled cases and positives, score 0 included)."""
    a, s = F.col(y), F.col(score)
    hit = lambda c: F.count_if(c).cast("double")
    own = df.filter((a != 0) & a.isNotNull())
    return own.groupBy(*part).agg(hit((a > 0) & (s > 0)).alias("tp"), hit((a < 0) & (s > 0)).alias("fp"), hit((a < 0) & (s < 0)).alias("tn"), hit((a > 0) & (s < 0)).alias("fn"), F.count(F.lit(1)).cast("double").alias("n"), hit(a > 0).alias("n_pos"))


def _div(a: Column, b: Column, empty: float | None = 0.0) -> Column:
    return F.when(b != 0, a / b).otherwise(F.lit(empty).cast("double"))


def measures() -> dict[str, Column]:
    """All single measures as arithmetic on the row of `confusion`."""
    tp, fp, tn, fn = (F.col(c) for c in ("tp", "fp", "tn", "fn"))
    se, sp = _div(tp, tp + fn, None), _div(tn, tn + fp, None)
    ppv, npv = _div(tp, tp + fp), _div(tn, tn + fn)
    return {
        "accuracy": _div(tp + tn, F.col("n"), None) * 100,
        "sensitivity": se * 100,
        "specificity": sp * 100,
        "tpr": _div(tp, F.col("n_pos"), None) * 100,
        "fpr": (1 - sp) * 100,
        "ppv": ppv * 100,
        "npv": npv * 100,
        "bac": F.when(se.isNull(), sp * 100).when(sp.isNull(), se * 100).otherwise((se + sp) * 50),
        "bac2": F.when(se.isNull(), sp * 100).when(sp.isNull(), se * 100).otherwise(se * sp * 100),
        "gmean": F.sqrt(se * sp),
        "fscore": _div(2 * tp, 2 * tp + fp + fn) * 100,
        "mcc": _div(tp * tn - fp * fn, F.sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))),
        "psi": (ppv + npv) * 100 - 100,
        "nnp": F.abs(_div(F.lit(1.0), ppv + npv - 1)),
        "dor": _div(se * sp, (1 - se) * (1 - sp)),
        "plr": _div(se, 1 - sp),
        # as the reference computes it; the usual ratio is nlr_standard
        "nlr": _div(sp, 1 - se),
        "nlr_standard": _div(1 - se, sp),
        "kappa": _div(2 * (tp * tn - fn * fp), (tp + fp) * (fp + tn) + (tp + fn) * (fn + tn)),
        "allparam_gmean": F.sqrt(se + sp),
        "allparam_fscore": _div(2 * tp, 2 * tp + fp + fn),
        "allparam_nlr": _div(1 - se, sp),
        "allparam_dor": _div(_div(se, 1 - sp), _div(1 - se, sp)),
    }


def auc(df: DataFrame, part: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Area under the curve by the rank sum over distinct scores, ties counted half, scores as 32-bit floats."""
    own = df.filter((F.col(y) != 0) & F.col(score).isNotNull()).withColumn("_s", F.col(score).cast("float").cast("double"))
    steps = own.groupBy(*part, "_s").agg(F.count_if(F.col(y) > 0).alias("p"), F.count_if(F.col(y) < 0).alias("q"))
    r = running(steps, part, "_s", ["q", "p"])
    area = F.sum(F.col("p").cast("double") * (F.col("before_q") + F.col("q") / 2))
    return r.groupBy(*part).agg(F.max("all_p").alias("n_pos"), F.max("all_q").alias("n_neg"), area.alias("_a")).select(*part, "n_pos", "n_neg", _div(F.col("_a"), F.col("n_pos").cast("double") * F.col("n_neg"), None).alias("auc"))


def auc_interval(area: Column, n_pos: Column, n_neg: Column) -> tuple[Column, Column]:
    """95 % bounds from the standard error of an area with exponential score distributions."""
    q1, q2 = area / (2 - area), 2 * area * area / (1 + area)
    se = F.sqrt((area * (1 - area) + (n_pos - 1) * (q1 - area * area) + (n_neg - 1) * (q2 - area * area)) / (n_pos * n_neg))
    return area - 1.96 * se, area + 1.96 * se


def roc(df: DataFrame, part: list[str], y: str = "y", score: str = "score") -> DataFrame:
    """Points of the curve at each distinct score (predict positive at or above it)."""
    steps = df.filter(F.col(y) != 0).groupBy(*part, score).agg(F.count_if(F.col(y) > 0).alias("p"), F.count_if(F.col(y) < 0).alias("q"))
    r = running(steps, part, score, ["q", "p"])
    return r.select(*part, F.col(score).alias("threshold"), (1 - F.col("before_q") / F.col("all_q")).alias("fpr"), (1 - F.col("before_p") / F.col("all_p")).alias("tpr"))


def errors(df: DataFrame, part: list[str], y: str, p: str) -> DataFrame:
    """Regression measures: mse, maerr, rmsd, nrmsd (of the range, %), nrsmd (of the label's norm, %), cc, scc."""
    a, b = F.col(y), F.col(p)
    d = b - a
    r = F.coalesce(correlation(y, p), F.lit(0.0))
    return df.filter(a.isNotNull() & b.isNotNull()).groupBy(*part).agg(
        F.avg(d * d).alias("mse"), F.avg(F.abs(d)).alias("maerr"), F.sqrt(F.avg(d * d)).alias("rmsd"), (F.sqrt(F.avg(d * d)) / (F.max(a) - F.min(a)) * 100).alias("nrmsd"),
        (F.sqrt(F.sum(d * d) / F.sum(a * a)) * 100).alias("nrsmd"), r.alias("cc"), (r * r * 100).alias("scc"),
    )


def equal_bins(df: DataFrame, part: list[str], p: str, case: str, bins: int) -> DataFrame:
    """Adds bin (1 to bins): sorted by p, then case; the first n mod bins bins hold one more."""
    key = with_bucket(df, part, p)
    counts = key.groupBy(*part, "_b").agg(F.count(F.lit(1)).alias("_n"))
    w = Window.partitionBy(*part)
    starts = counts.select(*[F.col(x).alias(f"_{x}") for x in part], F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_start"), F.sum("_n").over(w).alias("_all"))
    own = key.withColumn("_in", F.row_number().over(Window.partitionBy(*part, "_b").orderBy(p, case)))
    own = own.join(starts, [F.col("_b") == F.col("_c")] + [F.col(x).eqNullSafe(F.col(f"_{x}")) for x in part])
    i = F.col("_start") + F.col("_in") - 1
    size, more = F.floor(F.col("_all") / bins), F.col("_all") % bins
    edge = more * (size + 1)
    made = F.when(i < edge, F.floor(i / (size + 1))).otherwise(more + F.floor((i - edge) / F.greatest(size, F.lit(1)))) + 1
    return own.select(*df.columns, made.cast("int").alias("bin"))


def calibration(df: DataFrame, part: list[str], y01: str, p: str, case: str, bins: int = 10) -> DataFrame:
    """ece, mce (equal-count bins) and brier."""
    b = equal_bins(df, part, p, case, bins).groupBy(*part, "bin").agg(F.count(F.lit(1)).alias("n"), F.abs(F.avg(y01) - F.avg(p)).alias("gap"))
    e = b.groupBy(*part).agg((F.sum(F.col("n") * F.col("gap")) / F.sum("n")).alias("ece"), F.max("gap").alias("mce"))
    brier = df.groupBy(*part).agg(F.avg((F.col(p) - F.col(y01)) * (F.col(p) - F.col(y01))).alias("brier"))
    return e.join(brier, part)


def net_benefit(df: DataFrame, part: list[str], y01: str, p: str, thresholds: list[float]) -> DataFrame:
    """Net benefit of treating at p >= threshold, and of treating all."""
    t = F.col("threshold")
    own = df.withColumn("threshold", F.explode(F.array(*[F.lit(float(x)) for x in thresholds])))
    g = own.groupBy(*part, "threshold").agg(F.count_if((F.col(p) >= t) & (F.col(y01) == 1)).alias("tp"), F.count_if((F.col(p) >= t) & (F.col(y01) == 0)).alias("fp"), F.count(F.lit(1)).alias("n"), F.count_if(F.col(y01) == 1).alias("pos"))
    odds = t / (1 - t)
    return g.select(*part, "threshold", (F.col("tp") / F.col("n") - F.col("fp") / F.col("n") * odds).alias("net_benefit"), (F.col("pos") / F.col("n") - (1 - F.col("pos") / F.col("n")) * odds).alias("treat_all"))


def confusion_matrix(df: DataFrame, expected: str, predicted: str) -> DataFrame:
    return df.groupBy(expected, predicted).agg(F.count(F.lit(1)).alias("n"))


def one_vs_rest(matrix: DataFrame, expected: str, predicted: str) -> DataFrame:
    """tp, fp, fn, tn, bac of each class, from the confusion matrix alone."""
    rows = matrix.groupBy(F.col(expected).alias("cls")).agg(F.sum("n").alias("of"), F.sum(F.when(F.col(expected) == F.col(predicted), F.col("n")).otherwise(0)).alias("tp"))
    cols = matrix.groupBy(F.col(predicted).alias("cls")).agg(F.sum("n").alias("said"))
    total = matrix.agg(F.sum("n").alias("total"))
    j = rows.join(cols, "cls", "full").na.fill(0).crossJoin(F.broadcast(total))  # one row
    j = j.withColumn("fn", F.col("of") - F.col("tp")).withColumn("fp", F.col("said") - F.col("tp")).withColumn("tn", F.col("total") - F.col("of") - F.col("said") + F.col("tp"))
    return j.select("cls", "tp", "fp", "fn", "tn", ((_div(F.col("tp"), F.col("of")) + _div(F.col("tn"), F.col("tn") + F.col("fp"))) * 50).alias("bac"))
