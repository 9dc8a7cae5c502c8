"""Feature ranking on long tables (y of +1 and -1, or a class): one weight a feature."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import correlation
from .metrics import auc
from .order import tied_rank


def variance(df: DataFrame) -> DataFrame:
    return df.groupBy("feat").agg(F.var_samp("value").alias("weight"))


def pearson(df: DataFrame, y: str) -> DataFrame:
    """|r| with the label over rows that have both."""
    own = df.filter(F.col("value").isNotNull() & F.col(y).isNotNull())
    return own.groupBy("feat").agg(F.coalesce(F.abs(correlation("value", y)), F.lit(0.0)).alias("weight"))


def spearman(df: DataFrame, y: str) -> DataFrame:
    """|r| of tied ranks."""
    own = df.filter(F.col("value").isNotNull() & F.col(y).isNotNull())
    r = tied_rank(tied_rank(own, ["feat"], "value", "_rx"), ["feat"], y, "_ry")
    return r.groupBy("feat").agg(F.coalesce(F.abs(correlation("_rx", "_ry")), F.lit(0.0)).alias("weight"))


def f_score(df: DataFrame, y: str) -> DataFrame:
    """(mean+ - mean-)^2 / (SD+ + SD-): the sum of standard deviations, as the reference divides."""
    plus, minus = F.when(F.col(y) > 0, F.col("value")), F.when(F.col(y) < 0, F.col("value"))
    gap, spread = F.avg(plus) - F.avg(minus), F.stddev_samp(plus) + F.stddev_samp(minus)
    return df.groupBy("feat").agg(F.when(spread > 0, gap * gap / spread).otherwise(F.lit(0.0)).alias("weight"))


def auc_rank(df: DataFrame, y: str) -> DataFrame:
    return auc(df, ["feat"], y, "value").select("feat", F.col("auc").alias("weight"))


def anova(df: DataFrame, cls: str) -> DataFrame:
    """F statistic and R^2 of the class means, from class sums alone."""
    g = df.filter(F.col("value").isNotNull()).groupBy("feat", cls).agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("feat")
    g = g.withColumn("all_m", F.sum(F.col("n") * F.col("m")).over(w) / F.sum("n").over(w))
    s = g.groupBy("feat").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("k"), F.sum(F.col("n") * F.pow(F.col("m") - F.col("all_m"), F.lit(2))).alias("between"), F.sum(F.col("n") * F.col("v")).alias("within"))
    ok = F.col("within") > 0
    return s.select("feat", F.when(ok, F.col("between") / (F.col("k") - 1) / (F.col("within") / (F.col("n") - F.col("k")))).alias("f"), F.when(ok, F.col("between") / (F.col("between") + F.col("within"))).alias("r2"))


def mutual_information(df: DataFrame, cls: str) -> DataFrame:
    """I(feature; class) in bits of an already discrete feature."""
    j = df.filter(F.col("value").isNotNull()).groupBy("feat", "value", cls).agg(F.count(F.lit(1)).cast("double").alias("n"))
    x, y, t = Window.partitionBy("feat", "value"), Window.partitionBy("feat", cls), Window.partitionBy("feat")
    n = F.col("n")
    term = n / F.sum(n).over(t) * F.log2(n * F.sum(n).over(t) / F.sum(n).over(x) / F.sum(n).over(y))
    return j.withColumn("_t", term).groupBy("feat").agg(F.sum("_t").alias("weight"))


def pair_information(df: DataFrame, case: str) -> DataFrame:
    """I(a; b) of all feature pairs of a small discrete feature set, by a join on the case (features squared rows a case)."""
    a = df.select(case, F.col("feat").alias("a"), F.col("value").alias("u"))
    b = df.select(F.col(case).alias("_c"), F.col("feat").alias("b"), F.col("value").alias("v"))
    j = a.join(b, (F.col(case) == F.col("_c")) & (F.col("a") < F.col("b"))).groupBy("a", "b", "u", "v").agg(F.count(F.lit(1)).cast("double").alias("n"))
    n, t = F.col("n"), Window.partitionBy("a", "b")
    term = n / F.sum(n).over(t) * F.log2(n * F.sum(n).over(t) / F.sum(n).over(Window.partitionBy("a", "b", "u")) / F.sum(n).over(Window.partitionBy("a", "b", "v")))
    return j.withColumn("_t", term).groupBy("a", "b").agg(F.sum("_t").alias("mi"))


def mrmr(relevance: dict[str, float], redundancy: dict[tuple[str, str], float], k: int) -> list[str]:
    """Greedy choice: relevance less the mean redundancy with those chosen (tables of one row a feature or pair)."""
    chosen: list[str] = []
    while len(chosen) < min(k, len(relevance)):
        def gain(f: str) -> float:
            return relevance[f] - (sum(redundancy.get((min(f, c), max(f, c)), 0.0) for c in chosen) / len(chosen) if chosen else 0.0)
        chosen.append(max(sorted(set(relevance) - set(chosen)), key=gain))
    return chosen


def scaled(weights: DataFrame) -> DataFrame:
    """Weights to [0, 1] over the features; zeros become the least positive double."""
    w = Window.partitionBy(F.lit(1))  # one row a feature
    lo, hi = F.min("weight").over(w), F.max("weight").over(w)
    made = F.when(hi > lo, (F.col("weight") - lo) / (hi - lo)).otherwise(F.lit(0.0))
    return weights.withColumn("weight", made).withColumn("weight", F.when(F.col("weight") == 0, F.lit(2.2250738585072014e-308)).otherwise(F.col("weight")))


def top(weights: DataFrame, k: int) -> DataFrame:
    return weights.orderBy(F.col("weight").desc(), "feat").limit(k)


def weigh(df: DataFrame, weights: DataFrame, exponent: float = 1.0) -> DataFrame:
    w = weights.select(F.col("feat").alias("_f"), F.col("weight").alias("_w"))
    return df.join(w, F.col("feat") == F.col("_f")).withColumn("value", F.col("value") * F.pow("_w", F.lit(exponent))).drop("_f", "_w")
