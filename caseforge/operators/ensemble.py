"""Combining the scores of many learners: (case, learner, score), label y of +1 and -1."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, case: str) -> DataFrame:
    """n, mean, median, sd, the share of positive votes, and low and high (2.5 and 97.5 percent, Hazen) of each case's scores."""
    sorted_ = F.sort_array(F.filter(F.collect_list("score"), lambda x: x.isNotNull()))  # a score a learner
    g = df.groupBy(case).agg(F.count("score").alias("n"), F.avg("score").alias("mean"), F.percentile("score", 0.5).alias("median"), F.stddev_samp("score").alias("sd"), F.avg((F.col("score") > 0).cast("double")).alias("p_positive"), sorted_.alias("_s"))

    def tail(percent: float):
        at = F.greatest(F.lit(1.0), F.least(F.col("n").cast("double"), F.col("n") * (percent / 100) + 0.5))
        low, high = F.get("_s", (F.floor(at) - 1).cast("int")), F.get("_s", (F.ceil(at) - 1).cast("int"))
        return low + (high - low) * (at - F.floor(at))

    return g.withColumn("low", tail(2.5)).withColumn("high", tail(97.5)).drop("_s")


def decision(df: DataFrame, case: str) -> DataFrame:
    """Sign of the mean score; a mean of exactly 0 counts as +1 (a fixed rule, where a coin would do)."""
    return df.groupBy(case).agg(F.avg("score").alias("mean")).select(case, F.when(F.col("mean") >= 0, 1).otherwise(-1).alias("decision"))


def majority(df: DataFrame, case: str, label: str) -> DataFrame:
    """The label with most votes and its share; ties go to the lowest label."""
    c = df.groupBy(case, label).agg(F.count(F.lit(1)).alias("votes"))
    best = c.groupBy(case).agg(F.max(F.struct("votes", (-F.col(label)).alias("l"))).alias("b"), F.sum("votes").alias("all"))
    return best.select(case, (-F.col("b.l")).alias("label"), (F.col("b.votes") / F.col("all")).alias("share"))


def max_wins(df: DataFrame, case: str) -> DataFrame:
    """One-vs-one decoding: (case, a, b, score): |score| goes to the winner's class; sums, arg max, the first class on ties."""
    side = F.when(F.col("score") > 0, F.col("a")).when(F.col("score") < 0, F.col("b"))
    t = df.withColumn("cls", side).filter("cls is not null").groupBy(case, "cls").agg(F.sum(F.abs("score")).alias("total"))
    w = Window.partitionBy(case).orderBy(F.col("total").desc(), "cls")
    return t.withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(case, "cls", "total")


def codes(df: DataFrame, case: str, code: list[tuple[str, list[int]]], loss: str = "hamming") -> DataFrame:
    """Error-correcting decoding: scores by learner 1..m against each class's code word of +1, 0, -1; least distance, first class on ties."""
    table = F.array(*[F.struct(F.lit(c).alias("cls"), F.array(*[F.lit(x) for x in word]).alias("word")) for c, word in code])
    spread = df.select("*", F.explode(table).alias("_c")).withColumn("_w", F.element_at("_c.word", F.col("learner").cast("int")))
    x, w = F.col("score"), F.col("_w")
    part = {"hamming": F.abs(F.signum(x) - w) / 2, "euclidean": (x - w) * (x - w), "linear": -x * w}[loss]
    d = spread.groupBy(case, F.col("_c.cls").alias("cls")).agg((F.sqrt(F.sum(part)) if loss == "euclidean" else F.sum(part)).alias("distance"))
    r = F.row_number().over(Window.partitionBy(case).orderBy(F.round("distance", 9), "cls"))
    return d.withColumn("_r", r).filter("_r = 1").select(case, "cls", "distance")


def diversity(df: DataFrame, case: str) -> DataFrame:
    """Share of cases of which 25 to 75 % of the learners are right; mean vote entropy; kappa over learners."""
    right = (F.col("score") * F.col("y") > 0).cast("double")
    c = df.groupBy(case).agg(F.avg(right).alias("r"), F.avg((F.col("score") > 0).cast("double")).alias("v"), F.count(F.lit(1)).alias("m"))
    bits = lambda p: F.when((p > 0) & (p < 1), -(p * F.log2(p) + (1 - p) * F.log2(1 - p))).otherwise(F.lit(0.0))
    mean = F.avg("r")
    kappa = 1 - F.avg(F.col("r") * (1 - F.col("r")) * F.col("m") / (F.col("m") - 1)) / (mean * (1 - mean))
    return c.agg(F.avg(F.col("r").between(0.25, 0.75).cast("double")).alias("diversity"), F.avg(bits(F.col("v"))).alias("entropy"), kappa.alias("kappa"))


def ambiguity(df: DataFrame, case: str) -> DataFrame:
    """Mean squared distance of the learners from the case's median."""
    m = df.groupBy(case).agg(F.percentile("score", 0.5).alias("_m")).withColumnRenamed(case, "_c")
    j = df.join(m, F.col(case) == F.col("_c"))
    return j.agg(F.avg((F.col("score") - F.col("_m")) * (F.col("score") - F.col("_m"))).alias("ambiguity"))


def bias_variance(df: DataFrame, case: str) -> DataFrame:
    """Zero-one loss: bias of the main vote; variance adds where it is right and is taken off where it is wrong."""
    v = (F.col("score") > 0).cast("double")
    c = df.groupBy(case, "y").agg(F.avg(v).alias("p"))
    main = F.when(F.col("p") >= 0.5, 1).otherwise(-1)
    bias = (main != F.col("y")).cast("double")
    var = F.when(F.col("p") >= 0.5, 1 - F.col("p")).otherwise(F.col("p"))
    return c.agg(F.avg(bias).alias("bias"), F.avg(F.when(bias == 0, var).otherwise(0.0)).alias("var_unbiased"), F.avg(F.when(bias == 1, var).otherwise(0.0)).alias("var_biased"))


def sign_consistency(df: DataFrame, part: str, value: str) -> DataFrame:
    """|share positive - share negative| among present weights, times the share present."""
    v = F.col(value)
    have = F.count(value)
    return df.groupBy(part).agg((F.abs(F.count_if(v > 0) - F.count_if(v < 0)) / have * (have / F.count(F.lit(1)))).alias("consistency"))


def agreed_features(df: DataFrame, feature: str, subsets: int, share: float) -> DataFrame:
    """Features in at least a share of the subspaces."""
    return df.groupBy(feature).agg((F.count(F.lit(1)) / subsets).alias("agreement")).filter(F.col("agreement") >= share)
