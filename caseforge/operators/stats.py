"""Aggregates over long tables (part columns, value); missing values are null and left out."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import counted


def moments(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """n, mean, std (n - 1) and the n - 1 forms of skewness and excess kurtosis.

    The third and fourth moments are divided by n - 1, as the variance is. Two passes: a one-pass
    formula of power sums would lose the digits.
    """
    first = df.groupBy(*part).agg(F.count(value).alias("n"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("sd"))
    keys = first.select(*[F.col(p).alias(f"_{p}") for p in part], F.col("mean").alias("_m"))
    on = [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in part]
    d = df.join(keys, on)
    c = F.col(value) - F.col("_m")
    cubes = d.groupBy(*part).agg(F.sum(c * c * c).alias("s3"), F.sum(c * c * c * c).alias("s4"))
    j = first.join(cubes, part)
    k = F.col("n") - 1
    return j.select(*part, "n", "mean", "sd", (F.col("s3") / k / F.pow("sd", F.lit(3))).alias("skewness"), (F.col("s4") / k / F.pow("sd", F.lit(4)) - 3).alias("kurtosis"))


def weighted_mean(df: DataFrame, part: list[str], value: str, weight: str) -> DataFrame:
    """sum(w x) / sum(w) over rows with both; weights below zero and all-zero weights fail as null."""
    ok = F.col(value).isNotNull() & F.col(weight).isNotNull()
    w, x = F.when(ok, F.col(weight)), F.when(ok, F.col(value))
    total = F.sum(w)
    return df.groupBy(*part).agg(F.when((F.min(w) >= 0) & (total > 0), F.sum(w * x) / total).alias("wmean"))


def value_counts(df: DataFrame, part: list[str], value: str, flag_percent: float) -> DataFrame:
    """Per part: distinct values, the largest share of one value in percent, and whether it reaches the flag."""
    c = df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("n"))
    out = c.groupBy(*part).agg(F.count(F.lit(1)).alias("n_values"), (F.max("n") * 100 / F.sum("n")).alias("top_percent"))
    return out.withColumn("flagged", F.col("top_percent") >= flag_percent)


def missing_report(df: DataFrame, part: list[str], value: str) -> DataFrame:
    return df.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(value).isNull()).alias("n_missing"), (F.count_if(F.col(value).isNull()) * 100 / F.count(F.lit(1))).alias("percent_missing"))


def entropy(df: DataFrame, columns: list[str]) -> DataFrame:
    """Shannon entropy in bits of the joint variable."""
    c = df.groupBy(*columns).agg(F.count(F.lit(1)).cast("double").alias("n"))
    return c.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("h"))


def information(df: DataFrame, x: str, y: str, z: str | None = None) -> DataFrame:
    """h_x, h_y, h_xy, h_x_given_y and mi (with z: cmi, the information given z), from one joint count."""
    joint = df.groupBy(x, y, *([z] if z else [])).agg(F.count(F.lit(1)).cast("double").alias("n"))

    def h(names: list[str]) -> DataFrame:
        c = joint.groupBy(*names).agg(F.sum("n").alias("n"))
        return c.agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias("_".join(["h", *names])))

    sets = [[x], [y], [x, y]] + ([[z], [x, z], [y, z], [x, y, z]] if z else [])
    out = None
    for s in sets:
        out = h(s) if out is None else out.crossJoin(h(s))  # one row each
    made = [F.col(f"h_{x}").alias("h_x"), F.col(f"h_{y}").alias("h_y"), F.col(f"h_{x}_{y}").alias("h_xy"), (F.col(f"h_{x}_{y}") - F.col(f"h_{y}")).alias("h_x_given_y"), (F.col(f"h_{x}") + F.col(f"h_{y}") - F.col(f"h_{x}_{y}")).alias("mi")]
    if z:
        made.append((F.col(f"h_{x}_{z}") + F.col(f"h_{y}_{z}") - F.col(f"h_{x}_{y}_{z}") - F.col(f"h_{z}")).alias("cmi"))
    return out.select(*made)


def cross_validation_ratio(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """mean / (1.96 SD / sqrt(n)) with the population SD."""
    return df.groupBy(*part).agg((F.avg(value) / (1.96 * F.stddev_pop(value) / F.sqrt(F.count(value)))).alias("cvr"))


def inverse_percentile(train: DataFrame, test: DataFrame, part: list[str], value: str) -> DataFrame:
    """Each test value's Hazen non-exceedance share among the training values: below, plus half of the equal ones."""
    c = counted(train, part, value)
    step = c.select(*part, F.col(value).alias("_v"), "before_n", "n", "all_n")
    marked = test.select(*part, F.col(value).alias("_v"), F.lit(None).cast("long").alias("before_n"), F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("all_n")).distinct()
    both = step.unionByName(marked).groupBy(*part, "_v").agg(F.sum("n").alias("n"))
    from .order import running

    total = running(both, part, "_v", ["n"])
    found = total.select(*[F.col(p).alias(f"_{p}") for p in part], "_v", ((F.col("before_n") + 0.5 * F.col("n")) * 100 / F.col("all_n")).alias("percent"))
    on = [F.col(value) == F.col("_v")] + [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in part]
    return test.join(found, on, "left").drop("_v", *[f"_{p}" for p in part])
