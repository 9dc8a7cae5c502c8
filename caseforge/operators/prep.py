"""Fit and apply: every step learns a parameter table (part columns, feat, ...) from training rows and applies it to any rows.

Tables are long: part columns (a fold, or none), case columns, feat, value. A step never sees rows
outside the table that it is fitted on; parameters join back by part and feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import hazen, medians

#: Places that z scores are rounded to, and the spread that stands for none.
Z_PLACES = 9
NO_SPREAD = 1e-5
DUMMY_LIMIT = 20


def applied(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with their parameters; unknown features keep their rows, with null parameters."""
    p = params.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in params.columns if c not in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return df.join(p, on, "left").drop(*[f"_{k}" for k in keys])


def fit_scale(train: DataFrame, keys: list[str]) -> DataFrame:
    return train.groupBy(*keys).agg(F.min("value").alias("lo"), F.max("value").alias("hi"))


def scale(df: DataFrame, params: DataFrame, keys: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """To [low, high] by the training range; a constant feature becomes 0."""
    share = (F.col("value") - F.col("lo")) / (F.col("hi") - F.col("lo"))
    made = F.when(F.col("value").isNull(), None).when(F.col("hi") > F.col("lo"), low + (high - low) * share).otherwise(F.lit(0.0))
    return applied(df, params, keys).withColumn("value", made).drop("lo", "hi")


def unscale(df: DataFrame, params: DataFrame, keys: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    made = F.when(F.col("hi") > F.col("lo"), F.col("lo") + (F.col("value") - low) / (high - low) * (F.col("hi") - F.col("lo"))).otherwise(F.col("lo"))
    return applied(df, params, keys).withColumn("value", made).drop("lo", "hi")


def fit_standard(train: DataFrame, keys: list[str], median: bool = False) -> DataFrame:
    spread = train.groupBy(*keys).agg(F.stddev_samp("value").alias("sd"), F.avg("value").alias("centre"))
    spread = spread.withColumn("sd", F.when(F.col("sd") > 2.3e-308, F.col("sd")).otherwise(F.lit(NO_SPREAD)))
    return spread.drop("centre").join(medians(train, keys, "value", "centre"), keys) if median else spread


def standardise(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    z = F.round((F.col("value") - F.col("centre")) / F.col("sd"), Z_PLACES)
    return applied(df, params, keys).withColumn("value", z).drop("centre", "sd")


def _clipped(z: DataFrame, at: float) -> DataFrame:
    return z.withColumn("value", F.greatest(F.lit(-at), F.least(F.lit(at), F.col("value"))) + F.col("value") * 0)  # a missing value stays missing


def fit_winsorise(train: DataFrame, keys: list[str], at: float, median: bool = False) -> DataFrame:
    """centre, sd, and shift: the mean (or median) of the training rows' clipped z scores."""
    p = fit_standard(train, keys, median)
    z = _clipped(standardise(train, p, keys), at)
    shift = medians(z, keys, "value", "shift") if median else z.groupBy(*keys).agg(F.avg("value").alias("shift"))
    return p.join(shift.select(*[F.col(k).alias(f"_s_{k}") for k in keys], "shift"), [F.col(k).eqNullSafe(F.col(f"_s_{k}")) for k in keys], "left").drop(*[f"_s_{k}" for k in keys])


def winsorise(df: DataFrame, params: DataFrame, keys: list[str], at: float) -> DataFrame:
    """z scores clipped to +-at, less the training rows' shift, to 9 places."""
    z = _clipped(standardise(df, params.drop("shift"), keys), at)
    return applied(z, params.select(*keys, "shift"), keys).withColumn("value", F.round(F.col("value") - F.col("shift"), Z_PLACES)).drop("shift")


def fit_standard_iqr(train: DataFrame, keys: list[str]) -> DataFrame:
    """centre: the median; sd: the interquartile range at Hazen's positions."""
    q = hazen(train, keys, "value", [25, 50, 75])
    spread = F.col("p75") - F.col("p25")
    return q.select(*keys, F.when(spread > 2.3e-308, spread).otherwise(F.lit(NO_SPREAD)).alias("sd"), F.col("p50").alias("centre"))


def fit_mean(train: DataFrame, keys: list[str]) -> DataFrame:
    return train.groupBy(*keys).agg(F.avg("value").alias("centre"))


def centred(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    return applied(df, params, keys).withColumn("value", F.col("value") - F.col("centre")).drop("centre")


def group_normalise(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    """x 100 / (group mean + 1) - 100; keys hold the group column."""
    return applied(df, params, keys).withColumn("value", F.col("value") * 100 / (F.col("centre") + 1) - 100).drop("centre")


def fit_unit_norm(train: DataFrame, keys: list[str]) -> DataFrame:
    m = fit_mean(train, keys)
    n = applied(train, m, keys).groupBy(*keys).agg(F.sum(F.abs(F.col("value") - F.col("centre"))).alias("norm"))
    return m.join(n, keys)


def unit_normalise(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    made = F.when(F.col("norm") > 0, (F.col("value") - F.col("centre")) / F.col("norm")).otherwise(F.when(F.col("value").isNotNull(), 0.0))
    return applied(df, params, keys).withColumn("value", made).drop("centre", "norm")


def impute(df: DataFrame, params: DataFrame, keys: list[str]) -> DataFrame:
    return applied(df, params, keys).withColumn("value", F.coalesce("value", "centre")).drop("centre")


def impute_row_median(df: DataFrame, case: list[str]) -> DataFrame:
    """Missing values become the median of the case's own features."""
    own = df.groupBy(*case).agg(F.percentile("value", 0.5).alias("_m"))  # a case's features: one row each
    return applied(df, own, case).withColumn("value", F.coalesce("value", "_m")).drop("_m")


def fit_prune(train: DataFrame, keys: list[str], top_share: float | None = None) -> DataFrame:
    """Features that stay: spread above zero, nothing missing or infinite, no value with `top_share` of the rows."""
    s = train.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count("value").alias("m"), F.min("value").alias("lo"), F.max("value").alias("hi"))
    stay = s.filter((F.col("n") == F.col("m")) & (F.col("hi") > F.col("lo")) & (F.abs("lo") != float("inf")) & (F.abs("hi") != float("inf"))).select(*keys)
    if top_share is not None:
        c = train.groupBy(*keys, "value").agg(F.count(F.lit(1)).alias("c")).groupBy(*keys).agg((F.max("c") / F.sum("c")).alias("share"))
        stay = stay.join(c.filter(F.col("share") < top_share).select(*keys), keys)
    return stay


def discretise(df: DataFrame, params: DataFrame, keys: list[str], start: float, step: float, stop: float) -> DataFrame:
    """Signed band: how many of the marks start, start + step, .. stop (in SDs) the value lies beyond."""
    z = (F.col("value") - F.col("centre")) / F.col("sd")
    marks, m = [], start
    while m <= stop + 1e-12:
        marks.append(m)
        m += step
    bands = sum(((F.abs(z) > F.lit(k)).cast("double") for k in marks), F.lit(0.0))
    return applied(df, params, keys).withColumn("value", F.signum(z) * bands).drop("centre", "sd")


def into_bins(value: Column, edges: list[float]) -> Column:
    """Index of the last edge at or below the value, 0 if none."""
    return sum(((value >= F.lit(e)).cast("int") for e in edges), F.lit(0))


def dummies(df: DataFrame, case: str, column: str, limit: int = DUMMY_LIMIT) -> DataFrame:
    """0/1 columns of a text column's values; refuses over `limit` values; a missing value gives nulls."""
    found = sorted(r[0] for r in df.select(column).distinct().limit(limit + 2).collect() if r[0] is not None)
    if len(found) > limit:
        raise ValueError(f"{column} has over {limit} values")
    return df.select(case, *[(F.col(column) == v).cast("int").alias(f"d_{v}") for v in found])


def fit_offsets(train: DataFrame, group: str) -> DataFrame:
    """(group mean - overall mean) by feature; the overall mean comes from the groups' sums."""
    g = train.groupBy(group, "feat").agg(F.sum("value").alias("s"), F.count("value").alias("n"))
    w = Window.partitionBy("feat")
    return g.select(group, "feat", (F.col("s") / F.col("n") - F.sum("s").over(w) / F.sum("n").over(w)).alias("offset"))


def remove_offsets(df: DataFrame, params: DataFrame, group: str) -> DataFrame:
    return applied(df, params, [group, "feat"]).withColumn("value", F.col("value") - F.col("offset")).drop("offset")


def fit_residual(train: DataFrame, keys: list[str], covariate: str) -> DataFrame:
    """Least squares of each feature on one covariate, with intercept."""
    return train.groupBy(*keys).agg(F.regr_slope("value", covariate).alias("slope"), F.regr_intercept("value", covariate).alias("cut"))


def residuals(df: DataFrame, params: DataFrame, keys: list[str], covariate: str) -> DataFrame:
    return applied(df, params, keys).withColumn("value", F.col("value") - F.col("cut") - F.col("slope") * F.col(covariate)).drop("slope", "cut")


def fit_residuals_many(train: DataFrame, keys: list[str], covariates: list[str]) -> DataFrame:
    """Least squares on several covariates: normal equations summed by Spark, solved for each feature in numpy."""
    import numpy as np

    names = ["_one", *covariates]
    own = train.filter(F.col("value").isNotNull()).withColumn("_one", F.lit(1.0))
    own = own.select(*keys, "value", "_one", *[F.col(c).cast("double").alias(c) for c in covariates]).na.drop(subset=covariates)
    sums = [F.sum(F.col(a) * F.col(b)).alias(f"g{i}_{j}") for i, a in enumerate(names) for j, b in enumerate(names) if i <= j]
    sums += [F.sum(F.col(a) * F.col("value")).alias(f"v{i}") for i, a in enumerate(names)]
    k = len(names)

    def solve(batches):
        for pdf in batches:
            out = []
            for row in pdf.to_dict("records"):
                g = np.array([[row[f"g{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                out.append((np.linalg.pinv(g) @ np.array([row[f"v{i}"] for i in range(k)])).tolist())
            pdf = pdf[keys].copy()
            pdf["beta"] = out
            yield pdf

    gram = own.groupBy(*keys).agg(*sums)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in gram.schema if f.name in keys)
    return gram.mapInPandas(solve, f"{kinds}, beta array<double>")


def residuals_many(df: DataFrame, params: DataFrame, keys: list[str], covariates: list[str]) -> DataFrame:
    fitted = F.col("beta")[0]
    for i, c in enumerate(covariates):
        fitted = fitted + F.col("beta")[i + 1] * F.col(c)
    return applied(df, params, keys).withColumn("value", F.col("value") - fitted).drop("beta")


def fit_repair(train: DataFrame, group: str, percents: list[float]) -> DataFrame:
    """Group quantiles and the median of the groups' quantiles, by feature: for the disparate-impact remover."""
    q = hazen(train, [group, "feat"], "value", percents)
    names = [c for c in q.columns if c not in (group, "feat")]
    target = q.groupBy("feat").agg(*[F.percentile(n, 0.5).alias(f"t_{n}") for n in names])  # one row a group
    return q.join(target, "feat").select(group, "feat", F.array(*names).alias("own"), F.array(*[f"t_{n}" for n in names]).alias("target"))


def repair(df: DataFrame, params: DataFrame, group: str, strength: float) -> DataFrame:
    """Moves each value towards the value at its own quantile of the target distribution, by `strength`."""
    own, target, v = F.col("own"), F.col("target"), F.col("value")
    i = F.greatest(F.lit(1), F.least(F.size(F.filter(own, lambda x: x <= v)), F.size(own) - 1))
    at = lambda a, k: F.element_at(a, k.cast("int"))
    width = at(own, i + 1) - at(own, i)
    share = F.when(width > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), (v - at(own, i)) / width))).otherwise(F.lit(0.0))
    goal = at(target, i) + share * (at(target, i + 1) - at(target, i))
    return applied(df, params, [group, "feat"]).withColumn("value", F.when(v.isNotNull(), v + strength * (goal - v))).drop("own", "target")


def fit_batches(train: DataFrame, batch: str, tolerance: float = 1e-4, rounds: int = 100) -> DataFrame:
    """Empirical-Bayes batch location and scale (harmonisation without covariates).

    Features are standardised by their pooled mean and within-batch variance; each batch's additive
    and multiplicative effects are shrunk towards the batch's prior over features, to a fixed point.
    (batch, feat): mean, sd (pooled), gamma, delta. The fixed point runs by batch over one row a feature.
    """
    import numpy as np

    g = train.filter(F.col("value").isNotNull()).groupBy(batch, "feat").agg(F.count("value").alias("n"), F.avg("value").alias("m"), F.var_pop("value").alias("v"))
    w = Window.partitionBy("feat")
    total = F.sum("n").over(w)
    g = g.withColumn("mean", F.sum(F.col("n") * F.col("m")).over(w) / total).withColumn("sd", F.sqrt(F.sum(F.col("n") * F.col("v")).over(w) / total)).filter("sd > 0 and n > 1")
    g = g.withColumn("gamma", (F.col("m") - F.col("mean")) / F.col("sd")).withColumn("delta", F.col("v") * F.col("n") / (F.col("n") - 1) / F.col("sd") / F.col("sd"))

    def solve(pdf):
        pdf = pdf.sort_values("feat")
        gh, dh, n = pdf["gamma"].to_numpy(), pdf["delta"].to_numpy(), pdf["n"].to_numpy()
        if len(pdf) > 1 and gh.var(ddof=1) > 0 and dh.var(ddof=1) > 0:
            gb, t2 = gh.mean(), gh.var(ddof=1)
            m, s2 = dh.mean(), dh.var(ddof=1)
            a, b = (2 * s2 + m * m) / s2, (m * s2 + m**3) / s2
            go, do = gh.copy(), dh.copy()
            for _ in range(rounds):
                gn = (t2 * n * gh + do * gb) / (t2 * n + do)
                ss = (n - 1) * dh + n * (gh - gn) ** 2
                dn = (0.5 * ss + b) / (n / 2 + a - 1)
                change = max(np.abs((gn - go) / np.where(go == 0, 1, go)).max(), np.abs((dn - do) / do).max())
                go, do = gn, dn
                if change < tolerance:
                    break
            gh, dh = go, do
        return pdf.assign(gamma=gh, delta=dh)[[batch, "feat", "mean", "sd", "gamma", "delta"]]

    kind = dict(g.dtypes)
    return g.groupBy(batch).applyInPandas(solve, f"{batch} {kind[batch]}, feat {kind['feat']}, mean double, sd double, gamma double, delta double")


def harmonise(df: DataFrame, params: DataFrame, batch: str) -> DataFrame:
    z = ((F.col("value") - F.col("mean")) / F.col("sd") - F.col("gamma")) / F.sqrt("delta")
    made = F.when(F.col("sd").isNull(), F.col("value")).otherwise(z * F.col("sd") + F.col("mean"))
    return applied(df, params, [batch, "feat"]).withColumn("value", made).drop("mean", "sd", "gamma", "delta")
