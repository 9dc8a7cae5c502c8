"""Whole flows: the ordered step sequence, and nested-fold classification as one plan over all folds."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..operators import metrics, prep

#: Where the winsorising step clips z scores.
WINSOR = 3.0
#: Steps by name: (fit(train, keys) -> parameters, apply(df, parameters, keys) -> df).
STEPS: dict[str, tuple[Callable, Callable]] = {
    "impute": (prep.fit_mean, prep.impute),
    "scale": (prep.fit_scale, prep.scale),
    "standardise": (prep.fit_standard, prep.standardise),
    "centre": (prep.fit_mean, prep.centred),
    "unit_norm": (prep.fit_unit_norm, prep.unit_normalise),
    "standardise_median": (lambda train, keys: prep.fit_standard(train, keys, median=True), prep.standardise),
    "standardise_iqr": (prep.fit_standard_iqr, prep.standardise),
    "winsorise": (lambda train, keys: prep.fit_winsorise(train, keys, WINSOR), lambda df, p, keys: prep.winsorise(df, p, keys, WINSOR)),
    "prune": (prep.fit_prune, lambda df, p, keys: df.join(p.select(*[F.col(k).alias(f"_k_{k}") for k in keys]), [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys], "left_semi")),
    "copy": (lambda train, keys: train.select(*keys).limit(0), lambda df, p, keys: df),
}


@dataclass
class Sequence:
    """Ordered steps, each fitted on the training rows as the earlier steps left them, by fold."""

    steps: list[str]
    keys: list[str]
    params: list[DataFrame] = field(default_factory=list)

    def fit(self, train: DataFrame) -> Sequence:
        self.params, own = [], train
        for s in self.steps:
            fit, apply = STEPS[s]
            self.params.append(fit(own, self.keys))
            own = apply(own, self.params[-1], self.keys)
        return self

    def apply(self, df: DataFrame) -> DataFrame:
        for s, p in zip(self.steps, self.params, strict=True):
            df = STEPS[s][1](df, p, self.keys)
        return df

    def save(self, path: str) -> None:
        """Parameter tables only: no case data leaves."""
        for i, (s, p) in enumerate(zip(self.steps, self.params, strict=True)):
            p.write.mode("overwrite").parquet(f"{path}/{i:02d}_{s}")

    @classmethod
    def load(cls, spark, path: str, steps: list[str], keys: list[str]) -> Sequence:
        return cls(steps, keys, [spark.read.parquet(f"{path}/{i:02d}_{s}") for i, s in enumerate(steps)])


def custom_step(df: DataFrame, function: Callable, schema: str) -> DataFrame:
    """A user's function over pandas batches, as a step."""
    return df.mapInPandas(function, schema)


def by_fold(long: DataFrame, folds: DataFrame, case: str, fold: str, k: int) -> DataFrame:
    """Long rows once for each fold, with in_test: fold keys travel in the data, so one job serves all folds."""
    j = long.join(folds.select(F.col(case).alias("_c"), F.col(fold).alias("_own")), F.col(case) == F.col("_c"))
    return j.withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(k)))).withColumn("in_test", F.col("_own") == F.col("fold")).drop("_c", "_own")


def nearest_mean(rows: DataFrame, case: str, y: str, sequence: Sequence) -> DataFrame:
    """Scores of the test rows: the projection on the difference of the training class means, after the sequence."""
    train = rows.filter(~F.col("in_test"))
    sequence.fit(train)
    ready = sequence.apply(rows)
    keys = sequence.keys
    v = F.col("value")
    means = ready.filter(~F.col("in_test")).groupBy(*keys).agg((F.avg(F.when(F.col(y) > 0, v)) - F.avg(F.when(F.col(y) < 0, v))).alias("w"))
    test = prep.applied(ready.filter("in_test"), means, keys)
    return test.groupBy("fold", case, y).agg(F.sum(v * F.col("w")).alias("score"))


def nested_nearest_mean(df: DataFrame, folds: DataFrame, case: str, y: str, features: str, grid: list[int], inner: int) -> DataFrame:
    """Nested cross-validation of a nearest-mean classifier over its best features: fold, k, inner_bac, n, bac.

    folds: case, cv2_fold, cv1_fold (null in the outer test fold), as `folds.nested` makes them. In each
    outer fold, a model is fitted for each inner fold on the other inner folds; the number k of features
    (strongest difference of class means over spread) with the best mean inner accuracy is chosen, and
    the outer test rows are judged by the mean score of the inner models at that k.

    Sums are made once for each (outer, inner) fold, and a training set's are the total less a fold's.
    Models are a row a pair of folds; scores are array expressions, so rows aren't spread by feature.
    """
    own = folds.select(F.col(case).alias("_c"), F.col("cv2_fold").alias("f2"), F.col("cv1_fold").alias("f1"))
    rows = df.select(case, y, F.transform(features, lambda x: x.cast("double")).alias("_f")).join(own, F.col(case) == F.col("_c"))
    v = F.col("v")
    sums = rows.filter("f1 is not null").select("f2", "f1", y, F.posexplode("_f").alias("i", "v")).groupBy("f2", "f1", "i").agg(
        F.count(v).alias("n"), F.sum(v).alias("s"), F.sum(v * v).alias("q"),
        F.count(F.when(F.col(y) > 0, v)).alias("np"), F.sum(F.when(F.col(y) > 0, v)).alias("sp"),
    )
    whole = Window.partitionBy("f2", "i")  # a row an inner fold
    left = {c: F.sum(c).over(whole) - F.coalesce(F.col(c), F.lit(0)) for c in ("n", "s", "q", "np", "sp")}
    rest = sums.select("f2", "f1", "i", *[x.alias(c) for c, x in left.items()])
    centre = F.col("s") / F.col("n")
    sd = F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("n")) / (F.col("n") - 1))
    gap = F.col("sp") / F.col("np") - (F.col("s") - F.col("sp")) / (F.col("n") - F.col("np"))
    models = rest.select("f2", "f1", "i", centre.alias("c"), sd.alias("sd"), F.when(sd > 0, gap / sd).otherwise(F.lit(0.0)).alias("w"))
    models = models.withColumn("r", F.row_number().over(Window.partitionBy("f2", "f1").orderBy(F.abs("w").desc(), "i")))  # a row a feature
    cell = F.struct("i", "c", *[F.when((F.col("r") <= k) & (F.col("sd") > 0), F.col("w") / F.col("sd")).otherwise(F.lit(0.0)).alias(f"a{k}") for k in grid])
    models = models.groupBy("f2", "f1").agg(F.sort_array(F.collect_list(cell)).alias("m")).select(F.col("f2").alias("m2"), F.col("f1").alias("m1"), "m")
    pairs = rows.withColumn("at", F.explode(F.when(F.col("f1").isNull(), F.sequence(F.lit(1), F.lit(inner))).otherwise(F.array("f1"))))
    scored = pairs.join(F.broadcast(models), (F.col("f2") == F.col("m2")) & (F.col("at") == F.col("m1")))  # outer x inner folds of d numbers
    of = lambda k: F.aggregate(F.zip_with("_f", "m", lambda x, m: F.coalesce((x - m["c"]) * m[f"a{k}"], F.lit(0.0))), F.lit(0.0), lambda a, x: a + x)
    each = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), of(k).alias("score")) for k in grid])).alias("x")
    scored = scored.select("f2", "f1", "at", F.col(case).alias("case"), F.col(y).alias("y"), each).select("f2", "f1", "at", "case", "y", "x.*")

    def accuracy(part: list[str], d: DataFrame) -> DataFrame:
        rate = lambda hit, of_: F.avg(F.when(of_, hit.cast("double")))
        return d.groupBy(*part).agg(F.count(F.lit(1)).alias("n"), ((rate(F.col("score") > 0, F.col("y") > 0) + rate(F.col("score") <= 0, F.col("y") < 0)) * 50).alias("bac"))

    inner_bac = accuracy(["f2", "at", "k"], scored.filter("f1 is not null")).groupBy("f2", "k").agg(F.round(F.avg("bac"), 6).alias("a"))
    best = inner_bac.groupBy("f2").agg(F.max(F.struct("a", (-F.col("k")).alias("k"))).alias("b")).select(F.col("f2").alias("b2"), (-F.col("b.k")).alias("bk"), F.col("b.a").alias("inner_bac"))
    test = scored.filter("f1 is null").groupBy("f2", "case", "y", "k").agg(F.avg("score").alias("score"))
    judged = test.join(F.broadcast(best), (F.col("f2") == F.col("b2")) & (F.col("k") == F.col("bk")))  # a row an outer fold
    return accuracy(["f2", "k", "inner_bac"], judged).select(F.col("f2").alias("fold"), "k", "inner_bac", "n", "bac")


def fold_report(scored: DataFrame, y: str) -> DataFrame:
    a = metrics.auc(scored, ["fold"], y, "score").select("fold", "auc")
    m = metrics.measures()
    c = metrics.confusion(scored, ["fold"], y, "score").select(F.col("fold"), F.col("n").cast("long").alias("n"), m["bac"].alias("bac"))
    return c.join(a, "fold")
