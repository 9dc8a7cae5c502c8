"""Matching cases and modalities by id."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def keyed(df: DataFrame, id: str, order: str) -> DataFrame:
    """Trimmed ids as `key`; of rows with one id the first by `order`."""
    own = df.withColumn("key", F.trim(F.col(id).cast("string")))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("key").orderBy(order))).filter("_r = 1").drop("_r")


def intersect(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.join(target, "key")


def left_with_gaps(target: DataFrame, source: DataFrame) -> DataFrame:
    """All target ids; source columns are null where there is no match."""
    return target.join(source, "key", "left")


def source_only(source: DataFrame, target: DataFrame) -> DataFrame:
    return source.join(target, "key", "left_anti")


def substring_match(a: DataFrame, a_id: str, b: DataFrame, b_id: str) -> DataFrame:
    """Pairs (a_id, b_id) where either id holds the other.

    An equi-join on substrings instead of a comparison of all pairs: each id is cut into its
    substrings of the lengths that the other side has (ids are short; empty ids match nothing).
    """

    def inside(x: DataFrame, x_id: str, y: DataFrame, y_id: str) -> DataFrame:
        lengths = [r[0] for r in x.select(F.length(x_id).alias("n")).distinct().collect() if r[0]]

        def parts_of(n: int) -> Column:
            all_ = F.transform(F.sequence(F.lit(1), F.length(y_id) - n + 1), lambda i: F.substring(F.col(y_id), i, F.lit(n)))
            return F.when(F.length(y_id) >= n, all_).otherwise(F.array().cast("array<string>"))

        cut = [parts_of(n) for n in sorted(lengths)]
        if not cut:
            return y.select(F.lit(None).cast("string").alias(x_id), F.col(y_id)).limit(0)
        parts = y.select(y_id, F.explode(F.array_distinct(F.concat(*cut))).alias("_part"))
        return x.select(x_id).join(parts, F.col(x_id) == F.col("_part")).select(x_id, y_id)

    return inside(a, a_id, b, b_id).unionByName(inside(b, b_id, a, a_id)).distinct()


def aligned(df: DataFrame, spine: DataFrame, id: str, features: list[str]) -> DataFrame:
    """Rows and columns in the stored shape: every spine id once, features by name, null where absent."""
    missing = [f for f in features if f not in df.columns]
    if missing:
        raise ValueError(f"features not found: {', '.join(missing)}")
    return spine.select(id).join(df.select(id, *features), id, "left")


def list_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Ids that only one of two case lists holds, with the side."""
    return a.exceptAll(b).withColumn("side", F.lit("first")).unionByName(b.exceptAll(a).withColumn("side", F.lit("second")))


def product(parameters: dict[str, list], spark) -> DataFrame:
    """All combinations of parameter values, from the parameter lists themselves."""
    out = None
    for name, values in parameters.items():
        axis = spark.createDataFrame([(v,) for v in values], [name])
        out = axis if out is None else out.crossJoin(F.broadcast(axis))  # hyperparameter lists: a handful of literals
    return out


def combinations(df: DataFrame, item: str, k: int) -> DataFrame:
    """The k-combinations of a small item table (features, classes), in ascending order: c1 .. ck."""
    out = df.select(F.col(item).alias("c1"))
    for i in range(2, k + 1):
        out = out.join(F.broadcast(df.select(F.col(item).alias(f"c{i}"))), F.col(f"c{i - 1}") < F.col(f"c{i}"))
    return out
