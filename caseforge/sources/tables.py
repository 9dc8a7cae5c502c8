"""Case tables: loading, the NaN-to-NULL rule, long and wide form, and text files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File kinds by extension, for `read_table`.
KINDS = {"csv": "csv", "txt": "csv", "tsv": "tsv", "parquet": "parquet", "orc": "orc", "json": "json"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nulls(df: DataFrame) -> DataFrame:
    """NaN becomes NULL in every floating column, once, on reading."""
    kinds = dict(df.dtypes)
    return df.select(*[F.when(~F.isnan(c), F.col(c)).alias(c) if kinds[c] in ("double", "float") else F.col(c) for c in df.columns])


def read_table(spark: SparkSession, path: str, kind: str | None = None, schema: str | None = None, sep: str | None = None) -> DataFrame:
    """A case table from a file of a known kind, with NaN as NULL."""
    kind = kind or path.rsplit(".", 1)[-1].lower()
    if kind not in KINDS:
        raise ValueError(f"no reader for .{kind}; known: {', '.join(sorted(KINDS))}")
    reader = spark.read.schema(schema) if schema else spark.read
    if KINDS[kind] in ("csv", "tsv"):
        return nulls(reader.csv(path, header=True, sep=sep or ("\t" if kind == "tsv" else ","), nanValue="NaN", inferSchema=schema is None))
    return nulls(reader.format(KINDS[kind]).load(path))


def write_table(df: DataFrame, path: str, kind: str = "parquet", by: tuple[str, ...] = ()) -> None:
    """Writes a table; tab-separated text, or a columnar format partitioned by fold columns."""
    writer = df.write.mode("overwrite").partitionBy(*by) if by else df.write.mode("overwrite")
    if KINDS[kind] in ("csv", "tsv"):
        writer.csv(path, header=True, sep="\t" if kind == "tsv" else ",")
    else:
        writer.format(KINDS[kind]).save(path)


def checked(df: DataFrame, case_id: str, features: list[str], label: str | None = None) -> DataFrame:
    """Import checks: features there and numeric, ids there and unique. Raises with a message; returns the table."""
    missing = [c for c in [case_id, *features, *([label] if label else [])] if c not in df.columns]
    if missing:
        raise ValueError(f"columns not found: {', '.join(missing)}")
    kinds = dict(df.dtypes)
    wrong = [c for c in features if kinds[c].split("(")[0] not in ("double", "float", "int", "bigint", "smallint", "tinyint", "decimal")]
    if wrong:
        raise ValueError(f"features that aren't numeric: {', '.join(wrong)}")
    twice = df.groupBy(case_id).count().filter((F.col("count") > 1) | F.col(case_id).isNull()).limit(1).collect()
    if twice:
        raise ValueError(f"case id {twice[0][0]!r} is empty or there twice")
    return df


def to_long(df: DataFrame, case_id: str, features: list[str], keep: tuple[str, ...] = ()) -> DataFrame:
    """(case_id, *keep, feat, value): one row for each case and feature."""
    pairs = F.array(*[F.struct(F.lit(f).alias("feat"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(case_id, *keep, F.explode(pairs).alias("_p")).select(case_id, *keep, "_p.feat", "_p.value")


def array_to_long(df: DataFrame, case_id: str, array: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """The same from an array column; feat is the position from 1."""
    return df.select(case_id, *keep, F.posexplode(array).alias("_i", "value")).select(case_id, *keep, (F.col("_i") + 1).alias("feat"), F.col("value").cast("double").alias("value"))


def to_wide(long: DataFrame, case_id: str, features: list[str]) -> DataFrame:
    return long.groupBy(case_id).pivot("feat", features).agg(F.first("value", ignorenulls=True))


def cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The engine's case table over orders and customers: four features with gaps, a binary label, a class, a group, a site."""
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    j = o.join(c, o.o_custkey == c.c_custkey)
    gap = lambda k, x: F.when(F.col("o_orderkey") % k != 0, x)
    return j.select(
        F.col("o_orderkey").alias("case_id"),
        gap(11, F.col("o_totalprice") / 1e5).alias("x1"),
        gap(7, F.col("c_acctbal") / 1e3).alias("x2"),
        (F.col("o_custkey") % 50).cast("double").alias("x3"),
        F.lit(5.0).alias("x4"),
        F.when(F.col("o_orderstatus") == "F", 1).otherwise(-1).alias("y"),
        F.col("o_orderstatus").alias("cls"),
        F.col("o_orderpriority").alias("grp"),
        F.col("c_nationkey").alias("site"),
    )


FEATURES = ["x1", "x2", "x3", "x4"]
#: The same tables in SQL.
CASES_SQL = """cases AS (SELECT o_orderkey AS case_id, CASE WHEN o_orderkey % 11 <> 0 THEN o_totalprice / 1e5::DOUBLE END AS x1,
  CASE WHEN o_orderkey % 7 <> 0 THEN c_acctbal / 1e3::DOUBLE END AS x2, CAST(o_custkey % 50 AS DOUBLE) AS x3, 5.0::DOUBLE AS x4,
  CASE WHEN o_orderstatus = 'F' THEN 1 ELSE -1 END AS y, o_orderstatus AS cls, o_orderpriority AS grp, c_nationkey AS site
  FROM orders JOIN customer ON o_custkey = c_custkey),
long AS (SELECT case_id, y, cls, grp, site, 'x1' AS feat, x1 AS value FROM cases UNION ALL SELECT case_id, y, cls, grp, site, 'x2', x2 FROM cases
  UNION ALL SELECT case_id, y, cls, grp, site, 'x3', x3 FROM cases UNION ALL SELECT case_id, y, cls, grp, site, 'x4', x4 FROM cases)"""


def cases_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    return to_long(cases(spark, sf_dir), "case_id", FEATURES, ("y", "cls", "grp", "site"))


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deterministic predictions of a binary label: five learners over the labelled documents (case_id, learner, y, score, p)."""
    d = table(spark, sf_dir, "labels")
    learner = F.explode(F.sequence(F.lit(1), F.lit(5))).alias("learner")
    own = d.select(F.col("doc_id").alias("case_id"), (2 * F.col("quality") - 1).alias("y"), learner)
    raw = F.pmod(F.col("case_id") * 7919 + F.col("learner") * 104729, F.lit(201)).cast("double") / 100 - 1 + F.col("y") * 0.3
    own = own.withColumn("score", F.round(raw, 2) + 0.0)
    return own.withColumn("p", 1 / (1 + F.exp(-2 * F.col("score"))))


SCORES_SQL = """scores AS (SELECT *, 1 / (1 + exp(-2 * score)) AS p FROM (SELECT doc_id AS case_id, 2 * quality - 1 AS y, learner,
  round(CAST((doc_id * 7919 + learner * 104729) % 201 AS DOUBLE) / 100 - 1 + (2 * quality - 1) * 0.3::DOUBLE, 2) + 0 AS score
  FROM labels, (SELECT unnest(range(1, 6)) AS learner)))"""


def missing_to(column: Column, value: float) -> Column:
    return F.coalesce(column, F.lit(value))
