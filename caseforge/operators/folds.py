"""Fold tables. Order inside a stratum is that of a hash of the seed and the id, so folds are the same anywhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .order import lowest


def hashed(case: str, seed: Column | str | int) -> Column:
    seed = seed if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat(F.col(case).cast("string"), F.lit(":"), seed.cast("string")))


def hashed_number(case: str, seed: Column | str | int) -> Column:
    """The first 52 bits of `hashed`, as a number."""
    return F.conv(F.substring(hashed(case, seed), 1, 13), 16, 10).cast("long")


def stratified(df: DataFrame, case: str, strata: list[str], k: int, perms: int = 1, prefix: str = "cv2") -> DataFrame:
    """Adds <prefix>_perm (from 1) and <prefix>_fold (1 to k): in each stratum, rank by hash modulo k.

    A stratum may hold most rows, so ranks are hierarchical: inside hash blocks, with the blocks' counts before.
    """
    own = df.withColumn(f"{prefix}_perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    own = own.withColumn("_h", hashed(case, F.col(f"{prefix}_perm"))).withColumn("_hb", F.substring("_h", 1, 2))
    part = [f"{prefix}_perm", *strata]
    counts = own.groupBy(*part, "_hb").agg(F.count(F.lit(1)).alias("_n"))
    early = Window.partitionBy(*part).orderBy("_hb").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*[F.col(p).alias(f"_{p}") for p in part], F.col("_hb").alias("_sb"), F.coalesce(F.sum("_n").over(early), F.lit(0)).alias("_start"))
    own = own.withColumn("_in", F.row_number().over(Window.partitionBy(*part, "_hb").orderBy("_h", case)))
    on = [F.col("_hb") == F.col("_sb")] + [F.col(p).eqNullSafe(F.col(f"_{p}")) for p in part]
    j = own.join(starts, on)
    return j.select(*df.columns, f"{prefix}_perm", ((F.col("_start") + F.col("_in") - 1) % k + 1).cast("int").alias(f"{prefix}_fold"))


def nested(df: DataFrame, case: str, strata: list[str], k2: int, k1: int) -> DataFrame:
    """One row for each case and outer fold: role test2, or train2 with its inner fold (cv1_fold, role by l != fold)."""
    outer = stratified(df, case, strata, k2)
    spread = outer.withColumnRenamed("cv2_fold", "own_fold").withColumn("cv2_fold", F.explode(F.sequence(F.lit(1), F.lit(k2))))
    test = spread.filter("own_fold = cv2_fold").withColumn("cv1_fold", F.lit(None).cast("int")).withColumn("role", F.lit("test"))
    train = stratified(spread.filter("own_fold <> cv2_fold"), case, [*strata, "cv2_fold"], k1, prefix="cv1").drop("cv1_perm").withColumn("role", F.lit("train"))
    return train.unionByName(test).drop("own_fold")


def leave_group_out(df: DataFrame, group: str) -> DataFrame:
    """Fold number of each group: its rank among the groups (a table of one row a group)."""
    g = df.select(group).distinct().withColumn("fold", F.row_number().over(Window.orderBy(F.col(group).asc_nulls_last())))
    g = g.withColumnRenamed(group, "_g")
    return df.join(F.broadcast(g) if g.count() <= 10_000 else g, F.col(group).eqNullSafe(F.col("_g"))).drop("_g")


#: Classes that a decomposition takes; more fail rather than drop any (dichotomies grow with their square).
CLASSES = 1000


def _classes(df: DataFrame, cls: str) -> list:
    names = sorted(r[0] for r in df.filter(F.col(cls).isNotNull()).select(cls).distinct().limit(CLASSES + 1).collect())
    if len(names) > CLASSES:
        raise ValueError(f"{cls} has over {CLASSES} classes")
    return names


def _dichotomies(df: DataFrame, cls: str, rows: list[tuple]) -> DataFrame:
    """Joins each row to the dichotomies of its class; rows: (class, name, side)."""
    kind = dict(df.dtypes)[cls]
    table = df.sparkSession.createDataFrame(rows, f"_cls {kind}, class_b string, y_b int")
    return df.join(table, F.col(cls) == F.col("_cls")).drop("_cls")


def one_vs_one(df: DataFrame, cls: str) -> DataFrame:
    """(class_b, y_b): each pair of classes a < b, +1 for a, -1 for b; other classes aren't members."""
    names = _classes(df, cls)
    pairs = [(a, b) for i, a in enumerate(names) for b in names[i + 1 :]]
    return _dichotomies(df, cls, [row for a, b in pairs for row in ((a, f"{a}-{b}", 1), (b, f"{a}-{b}", -1))])


def one_vs_all(df: DataFrame, cls: str) -> DataFrame:
    names = _classes(df, cls)
    return _dichotomies(df, cls, [(c, str(a), 1 if c == a else -1) for a in names for c in names])


def undersampled(df: DataFrame, case: str, label: str, ratio: float) -> DataFrame:
    """All positives and at most ratio x positives of the negatives, the lowest ones by hash."""
    n = df.filter(F.col(label) > 0).count()
    rest = df.filter(F.col(label) < 0).withColumn("_h", hashed_number(case, F.lit("42"))).withColumn("_all", F.lit(1))
    whole, edge = lowest(rest, ["_all"], "_h", F.lit(int(ratio * n)), case)
    return df.filter(F.col(label) > 0).unionByName(whole.unionByName(edge).drop("_h", "_all"))


def leave_site_out(df: DataFrame, case: str, site: str, share: float, perms: int) -> DataFrame:
    """(site_out, perm, case, role): each site held out in turn; of the other sites' cases a share, drawn by hash, trains.

    A case's draw depends on its id and the permutation alone, so a site's size doesn't matter.
    """
    sites = df.select(F.col(site).alias("site_out")).filter(F.col(site).isNotNull()).distinct()
    drawn = df.select(case, site).withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(perms))))
    taken = hashed_number(case, F.col("perm")) < F.lit(int(share * (1 << 52)))
    drawn = drawn.withColumn("_in", taken)
    # a row for each case and site: what a leave-one-site-out table is
    pairs = drawn.join(F.broadcast(sites), F.lit(True)) if sites.count() <= CLASSES else None
    if pairs is None:
        raise ValueError(f"over {CLASSES} sites")
    own = F.col(site).eqNullSafe(F.col("site_out"))
    return pairs.filter(own | F.col("_in")).select("site_out", "perm", case, F.when(own, "test").otherwise("train").alias("role"))
