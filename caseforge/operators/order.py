"""Ranks, running sums and percentiles that no task has to hold a whole group for.

Values are grouped first. Running sums over them go through buckets cut at approximate
quantiles: sums inside a bucket by a window, sums of earlier buckets from a small table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 64
#: Parts up to which their bounds go through the driver and are broadcast (PARTS x BUCKETS numbers).
PARTS = 5000


def with_bucket(df: DataFrame, part: list[str], order: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds _b: how many of the part's own approximate quantiles lie below the value."""
    shares = [k / buckets for k in range(1, buckets)]
    number = F.col(order).cast("double")
    bounds = df.groupBy(*part).agg(F.percentile_approx(number, shares, 2000).alias("_bounds"))
    bounds = bounds.select(*[F.col(p).alias(f"_g_{p}") for p in part], "_bounds")
    rows = bounds.limit(PARTS + 1).collect()
    known = F.broadcast(df.sparkSession.createDataFrame(rows, bounds.schema)) if len(rows) <= PARTS else bounds

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a)
        m = (a + b) // 2
        return F.when(number <= F.get("_bounds", F.lit(m)), tree(a, m)).otherwise(tree(m + 1, b))

    joined = df.join(known, [F.col(p).eqNullSafe(F.col(f"_g_{p}")) for p in part], "left") if part else df.crossJoin(known)  # one row
    return joined.select(*df.columns, F.when(F.col("_bounds").isNull() | F.isnull(order), F.lit(0)).otherwise(tree(0, buckets - 1)).alias("_b"))


def running(df: DataFrame, part: list[str], order: str, sums: list[str], buckets: int = BUCKETS) -> DataFrame:
    """Adds before_<s> (sums of rows with lower `order` in the same part) and all_<s>. `order` must be distinct in a part."""
    own = with_bucket(df, part, order, buckets)
    totals = own.groupBy(*part, "_b").agg(*[F.sum(s).alias(f"_t_{s}") for s in sums])
    w = Window.partitionBy(*part)
    early = w.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(*[F.col(p).alias(f"_p_{p}") for p in part], F.col("_b").alias("_c"), *[F.coalesce(F.sum(f"_t_{s}").over(early), F.lit(0)).alias(f"_e_{s}") for s in sums], *[F.sum(f"_t_{s}").over(w).alias(f"all_{s}") for s in sums])
    inside = Window.partitionBy(*part, "_b").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    own = own.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_i_{s}") for s in sums])
    on = F.col("_b") == F.col("_c")
    for p in part:
        on = on & F.col(p).eqNullSafe(F.col(f"_p_{p}"))
    own = own.join(totals, on)
    return own.select(*df.columns, *[(F.col(f"_i_{s}") + F.col(f"_e_{s}")).alias(f"before_{s}") for s in sums], *[f"all_{s}" for s in sums])


#: Cells that evenly spread numbers under 2 ** 52 are counted in, to find a rank without a sort.
_CELL_BITS = 12


def lowest(df: DataFrame, part: list[str], order: str, many: Column, tie: str, value: str | None = None) -> tuple[DataFrame, DataFrame]:
    """The `many` rows of each part with the lowest `order`, as two tables with _cell: whole cells, and what is taken of the cell on the edge.

    order: a hash of 52 bits, so a part's rows fall evenly into 4,096 cells; a count of them finds the
    edge, and only its cell is sorted. With `value`, the first table is its sum by part instead of rows.
    """
    own = df.withColumn("_cell", F.shiftright(order, 52 - _CELL_BITS).cast("int"))
    cells = own.groupBy(*part, "_cell").agg(F.count(F.lit(1)).alias("_c"), F.sum(value or F.lit(0)).alias("_v"))
    early = Window.partitionBy(*part).orderBy("_cell").rowsBetween(Window.unboundedPreceding, -1)  # 4,096 cells a part at most
    cells = cells.withColumn("_before", F.coalesce(F.sum("_c").over(early), F.lit(0))).withColumn("_many", many)
    whole = cells.filter("_before + _c <= _many")
    edge = cells.filter("_before < _many and _before + _c > _many").select(*[F.col(p).alias(f"_e_{p}") for p in part], F.col("_cell").alias("_at"), (F.col("_many") - F.col("_before")).alias("_rest"))
    on = [F.col(p).eqNullSafe(F.col(f"_e_{p}")) for p in part] + [F.col("_cell") == F.col("_at")]
    border = own.join(edge, on).withColumn("_r", F.row_number().over(Window.partitionBy(*part, "_cell").orderBy(order, tie))).filter("_r <= _rest")
    if value:
        return whole.groupBy(*part).agg(F.sum("_v").alias("total")), border.groupBy(*part).agg(F.sum(value).alias("total"))
    taken = whole.select(*[F.col(p).alias(f"_e_{p}") for p in part], F.col("_cell").alias("_at"))
    return own.join(taken, on, "left_semi").select(*df.columns), border.select(*df.columns)


def counted(df: DataFrame, part: list[str], value: str) -> DataFrame:
    """One row for each value of a part: n, before_n, all_n (missing values left out)."""
    grouped = df.filter(F.col(value).isNotNull()).groupBy(*part, value).agg(F.count(F.lit(1)).alias("n"))
    return running(grouped, part, value, ["n"])


def tied_rank(df: DataFrame, part: list[str], value: str, name: str = "rank") -> DataFrame:
    """Adds the rank of each value in its part, ties at their average rank; missing values have none."""
    c = counted(df, part, value)
    c = c.select(*[F.col(p).alias(f"_q_{p}") for p in part], F.col(value).alias("_v"), (F.col("before_n") + (F.col("n") + 1) / 2).alias(name))
    on = F.col(value) == F.col("_v")
    for p in part:
        on = on & F.col(p).eqNullSafe(F.col(f"_q_{p}"))
    return df.join(c, on, "left").drop("_v", *[f"_q_{p}" for p in part])


def hazen(df: DataFrame, part: list[str], value: str, percents: list[float]) -> DataFrame:
    """Percentiles at Hazen's positions, (i - 0.5) / n, between neighbours, clamped to the extremes: columns p<percent>."""
    c = counted(df, part, value)
    made: list[Column] = []
    for k, p in enumerate(percents):
        at = F.greatest(F.lit(1.0), F.least(F.col("all_n").cast("double"), F.col("all_n") * (p / 100) + 0.5))
        low, high = F.floor(at), F.ceil(at)
        here = lambda i: F.max(F.when((F.col("before_n") < i) & (i <= F.col("before_n") + F.col("n")), F.col(value)))
        made += [here(low).alias(f"_l{k}"), here(high).alias(f"_h{k}"), F.max(at - low).alias(f"_f{k}")]
    out = c.groupBy(*part).agg(*made)
    names = [f"p{p:g}".replace(".", "_") for p in percents]
    return out.select(*part, *[(F.col(f"_l{k}") + (F.col(f"_h{k}") - F.col(f"_l{k}")) * F.col(f"_f{k}")).alias(name) for k, name in enumerate(names)])


def medians(df: DataFrame, part: list[str], value: str, name: str = "median") -> DataFrame:
    return hazen(df, part, value, [50]).withColumnRenamed("p50", name)
