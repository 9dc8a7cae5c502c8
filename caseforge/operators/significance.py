"""Corrections and rank tests. Tables of p values and of blocks x treatments; windows run over tests or inside blocks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalar import erfc, two_sided_normal_p
from .order import counted, with_bucket


#: Tests up to which the harmonic sum is added up; beyond, its series is exact to the last digit.
SUMMED = 100_000


def _harmonic(m: Column) -> Column:
    added = F.aggregate(F.sequence(F.lit(1), F.least(m, F.lit(SUMMED)).cast("int")), F.lit(0.0), lambda a, k: a + 1 / k)
    return F.when(m <= SUMMED, added).otherwise(F.log(m) + 0.5772156649015329 + 1 / (2 * m) - 1 / (12 * m * m))


def fdr(df: DataFrame, test: str, p: str = "p", dependent: bool = False, part: list[str] | None = None) -> DataFrame:
    """Step-up adjusted p (with `dependent`, times the harmonic sum), capped at 1. One row a test.

    Equal p share the rank of the last of them and so their result: it is made for each value, by
    running counts and by least values from behind, through buckets, so tests may be any number.
    """
    keys = part or []
    own = df if part else df.withColumn("_whole", F.lit(1))
    keys = keys or ["_whole"]
    c = with_bucket(counted(own, keys, p), keys, p)
    m = F.col("all_n").cast("double")
    c = c.withColumn("_x", F.col(p) * m / (F.col("before_n") + F.col("n")) * (_harmonic(F.col("all_n")) if dependent else F.lit(1.0)))
    inside = Window.partitionBy(*keys, "_b").orderBy(F.col(p).desc())
    later = Window.partitionBy(*keys).orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)  # a row a bucket
    behind = c.groupBy(*keys, "_b").agg(F.min("_x").alias("_m")).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_b").alias("_c"), F.min("_m").over(later).alias("_later"))
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    c = c.withColumn("_in", F.min("_x").over(inside)).join(behind, [*same, F.col("_b") == F.col("_c")])
    found = c.select(*[F.col(k).alias(f"_j_{k}") for k in keys], F.col(p).alias("_p"), F.least(F.lit(1.0), "_in", "_later").alias("adjusted"))
    out = own.join(found, [F.col(k).eqNullSafe(F.col(f"_j_{k}")) for k in keys] + [F.col(p) == F.col("_p")], "left")
    return out.select(*df.columns, "adjusted")


def holm(df: DataFrame, test: str, p: str = "p") -> DataFrame:
    """Step-down p (m - i + 1): the greater of each and its predecessor only, without a cap, as the reference computes it.

    Windows run inside buckets of p; a bucket's first test meets the last one of the bucket before.
    """
    own = with_bucket(df.withColumn("_whole", F.lit(1)), ["_whole"], p)
    every = Window.partitionBy("_whole").orderBy("_b")  # a row a bucket
    edges = own.groupBy("_whole", "_b").agg(F.count(F.lit(1)).alias("_n"), F.max(p).alias("_top"))
    edges = edges.select(F.col("_b").alias("_c"), F.coalesce(F.sum("_n").over(every.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy("_whole")).alias("_m"), F.lag("_top").over(every).alias("_last"))
    w = Window.partitionBy("_b").orderBy(p, test)
    own = own.join(edges, F.col("_b") == F.col("_c")).withColumn("_r", F.col("_before") + F.row_number().over(w))
    own = own.withColumn("_x", F.col(p) * (F.col("_m") - F.col("_r") + 1))
    crossed = F.col("_last") * (F.col("_m") - F.col("_before") + 1)
    made = F.greatest(F.col("_x"), F.coalesce(F.lag("_x").over(w), crossed, F.col("_x")))
    return own.select(*df.columns, made.alias("adjusted"))


def mcnemar(df: DataFrame, a: str, b: str, part: list[str]) -> DataFrame:
    """Yates-corrected chi square of the discordant counts of two 0/1 columns, and its p (1 degree)."""
    g = df.groupBy(*part).agg(F.count_if((F.col(a) == 1) & (F.col(b) == 0)).cast("double").alias("only_a"), F.count_if((F.col(a) == 0) & (F.col(b) == 1)).cast("double").alias("only_b"))
    n = F.col("only_a") + F.col("only_b")
    chi = F.when(n > 0, F.pow(F.greatest(F.abs(F.col("only_a") - F.col("only_b")) - 1, F.lit(0.0)), F.lit(2)) / n).otherwise(F.lit(0.0))
    return g.withColumn("chi2", chi).withColumn("p", erfc(F.sqrt(F.col("chi2") / 2)))


def _block_ranks(df: DataFrame, block: str, value: str) -> DataFrame:
    w = Window.partitionBy(block)
    low = F.rank().over(w.orderBy(value))
    ties = F.count(F.lit(1)).over(Window.partitionBy(block, value))
    return df.withColumn("_rank", low + (ties - 1) / 2).withColumn("_k", F.count(F.lit(1)).over(w)).withColumn("_range", F.max(value).over(w) - F.min(value).over(w))


def friedman(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """Chi square of the treatments' mean ranks over complete blocks, with the tie correction."""
    r = _block_ranks(df, block, value)
    ss = r.agg(F.sum(F.pow(F.col("_rank") - (F.col("_k") + 1) / 2, F.lit(2))).alias("all_ss"), F.count_distinct(block).alias("n"), F.max("_k").alias("k"))
    t = r.groupBy(treatment).agg(F.sum("_rank").alias("s"))
    j = t.crossJoin(F.broadcast(ss))  # one row
    return j.groupBy("n", "k").agg((F.first(F.col("n") * (F.col("k") - 1) / F.col("all_ss")) * F.sum(F.pow(F.col("s") - F.col("n") * (F.col("k") + 1) / 2, F.lit(2))) / F.first("n")).alias("chi2"))


def quade(df: DataFrame, block: str, treatment: str, value: str) -> DataFrame:
    """W: blocks weighted by the tied rank of their range; F = (b - 1) B / (A - B)."""
    from .order import tied_rank

    r = _block_ranks(df, block, value)
    ranges = r.select(block, "_range").distinct().withColumn("_all", F.lit(1))
    q = tied_rank(ranges, ["_all"], "_range", "_q").select(F.col(block).alias("_b"), "_q")
    s = r.join(q, F.col(block) == F.col("_b")).withColumn("_s", F.col("_q") * (F.col("_rank") - (F.col("_k") + 1) / 2))
    a = s.agg(F.sum(F.col("_s") * F.col("_s")).alias("a"), F.count_distinct(block).alias("n"))
    b = s.groupBy(treatment).agg(F.sum("_s").alias("t")).agg(F.sum(F.col("t") * F.col("t")).alias("bb"))
    return a.crossJoin(F.broadcast(b)).select(((F.col("n") - 1) * (F.col("bb") / F.col("n")) / (F.col("a") - F.col("bb") / F.col("n"))).alias("f"))  # one row each


def wilcoxon(df: DataFrame, diff: str) -> DataFrame:
    """Signed-rank sums of non-zero differences (ties averaged), z of the normal form, one-sided p."""
    from .order import tied_rank

    d = df.filter((F.col(diff) != 0) & F.col(diff).isNotNull()).withColumn("_a", F.abs(diff)).withColumn("_all", F.lit(1))
    r = tied_rank(d, ["_all"], "_a", "_r")
    g = r.agg(F.sum(F.when(F.col(diff) > 0, F.col("_r")).otherwise(0.0)).alias("w_plus"), F.sum(F.when(F.col(diff) < 0, F.col("_r")).otherwise(0.0)).alias("w_minus"), F.count(F.lit(1)).cast("double").alias("n"))
    n = F.col("n")
    z = (F.least("w_plus", "w_minus") - n * (n + 1) / 4) / F.sqrt(n * (n + 1) * (2 * n + 1) / 24)
    return g.withColumn("z", z).withColumn("p", two_sided_normal_p(F.col("z")) / 2)


def permutation_p(df: DataFrame, case: str, y: str, value: str, permutations: int) -> DataFrame:
    """Difference of class means against labels permuted by hash order: (share of |permuted| >= |observed|).

    Each permutation is a hash order of all cases cut at the number of positives. Counts by cells of
    the hash find the cut, and only the cell on the edge is sorted. One row; both values are null
    without cases or with one class only.
    """
    from .folds import hashed_number
    from .order import lowest

    own = df.filter(F.col(value).isNotNull() & F.col(y).isNotNull()).select(case, y, value)
    totals = own.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) > 0).alias("k"), F.sum(value).alias("s"), F.sum(F.when(F.col(y) > 0, F.col(value))).alias("sp")).first()
    n, k, s, sp = totals
    if not k or k == n:
        return df.sparkSession.createDataFrame([(None, None)], "observed double, p double")
    observed = sp / k - (s - sp) / (n - k)
    drawn = own.withColumn("perm", F.explode(F.sequence(F.lit(1), F.lit(permutations)))).withColumn("_h", hashed_number(case, F.col("perm")))
    whole, edge = lowest(drawn, ["perm"], "_h", F.lit(k), case, value)
    sums = whole.unionByName(edge).groupBy("perm").agg(F.sum("total").alias("t"))
    gap = F.col("t") / k - (s - F.col("t")) / (n - k)
    return sums.agg(F.lit(observed).alias("observed"), (F.count_if(F.abs(gap) >= abs(observed)) / F.count(F.lit(1))).alias("p"))


def wilcoxon_exact(df: DataFrame, diff: str) -> DataFrame:
    """w_plus, w_minus, n and the exact two-sided p of the signed-rank test, for up to EXACT non-zero differences (null beyond).

    The null distribution counts the sign patterns of the ranks 1 to n by their sum.
    """
    w = wilcoxon(df, diff)

    def ways(n: int) -> list[int]:
        out = [1]
        for k in range(1, n + 1):
            out = [(out[i] if i < len(out) else 0) + (out[i - k] if 0 <= i - k < len(out) else 0) for i in range(len(out) + k)]
        return out

    p = F.lit(None).cast("double")
    for n in range(1, EXACT + 1):
        table = [sum(ways(n)[: i + 1]) / 2**n for i in range(n * (n + 1) // 2 + 1)]
        at = F.floor(F.least("w_plus", "w_minus")).cast("int")
        p = F.when(F.col("n") == n, F.least(F.lit(1.0), 2 * F.get(F.array(*[F.lit(x) for x in table]), at))).otherwise(p)
    return w.select("w_plus", "w_minus", "n", p.alias("p"))


#: Differences up to which the signed-rank test is exact.
EXACT = 15


def liddell(df: DataFrame, a: str, b: str, part: list[str]) -> DataFrame:
    """Exact test of paired proportions: F, two-sided p and the ratio of the discordant counts, by part.

    With r the greater and s the lesser count, F = r / (s + 1), and p is twice the binomial chance of r
    or more out of r + s, 1 at most.
    """
    g = mcnemar(df, a, b, part)
    r, s = F.greatest("only_a", "only_b"), F.least("only_a", "only_b")
    n = (r + s).cast("int")
    # terms from r to n of the binomial: log-gamma by a running sum of logarithms
    logs = F.aggregate(F.sequence(F.lit(0), n), F.array(F.lit(0.0)), lambda t, i: F.when(i == 0, t).otherwise(F.concat(t, F.array(F.element_at(t, -1) + F.log(i.cast("double"))))))
    own = g.withColumn("_l", logs).withColumn("_n", n).withColumn("_r", r.cast("int"))
    tail = F.aggregate(F.sequence(F.col("_r"), F.col("_n")), F.lit(0.0), lambda t, i: t + F.exp(F.get("_l", F.col("_n")) - F.get("_l", i) - F.get("_l", F.col("_n") - i) - F.col("_n") * F.log(F.lit(2.0))))
    return own.select(*part, "only_a", "only_b", (r / (s + 1)).alias("f"), F.least(F.lit(1.0), 2 * tail).alias("p"), F.when(F.col("only_b") > 0, F.col("only_a") / F.col("only_b")).alias("ratio"))


def compare_classifiers(df: DataFrame, case: str, classifier: str, correct: str) -> DataFrame:
    """Every pair of classifiers (a < b) over the cases both have judged: McNemar's chi square and p."""
    left = df.select(F.col(case).alias("_c"), F.col(classifier).alias("a"), F.col(correct).alias("ra"))
    right = df.select(F.col(case).alias("_d"), F.col(classifier).alias("b"), F.col(correct).alias("rb"))
    pairs = left.join(right, F.col("_c") == F.col("_d")).filter("a < b")  # classifiers squared a case
    return mcnemar(pairs, "ra", "rb", ["a", "b"])


def consistency_p(df: DataFrame, feature: str, weight: str, two_sided: bool = False) -> DataFrame:
    """Sign consistency of each feature's weights over models, its z over the features, p and adjusted p.

    consistency: |share of positive less negative signs| x share of present weights (two-sided: signed mean x
    share of present weights); z = consistency / spread of it over features; p one- or two-sided.
    """
    own = df.groupBy(feature).agg(F.avg(F.signum(weight)).alias("_s"), F.avg(weight).alias("_m"), (F.count(weight) / F.count(F.lit(1))).alias("_n"))
    own = own.select(feature, ((F.col("_m") if two_sided else F.abs("_s")) * F.col("_n")).alias("consistency"))
    spread = own.agg(F.stddev_samp("consistency").alias("_sd"))
    own = own.crossJoin(F.broadcast(spread)).withColumn("z", F.col("consistency") / F.col("_sd"))  # one row
    p = two_sided_normal_p(F.col("z")) if two_sided else F.when(F.col("z") >= 0, two_sided_normal_p(F.col("z")) / 2).otherwise(1 - two_sided_normal_p(F.col("z")) / 2)
    return fdr(own.withColumn("p", p).select(feature, "consistency", "z", "p"), feature)


def kappa_test(df: DataFrame, part: list[str], tp: str = "tp", tn: str = "tn", fp: str = "fp", fn: str = "fn") -> DataFrame:
    """Cohen's kappa of a 2 x 2 table, its standard error under independence, z and two-sided p."""
    tp_, tn_, fp_, fn_ = (F.col(c).cast("double") for c in (tp, tn, fp, fn))
    n = tp_ + tn_ + fp_ + fn_
    po = (tp_ + tn_) / n
    r1, c1 = (tp_ + fp_) / n, (tp_ + fn_) / n
    pe = r1 * c1 + (1 - r1) * (1 - c1)
    both = r1 * c1 * (r1 + c1) + (1 - r1) * (1 - c1) * (2 - r1 - c1)
    se = F.sqrt((pe + pe * pe - both) / (n * (1 - pe) * (1 - pe)))
    out = df.select(*part, ((po - pe) / (1 - pe)).alias("kappa"), se.alias("se"))
    out = out.withColumn("z", F.col("kappa") / F.col("se"))
    return out.withColumn("p", two_sided_normal_p(F.col("z")))


def harmonic(m: int) -> float:
    return math.fsum(1 / k for k in range(1, m + 1))
