"""Queries over the further steps, decoding variants, interpretation and simulation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import interpret, more_prep, prep, select, tuning
from ..sources.tables import CASES_SQL, SCORES_SQL, array_to_long, cases, cases_long, scores, table

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


R = lambda c, n=6: F.round(c, n) + 0.0


def _q(p: float) -> str:
    return f"(SELECT l.value + (u.value - l.value) * (a.pos - floor(a.pos)) FROM (SELECT greatest(1.0::DOUBLE, least(max(n)::DOUBLE, max(n) * {p} / 100 + 0.5)) AS pos FROM q WHERE feat = f.feat) a, q l, q u WHERE l.feat = f.feat AND u.feat = f.feat AND l.r = floor(a.pos) AND u.r = ceil(a.pos))"


@query("agg_inspector", f"""WITH {CASES_SQL}, q AS (SELECT feat, value, row_number() OVER (PARTITION BY feat ORDER BY value) AS r, count(*) OVER (PARTITION BY feat) AS n FROM long WHERE value IS NOT NULL), f AS (SELECT DISTINCT feat FROM long),
  c AS (SELECT feat, value, count(*) AS n FROM long GROUP BY ALL), s AS (SELECT feat, max(n) FILTER (value IS NOT NULL) * 100.0::DOUBLE / sum(n) AS i, coalesce(sum(n) FILTER (value IS NULL), 0) * 100.0::DOUBLE / sum(n) AS m FROM c GROUP BY feat)
  SELECT f.feat, round(mean, 6) + 0 AS mean, round({_q(50)}, 6) + 0 AS median, round(variance, 5) + 0 AS variance, round({_q(75)} - {_q(25)}, 6) + 0 AS iqr, round(i, 6) + 0 AS percent_identical, round(m, 6) + 0 AS percent_missing FROM f JOIN s USING (feat) JOIN (SELECT feat, avg(value) AS mean, var_samp(value) AS variance FROM long GROUP BY feat) USING (feat)""")
def _(spark, sf):
    i = more_prep.inspector(cases_long(spark, sf), ["feat"])
    return i.select("feat", *[R(c, 5 if c == "variance" else 6).alias(c) for c in ("mean", "median", "variance", "iqr", "percent_identical", "percent_missing")])


@query("prep_zero_out", f"WITH {CASES_SQL} SELECT case_id, feat, CASE WHEN feat = 'x2' THEN 0 ELSE value END AS value FROM long")
def _(spark, sf):
    long = cases_long(spark, sf).select("case_id", "feat", F.when(F.col("feat") != "x2", F.col("value")).alias("value"))
    return more_prep.zero_out(long)


@query("prep_rank_transform", f"""WITH {CASES_SQL}, u AS (SELECT value, count(*) FILTER (case_id % 2 = 0) AS n FROM long WHERE feat = 'x3' GROUP BY value),
  r AS (SELECT value, (sum(n) OVER (ORDER BY value) - 0.5::DOUBLE * n) / sum(n) OVER () AS v FROM u) SELECT case_id, feat, round(v, 6) AS value FROM long JOIN r USING (value) WHERE feat = 'x3' AND case_id % 2 = 1""")
def _(spark, sf):
    long = cases_long(spark, sf).filter("feat = 'x3'").select("case_id", "feat", "value")
    r = more_prep.rank_transform(long.filter("case_id % 2 = 0"), long.filter("case_id % 2 = 1"), ["feat"])
    return r.select("case_id", "feat", R("value").alias("value"))


@query("dummy_first_seen", "SELECT p_brand, row_number() OVER (ORDER BY f) AS code FROM (SELECT p_brand, min(p_partkey) AS f FROM part GROUP BY p_brand)")
def _(spark, sf):
    return more_prep.first_seen_codes(table(spark, sf, "part"), "p_partkey", "p_brand")


@query("shape_padded", "SELECT user_id, a[1] AS v1, a[2] AS v2, a[3] AS v3 FROM (SELECT user_id, list(value ORDER BY event_id) AS a FROM events GROUP BY user_id)")
def _(spark, sf):
    e = table(spark, sf, "events").groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda s: s["value"]).alias("a"))
    return e.select("user_id", *[F.get(more_prep.padded(F.col("a"), 3), F.lit(i)).alias(f"v{i + 1}") for i in range(3)])


@query("shape_independent_set", "SELECT vec_id, CASE WHEN vec_id % 5 = 0 THEN 'independent' ELSE 'discovery' END AS dataset_id FROM embeddings")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id")
    out = e.filter("vec_id % 5 = 0")
    return e.join(out, "vec_id", "left_anti").withColumn("dataset_id", F.lit("discovery")).unionByName(out.withColumn("dataset_id", F.lit("independent")))


@query("check_label", "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def _(spark, sf):
    return more_prep.label_counts(table(spark, sf, "orders"), "o_orderstatus", "classification")


@query("permute_in_strata", f"""WITH {CASES_SQL}, a AS (SELECT case_id, cls, row_number() OVER (PARTITION BY cls ORDER BY case_id) AS p FROM cases), b AS (SELECT case_id AS taken, cls, row_number() OVER (PARTITION BY cls ORDER BY md5(case_id::VARCHAR || ':3')) AS p FROM cases) SELECT case_id, cls, taken FROM a JOIN b USING (cls, p)""")
def _(spark, sf):
    return more_prep.strat_permutation(cases(spark, sf), "case_id", "cls", 3)


@query("impute_labels")
def _(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("label", F.when(F.col("vec_id") % 10 != 0, F.col("label")))
    return more_prep.label_impute(e, "vec_id", "embedding", "label", 5)


@query("prep_symbol_bins", f"""WITH {CASES_SQL}, p AS (SELECT feat, avg(value) AS centre, stddev_samp(value) AS sd FROM long WHERE feat IN ('x1', 'x3') GROUP BY feat),
  s AS (SELECT case_id, feat, b, greatest(0, least(b - 1, CAST(floor((value - (centre - 2 * sd)) / (4 * sd) * b) AS BIGINT))) AS s FROM long JOIN p USING (feat), (SELECT unnest(range(2, 7)) AS b) WHERE value IS NOT NULL),
  w AS (SELECT feat, b, s || '-' || lead(s) OVER (PARTITION BY feat, b ORDER BY case_id) AS w FROM s), c AS (SELECT feat, b, w, count(*)::DOUBLE AS n FROM w WHERE w IS NOT NULL GROUP BY ALL),
  e AS (SELECT feat, b, log2(sum(n)) - sum(n * log2(n)) / sum(n) AS e FROM c GROUP BY ALL) SELECT feat, CAST(min(b) AS INT) AS bins FROM (SELECT *, max(e) OVER (PARTITION BY feat) AS t FROM e) WHERE e >= 0.99 * t GROUP BY feat""")
def _(spark, sf):
    long = cases_long(spark, sf).filter("feat in ('x1', 'x3')").select("case_id", "feat", "value")
    return more_prep.symbol_bins(more_prep.symbol_entropies(long, prep.fit_standard(long, ["feat"]), "case_id", 2, 6, 2.0, 2))


@query("project_discriminant")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    mean, basis = more_prep.discriminant(e, "embedding", "label", 2)
    s = more_prep.projected(e, "vec_id", "embedding", mean, basis)
    return s.select("vec_id", R(F.col("scores")[0], 4).alias("d1"), R(F.col("scores")[1], 4).alias("d2"))


@query("stat_mahalanobis")
def _(spark, sf):
    return more_prep.mahalanobis(table(spark, sf, "embeddings"), "vec_id", "embedding").select("vec_id", R("d2", 4).alias("d2"))


@query("prep_without_components")
def _(spark, sf):
    return more_prep.without_components(table(spark, sf, "embeddings"), "vec_id", "embedding", "label", 0.1)


@query("curve_knee")
def _(spark, sf):
    return more_prep.knee(spark.createDataFrame([(i, min(i, 5) + 0.1 * max(0, i - 5)) for i in range(20)], "x int, y double"), "x", "y")


@query("grid_percentile_nodes", f"WITH {SCORES_SQL}, g AS (SELECT learner, avg(CAST(score * y > 0 AS INT)) AS perf FROM scores GROUP BY learner), r AS (SELECT perf, row_number() OVER (ORDER BY perf) AS r FROM g) SELECT learner FROM g WHERE perf >= (SELECT a.perf + 0.5 * (b.perf - a.perf) FROM r a, r b WHERE a.r = 4 AND b.r = 4)")
def _(spark, sf):
    g = scores(spark, sf).groupBy("learner").agg(F.avg((F.col("score") * F.col("y") > 0).cast("int")).alias("perf"))
    return tuning.percentile_nodes(g, "perf", 70).select("learner")


@query("rank_repeats", "SELECT p_partkey, dense_rank() OVER (PARTITION BY p_brand ORDER BY p_size) AS r FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", F.dense_rank().over(Window.partitionBy("p_brand").orderBy("p_size")).cast("long").alias("r"))


# ---- decoding, interpretation
_DAG = "d AS (SELECT case_id, max(score) FILTER (learner = 1) AS ab, max(score) FILTER (learner = 2) AS ac, max(score) FILTER (learner = 3) AS bc FROM scores GROUP BY case_id)"


@query("ens_decision_graph", f"WITH {SCORES_SQL}, {_DAG} SELECT case_id, CASE WHEN ac > 0 THEN CASE WHEN ab > 0 THEN 'A' ELSE 'B' END ELSE CASE WHEN bc > 0 THEN 'B' ELSE 'C' END END AS cls FROM d")
def _(spark, sf):
    return interpret.decision_graph(scores(spark, sf), "case_id", {("A", "B"): 1, ("A", "C"): 2, ("B", "C"): 3}, ["A", "B", "C"])


@query("interpret_perturbation", f"""WITH {CASES_SQL}, m AS (SELECT median(x2) AS m2, median(x3) AS m3 FROM cases), s AS (SELECT case_id, x2, x3, 0.3::DOUBLE * x2 - 0.2::DOUBLE * x3 AS s FROM cases WHERE x2 IS NOT NULL), r AS (SELECT max(s) - min(s) AS r FROM s)
  SELECT case_id, round((0.3::DOUBLE * m2 - 0.2::DOUBLE * x3 - s) * 100 / r, 6) + 0 AS x2, round((0.3::DOUBLE * x2 - 0.2::DOUBLE * m3 - s) * 100 / r, 6) + 0 AS x3 FROM s, m, r""")
def _(spark, sf):
    c = cases(spark, sf)
    r = interpret.median_relevance(c, "case_id", {"x2": 0.3, "x3": -0.2})
    return r.select("case_id", R("x2").alias("x2"), R("x3").alias("x3"))


@query("interpret_shapley", f"WITH {CASES_SQL}, m AS (SELECT avg(x2) AS m2, avg(x3) AS m3 FROM cases WHERE x2 IS NOT NULL) SELECT case_id, round(0.3::DOUBLE * (x2 - m2), 6) + 0 AS x2, round(-0.2::DOUBLE * (x3 - m3), 6) + 0 AS x3 FROM cases, m WHERE x2 IS NOT NULL")
def _(spark, sf):
    r = interpret.linear_shapley(cases(spark, sf), "case_id", {"x2": 0.3, "x3": -0.2})
    return r.select("case_id", R("x2").alias("x2"), R("x3").alias("x3"))


@query("simulate_neighbours")
def _(spark, sf):
    return interpret.interpolated(table(spark, sf, "embeddings"), "vec_id", "embedding", 5)


@query("graph_degree", "WITH e AS (SELECT o_custkey % 40 AS a, o_orderkey % 40 AS b, count(*)::DOUBLE AS w FROM orders WHERE o_custkey % 40 <> o_orderkey % 40 GROUP BY ALL), u AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e) SELECT a AS node, count(DISTINCT b) AS degree, sum(w) AS strength FROM u GROUP BY a")
def _(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b")).filter("a <> b")
    return interpret.degrees(o.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w")))


@query("graph_pagerank")
def _(spark, sf):
    o = table(spark, sf, "orders").select((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b")).filter("a <> b")
    return interpret.pagerank(o.groupBy("a", "b").agg(F.count(F.lit(1)).cast("double").alias("w"))).select("node", R("rank", 5).alias("rank"))


@query("graph_strongest", "WITH e AS (SELECT o_custkey % 40 AS a, o_orderkey % 40 AS b, count(*)::DOUBLE AS w FROM orders GROUP BY ALL) SELECT a, b, w FROM (SELECT *, percent_rank() OVER (ORDER BY w DESC) AS p FROM e) WHERE p < 0.1")
def _(spark, sf):
    o = table(spark, sf, "orders").groupBy((F.col("o_custkey") % 40).alias("a"), (F.col("o_orderkey") % 40).alias("b")).agg(F.count(F.lit(1)).cast("double").alias("w"))
    return interpret.strongest(o, 0.1)


# ---- step by step selection
def _feast(criterion: str):
    def run(spark, sf):
        e = array_to_long(table(spark, sf, "embeddings").withColumn("embedding", F.slice("embedding", 1, 8)), "vec_id", "embedding", ("label",))
        d = e.select(F.col("vec_id").alias("case_id"), F.col("label").alias("cls"), F.concat(F.lit("e"), "feat").alias("feat"), F.floor(F.col("value") * 8).cast("double").alias("value"))
        relevance, pairs = select.information_tables(d, "case_id", "cls")
        return spark.createDataFrame(list(enumerate(select.by_information(relevance, pairs, 3, criterion), 1)), "place int, feat string")

    return run


for _criterion in select.CRITERIA:
    query(f"select_{_criterion}")(_feast(_criterion))


def _auc_of(learners: str) -> str:
    return f"""SELECT '{learners}' AS s, (sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y > 0) * count(*) FILTER (y < 0)) AS auc
      FROM (SELECT y, rank() OVER (ORDER BY v) + (count(*) OVER (PARTITION BY v) - 1) / 2.0::DOUBLE AS r FROM (SELECT y, round(sum(score), 9)::FLOAT AS v FROM scores WHERE learner IN ({learners}) GROUP BY case_id, y))"""


_ONE = " UNION ALL ".join(_auc_of(str(k)) for k in range(1, 6))


@query("wrap_forward_first", f"WITH {SCORES_SQL}, a AS ({_ONE}) SELECT CAST(s AS BIGINT) AS learner, round(auc, 6) AS auc FROM a ORDER BY round(auc, 9) DESC, s LIMIT 1")
def _(spark, sf):
    found = select.forward(scores(spark, sf), "case_id", "learner", "score", "y", 1)
    return spark.createDataFrame(found, "learner long, auc double").withColumn("auc", R("auc"))


@query("wrap_forward")
def _(spark, sf):
    found = select.forward(scores(spark, sf), "case_id", "learner", "score", "y", 3)
    return spark.createDataFrame([(i + 1, int(x), float(a)) for i, (x, a) in enumerate(found)], "place int, learner long, auc double")


_FOUR = " UNION ALL ".join(_auc_of(", ".join(str(j) for j in range(1, 6) if j != k)) for k in range(1, 6))


@query("wrap_backward_first", f"WITH {SCORES_SQL}, a AS ({_FOUR}), b AS (SELECT s FROM a ORDER BY round(auc, 9) DESC, s DESC LIMIT 1) SELECT CAST(unnest(string_split(s, ', ')) AS BIGINT) AS learner FROM b")
def _(spark, sf):
    return spark.createDataFrame([(x,) for x in select.backward(scores(spark, sf), "case_id", "learner", "score", "y", 4)], "learner long")


# ---- time windows
@query("monitor_windows", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, count(*) FILTER (event_type = 'error') AS n_hit, round(avg(value), 6) AS mean FROM events GROUP BY 1")
def _(spark, sf):
    from ..streaming import monitor

    e = table(spark, sf, "events").withColumn("hit", F.col("event_type") == "error")
    return monitor.window_counts(e, "ts", "hit", "value").select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", "n_hit", R("mean").alias("mean"))


@query("monitor_sessions", """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 2 HOUR THEN 0 ELSE 1 END AS new FROM events), s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM g) SELECT user_id, count(*) AS n FROM s GROUP BY user_id, k""")
def _(spark, sf):
    from ..streaming import monitor

    return monitor.sessions(table(spark, sf, "events"), "ts", "user_id", "2 hours").select("user_id", "n")
