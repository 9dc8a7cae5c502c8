"""Queries over matching, aggregates, ranks and windows."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..operators import match, order, stats
from ..sources.tables import CASES_SQL, FEATURES, SCORES_SQL, cases, cases_long, scores, table, to_long

QUERIES = {}
ORACLES = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


R = lambda c, n=6: F.round(c, n)


def _sides(spark, sf):
    a = table(spark, sf, "documents").select(F.concat(F.lit(" "), F.col("doc_id").cast("string")).alias("id"), F.col("doc_id").alias("a"), "source")
    b = table(spark, sf, "labels").select(F.concat(F.col("doc_id").cast("string"), F.lit("  ")).alias("id"), F.col("doc_id").alias("b"), "quality")
    return match.keyed(a, "id", "a").select("key", "source"), match.keyed(b, "id", "b").select("key", "quality")


@query("match_intersect", "SELECT CAST(d.doc_id AS VARCHAR) AS key, source, quality FROM documents d JOIN labels l USING (doc_id)")
def _(spark, sf):
    a, b = _sides(spark, sf)
    return match.intersect(a, b)


@query("match_left_gaps", "SELECT CAST(d.doc_id AS VARCHAR) AS key, source, quality FROM documents d LEFT JOIN labels l USING (doc_id)")
def _(spark, sf):
    a, b = _sides(spark, sf)
    return match.left_with_gaps(a, b)


@query("match_anti_src", "SELECT CAST(doc_id AS VARCHAR) AS key, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(spark, sf):
    a, b = _sides(spark, sf)
    return match.source_only(a, b)


@query("match_anti_dst", "SELECT CAST(doc_id AS VARCHAR) AS key, quality FROM labels WHERE doc_id + 500 NOT IN (SELECT doc_id FROM documents)")
def _(spark, sf):
    a = table(spark, sf, "documents").select((F.col("doc_id") - 500).cast("string").alias("key"))
    _, b = _sides(spark, sf)
    return match.source_only(b, a)


@query("match_substring", """SELECT p.p_partkey::VARCHAR AS a_id, s.s_suppkey::VARCHAR AS b_id FROM part p JOIN supplier s
  ON contains(p.p_partkey::VARCHAR, s.s_suppkey::VARCHAR) OR contains(s.s_suppkey::VARCHAR, p.p_partkey::VARCHAR)""")
def _(spark, sf):
    a = table(spark, sf, "part").select(F.col("p_partkey").cast("string").alias("a_id"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").cast("string").alias("b_id"))
    return match.substring_match(a, "a_id", b, "b_id")


@query("match_aligned", "SELECT c_custkey, s_acctbal FROM customer LEFT JOIN (SELECT s_suppkey, s_acctbal FROM supplier) ON c_custkey = s_suppkey")
def _(spark, sf):
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("c_custkey"), "s_name", "s_acctbal")
    return match.aligned(s, table(spark, sf, "customer"), "c_custkey", ["s_acctbal"])


@query("match_list_difference", """SELECT id, 'first' AS side FROM (SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels))
  UNION ALL SELECT doc_id, 'second' FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents)""")
def _(spark, sf):
    return match.list_difference(table(spark, sf, "documents").select(F.col("doc_id").alias("id")), table(spark, sf, "labels").select(F.col("doc_id").alias("id")))


@query("match_union_gaps", "SELECT c_custkey AS id, c_acctbal AS bal, c_mktsegment AS seg FROM customer UNION ALL SELECT s_suppkey, s_acctbal, NULL FROM supplier")
def _(spark, sf):
    a = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").alias("bal"), F.col("c_mktsegment").alias("seg"))
    b = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("id"), F.col("s_acctbal").alias("bal"))
    return a.unionByName(b, allowMissingColumns=True)


@query("match_set_intersection", "SELECT doc_id FROM documents INTERSECT SELECT doc_id FROM labels")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id").intersect(table(spark, sf, "labels").select("doc_id"))


@query("match_membership", "SELECT doc_id, doc_id IN (SELECT doc_id FROM labels) AS included FROM documents")
def _(spark, sf):
    a, b = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select(F.col("doc_id").alias("_id")).distinct()
    return a.join(b, a.doc_id == F.col("_id"), "left").select("doc_id", F.col("_id").isNotNull().alias("included"))


@query("grid_product", "SELECT c, g, k FROM (SELECT unnest([0.1::DOUBLE, 1.0, 10.0]) AS c), (SELECT unnest(['lin', 'rbf']) AS k), (SELECT unnest([1::BIGINT, 2]) AS g)")
def _(spark, sf):
    return match.product({"c": [0.1, 1.0, 10.0], "k": ["lin", "rbf"], "g": [1, 2]}, spark)


@query("grid_combinations", "SELECT a.n_nationkey AS c1, b.n_nationkey AS c2, c.n_nationkey AS c3 FROM nation a, nation b, nation c WHERE a.n_nationkey < b.n_nationkey AND b.n_nationkey < c.n_nationkey")
def _(spark, sf):
    return match.combinations(table(spark, sf, "nation"), "n_nationkey", 3)


@query("fusion_early", "SELECT doc_id, n_chars, quality, toxic FROM documents JOIN labels USING (doc_id)")
def _(spark, sf):
    return table(spark, sf, "documents").select("doc_id", "n_chars").join(table(spark, sf, "labels"), "doc_id")


@query("fusion_late", f"WITH {SCORES_SQL} SELECT case_id, round(avg(score), 6) AS bagged FROM (SELECT case_id, score FROM scores WHERE learner = 1 UNION ALL SELECT case_id, score FROM scores WHERE learner = 2) GROUP BY case_id")
def _(spark, sf):
    s = scores(spark, sf)
    one, two = s.filter("learner = 1").select("case_id", "score"), s.filter("learner = 2").select("case_id", "score")
    return one.unionByName(two).groupBy("case_id").agg(R(F.avg("score")).alias("bagged"))


# ---- projection, filters, reshaping
@query("shape_long", f"WITH {CASES_SQL} SELECT case_id, feat, value FROM long")
def _(spark, sf):
    return to_long(cases(spark, sf), "case_id", FEATURES)


@query("shape_wide", f"WITH {CASES_SQL} SELECT case_id, x1, x2, x3, x4 FROM cases")
def _(spark, sf):
    from ..sources.tables import to_wide

    return to_wide(to_long(cases(spark, sf), "case_id", FEATURES), "case_id", FEATURES)


@query("shape_insert_row", "SELECT r_regionkey::INT AS k, r_name AS n FROM region UNION ALL SELECT 99, NULL")
def _(spark, sf):
    rows = table(spark, sf, "region").select(F.col("r_regionkey").cast("int").alias("k"), F.col("r_name").alias("n"))
    return rows.unionByName(spark.createDataFrame([(99,)], "k int"), allowMissingColumns=True)


@query("shape_set_row", "SELECT n_nationkey, CASE WHEN n_nationkey = 3 THEN 'X' ELSE n_name END AS n_name FROM nation")
def _(spark, sf):
    return table(spark, sf, "nation").select("n_nationkey", F.when(F.col("n_nationkey") == 3, "X").otherwise(F.col("n_name")).alias("n_name"))


@query("shape_find_row", "SELECT p_partkey FROM part WHERE p_size IS NOT DISTINCT FROM 11 AND p_brand IS NOT DISTINCT FROM 'Brand#2'")
def _(spark, sf):
    return table(spark, sf, "part").filter(F.col("p_size").eqNullSafe(11) & F.col("p_brand").eqNullSafe("Brand#2")).select("p_partkey")


@query("shape_distinct_rows", "SELECT p_brand, p_type, min(p_partkey) AS first_row FROM part GROUP BY p_brand, p_type")
def _(spark, sf):
    return table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.min("p_partkey").alias("first_row"))


@query("nan_prune_all", f"WITH {CASES_SQL} SELECT case_id FROM cases WHERE x1 IS NOT NULL OR x2 IS NOT NULL")
def _(spark, sf):
    return cases(spark, sf).na.drop("all", subset=["x1", "x2"]).select("case_id")


@query("nan_prune_any", f"WITH {CASES_SQL} SELECT case_id FROM cases WHERE x1 IS NOT NULL AND x2 IS NOT NULL")
def _(spark, sf):
    return cases(spark, sf).na.drop("any", subset=["x1", "x2"]).select("case_id")


@query("nan_reinsert", f"WITH {CASES_SQL} SELECT a.case_id, b.x1 FROM cases a LEFT JOIN (SELECT case_id, x1 FROM cases WHERE x1 IS NOT NULL AND x2 IS NOT NULL) b USING (case_id)")
def _(spark, sf):
    c = cases(spark, sf)
    return c.select("case_id").join(c.na.drop("any", subset=["x1", "x2"]).select("case_id", "x1"), "case_id", "left")


@query("nan_report", f"WITH {CASES_SQL} SELECT feat, count(*) AS n, count(*) - count(value) AS n_missing, round((count(*) - count(value)) * 100.0::DOUBLE / count(*), 6) AS percent_missing FROM long GROUP BY feat")
def _(spark, sf):
    return stats.missing_report(cases_long(spark, sf), ["feat"], "value").withColumn("percent_missing", R("percent_missing"))


@query("dummy_scope", "SELECT c_custkey, " + ", ".join(f"CAST(c_mktsegment = '{s}' AS INT) AS d_{s}" for s in ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")) + " FROM customer")
def _(spark, sf):
    from ..operators.prep import dummies

    return dummies(table(spark, sf, "customer"), "c_custkey", "c_mktsegment")


# ---- aggregates
@query("agg_moments", f"""WITH {CASES_SQL}, m AS (SELECT feat, count(value) AS n, avg(value) AS mean, stddev_samp(value) AS sd FROM long GROUP BY feat)
  SELECT feat, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(s3 / (n - 1) / sd ** 3, 5) AS skewness, round(s4 / (n - 1) / sd ** 4 - 3, 5) AS kurtosis
  FROM m JOIN (SELECT feat, sum((value - mean) ** 3) AS s3, sum((value - mean) ** 4) AS s4 FROM long JOIN m USING (feat) GROUP BY feat) USING (feat) WHERE sd > 0""")
def _(spark, sf):
    m = stats.moments(cases_long(spark, sf), ["feat"], "value").filter("sd > 0")
    return m.select("feat", "n", R("mean").alias("mean"), R("sd").alias("sd"), R("skewness", 5).alias("skewness"), R("kurtosis", 5).alias("kurtosis"))


@query("agg_weighted_mean", f"WITH {CASES_SQL} SELECT grp, round(sum(x1 * x3) / sum(x3), 6) AS wmean FROM cases WHERE x1 IS NOT NULL GROUP BY grp")
def _(spark, sf):
    return stats.weighted_mean(cases(spark, sf), ["grp"], "x1", "x3").withColumn("wmean", R("wmean"))


_HAZEN = """q AS (SELECT feat, value, row_number() OVER (PARTITION BY feat ORDER BY value) AS r, count(*) OVER (PARTITION BY feat) AS n FROM long WHERE value IS NOT NULL),
  a AS (SELECT feat, n, p, greatest(1.0::DOUBLE, least(n::DOUBLE, n * p / 100 + 0.5)) AS pos FROM (SELECT DISTINCT feat, n FROM q), (SELECT unnest([2.5::DOUBLE, 25, 50, 75, 97.5]) AS p)),
  h AS (SELECT a.feat, p, l.value + (u.value - l.value) * (pos - floor(pos)) AS v FROM a JOIN q l ON l.feat = a.feat AND l.r = floor(pos) JOIN q u ON u.feat = a.feat AND u.r = ceil(pos))"""


@query("agg_hazen", f"WITH {CASES_SQL}, {_HAZEN} SELECT feat, " + ", ".join(f"round(max(v) FILTER (p = {p}), 6) AS p{str(p).replace('.', '_')}" for p in (2.5, 25, 50, 75, 97.5)) + " FROM h GROUP BY feat")
def _(spark, sf):
    h = order.hazen(cases_long(spark, sf), ["feat"], "value", [2.5, 25, 50, 75, 97.5])
    return h.select("feat", *[R(c).alias(c) for c in h.columns if c != "feat"])


@query("agg_median", f"WITH {CASES_SQL} SELECT grp, feat, round(median(value), 6) AS median FROM long GROUP BY grp, feat")
def _(spark, sf):
    return order.medians(cases_long(spark, sf), ["grp", "feat"], "value").withColumn("median", R("median"))


@query("agg_unique_counts", f"WITH {CASES_SQL}, c AS (SELECT feat, value, count(*) AS n FROM long WHERE value IS NOT NULL GROUP BY ALL) SELECT feat, count(*) AS n_values, round(max(n) * 100.0::DOUBLE / sum(n), 6) AS top_percent, max(n) * 100.0::DOUBLE / sum(n) >= 90 AS flagged FROM c GROUP BY feat")
def _(spark, sf):
    return stats.value_counts(cases_long(spark, sf), ["feat"], "value", 90).withColumn("top_percent", R("top_percent"))


@query("agg_group_means", f"WITH {CASES_SQL} SELECT site, feat, round(avg(value), 6) AS mean, count(value) AS n FROM long GROUP BY site, feat")
def _(spark, sf):
    return cases_long(spark, sf).groupBy("site", "feat").agg(R(F.avg("value")).alias("mean"), F.count("value").alias("n"))


@query("agg_region_means", "SELECT vec_id, CAST(floor((i - 1) / 8) AS INT) AS roi, round(avg(v::DOUBLE), 6) AS mean FROM (SELECT vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY ALL")
def _(spark, sf):
    from ..sources.tables import array_to_long

    long = array_to_long(table(spark, sf, "embeddings"), "vec_id", "embedding")
    return long.groupBy("vec_id", F.floor((F.col("feat") - 1) / 8).cast("int").alias("roi")).agg(R(F.avg("value")).alias("mean"))


@query("agg_cvr", f"WITH {SCORES_SQL} SELECT learner, round(avg(score) / (1.96::DOUBLE * stddev_pop(score) / sqrt(count(score))), 5) AS cvr FROM scores GROUP BY learner")
def _(spark, sf):
    return stats.cross_validation_ratio(scores(spark, sf), ["learner"], "score").withColumn("cvr", R("cvr", 5))


def _h(names: str) -> str:
    return f"(SELECT log2(sum(n)) - sum(n * log2(n)) / sum(n) FROM (SELECT count(*)::DOUBLE AS n FROM g GROUP BY {names}))"


@query("info_mi", f"WITH {CASES_SQL}, g AS (SELECT cls AS x, grp AS y, site % 3 AS z FROM cases), h AS (SELECT {_h('x')} AS hx, {_h('y')} AS hy, {_h('x, y')} AS hxy, {_h('z')} AS hz, {_h('x, z')} AS hxz, {_h('y, z')} AS hyz, {_h('x, y, z')} AS hxyz) SELECT round(hx, 6) AS h_x, round(hy, 6) AS h_y, round(hxy, 6) AS h_xy, round(hxy - hy, 6) AS h_x_given_y, round(hx + hy - hxy, 6) + 0 AS mi, round(hxz + hyz - hxyz - hz, 6) + 0 AS cmi FROM h")
def _(spark, sf):
    g = cases(spark, sf).select(F.col("cls").alias("x"), F.col("grp").alias("y"), (F.col("site") % 3).alias("z"))
    i = stats.information(g, "x", "y", "z")
    return i.select(*[(R(c) + 0.0).alias(c) for c in i.columns])


@query("agg_inverse_percentile", f"""WITH {CASES_SQL}, u AS (SELECT feat, value, count(*) FILTER (case_id % 2 = 0) AS n FROM long WHERE value IS NOT NULL AND feat IN ('x1', 'x2') GROUP BY feat, value),
  r AS (SELECT feat, value, (sum(n) OVER (PARTITION BY feat ORDER BY value) - 0.5::DOUBLE * n) * 100 / sum(n) OVER (PARTITION BY feat) AS percent FROM u)
  SELECT case_id, feat, round(percent, 6) AS percent FROM long JOIN r USING (feat, value) WHERE case_id % 2 = 1""")
def _(spark, sf):
    long = cases_long(spark, sf).filter("value is not null and feat in ('x1', 'x2')").select("case_id", "feat", "value")
    r = stats.inverse_percentile(long.filter("case_id % 2 = 0").select("feat", "value"), long.filter("case_id % 2 = 1"), ["feat"], "value")
    return r.select("case_id", "feat", R("percent").alias("percent"))


# ---- ranks, windows, sampling
@query("rank_tied", f"WITH {CASES_SQL} SELECT case_id, feat, CASE WHEN value IS NOT NULL THEN rank() OVER (PARTITION BY feat, value IS NULL ORDER BY value) + (count(*) OVER (PARTITION BY feat, value) - 1) / 2.0::DOUBLE END AS rank FROM long")
def _(spark, sf):
    return order.tied_rank(cases_long(spark, sf).select("case_id", "feat", "value"), ["feat"], "value").select("case_id", "feat", "rank")


@query("window_moving_mean", "SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 6) AS mean5 FROM events")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-2, 2)
    return table(spark, sf, "events").select("event_id", R(F.avg("value").over(w)).alias("mean5"))


@query("window_sliding_rate", """SELECT event_id, round(e / 5.0::DOUBLE, 6) AS rate, round(m, 6) AS x FROM (SELECT event_id, sum(CAST(event_type = 'error' AS INT)) OVER w AS e, avg(value) OVER w AS m, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY value, event_id ROWS BETWEEN CURRENT ROW AND 5 FOLLOWING)) WHERE n = 6""")
def _(spark, sf):
    w = Window.partitionBy("user_id").orderBy("value", "event_id").rowsBetween(0, 5)
    e = table(spark, sf, "events").select("event_id", F.sum((F.col("event_type") == "error").cast("int")).over(w).alias("e"), F.avg("value").over(w).alias("x"), F.count(F.lit(1)).over(w).alias("n"))
    return e.filter("n = 6").select("event_id", R(F.col("e") / 5).alias("rate"), R("x").alias("x"))


@query("window_energy_cut", "SELECT p_partkey, round(c, 6) AS energy FROM (SELECT p_partkey, sum(p_retailprice) OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS c, sum(p_retailprice) OVER (PARTITION BY p_brand) AS t FROM part) WHERE c <= 0.5::DOUBLE * t")
def _(spark, sf):
    w = Window.partitionBy("p_brand")
    p = table(spark, sf, "part").select("p_partkey", F.sum("p_retailprice").over(w.orderBy(F.col("p_retailprice").desc(), "p_partkey")).alias("c"), F.sum("p_retailprice").over(w).alias("t"))
    return p.filter(F.col("c") <= 0.5 * F.col("t")).select("p_partkey", R("c").alias("energy"))


@query("window_quantile_split", "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS bin FROM customer")
def _(spark, sf):
    w = Window.partitionBy("c_mktsegment").orderBy("c_acctbal", "c_custkey")
    return table(spark, sf, "customer").select("c_custkey", F.ntile(4).over(w).cast("long").alias("bin"))


@query("window_enumerate_duplicates", "SELECT p_partkey, CASE WHEN r = 1 THEN p_name ELSE p_name || '_' || r END AS label FROM (SELECT p_partkey, p_name, row_number() OVER (PARTITION BY p_name ORDER BY p_partkey) AS r FROM part)")
def _(spark, sf):
    r = F.row_number().over(Window.partitionBy("p_name").orderBy("p_partkey"))
    return table(spark, sf, "part").withColumn("r", r).select("p_partkey", F.when(F.col("r") == 1, F.col("p_name")).otherwise(F.concat("p_name", F.lit("_"), F.col("r"))).alias("label"))


@query("sample_without_replacement", "SELECT c_custkey FROM customer ORDER BY md5(c_custkey::VARCHAR || ':42'), c_custkey LIMIT 50")
def _(spark, sf):
    h = F.md5(F.concat(F.col("c_custkey").cast("string"), F.lit(":42")))
    return table(spark, sf, "customer").select("c_custkey").orderBy(h, "c_custkey").limit(50)


@query("top_grid_node", f"WITH {SCORES_SQL}, g AS (SELECT learner, avg(CAST(score * y > 0 AS INT)) * 100 - 0.5::DOUBLE * (learner / 5.0::DOUBLE) AS reg FROM scores GROUP BY learner) SELECT learner, round(reg, 6) AS reg FROM g ORDER BY reg DESC, learner LIMIT 1")
def _(spark, sf):
    from ..operators.tuning import best_node

    g = scores(spark, sf).groupBy("learner").agg((F.avg((F.col("score") * F.col("y") > 0).cast("int")) * 100).alias("perf")).withColumn("complexity", F.col("learner") / 5)
    return best_node(g, "perf", "complexity", "learner", weight=0.5, power=1.0).select("learner", R("regularised").alias("reg"))


# ---- scalar functions
@query("scalar_transforms", f"""WITH {SCORES_SQL} SELECT case_id, learner, round(1 / (1 + exp(-score)), 9) AS logistic, round(0.5 * ln((1 + r) / (1 - r)), 9) + 0 AS fisher, round((exp(2 * score) - 1) / (exp(2 * score) + 1), 9) + 0 AS fisher_inverse,
  round(exp(-score * score / 2) / sqrt(2 * pi()), 9) AS normal_density, round(r * sqrt(98) / sqrt(1 - r * r), 9) + 0 AS t_of_r FROM (SELECT *, score / 2 AS r FROM scores)""")
def _(spark, sf):
    from ..functions import scalar

    s = scores(spark, sf).withColumn("r", F.col("score") / 2)
    x, r = F.col("score"), F.col("r")
    made = {"logistic": scalar.logistic(x), "fisher": scalar.fisher_z(r), "fisher_inverse": scalar.fisher_inverse(x), "normal_density": scalar.normal_pdf(x), "t_of_r": scalar.t_of_r(r, 100)}
    return s.select("case_id", "learner", *[(R(v, 9) + 0.0).alias(k) for k, v in made.items()])


@query("scalar_softmax", f"WITH {SCORES_SQL} SELECT case_id, learner, round(exp(score) / sum(exp(score)) OVER (PARTITION BY case_id), 9) AS share FROM scores")
def _(spark, sf):
    s = scores(spark, sf)
    return s.select("case_id", "learner", R(F.exp("score") / F.sum(F.exp("score")).over(Window.partitionBy("case_id")), 9).alias("share"))


@query("scalar_normal_cdf")
def _(spark, sf):
    from ..functions import scalar

    return scores(spark, sf).select("case_id", "learner", R(scalar.normal_cdf(F.col("score")), 7).alias("cdf"))


@query("scalar_euclidean", "SELECT a.vec_id, round(sqrt(list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 6) AS d FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "embedding")
    n = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("other"))
    gap = F.zip_with("embedding", "other", lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return e.join(n, "vec_id").select("vec_id", R(F.sqrt(F.aggregate(gap, F.lit(0.0), lambda a, x: a + x))).alias("d"))


@query("scalar_label_transform", "SELECT o_orderkey, round(ln((o_totalprice - m) / (x - m) + 1), 9) AS t, round(pow((o_totalprice - m) / (x - m), 2), 9) AS q FROM orders, (SELECT min(o_totalprice) AS m, max(o_totalprice) AS x FROM orders)")
def _(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    b = o.agg(F.min("o_totalprice").alias("m"), F.max("o_totalprice").alias("x"))
    s = o.crossJoin(F.broadcast(b)).withColumn("s", (F.col("o_totalprice") - F.col("m")) / (F.col("x") - F.col("m")))  # one row
    return s.select("o_orderkey", R(F.log(F.col("s") + 1), 9).alias("t"), R(F.pow("s", F.lit(2)), 9).alias("q"))


@query("scalar_strings", "SELECT p_partkey, replace(p_name || ',x', ',', '') AS plain, string_split(p_name, ' ')[1] AS head FROM part")
def _(spark, sf):
    name = F.col("p_name")
    return table(spark, sf, "part").select("p_partkey", F.regexp_replace(F.concat(name, F.lit(",x")), ",", "").alias("plain"), F.split(name, " ")[0].alias("head"))
