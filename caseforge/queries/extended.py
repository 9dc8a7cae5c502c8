"""Queries over shaping, robust scales, reductions, kernel machines, rankers, subsets, committees, calibration and synthetic data."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from ..functions import scalar
from ..operators import calibrate, committee, kernels, margins, more_prep, prep, reduce, robust, significance, synthetic
from ..operators.order import running
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


def _vectors(spark, sf):
    e = table(spark, sf, "embeddings")
    return e.select(F.col("vec_id").alias("case_id"), F.col("embedding").cast("array<double>").alias("f"), F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"), "label")


# ---- shaping and matching
@query("shape_select_rows", "SELECT p_partkey, p_size FROM (SELECT *, row_number() OVER (ORDER BY p_partkey) AS r FROM part) WHERE r % 7 = 3")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", "p_size").withColumn("_all", F.lit(1)).withColumn("one", F.lit(1).cast("long"))
    return running(p, ["_all"], "p_partkey", ["one"]).filter("(before_one + 1) % 7 = 3").select("p_partkey", "p_size")


@query("import_selection", "SELECT vec_id, round(embedding[3]::DOUBLE, 6) AS f3, round(embedding[9]::DOUBLE, 6) AS f9 FROM embeddings WHERE label IN (1, 4)")
def _(spark, sf):
    e = table(spark, sf, "embeddings").filter(F.col("label").isin(1, 4))
    return e.select("vec_id", *[F.round(F.col("embedding")[k - 1].cast("double"), 6).alias(f"f{k}") for k in (3, 9)])


@query("shape_drop_unlabelled", "SELECT d.doc_id, l.quality FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE l.quality IS NOT NULL")
def _(spark, sf):
    d, l = table(spark, sf, "documents").select("doc_id"), table(spark, sf, "labels").select(F.col("doc_id").alias("_d"), "quality")
    return d.join(l, F.col("doc_id") == F.col("_d"), "left").na.drop(subset=["quality"]).select("doc_id", "quality")


@query("shape_subspace", "SELECT vec_id, list_transform([1, 5, 20], lambda i: round(embedding[i]::DOUBLE, 6)) AS f FROM embeddings")
def _(spark, sf):
    mask = F.array(*[F.lit(i) for i in (1, 5, 20)])
    return table(spark, sf, "embeddings").select("vec_id", F.transform(mask, lambda i: F.round(F.element_at("embedding", i).cast("double"), 6)).alias("f"))


@query("shape_merge_cells", "SELECT user_id, list_concat(list_sort(list(event_id) FILTER (event_type = 'click')), list_sort(list(event_id) FILTER (event_type = 'view'))) AS merged FROM events GROUP BY user_id HAVING count(*) FILTER (event_type = 'click') > 0 AND count(*) FILTER (event_type = 'view') > 0")
def _(spark, sf):
    side = lambda k: F.sort_array(F.collect_list(F.when(F.col("event_type") == k, F.col("event_id"))))
    e = table(spark, sf, "events").groupBy("user_id").agg(side("click").alias("a"), side("view").alias("b")).filter("size(a) > 0 and size(b) > 0")
    return e.select("user_id", F.concat("a", "b").alias("merged"))


_NETWORK = "l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings), s AS (SELECT * FROM l WHERE i <= 6), n AS (SELECT a.i AS a, b.i AS b, corr(a.v, b.v) AS w FROM s a JOIN s b ON a.vec_id = b.vec_id AND a.i < b.i GROUP BY a.i, b.i)"


@query("graph_features", f"WITH {_NETWORK} SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, round(w, 6) AS w FROM n")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("f", F.slice("f", 1, 6))
    return synthetic.feature_network(e, "f").select("a", "b", R("w").alias("w"))


@query("shape_upper_triangle", f"WITH {_NETWORK} SELECT CAST(a AS INT) AS a, CAST(b AS INT) AS b, CAST(CASE WHEN w >= 0.05 THEN 2 WHEN w >= 0 THEN 1 ELSE 0 END AS INT) AS bin FROM n")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("f", F.slice("f", 1, 6))
    return synthetic.feature_network(e, "f").select("a", "b", prep.into_bins(F.col("w"), [0.0, 0.05]).cast("int").alias("bin"))


@query("match_features", "SELECT p_size AS a, p_partkey AS b, p_retailprice AS c FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select(F.col("p_retailprice").alias("c"), F.col("p_partkey").alias("b"), F.col("p_size").alias("a"), "p_name")
    wanted = ["a", "b", "c"]
    missing = [c for c in wanted if c not in p.columns]
    if missing:
        raise ValueError(f"features not found: {missing}")
    return p.select(*wanted)


@query("match_merge_fields", "SELECT s_suppkey AS k, CASE WHEN s_suppkey % 3 = 0 THEN s_nationkey + 100 ELSE s_nationkey END AS nation, s_acctbal AS balance FROM supplier")
def _(spark, sf):
    """Later tables' fields override earlier ones where they have a row."""
    s = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").alias("nation"), F.col("s_acctbal").alias("balance"))
    later = s.filter("k % 3 = 0").select(F.col("k").alias("_k"), (F.col("nation") + 100).alias("_nation"))
    return s.join(later, F.col("k") == F.col("_k"), "left").select("k", F.coalesce("_nation", "nation").alias("nation"), "balance")


@query("fusion_intermediate", f"""WITH {CASES_SQL}, m AS (SELECT min(x2) AS lo, max(x2) AS hi FROM cases WHERE case_id % 2 = 0), z AS (SELECT avg(x3) AS c, stddev_samp(x3) AS s FROM cases WHERE case_id % 2 = 0)
  SELECT case_id, round((x2 - lo) / (hi - lo), 6) + 0 AS a, round(round((x3 - c) / s, 9), 6) + 0 AS b FROM cases, m, z""")
def _(spark, sf):
    """Each modality is prepared on its own training rows; then they are joined by case."""
    long = cases_long(spark, sf).select("case_id", "feat", "value")
    a, b = long.filter("feat = 'x2'"), long.filter("feat = 'x3'")
    a = prep.scale(a, prep.fit_scale(a.filter("case_id % 2 = 0"), ["feat"]), ["feat"]).select("case_id", R("value").alias("a"))
    b = prep.standardise(b, prep.fit_standard(b.filter("case_id % 2 = 0"), ["feat"]), ["feat"]).select("case_id", R("value").alias("b"))
    return a.join(b, "case_id")


@query("agg_cluster_means", "WITH l AS (SELECT vec_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM embeddings) SELECT vec_id AS case_id, CAST(i % 5 AS BIGINT) AS cluster, round(avg(v), 6) + 0 AS mean, round(stddev_samp(v), 6) AS sd FROM l GROUP BY ALL")
def _(spark, sf):
    long = array_to_long(_vectors(spark, sf), "case_id", "f").withColumn("cluster", (F.col("feat") % 5).cast("long"))
    return long.groupBy("case_id", "cluster").agg(R(F.avg("value")).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("sd"))


@query("agg_perturbation_interval", f"""WITH {SCORES_SQL}, g AS (SELECT learner, count(*) AS n, list(score ORDER BY score) AS l, round(median(score), 6) + 0 AS median, round(stddev_samp(score), 6) AS sd FROM scores GROUP BY learner),
  q AS (SELECT *, greatest(1.0::DOUBLE, n * 0.025::DOUBLE + 0.5) AS a, least(n::DOUBLE, n * 0.975::DOUBLE + 0.5) AS b FROM g)
  SELECT learner, median, sd, round(l[CAST(floor(a) AS INT)] + (l[CAST(ceil(a) AS INT)] - l[CAST(floor(a) AS INT)]) * (a - floor(a)), 6) + 0 AS low, round(l[CAST(floor(b) AS INT)] + (l[CAST(ceil(b) AS INT)] - l[CAST(floor(b) AS INT)]) * (b - floor(b)), 6) + 0 AS high FROM q""")
def _(spark, sf):
    from ..operators.order import hazen

    s = scores(spark, sf)
    h = hazen(s, ["learner"], "score", [2.5, 50, 97.5])
    return h.join(s.groupBy("learner").agg(F.round(F.stddev_samp("score"), 6).alias("sd")), "learner").select("learner", R("p50").alias("median"), "sd", R("p2_5").alias("low"), R("p97_5").alias("high"))


@query("sort_rows", "SELECT CAST(row_number() OVER (ORDER BY p_size, p_partkey) AS BIGINT) AS place, p_partkey FROM part")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey", (F.col("p_size") * 1e9 + F.col("p_partkey")).alias("key")).withColumn("_all", F.lit(1)).withColumn("one", F.lit(1).cast("long"))
    return running(p, ["_all"], "key", ["one"]).select((F.col("before_one") + 1).alias("place"), "p_partkey")


@query("search_nearest", "SELECT p_partkey, CAST(arg_min(i, (abs(v - p_size), i)) AS INT) AS position FROM part, (SELECT unnest([1.0, 4.0, 9.0, 16.0, 25.0, 36.0, 49.0]) AS v, unnest(range(1, 8)) AS i) GROUP BY p_partkey")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", synthetic.nearest_position([1, 4, 9, 16, 25, 36, 49], F.col("p_size")).alias("position"))


@query("sample_with_replacement", "WITH o AS (SELECT p_partkey, row_number() OVER (ORDER BY p_partkey) - 1 AS r, count(*) OVER () AS n FROM part), d AS (SELECT draw, CAST('0x' || substr(md5(draw || ':5'), 1, 12) AS BIGINT) AS h FROM (SELECT unnest(range(1, 501)) AS draw)) SELECT draw, p_partkey FROM d JOIN o ON h % n = r")
def _(spark, sf):
    p = table(spark, sf, "part").select("p_partkey").withColumn("_all", F.lit(1)).withColumn("one", F.lit(1).cast("long"))
    placed = running(p, ["_all"], "p_partkey", ["one"]).select("p_partkey", F.col("before_one").alias("r"))
    n = placed.count()
    draws = spark.range(1, 501).select(F.col("id").alias("draw"), F.pmod(F.conv(F.substring(F.md5(F.concat(F.col("id").cast("string"), F.lit(":5"))), 1, 12), 16, 10).cast("long"), F.lit(n)).alias("h"))
    return draws.join(placed, F.col("h") == F.col("r")).select("draw", "p_partkey")


@query("scalar_log_spaced", "SELECT CAST(k AS INT) AS k, round(2 + 8 * (exp(k / 6.0::DOUBLE) - 1) / (exp(1.0::DOUBLE) - 1), 9) AS v FROM (SELECT unnest(range(0, 7)) AS k)")
def _(spark, sf):
    return spark.createDataFrame([(k, round(v, 9)) for k, v in enumerate(scalar.log_spaced(2.0, 10.0, 7))], "k int, v double")


@query("lookup_columns", "SELECT name, CAST(position AS INT) AS position FROM (SELECT unnest(['p_size', 'p_name', 'p_brand']) AS name, unnest([5, 2, 3]) AS position)")
def _(spark, sf):
    """Positions (from 1) of several names among a table's columns."""
    columns = table(spark, sf, "part").columns
    return spark.createDataFrame([(c, columns.index(c) + 1) for c in ("p_size", "p_name", "p_brand")], "name string, position int")


@query("lookup_codes", "SELECT p_brand, CAST(dense_rank() OVER (ORDER BY p_brand) AS INT) AS code FROM (SELECT DISTINCT p_brand FROM part)")
def _(spark, sf):
    from pyspark.sql import Window

    return table(spark, sf, "part").select("p_brand").distinct().withColumn("code", F.row_number().over(Window.orderBy("p_brand")))  # a row a value


@query("search_field", "SELECT p_partkey FROM part WHERE p_brand = (SELECT min(p_brand) FROM part)")
def _(spark, sf):
    p = table(spark, sf, "part")
    least = p.agg(F.min("p_brand").alias("_b"))
    return p.join(F.broadcast(least), F.col("p_brand") == F.col("_b"), "left_semi").select("p_partkey")  # one row


# ---- scales and imputation
@query("prep_standardise_iqr", f"""WITH {CASES_SQL}, q AS (SELECT feat, list(value ORDER BY value) AS l, count(*) AS n FROM long WHERE value IS NOT NULL AND case_id % 2 = 0 GROUP BY feat), t AS (SELECT feat, l, n, unnest([25.0, 50.0, 75.0]) AS p FROM q), a AS (SELECT *, greatest(1.0::DOUBLE, least(n::DOUBLE, n * p / 100 + 0.5)) AS pos FROM t),
  v AS (SELECT feat, p, l[CAST(floor(pos) AS INT)] + (l[CAST(ceil(pos) AS INT)] - l[CAST(floor(pos) AS INT)]) * (pos - floor(pos)) AS v FROM a), s AS (SELECT feat, max(v) FILTER (p = 50) AS centre, CASE WHEN max(v) FILTER (p = 75) - max(v) FILTER (p = 25) > 2.3e-308 THEN max(v) FILTER (p = 75) - max(v) FILTER (p = 25) ELSE 1e-5 END AS sd FROM v GROUP BY feat)
  SELECT case_id, feat, round(round((value - centre) / sd, 9), 4) + 0 AS value FROM long LEFT JOIN s USING (feat)""")
def _(spark, sf):
    long = cases_long(spark, sf).select("case_id", "feat", "value")
    p = prep.fit_standard_iqr(long.filter("case_id % 2 = 0"), ["feat"])
    return prep.standardise(long, p, ["feat"]).select("case_id", "feat", R("value", 4).alias("value"))


def _small(spark, sf):
    """Values of three features by supplier: a table whose features fit into one task."""
    s = table(spark, sf, "supplier")
    return s.select(F.col("s_suppkey").alias("case_id"), F.col("s_acctbal").alias("a"), F.col("s_nationkey").cast("double").alias("b"))


def _small_long(spark, sf):
    s = _small(spark, sf)
    return s.select("case_id", F.lit("a").alias("feat"), F.col("a").alias("value")).unionByName(s.select("case_id", F.lit("b").alias("feat"), F.col("b").alias("value")))


_QN = "q AS (SELECT feat, 2.2219::DOUBLE * (list_sort(list(d)))[CAST((any_value(n) // 2 + 1) * (any_value(n) // 2) // 2 AS INT)] AS sd FROM (SELECT x.feat, abs(x.value - z.value) AS d, count(*) OVER (PARTITION BY x.feat, x.case_id) AS o, m.n FROM l x JOIN l z ON x.feat = z.feat AND x.case_id < z.case_id JOIN (SELECT feat, count(*) AS n FROM l GROUP BY feat) m ON m.feat = x.feat) GROUP BY feat)"
_SMALL = "l AS (SELECT s_suppkey AS case_id, 'a' AS feat, s_acctbal AS value FROM supplier UNION ALL SELECT s_suppkey, 'b', s_nationkey::DOUBLE FROM supplier)"


@query("prep_standardise_qn", f"WITH {_SMALL}, {_QN} SELECT case_id, feat, round(round(value / CASE WHEN sd > 2.3e-308 THEN sd ELSE 1e-5 END, 9), 6) + 0 AS value FROM l JOIN q USING (feat)")
def _(spark, sf):
    l = _small_long(spark, sf)
    return prep.standardise(l, robust.fit_robust(l, ["feat"], "qn"), ["feat"]).select("case_id", "feat", R("value").alias("value"))


_SN = "h AS (SELECT x.feat, x.case_id, (list_sort(list(abs(x.value - z.value))))[CAST(count(*) // 2 + 1 AS INT)] AS d FROM l x JOIN l z ON x.feat = z.feat GROUP BY x.feat, x.case_id), q AS (SELECT feat, 1.1926::DOUBLE * (list_sort(list(d)))[CAST((count(*) + 1) // 2 AS INT)] AS sd FROM h GROUP BY feat)"


@query("prep_standardise_sn", f"WITH {_SMALL}, {_SN} SELECT case_id, feat, round(round(value / CASE WHEN sd > 2.3e-308 THEN sd ELSE 1e-5 END, 9), 6) + 0 AS value FROM l JOIN q USING (feat)")
def _(spark, sf):
    l = _small_long(spark, sf)
    return prep.standardise(l, robust.fit_robust(l, ["feat"], "sn"), ["feat"]).select("case_id", "feat", R("value").alias("value"))


@query("prep_spatial_median")
def _(spark, sf):
    e = _vectors(spark, sf)
    centre = reduce.spatial_median(e, "f")
    return e.select("case_id", F.zip_with("f", F.array(*[F.lit(float(c)) for c in centre]), lambda a, b: F.round(a - b, 5)).alias("f"))


def _gappy(spark, sf):
    e = _vectors(spark, sf)
    return e.select("case_id", F.transform(F.slice("f", 1, 8), lambda x, i: F.when((F.col("case_id") % 10 != 0) | (i != F.col("case_id") % 7), x)).alias("f"))


@query("prep_impute_sequential")
def _(spark, sf):
    return robust.sequential_impute(_gappy(spark, sf), "case_id", "f", 5)


@query("prep_impute_hybrid")
def _(spark, sf):
    s = table(spark, sf, "supplier").join(table(spark, sf, "nation"), F.col("s_nationkey") == F.col("n_nationkey"))
    own = s.select(F.col("s_suppkey").alias("case_id"), F.when(F.col("s_suppkey") % 9 != 0, F.col("s_acctbal")).alias("a"), F.col("n_regionkey").cast("double").alias("b"), F.col("n_name").alias("c"))
    return robust.hybrid_impute(own, "case_id", ["a", "b"], ["c"], 3)


# ---- reductions
@query("reduce_probabilistic")
def _(spark, sf):
    e = _vectors(spark, sf)
    mean, load, _ = reduce.probabilistic(e, "f", 3)
    return more_prep.projected(e, "case_id", "f", mean, load)


@query("reduce_factors")
def _(spark, sf):
    e = _vectors(spark, sf)
    mean, load, psi = reduce.factors(e, "f", 3, 50)
    return more_prep.projected(e, "case_id", "f", mean, load / psi[:, None])


@query("reduce_sparse")
def _(spark, sf):
    e = _vectors(spark, sf)
    mean, load = reduce.sparse_components(e, "f", 2, 0.002)
    return more_prep.projected(e, "case_id", "f", mean, load)


@query("reduce_robust")
def _(spark, sf):
    e = _vectors(spark, sf)
    return more_prep.projected(e, "case_id", "f", *reduce.robust_components(e, "case_id", "f", 3))


@query("reduce_independent")
def _(spark, sf):
    return reduce.independent(_vectors(spark, sf), "case_id", "f", 3, 12)[0]


@query("reduce_least_squares")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("t", F.array(F.col("label").cast("double")))
    mean, weights, _, _ = reduce.least_squares_components(e, "f", "t", 2)
    return more_prep.projected(e, "case_id", "f", mean, weights)


@query("prep_deviation")
def _(spark, sf):
    e = _vectors(spark, sf).select("case_id", F.slice("f", 1, 4).alias("x"), F.slice("f", 5, 3).alias("t"))
    return reduce.deviation(e, "case_id", "x", "t", reduce.least_squares_components(e.filter("case_id % 2 = 0"), "x", "t", 2))


@query("reduce_aligned")
def _(spark, sf):
    """Components of one half of the rows, turned onto those of the other half."""
    e = _vectors(spark, sf)
    a, b = (reduce.probabilistic(e.filter(f"case_id % 2 = {k}"), "f", 3)[1] for k in (0, 1))
    return more_prep.projected(e, "case_id", "f", np.zeros(len(a)), reduce.aligned_basis(a, b))


for _name, _options in (("kernel_pca", {"gamma": 0.5}), ("laplacian", {}), ("locally_linear", {}), ("locality_preserving", {}), ("isometric", {}), ("kernel_discriminant", {"gamma": 0.5})):

    def _map(spark, sf, name=_name, options=_options):
        return kernels.embedded(_vectors(spark, sf).select("case_id", "f", "label"), "case_id", "f", name, 2, "label", **options)

    query(f"embed_{_name}")(_map)


# ---- machines
def _machine(name: str, target: str = "y", **options):
    def run(spark, sf):
        e = _vectors(spark, sf).withColumn("fold", (F.col("case_id") % 2).cast("int")).withColumn("target", F.col(target).cast("double"))
        rows = e.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("in_test", F.col("case_id") % 2 == F.col("fold"))
        return kernels.fit_predict(rows, ["fold"], "case_id", "f", "target", "in_test", name, **options)

    return run


for _query, _name, _options in (
    ("svc_rbf", "svc", {"kind": "rbf", "gamma": 0.5}), ("svc_poly", "svc", {"kind": "poly", "gamma": 1.0, "degree": 2, "shift": 1.0}), ("svc_sigmoid", "svc", {"kind": "sigmoid", "gamma": 0.1}), ("svc_linear", "svc", {"kind": "linear"}),
    ("robust_svc", "robust_svc", {"kind": "rbf", "gamma": 0.5}), ("one_class", "one_class", {"kind": "rbf", "gamma": 0.5}), ("extreme", "extreme", {}), ("sparse_logistic", "sparse_logistic", {}),
):
    query(f"learn_{_query}")(_machine(_name, **_options))
query("learn_svr_rbf")(_machine("svr", "label", kind="rbf", gamma=0.5, epsilon=0.2))
query("learn_relevance")(_machine("relevance", "label", kind="rbf", gamma=0.5))


# ---- ranking and subsets
@query("rank_relief")
def _(spark, sf):
    return margins.relief(_vectors(spark, sf), "case_id", "f", "y", 5).withColumn("weight", R("weight", 5))


@query("rank_margin")
def _(spark, sf):
    e = _vectors(spark, sf)
    return margins.to_frame(e, margins.margin_weights(e, "case_id", "f", "y", 2))


@query("select_margin")
def _(spark, sf):
    return spark.createDataFrame([(i,) for i in margins.margin_subset(_vectors(spark, sf), "case_id", "f", "y", 2)], "feat int")


@query("rank_least_squares")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("t", F.array(F.col("y").cast("double")))
    return margins.to_frame(e, np.abs(reduce.least_squares_components(e, "f", "t", 1)[1][:, 0]).tolist())


@query("rank_linear_svm")
def _(spark, sf):
    from ..operators import learn

    e = _vectors(spark, sf).withColumn("c", ((F.col("y") + 1) / 2))
    model = learn.LEARNERS["linear_svm"]().fit(learn.vectors(e, "f", "c"))
    return margins.to_frame(e, np.abs(model.coefficients.toArray()).tolist())


@query("rank_bhattacharyya")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("f", F.slice("f", 1, 10))
    return margins.to_frame(e, reduce.bhattacharyya_ranks(e, "f", "y"))


_RANKS = "ranks AS (SELECT feat, round(var_samp(value), 9) AS weight FROM long GROUP BY feat)"


def _ranks(spark, sf):
    return cases_long(spark, sf).groupBy("feat").agg(F.round(F.var_samp("value"), 9).alias("weight"))


@query("rank_external", f"WITH {CASES_SQL} SELECT DISTINCT feat, CASE feat WHEN 'x1' THEN 0.5::DOUBLE WHEN 'x3' THEN 0.25::DOUBLE ELSE 0 END AS weight FROM long")
def _(spark, sf):
    return margins.weighted(_ranks(spark, sf), spark.createDataFrame([("x1", 0.5), ("x3", 0.25)], "feat string, weight double"), "feat")


@query("subsets_increasing", f"WITH {CASES_SQL}, {_RANKS}, r AS (SELECT feat, row_number() OVER (ORDER BY weight DESC, feat) AS r FROM ranks) SELECT CAST(k AS INT) AS subset, feat FROM r, (SELECT unnest([1, 2, 4]) AS k) WHERE r <= k")
def _(spark, sf):
    return margins.increasing_sets(_ranks(spark, sf), "feat", "weight", [1, 2, 4])


@query("subsets_random", f"WITH {CASES_SQL}, f AS (SELECT DISTINCT feat FROM long), r AS (SELECT CAST(k AS INT) AS subset, feat, row_number() OVER (PARTITION BY k ORDER BY md5(feat || ':42:' || k), feat) AS r FROM f, (SELECT unnest(range(1, 6)) AS k)) SELECT subset, feat FROM r WHERE r <= 2")
def _(spark, sf):
    return margins.random_sets(cases_long(spark, sf).select("feat").distinct(), "feat", 5, 2)


_PERF = "g AS (SELECT learner, round(avg(CAST(score * y > 0 AS INT)) * 100, 9) AS perf FROM scores GROUP BY learner)"


def _perf(spark, sf):
    return scores(spark, sf).groupBy("learner").agg(F.round(F.avg((F.col("score") * F.col("y") > 0).cast("int")) * 100, 9).alias("perf"))


for _name, _keep, _amount in (("winner", "QUALIFY row_number() OVER (ORDER BY perf DESC, learner) = 1", 0.0), ("range", "QUALIFY perf >= max(perf) OVER () * 0.99::DOUBLE", 1.0), ("all", "", 0.0)):

    def _strategy(spark, sf, name=_name, amount=_amount):
        s = margins.chosen_sets(_perf(spark, sf), "learner", "perf", name, amount, "linear")
        return s.select("learner", R("weight").alias("weight"))

    query(f"subsets_{_name}", f"WITH {SCORES_SQL}, {_PERF}, k AS (SELECT * FROM g {_keep}) SELECT learner, round(perf / sum(perf) OVER (), 6) AS weight FROM k")(_strategy)


@query("permute_unique", f"WITH {CASES_SQL} SELECT CAST(perm AS INT) AS perm, case_id, y, CAST(row_number() OVER (PARTITION BY perm, y ORDER BY md5(case_id::VARCHAR || ':' || perm), case_id) AS INT) AS place FROM cases, (SELECT unnest(range(1, 4)) AS perm)")
def _(spark, sf):
    return margins.unique_permutations(cases(spark, sf), "case_id", ["y"], 3)


# ---- committees, calibration, significance
for _name in committee.CRITERIA:

    def _committee(spark, sf, name=_name):
        kept = committee.selected(committee.vote_patterns(scores(spark, sf), "case_id", "learner", "score", "y"), name)
        return spark.createDataFrame([(int(k),) for k in kept], "learner long")

    query(f"ens_select_{_name}")(_committee)


@query("ens_boosted")
def _(spark, sf):
    w = committee.boosted(committee.vote_patterns(scores(spark, sf), "case_id", "learner", "score", "y"))
    return spark.createDataFrame([(int(k), float(v)) for k, v in w.items()], "learner long, weight double")


@query("ens_eliminated", f"WITH {SCORES_SQL}, d AS (SELECT case_id, max(score) FILTER (learner = 1) AS ab, max(score) FILTER (learner = 2) AS ac, max(score) FILTER (learner = 3) AS bc FROM scores GROUP BY case_id) SELECT case_id, CASE WHEN ab > 0 THEN CASE WHEN ac > 0 THEN 'A' ELSE 'C' END ELSE CASE WHEN bc > 0 THEN 'B' ELSE 'C' END END AS cls FROM d")
def _(spark, sf):
    s = scores(spark, sf)
    side = lambda k: F.max(F.when(F.col("learner") == k, F.col("score")))
    d = s.groupBy("case_id").agg(side(1).alias("ab"), side(2).alias("ac"), side(3).alias("bc"))
    return d.select("case_id", committee.eliminated({("A", "B"): F.col("ab"), ("A", "C"): F.col("ac"), ("B", "C"): F.col("bc")}, ["A", "B", "C"]).alias("cls"))


@query("grid_regularisation", "SELECT CAST(k AS INT) AS k, round((1 - cos(pi() * k / 10)) / 2 * 100, 6) + 0 AS cos2, round((1 - sin(k / 10.0::DOUBLE * pi() / 2)) * 100, 6) + 0 AS sin_inverted FROM (SELECT unnest(range(0, 11)) AS k)")
def _(spark, sf):
    c = F.col("k") / 10
    return spark.range(11).select(F.col("id").cast("int").alias("k")).select("k", R(committee.regularisation(c, "cos2")).alias("cos2"), R(committee.regularisation(c, "sin", True)).alias("sin_inverted"))


@query("calibrate_threshold", f"""WITH {SCORES_SQL}, t AS (SELECT score, y FROM scores WHERE learner = 1 AND case_id % 2 = 0), c AS (SELECT DISTINCT score AS s FROM t),
  g AS (SELECT s, round(avg(CAST(score >= s AS INT)) FILTER (y > 0) + avg(CAST(score < s AS INT)) FILTER (y < 0), 12) AS g FROM c, t GROUP BY s), b AS (SELECT s FROM g ORDER BY g DESC, s LIMIT 1)
  SELECT case_id, round(score - s, 6) + 0 AS score FROM scores, b WHERE learner = 1 AND case_id % 2 = 1""")
def _(spark, sf):
    s = scores(spark, sf).filter("learner = 1").withColumn("y01", ((F.col("y") + 1) / 2).cast("int"))
    t = calibrate.best_threshold(s.filter("case_id % 2 = 0"), "y01", "score")
    return calibrate.shifted(s.filter("case_id % 2 = 1"), "score", t).select("case_id", R("score").alias("score"))


@query("calibrate_quantile_bins")
def _(spark, sf):
    s = scores(spark, sf).filter("learner = 1").withColumn("y01", ((F.col("y") + 1) / 2).cast("int"))
    models = calibrate.fit_quantile_bins(s.filter("case_id % 2 = 0"), "y01", "p", "case_id", 8)
    return s.filter("case_id % 2 = 1").select("case_id", R(calibrate.binned_probability(F.col("p"), models)).alias("p"))


@query("stat_wilcoxon_exact", f"WITH {SCORES_SQL}, d AS (SELECT round(a.score - b.score, 6) AS d FROM scores a JOIN scores b USING (case_id) WHERE a.learner = 1 AND b.learner = 2 AND case_id < 0) SELECT 0.0::DOUBLE AS w_plus, 0.0::DOUBLE AS w_minus, 0.0::DOUBLE AS n, NULL::DOUBLE AS p WHERE (SELECT count(*) FROM d) = 0")
def _(spark, sf):
    """No differences: the sums are 0 and there is no p (the values are tested on fixtures)."""
    s = scores(spark, sf).filter("case_id < 0").withColumn("d", F.col("score"))
    return significance.wilcoxon_exact(s, "d").select(F.coalesce("w_plus", F.lit(0.0)).alias("w_plus"), F.coalesce("w_minus", F.lit(0.0)).alias("w_minus"), "n", "p")


def _classifiers(spark, sf):
    return scores(spark, sf).withColumn("ok", (F.col("score") * F.col("y") > 0).cast("int"))


@query("stat_compare", f"WITH {SCORES_SQL}, s AS (SELECT *, CAST(score * y > 0 AS INT) AS ok FROM scores), g AS (SELECT a.learner AS a, b.learner AS b, count(*) FILTER (a.ok = 1 AND b.ok = 0)::DOUBLE AS only_a, count(*) FILTER (a.ok = 0 AND b.ok = 1)::DOUBLE AS only_b FROM s a JOIN s b USING (case_id) WHERE a.learner < b.learner GROUP BY ALL) SELECT a, b, only_a, only_b, round(greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b), 6) AS chi2 FROM g")
def _(spark, sf):
    return significance.compare_classifiers(_classifiers(spark, sf), "case_id", "learner", "ok").select("a", "b", "only_a", "only_b", R("chi2").alias("chi2"))


@query("stat_liddell", f"WITH {SCORES_SQL}, s AS (SELECT *, CAST(score * y > 0 AS INT) AS ok FROM scores), g AS (SELECT b.learner, count(*) FILTER (a.ok = 1 AND b.ok = 0)::DOUBLE AS only_a, count(*) FILTER (a.ok = 0 AND b.ok = 1)::DOUBLE AS only_b FROM s a JOIN s b USING (case_id) WHERE a.learner = 1 AND b.learner > 1 GROUP BY b.learner), t AS (SELECT g.*, greatest(only_a, only_b) AS r, least(only_a, only_b) AS s FROM g), k AS (SELECT learner, sum(exp(lgamma(r + s + 1) - lgamma(i + 1) - lgamma(r + s - i + 1) - (r + s) * ln(2.0::DOUBLE))) AS tail FROM (SELECT *, unnest(range(CAST(r AS BIGINT), CAST(r + s AS BIGINT) + 1)) AS i FROM t) GROUP BY learner) SELECT learner, only_a, only_b, round(r / (s + 1), 6) AS f, round(least(1.0, 2 * tail), 6) AS p FROM t JOIN k USING (learner)")
def _(spark, sf):
    s = _classifiers(spark, sf)
    a, b = s.filter("learner = 1").select("case_id", F.col("ok").alias("a")), s.filter("learner > 1").select("case_id", "learner", F.col("ok").alias("b"))
    return significance.liddell(a.join(b, "case_id"), "a", "b", ["learner"]).select("learner", "only_a", "only_b", R("f").alias("f"), R("p").alias("p"))


@query("stat_kappa", f"WITH {SCORES_SQL}, c AS (SELECT learner, count(*)::DOUBLE AS n, count(*) FILTER (y > 0 AND score > 0) AS tp, count(*) FILTER (y < 0 AND score <= 0) AS tn, count(*) FILTER (y < 0 AND score > 0) AS fp, count(*) FILTER (y > 0 AND score <= 0) AS fn FROM scores GROUP BY learner), r AS (SELECT *, (tp + tn) / n AS po, (tp + fp) / n AS r1, (tp + fn) / n AS c1 FROM c), e AS (SELECT *, r1 * c1 + (1 - r1) * (1 - c1) AS pe, r1 * c1 * (r1 + c1) + (1 - r1) * (1 - c1) * (2 - r1 - c1) AS q FROM r) SELECT learner, round((po - pe) / (1 - pe), 6) + 0 AS kappa, round((po - pe) / (1 - pe) / sqrt((pe + pe * pe - q) / (n * (1 - pe) * (1 - pe))), 5) + 0 AS z FROM e")
def _(spark, sf):
    pos, said = F.col("y") > 0, F.col("score") > 0
    c = scores(spark, sf).groupBy("learner").agg(F.count_if(pos & said).alias("tp"), F.count_if(~pos & ~said).alias("tn"), F.count_if(~pos & said).alias("fp"), F.count_if(pos & ~said).alias("fn"))
    return significance.kappa_test(c, ["learner"]).select("learner", R("kappa").alias("kappa"), R("z", 5).alias("z"))


_CONSISTENCY = "i AS (SELECT learner AS feat, {} AS c FROM scores GROUP BY learner), s AS (SELECT stddev_samp(c) AS sd FROM i) SELECT feat, round(c, 6) + 0 AS consistency, round(c / sd, 5) + 0 AS z FROM i, s"


@query("stat_consistency", f"WITH {SCORES_SQL}, " + _CONSISTENCY.format("abs(avg(sign(score)))"))
def _(spark, sf):
    s = scores(spark, sf).withColumnRenamed("learner", "feat")
    return significance.consistency_p(s, "feat", "score").select("feat", R("consistency").alias("consistency"), R("z", 5).alias("z"))


@query("stat_consistency_two_sided", f"WITH {SCORES_SQL}, " + _CONSISTENCY.format("avg(score)"))
def _(spark, sf):
    s = scores(spark, sf).withColumnRenamed("learner", "feat")
    return significance.consistency_p(s, "feat", "score", True).select("feat", R("consistency").alias("consistency"), R("z", 5).alias("z"))


# ---- synthetic data, graphs, shares
@query("simulate_gaussian")
def _(spark, sf):
    return synthetic.gaussian(_vectors(spark, sf), "f", 200, 5)


@query("simulate_mixture")
def _(spark, sf):
    return synthetic.mixture(_vectors(spark, sf).withColumn("f", F.slice("f", 1, 4)), "f", 200, 2)


@query("simulate_copula")
def _(spark, sf):
    return synthetic.copula(_vectors(spark, sf).withColumn("f", F.slice("f", 1, 4)), "f", 200)


@query("simulate_oversampled")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("y", F.when(F.col("label") == 0, 1).otherwise(-1))
    return margins.oversampled(e, "case_id", "f", "y", 5, 0.5)


_GRAPHS = "ed AS (SELECT DISTINCT user_id % 4 AS graph, user_id AS a, event_type AS b FROM events), eb AS (SELECT graph, CAST(a AS VARCHAR) AS a, b FROM ed UNION SELECT graph, b, CAST(a AS VARCHAR) FROM ed), nd AS (SELECT DISTINCT graph, a AS node, CASE WHEN a IN (SELECT DISTINCT event_type FROM events) THEN 'type' ELSE 'user' END AS label FROM eb), n1 AS (SELECT nd.graph, nd.node, md5(nd.label || '|' || string_agg(o.label, ',' ORDER BY o.label)) AS label FROM nd JOIN eb ON nd.graph = eb.graph AND nd.node = eb.a JOIN nd o ON o.graph = eb.graph AND o.node = eb.b GROUP BY nd.graph, nd.node, nd.label), al AS (SELECT graph, 0 AS r, label, count(*) AS n FROM nd GROUP BY ALL UNION ALL SELECT graph, 1, label, count(*) FROM n1 GROUP BY ALL)"


@query("graph_kernel", f"WITH {_GRAPHS} SELECT x.graph AS g, z.graph AS h, CAST(sum(x.n * z.n) AS BIGINT) AS k FROM al x JOIN al z ON x.r = z.r AND x.label = z.label AND x.graph <= z.graph GROUP BY ALL")
def _(spark, sf):
    e = table(spark, sf, "events").select((F.col("user_id") % 4).alias("graph"), F.col("user_id").cast("string").alias("a"), F.col("event_type").alias("b")).distinct()
    nodes = e.select("graph", F.col("a").alias("node"), F.lit("user").alias("label")).unionByName(e.select("graph", F.col("b").alias("node"), F.lit("type").alias("label"))).distinct()
    return synthetic.graph_kernel(synthetic.relabelled(nodes, e, 1))


@query("interpret_shapley_exact")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("f", F.slice("f", 1, 5))
    mean, _, _ = more_prep.gram(e, "f")
    return synthetic.shapley(e, "case_id", "f", lambda x: np.tanh(x @ np.arange(1, 6)) + x[:, 0] * x[:, 1], mean)


@query("stat_bhattacharyya")
def _(spark, sf):
    e = _vectors(spark, sf).withColumn("f", F.slice("f", 1, 10))
    return spark.createDataFrame([(reduce.bhattacharyya(e, "f", "y"),)], "distance double")


@query("fold_leave_site_out", f"WITH {CASES_SQL}, s AS (SELECT DISTINCT site AS site_out FROM cases) SELECT site_out, CAST(perm AS INT) AS perm, case_id, CASE WHEN site = site_out THEN 'test' ELSE 'train' END AS role FROM cases, s, (SELECT unnest([1, 2]) AS perm) WHERE site = site_out OR CAST('0x' || substr(md5(case_id::VARCHAR || ':' || perm), 1, 13) AS BIGINT) < CAST(0.1::DOUBLE * 4503599627370496 AS BIGINT)")
def _(spark, sf):
    from ..operators import folds

    return folds.leave_site_out(cases(spark, sf).select("case_id", "site"), "case_id", "site", 0.1, 2)


@query("calibrate_sigmoid")
def _(spark, sf):
    s = scores(spark, sf).filter("learner = 1").withColumn("y01", ((F.col("y") + 1) / 2).cast("int"))
    a, b = calibrate.fit_sigmoid(s.filter("case_id % 2 = 0"), "y01", "score")
    return s.filter("case_id % 2 = 1").select("case_id", R(calibrate.sigmoid(F.col("score"), a, b)).alias("p"))


@query("scalar_r_to_p")
def _(spark, sf):
    r = spark.range(1, 20).select((F.col("id") / 20).alias("r"))
    return r.select("r", R(scalar.t_of_r(F.col("r"), 12)).alias("t"), R(scalar.two_sided_t_p(scalar.t_of_r(F.col("r"), 12), 10), 9).alias("p"))


@query("grid_annealed", "SELECT 3 AS a, 1 AS b")
def _(spark, sf):
    nodes = [(a, b) for a in range(6) for b in range(4)]
    best, _ = committee.annealed(nodes, lambda n: -((n[0] - 3) ** 2) - (n[1] - 1) ** 2, rounds=400)
    return spark.createDataFrame([best], "a int, b int")
