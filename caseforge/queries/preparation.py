"""Queries over fit/apply steps, folds and feature ranking. Steps are fitted on even cases and applied to all."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, neighbours, prep, rank
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
TRAIN = "case_id % 2 = 0"
#: (case_id, feat, value) as it comes out, rounded.
OUT = lambda df, n=6: df.select("case_id", "feat", R("value", n).alias("value"))


def _long(spark, sf, *keep):
    return cases_long(spark, sf).select("case_id", "feat", "value", *keep)


def _fit(spark, sf, *keep):
    long = _long(spark, sf, *keep)
    return long.filter(TRAIN), long


def _sql(params: str, made: str, keys: str = "feat", n: int = 6, where: str = "") -> str:
    return f"WITH {CASES_SQL}, tr AS (SELECT * FROM long WHERE case_id % 2 = 0), p AS ({params}) SELECT case_id, feat, round({made}, {n}) + 0 AS value FROM long LEFT JOIN p USING ({keys}) {where}"


_RANGE = "SELECT feat, min(value) AS lo, max(value) AS hi FROM tr GROUP BY feat"


@query("prep_scale01", _sql(_RANGE, "CASE WHEN value IS NULL THEN NULL WHEN hi > lo THEN (value - lo) / (hi - lo) ELSE 0 END"))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.scale(long, prep.fit_scale(train, ["feat"]), ["feat"]))


@query("prep_scale11", _sql(_RANGE, "CASE WHEN value IS NULL THEN NULL WHEN hi > lo THEN -1 + 2 * (value - lo) / (hi - lo) ELSE 0 END"))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.scale(long, prep.fit_scale(train, ["feat"]), ["feat"], -1.0, 1.0))


@query("prep_scale_revert", f"WITH {CASES_SQL} SELECT case_id, feat, round(value, 9) + 0 AS value FROM long WHERE feat <> 'x4'")
def _(spark, sf):
    train, long = _fit(spark, sf)
    p = prep.fit_scale(train, ["feat"])
    return OUT(prep.unscale(prep.scale(long, p, ["feat"]), p, ["feat"]).filter("feat <> 'x4'"), 9)


_SD = "CASE WHEN stddev_samp(value) > 2.3e-308 THEN stddev_samp(value) ELSE 1e-5 END"
_Z = "round((value - centre) / sd, 9)"


@query("prep_standardise_mean", _sql(f"SELECT feat, avg(value) AS centre, {_SD} AS sd FROM tr GROUP BY feat", _Z))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.standardise(long, prep.fit_standard(train, ["feat"]), ["feat"]))


@query("prep_standardise_median", _sql(f"SELECT feat, median(value) AS centre, {_SD} AS sd FROM tr GROUP BY feat", _Z))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.standardise(long, prep.fit_standard(train, ["feat"], median=True), ["feat"]))


def _winsorised(centre: str, shift: str) -> str:
    return f"""WITH {CASES_SQL}, p AS (SELECT feat, {centre} AS centre, {_SD} AS sd FROM long WHERE case_id % 2 = 0 GROUP BY feat),
  z AS (SELECT case_id, feat, CASE WHEN value IS NULL THEN NULL ELSE greatest(-1.5::DOUBLE, least(1.5::DOUBLE, {_Z})) END AS z FROM long JOIN p USING (feat)),
  m AS (SELECT feat, {shift} AS shift FROM z WHERE case_id % 2 = 0 GROUP BY feat) SELECT case_id, feat, round(z - shift, 4) + 0 AS value FROM z JOIN m USING (feat)"""


@query("prep_winsorise", _winsorised("avg(value)", "avg(z)"))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.winsorise(long, prep.fit_winsorise(train, ["feat"], 1.5), ["feat"], 1.5), 4)


@query("prep_winsorise_median", _winsorised("median(value)", "median(z)"))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.winsorise(long, prep.fit_winsorise(train, ["feat"], 1.5, median=True), ["feat"], 1.5), 4)


@query("prep_centre", _sql("SELECT feat, avg(value) AS centre FROM tr GROUP BY feat", "value - centre"))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.centred(long, prep.fit_mean(train, ["feat"]), ["feat"]))


@query("prep_standardise_by_group", _sql(f"SELECT grp, feat, avg(value) AS centre, {_SD} AS sd FROM tr GROUP BY grp, feat", _Z, "grp, feat"))
def _(spark, sf):
    train, long = _fit(spark, sf, "grp")
    return OUT(prep.standardise(long, prep.fit_standard(train, ["grp", "feat"]), ["grp", "feat"]))


@query("prep_group_normalise", _sql("SELECT grp, feat, avg(value) AS centre FROM tr GROUP BY grp, feat", "value * 100 / (centre + 1) - 100", "grp, feat"))
def _(spark, sf):
    train, long = _fit(spark, sf, "grp")
    return OUT(prep.group_normalise(long, prep.fit_mean(train, ["grp", "feat"]), ["grp", "feat"]))


@query("prep_unit_normalise", f"WITH {CASES_SQL}, m AS (SELECT feat, avg(value) AS centre FROM long WHERE case_id % 2 = 0 GROUP BY feat), p AS (SELECT feat, centre, sum(abs(value - centre)) AS norm FROM long JOIN m USING (feat) WHERE case_id % 2 = 0 GROUP BY feat, centre) SELECT case_id, feat, round(CASE WHEN value IS NULL THEN NULL WHEN norm > 0 THEN (value - centre) / norm ELSE 0 END, 9) + 0 AS value FROM long JOIN p USING (feat)")
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.unit_normalise(long, prep.fit_unit_norm(train, ["feat"]), ["feat"]), 9)


@query("prep_impute_mean", _sql("SELECT feat, avg(value) AS centre FROM tr GROUP BY feat", "coalesce(value, centre)", n=9))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.impute(long, prep.fit_mean(train, ["feat"]), ["feat"]), 9)


@query("prep_impute_row_median", f"WITH {CASES_SQL} SELECT case_id, feat, round(coalesce(value, median(value) OVER (PARTITION BY case_id)), 9) + 0 AS value FROM long")
def _(spark, sf):
    return OUT(prep.impute_row_median(_long(spark, sf), ["case_id"]), 9)


@query("prep_prune", f"WITH {CASES_SQL} SELECT feat FROM long GROUP BY feat HAVING count(*) = count(value) AND max(value) > min(value)")
def _(spark, sf):
    return prep.fit_prune(_long(spark, sf), ["feat"], 0.9)


@query("prep_discretise", _sql(f"SELECT feat, avg(value) AS centre, {_SD} AS sd FROM tr GROUP BY feat", "sign((value - centre) / sd) * (CAST(abs((value - centre) / sd) > 0.5 AS INT) + CAST(abs((value - centre) / sd) > 1 AS INT) + CAST(abs((value - centre) / sd) > 1.5 AS INT) + CAST(abs((value - centre) / sd) > 2 AS INT))"))
def _(spark, sf):
    train, long = _fit(spark, sf)
    return OUT(prep.discretise(long, prep.fit_standard(train, ["feat"]), ["feat"], 0.5, 0.5, 2.0))


@query("prep_bins", "SELECT p_partkey, CAST(p_size >= 5 AS INT) + CAST(p_size >= 15 AS INT) + CAST(p_size >= 30 AS INT) AS bin FROM part")
def _(spark, sf):
    return table(spark, sf, "part").select("p_partkey", prep.into_bins(F.col("p_size"), [5, 15, 30]).alias("bin"))


@query("prep_remove_offsets", _sql("SELECT grp, feat, avg(value) - any_value(m) AS o FROM tr JOIN (SELECT feat, avg(value) AS m FROM tr GROUP BY feat) USING (feat) GROUP BY grp, feat", "value - o", "grp, feat"))
def _(spark, sf):
    train, long = _fit(spark, sf, "grp")
    return OUT(prep.remove_offsets(long, prep.fit_offsets(train, "grp"), "grp"))


@query("prep_residuals", _sql("SELECT feat, regr_slope(value, site::DOUBLE) AS slope, regr_intercept(value, site::DOUBLE) AS cut FROM tr GROUP BY feat", "value - cut - slope * site"))
def _(spark, sf):
    train, long = _fit(spark, sf, "site")
    long, train = (x.withColumn("site", F.col("site").cast("double")) for x in (long, train))
    return OUT(prep.residuals(long, prep.fit_residual(train, ["feat"], "site"), ["feat"], "site"))


@query("prep_residuals_many")
def _(spark, sf):
    train, long = _fit(spark, sf, "site", "y")
    return OUT(prep.residuals_many(long, prep.fit_residuals_many(train, ["feat"], ["site", "y"]), ["feat"], ["site", "y"]))


@query("prep_disparate_impact")
def _(spark, sf):
    train, long = _fit(spark, sf, "grp")
    return OUT(prep.repair(long, prep.fit_repair(train, "grp", [0, 10, 20, 30, 40, 50, 60, 70, 80, 90, 100]), "grp", 0.8))


@query("prep_harmonise")
def _(spark, sf):
    long = array_to_long(table(spark, sf, "embeddings"), "vec_id", "embedding", ("label",)).withColumnRenamed("vec_id", "case_id")
    return OUT(prep.harmonise(long, prep.fit_batches(long.filter(TRAIN), "label"), "label"))


@query("prep_impute_knn")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), F.transform("embedding", lambda x, i: F.when((i + F.col("vec_id")) % 13 != 0, x.cast("double"))).alias("features"))
    near = neighbours.nearest(e.filter("case_id % 2 = 0"), e.filter("case_id % 2 = 1"), "case_id", "features", 5)
    long = e.select("case_id", F.posexplode("features").alias("feat", "value"))
    found = neighbours.impute_median(near, long, "case_id")
    gaps = long.filter("value is null and case_id % 2 = 1").select(F.col("case_id").alias("query"), "feat")
    return gaps.join(found, ["query", "feat"], "left").select(F.col("query").alias("case_id"), "feat", R("value").alias("value"))


_KNN = """d AS (SELECT q.vec_id AS query, t.vec_id AS vec_id, t.label, round(sqrt(list_sum(list_transform(list_zip(q.embedding, t.embedding), lambda x: (x[1]::DOUBLE - x[2]::DOUBLE) ** 2))), 9) AS distance
  FROM embeddings q JOIN embeddings t ON q.vec_id % 20 = 0 AND q.vec_id <> t.vec_id),
  k AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, vec_id) AS place FROM d QUALIFY place <= 7)"""


@query("knn_nearest", f"WITH {_KNN} SELECT query, vec_id, round(distance, 6) AS distance, place FROM k")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    n = neighbours.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 7)
    return n.select("query", "vec_id", R("distance").alias("distance"), "place")


@query("knn_vote", f"WITH {_KNN}, v AS (SELECT query, label, count(*) AS n FROM k GROUP BY ALL) SELECT query, label AS predicted, n / 7.0::DOUBLE AS share FROM v QUALIFY row_number() OVER (PARTITION BY query ORDER BY n DESC, label) = 1")
def _(spark, sf):
    e = table(spark, sf, "embeddings")
    n = neighbours.nearest(e, e.filter("vec_id % 20 = 0"), "vec_id", "embedding", 7)
    return neighbours.vote(n, e, "vec_id", "label")


# ---- folds
_FOLD = "row_number() OVER (PARTITION BY {} ORDER BY md5(case_id::VARCHAR || ':' || {}), case_id)"


@query("fold_stratified", f"WITH {CASES_SQL} SELECT case_id, cls, perm AS cv2_perm, CAST(({_FOLD.format('cls, perm', 'perm')} - 1) % 5 + 1 AS INT) AS cv2_fold FROM cases, (SELECT unnest([1, 2]) AS perm)")
def _(spark, sf):
    return folds.stratified(cases(spark, sf).select("case_id", "cls"), "case_id", ["cls"], 5, 2)


@query("fold_constrained", f"WITH {CASES_SQL} SELECT case_id, cls, grp, 1 AS cv2_perm, CAST(({_FOLD.format('cls, grp', '1')} - 1) % 4 + 1 AS INT) AS cv2_fold FROM cases")
def _(spark, sf):
    return folds.stratified(cases(spark, sf).select("case_id", "cls", "grp"), "case_id", ["cls", "grp"], 4)


@query("fold_nested", f"""WITH {CASES_SQL}, o AS (SELECT case_id, y, ({_FOLD.format('y', '1')} - 1) % 3 + 1 AS own FROM cases), s AS (SELECT case_id, y, own, f FROM o, (SELECT unnest([1, 2, 3]) AS f))
  SELECT case_id, y, 1 AS cv2_perm, CAST(f AS INT) AS cv2_fold, CAST(NULL AS INT) AS cv1_fold, 'test' AS role FROM s WHERE own = f
  UNION ALL SELECT case_id, y, 1, CAST(f AS INT), CAST(({_FOLD.format('y, f', '1')} - 1) % 2 + 1 AS INT), 'train' FROM s WHERE own <> f""")
def _(spark, sf):
    return folds.nested(cases(spark, sf).select("case_id", "y"), "case_id", ["y"], 3, 2)


@query("fold_leave_group_out", f"WITH {CASES_SQL} SELECT case_id, site, dense_rank() OVER (ORDER BY site) AS fold FROM cases")
def _(spark, sf):
    return folds.leave_group_out(cases(spark, sf).select("case_id", "site"), "site")


@query("fold_leave_one_out", "SELECT vec_id, row_number() OVER (ORDER BY vec_id) AS fold FROM embeddings")
def _(spark, sf):
    from ..operators.order import running

    e = table(spark, sf, "embeddings").select("vec_id").withColumn("_all", F.lit(1)).withColumn("n", F.lit(1).cast("long"))
    return running(e, ["_all"], "vec_id", ["n"]).select("vec_id", (F.col("before_n") + 1).alias("fold"))


@query("fold_one_vs_one", f"WITH {CASES_SQL}, p AS (SELECT * FROM (VALUES ('F', 'O'), ('F', 'P'), ('O', 'P')) t(a, b)) SELECT case_id, cls, a || '-' || b AS class_b, CASE WHEN cls = a THEN 1 ELSE -1 END AS y_b FROM cases JOIN p ON cls IN (a, b)")
def _(spark, sf):
    return folds.one_vs_one(cases(spark, sf).select("case_id", "cls"), "cls")


@query("fold_one_vs_all", f"WITH {CASES_SQL} SELECT case_id, cls, a AS class_b, CASE WHEN cls = a THEN 1 ELSE -1 END AS y_b FROM cases, (SELECT unnest(['F', 'O', 'P']) AS a)")
def _(spark, sf):
    return folds.one_vs_all(cases(spark, sf).select("case_id", "cls"), "cls")


@query("fold_undersample", f"WITH {CASES_SQL} (SELECT case_id, y FROM cases WHERE y > 0) UNION ALL (SELECT case_id, y FROM cases WHERE y < 0 ORDER BY md5(case_id::VARCHAR || ':42'), case_id LIMIT (SELECT CAST(floor(1.5 * count(*)) AS BIGINT) FROM cases WHERE y > 0))")
def _(spark, sf):
    return folds.undersampled(cases(spark, sf).select("case_id", "y"), "case_id", "y", 1.5)


# ---- ranking
@query("rank_variance", f"WITH {CASES_SQL} SELECT feat, round(var_samp(value), 5) + 0 AS weight FROM long GROUP BY feat")
def _(spark, sf):
    return rank.variance(_long(spark, sf)).select("feat", R("weight", 5).alias("weight"))


@query("rank_pearson", f"WITH {CASES_SQL} SELECT feat, CASE WHEN stddev_pop(value) > 0 THEN round(abs(corr(value, y::DOUBLE)), 6) ELSE 0 END + 0 AS weight FROM long GROUP BY feat")
def _(spark, sf):
    return rank.pearson(_long(spark, sf, "y"), "y").select("feat", R("weight").alias("weight"))


_AVG_RANK = "rank() OVER (PARTITION BY feat ORDER BY {0}) + (count(*) OVER (PARTITION BY feat, {0}) - 1) / 2.0::DOUBLE"


@query("rank_spearman", f"WITH {CASES_SQL}, r AS (SELECT feat, {_AVG_RANK.format('value')} AS a, {_AVG_RANK.format('y')} AS b FROM long WHERE value IS NOT NULL) SELECT feat, CASE WHEN stddev_pop(a) > 0 THEN round(abs(corr(a, b)), 6) ELSE 0 END + 0 AS weight FROM r GROUP BY feat")
def _(spark, sf):
    return rank.spearman(_long(spark, sf, "y"), "y").select("feat", R("weight").alias("weight"))


@query("rank_fscore", f"WITH {CASES_SQL}, s AS (SELECT feat, avg(value) FILTER (y > 0) AS a, avg(value) FILTER (y < 0) AS b, stddev_samp(value) FILTER (y > 0) + stddev_samp(value) FILTER (y < 0) AS d FROM long GROUP BY feat) SELECT feat, round(CASE WHEN d > 0 THEN (a - b) ** 2 / d ELSE 0 END, 9) + 0 AS weight FROM s")
def _(spark, sf):
    return rank.f_score(_long(spark, sf, "y"), "y").select("feat", R("weight", 9).alias("weight"))


@query("rank_auc", f"WITH {CASES_SQL}, r AS (SELECT feat, y, {_AVG_RANK.format('v')} AS r FROM (SELECT *, value::FLOAT::DOUBLE AS v FROM long WHERE value IS NOT NULL)) SELECT feat, round((sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y > 0) * count(*) FILTER (y < 0)), 6) AS weight FROM r GROUP BY feat")
def _(spark, sf):
    return rank.auc_rank(_long(spark, sf, "y"), "y").select("feat", R("weight").alias("weight"))


@query("rank_anova", f"""WITH {CASES_SQL}, g AS (SELECT feat, cls, count(value) AS n, avg(value) AS m, var_pop(value) AS v FROM long WHERE feat <> 'x4' GROUP BY feat, cls), a AS (SELECT feat, avg(value) AS am FROM long GROUP BY feat),
  s AS (SELECT feat, sum(n) AS n, count(*) AS k, sum(n * (m - am) ** 2) AS b, sum(n * v) AS w FROM g JOIN a USING (feat) GROUP BY feat) SELECT feat, round(b / (k - 1) / (w / (n - k)), 5) AS f, round(b / (b + w), 9) AS r2 FROM s""")
def _(spark, sf):
    return rank.anova(_long(spark, sf, "cls").filter("feat <> 'x4'"), "cls").select("feat", R("f", 5).alias("f"), R("r2", 9).alias("r2"))


_DISC = "disc AS (SELECT case_id, cls, feat, floor(value) AS value FROM long WHERE value IS NOT NULL AND feat IN ('x1', 'x2', 'x3'))"


@query("rank_mutual_information", f"WITH {CASES_SQL}, {_DISC}, j AS (SELECT feat, value, cls, count(*)::DOUBLE AS n FROM disc GROUP BY ALL) SELECT feat, round(sum(w), 6) AS weight FROM (SELECT feat, n / sum(n) OVER t * log2(n * sum(n) OVER t / sum(n) OVER (PARTITION BY feat, value) / sum(n) OVER (PARTITION BY feat, cls)) AS w FROM j WINDOW t AS (PARTITION BY feat)) GROUP BY feat")
def _(spark, sf):
    d = _long(spark, sf, "cls").filter("feat in ('x1', 'x2', 'x3')").withColumn("value", F.floor("value").cast("double"))
    return rank.mutual_information(d, "cls").select("feat", R("weight").alias("weight"))


@query("rank_mrmr")
def _(spark, sf):
    e = array_to_long(table(spark, sf, "embeddings").withColumn("embedding", F.slice("embedding", 1, 8)), "vec_id", "embedding", ("label",))
    d = e.select(F.col("vec_id").alias("case_id"), F.col("label").alias("cls"), F.concat(F.lit("e"), "feat").alias("feat"), F.floor(F.col("value") * 8).cast("double").alias("value"))
    relevance = {r["feat"]: r["weight"] for r in rank.mutual_information(d, "cls").collect()}
    redundancy = {(r["a"], r["b"]): r["mi"] for r in rank.pair_information(d, "case_id").collect()}
    return spark.createDataFrame([(i + 1, f) for i, f in enumerate(rank.mrmr(relevance, redundancy, 3))], "place int, feat string")


@query("rank_top", f"WITH {CASES_SQL} SELECT feat, round(var_samp(value), 5) AS weight FROM long GROUP BY feat ORDER BY 2 DESC, 1 LIMIT 2")
def _(spark, sf):
    return rank.top(rank.variance(_long(spark, sf)), 2).select("feat", R("weight", 5).alias("weight"))


@query("rank_weighting", f"WITH {CASES_SQL}, w AS (SELECT feat, var_samp(value) AS v FROM long GROUP BY feat), s AS (SELECT feat, (v - min(v) OVER ()) / (max(v) OVER () - min(v) OVER ()) AS w FROM w) SELECT case_id, feat, round(value * w ** 2, 6) + 0 AS value FROM long JOIN s USING (feat)")
def _(spark, sf):
    long = _long(spark, sf)
    return OUT(rank.weigh(long, rank.scaled(rank.variance(long)), 2.0))


@query("subspace_agreement", "SELECT learner AS feature, 1.0::DOUBLE AS agreement FROM (SELECT unnest(range(1, 6)) AS learner)")
def _(spark, sf):
    from ..operators.ensemble import agreed_features

    s = scores(spark, sf).select("case_id", F.col("learner").alias("feature"))
    return agreed_features(s, "feature", table(spark, sf, "labels").count(), 0.5)
