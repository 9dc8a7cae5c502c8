"""Queries over whole flows and learners."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import folds, learn
from ..plans import flow
from ..sources.tables import CASES_SQL, array_to_long, cases, scores, table

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


def _flow(steps: list[str]):
    def run(spark, sf):
        e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding", F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
        own = folds.stratified(e.select("case_id", "y"), "case_id", ["y"], 5)
        rows = flow.by_fold(array_to_long(e, "case_id", "embedding", ("y",)), own, "case_id", "cv2_fold", 5)
        scored = flow.nearest_mean(rows, "case_id", "y", flow.Sequence(steps, ["fold", "feat"]))
        r = flow.fold_report(scored, "y")
        return r.select("fold", "n", R("bac", 5).alias("bac"), R("auc", 5).alias("auc"))

    return run


def _flow_sql(made: str) -> str:
    return f"""WITH e AS (SELECT vec_id AS case_id, embedding, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings),
  f AS (SELECT case_id, (row_number() OVER (PARTITION BY y ORDER BY md5(case_id::VARCHAR || ':1'), case_id) - 1) % 5 + 1 AS own FROM e),
  l AS (SELECT case_id, y, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) AS feat FROM e),
  r AS (SELECT l.*, fold, own = fold AS in_test FROM l JOIN f USING (case_id), (SELECT unnest(range(1, 6)) AS fold)),
  p AS (SELECT fold, feat, avg(value) AS centre, stddev_samp(value) AS sd, min(value) AS lo, max(value) AS hi FROM r WHERE NOT in_test GROUP BY fold, feat),
  z AS (SELECT case_id, y, fold, feat, in_test, {made} AS z FROM r JOIN p USING (fold, feat)),
  w AS (SELECT fold, feat, avg(z) FILTER (y > 0) - avg(z) FILTER (y < 0) AS w FROM z WHERE NOT in_test GROUP BY fold, feat),
  s AS (SELECT fold, case_id, y, sum(z * w) AS score FROM z JOIN w USING (fold, feat) WHERE in_test GROUP BY ALL),
  k AS (SELECT fold, y, score, rank() OVER (PARTITION BY fold ORDER BY score::FLOAT) + (count(*) OVER (PARTITION BY fold, score::FLOAT) - 1) / 2.0::DOUBLE AS r FROM s)
  SELECT CAST(fold AS INT) AS fold, count(*) AS n, round((count(*) FILTER (y > 0 AND score > 0) / count(*) FILTER (y > 0 AND score <> 0) + count(*) FILTER (y < 0 AND score < 0) / count(*) FILTER (y < 0 AND score <> 0)) * 50, 5) AS bac,
    round((sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y > 0) * count(*) FILTER (y < 0)), 5) AS auc FROM k GROUP BY fold"""


query("flow_nearest_mean", _flow_sql("round((value - centre) / sd, 9)"))(_flow(["standardise"]))
query("flow_scaled_nearest_mean", _flow_sql("(value - lo) / (hi - lo) - 0"))(_flow(["scale"]))


_MD5 = "md5(case_id::VARCHAR || ':1'), case_id"
_NESTED_SQL = f"""WITH e AS (SELECT vec_id AS case_id, embedding, CASE WHEN label < 5 THEN 1 ELSE -1 END AS y FROM embeddings),
  o AS (SELECT case_id, y, (row_number() OVER (PARTITION BY y ORDER BY {_MD5}) - 1) % 5 + 1 AS own FROM e), s AS (SELECT case_id, y, own, f FROM o, (SELECT unnest(range(1, 6)) AS f)),
  t AS (SELECT case_id, y, f AS f2, (row_number() OVER (PARTITION BY y, f ORDER BY {_MD5}) - 1) % 3 + 1 AS f1 FROM s WHERE own <> f),
  l AS (SELECT case_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) AS i FROM e),
  m AS (SELECT f2, g.f1, i, avg(v) AS c, stddev_samp(v) AS sd, avg(v) FILTER (y > 0) - avg(v) FILTER (y < 0) AS d FROM t JOIN l USING (case_id), (SELECT unnest(range(1, 4)) AS f1) g WHERE t.f1 <> g.f1 GROUP BY f2, g.f1, i),
  r AS (SELECT *, d / sd AS w, row_number() OVER (PARTITION BY f2, f1 ORDER BY abs(d / sd) DESC, i) AS r FROM m), k AS (SELECT unnest([4, 16, 64]) AS k),
  n AS (SELECT t.f2, t.f1, k, case_id, y, sum((v - c) / sd * w) AS s FROM t JOIN l USING (case_id) JOIN r ON r.f2 = t.f2 AND r.f1 = t.f1 AND r.i = l.i JOIN k ON r.r <= k.k GROUP BY ALL),
  b AS (SELECT f2, f1, k, (avg(CAST(s > 0 AS INT)) FILTER (y > 0) + avg(CAST(s <= 0 AS INT)) FILTER (y < 0)) * 50 AS bac FROM n GROUP BY ALL),
  p AS (SELECT f2, k, a FROM (SELECT f2, k, round(avg(bac), 6) AS a FROM b GROUP BY ALL) QUALIFY row_number() OVER (PARTITION BY f2 ORDER BY a DESC, k) = 1),
  z AS (SELECT s.f AS f2, case_id, y, sum((v - c) / sd * w) AS sc FROM s JOIN p ON p.f2 = s.f JOIN l USING (case_id) JOIN r ON r.f2 = s.f AND r.i = l.i AND r.r <= p.k WHERE s.own = s.f GROUP BY ALL)
  SELECT CAST(f2 AS INT) AS fold, CAST(k AS INT) AS k, round(a, 4) AS inner_bac, count(*) AS n, round((avg(CAST(sc > 0 AS INT)) FILTER (y > 0) + avg(CAST(sc <= 0 AS INT)) FILTER (y < 0)) * 50, 4) AS bac FROM z JOIN p USING (f2) GROUP BY f2, k, a"""


@query("flow_nested", _NESTED_SQL)
def _(spark, sf):
    e = table(spark, sf, "embeddings").select(F.col("vec_id").alias("case_id"), "embedding", F.when(F.col("label") < 5, 1).otherwise(-1).alias("y"))
    own = folds.nested(e.select("case_id", "y"), "case_id", ["y"], 5, 3)
    r = flow.nested_nearest_mean(e, own, "case_id", "y", "embedding", [4, 16, 64], 3)
    return r.select("fold", "k", R("inner_bac", 4).alias("inner_bac"), "n", R("bac", 4).alias("bac"))


def _data(spark, sf, cls):
    e = table(spark, sf, "embeddings").withColumn("cls", cls)
    v = learn.vectors(e, "embedding", "cls").select("vec_id", "features", "label", "embedding")
    return v.filter("vec_id % 2 = 0"), v.filter("vec_id % 2 = 1")


def _classify(name, **options):
    def run(spark, sf):
        train, test = _data(spark, sf, (F.col("label") < 5).cast("int"))
        return learn.predict(name, train, test, "vec_id", **options)

    return run


for _name, _options in (("logistic", {}), ("elastic_net", {}), ("linear_svm", {}), ("tree", {}), ("forest", {}), ("boosting", {}), ("perceptron", {"layers": [64, 8, 2]}), ("bayes", {})):
    query(f"learn_{_name}")(_classify(_name, **_options))


def _regress(name):
    def run(spark, sf):
        c = cases(spark, sf).na.drop(subset=["x1", "x2"]).withColumn("a", F.array("x2", "x3"))
        v = learn.vectors(c, "a", "x1").select("case_id", "features", "label", (F.col("y") > 0).cast("double").alias("censor"))
        return learn.predict(name, v.filter("case_id % 2 = 0"), v.filter("case_id % 2 = 1"), "case_id")

    return run


_OLS = f"""WITH {CASES_SQL}, d AS (SELECT * FROM cases WHERE x1 IS NOT NULL AND x2 IS NOT NULL), t AS (SELECT * FROM d WHERE case_id % 2 = 0),
  m AS (SELECT avg(x1) AS my, avg(x2) AS m2, avg(x3) AS m3, var_pop(x2) AS s22, var_pop(x3) AS s33, covar_pop(x2, x3) AS s23, covar_pop(x2, x1) AS c2, covar_pop(x3, x1) AS c3 FROM t),
  b AS (SELECT *, (c2 * s33 - c3 * s23) / (s22 * s33 - s23 * s23) AS b2, (c3 * s22 - c2 * s23) / (s22 * s33 - s23 * s23) AS b3 FROM m)
  SELECT case_id, round(my + b2 * (x2 - m2) + b3 * (x3 - m3), 6) AS prediction FROM d, b WHERE case_id % 2 = 1"""


def _rounded(run):
    return lambda spark, sf: run(spark, sf).withColumn("prediction", R("prediction"))


query("learn_linear", _OLS)(_rounded(_regress("linear")))
query("learn_glm", _OLS)(_rounded(_regress("glm")))
for _name in ("lasso", "tree_regression", "forest_regression", "boosting_regression", "survival"):
    query(f"learn_{_name}")(_regress(_name))


@query("learn_isotonic")
def _(spark, sf):
    s = scores(spark, sf).filter("learner = 1").select("case_id", F.col("score").alias("features"), ((F.col("y") + 1) / 2).alias("label"))
    return learn.predict("isotonic", s, s, "case_id")


@query("learn_detrend", f"WITH {CASES_SQL}, d AS (SELECT case_id, x1, 0.5::DOUBLE * x1 + x3 / 50 AS p FROM cases WHERE x1 IS NOT NULL), b AS (SELECT regr_slope(p, x1) AS s, regr_intercept(p, x1) AS i FROM d WHERE case_id % 2 = 0) SELECT case_id, round((p - i) / s, 6) AS corrected FROM d, b")
def _(spark, sf):
    d = cases(spark, sf).filter("x1 is not null").select("case_id", "x1", (0.5 * F.col("x1") + F.col("x3") / 50).alias("p"))
    b = d.filter("case_id % 2 = 0").agg(F.regr_slope("p", "x1").alias("s"), F.regr_intercept("p", "x1").alias("i"))
    return d.crossJoin(F.broadcast(b)).select("case_id", R((F.col("p") - F.col("i")) / F.col("s")).alias("corrected"))  # one row


@query("learn_components")
def _(spark, sf):
    train, test = _data(spark, sf, F.col("label"))
    c = learn.components(train, test, "vec_id", 3)
    return c.select("vec_id", *[R(F.col("scores")[i]).alias(f"pc{i + 1}") for i in range(3)])


@query("learn_nmf")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.transform("embedding", lambda x: F.abs(x.cast("double"))).alias("f"))
    return learn.nmf(e, "vec_id", "f", 4)


@query("learn_grid")
def _(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("f"), F.col("label").cast("double").alias("y"))
    own = folds.stratified(e.select("vec_id", "y"), "vec_id", ["y"], 3).select(F.col("vec_id").alias("_v"), "cv2_fold")
    rows = e.join(own, F.col("vec_id") == F.col("_v")).withColumn("fold", F.explode(F.sequence(F.lit(1), F.lit(3)))).withColumn("in_test", F.col("cv2_fold") == F.col("fold"))
    return learn.ridge_grid(rows, ["fold"], "f", "y", "in_test", [0.01, 0.1, 1.0, 10.0])


@query("learn_stacking")
def _(spark, sf):
    s = scores(spark, sf).groupBy("case_id", "y").pivot("learner", [1, 2, 3, 4, 5]).agg(F.first("score")).withColumn("a", F.array("`1`", "`2`", "`3`", "`4`", "`5`")).withColumn("l", (F.col("y") + 1) / 2)
    v = learn.vectors(s, "a", "l")
    return learn.predict("logistic", v.filter("case_id % 2 = 0"), v.filter("case_id % 2 = 1"), "case_id")


@query("learn_permutation_importance")
def _(spark, sf):
    train, test = _data(spark, sf, (F.col("label") < 5).cast("int"))
    model = learn.LEARNERS["logistic"]().fit(train)
    own = test.select(F.col("embedding").cast("array<double>").alias("a"), "label")
    return learn.permutation_importance(model, own, "a", "label", [0, 1, 2])
