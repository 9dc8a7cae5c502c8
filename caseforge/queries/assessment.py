"""Queries over measures, calibration, ensembles, decoding and significance."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import ensemble, metrics, significance
from ..sources.tables import CASES_SQL, SCORES_SQL, cases, scores, table

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
PART = ["learner"]
_CONF = f"""WITH {SCORES_SQL}, c AS (SELECT learner, count(*) FILTER (y > 0 AND score > 0)::DOUBLE AS tp, count(*) FILTER (y < 0 AND score > 0)::DOUBLE AS fp, count(*) FILTER (y < 0 AND score < 0)::DOUBLE AS tn,
  count(*) FILTER (y > 0 AND score < 0)::DOUBLE AS fn, count(*)::DOUBLE AS n, count(*) FILTER (y > 0)::DOUBLE AS n_pos FROM scores WHERE y <> 0 GROUP BY learner),
  m AS (SELECT *, tp / (tp + fn) AS se, tn / (tn + fp) AS sp, tp / (tp + fp) AS pp, tn / (tn + fn) AS np FROM c)"""
#: Each measure's formula, on the counts and on se, sp, pp, np.
FORMULAS = {
    "accuracy": "(tp + tn) / n * 100",
    "sensitivity": "se * 100",
    "specificity": "sp * 100",
    "tpr": "tp / n_pos * 100",
    "fpr": "(1 - sp) * 100",
    "ppv": "pp * 100",
    "npv": "np * 100",
    "bac": "(se + sp) * 50",
    "bac2": "se * sp * 100",
    "gmean": "sqrt(se * sp)",
    "fscore": "2 * pp * se / (pp + se) * 100",
    "mcc": "(tp * tn - fp * fn) / sqrt((tp + fp) * (tp + fn) * (tn + fp) * (tn + fn))",
    "psi": "(pp + np) * 100 - 100",
    "nnp": "abs(1 / (pp + np - 1))",
    "dor": "se * sp / ((1 - se) * (1 - sp))",
    "plr": "se / (1 - sp)",
    "nlr": "sp / (1 - se)",
    "nlr_standard": "(1 - se) / sp",
    "kappa": "((tp + tn) / (tp + tn + fp + fn) - e) / (1 - e)",
    "allparam_gmean": "sqrt(se + sp)",
    "allparam_fscore": "2 * pp * se / (pp + se)",
    "allparam_nlr": "(1 - se) / sp",
    "allparam_dor": "se / (1 - sp) / ((1 - se) / sp)",
}
_CHANCE = "((tp + fp) * (tp + fn) + (tn + fn) * (tn + fp)) / ((tp + tn + fp + fn) * (tp + tn + fp + fn))"


@query("metric_counts", f"{_CONF} SELECT learner, tp, fp, tn, fn, n, n_pos FROM c")
def _(spark, sf):
    return metrics.confusion(scores(spark, sf), PART)


def _measure(name: str):
    def run(spark, sf):
        return metrics.confusion(scores(spark, sf), PART).select("learner", R(metrics.measures()[name]).alias(name))

    return run


for _name, _formula in FORMULAS.items():
    query(f"metric_{_name}", f"{_CONF} SELECT learner, round({_formula}, 6) + 0 AS {_name} FROM (SELECT *, {_CHANCE} AS e FROM m)")(_measure(_name))


@query("metric_allparam", f"{_CONF} SELECT learner, " + ", ".join(f"round({f}, 6) + 0 AS {k}" for k, f in FORMULAS.items()) + f" FROM (SELECT *, {_CHANCE} AS e FROM m)")
def _(spark, sf):
    return metrics.confusion(scores(spark, sf), PART).select("learner", *[R(c).alias(k) for k, c in metrics.measures().items()])


_AUC = f"""WITH {SCORES_SQL}, r AS (SELECT learner, y, rank() OVER (PARTITION BY learner ORDER BY score) + (count(*) OVER (PARTITION BY learner, score) - 1) / 2.0::DOUBLE AS r FROM scores),
  a AS (SELECT learner, count(*) FILTER (y > 0) AS n_pos, count(*) FILTER (y < 0) AS n_neg, (sum(r) FILTER (y > 0) - count(*) FILTER (y > 0) * (count(*) FILTER (y > 0) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y > 0) * count(*) FILTER (y < 0)) AS auc FROM r GROUP BY learner)"""


@query("metric_auc", f"{_AUC} SELECT learner, n_pos, n_neg, round(auc, 6) AS auc FROM a")
def _(spark, sf):
    return metrics.auc(scores(spark, sf), PART).withColumn("auc", R("auc"))


@query("metric_auc_interval", f"""{_AUC}, s AS (SELECT *, sqrt((auc * (1 - auc) + (n_pos - 1) * (auc / (2 - auc) - auc * auc) + (n_neg - 1) * (2 * auc * auc / (1 + auc) - auc * auc)) / (n_pos * n_neg)) AS se FROM a)
  SELECT learner, round(auc - 1.96::DOUBLE * se, 6) AS low, round(auc + 1.96::DOUBLE * se, 6) AS high FROM s""")
def _(spark, sf):
    a = metrics.auc(scores(spark, sf), PART)
    low, high = metrics.auc_interval(F.col("auc"), F.col("n_pos"), F.col("n_neg"))
    return a.select("learner", R(low).alias("low"), R(high).alias("high"))


@query("metric_roc", f"""WITH {SCORES_SQL}, g AS (SELECT learner, score AS threshold, count(*) FILTER (y > 0) AS p, count(*) FILTER (y < 0) AS q FROM scores GROUP BY learner, score)
  SELECT learner, threshold, round(sum(q) OVER w / sum(q) OVER (PARTITION BY learner), 6) AS fpr, round(sum(p) OVER w / sum(p) OVER (PARTITION BY learner), 6) AS tpr FROM g WINDOW w AS (PARTITION BY learner ORDER BY threshold DESC)""")
def _(spark, sf):
    return metrics.roc(scores(spark, sf), PART).select("learner", "threshold", R("fpr").alias("fpr"), R("tpr").alias("tpr"))


_REG = f"WITH {CASES_SQL}, e AS (SELECT grp, x1 AS a, 2 + 0.1::DOUBLE * x3 / 5 AS b FROM cases WHERE x1 IS NOT NULL)"


@query("metric_regression", f"{_REG} SELECT grp, round(avg((b - a) ** 2), 6) AS mse, round(avg(abs(b - a)), 6) AS maerr, round(sqrt(avg((b - a) ** 2)), 6) AS rmsd, round(sqrt(avg((b - a) ** 2)) / (max(a) - min(a)) * 100, 6) AS nrmsd, round(sqrt(sum((b - a) ** 2) / sum(a * a)) * 100, 6) AS nrsmd, round(corr(a, b), 6) AS cc, round(corr(a, b) ** 2 * 100, 6) AS scc FROM e GROUP BY grp")
def _(spark, sf):
    c = cases(spark, sf).withColumn("b", 2 + 0.1 * F.col("x3") / 5)
    m = metrics.errors(c, ["grp"], "x1", "b")
    return m.select("grp", *[R(x).alias(x) for x in m.columns if x != "grp"])


@query("metric_calibration", f"""WITH {SCORES_SQL}, b AS (SELECT learner, (y + 1) / 2 AS l, p, ntile(10) OVER (PARTITION BY learner ORDER BY p, case_id) AS bin FROM scores),
  g AS (SELECT learner, bin, count(*) AS n, abs(avg(l) - avg(p)) AS gap FROM b GROUP BY ALL) SELECT g.learner, round(sum(n * gap) / sum(n), 6) AS ece, round(max(gap), 6) AS mce, any_value(brier) AS brier FROM g JOIN (SELECT learner, round(avg((p - l) ** 2), 6) AS brier FROM b GROUP BY learner) USING (learner) GROUP BY g.learner""")
def _(spark, sf):
    s = scores(spark, sf).withColumn("l", (F.col("y") + 1) / 2)
    c = metrics.calibration(s, PART, "l", "p", "case_id", 10)
    return c.select("learner", R("ece").alias("ece"), R("mce").alias("mce"), R("brier").alias("brier"))


@query("metric_calibration_bins", f"WITH {SCORES_SQL} SELECT case_id, learner, ntile(7) OVER (PARTITION BY learner ORDER BY p, case_id) AS bin FROM scores")
def _(spark, sf):
    return metrics.equal_bins(scores(spark, sf), PART, "p", "case_id", 7).select("case_id", "learner", "bin")


@query("metric_probability_bins", f"WITH {SCORES_SQL} SELECT learner, round(p, 1) AS p, count(*) AS n, round(avg((y + 1) / 2), 6) AS rate FROM scores GROUP BY learner, round(p, 1)")
def _(spark, sf):
    s = scores(spark, sf)
    return s.groupBy("learner", F.round("p", 1).alias("p")).agg(F.count(F.lit(1)).alias("n"), R(F.avg((F.col("y") + 1) / 2)).alias("rate"))


@query("metric_net_benefit", f"WITH {SCORES_SQL}, t AS (SELECT unnest([0.1::DOUBLE, 0.25, 0.5, 0.75]) AS threshold), g AS (SELECT learner, threshold, count(*) FILTER (p >= threshold AND y > 0) AS tp, count(*) FILTER (p >= threshold AND y < 0) AS fp, count(*) AS n, count(*) FILTER (y > 0) AS pos FROM scores, t GROUP BY ALL) SELECT learner, threshold, round(tp / n - fp / n * (threshold / (1 - threshold)), 6) + 0 AS net_benefit, round(pos / n - (1 - pos / n) * (threshold / (1 - threshold)), 6) + 0 AS treat_all FROM g")
def _(spark, sf):
    s = scores(spark, sf).withColumn("l", (F.col("y") + 1) / 2)
    m = metrics.net_benefit(s, PART, "l", "p", [0.1, 0.25, 0.5, 0.75])
    return m.select("learner", "threshold", R("net_benefit").alias("net_benefit"), R("treat_all").alias("treat_all"))


_MULTI = "g AS (SELECT cls AS e, CASE WHEN case_id % 4 = 0 THEN 'F' WHEN case_id % 5 = 0 THEN 'O' ELSE cls END AS p FROM cases)"


def _multi(spark, sf):
    made = F.when(F.col("case_id") % 4 == 0, "F").when(F.col("case_id") % 5 == 0, "O").otherwise(F.col("cls"))
    return cases(spark, sf).select(F.col("cls").alias("e"), made.alias("p"))


@query("metric_confusion_matrix", f"WITH {CASES_SQL}, {_MULTI} SELECT e, p, count(*) AS n FROM g GROUP BY e, p")
def _(spark, sf):
    return metrics.confusion_matrix(_multi(spark, sf), "e", "p")


@query("metric_one_vs_rest", f"WITH {CASES_SQL}, {_MULTI}, c AS (SELECT k AS cls, count(*) FILTER (e = k AND p = k) AS tp, count(*) FILTER (e <> k AND p = k) AS fp, count(*) FILTER (e = k AND p <> k) AS fn, count(*) FILTER (e <> k AND p <> k) AS tn FROM g, (SELECT DISTINCT e AS k FROM g) GROUP BY k) SELECT *, round((tp / (tp + fn) + tn / (tn + fp)) * 50, 6) AS bac FROM c")
def _(spark, sf):
    m = metrics.one_vs_rest(metrics.confusion_matrix(_multi(spark, sf), "e", "p"), "e", "p")
    return m.select("cls", *[F.col(c).cast("long").alias(c) for c in ("tp", "fp", "fn", "tn")], R("bac").alias("bac"))


@query("metric_multi_accuracy", f"WITH {CASES_SQL}, {_MULTI} SELECT round(avg(CAST(e = p AS INT)) * 100, 6) AS accuracy FROM g")
def _(spark, sf):
    return _multi(spark, sf).agg(R(F.avg((F.col("e") == F.col("p")).cast("int")) * 100).alias("accuracy"))


# ---- ensembles
def _tail(p: float) -> str:
    pos = f"greatest(1.0::DOUBLE, least(n::DOUBLE, n * {p} / 100 + 0.5))"
    return f"l[CAST(floor({pos}) AS INT)] + (l[CAST(ceil({pos}) AS INT)] - l[CAST(floor({pos}) AS INT)]) * ({pos} - floor({pos}))"


@query("ens_summary", f"WITH {SCORES_SQL}, g AS (SELECT case_id, count(score) AS n, list(score ORDER BY score) AS l, round(avg(score), 6) + 0 AS mean, round(median(score), 6) + 0 AS median, round(stddev_samp(score), 6) AS sd, round(avg(CAST(score > 0 AS INT)), 6) AS p_positive FROM scores GROUP BY case_id) SELECT case_id, n, mean, median, sd, p_positive, round({_tail(2.5)}, 6) + 0 AS low, round({_tail(97.5)}, 6) + 0 AS high FROM g")
def _(spark, sf):
    s = ensemble.summary(scores(spark, sf), "case_id")
    return s.select("case_id", "n", *[R(c).alias(c) for c in ("mean", "median", "sd", "p_positive", "low", "high")])


@query("ens_decision", f"WITH {SCORES_SQL} SELECT case_id, CASE WHEN round(avg(score), 9) >= 0 THEN 1 ELSE -1 END AS decision FROM scores GROUP BY case_id")
def _(spark, sf):
    s = scores(spark, sf)
    return ensemble.decision(s.withColumn("score", F.col("score").cast("decimal(18,6)")), "case_id")


@query("ens_majority", f"WITH {SCORES_SQL}, v AS (SELECT case_id, CAST(floor(score * 2) AS BIGINT) AS label, count(*) AS n FROM scores GROUP BY ALL) SELECT case_id, label, n / sum(n) OVER (PARTITION BY case_id) AS share FROM v QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY n DESC, label) = 1")
def _(spark, sf):
    return ensemble.majority(scores(spark, sf).withColumn("label", F.floor(F.col("score") * 2)), "case_id", "label")


_PAIRS = "d AS (SELECT case_id, CASE learner WHEN 1 THEN 'A' WHEN 2 THEN 'A' ELSE 'B' END AS a, CASE learner WHEN 1 THEN 'B' ELSE 'C' END AS b, score FROM scores WHERE learner <= 3)"


@query("ens_max_wins", f"WITH {SCORES_SQL}, {_PAIRS}, t AS (SELECT case_id, CASE WHEN score > 0 THEN a ELSE b END AS cls, sum(abs(score)) AS total FROM d WHERE score <> 0 GROUP BY ALL) SELECT case_id, cls, round(total, 6) AS total FROM t QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(total, 9) DESC, cls) = 1")
def _(spark, sf):
    s = scores(spark, sf).filter("learner <= 3").withColumn("a", F.when(F.col("learner") <= 2, "A").otherwise("B")).withColumn("b", F.when(F.col("learner") == 1, "B").otherwise("C"))
    m = ensemble.max_wins(s.withColumn("score", F.col("score").cast("decimal(18,6)")), "case_id")
    return m.select("case_id", "cls", R(F.col("total").cast("double")).alias("total"))


_CODE = [("A", [1, 1, 0]), ("B", [-1, 0, 1]), ("C", [0, -1, -1])]
_LOSS = {"hamming": "sum(abs(sign(score) - w) / 2.0::DOUBLE)", "euclidean": "sqrt(sum((score - w) ** 2))", "linear": "sum(-score * w)"}


def _codes(loss: str):
    def run(spark, sf):
        c = ensemble.codes(scores(spark, sf).filter("learner <= 3"), "case_id", _CODE, loss)
        return c.select("case_id", "cls", R("distance").alias("distance"))

    return run


for _loss, _formula in _LOSS.items():
    _values = ", ".join(f"('{c}', {i + 1}, {w})" for c, word in _CODE for i, w in enumerate(word))
    query(f"ens_codes_{_loss}", f"WITH {SCORES_SQL}, c AS (SELECT * FROM (VALUES {_values}) t(cls, learner, w)), d AS (SELECT case_id, cls, {_formula} AS distance FROM scores JOIN c USING (learner) GROUP BY case_id, cls) SELECT case_id, cls, round(distance, 6) + 0 AS distance FROM d QUALIFY row_number() OVER (PARTITION BY case_id ORDER BY round(distance, 9), cls) = 1")(_codes(_loss))


@query("ens_diversity", f"WITH {SCORES_SQL}, c AS (SELECT case_id, avg(CAST(score * y > 0 AS INT)) AS r, avg(CAST(score > 0 AS INT)) AS v, count(*) AS m FROM scores GROUP BY case_id) SELECT round(avg(CAST(r BETWEEN 0.25 AND 0.75 AS INT)), 6) AS diversity, round(avg(CASE WHEN v > 0 AND v < 1 THEN -(v * log2(v) + (1 - v) * log2(1 - v)) ELSE 0 END), 6) AS entropy, round(1 - avg(r * (1 - r) * m / (m - 1)) / (avg(r) * (1 - avg(r))), 6) AS kappa FROM c")
def _(spark, sf):
    d = ensemble.diversity(scores(spark, sf), "case_id")
    return d.select(*[R(c).alias(c) for c in d.columns])


@query("ens_ambiguity", f"WITH {SCORES_SQL} SELECT round(avg((score - m) ** 2), 6) AS ambiguity FROM (SELECT score, median(score) OVER (PARTITION BY case_id) AS m FROM scores)")
def _(spark, sf):
    return ensemble.ambiguity(scores(spark, sf), "case_id").select(R("ambiguity").alias("ambiguity"))


@query("ens_bias_variance", f"WITH {SCORES_SQL}, c AS (SELECT y, avg(CAST(score > 0 AS INT)) AS p FROM scores GROUP BY case_id, y), b AS (SELECT CAST((CASE WHEN p >= 0.5 THEN 1 ELSE -1 END) <> y AS INT) AS bias, CASE WHEN p >= 0.5 THEN 1 - p ELSE p END AS v FROM c) SELECT round(avg(bias), 6) AS bias, round(avg(CASE WHEN bias = 0 THEN v ELSE 0 END), 6) AS var_unbiased, round(avg(CASE WHEN bias = 1 THEN v ELSE 0 END), 6) AS var_biased FROM b")
def _(spark, sf):
    b = ensemble.bias_variance(scores(spark, sf), "case_id")
    return b.select(*[R(c).alias(c) for c in b.columns])


@query("ens_sign_consistency", f"WITH {CASES_SQL} SELECT site, round(abs(count(*) FILTER (v > 0) - count(*) FILTER (v < 0)) / count(v) * (count(v) / count(*)), 6) AS consistency FROM (SELECT site, x1 - 2.5::DOUBLE AS v FROM cases) GROUP BY site")
def _(spark, sf):
    c = cases(spark, sf).withColumn("v", F.col("x1") - 2.5)
    return ensemble.sign_consistency(c, "site", "v").select("site", R("consistency").alias("consistency"))


# ---- significance
_P = "p AS (SELECT p_partkey AS test, ((p_partkey * 37) % 1009 + 1) / 1010.0::DOUBLE AS p FROM part)"


def _tests(spark, sf):
    return table(spark, sf, "part").select(F.col("p_partkey").alias("test"), (((F.col("p_partkey") * 37) % 1009 + 1) / F.lit(1010.0)).alias("p"))


@query("stat_bh", f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM p) SELECT test, p, round(least(1, min(p * m / r) OVER (ORDER BY r DESC)), 9) AS adjusted FROM r")
def _(spark, sf):
    return significance.fdr(_tests(spark, sf), "test").withColumn("adjusted", R("adjusted", 9))


@query("stat_by", f"WITH {_P}, r AS (SELECT *, row_number() OVER (ORDER BY p, test) AS r, count(*) OVER () AS m FROM p) SELECT test, p, round(least(1, min(p * m / r * (SELECT sum(1.0::DOUBLE / k) FROM (SELECT unnest(range(1, 1000001)) AS k) WHERE k <= (SELECT count(*) FROM p))) OVER (ORDER BY r DESC)), 9) AS adjusted FROM r")
def _(spark, sf):
    return significance.fdr(_tests(spark, sf), "test", dependent=True).withColumn("adjusted", R("adjusted", 9))


@query("stat_holm", f"WITH {_P}, r AS (SELECT *, p * (count(*) OVER () - row_number() OVER (ORDER BY p, test) + 1) AS x, row_number() OVER (ORDER BY p, test) AS r FROM p) SELECT test, p, round(greatest(x, coalesce(lag(x) OVER (ORDER BY r), x)), 9) AS adjusted FROM r")
def _(spark, sf):
    return significance.holm(_tests(spark, sf), "test").withColumn("adjusted", R("adjusted", 9))


def _right(spark, sf):
    s = scores(spark, sf).withColumn("ok", (F.col("score") * F.col("y") > 0).cast("int"))
    a, b = s.filter("learner = 1").select("case_id", F.col("ok").alias("a")), s.filter("learner > 1").select("case_id", "learner", F.col("ok").alias("b"))
    return a.join(b, "case_id")


@query("stat_mcnemar", f"WITH {SCORES_SQL}, s AS (SELECT *, CAST(score * y > 0 AS INT) AS ok FROM scores), g AS (SELECT b.learner, count(*) FILTER (a.ok = 1 AND b.ok = 0)::DOUBLE AS only_a, count(*) FILTER (a.ok = 0 AND b.ok = 1)::DOUBLE AS only_b FROM s a JOIN s b USING (case_id) WHERE a.learner = 1 AND b.learner > 1 GROUP BY b.learner) SELECT learner, only_a, only_b, round(greatest(abs(only_a - only_b) - 1, 0) ** 2 / (only_a + only_b), 6) AS chi2 FROM g")
def _(spark, sf):
    return significance.mcnemar(_right(spark, sf), "a", "b", PART).select("learner", "only_a", "only_b", R("chi2").alias("chi2"))


_RANKED = "r AS (SELECT case_id, learner, score, rank() OVER (PARTITION BY case_id ORDER BY score) + (count(*) OVER (PARTITION BY case_id, score) - 1) / 2.0::DOUBLE AS r, max(score) OVER (PARTITION BY case_id) - min(score) OVER (PARTITION BY case_id) AS w FROM scores)"


@query("stat_friedman", f"WITH {SCORES_SQL}, {_RANKED} SELECT round((n * 4 / ss) * sum((s - n * 3) ** 2) / n, 6) AS chi2 FROM (SELECT learner, sum(r) AS s FROM r GROUP BY learner), (SELECT count(DISTINCT case_id) AS n, sum((r - 3) ** 2) AS ss FROM r) GROUP BY n, ss")
def _(spark, sf):
    return significance.friedman(scores(spark, sf), "case_id", "learner", "score").select(R("chi2").alias("chi2"))


@query("stat_quade", f"WITH {SCORES_SQL}, {_RANKED}, q AS (SELECT case_id, rank() OVER (ORDER BY w) + (count(*) OVER (PARTITION BY w) - 1) / 2.0::DOUBLE AS q FROM (SELECT DISTINCT case_id, round(w, 6) AS w FROM r)), s AS (SELECT learner, q * (r - 3) AS s FROM r JOIN q USING (case_id)), a AS (SELECT sum(s * s) AS a FROM s), b AS (SELECT sum(t * t) AS b FROM (SELECT sum(s) AS t FROM s GROUP BY learner)), n AS (SELECT count(DISTINCT case_id) AS n FROM scores) SELECT round((n - 1) * (b / n) / (a - b / n), 6) AS f FROM a, b, n")
def _(spark, sf):
    s = scores(spark, sf).withColumn("score", F.col("score").cast("decimal(18,6)"))
    return significance.quade(s, "case_id", "learner", "score").select(R("f").alias("f"))


@query("stat_wilcoxon", f"WITH {SCORES_SQL}, d AS (SELECT round(a.score - b.score, 6) AS d FROM scores a JOIN scores b USING (case_id) WHERE a.learner = 1 AND b.learner = 2), r AS (SELECT d, rank() OVER (ORDER BY abs(d)) + (count(*) OVER (PARTITION BY abs(d)) - 1) / 2.0::DOUBLE AS r FROM d WHERE d <> 0), g AS (SELECT coalesce(sum(r) FILTER (d > 0), 0) AS w_plus, coalesce(sum(r) FILTER (d < 0), 0) AS w_minus, count(*)::DOUBLE AS n FROM r) SELECT w_plus, w_minus, n, round((least(w_plus, w_minus) - n * (n + 1) / 4) / sqrt(n * (n + 1) * (2 * n + 1) / 24), 6) AS z FROM g")
def _(spark, sf):
    s = scores(spark, sf)
    a, b = s.filter("learner = 1").select("case_id", F.col("score").alias("a")), s.filter("learner = 2").select("case_id", F.col("score").alias("b"))
    w = significance.wilcoxon(a.join(b, "case_id").withColumn("d", F.round(F.col("a") - F.col("b"), 6)), "d")
    return w.select("w_plus", "w_minus", "n", R("z").alias("z"))


@query("stat_permutation", f"""WITH {CASES_SQL}, c AS (SELECT case_id, y, x1 AS v FROM cases WHERE x1 IS NOT NULL), k AS (SELECT count(*) FILTER (y > 0) AS k, count(*) AS n, sum(v) AS s, avg(v) FILTER (y > 0) - avg(v) FILTER (y < 0) AS o FROM c),
  p AS (SELECT perm, v, row_number() OVER (PARTITION BY perm ORDER BY md5(case_id::VARCHAR || ':' || perm)) AS r FROM c, (SELECT unnest(range(1, 21)) AS perm)), t AS (SELECT perm, sum(v) FILTER (r <= k) AS t FROM p, k GROUP BY perm)
  SELECT round(any_value(o), 6) AS observed, round(avg(CAST(abs(t / k - (s - t) / (n - k)) >= abs(o) AS INT)), 6) AS p FROM t, k""")
def _(spark, sf):
    r = significance.permutation_p(cases(spark, sf), "case_id", "y", "x1", 20)
    return r.select(R("observed").alias("observed"), R("p").alias("p"))
