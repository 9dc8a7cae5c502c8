"""Operators that SQL can't express, against brute force or known answers on small tables."""

from __future__ import annotations

import math
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseforge.operators import calibrate, committee, folds, kernels, learn, margins, more_prep, neighbours, order, prep, reduce, robust, significance, synthetic
from caseforge.sources import files


@pytest.fixture(scope="module")
def cloud(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 6)) @ rng.normal(size=(6, 6))
    y = np.where(x[:, 0] + 0.5 * x[:, 1] > 0, 1, -1)
    return x, y, spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "case_id long, f array<double>, y int")


def by_case(df, column):
    return np.array([r[column] for r in sorted(df.collect(), key=lambda r: r["case_id"])])


# ---- order and significance
def test_running_by_parts_of_unlike_scale(spark):
    rows = [("small", i / 1e6, 1) for i in range(500)] + [("large", i * 1e6, 1) for i in range(500)]
    df = spark.createDataFrame(rows, "feat string, v double, n long")
    parts = order.with_bucket(df, ["feat"], "v").groupBy("feat").agg(F.count_distinct("_b").alias("k")).collect()
    assert all(r["k"] > 50 for r in parts)
    out = order.running(df, ["feat"], "v", ["n"]).collect()
    assert all(r["before_n"] == round(r["v"] * 1e6 if r["feat"] == "small" else r["v"] / 1e6) and r["all_n"] == 500 for r in out)


def test_lowest(spark):
    df = spark.range(3000).select("id", (F.col("id") % 3).alias("part")).withColumn("h", folds.hashed_number("id", "x"))
    whole, edge = order.lowest(df, ["part"], "h", F.lit(417), "id")
    got = {(r["part"], r["id"]) for r in whole.unionByName(edge).collect()}
    rows = sorted(((r["part"], r["h"], r["id"]) for r in df.collect()))
    want = {(p, i) for p in range(3) for _, _, i in [r for r in rows if r[0] == p][:417]}
    assert got == want


def test_fdr_and_holm_of_ties(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5, 0.03, 0.03, 0.9, 0.9]
    df = spark.createDataFrame(list(enumerate(p)), "test long, p double")
    m, by = len(p), sorted(range(len(p)), key=lambda i: (p[i], i))
    raw = [p[i] * m / (k + 1) for k, i in enumerate(by)]
    want = {i: min(1.0, min(raw[k:])) for k, i in enumerate(by)}
    assert {r["test"]: r["adjusted"] for r in significance.fdr(df, "test").collect()} == pytest.approx(want)
    step = [p[i] * (m - k) for k, i in enumerate(by)]
    want = {i: max(step[k], step[k - 1] if k else step[k]) for k, i in enumerate(by)}
    assert {r["test"]: r["adjusted"] for r in significance.holm(df, "test").collect()} == pytest.approx(want)
    assert significance.fdr(df.limit(0), "test").count() == 0


def test_permutation_of_nothing(spark):
    df = spark.createDataFrame([(1, 1, 2.0), (2, 1, 3.0)], "c long, y int, v double")
    for d in (df, df.limit(0)):
        assert tuple(significance.permutation_p(d, "c", "y", "v", 5).first()) == (None, None)


def test_exact_tests(spark):
    d = [3.0, -1.0, 2.5, 4.0, -0.5, 6.0, 7.0]
    r = significance.wilcoxon_exact(spark.createDataFrame([(x,) for x in d], "d double"), "d").first()
    ranks = np.argsort(np.argsort(np.abs(d))) + 1
    w = min(ranks[np.array(d) > 0].sum(), ranks[np.array(d) < 0].sum())
    sums = [sum(int(k) for k, s in zip(range(1, 8), f"{m:07b}", strict=True) if s == "1") for m in range(128)]
    assert r["p"] == pytest.approx(min(1.0, 2 * sum(s <= w for s in sums) / 128)) and r["n"] == 7
    pairs = [(1, 0)] * 9 + [(0, 1)] * 2 + [(1, 1)] * 5
    l = significance.liddell(spark.createDataFrame([(1, *p) for p in pairs], "g int, a int, b int"), "a", "b", ["g"]).first()
    assert l["f"] == pytest.approx(9 / 3) and l["p"] == pytest.approx(2 * sum(math.comb(11, k) for k in range(9, 12)) / 2**11) and l["ratio"] == 4.5


def test_kappa(spark):
    r = significance.kappa_test(spark.createDataFrame([(1, 20, 15, 5, 10)], "g int, tp int, tn int, fp int, fn int"), ["g"]).first()
    assert r["kappa"] == pytest.approx(0.4) and 0 < r["p"] < 0.05 and r["z"] == pytest.approx(r["kappa"] / r["se"])


# ---- classes, folds, steps
def test_many_classes(spark):
    df = spark.range(1200).select("id", F.col("id").cast("string").alias("c"))
    with pytest.raises(ValueError):
        folds.one_vs_all(df, "c")
    few = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None)], "id long, c string")
    assert sorted((r["id"], r["class_b"], r["y_b"]) for r in folds.one_vs_one(few, "c").collect()) == [(1, "a-b", 1), (1, "a-c", 1), (2, "a-b", -1), (2, "b-c", 1), (3, "a-c", -1), (3, "b-c", -1)]
    rng = np.random.default_rng(2)
    many = spark.createDataFrame([(i, (rng.normal(size=3) + i % 300).tolist(), i % 300) for i in range(900)], "i int, f array<double>, c int")
    _, basis = more_prep.discriminant(many, "f", "c", 1)
    assert abs(basis[:, 0] / np.linalg.norm(basis[:, 0])) == pytest.approx(np.full(3, 1 / np.sqrt(3)), abs=0.1)


def test_winsorise_leaves_held_out_rows_alone(spark):
    train = spark.createDataFrame([(i, "x", float(i)) for i in range(20)], "case_id long, feat string, value double")
    held = spark.createDataFrame([(100, "x", 3.0), (101, "x", 1e6), (102, "x", None)], train.schema)
    for median in (False, True):
        p = prep.fit_winsorise(train, ["feat"], 1.0, median)
        alone = {r["case_id"]: r["value"] for r in prep.winsorise(held, p, ["feat"], 1.0).collect()}
        beside = {r["case_id"]: r["value"] for r in prep.winsorise(held.unionByName(train), p, ["feat"], 1.0).collect()}
        assert all(beside[k] == alone[k] for k in (100, 101)) and alone[102] is None and beside[102] is None


def test_symbol_words_cross_blocks(spark, monkeypatch):
    df = spark.createDataFrame([(i * 3, "x", float(i * 7 % 10)) for i in range(60)], "case_id long, feat string, value double")
    p = prep.fit_standard(df, ["feat"])
    whole = more_prep.symbol_entropies(df, p, "case_id", 2, 4, 2.0, 3).collect()
    monkeypatch.setattr(more_prep, "SYMBOL_BLOCK", 7)
    cut = more_prep.symbol_entropies(df, p, "case_id", 2, 4, 2.0, 3).collect()
    assert {r["bins"]: round(r["entropy"], 9) for r in whole} == {r["bins"]: round(r["entropy"], 9) for r in cut}


def test_nearest_in_blocks(spark, cloud, monkeypatch):
    x, _, df = cloud
    monkeypatch.setattr(neighbours, "BLOCK_NUMBERS", 60)
    got = {}
    for r in neighbours.nearest(df, df.filter("case_id < 25"), "case_id", "f", 3).collect():
        got.setdefault(r["query"], {})[r["place"]] = r["case_id"]
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag(np.full(len(x), np.inf))
    assert all([got[q][k] for k in (1, 2, 3)] == np.argsort(far[q])[:3].tolist() for q in range(25))


# ---- robust scales, imputation
def test_robust_scales():
    x = np.array([1.0, 2.0, 4.0, 7.0, 20.0])
    gaps = sorted(abs(a - b) for i, a in enumerate(x) for b in x[:i])
    assert robust.qn(x) == pytest.approx(2.2219 * gaps[3 * 2 // 2 - 1])
    inner = sorted(sorted(abs(a - b) for b in x)[2] for a in x)
    assert robust.sn(x) == pytest.approx(1.1926 * inner[2])
    big = np.random.default_rng(1).normal(size=2000) * 3
    assert robust.qn(big) == pytest.approx(3, rel=0.1) and robust.sn(big) == pytest.approx(3, rel=0.1)


def test_sequential_and_hybrid_impute(spark):
    df = spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 10.0]), (3, [0.4, None]), (4, [None, None])], "case_id long, f array<double>")
    got = {r["case_id"]: r["f"] for r in robust.sequential_impute(df, "case_id", "f", 2).collect()}
    assert got[3][1] == pytest.approx((0 / 0.4 + 10 / 0.6) / (1 / 0.4 + 1 / 0.6)) and None not in got[4]
    h = spark.createDataFrame([(1, 1.0, 0.0, "a"), (2, 9.0, 1.0, "b"), (3, None, 0.0, "a"), (4, 5.0, 0.1, "b")], "case_id long, v double, w double, c string")
    assert {r["case_id"]: r["v"] for r in robust.hybrid_impute(h, "case_id", ["v", "w"], ["c"], 1).collect()}[3] == 1.0


# ---- reductions
def test_linear_reductions(spark, cloud):
    x, y, df = cloud
    cov = np.cov(x.T, bias=True)
    values = np.linalg.eigvalsh(cov)[::-1]
    _, load, noise = reduce.probabilistic(df, "f", 2)
    assert noise == pytest.approx(values[2:].mean()) and np.linalg.eigvalsh(load @ load.T)[::-1][:2] == pytest.approx(values[:2] - noise)
    _, own, psi = reduce.factors(df, "f", 2, 2000)
    model = own @ own.T + np.diag(psi)
    likelihood = lambda m: -np.linalg.slogdet(m)[1] - np.trace(np.linalg.solve(m, cov))
    assert likelihood(model) >= likelihood(load @ load.T + noise * np.eye(6)) - 1e-6
    _, sparse = reduce.sparse_components(df, "f", 2, float(values[0]))
    assert (sparse == 0).sum() > 0
    _, dense = reduce.sparse_components(df, "f", 2, 0.0)
    assert abs(dense[:, 0] @ np.linalg.eigh(cov)[1][:, -1]) == pytest.approx(1, abs=1e-3)
    centre = reduce.spatial_median(df, "f")
    loss = lambda c: np.sqrt(((x - c) ** 2).sum(axis=1)).sum()
    assert all(loss(centre) <= loss(centre + d) + 1e-6 for d in np.eye(6) * 0.01)
    turned = np.linalg.qr(np.random.default_rng(5).normal(size=(2, 2)))[0]
    assert reduce.aligned_basis(load, load @ turned) == pytest.approx(load)


def test_partial_least_squares(spark, cloud):
    x, y, df = cloud
    own = df.withColumn("t", F.array(F.col("y").cast("double")))
    mean, w, mean_t, beta = reduce.least_squares_components(own, "f", "t", 6)
    full = np.linalg.lstsq(np.c_[np.ones(len(x)), x], y, rcond=None)[0]
    assert beta[:, 0] == pytest.approx(full[1:], abs=1e-6)
    scores = (x - mean) @ w
    assert np.cov(scores.T, bias=True) == pytest.approx(np.eye(6), abs=1e-6)
    d = by_case(reduce.deviation(own, "case_id", "f", "t", (mean, w, mean_t, beta)), "deviation")[:, 0]
    assert d == pytest.approx(y - np.c_[np.ones(len(x)), x] @ full, abs=1e-6)


def test_independent_components(spark):
    rng = np.random.default_rng(4)
    s = np.c_[rng.uniform(-1, 1, 3000), np.sign(rng.normal(size=3000)) * rng.exponential(size=3000)]
    x = s @ np.array([[1.0, 0.6], [-0.4, 1.0]])
    df = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "case_id long, f array<double>")
    got = by_case(reduce.independent(df, "case_id", "f", 2)[0], "scores")
    r = np.abs(np.corrcoef(got.T, s.T)[:2, 2:])
    assert r.max(axis=1) == pytest.approx([1, 1], abs=0.03)


# ---- kernel machines and maps
def test_machines():
    rng = np.random.default_rng(6)
    x = rng.normal(size=(150, 2))
    ring = np.where((x**2).sum(axis=1) > 1.2, 1, -1)
    for fit, options in ((kernels.svc, {"kind": "rbf", "gamma": 1.0, "c": 10.0}), (kernels.svc, {"kind": "poly", "gamma": 1.0, "degree": 2, "shift": 1.0, "c": 10.0}), (kernels.robust_svc, {"kind": "rbf", "gamma": 1.0, "c": 10.0})):
        assert (np.sign(fit(x, ring, **options)(x)) == ring).mean() > 0.95
    assert (np.sign(kernels.extreme(x, ring.astype(float), hidden=80)(x)) == ring).mean() > 0.9
    t = np.sin(2 * x[:, 0])
    assert np.abs(kernels.svr(x, t, c=10.0, epsilon=0.05, kind="rbf", gamma=1.0)(x) - t).max() < 0.15
    r = kernels.relevance(x, t + rng.normal(size=150) * 0.05, kind="rbf", gamma=1.0)
    assert np.abs(r(x) - t).mean() < 0.1 and len(r.weights) < 60
    inside = kernels.one_class(x, nu=0.2, kind="rbf", gamma=0.5)(x)
    assert 0.1 < (inside < -1e-6).mean() < 0.3
    line = np.where(x[:, 0] > 0, 1, -1)
    wide = np.c_[x, rng.normal(size=(150, 10))]
    score = kernels.sparse_logistic(wide, line)
    assert (np.sign(score(wide)) == line).mean() > 0.95 and abs(score(np.eye(12)[3:4]) - score(np.zeros((1, 12))))[0] < abs(score(np.eye(12)[:1]) - score(np.zeros((1, 12))))[0]


def test_dual_is_optimal():
    """A separable pair: the widest margin lies halfway."""
    x, y = np.array([[0.0, 0.0], [2.0, 0.0], [0.0, 1.0], [2.0, 3.0]]), np.array([-1, 1, -1, 1])
    machine = kernels.svc(x, y, c=1e3, kind="linear")
    assert machine(np.array([[1.0, 0.5], [2.0, 0.0], [0.0, 0.0]])) == pytest.approx([0, 1, -1], abs=1e-3)


def test_fold_prediction(spark, cloud):
    x, y, df = cloud
    rows = df.withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("in_test", F.col("case_id") % 2 == F.col("fold"))
    out = kernels.fit_predict(rows, ["fold"], "case_id", "f", "y", "in_test", "svc", kind="linear", c=10.0).collect()
    assert len(out) == 80 and np.mean([(r["score"] > 0) == (r["y"] > 0) for r in out]) > 0.9
    machine = kernels.svc(x, y, c=10.0, kind="linear")
    assert by_case(kernels.judged(df, "case_id", "f", machine), "score") == pytest.approx(machine(x))


def test_maps_of_a_curve():
    t = np.linspace(0, 3, 120)
    x = np.c_[np.cos(t), np.sin(t), 0.01 * np.random.default_rng(2).normal(size=120)]
    for name in ("laplacian", "locally_linear", "isometric"):
        first = kernels.MAPS[name](x, 1, near=6)[:, 0]
        assert abs(np.corrcoef(np.argsort(np.argsort(first)), np.arange(120))[0, 1]) > 0.97, name
    linear = kernels.kernel_pca(x, 2, kind="linear")
    assert np.abs(np.corrcoef(linear[:, 0], (x - x.mean(axis=0)) @ np.linalg.svd(x - x.mean(axis=0))[2][0])[0, 1]) == pytest.approx(1)
    label = (t > 1.5).astype(int)
    g = kernels.kernel_discriminant(x, 1, label, gamma=1.0)[:, 0]
    assert abs(g[label == 0].mean() - g[label == 1].mean()) > 2 * (g[label == 0].std() + g[label == 1].std())
    assert kernels.locality_preserving(x, 2).shape == (120, 2)


# ---- rankers, subsets, committees
def test_rankers_find_the_feature(spark):
    rng = np.random.default_rng(8)
    x = rng.normal(size=(120, 5))
    y = np.where(x[:, 2] > 0, 1, -1)
    df = spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "case_id long, f array<double>, y int")
    weights = {r["feat"]: r["weight"] for r in margins.relief(df, "case_id", "f", "y", 5).collect()}
    assert max(weights, key=weights.get) == 3
    far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2)) + np.diag(np.full(120, np.inf))
    near = {s: [np.argsort(np.where((y == y[i]) == s, far[i], np.inf))[:5] for i in range(120)] for s in (True, False)}
    span = x.max(axis=0) - x.min(axis=0)
    want = [(np.mean([np.abs(x[i, j] - x[near[False][i], j]).mean() for i in range(120)]) - np.mean([np.abs(x[i, j] - x[near[True][i], j]).mean() for i in range(120)])) / span[j] for j in range(5)]
    assert [weights[j + 1] for j in range(5)] == pytest.approx(want)
    assert int(np.argmax(margins.margin_weights(df, "case_id", "f", "y"))) == 2 and 3 in margins.margin_subset(df, "case_id", "f", "y")
    ranks = reduce.bhattacharyya_ranks(df, "f", "y")
    assert int(np.argmin(ranks)) == 2


def test_committees(spark):
    rng = np.random.default_rng(9)
    y = rng.choice([-1, 1], 200)
    rows = [(i, k, float(y[i] if rng.random() < (0.9 if k < 3 else 0.5) else -y[i]), int(y[i])) for i in range(200) for k in range(5)]
    p = committee.vote_patterns(spark.createDataFrame(rows, "case_id long, learner long, score double, y int"), "case_id", "learner", "score", "y")
    assert p[3].sum() == 200
    kept = committee.selected(p, "performance")
    assert committee.balanced(p[1][:, kept], p[2], p[3]) >= committee.balanced(p[1], p[2], p[3])
    w = committee.boosted(p)
    assert sum(w.values()) == pytest.approx(1) and max(w, key=w.get) < 3
    for name in ("entropy", "diversity", "bias_variance"):
        got = committee.selected(p, name)
        assert committee.CRITERIA[name](p[1][:, got], p[2], p[3]) >= committee.CRITERIA[name](p[1], p[2], p[3]) - 1e-12
    assert committee.accepts(1, 2, 0.1, 0.99) and not committee.accepts(2, 1, 0.1, 0.5) and committee.accepts(2, 1.9, 10, 0.5)
    nodes = [(a, b) for a in range(6) for b in range(6)]
    assert committee.annealed(nodes, lambda n: -abs(n[0] - 4) - abs(n[1] - 1), rounds=300)[0] == (4, 1)


def test_quantile_bins(spark):
    rng = np.random.default_rng(10)
    p = rng.random(2000)
    y = (rng.random(2000) < p**3).astype(int)
    df = spark.createDataFrame([(i, float(a), int(b)) for i, (a, b) in enumerate(zip(p, y, strict=True))], "case_id long, p double, y int")
    models = calibrate.fit_quantile_bins(df, "y", "p", "case_id", 10)
    assert sum(m[0] for m in models) == pytest.approx(1) and [len(m[2]) for m in models] == list(range(1, 11))
    got = by_case(df.select("case_id", calibrate.binned_probability(F.col("p"), models).alias("q")), "q")
    assert np.mean((got - p**3) ** 2) < 0.25 * np.mean((p - p**3) ** 2)
    assert calibrate.best_threshold(df.limit(0), "y", "p") == 0.0


def test_sigmoid_calibration(spark):
    rng = np.random.default_rng(11)
    s = rng.normal(size=500)
    y = (rng.random(500) < 1 / (1 + np.exp(-(2 * s - 0.5)))).astype(int)
    a, b = calibrate.fit_sigmoid(spark.createDataFrame([(float(u), int(v)) for u, v in zip(s, y, strict=True)], "s double, y int"), "y", "s")
    t = np.where(y == 1, (y.sum() + 1) / (y.sum() + 2), 1 / (500 - y.sum() + 2))
    p = 1 / (1 + np.exp(a * s + b))
    assert abs((t - p).sum()) < 1e-6 and abs(((t - p) * s).sum()) < 1e-6


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 10, 31])
def test_student_p(spark, n):
    from caseforge.functions import scalar

    x = np.linspace(0, 400, 4_000_001)
    density = math.exp(math.lgamma((n + 1) / 2) - math.lgamma(n / 2)) / math.sqrt(n * math.pi) * (1 + x * x / n) ** (-(n + 1) / 2)
    step = x[1] - x[0]
    for t in (0.3, 1.7, -2.5):
        got = spark.range(1).select(scalar.two_sided_t_p(F.lit(t), n).alias("p")).first()["p"]
        k = int(round(abs(t) / step))
        inside = 2 * step * (density[: k + 1].sum() - 0.5 * (density[0] + density[k]))
        assert got == pytest.approx(1 - inside, abs=1e-6)


# ---- synthetic data, graphs, shares
def test_synthetic_rows(spark, cloud):
    x, y, df = cloud
    for made in (synthetic.gaussian(df, "f", 4000, 6), synthetic.copula(df, "f", 4000)):
        z = by_case(made, "features")
        assert np.abs(z.mean(axis=0) - x.mean(axis=0)).max() < 0.4 and np.abs(np.corrcoef(z.T) - np.corrcoef(x.T)).max() < 0.2
    few = df.withColumn("y", F.when(F.col("case_id") < 12, 1).otherwise(-1))
    extra = margins.oversampled(few, "case_id", "f", "y", 3).collect()
    assert abs(len(extra) - 56) <= 12 and all(r["query"] < 12 for r in extra)


def test_shapley_adds_up(spark, cloud):
    x, _, df = cloud
    model = lambda z: z[:, 0] * z[:, 1] + 2 * z[:, 2]
    background = x.mean(axis=0)
    got = by_case(synthetic.shapley(df.filter("case_id < 5"), "case_id", "f", model, background), "shares")
    assert got.sum(axis=1) == pytest.approx(model(x[:5]) - model(background[None])[0]) and got[:, 2] == pytest.approx(2 * (x[:5, 2] - background[2])) and got[:, 3:] == pytest.approx(0)


def test_pagerank_by_graph(spark):
    edges = [(1, 1, 2, 1.0), (1, 2, 3, 2.0), (1, 3, 1, 1.0), (1, 3, 2, 1.0), (2, 1, 2, 1.0)]
    from caseforge.operators import interpret

    got = {(r["g"], r["node"]): r["rank"] for r in interpret.pagerank(spark.createDataFrame(edges, "g int, a int, b int, w double"), graph="g").collect()}
    m = np.array([[0, 0, 0.5], [1, 0, 0.5], [0, 1, 0]])
    r = np.linalg.solve(np.eye(3) - 0.85 * m, np.full(3, 0.05))
    assert [got[1, k] for k in (1, 2, 3)] == pytest.approx(r.tolist(), abs=1e-6) and got[2, 1] + got[2, 2] == pytest.approx(1)


# ---- learners of the library against known answers
def test_isotonic_equals_pooling(spark):
    rng = np.random.default_rng(12)
    x, y = np.arange(60.0), np.arange(60) / 60 + rng.normal(size=60)
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(x, y, strict=True))], "case_id long, features double, label double")
    got = by_case(learn.predict("isotonic", df, df, "case_id"), "prediction")
    blocks = []
    for v in y:
        blocks.append([v, 1])
        while len(blocks) > 1 and blocks[-2][0] > blocks[-1][0]:
            b, a = blocks.pop(), blocks.pop()
            blocks.append([(a[0] * a[1] + b[0] * b[1]) / (a[1] + b[1]), a[1] + b[1]])
    assert got == pytest.approx(np.repeat([b[0] for b in blocks], [b[1] for b in blocks]))


def test_components_and_distance(spark, cloud):
    x, _, df = cloud
    off = x - x.mean(axis=0)
    own = learn.vectors(df, "f", "y")
    got = by_case(learn.components(own, own, "case_id", 2), "scores")
    basis = np.linalg.eigh(np.cov(x.T))[1][:, ::-1][:, :2]
    assert np.abs(got) == pytest.approx(np.abs(x @ basis), abs=1e-6)
    assert by_case(more_prep.mahalanobis(df, "case_id", "f"), "d2") == pytest.approx(np.einsum("ij,ij->i", off @ np.linalg.inv(np.cov(x.T)), off), rel=1e-4)


# ---- files
def test_sheets(spark, tmp_path):
    sheet = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>x</t></is></c></row><row r="2"><c r="A2"><v>7</v></c><c r="C2"><v>1.5</v></c></row><row r="3"><c r="C3"><v>2</v></c></row></sheetData></worksheet>'
    strings = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>id</t></si></sst>'
    with zipfile.ZipFile(tmp_path / "a.xlsx", "w") as z:
        z.writestr("xl/worksheets/sheet1.xml", sheet)
        z.writestr("xl/sharedStrings.xml", strings)
    got = {(r["row"], r["column"]): r["value"] for r in files.read_sheet(spark, str(tmp_path)).collect()}
    assert got == {(1, "id"): "7", (1, "x"): "1.5", (2, "id"): None, (2, "x"): "2"}


def test_workspaces(spark, tmp_path):
    def element(kind, data):
        return struct.pack("<II", kind, len(data)) + data + bytes(-len(data) % 8)

    m = np.array([[1.0, 2.0], [np.nan, 4.0], [5.0, 6.0]])
    body = element(6, struct.pack("<II", 6, 0)) + element(5, struct.pack("<ii", 3, 2)) + element(1, b"data") + element(9, m.tobytes(order="F"))
    packed = zlib.compress(element(14, body))
    raw = b"text".ljust(124) + struct.pack("<H", 0x0100) + b"IM" + struct.pack("<II", 15, len(packed)) + packed
    (tmp_path / "a.mat").write_bytes(raw)
    got = {(r["row"], r["feat"]): r["value"] for r in files.read_workspace(spark, str(tmp_path), "data").collect()}
    assert got == {(1, 1): 1.0, (1, 2): 2.0, (2, 1): None, (2, 2): 4.0, (3, 1): 5.0, (3, 2): 6.0}


def test_images_and_surfaces(spark, tmp_path):
    v = np.arange(24, dtype="<i2").reshape((2, 3, 4), order="F")
    head = bytearray(352)
    head[:4] = struct.pack("<i", 348)
    head[40:56] = struct.pack("<8h", 3, 2, 3, 4, 1, 1, 1, 1)
    head[70:72] = struct.pack("<h", 4)
    head[108:120] = struct.pack("<3f", 352, 2.0, 1.0)
    (tmp_path / "a.nii").write_bytes(bytes(head) + v.tobytes(order="F"))
    mask = (np.arange(24).reshape((2, 3, 4), order="F") % 2).astype(int)
    got = {r["feat"]: r["value"] for r in files.read_volumes(spark, str(tmp_path), mask).collect()}
    assert got == {k + 1: 2.0 * k + 1 for k in range(24) if k % 2}
    s = struct.pack(">6i", 1, 4, 1, 1, 1, 3).ljust(284, b"\0") + np.array([0.5, 1.5, np.nan, 3.0], dtype=">f4").tobytes()
    import gzip

    (tmp_path / "lh.mgz").write_bytes(gzip.compress(s))
    assert {r["feat"]: r["value"] for r in files.read_surfaces(spark, str(tmp_path)).collect()} == {1: 0.5, 2: 1.5, 3: None, 4: 3.0}


def test_xml(spark, tmp_path):
    (tmp_path / "a.xml").write_text("<all><case><id>1</id><v>2.5</v></case><case><id>2</id></case></all>")
    assert sorted((r["id"], r["v"]) for r in files.read_xml(spark, str(tmp_path / "a.xml"), "case", "id long, v double").collect()) == [(1, 2.5), (2, None)]


