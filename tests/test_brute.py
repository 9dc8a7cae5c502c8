"""Steps, choosers and learners whose queries have no SQL, against brute force on small tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from caseforge.operators import interpret, learn, more_prep, neighbours, prep, rank, select
from caseforge.plans import flow


@pytest.fixture(scope="module")
def cases(spark):
    rng = np.random.default_rng(21)
    x = rng.normal(size=(60, 4))
    y = np.where(x[:, 0] - x[:, 2] + rng.normal(size=60) * 0.3 > 0, 1, 0)
    return x, y, spark.createDataFrame([(i, r.tolist(), int(c)) for i, (r, c) in enumerate(zip(x, y, strict=True))], "case_id long, f array<double>, label int")


def long(df):
    return df.select("case_id", F.posexplode("f").alias("feat", "value"))


def wide(df):
    got: dict = {}
    for r in df.collect():
        got.setdefault(r["case_id"], {})[r["feat"]] = r["value"]
    return np.array([[got[i][k] for k in sorted(got[i])] for i in sorted(got)], dtype=float)


def test_residuals_of_many_covariates(spark, cases):
    x, y, df = cases
    own = long(df).join(df.select("case_id", F.col("label").alias("u"), F.col("f")[1].alias("w")), "case_id").filter("feat in (0, 2)")
    got = wide(prep.residuals_many(own, prep.fit_residuals_many(own, ["feat"], ["u", "w"]), ["feat"], ["u", "w"]))
    z = np.c_[np.ones(60), y, x[:, 1]]
    assert got == pytest.approx(x[:, [0, 2]] - z @ np.linalg.lstsq(z, x[:, [0, 2]], rcond=None)[0], abs=1e-9)


def test_knn_imputation(spark, cases):
    x, _, df = cases
    gaps = df.select("case_id", F.transform("f", lambda v, i: F.when((F.col("case_id") < 50) | (i != 1), v)).alias("f"))
    near = neighbours.nearest(gaps.filter("case_id < 50"), gaps.filter("case_id >= 50"), "case_id", "f", 5)
    got = {r["query"]: r["value"] for r in neighbours.impute_median(near, long(gaps), "case_id").filter("feat = 1").collect()}
    for q in range(50, 60):
        far = ((x[:50][:, [0, 2, 3]] - x[q, [0, 2, 3]]) ** 2).sum(axis=1)
        assert got[q] == pytest.approx(np.median(x[np.argsort(far)[:5], 1]))


def test_label_imputation(spark, cases):
    x, y, df = cases
    own = df.withColumn("label", F.when(F.col("case_id") % 6 != 0, F.col("label")))
    got = {r["case_id"]: r["label"] for r in more_prep.label_impute(own, "case_id", "f", "label", 5).collect()}
    known = np.array([i for i in range(60) if i % 6])
    for q in range(0, 60, 6):
        votes = y[known[np.argsort(((x[known] - x[q]) ** 2).sum(axis=1))[:5]]]
        assert got[q] == int(votes.sum() >= 3)


def test_components_of_a_covariate_go(spark, cases):
    x, y, df = cases
    got = np.array([r["f"] for r in sorted(more_prep.without_components(df, "case_id", "f", "label", 0.2).collect(), key=lambda r: r["case_id"])])
    off = x - x.mean(axis=0)
    basis = np.linalg.eigh(off.T @ off)[1]
    out = np.array([abs(np.corrcoef(off @ b, y)[0, 1]) > 0.2 for b in basis.T])
    assert out.any() and got == pytest.approx(x - off @ basis[:, out] @ basis[:, out].T)


def test_knee_and_synthetic_neighbours(spark, cases):
    x, _, df = cases
    assert more_prep.knee(spark.createDataFrame([(i, float(min(i, 5))) for i in range(12)], "x int, y double"), "x", "y").first()[0] == 5
    made = {r["query"]: np.array(r["f"]) for r in interpret.interpolated(df, "case_id", "f", 3).collect()}
    for q, z in made.items():
        mates = np.argsort(((x - x[q]) ** 2).sum(axis=1))[1:4]
        gaps = [np.linalg.norm(z - x[q]) + np.linalg.norm(z - x[m]) - np.linalg.norm(x[m] - x[q]) for m in mates]
        assert min(gaps) < 1e-9
    assert len(made) == 60


def test_harmonised_batches(spark):
    rng = np.random.default_rng(22)
    batch = np.repeat([0, 1], 150)
    x = rng.normal(size=(300, 20)) * np.where(batch == 1, 2.0, 1.0)[:, None] + np.where(batch == 1, 3.0, 0.0)[:, None] + rng.normal(size=20)
    df = spark.createDataFrame([(i, int(b), r.tolist()) for i, (b, r) in enumerate(zip(batch, x, strict=True))], "case_id long, batch int, f array<double>")
    rows = df.select("case_id", "batch", F.posexplode("f").alias("feat", "value"))
    got = wide(prep.harmonise(rows, prep.fit_batches(rows, "batch"), "batch"))
    assert np.abs(got[batch == 0].mean(axis=0) - got[batch == 1].mean(axis=0)).max() < 0.3
    assert (got[batch == 1].std(axis=0) / got[batch == 0].std(axis=0)) == pytest.approx(np.ones(20), abs=0.2)


def test_impact_repair(spark):
    rng = np.random.default_rng(23)
    rows = [(i, "x", "ab"[i % 2], float(rng.normal() + 2 * (i % 2))) for i in range(400)]
    df = spark.createDataFrame(rows, "case_id long, feat string, grp string, value double")
    p = prep.fit_repair(df, "grp", list(range(0, 101, 10)))
    got = {g: np.array([r["value"] for r in prep.repair(df, p, "grp", 1.0).filter(F.col("grp") == g).collect()]) for g in "ab"}
    assert np.quantile(got["a"], [0.1, 0.5, 0.9]) == pytest.approx(np.quantile(got["b"], [0.1, 0.5, 0.9]), abs=0.15)
    same = prep.repair(df, p, "grp", 0.0).collect()
    assert {r["case_id"]: r["value"] for r in same} == {r[0]: r[3] for r in rows}


def entropy(*columns):
    _, n = np.unique(np.stack(columns), axis=1, return_counts=True)
    p = n / n.sum()
    return -(p * np.log2(p)).sum()


def test_choosers_take_the_right_features(spark):
    rng = np.random.default_rng(24)
    c = rng.integers(0, 3, 400)
    x = np.stack([np.where(rng.random(400) < q, c, rng.integers(0, 3, 400)) for q in (0.8, 0.7, 0.5, 0.3, 0.1, 0.0)], axis=1)
    x[:, 1] = np.where(rng.random(400) < 0.9, x[:, 0], x[:, 1])
    names = list("abcdef")
    rows = [(i, int(c[i]), names[j], float(x[i, j])) for i in range(400) for j in range(6)]
    df = spark.createDataFrame(rows, "case_id long, cls int, feat string, value double")
    relevance, pairs = select.information_tables(df, "case_id", "cls")
    h = {**{(j,): entropy(x[:, j]) for j in range(6)}, "c": entropy(c)}
    for j in range(6):
        assert relevance[names[j]] == pytest.approx(h[(j,)] + h["c"] - entropy(x[:, j], c))
    for i, j in combinations(range(6), 2):
        p = pairs[(names[i], names[j])]
        three = entropy(x[:, i], x[:, j], c)
        assert p["mi"] == pytest.approx(h[(i,)] + h[(j,)] - entropy(x[:, i], x[:, j])) and p["joint"] == pytest.approx(entropy(x[:, i], x[:, j]) + h["c"] - three)
        assert p["cmi"] == pytest.approx(entropy(x[:, i], c) + entropy(x[:, j], c) - three - h["c"]) and p["h"] == pytest.approx(three)
    assert select.by_information(relevance, pairs, 3, "mim") == sorted(names, key=lambda f: -relevance[f])[:3]
    best = sorted(names, key=lambda f: -relevance[f])[0]
    for criterion, gain in {
        "mifs": lambda f, s: relevance[f] - sum(pairs[f, g]["mi"] for g in s),
        "mrmr": lambda f, s: relevance[f] - sum(pairs[f, g]["mi"] for g in s) / len(s),
        "cife": lambda f, s: relevance[f] - sum(pairs[f, g]["mi"] - pairs[f, g]["cmi"] for g in s),
        "jmi": lambda f, s: sum(pairs[f, g]["joint"] for g in s),
        "condred": lambda f, s: relevance[f] + sum(pairs[f, g]["cmi"] for g in s),
        "cmim": lambda f, s: relevance[f] - max(0.0, max(pairs[f, g]["mi"] - pairs[f, g]["cmi"] for g in s)),
        "icap": lambda f, s: relevance[f] - sum(max(0.0, pairs[f, g]["mi"] - pairs[f, g]["cmi"]) for g in s),
        "disr": lambda f, s: sum(pairs[f, g]["joint"] / pairs[f, g]["h"] for g in s),
    }.items():
        chosen = [best]
        while len(chosen) < 3:
            chosen.append(max(sorted(set(names) - set(chosen)), key=lambda f: gain(f, chosen)))
        assert select.by_information(relevance, pairs, 3, criterion) == chosen, criterion
    redundancy = {k: v["mi"] for k, v in pairs.items() if k[0] < k[1]}
    assert rank.mrmr(relevance, redundancy, 3) == select.by_information(relevance, pairs, 3, "mrmr")


def test_ridge_grid(spark, cases):
    x, y, df = cases
    rows = df.withColumn("y", F.col("label").cast("double")).withColumn("fold", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("in_test", F.col("case_id") % 2 == F.col("fold"))
    got = {(r["fold"], r["penalty"]): r["mse"] for r in learn.ridge_grid(rows, ["fold"], "f", "y", "in_test", [0.1, 5.0]).collect()}
    z = np.c_[np.ones(60), x]
    for fold in (0, 1):
        test = np.arange(60) % 2 == fold
        for p in (0.1, 5.0):
            b = np.linalg.solve(z[~test].T @ z[~test] + p * np.diag([0, 1, 1, 1, 1]), z[~test].T @ y[~test])
            assert got[fold, p] == pytest.approx(((z[test] @ b - y[test]) ** 2).mean())


def test_learners_beat_chance(spark, cases):
    x, y, df = cases
    v = learn.vectors(df, "f", "label")
    for name, options in (("logistic", {}), ("elastic_net", {}), ("linear_svm", {}), ("tree", {}), ("forest", {}), ("boosting", {}), ("perceptron", {"layers": [4, 6, 2]}), ("bayes", {})):
        got = {r["case_id"]: r["prediction"] for r in learn.predict(name, v, v, "case_id", **options).collect()}
        assert np.mean([got[i] == y[i] for i in range(60)]) > 0.85, name


def test_nmf_and_importance(spark, cases):
    x, y, df = cases
    w = learn.nmf(df.select("case_id", F.transform("f", F.abs).alias("f")), "case_id", "f", 2).collect()
    assert len(w) == 60 and all(v >= 0 for r in w for v in r["weights"])
    model = learn.LEARNERS["logistic"]().fit(learn.vectors(df, "f", "label"))
    loss = {r["feature"]: r["loss"] for r in learn.permutation_importance(model, df, "f", "label", [0, 1, 2, 3]).collect()}
    assert min(loss[0], loss[2]) > max(loss[1], loss[3])


def test_sequence_of_steps(spark):
    rng = np.random.default_rng(25)
    x = rng.normal(size=(40, 3)) * [1, 5, 0] + [0, 10, 7]
    rows = [(i, j, 0, None if (i + j) % 9 == 0 and j < 2 else float(x[i, j])) for i in range(40) for j in range(3)]
    df = spark.createDataFrame(rows, "case_id long, feat int, fold int, value double")
    train = df.filter("case_id < 30")
    own = flow.Sequence(["impute", "prune", "winsorise", "copy", "scale"], ["fold", "feat"]).fit(train)
    got = wide(own.apply(df))
    assert got.shape == (40, 2)
    for j in range(2):
        v = np.array([r[3] for r in rows if r[1] == j], dtype=float)
        v = np.where(np.isnan(v), np.nanmean(v[:30]), v)
        z = np.clip(np.round((v - v[:30].mean()) / v[:30].std(ddof=1), 9), -flow.WINSOR, flow.WINSOR)
        z = np.round(z - z[:30].mean(), 9)
        assert got[:, j] == pytest.approx((z - z[:30].min()) / (z[:30].max() - z[:30].min()), abs=1e-6)
