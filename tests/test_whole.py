"""Operators that once refused tables beyond a number of rows take them whole."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from caseforge import catalog
from caseforge.operators import kernels, margins, neighbours, robust

from .conftest import SMALL

MACHINES = [
    ("svc", {"kind": "rbf", "gamma": 0.5}),
    ("svc", {"kind": "poly", "gamma": 1.0, "degree": 2, "shift": 1.0}),
    ("svc", {"kind": "linear"}),
    ("svc", {"kind": "sigmoid", "gamma": 0.1, "shift": -0.25}),
    ("robust_svc", {"kind": "rbf", "gamma": 0.5}),
    ("one_class", {"kind": "rbf", "gamma": 0.5}),
    ("svr", {"kind": "rbf", "gamma": 0.5}),
    ("extreme", {}),
    ("sparse_logistic", {}),
]


@pytest.mark.parametrize("name,options", MACHINES)
def test_machine_of_over_5000_training_rows(spark, name, options):
    x = np.random.default_rng(1).integers(0, 6, (5220, 2)) / 2.0
    y = np.where(x[:, 0] > 1.2, 1.0, -1.0)
    df = spark.createDataFrame(pd.DataFrame({"fold": 0, "case_id": range(5220), "f": x.tolist(), "y": y, "in_test": np.arange(5220) >= 5200}))
    out = kernels.fit_predict(df, ["fold"], "case_id", "f", "y", "in_test", name, **options).toPandas().sort_values("case_id")
    assert len(out) == 20 and np.isfinite(out["score"]).all()
    if name != "one_class":
        assert (np.sign(out["score"]) == y[5200:]).all()


def test_relevance_of_over_5000_training_rows(spark):
    x = np.random.default_rng(15).normal(size=(5220, 2))
    t = np.sin(2 * x[:, 0])
    y = t + np.random.default_rng(16).normal(size=5220) * 0.1
    df = spark.createDataFrame(pd.DataFrame({"fold": 0, "case_id": range(5220), "f": x.tolist(), "y": y, "in_test": np.arange(5220) >= 5200}))
    out = kernels.fit_predict(df, ["fold"], "case_id", "f", "y", "in_test", "relevance", kind="rbf", gamma=1.0).toPandas().sort_values("case_id")
    assert len(out) == 20 and np.abs(out["score"].to_numpy() - t[5200:]).mean() < 0.05


@pytest.mark.parametrize("width", [2, 64])
def test_relevance_by_added_functions_has_no_less_evidence_than_by_pruning(monkeypatch, width):
    rng = np.random.default_rng(17)
    x = rng.normal(size=(200, width)) / np.sqrt(width) * 2
    y = np.sin(2 * x[:, 0]) + 3 + rng.normal(size=200) * 0.1

    def evidence(machine):
        """Greatest log evidence over the strengths of the machine's functions, by many rounds of re-estimation."""
        phi = np.c_[np.ones(200), kernels.kernel(x, machine.support, gamma=0.5)]
        alpha, beta = np.full(phi.shape[1], 1.0), 1.0
        for _ in range(2000):
            sigma = np.linalg.inv(beta * phi.T @ phi + np.diag(alpha))
            mean = beta * sigma @ phi.T @ y
            gamma = 1 - alpha * np.diag(sigma)
            alpha, beta = np.clip(gamma / (mean * mean + 1e-30), 1e-12, 1e9), (200 - gamma.sum()) / ((y - phi @ mean) ** 2).sum()
        c = np.eye(200) / beta + phi @ (phi / alpha).T
        return -0.5 * (np.linalg.slogdet(c)[1] + y @ np.linalg.solve(c, y))

    pruned = kernels.relevance(x, y, gamma=0.5)
    monkeypatch.setattr(kernels, "ROWS", 100)
    monkeypatch.setattr(kernels, "NUMBERS", 5000)
    added = kernels.relevance(x, y, gamma=0.5)
    assert evidence(added) > evidence(pruned) - 1
    assert np.sqrt(np.mean((added(x) - pruned(x)) ** 2)) < 0.1


def test_relevance_by_added_functions_of_odd_rows(monkeypatch):
    monkeypatch.setattr(kernels, "ROWS", 2)
    x = np.repeat(np.random.default_rng(18).normal(size=(20, 2)), 3, axis=0)
    assert kernels.relevance(x, np.zeros(60), gamma=0.5)(x) == pytest.approx(np.zeros(60))
    assert kernels.relevance(x, np.full(60, 7.0), gamma=0.5)(x) == pytest.approx(np.full(60, 7.0), abs=1e-3)
    assert kernels.relevance(x, 1000 * x[:, 0], kind="linear")(x) == pytest.approx(1000 * x[:, 0], abs=1.0)


def _scale(spark, scale):
    v = np.random.default_rng(3).integers(0, 3000, 10_100) / 7
    df = spark.createDataFrame(pd.DataFrame({"feat": "a", "value": v}))
    return v, robust.fit_robust(df, ["feat"], scale).first()["sd"]


def test_qn_of_over_10000_values(spark):
    v, sd = _scale(spark, "qn")
    s, h, t = np.sort(v), len(v) // 2 + 1, sd / robust.QN
    at_most = lambda t: sum(int((s[i + 1 :] - s[i] <= t).sum()) for i in range(len(s)))
    assert at_most(t - 1e-9) < h * (h - 1) // 2 <= at_most(t + 1e-9)


def test_sn_of_over_10000_values(spark):
    v, sd = _scale(spark, "sn")
    inner = np.sort([np.partition(np.abs(v - x), len(v) // 2)[len(v) // 2] for x in v])
    assert sd == pytest.approx(robust.SN * inner[(len(v) + 1) // 2 - 1])


def test_sequential_impute_of_over_20000_rows(spark):
    x = np.random.default_rng(4).normal(size=(20_010, 2)).round(3)
    rows = [(i, [float(a), None if i in (7, 9) else float(b)]) for i, (a, b) in enumerate(x)]
    got = {r["case_id"]: r["f"] for r in robust.sequential_impute(spark.createDataFrame(rows, "case_id long, f array<double>").repartition(4), "case_id", "f", 3).collect()}
    known = np.delete(x, (7, 9), axis=0)
    far = np.abs(known[:, 0] - x[7, 0])
    near = np.argsort(far, kind="stable")[:3]
    w = 1 / np.maximum(far[near], 1e-12)
    assert len(got) == 20_010 and got[7][1] == pytest.approx((w / w.sum()) @ known[near, 1]) and got[9][1] is not None


def test_hybrid_impute_of_over_20000_rows(spark):
    v = np.random.default_rng(5).permutation(20_010).astype(float)
    df = spark.createDataFrame(pd.DataFrame({"case_id": range(20_010), "v": [None if i == 3 else float(i) for i in range(20_010)], "w": v, "c": "x"}), "case_id long, v double, w double, c string")
    got = {r["case_id"]: r["v"] for r in robust.hybrid_impute(df, "case_id", ["v", "w"], ["c"], 1).collect()}
    gap = np.abs(v - v[3])
    gap[3] = np.inf
    assert len(got) == 20_010 and got[3] == gap.argmin()


def _margin_rows(spark):
    y = np.where(np.arange(5010) % 2, 1, -1)
    x = np.c_[np.random.default_rng(6).normal(size=(5010, 2)), y * 3.0]
    return spark.createDataFrame(pd.DataFrame({"case_id": range(5010), "f": x.tolist(), "y": y}))


def test_margin_weights_of_over_5000_rows(spark):
    assert int(np.argmax(margins.margin_weights(_margin_rows(spark), "case_id", "f", "y", 1))) == 2


def test_margin_subset_of_over_5000_rows(spark):
    assert 3 in margins.margin_subset(_margin_rows(spark), "case_id", "f", "y", 1)


def test_close_rows_equal_those_by_differences():
    rng = np.random.default_rng(8)
    t = np.round(np.r_[rng.normal(size=(300, 5)), np.zeros((40, 5)), rng.normal(size=(60, 5)) + 1e4], 1)
    q, names, own = t[::3], np.arange(400)[::3], np.arange(400)
    got = {i: [] for i in range(len(q))}
    for rows, cols, far in neighbours._close(q, t, names, own, 4):
        for r, c, d in zip(rows, cols, far, strict=True):
            got[r].append((c, d))
    for i, v in enumerate(q):
        d = np.round(np.sqrt(((t - v) ** 2).sum(axis=1)), 9)
        d[names[i]] = np.inf
        assert [c for c, _ in got[i]] == np.lexsort((own, d))[:4].tolist()

def test_locality_preserving_of_over_5000_rows(spark):
    x = np.random.default_rng(9).normal(size=(5010, 3)) * [1.0, 3.0, 9.0]
    df = spark.createDataFrame(pd.DataFrame({"case_id": range(5010), "f": x.tolist()}))
    assert kernels.embedded(df, "case_id", "f", "locality_preserving", 2).count() == 5010


@pytest.mark.parametrize("name,options", [("laplacian", {}), ("kernel_pca", {"gamma": 0.5}), ("locally_linear", {}), ("isometric", {"near": 4})])
def test_map_of_over_5000_rows(spark, name, options):
    x = np.random.default_rng(10).normal(size=(5010, 12)) * np.r_[4.0, 3.0, np.ones(10)] / 4
    df = spark.createDataFrame(pd.DataFrame({"case_id": range(5010), "f": x.tolist()}))
    out = kernels.embedded(df, "case_id", "f", name, 2, **options).toPandas()
    assert len(out) == 5010 and np.isfinite(out["scores"].tolist()).all()


@pytest.mark.parametrize("name,options", [("laplacian", {}), ("kernel_pca", {"gamma": 0.5}), ("locally_linear", {}), ("isometric", {})])
def test_map_by_products_equals_that_of_a_whole_matrix(monkeypatch, name, options):
    x = np.random.default_rng(12).normal(size=(300, 5)) * [4.0, 2.0, 1.0, 1.0, 1.0] / 4
    whole = kernels.MAPS[name](x, 2, **options)
    monkeypatch.setattr(kernels, "NUMBERS", 20_000)
    assert kernels.MAPS[name](x, 2, **options) == pytest.approx(whole, abs=1e-6 * np.abs(whole).max())


def test_kernel_discriminant_of_over_5000_rows(spark):
    x = np.random.default_rng(13).normal(size=(5010, 2))
    label = (x[:, 0] > 0).astype(int) + (x[:, 1] > 1)
    df = spark.createDataFrame(pd.DataFrame({"case_id": range(5010), "f": x.tolist(), "label": label}))
    out = kernels.embedded(df, "case_id", "f", "kernel_discriminant", 2, "label", gamma=0.5).toPandas().sort_values("case_id")
    u = np.array(out["scores"].tolist())
    assert len(u) == 5010 and u.T @ u == pytest.approx(np.eye(2), abs=1e-6)
    between = sum((label == c).sum() * (u[label == c].mean(axis=0) ** 2) for c in range(3))
    assert (between > 0.5).all()


@pytest.mark.parametrize("width,copies", [(2, 0), (64, 0), (64, 60)])
def test_kernel_discriminant_by_products_equals_that_of_a_whole_matrix(monkeypatch, width, copies):
    """Of low rank (the factor), of full rank, and with copies under other labels (conjugate residuals)."""
    rng = np.random.default_rng(14)
    x = rng.normal(size=(500, width)) / np.sqrt(width)
    label = rng.integers(0, 5, 500) + 5 * (x[:, 0] > 0)
    x, label = np.r_[x, x[:copies]], np.r_[label, (label[:copies] + 1) % 10]
    whole = kernels.kernel_discriminant(x, 2, label, gamma=0.5)
    g = kernels.kernel(x, x, gamma=0.5)
    g = g - g.mean(axis=0) - g.mean(axis=1)[:, None] + g.mean()
    values, vectors = np.linalg.eigh(g)
    p = vectors[:, values > 1e-8 * values.max()]
    block = sum(np.outer(label == c, label == c) / (label == c).sum() for c in range(10))
    top = np.linalg.eigvalsh(p.T @ block @ p)[::-1][:2]
    assert np.diag(whole.T @ block @ whole) == pytest.approx(top, abs=1e-6)
    monkeypatch.setattr(kernels, "NUMBERS", 20_000)
    assert kernels.kernel_discriminant(x, 2, label, gamma=0.5) == pytest.approx(whole, abs=1e-5 * np.abs(whole).max())


def _margin_table():
    e = pd.read_parquet(f"{SMALL}/embeddings.parquet").sort_values("vec_id")
    return np.array(e["embedding"].tolist(), dtype=float), np.where(e["label"] < 5, 1, -1)


def test_rank_margin_reads_its_whole_table(spark):
    x, y = _margin_table()
    w = np.ones(x.shape[1])
    for _ in range(2):
        for i in np.random.default_rng(42).permutation(len(x)):
            gap = (x - x[i]) ** 2
            far = gap @ (w * w)
            far[i] = np.inf
            hit, miss = np.where(y == y[i], far, np.inf).argmin(), np.where(y != y[i], far, np.inf).argmin()
            w = w + 0.5 * (gap[miss] / np.sqrt(far[miss]) - gap[hit] / np.sqrt(far[hit])) * w / np.abs(w).max()
    got = {r["feat"]: r["weight"] for r in catalog.QUERIES["rank_margin"](spark, SMALL).collect()}
    assert [got[j + 1] for j in range(64)] == pytest.approx((w * w / (w * w).max()).tolist(), abs=1e-9)


def test_select_margin_reads_its_whole_table(spark):
    x, y = _margin_table()
    same = y[:, None] == y[None]
    gaps = [(v[:, None] - v) ** 2 for v in x.T]
    inside, best, far = np.zeros(64, dtype=bool), 0.0, np.zeros((len(x), len(x)))
    for _ in range(2):
        for j in np.random.default_rng(42).permutation(64):
            trial = far + np.where(inside[j], -1, 1) * gaps[j]
            own = np.where(same, trial, np.inf)
            np.fill_diagonal(own, np.inf)
            value = (np.sqrt(np.maximum(np.where(same, np.inf, trial).min(axis=1), 0)) - np.sqrt(np.maximum(own.min(axis=1), 0))).sum() / 2
            if value > best + 1e-9:
                inside[j], far, best = not inside[j], trial, value
    assert [r["feat"] for r in catalog.QUERIES["select_margin"](spark, SMALL).collect()] == (np.flatnonzero(inside) + 1).tolist()


@pytest.mark.parametrize("classes", [2, 3])
def test_margin_weights_by_blocks_equal_those_by_all_differences(spark, classes):
    rng = np.random.default_rng(19)
    x, y = np.round(rng.normal(size=(90, 4)), 1), rng.integers(0, classes, 90)
    w = np.ones(4)
    for i in np.random.default_rng(42).permutation(90):
        gap = (x - x[i]) ** 2
        far = gap @ (w * w)
        far[i] = np.inf
        hit, miss = np.where(y == y[i], far, np.inf).argmin(), np.where(y != y[i], far, np.inf).argmin()
        w = w + 0.5 * (gap[miss] / np.sqrt(max(far[miss], 1e-12)) - gap[hit] / np.sqrt(max(far[hit], 1e-12))) * w / np.abs(w).max()
    df = spark.createDataFrame(pd.DataFrame({"case_id": range(90), "f": x.tolist(), "y": y}))
    assert margins.margin_weights(df, "case_id", "f", "y", 1) == pytest.approx((w * w / (w * w).max()).tolist(), abs=1e-9)


def test_near_rows_of_a_map_equal_those_by_differences(monkeypatch):
    rng = np.random.default_rng(20)
    for x, near in ((np.round(rng.normal(size=(300, 2)), 1), 12), (np.repeat(rng.normal(size=(40, 5)), 6, axis=0), 4), (rng.normal(size=(90, 3)) + 1e4, 89)):
        far = np.sqrt(((x[:, None] - x[None]) ** 2).sum(axis=2))
        np.fill_diagonal(far, np.inf)
        for tile in ((256, 2048), (16, 50)):
            monkeypatch.setattr(kernels, "TILE", tile)
            assert (kernels._near(x, near, kernels.HERE)[0] == np.argsort(far, axis=1, kind="stable")[:, :near]).all()


def _spread_map(spark, monkeypatch, name, options):
    """A map of 300 rows whose work Spark's tasks share, the map of the whole matrix, and the portions that were dealt out."""
    x = np.random.default_rng(21).normal(size=(300, 5)) * [4.0, 2.0, 1.0, 1.0, 1.0] / 4
    whole = kernels.MAPS[name](x, 2, np.arange(300) % 3, **options)
    monkeypatch.setattr(kernels, "NUMBERS", 20_000)
    dealt, spread = [], kernels._Spread.__call__
    monkeypatch.setattr(kernels._Spread, "__call__", lambda self, *a: dealt.append(len(out := spread(self, *a))) or out)
    df = spark.createDataFrame(pd.DataFrame({"case_id": range(300), "f": x.tolist(), "label": np.arange(300) % 3})).repartition(3)
    out = kernels.embedded(df, "case_id", "f", name, 2, "label", **options).toPandas().sort_values("case_id")
    return np.array(out["scores"].tolist()), whole, dealt


def test_locality_preserving_is_shared_by_tasks(spark, monkeypatch):
    got, whole, dealt = _spread_map(spark, monkeypatch, "locality_preserving", {})
    assert got == pytest.approx(whole, abs=1e-6 * np.abs(whole).max()) and min(dealt) > 1


def test_laplacian_is_shared_by_tasks(spark, monkeypatch):
    got, whole, dealt = _spread_map(spark, monkeypatch, "laplacian", {})
    assert got == pytest.approx(whole, abs=1e-6 * np.abs(whole).max()) and min(dealt) > 1


def test_kernel_pca_is_shared_by_tasks(spark, monkeypatch):
    got, whole, dealt = _spread_map(spark, monkeypatch, "kernel_pca", {"gamma": 0.5})
    assert got == pytest.approx(whole, abs=1e-6 * np.abs(whole).max()) and min(dealt) > 1


@pytest.mark.parametrize("fit,options", [("robust_svc", {"kind": "rbf", "gamma": 0.5}), ("svc", {"kind": "poly", "gamma": 1.0, "degree": 2, "shift": 1.0}), ("one_class", {"kind": "rbf", "gamma": 0.5})])
def test_machine_by_tiles_has_whole_working_sets_and_the_same_scores(monkeypatch, fit, options):
    rng = np.random.default_rng(22)
    x = rng.normal(size=(700, 6)) / 2
    y = np.where(x[:, 0] + rng.normal(size=700) * 0.3 > 0.1, 1.0, -1.0)
    whole = kernels.MACHINES[fit](x, y, **options)(x)
    sizes, pairs = [], kernels._pairs_of_violation
    monkeypatch.setattr(kernels, "_pairs_of_violation", lambda q, *a: sizes.append(len(q)) or pairs(q, *a))
    monkeypatch.setattr(kernels, "NUMBERS", 20_000)
    assert kernels.MACHINES[fit](x, y, **options)(x) == pytest.approx(whole, abs=2e-3)
    assert max(sizes) > 20_000 // 700


def test_range_of_a_kernel_by_its_factor_leaves_out_small_eigenvalues():
    rng = np.random.default_rng(23)
    x = rng.normal(size=(600, 64)) / 8
    x[599] = x[0] + 1e-4 * rng.normal(size=64) / 8
    z = rng.normal(size=(600, 3))
    z -= z.mean(axis=0)
    g = kernels.kernel(x, x, gamma=0.5)
    g = g - g.mean(axis=0) - g.mean(axis=1)[:, None] + g.mean()
    values, vectors = np.linalg.eigh(g)
    p = vectors[:, values > kernels.CUT * values.max()]
    assert p.shape[1] == 598
    inside, u = kernels._by_factor(x, z, kernels.CUT * values.max(), gamma=0.5)
    assert inside == pytest.approx(p @ (p.T @ z), abs=1e-6) and g @ u == pytest.approx(inside, abs=1e-6)
