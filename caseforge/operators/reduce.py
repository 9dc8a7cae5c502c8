"""Linear reductions from sums that Spark adds up: only matrices of features squared meet on the driver."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .more_prep import gram, projected, signed


def probabilistic(df: DataFrame, features: str, k: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Mean, loadings and noise variance of probabilistic PCA (its likelihood's maximum, in closed form)."""
    mean, cov, _ = gram(df, features)
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    noise = float(values[k:].mean()) if k < len(values) else 0.0
    return mean, signed(vectors[:, :k] * np.sqrt(np.maximum(values[:k] - noise, 0))), noise


def factors(df: DataFrame, features: str, k: int, rounds: int = 500) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean, loadings and specific variances of factor analysis, by expectation-maximisation on the covariance."""
    mean, cov, _ = gram(df, features)
    _, load, noise = probabilistic(df, features, k)
    psi = np.full(len(mean), max(noise, 1e-6))
    for _ in range(rounds):
        inner = np.linalg.solve(np.eye(k) + load.T @ (load / psi[:, None]), load.T / psi)
        moment = np.eye(k) - inner @ load + inner @ cov @ inner.T
        new = cov @ inner.T @ np.linalg.inv(moment)
        psi_new = np.maximum(np.diag(cov - new @ inner @ cov), 1e-9)
        change = np.abs(new - load).max()
        load, psi = new, psi_new
        if change < 1e-8:
            break
    return mean, signed(load), psi


def sparse_components(df: DataFrame, features: str, k: int, penalty: float, ridge: float = 1e-6, rounds: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """Mean and sparse unit loadings: elastic-net regressions of the components, alternated with a rotation."""
    mean, cov, _ = gram(df, features)
    vectors = np.linalg.eigh(cov)[1][:, ::-1][:, :k]
    a, b = vectors.copy(), vectors.copy()
    for _ in range(rounds):
        before = b.copy()
        for j in range(k):
            w, target = b[:, j], cov @ a[:, j]
            for _ in range(50):
                old = w.copy()
                for i in range(len(w)):
                    rest = target[i] - cov[i] @ w + cov[i, i] * w[i]
                    w[i] = np.sign(rest) * max(abs(rest) - penalty / 2, 0) / (cov[i, i] + ridge)
                if np.abs(w - old).max() < 1e-9:
                    break
        u, _, v = np.linalg.svd(cov @ b, full_matrices=False)
        a = u @ v
        if np.abs(b - before).max() < 1e-8:
            break
    size = np.sqrt((b * b).sum(axis=0))
    return mean, signed(np.where(size > 0, b / np.where(size > 0, size, 1), 0))


def least_squares_components(df: DataFrame, features: str, targets: str, k: int, keep: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Partial least squares between two array columns: (mean, weights, mean of targets, coefficients features x targets).

    Weights are the leading directions of the cross-covariance, which is deflated by each score
    (SIMPLS). With `keep`, only so many features of a direction stay (sparse PLS).
    """
    joined = df.select(F.concat(F.transform(features, lambda x: x.cast("double")), F.transform(targets, lambda x: x.cast("double"))).alias("_z"))
    p = len(df.select(features).first()[0])
    mean, cov, n = gram(joined, "_z")
    xx, xy = cov[:p, :p], cov[:p, p:].copy()
    weights, loads = np.zeros((p, 0)), np.zeros((p, 0))
    for _ in range(k):
        u, _, _ = np.linalg.svd(xy, full_matrices=False)
        w = u[:, 0]
        if keep is not None:
            cut = np.sort(np.abs(w))[::-1][min(keep, p - 1)] if keep < p else 0.0
            w = np.sign(w) * np.maximum(np.abs(w) - cut, 0)
        w = w / np.sqrt(max(w @ xx @ w, 1e-300))
        load = xx @ w
        for q in loads.T:
            load = load - q * (q @ load)
        load = load / max(np.linalg.norm(load), 1e-300)
        weights, loads = np.c_[weights, w], np.c_[loads, load]
        xy = xy - np.outer(load, load @ xy)
    weights = signed(weights)
    inner = np.linalg.solve(weights.T @ xx @ weights + 1e-12 * np.eye(k), weights.T @ cov[:p, p:])
    return mean[:p], weights, mean[p:], weights @ inner


def deviation(df: DataFrame, case: str, features: str, targets: str, model: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> DataFrame:
    """(case, deviation): the targets less what a normative model of the features expects of them."""
    mean_x, _, mean_y, beta = model

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x, y = (np.array(pdf[c].tolist(), dtype=float).reshape(len(pdf), -1) for c in (features, targets))
            yield pd.DataFrame({case: pdf[case], "deviation": (y - mean_y - (x - mean_x) @ beta).tolist()})

    return df.select(case, features, targets).mapInPandas(run, f"{case} {dict(df.dtypes)[case]}, deviation array<double>")


def independent(df: DataFrame, case: str, features: str, k: int, rounds: int = 30) -> tuple[DataFrame, np.ndarray]:
    """Scores of k independent components and their unmixing matrix: whitening, then fixed-point steps with tanh, one pass each."""
    mean, cov, _ = gram(df, features)
    values, vectors = np.linalg.eigh(cov)
    white = vectors[:, ::-1][:, :k] / np.sqrt(np.maximum(values[::-1][:k], 1e-12))
    w = np.linalg.qr(np.random.default_rng(42).normal(size=(k, k)))[0]

    for _ in range(rounds):
        def step(batches: Iterator[pd.DataFrame], w: np.ndarray = w) -> Iterator[pd.DataFrame]:
            a, b, n = np.zeros((k, k)), np.zeros(k), 0
            for pdf in batches:
                if len(pdf):
                    z = (np.array(pdf[features].tolist(), dtype=float) - mean) @ white
                    g = np.tanh(z @ w.T)
                    a, b, n = a + g.T @ z, b + (1 - g * g).sum(axis=0), n + len(z)
            yield pd.DataFrame({"a": [a.ravel().tolist()], "b": [b.tolist()], "n": [n]})

        rows = df.select(features).mapInPandas(step, "a array<double>, b array<double>, n long").collect()  # k x k numbers a partition
        n = sum(r["n"] for r in rows)
        new = sum(np.array(r["a"]) for r in rows).reshape(k, k) / n - (sum(np.array(r["b"]) for r in rows) / n)[:, None] * w
        u, _, v = np.linalg.svd(new)
        new = u @ v
        settled = np.abs(np.abs((new * w).sum(axis=1)) - 1).max() < 1e-6
        w = new
        if settled:
            break
    basis = signed(white @ w.T)
    return projected(df, case, features, mean, basis), basis


def aligned_basis(reference: np.ndarray, target: np.ndarray) -> np.ndarray:
    """The target's loadings turned onto the reference's (orthogonal Procrustes)."""
    u, _, v = np.linalg.svd(target.T @ reference)
    return target @ (u @ v)


def spatial_median(df: DataFrame, features: str, rounds: int = 100, tolerance: float = 1e-8) -> np.ndarray:
    """The point of least summed distance to all rows (Weiszfeld's steps, one pass each), from the mean."""
    centre = gram(df, features)[0]
    for _ in range(rounds):
        def step(batches: Iterator[pd.DataFrame], centre: np.ndarray = centre) -> Iterator[pd.DataFrame]:
            s, w = np.zeros(len(centre)), 0.0
            for pdf in batches:
                if len(pdf):
                    x = np.array(pdf[features].tolist(), dtype=float)
                    gap = np.sqrt(((x - centre) ** 2).sum(axis=1))
                    inv = np.where(gap > 1e-12, 1 / np.maximum(gap, 1e-12), 0)
                    s, w = s + inv @ x, w + inv.sum()
            yield pd.DataFrame({"s": [s.tolist()], "w": [w]})

        rows = df.select(features).mapInPandas(step, "s array<double>, w double").collect()  # a row a partition
        total = sum(r["w"] for r in rows)
        if not total:
            break
        new = sum(np.array(r["s"]) for r in rows) / total
        moved = np.abs(new - centre).max()
        centre = new
        if moved < tolerance:
            break
    return centre


def robust_components(df: DataFrame, case: str, features: str, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Spatial median and components of the rows' directions from it: far rows count no more than near ones."""
    centre = spatial_median(df, features)

    def unit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[features].tolist(), dtype=float).reshape(len(pdf), len(centre)) - centre
            size = np.sqrt((x * x).sum(axis=1, keepdims=True))
            yield pd.DataFrame({"u": (x / np.where(size > 1e-12, size, 1)).tolist()})

    mean, cov, _ = gram(df.select(features).mapInPandas(unit, "u array<double>"), "u")
    values, vectors = np.linalg.eigh(cov + np.outer(mean, mean))
    return centre, signed(vectors[:, ::-1][:, :k])


def bhattacharyya(df: DataFrame, features: str, label: str, without: int | None = None) -> float:
    """Gaussian distance of the two classes (label > 0 or not), of all features or without one."""
    parts = [gram(df.filter(c), features) for c in (F.col(label) > 0, F.col(label) <= 0)]
    return _bhattacharyya(parts, without)


def _bhattacharyya(parts: list, without: int | None) -> float:
    own = [i for i in range(len(parts[0][0])) if i != without]
    (m1, c1), (m2, c2) = ((m[own], (c * n / (n - 1))[np.ix_(own, own)]) for m, c, n in parts)
    both = (c1 + c2) / 2
    logdet = lambda c: np.linalg.slogdet(c)[1]
    return float((m1 - m2) @ np.linalg.solve(both, m1 - m2) / 8 + 0.5 * (logdet(both) - 0.5 * (logdet(c1) + logdet(c2))))


def bhattacharyya_ranks(df: DataFrame, features: str, label: str) -> list[float]:
    """The distance of the classes without each feature in turn, from one pass a class."""
    parts = [gram(df.filter(c), features) for c in (F.col(label) > 0, F.col(label) <= 0)]
    return [_bhattacharyya(parts, i) for i in range(len(parts[0][0]))]
