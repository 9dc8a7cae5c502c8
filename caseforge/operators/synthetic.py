"""Synthetic cases, networks of features, and graphs compared by their neighbourhoods."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .more_prep import gram

SEED = 42


def _drawn(df: DataFrame, rows: int, schema: str, make) -> DataFrame:
    """Rows 0 to n - 1 made in parallel; each row's numbers come from its own generator."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"case_id": pdf["id"], "features": [make(np.random.default_rng((SEED, int(i)))).tolist() for i in pdf["id"]]})

    return df.sparkSession.range(rows).mapInPandas(run, schema)


def gaussian(df: DataFrame, features: str, rows: int, k: int) -> DataFrame:
    """(case_id, features): normal scores on the first k principal components, projected back."""
    mean, cov, _ = gram(df, features)
    values, vectors = np.linalg.eigh(cov)
    load = vectors[:, ::-1][:, :k] * np.sqrt(np.maximum(values[::-1][:k], 0))
    return _drawn(df, rows, "case_id long, features array<double>", lambda rng: mean + load @ rng.normal(size=k))


def mixture(df: DataFrame, features: str, rows: int, parts: int) -> DataFrame:
    """The same from a mixture of normals fitted by Spark."""
    from pyspark.ml.clustering import GaussianMixture
    from pyspark.ml.functions import array_to_vector

    own = df.select(array_to_vector(F.col(features).cast("array<double>")).alias("features"))
    model = GaussianMixture(k=parts, seed=SEED, maxIter=30).fit(own)
    weights = np.array(model.weights)
    found = [(np.array(r["mean"].toArray()), np.linalg.cholesky(r["cov"].toArray() + 1e-9 * np.eye(len(r["mean"].toArray())))) for r in model.gaussiansDF.collect()]

    def make(rng: np.random.Generator) -> np.ndarray:
        mean, root = found[int(rng.choice(len(weights), p=weights / weights.sum()))]
        return mean + root @ rng.normal(size=len(mean))

    return _drawn(df, rows, "case_id long, features array<double>", make)


def copula(df: DataFrame, features: str, rows: int, grid: int = 200) -> DataFrame:
    """The same with each feature's own distribution (quantiles on a grid) and normal dependence between features' ranks."""
    from statistics import NormalDist

    d = len(df.select(features).first()[0])
    shares = [(i + 0.5) / grid for i in range(grid)]
    row = df.agg(*[F.percentile_approx(F.col(features)[i].cast("double"), shares, 10_000).alias(f"q{i}") for i in range(d)]).first()
    quantiles = np.array([row[f"q{i}"] for i in range(d)])
    normal = np.array([NormalDist().inv_cdf(s) for s in shares])

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            x = np.array(pdf[features].tolist(), dtype=float).reshape(len(pdf), d)
            yield pd.DataFrame({"z": np.stack([np.interp(x[:, i], quantiles[i], normal) for i in range(d)], axis=1).tolist()})

    _, cov, _ = gram(df.select(features).mapInPandas(scored, "z array<double>"), "z")
    spread = np.sqrt(np.maximum(np.diag(cov), 1e-12))
    root = np.linalg.cholesky(cov / np.outer(spread, spread) + 1e-9 * np.eye(d))
    return _drawn(df, rows, "case_id long, features array<double>", lambda rng: np.array([np.interp(v, normal, q) for v, q in zip(root @ rng.normal(size=d), quantiles, strict=True)]))


def feature_network(df: DataFrame, features: str) -> DataFrame:
    """(a, b, w): Pearson correlations of all pairs of features a < b (from 1), from one Gram matrix."""
    _, cov, _ = gram(df, features)
    spread = np.sqrt(np.diag(cov))
    rows = [(i + 1, j + 1, float(cov[i, j] / (spread[i] * spread[j]))) for i in range(len(cov)) for j in range(i + 1, len(cov)) if spread[i] > 0 and spread[j] > 0]
    return df.sparkSession.createDataFrame(rows, "a int, b int, w double")


def relabelled(nodes: DataFrame, edges: DataFrame, rounds: int) -> DataFrame:
    """(graph, round, label, n): counts of neighbourhood labels, for rounds 0 to `rounds`.

    nodes: graph, node, label; edges: graph, a, b, undirected. A label of the next round is the digest
    of the node's label and its neighbours' sorted ones.
    """
    both = edges.select("graph", "a", "b").unionByName(edges.select("graph", F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    now = nodes.select("graph", "node", F.col("label").cast("string").alias("label"))
    out = now.withColumn("round", F.lit(0))
    for k in range(1, rounds + 1):
        side = now.select(F.col("graph").alias("_g"), F.col("node").alias("_n"), F.col("label").alias("_l"))
        near = both.join(side, (F.col("graph") == F.col("_g")) & (F.col("b") == F.col("_n"))).groupBy("graph", F.col("a").alias("node")).agg(F.array_join(F.sort_array(F.collect_list("_l")), ",").alias("_around"))
        now = now.join(near, ["graph", "node"], "left").select("graph", "node", F.md5(F.concat_ws("|", "label", F.coalesce("_around", F.lit("")))).alias("label"))
        out = out.unionByName(now.withColumn("round", F.lit(k)))
    return out.groupBy("graph", "round", "label").agg(F.count(F.lit(1)).alias("n"))


def graph_kernel(counts: DataFrame) -> DataFrame:
    """(g, h, k): sums over shared labels of products of counts, for pairs of graphs g <= h that share one."""
    left = counts.select(F.col("graph").alias("g"), "round", "label", F.col("n").alias("_n"))
    right = counts.select(F.col("graph").alias("h"), F.col("round").alias("_r"), F.col("label").alias("_l"), F.col("n").alias("_m"))
    pairs = left.join(right, (F.col("round") == F.col("_r")) & (F.col("label") == F.col("_l"))).filter("g <= h")  # graphs squared for a label
    return pairs.groupBy("g", "h").agg(F.sum(F.col("_n") * F.col("_m")).alias("k"))


def shapley(df: DataFrame, case: str, features: str, model, background: np.ndarray) -> DataFrame:
    """(case, shares): exact Shapley values of model(rows x features) against a background mean, over all coalitions (16 features at most)."""
    d = len(background)
    if d > 16:
        raise ValueError("over 16 features: their coalitions are too many")
    from math import factorial

    masks = (np.arange(1 << d)[:, None] >> np.arange(d)) & 1
    size = masks.sum(axis=1)
    weight = np.array([factorial(s) * factorial(d - s - 1) / factorial(d) if s < d else 0.0 for s in size])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for row in pdf[features]:
                x = np.asarray(row, dtype=float)
                value = model(np.where(masks == 1, x, background))
                out.append([float((weight[without] * (value[without | (1 << j)] - value[without])).sum()) for j in range(d) for without in [np.flatnonzero(masks[:, j] == 0)]])
            yield pd.DataFrame({case: pdf[case], "shares": out})

    return df.select(case, features).mapInPandas(run, f"{case} {dict(df.dtypes)[case]}, shares array<double>")


def nearest_position(sorted_values: list[float], x: Column) -> Column:
    """Position (from 1) of the value nearest to x in an ascending vector of literals; the lower one on ties."""
    v = [float(s) for s in sorted_values]

    def tree(a: int, b: int) -> Column:
        if a == b:
            return F.lit(a + 1)
        m = (a + b) // 2
        return F.when(x <= F.lit((v[m] + v[m + 1]) / 2), tree(a, m)).otherwise(tree(m + 1, b))

    return tree(0, len(v) - 1)
