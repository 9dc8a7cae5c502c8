"""Decision graphs, relevance of features, synthetic cases, and measures of case graphs."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .neighbours import nearest
from .order import medians, running


def decision_graph(df: DataFrame, case: str, learner_of: dict[tuple[str, str], int], classes: list[str]) -> DataFrame:
    """One-vs-one scores decoded by elimination: the first class against the last, the loser leaves, until one is left."""
    wide = df.groupBy(case).agg(*[F.max(F.when(F.col("learner") == n, F.col("score"))).alias(f"_s{n}") for n in learner_of.values()])

    def node(left: list[str]) -> Column:
        if len(left) == 1:
            return F.lit(left[0])
        return F.when(F.col(f"_s{learner_of[(left[0], left[-1])]}") > 0, node(left[:-1])).otherwise(node(left[1:]))

    return wide.select(case, node(classes).alias("cls"))


def _score(weights: dict[str, float], swapped: str | None = None, by: Column | None = None) -> Column:
    out = F.lit(0.0)
    for f, w in weights.items():
        out = out + F.lit(w) * (by if f == swapped and by is not None else F.col(f))
    return out


def median_relevance(df: DataFrame, case: str, weights: dict[str, float]) -> DataFrame:
    """(perturbed - observed) x 100 / range of the scores, each feature in turn set to its median. Scores are linear."""
    middle = {}
    for f in weights:
        one = df.select(F.lit(1).alias("_g"), F.col(f).alias("value"))
        middle[f] = medians(one, ["_g"], "value").first()["median"]
    own = df.na.drop(subset=list(weights)).withColumn("_s", _score(weights))
    low, high = own.agg(F.min("_s"), F.max("_s")).first()
    return own.select(case, *[((_score(weights, f, F.lit(middle[f])) - F.col("_s")) * 100 / (high - low)).alias(f) for f in weights])


def linear_shapley(df: DataFrame, case: str, weights: dict[str, float]) -> DataFrame:
    """Shapley values of a linear score under independent features: weight x (value - mean)."""
    own = df.na.drop(subset=list(weights))
    means = own.agg(*[F.avg(f).alias(f) for f in weights]).first()
    return own.select(case, *[(F.lit(w) * (F.col(f) - means[f])).alias(f) for f, w in weights.items()])


def interpolated(df: DataFrame, case: str, features: str, k: int, seed: int = 42) -> DataFrame:
    """One synthetic case for each real one: a point between it and one of its k nearest, chosen and placed by hash."""
    near = nearest(df, df, case, features, k)
    pick = F.pmod(F.xxhash64("query", F.lit(seed)), F.lit(k)) + 1
    chosen = near.filter(F.col("place") == pick).select("query", F.col(case).alias("_n"))
    a = df.select(F.col(case).alias("query"), F.col(features).alias("_a"))
    b = df.select(F.col(case).alias("_n"), F.col(features).alias("_b"))
    share = F.pmod(F.xxhash64("query", F.lit(seed + 1)), F.lit(1000)) / 1000
    made = chosen.join(a, "query").join(b, "_n").withColumn("_t", share)
    return made.select("query", F.zip_with("_a", "_b", lambda x, y: x + (y - x) * F.col("_t")).alias(features))


def degrees(edges: DataFrame) -> DataFrame:
    """Degree and strength of each node of an undirected graph (a, b, w)."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "w"))
    c = both.groupBy("a", "b").agg(F.sum("w").alias("w"))
    return c.groupBy(F.col("a").alias("node")).agg(F.count(F.lit(1)).alias("degree"), F.sum("w").alias("strength"))


def strongest(edges: DataFrame, share: float) -> DataFrame:
    """Edges whose percent rank by descending weight lies under the share (ties rank alike)."""
    c = edges.groupBy("w").agg(F.count(F.lit(1)).alias("n")).withColumn("down", -F.col("w")).withColumn("_all", F.lit(1))
    r = running(c, ["_all"], "down", ["n"]).filter((F.col("before_n") / (F.col("all_n") - 1)) < share)
    return edges.join(r.select(F.col("w").alias("_w")), F.col("w") == F.col("_w")).drop("_w")


#: Edges of one graph that a task holds; more fail.
EDGES = 5_000_000


def pagerank(edges: DataFrame, damping: float = 0.85, rounds: int = 100, graph: str | None = None) -> DataFrame:
    """Weighted page rank of each graph (column `graph`, a case say; without one all edges are one graph), over its edges as they are."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        if len(pdf) > EDGES:
            raise ValueError(f"a graph has over {EDGES} edges")
        names, at = np.unique(np.concatenate([pdf["a"], pdf["b"]]), return_inverse=True)
        a, b, n = at[: len(pdf)], at[len(pdf) :], len(names)
        out = np.bincount(a, pdf["w"], n)
        share = pdf["w"].to_numpy(dtype=float) / out[a]
        r = np.full(n, 1 / n)
        for _ in range(rounds):
            r = (1 - damping) / n + damping * (np.bincount(b, share * r[a], n) + r[out == 0].sum() / n)
        return pd.DataFrame({**({graph: pdf[graph].iloc[0]} if graph else {}), "node": names, "rank": r})

    kinds = dict(edges.dtypes)
    own = edges if graph else edges.withColumn("_g", F.lit(1))
    head = f"{graph} {kinds[graph]}, " if graph else ""
    return own.groupBy(graph or "_g").applyInPandas(run, f"{head}node {kinds['a']}, rank double")
