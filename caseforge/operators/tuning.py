"""Choosing nodes of a parameter grid."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .order import hazen


def regularised(perf: str, complexity: str, weight: float, power: float) -> Column:
    return F.col(perf) - weight * F.pow(F.col(complexity), F.lit(power))


def best_node(grid: DataFrame, perf: str, complexity: str, node: str, weight: float = 0.0, power: float = 1.0, higher: bool = True) -> DataFrame:
    """The node with the best regularised score; ties go to the simplest one, then the first."""
    g = grid.withColumn("regularised", regularised(perf, complexity, weight, power))
    key = F.col("regularised").desc() if higher else F.col("regularised").asc()
    return g.orderBy(key, complexity, node).limit(1)


def percentile_nodes(grid: DataFrame, perf: str, percent: float) -> DataFrame:
    """All nodes at or beyond a Hazen percentile of the score."""
    one = grid.withColumn("_all", F.lit(1))
    cut = hazen(one, ["_all"], perf, [percent])
    name = [c for c in cut.columns if c != "_all"][0]
    return one.join(F.broadcast(cut), "_all").filter(F.col(perf) >= F.col(name)).drop("_all", name)
