"""All queries of the engine and their SQL, gathered from the areas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .queries import assessment, base, extended, further, learning, preparation

_AREAS = (learning, base, preparation, assessment, further, extended)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {k: v for a in _AREAS for k, v in a.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for a in _AREAS for k, v in a.ORACLES.items()}
