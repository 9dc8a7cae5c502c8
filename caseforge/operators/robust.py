"""Robust scales and imputation by neighbours: a feature's values, or a table, are one task's, in linear memory."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Factors that make the scales agree with the standard deviation of a normal sample.
QN, SN = 2.2219, 1.1926


def _first(low: np.ndarray, high: np.ndarray, holds) -> np.ndarray:
    """The first place in [low, high) at which `holds` is true, high where there is none; it stays true from there on."""
    low, high = low.copy(), high.copy()
    while (open_ := low < high).any():
        mid = (low + high) // 2
        yes = holds(np.minimum(mid, np.maximum(high - 1, 0)))
        high = np.where(open_ & yes, mid, high)
        low = np.where(open_ & ~yes, mid + 1, low)
    return low


def qn(x: np.ndarray) -> float:
    """The order statistic of pairwise distances at C(h, 2), h = n // 2 + 1, times QN.

    Distances are counted, not listed: the least number that enough pairs of the sorted values don't
    exceed is found by halving the doubles between 0 and the range.
    """
    n = len(x)
    if n < 2:
        return 0.0
    h = n // 2 + 1
    s, i = np.sort(np.asarray(x, dtype=float)), np.arange(n)
    low, high = -1, int(np.float64(s[-1] - s[0]).view(np.int64))  # doubles from 0 on stand in the order of their bits
    while high - low > 1:
        mid = (low + high) // 2
        t = np.int64(mid).view(np.float64)
        if int((_first(i, np.full(n, n), lambda j: s[j] - s > t) - i - 1).sum()) >= h * (h - 1) // 2:
            high = mid
        else:
            low = mid
    return float(QN * np.int64(high).view(np.float64))


def sn(x: np.ndarray) -> float:
    """The low median over rows of the high median of distances to all rows, times SN: the nearest n // 2 + 1 values stand side by side."""
    n = len(x)
    if n < 2:
        return 0.0
    s, i = np.sort(np.asarray(x, dtype=float)), np.arange(n)
    m = n // 2 + 1
    least, most = np.maximum(0, i - m + 1), np.minimum(i, n - m)
    at = np.minimum(_first(least, most + 1, lambda a: s[a + m - 1] - s >= s - s[a]), most)
    width = lambda a: np.maximum(s - s[a], s[a + m - 1] - s)
    inner = np.minimum(width(at), width(np.maximum(at - 1, least)))
    return float(SN * np.partition(inner, (n + 1) // 2 - 1)[(n + 1) // 2 - 1])


def _nearest(far: np.ndarray, k: int) -> np.ndarray:
    """Places of the k least, ties by place, in that order."""
    if len(far) > k:
        some = np.flatnonzero(far <= np.partition(far, k - 1)[k - 1])
        return some[np.argsort(far[some], kind="stable")[:k]]
    return np.argsort(far, kind="stable")


def fit_robust(train: DataFrame, keys: list[str], scale: str = "qn") -> DataFrame:
    """centre 0 and sd, a robust scale: parameters for `prep.standardise`. A feature's values are one task's."""
    method = {"qn": qn, "sn": sn}[scale]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        sd = method(pdf["value"].to_numpy(dtype=float))
        return pdf[keys].iloc[:1].assign(centre=0.0, sd=sd if sd > 2.3e-308 else 1e-5)

    kinds = {f.name: f.dataType.simpleString() for f in train.schema}
    head = ", ".join(f"`{k}` {kinds[k]}" for k in keys)
    return train.filter(F.col("value").isNotNull()).select(*keys, "value").groupBy(*keys).applyInPandas(run, f"{head}, centre double, sd double")


def sequential_impute(df: DataFrame, case: str, features: str, k: int) -> DataFrame:
    """(case, features): gaps filled from the k nearest complete rows, weighted by inverse distance.

    Rows with fewer gaps come first (ties by case), and a filled row joins the complete ones: the
    order matters, so the table is one task's.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(case)
        x = np.array([[np.nan if v is None else v for v in row] for row in pdf[features]], dtype=float)
        gaps = np.isnan(x).sum(axis=1)
        held = int((gaps == 0).sum())
        pool = np.empty((x.shape[1], len(x)))
        pool[:, :held] = x[gaps == 0].T
        for i in np.lexsort((np.arange(len(x)), gaps)):
            if not gaps[i] or not held:
                continue
            has = ~np.isnan(x[i])
            far = np.zeros(held)
            for j in np.flatnonzero(has):
                far += (pool[j, :held] - x[i, j]) ** 2
            far = np.sqrt(far)
            near = _nearest(far, k)
            w = 1 / np.maximum(far[near], 1e-12)
            x[i, ~has] = (w / w.sum()) @ pool[:, near].T[:, ~has]
            pool[:, held] = x[i]
            held += 1
        return pd.DataFrame({case: pdf[case].to_numpy(), features: [[None if np.isnan(v) else float(v) for v in row] for row in x]})

    return df.select(case, features).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(run, f"{case} {dict(df.dtypes)[case]}, {features} array<double>")


def hybrid_impute(df: DataFrame, case: str, numbers: list[str], names: list[str], k: int) -> DataFrame:
    """Gaps of number columns filled by the mean of the k nearest rows that have them.

    The distance is the mean of the scaled Euclidean distance over numbers and the share of differing
    names, both over what the two rows have. The table is one task's, compared row by row.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(case).reset_index(drop=True)
        x = pdf[numbers].to_numpy(dtype=float)
        low, high = np.nanmin(x, axis=0), np.nanmax(x, axis=0)
        z = (x - low) / np.where(high > low, high - low, 1)
        codes = np.stack([pd.factorize(pdf[c])[0] for c in names], axis=1) if names else np.zeros((len(x), 0))
        out = x.copy()
        for i in np.flatnonzero(np.isnan(x).any(axis=1)):
            gap = (z - z[i]) ** 2
            both = ~np.isnan(gap)
            far = np.sqrt(np.where(both, gap, 0).sum(axis=1) / np.maximum(both.sum(axis=1), 1))
            if names:
                far = (far + (codes != codes[i]).mean(axis=1)) / 2
            far[i] = np.inf
            for j in np.flatnonzero(np.isnan(x[i])):
                known = np.flatnonzero(~np.isnan(x[:, j]))
                own = known[_nearest(far[known], k)]
                out[i, j] = x[own, j].mean() if len(own) else np.nan
        return pdf[[case]].assign(**{c: out[:, j] for j, c in enumerate(numbers)})

    kinds = dict(df.dtypes)
    return df.select(case, *numbers, *names).withColumn("_g", F.lit(1)).groupBy("_g").applyInPandas(run, f"{case} {kinds[case]}, " + ", ".join(f"{c} double" for c in numbers))
