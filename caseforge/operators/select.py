"""Choosing features or learners step by step. Tables of features and pairs are small; cases stay in Spark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import auc

CRITERIA = ("mim", "mifs", "mrmr", "cife", "jmi", "condred", "cmim", "icap", "disr")


def information_tables(df: DataFrame, case: str, cls: str) -> tuple[dict, dict]:
    """From a discrete long table (case, feat, value, cls): I(f; c) by feature, and by pair I(f; g), I(f; g | c), I(f, g; c), H(f, g, c).

    One join on the case gives the joint counts of all pairs; entropies are sums over them.
    """
    a = df.select(case, F.col(cls).alias("c"), F.col("feat").alias("a"), F.col("value").alias("u"))
    b = df.select(F.col(case).alias("_i"), F.col("feat").alias("b"), F.col("value").alias("v"))
    joint = a.join(b, (F.col(case) == F.col("_i")) & (F.col("a") <= F.col("b"))).groupBy("a", "b", "u", "v", "c").agg(F.count(F.lit(1)).cast("double").alias("n"))

    def h(keys: list[str], name: str) -> DataFrame:
        t = joint.groupBy("a", "b", *keys).agg(F.sum("n").alias("n"))
        return t.groupBy("a", "b").agg((F.log2(F.sum("n")) - F.sum(F.col("n") * F.log2("n")) / F.sum("n")).alias(name))

    out = None
    for keys, name in ((["u"], "hu"), (["v"], "hv"), (["c"], "hc"), (["u", "v"], "huv"), (["u", "c"], "huc"), (["v", "c"], "hvc"), (["u", "v", "c"], "huvc")):
        out = h(keys, name) if out is None else out.join(h(keys, name), ["a", "b"])
    relevance, pairs = {}, {}
    for r in out.collect():  # one row a pair of features
        if r["a"] == r["b"]:
            relevance[r["a"]] = r["hu"] + r["hc"] - r["huc"]
        else:
            found = {"mi": r["hu"] + r["hv"] - r["huv"], "cmi": r["huc"] + r["hvc"] - r["huvc"] - r["hc"], "joint": r["huv"] + r["hc"] - r["huvc"], "h": r["huvc"]}
            pairs[(r["a"], r["b"])] = pairs[(r["b"], r["a"])] = found
    return relevance, pairs


def by_information(relevance: dict, pairs: dict, k: int, criterion: str, beta: float = 1.0) -> list[str]:
    """Greedy choice of k features under one of CRITERIA."""
    chosen: list[str] = []

    def gain(f: str) -> float:
        r, p = relevance[f], [pairs[(f, g)] for g in chosen]
        if not p or criterion == "mim":
            return r
        mi, cmi = [x["mi"] for x in p], [x["cmi"] for x in p]
        match criterion:
            case "mifs":
                return r - beta * sum(mi)
            case "mrmr":
                return r - sum(mi) / len(p)
            case "cife":
                return r - sum(mi) + sum(cmi)
            case "jmi":
                return sum(x["joint"] for x in p)
            case "condred":
                return r + sum(cmi)
            case "cmim":
                return r - max(0.0, *[a - b for a, b in zip(mi, cmi, strict=True)]) if len(p) > 1 else r - max(0.0, mi[0] - cmi[0])
            case "icap":
                return r - sum(max(0.0, a - b) for a, b in zip(mi, cmi, strict=True))
            case "disr":
                return sum(x["joint"] / x["h"] for x in p if x["h"] > 0)
        raise ValueError(f"unknown criterion {criterion}")

    while len(chosen) < min(k, len(relevance)):
        chosen.append(max(sorted(set(relevance) - set(chosen)), key=gain))
    return chosen


def forward(df: DataFrame, case: str, item: str, part: str, y: str, k: int) -> list[tuple[str, float]]:
    """Adds, k times, the item whose contribution raises the AUC of the summed score most; all candidates are one job a step.

    df: (case, item, part, y), a contribution of each item to each case's score.
    """
    chosen: list[tuple[str, float]] = []
    for _ in range(k):
        names = [c for c, _ in chosen]
        base = df.groupBy(F.col(case).alias("_c")).agg(F.sum(F.when(F.col(item).isin(names), F.col(part)).otherwise(0.0)).alias("_s"))
        tried = df.filter(~F.col(item).isin(names)).join(base, F.col(case) == F.col("_c")).withColumn("score", F.round(F.col("_s") + F.col(part), 9))
        best = auc(tried, [item], y, "score").orderBy(F.round("auc", 9).desc(), item).limit(1).collect()
        if not best:
            break
        chosen.append((best[0][item], best[0]["auc"]))
    return chosen


def backward(df: DataFrame, case: str, item: str, part: str, y: str, keep: int) -> list[str]:
    """Drops the item without which the AUC is highest, until `keep` are left."""
    left = sorted(r[0] for r in df.select(item).distinct().collect())
    while len(left) > keep:
        own = df.filter(F.col(item).isin(left))
        whole = own.groupBy(F.col(case).alias("_c")).agg(F.sum(part).alias("_s"))
        tried = own.join(whole, F.col(case) == F.col("_c")).withColumn("score", F.round(F.col("_s") - F.col(part), 9))
        worst = auc(tried, [item], y, "score").orderBy(F.round("auc", 9).desc(), item).first()[item]
        left.remove(worst)
    return left
