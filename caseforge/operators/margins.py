"""Rankers by margins and neighbours, subsets of ranked features, and strategies over subsets."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .folds import hashed
from .neighbours import nearest

#: Rows and columns of a tile of a subset's distances, which a task holds at once.
TILE = 256, 2048
#: Distances of a block of rows that the driver holds at once for margin weights.
MARGINS = 8_000_000


def relief(df: DataFrame, case: str, features: str, label: str, k: int) -> DataFrame:
    """(feat, weight): mean distance along each feature to the k nearest rows of other classes, less that to those of the own class.

    Distances along a feature are shares of its range; every class is searched for every row.
    """
    d = len(df.select(features).first()[0])
    spans = df.select(F.posexplode(features).alias("i", "v")).groupBy("i").agg((F.max("v") - F.min("v")).cast("double").alias("span"))
    span = [r["span"] or 0.0 for r in sorted(spans.collect(), key=lambda r: r["i"])]  # a row a feature
    classes = [r[0] for r in df.filter(F.col(label).isNotNull()).select(label).distinct().limit(1001).collect()]
    if len(classes) > 1000:
        raise ValueError(f"{label} has over 1000 classes")
    own = df.filter(F.col(label).isNotNull()).select(case, features, label)
    side = own.select(F.col(case).alias("query"), F.col(features).alias("q"), F.col(label).alias("lq"))
    near = None
    for c in sorted(classes):
        part = own.filter(F.col(label) == c)
        found = nearest(part, own, case, features, k).select("query", case)
        near = found if near is None else near.unionByName(found)
    pairs = near.join(side, "query").join(own, case)
    gaps = F.zip_with("q", F.col(features), lambda a, b: F.abs(a.cast("double") - b.cast("double")))
    sign = F.when(F.col("lq") == F.col(label), -1.0).otherwise(1.0)
    shares = [F.avg(F.when(sign > 0, gaps[i])).alias(f"m{i}") for i in range(d)] + [F.avg(F.when(sign < 0, gaps[i])).alias(f"h{i}") for i in range(d)]
    r = pairs.agg(*shares).first()
    rows = [(i + 1, ((r[f"m{i}"] or 0.0) - (r[f"h{i}"] or 0.0)) / span[i] if span[i] else 0.0) for i in range(d)]
    return df.sparkSession.createDataFrame(rows, "feat int, weight double")


def _matrix(df: DataFrame, case: str, features: str, label: str) -> tuple[np.ndarray, np.ndarray]:
    rows = df.filter(F.col(label).isNotNull()).select(case, features, label).toPandas().sort_values(case)
    return np.array(rows[features].tolist(), dtype=float), rows[label].to_numpy()


def _by_class(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Rows and their numbers in the order of their classes, the bounds of each row's class, and each number's place."""
    order = np.argsort(y, kind="stable")
    sizes = np.unique(y, return_counts=True)[1]
    ends = np.cumsum(sizes)
    place = np.empty(len(x), dtype=np.int64)
    place[order] = np.arange(len(x))
    return x[order], order, np.repeat(ends - sizes, sizes), np.repeat(ends, sizes), place


def margin_weights(df: DataFrame, case: str, features: str, label: str, rounds: int = 5) -> list[float]:
    """Iterative margin weights: each row moves the weights along the difference of its nearest miss and nearest hit.

    The order of the rows matters, so they are the driver's: rows x features numbers. Distances come from matrix products for
    a block of rows under the weights at its start; as far as the weights have moved since, they bound the nearest rows, and
    those that may be nearest are computed by differences.
    """
    x, order, first, end, place = _by_class(*_matrix(df, case, features, label))
    n, size = len(x), 16
    w = np.ones(x.shape[1])
    for _ in range(rounds):
        todo, at = place[np.random.default_rng(42).permutation(n)], 0
        while at < n:
            size = max(1, min(size, MARGINS // max(1, n)))
            own, v = todo[at : at + size], w * w
            z = x * np.sqrt(v)
            norm = (z * z).sum(axis=1)
            far = norm[own, None] + norm - 2 * z[own] @ z.T
            far[np.arange(len(own)), own] = np.inf
            slip = 1e-14 * (x.shape[1] + 8) * (norm[own] + norm.max())  # rounding of the products, with room to spare
            turned = 0
            for i, row in enumerate(own):
                moved = np.where(v > 0, w * w / np.where(v > 0, v, 1.0), 1.0)
                wide = moved.max() / max(moved.min(), 1e-300)
                if i and wide > 1.2:
                    break
                turned += 1
                d, a, b = far[i], first[row], end[row]
                least = [d[a:b].min(), min(d[:a].min(initial=np.inf), d[b:].min(initial=np.inf))]
                near = np.arange(n)
                if np.isfinite(least).all():
                    near = np.flatnonzero(d <= (max(least) + slip[i]) * wide + slip[i])
                    near = near[d[near] <= (np.where((near >= a) & (near < b), *least) + slip[i]) * wide + slip[i]]
                gap = (x[near] - x[row]) ** 2
                exact = (gap * (w * w)).sum(axis=1)
                exact[near == row] = np.inf
                same = (near >= a) & (near < b)
                hit = np.lexsort((order[near], np.where(same, exact, np.inf)))[0]
                miss = np.lexsort((order[near], np.where(same, np.inf, exact)))[0]
                p, q = np.sqrt(max(exact[miss], 1e-12)), np.sqrt(max(exact[hit], 1e-12))
                w = w + 0.5 * (gap[miss] / p - gap[hit] / q) * w / max(np.abs(w).max(), 1e-12)
            at += turned
            size = 2 * size if turned == len(own) else max(8, turned)
    w = w * w
    return (w / max(w.max(), 1e-300)).tolist()


def margin_subset(df: DataFrame, case: str, features: str, label: str, rounds: int = 5) -> list[int]:
    """Greedy flips: features (from 1) whose membership raises the summed margin of the leave-one-out nearest rows.

    Rows x features numbers are sent to every task; each takes the distances of a share of the rows, a tile of TILE at once.
    Nearest rows are found by matrix products, and their distances are taken by differences.
    """
    x, _, first, end, _ = _by_class(*_matrix(df, case, features, label))
    spark, n = df.sparkSession, len(x)
    sent = spark.sparkContext.broadcast((x - x.mean(axis=0), first, end))
    starts = spark.range(0, n, TILE[0], max(1, min(-(-n // TILE[0]), spark.sparkContext.defaultParallelism)))

    def margins(trials: list[np.ndarray]) -> list[float]:
        def part_of(starts: np.ndarray, chosen: np.ndarray) -> list[float]:
            x, first, end = sent.value
            own = np.ascontiguousarray(x[:, chosen])
            wide = np.c_[own, (own * own).sum(axis=1)].T.copy()

            def least(at: np.ndarray, *spans: tuple[int, int]) -> np.ndarray:
                """Distances to the nearest rows of the spans."""
                q, rows = np.c_[-2 * own[at], np.ones(len(at))], np.arange(len(at))
                far, near = np.full(len(at), np.inf), np.full(len(at), -1)
                for lo, hi in spans:
                    for c in range(lo, hi, TILE[1]):
                        tile = q @ wide[:, c : min(c + TILE[1], hi)]
                        inside = (at >= c) & (at < c + tile.shape[1])
                        tile[rows[inside], at[inside] - c] = np.inf
                        j = tile.argmin(axis=1)
                        d = tile[rows, j]
                        near, far = np.where(d < far, c + j, near), np.minimum(far, d)
                return np.where(near < 0, np.inf, np.sqrt(((own[at] - own[near]) ** 2).sum(axis=1)))

            out = []
            for a in starts:
                at, total = np.arange(a, min(a + TILE[0], n)), 0.0
                for lo in np.unique(first[at]):
                    rows = at[first[at] == lo]
                    hi = end[rows[0]]
                    total += float((least(rows, (0, lo), (hi, n)) - least(rows, (lo, hi))).sum())
                out.append(total)
            return out

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                told = [part_of(pdf["id"].to_numpy(), chosen) for chosen in trials]
                yield pd.DataFrame({"id": pdf["id"], "m": list(zip(*told, strict=True))})

        parts = sorted(starts.mapInPandas(run, "id long, m array<double>").collect(), key=lambda r: r["id"])
        return [sum(r["m"][t] for r in parts) / 2 for t in range(len(trials))]

    inside, best, width = np.zeros(x.shape[1], dtype=bool), 0.0, 1
    for _ in range(rounds):
        flipped, order, at = False, np.random.default_rng(42).permutation(x.shape[1]), 0
        while at < len(order):  # flips up to the first that is kept start from the same subset, so some are tried at once
            flips = order[at : at + width]
            values = margins([inside ^ (np.arange(len(inside)) == j) for j in flips])
            kept = next((i for i, value in enumerate(values) if value > best + 1e-9), None)
            if kept is None:
                at, width = at + len(flips), min(2 * width, 16)
                continue
            inside[flips[kept]] ^= True
            best, flipped, at, width = values[kept], True, at + kept + 1, 1
        if not flipped:
            break
    return (np.flatnonzero(inside) + 1).tolist()


def increasing_sets(ranks: DataFrame, feat: str, weight: str, steps: list[int]) -> DataFrame:
    """(subset, feat): the top k features for each k of the steps."""
    placed = ranks.withColumn("_r", F.row_number().over(Window.orderBy(F.col(weight).desc(), feat)))  # a row a feature
    sizes = F.array(*[F.lit(k) for k in steps])
    return placed.select(feat, F.explode(F.filter(sizes, lambda k: k >= F.col("_r"))).alias("subset")).select("subset", feat)


def random_sets(features: DataFrame, feat: str, sets: int, size: int, seed: int = 42) -> DataFrame:
    """(subset, feat): `size` features in each of `sets` subsets, by hash order."""
    own = features.select(feat).withColumn("subset", F.explode(F.sequence(F.lit(1), F.lit(sets))))
    own = own.withColumn("_h", hashed(feat, F.concat_ws(":", F.lit(str(seed)), F.col("subset").cast("string"))))
    return own.withColumn("_r", F.row_number().over(Window.partitionBy("subset").orderBy("_h", feat))).filter(F.col("_r") <= size).select("subset", feat)


def chosen_sets(scores: DataFrame, subset: str, perf: str, strategy: str, amount: float = 0.0, weights: str = "equal") -> DataFrame:
    """Subsets that stay, with weights that add up to 1: the winner, those within a range of it, from a Hazen percentile on, or all.

    amount: the range in percent of the best score, or the percentile. weights: equal, linear in the
    score, or its logarithm. A table of one row a subset.
    """
    whole = Window.partitionBy(F.lit(1))
    best = F.max(perf).over(whole)
    own = scores
    if strategy == "winner":
        own = scores.withColumn("_r", F.row_number().over(whole.orderBy(F.col(perf).desc(), subset))).filter("_r = 1").drop("_r")
    elif strategy == "range":
        own = scores.withColumn("_b", best).filter(F.col(perf) >= F.col("_b") * (1 - amount / 100)).drop("_b")
    elif strategy == "percentile":
        from .tuning import percentile_nodes

        own = percentile_nodes(scores, perf, amount)
    elif strategy != "all":
        raise ValueError(f"no strategy {strategy}")
    raw: Column = {"equal": F.lit(1.0), "linear": F.col(perf).cast("double"), "log": F.log(F.col(perf).cast("double") + 1)}[weights]
    return own.withColumn("_w", raw).withColumn("weight", F.col("_w") / F.sum("_w").over(whole)).drop("_w")


def weighted(ranks: DataFrame, weights: DataFrame, feat: str) -> DataFrame:
    """An external weight map over the features: its weight where it has one, else 0."""
    return ranks.select(feat).join(weights.select(F.col(feat).alias("_f"), "weight"), F.col(feat) == F.col("_f"), "left").select(feat, F.coalesce("weight", F.lit(0.0)).alias("weight"))


def oversampled(df: DataFrame, case: str, features: str, label: str, k: int, share: float = 1.0) -> DataFrame:
    """Synthetic minority rows (query, copy, features): more for cases with more majority rows among their k nearest.

    Each case makes round(its difficulty's share x gap between the classes x share) rows, each between the
    case and one of its nearest minority rows, at a place given by a hash.
    """
    sizes = {r[0]: r[1] for r in df.groupBy(F.col(label) > 0).count().collect()}
    minority = sizes.get(True, 0) <= sizes.get(False, 0)
    few = df.filter((F.col(label) > 0) == F.lit(minority)).select(case, features, label)
    gap = abs(sizes.get(True, 0) - sizes.get(False, 0)) * share
    hard = nearest(df.select(case, features), few, case, features, k).join(df.select(case, F.col(label).alias("_l")), case)
    hard = hard.groupBy("query").agg(F.avg(((F.col("_l") > 0) != F.lit(minority)).cast("double")).alias("r"))
    total = hard.agg(F.sum("r").alias("t")).first()["t"] or 0.0
    wanted = hard.withColumn("n", F.round(F.col("r") / F.lit(total or 1.0) * gap).cast("int")).filter("n > 0").select("query", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("copy"))
    mates = nearest(few.select(case, features), few, case, features, k).select("query", F.col(case).alias("_mate"), "place")
    pick = F.pmod(F.xxhash64("query", "copy"), F.lit(k)) + 1
    pairs = wanted.withColumn("_p", pick).join(mates.withColumnRenamed("query", "_q"), (F.col("query") == F.col("_q")) & (F.col("_p") == F.col("place")))
    a = few.select(F.col(case).alias("_c1"), F.col(features).alias("_a"))
    b = few.select(F.col(case).alias("_c2"), F.col(features).alias("_b"))
    t = F.pmod(F.xxhash64("copy", "query"), F.lit(1000)) / 1000
    made = pairs.join(a, F.col("query") == F.col("_c1")).join(b, F.col("_mate") == F.col("_c2")).withColumn("_t", t)
    return made.select("query", "copy", F.zip_with("_a", "_b", lambda x, y: x + (y - x) * F.col("_t")).alias(features))


def unique_permutations(df: DataFrame, case: str, strata: list[str], wanted: int, tries: int = 500) -> DataFrame:
    """(perm, case, place): `wanted` different orders inside the strata; orders that repeat an earlier one are passed over."""
    own = df.select(case, *strata).withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(min(tries, 4 * wanted)))))
    own = own.withColumn("place", F.row_number().over(Window.partitionBy("draw", *strata).orderBy(hashed(case, F.col("draw")), case)))
    same = own.groupBy("draw").agg(F.sum(F.xxhash64(case, "place").cast("decimal(20,0)")).alias("_d"))
    first = same.groupBy("_d").agg(F.min("draw").alias("draw"))  # a row a draw
    kept = first.withColumn("perm", F.row_number().over(Window.orderBy("draw"))).filter(F.col("perm") <= wanted).select(F.col("draw").alias("_w"), "perm")
    return own.join(F.broadcast(kept), F.col("draw") == F.col("_w")).select("perm", case, *strata, "place")


def to_frame(df: DataFrame, ranks: list[float]) -> DataFrame:
    return df.sparkSession.createDataFrame(pd.DataFrame({"feat": range(1, len(ranks) + 1), "weight": ranks}), "feat int, weight double")
