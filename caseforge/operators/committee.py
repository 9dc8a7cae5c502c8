"""Choosing and weighting learners: votes are first grouped into patterns, which are few however many cases there are."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Patterns of votes that reach the driver; more fail.
PATTERNS = 200_000


def vote_patterns(df: DataFrame, case: str, learner: str, score: str, y: str) -> tuple[list, np.ndarray, np.ndarray, np.ndarray]:
    """Learners, votes (patterns x learners, +1 or -1), labels and numbers of cases of each pattern. A missing or zero vote is -1."""
    learners = sorted(r[0] for r in df.select(learner).distinct().limit(1001).collect())
    if len(learners) > 1000:
        raise ValueError("over 1000 learners")
    vote = F.when(F.col(score) > 0, 1).otherwise(-1)
    wide = df.groupBy(case, y).agg(F.map_from_entries(F.collect_list(F.struct(F.col(learner), vote))).alias("m"))  # a vote a learner
    row = F.array(*[F.coalesce(F.element_at("m", F.lit(k)), F.lit(-1)) for k in learners])
    rows = wide.select(row.alias("v"), y).groupBy("v", y).agg(F.count(F.lit(1)).alias("n")).limit(PATTERNS + 1).collect()
    if len(rows) > PATTERNS:
        raise ValueError(f"over {PATTERNS} patterns of votes")
    rows.sort(key=lambda r: (list(r["v"]), r[y]))
    return learners, np.array([r["v"] for r in rows], dtype=float).reshape(len(rows), len(learners)), np.array([r[y] for r in rows], dtype=float), np.array([r["n"] for r in rows], dtype=float)


def balanced(votes: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Balanced accuracy of the majority (even votes count as positive)."""
    said = np.where(votes.mean(axis=1) >= 0, 1, -1)
    rate = lambda s: (n * (said == s) * (y == s)).sum() / max((n * (y == s)).sum(), 1)
    return float((rate(1) + rate(-1)) / 2)


def vote_entropy(votes: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Mean entropy of the votes on a case, in bits."""
    p = (votes > 0).mean(axis=1)
    h = -sum(np.where(q > 0, q * np.log2(np.maximum(q, 1e-300)), 0) for q in (p, 1 - p))
    return float((n * h).sum() / n.sum())


def kappa_diversity(votes: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """1 - kappa of agreement in being right, over all pairs of learners."""
    k = votes.shape[1]
    if k < 2:
        return 0.0
    right = (votes == y[:, None]).sum(axis=1)
    total = n.sum()
    p = (n * right).sum() / (total * k)
    apart = (n * right * (k - right)).sum() / k
    return float(apart / max(total * (k - 1) * p * (1 - p), 1e-12))


def bias_variance(votes: np.ndarray, y: np.ndarray, n: np.ndarray) -> float:
    """Negative of bias + variance on right cases - variance on wrong ones (0-1 loss of the majority)."""
    main = np.where(votes.mean(axis=1) >= 0, 1, -1)
    off = (votes != main[:, None]).mean(axis=1)
    wrong = main != y
    return -float((n * (wrong + np.where(wrong, -off, off))).sum() / n.sum())


CRITERIA: dict[str, Callable] = {"performance": balanced, "entropy": vote_entropy, "diversity": kappa_diversity, "bias_variance": bias_variance}


def selected(patterns: tuple, criterion: str, forward: bool = False, keep_performance: bool = True) -> list:
    """Learners left by dropping (or adding) one at a time while the criterion grows; others than performance may not lower it."""
    learners, votes, y, n = patterns
    measure = CRITERIA[criterion]
    inside = [] if forward else list(range(len(learners)))
    best = measure(votes[:, inside], y, n) if inside else -math.inf
    floor = balanced(votes[:, inside], y, n) if inside else -math.inf
    while True:
        trials = [inside + [k] for k in range(len(learners)) if k not in inside] if forward else [[j for j in inside if j != k] for k in inside if len(inside) > 1]
        rated = [(measure(votes[:, t], y, n), t) for t in trials if criterion == "performance" or not keep_performance or balanced(votes[:, t], y, n) >= floor - 1e-12]
        if not rated:
            break
        value, trial = max(rated, key=lambda x: (round(x[0], 12), [-i for i in x[1]]))
        if value <= best + 1e-12:
            break
        best, inside = value, trial
        floor = max(floor, balanced(votes[:, inside], y, n))
    return [learners[k] for k in sorted(inside)]


def boosted(patterns: tuple, rounds: int = 10) -> dict:
    """Weights of learners by boosting: each round takes the learner of least weighted error and raises the cases it misses."""
    learners, votes, y, n = patterns
    w = n / n.sum()
    out = {k: 0.0 for k in learners}
    for _ in range(rounds):
        errors = [(float((w * (votes[:, k] != y)).sum()), k) for k in range(len(learners))]
        error, k = min(errors)
        if error >= 0.5 - 1e-12:
            break
        a = 0.5 * math.log((1 - error) / max(error, 1e-12))
        out[learners[k]] += a
        w = w * np.exp(-a * y * votes[:, k])
        w = w / w.sum()
        if error < 1e-12:
            break
    total = sum(out.values())
    return {k: v / total if total else 0.0 for k, v in out.items()}


def eliminated(scores: dict[tuple[str, str], Column], classes: list[str]) -> Column:
    """Hierarchical one-vs-one: classes meet in turn, and the loser of each meeting leaves; the last one is the decision."""
    winner = F.lit(classes[0])
    for c in classes[1:]:
        beats = F.lit(False)
        for a in classes[: classes.index(c)]:
            s = scores[(a, c)]
            beats = F.when(winner == a, s <= 0).otherwise(beats)
        winner = F.when(beats, F.lit(c)).otherwise(winner)
    return winner


# ---- annealing over a parameter grid
def accepts(current: float, neighbour: float, temperature: float, draw: float) -> bool:
    """Boltzmann's rule: a better score always, a worse one with chance exp(difference / temperature)."""
    return neighbour >= current or draw < math.exp((neighbour - current) / max(temperature, 1e-12))


def annealed(nodes: list[tuple], score: Callable[[tuple], float], start: float = 1.0, cooling: float = 0.9, rounds: int = 100, seed: int = 42) -> tuple[tuple, float]:
    """Walks a grid of parameter nodes (tuples of indices; neighbours differ by one step in one place) and returns the best node met."""
    rng = np.random.default_rng(seed)
    known: dict[tuple, float] = {}
    at = nodes[int(rng.integers(len(nodes)))]
    there = set(nodes)

    def rate(node: tuple) -> float:
        if node not in known:
            known[node] = score(node)
        return known[node]

    temperature = start
    for _ in range(rounds):
        near = [t for i in range(len(at)) for s in (-1, 1) if (t := (*at[:i], at[i] + s, *at[i + 1 :])) in there]
        if not near:
            break
        trial = near[int(rng.integers(len(near)))]
        if accepts(rate(at), rate(trial), temperature, float(rng.random())):
            at = trial
        temperature *= cooling
    rate(at)
    best = max(known, key=lambda k: (known[k], k))
    return best, known[best]


def regularisation(c: Column, kind: str, inverted: bool = False) -> Column:
    """Shapes of a complexity penalty over c in 0 to 1, scaled to 0-100: none, cos, cos2, sin, sin2."""
    x = c.cast("double")
    shape = {"none": x, "cos": 1 - F.cos(x * math.pi / 2), "cos2": (1 - F.cos(x * math.pi)) / 2, "sin": F.sin(x * math.pi / 2), "sin2": F.pow(F.sin(x * math.pi / 2), F.lit(2.0))}[kind]
    return (1 - shape if inverted else shape) * 100
