"""Toxicity by non-negative positive-unlabelled learning.

Confirmed toxic texts are the positives. The unlabelled texts are a hash sample of all labelled
rows of the learning folds with their labels set aside, so the toxic share of the labels is
the class prior among them. With the prior p, the risk

    p E_pos[l(+)] + max(0, E_unl[l(-)] - p E_pos[l(-)])

estimates that of a fully labelled sample; the clamp keeps the part of the negatives from
falling below zero, where the classifier would fit noise. A logistic classifier over words and
word openings is trained on it in numpy on the driver.

The sample is bounded by POSITIVES and UNLABELLED. Its features are counted by Spark; those that
tell positives from unlabelled texts, for or against, are kept, and only they reach the driver.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, free_name, portions, removed, text_or_empty, trimmed, written

#: Bounds of the training sample: confirmed toxic ids, and labelled ids that stand for unlabelled ones.
POSITIVES = 2500
UNLABELLED = 6000
#: Features count from this log-likelihood ratio (G) on, for or against; the strongest ones up to a bound.
EVIDENCE = 12.0
FEATURES = 20_000
#: So many characters of a word's opening are a feature of their own.
OPENINGS = (4, 5, 6)
THRESHOLD = 0.7
FOLDS, HELD_OUT = 3, 1
STEPS, RATE, DECAY = 1500, 0.08, 1e-5

_WORDS = re.compile(r"\w+")


def _features(word: str) -> list[int]:
    """Numbers of a word's features: itself and its openings."""
    return [zlib.crc32(word.encode("utf-8", "replace")), *(zlib.crc32(f"{word[:n]}*{n}".encode("utf-8", "replace")) for n in OPENINGS if len(word) > n)]


def features_of(text: str) -> set[int]:
    return {f for w in set(_WORDS.findall(text.lower())) for f in _features(w)}


@dataclass
class Model:
    weights: dict[int, float]
    bias: float

    def scorer(self) -> _Scorer:
        return _Scorer(self)


class _Scorer:
    """Scores texts; remembers which words have no weighted feature."""

    def __init__(self, model: Model):
        self.model = model
        self.known: dict[str, tuple[int, ...]] = {}

    def __call__(self, text: str) -> float:
        if len(self.known) > 200_000:
            self.known.clear()
        known, weights = self.known, self.model.weights
        hit: set[int] = set()
        for w in set(_WORDS.findall(text.lower())):
            own = known.get(w)
            if own is None:
                own = known[w] = tuple(f for f in _features(w) if f in weights)
            if own:
                hit.update(own)
        z = self.model.bias + sum(weights[f] for f in sorted(hit))
        return float(1.0 / (1.0 + np.exp(-np.clip(z, -40, 40))))


def evidence(positive: np.ndarray, unlabelled: np.ndarray, n_positive: int, n_unlabelled: int) -> np.ndarray:
    """Log-likelihood ratio (G) of a feature's presence against the side, from the numbers of texts that have it."""
    n = n_positive + n_unlabelled
    both = positive + unlabelled
    cells = ((positive, both * n_positive), (unlabelled, both * n_unlabelled), (n_positive - positive, (n - both) * n_positive), (n_unlabelled - unlabelled, (n - both) * n_unlabelled))
    return 2 * sum(np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-9) * n / np.maximum(meant, 1e-9)), 0.0) for seen, meant in cells)


def train(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float) -> Model:
    """Fits the classifier; each text is the array of its feature numbers."""
    if not positive or not unlabelled:
        return Model({}, float(np.log(max(prior, 1e-6) / (1 - min(prior, 1 - 1e-6)))))
    names, which = np.unique(np.concatenate(positive + unlabelled), return_inverse=True)
    first = sum(len(t) for t in positive)
    counts, base = (np.bincount(x, minlength=len(names)) for x in (which[:first], which[first:]))
    gain = evidence(counts, base, len(positive), len(unlabelled))
    chosen = np.flatnonzero(gain >= EVIDENCE)
    names = names[np.sort(chosen[np.argsort(-gain[chosen], kind="stable")[:FEATURES]])]

    def rows(texts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        which = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        flat = np.concatenate(texts)
        at = np.searchsorted(names, flat)
        at[at == len(names)] = 0
        ok = names[at] == flat if len(names) else np.zeros(len(flat), dtype=bool)
        return which[ok], at[ok]

    (pr, pc), (ur, uc) = rows(positive), rows(unlabelled)
    w, b = np.zeros(len(names)), float(np.log(prior / (1 - prior)))
    m, v, mb, vb = np.zeros(len(names)), np.zeros(len(names)), 0.0, 0.0
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    softplus = lambda z: np.logaddexp(0, z)
    for step in range(1, STEPS + 1):
        zp = b + np.bincount(pr, w[pc], len(positive))
        zu = b + np.bincount(ur, w[uc], len(unlabelled))
        negative = softplus(zu).mean() - prior * softplus(zp).mean()
        gp_plus = -prior * sigmoid(-zp) / len(positive)
        gp_minus, gu_minus = -prior * sigmoid(zp) / len(positive), sigmoid(zu) / len(unlabelled)
        if negative >= 0:
            gp, gu = gp_plus + gp_minus, gu_minus
        else:  # the estimate of the negatives' risk has gone below zero: step back from it
            gp, gu = -gp_minus, -gu_minus
        g = np.bincount(pc, gp[pr], len(names)) + np.bincount(uc, gu[ur], len(names)) + DECAY * w
        gb = gp.sum() + gu.sum()
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        fix1, fix2 = 1 - 0.9**step, 1 - 0.999**step
        w = w - RATE * (m / fix1) / (np.sqrt(v / fix2) + 1e-8)
        b = b - RATE * (mb / fix1) / (np.sqrt(vb / fix2) + 1e-8)
    return Model({int(k): float(x) for k, x in zip(names.tolist(), w.tolist(), strict=True) if abs(x) > 1e-6}, float(b))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> Model:
    """Learns from the folds other than the held-out one.

    labels: doc_id and toxic (0, 1 or null); an id labelled twice is toxic if any label says so.
    The prior is the toxic share of all labelled ids of the learning folds.
    """
    learn = fold_of("doc_id", FOLDS) != HELD_OUT
    own = labels.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & learn)
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    share = own.agg(F.avg("toxic").alias("p"), F.count(F.lit(1)).alias("n")).first()
    if not share["n"]:
        return train([], [], 0.5)
    prior = min(max(share["p"], 1e-3), 0.999)
    order = F.xxhash64(F.col("doc_id"), F.lit("toxicity"))
    toxic = own.filter("toxic = 1").select("doc_id").orderBy(order, "doc_id").limit(positives)
    rest = own.select("doc_id").orderBy(order, "doc_id").limit(unlabelled)  # whatever their labels, so that the prior holds among them
    # at most positives + unlabelled ids: a bounded side
    chosen = toxic.withColumn("y", F.lit(1)).unionByName(rest.withColumn("y", F.lit(0)))
    texts = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))
    # one text an id, however many rows share it
    sampled = texts.join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, own in portions(batch.column(2), 1_000_000):
                found = [np.array(sorted(features_of(t)), dtype=np.int64) for t in own]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, len(own)), batch.column(1).slice(a, len(own)), pa.array(found, pa.list_(pa.int64()))], names=["doc_id", "y", "f"])

    rows, path = written(sampled.select("doc_id", "y", "text").mapInArrow(trimmed(run), "doc_id long, y int, f array<long>"), "toxic-sample")
    sides = {r["y"]: r["n"] for r in rows.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    if len(sides) < 2:
        return train([], [], prior)
    counts = rows.select("y", F.explode("f").alias("f")).groupBy("f").agg(F.sum("y").cast("double").alias("a"), F.sum(1 - F.col("y")).cast("double").alias("b"))

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            gain = evidence(batch.column(1).to_numpy(), batch.column(2).to_numpy(), sides[1], sides[0])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(gain)], names=["f", "gain"])

    told = counts.mapInArrow(trimmed(weigh), "f long, gain double").filter(F.col("gain") >= EVIDENCE)
    kept = told.orderBy(F.desc("gain"), "f").limit(FEATURES)  # a bounded side
    lists = rows.join(F.broadcast(kept.agg(F.collect_list("f").alias("kept")))).select("doc_id", "y", F.array_intersect("f", "kept").alias("f"))  # one row
    got = lists.toArrow().sort_by([("doc_id", "ascending"), ("y", "ascending")])
    removed(docs.sparkSession, path)
    y = got.column("y").to_numpy()
    found = got.column("f").combine_chunks()
    flat, at = found.values.to_numpy(), found.offsets.to_numpy()
    own = [np.sort(flat[at[k] : at[k + 1]]) for k in range(len(y))]
    return train([r for r, t in zip(own, y, strict=True) if t == 1], [r for r, t in zip(own, y, strict=True) if t == 0], prior)


def scored(df: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """Adds a score from 0 to 1 (higher: likelier toxic); null and empty texts get the score without any word.

    Rows and other columns stay as they are; a column named as `score` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != score.lower()]
    hidden = free_name(df, "_text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(hidden))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rate = model.scorer()
        for batch in batches:
            for a, texts in portions(batch.column(len(kept)), 1_000_000):
                scores = pa.array([rate(t) for t in texts], pa.float64())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, len(texts)) for k in range(len(kept))), scores], names=[*kept, score])

    return source.mapInArrow(trimmed(run), f"{schema}, `{score}` double")


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted for every document, repeated rows included.

    Null and empty texts score as texts without any word; very long texts are read whole; a null
    doc_id is not held out and never learnt from; of rows that share a labelled id one text is
    learnt from, all are scored; without labels every score is 0.5; other columns are left aside.
    """
    model = fit(docs, labels)
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "text")
    return scored(own, model).select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def clean(df: DataFrame, model: Model, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows whose score is below the threshold, with their columns. Nulls, empty and repeated rows: as in `scored`."""
    name = free_name(df, "_toxicity")
    return scored(df, model, text, name).filter(F.col(name) < threshold).drop(name)
