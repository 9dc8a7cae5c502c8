"""Language identification as inference of a mixture.

Each language has a character trigram model; it gives every word a log-likelihood. A document is
a mixture of languages: expectation-maximisation estimates the proportions under which its words
are likeliest. Languages are added in the order of their proportions as long as the likelihood,
less a penalty of half a logarithm of the word count for each further one, grows (nested sets,
each with proportions of its own); the largest proportion of the chosen set is the prediction.

Words are scored once for each store of words; expectation-maximisation runs over all documents
of a batch at once, as segmented sums over flat arrays, taken in pieces of bounded size; documents
whose proportions have settled leave the rounds.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, portions, text_or_empty

#: Bound of the training sample: about so many documents of each language.
SAMPLE = 1500
#: Languages that a model may have; more fail rather than drop any.
LANGUAGES = 400
SMOOTH = 0.05
#: Rounds at most, and the change of a proportion under which a document has settled.
ROUNDS, SETTLED = 30, 1e-4
FOLDS, HELD_OUT = 4, 2
UNDETERMINED = "und"
_WORDS = re.compile(r"[^\W\d_]+")
#: Word scores (words x languages) that a store keeps, and that are taken at once.
SCORES_KEPT, PIECE = 4_000_000, 1_000_000


def _grams(word: str) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + 3] for i in range(len(w) - 2)]


def words_of(text: str) -> Counter[str]:
    """Runs of letters, in lower case, with their counts. Other word characters (fractions, circled digits) end a word."""
    found = Counter(_WORDS.findall(text.lower()))
    for w in [w for w in found if not w.isalpha()]:
        n = found.pop(w)
        for part in "".join(c if c.isalpha() else " " for c in w).split():
            found[part] += n
    return found


@dataclass
class Model:
    names: list[str]
    of_gram: dict[str, np.ndarray]  # log-probability of a trigram's last character after the first two
    of_pair: dict[str, np.ndarray]  # the same for a trigram that has not been seen after a pair that has
    unseen: np.ndarray

    def word(self, word: str) -> np.ndarray:
        out = np.zeros(len(self.names))
        for g in _grams(word):
            p = self.of_gram.get(g)
            if p is None:
                p = self.of_pair.get(g[:2])
            out += self.unseen if p is None else p
        return out


def build(counts: dict[str, Counter[str]]) -> Model:
    """The model of trigram counts by language."""
    names = sorted(counts)
    letters = len({g[2] for c in counts.values() for g in c}) + 1
    index = {g: np.zeros(len(names)) for c in counts.values() for g in c}
    for k, name in enumerate(names):
        for g, n in counts[name].items():
            index[g][k] = n
    pairs: dict[str, np.ndarray] = {}
    for g, n in index.items():
        pairs[g[:2]] = pairs.get(g[:2], 0) + n
    below = {p: np.log(n + SMOOTH * letters) for p, n in pairs.items()}
    of_gram = {g: np.log(n + SMOOTH) - below[g[:2]] for g, n in index.items()}
    of_pair = {p: np.log(SMOOTH) - b for p, b in below.items()}
    return Model(names, of_gram, of_pair, np.full(len(names), -np.log(letters)))


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from documents with a language outside the held-out fold; about `sample` of each language, by hash."""
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"), text_or_empty().alias("text"))
    own = own.filter(F.col("lang").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT))
    sizes = own.groupBy("lang").count().limit(LANGUAGES + 1).collect()
    if len(sizes) > LANGUAGES:
        raise ValueError(f"over {LANGUAGES} languages")
    if not sizes:
        return build({})
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(min(1.0, sample / r["count"])))])
    place = F.pmod(F.xxhash64("doc_id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = own.filter(place < F.element_at(share, F.col("lang"))).select("lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found: dict[str, Counter[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                own = found.setdefault(lang, Counter())
                for w, n in words_of(text).items():
                    for g in _grams(w):
                        own[g] += n
            rows = [(lang, g, n) for lang, c in found.items() for g, n in c.items()]
            if rows:
                a, b, c = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(b, pa.string()), pa.array(c, pa.int64())], names=["lang", "gram", "n"])

    table = chosen.mapInArrow(run, "lang string, gram string, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    counts: dict[str, Counter[str]] = {}
    for r in table.collect():  # trigrams of the bounded sample
        counts.setdefault(r["lang"], Counter())[r["gram"]] = r["n"]
    return build(counts)


def _mixture(like: np.ndarray, top: np.ndarray, which: np.ndarray, n: np.ndarray, at: np.ndarray, allowed: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Proportions (documents x languages) under which the words are likeliest, and the log-likelihood.

    like, top: of the stored words, likelihoods by language over their greatest, and its logarithm;
    which, n: the documents' words and their counts; at: where each document's words begin, and the
    end; allowed: documents x languages.
    """
    docs, k = allowed.shape
    total = np.add.reduceat(n, at[:-1])
    share = allowed / allowed.sum(axis=1, keepdims=True)
    step = max(1, PIECE // k)

    def pieces(own: np.ndarray, used: np.ndarray, bounds: np.ndarray, what) -> np.ndarray:
        """Sums over the words of each document of what(likelihoods, proportions of the words' documents, counts, word numbers)."""
        out = np.zeros((len(own), k)) if what is _joint else np.zeros(len(own))
        doc = np.repeat(np.arange(len(own)), np.diff(bounds))
        for a in range(0, len(used), step):
            b = min(len(used), a + step)
            rows = which[used[a:b]]
            first, last = doc[a], doc[b - 1]
            starts = np.maximum(bounds[first : last + 1], a) - a
            out[first : last + 1] += np.add.reduceat(what(like[rows], share[own][doc[a:b]], n[used[a:b]], top[rows]), starts, axis=0)
        return out

    live, used, bounds = np.arange(docs), np.arange(len(n)), at
    for _ in range(ROUNDS):
        new = np.where(allowed[live], pieces(live, used, bounds, _joint) / total[live, None], 0)
        new /= np.maximum(new.sum(axis=1, keepdims=True), 1e-300)
        moving = np.abs(new - share[live]).max(axis=1) > SETTLED
        share[live] = new
        if not moving.any():
            break
        if not moving.all():
            spans = np.diff(bounds)
            used, live = used[np.repeat(moving, spans)], live[moving]
            bounds = np.concatenate([[0], np.cumsum(spans[moving])])
    return share, pieces(np.arange(docs), np.arange(len(n)), at, _fit)


def _joint(like: np.ndarray, share: np.ndarray, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    both = like * share
    return both * (n / np.maximum(both.sum(axis=1), 1e-300))[:, None]


def _fit(like: np.ndarray, share: np.ndarray, n: np.ndarray, top: np.ndarray) -> np.ndarray:
    return n * (np.log(np.maximum((like * share).sum(axis=1), 1e-300)) + top)


class Identifier:
    def __init__(self, model: Model):
        self.model = model
        self.empty()

    def empty(self) -> None:
        k = len(self.model.names)
        self.number: dict[str, int] = {}
        self.logs, self.like, self.top = np.zeros((0, k)), np.zeros((0, k)), np.zeros(0)

    def _store(self, fresh: list[str]) -> None:
        self.number.update(zip(fresh, range(len(self.number), len(self.number) + len(fresh)), strict=True))
        logs = np.array([self.model.word(w) for w in fresh]).reshape(len(fresh), len(self.model.names))
        top = logs.max(axis=1)
        self.logs, self.top = np.concatenate([self.logs, logs]), np.concatenate([self.top, top])
        self.like = np.concatenate([self.like, np.exp(logs - top[:, None])])

    def __call__(self, texts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Predicted languages, their proportions, and the number of languages chosen."""
        k = len(self.model.names)
        found = [words_of(t) for t in texts]
        names, score, chosen = [UNDETERMINED] * len(texts), np.zeros(len(texts)), np.zeros(len(texts), dtype=np.int64)
        rows = [i for i, c in enumerate(found) if c]
        if not rows or not k:
            return names, score, chosen
        if len(self.number) * k > SCORES_KEPT:
            self.empty()
        fresh = list(set().union(*found).difference(self.number))
        if fresh:
            self._store(fresh)
        number = self.number
        which = np.array([number[w] for i in rows for w in found[i]], dtype=np.int64)
        n = np.array([x for i in rows for x in found[i].values()], dtype=np.float64)
        at = np.concatenate([[0], np.cumsum([len(found[i]) for i in rows])])
        docs = len(rows)
        words = np.add.reduceat(n, at[:-1])
        full, _ = _mixture(self.like, self.top, which, n, at, np.ones((docs, k), dtype=bool))
        order = np.argsort(-full, axis=1, kind="stable")
        rank = np.argsort(order, axis=1, kind="stable")
        alone = np.stack([np.add.reduceat(self.logs[which, j] * n, at[:-1]) for j in range(k)], axis=1)
        best = alone.max(axis=1)
        share = (np.arange(k) == alone.argmax(axis=1)[:, None]).astype(float)
        size = np.ones(docs, dtype=np.int64)
        spans = np.diff(at)
        open_ = full[np.arange(docs), order[:, 1]] > 1e-6 if k > 1 else np.zeros(docs, dtype=bool)
        for m in range(2, k + 1):
            own = np.flatnonzero(open_)
            if not len(own):
                break
            pick = np.repeat(open_, spans)
            sub_at = np.concatenate([[0], np.cumsum(spans[own])])
            got, fit = _mixture(self.like, self.top, which[pick], n[pick], sub_at, rank[own] < m)
            value = fit - 0.5 * (m - 1) * np.log(words[own])
            better = value > best[own]
            share[own[better]], best[own[better]], size[own[better]] = got[better], value[better], m
            if m < k:
                open_[own] = full[own, order[own, m]] > 1e-6
        lead = share.argmax(axis=1)
        for j, i in enumerate(rows):
            names[i], score[i], chosen[i] = self.model.names[lead[j]], min(1.0, share[j, lead[j]]), size[j]
        return names, score, chosen


def identified(df: DataFrame, model: Model, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score, n_langs for each row, repeated ones included.

    Null texts and texts without a letter are `und` with score 0, as is everything under a model
    without languages; ties go to the language that comes first by name; very long texts are taken
    whole, by pieces; other columns are left aside; an empty table gives an empty result.
    """
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (fold_of(doc_id, FOLDS) == HELD_OUT).alias("held_out"), text_or_empty(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identify = Identifier(model)
        for batch in batches:
            for a, texts in portions(batch.column(2), 1_000_000):
                names, score, size = identify(texts)
                part = batch.slice(a, len(texts))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(names, pa.string()), pa.array(score), pa.array(size)], names=["doc_id", "held_out", "lang_pred", "score", "n_langs"])

    return own.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double, n_langs long")
