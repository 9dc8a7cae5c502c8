"""SentencePiece BPE as numpy merge rounds, with the inverse.

A model's pieces never hold a space mark after another character, so a text falls into
words (space marks, then other characters) that merge independently. Each distinct word is
merged once: all words lie in one flat symbol array; a round looks up every adjacent pair,
takes the minimum rank of each word (a segmented minimum), merges its leftmost occurrences
in all words at once, and compacts the array; a word without a pair leaves it. Some pairs, once
merged, make a pair that comes before their own kind; of those a word merges one occurrence a
round, for all at once would give other pieces than the library. A word that has had SINGLE_ROUNDS
such rounds (long runs of one character) is finished by a heap, with the same result.
"""

from __future__ import annotations

import hashlib
import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, portions, text_or_empty, trimmed

MARK = "▁"
_BIG = 1 << 22  # over any symbol number, so that a pair is one integer
_NONE = np.int64(1) << 40  # rank of a pair that makes no piece
#: Words kept between batches; the store is emptied beyond it, which changes no result.
WORDS_KEPT = 200_000
#: Characters handled at once.
CHUNK = 2_000_000
#: Rounds in which a word may merge one pair only, before the heap takes over.
SINGLE_ROUNDS = 64


class PieceModel:
    """Vocabulary of a SentencePiece BPE model file with byte fallback, as arrays."""

    def __init__(self, path: str):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        names = [sp.id_to_piece(i) for i in range(n)]
        self.size = n
        self.unknown = sp.unk_id()
        self.byte_ids = np.full(256, self.unknown, dtype=np.int64)
        plain: dict[str, int] = {}
        rendered: list[bytes] = []
        self.is_byte = np.zeros(n, dtype=bool)
        self.is_control = np.zeros(n, dtype=bool)
        for i, name in enumerate(names):
            if sp.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.is_byte[i] = True
                rendered.append(bytes([value]))
            elif sp.is_control(i):
                self.is_control[i] = True
                rendered.append(b"")
            elif sp.is_unknown(i):
                rendered.append(" ⁇ ".encode())
            else:
                plain[name] = i
                rendered.append(name.replace(MARK, " ").encode())
        self.rendered = rendered
        self.lengths = np.array([len(b) for b in rendered], dtype=np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.lengths)[:-1]])
        self.table = np.frombuffer(b"".join(rendered), dtype=np.uint8)
        self.opens_with_mark = np.array([name.startswith(MARK) for name in names])
        # Symbols: pieces keep their ids; any other code point c is the symbol n + c, which can still be
        # part of a piece although it is none itself.
        self.of_code = np.arange(0x110000, dtype=np.int64) + n
        for name, i in plain.items():
            if len(name) == 1:
                self.of_code[ord(name)] = i
        scores = {name: sp.get_score(i) for name, i in plain.items()}
        order = {s: r for r, s in enumerate(sorted(set(scores.values()), reverse=True))}

        def symbol(part: str) -> int | None:
            return int(self.of_code[ord(part)]) if len(part) == 1 else plain.get(part)

        keys, merged, ranks, safe = [], [], [], np.ones(n, dtype=bool)
        for name, i in plain.items():
            for k in range(1, len(name)):
                a, b = symbol(name[:k]), symbol(name[k:])
                if a is not None and b is not None:
                    keys.append(a * _BIG + b)
                    merged.append(i)
                    ranks.append(order[scores[name]])
                    for part, s in ((name[:k], a), (name[k:], b)):
                        if len(part) > 1 and scores[part] <= scores[name]:
                            safe[s] = False  # after it is made, a pair with it may come before its own kind
        by = np.argsort(np.array(keys, dtype=np.int64))
        self.pair_keys = np.array(keys, dtype=np.int64)[by]
        self.pair_merged = np.array(merged, dtype=np.int64)[by]
        self.pair_ranks = np.array(ranks, dtype=np.int64)[by]
        self.safe = safe
        self._slots()
        letters = "".join(plain)
        if any(re.search(f"[^{MARK}]{MARK}", name) for name in plain):
            raise ValueError("a piece of this model goes over the start of a word; words would not merge independently")
        alone = "" if "\n" in letters else "\n"
        self.words = re.compile(f"{MARK}+[^{MARK}{alone}]*|[^{MARK}{alone}]+" + (f"|{alone}" if alone else ""))

    def split(self, text: str) -> list[str]:
        """Words of a text: an opening mark is added, spaces become marks; the words' text joins to the whole."""
        return self.words.findall(MARK + text.replace(" ", MARK)) if text else []

    def _slots(self) -> None:
        """Pair table by open addressing: a pair lies at most `probes` slots after its own."""
        size = 1 << max(10, int(len(self.pair_keys) * 6).bit_length())
        self._mask = size - 1
        self._slot = np.full(size + 64, -1, dtype=np.int64)
        self.probes, rest = 0, np.arange(len(self.pair_keys))
        at = self._home(self.pair_keys)
        while len(rest):
            free = rest[self._slot[at[rest] + self.probes] < 0]
            self._slot[at[free] + self.probes] = free  # of several, the last one stays
            rest = rest[self._slot[at[rest] + self.probes] != rest]
            self.probes += 1
        self._slot_key = np.where(self._slot >= 0, self.pair_keys[self._slot], -1)

    def _home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & self._mask

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and piece of each pair of symbols."""
        keys = left * _BIG + right
        home = self._home(keys)
        found = np.full(len(keys), -1, dtype=np.int64)
        rest = np.arange(len(keys))
        for k in range(self.probes):
            there = self._slot_key[home[rest] + k]
            hit = there == keys[rest]
            found[rest[hit]] = self._slot[home[rest[hit]] + k]
            rest = rest[~hit & (there >= 0)]
            if not len(rest):
                break
        return np.where(found >= 0, self.pair_ranks[found], _NONE), self.pair_merged[found]

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat piece ids of the words, and the offsets of each word in them."""
        sizes = np.array([len(w) for w in words], dtype=np.int64)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        symbols, word = self.of_code[codes].copy(), np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_words = [], []
        singles = np.zeros(len(words), dtype=np.int32)
        rank = np.full(len(symbols), _NONE)
        made = np.zeros(len(symbols), dtype=np.int64)
        fresh = np.arange(len(symbols))  # where a pair begins that hasn't been looked up
        while len(symbols):
            fresh = fresh[fresh < len(symbols) - 1]
            inside = word[fresh] == word[fresh + 1]
            rank[fresh[~inside]] = _NONE
            fresh = fresh[inside]
            rank[fresh], made[fresh] = self._pairs(symbols[fresh], symbols[fresh + 1])
            rank[-1] = _NONE
            first = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            spans = np.diff(np.concatenate([first, [len(word)]]))
            least = np.repeat(np.minimum.reduceat(rank, first), spans)
            over = least == _NONE
            if over.any():
                done_symbols.append(symbols[over])
                done_words.append(word[over])
                go = ~over
                symbols, word, rank, made, least = symbols[go], word[go], rank[go], made[go], least[go]
                if not len(symbols):
                    break
            at = np.flatnonzero(rank == least)
            new_word = np.concatenate([[True], word[at][1:] != word[at][:-1]])
            leader = at[new_word]
            group = np.cumsum(new_word) - 1
            one = ~self.safe[made[leader]]
            # of neighbouring occurrences that overlap, the first, third, ... merge
            joined = np.concatenate([[False], (at[1:] == at[:-1] + 1) & ~new_word[1:]])
            order = np.arange(len(at))
            since = order - np.maximum.accumulate(np.where(joined, 0, order))
            take = np.where(one[group], new_word, since % 2 == 0)
            merge_at = at[take]
            symbols[merge_at] = made[merge_at]
            stay = np.ones(len(symbols), dtype=bool)
            stay[merge_at + 1] = False
            singles[word[leader[one]]] += 1
            slow = np.flatnonzero(singles >= SINGLE_ROUNDS)
            changed = np.zeros(len(symbols), dtype=bool)
            changed[merge_at] = True
            before = merge_at[merge_at > 0] - 1
            changed[np.where(stay[before], before, before - 1)] = True
            fresh = np.flatnonzero(changed[stay])
            symbols, word, rank, made = symbols[stay], word[stay], rank[stay], made[stay]
            for w in slow:
                singles[w] = 0
                a, b = np.searchsorted(word, [w, w + 1])  # words stand in order
                ended = self._merge_by_heap(symbols[a:b].tolist())
                done_symbols.append(np.array(ended, dtype=np.int64))
                done_words.append(np.full(len(ended), w))
                symbols, word, rank, made = (np.delete(x, slice(a, b)) for x in (symbols, word, rank, made))
                fresh = np.arange(len(symbols))
        if not done_symbols:
            return np.zeros(0, dtype=np.int64), np.zeros(len(words) + 1, dtype=np.int64)
        symbols, word = np.concatenate(done_symbols), np.concatenate(done_words)
        by = np.argsort(word, kind="stable")
        symbols, word = self._as_bytes(symbols[by], word[by])
        return symbols, np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(words)))])

    def _merge_by_heap(self, symbols: list[int]) -> list[int]:
        """One word, one merge at a time: for long runs where an equal rank must go from the left."""
        table = self._pair_dict()
        after = [*range(1, len(symbols)), -1]
        before = [-1, *range(len(symbols) - 1)]
        live = [True] * len(symbols)
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and (j := after[i]) >= 0 and (found := table.get(symbols[i] * _BIG + symbols[j])):
                heapq.heappush(heap, (found[0], i, symbols[i], symbols[j], found[1]))

        for i in range(len(symbols)):
            offer(i)
        while heap:
            _, i, a, b, to = heapq.heappop(heap)
            j = after[i] if live[i] else -1
            if j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], live[j], after[i] = to, False, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [s for s, ok in zip(symbols, live, strict=True) if ok]

    def _pair_dict(self) -> dict[int, tuple[int, int]]:
        if not hasattr(self, "_pairs_by_key"):
            self._pairs_by_key = {k: (r, m) for k, r, m in zip(self.pair_keys.tolist(), self.pair_ranks.tolist(), self.pair_merged.tolist(), strict=True)}
        return self._pairs_by_key

    def _as_bytes(self, symbols: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Code points outside the vocabulary become the ids of their UTF-8 bytes."""
        out = np.flatnonzero(symbols >= self.size)
        if not len(out):
            return symbols, word
        texts = [chr(c).encode("utf-8", "replace") for c in (symbols[out] - self.size).tolist()]
        counts = np.ones(len(symbols), dtype=np.int64)
        counts[out] = [len(b) for b in texts]
        wide = np.repeat(symbols, counts)
        wide[np.repeat(symbols >= self.size, counts)] = self.byte_ids[np.frombuffer(b"".join(texts), dtype=np.uint8)]
        return wide, np.repeat(word, counts)

    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of documents whose ids lie between the offsets, as the library's decode(ids) gives them."""
        lengths = self.lengths[ids]
        ends = np.cumsum(lengths)
        total = int(ends[-1]) if len(ends) else 0
        flat = self.table[np.repeat(self.starts[ids] - (ends - lengths), lengths) + np.arange(total)].tobytes()
        bounds = np.concatenate([[0], ends])[offsets]
        out = []
        for k in range(len(offsets) - 1):
            own = ids[offsets[k] : offsets[k + 1]]
            apart = bool(self.is_control[own].any())  # a control piece shows nothing but ends a run of bytes
            try:
                text = self._decode_broken(own) if apart else flat[bounds[k] : bounds[k + 1]].decode()
            except UnicodeDecodeError:
                text = self._decode_broken(own)
            if apart:
                own = own[~self.is_control[own]]
            out.append(text[1:] if len(own) and self.opens_with_mark[own[0]] else text)
        return out

    def _decode_broken(self, ids: np.ndarray) -> str:
        """Runs of byte pieces that aren't UTF-8: one replacement character for each byte that fits nowhere."""
        out, run = [], bytearray()

        def flush() -> None:
            at = 0
            while at < len(run):
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[at : at + n]).decode())
                        at += n
                        break
                    except UnicodeDecodeError:
                        continue
                else:
                    out.append("�")
                    at += 1
            run.clear()

        for i in ids.tolist():
            if self.is_byte[i]:
                run += self.rendered[i]
            else:
                flush()
                out.append(self.rendered[i].decode())
        flush()
        return "".join(out)


class Encoder:
    """Encodes texts through a store of words that have been merged before."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.empty()

    def empty(self) -> None:
        self.number: dict[str, int] = {}
        self.ids: list[np.ndarray] = []
        self.count = 0

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offset of each text in them."""
        if len(self.number) > WORDS_KEPT:
            self.empty()
        words = [self.model.split(t) for t in texts]
        fresh = list(set().union(*words).difference(self.number))
        if fresh:
            flat, at = self.model.merge(fresh)
            start = len(self.number)
            self.number.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            self.ids.append(flat)
            self.sizes = np.concatenate([self.sizes, np.diff(at)]) if start else np.diff(at)
        if not self.number:
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        number = self.number
        used = np.array([number[w] for ws in words for w in ws], dtype=np.int64)
        sizes = self.sizes[used]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[0][np.repeat(starts[used] - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[upto]


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids of the texts, and the offset of each text in them."""
        if len(self.number) > WORDS_KEPT:
            self.empty()
        words = [self.model.split(t) for t in texts]
        fresh = list(set().union(*words).difference(self.number))
        if fresh:
            flat, at = self.model.merge(fresh)
            start = len(self.number)
            self.number.update(zip(fresh, range(start, start + len(fresh)), strict=True))
            self.ids.append(flat)
            self.sizes = np.concatenate([self.sizes, np.diff(at)]) if start else np.diff(at)
        if not self.number:
            return np.zeros(0, dtype=np.int64), np.zeros(len(texts) + 1, dtype=np.int64)
        if len(self.ids) > 1:
            self.ids = [np.concatenate(self.ids)]
        starts = np.concatenate([[0], np.cumsum(self.sizes)[:-1]])
        number = self.number
        used = np.array([number[w] for ws in words for w in ws], dtype=np.int64)
        sizes = self.sizes[used]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.ids[0][np.repeat(starts[used] - (ends - sizes), sizes) + np.arange(total)]
        upto = np.concatenate([[0], np.cumsum([len(ws) for ws in words])]).astype(np.int64)
        return ids, np.concatenate([[0], ends])[upto]


_models: dict[str, PieceModel] = {}


def model_at(path: str) -> PieceModel:
    if path not in _models:
        _models[path] = PieceModel(path)
    return _models[path]


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= CHUNK:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """Adds the piece ids of a text column (array of int). Null and empty texts give an empty array.

    Rows and other columns stay as they are, repeated rows included; a column named as `ids` is replaced.
    """
    kept = [c for c in df.columns if c.lower() != ids.lower()]
    hidden = free_name(df, "_text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(hidden))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model_at(path))
        for batch in batches:
            for a, texts in portions(batch.column(len(kept)), CHUNK):
                flat, at = encoder.encode(texts)
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, len(texts)) for k in range(len(kept))), column], names=[*kept, ids])

    return source.mapInArrow(trimmed(run), f"{schema}, `{ids}` array<int>")


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """Adds the text of an array of piece ids. Null and empty arrays give an empty text; ids outside the vocabulary fail."""
    kept = [c for c in df.columns if c.lower() != text.lower()]
    source = df.select(*[F.col(f"`{c}`") for c in kept])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema)
    where = kept.index(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for a in range(0, batch.num_rows, 256):
                part = batch.slice(a, 256)
                rows = [np.array(x or [], dtype=np.int64) for x in part.column(where).to_pylist()]
                at = np.concatenate([[0], np.cumsum([len(x) for x in rows])]).astype(np.int64)
                texts = model.decode(np.concatenate(rows), at)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=[*kept, text])

    return source.mapInArrow(trimmed(run), f"{schema}, `{text}` string")


def round_trip(df: DataFrame, path: str, text: str = "text", ids: str = "ids", back: str = "decoded") -> DataFrame:
    """encode and decode in one pass (one Python worker a task): adds the ids and the text that they decode to.

    Null and empty texts give an empty array and an empty text; columns of the added names are replaced.
    """
    kept = [c for c in df.columns if c.lower() not in (ids.lower(), back.lower())]
    hidden = free_name(df, "_text")
    source = df.select(*[F.col(f"`{c}`") for c in kept], text_or_empty(f"`{text}`").alias(hidden))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != hidden)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        encoder = Encoder(model)
        for batch in batches:
            for a, texts in portions(batch.column(len(kept)), CHUNK):
                flat, at = encoder.encode(texts)
                column = pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(flat.astype(np.int32)))
                again = pa.array(model.decode(flat, at), pa.string())
                yield pa.RecordBatch.from_arrays([*(batch.column(k).slice(a, len(texts)) for k in range(len(kept))), column, again], names=[*kept, ids, back])

    return source.mapInArrow(trimmed(run), f"{schema}, `{ids}` array<int>, `{back}` string")


def codec_digests(df: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encodes and decodes each text in one pass: doc_id, n_tokens, ids_sha256, decoded_sha256.

    Null and empty texts give no ids and the digests of an empty string; repeated rows give repeated rows.
    """
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        encoder = Encoder(model)
        number = [str(i) for i in range(model.size)]
        for batch in batches:
            for a, texts in portions(batch.column(1), CHUNK):
                ids, at = encoder.encode(texts)
                back = model.decode(ids, at)
                shown = [number[i] for i in ids.tolist()]
                coded = [hashlib.sha256(",".join(shown[at[k] : at[k + 1]]).encode()).hexdigest() for k in range(len(texts))]
                plain = [hashlib.sha256(t.encode()).hexdigest() for t in back]
                columns = [batch.column(0).slice(a, len(texts)), pa.array(np.diff(at)), pa.array(coded, pa.string()), pa.array(plain, pa.string())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return source.mapInArrow(trimmed(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
