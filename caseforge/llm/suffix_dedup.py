"""Removal of byte strings that start in two places, by a sparse, sampled suffix sort.

A byte goes if a string of `length` bytes that covers it also starts anywhere else. Sorting all
suffixes would move the corpus many times over, so only those are sorted that can matter:

1. Every window of `length` bytes has a minimizer: the place of the least hash among its 8-byte
   pieces, the first of equal ones. Equal windows have it at the same offset, so windows fall into
   runs that share a minimizer, and two equal windows lie at the same distances from equal bytes.
   Each run sends digests of the bytes that all its near or far windows share; runs whose digest
   occurs once have no repeated window. Of equal texts one stands for all.
2. Runs left over are cut into blocks of 32 window starts at fixed distances from the minimizer.
   A block's windows share a core of `length` - 31 bytes: its suffix, with up to 31 bytes on
   either side. Its key has the suffix's leading 32 bytes (four tokens of 8), a 128-bit digest of
   the core that stands for the tokens after those, and the sides.
3. Keys are range-partitioned by their leading tokens at splitters drawn from a bounded sample, with
   the text's number behind the key, so that one core may lie in many buckets. Each bucket sorts its
   keys by multikey quicksort token after token and compares neighbours. Only equality of cores
   matters for what is removed, so suffixes that agree for 32 bytes may stand in the digest's
   order. A core whose blocks have equal
   sides decides for all its windows at once, otherwise its single windows are counted.
4. A bucket's first and last core may go on beyond it. Their blocks are compared across the
   boundaries, window by window, in an aggregation that is combined before its shuffle.

Repeated windows come back as spans by text and are cut out.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed as forget
from .common import portions, text_or_empty, written

LENGTH = 400
PIECE = 8
BLOCK = 32
#: Texts and keys a text that splitters are drawn from, and blocks that a bucket is meant to hold.
SAMPLE_TEXTS, SAMPLE_KEYS, BUCKET_ROWS = 2000, 64, 60_000
#: Bytes of text whose windows are found at once.
CHUNK = 4_000_000
#: Runs of a text whose keys are made at once, and keys that go out at once.
KEYS_HELD = 2000
#: Segments below this size are ordered directly.
SMALL = 256


def _hashes(flat: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 8 bytes from each place on; the array has 8 bytes more than places."""
    n = len(flat) - PIECE
    words = np.empty(n, dtype=np.uint64)
    for k in range(PIECE):
        own = flat[k : k + (n - k + PIECE - 1) // PIECE * PIECE]
        words[k::PIECE] = own[: (len(own) // PIECE) * PIECE].view(np.uint64)[: len(words[k::PIECE])]
    words *= np.uint64(0x9E3779B97F4A7C15)
    words ^= words >> np.uint64(29)
    words *= np.uint64(0xBF58476D1CE4E5B9)
    words ^= words >> np.uint64(32)
    return words


def _minimizers(hashes: np.ndarray, width: int) -> np.ndarray:
    """Place of the first least hash among `width` from each place on (block minima from both ends)."""
    n = len(hashes) - width + 1
    blocks = -(-len(hashes) // width)
    # 40 bits of hash, then the place, so that one minimum gives both; equal hashes: the first place
    place = np.arange(len(hashes), dtype=np.uint64)
    key = np.full(blocks * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    key[: len(hashes)] = (hashes >> np.uint64(24) << np.uint64(24)) | (place & np.uint64(0xFFFFFF))
    table = key.reshape(blocks, width)
    ahead = np.minimum.accumulate(table, axis=1).reshape(-1)
    behind = np.minimum.accumulate(table[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    least = np.minimum(behind[:n], ahead[width - 1 : width - 1 + n])
    return (least & np.uint64(0xFFFFFF)).astype(np.int64)


def runs_of(texts: list[bytes], length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of windows with one minimizer: text number, the minimizer's place, first and last window start."""
    width = length - PIECE + 1
    out: list[tuple[np.ndarray, ...]] = []
    pieces: list[tuple[int, int, int]] = []  # text, from, to: bytes whose windows are found

    def flush() -> None:
        if not pieces:
            return
        sizes = np.array([b - a for _, a, b in pieces])
        flat = np.frombuffer(b"".join([texts[t][a:b] for t, a, b in pieces]) + bytes(PIECE), dtype=np.uint8)
        at = np.concatenate([[0], np.cumsum(sizes)])
        low = _minimizers(_hashes(flat), width)
        k = np.repeat(np.arange(len(pieces)), sizes - length + 1)
        firsts = np.cumsum(sizes - length + 1) - (sizes - length + 1)
        start = at[k] + np.arange(len(k)) - firsts[k]
        low = low[start]
        new = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (low[1:] != low[:-1])]))
        last = np.concatenate([new[1:], [len(k)]]) - 1
        own = k[new]
        shift = np.array([a for _, a, _ in pieces])[own] - at[own]
        out.append((np.array([t for t, _, _ in pieces])[own], low[new] + shift, start[new] + shift, start[last] + shift))
        pieces.clear()

    held = 0
    for t, text in enumerate(texts):
        for a in range(0, max(0, len(text) - length + 1), CHUNK):
            b = min(len(text), a + CHUNK + length - 1)
            if held + b - a > CHUNK and pieces:
                flush()
                held = 0
            pieces.append((t, a, b))
            held += b - a
    flush()
    if not out:
        none = np.zeros(0, dtype=np.int64)
        return none, none, none, none
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))  # type: ignore[return-value]


def _half(length: int) -> int:
    return (length - PIECE) // 2


def run_digests(text: bytes, low: int, first: int, last: int, length: int = LENGTH) -> list[int]:
    """Digests of the bytes that the near, and that the far windows of a run share (distance to the minimizer up to or over half)."""
    half, out = _half(length), []
    if low - last <= half:
        out.append(xxhash.xxh3_64_intdigest(text[low : low + length - half], 1))
    if low - first > half:
        out.append(xxhash.xxh3_64_intdigest(text[low - half - 1 : low + PIECE], 2))
    return out


def blocks_of(text: bytes, low: int, first: int, last: int, length: int = LENGTH) -> Iterator[tuple[int, bytes, bytes, bytes]]:
    """Blocks of a run: place of the suffix, its core, and the bytes on either side that its windows need."""
    core = length - BLOCK + 1
    for j in range((low - last) // BLOCK, (low - first) // BLOCK + 1):
        s = low - j * BLOCK
        x1, x0 = min(BLOCK - 1, s - first), max(0, s - last)
        yield s, text[s : s + core], text[s - x1 : s], text[s + core : s + length - x0]


def multikey_quicksort(keys: np.ndarray) -> np.ndarray:
    """Order of rows of unsigned tokens, by token after token: three-way partitions by a pivot's token;
    rows equal to it go on with the next token. Small segments are ordered directly."""
    n, depth = keys.shape
    order = np.arange(n)
    stack = [(0, n, 0)]
    while stack:
        a, b, d = stack.pop()
        if b - a < 2 or d == depth:
            continue
        own = order[a:b]
        if b - a <= SMALL:
            order[a:b] = own[np.lexsort(keys[own, d:].T[::-1])]
            continue
        token = keys[own, d]
        sample = np.sort(token[:: max(1, (b - a) // 64)])
        pivot = sample[len(sample) // 2]
        less, more = token < pivot, token > pivot
        same = ~(less | more)
        order[a:b] = np.concatenate([own[less], own[same], own[more]])
        i, j = a + int(less.sum()), b - int(more.sum())
        stack += [(a, i, d), (i, j, d + 1), (j, b, d)]
    return order


LEAD = 32  # leading bytes of a suffix that a key spells out
CORE = LEAD + 16
KEY = CORE + 2 + 2 * (BLOCK - 1)  # bytes of a key; a multiple of 8


def _key(core: bytes, left: bytes, right: bytes) -> bytes:
    return b"".join((core[:LEAD], _digest(core), bytes((len(left), len(right))), left.rjust(BLOCK - 1, b"\0"), right.ljust(BLOCK - 1, b"\0")))


def _windows(key: bytes) -> Iterator[tuple[int, bytes]]:
    """How far each window of a block begins before the suffix, and what it holds beside the core."""
    m, n = key[CORE], key[CORE + 1]
    both = key[CORE + 2 :]
    for x in range(BLOCK - 1 - n, m + 1):
        yield x, both[BLOCK - 1 - x : 2 * (BLOCK - 1) - x]


def _stretches(xs: list[int]) -> list[tuple[int, int]]:
    """Runs of consecutive numbers of an ascending list."""
    out: list[list[int]] = []
    for x in xs:
        if out and out[-1][1] == x - 1:
            out[-1][1] = x
        else:
            out.append([x, x])
    return [(a, b) for a, b in out]


def _texts(df: DataFrame, doc_id: str, text: str) -> DataFrame:
    return df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"))


def _digest(text: bytes) -> bytes:
    return xxhash.xxh3_128_digest(text)


def _arrow(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    """The rows of a batch, one at a time."""
    for i in range(batch.num_rows):
        yield batch.slice(i, 1).to_pylist()[0]


def _scan(df: DataFrame, length: int) -> DataFrame:
    """Every run of every text: th, doc_id, head (1 in a text's first row), digest, run (place and the distances to its windows)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, found in portions(batch.column(1), CHUNK // 2):
                texts = [t.encode("utf-8", "replace") for t in found]
                ids = batch.column(0).slice(a, len(texts)).to_pylist()
                names = [_digest(t) for t in texts]
                which, low, first, last = (x.tolist() for x in runs_of(texts, length))
                rows, seen = [], set()
                for t, m, p, q in zip(which, low, first, last, strict=True):
                    packed = m << 20 | (m - q) << 10 | (m - p)
                    for d in run_digests(texts[t], m, p, q, length):
                        rows.append((names[t], ids[t], 0 if t in seen else 1, d - (1 << 64) if d >> 63 else d, packed))
                        seen.add(t)
                if rows:
                    yield _arrow(rows, ["th", "doc_id", "head", "digest", "run"], [pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64()])

    return df.mapInArrow(run, "th binary, doc_id long, head int, digest long, run long")


def _named(df: DataFrame) -> DataFrame:
    """th (the digest of the text), doc_id, and the text packed."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for i, texts in portions(batch.column(1), CHUNK):
                raw, part = [t.encode("utf-8", "replace") for t in texts], batch.slice(i, len(texts))
                yield pa.RecordBatch.from_arrays([pa.array([_digest(t) for t in raw], pa.binary()), part.column(0), pa.array([pack(t) for t in raw], pa.binary())], names=["th", "doc_id", "packed"])

    return df.mapInArrow(run, "th binary, doc_id long, packed binary")


def _whole(df: DataFrame) -> DataFrame:
    """doc_id, th, n_bytes and the digest of the whole text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, texts in portions(batch.column(1), CHUNK):
                raw, part = [t.encode("utf-8", "replace") for t in texts], batch.slice(i, len(texts))
                columns = [pa.array([_digest(t) for t in raw], pa.binary()), pa.array([len(t) for t in raw], pa.int64()), pa.array([hashlib.sha256(t).hexdigest() for t in raw], pa.string())]
                yield pa.RecordBatch.from_arrays([part.column(0), *columns], names=["doc_id", "th", "n_bytes", "sha256"])

    return df.mapInArrow(run, "doc_id long, th binary, n_bytes long, sha256 string")


def _text_blocks(raw: bytes, runs: list[int], length: int) -> Iterator[dict[bytes, list[int]]]:
    """Places of the different keys of a text, by portions of at most KEYS_HELD runs: a key may come again in a later one."""
    for at in range(0, len(runs), KEYS_HELD):
        out: dict[bytes, list[int]] = {}
        for r in runs[at : at + KEYS_HELD]:
            low = r >> 20
            for s, core, left, right in blocks_of(raw, low, low - (r & 1023), low - (r >> 10 & 1023), length):
                out.setdefault(_key(core, left, right), []).append(s)
        yield out


def _splitters(texts: DataFrame, length: int) -> list[bytes]:
    """Keys (with text numbers) that cut the blocks into buckets, from a sample of bounded size."""
    total = texts.count()
    if not total:
        return []
    share = min(1.0, SAMPLE_TEXTS / total)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for row in _rows(batch):
                every = max(1, len(row["runs"]) // SAMPLE_KEYS)
                keys = sorted({k for part in _text_blocks(unpack(row["packed"]), row["runs"][::every], length) for k in part})
                own = keys[:: max(1, -(-len(keys) // SAMPLE_KEYS))]
                yield _arrow([(k + row["tid"].to_bytes(8, "big"), every * len(keys) / len(own)) for k in own], ["k", "w"], [pa.binary(), pa.float64()])

    place = F.pmod(F.xxhash64("tid", F.lit("splitters")), F.lit(1 << 30))
    drawn = texts.filter(place < F.lit(int(share * (1 << 30)) + 1)).select("tid", "packed", "runs").mapInArrow(run, "k binary, w double")
    rows = sorted((bytes(r["k"]), r["w"]) for r in drawn.collect())
    if not rows:
        return []
    weight = np.cumsum([w for _, w in rows])
    buckets = int(weight[-1] / share / BUCKET_ROWS) + 1
    cuts = np.searchsorted(weight, weight[-1] * np.arange(1, buckets) / buckets)
    return sorted({rows[min(c, len(rows) - 1)][0] for c in cuts.tolist()})


def _blocks(texts: DataFrame, splitters: list[bytes], length: int) -> DataFrame:
    """bucket, key, n (2 for copies), tid, places (packed): a row for each different key of a text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        names, kinds = ["bucket", "key", "n", "tid", "places"], [pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.binary()]
        for batch in batches:
            rows: list[tuple] = []
            for row in _rows(batch):
                number, raw = row["tid"].to_bytes(8, "big"), unpack(row["packed"])
                for part in _text_blocks(raw, row["runs"], length):
                    rows += [(bisect_right(splitters, key + number), key, min(2, row["n"] * len(at)), row["tid"], np.array(at, dtype=np.int64).tobytes()) for key, at in part.items()]
                    if len(rows) >= KEYS_HELD:
                        yield _arrow(rows, names, kinds)
                        rows = []
            if rows:
                yield _arrow(rows, names, kinds)

    return texts.select("tid", "packed", "n", "runs").mapInArrow(run, "bucket int, key binary, n long, tid long, places binary")


_FOUND = "edge boolean, key binary, n long, tid long, at binary"


def _spans(places: bytes, stretches: list[tuple[int, int]]) -> bytes:
    """First and last start of each stretch of windows before each place, packed."""
    p = np.frombuffer(places, dtype=np.int64)
    return np.stack([np.concatenate([p - b for _, b in stretches]), np.concatenate([p - a for a, _ in stretches])], axis=1).tobytes()


def _even(key: bytes) -> list[tuple[int, int]]:
    return [(BLOCK - 1 - key[CORE + 1], key[CORE])]


def _repeated(members: dict[bytes, int]) -> dict[bytes, list[tuple[int, int]]]:
    """For each key of one core: the stretches of its windows that are there twice."""
    total: dict[tuple[int, bytes], int] = {}
    for key, n in members.items():
        for w in _windows(key):
            total[w] = total.get(w, 0) + n
    return {key: _stretches([w[0] for w in _windows(key) if total[w] > 1]) for key in members}


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorts each bucket and compares neighbours: spans of repeated windows, and the blocks of its first and last core."""
    kinds = [("bucket", pa.int32()), ("key", pa.binary()), ("n", pa.int64()), ("tid", pa.int64()), ("places", pa.binary())]
    table = pa.Table.from_batches(batches, schema=pa.schema(kinds)).combine_chunks()
    if not table.num_rows:
        return
    bucket, n, tid = (table.column(c).to_numpy() for c in ("bucket", "n", "tid"))
    column, places = table.column("key"), table.column("places")
    keys = np.concatenate([np.frombuffer(c.buffers()[2], dtype=np.uint8)[c.offset * KEY : (c.offset + len(c)) * KEY] for c in column.chunks])
    tokens = keys.view(">u8").reshape(len(n), KEY // 8).astype(np.uint64)
    rows: list[tuple] = []
    by = np.argsort(bucket, kind="stable")
    cuts = np.concatenate([[0], np.flatnonzero(np.diff(bucket[by])) + 1, [len(by)]])
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
        own = by[a:b]
        own = own[multikey_quicksort(tokens[own])]
        near = tokens[own]
        new_core = np.concatenate([[True], (near[1:, : CORE // 8] != near[:-1, : CORE // 8]).any(axis=1)])
        new_key = new_core | np.concatenate([[True], (near[1:] != near[:-1]).any(axis=1)])
        first = np.flatnonzero(new_core)
        last = np.concatenate([first[1:], [len(own)]])
        total, different = np.add.reduceat(n[own], first), np.add.reduceat(new_key.astype(np.int64), first)
        edge = np.zeros(len(first), dtype=bool)
        edge[[0, -1]] = True
        for k in np.flatnonzero(edge | (total > 1)).tolist():
            mine = own[first[k] : last[k]].tolist()
            names = [column[i].as_py() for i in mine]
            if edge[k]:
                rows += [(True, key, int(n[i]), int(tid[i]), places[i].as_py()) for i, key in zip(mine, names, strict=True)]
            elif different[k] == 1:
                found = _even(names[0])
                rows += [(False, None, 0, int(tid[i]), _spans(places[i].as_py(), found)) for i in mine]
            else:
                members: dict[bytes, int] = {}
                for i, key in zip(mine, names, strict=True):
                    members[key] = members.get(key, 0) + int(n[i])
                stretches = _repeated(members)
                rows += [(False, None, 0, int(tid[i]), _spans(places[i].as_py(), stretches[key])) for i, key in zip(mine, names, strict=True) if stretches[key]]
            if len(rows) >= 20_000:
                yield _arrow(rows, ["edge", "key", "n", "tid", "at"], [pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary()])
                rows = []
    if rows:
        yield _arrow(rows, ["edge", "key", "n", "tid", "at"], [pa.bool_(), pa.binary(), pa.int64(), pa.int64(), pa.binary()])


def _edge_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(0, batch.num_rows, 1000):
            part = batch.slice(i, 1000)
            rows = [(key, x, _digest(key[:CORE] + w + bytes((x,))), n) for key, n in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True) for x, w in _windows(key)]
            if rows:
                yield _arrow(rows, ["key", "x", "window", "n"], [pa.binary(), pa.int32(), pa.binary(), pa.int64()])


def _edge_spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(t, _spans(p, _stretches(sorted(xs)))) for t, p, xs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        if rows:
            yield _arrow(rows, ["tid", "at"], [pa.int64(), pa.binary()])


def candidates(own: DataFrame, length: int = LENGTH) -> DataFrame:
    """One row for each different text that shares a run's digest with any other place: tid, th, packed, n (2 for copies), runs.

    Of copies the one with the least doc_id stands for all; the join on (text digest, doc_id) deals them out.
    """
    runs, path = written(_scan(own, length), "runs")
    # a written side, so that Spark can split the rows of a digest that very many runs share
    often, often_path = written(runs.groupBy("digest").agg(F.count(F.lit(1)).alias("c")).filter("c > 1").select("digest"), "often")
    held = runs.join(often, "digest", "left_semi")
    by_text = held.groupBy("th").agg(F.collect_set("run").alias("runs"), F.min("doc_id").alias("least"), F.least(F.greatest(F.sum("head"), F.lit(1)), F.lit(2)).alias("n"))
    by_text, _ = written(by_text.withColumnRenamed("th", "of"), "texts")
    forget(own.sparkSession, path)
    forget(own.sparkSession, often_path)
    found = _named(own).join(by_text, (F.col("th") == F.col("of")) & F.col("doc_id").eqNullSafe(F.col("least")))
    return written(found.select(F.monotonically_increasing_id().alias("tid"), "th", "packed", "n", "runs"), "candidates")[0]


def repeated_spans(texts: DataFrame, length: int = LENGTH) -> DataFrame:
    """(tid, starts) of candidate texts with repeated windows: packed pairs of the first and last start of stretches of such windows."""
    dealt = _blocks(texts, _splitters(texts, length), length).repartition("bucket")
    found, _ = written(dealt.mapInArrow(_compare, _FOUND), "found")
    edges = found.filter("edge")
    members = edges.groupBy("key").agg(F.sum("n").alias("n"))
    windows, _ = written(members.mapInArrow(_edge_windows, "key binary, x int, window binary, n long"), "windows")
    twice = windows.groupBy("window").agg(F.sum("n").alias("c")).filter("c > 1").select("window")
    xs = windows.join(twice, "window", "left_semi").groupBy("key").agg(F.collect_set("x").alias("xs"))
    crossed = edges.join(xs, "key").select("tid", "at", "xs").mapInArrow(_edge_spans, "tid long, at binary")
    return found.filter("not edge").select("tid", "at").unionByName(crossed).groupBy("tid").agg(F.collect_list("at").alias("starts"))


def _cut(text: bytes, starts: list[bytes], length: int) -> tuple[int, int, bytes]:
    """Removed bytes, maximal removed runs, and what is left; works on spans, whatever the text's size."""
    pairs = np.concatenate([np.frombuffer(s, dtype=np.int64).reshape(-1, 2) for s in starts]) if starts else np.zeros((0, 2), dtype=np.int64)
    if not len(pairs):
        return 0, 0, text
    pairs = pairs[np.argsort(pairs[:, 0], kind="stable")]
    first, upto = pairs[:, 0], np.maximum.accumulate(pairs[:, 1] + length)
    new = np.flatnonzero(np.concatenate([[True], first[1:] > upto[:-1]]))
    begin, end = first[new], upto[np.concatenate([new[1:], [len(upto)]]) - 1]
    edges = zip(np.concatenate([[0], end]).tolist(), np.concatenate([begin, [len(text)]]).tolist(), strict=True)
    return int((end - begin).sum()), len(new), b"".join([text[a:b] for a, b in edges])


def removal_digests(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, n_kept (bytes left), cut (whether it lost any) for each row.

    Null texts count as empty; texts shorter than `length` bytes lose nothing; rows with equal texts
    (repeated rows too) repeat each other, so from `length` bytes on they lose everything; very
    long texts are read by windows and cut by spans; ids may be null or repeated; other columns are
    left aside; an empty table gives an empty result.
    """
    own = _texts(df, doc_id, text)
    done, _ = written(_kept(own, length, False), "cut")
    rows = _whole(own).join(done.dropDuplicates(["of"]), F.col("th") == F.col("of"), "left")
    gone = F.coalesce("n_removed", F.lit(0))
    return rows.select("doc_id", "n_bytes", gone.alias("n_removed"), F.coalesce("n_spans", F.lit(0)).alias("n_spans"), F.coalesce("kept_sha256", "sha256").alias("kept_sha256"), (F.col("n_bytes") - gone).alias("n_kept"), (gone > 0).alias("cut"))


def _kept(own: DataFrame, length: int, whole: bool) -> DataFrame:
    """of (text digest), n_removed, n_spans, kept_sha256 of the texts that lose bytes; with `whole`, what is left of them too."""
    texts = candidates(own, length)
    spans = repeated_spans(texts, length).withColumnRenamed("tid", "t")
    cut = texts.select("tid", "th", "packed").join(spans, F.col("tid") == F.col("t")).select("th", "packed", "starts")
    names, kinds = ["of", "n_removed", "n_spans", "kept_sha256"], [pa.binary(), pa.int64(), pa.int64(), pa.string()]
    names, kinds = (names + ["kept"], kinds + [pa.binary()]) if whole else (names, kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            rows, held = [], 0
            for row in _rows(batch):
                removed, count, kept = _cut(unpack(row["packed"]), row["starts"], length)
                rows.append((row["th"], removed, count, hashlib.sha256(kept).hexdigest(), *([kept] if whole else [])))
                held += len(kept)
                if held >= CHUNK or len(rows) >= 256:
                    yield _arrow(rows, names, kinds)
                    rows, held = [], 0
            if rows:
                yield _arrow(rows, names, kinds)

    return cut.mapInArrow(run, "of binary, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * whole)


def kept_bytes(df: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH) -> DataFrame:
    """doc_id and the bytes that are left of each text (binary: a cut may fall inside a character)."""
    own = _texts(df, doc_id, text)
    done = _kept(own, length, True).dropDuplicates(["of"])
    same = _whole(own).select(F.col("doc_id").alias("d"), "th").distinct()
    texts = own.join(same, F.col("doc_id").eqNullSafe(F.col("d"))).join(done, F.col("th") == F.col("of"), "left")
    return texts.select("doc_id", F.coalesce("kept", F.col("text").cast("binary")).alias("kept"))
