"""Copies of images, cropped or edited ones included, by local descriptors of a media column.

1. Corners: the local maxima of the Harris response, of any number, at the levels of an image
   pyramid (steps of 2 ** (1/4); pictures over BASE pixels a side begin at BASE, those under SMALL
   are enlarged too, so that copies at other sizes meet at some level).
2. Descriptors: 256 binary brightness tests around a corner of the smoothed picture, turned by the
   direction of the patch's intensity centroid, so that turned and re-lit copies give the same bits.
3. Hamming tables: 64 bits from each of eight places of the descriptor on are the key of a table, so
   descriptors of few differing bits share an entry of some table. All corners of an entry are compared
   with one another, in tiles of bounded size, and those of MATCH_BITS differing bits at most meet.
   Images that meet at two places, with about the same turn and scale between them, are compared: a
   copy needs VOTES such places.
4. Geometric consensus: the matched corners of a pair vote for one similarity transform (turn,
   scale, shift); a pair with enough agreeing votes is a copy.

Equal bytes are one image from the start. Classes are the components over copies.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, table_bytes, trimmed, written
from .components import components

#: Side beyond which pictures are reduced first, and up to which they are enlarged too.
BASE, SMALL = 512, 64
STEP = 2 ** (1 / 4)
#: Radius of a patch and of the square in which a corner is the greatest; differing bits of a match, votes of a copy.
RADIUS, APART, MATCH_BITS, VOTES = 10, 4, 36, 6
#: Tables, and the bytes of a key.
TABLES, WIDTH = 8, 8
#: Corners of an entry that meet in one group; longer ones are cut into chunks that meet two by two. Rows compared at once.
ENTRY, HELD = 4096, 40_000
#: Steps of turn and scale by which two shared entries may differ to be about the same.
TURN_STEPS, SCALE_STEPS = 3, 2
TURNS = 32
#: Bytes of a written table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
#: Pixels that are described at once, and corners whose keys are made at once.
PIXELS, CORNERS = 4_000_000, 16_384
#: Pictures of a batch that a Python worker gets or gives.
PICTURES = 256

_rng = np.random.default_rng(7)
_TESTS = np.clip(np.round(_rng.normal(0, RADIUS / 2.2, (256, 4))), -RADIUS + 1, RADIUS - 1)


def _turned() -> np.ndarray:
    """Test points for each turn: turns x 256 x (y1, x1, y2, x2)."""
    out = np.empty((TURNS, 256, 4), dtype=np.int64)
    for k in range(TURNS):
        c, s = np.cos(2 * np.pi * k / TURNS), np.sin(2 * np.pi * k / TURNS)
        for a in (0, 2):
            y, x = _TESTS[:, a], _TESTS[:, a + 1]
            out[k, :, a], out[k, :, a + 1] = np.round(s * x + c * y), np.round(c * x - s * y)
    return np.clip(out, -RADIUS, RADIUS)


_POINTS = _turned()


def decode_image(raw: bytes | None) -> np.ndarray | None:
    """Grey values of a PGM, PPM or PNG image (8 or 16 bits a channel or an 8-bit palette, no interlacing); None for anything else."""
    try:
        if raw is None:
            return None
        if raw[:2] in (b"P5", b"P6"):
            parts = raw.split(None, 4)[:4]
            w, h, top = (int(x) for x in parts[1:4])
            n = 3 if raw[:2] == b"P6" else 1
            if top > 255 or w < 1 or h < 1:
                return None
            body = np.frombuffer(raw[len(raw) - w * h * n :], dtype=np.uint8).reshape(h, w, n)
            return body.astype(np.float32).mean(axis=2)
        if raw[:8] == b"\x89PNG\r\n\x1a\n":
            at, data = 8, b""
            while at < len(raw):
                size, kind = struct.unpack(">I4s", raw[at : at + 8])
                if kind == b"IHDR":
                    w, h, bits, colour, _, _, laced = struct.unpack(">IIBBBBB", raw[at + 8 : at + 21])
                elif kind == b"PLTE":
                    colours = np.frombuffer(raw[at + 8 : at + 8 + size], dtype=np.uint8).reshape(-1, 3)
                elif kind == b"IDAT":
                    data += raw[at + 8 : at + 8 + size]
                at += 12 + size
            channels = {0: 1, 2: 3, 3: 1, 4: 2, 6: 4}.get(colour)
            if bits not in (8, 16) or laced or channels is None:
                return None
            n = channels * bits // 8
            rows = np.frombuffer(zlib.decompress(data), dtype=np.uint8).reshape(h, 1 + w * n)
            out = np.zeros((h, w * n), dtype=np.uint8)
            for y in range(h):
                line, up = rows[y, 1:].astype(np.int64), out[y - 1].astype(np.int64) if y else np.zeros(w * n, dtype=np.int64)
                kind = rows[y, 0]
                if kind == 0:
                    out[y] = line
                elif kind == 1:
                    out[y] = (line.reshape(w, n).cumsum(axis=0) & 255).reshape(-1)
                elif kind == 2:
                    out[y] = (line + up) & 255
                else:
                    own = np.zeros(w * n, dtype=np.int64)
                    for x in range(w * n):
                        a = own[x - n] if x >= n else 0
                        c = up[x - n] if x >= n else 0
                        if kind == 3:
                            p = (a + up[x]) // 2
                        else:
                            e = a + up[x] - c
                            p = min((abs(e - a), 0, a), (abs(e - up[x]), 1, up[x]), (abs(e - c), 2, c))[2]
                        own[x] = (line[x] + p) & 255
                    out[y] = own
            image = out.reshape(h, w, channels, bits // 8)[..., 0]  # the high byte of 16 bits
            if colour == 3:
                image = colours[image[..., 0]]
            return (image[..., :3] if image.shape[2] > 2 else image[..., :1]).astype(np.float32).mean(axis=2)
    except (ValueError, IndexError, struct.error, zlib.error, UnboundLocalError):
        return None
    return None


def _resized(images: np.ndarray, scale: float) -> np.ndarray:
    """Bilinear resampling of images x height x width."""
    if scale == 1:
        return images
    _, h, w = images.shape
    y, x = np.arange(max(1, int(h * scale))) / scale, np.arange(max(1, int(w * scale))) / scale
    y0, x0 = np.minimum(y.astype(int), h - 1), np.minimum(x.astype(int), w - 1)
    y1, x1 = np.minimum(y0 + 1, h - 1), np.minimum(x0 + 1, w - 1)
    fy, fx = (y - y0)[None, :, None], (x - x0)[None, None, :]
    a = images[:, y0][:, :, x0] * (1 - fx) + images[:, y0][:, :, x1] * fx
    b = images[:, y1][:, :, x0] * (1 - fx) + images[:, y1][:, :, x1] * fx
    return (a * (1 - fy) + b * fy).astype(np.float32)


def _box(a: np.ndarray, r: int) -> np.ndarray:
    """Sums over (2r + 1)-squares, edges repeated."""
    h, w = a.shape[1:]
    p = np.pad(a, ((0, 0), (r, r), (r, r)), mode="edge")
    rows = sum(p[:, k : k + h] for k in range(2 * r + 1))
    return sum(rows[:, :, k : k + w] for k in range(2 * r + 1))


def _levels(h: int, w: int) -> list[float]:
    """Scales of the pyramid of a picture."""
    first = min(1.0, BASE / max(h, w))
    up = [STEP**k for k in range(1, 9) if min(h, w) * STEP**k <= SMALL]
    down = [first / STEP**k for k in range(40)]
    return [s for s in [*up, *down] if min(h, w) * s >= 2 * RADIUS + 3]


def _greatest(a: np.ndarray, r: int) -> np.ndarray:
    """The greatest value in (2r + 1)-squares (edges wrap), by spans that double, along columns and rows."""
    for axis in (1, 2):
        out, span = a, 1
        while span < 2 * r + 1:
            step = min(span, 2 * r + 1 - span)
            out, span = np.maximum(out, np.roll(out, -step, axis=axis)), span + step
        a = np.roll(out, r, axis=axis)
    return a


def corners_of(images: np.ndarray) -> tuple[np.ndarray, ...]:
    """image, y, x, scale, turn, bits (32 bytes) of the corners of images x height x width."""
    found: list[tuple[np.ndarray, ...]] = []
    disc = np.arange(-RADIUS, RADIUS + 1)
    py, px = np.meshgrid(disc, disc, indexing="ij")
    inside = (py * py + px * px <= RADIUS * RADIUS).astype(np.float32)
    for scale in _levels(*images.shape[1:]):
        own, rest = images, scale
        while rest <= 0.5 and min(own.shape[1:]) >= 2:  # halve by means, so that nothing is skipped
            h2, w2 = own.shape[1] // 2 * 2, own.shape[2] // 2 * 2
            own, rest = own[:, :h2, :w2].reshape(len(own), h2 // 2, 2, w2 // 2, 2).mean(axis=(2, 4)), rest * 2
        own = _box(_resized(own, rest), 1) / 9
        b, h, w = own.shape
        if min(h, w) < 2 * RADIUS + 3:
            continue
        dy, dx = np.gradient(own, axis=1), np.gradient(own, axis=2)
        xx, yy, xy = _box(dx * dx, 2), _box(dy * dy, 2), _box(dx * dy, 2)
        response = xx * yy - xy * xy - 0.05 * (xx + yy) ** 2
        edge = np.zeros((h, w), dtype=bool)
        edge[RADIUS : h - RADIUS, RADIUS : w - RADIUS] = True
        image, y, x = np.nonzero((response >= _greatest(response, APART)) & (response > 100.0) & edge)
        smooth = _box(own, 2) / 25
        for at in range(0, len(y), 20_000):
            i, cy, cx = image[at : at + 20_000], y[at : at + 20_000], x[at : at + 20_000]
            patch = smooth[i[:, None, None], cy[:, None, None] + py, cx[:, None, None] + px]
            level = (patch * inside).sum(axis=(1, 2), keepdims=True) / inside.sum()
            off = (patch - level) * inside
            turn = np.round(np.arctan2((off * py).sum(axis=(1, 2)), (off * px).sum(axis=(1, 2))) / (2 * np.pi) * TURNS).astype(int) % TURNS
            spread = np.sqrt((off * off).sum(axis=(1, 2)) / inside.sum())
            q = _POINTS[turn]
            row = np.arange(len(cy))[:, None]
            first = patch[row, q[:, :, 0] + RADIUS, q[:, :, 1] + RADIUS]
            second = patch[row, q[:, :, 2] + RADIUS, q[:, :, 3] + RADIUS]
            bits = np.packbits(first < second - 0.05 * spread[:, None], axis=1)
            found.append((i, cy / scale, cx / scale, np.full(len(cy), scale), turn, bits))
    if not found:
        none = np.zeros(0)
        return none.astype(int), none, none, none, none.astype(int), np.zeros((0, 32), dtype=np.uint8)
    return tuple(np.concatenate(z) for z in zip(*found, strict=True))


#: A corner as it is kept: its bits, place, level of the pyramid (steps from LEVEL), and turn.
_CORNER = np.dtype([("bits", "u1", 32), ("y", "<f4"), ("x", "<f4"), ("level", "u1"), ("turn", "u1")])
LEVEL = 40


def _packed(y: np.ndarray, x: np.ndarray, scale: np.ndarray, turn: np.ndarray, bits: np.ndarray) -> bytes:
    out = np.zeros(len(y), dtype=_CORNER)
    out["bits"], out["y"], out["x"], out["turn"] = bits, y, x, turn
    out["level"] = np.clip(np.round(np.log(scale) / np.log(STEP)) + LEVEL, 0, 63)
    return out.tobytes()


def _batches(images: list[np.ndarray | None]) -> Iterator[list[int]]:
    """Places of pictures of one shape, as many as PIXELS allow (one at least)."""
    shapes: dict[tuple, list[int]] = {}
    for i, m in enumerate(images):
        if m is not None:
            shapes.setdefault(m.shape, []).append(i)
    for (h, w), own in shapes.items():
        step = max(1, PIXELS // (h * w))
        for a in range(0, len(own), step):
            yield own[a : a + step]


def described(media: DataFrame) -> DataFrame:
    """media_id, media_hash, readable and the corners of each row, in one pass without moving pictures; unreadable media have none."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for a in range(0, len(pdf), 32):
                part = pdf.iloc[a : a + 32]
                images = [decode_image(m) for m in part["media"]]
                out = [b""] * len(part)
                for own in _batches(images):
                    which, *columns = corners_of(np.stack([images[i] for i in own]))
                    for j, i in enumerate(own):
                        k = which == j
                        out[i] = _packed(*(c[k] for c in columns))
                yield pd.DataFrame({"media_id": part["media_id"].astype("Int64"), "media_hash": part["media_hash"], "readable": [m is not None for m in images], "corners": out})

    return media.select("media_id", "media_hash", "media").mapInPandas(trimmed(run), "media_id long, media_hash string, readable boolean, corners binary")


def _small(df: DataFrame, path: str) -> DataFrame:
    """A written table, to be broadcast where its files are small."""
    return F.broadcast(df) if table_bytes(df.sparkSession, path) <= BROADCAST_BYTES else df


def _numbered(df: DataFrame) -> tuple[DataFrame, str]:
    """Adds fid: numbers without large gaps, from the number of rows of each written partition (a row a partition on the driver)."""
    own, _ = written(df.withColumn("_id", F.monotonically_increasing_id()), "numbered", tidy=True)
    counts = {r["p"]: r["n"] for r in own.groupBy(F.shiftright("_id", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect()}
    starts, at = {}, 0
    for p in sorted(counts):
        starts[p], at = at, at + counts[p]
    start = F.element_at(F.create_map(*[F.lit(x) for kv in starts.items() for x in kv]), F.shiftright("_id", 33)) if starts else F.lit(0)
    return written(own.withColumn("fid", (start + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))).cast("long")).drop("_id"), "numbered")


#: Bits of a mark below the image's number: place (16), turn (5), scale (6).
_GEO = 27


def _mixed(key: np.ndarray, more: np.ndarray) -> np.ndarray:
    key = (key ^ (key >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) + more * np.uint64(0xC2B2AE3D27D4EB4F)
    return key ^ (key >> np.uint64(32))


def _held(corners: pd.Series, most: int) -> Iterator[tuple[int, int]]:
    """Slices of rows of `most` corners at most (one row at least)."""
    ends = np.cumsum([len(c) // _CORNER.itemsize for c in corners], dtype=np.int64)
    at = 0
    while at < len(ends):
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right")))
        yield at, upto
        at = upto


def _keyed(batches: Iterator[pd.DataFrame], bits: bool) -> Iterator[pd.DataFrame]:
    """Keys of a batch's images by CORNERS corners: a batch may hold 10,000 images, and their keys take up to 384 bytes a corner."""
    for whole in batches:
        for a, b in _held(whole["corners"], CORNERS):
            pdf = whole.iloc[a:b]
            corners = np.frombuffer(b"".join(pdf["corners"]), dtype=_CORNER)
            counts = np.array([len(c) // _CORNER.itemsize for c in pdf["corners"]], dtype=np.int64)
            own = corners["bits"]
            twice = np.concatenate([own, own], axis=1)
            key = np.tile(np.arange(1, TABLES + 1, dtype=np.uint64), (len(own), 1))
            for k in range(TABLES):
                key[:, k] = _mixed(key[:, k], np.ascontiguousarray(twice[:, 4 * k : 4 * k + WIDTH]).view(np.uint64)[:, 0])
            place = (corners["y"].astype(np.int64) // 8 * 4099 + corners["x"].astype(np.int64) // 8) & 0xFFFF
            mark = np.repeat(pdf["fid"].to_numpy(), counts) << _GEO | place << 11 | corners["turn"].astype(np.int64) << 6 | corners["level"]
            out = pd.DataFrame({"key": key.ravel().view(np.int64), "mark": np.repeat(mark, TABLES)})
            if bits:
                words = np.repeat(np.ascontiguousarray(own).view(np.int64).reshape(-1, 4), TABLES, axis=0)
                out = out.assign(**{f"w{k}": words[:, k] for k in range(4)})
            yield out


def table_keys(features: DataFrame, bits: bool = False) -> DataFrame:
    """(key, mark): of each corner and table the key, and image, place, turn, scale in one number; with `bits` the whole descriptor too."""
    return features.select("fid", "corners").mapInPandas(trimmed(lambda batches: _keyed(batches, bits)), "key long, mark long" + (", w0 long, w1 long, w2 long, w3 long" if bits else ""))


def _shared(a: str, b: str) -> list:
    """What an entry tells of two marks: images a < b; and in one number (as marks have it) the place on a, turn and scale from a to b."""
    low, high = F.least(a, b), F.greatest(a, b)
    bits = lambda m, at, n: F.shiftright(m, at).bitwiseAND(F.lit((1 << n) - 1)).cast("int")
    turn, level = F.pmod(bits(high, 6, 5) - bits(low, 6, 5), F.lit(TURNS)), bits(high, 0, 6) - bits(low, 0, 6) + 64
    return [F.shiftright(low, _GEO).alias("a"), F.shiftright(high, _GEO).alias("b"), (bits(low, 11, 16) * (TURNS << 7) + turn * 128 + level).alias("told")]


def _whole_groups(batches: Iterator[pa.RecordBatch], names: list[str], keys: int) -> Iterator[list[np.ndarray]]:
    """Columns by portions of about HELD rows that end where a group of the first `keys` columns, in whose order rows come, ends."""
    held = [np.zeros(0, dtype=np.int64)] * len(names)
    for batch in batches:
        held = [np.concatenate([h, batch.column(n).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)]) for h, n in zip(held, names, strict=True)]
        if len(held[0]) > HELD:
            last = np.flatnonzero(np.any([h != h[-1] for h in held[:keys]], axis=0))
            cut = int(last[-1]) + 1 if len(last) else 0
            yield [h[:cut] for h in held]
            held = [h[cut:] for h in held]
    yield held


def _agreed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of the image pairs that are told of two places with about the same turn and scale; rows come in order of a and b."""
    for a, b, told in _whole_groups(batches, ["a", "b", "told"], 2):
        change = np.ones(len(a), dtype=bool)
        change[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
        group, start = np.cumsum(change) - 1, np.flatnonzero(change)
        place, turn, level = told >> 12, told >> 7 & 31, told & 127
        found = np.zeros(len(start), dtype=bool)
        at, lag = np.arange(len(a)), 1
        while True:
            at = at[at + lag < len(a)]
            at = at[(group[at + lag] == group[at]) & ~found[group[at]]]
            if not len(at):
                break
            z = at + lag
            gap = np.abs(turn[at] - turn[z])
            alike = (place[at] != place[z]) & (np.minimum(gap, TURNS - gap) <= TURN_STEPS) & (np.abs(level[at] - level[z]) <= SCALE_STEPS)
            found[group[at[alike]]] = True
            lag += 1
        yield pa.RecordBatch.from_arrays([pa.array(a[start[found]]), pa.array(b[start[found]])], names=["a", "b"])


def _met(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(x, z): marks of all pairs of an entry's corners of different images with MATCH_BITS differing bits at most; rows come in order of key and tile."""

    def pairs(cols: list[np.ndarray]) -> Iterator[pa.RecordBatch]:
        key, tile, side, mark = cols[:4]
        words = np.stack(cols[4:]).view(np.uint64)
        change = np.ones(len(key), dtype=bool)
        change[1:] = (key[1:] != key[:-1]) | (tile[1:] != tile[:-1])
        group = np.cumsum(change)
        at, lag = np.arange(len(key)), 1
        while True:
            at = at[at + lag < len(key)]
            at = at[group[at + lag] == group[at]]
            if not len(at):
                return
            z = at + lag
            keep = (mark[at] >> _GEO != mark[z] >> _GEO) & ((side[at] != side[z]) | (side[at] == 2))
            gap = np.bitwise_count(words[:, at[keep]] ^ words[:, z[keep]]).sum(axis=0, dtype=np.int64)
            near = gap <= MATCH_BITS
            yield pa.RecordBatch.from_arrays([pa.array(mark[at[keep][near]]), pa.array(mark[z[keep][near]])], names=["x", "z"])
            lag += 1

    for cols in _whole_groups(batches, ["key", "tile", "side", "mark", "w0", "w1", "w2", "w3"], 2):
        yield from pairs(cols)


def candidate_pairs(features: DataFrame) -> DataFrame:
    """(a, b) with a < b: the images that share entries at two places with about the same turn and scale.

    All pairs of an entry's corners are compared, however long it is: corners that differ in more than
    MATCH_BITS aren't matched by `agreeing` either, so none is lost by leaving those out.
    """
    # dealt out before they are counted: nearly all keys differ, so counting them first would only fill memory and spill
    counted = table_keys(features).repartition("key").groupBy("key").agg(F.min("mark").alias("first"), F.max("mark").alias("last"), F.count(F.lit(1)).alias("n"))
    shared = counted.filter(F.shiftright("first", _GEO) < F.shiftright("last", _GEO)).select(F.col("key").alias("k"), F.ceil(F.col("n") / ENTRY).cast("int").alias("chunks"))
    entries, path = written(shared, "entries", tidy=True)
    own = table_keys(features, bits=True).join(_small(entries, path), F.col("key") == F.col("k"))
    # a long entry is cut into chunks, and each two of them meet in a tile of their own
    chunk = F.pmod(F.xxhash64("mark"), "chunks").cast("int")
    tiles = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda t: F.struct((F.least(t, chunk).cast("long") * F.col("chunks") + F.greatest(t, chunk)).alias("tile"), F.when(t == chunk, 2).when(chunk < t, 0).otherwise(1).alias("side")))
    words = ["w0", "w1", "w2", "w3"]
    short = own.filter("chunks = 1").select("key", F.lit(0).cast("long").alias("tile"), F.lit(2).alias("side"), "mark", *words)
    long_ = own.filter("chunks > 1").select("key", F.explode(tiles).alias("_t"), "mark", *words).select("key", "_t.tile", "_t.side", "mark", *words)
    parts = short if entries.filter("chunks > 1").isEmpty() else short.unionByName(long_)
    pairs = parts.repartition("key", "tile").sortWithinPartitions("key", "tile").mapInArrow(trimmed(_met), "x long, z long")
    # told by pair of images at once: a table of the met pairs, and an exchange to make them distinct, would be on disk beside this one
    told = pairs.select(*_shared("x", "z")).repartition("a", "b").sortWithinPartitions("a", "b").mapInArrow(trimmed(_agreed), "a long, b long")
    found = written(told, "candidates", tidy=True)[0]
    removed(features.sparkSession, path)
    return found


def agreeing(a: bytes, b: bytes) -> int:
    """Places of matched corners of two images (as they are kept) that agree on one similarity transform."""
    ca, cb = (np.frombuffer(z, dtype=_CORNER) for z in (a, b))
    if not len(ca) or not len(cb):
        return 0
    da, db = (np.ascontiguousarray(c["bits"]).view(np.uint64) for c in (ca, cb))
    gap = np.zeros((len(da), len(db)), dtype=np.uint16)
    for k in range(4):
        gap += np.bitwise_count(da[:, k, None] ^ db[None, :, k])
    best = gap.argmin(axis=1)
    i = np.flatnonzero((gap[np.arange(len(da)), best] <= MATCH_BITS) & (gap.argmin(axis=0)[best] == np.arange(len(da))))
    if len(i) < VOTES:
        return 0
    j = best[i]
    (ya, xa, sa, ta), (yb, xb, sb, tb) = ((c["y"].astype(float), c["x"].astype(float), STEP ** (c["level"].astype(float) - LEVEL), c["turn"].astype(float)) for c in (ca, cb))
    turn, zoom = (tb[j] - ta[i]) * 2 * np.pi / TURNS, sa[i] / sb[j]
    c, s = np.cos(turn) * zoom, np.sin(turn) * zoom
    near = 3 / sb[j]  # three pixels of the level on which the corner was found
    top = 0
    for m in range(len(i)):  # each match proposes a transform; the others vote
        dx, dy = xa[i] - xa[i[m]], ya[i] - ya[i[m]]
        px, py = xb[j[m]] + c[m] * dx - s[m] * dy, yb[j[m]] + s[m] * dx + c[m] * dy
        off = near + 0.12 * zoom[m] * np.hypot(dx, dy)  # turns and scales are known by steps
        agree = (np.abs(px - xb[j]) <= off) & (np.abs(py - yb[j]) <= off)
        agree &= (np.cos(turn - turn[m]) > 0.9) & (np.abs(np.log(zoom / zoom[m])) < 1.6 * np.log(STEP))
        # corners that stand for one place at several levels count once
        top = max(top, len(set(zip((xa[i[agree]] // 6).tolist(), (ya[i[agree]] // 6).tolist(), strict=True))))
    return top


def verified(pairs: DataFrame, features: DataFrame) -> DataFrame:
    """(a, b, votes) of the pairs with enough agreeing matches. Only images that are in a pair move."""
    met, path = written(pairs.select(F.explode(F.array("a", "b")).alias("m")).distinct(), "met", tidy=True)
    own, _ = written(features.join(_small(met, path), F.col("fid") == F.col("m"), "left_semi").select("fid", "corners"), "compared", tidy=True)
    side = lambda k: own.select(F.col("fid").alias(f"f{k}"), F.col("corners").alias(f"c{k}"))
    joined = pairs.join(side("a"), F.col("a") == F.col("fa")).join(side("b"), F.col("b") == F.col("fb"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = pd.DataFrame({"a": pdf["a"], "b": pdf["b"], "votes": [agreeing(x, z) for x, z in zip(pdf["ca"], pdf["cb"], strict=True)]})
            yield out[out["votes"] >= VOTES]

    return joined.select("a", "b", "ca", "cb").mapInPandas(trimmed(run), "a long, b long, votes int")


def copies(df: DataFrame, media_id: str = "media_id", media: str = "media") -> DataFrame:
    """media_id, class_id (least id of its class), n_links (copies found among different images), n_corners, readable.

    Null, empty and unreadable media (any format but those of `decode_image`) have no corners and are
    marked as not readable: equal bytes are still one class. Very large pictures are reduced first
    (BASE). Repeated rows are repeated; null ids are kept and name a class only where no other id
    does; other columns are left aside; an empty table gives an empty result. Ids are longs.
    """
    raw = F.coalesce(F.col(f"`{media}`"), F.lit(b""))
    own = df.select(F.col(f"`{media_id}`").cast("long").alias("media_id"), raw.alias("media"), F.sha2(raw, 256).alias("media_hash"))
    rows, _ = written(described(own).withColumn("row", F.monotonically_increasing_id()), "described", rows=PICTURES)
    distinct = rows.groupBy("media_hash").agg(F.min("media_id").alias("least"), F.min("row").alias("first"), F.first("readable").alias("readable"), F.first(F.length("corners") / _CORNER.itemsize).cast("long").alias("n_corners"))
    numbered, path = _numbered(distinct)
    features = rows.select("row", "corners").join(_small(numbered.select("first", "fid"), path), F.col("row") == F.col("first")).select("fid", "corners")
    links, _ = written(verified(candidate_pairs(features), features), "copies", tidy=True)
    roots = components(links.select("a", "b"))
    degree = links.select(F.explode(F.array("a", "b")).alias("m")).groupBy("m").agg(F.count(F.lit(1)).alias("n_links"))
    classes = numbered.join(roots, F.col("fid") == F.col("node"), "left").select("media_hash", "fid", "least", "n_corners", "readable", F.coalesce("root", "fid").alias("root"))
    named = classes.groupBy("root").agg(F.min("least").alias("class_id")).withColumnRenamed("root", "r")
    whole = classes.join(named, F.col("root") == F.col("r")).join(degree, F.col("fid") == F.col("m"), "left")
    whole = whole.select(F.col("media_hash").alias("w"), "class_id", F.coalesce("n_links", F.lit(0)).alias("n_links"), "n_corners", "readable")
    return rows.select("media_id", "media_hash").join(whole, F.col("media_hash") == F.col("w")).select("media_id", "class_id", "n_links", "n_corners", "readable")


def encode_pgm(grey: np.ndarray) -> bytes:
    h, w = grey.shape
    return b"P5\n%d %d\n255\n" % (w, h) + grey.astype(np.uint8).tobytes()


#: Sides of a drawn picture, and the edits that copies take in turn.
SIDE = 80
EDITS = ("crop", "turn", "half", "smaller", "larger", "noise")


@lru_cache(maxsize=4)
def _waves(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases, sines and cosines of n waves of fixed directions and lengths (7 to 40 pixels) over a picture."""
    rng = np.random.default_rng(n)
    length, angle, phase = np.exp(rng.uniform(np.log(7), np.log(40), n)), rng.uniform(0, np.pi, n), rng.uniform(0, 2 * np.pi, n)
    y, x = np.mgrid[:SIDE, :SIDE].reshape(2, -1)
    along = 2 * np.pi / length[:, None] * (np.cos(angle)[:, None] * x + np.sin(angle)[:, None] * y)
    return phase, np.sin(along), np.cos(along)


def draw(vector: list[float]) -> np.ndarray:
    """A picture of a vector: waves as strong as its components and shifted by them."""
    v = np.nan_to_num(np.asarray([0.0 if x is None else x for x in vector], dtype=np.float64))
    phase, sines, cosines = _waves(len(v))
    field = ((v * np.cos(phase + 40 * v)) @ sines + (v * np.sin(phase + 40 * v)) @ cosines).reshape(SIDE, SIDE)
    low, high = field.min(), field.max()
    return (field - low) / (high - low if high > low else 1) * 250


def edited(image: np.ndarray, edit: str) -> np.ndarray:
    """crop: cut on all sides, dimmed, with a bar drawn in; turn: by a right angle; half: the left half; smaller, larger: resized; noise: of spread 8."""
    h, w = image.shape
    if edit == "crop":
        out = image[7:-9, 6:-11] * 0.8 + 15
        out[-12:-8, :30] = 255
        return out
    if edit == "turn":
        return np.rot90(image)
    if edit == "half":
        return image[:, : w // 2]
    if edit in ("smaller", "larger"):
        return _resized(image[None].astype(np.float32), 0.8 if edit == "smaller" else 1.4)[0]
    return np.clip(image + np.random.default_rng(int(image.sum())).normal(0, 8, (h, w)), 0, 255)


def drawn(embeddings: DataFrame) -> DataFrame:
    """The media table of the query: each vector's picture under 2 x id, and for every tenth id a copy with one of EDITS under 2 x id + 1.

    Rows without a vector have null media; a null id stays null.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for whole in batches:
            for at in range(0, len(whole), PICTURES):
                pdf, ids, media = whole.iloc[at : at + PICTURES], [], []
                for i, vector in zip(pdf["vec_id"], pdf["embedding"], strict=True):
                    known = pd.notna(i)
                    picture = draw(vector) if vector is not None and len(vector) else None
                    ids.append(int(i) * 2 if known else None)
                    media.append(None if picture is None else encode_pgm(np.round(picture)))
                    if known and picture is not None and int(i) % 10 == 0:
                        ids.append(int(i) * 2 + 1)
                        media.append(encode_pgm(np.round(edited(picture, EDITS[int(i) // 10 % len(EDITS)]))))
                yield pd.DataFrame({"media_id": pd.array(ids, dtype="Int64"), "media": media})

    return embeddings.select("vec_id", "embedding").mapInPandas(trimmed(run), "media_id long, media binary")
