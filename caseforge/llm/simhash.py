"""SimHash near-dedup by a binary trie self-join over the distinct fingerprints.

Two fingerprints within `bits` differing bits have, in one of `parts` stretches of the 64 bits,
at most bits // parts differing ones. So for each stretch the fingerprints are rotated to begin
with it, and a binary trie over the rotated bits is joined with itself: node pairs go down
together, add up differing bits, and end when they exceed bits // parts inside the first
stretch or `bits` in all. The first `top` levels of the join are made by Spark: a fingerprint
goes to the node of its prefix and to those one differing bit below it, so every surviving node
pair meets in one task, at a fixed number of copies a fingerprint. The rest is a frontier of
node pairs as numpy ranges of a sorted array, taken in pieces of bounded size.

Copies collapse into one fingerprint before the join. Node pairs whose fingerprints are all in
one component already aren't followed, so a large cluster isn't spelled out into all its pairs;
each task returns links that span the components it has found.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, portions, table_bytes, text_or_empty, trimmed, written
from .components import components

WORDS = 4
BITS = 4
PARTS = 3
#: Least number of the levels that Spark deals out, and the fingerprints that a node should hold.
TOP, NODE_ROWS = 8, 4000
SEED = 42
#: Node pairs held at once by a task's frontier piece.
PIECE = 200_000
#: Bytes of a written table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
#: Two nodes of so few fingerprint pairs are compared directly.
LEAF = 16


def bit_counts(values: np.ndarray) -> np.ndarray:
    """How many of the values have each bit: rows x 64, bit 0 first, for rows of unsigned 64-bit values.

    Eight bits at a time are summed as the bytes of a word, over at most 255 values.
    """
    rows, n = values.shape
    full = np.zeros((rows, -(-n // 255), 255), dtype=np.uint64)
    full.reshape(rows, -1)[:, :n] = values
    out = np.empty((rows, 8, 8), dtype=np.int64)
    for k in range(8):
        lanes = ((full >> np.uint64(k)) & np.uint64(0x0101010101010101)).sum(axis=2, dtype=np.uint64)
        out[:, :, k] = lanes.astype("<u8").view(np.uint8).reshape(rows, -1, 8).sum(axis=1, dtype=np.int64)
    return out.reshape(rows, 64)


def fingerprint(text: str, words: int = WORDS) -> int:
    """64-bit SimHash of a text's word shingles, repeats included; 0 without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return 0
    joined = b" ".join(tokens)
    n = len(tokens)
    if n <= words:
        return xxhash.xxh64_intdigest(joined, SEED)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])[: n - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    total, count = np.zeros(64, dtype=np.int64), len(starts)
    for at in range(0, count, 4080):
        hashes = np.array([digest(joined[a:b], SEED) for a, b in zip(starts[at : at + 4080], ends[at : at + 4080], strict=True)], dtype=np.uint64)
        total += bit_counts(hashes[None])[0]
    return int.from_bytes(np.packbits((total * 2 > count)[::-1]).tobytes(), "big")


def fingerprints(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, row: Column | None = None) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long), row where asked for. Null texts count as empty: fingerprint 0."""
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), text_or_empty(f"`{text}`").alias("text"), *([] if row is None else [row.alias("row")]))
    names = ["doc_id", "fp", *source.columns[2:]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in portions(batch.column(1), 1_000_000):
                part = batch.slice(a, len(texts))
                own = np.array([fingerprint(t, words) for t in texts], dtype=np.uint64)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(own.view(np.int64)), *part.columns[2:]], names=names)

    return source.mapInArrow(trimmed(run), "doc_id long, fp long" + ("" if row is None else ", row string"))


class _Found:
    """Components of the fingerprints of one task, as labels, and links that span them."""

    def __init__(self, which: np.ndarray, n: int):
        self.which, self.label, self.links = which, np.arange(n), []
        self._mark()

    def _mark(self) -> None:
        own = self.label[self.which]
        self.at = own
        self.changes = np.concatenate([[0], np.cumsum(own[1:] != own[:-1])])

    def add(self, i: np.ndarray, j: np.ndarray) -> None:
        """Joins the fingerprints at positions i and j of the sorted array."""
        a, b = self.label[self.which[i]], self.label[self.which[j]]
        new = a != b
        if not new.any():
            return
        a, b, i, j = a[new], b[new], i[new], j[new]
        low, high = np.minimum(a, b), np.maximum(a, b)
        _, once = np.unique(low * len(self.label) + high, return_index=True)
        self.links.append((self.which[i[once]], self.which[j[once]]))
        low, high = low[once], high[once]
        parent = np.arange(len(self.label))
        while True:
            np.minimum.at(parent, high, low)
            while True:
                up = parent[parent]
                if (up == parent).all():
                    break
                parent = up
            x, y = parent[low], parent[high]
            rest = x != y
            if not rest.any():
                break
            low, high = np.minimum(x[rest], y[rest]), np.maximum(x[rest], y[rest])
        self.label = parent[self.label]
        self._mark()

    def settled(self, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
        """Where both ranges are of one and the same component."""
        return (self.changes[a0] == self.changes[a1 - 1]) & (self.changes[b0] == self.changes[b1 - 1]) & (self.at[a0] == self.at[b0])


def _products(a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All position pairs of the ranges; each pair once where a range meets itself."""
    na, nb = a1 - a0, b1 - b0
    n = na * nb
    k = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
    wide = np.repeat(nb, n)
    i, j = np.repeat(a0, n) + k // wide, np.repeat(b0, n) + k % wide
    own = i != j
    return i[own], j[own]


def trie_links(node: np.ndarray, value: np.ndarray, name: np.ndarray, stretch: np.ndarray, top: int, bits: int, inner: int) -> tuple[np.ndarray, np.ndarray]:
    """Links among the rotated fingerprints of one task, between their names.

    node: number of the trie node that a row has come to; value: the rotated fingerprint, whose
    prefix is the row's own; name: what it belongs to; stretch: by row, the length of the first
    stretch. Rows whose prefix is the node's own meet each other and all the node's other rows.
    """
    side = (value >> np.uint64(64 - top)).astype(np.int64)
    by = np.lexsort((value, side, node))
    node, side, value, stretch = node[by], side[by], value[by], stretch[by]
    names, which = np.unique(name[by], return_inverse=True)
    found = _Found(which, len(names))
    near = np.flatnonzero((node[1:] == node[:-1]) & (np.bitwise_count(value[1:] ^ value[:-1]) <= bits))
    found.add(near, near + 1)
    first = np.flatnonzero(np.concatenate([[True], (node[1:] != node[:-1]) | (side[1:] != side[:-1])]))
    last = np.concatenate([first[1:], [len(node)]])
    at_node = node[first]
    home = side[first] == (at_node & ((1 << top) - 1))
    home_of = dict(zip(at_node[home].tolist(), np.flatnonzero(home).tolist(), strict=True))
    host = np.array([home_of.get(x, -1) for x in at_node.tolist()], dtype=np.int64)
    ok = host >= 0
    d = np.where(home, 0, 1)
    frontier = (first[host[ok]], last[host[ok]], first[ok], last[ok], d[ok], np.full(ok.sum(), top))
    stack = [frontier]
    ones: dict[int, np.ndarray] = {}
    while stack:
        a0, a1, b0, b1, d, level = stack.pop()
        if len(a0) > PIECE:
            half = len(a0) // 2
            stack += [tuple(x[:half] for x in (a0, a1, b0, b1, d, level)), tuple(x[half:] for x in (a0, a1, b0, b1, d, level))]
            continue
        go = ~found.settled(a0, a1, b0, b1)
        a0, a1, b0, b1, d, level = (x[go] for x in (a0, a1, b0, b1, d, level))
        leaf = ((a1 - a0) * (b1 - b0) <= LEAF) | (level >= 64)
        if leaf.any():
            i, j = _products(a0[leaf], a1[leaf], b0[leaf], b1[leaf])
            hit = np.bitwise_count(value[i] ^ value[j]) <= bits
            found.add(i[hit], j[hit])
            go = ~leaf
            a0, a1, b0, b1, d, level = (x[go] for x in (a0, a1, b0, b1, d, level))
        if not len(a0):
            continue
        bit = int(level[0])
        if bit not in ones:
            ones[bit] = np.concatenate([[0], np.cumsum((value >> np.uint64(63 - bit)) & np.uint64(1))]).astype(np.int64)
        c = ones[bit]
        am, bm = a1 - (c[a1] - c[a0]), b1 - (c[b1] - c[b0])
        allowed = np.where(bit < stretch[a0], inner, bits)
        own = a0 == b0
        children = (
            (a0, am, b0, bm, d, np.ones(len(a0), dtype=bool)),
            (am, a1, bm, b1, d, np.ones(len(a0), dtype=bool)),
            (a0, am, bm, b1, d + 1, d < allowed),
            (am, a1, b0, bm, d + 1, (d < allowed) & ~own),
        )
        parts = []
        for x0, x1, y0, y1, e, may in children:
            keep = may & (x1 > x0) & (y1 > y0)
            parts.append(tuple(z[keep] for z in (x0, x1, y0, y1, e, level + 1)))
        stack.append(tuple(np.concatenate(z) for z in zip(*parts, strict=True)))
    if not found.links:
        return names[:0], names[:0]
    return names[np.concatenate([x for x, _ in found.links])], names[np.concatenate([y for _, y in found.links])]


def links(prints: DataFrame, bits: int, parts: int, top: int, several: int = 0) -> DataFrame:
    """Links (a, b) between names that span the components of their fingerprints under `bits` differing bits.

    prints: fp, name. With `several`, which says of how many independent fingerprints each name has
    one; those of a kind meet, and only where the first `top` bits of a stretch agree, which
    saves the copies of a row that go to the nodes one bit away (pairs are missed: see the caller).
    """
    inner = bits // parts if not several else 1
    if inner > 1 and not several:
        raise ValueError("bits must be under twice the parts: a task meets nodes that differ in one bit at most")
    cuts = [64 * k // parts for k in range(parts + 1)]
    which = F.col("which").cast("long") if several else F.lit(0).cast("long")
    spread = []
    for k in range(parts):
        turn = cuts[k]
        rotated = F.col("fp") if turn == 0 else F.shiftleft("fp", turn).bitwiseOR(F.shiftrightunsigned("fp", 64 - turn))
        prefix = F.shiftrightunsigned(rotated, 64 - top)
        others = [F.when(prefix.bitwiseAND(F.lit(1 << b)) != 0, prefix - F.lit(1 << b)) for b in range(top)] if inner and not several else []
        for to in [prefix, *others]:
            spread.append(F.struct((F.shiftleft(which * parts + k, top) + to).alias("node"), rotated.alias("value")))
    dealt = prints.select("name", F.explode(F.array(*spread)).alias("x")).select("x.node", "x.value", "name").filter("node is not null").repartition("node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(batches, schema=pa.schema([("node", pa.int64()), ("value", pa.int64()), ("name", pa.int64())]))
        if table.num_rows:
            node, value, name = (table.column(k).to_numpy() for k in range(3))
            length = np.diff(cuts)[(node >> top) % parts]
            a, b = trie_links(node, value.view(np.uint64), name, length, top, bits, inner)
            for at in range(0, len(a), 100_000):
                yield pa.RecordBatch.from_arrays([pa.array(x[at : at + 100_000]) for x in (a, b)], names=["a", "b"])

    return dealt.mapInArrow(trimmed(run), "a long, b long")


def top_of(n: int, parts: int = PARTS) -> int:
    """Levels of the trie that Spark deals out, so that a node holds some thousands of n fingerprints."""
    return min(64 // parts - 1, max(TOP, (n // NODE_ROWS).bit_length()))


def _roots(prints: DataFrame, bits: int, parts: int, top: int | None) -> DataFrame:
    """fp, least (its least doc_id), n (its rows), root (least fingerprint of its component, null without links)."""
    distinct, _ = written(prints.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")), "distinct-fingerprints")
    top = top or top_of(distinct.count(), parts)
    roots = components(links(distinct.select("fp", F.col("fp").alias("name")), bits, parts, top))
    return distinct.join(roots, F.col("fp") == F.col("node"), "left").select("fp", "least", "n", "root")


def near_duplicates(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, parts: int = PARTS, top: int | None = None) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable over links).

    Null, empty and wordless texts have fingerprint 0 and are linked like any other; a null doc_id
    keeps its row but never names a component unless no other id is there; repeated rows are
    repeated in the result; an empty table gives an empty result.
    """
    docs, _ = written(fingerprints(df, doc_id, text, words), "fingerprints")
    held = _roots(docs, bits, parts, top).filter("n > 1 or root is not null")
    held = held.select("fp", "least", F.coalesce("root", "fp").alias("root"))
    named = held.groupBy("root").agg(F.min("least").alias("component_id")).withColumnRenamed("root", "of")
    classes = held.join(named, F.col("root") == F.col("of")).select(F.col("fp").alias("key"), "component_id")
    return docs.join(classes, F.col("fp") == F.col("key"), "left").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.when(F.col("key").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))


def row_key(doc_id: str = "doc_id", text: str = "text") -> Column:
    """Digest of a row's id and text: rows that share an id, or have none, are told apart by their texts."""
    return F.sha2(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), F.lit("null")), F.lit(":"), text_or_empty(f"`{text}`")), 256)


def one_a_group(df: DataFrame, grouped: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The row of df with the least (doc_id, digest) of each group; columns as they came.

    grouped: doc_id, row (the row_key) and the group of each row. Null ids come last. Rows that go
    are few as a rule: where their table is small (checked) it is broadcast and texts don't move.
    """
    key = free_name(df, "_row")
    own, _ = written(grouped, "grouped")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row"))
    chosen = own.groupBy("group").agg(least.alias("least")).select(F.col("least.row").alias("chosen"))
    keys = own.groupBy("row").agg(F.count(F.lit(1)).alias("n")).join(chosen, F.col("row") == F.col("chosen"), "left")
    told = keys.filter("n > 1 or chosen is null").select(F.col("row").alias(key), F.col("chosen").isNotNull().alias("repeated"))
    told, path = written(told, "told")
    told = F.broadcast(told) if table_bytes(df.sparkSession, path) <= BROADCAST_BYTES else told
    keyed, names = df.withColumn(key, row_key(doc_id, text)), [F.col(f"`{c}`") for c in df.columns]
    alone = keyed.join(told, key, "left_anti").select(*names)
    repeated = keyed.join(told.filter("repeated"), key, "left_semi").dropDuplicates([key]).select(*names)
    return alone.unionByName(repeated)


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text", words: int = WORDS, bits: int = BITS, parts: int = PARTS, top: int | None = None) -> DataFrame:
    """One row of each component of fingerprints: the one with the least id; columns as they came.

    Ids needn't be unique or given: a component keeps one row whatever its ids, so different texts
    with a null id or under one id all stay. Rows equal in id and text count as one row.
    """
    docs, _ = written(fingerprints(df, doc_id, text, words, row_key(doc_id, text)), "fingerprints")
    group = _roots(docs, bits, parts, top).select(F.col("fp").alias("key"), F.coalesce("root", "fp").alias("group"))
    return one_a_group(df, docs.join(group, F.col("fp") == F.col("key")).select("doc_id", "row", "group"), doc_id, text)
