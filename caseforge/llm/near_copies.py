"""Near copies by SimHash: five-word Jaccard similarity of 0.8 or more, confirmed on the whole sets.

1. A text's set holds the 64-bit hashes of its runs of five words (A-Z lowered, split at white
   space; fewer words are one run). Equal sets are one node from the start.
2. Each set has several independent 64-bit fingerprints. A bit of two sets at similarity 0.8
   differs with chance acos(8/9) / pi = 0.15, too often for one narrow Hamming budget, and a wide
   one meets a share of all pairs that doesn't fall with their number. So every fingerprint goes
   through the binary trie self-join with a narrow budget, at most one differing bit in a stretch
   of 21 and BITS in all, and their number is chosen so that a pair at 0.8 is missed by all of
   them with chance MISS (`plan`); pairs above 0.8 are missed far more seldom.
3. Sets that the tries link are gathered into clusters, the components over those links.
4. Links of a cluster are confirmed exactly by comparing its sets with pivots: all of them in a small
   cluster, a few and then PIVOTS at a time in a large one, whose members are spread over tasks. Sets outside the
   cluster's largest component become pivots until none is left that hasn't been one, so no link
   between components can be missed, and a large group of copies takes few passes, not all its pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import free_name, portions, table_bytes, text_or_empty, trimmed, written
from .components import components
from .simhash import SEED, bit_counts, links, one_a_group, row_key

WORDS = 5
SIMILARITY = 0.8
BITS, PARTS, MISS = 10, 3, 3e-4
#: Distinct sets from which on the budget is narrower, so that chance links stay fewer than sets.
MANY, BITS_OF_MANY = 4_000_000, 8
#: Rows that a top node of a trie should hold.
NODE_ROWS = 8000
#: Members up to which all of a cluster are pivots at once; pivots of a larger one in its first round, which joins
#: most of a group of copies, and in later ones; the hashes that they may hold together; members of a cluster in a task.
SMALL, FIRST, PIVOTS, PIVOT_HASHES, SPREAD = 256, 16, 4096, 4_000_000, 512
#: Bytes of a written table up to which it is broadcast.
BROADCAST_BYTES = 16 << 20
ROUNDS = 10_000


def shingles(text: str, words: int = WORDS) -> np.ndarray:
    """Sorted different hashes of the text's runs of words; none without words."""
    tokens = text.encode("utf-8", "surrogatepass").lower().split()
    if not tokens:
        return np.zeros(0, dtype=np.uint64)
    joined = b" ".join(tokens)
    if len(tokens) <= words:
        return np.array([xxhash.xxh64_intdigest(joined, SEED)], dtype=np.uint64)
    ends = np.cumsum([len(t) + 1 for t in tokens])
    starts = np.concatenate([[0], ends[:-1]])[: len(tokens) - words + 1].tolist()
    ends = (ends[words - 1 :] - 1).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(joined[a:b], SEED) for a, b in zip(starts, ends, strict=True)], dtype=np.uint64))


def _at_most(k: int, n: int, p: float) -> float:
    return sum(math.comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(k + 1))


def plan(sets: int) -> tuple[int, int, int]:
    """Top levels of the tries, differing bits, and number of fingerprints for so many different sets."""
    top = min(20, max(4, math.ceil(math.log2(max(1, sets) / NODE_ROWS))))
    bits = BITS if sets < MANY else BITS_OF_MANY
    p = math.acos(2 * SIMILARITY / (1 + SIMILARITY)) / math.pi
    stretch = 64 // PARTS
    met = (1 - p) ** top * _at_most(1, stretch - top, p) * _at_most(bits - 1, 64 - stretch, p)
    return top, bits, math.ceil(math.log(MISS) / (PARTS * math.log(1 - met)))


def fingerprints(own: np.ndarray, prints: int) -> np.ndarray:
    """So many independent SimHashes of a set; zeros for the empty one."""
    rng = np.random.default_rng(11)
    factors = rng.integers(0, 1 << 63, (prints, 1), dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    shifts = rng.integers(0, 1 << 63, (prints, 1), dtype=np.uint64)
    total = np.zeros((prints, 64), dtype=np.int64)
    for at in range(0, len(own), 4080):
        x = own[None, at : at + 4080] * factors + shifts
        x ^= x >> np.uint64(30)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        total += bit_counts(x)
    return np.packbits((total * 2 > len(own))[:, ::-1], axis=1).view(">u8").astype(np.uint64).reshape(-1)


def _described(df: DataFrame, doc_id: str, text: str, prints: int) -> DataFrame:
    """doc_id, row (its key), node (digest of its set), size (of the set), prints."""
    source = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), row_key(doc_id, text).alias("row"), text_or_empty(f"`{text}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, texts in portions(batch.column(2), 1_000_000):
                node, size, own = [], [], []
                for t in texts:
                    s = shingles(t)
                    node.append(xxhash.xxh64_intdigest(s.tobytes(), SEED))
                    size.append(len(s))
                    own.append(fingerprints(s, prints).view(np.int64))
                part = batch.slice(a, len(texts))
                columns = [part.column(0), part.column(1), pa.array(np.array(node, dtype=np.uint64).view(np.int64)), pa.array(size, pa.int64()), pa.array(own, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "row", "node", "size", "prints"])

    return source.mapInArrow(trimmed(run), "doc_id long, row string, node long, size long, prints array<long>")


def near_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (a, b) of members and pivots at the similarity, as many as span what they connect.

    Rows: cluster, salt, member (0: a pivot, first in its group; 1: a member), node, comp, text, in order.
    """
    now, names, comps, sets, index = None, [], [], [], None
    found: list[tuple[int, int]] = []

    def root(i: int) -> int:
        while up[i] != i:
            i = up[i]
        return i

    for batch in batches:
        for k in range(batch.num_rows):
            cluster, salt, member, node, comp, text = (batch.column(c)[k].as_py() for c in range(6))
            if (cluster, salt) != now:
                now, names, comps, sets, index = (cluster, salt), [], [], [], None
            own = shingles(text)
            if not member:
                names.append(node)
                comps.append(comp)
                sets.append(own)
                continue
            if not sets:
                continue
            if index is None:
                whole = np.concatenate(sets)
                order = np.argsort(whole, kind="stable")
                sizes = np.array([len(s) for s in sets])
                index, owner = whole[order], np.repeat(np.arange(len(sets)), sizes)[order]
                other, up = np.array(comps), list(range(len(sets)))
            low = np.searchsorted(index, own, "left")
            many = np.searchsorted(index, own, "right") - low
            shared = np.bincount(owner[np.repeat(low - np.cumsum(many) + many, many) + np.arange(many.sum())], minlength=len(sets))
            near = np.flatnonzero((other != comp) & (shared >= SIMILARITY * (sizes + len(own) - shared) - 1e-9))
            for i, p in enumerate(near.tolist()):
                if i == 0 or root(p) != root(near[0]):
                    found.append((node, names[p]))
                    up[root(p)] = root(int(near[0]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b"])
            found = []


def _pivots(open_: DataFrame, first: bool) -> DataFrame:
    """pivot: nodes of each cluster by hash, as many as SMALL, FIRST or PIVOTS allow, PIVOT_HASHES at most together (one always)."""
    order, most = F.xxhash64("node"), F.when(F.col("m") <= SMALL, SMALL).otherwise(FIRST if first else PIVOTS)
    inside = Window.partitionBy("cluster", F.pmod(order, F.lit(16))).orderBy(order)
    some = open_.select("cluster", "node", "size", most.alias("most")).withColumn("r", F.row_number().over(inside)).filter("r <= most")
    whole = Window.partitionBy("cluster").orderBy(F.xxhash64("node"))  # 16 x PIVOTS rows of a cluster at most
    some = some.withColumn("r", F.row_number().over(whole)).withColumn("held", F.sum("size").over(whole))
    return some.filter((F.col("r") <= F.col("most")) & ((F.col("r") == 1) | (F.col("held") <= PIVOT_HASHES))).select(F.col("node").alias("pivot"))


def confirmed(members: DataFrame) -> DataFrame:
    """(node, comp): exact components at the similarity inside each cluster. members: cluster, node, size, text; a row a node."""
    state, _ = written(members.select("cluster", "node", "size", F.col("node").alias("comp"), F.lit(False).alias("asked")), "cluster-state")
    for k in range(ROUNDS):
        sizes = state.groupBy("cluster", "comp").agg(F.count(F.lit(1)).alias("n"))
        most = sizes.groupBy("cluster").agg(F.max(F.struct("n", "comp")).alias("top"), F.sum("n").alias("m"))
        most = most.select(F.col("cluster").alias("of"), F.col("top.comp").alias("largest"), "m", F.ceil(F.col("m") / SPREAD).cast("int").alias("salts"))
        placed = state.join(most, F.col("cluster") == F.col("of"))
        # a component of one node may be the largest; it is then compared by the others as pivots
        open_ = placed.filter(~F.col("asked") & (F.col("comp") != F.col("largest")))
        pivots, _ = written(_pivots(open_, k == 0), "pivots")
        if pivots.isEmpty():
            return state.select("node", "comp")
        now = placed.join(pivots, F.col("node") == F.col("pivot"), "left").withColumn("is_pivot", F.col("pivot").isNotNull())
        now, _ = written(now.select("cluster", "node", "size", "comp", (F.col("asked") | F.col("is_pivot")).alias("asked"), "is_pivot", "salts"), "cluster-round")
        busy = now.filter("is_pivot").select(F.col("cluster").alias("bc")).distinct()
        rows = now.join(busy, F.col("cluster") == F.col("bc"), "left_semi").select(F.col("node").alias("n"), "comp", "is_pivot", "salts").join(members.select("cluster", "node", "text"), F.col("n") == F.col("node"))
        salt = F.pmod(F.xxhash64("node", F.lit("salt")), F.col("salts")).cast("int")
        as_member = F.array(F.struct(salt.alias("salt"), F.lit(1).alias("member")))
        as_pivot = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda s: F.struct(s.alias("salt"), F.lit(0).alias("member")))
        dealt = rows.withColumn("x", F.explode(F.when(F.col("is_pivot"), F.concat(as_pivot, as_member)).otherwise(as_member)))
        dealt = dealt.select("cluster", "x.salt", "x.member", "node", "comp", "text").repartition("cluster", "salt").sortWithinPartitions("cluster", "salt", "member")
        found = dealt.mapInArrow(trimmed(near_pairs), "a long, b long")
        known = now.filter("comp <> node").select(F.col("node").alias("a"), F.col("comp").alias("b"))
        roots = components(known.unionByName(found)).select(F.col("node").alias("of"), "root")
        state, _ = written(now.join(roots, F.col("node") == F.col("of"), "left").select("cluster", "node", "size", F.coalesce("root", "comp").alias("comp"), "asked"), "cluster-state")
    raise RuntimeError(f"clusters haven't settled in {ROUNDS} rounds")


def groups(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, row (the row_key), group: the rows of df by components of near copies.

    Texts without words are one group. Nodes are known by 64-bit digests of their sets.
    """
    top, bits, prints = plan(df.count())
    docs, _ = written(_described(df, doc_id, text, prints), "shingles")
    distinct = docs.groupBy("node").agg(F.min("row").alias("row"), F.first("size").alias("size"), F.first("prints").alias("prints"))
    distinct, _ = written(distinct, "sets")
    each = distinct.filter("size > 0").select(F.col("node").alias("name"), F.posexplode("prints").alias("which", "fp"))
    clusters = components(links(each, bits, PARTS, top, prints))
    key = free_name(df, "_row")
    chosen = distinct.join(clusters.select(F.col("node").alias("of"), F.col("root").alias("cluster")), F.col("node") == F.col("of"))
    chosen, path = written(chosen.select(F.col("row").alias(key), "node", "size", "cluster"), "members")
    texts = df.select(row_key(doc_id, text).alias(key), text_or_empty(f"`{text}`").alias("text"))
    small = table_bytes(df.sparkSession, path) <= BROADCAST_BYTES
    members, _ = written(texts.join(F.broadcast(chosen) if small else chosen, key).dropDuplicates(["node"]).select("cluster", "node", "size", "text"), "member-texts")
    found = confirmed(members).select(F.col("node").alias("of"), "comp")
    return docs.join(found, F.col("node") == F.col("of"), "left").select("doc_id", "row", F.coalesce("comp", "node").alias("group"))


def deduplicated(df: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of each group of near copies: the one with the least id (null ids last); columns as they came.

    Null, empty and wordless texts are one group; different texts with a null id or under one id are
    told apart; rows equal in id and text count as one; very long texts are compared whole; an
    empty table gives an empty result.
    """
    return one_a_group(df, groups(df, doc_id, text), doc_id, text)
