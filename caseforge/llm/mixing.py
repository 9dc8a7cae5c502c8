"""Mixing sources to target weights by systematic sampling, in DataFrame operations only.

A source's target is its weight's share of all words, at most `most` times the source's own
size; the excess is shared again by weight (a water level: the target is min(level x weight,
most x size)). Each document then has target / source size expected copies. Along a fixed
order of the source's documents these are prefix-summed from one random offset, and a
document is emitted once for each integer crossed, so a source's copies differ from the
expected count by less than one, in every stretch of the order.

The order runs by size class and then by a hash of the id and the text, which spreads the sizes
evenly over the crossings; rows equal in both are interchangeable. Prefix sums are hierarchical:
documents are numbered inside blocks of (source, size class, hash digits), blocks inside size
classes, size classes inside sources, so no task holds a source; the digits grow with the table.

Texts are read once for sizes and hashes, which are written; all sums run over that narrow table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACES, free_name, text_or_empty, written

#: Weights of the sources in code-point order, null last, repeating.
WEIGHTS = (1.0, 2.0, 3.0)
MOST = 3.0
#: Rows that a block of the order should hold; a block has 2 to 4 hash digits.
BLOCK_ROWS = 20_000


def n_words(text: Column) -> Column:
    """Runs of characters other than ASCII white space; null and empty texts have none."""
    marks = F.translate(F.coalesce(text.cast("string"), F.lit("")), SPACES, " " * len(SPACES))
    return F.size(F.array_remove(F.split(marks, " "), "")).cast("long")


def size_class(size: str) -> Column:
    """Four classes to each doubling of a size column: its bit length and the two bits after the first."""
    bits = f"length(bin(`{size}`))"
    return F.expr(f"cast({bits} * 4 + if({bits} > 2, shiftright(`{size}`, {bits} - 3) & 3, 0) as int)")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """From (source, size): source, source_size, target. One row for each source, null included.

    The windows run over the table of sources, which holds one row for each of them.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (rank % len(weights)).cast("int") + 1)
    per = per.select("source", "source_size", weight.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap"))
    by_ratio = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before, after = by_ratio.rowsBetween(Window.unboundedPreceding, -1), by_ratio.rowsBetween(0, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(0))
    # the level if all sources with a lower cap a weight are at their caps and this one isn't
    level = (F.sum("source_size").over(whole).cast("double") - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("w").over(after)
    per = per.withColumn("level", level)
    fits = F.when(F.col("level") <= F.col("cap") / F.col("w"), F.col("level"))
    per = per.withColumn("level", F.max(fits).over(whole))
    target = F.when(F.col("level").isNull(), F.col("cap")).otherwise(F.least(F.col("level") * F.col("w"), F.col("cap")))
    return per.select("source", "source_size", target.alias("target"))


def _measured(df: DataFrame, doc_id: str, text: str, source: str, seed: int) -> DataFrame:
    """_id, _size, _source, _class, _hash (of id and text) of each row."""
    whole = text_or_empty(f"`{text}`")
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("_id"), n_words(whole).alias("_size"), F.col(f"`{source}`").cast("string").alias("_source"), _row_hash(doc_id, text, seed).alias("_hash"))
    return own.withColumn("_class", size_class("_size"))


def _row_hash(doc_id: str, text: str, seed: int) -> Column:
    return F.md5(F.concat(F.coalesce(F.col(f"`{doc_id}`").cast("long").cast("string"), F.lit("")), F.lit(f":{seed}:"), F.md5(text_or_empty(f"`{text}`").cast("binary"))))


def _decided(own: DataFrame, offset: float, weights: tuple[float, ...], most: float) -> DataFrame:
    """Adds _source_size, _target and _copies to the written table of measures."""
    targets = source_targets(own.select(F.col("_source").alias("source"), F.col("_size").alias("size")), weights, most)
    digits = 2 + sum(own.count() > BLOCK_ROWS * 16**k for k in (2, 3))
    own = own.withColumn("_block", F.substring("_hash", 1, digits))
    blocks = own.groupBy("_source", "_class", "_block").agg(F.count(F.lit(1)).alias("_n"))
    classes = blocks.groupBy("_source", "_class").agg(F.sum("_n").alias("_m"))
    earlier = Window.partitionBy("_source").orderBy("_class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(F.col("_source").alias("_ys"), F.col("_class").alias("_yc"), F.coalesce(F.sum("_m").over(earlier), F.lit(0)).alias("_before_class"))
    inside = Window.partitionBy("_source", "_class").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("_before_block", F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    starts = blocks.join(classes, F.col("_source").eqNullSafe(F.col("_ys")) & (F.col("_class") == F.col("_yc")))
    starts = starts.select(F.col("_source").alias("_s"), F.col("_class").alias("_c"), F.col("_block").alias("_b"), (F.col("_before_class") + F.col("_before_block")).alias("_start"))
    starts = starts.join(targets, F.col("_s").eqNullSafe(targets["source"])).select("_s", "_c", "_b", "_start", F.col("source_size").alias("_source_size"), F.col("target").alias("_target"))
    numbered = own.withColumn("_in", F.row_number().over(Window.partitionBy("_source", "_class", "_block").orderBy("_hash")))
    done = numbered.join(starts, F.col("_source").eqNullSafe(F.col("_s")) & (F.col("_class") == F.col("_c")) & (F.col("_block") == F.col("_b")))
    rate = F.when(F.col("_source_size") > 0, F.col("_target") / F.col("_source_size")).otherwise(F.lit(0.0))
    place = (F.col("_start") + F.col("_in")).cast("double")
    copies = F.floor(F.lit(offset) + place * rate) - F.floor(F.lit(offset) + (place - 1) * rate)
    return done.withColumn("_copies", F.least(copies, F.lit(int(-(-most // 1)))).cast("long"))


def mix(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, offset: float = 0.4142135623730951, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """Decides the copies of each document: doc_id, size, source_size, target, copies, taken (copies x size).

    Null sources are a source of their own; null and empty texts have size 0 and count towards no
    crossing's target; a source of size 0 gives no copies; a very long text is one document, of
    which only the size and a digest move; repeated rows are documents of their own; rows that
    share an id are told apart by their texts, so reruns agree; columns of any other names are
    left aside; an empty table gives an empty result. The offset is the one random number of the
    method, a parameter so that reruns agree.
    """
    own, _ = written(_measured(df, doc_id, text, source, seed), "sizes")
    done = _decided(own, offset, weights, most)
    return done.select(F.col("_id").alias("doc_id"), F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), F.col("_copies").alias("copies"), (F.col("_copies") * F.col("_size")).alias("taken"))


def emitted(df: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", seed: int = 7, offset: float = 0.4142135623730951, weights: tuple[float, ...] = WEIGHTS, most: float = MOST) -> DataFrame:
    """The mix itself: each document as often as it was emitted, with the input's columns.

    Copies come back to their rows by a join on the hash of id and text, so texts move once. Of
    rows that are equal in both, whose numbers of copies may differ, the first by their other
    columns takes the first number. Nulls, empty texts and empty tables: as in `mix`.
    """
    own, _ = written(_measured(df, doc_id, text, source, seed), "sizes")
    decided = _decided(own, offset, weights, most).groupBy("_hash", "_source")
    decided = decided.agg(F.min("_copies").alias("_least"), F.max("_copies").alias("_copies"), F.sum("_copies").alias("_sum"), F.count(F.lit(1)).alias("_n")).filter("_copies > 0")
    decided, _ = written(decided, "copies")
    key, held, times, rank, of, group, least, top, total, n = (free_name(df, c) for c in ("_key", "_held", "_times", "_rank", "_hash", "_source", "_least", "_copies", "_sum", "_n"))
    decided = decided.select(*[F.col(a).alias(b) for a, b in (("_hash", of), ("_source", group), ("_least", least), ("_copies", top), ("_sum", total), ("_n", n))])
    keyed = df.withColumn(key, _row_hash(doc_id, text, seed)).withColumn(held, F.col(f"`{source}`").cast("string"))
    joined = keyed.join(decided, (F.col(key) == F.col(of)) & F.col(held).eqNullSafe(F.col(group)))
    names = [F.col(f"`{c}`") for c in df.columns]
    even = joined.filter(F.col(least) == F.col(top)).select(*names, F.col(top).alias(times))
    # copies of equal rows differ by one at most along the order, so a sum says how many take the greater number
    order = Window.partitionBy(key, held).orderBy(*[F.col(f"`{c}`") for c in df.columns if c != text])
    uneven = joined.filter(F.col(least) < F.col(top)).withColumn(rank, F.row_number().over(order))
    more = (F.col(rank) <= F.col(total) - F.col(n) * F.col(least)).cast("long")
    uneven = uneven.select(*names, (F.col(least) + more).alias(times)).filter(F.col(times) > 0)
    return even.unionByName(uneven).withColumn(times, F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).select(*names)


#: The same mix over `documents`; the order runs through whole sources.
SQL = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':7:' || md5(coalesce(text, ''))) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT source, source_size, CAST(1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS DOUBLE) AS w, 3.0::DOUBLE * source_size AS cap FROM s),
l AS (SELECT *, (CAST((SELECT sum(source_size) FROM s) AS DOUBLE) - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
        / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w),
t AS (SELECT source, source_size, least((SELECT max(level) FROM l WHERE level <= cap / w) * w, cap) AS target FROM l),
p AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0.0 END AS rate,
         CAST(row_number() OVER (PARTITION BY d.source ORDER BY
           length(bin(size)) * 4 + CASE WHEN length(bin(size)) > 2 THEN (size >> (length(bin(size)) - 3)) & 3 ELSE 0 END, h) AS DOUBLE) AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
c AS (SELECT *, CAST(least(floor(0.4142135623730951::DOUBLE + place * rate) - floor(0.4142135623730951::DOUBLE + (place - 1) * rate), 3) AS BIGINT) AS copies FROM p)
SELECT doc_id, size, source_size, target, copies, copies * size AS taken FROM c
"""
