"""Sharding by balanced label propagation, in DataFrame operations only.

Documents with equal texts are linked. Every document begins in the shard of its hash; in each
round the linked documents ask to move to the shard where most of their neighbours are, and a
shard admits as many rows as its quota leaves room for. Then rows beyond a shard's quota, the
unlinked ones first, fill the shards that lack rows, so that counts differ by one at most.

State is kept by unit: the documents of one group in one of 128 hash cells. A unit moves as a
whole, so a round works on at most 128 rows a group, however many copies it has, and a group
that no shard could hold fills one shard a round by cells; any other asks only a shard that has
room for all of it. Requests are admitted in classes of (unit size, hash) up to the room, the
class at the edge by finer hashes, through tables of bounded size. Rows are numbered inside
blocks of a shard.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import removed, text_or_empty, written

SHARDS = 16
CELLS = 128
ROUNDS = 6
#: Classes of requests a shard: bit length of the unit's rows x hash; 16 x 64 x 64 rows at most.
REQUEST_HASHES = 64
BLOCKS = 512


def _pick(values: list[int], label: Column) -> Column:
    return F.element_at(F.array(*[F.lit(int(v)) for v in values]), (label + 1).cast("int")).cast("long")


def _by_label(df: DataFrame, what: Column, shards: int) -> list[int]:
    found = {r["label"]: r["n"] for r in df.groupBy("label").agg(what.alias("n")).collect()}
    return [found.get(k) or 0 for k in range(shards)]


def propagate(units: DataFrame, quota: int, shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """Moves units (a, b: the group; cell; label; n rows) towards their group's largest shard with room.

    A group over the room of all shards fills one more of them a round, so `rounds` of them at most.
    """
    now, path = written(units, "units")
    for _ in range(rounds):
        room = [max(0, quota - n) for n in _by_label(now, F.sum("n"), shards)]
        weights = now.groupBy("a", "b", "label").agg(F.sum("n").alias("w"), F.max("n").alias("widest"))
        tie = F.xxhash64("a", "b", "label")
        sums = weights.groupBy("a", "b").agg(F.sum("w").alias("m"), F.max("widest").alias("widest")).select(F.col("a").alias("sa"), F.col("b").alias("sb"), "m", F.col("widest").alias("unit"))
        free = _pick(room, F.col("label"))
        rated = weights.join(sums, (F.col("a") == F.col("sa")) & (F.col("b") == F.col("sb"))).withColumn("whole", free >= F.col("m") - F.col("w")).withColumn("open", free >= F.col("unit"))
        lead = rated.groupBy("a", "b").agg(F.max(F.struct("whole", "open", "w", tie.alias("tie"), "label")).alias("lead"))
        lead = lead.select(F.col("a").alias("ga"), F.col("b").alias("gb"), "lead")
        own = weights.select(F.col("a").alias("wa"), F.col("b").alias("wb"), F.col("label").alias("wl"), "w", tie.alias("tie"))
        asked = now.join(lead, (F.col("a") == F.col("ga")) & (F.col("b") == F.col("gb"))).join(own, (F.col("a") == F.col("wa")) & (F.col("b") == F.col("wb")) & (F.col("label") == F.col("wl")))
        better = F.col("lead.whole") | (F.col("lead.open") & (F.struct("lead.w", "lead.tie") > F.struct("w", "tie")))
        asked = asked.withColumn("to", F.when((F.col("label") != F.col("lead.label")) & better, F.col("lead.label")))
        hashed = lambda salt: F.pmod(F.xxhash64("a", "b", F.lit(salt)), F.lit(REQUEST_HASHES))
        part = hashed("finer") * CELLS + F.when(F.col("lead.whole"), 0).otherwise(F.col("cell"))
        asked = asked.select("a", "b", "cell", "label", "n", "to", F.struct((~F.col("lead.whole")).alias("split"), F.length(F.bin("n")).alias("bits"), hashed("request").alias("h")).alias("class"), part.alias("part"))
        requests = asked.filter("to is not null").groupBy("to", "class").agg(F.sum("n").alias("rows"))
        upto = requests.withColumn("upto", F.sum("rows").over(Window.partitionBy("to").orderBy("class"))).withColumn("space", _pick(room, F.col("to")))
        cut = upto.filter("upto > space").groupBy("to").agg(F.min(F.struct("class", (F.col("space") - F.col("upto") + F.col("rows")).alias("left"))).alias("cut"))
        limits = cut.select(F.col("to").alias("t"), F.col("cut.class").alias("limit"), F.col("cut.left").alias("left"))  # a row a shard at most
        asked = asked.join(F.broadcast(limits), F.col("to") == F.col("t"), "left")
        edge = asked.filter(F.col("class") == F.col("limit")).groupBy("to", "part", "left").agg(F.sum("n").alias("rows"))
        edge = edge.withColumn("upto", F.sum("rows").over(Window.partitionBy("to").orderBy("part"))).filter("upto <= left")
        edge = edge.select(F.col("to").alias("et"), F.col("part").alias("ep"))  # shards x 64 x CELLS rows at most
        moved = asked.join(F.broadcast(edge), (F.col("class") == F.col("limit")) & (F.col("to") == F.col("et")) & (F.col("part") == F.col("ep")), "left")
        admitted = F.col("to").isNotNull() & (F.col("limit").isNull() | (F.col("class") < F.col("limit")) | F.col("et").isNotNull())
        moved = moved.withColumn("t", F.when(admitted, F.col("to")))
        moved = moved.select("a", "b", "cell", F.when(F.col("t").isNotNull(), F.col("to")).otherwise(F.col("label")).alias("label"), "n", F.col("t").isNotNull().alias("moved"))
        new, new_path = written(moved, "units")
        count = new.filter("moved").count()
        removed(units.sparkSession, path)
        now, path = new.drop("moved"), new_path
        if not count:
            break
    return now


def shard(df: DataFrame, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for each row.

    Size is the text's UTF-8 bytes plus 1 (null: 1); null and empty texts are equal texts with crc 0.
    Repeated rows are rows of their own, with slots of their own; an empty table gives an empty result.
    The law is `rows`: shard counts differ by one at most, slots run from 0 without gaps.
    """
    whole = text_or_empty(f"`{text}`")
    own = df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), (F.octet_length(whole) + 1).cast("long").alias("size"), F.crc32(whole.cast("binary")).alias("text_crc32"), F.xxhash64(whole).alias("a"))
    own = own.withColumn("b", F.concat_ws(":", "text_crc32", "size")).withColumn("cell", F.pmod(F.xxhash64("doc_id", F.lit("cell")), F.lit(CELLS)).cast("int"))
    docs, _ = written(own, "rows")
    total = docs.count()
    cells = docs.groupBy("a", "b", "cell").agg(F.count(F.lit(1)).alias("n"))
    groups = cells.groupBy("a", "b").agg(F.sum("n").alias("m")).filter("m > 1").select("a", "b")
    units = cells.join(groups, ["a", "b"], "left_semi").select("a", "b", "cell", (F.col("cell") % shards).alias("label"), "n")
    placed = propagate(units, total // shards, shards, rounds).select(F.col("a").alias("ua"), F.col("b").alias("ub"), F.col("cell").alias("uc"), "label")
    linked = docs.join(placed, (F.col("a") == F.col("ua")) & (F.col("b") == F.col("ub")) & (F.col("cell") == F.col("uc")), "left")
    linked = linked.select("doc_id", "size", "text_crc32", F.coalesce("label", F.col("cell") % shards).alias("label"), F.when(F.col("label").isNull(), F.lit(1)).otherwise(F.lit(0)).alias("kind"), F.pmod(F.xxhash64("doc_id", F.lit("slot")), F.lit(BLOCKS)).cast("int").alias("block"))
    linked, _ = written(linked, "placed")
    blocks = linked.groupBy("label", "kind", "block").agg(F.count(F.lit(1)).alias("n"))
    have = _by_label(blocks, F.sum("n"), shards)
    quota = [total // shards + (k < total % shards) for k in range(shards)]
    before = F.sum("n").over(Window.partitionBy("label").orderBy("kind", "block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.select(F.col("label").alias("sl"), F.col("kind").alias("sk"), F.col("block").alias("sb"), F.coalesce(before, F.lit(0)).alias("start"))  # shards x 2 x BLOCKS rows at most
    inside = F.row_number().over(Window.partitionBy("label", "kind", "block").orderBy("doc_id", "size", "text_crc32"))
    ranked = linked.withColumn("inside", inside).join(F.broadcast(starts), (F.col("label") == F.col("sl")) & (F.col("kind") == F.col("sk")) & (F.col("block") == F.col("sb")))
    rank = F.col("start") + F.col("inside") - 1
    over, lack = [max(0, h - q) for h, q in zip(have, quota, strict=True)], [max(0, q - h) for h, q in zip(have, quota, strict=True)]
    spill = _pick([sum(over[:k]) for k in range(shards)], F.col("label")) + rank - _pick(quota, F.col("label"))
    to, slot = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k in range(shards):
        here = (F.col("spill") >= sum(lack[:k])) & (F.col("spill") < sum(lack[: k + 1]))
        to = F.when(here, F.lit(k)).otherwise(to)
        slot = F.when(here, F.lit(have[k] - sum(lack[:k])) + F.col("spill")).otherwise(slot)
    ranked = ranked.withColumn("rank", rank).withColumn("stays", F.col("rank") < _pick(quota, F.col("label"))).withColumn("spill", spill)
    return ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(F.col("stays"), F.col("label")).otherwise(to).cast("int").alias("shard"),
        F.when(F.col("stays"), F.col("rank")).otherwise(slot).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
