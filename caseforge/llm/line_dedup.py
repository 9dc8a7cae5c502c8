"""Line dedup by site-relative frequency, in DataFrame operations only.

Pages are grouped by host. A line is boilerplate of its host if the share of the host's
pages that hold it exceeds `ratio` (and at least `least_pages` pages do); such lines are
dropped from all pages of the host. The floor is there because on a host of fewer than
1 / ratio pages a line that stands on one page alone exceeds the ratio already; with
`least_pages` at 0 the ratio decides alone.

Each page sends its distinct lines once, as a 128-bit digest, into a count that is combined
before the shuffle. A host has fewer than (lines a page / ratio) boilerplate lines, so the
digests of a host fit in one row. The table of hosts with such lines is written; where its
files are small (checked), it goes to all executors and the texts aren't moved at all,
otherwise pages get their host's row by a join dealt over salts, so that a large host isn't
one task. Lines are dropped in a projection.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import free_name, table_bytes, written

RATIO = 0.05
LEAST_PAGES = 3
#: What a line has unless it is white space only (space, tab to return).
_SEEN = r"[^\x20\x09-\x0D]"
#: Bytes of the written table up to which it is broadcast; salts of the join beyond that.
BROADCAST_BYTES = 16 << 20
SALTS = 256


def host_of(url: Column) -> Column:
    """The host of a web address in lower case; null if it has none."""
    return F.lower(F.try_parse_url(url, F.lit("HOST")))


def _digest(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("a"), F.xxhash64(F.lit("second"), line).alias("b"))


def boilerplate(df: DataFrame, host: str, text: str, ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """host, drop: the digests of each host's boilerplate lines (hosts without any are absent)."""
    pages = df.select(F.col(f"`{host}`").cast("string").alias("host"), F.col(f"`{text}`").cast("string").alias("text"))
    totals = pages.groupBy("host").agg(F.count(F.lit(1)).alias("pages"))
    lines = pages.select("host", F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n", -1), lambda x: x.rlike(_SEEN)), _digest))).alias("line"))
    counts = lines.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") >= least_pages)
    t = totals.withColumnRenamed("host", "of")
    often = counts.join(t, F.col("host").eqNullSafe(F.col("of"))).filter(F.col("n") > F.lit(ratio) * F.col("pages"))
    return often.groupBy("host").agg(F.collect_list("line").alias("drop"))


def dedup_lines(df: DataFrame, host: str = "source", text: str = "text", ratio: float = RATIO, least_pages: int = LEAST_PAGES) -> DataFrame:
    """The input with its text cleaned, plus n_lines and n_dropped (columns of such names are replaced).

    Lines end at line feeds only. White-space lines are never dropped. A null text stays null
    with 0 lines, an empty one stays empty (one line). Pages with a null host form one host.
    Rows, repeated ones included, are all kept; each counts as a page. Input columns may have any
    other names. A page is one row of lines, so a very long text takes a task's memory as often as
    its own size allows, and no more. For web pages, add a column of `host_of(url)` and name it.
    """
    drop, salt = free_name(df, "_drop"), free_name(df, "_salt")
    marked = boilerplate(df, host, text, ratio, least_pages).withColumnRenamed("host", "_of").withColumnRenamed("drop", drop)
    marked, path = written(marked, "boilerplate")
    same_host = F.col(f"`{host}`").cast("string").eqNullSafe(F.col("_of"))
    if table_bytes(df.sparkSession, path) <= BROADCAST_BYTES:
        joined = df.join(F.broadcast(marked), same_host, "left")
    else:
        dealt = marked.withColumn("_at", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        # by place, not by text: copies of one text are spread as well
        salted = df.withColumn(salt, F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)).cast("int"))
        joined = salted.join(dealt, same_host & (F.col(salt) == F.col("_at")), "left")
    whole = F.col(f"`{text}`").cast("string")
    lines = F.split(whole, "\n", -1)
    kept = F.filter(lines, lambda x: ~x.rlike(_SEEN) | ~F.array_contains(F.col(drop), _digest(x)))
    has = F.col(drop).isNotNull() & whole.isNotNull()
    n = F.when(whole.isNull(), F.lit(0)).otherwise(F.size(lines)).cast("long")
    kept_name = free_name(df, "_kept")
    joined = joined.withColumn(kept_name, F.when(has, kept))
    cleaned = F.when(has, F.array_join(F.col(kept_name), "\n")).otherwise(whole)
    dropped = F.when(has, n - F.size(kept_name)).otherwise(F.lit(0)).cast("long")
    rest = [c for c in df.columns if c.lower() not in ("n_lines", "n_dropped")]
    return joined.select(*[cleaned.alias(c) if c == text else F.col(f"`{c}`") for c in rest], n.alias("n_lines"), dropped.alias("n_dropped"))


#: The same over `documents`, with the source as host.
SQL = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, text FROM documents),
l AS (SELECT r, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM d),
p AS (SELECT source, count(*) AS pages FROM d GROUP BY source),
f AS (SELECT source, line, count(DISTINCT r) AS n FROM l WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY source, line),
b AS (SELECT f.source, f.line FROM f JOIN p ON f.source IS NOT DISTINCT FROM p.source WHERE n >= {LEAST_PAGES} AND n > {RATIO}::DOUBLE * pages),
k AS (SELECT l.r, count(*) AS n_lines, count(b.line) AS n_dropped, string_agg(l.line, chr(10) ORDER BY l.i) FILTER (b.line IS NULL) AS kept
      FROM l LEFT JOIN b ON l.line = b.line AND l.source IS NOT DISTINCT FROM b.source GROUP BY l.r)
SELECT d.doc_id, d.source, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(k.kept, '') END AS text,
       coalesce(k.n_lines, 0) AS n_lines, coalesce(k.n_dropped, 0) AS n_dropped
FROM d LEFT JOIN k ON d.r = k.r
"""
