"""Quality rules: a threshold table compiled into one Spark projection, without user functions.

A rule bounds one measure of a text. Measures are column expressions over four arrays of the
text (words, lines with a word, hashes of 3-word windows, the windows that repeat), so the
whole table becomes one projection: one pass, no shuffle.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, free_name, text_or_empty

#: Frequent function words of English, German, French and Spanish.
STOP_WORDS = (
    "the of and to in is that it was for on are with as his they at be this have from or by not "
    "der die das und ist zu den von mit sich des auf für im dem nicht ein eine als auch "
    "le la les de et à un une du que est en dans pour par sur ne pas qui au "
    "el los las y se con no es su lo como más pero sus una del al por para"
).split()
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Texts whose measure lies outside [low, high] are rejected; None leaves a side open."""

    measure: str
    low: float | None = None
    high: float | None = None


#: Length, symbol, stop-word and line ratios.
RULES = (
    Rule("n_words", low=50),
    Rule("repeat_word_ratio", high=0.5),
    Rule("mean_word_chars", low=3.0, high=10.0),
    Rule("symbol_word_ratio", high=0.1),
    Rule("stop_word_ratio", low=0.02),
    Rule("dup_line_ratio", high=0.5),
    Rule("bullet_line_ratio", high=0.9),
    Rule("ellipsis_line_ratio", high=0.3),
)


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def _repeat_words(words: Column, windows: Column, n: Column) -> Column:
    """Words inside 3-word windows that are in the text twice or more.

    Windows are sorted by hash with their places, equal neighbours give the repeated places, and
    each place covers three words less what the next place covers again.
    """
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def place(x: Column, k: Column, all_: Column) -> Column:
        return F.when((F.get(all_, k - 1)["h"] == x["h"]) | (F.get(all_, k + 1)["h"] == x["h"]), x["i"])

    def places(all_: Column) -> Column:
        return F.sort_array(F.array_compact(F.transform(all_, lambda x, k: place(x, k, all_))))

    def covered(at: Column) -> Column:
        return F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p - s["last"])).alias("n"), p.alias("last")), lambda s: s["n"])

    # an array of one element binds the sorted pairs to a name, so that they are made once
    many = F.element_at(F.transform(F.array(pairs), lambda all_: covered(places(all_))), 1)
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0)).otherwise(many).cast("long")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines and the ratios of RULES.

    Words are runs of characters other than ASCII white space. Null and empty texts have none
    of anything, and ratios of 0. Input columns of these names are replaced.
    """
    t, w, tri, ln = (free_name(df, x) for x in ("_t", "_w", "_tri", "_ln"))
    step = df.withColumn(t, text_or_empty(f"`{text}`"))
    step = step.withColumn(w, F.array_remove(F.split(t, "[ \\t-\\r]+"), ""))
    lines = F.filter(F.split(t, "\n", -1), lambda x: x.rlike(r"[^ \t-\r]"))
    n = F.size(w)
    windows = F.when(n < 3, F.array().cast("array<bigint>")).otherwise(F.transform(F.slice(w, 3, F.greatest(n - 2, F.lit(0))), lambda x, i: F.xxhash64(F.get(w, i), F.get(w, i + 1), x)))
    step = step.withColumn(tri, windows).withColumn(ln, lines)
    word_chars = F.length(F.regexp_replace(t, "[ \\t-\\r]+", ""))
    symbols = F.regexp_count(t, F.lit(f"[{SYMBOLS}]"))
    stops = [x for s in STOP_WORDS for x in (s, s.capitalize())]
    n_lines = F.size(ln)
    base = {
        "n_words": n.cast("long"),
        "word_chars": word_chars.cast("long"),
        "n_symbols": symbols.cast("long"),
        "n_dup_lines": (n_lines - F.size(F.array_distinct(ln))).cast("long"),
        "n_repeat_words": _repeat_words(F.col(w), F.col(tri), n),
        "n_lines": n_lines.cast("long"),
        "_stops": F.size(F.filter(w, lambda x: x.isin(stops))),
        "_bullets": F.size(F.filter(ln, lambda x: x.rlike(r"^[ \t]*[-*•]"))),
        "_ellipses": F.size(F.filter(ln, lambda x: x.rlike(r"(\.\.\.|…)[ \t\r]*$"))),
    }
    held = [c for c in df.columns if c.lower() not in base and c.lower() not in {r.measure for r in RULES}]
    step = step.select(*[F.col(f"`{c}`") for c in held], *[v.alias(k) for k, v in base.items()])
    ratios = {
        "repeat_word_ratio": _ratio(F.col("n_repeat_words"), F.col("n_words")),
        "mean_word_chars": _ratio(F.col("word_chars"), F.col("n_words")),
        "symbol_word_ratio": _ratio(F.col("n_symbols"), F.col("n_words")),
        "stop_word_ratio": _ratio(F.col("_stops"), F.col("n_words")),
        "dup_line_ratio": _ratio(F.col("n_dup_lines"), F.col("n_lines")),
        "bullet_line_ratio": _ratio(F.col("_bullets"), F.col("n_lines")),
        "ellipsis_line_ratio": _ratio(F.col("_ellipses"), F.col("n_lines")),
    }
    return step.withColumns(ratios).drop("_stops", "_bullets", "_ellipses")


def verdict(rules: tuple[Rule, ...] = RULES) -> Column:
    """The threshold table as one condition over the measures."""
    out = F.lit(True)
    for r in rules:
        if r.low is not None:
            out = out & (F.col(r.measure) >= F.lit(r.low))
        if r.high is not None:
            out = out & (F.col(r.measure) <= F.lit(r.high))
    return out


def judged(df: DataFrame, doc_id: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """doc_id, the base counts, base_failed and kept; a row for each input row, repeated ones included."""
    own = measured(df.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return own.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & verdict(rules)).alias("kept"))


def _sql() -> str:
    stops = ", ".join("'" + x + "'" for s in STOP_WORDS for x in (s, s.capitalize()))
    word = "[^\\x20\\x09-\\x0D]+"
    return f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '{word}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{word}')) AS ln FROM d),
t AS (SELECT r, i, w[i:i+2] AS tri FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM w)),
m AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, tri) AS c FROM t) WHERE c > 1),
p AS (SELECT r, count(DISTINCT k) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS k FROM m) GROUP BY r),
b AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars,
        CAST(length(text) - length(regexp_replace(text, '[{SYMBOLS}]', '', 'g')) AS BIGINT) AS n_symbols,
        CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines, coalesce(p.n, 0) AS n_repeat_words, len(ln) AS n_lines,
        len(list_filter(w, lambda x: x IN ({stops}))) AS stops,
        len(list_filter(ln, lambda x: regexp_matches(x, '^[ \\t]*[-*•]'))) AS bullets,
        len(list_filter(ln, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[ \\t\\r]*$'))) AS ellipses
      FROM w LEFT JOIN p ON w.r = p.r),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars BETWEEN 3 * n_words AND 10 * n_words AND 10 * n_symbols <= n_words AND 100 * stops >= 2 * n_words
  AND 2 * n_dup_lines <= n_lines AND 10 * bullets <= 9 * n_lines AND 10 * ellipses <= 3 * n_lines AS kept
FROM f
"""


SQL = _sql()
