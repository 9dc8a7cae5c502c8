"""The text operators against brute force, on small tables with the awkward rows, and on the smallest driver tables."""

from __future__ import annotations

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from caseforge.llm import components, language_id, line_dedup, media_copies, mixing, near_copies, quality_rules, queries, sentencepiece_codec, sharding, simhash, suffix_dedup, toxicity

from ..conftest import SMALL, tidy

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and long texts, ties, repeated rows, columns with clashing names."""
    rng = random.Random(3)
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta"]) + str(rng.randrange(50)) for _ in range(4000))
    base = "the quick brown fox jumps over the lazy dog and runs away from it\n" * 9
    rows = [
        (1, None, None, None, None), (2, "", "en", "a", 0), (3, "   \n\t ", "en", "a", 6), (4, long, "en", "a", len(long)), (5, base, "en", "b", 1), (5, base, "en", "b", 1),
        (None, base, None, "b", 1), (6, "x" * 900 + long[:700], "en", "a", 1), (7, "日本𠀀 é\x00 ▁▁a", "fr", None, 1), (8, long[:800] + " tail", "en", "a", 1), (9, "a b", "en", "a", 1), (10, "A B", "en", "a", 1),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    return df.withColumn("size", F.lit(1)).withColumn("score", F.lit("mine")).withColumn("_text", F.lit(2)).withColumn("copies", F.lit(3))


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


def texts_of(df):
    return [(r["doc_id"], r["text"] or "") for r in df.select("doc_id", "text").collect()]


# ---- 1
@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_path())


def test_codec_equals_the_library(library):
    rng = random.Random(5)
    texts = ["", " ", "  ", "a" * 3000, " " * 2000, "x" + " " * 333 + "the", "日本𠀀 é \x00 <s> ▁▁a", "\n\n a\n\tb", "== " * 300]
    texts += ["".join(rng.choice("  theandof▁=-aé日\n\t0") for _ in range(rng.randint(1, 300))) for _ in range(400)]
    model = sentencepiece_codec.model_at(queries.tokenizer_path())
    ids, at = sentencepiece_codec.Encoder(model).encode(texts)
    got = [ids[at[k] : at[k + 1]].tolist() for k in range(len(texts))]
    assert got == library.encode(texts)
    assert model.decode(ids, at) == [library.decode(x) for x in got]


def test_decode_of_any_ids(library):
    rng = random.Random(6)
    rows = [[rng.choice([0, 1, 2, *range(3, 259), 259, 261, 28705]) for _ in range(rng.randint(0, 9))] for _ in range(1500)]
    at = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    assert sentencepiece_codec.model_at(queries.tokenizer_path()).decode(np.array(sum(rows, [])), at) == [library.decode(r) for r in rows]


def test_codec_query(awkward, nothing, library):
    got = Counter((r["doc_id"], r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) for r in sentencepiece_codec.codec_digests(awkward, queries.tokenizer_path()).collect())
    want = Counter()
    for i, t in texts_of(awkward):
        ids = library.encode(t)
        want[(i, len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())] += 1
    assert got == want
    assert sentencepiece_codec.codec_digests(nothing, queries.tokenizer_path()).count() == 0
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(awkward, queries.tokenizer_path()), queries.tokenizer_path())
    assert both.filter("coalesce(replace(text, '▁', ' '), '') <> decoded").count() == 0
    assert set(awkward.columns) < set(both.columns)


# ---- 2
def test_toxicity_held_out(spark):
    sf = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    out = toxicity.judged(docs, labels).join(labels, "doc_id").toPandas()
    assert set(out.columns) >= {"doc_id", "held_out", "score", "predicted"}
    assert all(bool(h) == (zlib.crc32(str(i).encode()) % 3 == 1) for i, h in zip(out.doc_id, out.held_out, strict=True))
    test = out[out.held_out]
    assert test.predicted[test.toxic == 1].mean() > 0.7 and test.predicted[test.toxic == 0].mean() < 0.01
    assert out.score.between(0, 1).all()


def test_toxicity_learner_recovers_words():
    rng = np.random.default_rng(1)
    noise = lambda: rng.choice(np.arange(100, 400), 30, replace=False)
    bad = lambda: np.concatenate([noise(), rng.choice([1, 2, 3], 2, replace=False)])
    model = toxicity.train([bad() for _ in range(300)], [bad() if k % 10 == 0 else noise() for k in range(2000)], 0.1)
    assert {1, 2, 3} <= set(model.weights) and all(model.weights[k] > 1 for k in (1, 2, 3))


def test_toxicity_awkward(spark, awkward, nothing):
    labels = spark.createDataFrame([(1, 1), (2, 0), (4, None), (None, 1), (1, 0)], "doc_id long, toxic int")
    assert toxicity.judged(awkward, labels).count() == awkward.count()
    assert toxicity.judged(nothing, labels.limit(0)).count() == 0
    kept = toxicity.clean(awkward, toxicity.Model({}, -5.0))
    assert kept.columns == awkward.columns and kept.count() == awkward.count()


def test_evidence_counts_both_sides():
    got = toxicity.evidence(np.array([10.0, 0.0, 5.0]), np.array([0.0, 10.0, 50.0]), 100, 1000)
    assert got[0] > 12 and got[2] == pytest.approx(0) and got[1] > 0


# ---- 3
def test_line_dedup(spark, duck, nothing):
    df = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "source", "text")
    assert tidy(line_dedup.dedup_lines(df).toPandas()).equals(tidy(duck.sql(line_dedup.SQL).df()))
    assert line_dedup.dedup_lines(nothing).count() == 0


@pytest.mark.parametrize("limit", [0, 1 << 24])
def test_line_dedup_awkward(awkward, monkeypatch, limit):
    monkeypatch.setattr(line_dedup, "BROADCAST_BYTES", limit)
    out = line_dedup.dedup_lines(awkward, ratio=0.5, least_pages=2)
    rows = {(r["doc_id"], r["source"]): r for r in out.collect()}
    assert out.count() == awkward.count() and set(awkward.columns) < set(out.columns)
    assert rows[(1, None)]["text"] is None and rows[(1, None)]["n_lines"] == 0
    assert rows[(5, "b")]["text"] == "" and rows[(5, "b")]["n_dropped"] == 9
    assert rows[(9, "a")]["text"] == "a b"


def test_line_dedup_keeps_blank_lines_and_takes_hosts(spark):
    lines = "menu\n\t\n\r\n  \nown "
    pages = [(i, f"https://{'WWW.a.org' if i < 30 else 'b.org'}/{i}", (lines if i < 30 else "menu\nown ") + str(i)) for i in range(33)]
    own = spark.createDataFrame(pages, "page_id long, url string, n_lines string").withColumn("host", line_dedup.host_of(F.col("url"))).withColumnRenamed("n_lines", "text")
    out = {r["page_id"]: r for r in line_dedup.dedup_lines(own.withColumn("n_lines", F.lit("clash")), host="host", least_pages=4).collect()}
    assert out[3]["host"] == "www.a.org" and out[3]["text"] == "\t\n\r\n  \nown 3" and out[3]["n_dropped"] == 1
    assert out[31]["text"] == "menu\nown 31" and out[31]["n_lines"] == 2


# ---- 4
def test_language_held_out(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    out = language_id.identified(docs, language_id.fit(docs)).join(docs.select("doc_id", "lang"), "doc_id").toPandas()
    test = out[out.held_out]
    assert (test.lang_pred == test.lang).mean() > 0.97 and out.score.between(0, 1).all()


def test_language_mixture():
    a, b = Counter(), Counter()
    for w in ("baba", "bobo", "abab"):
        a.update({g: 50 for g in language_id._grams(w)})
    for w in ("zuzu", "zizi", "uzuz"):
        b.update({g: 50 for g in language_id._grams(w)})
    identify = language_id.Identifier(language_id.build({"x": a, "y": b}))
    names, score, size = identify(["baba bobo " * 20, "baba bobo " * 30 + "zuzu zizi " * 10, "", "123 !"])
    assert names == ["x", "x", "und", "und"] and size.tolist() == [1, 2, 0, 0]
    assert score[0] == pytest.approx(1) and score[1] == pytest.approx(0.75, abs=0.02) and score[2] == 0


def test_language_awkward(awkward, nothing):
    out = language_id.identified(awkward, language_id.fit(awkward)).collect()
    assert len(out) == awkward.count() and {r["lang_pred"] for r in out if r["doc_id"] in (1, 2, 3)} == {"und"}
    assert language_id.identified(nothing, language_id.fit(nothing)).count() == 0


def test_language_needs_letters():
    model = language_id.build({"x": Counter({"^ab": 9, "ab$": 9}), "y": Counter({"^cd": 9, "cd$": 9})})
    names, score, _ = language_id.Identifier(model)(["½ ² Ⅷ ①", "ab½ab", "_ 1"])
    assert names == ["und", "x", "und"] and score[0] == 0
    assert language_id.words_of("Ab½ab 3x") == Counter({"ab": 2, "x": 1})


def test_language_pieces_change_nothing(monkeypatch):
    rng = np.random.default_rng(9)
    model = language_id.build({k: Counter({f"{a}{b}{c}": int(n) for a, b, c, n in zip(*rng.choice(list("abc^$"), (3, 40)), rng.integers(1, 50, 40), strict=True)}) for k in "uvw"})
    texts = [" ".join("".join(rng.choice(list("abc"), 4)) for _ in range(n)) for n in (1, 50, 300, 2)]
    whole = language_id.Identifier(model)(texts)
    monkeypatch.setattr(language_id, "PIECE", 30)
    cut = language_id.Identifier(model)(texts)
    assert whole[0] == cut[0] and np.allclose(whole[1], cut[1]) and (whole[2] == cut[2]).all()


# ---- 5
def test_mixing_equals_sql(spark, duck):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert tidy(mixing.mix(df).toPandas()).equals(tidy(duck.sql(mixing.SQL).df()))


def test_mixing_laws(spark):
    out = mixing.mix(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").withColumn("size", F.lit("clash"))).toPandas()
    assert ((out.copies >= 0) & (out.copies <= 3)).all() and (out.target <= 3 * out.source_size + 1e-6).all()
    total = out.drop_duplicates(["source_size", "target"])
    assert total.target.sum() == pytest.approx(total.source_size.sum())


def test_mixing_awkward(awkward, nothing):
    out = mixing.mix(awkward)
    assert out.count() == awkward.count() and mixing.mix(nothing).count() == 0
    again = mixing.mix(awkward.repartition(7))
    assert tidy(out.toPandas()).equals(tidy(again.toPandas()))
    sent = mixing.emitted(awkward)
    assert sent.columns == awkward.columns and sent.count() == out.agg(F.sum("copies")).first()[0]


def test_mixing_reruns_agree_whatever_the_ids(spark):
    rows = [(7 if i % 2 else None, "w " * (i % 17 + 1) + str(i), "s") for i in range(200)] + [(1, "z " * 40, "t")] * 9
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    runs = [tidy(mixing.mix(df.repartition(n)).toPandas()) for n in (1, 3, 8)]
    assert all(r.equals(runs[0]) for r in runs)
    sent = [Counter(tuple(r) for r in mixing.emitted(df.repartition(n)).collect()) for n in (2, 5)]
    assert sent[0] == sent[1]
    sizes = mixing.mix(df).groupBy("source_size", "target").agg(F.sum("taken").alias("t")).collect()
    assert all(abs(r["t"] - r["target"]) <= 120 for r in sizes)


# ---- 6
def test_media_copies(spark):
    rng = np.random.default_rng(2)
    pictures = [media_copies.draw((v / 8).tolist()) for v in rng.normal(size=(120, 64))]
    code = lambda m: media_copies.encode_pgm(np.round(m))
    rows = [(2 * i, code(m)) for i, m in enumerate(pictures)] + [(2 * i + 1, code(media_copies.edited(m, media_copies.EDITS[i % 6]))) for i, m in enumerate(pictures)]
    rows += [(1000, rows[4][1]), (1001, None), (1002, b""), (1003, b"no image"), (1001, None), (None, b"no image either")]
    own = spark.createDataFrame([(*r, "x") for r in rows], "media_id long, media binary, readable string")
    out = media_copies.copies(own).collect()
    classes = {r["media_id"]: r["class_id"] for r in out}
    assert len(out) == len(rows)
    caught = Counter(media_copies.EDITS[i % 6] for i in range(120) if classes[2 * i + 1] == 2 * i)
    assert all(caught[e] >= 17 for e in media_copies.EDITS) and sum(caught.values()) >= 114, caught
    assert all(classes[2 * i + 1] in (2 * i, 2 * i + 1) and classes[2 * i] == 2 * i for i in range(120))
    assert classes[1000] == 8 and classes[1001] == classes[1002] == 1001 and classes[1003] == 1003 and classes[None] is None
    assert {r["media_id"] for r in out if not r["readable"]} == {1001, 1002, 1003, None}
    assert media_copies.copies(spark.createDataFrame([], "media_id long, media binary")).count() == 0


def test_media_pairs_of_long_entries(spark, monkeypatch):
    """With entries of two corners only, longer ones go through wider keys, the star and the chain."""
    monkeypatch.setattr(media_copies, "ENTRY", 2)
    picture = media_copies.draw((np.random.default_rng(4).normal(size=64) / 8).tolist())
    rows = [(i, media_copies.encode_pgm(np.clip(np.round(picture + 2 * i), 0, 255))) for i in range(9)]
    out = media_copies.copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {r["class_id"] for r in out} == {0} and all(r["n_links"] > 0 for r in out)


def test_media_pairs_of_long_entries_are_all_found(spark):
    """Twelve pictures that differ by brightness share entries of twelve corners: each is a copy of all others."""
    picture = media_copies.draw((np.random.default_rng(4).normal(size=64) / 8).tolist())
    rows = [(i, media_copies.encode_pgm(np.clip(np.round(picture + i), 0, 255))) for i in range(12)]
    out = media_copies.copies(spark.createDataFrame(rows, "media_id long, media binary")).collect()
    assert {(r["class_id"], r["n_links"]) for r in out} == {(0, 11)}


def test_trimmed_gives_memory_back():
    """Blocks below a live one stay with the process until they are trimmed."""
    from caseforge.llm.common import trimmed

    held = lambda: int(open("/proc/self/statm").read().split()[1]) * 4096
    live = []

    def run(batches):
        for n in batches:
            blocks = [np.ones(8000) for _ in range(4000)]
            live.append(np.ones(8000))
            yield n + len(blocks)

    before = held()
    assert list(trimmed(run)(iter([1]))) == [4001] and live
    assert held() - before < 64e6


def test_media_keys_of_a_large_batch_come_in_portions():
    one = np.zeros(20, dtype=media_copies._CORNER)
    one["y"], one["bits"][:, 0] = np.arange(20), np.arange(20)
    batch = pd.DataFrame({"fid": range(3000), "corners": [one.tobytes()] * 2999 + [np.tile(one, 1000).tobytes()]})
    parts = list(media_copies._keyed(iter([batch]), True))
    assert sum(map(len, parts)) == (2999 * 20 + 20_000) * media_copies.TABLES
    assert max(map(len, parts[:-1])) <= media_copies.CORNERS * media_copies.TABLES and len(parts[-1]) == 20_000 * media_copies.TABLES
    whole = pd.concat(parts)
    assert whole.groupby(whole["mark"].to_numpy() >> media_copies._GEO).size().tolist() == [160] * 2999 + [160_000]


def test_media_pairing_leaves_no_shuffle_files(spark):
    """The keys' exchange is as large as all that follows: it must not stay on disk beside it."""
    rng = np.random.default_rng(5)
    pictures = np.stack([np.round(media_copies.draw((v / 8).tolist())) for v in rng.normal(size=(6, 64))]).astype(np.float32)
    which, *columns = media_copies.corners_of(np.concatenate([pictures, pictures * 0.9]))
    rows = [(i, media_copies._packed(*(c[which == i] for c in columns))) for i in range(12)]
    features = spark.createDataFrame(rows, "fid long, corners binary")
    held = lambda: sum(str(f).split("/")[-1].startswith("shuffle_") for f in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles()))
    before = held()
    assert {(r["a"], r["b"]) for r in media_copies.candidate_pairs(features).collect()} >= {(i, i + 6) for i in range(6)}
    assert held() <= before


def test_written_by_small_batches(spark):
    """Pictures reach a Python worker by batches of few rows; the session's own setting stays."""
    from caseforge.llm.common import written

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name, None)
    sizes = spark.range(0, 1000, 1, 2).mapInPandas(lambda it: (pd.DataFrame({"n": [len(p)]}) for p in it), "n long")
    got = [r["n"] for r in written(sizes, "sizes", rows=70)[0].collect()]
    assert sum(got) == 1000 and max(got) == 70 and spark.conf.get(name, None) == before


def test_media_places_that_agree():
    """Two places told of a pair, under about the same turn and scale, make a candidate; turns meet at their ends."""
    rng = np.random.default_rng(6)
    n = 4000
    a, b, place, turn, level = rng.integers(0, 30, n), rng.integers(30, 60, n), rng.integers(0, 9, n), rng.integers(0, 32, n), rng.integers(40, 90, n)
    order = np.lexsort((b, a))
    a, b, place, turn, level = (v[order] for v in (a, b, place, turn, level))
    told = place << 12 | turn << 7 | level
    batches = [pa.RecordBatch.from_arrays([pa.array(v[k : k + 700]) for v in (a, b, told)], names=["a", "b", "told"]) for k in range(0, n, 700)]
    wanted = {
        (a[i], b[i]) for i in range(n) for j in range(i + 1, min(i + 40, n))
        if (a[i], b[i]) == (a[j], b[j]) and place[i] != place[j] and min((turn[i] - turn[j]) % 32, (turn[j] - turn[i]) % 32) <= 3 and abs(level[i] - level[j]) <= 2
    }
    for held in (media_copies.HELD, 50):
        with pytest.MonkeyPatch.context() as patch:
            patch.setattr(media_copies, "HELD", held)
            got = [(r["a"], r["b"]) for o in media_copies._agreed(iter(batches)) for r in o.to_pylist()]
        assert len(got) == len(set(got)) and set(got) == wanted


def test_media_of_any_size():
    assert media_copies.corners_of(np.zeros((1, 5, 5), dtype=np.float32))[0].size == 0
    large = np.kron(media_copies.draw(list(np.linspace(-0.2, 0.2, 64))), np.ones((16, 16)))[None].astype(np.float32)
    assert len(media_copies.corners_of(large)[0]) > 20


def test_png_decodes():
    import struct

    grey = (np.arange(40 * 30).reshape(40, 30) % 251).astype(np.uint8)
    chunk = lambda k, d: struct.pack(">I", len(d)) + k + d + struct.pack(">I", zlib.crc32(k + d))
    up = np.vstack([grey[:1], np.diff(grey.astype(int), axis=0).astype(np.uint8)])
    raw = b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 30, 40, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(b"".join(b"\x02" + r.tobytes() for r in up))) + chunk(b"IEND", b"")
    assert (media_copies.decode_image(raw) == grey).all()
    assert media_copies.decode_image(raw[:50]) is None


# ---- 7
def test_quality_rules_equal_sql(spark, duck):
    assert tidy(quality_rules.judged(spark.read.parquet(f"{SMALL}/documents.parquet")).toPandas()).equals(tidy(duck.sql(quality_rules.SQL).df()))


def test_quality_rules_by_hand(spark, awkward, nothing):
    out = {r["doc_id"]: r for r in quality_rules.judged(spark.createDataFrame([(1, "a b c a b c d"), (2, None), (3, "a a a a"), (4, "# x\n# x\n\n \n$")], "doc_id long, text string")).collect()}
    assert [out[1][c] for c in ("n_words", "n_repeat_words", "word_chars")] == [7, 6, 7]
    assert [out[2][c] for c in ("n_words", "n_repeat_words", "base_failed", "kept")] == [0, 0, True, False]
    assert out[3]["n_repeat_words"] == 4 and out[4]["n_dup_lines"] == 1 and out[4]["n_symbols"] == 3
    assert quality_rules.judged(awkward).count() == awkward.count() and quality_rules.judged(nothing).count() == 0


# ---- 8
def check_shards(rows, texts):
    n = Counter(r["shard"] for r in rows)
    assert max(n.values()) - min(n.get(k, 0) for k in range(16)) <= 1
    for k in n:
        assert sorted(r["slot"] for r in rows if r["shard"] == k) == list(range(n[k]))
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in rows) == Counter((i, len(t.encode()) + 1, zlib.crc32(t.encode())) for i, t in texts)


def test_sharding(spark):
    df = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows, texts = sharding.shard(df).collect(), texts_of(df)
    check_shards(rows, texts)
    by_id = dict(texts)
    spread: dict[str, set] = {}
    for r in rows:
        spread.setdefault(by_id[r["doc_id"]], set()).add(r["shard"])
    groups = [t for t, c in Counter(t for _, t in texts).items() if c > 1]
    assert all(len(spread[t]) == 1 for t in groups)


def test_sharding_awkward_and_hot(spark, awkward, nothing):
    check_shards(sharding.shard(awkward).collect(), texts_of(awkward))
    assert sharding.shard(nothing).count() == 0
    hot = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.lit("same")).otherwise(F.col("id").cast("string")).alias("text")).withColumnRenamed("id", "doc_id")
    check_shards(sharding.shard(hot).collect(), texts_of(hot))


def test_sharding_gathers_hot_groups(spark):
    """Quota 375: 2,000 equal texts take 6 shards, 300 others one."""
    text = F.when(F.col("id") % 3 == 0, F.lit("hot")).when(F.col("id") % 20 == 1, F.lit("warm")).otherwise(F.col("id").cast("string"))
    df = spark.range(6000).select(F.col("id").alias("doc_id"), text.alias("text"))
    rows, by_id = sharding.shard(df).collect(), dict(texts_of(df))
    check_shards(rows, texts_of(df))
    spread = {name: len({r["shard"] for r in rows if by_id[r["doc_id"]] == name}) for name in ("hot", "warm")}
    assert spread == {"hot": 6, "warm": 1}


# ---- 9
def slow_fingerprint(t, k=4):
    w = t.encode().lower().split()
    if not w:
        return 0
    shingles = [b" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(prints, bits=4):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= bits:
                a, b = sorted((root(i), root(j)))
                label[b] = a
    return [root(i) for i in range(len(prints))]


def test_simhash_equals_brute_force(spark, awkward):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), awkward):
        texts = texts_of(df)
        prints = [slow_fingerprint(t) for _, t in texts]
        roots = slow_components(prints)
        least: dict[int, int] = {}
        for (i, _), r in zip(texts, roots, strict=True):
            if i is not None:
                least[r] = min(least.get(r, i), i)
        want = Counter((i, f"{p:016x}", least.get(r)) for (i, _), p, r in zip(texts, prints, roots, strict=True))
        assert Counter(tuple(r) for r in simhash.near_duplicates(df).collect()) == want


@pytest.mark.parametrize("small", [0, 1 << 22])
def test_trie_links_on_clusters(spark, monkeypatch, small):
    monkeypatch.setattr(components, "SMALL_BYTES", small)
    rng = random.Random(8)
    prints = [rng.getrandbits(64) for _ in range(150)]
    for p in list(prints[:40]):
        for _ in range(6):
            p ^= 1 << rng.randrange(64)
            p ^= 1 << rng.randrange(64)
            prints.append(p)
    prints = sorted(set(prints))
    signed = [p - (1 << 64) if p >> 63 else p for p in prints]
    found = simhash.components(simhash.links(spark.createDataFrame([(p, p) for p in signed], "fp long, name long"), 4, 3, 8)).collect()
    got = {r["node"]: r["root"] for r in found}
    roots = slow_components(prints)
    groups: dict[int, set] = {}
    for p, r in zip(signed, roots, strict=True):
        groups.setdefault(r, set()).add(p)
    for g in groups.values():
        assert {got.get(p, p) for p in g} == {min(g)}


def test_simhash_stage_keeps_one(awkward, nothing):
    kept = simhash.deduplicated(awkward)
    assert kept.columns == awkward.columns
    ids = sorted(r["doc_id"] for r in kept.collect())
    assert ids == sorted(set(ids)) and 5 in ids and simhash.near_duplicates(nothing).count() == 0


def test_simhash_stage_keeps_texts_without_own_ids(spark):
    rng = random.Random(5)
    texts = [" ".join(rng.choice("abcdefgh") * 3 + str(rng.randrange(900)) for _ in range(60)) for _ in range(8)]
    rows = [(None, t) for t in texts[:4]] + [(7, t) for t in texts[4:]] + [(None, texts[0]), (3, texts[0]), (7, texts[5])]
    kept = simhash.deduplicated(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter(tuple(r) for r in kept) == Counter([(3, texts[0]), *[(None, t) for t in texts[1:4]], *[(7, t) for t in texts[4:]]])


def slow_near_groups(texts):
    """Root of each text under links of five-word Jaccard similarity >= 0.8; all pairs."""
    runs = [frozenset(" ".join(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if (w := t.lower().split()) else frozenset() for _, t in texts]
    root = list(range(len(runs)))
    for i, a in enumerate(runs):
        for j, b in enumerate(runs[:i]):
            if a == b or (5 * min(len(a), len(b)) >= 4 * max(len(a), len(b)) and 5 * len(a & b) >= 4 * len(a | b)):
                x, y = root[i], root[j]
                root = [min(x, y) if r in (x, y) else r for r in root]
    return root


def test_near_copies_equal_brute_force(spark):
    rng = random.Random(6)
    base = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(120)]
    rows = [(i, t) for i, t in enumerate(["", None, " a  B", "A b", "a b c"])]
    for i in range(60):
        words = list(base)
        for _ in range(rng.randrange(8)):
            words[rng.randrange(120)] = f"x{rng.randrange(9999)}"
        rows.append((100 + i if i % 3 else None, " ".join(words)))
    own = spark.createDataFrame(rows, "doc_id long, text string")
    for df in (own, spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")):
        texts = texts_of(df)
        by_root: dict[int, list] = {}
        for (i, t), r in zip(texts, slow_near_groups(texts), strict=True):
            by_root.setdefault(r, []).append((i, t))
        kept = Counter((r["doc_id"], r["text"] or "") for r in near_copies.deduplicated(df).collect())
        assert sum(kept.values()) == len(by_root)
        group_of = {row: r for r, g in by_root.items() for row in g}
        assert len({group_of[row] for row in kept}) == len(by_root)
        for row in kept:
            ids = [i for i, _ in by_root[group_of[row]] if i is not None]
            assert row[0] == (min(ids) if ids else None)


def test_near_copies_in_large_clusters(spark, monkeypatch):
    """Few pivots and members a task: several rounds, several salts, the same groups."""
    rng = random.Random(7)
    base = [rng.choice("abcdefgh") + str(rng.randrange(900)) for _ in range(150)]
    rows = []
    for i in range(50):
        words = list(base)
        for _ in range(rng.randrange(1, 14)):
            words[rng.randrange(150)] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(words)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(near_copies, "SMALL", 3)
    monkeypatch.setattr(near_copies, "FIRST", 2)
    monkeypatch.setattr(near_copies, "PIVOTS", 30)
    monkeypatch.setattr(near_copies, "SPREAD", 15)
    groups: dict[int, set] = {}
    for r in near_copies.groups(df).collect():
        groups.setdefault(r["group"], set()).add(r["doc_id"])
    want: dict[int, set] = {}
    for (i, _), r in zip(rows, slow_near_groups(rows), strict=True):
        want.setdefault(r, set()).add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_near_copies_awkward(awkward, nothing):
    kept = near_copies.deduplicated(awkward)
    assert kept.columns == awkward.columns and near_copies.deduplicated(nothing).count() == 0
    ids = [r["doc_id"] for r in kept.collect()]
    assert ids.count(5) == 1 and 1 in ids and 2 not in ids and 3 not in ids


def test_bit_counts():
    values = np.random.default_rng(1).integers(0, 1 << 63, (3, 700), dtype=np.uint64)
    want = [[int(((row >> np.uint64(k)) & np.uint64(1)).sum()) for k in range(64)] for row in values]
    assert simhash.bit_counts(values).tolist() == want


# ---- 10
def slow_removal(texts, length):
    seen: Counter = Counter()
    raws = [t.encode() for _, t in texts]
    for raw in raws:
        seen.update(raw[p : p + length] for p in range(len(raw) - length + 1))
    out = Counter()
    for (i, _), raw in zip(texts, raws, strict=True):
        gone = [False] * len(raw)
        for p in range(len(raw) - length + 1):
            if seen[raw[p : p + length]] > 1:
                gone[p : p + length] = [True] * length
        spans = sum(g and (not k or not gone[k - 1]) for k, g in enumerate(gone))
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out[(i, len(raw), sum(gone), spans, hashlib.sha256(kept).hexdigest())] += 1
    return out


def test_suffix_removal_equals_brute_force(spark, awkward):
    for df in (spark.read.parquet(f"{SMALL}/documents.parquet"), awkward):
        assert Counter(tuple(r)[:5] for r in suffix_dedup.removal_digests(df).collect()) == slow_removal(texts_of(df), 400)


def test_suffix_removal_across_many_buckets(spark, monkeypatch):
    rng = random.Random(4)
    passage = "".join(rng.choice("abcdef ") for _ in range(520))
    texts = [(i, "".join(rng.choice("abcdef ") for _ in range(rng.randrange(200))) + passage[rng.randrange(60) :] + "".join(rng.choice("ghij") for _ in range(50))) for i in range(40)]
    monkeypatch.setattr(suffix_dedup, "BUCKET_ROWS", 20)
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert Counter(tuple(r)[:5] for r in suffix_dedup.removal_digests(df).collect()) == slow_removal(texts, 400)
    kept = {r["doc_id"]: bytes(r["kept"]) for r in suffix_dedup.kept_bytes(df).collect()}
    assert all(hashlib.sha256(kept[k[0]]).hexdigest() == k[4] for k in slow_removal(texts, 400))


def test_suffix_cuts_and_portions(monkeypatch, spark):
    pairs = lambda *p: np.array(p, dtype=np.int64).tobytes()
    assert suffix_dedup._cut(b"0123456789", [pairs((1, 2)), pairs((6, 6), (2, 2))], 3) == (7, 2, b"059")
    assert suffix_dedup._cut(b"0123456789", [], 3) == (0, 0, b"0123456789")
    monkeypatch.setattr(suffix_dedup, "KEYS_HELD", 3)
    runs = [(low << 20) | (low - 5) for low in (60, 90, 120, 150)]
    text = bytes(range(256)) * 2
    whole = Counter(s for part in suffix_dedup._text_blocks(text, runs, 100) for at in part.values() for s in at)
    monkeypatch.setattr(suffix_dedup, "KEYS_HELD", 1000)
    assert whole == Counter(s for part in suffix_dedup._text_blocks(text, runs, 100) for at in part.values() for s in at)


def test_shared_folder_needs_a_shared_place():
    from types import SimpleNamespace

    from caseforge.llm.common import shared_folder

    session = lambda master, folder: SimpleNamespace(conf=SimpleNamespace(get=lambda k, d: folder), sparkContext=SimpleNamespace(master=master))
    assert shared_folder(session("spark://x", "hdfs://y/z/")) == "hdfs://y/z" and shared_folder(session("local[4]", None)).startswith("file:")
    with pytest.raises(ValueError):
        shared_folder(session("local-cluster[2,1,1000]", None))


def test_multikey_quicksort():
    rng = np.random.default_rng(3)
    keys = rng.integers(0, 4, (3000, 5)).astype(np.uint64)
    got = keys[suffix_dedup.multikey_quicksort(keys)]
    assert (got == keys[np.lexsort(keys.T[::-1])]).all()


def test_suffix_removal_of_nothing(nothing):
    assert suffix_dedup.removal_digests(nothing).count() == 0
