"""The pipeline's stages, each on its own input."""

from __future__ import annotations

import corpus_pipeline
from caseforge.llm.common import written

from ..conftest import SMALL


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs, _ = written(stage(spark, docs, SMALL), name)
        counts.append(docs.count())
        if name != corpus_pipeline.STAGES[-1][0]:
            assert docs.columns == columns
        if name == "simhash":
            assert docs.select("doc_id").distinct().count() == counts[-1] < counts[-2]
    assert 0.7 * counts[0] < counts[1] <= counts[0] and counts[2] == counts[1] and counts[4] > 0
    assert docs.filter("n_tokens <> size(ids) or decoded is null").count() == 0
    assert corpus_pipeline.run(spark, SMALL).count() == counts[-1]


def test_stages_on_awkward_rows(spark):
    """Nulls in every column, empty texts, repeated rows and ids: every stage gives its defined result."""
    text = "some plain words that stand here for a text of its own number "
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (2, text * 3, "en", "a", 9), (2, text * 3, "en", "a", 9), (None, text + "one", "en", "a", 5), (None, text + "two three", "en", "b", 5), (3, None, "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for data in (docs, docs.limit(0)):
        own = data
        for name, stage in corpus_pipeline.STAGES:
            own, _ = written(stage(spark, own, SMALL), name)
            if name in ("toxicity", "line_dedup"):
                assert own.count() == data.count()
            if name == "simhash" and data is docs:
                assert sorted((r["doc_id"] or 0, r["text"] or "") for r in own.collect()) == [(0, text + "one"), (0, text + "two three"), (1, ""), (2, text * 3)]
    assert own.count() == 0


def test_near_copy_stage_meets_five_words(spark):
    """6 bits apart as SimHash, at 0.815 by five-word shingles."""
    words = [f"w{i * 7919 % 1000}" for i in range(200)]
    edits = [" ".join(f"x{i}" if i in at else w for i, w in enumerate(words)) for at in ((), (20, 60, 90, 150))]
    docs = spark.createDataFrame(list(enumerate(edits)), "doc_id long, text string")
    assert [r["doc_id"] for r in corpus_pipeline.drop_near_copies(spark, docs, SMALL).collect()] == [0]
