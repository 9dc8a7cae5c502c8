"""Hand-computed values of the definitions that differ from the textbook, and properties of folds and steps."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from caseforge.operators import folds, metrics, order, prep, rank, significance, stats


def col(df, name, by):
    return [r[name] for r in df.orderBy(by).collect()]


@pytest.fixture(scope="module")
def f1(spark):
    y, p = [1, 1, 1, -1, -1, -1, 1, 0], [0.9, 0.4, -0.2, -0.7, 0.3, -0.1, 0.0, 0.8]
    return spark.createDataFrame([(1, a, b) for a, b in zip(y, p, strict=True)], "g int, y int, score double")


@pytest.mark.parametrize(
    ("name", "value"),
    [("accuracy", 57.142857142857), ("sensitivity", 66.666666666667), ("bac", 66.666666666667), ("ppv", 66.666666666667), ("fscore", 66.666666666667), ("tpr", 50), ("bac2", 44.444444444444), ("gmean", 0.666666666667), ("allparam_gmean", 1.154700538379), ("mcc", 0.333333333333), ("plr", 2), ("nlr", 2), ("nlr_standard", 0.5), ("psi", 33.333333333333), ("dor", 4)],
)
def test_measures(f1, name, value):
    got = metrics.confusion(f1, ["g"]).select(metrics.measures()[name].alias("v")).first()["v"]
    assert got == pytest.approx(value, abs=1e-9)


def test_auc(f1):
    assert metrics.auc(f1, ["g"]).first()["auc"] == pytest.approx(0.75)
    flipped = metrics.auc(f1.withColumn("score", -F.col("score")), ["g"]).first()["auc"]
    assert flipped == pytest.approx(0.25)


@pytest.fixture(scope="module")
def f2(spark):
    return spark.createDataFrame([(i, "x", float(v)) for i, v in enumerate([1, 2, 3, 10, 3])] + [(i, "c", 5.0) for i in range(5)], "case_id int, feat string, value double")


def test_scaling(f2):
    out = prep.scale(f2, prep.fit_scale(f2, ["feat"]), ["feat"])
    assert col(out.filter("feat = 'x'"), "value", "case_id") == pytest.approx([0, 1 / 9, 2 / 9, 1, 2 / 9])
    assert col(out.filter("feat = 'c'"), "value", "case_id") == [0.0] * 5


def test_standardise_and_winsorise(f2):
    x = f2.filter("feat = 'x'")
    p = prep.fit_standard(x, ["feat"])
    assert col(prep.standardise(x, p, ["feat"]), "value", "case_id") == pytest.approx([-0.785698947, -0.505092180, -0.224485413, 1.739761953, -0.224485413], abs=1e-9)
    m = prep.standardise(x, prep.fit_standard(x, ["feat"], median=True), ["feat"])
    assert col(m, "value", "case_id") == pytest.approx([-0.561213533, -0.280606767, 0, 1.964247366, 0], abs=1e-9)
    w = prep.winsorise(x, prep.fit_winsorise(x, ["feat"], 1.0), ["feat"], 1.0)
    assert col(w, "value", "case_id") == pytest.approx([-0.637746556, -0.357139789, -0.076533022, 1.147952391, -0.076533022], abs=1e-8)


def test_hazen(f2):
    r = order.hazen(f2.filter("feat = 'x'"), ["feat"], "value", [2.5, 25, 50, 75, 97.5]).first()
    assert [r[c] for c in ("p2_5", "p25", "p50", "p75", "p97_5")] == pytest.approx([1, 1.75, 3, 4.75, 10])


def test_corrections(spark):
    p = spark.createDataFrame(list(enumerate([0.01, 0.04, 0.03, 0.005, 0.5])), "test int, p double")
    assert col(significance.fdr(p, "test"), "adjusted", "test") == pytest.approx([0.025, 0.05, 0.05, 0.025, 0.5])
    assert col(significance.holm(p, "test"), "adjusted", "test") == pytest.approx([0.04, 0.09, 0.09, 0.025, 0.5])


def test_information(spark):
    rows = list(zip([0, 0, 1, 1], [0, 1, 0, 1], [0, 1, 1, 1], [0, 1, 1, 0], strict=True))
    df = spark.createDataFrame(rows, "a int, b int, c int, t int")
    got = [stats.information(df, x, "t").first()["mi"] for x in "abc"]
    assert got == pytest.approx([0, 0, 0.311278124459], abs=1e-9)
    assert stats.entropy(df, ["c"]).first()["h"] == pytest.approx(0.811278124459)


def test_f_score(spark):
    df = spark.createDataFrame([("f", float(v), y) for v, y in zip([1, 2, 3, 5, 7], [1, 1, 1, -1, -1], strict=True)], "feat string, value double, y int")
    assert rank.f_score(df, "y").first()["weight"] == pytest.approx(6.627416997970)


def test_calibration(spark):
    df = spark.createDataFrame([(1, i, p, float(l)) for i, (p, l) in enumerate(zip([0.1, 0.4, 0.35, 0.8, 0.9], [0, 1, 0, 1, 1], strict=True))], "g int, i int, p double, l double")
    r = metrics.calibration(df, ["g"], "l", "p", "i", 2).first()
    assert (r["ece"], r["brier"]) == pytest.approx((0.09, 0.1085))


def test_folds_hold_each_case_once_and_are_even(spark):
    df = spark.range(203).select(F.col("id").alias("case_id"), (F.col("id") % 3).alias("cls"))
    f = folds.stratified(df, "case_id", ["cls"], 5, 2)
    assert f.groupBy("cv2_perm", "case_id").count().filter("count <> 1").count() == 0
    n = f.groupBy("cv2_perm", "cls", "cv2_fold").count().groupBy("cv2_perm", "cls").agg((F.max("count") - F.min("count")).alias("d"))
    assert n.filter("d > 1").count() == 0


def test_scale_reverts(f2):
    p = prep.fit_scale(f2, ["feat"])
    back = prep.unscale(prep.scale(f2, p, ["feat"]), p, ["feat"])
    assert back.exceptAll(f2).count() == 0


def test_tables_read_and_write(spark, tmp_path):
    from caseforge.sources import tables

    df = spark.createDataFrame([("a", 1.0), ("b", float("nan"))], "id string, x double")
    tables.write_table(df, str(tmp_path / "t.tsv"), "tsv")
    back = tables.read_table(spark, str(tmp_path / "t.tsv"))
    assert {r["id"]: r["x"] for r in back.collect()} == {"a": 1.0, "b": None}
    with pytest.raises(ValueError, match="there twice"):
        tables.checked(df.union(df), "id", ["x"])
