"""The same steps and windows over a stream as over a table."""

from __future__ import annotations

from pyspark.sql import functions as F

from caseforge.plans.flow import Sequence
from caseforge.streaming import monitor

from .conftest import SMALL


def run(stream, name, mode):
    q = stream.writeStream.format("memory").queryName(name).outputMode(mode).start()
    q.processAllAvailable()
    q.stop()


def test_steps_apply_to_a_stream(spark, tmp_path):
    long = spark.range(200).select(F.col("id").alias("case_id"), F.lit("x").alias("feat"), (F.col("id") % 17).cast("double").alias("value"))
    long.write.parquet(str(tmp_path / "in"))
    sequence = Sequence(["impute", "standardise"], ["feat"]).fit(long.filter("case_id % 2 = 0"))
    sequence.save(str(tmp_path / "steps"))
    again = Sequence.load(spark, str(tmp_path / "steps"), ["impute", "standardise"], ["feat"])
    stream = spark.readStream.schema(long.schema).parquet(str(tmp_path / "in"))
    run(again.apply(stream), "steps", "append")
    assert spark.table("steps").exceptAll(sequence.apply(long)).count() == 0 and spark.table("steps").count() == 200


def test_windows_of_a_stream(spark, tmp_path):
    events = spark.read.parquet(f"{SMALL}/events.parquet").withColumn("hit", F.col("event_type") == "error")
    events.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    run(monitor.window_counts(stream, "ts", "hit", "value", late="1 day"), "windows", "complete")
    assert spark.table("windows").exceptAll(monitor.window_counts(events, "ts", "hit", "value")).count() == 0
