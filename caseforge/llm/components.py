"""Connected components of an edge table by alternating large and small stars.

Each round is a pair of aggregations and joins; its edges are written to the shared folder,
so a lost executor costs one round at most. A node with very many neighbours is one key of
a join whose other side is a written table with one row for it, so Spark can split its rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import removed, table_bytes, written

ROUNDS = 60
#: Bytes of a written edge table up to which one task settles it at once, without rounds.
SMALL_BYTES = 4 << 20


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, root) of all edges of a small table, by minima that spread and pointers that jump."""
    table = pa.Table.from_batches(batches, schema=pa.schema([("a", pa.int64()), ("b", pa.int64())]))
    if not table.num_rows:
        return
    names, at = np.unique(np.concatenate([table.column(k).to_numpy() for k in (0, 1)]), return_inverse=True)
    a, b = at[: table.num_rows], at[table.num_rows :]
    root = np.arange(len(names))
    while True:
        x, y = root[a], root[b]
        apart = x != y
        if not apart.any():
            break
        np.minimum.at(root, np.maximum(x, y)[apart], np.minimum(x, y)[apart])
        while not np.array_equal(up := root[root], root):
            root = up
    for k in range(0, len(names), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(names[k : k + 100_000]), pa.array(names[root[k : k + 100_000]])], names=["node", "root"])


def _large_star(edges: DataFrame) -> tuple[DataFrame, str]:
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least, path = written(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("of"), F.least("a", "m").alias("m")), "least")
    return both.filter("b > a").join(least, F.col("a") == F.col("of")).select(F.col("b").alias("a"), F.col("m").alias("b")), path


def _small_star(edges: DataFrame) -> tuple[DataFrame, str]:
    down = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b")
    least, path = written(down.groupBy("a").agg(F.min("b").alias("m")).withColumnRenamed("a", "of"), "least")
    moved = down.join(least, F.col("a") == F.col("of")).filter("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return moved.unionByName(least.select(F.col("of").alias("a"), F.col("m").alias("b"))).distinct(), path


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of each node that has an edge; the root is the component's least node, with itself as root.

    edges: columns a and b of one ordered type. Loops and repeated edges are harmless, rows with a
    null are left out; an empty table gives an empty result. Tables of earlier rounds are deleted.
    A table of long ids whose files are small (checked) is settled by one task, with the same result.
    """
    spark = edges.sparkSession
    now, path = written(edges.select("a", "b").filter("a <> b"), "edges")
    if table_bytes(spark, path) <= SMALL_BYTES and dict(now.dtypes) == {"a": "bigint", "b": "bigint"}:
        return now.coalesce(1).mapInArrow(_settled, "node long, root long")
    before = None
    for _ in range(ROUNDS):
        large, large_least = _large_star(now)
        small, small_least = _small_star(large)
        new, new_path = written(small, "edges")
        for old in (path, large_least, small_least):
            removed(spark, old)
        now, path = new, new_path
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(20,0)"))).first()
        if mark == before:
            break
        before = mark
    else:
        raise RuntimeError(f"components haven't settled in {ROUNDS} rounds")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
