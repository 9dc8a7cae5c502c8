"""What the text operators share: row keys, held-out folds and tables written to the shared folder."""

from __future__ import annotations

import contextlib
import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space that separates words: space, tab, line feed, vertical tab, form feed, return.
SPACES = " \t\n\x0b\x0c\r"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def fold_of(doc_id: str, folds: int) -> Column:
    """crc32 of the id's decimal text, modulo the number of folds; null ids count as fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % F.lit(folds), F.lit(0))


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir. Where it is unset, a local session makes its own; a cluster fails."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    master = spark.sparkContext.master
    if master != "local" and not master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="caseforge-")
    return f"file://{_own}"


_own = ""


def portions(column: pa.Array, most: int) -> Iterator[tuple[int, list[str]]]:
    """Texts of an Arrow column by portions of about `most` characters: the first one's place, and the texts. One text is never cut."""
    at = 0
    while at < len(column):
        texts, held = [], 0
        while at + len(texts) < len(column) and held < most:
            texts.append(column[at + len(texts)].as_py())
            held += len(texts[-1])
        yield at, texts
        at += len(texts)


def trimmed(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """The same function of batches; what it has freed goes back to the system at its end, since a Python worker outlives its task."""

    def whole(batches: Iterator) -> Iterator:
        try:
            yield from run(batches)
        finally:
            pa.default_memory_pool().release_unused()
            with contextlib.suppress(OSError, AttributeError):  # not glibc
                ctypes.CDLL(None).malloc_trim(0)

    return whole


@contextlib.contextmanager
def settings(spark: SparkSession, **values: str) -> Iterator[None]:
    """Session settings (their names' dots as double underscores) that hold for a while."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def written(df: DataFrame, name: str, tidy: bool = False, rows: int | None = None) -> tuple[DataFrame, str]:
    """Writes a table to the shared folder and reads it again: lineage ends there, and its size is known.

    tidy: the shuffle files of the writing go at its end, not when the driver happens to collect garbage.
    rows: Python workers get batches of so many rows at most, for tables of large cells.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    own = {"spark__sql__classic__shuffleDependency__fileCleanup__enabled": "true"} if tidy else {}
    own |= {"spark__sql__execution__arrow__maxRecordsPerBatch": str(rows)} if rows else {}
    with settings(spark, **own):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path), path


def removed(spark: SparkSession, path: str) -> None:
    """Deletes a written table that nothing reads any more."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def table_bytes(spark: SparkSession, path: str) -> int:
    """Bytes of a written table, for decisions that need a proven size."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(where).getLength()


def free_name(df: DataFrame, name: str) -> str:
    """A column name that the table doesn't use (names are compared without case, as Spark does)."""
    used = {c.lower() for c in df.columns}
    while name.lower() in used:
        name += "_"
    return name
