"""Readers of spreadsheet, workspace, image and surface files: files are read as bytes by Spark and decoded in parallel."""

from __future__ import annotations

import gzip
import io
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _decoded(spark: SparkSession, path: str, decode, schema: str, pattern: str) -> DataFrame:
    """A row stream of every file under a path; decode(name, bytes) gives data frames."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, raw in zip(pdf["path"], pdf["content"], strict=True):
                yield from decode(name, bytes(raw))

    return files.mapInPandas(run, schema)


def _plain(raw: bytes) -> bytes:
    return gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw


def sheet_cells(raw: bytes, sheet: int = 1) -> list[list[str | None]]:
    """Cells of a spreadsheet's sheet (Office Open XML) as text; gaps are None."""
    space = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        shared = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iter(f"{space}t")) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iter(f"{space}si")]
        root = ElementTree.fromstring(z.read(f"xl/worksheets/sheet{sheet}.xml"))
    out = []
    for row in root.iter(f"{space}row"):
        cells: dict[int, str | None] = {}
        for c in row.iter(f"{space}c"):
            letters = re.match(r"[A-Z]+", c.get("r", "A")).group()
            at = 0
            for ch in letters:
                at = at * 26 + ord(ch) - 64
            v = c.find(f"{space}v")
            text = "".join(t.text or "" for t in c.iter(f"{space}t")) if c.get("t") == "inlineStr" else (v.text if v is not None else None)
            cells[at - 1] = shared[int(text)] if c.get("t") == "s" and text is not None else text
        out.append([cells.get(k) for k in range(max(cells, default=-1) + 1)])
    return out


def read_sheet(spark: SparkSession, path: str, sheet: int = 1) -> DataFrame:
    """(path, row, column name, value as text) of spreadsheets with a heading row: long form, for `to_wide`."""

    def decode(name: str, raw: bytes) -> Iterator[pd.DataFrame]:
        rows = sheet_cells(raw, sheet)
        if rows:
            cells = [(name, i, h, r[k] if k < len(r) else None) for i, r in enumerate(rows[1:], 1) for k, h in enumerate(rows[0]) if h is not None]
            yield pd.DataFrame(cells, columns=["path", "row", "column", "value"])

    return _decoded(spark, path, decode, "path string, row long, column string, value string", "*.xlsx")


#: Numbers of types in a workspace file, and of its numeric classes.
_TYPES = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8"}
_NUMERIC = range(6, 16)


def workspace_arrays(raw: bytes) -> dict[str, np.ndarray]:
    """Numeric arrays of a version 5 workspace file, by name; other variables are left out."""
    order = "<" if raw[126:128] == b"IM" else ">"
    out: dict[str, np.ndarray] = {}

    def element(data: bytes, at: int) -> tuple[int, bytes, int]:
        kind, size = struct.unpack(f"{order}II", data[at : at + 8])
        if kind >> 16:  # small form: size and type share a word
            return kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)], at + 8
        end = at + 8 + size
        return kind, data[at + 8 : end], end if kind == 15 else end + (-size) % 8

    def matrix(data: bytes) -> None:
        _, flags, at = element(data, 0)
        cls = struct.unpack(f"{order}I", flags[:4])[0] & 0xFF
        _, dims, at = element(data, at)
        _, name, at = element(data, at)
        if cls in _NUMERIC:
            kind, body, _ = element(data, at)
            shape = struct.unpack(f"{order}{len(dims) // 4}i", dims)
            out[name.decode("latin-1")] = np.frombuffer(body, dtype=f"{order}{_TYPES[kind]}").astype(float).reshape(shape, order="F")

    at = 128
    while at + 8 <= len(raw):
        kind, body, at = element(raw, at)
        if kind == 15:
            inner = zlib.decompress(body)
            kind, body, _ = element(inner, 0)
        if kind == 14 and body:
            matrix(body)
    return out


def _entries(name: str, values: np.ndarray, step: int = 1_000_000) -> Iterator[pd.DataFrame]:
    flat = values.ravel(order="F")
    for a in range(0, len(flat), step):
        part = flat[a : a + step]
        yield pd.DataFrame({"path": name, "feat": np.arange(a + 1, a + 1 + len(part)), "value": part.astype(float)})


def read_workspace(spark: SparkSession, path: str, variable: str) -> DataFrame:
    """(path, row, feat, value) of a matrix variable in workspace files (.mat, version 5); NaN is NULL."""

    def decode(name: str, raw: bytes) -> Iterator[pd.DataFrame]:
        m = workspace_arrays(raw).get(variable)
        if m is not None:
            m = m.reshape(m.shape[0], -1)
            for i, row in enumerate(m, 1):
                yield pd.DataFrame({"path": name, "row": i, "feat": np.arange(1, len(row) + 1), "value": row})

    out = _decoded(spark, path, decode, "path string, row long, feat long, value double", "*.mat")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


#: Numbers of voxel types in an image header.
_VOXELS = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def volume(raw: bytes) -> np.ndarray:
    """Voxels of a NIfTI-1 image in one file, scaled by its slope and intercept."""
    raw = _plain(raw)
    order = "<" if struct.unpack("<i", raw[:4])[0] == 348 else ">"
    dims = struct.unpack(f"{order}8h", raw[40:56])
    kind = struct.unpack(f"{order}h", raw[70:72])[0]
    start, slope, cut = struct.unpack(f"{order}3f", raw[108:120])
    shape = dims[1 : 1 + dims[0]]
    n = int(np.prod(shape))
    v = np.frombuffer(raw, dtype=f"{order}{_VOXELS[kind]}", count=n, offset=int(start) or 352).astype(float).reshape(shape, order="F")
    return v * slope + cut if slope else v


def read_volumes(spark: SparkSession, path: str, mask: np.ndarray | None = None) -> DataFrame:
    """(path, feat, value): voxels of each image in storage order (those of a mask, if given); NaN is NULL."""

    def decode(name: str, raw: bytes) -> Iterator[pd.DataFrame]:
        v = volume(raw)
        for part in _entries(name, v):
            yield part[mask.ravel(order="F")[part["feat"] - 1] != 0] if mask is not None else part

    out = _decoded(spark, path, decode, "path string, feat long, value double", "*.nii*")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


#: Numbers of value types in a surface overlay.
_OVERLAY = {0: "u1", 1: "i4", 3: "f4", 4: "i2"}


def overlay(raw: bytes) -> np.ndarray:
    """Values of a surface overlay file (.mgh, .mgz)."""
    raw = _plain(raw)
    version, w, h, d, frames, kind = struct.unpack(">6i", raw[:24])
    if version != 1:
        raise ValueError("not a surface overlay")
    n = w * h * d * frames
    return np.frombuffer(raw, dtype=f">{_OVERLAY[kind]}", count=n, offset=284).astype(float)


def read_surfaces(spark: SparkSession, path: str) -> DataFrame:
    """(path, feat, value): vertices of each overlay; NaN is NULL."""
    out = _decoded(spark, path, lambda name, raw: _entries(name, overlay(raw)), "path string, feat long, value double", "*.mg[hz]")
    return out.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def read_xml(spark: SparkSession, path: str, row: str, schema: str | None = None) -> DataFrame:
    """Rows of an XML file by the name of their element."""
    reader = spark.read.format("xml").option("rowTag", row)
    return (reader.schema(schema) if schema else reader).load(path)
