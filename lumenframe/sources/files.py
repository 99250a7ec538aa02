"""Readers and writers of the file layouts that the media pipelines use."""

from __future__ import annotations

import io
import re
import struct
import wave
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.operators import tensors


def keyed_json_lines(spark: SparkSession, path: str, schema: str, key: str) -> DataFrame:
    """JSON lines by key; of a key's rows the last in its file, and of files the last by name, wins (S3)."""
    rows = spark.read.schema(schema).json(path).select("*", F.col("_metadata.file_path").alias("_f"), F.monotonically_increasing_id().alias("_i"))
    whole = F.struct(*[c for c in rows.columns if not c.startswith("_")])
    return rows.groupBy(F.col(key).alias("_k")).agg(F.max_by(whole, F.struct("_f", "_i")).alias("r")).select("r.*")


def json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines with a fixed schema; lines that do not parse keep their text in ``_corrupt_record``."""
    return spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").json(path)


def whitelist(spark: SparkSession, path: str) -> DataFrame:
    """Ids of a text file, one a line, without blanks and # comments; a missing file has none."""
    try:
        lines = spark.read.text(path)
    except AnalysisException as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "video_id string")
    clean = F.regexp_replace("value", r"(?U)^\s+|\s+$", "")
    return lines.select(clean.alias("video_id")).filter((F.col("video_id") != "") & ~F.col("video_id").startswith("#")).distinct()


def path_columns(paths: DataFrame, path: str = "path") -> DataFrame:
    """channel, the folder, and video_id, the file's stem, of each path."""
    return paths.withColumn("channel", F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)).withColumn("video_id", F.regexp_extract(path, r"([^/]+?)(?:\.[^./]*)?$", 1))


def image_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, channel, video_id, image): decoded images; unreadable ones stay, with no data."""
    rows = spark.read.format("image").option("dropInvalid", False).option("recursiveFileLookup", True).load(path)
    return path_columns(rows.select(F.col("image.origin").alias("path"), "image"))


def binary_files(spark: SparkSession, path: str) -> DataFrame:
    return path_columns(spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content"))


def _decoded(rows: DataFrame, schema: str, decode) -> DataFrame:
    """(path, channel, video_id, schema, error) of binary files, each decoded alone: one that cannot be read is a row with an error."""
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for content in batch.column(3).to_pylist():
                try:
                    out.append((*decode(content), None))
                except (ValueError, KeyError, EOFError, struct.error, wave.Error) as e:
                    out.append((*[None] * len(names), f"{type(e).__name__}: {e}"))
            columns = [pa.array(list(c), kind) for c, kind in zip(zip(*out) if out else [()] * len(kinds), kinds)]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(3)), *columns], names=["path", "channel", "video_id", *names, "error"])

    kinds = [{"array<float>": pa.list_(pa.float32()), "array<int>": pa.list_(pa.int32()), "int": pa.int32()}[c.split()[1]] for c in schema.split(", ")] + [pa.string()]
    return rows.select("path", "channel", "video_id", "content").mapInArrow(run, f"path string, channel string, video_id string, {schema}, error string")


def audio_files(spark: SparkSession, path: str, rate: int = 16_000) -> DataFrame:
    """(path, channel, video_id, samples, rate, error): PCM16 WAV files, channels averaged, at one rate."""
    return _decoded(binary_files(spark, path), "samples array<float>, rate int", lambda content: (tensors.wav_samples(content, rate).tolist(), rate))


def tensor_files(spark: SparkSession, path: str, name: str) -> DataFrame:
    """(path, channel, video_id, tensor, shape, error): one tensor, flat, of each safetensors file."""

    def decode(content: bytes) -> tuple[list, list]:
        found = tensors.safetensor(content, name)
        return found.ravel().tolist(), list(found.shape)

    return _decoded(binary_files(spark, path), "tensor array<float>, shape array<int>", decode)


def array_files(spark: SparkSession, path: str, name: str = "") -> DataFrame:
    """(path, channel, video_id, tensor, shape, error): npy files, or the array ``name`` of npz files."""

    def decode(content: bytes) -> tuple[list, list]:
        found = np.load(io.BytesIO(content), allow_pickle=False)
        found = np.asarray(found[name] if name else found, np.float32)
        return found.ravel().tolist(), list(found.shape)

    return _decoded(binary_files(spark, path), "tensor array<float>, shape array<int>", decode)


def write_pngs(images: DataFrame, path: str) -> None:
    """Images (name, png) as a table of encoded files (K6): a file each would be too many for a shared store."""
    images.select("name", "png").write.mode("overwrite").parquet(path)


def frequency_list(spark: SparkSession, path: str) -> DataFrame:
    """(term, n) of lines "term count" (S13)."""
    return spark.read.schema("term string, n long").option("sep", " ").option("quote", "").csv(path)


def charset(spark: SparkSession, path: str) -> str:
    """The characters of a recogniser, one a line, and a space (S15). A small file by definition."""
    lines = spark.read.text(path, wholetext=True).first()
    return "".join(re.split(r"\r?\n", lines[0].rstrip("\r\n"))) + " " if lines else " "


def sheet_cells(spark: SparkSession, path: str, sheet: str) -> DataFrame:
    """(path, row, column, value) of one sheet of Excel workbooks, values as text."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [(p, *cell) for p, content in zip(*(batch.column(i).to_pylist() for i in (0, 1))) for cell in workbook_cells(content, sheet)]
            columns = zip(*out) if out else ([], [], [], [])
            kinds = (pa.string(), pa.int32(), pa.string(), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], names=["path", "row", "column", "value"])

    return files.mapInArrow(run, "path string, row int, column string, value string")


def workbook_cells(content: bytes, sheet: str) -> Iterator[tuple[int, str, str]]:
    """(row, column, value) of a sheet: the zip's XML, with shared and inline strings."""
    ns = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
    link = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = {s.get("name"): s.get(link) for s in ElementTree.fromstring(z.read("xl/workbook.xml")).iterfind(".//m:sheet", ns)}
        targets = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in s.iterfind(".//m:t", ns)) for s in ElementTree.fromstring(z.read("xl/sharedStrings.xml")).iterfind("m:si", ns)]
        if sheet not in names:
            raise ValueError(f"no sheet {sheet!r}")
        for cell in ElementTree.fromstring(z.read("xl/" + targets[names[sheet]].removeprefix("/xl/"))).iterfind(".//m:c", ns):
            column, row = re.fullmatch(r"([A-Z]+)([0-9]+)", cell.get("r")).groups()
            value = cell.findtext("m:v", None, ns)
            if cell.get("t") == "s":
                value = shared[int(value)]
            elif cell.get("t") == "inlineStr":
                value = "".join(t.text or "" for t in cell.iterfind(".//m:t", ns))
            if value is not None:
                yield int(row), column, value


def write_sheets(sheets: dict[str, DataFrame], folder: str) -> None:
    """One table per sheet of a report, each a folder of its own (K5)."""
    for name, df in sheets.items():
        df.write.mode("overwrite").parquet(f"{folder}/{name}")


def write_records(df: DataFrame, path: str) -> None:
    """Embeddings and other records as Parquet (K1)."""
    df.write.mode("overwrite").parquet(path)


def write_json_lines(df: DataFrame, path: str) -> None:
    """Records as JSON lines, letters as they are and null fields written (K2)."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_json_report(df: DataFrame, path: str) -> None:
    """A one-row report as pretty JSON (K3)."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def append_results(df: DataFrame, path: str) -> None:
    """Results of one more combination, beside those before (K4)."""
    df.write.mode("append").json(path)
