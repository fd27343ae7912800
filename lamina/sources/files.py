"""Files of text to pages: pages(source, page, text)."""

from __future__ import annotations

import io
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as X
from ..operators.pages import finalize
from ..storage import materialize

SUFFIXES = (".markdown", ".md", ".pdf", ".txt")
RAW = "source string, page int, text string"


class UnsupportedFileError(ValueError):
    """A file whose extension cannot be read."""


class EmptyDocumentError(ValueError):
    """A file without text, such as a scanned PDF."""


def _pdf_pages(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        if not len(frame):
            continue
        from pypdf import PdfReader  # an optional dependency: needed where there are PDF files only

        rows = [(r.source, i, page.extract_text() or "") for r in frame.itertuples() for i, page in enumerate(PdfReader(io.BytesIO(r.content)).pages, 1)]
        yield pd.DataFrame(rows, columns=["source", "page", "text"])


def raw_pages(files: DataFrame) -> DataFrame:
    """files(source, content BINARY) to raw pages: one page of a text file, the text layer of each PDF page. Bytes
    that are not UTF-8 become replacement characters."""
    kind = X.suffix(F.col("source"))
    plain = files.filter(kind != ".pdf").select("source", F.lit(1).alias("page"), F.expr("make_valid_utf8(cast(content AS string))").alias("text"))
    pdf = files.filter(kind == ".pdf").select("source", "content").mapInPandas(_pdf_pages, RAW)
    return plain.unionByName(pdf)


def read_files(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """files(source, content) of a path or glob, by name; files of other kinds are left to check_supported."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", r"([^/]+)$", 1).alias("source"), "content")


def unsupported(files: DataFrame) -> DataFrame:
    """(source, error) of the files whose extension cannot be read."""
    kind = X.suffix(F.col("source"))
    text = F.concat("source", F.lit(": unsupported extension '"), kind, F.lit(f"'. Supported: {', '.join(SUFFIXES)}"))
    return files.filter(~kind.isin(*SUFFIXES)).select("source", text.alias("error"))


def ingest(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(pages, errors): repeated edge lines stripped, text normalised, empty pages dropped after numbering; errors
    (source, error) has unsupported and empty files, so that one bad file does not stop a run."""
    good = files.filter(X.suffix(F.col("source")).isin(*SUFFIXES))
    pages = finalize(raw_pages(good)).filter("text <> ''")
    empty = good.select("source").distinct().join(pages.select("source").distinct(), "source", "left_anti")
    errors = unsupported(files).unionByName(empty.select("source", F.concat("source", F.lit(": no extractable text.")).alias("error")))
    return pages, errors


def _strict(files: DataFrame) -> DataFrame:
    bad = unsupported(files).first()
    if bad:
        raise UnsupportedFileError(bad.error)
    pages, errors = ingest(files)
    first = errors.first()
    if first:
        raise EmptyDocumentError(first.error)
    return pages


def load(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of files; raises on the first file that cannot be read or has no text."""
    return _strict(read_files(spark, path))


def load_bytes(spark: SparkSession, data: bytes, filename: str) -> DataFrame:
    """Pages of one file in memory; `filename` is kept as given."""
    return _strict(spark.createDataFrame([(filename, bytearray(data))], "source string, content binary"))


def ingest_once(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """Pages of files, read once for each state of the files in this session: names, sizes and times of change name
    the written table that later calls read."""
    listed = spark.read.format("binaryFile").load(path).select("path", "length", F.col("modificationTime").cast("string"))
    key = listed.agg(F.count(F.lit(1)), F.sum(F.xxhash64(*listed.columns).cast("decimal(38,0)"))).first()
    known = _ingested.setdefault(id(spark), {})
    if key not in known:
        known[key] = materialize(load(spark, path), "ingested")
    return known[key]


_ingested: dict[int, dict[tuple, DataFrame]] = {}


def upload_totals(pages: DataFrame) -> DataFrame:
    """files, pages and characters of a batch."""
    return pages.agg(F.countDistinct("source").alias("files"), F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"))
