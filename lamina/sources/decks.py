"""Decks from CSV and Parquet. Schemas are declared, never inferred: a text such as NA stays a text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, types as T

from ..operators.review import attach_review_state
from ..schemas import DECK, REVIEW


def _header(spark: SparkSession, path: str) -> list[str]:
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"').columns


def load_csv(spark: SparkSession, path: str) -> DataFrame:
    """A deck, with or without review state; columns beyond those are read as text."""
    known = {f.name: f.dataType for f in [*DECK, *REVIEW]}
    schema = T.StructType([T.StructField(name, known.get(name, T.StringType())) for name in _header(spark, path)])
    # With a null value that no file holds, an unquoted empty field is null and a quoted one is an empty text.
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"', nullValue="\u0001", emptyValue="", ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)


def load_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def resume(spark: SparkSession, path: str) -> DataFrame:
    """A saved deck with its review state filled up."""
    return attach_review_state(load_csv(spark, path))
