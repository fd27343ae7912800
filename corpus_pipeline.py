"""From documents to packed training sequences: five stages, each on all that the one before kept.

A stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written and read again as the next one's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from lamina.llm.decontaminate import decontaminate
from lamina.llm.linededup import dedup_lines
from lamina.llm.neardup import near_duplicates
from lamina.llm.packing import pack
from lamina.storage import discard, materialize, table, written
from lamina.llm.toxicity import toxicity

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
CARRY = ("lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier chain rejects go; null texts and texts without words stay, and so does everything
    where there are no labels. Rows are judged one by one, null doc_ids included; an empty table gives an empty result."""
    return toxicity(docs, table(spark, sf_dir, "labels"), carry=CARRY).filter("NOT is_toxic").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first only; n_chars follows the text. A document all of whose
    words stood in such lines goes: others hold every one of them. Null texts stay null; texts that were empty before
    stay; rows that share a doc_id are one document; null doc_ids stay whole; an empty table gives an empty result."""
    out = dedup_lines(docs, carry=CARRY)
    # Signs other than ASCII white space are words.
    out = out.filter(F.expr(r"n_dropped = 0 OR text RLIKE '[^\x20\x09-\x0D]'"))
    return out.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, the one of smallest doc_id: five-word shingles, similarity 0.8. Null, empty and
    blank texts and null doc_ids stay; rows that share a doc_id go or stay together; an empty table gives an empty
    result."""
    gone = near_duplicates(docs, words=5, percent=80).filter("NOT kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(COLUMNS)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth or more of the words lie in benchmark windows go, row by row: repeated rows and
    null doc_ids are judged by their texts; null and empty texts stay; an empty table gives an empty result."""
    return decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=CARRY).filter("NOT contaminated").select(COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of sequences of at most 2048 tokens. Each row is packed, with a null or empty text as the end id
    alone, so repeated rows and null doc_ids need no care; an empty table gives an empty result."""
    return pack(docs, keep_ids=False).drop("ids")


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_repeated_lines),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: SQL cannot express the trained classifier or the packing; tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of `sf_dir`. What a stage wrote besides its result goes once the result is there,
    and so does the result of the stage before."""
    docs, old = table(spark, sf_dir, "documents"), len(written(spark))
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
        discard(spark, written(spark)[old:-1])
    return STAGES[-1][1](spark, docs, sf_dir)
