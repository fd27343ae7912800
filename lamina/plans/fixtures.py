"""Derived tables on which the named queries run, in the SQL that Spark and DuckDB share.

Every derivation reads the whole table and keeps whole texts: a card's question is its document's first line, the
answer all the rest; every line of a document is a paragraph; every event of a user is a review.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import table

#: Flash cards, one for each document.
CARD_COLUMNS = [
    "CAST(doc_id AS INT) AS id",
    "split_part(text, chr(10), 1) AS question",
    "CASE WHEN doc_id % 11 = 0 THEN split_part(text, chr(10), 1) ELSE substr(text, length(split_part(text, chr(10), 1)) + 2) END AS answer",
    "CASE doc_id % 5 WHEN 0 THEN 'definition' WHEN 1 THEN 'concept' WHEN 2 THEN 'application' WHEN 3 THEN 'compare' ELSE 'cloze' END AS card_type",
    "CASE doc_id % 3 WHEN 0 THEN 'easy' WHEN 1 THEN 'medium' ELSE 'hard' END AS difficulty",
    "CASE WHEN doc_id % 97 = 96 THEN NULL ELSE CASE WHEN doc_id % 2 = 1 THEN upper(lang) ELSE lang END || '-' || lower(split_part(split_part(text, chr(10), 1), ' ', 1)) END AS topic",
    "CASE WHEN doc_id % 4 = 0 THEN 'a passage that is nowhere' ELSE split_part(text, chr(10), -1) END AS source_excerpt",
    "source AS document",
    "CAST(doc_id % 40 AS INT) AS chunk_index",
]
#: Pages with a running header and a page number, one document for each source.
PAGE_COLUMNS = ["source", "CAST(row_number() OVER (PARTITION BY source ORDER BY doc_id) AS INT) AS page", "concat('HDR ', CAST(doc_id AS STRING), chr(10), text, chr(10), 'Page ', CAST(doc_id AS STRING)) AS text"]
#: Text with what extraction leaves behind: carriage returns, form feeds, hard blanks, hyphenated line ends.
ROUGH_TEXT = "concat(replace(replace(text, '. ', concat('.', chr(160), '  ')), ', ', concat(',', chr(13), chr(10), chr(9))), chr(12), ' ab-', chr(10), 'cd  ', chr(10), chr(10), chr(10), chr(10), 'end ')"
#: A lapse at every sixth review at least keeps intervals within the calendar.
REVIEW_ORDER = "row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id)"
RATING = "CASE WHEN event_type = 'error' OR nr % 6 = 0 THEN 'again' WHEN event_type = 'signup' THEN 'hard' WHEN event_type = 'purchase' THEN 'easy' ELSE 'good' END"


def cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*CARD_COLUMNS)


def broken_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards of which some break the schema."""
    return cards(spark, sf_dir).withColumns({"card_type": F.expr("CASE WHEN id % 13 = 0 THEN 'bogus' ELSE card_type END"), "question": F.expr("CASE WHEN id % 17 = 0 THEN '' ELSE question END")})


def raw_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").selectExpr(*PAGE_COLUMNS)


def markdown_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document as a page of its source: every line a paragraph, with one or two headings before some."""
    head = lambda sign, i: F.concat(F.lit(f"{sign} Part "), i.cast("string"), F.lit("\n\n"))
    lines = F.transform(F.split("text", "\n", -1), lambda x, i: F.concat(F.when(i % 6 == 0, F.concat(head("#", i), head("##", i))).when(i % 3 == 0, head("##", i)).otherwise(""), x))
    docs = table(spark, sf_dir, "documents").withColumn("text", F.array_join(lines, "\n\n"))
    return docs.selectExpr("concat('d', CAST(doc_id AS STRING)) AS source", "1 AS page", "text", "doc_id")


def reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events of all users as reviews, a card for each user."""
    events = table(spark, sf_dir, "events").filter("user_id IS NOT NULL").selectExpr("CAST(user_id AS INT) AS id", "event_type", "to_date(ts) AS day", "ts", f"{REVIEW_ORDER} AS nr")
    return events.selectExpr("id", "nr AS at", f"{RATING} AS rating", "day", "ts")


def review_deck(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards that reviews may name, without any state."""
    return cards(spark, sf_dir)


def generation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A generation log over the cards' chunks; each seventh chunk is a refusal."""
    own = cards(spark, sf_dir)
    fields = ["question", "answer", "card_type", "difficulty", "topic", "source_excerpt"]
    rows = own.groupBy("chunk_index").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("id", *fields))), lambda c: F.struct(*(c[f].alias(f) for f in fields))).alias("cards"),
        F.count_if(F.col("id") % 4 == 0).alias("dropped_ungrounded"),
        F.sum(F.length("question")).alias("input_tokens"),
        F.sum(F.length("answer")).alias("output_tokens"),
        F.sum(F.when(F.col("id") % 2 == 0, F.length("question")).otherwise(0)).alias("cache_read_tokens"),
        F.sum(F.when(F.col("id") % 2 == 1, F.length("question")).otherwise(0)).alias("cache_creation_tokens"),
    )
    refused = F.col("chunk_index") % 7 == 3
    return rows.withColumns({"error": F.when(refused, F.concat(F.lit("chunk "), F.col("chunk_index").cast("string"), F.lit(" (p. 1): generation refused (category=None)"))), "stop_reason": F.when(refused, "refusal").otherwise("end_turn"), "cards": F.when(refused, F.expr("slice(cards, 1, 0)")).otherwise(F.col("cards"))})
