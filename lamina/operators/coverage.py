"""Reports on a deck."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schemas import DIFFICULTIES


def coverage_by_topic(deck: DataFrame) -> DataFrame:
    """Cards, difficulties and card types of each topic, most cards first, then by topic. One aggregation; topics are
    case-sensitive here, and cards without a topic are left out."""
    counts = [F.count_if(F.col("difficulty") == d).alias(d) for d in DIFFICULTIES]
    out = deck.filter("topic IS NOT NULL").groupBy("topic").agg(F.count(F.lit(1)).alias("card_count"), *counts, F.array_sort(F.collect_set("card_type")).alias("card_types"))
    return out.orderBy(F.desc("card_count"), "topic")


def card_mix(deck: DataFrame) -> DataFrame:
    """Cards of each type, most first."""
    return deck.filter("card_type IS NOT NULL").groupBy("card_type").agg(F.count(F.lit(1)).alias("cards")).orderBy(F.desc("cards"), "card_type")


def difficulty_mix(deck: DataFrame) -> DataFrame:
    """Cards of the three levels in their order, 0 where there are none."""
    spark: SparkSession = deck.sparkSession
    levels = spark.createDataFrame(list(enumerate(DIFFICULTIES)), "place int, difficulty string")
    counts = deck.groupBy("difficulty").agg(F.count(F.lit(1)).alias("n"))
    return levels.join(counts, "difficulty", "left").orderBy("place").select("difficulty", F.coalesce("n", F.lit(0)).alias("cards"))


def keyword_search(deck: DataFrame, pattern: str) -> DataFrame:
    """Cards whose question or answer matches a regular expression, without regard to case."""
    hit = lambda name: F.coalesce(F.rlike(F.col(name), F.lit(f"(?iu){pattern}")), F.lit(False))
    return deck.filter(hit("question") | hit("answer")).select("question", "answer", "topic", "card_type")


def search_count(deck: DataFrame, pattern: str) -> DataFrame:
    """matches and total, in one pass."""
    hit = lambda name: F.coalesce(F.rlike(F.col(name), F.lit(f"(?iu){pattern}")), F.lit(False))
    return deck.agg(F.count_if(hit("question") | hit("answer")).alias("matches"), F.count(F.lit(1)).alias("total"))
