"""Quality filters: one reason for each dropped card."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..schemas import CARD_TYPES, DIFFICULTIES

MIN_ANSWER_CHARS = 15


@dataclass(frozen=True)
class QualityFilterResult:
    deck: DataFrame
    dropped: DataFrame  # with `reason`


def quality_reason(min_answer_chars: int = MIN_ANSWER_CHARS) -> Column:
    """Null for a good card. A short answer comes before one that its question already holds."""
    q = X.normal_form(F.col("question"))
    restates = X.let(X.normal_form(F.col("answer")), lambda a: (a != "") & F.contains(q, a))
    return F.when(F.length("answer") < min_answer_chars, "answer too short").when(restates, "answer restates question")


def filter_quality(deck: DataFrame, *, min_answer_chars: int = MIN_ANSWER_CHARS) -> QualityFilterResult:
    """Cards with a null question or answer have no reason and stay; validation reports them."""
    marked = deck.withColumn("reason", quality_reason(min_answer_chars))
    return QualityFilterResult(marked.filter("reason IS NULL").drop("reason"), marked.filter("reason IS NOT NULL"))


def is_valid_card() -> Column:
    """Four texts that are not empty, and two levels of the enumerations; a blank counts as text."""
    out = F.col("card_type").isin(*CARD_TYPES) & F.col("difficulty").isin(*DIFFICULTIES)
    for name in ("question", "answer", "topic", "source_excerpt"):
        out &= F.length(name) > 0
    return F.coalesce(out, F.lit(False))
