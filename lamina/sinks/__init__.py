"""Decks to files and to the formats of other tools."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..operators.deck import validated_cards
from ..operators.review import attach_review_state
from ..schemas import CARD_FIELDS

ANKI_HEADER = "Front,Back,Tags"


def save_csv(deck: DataFrame, path: str) -> None:
    """Quotes doubled, blanks kept, an empty text distinct from null; dates in ISO form."""
    deck.write.mode("overwrite").csv(path, header=True, quote='"', escape='"', emptyValue='""', ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False, dateFormat="yyyy-MM-dd")


def save_parquet(deck: DataFrame, path: str) -> None:
    deck.write.mode("overwrite").parquet(path)


def save_snapshot(deck: DataFrame, path: str) -> None:
    """The deck with its review state; refused, as the exports are, while a card is invalid."""
    validated_cards(deck)
    save_csv(attach_review_state(deck), path)


def anki_line() -> Column:
    """A record of the Anki import: front, back, tags; without its line end."""
    tags = X.card_tags(F.col("card_type"), F.col("difficulty"), F.col("topic"))
    return F.concat_ws(",", *(X.quoted(c, ",") for c in (F.col("question"), F.col("answer"), tags)))


def quizlet_line() -> Column:
    """A record of the Quizlet import: term and definition with single spaces."""
    return F.concat_ws("\t", *(X.quoted(X.collapse(F.col(c)), "\t") for c in ("question", "answer")))


def json_line() -> Column:
    return F.to_json(F.struct(*CARD_FIELDS))


def export_lines(deck: DataFrame, line: Column) -> DataFrame:
    """(id, line) of each card, sorted by id within partitions: the distributed form of the exports."""
    return deck.repartitionByRange("id").sortWithinPartitions("id").select("id", line.alias("line"))


def _collected(deck: DataFrame, line: Column) -> list[str]:
    validated_cards(deck)
    return [r.line for r in deck.select("id", line.alias("line")).orderBy("id").collect()]


def to_anki_csv(deck: DataFrame) -> str:
    """The whole import file as one string, for decks that a person imports; export_lines is for larger ones."""
    return "".join(f"{x}\r\n" for x in [ANKI_HEADER, *_collected(deck, anki_line())])


def to_quizlet_tsv(deck: DataFrame) -> str:
    return "".join(f"{x}\n" for x in _collected(deck, quizlet_line()))


def to_json(deck: DataFrame) -> str:
    cards = [{f: r[f] for f in CARD_FIELDS} for r in validated_cards(deck).collect()]
    return json.dumps(cards, indent=2, ensure_ascii=False)
