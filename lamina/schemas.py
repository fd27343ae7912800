"""The tables of the engine."""

from __future__ import annotations

from pyspark.sql import types as T

#: The levels of a card's two enumerations.
CARD_TYPES = ("definition", "concept", "application", "compare", "cloze")
DIFFICULTIES = ("easy", "medium", "hard")

_TYPES = {"string": T.StringType(), "int": T.IntegerType(), "double": T.DoubleType(), "date": T.DateType()}


def _struct(ddl: str) -> T.StructType:
    """A flat schema; unlike StructType.fromDDL it needs no session, so that workers can import it."""
    return T.StructType([T.StructField(name, _TYPES[kind]) for name, kind in (x.split() for x in ddl.split(", "))])


PAGES = _struct("source string, page int, text string")
CHUNKS = _struct("index int, text string, start_page int, end_page int, token_count int, source string")
CARD_FIELDS = ["question", "answer", "card_type", "difficulty", "topic", "source_excerpt"]
CARD = "struct<" + ",".join(f"{f}:string" for f in CARD_FIELDS) + ">"
GENERATION = f"chunk_index int, cards array<{CARD}>, dropped_ungrounded int, input_tokens bigint, output_tokens bigint, cache_read_tokens bigint, cache_creation_tokens bigint, stop_reason string, error string"
DECK = _struct("id int, question string, answer string, card_type string, difficulty string, topic string, source_excerpt string, document string, chunk_index int")
REVIEW = _struct("repetitions int, ease_factor double, interval_days int, due_date date, last_reviewed date")
DECK_COLUMNS = DECK.fieldNames()
REVIEW_COLUMNS = REVIEW.fieldNames()
