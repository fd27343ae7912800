"""Spaced-repetition state of a deck."""

from __future__ import annotations

import datetime
import functools

from pyspark.sql import Column, DataFrame, Row, Window, functions as F

from ..functions import srs
from ..schemas import REVIEW
from ..storage import materialize


def attach_review_state(deck: DataFrame) -> DataFrame:
    """Add missing review columns and fill nulls with those of a fresh card; a missing `document` is null. Applying
    it again changes nothing."""
    default = {"repetitions": F.lit(0), "ease_factor": F.lit(srs.DEFAULT_EASE), "interval_days": F.lit(0)}
    if "document" not in deck.columns:
        deck = deck.withColumn("document", F.lit(None).cast("string"))
    for field in REVIEW:
        old = F.col(field.name) if field.name in deck.columns else F.lit(None)
        new = old.cast(field.dataType)
        deck = deck.withColumn(field.name, F.coalesce(new, default[field.name]) if field.name in default else new)
    return deck


def _day(as_of: datetime.date | str | Column | None) -> Column:
    if as_of is None:
        return F.current_date()
    return as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("date")


def due_cards(deck: DataFrame, *, as_of: datetime.date | str | None = None) -> DataFrame:
    """Cards due on a day: those never reviewed first, then the longest overdue, then by id."""
    deck = attach_review_state(deck)
    return deck.filter(srs.is_due(F.col("due_date"), _day(as_of))).orderBy(F.asc_nulls_first("due_date"), "id")


def _state() -> Column:
    return F.struct(*REVIEW.fieldNames())


def apply_reviews(deck: DataFrame, reviews: DataFrame) -> DataFrame:
    """Fold reviews(id, at, rating, day) into the deck: each card's in order of `at`, one schedule step for each.

    One aggregation on the card and one join; reviews of unknown cards change nothing."""
    deck = attach_review_state(deck)
    steps = reviews.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("at", "rating", "day"))).alias("__steps"))
    folded = F.aggregate("__steps", _state().cast(srs.STATE), lambda s, r: srs.schedule(s, srs.quality_of(r["rating"]), r["day"]))
    out = deck.join(steps, "id", "left").withColumn("__new", F.when(F.col("__steps").isNull(), _state().cast(srs.STATE)).otherwise(folded))
    return out.withColumns({f: F.col(f"__new.{f}") for f in REVIEW.fieldNames()}).select(deck.columns)


def record_review(deck: DataFrame, card_id: int, rating: str, *, today: datetime.date | str | None = None) -> DataFrame:
    """The deck after one review. Of several cards with the id the first gets it, in the order of `first_match`.
    KeyError for an unknown id."""
    if rating not in srs.QUALITY:
        raise KeyError(f"unknown rating {rating!r}")
    deck = attach_review_state(deck)
    first = first_match(deck, card_id)
    if first is None:
        raise KeyError(f"no card with id {card_id}")
    new = srs.schedule(_state().cast(srs.STATE), F.lit(srs.QUALITY[rating]), _day(today))
    same = [F.col(c).eqNullSafe(F.lit(first[c])) for c in deck.columns]
    hit = functools.reduce(lambda a, b: a & b, same)
    if deck.filter(F.col("id") == card_id).count() > 1 and deck.filter(hit).count() > 1:
        # Rows that are equal in every column: any one of them is the first.
        nth = F.row_number().over(Window.partitionBy("id").orderBy(*deck.columns))
        deck = deck.filter(~hit).withColumn("__nth", F.lit(0)).unionByName(deck.filter(hit).withColumn("__nth", nth))
        hit &= F.col("__nth") == 1
    out = deck.withColumn("__new", F.when(hit, new).otherwise(_state().cast(srs.STATE))).withColumns({f: F.col(f"__new.{f}") for f in REVIEW.fieldNames()})
    return out.drop("__new", "__nth")


def first_match(deck: DataFrame, card_id: int) -> Row | None:
    """The first card with an id: by document, chunk_index and then all other columns, as rows have no places."""
    order = [c for c in ("document", "chunk_index") if c in deck.columns]
    order += [c for c in deck.columns if c not in order]
    return deck.filter(F.col("id") == card_id).orderBy(*(F.asc_nulls_last(c) for c in order)).first()


def review_progress(deck: DataFrame, *, as_of: datetime.date | str | None = None) -> DataFrame:
    """total, new, due and mastered cards, in one aggregation."""
    deck = attach_review_state(deck)
    return deck.agg(
        F.count(F.lit(1)).alias("total"),
        F.count_if(F.col("repetitions") == 0).alias("new"),
        F.count_if(srs.is_due(F.col("due_date"), _day(as_of))).alias("due"),
        F.count_if((F.col("repetitions") >= 3) & (F.col("interval_days") > 7)).alias("mastered"),
    )


def apply_edits(deck: DataFrame, edits: DataFrame, deleted: DataFrame | None = None) -> DataFrame:
    """Merge edited rows by id: an edit's columns replace the card's, new ids are appended, ids in `deleted` go."""
    names = [c for c in edits.columns if c != "id" and c in deck.columns]
    new = edits.select("id", *(F.col(c).alias(f"__{c}") for c in names), F.lit(True).alias("__edited"))
    out = deck.join(new, "id", "full")
    out = out.withColumns({c: F.when(F.col("__edited"), F.col(f"__{c}").cast(deck.schema[c].dataType)).otherwise(F.col(c)) for c in names}).select(deck.columns)
    return out if deleted is None else out.join(deleted.select("id"), "id", "left_anti").select(deck.columns)


class StudySession:
    """A queue of all due cards, fixed at the start; each rating is applied to the deck and moves on.

    The queue is a written table: the session pulls one partition of ids at a time, so its length does not matter.
    """

    def __init__(self, deck: DataFrame, *, as_of: datetime.date | str | None = None):
        self.deck, self.as_of, self.position, self.revealed = attach_review_state(deck), as_of, 0, False
        self.due = materialize(due_cards(self.deck, as_of=as_of).select("due_date", "id"), "due-queue")
        self._ids = (r.id for r in self.due.orderBy(F.asc_nulls_first("due_date"), "id").toLocalIterator())
        self.current = next(self._ids, None)
        self.reviews: list[tuple[int, int, str]] = []

    @property
    def queue(self) -> DataFrame:
        """The ids in the order of the session."""
        return self.due.orderBy(F.asc_nulls_first("due_date"), "id").select("id")

    @property
    def finished(self) -> bool:
        return self.current is None

    def card(self) -> Row | None:
        return None if self.finished else first_match(self.deck, self.current)

    def reveal(self) -> None:
        self.revealed = True

    def rate(self, rating: str) -> None:
        if rating not in srs.QUALITY:
            raise KeyError(f"unknown rating {rating!r}")
        if self.finished:
            raise IndexError("the queue is at its end")
        self.reviews.append((self.current, self.position, rating))
        self.position, self.revealed, self.current = self.position + 1, False, next(self._ids, None)

    def result(self) -> DataFrame:
        """The deck with all ratings so far applied at once."""
        rows = self.deck.sparkSession.createDataFrame(self.reviews, "id int, at int, rating string").withColumn("day", _day(self.as_of))
        return apply_reviews(self.deck, rows)

