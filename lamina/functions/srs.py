"""SM-2 scheduling as Column expressions on a struct of review state."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

DEFAULT_EASE = 2.5
LEAST_EASE = 1.3
#: The quality that each rating stands for.
QUALITY = {"again": 0, "hard": 3, "good": 4, "easy": 5}

STATE = "struct<repetitions:int,ease_factor:double,interval_days:int,due_date:date,last_reviewed:date>"


def quality_of(rating: Column) -> Column:
    """The quality of a rating; an unknown rating raises."""
    out = F.when(F.lit(False), 0)
    for name, q in QUALITY.items():
        out = out.when(rating == name, q)
    return out.otherwise(F.raise_error(F.concat(F.lit("unknown rating: "), F.coalesce(rating, F.lit("null")))).cast("int"))


def fresh() -> Column:
    return F.struct(F.lit(0).alias("repetitions"), F.lit(DEFAULT_EASE).alias("ease_factor"), F.lit(0).alias("interval_days"), F.lit(None).cast("date").alias("due_date"), F.lit(None).cast("date").alias("last_reviewed")).cast(STATE)


def schedule(state: Column, quality: Column, today: Column) -> Column:
    """The state after one review. The ease changes at every review, a lapse included, and the new ease already
    counts for this review's interval; halves round to even."""
    miss = 5 - quality
    ease = F.greatest(F.lit(LEAST_EASE), state["ease_factor"] + (F.lit(0.1) - miss * (F.lit(0.08) + miss * F.lit(0.02))))
    lapse = quality < 3
    reps = F.when(lapse, 0).otherwise(state["repetitions"] + 1)
    days = F.when(lapse | (reps == 1), 1).when(reps == 2, 6).otherwise(F.greatest(F.lit(1), F.rint(state["interval_days"] * ease).cast("int")))
    return F.struct(reps.cast("int").alias("repetitions"), ease.alias("ease_factor"), days.cast("int").alias("interval_days"), F.date_add(today, days.cast("int")).alias("due_date"), today.alias("last_reviewed")).cast(STATE)


def is_due(due_date: Column, as_of: Column) -> Column:
    return due_date.isNull() | (due_date <= as_of)
