"""Review events as a stream: one review state for each card, kept by Structured Streaming."""

from __future__ import annotations

import datetime
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState

from ..functions import srs

STATE = "repetitions int, ease_factor double, interval_days int"
OUTPUT = "id long, repetitions int, ease_factor double, interval_days int, due_date date, last_reviewed date"


def next_state(state: tuple[int, float, int], quality: int) -> tuple[int, float, int]:
    """The schedule step of functions.srs on plain values."""
    reps, ease, days = state
    miss = 5 - quality
    ease = max(srs.LEAST_EASE, ease + (0.1 - miss * (0.08 + miss * 0.02)))
    if quality < 3:
        return 0, ease, 1
    reps += 1
    return reps, ease, {1: 1, 2: 6}.get(reps) or max(1, round(days * ease))


def _fold(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    now = tuple(state.get) if state.exists else (0, srs.DEFAULT_EASE, 0)
    events = pd.concat(list(frames)).sort_values("ts", kind="stable")
    rows = []
    for r in events.itertuples():
        now = next_state(now, srs.QUALITY[r.rating])
        day = r.ts.date()
        rows.append((key[0], *now, day + datetime.timedelta(days=now[2]), day))
    state.update(now)
    yield pd.DataFrame(rows, columns=["id", "repetitions", "ease_factor", "interval_days", "due_date", "last_reviewed"])


def review_stream(events: DataFrame) -> DataFrame:
    """Streaming reviews(id, ts, rating) to the state after each review. Within a micro-batch reviews are applied in
    order of their time; unknown ratings are left out."""
    good = events.filter(F.col("rating").isin(*srs.QUALITY) & F.col("id").isNotNull()).select(F.col("id").cast("long").alias("id"), "ts", "rating")
    return good.groupBy("id").applyInPandasWithState(_fold, OUTPUT, STATE, "append", "NoTimeout")


def activity_windows(events: DataFrame, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Streaming reviews for each window of time and rating, with a watermark for late events."""
    return events.withWatermark("ts", late).groupBy(F.window("ts", width), "rating").agg(F.count(F.lit(1)).alias("reviews")).select("window.start", "window.end", "rating", "reviews")
