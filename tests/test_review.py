import datetime
import random

import pytest
from pyspark.sql import functions as F

from lamina.functions import srs
from lamina.operators import review
from lamina.operators.deck import cards_to_deck
from lamina.streaming.reviews import activity_windows, next_state, review_stream

DAY = datetime.date(2024, 5, 1)


def test_attach_is_idempotent(spark, card):
    deck = review.attach_review_state(cards_to_deck(spark, [card()]).drop("document"))
    assert deck.first().ease_factor == 2.5 and deck.first().document is None
    again = review.attach_review_state(deck)
    assert again.schema == deck.schema and again.collect() == deck.collect()


def test_trajectory(spark, card):
    deck = cards_to_deck(spark, [card()])
    days = []
    for _ in range(3):
        deck = review.record_review(deck, 0, "good", today=DAY)
        days.append(deck.first().interval_days)
    assert days == [1, 6, 15] and deck.first().due_date == DAY + datetime.timedelta(days=15)
    lapsed = review.record_review(deck, 0, "again", today=DAY).first()
    assert (lapsed.repetitions, lapsed.interval_days) == (0, 1) and lapsed.ease_factor == pytest.approx(1.7)
    for bad in (99, 0):
        with pytest.raises(KeyError):
            review.record_review(deck, bad, "good" if bad else "great")


def test_fold_equals_plain_steps(spark, card):
    rng = random.Random(2)
    deck = cards_to_deck(spark, [card() for _ in range(20)])
    events = [(i, k, rng.choice(list(srs.QUALITY)), DAY + datetime.timedelta(days=k)) for i in range(25) for k in range(rng.randint(0, 9))]
    got = {r.id: r for r in review.apply_reviews(deck, spark.createDataFrame(events, "id int, at int, rating string, day date")).collect()}
    assert len(got) == 20
    for i, row in got.items():
        state, last = (0, 2.5, 0), None
        for _, _, rating, day in (e for e in events if e[0] == i):
            state, last = next_state(state, srs.QUALITY[rating]), day
        assert (row.repetitions, row.ease_factor, row.interval_days, row.last_reviewed) == (*state, last)
        assert row.ease_factor >= 1.3


def test_due_progress_session(spark, card):
    deck = cards_to_deck(spark, [card() for _ in range(4)])
    deck = review.record_review(review.record_review(deck, 1, "good", today=DAY), 2, "good", today=DAY - datetime.timedelta(days=3))
    assert [r.id for r in review.due_cards(deck, as_of=DAY).collect()] == [0, 3, 2]
    assert tuple(review.review_progress(deck, as_of=DAY).first()) == (4, 2, 3, 0)
    session = review.StudySession(deck, as_of=DAY)
    assert [r.id for r in session.queue.collect()] == [0, 3, 2] and session.card().id == 0
    session.reveal()
    session.rate("easy")
    session.rate("again")
    assert not session.finished and session.card().id == 2
    session.rate("good")
    assert session.finished and session.card() is None
    with pytest.raises(IndexError):
        session.rate("good")
    assert {r.id: r.repetitions for r in session.result().collect()} == {0: 1, 1: 1, 2: 2, 3: 0}


def test_study_queue_has_no_limit(spark):
    deck = spark.range(12_000).select(F.col("id").cast("int").alias("id"), F.lit("q").alias("question"))
    session = review.StudySession(deck, as_of=DAY)
    for _ in range(3):
        session.rate("good")
    assert session.queue.count() == 12_000 and session.current == 3


def test_first_of_several_cards_with_an_id_is_reviewed(spark, card):
    deck = cards_to_deck(spark, [card(), card(question="other?"), card()], [3, 2, 3]).withColumn("id", F.lit(1))
    assert review.first_match(deck, 1).question == "other?" and review.first_match(deck, 9) is None
    out = review.record_review(deck, 1, "good", today=DAY).collect()
    assert sorted((r.question, r.repetitions) for r in out) == sorted([("other?", 1)] + [(card()["question"], 0)] * 2)
    same = deck.filter("chunk_index = 3")
    assert sorted(r.repetitions for r in review.record_review(same, 1, "good", today=DAY).collect()) == [0, 1]


def test_activity_windows(spark):
    events = spark.createDataFrame([(datetime.datetime(2024, 5, 1, h, m), r) for h, m, r in ((9, 1, "good"), (9, 59, "good"), (10, 0, "good"), (9, 5, "hard"))], "ts timestamp, rating string")
    rows = [(r.start.hour, r.rating, r.reviews) for r in activity_windows(events).collect()]
    assert sorted(rows) == [(9, "good", 2), (9, "hard", 1), (10, "good", 1)]


def test_edits(spark, card):
    deck = cards_to_deck(spark, [card(), card(), card()])
    edits = spark.createDataFrame([(1, "new?"), (7, "added?")], "id int, question string")
    out = review.apply_edits(deck, edits, spark.createDataFrame([(2,)], "id int"))
    assert {r.id: r.question for r in out.collect()} == {0: card()["question"], 1: "new?", 7: "added?"}


def test_stream_equals_batch(spark, card, tmp_path):
    rng = random.Random(3)
    events = [(i, datetime.datetime(2024, 5, 1 + k, 12), rng.choice(list(srs.QUALITY))) for i in range(5) for k in range(rng.randint(1, 6))]
    frame = spark.createDataFrame(events, "id long, ts timestamp, rating string")
    frame.write.parquet(f"{tmp_path}/in")
    stream = review_stream(spark.readStream.schema(frame.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("states").outputMode("append").option("checkpointLocation", f"{tmp_path}/c").start()
    q.processAllAvailable()
    q.stop()
    got = {}
    for r in spark.table("states").orderBy("last_reviewed").collect():
        got[r.id] = (r.repetitions, r.ease_factor, r.interval_days)
    batch = review.apply_reviews(cards_to_deck(spark, [card() for _ in range(5)]), frame.selectExpr("cast(id as int) id", "ts as at", "rating", "to_date(ts) as day"))
    assert got == {r.id: (r.repetitions, r.ease_factor, r.interval_days) for r in batch.collect()}
