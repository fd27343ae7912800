import difflib
import itertools
import random
import re

import pytest

from lamina.operators import coverage, dedup, quality
from lamina.operators.deck import Deck, InvalidCardError, cards_to_deck, invalid_cards, validated_cards


def test_build_and_validate(spark, card):
    deck = Deck.from_cards(spark, [card(), card(topic="Other")], [3, None], ["a.md", None])
    assert [tuple(r) for r in deck.df.select("id", "chunk_index", "document").orderBy("id").collect()] == [(0, 3, "a.md"), (1, None, None)]
    assert len(deck) == 2 and deck.cards.count() == 2
    with pytest.raises(ValueError):
        cards_to_deck(spark, [card()], [1, 2])
    assert Deck.from_cards(spark, []).df.count() == 0


@pytest.mark.parametrize("change", [{"question": ""}, {"card_type": "bogus"}, {"difficulty": None}, {"topic": None}, {"source_excerpt": ""}])
def test_invalid(spark, card, change):
    deck = cards_to_deck(spark, [card(), card(**change)])
    assert [r.id for r in invalid_cards(deck).collect()] == [1]
    with pytest.raises(InvalidCardError):
        validated_cards(deck)
    assert invalid_cards(cards_to_deck(spark, [card(question=" ")])).count() == 0


def norm(text):
    return re.sub(r"\s+", " ", re.sub(r"[^\w\s]", " ", text.lower())).strip()


def brute_groups(cards, threshold):
    parent = list(range(len(cards)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, j in itertools.combinations(range(len(cards)), 2):
        a, b = cards[i], cards[j]
        if a["topic"] is not None and b["topic"] is not None and a["topic"].lower() == b["topic"].lower():
            if difflib.SequenceMatcher(None, norm(a["question"]), norm(b["question"])).ratio() >= threshold:
                parent[max(root(i), root(j))] = min(root(i), root(j))
    return {i: root(i) for i in range(len(cards)) if root(i) != i}


@pytest.mark.parametrize("threshold", [0.6, 0.85, 1.0])
def test_duplicates_equal_brute_force(spark, card, threshold):
    rng = random.Random(4)
    base = ["what is the role of the cell wall", "which organelle makes the energy of a cell", "what is the role of the cell walls?", "how do plants store light"]
    cards = []
    for _ in range(60):
        q = list(rng.choice(base))
        for _ in range(rng.randint(0, 6)):
            q[rng.randrange(len(q))] = rng.choice("abcdefg ?!")
        cards.append(card(question="".join(q) * rng.choice([1, 1, 1, 8]), topic=rng.choice(["Cells", "cells", "Plants", None])))
    got = dedup.deduplicate(cards_to_deck(spark, cards), threshold=threshold)
    want = brute_groups(cards, threshold)
    assert {r.id: r.duplicate_of for r in got.dropped.collect()} == want
    assert sorted(r.id for r in got.deck.collect()) == [i for i in range(60) if i not in want]


def test_cleaning_queries_at_the_default_threshold(spark, tmp_path):
    import pyarrow as pa
    import pyarrow.parquet as pq

    from lamina.plans import fixtures as fx
    from lamina.plans.catalogue import QUERIES, _coverage

    rng = random.Random(5)
    base = ["The old harbour was closed for the winter and all boats were brought to land before the storm came over the hills.", "A museum of local history opens in the former mill beside the river, with maps, tools and letters from two centuries."]
    texts = []
    for _ in range(40):
        t = list(rng.choice(base))
        for _ in range(rng.randint(0, 8)):
            t[rng.randrange(3, len(t))] = rng.choice("abcdefg ")
        texts.append("".join(t))
    n = len(texts)
    pq.write_table(pa.table({"doc_id": pa.array(range(n), pa.int64()), "text": texts, "lang": ["en"] * n, "source": ["s"] * n}), tmp_path / "documents.parquet")
    at = str(tmp_path)
    cards = [r.asDict() for r in fx.cards(spark, at).orderBy("id").collect()]
    want = brute_groups(cards, dedup.THRESHOLD)
    assert len(want) > len(brute_groups(cards, 1.0))
    kept = fx.cards(spark, at).filter(~fx.F.col("id").isin([*want]))
    good = quality.filter_quality(kept)
    assert sorted(r.id for r in QUERIES["q30b_near_deduplicate_kept"](spark, at).collect()) == [i for i in range(n) if i not in want]
    assert {r.id: r.duplicate_of for r in QUERIES["q31b_near_deduplicate_dropped"](spark, at).collect()} == want
    assert QUERIES["q19b_near_clean_stats"](spark, at).first() == (len(want), good.dropped.count())
    assert sorted(QUERIES["q40b_near_clean_pipeline"](spark, at).collect()) == sorted(_coverage(good.deck).collect())


@pytest.mark.parametrize("block", [7, 2000])
def test_large_topics_in_blocks(spark, card, monkeypatch, block):
    """Several topics with chains of similar questions, cut into small blocks or none; the bounds lose no link."""
    monkeypatch.setattr(dedup, "BLOCK", block)
    rng = random.Random(block)
    cards = []
    for topic in ("A", "b", "C"):
        q = list("how does the water in a river find its way down to the sea after heavy rain")
        for _ in range(30):
            for _ in range(rng.randint(0, 6)):
                q[rng.randrange(len(q))] = rng.choice("abc defg")
            cards.append(card(question="".join(q)[: rng.randint(40, len(q))], topic=topic))
    want = brute_groups(cards, dedup.THRESHOLD)
    assert {r.id: r.duplicate_of for r in dedup.deduplicate(cards_to_deck(spark, cards)).dropped.collect()} == want and want


def test_common_subsequence():
    def plain(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            old, row = row, [0]
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[j]))
        return row[-1]

    rng = random.Random(1)
    for _ in range(300):
        a, b = ("".join(rng.choice("abcé") for _ in range(rng.randint(0, 30))) for _ in range(2))
        assert dedup.common_subsequence(a, b) == plain(a, b)
        assert difflib.SequenceMatcher(None, a, b).ratio() * (len(a) + len(b)) <= 2 * plain(a, b) + 1e-9


def test_matches_of_long_texts_equal_difflib():
    rng = random.Random(2)
    for _ in range(200):
        signs = "abcdefghij klmnopqrstuvwxyzé"[: rng.choice([3, 8, 28])]
        x = "".join(rng.choice(signs) for _ in range(rng.randint(180, 900)))
        y = list(x)
        for _ in range(rng.randint(0, 120)):
            i = rng.randrange(len(y))
            y[i : i + rng.randint(0, 1)] = rng.choice(["", rng.choice(signs), rng.choice(signs) * 5])
        y = "".join(y)
        ratio = difflib.SequenceMatcher(None, x, y).ratio()
        assert dedup.reaches(x, y, 0.85) == (ratio >= 0.85)
        if len(y) >= 200:
            assert 2.0 * dedup.matched(x, y) / (len(x) + len(y)) == ratio


def test_long_questions_of_a_topic_are_sorted_out_before_the_ratio(spark, card, monkeypatch):
    """Long texts of one vocabulary share characters, so that counts of characters let every pair through."""
    rng = random.Random(4)
    words = ["".join(rng.choice("etaoinsrhdlucmfywgpbvk") for _ in range(rng.randint(2, 9))) for _ in range(300)]
    base = [[rng.choice(words) for _ in range(80)] for _ in range(30)]
    texts = [" ".join(w) for w in base] + [" ".join(w[:40] + [rng.choice(words)] + w[41:]) for w in base]
    cards = [card(question=t) for t in texts]
    frame = cards_to_deck(spark, cards)
    got = {(r.a, r.b) for r in dedup.similar_pairs(frame).collect()}
    ratio = lambda i, j: difflib.SequenceMatcher(None, *(" ".join(texts[k].split()) for k in (i, j))).ratio()
    assert got == {(i, j) for i in range(60) for j in range(i + 1, 60) if ratio(i, j) >= dedup.THRESHOLD} and got
    signs = dedup.gram_bits(dedup.pd.Series(texts))
    words = signs[[f"s{i}" for i in range(dedup.WORDS)]].to_numpy()
    through = 0
    for i in range(60):
        for j in range(i + 1, 60):
            both, common = len(texts[i]) + len(texts[j]), sum((x & y & 2**64 - 1).bit_count() for x, y in zip(words[i].tolist(), words[j].tolist(), strict=True))
            cuts = (dedup.GRAM - 1) * min(max(signs["rare"][i], signs["rare"][j]), both * (1 - dedup.THRESHOLD))
            through += common >= max(signs["bits"][k] - len(texts[k]) for k in (i, j)) + dedup.THRESHOLD * both / 2 - cuts
    assert len(got) <= through < 60 * 59 / 2 / 4


def test_whole_table_equals_brute_force(spark):
    from conftest import DATA

    from lamina.plans import fixtures as fx
    from lamina.plans.catalogue import QUERIES

    cards = [r.asDict() for r in fx.cards(spark, str(DATA)).orderBy("id").collect()]
    want = brute_groups(cards, dedup.THRESHOLD)
    ids = [c["id"] for c in cards]
    got = QUERIES["q31b_near_deduplicate_dropped"](spark, str(DATA)).collect()
    assert {r.id: r.duplicate_of for r in got} == {ids[i]: ids[k] for i, k in want.items()}


def test_groups_and_empty(spark, card):
    deck = cards_to_deck(spark, [card(), card(question="what does a RIBOSOME do"), card(topic="x")])
    assert [r.ids for r in dedup.find_near_duplicates(deck).collect()] == [[0, 1]]
    assert dedup.deduplicate(deck.limit(0)).deck.count() == 0


def test_quality(spark, card):
    deck = cards_to_deck(spark, [card(), card(answer="short"), card(question="Is it a long enough answer text?", answer="a long enough answer"), card(answer="?!?!?!?!?!?!?!?!?!")])
    got = quality.filter_quality(deck)
    assert {r.id: r.reason for r in got.dropped.collect()} == {1: "answer too short", 2: "answer restates question"}
    assert quality.filter_quality(deck, min_answer_chars=0).dropped.count() == 1
    assert quality.filter_quality(deck.limit(0)).dropped.columns[-1] == "reason"


def test_clean_dedupes_first(spark, card):
    deck = Deck.from_cards(spark, [card(answer="bad"), card(), card(question="Something else entirely here?")])
    cleaned, stats = deck.clean()
    assert [r.id for r in cleaned.df.collect()] == [2]
    assert stats["duplicates_dropped"].first()[0] == 1 and stats["quality_dropped"].first()[0] == 1


def test_coverage_and_search(spark, card):
    deck = cards_to_deck(spark, [card(), card(difficulty="hard", card_type="cloze"), card(topic="cells"), card(topic=None), card(difficulty="odd")])
    rows = [tuple(r) for r in coverage.coverage_by_topic(deck).collect()]
    assert rows == [("Cells", 3, 1, 0, 1, ["cloze", "definition"]), ("cells", 1, 1, 0, 0, ["definition"])]
    assert [tuple(r) for r in coverage.difficulty_mix(deck).collect()] == [("easy", 3), ("medium", 0), ("hard", 1)]
    assert coverage.keyword_search(deck, "RIBO.ome").count() == 5 and coverage.keyword_search(deck, "nothing").count() == 0
    assert tuple(coverage.search_count(deck, "amino").first()) == (5, 5)
    assert coverage.coverage_by_topic(deck.limit(0)).count() == 0


def test_persistence(spark, card, tmp_path):
    odd = [card(question='a "quoted", text\nwith \\ lines\t', answer="NA"), card(answer=" None ", topic=""), card(source_excerpt=None)]
    deck = Deck.from_cards(spark, odd)
    deck.to_csv(f"{tmp_path}/csv")
    deck.to_parquet(f"{tmp_path}/parquet")
    want = [tuple(r) for r in deck.df.orderBy("id").collect()]
    for back in (Deck.read_csv(spark, f"{tmp_path}/csv"), Deck.read_parquet(spark, f"{tmp_path}/parquet")):
        assert [tuple(r) for r in back.df.orderBy("id").collect()] == want
