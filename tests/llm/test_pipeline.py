"""Each stage of the corpus pipeline on its own input, against the plain versions."""

import collections

import numpy as np
import pytest
from conftest import DATA
from test_llm_small import brute_components, brute_hits, brute_lines

import corpus_pipeline as P
from lamina.llm import tokens
from lamina.storage import materialize, table

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


@pytest.fixture(scope="module")
def stages(spark):
    """The input of each stage and its output."""
    docs, out = table(spark, str(DATA), "documents"), []
    for name, stage in P.STAGES:
        after = materialize(stage(spark, docs, str(DATA)), name)
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def texts(frame):
    """Texts in the order of doc_id, and the ids."""
    rows = sorted(frame.select("doc_id", "text").collect())
    return [r.doc_id for r in rows], [r.text for r in rows]


def test_columns(stages):
    for name, (before, after) in stages.items():
        assert before.columns == P.COLUMNS and (name == "packing" or after.columns == P.COLUMNS)


def test_toxicity_keeps_clean_documents(spark, stages):
    before, after = stages["toxicity"]
    gone = {r.doc_id for r in before.join(after, "doc_id", "left_anti").collect()}
    labels = {r.doc_id: (r.quality, r.toxic) for r in table(spark, str(DATA), "labels").collect()}
    assert not any(labels[i][1] == 0 and labels[i][0] == 1 for i in gone if i in labels)
    words = {"idiot", "moron", "scum", "worthless", "pathetic", "loser", "trash", "clown", "stupid", "disgusting"}
    toxic = lambda frame: sum(len(words & set(t.lower().split())) > 1 for t in texts(frame)[1] if t)
    assert toxic(after) <= 0.2 * toxic(before)  # the smallest tables have 87 labels


def test_line_dedup(stages):
    before, after = stages["line_dedup"]
    ids, old = texts(before)
    want = brute_lines(old)
    got_ids, new = texts(after)
    left = [i for i in range(len(ids)) if not want[i][1] or want[i][2].strip("\x20\t\n\v\f\r")]
    assert got_ids == [ids[i] for i in left] and [t or "" for t in new] == [want[i][2] for i in left]
    assert len(left) < len(ids)  # some documents hold nothing that others do not
    assert all(r.n_chars == len(r.text) for r in after.collect())


def test_near_dedup(stages):
    before, after = stages["near_dedup"]
    ids, old = texts(before)
    want = brute_components(old, 5, 80)
    assert texts(after)[0] == [ids[i] for i in range(len(ids)) if want[i][1] == i]


def test_decontamination(spark, stages):
    before, after = stages["decontamination"]
    ids, old = texts(before)
    want = brute_hits(old, [(r.item_id, r.text) for r in table(spark, str(DATA), "benchmark").collect()])
    assert texts(after)[0] == [ids[i] for i in range(len(ids)) if not want[i][3]]


def test_packing(stages):
    before, after = stages["packing"]
    ids, old = texts(before)
    tokenizer = tokens.WordTokenizer().tokenizer
    length, sequences = collections.Counter(), collections.Counter()
    for r in after.collect():
        length[r.doc_id] += r.length
        sequences[r.sequence_id] += r.length
    assert length == {i: len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1 for i, t in zip(ids, old)}
    assert max(sequences.values()) <= 2048
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sequences.values())
    assert padding < 0.02 * np.sum(list(length.values()))


def odd_documents(spark):
    """Null ids and texts, blank and repeated rows, one very long text."""
    long = " ".join(f"w{i}" for i in range(20_000))
    same = "one sentence that stands in two documents and is long enough to count as a line"
    rows = [(None, None), (None, same), (1, None), (2, ""), (3, " \n "), (4, long), (5, long), (6, same), (7, same), (7, same), (8, "short"), (8, "other text of the same id")]
    return spark.createDataFrame([(i, t, "en", "s", None if t is None else len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")


def test_stages_on_odd_and_empty_tables(spark):
    kept = {"toxicity": 12, "line_dedup": 9, "near_dedup": 9, "decontamination": 12}
    for name, stage in P.STAGES:
        docs = odd_documents(spark)
        out = stage(spark, docs, str(DATA))
        if name == "packing":
            assert out.agg({"length": "sum"}).first()[0] > 40_000 and out.select("doc_id").distinct().count() == 9
        else:
            assert out.columns == P.COLUMNS and out.count() == kept[name], name
        assert stage(spark, docs.limit(0), str(DATA)).count() == 0


def test_run(spark):
    assert P.run(spark, str(DATA)).count() > 0
