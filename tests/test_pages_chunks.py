import random
import re

import pytest
from pyspark.sql import functions as F

from lamina.operators import chunks as C, pages as P
from lamina.sources import files


def pages_of(spark, *texts, source="s"):
    return spark.createDataFrame([(source, i, t) for i, t in enumerate(texts, 1)], "source string, page int, text string")


def texts_of(frame):
    return [r.text for r in frame.orderBy("page").collect()]


def test_running_lines(spark):
    pages = [f"BIOL 101\nbody {w}\nPage {i}" for i, w in enumerate(["alpha", "beta", "gamma", "delta"], 1)]
    assert texts_of(P.strip_running_lines(pages_of(spark, *pages))) == [f"body {w}" for w in ["alpha", "beta", "gamma", "delta"]]
    assert texts_of(P.strip_running_lines(pages_of(spark, *pages[:2]))) == pages[:2]


def test_header_after_blank_lines_is_counted_but_stays(spark):
    pages = [f"\n\nHEAD\nline {w}\nmore {w}" for w in "abc"]
    assert all("HEAD" in t for t in texts_of(P.strip_running_lines(pages_of(spark, *pages))))


def test_numbers_keep_gaps_after_empty_pages(spark):
    out = P.finalize(pages_of(spark, "one", "  \n ", None, "four")).filter("text <> ''")
    assert [(r.page, r.text) for r in out.orderBy("page").collect()] == [(1, "one"), (4, "four")]


def test_load(spark, tmp_path):
    (tmp_path / "a.md").write_text("# Title\n\nSome  text.")
    (tmp_path / "b.txt").write_bytes(b"bad \xff byte")
    got = {r.source: r.text for r in files.load(spark, f"{tmp_path}/*").collect()}
    assert got == {"a.md": "# Title\n\nSome text.", "b.txt": "bad � byte"}
    (tmp_path / "c.pptx").write_text("x")
    with pytest.raises(files.UnsupportedFileError, match=r"\.markdown, \.md, \.pdf, \.txt"):
        files.load(spark, f"{tmp_path}/*")
    with pytest.raises(files.EmptyDocumentError):
        files.load_bytes(spark, b"   \n\n ", "empty.md")
    pages, errors = files.ingest(files.read_files(spark, f"{tmp_path}/*"))
    assert pages.count() == 2 and [r.source for r in errors.collect()] == ["c.pptx"]
    stats = P.document_stats(pages).filter("source = 'a.md'").first()
    assert (stats.page_count, stats.char_count) == (1, 19)


def test_pdf_pages(monkeypatch):
    """The table of pages, with a stand-in for the optional reader."""
    import sys
    from types import SimpleNamespace as NS

    import pandas as pd

    reader = lambda stream: NS(pages=[NS(extract_text=lambda t=t: t) for t in stream.read().decode().split("|")] + [NS(extract_text=lambda: None)])
    monkeypatch.setitem(sys.modules, "pypdf", NS(PdfReader=reader))
    frame = pd.DataFrame({"source": ["a.pdf", "b.pdf"], "content": [b"one|two", b"three"]})
    got = pd.concat(files._pdf_pages(iter([frame, frame.iloc[:0]])))
    assert got.values.tolist() == [["a.pdf", 1, "one"], ["a.pdf", 2, "two"], ["a.pdf", 3, ""], ["b.pdf", 1, "three"], ["b.pdf", 2, ""]]


def test_ingest_once(spark, tmp_path):
    (tmp_path / "a.md").write_text("first text")
    one, two = (files.ingest_once(spark, f"{tmp_path}/*") for _ in range(2))
    assert one is two and [r.text for r in one.collect()] == ["first text"]
    (tmp_path / "a.md").write_text("second, longer text")
    assert [r.text for r in files.ingest_once(spark, f"{tmp_path}/*").collect()] == ["second, longer text"]


def test_running_offsets(spark):
    from lamina.operators.numbering import running_offsets

    rng = random.Random(7)
    rows = [(i, f"s{i}", rng.randint(0, 5)) for i in rng.sample(range(1000), 300)]
    out = running_offsets(spark.createDataFrame(rows, "o int, s string, n long").repartition(5), ["o", "s"], "n", "at")
    total, want = 0, {}
    for o, _, n in sorted(rows):
        want[o], total = total, total + n
    assert {r.o: r["at"] for r in out.collect()} == want
    assert running_offsets(spark.createDataFrame([], "o int, n long"), ["o"], "n", "at").count() == 0


def test_long_documents_group_as_short_ones(spark):
    """Units beyond one inner fold."""
    sentences = [f"Sentence {'x' * (i % 23)}." for i in range(3000)]
    got = spark.createDataFrame([(" ".join(sentences),)], "t string").select(C.hard_split(F.col("t"), 20)).first()[0]
    assert got == [" ".join(sentences[i] for i in own) for own in C._groups(sentences, " ", 20, lambda t: max(1, int(len(t) / 3.5)))]


def test_max_below_min_raises(spark):
    with pytest.raises(ValueError):
        C.chunk_documents(pages_of(spark, "x"), max_tokens=10, min_tokens=99)


def sample_pages(spark, seed):
    rng = random.Random(seed)
    rows = []
    for d in range(6):
        for p in range(rng.randint(1, 4)):
            parts = []
            for _ in range(rng.randint(0, 8)):
                kind = rng.random()
                if kind < 0.3:
                    parts.append(f"# Heading {rng.randint(1, 99)}")
                else:
                    sentence = lambda: " ".join(["W" + "o" * rng.randint(1, 9)] + ["w" * rng.randint(1, 9) for _ in range(rng.randint(2, 20))]) + rng.choice([". ", "! ", "; "])
                    parts.append("".join(sentence() for _ in range(rng.randint(1, 12))).strip())
            rows.append((f"d{d}", p + 1, rng.choice(["\n\n", "\n"]).join(parts)))
    return spark.createDataFrame(rows, "source string, page int, text string")


@pytest.mark.parametrize("seed", [1, 2])
def test_native_chunks_equal_the_python_path(spark, seed):
    pages = sample_pages(spark, seed)
    native = C.chunk_documents(pages, max_tokens=60, min_tokens=20).orderBy("index").collect()
    python = C.chunk_documents(pages, max_tokens=60, min_tokens=20, token_counter=lambda t: max(1, int(len(t) / 3.5))).orderBy("index").collect()
    assert [tuple(r) for r in native] == [tuple(r) for r in python]
    assert [r["index"] for r in native] == list(range(len(native)))
    assert all(r.token_count <= 72 for r in native)
    words = lambda texts: sorted(w for t in texts for w in re.findall(r"\w+", t))
    assert words(r.text for r in native) == words(r.text for r in pages.collect())
    for source in {r.source for r in native}:
        own = [r for r in native if r.source == source]
        assert all(a.end_page <= b.end_page and a.start_page <= a.end_page for a, b in zip(own, own[1:]))


def test_heading_stays_with_its_text_and_runt_merges(spark):
    out = C.chunk_documents(pages_of(spark, "# A\n\n" + "word " * 60 + "\n\n# B\n\nshort"), max_tokens=90, min_tokens=20)
    got = [r.text for r in out.orderBy("index").collect()]
    assert len(got) == 1 and got[0].endswith("# B\n\nshort")


def test_injected_counter(spark):
    out = C.chunk_documents(pages_of(spark, "a b c\n\nd e f\n\ng h i"), max_tokens=3, min_tokens=1, token_counter=lambda t: len(t.split()))
    assert [r.token_count for r in out.orderBy("index").collect()] == [3, 3, 3]


def test_empty(spark):
    empty = pages_of(spark, "x").limit(0)
    assert C.chunk_documents(empty).count() == 0 and P.finalize(empty).count() == 0
    assert C.split_blocks(pages_of(spark, "")).count() == 0


def test_plans_stay_native(spark):
    plan = C.chunk_documents(pages_of(spark, "a"))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Cartesian" not in plan and "SinglePartition" not in plan
