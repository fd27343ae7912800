"""The operators on small tables: defined edge cases and comparison with plain versions."""

import collections
import os
import random
import re
import textwrap
import time
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lamina import storage
from lamina.llm import ann, decontaminate as D, html, licenses, linededup, neardup, packing, pii, sharding, textvec as V, tokens, toxicity

SCHEMA = "doc_id long, text string, lang string, n_lines long, shard int, component_id long, spans string, cell int"


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


@pytest.fixture(scope="module")
def texts():
    """Nulls, empty and very long texts, ties, repeated rows, copies, shared lines and near copies."""
    rng = random.Random(11)
    word = lambda: "".join(rng.choice("abcdeéßñ") for _ in range(rng.randint(1, 7)))
    line = lambda n: " ".join(word() for _ in range(n))
    shared = [line(12) for _ in range(4)]
    out = [None, "", " \n\t\n", "One", "two words", "A b c", "a B c"]
    base = [line(60) for _ in range(4)]
    for b in base:
        for _ in range(7):
            words = b.split()
            for _ in range(rng.randint(0, 5)):
                words[rng.randrange(len(words))] = word()
            out.append(" ".join(words))
    for _ in range(25):
        parts = [line(rng.randint(1, 30)) for _ in range(rng.randint(1, 6))] + rng.sample(shared, rng.randint(0, 3))
        rng.shuffle(parts)
        out.append(rng.choice(["\n", "\n\n", "\r\n"]).join(parts))
    out += [out[-1], out[-2], out[-2].upper(), line(9000), "x" * 50_000, "\n".join([shared[0]] * 3)]
    return out


@pytest.fixture(scope="module")
def docs(spark, texts):
    rows = [(i, t, "en", 1, 2, 3, "s", 4) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[20], (None, "a text without an id, one two three", *rows[0][2:])], SCHEMA)


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


def by_id(frame):
    return {r.doc_id: r for r in frame.collect() if r.doc_id is not None}


# Words and hashes


def test_spans_and_hashes():
    column = pa.array(["ab  c", None, "", " é-X9", "ab"])
    data, offsets = V.column_bytes(column)
    starts, ends, first = V.spans(data, offsets, V.IS_ALNUM)
    assert [data[a:b].tobytes().decode() for a, b in zip(starts, ends)] == ["ab", "c", "é", "X9", "ab"]
    assert first.tolist() == [0, 2, 2, 2, 4, 5]
    hashes = V.span_hashes(data, starts, ends)
    assert hashes[0] == hashes[4] and len(set(hashes.tolist())) == 4
    long = pa.array(["a" * (V.BLOCK + 7) + " b " + "c" * 10, "b"])
    data, offsets = V.column_bytes(long)
    starts, ends, _ = V.spans(data, offsets, V.IS_ALNUM)
    hashes = V.span_hashes(data, starts, ends)
    assert hashes[1] == hashes[3]
    sliced = column.slice(3, 2)
    assert V.column_bytes(sliced)[1].tolist() == [0, 6, 8]


# Line deduplication


def brute_lines(texts):
    key = lambda x: lower(x.strip("\x20\t\n\v\f\r"))
    holders = collections.defaultdict(set)
    for i, t in enumerate(texts):
        for x in (t or "").split("\n"):
            if len(key(x)) >= 10:
                holders[key(x)].add(i)
    out = {}
    for i, t in enumerate(texts):
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (len(holders.get(key(x), ())) > 1 and min(holders[key(x)]) != i)]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("bits", [linededup.MIN_FILTER_BITS, linededup.SEGMENT_BITS])
def test_line_dedup(docs, texts, bits):
    got = linededup.dedup_lines(docs, bits=bits)
    assert {i: (r.n_lines, r.n_dropped, r.text or "") for i, r in by_id(got).items()} == brute_lines(texts)
    assert got.count() == docs.count()


def test_line_filters_have_no_misses():
    rng = np.random.default_rng(5)
    seen = rng.integers(0, 2**63, 3000).astype(np.uint64)
    bitmap = np.zeros(linededup.MIN_FILTER_BITS // 8, np.uint8)
    at = linededup.probes(seen, linededup.MIN_FILTER_BITS)
    linededup.set_bits(bitmap, at)
    assert linededup.all_set(bitmap, at).all()
    other = linededup.probes(rng.integers(0, 2**63, 3000).astype(np.uint64), linededup.MIN_FILTER_BITS)
    assert linededup.all_set(bitmap, other).mean() < 0.01


# Near-duplicates


def brute_components(texts, n, percent):
    sets = []
    for t in texts:
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", lower(t or "")) if x]
        sets.append({tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set()))
    low = list(range(len(texts)))

    def root(i):
        while low[i] != i:
            i = low[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                a, b = sorted((root(i), root(j)))
                low[b] = a
    return {i: (len(sets[i]), root(i)) for i in range(len(texts))}


@pytest.mark.parametrize("words, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, texts, words, percent):
    got = neardup.near_duplicates(docs, words=words, percent=percent)
    rows = got.collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows if r.doc_id is not None} == brute_components(texts, words, percent)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows if r.doc_id is not None) and len(rows) == docs.count()
    assert [(r.component_id, r.kept) for r in rows if r.doc_id is None] == [(None, True)]


def test_near_duplicates_on_a_chain(spark):
    """A large group in which most pairs lie below the similarity, so that links must be found beyond the stars."""
    words = [f"w{i}" for i in range(90 + 4 * 60)]
    texts = [" ".join(words[4 * i : 4 * i + 90]) for i in range(60)] + [" ".join(words[4 * i : 4 * i + 90]) + " end" for i in range(0, 60, 7)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = by_id(neardup.near_duplicates(docs, words=3, percent=85))
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == brute_components(texts, 3, 85)


def test_members_of_buckets_are_dealt_out_once(spark):
    nodes = spark.createDataFrame([(1, 5, [10, 20]), (2, 6, [10, 30]), (3, 7, [10, 20]), (4, 8, [40, 50])], "id long, n long, bands array<long>")
    got = neardup.bucket_members(nodes)
    rows = got.collect()
    assert sorted((r.bucket, r.members, r.weight, r.id, r.n) for r in rows) == [(10, 3, 18, 1, 5), (10, 3, 18, 2, 6), (10, 3, 18, 3, 7), (20, 2, 12, 1, 5), (20, 2, 12, 3, 7)]
    leads = {r.bucket: (r.lead, r.lead_n) for r in rows}
    assert all(leads[r.bucket] == (r.lead, r.lead_n) and r.lead_n == r.lead + 4 for r in rows)
    plan = neardup.bucket_members(nodes)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_sketch_fills_and_estimates():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    b = np.concatenate([a[:800], rng.integers(0, 2**63, 200).astype(np.uint64)])
    rows = neardup.sketches(np.concatenate([a, b, a[:1]]), np.array([0, 1000, 2000, 2001]))
    assert (rows != neardup._FREE).all()
    assert abs((rows[0] == rows[1]).mean() - 800 / 1200) < 0.15


# Decontamination


def brute_hits(texts, items):
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t or ""))
    windows = collections.defaultdict(set)
    for name, t in items:
        w = word(t)
        if w:
            n = min(13, len(w))
            for i in range(len(w) - n + 1):
                windows[tuple(w[i : i + n])].add(name)
    out = {}
    for d, t in enumerate(texts):
        w, hit, names = word(t), set(), set()
        for n in {len(x) for x in windows}:
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) in windows:
                    hit |= set(range(i, i + n))
                    names |= windows[tuple(w[i : i + n])]
        out[d] = (len(w), len(hit), sorted(map(str, names)), len(hit) > 0 and 20 * len(hit) >= len(w))
    return out


@pytest.mark.parametrize("block_bytes", [D.BLOCK_BYTES, 400])
def test_decontamination(spark, docs, texts, block_bytes):
    rng = random.Random(2)
    items = [(1, None), (2, ""), (3, "One"), (4, "two words"), (5, "a b c")]
    for i in range(10, 30):
        w = rng.choice([t for t in texts if t and len(t.split()) > 20]).split()
        at = rng.randrange(len(w) - 15)
        items.append((i, " ".join(w[at : at + rng.randint(3, 18)]).upper()))
    items.append((31, items[-1][1]))
    bench = spark.createDataFrame([*items, (None, "two words")], "item_id long, text string")
    got = by_id(D.decontaminate(docs, bench, block_bytes=block_bytes))
    want = brute_hits(texts, items)
    assert {i: (r.n_words, r.n_hit, list(r["items"]), r.contaminated) for i, r in got.items()} == want
    assert all(sum(s.stop - s.start for s in r.spans) == r.n_hit for r in got.values())


def test_no_benchmark(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert D.decontaminate(docs, bench).filter("contaminated OR n_hit > 0").count() == 0


def test_long_item_in_pieces():
    words = [f"q{i}" for i in range(9000)]
    batch = pa.RecordBatch.from_pydict({"item_id": ["a"], "text": [" ".join(words)]})
    parts = next(D.cut_items(iter([batch]))).column("text").to_pylist()
    windows = {tuple(p.split()[i : i + 13]) for p in parts for i in range(len(p.split()) - 12)}
    assert windows == {tuple(words[i : i + 13]) for i in range(9000 - 12)} and max(len(p.split()) for p in parts) <= D.PIECE_WORDS


# Sharding


def test_best_fit_equals_one_by_one():
    rng = random.Random(8)
    for _ in range(50):
        sizes = sorted({rng.randint(1, 60) for _ in range(12)}, reverse=True)
        counts = [rng.randint(1, 9) for _ in sizes]
        runs = sharding.best_fit(sizes, counts, 100)
        left = []
        for s, c in zip(sizes, counts):
            for _ in range(c):
                fits = [(r, b) for b, r in enumerate(left) if r >= s]
                if fits:
                    left[min(fits)[1]] -= s
                else:
                    left.append(100 - s)
        used = collections.Counter()
        for s, _, n, b in runs:
            used[b] += s * n
        assert sorted(used.values()) == sorted(100 - r for r in left)


def test_shards(docs, texts):
    rows = sharding.shard(docs, n_shards=5).collect()
    assert len(rows) == docs.count()
    size = collections.Counter()
    slots, where = collections.defaultdict(list), collections.defaultdict(set)
    for r in rows:
        text = texts[r.doc_id] if r.doc_id is not None else "a text without an id, one two three"
        assert r.size == len((text or "").encode()) + 8 and r.text_crc32 == zlib.crc32((text or "").encode())
        size[r.shard] += r.size
        slots[r.shard].append(r.slot)
        where[text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and max(map(len, where.values())) == 1
    rest = sorted(size.values())[:-1]
    assert max(rest) - min(rest) < 0.2 * max(rest) or max(rest) > 40_000
    fixed = sharding.shard(docs, n_shards=None, capacity=60_000).groupBy("shard").agg(F.sum("size").alias("n")).collect()
    assert all(r.n <= max(60_000, 9 * 9000) for r in fixed)


def test_slots_of_hot_ids_and_texts(spark, monkeypatch):
    """A third of all rows equal in everything, a third under one id and a third without an id: slots stay gapless."""
    monkeypatch.setattr(sharding, "BUCKET_ROWS", 20)
    rows = [(7, "a copy of a text")] * 300 + [(8, f"text {i}") for i in range(300)] + [(None, f"other text {i % 200}") for i in range(300)]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), n_shards=4).collect()
    slots = collections.defaultdict(list)
    for r in out:
        slots[r.shard].append(r.slot)
    assert collections.Counter(r.doc_id for r in out) == {7: 300, 8: 300, None: 300}
    assert len(slots) == 4 and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert len({r.shard for r in out if r.doc_id == 7}) == 1


# Packing


@pytest.mark.parametrize("window, limit", [(64, 4), (2048, 32)])
def test_pack(docs, texts, window, limit):
    rows = packing.pack(docs, window=window, limit=limit, max_padding=2).collect()
    tokenizer = tokens.WordTokenizer().tokenizer
    ids = {i: tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID] for i, t in enumerate(texts)}
    sequences, parts = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        assert r.ids_crc32 == zlib.crc32(r.ids) and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        if r.doc_id is not None and r.doc_id != 20:
            parts[r.doc_id].append((r.start, np.frombuffer(r.ids, "<u4").tolist(), r.doc_tokens))
    for i, own in parts.items():
        own.sort()
        assert sum((p[1] for p in own), []) == ids[i] and all(p[2] == len(ids[i]) for p in own)
        assert [p[0] for p in own] == [sum(len(q[1]) for q in own[:k]) for k in range(len(own))]
    assert set(parts) == set(ids) - {20}
    padding = 0
    for own in sequences.values():
        own.sort()
        total = sum(n for _, n in own)
        assert [o for o, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and total <= window
        padding += 0 if total & (total - 1) == 0 else window - total
    assert padding <= 0.05 * sum(r.length for r in rows)


def test_token_cache_restarts():
    own = tokens.WordTokenizer(cache_words=5)
    texts = ["Hello wörld, it's fine", None, "", "a b c d e f g", "hello HELLO 12 <|endoftext|> x"]
    for _ in range(2):
        for t in texts:
            ids, edges = own.encode(pa.array([t], pa.string()), 1)
            assert ids.tolist() == own.tokenizer.encode(t or "", add_special_tokens=False).ids + [1] and edges.tolist() == [0, len(ids)]


def test_token_cache_smaller_than_a_text():
    own = tokens.WordTokenizer(cache_words=1000)
    long = " ".join(f"w{i:x}" for i in range(1200))
    for t in ("w0 w1 w2 w3 w4", long, "w5 other", long):
        ids, _ = own.encode(pa.array([t]))
        assert ids.tolist() == own.tokenizer.encode(t, add_special_tokens=False).ids


# Personal data


BASE = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda m: True),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda m: all(int(x) <= 255 for x in m.split("."))),
    ("card", r"[0-9]([\x20-]?[0-9])+", lambda m: 12 <= len(re.sub("[ -]", "", m)) <= 19 and pii.luhn(re.sub("[ -]", "", m))),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda m: 9 <= len(re.sub("[^0-9]", "", m)) <= 15),
]


def brute_pii(text):
    found = [(k, m.start(), m.end()) for k, p, ok in BASE for m in re.finditer(p, text) if ok(m.group())]
    return sorted(found, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_pii_equals_patterns():
    rng = random.Random(1)
    kinds = ["0123456789. -+()", "ab@.-0 é%", "0.1", "12345 -", "+1 (.)", "@a.", "4 1-", "0123456789"]
    for _ in range(20_000):
        text = "".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 40))) if rng.random() < 0.5 else "".join(rng.choice(k) for k in [rng.choice(kinds)] for _ in range(rng.randint(0, 40)))
        assert [s for s in pii.find(text) if s[0] in pii.BASE_KINDS] == brute_pii(text), text


def test_pii_added_kinds_and_redaction(spark):
    text = 'Mail josé@exämple.fr, see https://bob:pw12@host.example/x, IBAN DE89370400440532013000, SSN 078-05-1120, account no. 12345678 and token = "0123456789abcdef". plain words: the account of a token.'
    kinds = [text[a:b] for k, a, b in pii.find(text) if k in pii.ADDED_KINDS]
    assert kinds == ["josé@exämple.fr", "https://bob:pw12@host.example/x", "DE89370400440532013000", "078-05-1120", "12345678", "0123456789abcdef"]
    assert pii.find("A clean sentence with no data, version 3.2 of 2024.") == []
    docs = spark.createDataFrame([(1, "to a@b.co now"), (2, None)], "doc_id long, text string")
    assert {r.doc_id: r.text for r in pii.redact(docs).collect()} == {1: "to <email> now", 2: None}


def grows_linearly(f, make, n):
    """Four times the input takes well under the sixteen times that a quadratic cost would."""

    def best(k):
        text, times = make(k), []
        for _ in range(3):
            began = time.perf_counter()
            f(text)
            times.append(time.perf_counter() - began)
        return min(times)

    return best(4 * n) < 9 * best(n) + 0.02


@pytest.mark.parametrize("unit", ["a", "1", "+1", "1.1", "a@", "1 ", "token=", 'token="', "-token= ", "a://b:c@d", "a://b", "account 1", "iban ", "a.b@c"])
def test_pii_is_linear(unit):
    assert grows_linearly(pii.find, lambda n: unit * n, 10_000)


@pytest.mark.parametrize("units", [("<ul>", ""), ("<ul><li>", ""), ("<div class=a>", "<p>x"), ("<span>", "</b>"), ("<div>", "<p>a"), ("<b>", "<header>")])
def test_extraction_is_linear(units):
    assert grows_linearly(html.main_text, lambda n: units[0] * n + "text " + units[1] * n, 2000)


def test_carried_columns_give_way_to_results(spark):
    names = ["p_toxic", "is_toxic", "n_words", "n_hit", "spans", "items", "contaminated", "licenses", "n_lines", "n_dropped", "drop", "lang"]
    docs = spark.createDataFrame([(1, "a line of some length\nb", *["x"] * len(names))], ", ".join(["doc_id long, text string", *(f"{n} string" for n in names)]))
    bench = spark.createDataFrame([(1, "some length")], "item_id long, text string")
    labels = spark.createDataFrame([(1, 1, 0)], "doc_id long, quality int, toxic int")
    carry = tuple(names)
    for frame, name, want in (
        (toxicity.toxicity(docs, labels, carry=carry), "is_toxic", False),
        (D.decontaminate(docs, bench, carry=carry), "n_hit", 2),
        (licenses.scan_licenses(docs, carry=carry), "licenses", []),
        (linededup.dedup_lines(docs, carry=carry), "n_lines", 2),
        (pii.find_pii(docs, carry=carry), "spans", []),
    ):
        row = frame.first()
        assert row[name] == want and row.lang == "x" and len(set(frame.columns)) == len(frame.columns)
    pages = spark.createDataFrame([(1, "u", "<p>text</p>", "x")], "page_id long, url string, html string, text string")
    assert html.extract(pages, carry=("url", "text")).first().text == "text"


def test_near_duplicates_of_one_id(spark):
    """Rows that share an id are one document, linked by any of its texts."""
    a, b, c = (" ".join(f"{s}{i}" for i in range(40)) for s in "abc")
    rows = [(5, a), (5, b), (2, a), (9, b + " x"), (7, c), (7, c)]
    got = neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == 6 and {(r.doc_id, r.component_id) for r in got} == {(5, 2), (2, 2), (9, 2), (7, 7)}


def test_repeated_items_stand_once(spark, docs):
    item = (1, " ".join(f"w{i}" for i in range(20)))
    once, many = (spark.createDataFrame([item] * n, "item_id long, text string") for n in (1, 60))
    one = spark.createDataFrame([(1, "start " + item[1] + " end")], "doc_id long, text string")
    rows = [D.decontaminate(one, bench, block_bytes=10**6).first() for bench in (once, many)]
    assert rows[0] == rows[1] and rows[0].n_hit == 20


def test_the_fit_takes_little_of_the_driver():
    rng = np.random.default_rng(3)
    n = 3000
    y = {"first": (rng.random(n) < 0.3).astype(float), "second": (rng.random(n) < 0.1).astype(float)}
    rows = np.repeat(np.arange(n), 200)
    hashes = rng.integers(0, 1 << toxicity.HASH_BITS, len(rows)) >> rng.integers(0, 16, len(rows))
    hashes[::20] = 7 + 2 * y["first"][rows[::20]] + y["second"][rows[::20]]
    rows, hashes = toxicity.distinct(rows, hashes.astype(np.uint32))
    tracemalloc.start()
    chain = toxicity.fit_chain(rows.astype(np.int32), hashes, rng.normal(size=(n, 2)), y, np.arange(n) % toxicity.FOLDS)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert all(len(m.features) for m in chain.models)
    assert peak < 45e6  # two tables of all 4 million hashes as 64-bit counts are 67 MB


def test_written_tables_bear_no_marker(spark):
    table = storage.materialize(spark.range(5), "plain")
    where = storage.written(spark)[-1]
    assert sorted(r.id for r in table.collect()) == [0, 1, 2, 3, 4]
    assert not [p for p in os.listdir(where.removeprefix("file:")) if "SUCCESS" in p]
    storage.discard(spark, [where])


def test_toxicity_settles_repeated_labels(spark, labelled):
    docs, labels = labelled.select("doc_id", "text"), labelled.select("doc_id", "quality", "toxic")
    twice = labels.unionByName(labels.filter("toxic = 1").withColumn("toxic", F.lit(0)))
    one, two = (by_id(toxicity.toxicity(docs, x)) for x in (labels, twice))
    assert all(one[i].p_toxic == two[i].p_toxic for i in one)
    only = labels.filter("toxic = 0 AND quality = 1")
    assert toxicity.toxicity(docs, only).filter("is_toxic OR is_low_quality").count() == 0
    few = toxicity.train(docs, labels, dict(toxicity.CATEGORIES), fit_bytes=20_000)
    assert len(few.models) == 2


def test_chain_links_are_optimal_and_out_of_fold():
    rng = np.random.default_rng(2)
    n = 300
    held = rng.random((n, 30)) < 0.3
    y = {"first": (held[:, 0] | (rng.random(n) < 0.05)).astype(float), "second": (held[:, 1] & held[:, 0]).astype(float)}
    rows, hashes = np.nonzero(held)
    rows, hashes, dense, folds = rows.astype(np.int32), hashes.astype(np.uint32), rng.normal(size=(n, 2)), np.arange(n) % toxicity.FOLDS
    chain = toxicity.fit_chain(rows, hashes, dense, y, folds)
    # The second link's earlier log-odds come from models that have not seen the row.
    out = np.zeros(n)
    for f in range(toxicity.FOLDS):
        own = folds[rows] != f
        index = np.cumsum(folds != f) - 1
        model = toxicity.fit(index[rows[own]].astype(np.int32), hashes[own], dense[folds != f], y["first"][folds != f])
        out[folds == f] = model.log_odds(np.bincount(rows, model.table()[hashes], n), dense)[folds == f]
    z = np.concatenate([dense, np.clip(out, -12, 12)[:, None]], axis=1)
    model = chain.models[1]
    odds = model.log_odds(np.bincount(rows, model.table()[hashes], n), z)
    error = 1 / (1 + np.exp(-odds)) - y["second"]
    scaled = (z - model.mean) / model.scale
    slope = np.concatenate([error @ scaled + toxicity.RIDGE * model.dense, [error.sum()], [error @ held[:, h] + toxicity.RIDGE * w for h, w in zip(model.features, model.weights)]])
    assert len(model.features) and np.abs(slope).max() < 0.5 and np.allclose(model.mean, z.mean(axis=0))


def test_license_sample_ignores_the_order_of_rows(spark):
    words = "the house stood by a river and nobody had lived in it for years while boats went past".split()
    rng = random.Random(3)
    rows = [(i, "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(6)) + ("\nLicensed under the Foo Public License." if i % 9 == 0 else "")) for i in range(80)]
    rows.append((80, "x y " * 5000))
    one, two = (by_id(licenses.scan_licenses(spark.createDataFrame(x, "doc_id long, text string").repartition(n), fit_lines=100)) for x, n in ((rows, 1), (rows[::-1], 5)))
    assert {i: r.licenses for i, r in one.items()} == {i: r.licenses for i, r in two.items()} and one[0].licenses


@pytest.mark.parametrize(
    "text, family",
    [
        ("Everything in this folder may be reused under the terms of the Apache License, Version 2.0, see there.", "Apache"),
        ("Unless stated otherwise all photographs are available under a Creative Commons Attribution-ShareAlike 4.0 International License here.", "CC-BY-SA"),
        ("The tools come under the GNU Lesser General Public License, version 3 or any later one.", "LGPL"),
        ("Please note: code is Mozilla Public License 2.0, documentation is not.", "MPL"),
        ("We chose the BSD 3-Clause License for the whole project.", "BSD"),
        ("The commission reads the report on public works and general terms of trade.", None),
        ("Her driving licence expired, so she took the bus to the public library.", None),
        ("The foundation gave software to schools, free of charge.", None),
    ],
)
def test_licenses_in_other_phrasings(license_model, text, family):
    assert [f for _, f in license_lines(license_model, text)] == ([family] if family else [])


def test_pii_on_table(docs):
    assert pii.find_pii(docs).count() == docs.count()


# Pages


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p>";</script></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=1>Home</a></li><li><a href=2>News</a></li></ul></nav><div class="cookie-notice"><p>We use cookies, and more, to serve you better.</p></div>
<div id=page><article><h1>Head&amp;line</h1><p>First   paragraph, with <b>bo</b>ld text, commas,
and a <a href=x>link</a>.<p>Short one.<div class="ad">Buy, now, this, product, it is great</div><blockquote>Quoted &#8220;text&#8221;&nbsp;here, long enough to count.</blockquote></article>
<aside><p>Side, bar, text, that is long, too.</p></aside><section id="comments"><p>Nice, post, thank you, I liked it, a lot!</p></section></div><form><p>Your, name, please, here, now</p></form><footer>&copy; 2024</footer>"""


def test_extraction():
    assert html.main_text(PAGE) == "Head&line First paragraph, with bold text, commas, and a link. Short one. Quoted “text” here, long enough to count."
    assert html.main_text(None) == html.main_text("") == html.main_text("<script>x</script>") == ""
    assert html.main_text("just text, no tags") == "just text, no tags"
    assert html.main_text("<p>cut off &amp; text, that goes on and on<b>x</b><a href='") == "cut off & text, that goes on and onx"
    assert html.main_text("<div>" * 5000 + "<p>deep text, that is long enough to score</p>") == "deep text, that is long enough to score"
    plain = "<body><div class='wrap has-sidebar'><h2>T</h2><p>Body text, one, two, three, long enough.</p><p>b</p></div><div class=sidebar><p>Side text, one, two.</p></div>"
    assert html.main_text(plain) == "T Body text, one, two, three, long enough. b"


def test_extraction_keeps_short_sections():
    para = "A sentence of the text, which goes on, and on, and on until it is long enough. " * 3
    body = f"<div class=body>{f'<p>{para}</p>' * 10}</div>"
    lead = f"<div class=lead><p>Lead text. {para}</p></div>"
    menu = "<div class=list>" + "<p><a href=x>Another page of this site, with a long name</a></p>" * 5 + "</div>"
    related = "<div class=related>" + "<p><a href=x>Another page of this site, with a long name</a></p>" * 5 + "</div>"
    want = " ".join(f"Title Lead text. {para} {para * 10}".split())
    for inner in (body, f"<div><div>{body}</div></div>"):
        page = f"<body><div id=page><div><h1>Title</h1></div>{lead}{inner}{menu}{related}</div></body>"
        assert html.main_text(page) == want
    own = f"<article><p>{para}</p><h2 id='related-work'>Related work</h2><p>{para}</p><section id='discussion'><p>{para}</p></section><div class=social><p>Tell others about it</p></div></article>"
    assert html.main_text(own) == " ".join(f"{para} Related work {para} {para}".split())


def test_extraction_on_table(spark):
    pages = spark.createDataFrame([(1, "u", PAGE, "t"), (1, "u", PAGE, "t"), (None, None, None, "t")], "page_id long, url string, html string, text string")
    rows = html.extract(pages, carry=("url",)).collect()
    assert len(rows) == 3 and sorted(len(r.text) for r in rows)[0] == 0
    assert html.extract(pages.limit(0)).count() == 0


# Nearest neighbours


@pytest.mark.parametrize("factor, least", [(1.0, 1.0), (ann.FACTOR, 0.9)])
def test_nearest(spark, monkeypatch, factor, least):
    monkeypatch.setattr(ann, "SHARD_ROWS", 64)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 60)
    rng = np.random.default_rng(1)
    x = rng.normal(size=(500, 8)).astype(np.float32) * rng.uniform(0.2, 3, (500, 1)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, v.tolist(), "c") for i, v in enumerate(x)] + [(500, None, "c"), (501, [0.0] * 8, "c"), (502, [float("nan")] * 8, "c"), (503, [1.0, None] * 4, "c"), (None, [1.0] * 8, "c"), (7, x[7].tolist(), "c")]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    got = ann.nearest(frame, "vec_id % 20 = 0", k=20, factor=factor).toPandas()
    found, total = 0, 0
    d = x.astype(float)
    for q, own in got.sort_values(["query_id", "rank"]).groupby("query_id"):
        s = (d * d[q]).sum(axis=1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(500), -s))[:20]
        assert len(own) == 20 and own["rank"].tolist() == list(range(1, 21)) and q not in set(own.vec_id)
        assert np.allclose(own.score, s[own.vec_id], rtol=1e-14)
        found += len(set(want) & set(own.vec_id))
        total += 20
        if factor == 1:
            assert own.vec_id.tolist() == want.tolist()
    assert got.query_id.nunique() == 25 and found >= least * total


def test_neighbours_come_from_pruned_trees(spark, monkeypatch):
    """Beyond the sample, on vectors without clusters: whole shares of the rows are skipped, recall stays."""
    monkeypatch.setattr(ann, "SHARD_ROWS", 512)
    monkeypatch.setattr(ann, "SAMPLE_ROWS", 200)
    rng = np.random.default_rng(4)
    x = rng.normal(size=(4000, 24))
    x /= np.sqrt((x * x).sum(axis=1))[:, None]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.nearest(frame, "vec_id % 40 = 0", k=20).toPandas()
    s = x[::40] @ x.T
    s[np.arange(100), np.arange(0, 4000, 40)] = -np.inf
    want = np.argsort(-s, axis=1)[:, :20]
    hits = sum(len(set(want[q // 40]) & set(own.vec_id)) for q, own in got.groupby("query_id"))
    assert len(got) == 2000 and hits >= 0.9 * 2000
    tree = ann.Tree(x, 1.0, np.arange(4000))
    visited = [tree.search(x[::40], 21, np.full(100, -np.inf), f).visited.mean() / 4000 for f in (1.0, ann.FACTOR, 4 * ann.FACTOR)]
    assert visited[2] < visited[1] < visited[0] <= 1 and visited[1] < 0.9


def test_factor_one_is_exact_with_ties(spark, monkeypatch):
    monkeypatch.setattr(ann, "SHARD_ROWS", 128)
    rng = np.random.default_rng(9)
    x = rng.integers(-2, 3, (900, 4)).astype(float)
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<float>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in ann.nearest(frame, "vec_id % 30 = 0", k=20, factor=1.0).collect()}
    ids = np.flatnonzero((x != 0).any(axis=1))
    want = {}
    for q in (i for i in ids if i % 30 == 0):
        s = x[ids] @ x[q]
        order = [j for j in np.lexsort((ids, -s)) if ids[j] != q][:20]
        want |= {(q, k): (ids[j], s[j]) for k, j in enumerate(order, 1)}
    assert got == want


def test_nearest_with_few_candidates(spark):
    frame = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (2, [0.5, 0.5])], "vec_id long, embedding array<float>")
    got = ann.nearest(frame, "vec_id % 20 = 0").collect()
    assert [(r.query_id, r["rank"], r.vec_id, r.score) for r in sorted(got, key=lambda r: r["rank"])] == [(0, 1, 1, 0.5), (0, 2, 2, 0.5)]
    assert ann.nearest(frame.limit(0), "true").count() == 0


# Toxicity and licences


@pytest.fixture(scope="module")
def labelled(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefg") for _ in range(rng.randint(2, 6)))
    rows = []
    for i in range(600):
        words, bad, low = [word() for _ in range(rng.randint(20, 60))], i % 6 == 0, i % 5 == 1
        if bad and not low:
            for _ in range(3):
                words[rng.randrange(len(words))] = "xorq" + word()
        rows.append((i, ("###| " if low else " ").join(words), 0 if low else 1, int(bad and not low)))
    return spark.createDataFrame(rows, "doc_id long, text string, quality int, toxic int")


def test_toxicity_held_out(spark, labelled):
    docs, seen = labelled.select("doc_id", "text"), labelled.filter("doc_id % 3 <> 0 OR doc_id % 12 = 0").select("doc_id", "quality", "toxic")
    docs = docs.unionByName(spark.createDataFrame([(9001, None), (9002, ""), (None, "one two")], "doc_id long, text string"))
    got = by_id(toxicity.toxicity(docs, seen))
    labels = {r.doc_id: r for r in labelled.collect()}
    unseen = [i for i in labels if i % 3 == 0 and i % 12]
    assert np.mean([got[i].is_toxic == bool(labels[i].toxic) for i in unseen]) > 0.97
    assert np.mean([got[i].is_low_quality == (labels[i].quality == 0) for i in unseen]) > 0.97
    assert not got[9001].is_toxic and got[9002].p_toxic == 0.0


def test_toxicity_without_labels(labelled):
    none = labelled.limit(0).select("doc_id", "quality", "toxic")
    assert toxicity.toxicity(labelled.select("doc_id", "text"), none).filter("is_toxic OR is_low_quality").count() == 0


def test_licenses(spark):
    lines = {"Some text.\nReleased under the MIT License.": "MIT", "Licensed under the Apache License, Version 2.0.": "Apache", "This is a normal sentence about a house.": "", "Licensed under the Foobar Public License, version 7.": "unknown", "He got a license to drive.": "", "": "", "permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files": "MIT"}
    docs = spark.createDataFrame([*((i, t) for i, t in enumerate(lines)), (99, None)], "doc_id long, text string")
    got = by_id(licenses.scan_licenses(docs))
    assert [",".join(x.family for x in got[i].licenses) for i in range(len(lines))] == list(lines.values()) and got[99].licenses == []
    assert [x.line for x in got[0].licenses] == [1]


@pytest.fixture(scope="module")
def license_model():
    return licenses.train([])


def license_lines(model, text):
    batch = pa.RecordBatch.from_pydict({"doc_id": [1], "text": [text]})
    return [(x["line"], x["family"]) for x in next(licenses.scan(iter([batch]), model)).to_pylist()[0]["licenses"]]


def test_licenses_of_one_word(license_model):
    one = {"SPDX-License-Identifier: MIT": "MIT", "License: MIT": "MIT", "Licensed under MIT.": "MIT", "SPDX-License-Identifier: ISC": "ISC", "SPDX-License-Identifier: Unlicense": "Unlicense", "License: GPLv2": "GPL"}
    several = {"MIT OR Apache-2.0": "Apache MIT", "SPDX-License-Identifier: MIT OR Apache-2.0 OR ISC": "Apache ISC MIT", "Licensed under the MIT License or the Apache License, Version 2.0": "Apache MIT", "Creative Commons Attribution-ShareAlike 4.0 International License": "CC-BY-SA"}
    for text, want in (one | several).items():
        assert license_lines(license_model, text) == [(0, f) for f in want.split()], text
    for text in ("He studied at MIT.", "Er fuhr mit dem Auto.", "Sie fuhren unter anderem mit dem Auto."):
        assert license_lines(license_model, text) == []


@pytest.mark.parametrize("width", [25, 40, 72])
@pytest.mark.parametrize("family", ["MIT", "BSD", "ISC"])
def test_licenses_hard_wrapped(license_model, family, width):
    wrapped = textwrap.fill(licenses.TEXTS[family][0], width)
    near = ["The house was old and stood by the river.", "Nobody had lived in it for years."]
    for text, at in ((wrapped, 0), (f"A title\n\n{wrapped}\n\n{near[0]}", 2), ("\n".join([*near, wrapped, *near]), 2)):
        assert license_lines(license_model, text) == [(at, family)]
    assert license_lines(license_model, "Released under the Apache\nLicense, Version 2.0.") == [(0, "Apache")]
    assert license_lines(license_model, "\n".join(near * 3)) == []
    assert license_lines(license_model, "\n".join([wrapped] * 5)) == [(i * (wrapped.count("\n") + 1), family) for i in range(5)]


# All operators on empty tables


def test_empty_tables(spark, empty):
    bench = spark.createDataFrame([], "item_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for out in (linededup.dedup_lines(empty), neardup.near_duplicates(empty), D.decontaminate(empty, bench), sharding.shard(empty), packing.pack(empty), pii.find_pii(empty), toxicity.toxicity(empty, labels), licenses.scan_licenses(empty)):
        assert out.count() == 0
