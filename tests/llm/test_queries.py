"""The registered queries on the smallest tables: SQL where there is any, plain versions for the rest."""

import collections
import hashlib
import html as H
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from conftest import DATA
from test_llm_small import BASE, brute_pii

from lamina.llm import pii, tokens
from lamina.llm.registry import ORACLES, QUERIES

pytestmark = pytest.mark.skipif(not DATA.exists(), reason="no test tables")


def column(table, name):
    return pq.read_table(f"{DATA}/{table}.parquet").column(name).to_pylist()


@pytest.fixture(scope="module")
def texts():
    return dict(zip(column("documents", "doc_id"), column("documents", "text"), strict=True))


def run(spark, name):
    return QUERIES[name](spark, str(DATA))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equal_to_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    want, got = con.execute(ORACLES[name]).df(), run(spark, name).toPandas()
    assert sorted(got.columns) == sorted(want.columns)
    rows = lambda f: sorted(map(str, f[sorted(f.columns)].astype(object).itertuples(index=False, name=None)))
    assert rows(got) == rows(want)


def test_op1(spark, texts):
    frame = run(spark, "op1_toxicity")
    assert frame.columns == ["doc_id", "p_low_quality", "is_low_quality", "p_toxic", "is_toxic"]
    rows = {r.doc_id: r for r in frame.collect()}
    assert set(rows) == set(texts) and all(0 <= r.p_toxic <= 1 for r in rows.values())
    good = [i for i, q, t in zip(*(column("labels", c) for c in ("doc_id", "quality", "toxic")), strict=True) if q and not t]
    assert good and not any(rows[i].is_toxic or rows[i].is_low_quality for i in good)  # few labels, yet no good text is rejected
    assert rows == {r.doc_id: r for r in run(spark, "op1_toxicity").collect()}


def test_op3(spark, texts):
    frame = run(spark, "op3_shard")
    assert dict(frame.dtypes) == {"doc_id": "bigint", "size": "bigint", "text_crc32": "bigint", "law": "string", "shard": "int", "slot": "bigint", "grown_shard": "int"}
    rows = frame.collect()
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    used, slots, shard_of = collections.Counter(), collections.defaultdict(list), {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r.size, r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        assert shard_of.setdefault(raw, r.shard) == r.shard and 0 <= r.shard < 24
        used[r.shard] += r.size
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    largest = max(collections.Counter({t: 0 for t in texts.values()} | collections.Counter((texts[r.doc_id]) for r in rows)).values())
    assert max(used.values()) <= max(1.02 * sum(used.values()) / 24 + 1, max(r.size for r in rows) * largest)


def test_op4(spark):
    """The pages' article, read with plain patterns."""
    pages = {i: (u, h) for i, u, h in zip(column("pages", "page_id"), column("pages", "url"), column("pages", "html"), strict=True)}
    rows = run(spark, "op4_extract").collect()
    assert len(rows) == len(pages)
    for r in rows:
        url, page = pages[r.page_id]
        article = re.search(r"<article[^>]*>(.*?)</article>", page, re.S).group(1)
        article = re.sub(r"</?(?:p|h1|br|div)\b[^>]*>", " ", re.sub(r"</?(?:b|a|i|em)\b[^>]*>", "", article))
        assert (r.url, r.text, r.n_chars) == (url, " ".join(H.unescape(re.sub(r"<[^>]+>", "", article)).split()), len(r.text))


def test_op5(spark, texts):
    rows = {r.doc_id: r for r in run(spark, "op5_licenses").collect()}
    assert set(rows) == set(texts)
    named = re.compile(r"licensed under|licen[cs]e|spdx|creative commons|public domain", re.I)
    for i, r in rows.items():
        assert (r.n_licenses == 0) == (r.families == "" and r.lines == "" and r.best_probability is None)
        assert set(r.families.split(",")) == {x.split(":")[1] for x in r.lines.split(",")} if r.n_licenses else True
        if r.n_licenses:
            assert named.search(texts[i])
    assert any(r.n_licenses for r in rows.values())


def test_op6(spark, texts):
    frame = run(spark, "op6_pack")
    assert frame.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and {t for _, t in frame.dtypes} == {"bigint"}
    rows = frame.collect()
    tokenizer = tokens.WordTokenizer().tokenizer
    ids = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 1], "<u4") for i, t in texts.items()}
    covered, sequences = collections.defaultdict(list), collections.defaultdict(list)
    for r in rows:
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert (len(own), zlib.crc32(own.tobytes()), r.doc_tokens) == (r.length, r.ids_crc32, len(ids[r.doc_id]))
        covered[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for own, total in [(sorted(covered[i]), len(x)) for i, x in ids.items()] + [(sorted(s), None) for s in sequences.values()]:
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))]
        assert sum(n for _, n in own) == total if total else sum(n for _, n in own) <= 2048


def test_op9(spark):
    x = np.array(column("embeddings", "embedding"), float)
    ids = np.array(column("embeddings", "vec_id"))
    frame = run(spark, "op9_ann")
    assert dict(frame.dtypes) == {"query_id": "bigint", "rank": "int", "vec_id": "bigint", "score": "double"}
    got, hits = frame.toPandas().sort_values(["query_id", "rank"]), 0
    assert set(got.query_id) == {i for i in ids if i % 20 == 0}
    for q, own in got.groupby("query_id"):
        s = x @ x[ids == q][0]
        s[ids == q] = -np.inf
        at = np.searchsorted(ids, own.vec_id)
        assert own["rank"].tolist() == list(range(1, 21)) and np.allclose(own.score, s[at], rtol=1e-12)
        assert list(zip(-own.score, own.vec_id, strict=True)) == sorted(zip(-own.score, own.vec_id, strict=True))
        hits += len(set(ids[np.lexsort((ids, -s))[:20]]) & set(own.vec_id))
    assert hits >= 0.9 * len(got)


def test_op10(spark, texts):
    frame = run(spark, "op10_pii")
    assert frame.columns == ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"]
    rows = {r.doc_id: r for r in frame.collect()}
    assert set(rows) == set(texts)
    for i, r in rows.items():
        base = brute_pii(texts[i] or "")
        assert [r[f"n_{k}"] for k, _, _ in BASE] == [sum(s[0] == k for s in base) for k, _, _ in BASE]
        assert r.base_sha256 == hashlib.sha256(pii.joined(base).encode()).hexdigest()
        spans = [s for s in r.spans.split(",") if s]
        assert set(pii.joined(base).split(",")) - {""} <= set(spans)
        order = [(int(s.split(":")[1]), pii.KINDS.index(s.split(":")[0])) for s in spans]
        assert order == sorted(order)
    assert any(r.n_email for r in rows.values())
