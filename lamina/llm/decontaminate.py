"""Benchmark decontamination by winnowing.

A window is 13 consecutive words. Of the nine 5-word grams in a window, winnowing keeps the one of minimum
hash, so two equal windows always keep the same fingerprint: every shared span of 13 words or more is found.
Fingerprints of the training texts are joined with those of the benchmark; at each match the hit is extended
to all windows around it, which are compared word by word. Benchmark items shorter than a window have no such
guarantee and are found by the hash of their whole word sequence.

The benchmark's index is broadcast in blocks of bounded size: long items are cut into overlapping pieces, and a
benchmark beyond one block costs one more scan of the texts for each block. Texts are never shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import materialize, table
from . import textvec as V

WINDOW = 13
GRAM = 5
#: Bytes of benchmark text in one broadcast block; the index takes some 25 times as much.
BLOCK_BYTES = 2_000_000
PIECE_WORDS = 4096


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of a column, and the index of each row's first word (and one more)."""
    data, offsets = V.column_bytes(texts)
    starts, ends, first = V.spans(data, offsets, V.IS_ALNUM)
    return V.span_hashes(V.LOWER[data], starts, ends), first


def winnow(words: np.ndarray) -> np.ndarray:
    """The minimum gram hash of each window."""
    low = V.ngram_hashes(words, GRAM)
    width, done = WINDOW - GRAM + 1, 1
    while done < width:
        step = min(done, width - done)
        low = np.minimum(low[: len(low) - step], low[step:])
        done += step
    return low


class Sequences:
    """Word sequences of one length, found by hash and compared word by word; each has the items that hold it."""

    def __init__(self, rows: np.ndarray, items: np.ndarray):
        hashes = V.ngram_hashes(rows.ravel(), rows.shape[1])[:: rows.shape[1]]
        order = np.lexsort((items, hashes))
        hashes, items, rows = hashes[order], items[order], rows[order]
        self.hashes, head = np.unique(hashes, return_index=True)
        self.rows, self.items, self.edges = rows[head], items, np.append(head, len(items))

    def find(self, words: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the places `at` where a sequence begins, and the sequences' numbers."""
        n = self.rows.shape[1]
        view = np.lib.stride_tricks.sliding_window_view(words, n)[at]
        hashes = V.ngram_hashes(np.ascontiguousarray(view).ravel(), n)[::n]
        k = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        same = (self.rows[k] == view).all(axis=1)
        return at[same], k[same]


class Index:
    """One block of the benchmark: fingerprints, windows and short items."""

    def __init__(self, pieces: list[tuple[str, str]]):
        self.names = sorted({name for name, _ in pieces})
        number = {name: i for i, name in enumerate(self.names)}
        words, first = word_hashes(pa.array([text for _, text in pieces], pa.string()))
        by_length: dict[int, list[tuple[np.ndarray, int]]] = {}
        marks = []
        for i, (name, _) in enumerate(pieces):
            own = words[first[i] : first[i + 1]]
            if len(own) >= WINDOW:
                marks.append(winnow(own))
            if len(own):
                n = min(len(own), WINDOW)
                view = np.lib.stride_tricks.sliding_window_view(own, n)
                by_length.setdefault(n, []).append((view, number[name]))
        self.marks = np.unique(np.concatenate(marks)) if marks else np.zeros(0, V.U64)
        self.sequences = {n: Sequences(np.concatenate([v for v, _ in found]), np.concatenate([np.full(len(v), k) for v, k in found])) for n, found in by_length.items()}

    def places(self, words: np.ndarray, n: int) -> np.ndarray:
        """Where a sequence of n words may begin."""
        if len(words) < n:
            return np.zeros(0, np.int64)
        if n < WINDOW:
            return np.flatnonzero(np.isin(V.ngram_hashes(words, n), self.sequences[n].hashes))
        low = winnow(words)
        head = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
        held = np.isin(low[head], self.marks)
        return np.flatnonzero(np.repeat(held, np.diff(np.append(head, len(low)))))


def scan(batches: Iterator[pa.RecordBatch], index: Index) -> Iterator[pa.RecordBatch]:
    """Add n_words, n_hit, spans (word ranges that are hit) and items to each row."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32())]))
    for batch in V.slices(batches):
        words, first = word_hashes(batch.column("text"))
        n_words = np.diff(first)
        edge = np.zeros(len(words) + 1, np.int32)
        items: dict[int, set[int]] = {}
        for n, seq in index.sequences.items():
            at = index.places(words, n)
            row = np.searchsorted(first, at, "right") - 1
            at = at[at + n <= first[row + 1]]
            at, k = seq.find(words, at) if len(at) else (at, at)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + n, -1)
            row = np.searchsorted(first, at, "right") - 1
            for r, j in set(zip(row.tolist(), k.tolist(), strict=True)):
                items.setdefault(r, set()).update(seq.items[seq.edges[j] : seq.edges[j + 1]].tolist())
        hit = np.cumsum(edge)[:-1] > 0
        total = np.append(0, np.cumsum(hit))
        n_hit = total[first[1:]] - total[first[:-1]]
        spans: list[list[dict]] = [[] for _ in range(len(batch))]
        for r in items:
            own = np.concatenate([[False], hit[first[r] : first[r + 1]], [False]])
            turn = np.flatnonzero(own[1:] != own[:-1])
            spans[r] = [{"start": a, "stop": b} for a, b in zip(turn[::2].tolist(), turn[1::2].tolist(), strict=True)]
        names = [[index.names[k] for k in sorted(items.get(r, ()))] for r in range(len(batch))]
        out = {name: batch.column(name) for name in batch.schema.names}
        yield pa.RecordBatch.from_pydict(out | {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "spans": pa.array(spans, kind), "items": pa.array(names, pa.list_(pa.string()))})


def cut_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Items as pieces of at most PIECE_WORDS words which together hold every window."""
    for batch in batches:
        names, texts = [], []
        for name, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
            data, offsets = V.column_bytes(pa.array([text], pa.string()))
            starts, ends, _ = V.spans(data, offsets, V.IS_ALNUM)
            for i in range(0, max(1, len(starts) - WINDOW + 1), PIECE_WORDS - WINDOW + 1) if len(starts) else ():
                names.append(name)
                texts.append(data[starts[i] : ends[min(len(ends), i + PIECE_WORDS) - 1]].tobytes().decode())
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.string())], ["item_id", "text"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, carry: tuple[str, ...] = (), block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Mark the documents that share windows with the benchmark.

    Returns doc_id, text, the columns in `carry`, n_words, n_hit (words inside an occurrence of a window), spans
    (the word ranges they form), items (item_ids as strings, sorted) and contaminated (n_hit > 0 and
    20 * n_hit >= n_words). Edge cases: a null or empty text has no words and is clean; items without words or
    with a null item_id match nothing; repeated rows are judged row by row, repeated items count once by
    item_id; an empty benchmark leaves all documents clean; an empty table gives an empty result; other columns play no
    part, and carried columns that bear the name of a result give way to it.
    """
    spark = docs.sparkSession
    docs = V.chosen(docs, "doc_id", "text", carry, ("n_words", "n_hit", "spans", "items", "contaminated"))
    pieces = benchmark.filter("item_id IS NOT NULL AND text IS NOT NULL").select(F.col("item_id").cast("string").alias("item_id"), "text").mapInArrow(cut_items, "item_id string, text string")
    pieces = materialize(pieces.distinct(), "benchmark-pieces")  # a repeated item stands once
    nbytes = pieces.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, math.ceil(nbytes / block_bytes))
    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), "n_words long, n_hit long, spans array<struct<start:int,stop:int>>, items array<string>"])

    def block(k: int) -> DataFrame:
        own = pieces.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == k).collect()
        index = spark.sparkContext.broadcast(Index([(r.item_id, r.text) for r in own]))
        return docs.mapInArrow(lambda it: scan(it, index.value), fields)

    out = block(0)
    if blocks > 1:
        key = [F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__key")]
        hits = None
        for k in range(blocks):
            part = (out if k == 0 else block(k)).filter("n_hit > 0").select(*key, "spans", "items").dropDuplicates(["__id", "__key"])
            hits = part if hits is None else hits.unionByName(part)
        hits = hits.groupBy("__id", "__key").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("__spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("__items"))
        joined = F.expr("""aggregate(__spans, cast(array() as array<struct<start:int,stop:int>>), (a, x) ->
            if(size(a) > 0 and try_element_at(a, -1).stop >= x.start,
               concat(slice(a, 1, size(a) - 1), array(named_struct('start', try_element_at(a, -1).start, 'stop', greatest(try_element_at(a, -1).stop, x.stop)))),
               concat(a, array(x))))""")
        hits = hits.withColumn("__spans", joined)
        out = out.drop("n_hit", "spans", "items").join(hits, F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64("text") == F.col("__key")), "left")
        out = out.withColumns({"spans": F.coalesce("__spans", F.expr("cast(array() as array<struct<start:int,stop:int>>)")), "items": F.coalesce("__items", F.expr("cast(array() as array<string>)"))})
        out = out.withColumn("n_hit", F.expr("aggregate(spans, 0L, (a, x) -> a + x.stop - x.start)")).drop("__id", "__key", "__spans", "__items")
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark; items as their number and digest."""
    out = decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"), "contaminated")


ORACLE = r"""
WITH dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
iw AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(13, len(w)) AS k, unnest(range(1, greatest(len(w) - 13, 0) + 2)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS g FROM ip),
dp AS (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM dw, (SELECT DISTINCT k FROM win) WHERE len(w) >= k),
dg AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g FROM dp),
hits AS (SELECT doc_id, i, k, item_id FROM dg JOIN win USING (k, g)),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM hits) GROUP BY doc_id),
hi AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS digest
       FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       coalesce(digest, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""
