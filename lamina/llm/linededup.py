"""Line deduplication over a whole corpus with two Bloom filters.

A first scan hashes every line and fills, in each task, a filter of keys that some document holds and one of
keys that two documents may hold. Tasks send the non-empty segments of both; a streaming merge per segment
keeps what meets in two tasks. Only the second filter, of fixed size, is broadcast. A second scan shuffles a
16-byte digest for each suspected line only, confirms repeats exactly and picks the smallest doc_id. A false
positive of the filters costs a digest in the shuffle; results never depend on the filters' size. Texts without
a suspected line are never shuffled.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..storage import input_bytes, materialize, table
from . import textvec as V

SEGMENT_BITS = 1 << 18
PROBES = 3
#: The broadcast filter has at most this many bits (64 MB); beyond about 10**8 distinct lines it only loses
#: selectivity, so more digests are shuffled.
MAX_FILTER_BITS = 1 << 29
MIN_FILTER_BITS = 1 << 20
MIN_KEY_CHARS = 10


def filter_bits(nbytes: int) -> int:
    """A power of two near one bit for each two bytes of input: some 16 bits for a line of usual length."""
    return min(MAX_FILTER_BITS, max(MIN_FILTER_BITS, 1 << max(0, (nbytes // 2).bit_length() - 3)))


def keyed_lines(texts: pa.Array, min_chars: int = MIN_KEY_CHARS) -> dict[str, np.ndarray]:
    """All lines of a column: `first` has each row's first line; `line` and `row` are those of the lines whose
    stripped key has at least `min_chars` code points, `start` and `end` the key's bytes, `hash` its hash."""
    data, offsets = V.column_bytes(texts)
    breaks = np.flatnonzero(data == 10)
    first = np.zeros(len(offsets), np.int64)
    np.cumsum(np.diff(np.searchsorted(breaks, offsets)) + 1, out=first[1:])
    starts = np.sort(np.concatenate([offsets[:-1], breaks + 1]), kind="stable")
    ends = np.sort(np.concatenate([breaks, offsets[1:]]), kind="stable")
    solid = np.flatnonzero(V.IS_SOLID[data])
    a, b = np.searchsorted(solid, starts), np.searchsorted(solid, ends)
    line = np.flatnonzero(b - a > 0)
    start, end = solid[a[line]], solid[b[line] - 1] + 1
    points = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=points[1:])
    long = points[end] - points[start] >= min_chars
    line, start, end = line[long], start[long], end[long]
    return {"data": data, "first": first, "line": line, "row": np.searchsorted(first, line, "right") - 1, "start": start, "end": end, "hash": V.span_hashes(V.LOWER[data], start, end)}


def probes(hashes: np.ndarray, bits: int) -> np.ndarray:
    """Bit positions of each hash, all in one segment: an array of PROBES rows."""
    segment = (hashes % np.uint64(bits // SEGMENT_BITS)) * np.uint64(SEGMENT_BITS)
    h = V.mix(hashes)
    return np.stack([segment + ((h >> np.uint64(18 * i)) & np.uint64(SEGMENT_BITS - 1)) for i in range(PROBES)])


def all_set(bitmap: np.ndarray, at: np.ndarray) -> np.ndarray:
    return (bitmap[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8) & 1).all(axis=0)


def set_bits(bitmap: np.ndarray, at: np.ndarray) -> None:
    at = at.ravel()
    np.bitwise_or.at(bitmap, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))


def fill(batches: Iterator[pa.RecordBatch], bits: int) -> Iterator[pa.RecordBatch]:
    """One task's filters, as the segments that have a bit."""
    once, twice = np.zeros(bits // 8, np.uint8), np.zeros(bits // 8, np.uint8)
    for batch in V.slices(batches):
        lines = keyed_lines(batch.column("text"))
        ids = batch.column("doc_id")
        # One vote for a document: rows of one doc_id in this slice count together.
        owner = np.asarray(pc.fill_null(ids, 0), np.int64)[lines["row"]].astype(np.uint64)
        _, at = np.unique(lines["hash"] ^ V.mix(owner * np.uint64(3) + np.uint64(1)), return_index=True)
        hashes, counts = np.unique(lines["hash"][at], return_counts=True)
        where = probes(hashes, bits)
        set_bits(twice, where[:, (counts > 1) | all_set(once, where)])
        set_bits(once, where)
    size = SEGMENT_BITS // 8
    for k in np.flatnonzero(once.reshape(-1, size).any(axis=1)):
        part = slice(k * size, (k + 1) * size)
        yield pa.RecordBatch.from_arrays([pa.array([int(k)], pa.int32()), pa.array([zlib.compress(once[part].tobytes(), 1)], pa.binary()), pa.array([zlib.compress(twice[part].tobytes(), 1)], pa.binary())], ["segment", "once", "twice"])


def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge tasks' segments, which come sorted, one segment in memory at a time."""

    def out(k: int, twice: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([twice.tobytes()], pa.binary())], ["segment", "twice"])

    at, once, twice = -1, None, None
    for batch in batches:
        for k, o, t in zip(*(batch.column(c).to_pylist() for c in ("segment", "once", "twice")), strict=True):
            o, t = np.frombuffer(zlib.decompress(o), np.uint8), np.frombuffer(zlib.decompress(t), np.uint8)
            if k != at:
                if at >= 0 and twice.any():
                    yield out(at, twice)
                at, once, twice = k, o.copy(), t.copy()
            else:
                twice |= t | (once & o)
                once |= o
    if at >= 0 and twice.any():
        yield out(at, twice)


def suspect_filter(docs: DataFrame, bits: int) -> np.ndarray:
    """The bitmap of keys that two documents may hold; its size is fixed by `bits`."""
    parts = docs.select("doc_id", "text").mapInArrow(lambda it: fill(it, bits), "segment int, once binary, twice binary")
    merged = parts.repartition("segment").sortWithinPartitions("segment").mapInArrow(merge, "segment int, twice binary")
    bitmap = np.zeros(bits // 8, np.uint8)
    size = SEGMENT_BITS // 8
    for row in merged.toLocalIterator():
        bitmap[row.segment * size : (row.segment + 1) * size] = np.frombuffer(row.twice, np.uint8)
    return bitmap


def digest(key: bytes) -> bytes:
    return hashlib.blake2b(key, digest_size=16).digest()


def suspects(batches: Iterator[pa.RecordBatch], bitmap: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(doc_id, digest) of each suspected line, once for a document in a slice."""
    bits = len(bitmap) * 8
    for batch in V.slices(batches):
        lines = keyed_lines(batch.column("text"))
        hit = np.flatnonzero(all_set(bitmap, probes(lines["hash"], bits)))
        low, ids = V.LOWER[lines["data"]].tobytes(), batch.column("doc_id")
        pairs = {(int(lines["row"][i]), digest(low[lines["start"][i] : lines["end"][i]])) for i in hit}
        yield pa.RecordBatch.from_arrays([ids.take(pa.array([r for r, _ in pairs], pa.int64())), pa.array([d for _, d in pairs], pa.binary())], ["doc_id", "digest"])


def rows_with(bitmap: Broadcast, wanted: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Keep the rows that have a suspected line, or those that have none; a null doc_id has none."""

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = len(bitmap.value) * 8
        for batch in V.slices(batches):
            lines = keyed_lines(batch.column("text"))
            flag = np.zeros(len(batch), bool)
            flag[lines["row"][all_set(bitmap.value, probes(lines["hash"], bits))]] = True
            flag &= np.asarray(batch.column("doc_id").is_valid())
            yield batch.filter(pa.array(flag == wanted))

    return kept


def drop_lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rebuild the texts without the lines whose digests are in `drop`."""
    for batch in V.slices(batches):
        texts, drops = batch.column("text"), batch.column("drop").to_pylist()
        lines = keyed_lines(texts)
        low, raw = V.LOWER[lines["data"]].tobytes(), texts.to_pylist()
        n_lines, n_dropped, kept = np.diff(lines["first"]), [], []
        edge = np.searchsorted(lines["row"], np.arange(len(batch) + 1))
        for i, drop in enumerate(drops):
            gone = set()
            if drop:
                drop = set(drop)
                gone = {int(lines["line"][j] - lines["first"][i]) for j in range(edge[i], edge[i + 1]) if digest(low[lines["start"][j] : lines["end"][j]]) in drop}
            n_dropped.append(len(gone))
            kept.append(raw[i] if not gone else "\n".join(x for j, x in enumerate(raw[i].split("\n")) if j not in gone))
        out = {name: batch.column(name) for name in batch.schema.names if name not in ("text", "drop")}
        out |= {"text": pa.array(kept, pa.string()), "n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())}
        yield pa.RecordBatch.from_pydict(out)


def dedup_lines(docs: DataFrame, *, carry: tuple[str, ...] = (), bits: int | None = None) -> DataFrame:
    """Drop repeated lines: doc_id, text, n_lines (before), n_dropped, and the columns named in `carry`.

    A key is the line stripped of ASCII white space and lower-cased in A-Z. Keys of at least ten code points
    that at least two documents hold lose all their lines except in the document of the smallest doc_id.
    Edge cases: a null or empty text is one empty line and stays as it is; a line repeated inside one document
    only stays; rows that share a doc_id are one document; rows with a null doc_id stay whole and do not count
    as holders; an empty table gives an empty result; other columns of the input play no part, and carried columns
    named n_lines, n_dropped or drop give way to the results. Memory follows
    the longest single text, never a key's number of holders.
    """
    spark = docs.sparkSession
    docs = V.chosen(docs, "doc_id", "text", carry, ("n_lines", "n_dropped", "drop"))
    named = docs.filter("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", "text")
    bits = bits or filter_bits(input_bytes(docs))
    bitmap = spark.sparkContext.broadcast(suspect_filter(named, bits))
    seen = materialize(named.mapInArrow(lambda it: suspects(it, bitmap.value), "doc_id long, digest binary"), "suspects")
    keepers = seen.groupBy("digest").agg(F.min("doc_id").alias("keeper"), F.max("doc_id").alias("last")).filter("keeper <> last").select("digest", "keeper")
    # Read back, the join's two sides are plain shuffles, so a line that many documents hold can be split.
    keepers = materialize(keepers, "keepers")
    drops = seen.join(keepers, "digest").filter("doc_id <> keeper").groupBy("doc_id").agg(F.collect_set("digest").alias("drop"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    clean = docs.mapInArrow(rows_with(bitmap, False), fields)
    clean = clean.withColumns({"n_lines": F.when(F.col("text").isNull(), F.lit(1)).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1).cast("long"), "n_dropped": F.lit(0).cast("long")})
    dirty = docs.mapInArrow(rows_with(bitmap, True), fields).join(drops, "doc_id", "left")
    order = [*docs.columns, "n_lines", "n_dropped"]
    dirty = dirty.mapInArrow(drop_lines, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name != "text"), "text string", "n_lines long", "n_dropped long"]))
    return clean.select(order).unionByName(dirty.select(order))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line deduplication of all documents, as digests of the kept texts."""
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT d.doc_id, u.pos, u.line,
         translate(regexp_replace(regexp_replace(u.line, '^[ \t\n\v\f\r]+', ''), '[ \t\n\v\f\r]+$', ''),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents) d,
       LATERAL (SELECT unnest(d.l) AS line, generate_subscripts(d.l, 1) AS pos) u),
holders AS (
  SELECT key, min(doc_id) AS keeper FROM lines WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
marked AS (
  SELECT l.*, h.keeper IS NOT NULL AND h.keeper <> l.doc_id AS gone FROM lines l LEFT JOIN holders h USING (key))
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
