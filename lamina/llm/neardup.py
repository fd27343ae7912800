"""Near-duplicate documents by fast similarity sketching, banding and exact verification.

A document's sketch has SIZE coordinates. In each round every shingle is placed in one hashed bin with a value that
grows with the round, and bins keep their minimum; after SIZE rounds the places are no longer random but fixed, bin
after bin, so every coordinate is filled. A coordinate of two sketches is equal with the probability of their
Jaccard similarity. Bands of coordinates form buckets; documents of equal shingle sets enter once.

No bucket's pairs are all compared. First every member meets one member of its bucket, chosen by hash, and the
pairs are verified on full sets. Only in buckets that still hold several components do members of different
components meet, in blocks of bounded size: their sketches sort out most, full sets decide, and only links that
join components leave the task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..operators.components import components
from ..storage import discard, materialize, release, table, written
from . import textvec as V

BANDS = 32
#: Coordinates in a band: two sets of similarity 0.85 share no band of 32 with a probability of 7e-9.
BAND_ROWS = 5
SIZE = BANDS * BAND_ROWS
#: Members, and their shingles, of one block of a bucket: a task holds two blocks at most, some 20 MB.
BLOCK = 1024
BLOCK_SHINGLES = 1_000_000
_FREE = np.uint64(2**64 - 1)


def shingle_sets(texts: pa.Array, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of each row's distinct n-word shingles, sorted by row and hash, and each row's first (and one
    more). A row of fewer words has one shingle, its whole sequence; a row without words has none."""
    data, offsets = V.column_bytes(texts)
    starts, ends, first = V.spans(data, offsets, V.IS_SOLID)
    words = V.span_hashes(V.LOWER[data], starts, ends)
    grams = V.ngram_hashes(words, n)
    parts, counts = [], np.zeros(len(offsets) - 1, np.int64)
    for i, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist(), strict=True)):
        if b - a >= n:
            own = np.sort(grams[a : b - n + 1])
            own = own[np.append(True, own[1:] != own[:-1])]
        elif b > a:
            own = V.mix(V.ngram_hashes(words[a:b], b - a) + V.U64(b - a))
        else:
            continue
        parts.append(own)
        counts[i] = len(own)
    return np.concatenate(parts) if parts else np.zeros(0, V.U64), np.append(0, np.cumsum(counts))


def sketches(hashes: np.ndarray, first: np.ndarray, size: int = SIZE) -> np.ndarray:
    """Fast similarity sketches, a row for each set; the rows of empty sets stay free."""
    rows = len(first) - 1
    out = np.full(rows * size, _FREE, V.U64)
    row = np.repeat(np.arange(rows), np.diff(first))
    live = hashes
    for i in range(2 * size):
        if not len(live):
            break
        x = V.mix(live ^ V.mix(np.full(1, i + 1, V.U64)))
        bins = ((x >> V.U64(32)) * V.U64(size) >> V.U64(32)).astype(np.int64) if i < size else np.full(len(x), i - size)
        np.minimum.at(out, row * size + bins, V.U64(i) << V.U64(40) | x & V.U64(2**40 - 1))
        open_rows = (out.reshape(rows, size) == _FREE).any(axis=1)
        keep = open_rows[row]
        if not keep.all():
            live, row = live[keep], row[keep]
    return out.reshape(rows, size)


def band_keys(sketch: np.ndarray, rows: int = BAND_ROWS) -> np.ndarray:
    """A key for each band, different from band to band."""
    parts = sketch.reshape(len(sketch), -1, rows)
    keys = np.broadcast_to(np.arange(1, parts.shape[1] + 1, dtype=V.U64), parts.shape[:2])
    for i in range(rows):
        keys = V.mix(keys * V.U64(0x9FB21C651E98DF25) + parts[:, :, i])
    return keys.view(np.int64)


def set_keys(hashes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums that name a set; equal sets have equal names."""
    out = []
    for salt in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        sums = np.append(V.U64(0), np.cumsum(V.mix(hashes ^ V.U64(salt))))
        out.append((sums[first[1:]] - sums[first[:-1]]).view(np.int64))
    return out[0], out[1]


def sketch_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches):
        hashes, first = shingle_sets(batch.column("text"), n)
        sketch = sketches(hashes, first)
        k1, k2 = set_keys(hashes, first)
        bands = pa.ListArray.from_arrays(pa.array(np.arange(0, len(batch) * BANDS + 1, BANDS), pa.int32()), pa.array(band_keys(sketch).ravel()))
        low = np.ascontiguousarray((sketch & V.U64(255)).astype(np.uint8))
        yield pa.RecordBatch.from_pydict({"doc_id": batch.column("doc_id"), "n_shingles": pa.array(np.diff(first)), "k1": pa.array(k1), "k2": pa.array(k2), "bands": bands, "sketch": pa.array([r.tobytes() for r in low], pa.binary())})


def set_rows(batches: Iterator[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
    for batch in V.slices(batches):
        hashes, first = shingle_sets(batch.column("text"), n)
        yield pa.RecordBatch.from_pydict({"id": batch.column("doc_id"), "set": pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(hashes.view(np.int64)))})


def may_link(percent: int, size: int = SIZE) -> int:
    """Equal coordinates that a linked pair has, but for a chance of about 1e-9: six deviations below the mean."""
    j = percent / 100
    return max(1, int(size * j - 6 * (size * j * (1 - j)) ** 0.5))


def compare_block(group: pd.DataFrame, percent: int) -> pd.DataFrame:
    """Links between different components in one block pair of a bucket: as many as join them, not all.

    Sketches sort out most pairs, full sets decide. A pair that meets in several buckets is looked at in the first.
    """
    i, j = int(group["bi"].iloc[0]), int(group["bj"].iloc[0])
    bucket = int(group["bucket"].iloc[0])
    left, right = (group if i == j else group[group["block"] == k] for k in (i, j))
    out: list[tuple[int, int]] = []
    if len(left) and len(right):
        sk, bands = np.stack([np.frombuffer(x, np.uint8) for x in right["sketch"]]), np.stack(right["bands"].to_numpy())
        ids, n = right["id"].to_numpy(), right["n"].to_numpy()
        sets = [np.asarray(x, np.int64).view(np.uint64) for x in right["set"]]
        joined: dict[int, int] = {}  # component -> component that it has joined here
        label = right["component"].to_numpy().copy()
        least = may_link(percent)
        for r in left.itertuples():
            own = r.component
            while own in joined:
                own = joined[own]
            near = (label != own) & (100 * np.minimum(n, r.n) >= percent * np.maximum(n, r.n))
            if i == j:
                near &= ids > r.id
            at = np.flatnonzero(near)
            at = at[(sk[at] == np.frombuffer(r.sketch, np.uint8)).sum(axis=1) >= least]
            if len(at):
                same = bands[at] == np.asarray(r.bands)
                at = at[bands[at, same.argmax(axis=1)] == bucket]
            if not len(at):
                continue
            mine = np.asarray(r.set, np.int64).view(np.uint64)
            flat = np.concatenate([sets[k] for k in at])
            held = mine[np.minimum(np.searchsorted(mine, flat), len(mine) - 1)] == flat
            common = np.add.reduceat(held.astype(np.int64), np.append(0, np.cumsum(n[at]))[:-1])
            for k in at[100 * common >= percent * (r.n + n[at] - common)]:
                if label[k] != own:
                    out.append((r.id, ids[k]))
                    joined[int(label[k])] = own
                    label[label == label[k]] = own
    pairs = np.array(out, np.int64).reshape(-1, 2)
    return pd.DataFrame({"a": pairs.min(axis=1, initial=2**63 - 1), "b": pairs.max(axis=1, initial=-(2**63))})


def verify(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets reach the similarity."""
    both = pairs.join(sets.select(F.col("id").alias("a"), F.col("set").alias("sa")), "a").join(sets.select(F.col("id").alias("b"), F.col("set").alias("sb")), "b")
    common = F.size(F.array_intersect("sa", "sb"))
    return both.filter(100 * common >= percent * (F.size("sa") + F.size("sb") - common)).select("a", "b").distinct()


def bucket_members(nodes: DataFrame) -> DataFrame:
    """The members of buckets of several: bucket, members, weight, id, n, lead, lead_n, the lead being the member that
    all meet. Members are dealt out once, as three numbers: an aggregate joined to its own rows would deal them twice,
    and a window without the stated exchange would deal its arguments as well."""
    member, own = nodes.select("id", "n", F.explode("bands").alias("bucket")).repartition("bucket"), Window.partitionBy("bucket")
    lead = F.min_by(F.struct("id", "n"), F.xxhash64("id", "bucket")).over(own)
    member = member.withColumns({"members": F.count(F.lit(1)).over(own), "weight": F.sum("n").over(own), "lead": lead}).filter("members > 1")
    return member.select("bucket", "members", "weight", "id", "n", F.col("lead.id").alias("lead"), F.col("lead.n").alias("lead_n"))


def near_duplicates(docs: DataFrame, *, words: int = 5, percent: int = 80) -> DataFrame:
    """Group documents whose sets of word shingles have a Jaccard similarity of at least `percent` / 100.

    Returns doc_id, n_shingles, component_id (the smallest doc_id that links reach) and kept (doc_id =
    component_id). Words are runs without ASCII white space, lower-cased in A-Z. Edge cases: a text of fewer words
    than a shingle is one shingle; a null or empty text, or one without words, has none and is linked with nothing;
    rows that share a doc_id are one document, linked by any of its texts, and share the result's kept flag; rows
    with a null doc_id stay alone: component_id null, kept true; an empty table gives an empty result; other columns
    play no part. Equal sets are one node however many copies there are.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    rows = docs.mapInArrow(lambda it: sketch_rows(it, words), "doc_id long, n_shingles long, k1 long, k2 long, bands array<long>, sketch binary")
    rows = materialize(rows, "sketches")
    sketched = written(spark)[-1]
    has_words = "doc_id IS NOT NULL AND n_shingles > 0"
    nodes = rows.filter(has_words).groupBy("k1", "k2", F.col("n_shingles").alias("n")).agg(F.min("doc_id").alias("id"), F.min_by(F.struct("bands", "sketch"), "doc_id").alias("s"))
    nodes = materialize(nodes.select("id", "k1", "k2", "n", "s.bands", "s.sketch"), "nodes")
    # Sketches stand once on disk, with the nodes; documents keep the names of their sets.
    rows = materialize(rows.select("doc_id", "n_shingles", "k1", "k2"), "named")
    discard(spark, [sketched])
    named = rows.filter(has_words)
    member = materialize(bucket_members(nodes), "members")
    release(spark)
    met = written(spark)[-1]
    wanted = member.select(F.col("id").alias("doc_id")).distinct()
    sets = materialize(docs.join(wanted, "doc_id", "left_semi").mapInArrow(lambda it: set_rows(it, words), "id long, set array<long>"), "sets")

    pairs = member.filter((F.col("id") != F.col("lead")) & (100 * F.least("n", "lead_n") >= percent * F.greatest("n", "lead_n")))
    pairs = materialize(pairs.select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct(), "pairs")
    # Texts of one doc_id are one document: where it has several different ones, their nodes are linked.
    several = named.groupBy("doc_id").agg(F.min(F.struct("k1", "k2")).alias("low"), F.max(F.struct("k1", "k2")).alias("high")).filter("low <> high").select("doc_id")
    own = named.join(several, "doc_id").join(nodes.select("k1", "k2", "id"), ["k1", "k2"]).select("doc_id", "id")
    own = own.join(own.groupBy("doc_id").agg(F.min("id").alias("a")), "doc_id").select("a", F.col("id").alias("b"))
    found = materialize(components(verify(pairs, sets, percent).unionByName(own)), "components")
    release(spark)

    member = member.join(found.withColumnRenamed("node", "id"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    member = materialize(member.select("bucket", "members", "weight", "id", "n", "component"), "labelled")
    discard(spark, [met])
    release(spark)
    split = member.groupBy("bucket").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low <> high AND low IS NOT NULL").select("bucket")
    blocks = F.ceil(F.greatest(F.col("members") / F.lit(BLOCK), F.col("weight") / F.lit(BLOCK_SHINGLES)))
    rest = member.join(split, "bucket").filter("members > 2").withColumn("blocks", blocks).withColumn("block", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    rest = rest.withColumn("other", F.explode(F.sequence(F.lit(0), (F.col("blocks") - 1).cast("int"))))
    rest = rest.withColumns({"bi": F.least("block", "other"), "bj": F.greatest("block", "other")}).drop("other", "blocks", "members", "weight")
    rest = rest.join(nodes.select("id", "n", "bands", "sketch"), ["id", "n"]).join(sets.withColumn("n", F.size("set").cast("long")), ["id", "n"])
    more = rest.groupBy("bucket", "bi", "bj").applyInPandas(lambda g: compare_block(g, percent), "a long, b long")

    # The second links join components of the first.
    label = found.select(F.col("node").alias("a"), F.col("component").alias("ca"))
    more = more.join(label, "a", "left").join(label.withColumnsRenamed({"a": "b", "ca": "cb"}), "b", "left")
    joined = components(more.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    final = found.join(joined.select(F.col("node").alias("component"), F.col("component").alias("whole")), "component", "left").select("node", F.coalesce("whole", "component").alias("component"))
    alone = joined.select("node", "component").join(found.select("node"), "node", "left_anti")
    final = final.unionByName(alone)

    keys = nodes.select("k1", "k2", "id").join(final.withColumnRenamed("node", "id"), "id", "left").select("k1", "k2", F.coalesce("component", "id").alias("component_id"))
    known = named.select("doc_id", "n_shingles", "k1", "k2").join(keys, ["k1", "k2"]).select("doc_id", "n_shingles", "component_id")
    alone = rows.filter("doc_id IS NULL OR n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return known.unionByName(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op8_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicates of all documents on 3-word shingles at a similarity of 0.85."""
    return near_duplicates(table(spark, sf_dir, "documents"), words=3, percent=85)


ORACLE = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, least(3, len(w)) AS k, unnest(range(1, greatest(len(w) - 3, 0) + 2)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + k - 1], ' ') AS g FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pr AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
link AS (SELECT a, b FROM pr JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach(node, low) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.low FROM reach r JOIN e ON e.a = r.node WHERE r.low < e.b)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, c.component_id, d.doc_id = c.component_id AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT node AS doc_id, min(low) AS component_id FROM reach GROUP BY node) c USING (doc_id)
"""
