"""Sharding by best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) enter, largest first, the open shard with the tightest remaining capacity, found in a
balanced tree. Groups of one size are alike for the packing, so the driver packs the histogram of group sizes: a
corpus of T bytes has at most sqrt(2 T) different sizes, however many groups there are. The plan goes back as runs
"the i-th to j-th group of this size enter shard s"; groups are numbered within their size in buckets, so no task
gets all groups of a size or all rows of a shard.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..storage import materialize, table

N_SHARDS = 24
ROW_BYTES = 8
#: Groups or rows that one numbering window should hold.
BUCKET_ROWS = 20_000


class Bins:
    """Open bins by (remaining capacity, bin) in an AA tree."""

    def __init__(self) -> None:
        self.root: list | None = None  # [key, level, left, right]

    @staticmethod
    def _skew(t: list) -> list:
        left = t[2]
        if left and left[1] == t[1]:
            t[2], left[3] = left[3], t
            return left
        return t

    @staticmethod
    def _split(t: list) -> list:
        right = t[3]
        if right and right[3] and right[3][1] == t[1]:
            t[3], right[2] = right[2], t
            right[1] += 1
            return right
        return t

    def add(self, key: tuple[int, int]) -> None:
        self.root = self._add(self.root, key)

    def _add(self, t: list | None, key: tuple[int, int]) -> list:
        if t is None:
            return [key, 1, None, None]
        side = 2 if key < t[0] else 3
        t[side] = self._add(t[side], key)
        return self._split(self._skew(t))

    def remove(self, key: tuple[int, int]) -> None:
        self.root = self._remove(self.root, key)

    def _remove(self, t: list | None, key: tuple[int, int]) -> list | None:
        if t is None:
            return None
        if key < t[0]:
            t[2] = self._remove(t[2], key)
        elif key > t[0]:
            t[3] = self._remove(t[3], key)
        elif t[2] is None:
            return t[3]
        else:
            near = t[2]
            while near[3]:
                near = near[3]
            t[0] = near[0]
            t[2] = self._remove(t[2], near[0])
        level = min(t[2][1] if t[2] else 0, t[3][1] if t[3] else 0) + 1
        if level < t[1]:
            t[1] = level
            if t[3] and t[3][1] > level:
                t[3][1] = level
        t = self._skew(t)
        if t[3]:
            t[3] = self._skew(t[3])
            if t[3][3]:
                t[3][3] = self._skew(t[3][3])
        t = self._split(t)
        if t[3]:
            t[3] = self._split(t[3])
        return t

    def tightest(self, size: int) -> tuple[int, int] | None:
        """The bin of least remaining capacity that takes `size`."""
        t, best = self.root, None
        while t:
            if t[0][0] >= size:
                best, t = t[0], t[2]
            else:
                t = t[3]
        return best


def best_fit(sizes: list[int], counts: list[int], capacity: int, most: int | None = None, first: int = 0) -> list[tuple[int, int, int, int]] | None:
    """Pack classes of equal sizes, given largest first: runs (size, first group, groups, bin). None if more than
    `most` bins are needed. A group above the capacity gets a bin of its own. After a group enters the tightest bin,
    that bin stays the tightest for its size, so whole runs are placed at once, as one by one."""
    bins, runs, opened = Bins(), [], 0
    for size, count in zip(sizes, counts, strict=True):
        at = 0
        while at < count:
            found = bins.tightest(size)
            if found is None:
                if opened == most:
                    return None
                left, b = max(capacity, size), first + opened
                opened += 1
            else:
                left, b = found
                bins.remove(found)
            n = min(count - at, left // size)
            runs.append((size, at, n, b))
            if left > n * size:
                bins.add((left - n * size, b))
            at += n
    return runs


def plan_equal(sizes: list[int], counts: list[int], n: int) -> list[tuple[int, int, int, int]]:
    """Pack into n bins of the smallest capacity that best-fit-decreasing meets (to 1/20000 of a bin). Groups that
    alone exceed an equal share get bins of their own first, as they cannot be divided."""
    sizes, counts = list(sizes), list(counts)
    runs, used = [], 0
    total = sum(s * c for s, c in zip(sizes, counts, strict=True))
    at = {}
    while sizes and n - used > 1 and sizes[0] * (n - used) >= total:
        runs.append((sizes[0], at.get(sizes[0], 0), 1, used))
        at[sizes[0]] = at.get(sizes[0], 0) + 1
        total, used, counts[0] = total - sizes[0], used + 1, counts[0] - 1
        if not counts[0]:
            del sizes[0], counts[0]
    if not sizes:
        return runs
    low = -(-total // (n - used))
    high, step = low + sizes[0], max(1, low // 20_000)
    best = best_fit(sizes, counts, high, n - used, used)
    while high - low > step:
        middle = (low + high) // 2
        found = best_fit(sizes, counts, middle, n - used, used)
        if found is None:
            low = middle
        else:
            high, best = middle, found
    return runs + [(s, a + at.get(s, 0), c, b) for s, a, c, b in best]


def _numbered(df: DataFrame, part: list[str], order: str, name: str) -> DataFrame:
    """Gapless numbers from 0 within `part`, bucket (`__b`) after bucket: a window holds one bucket, and the buckets'
    offsets come from their counts."""
    counts = df.groupBy(*part, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(*part).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("__at", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n")
    own = F.row_number().over(Window.partitionBy(*part, "__b").orderBy(order)) - 1
    return df.withColumn("__own", own).join(counts, [*part, "__b"]).withColumn(name, (F.col("__own") + F.col("__at")).cast("long")).drop("__b", "__own", "__at")


def shard(docs: DataFrame, *, n_shards: int | None = N_SHARDS, capacity: int | None = None) -> DataFrame:
    """Assign all documents to shards: doc_id, size, text_crc32, shard, slot.

    A row's size is its text's UTF-8 bytes plus 8; rows of equal texts are one indivisible group. With `capacity`
    (bytes) as few shards as best-fit-decreasing finds are opened; otherwise `n_shards` shards of nearly equal bytes.
    Slots are gapless from 0 in each shard; those of a group of over BUCKET_ROWS rows may differ from run to run, as
    its rows may be equal in everything and are dealt by their place. Edge cases: null texts are a group of their own, of size 8 each, with
    the CRC of no bytes; a group larger than a shard gets a shard of its own and is not divided; repeated rows and
    null doc_ids are ordinary rows; an empty table gives an empty result; other columns play no part.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", (F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES).cast("long").alias("size"), F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"), F.coalesce(F.unhex(F.sha2("text", 256)), F.lit(b"\x00")).alias("__key"))
    docs = materialize(docs, "shard-rows")
    groups = docs.groupBy("__key").agg((F.max("size") * F.count(F.lit(1))).alias("__size"), F.count(F.lit(1)).alias("__rows"))
    groups = materialize(groups, "shard-groups")
    classes = groups.groupBy("__size").agg(F.count(F.lit(1)).alias("n")).toPandas().sort_values("__size", ascending=False)
    sizes, counts = classes["__size"].tolist(), classes["n"].tolist()
    runs = best_fit(sizes, counts, capacity) if capacity else plan_equal(sizes, counts, n_shards)
    n_bins = max((b for *_, b in runs), default=0) + 1
    runs = spark.createDataFrame(pd.DataFrame(np.array(runs, np.int64).reshape(-1, 4), columns=["__size", "__from", "__many", "shard"]), "__size long, __from long, __many long, shard long")
    buckets = max(1, math.ceil(max(counts, default=1) / BUCKET_ROWS))
    numbered = _numbered(groups.withColumn("__b", F.pmod(F.xxhash64("__key"), F.lit(buckets))), ["__size"], "__key", "__nth")
    placed = numbered.join(runs, "__size").filter("__nth >= __from AND __nth < __from + __many").select("__key", "__rows", F.col("shard").cast("int").alias("shard"))
    # Rows of one doc_id are spread by their texts, rows of a hot text by their place, in buckets of their own.
    buckets = max(16, math.ceil(docs.count() / n_bins / BUCKET_ROWS))
    bucket = F.pmod(F.xxhash64("doc_id", "text_crc32"), F.lit(buckets))
    bucket = F.when(F.col("__rows") > BUCKET_ROWS, buckets + F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(buckets))).otherwise(bucket)
    rows = docs.join(placed, "__key").select("doc_id", "size", "text_crc32", "shard", bucket.alias("__b"))
    rows = materialize(rows, "shard-placed")  # once written, a row's bucket stays the same whenever it is read
    return _numbered(rows, ["shard"], "doc_id", "slot").select("doc_id", "size", "text_crc32", "shard", "slot")


def op3_shard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 24 shards of nearly equal bytes."""
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
