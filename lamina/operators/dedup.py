"""Near-duplicate questions within a topic."""

from __future__ import annotations

import difflib
import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..functions import text as X
from ..storage import materialize
from .components import components

THRESHOLD = 0.85
#: Questions of one topic and class of length in a block.
BLOCK = 500
#: Characters that are counted one by one; the others count together.
COUNTED = "etaoinsrhdl "
#: Characters of a run, and longs of the signature of a text's runs.
GRAM = 4
WORDS = 16


@dataclass(frozen=True)
class DedupeResult:
    deck: DataFrame
    dropped: DataFrame  # with `duplicate_of`


def common_subsequence(a: str, b: str) -> int:
    """The length of the longest common subsequence, a bit for each character of `a`."""
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full = open_bits = (1 << len(a)) - 1
    for c in b:
        hit = open_bits & places.get(c, 0)
        open_bits = (open_bits + hit | open_bits - hit) & full
    return len(a) - open_bits.bit_count()


def rare_characters(text: str) -> int:
    """How many of the characters of a second text start matches: all, but in texts of 200 and more only those that
    difflib does not call popular."""
    popular = len(text) // 100 + 1
    return len(text) if len(text) < 200 else sum(n for n in Counter(text).values() if n <= popular)


def gram_bits(texts: pd.Series) -> pd.DataFrame:
    """A signature of each text's distinct runs of GRAM characters, one bit for each hash, and its rare characters."""
    out = np.zeros((len(texts), 64 * WORDS), np.uint8)
    for row, text in zip(out, texts, strict=True):
        code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        if len(code) >= GRAM:
            grams = np.zeros(len(code) - GRAM + 1, np.uint64)
            for i in range(GRAM):
                grams = grams * np.uint64(0x9FB21C651E98DF25) + code[i : i + len(grams)]
            row[(grams * np.uint64(0xD1342543DE82EF95) >> np.uint64(40)) % np.uint64(64 * WORDS)] = 1
    words = np.packbits(out, axis=1, bitorder="little").view(np.int64)
    return pd.DataFrame({f"s{i}": words[:, i] for i in range(WORDS)} | {"bits": out.sum(axis=1, dtype=np.int64), "rare": [rare_characters(x) for x in texts]})


def matched(x: str, y: str) -> int:
    """The characters that difflib matches between `x` and a `y` of at least 200. Matches start at characters that are
    not popular in `y`, so only their places are looked at; runs and ties are settled as difflib settles them."""
    places: dict[str, list[int]] = {}
    popular = len(y) // 100 + 1
    kept = {c for c, n in Counter(y).items() if n <= popular}
    for j, c in enumerate(y):
        if c in kept:
            places.setdefault(c, []).append(j)
    anchors = [(i, places[c]) for i, c in enumerate(x) if c in places]
    at = [i for i, _ in anchors]
    total, open_regions = 0, [(0, len(x), 0, len(y))]
    while open_regions:
        alo, ahi, blo, bhi = open_regions.pop()
        i, j, size, last, ends = alo, blo, 0, -2, {}
        for place, others in anchors[bisect_left(at, alo) : bisect_left(at, ahi)]:
            before, ends = ends if place == last + 1 else {}, {}
            for other in others[bisect_left(others, blo) : bisect_left(others, bhi)]:
                run = ends[other] = before.get(other - 1, 0) + 1
                if run > size:
                    i, j, size = place - run + 1, other - run + 1, run
            last = place
        end_a, end_b = i + size, j + size
        while i > alo and j > blo and x[i - 1] == y[j - 1]:
            i, j = i - 1, j - 1
        while end_a < ahi and end_b < bhi and x[end_a] == y[end_b]:
            end_a, end_b = end_a + 1, end_b + 1
        if end_a > i:
            total += end_a - i
            if alo < i and blo < j:
                open_regions.append((alo, i, blo, j))
            if end_a < ahi and end_b < bhi:
                open_regions.append((end_a, ahi, end_b, bhi))
    return total


def reaches(x: str, y: str, threshold: float) -> bool:
    """Whether difflib's ratio of `x` to `y` reaches the threshold. Matched blocks are a common subsequence of both
    texts, whose greatest length bounds the ratio of short ones; long ones must share runs, as in the join's bound."""
    both = len(x) + len(y)
    if len(y) < 200:
        return 2 * common_subsequence(x, y) >= threshold * both - 1e-9 and difflib.SequenceMatcher(None, x, y).ratio() >= threshold
    if both > 64 * WORDS:
        grams = [{t[i : i + GRAM] for i in range(len(t) - GRAM + 1)} for t in (x, y)]
        least = threshold * both / 2 - 1e-9
        cuts = (GRAM - 1) * min(rare_characters(y), both - 2 * least)
        if any(len(own - other) > len(t) - least + cuts for t, own, other in ((x, *grams), (y, *grams[::-1]))):
            return False
        if 2 * common_subsequence(x, y) < 2 * least:
            return False
    return 2.0 * matched(x, y) / both >= threshold


def _linked(threshold: float):
    """Whether the ratio of the first text to the second, or with `back` that of the second to the first, reaches the
    threshold."""

    @F.pandas_udf("boolean")
    def linked(a: pd.Series, b: pd.Series, back: pd.Series) -> pd.Series:
        return pd.Series([reaches(x, y, threshold) or both and reaches(y, x, threshold) for x, y, both in zip(a, b, back, strict=True)], dtype=bool)

    return linked


def _joining(threshold: float):
    """Of the pairs (id1, id2, q1, q2, back, near) a task sees, links that join the same questions as all its links do:
    the nearest come first, and two questions that are joined already are not compared."""

    def joining(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        above: dict[int, int] = {}

        def root(i: int) -> int:
            while i in above:
                if above[i] in above:
                    above[i] = above[above[i]]
                i = above[i]
            return i

        for batch in batches:
            links = []
            for id1, id2, x, y, both, _ in batch.sort_values("near", ascending=False).itertuples(index=False):
                a, b = root(id1), root(id2)
                if a != b and (reaches(x, y, threshold) or both and reaches(y, x, threshold)):
                    above[max(a, b)] = min(a, b)
                    links.append((id1, id2))
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    return joining


def _forms(deck: DataFrame) -> DataFrame:
    """The cards that can be compared: id, topic without regard to case, normal form of the question."""
    return deck.filter("topic IS NOT NULL AND question IS NOT NULL").select("id", F.lower("topic").alias("t"), X.normal_form(F.col("question")).alias("q"))


def similar_pairs(deck: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Links (a, b) between the smallest ids of equal questions in a topic (topics without regard to case) whose
    ratio reaches the threshold in the order in which any two of their cards stand.

    Equal questions enter once, so copies cost nothing. Lengths bound the ratio: candidates meet only in equal or
    neighbouring classes of length, an equi-join on topic and class. Counts of characters bound it as well: the join
    itself sorts out pairs that share too few, before any Python runs. So do runs of GRAM characters: k matched blocks
    of m characters in all hold m - k (GRAM - 1) of a text's runs or more, and there is no block without a rare
    character of the second text but one at the start. A topic's class of many questions is cut into blocks, and each
    pair of blocks is a task's share, so that no task compares a whole topic.
    """
    return _similar(_forms(deck), threshold)


def _similar(cards: DataFrame, threshold: float, every: bool = True) -> DataFrame:
    """Every link, or links enough to join the same questions."""
    reps = cards.groupBy("t", "q").agg(F.min("id").cast("long").alias("id"), F.max("id").cast("long").alias("last")).withColumn("n", F.length("q"))
    # Above a ratio of t, the longer text has at most (2 - t) / t times the characters of the shorter.
    if 0 < threshold <= 1:
        step = math.log(max((2 - threshold) / threshold, 1.0) + 1e-9)
        kind = F.floor(F.log(F.greatest(F.col("n"), F.lit(1)).cast("double")) / F.lit(max(step, 1e-6)))
    else:
        kind = F.lit(0)
    counts = [(F.col("n") - F.length(F.replace("q", F.lit(c), F.lit("")))).alias(f"c{i}") for i, c in enumerate(COUNTED)]
    reps = reps.select("id", "last", "t", "q", "n", kind.cast("long").alias("k"), *counts)
    reps = reps.withColumn("c", F.col("n") - sum((F.col(f"c{i}") for i in range(len(COUNTED))), F.lit(0)))
    schema = ", ".join([*(f"s{i} long" for i in range(WORDS)), "bits long", "rare long"])
    reps = reps.withColumn("s", F.pandas_udf(gram_bits, schema)("q")).select("*", "s.*").drop("s")
    reps = materialize(reps, "questions")
    # Classes of more than one block; all others are block 0 alone.
    large = reps.groupBy("t", "k").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")).filter("blocks > 1")
    large = materialize(large, "large-classes")

    def blocks_of(frame: DataFrame, kind: str) -> DataFrame:
        known = large.select("t", F.col("k").alias(kind), F.col("blocks").alias("__blocks"))
        return frame.join(known, ["t", kind], "left").withColumn("__blocks", F.coalesce("__blocks", F.lit(1)))

    def side(own: str, other: str, sign: str) -> DataFrame:
        """Each text in its block, once for each block of the classes that it can meet."""
        out = blocks_of(reps.withColumnRenamed("k", own), own).withColumn(f"{own}_block", F.pmod(F.xxhash64("id"), F.col("__blocks")).cast("int")).drop("__blocks")
        out = blocks_of(out.withColumn(other, F.explode(F.array(F.col(own) - 1, F.col(own), F.col(own) + 1))), other)
        out = out.withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), (F.col("__blocks") - 1).cast("int"))))
        return out.select("t", "j", "k", "j_block", "k_block", *(F.col(c).alias(f"{c}{sign}") for c in names))

    counted = ["c", *(f"c{i}" for i in range(len(COUNTED)))]
    names = ["id", "last", "q", "n", *counted, *(f"s{i}" for i in range(WORDS)), "bits", "rare"]
    least = F.lit(threshold) * (F.col("n1") + F.col("n2")) - F.lit(1e-9)
    shared = sum((F.least(f"{c}1", f"{c}2") for c in counted), F.lit(0))
    # The ratio depends on the order; the other order counts where a card of the second text stands first.
    back = F.col("id2") < F.col("last1")
    common = sum((F.bit_count(F.col(f"s{i}1").bitwiseAND(F.col(f"s{i}2"))) for i in range(WORDS)), F.lit(0))
    cuts = (GRAM - 1) * F.least(F.when(back, F.greatest("rare1", "rare2")).otherwise(F.col("rare2")), F.col("n1") + F.col("n2") - least)
    bounds = (F.col("id1") < F.col("id2")) & (2 * F.least("n1", "n2") >= least) & (2 * shared >= least)
    bounds &= common >= F.greatest(F.col("bits1") - F.col("n1"), F.col("bits2") - F.col("n2")) + least / 2 - cuts
    keys, spark = ["t", "j", "k", "j_block", "k_block"], cards.sparkSession
    # Topics differ in size, so there are more shares than cores; a stated number is not lowered by adaptive execution.
    shares = max(4 * spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    left, right = side("j", "k", "1").repartition(shares, *keys), side("k", "j", "2").repartition(shares, *keys)
    both = left.join(right, [left[c] == right[c] for c in keys] + [bounds]).select("id1", "id2", "q1", "q2", back.alias("back"), (common / F.greatest("bits1", "bits2", F.lit(1))).alias("near"))
    if not every:
        return both.mapInPandas(_joining(threshold), "a long, b long")
    return both.filter(_linked(threshold)("q1", "q2", "back")).select(F.col("id1").alias("a"), F.col("id2").alias("b"))


def duplicate_labels(deck: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """(id, keeper) of every card that is in a group of several: equal and similar questions, closed under links."""
    cards = _forms(deck)
    if threshold < 1.0:
        cards = materialize(cards, "forms")  # read three times
    reps = cards.groupBy("t", "q").agg(F.min("id").cast("long").alias("rep"), F.count(F.lit(1)).alias("copies"))
    if threshold <= 1.0:
        found = components(_similar(cards, threshold, every=False)).withColumnRenamed("node", "rep") if threshold < 1.0 else None
    else:
        return cards.select("id", F.lit(0).alias("keeper")).limit(0)
    if found is None:
        reps = reps.filter("copies > 1").select("t", "q", F.col("rep").alias("keeper"))
    else:
        reps = reps.join(found, "rep", "left").filter("copies > 1 OR component IS NOT NULL").select("t", "q", F.coalesce("component", "rep").alias("keeper"))
    return cards.join(reps, ["t", "q"]).select("id", F.col("keeper").cast("int").alias("keeper"))


def find_near_duplicates(deck: DataFrame, *, threshold: float = THRESHOLD) -> DataFrame:
    """Groups of near-duplicate cards: keeper and the sorted ids of its group."""
    return duplicate_labels(deck, threshold).groupBy("keeper").agg(F.array_sort(F.collect_set("id")).alias("ids"))


def deduplicate(deck: DataFrame, *, threshold: float = THRESHOLD) -> DedupeResult:
    """Keep the card of smallest id in each group."""
    drop = materialize(duplicate_labels(deck, threshold).filter("id <> keeper").select("id", F.col("keeper").alias("duplicate_of")), "duplicates")
    return DedupeResult(deck.join(drop.select("id"), "id", "left_anti").select(deck.columns), deck.join(drop, "id").select(*deck.columns, "duplicate_of").orderBy("id"))
