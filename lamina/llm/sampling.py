"""Bounded samples for fitting models."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F


def sample_keys(keys: DataFrame, n: int) -> DataFrame:
    """The n rows of smallest hash of a table of keys, or all if there are fewer.

    Hashes above about twice the n-th are left out before the sort, so that what meets in one task is a few times n
    rows for any number of partitions. The same rows always give the same sample.
    """
    total = keys.count()
    share = min(1.0, (2 * n + 1000) / max(1, total))
    names = list(keys.columns)
    hashed = keys.withColumn("__hash", F.xxhash64(*names))
    if share < 1:
        hashed = hashed.filter(F.pmod("__hash", F.lit(1_000_000)) < math.ceil(share * 1_000_000))
    return hashed.orderBy("__hash", *names).limit(n).select(names)
