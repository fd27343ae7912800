"""Vectorised words, lines and hashes over whole Arrow columns of text.

A column's UTF-8 bytes are one numpy array. All separators used here are ASCII, and in UTF-8 no byte of a
longer character is ASCII, so cutting bytes equals cutting characters. Hashes are polynomials modulo 2**64,
computed from running sums of short blocks, then mixed; equal byte strings always get equal hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

U64 = np.uint64
BLOCK = 1 << 18
SLICE = 1 << 21

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Words of letters, digits and all non-ASCII characters.
IS_ALNUM = np.zeros(256, bool)
IS_ALNUM[0x30:0x3A] = IS_ALNUM[0x61:0x7B] = IS_ALNUM[0x41:0x5B] = IS_ALNUM[0x80:] = True
#: Words of everything but ASCII white space.
IS_SPACE = np.zeros(256, bool)
IS_SPACE[[0x20, *range(0x09, 0x0E)]] = True
IS_SOLID = ~IS_SPACE

_MULTIPLIER = 0x9E3779B97F4A7C15 | 1
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _tables(n: int, multiplier: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n-1 of the multiplier and of its inverse modulo 2**64."""
    have = _powers.get(multiplier)
    if have is None or len(have[0]) < n:
        size = max(n, BLOCK + 1)
        out = []
        for base in (multiplier, pow(multiplier, -1, 1 << 64)):
            table = np.full(size, base, U64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        have = (out[0], out[1])
        if size <= 8 * BLOCK:
            _powers[multiplier] = have
    return have


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    x = (x ^ (x >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U64(27))) * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, multiplier: int = _MULTIPLIER) -> np.ndarray:
    """A 64-bit hash of each span of bytes; spans are in order and do not overlap."""
    out = np.zeros(len(starts), U64)
    i = 0
    while i < len(starts):
        first = starts[i]
        j = max(i + 1, int(np.searchsorted(ends, first + BLOCK, "right")))
        last = ends[j - 1]
        power, inverse = _tables(int(last - first) + 1, multiplier)
        sums = np.zeros(last - first + 1, U64)
        np.cumsum((data[first:last].astype(U64) + U64(1)) * power[: last - first], out=sums[1:])
        a, b = starts[i:j] - first, ends[i:j] - first
        out[i:j] = (sums[b] - sums[a]) * inverse[a]
        i = j
    return mix(out ^ (ends - starts).astype(U64) * U64(0xD6E8FEB86659FD93))


def column_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and its offsets; nulls are empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if not pa.types.is_large_string(texts.type):
        texts = texts.cast(pa.large_string())
    if texts.null_count:
        texts = texts.fill_null("")
    _, offsets, data = texts.buffers()
    at = np.frombuffer(offsets, np.int64, len(texts) + 1, texts.offset * 8) if len(texts) else np.zeros(1, np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8, int(at[-1] - at[0]), int(at[0])), at - at[0]


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", size: int = SLICE) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about `size` bytes of text, so that memory follows the longest text only."""
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column))
        if not len(texts):
            continue
        lengths = np.diff(column_bytes(texts)[1])
        ends = np.cumsum(lengths)
        at = 0
        while at < len(texts):
            base = ends[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(ends, base + size, "right")))
            yield batch.slice(at, stop - at)
            at = stop


def chosen(docs: DataFrame, key: str, text: str, carry: tuple[str, ...], results: tuple[str, ...]) -> DataFrame:
    """The key, the text and the carried columns, but for those that bear the name of a result: the result stands."""
    taken = {key.lower(), text.lower(), *(r.lower() for r in results)}
    return docs.select(key, text, *(c for c in dict.fromkeys(carry) if c.lower() not in taken))


def spans(data: np.ndarray, offsets: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of bytes for which `inside` holds: starts, ends, and the first run of each row (and one more)."""
    if not len(data):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(len(offsets), np.int64)
    held = inside[data]
    edge = held.copy()
    edge[1:] &= ~held[:-1]
    heads = offsets[:-1][offsets[:-1] < len(data)]
    edge[heads] = held[heads]
    starts = np.flatnonzero(edge)
    edge = held.copy()
    edge[:-1] &= ~held[1:]
    tails = offsets[1:][offsets[1:] > 0] - 1
    edge[tails] = held[tails]
    ends = np.flatnonzero(edge) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def ngram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash of each n consecutive word hashes."""
    if len(words) < n:
        return np.zeros(0, U64)
    out = np.zeros(len(words) - n + 1, U64)
    factor = U64(0x9FB21C651E98DF25)
    for i in range(n):
        out = out * factor + words[i : len(words) - n + 1 + i]
    return mix(out)


