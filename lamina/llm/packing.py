"""Packing of token sequences: bounded-space, online, best-fit.

Each partition keeps a fixed number of open windows. A document, or what is left of it after whole windows, enters
the open window with the least space that holds it; when none does and all windows are open, the fullest is
emitted, first filled by a cut where it would carry more than a few padding tokens. What is open at the end of a
partition goes, with its ids, to a merge for each group of neighbouring partitions: best-fit-decreasing of whole
windows, then what is still open is cut into full windows and, at last, into powers of two, which need no padding.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from ..storage import materialize, table
from . import textvec as V
from .tokens import tokenizer

WINDOW = 2048
OPEN_WINDOWS = 32
#: Padding tokens at most with which a window is emitted rather than filled by cutting a document.
MAX_PADDING = 8
#: Partitions whose leftovers are merged together: at most MERGE_PARTITIONS * OPEN_WINDOWS * WINDOW ids in a task.
MERGE_PARTITIONS = 16
END_ID = 1

FIELDS = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, ids binary"
Piece = tuple[int | None, int, int, np.ndarray]  # doc_id, start in the document, the document's tokens, ids


class Packer:
    """Open windows ordered by free space; `closed` collects the pieces of emitted windows."""

    def __init__(self, window: int, limit: int, max_padding: int, first_id: int):
        self.window, self.limit, self.max_padding, self.next_id = window, limit, max_padding, first_id
        self.open: list[tuple[int, int]] = []  # (free, key), sorted
        self.pieces: dict[int, list[Piece]] = {}
        self.keys = 0
        self.closed: list[tuple[int, list[Piece]]] = []

    def emit(self, pieces: list[Piece]) -> None:
        self.closed.append((self.next_id, pieces))
        self.next_id += 1

    def _put(self, free: int, key: int) -> None:
        if free:
            insort(self.open, (free, key))
        else:
            self.emit(self.pieces.pop(key))

    def add(self, piece: Piece) -> None:
        doc_id, start, total, ids = piece
        while len(ids) >= self.window:
            self.emit([(doc_id, start, total, ids[: self.window])])
            start, ids = start + self.window, ids[self.window :]
        if not len(ids):
            return
        at = bisect_left(self.open, (len(ids), -1))
        if at < len(self.open):
            free, key = self.open.pop(at)
            self.pieces[key].append((doc_id, start, total, ids))
            self._put(free - len(ids), key)
            return
        if len(self.open) >= self.limit:
            free, key = self.open.pop(0)
            if free > self.max_padding:
                self.pieces[key].append((doc_id, start, total, ids[:free]))
                start, ids = start + free, ids[free:]
            self.emit(self.pieces.pop(key))
        self.keys += 1
        self.pieces[self.keys] = [(doc_id, start, total, ids)]
        self._put(self.window - len(ids), self.keys)


def rows_of(closed: list[tuple[int, list[Piece]]], keep_ids: bool) -> list[tuple]:
    out = []
    for sequence, pieces in closed:
        at = 0
        for doc_id, start, total, ids in pieces:
            raw = ids.astype("<u4").tobytes()
            out.append((doc_id, start, len(ids), zlib.crc32(raw), total, sequence, at, raw if keep_ids else None))
            at += len(ids)
    return out


def to_batch(rows: list[tuple], more: dict[str, list] | None = None) -> pa.RecordBatch:
    names = [x.split()[0] for x in FIELDS.split(", ")]
    columns = list(zip(*rows, strict=True)) or [[]] * len(names)
    arrays = {n: pa.array(c, pa.binary() if n == "ids" else pa.int64()) for n, c in zip(names, columns, strict=True)}
    return pa.RecordBatch.from_pydict(arrays | {n: pa.array(c, pa.int64()) for n, c in (more or {}).items()})


def pack_partition(batches: Iterator[pa.RecordBatch], window: int, limit: int, max_padding: int, path: str | None, keep_ids: bool) -> Iterator[pa.RecordBatch]:
    """Pieces of emitted windows, then, marked by merge >= 0, those of the windows still open."""
    part = TaskContext.get().partitionId()
    packer = Packer(window, limit, max_padding, part << 32)
    tokens = tokenizer(path)
    for batch in V.slices(batches):
        ids, edges = tokens.encode(batch.column("text"), END_ID)
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            own = ids[edges[i] : edges[i + 1]]
            packer.add((doc_id, 0, len(own), own))
        rows = rows_of(packer.closed, keep_ids)
        packer.closed = []
        yield to_batch(rows, {"merge": [-1] * len(rows)})
        for key, pieces in packer.pieces.items():  # so that an open window does not hold this slice's ids
            packer.pieces[key] = [(a, b, c, x.copy() if x.base is not None else x) for a, b, c, x in pieces]
    left = [(part << 32 | key, pieces) for key, pieces in sorted(packer.pieces.items())]
    rows = rows_of(left, True)
    yield to_batch(rows, {"merge": [part // MERGE_PARTITIONS] * len(rows)})


def merge_windows(windows: list[list[Piece]], window: int, max_padding: int, first_id: int) -> list[tuple[int, list[Piece]]]:
    """Merge leftover windows: whole ones best-fit-decreasing, then by cutting; the last rest in powers of two."""
    used = [sum(len(p[3]) for p in w) for w in windows]
    bins: list[tuple[int, int]] = []
    held: list[list[Piece]] = []
    for i in sorted(range(len(windows)), key=lambda i: -used[i]):
        at = bisect_left(bins, (used[i], -1))
        if at < len(bins):
            free, b = bins.pop(at)
            held[b] += windows[i]
            insort(bins, (free - used[i], b))
        else:
            held.append(list(windows[i]))
            insort(bins, (window - used[i], len(held) - 1))
    closed, rest = [], []
    for free, b in sorted(bins, key=lambda x: x[1]):
        if free <= max_padding:
            closed.append((first_id + len(closed), held[b]))
        else:
            rest += held[b]
    total = sum(len(p[3]) for p in rest)
    room = [window] * (total // window) + [1 << k for k in range(window.bit_length(), -1, -1) if total % window >> k & 1]
    at = 0
    for size in room:
        pieces, free = [], size
        while free:
            doc_id, start, tokens, ids = rest[at]
            pieces.append((doc_id, start, tokens, ids[:free]))
            if len(ids) > free:
                rest[at] = (doc_id, start + free, tokens, ids[free:])
            else:
                at += 1
            free -= len(pieces[-1][3])
        closed.append((first_id + len(closed), pieces))
    return closed


def pack(docs: DataFrame, *, window: int = WINDOW, limit: int = OPEN_WINDOWS, max_padding: int = MAX_PADDING, path: str | None = None, keep_ids: bool = True) -> DataFrame:
    """Pack all documents' tokens into sequences of at most `window`: a row for each piece with doc_id, start,
    length, ids_crc32, doc_tokens, sequence_id, offset and ids (little-endian unsigned 32-bit, null unless
    `keep_ids`).

    `path` names the tokenizer's file. Edge cases: a null or empty text is the end id alone; repeated rows and null
    doc_ids are packed row by row; a text longer than a window fills windows of its own first; an empty table
    gives an empty result; other columns play no part. Memory: one slice of text, the open windows and the bounded
    cache of words. Tokenizing happens once: the pieces are written to the shared folder before leftovers merge.
    """
    docs = docs.select("doc_id", "text")
    first = docs.mapInArrow(lambda it: pack_partition(it, window, limit, max_padding, path, keep_ids), f"{FIELDS}, merge long")
    first = materialize(first, "packed")

    def merge(group: pd.DataFrame) -> pd.DataFrame:
        windows: dict[int, list[Piece]] = {}
        for r in group.sort_values(["sequence_id", "offset"]).itertuples():
            windows.setdefault(r.sequence_id, []).append((None if pd.isna(r.doc_id) else int(r.doc_id), r.start, r.doc_tokens, np.frombuffer(r.ids, "<u4")))
        rows = rows_of(merge_windows(list(windows.values()), window, max_padding, 1 << 62 | int(group["merge"].iloc[0]) << 32), keep_ids)
        return to_batch(rows).to_pandas(types_mapper={pa.int64(): pd.Int64Dtype()}.get)

    left = first.filter("merge >= 0").groupBy("merge").applyInPandas(merge, FIELDS)
    return first.filter("merge < 0").drop("merge").unionByName(left)


def op6_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 2048 tokens."""
    return pack(table(spark, sf_dir, "documents"), keep_ids=False).drop("ids")
