"""Pages to token-bounded chunks.

Texts are never copied while they are grouped: an ordered fold over lengths finds where groups begin, then slices are
joined once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import text as X
from ..storage import materialize
from .numbering import running_offsets

MAX_TOKENS = 1500
MIN_TOKENS = 120
OVERFLOW = 1.2
#: Units that one inner fold takes.
FOLD_UNITS = 512
TokenCounter = Callable[[str], int]


def group_starts(lengths: Column, separator: int, max_tokens: int) -> Column:
    """Greedy grouping: the index of each group's first unit. A group takes units as long as its joined text keeps
    the ceiling; a unit beyond the ceiling is a group of its own.

    Units are folded in blocks: appending copies a list, so only a block's own starts are appended to one by one."""
    none = F.array().cast("array<int>")
    state = lambda size, i, starts: F.struct(size.alias("size"), i.alias("i"), starts.alias("starts"))
    start = F.struct(F.lit(0).cast("long").alias("size"), F.lit(0).alias("i"), F.array().cast("array<array<int>>").alias("blocks"))

    def step(acc: Column, n: Column) -> Column:
        joined = acc["size"] + separator + n
        new = (acc["i"] == 0) | (X.tokens_of_length(joined) > max_tokens)
        return state(F.when(new, n.cast("long")).otherwise(joined), acc["i"] + 1, F.when(new, F.concat(acc["starts"], F.array(acc["i"]))).otherwise(acc["starts"]))

    def block(acc: Column, own: Column) -> Column:
        done = F.aggregate(own, state(acc["size"], acc["i"], none), step)
        return X.let(done, lambda d: F.struct(d["size"].alias("size"), d["i"].alias("i"), F.concat(acc["blocks"], F.array(d["starts"])).alias("blocks")))

    def blocks(lengths: Column) -> Column:
        first = F.sequence(F.lit(0), F.floor((F.size(lengths) - 1) / F.lit(FOLD_UNITS)).cast("int"))
        return F.transform(first, lambda k: F.slice(lengths, k * FOLD_UNITS + 1, F.lit(FOLD_UNITS)))

    folded = lambda lengths: F.when(F.size(lengths) == 0, none).otherwise(F.aggregate(blocks(lengths), start, block, lambda acc: F.flatten(acc["blocks"])))
    return X.let(lengths, folded)


def sliced(units: Column, starts: Column, make: Callable[[Column], Column]) -> Column:
    """One value for each group, made of its slice of units."""
    return F.transform(starts, lambda s, k: make(F.slice(units, s + 1, F.coalesce(F.get(starts, k + 1), F.size(units)) - s)))


def grouped(units: Column, separator: str, max_tokens: int) -> Column:
    joined = lambda u, starts: sliced(u, starts, lambda own: F.array_join(own, separator))
    return X.let(units, lambda u: X.let(group_starts(F.transform(u, F.length), len(separator), max_tokens), lambda starts: joined(u, starts)))


def hard_split(text: Column, max_tokens: int) -> Column:
    """Sentences grouped under the ceiling; what is still above it is cut into groups of words."""
    pieces = grouped(X.sentences(text), " ", max_tokens)
    return F.flatten(F.transform(pieces, lambda p: F.when(X.estimate_tokens(p) <= max_tokens, F.array(p)).otherwise(grouped(X.words(p), " ", max_tokens))))


def split_blocks(pages: DataFrame) -> DataFrame:
    """blocks(source, page, pos, text): paragraphs with the headings before them; no shuffle."""
    paras = pages.select("source", "page", X.paragraphs(F.col("text")).alias("paras"))
    return paras.select("source", "page", F.posexplode(X.heading_blocks(F.col("paras"))).alias("pos", "text"))


def explode_oversized(blocks: DataFrame, max_tokens: int = MAX_TOKENS) -> DataFrame:
    """Blocks above the ceiling as their pieces: adds `sub`, the place in the block."""
    pieces = F.when(X.estimate_tokens(F.col("text")) <= max_tokens, F.array("text")).otherwise(hard_split(F.col("text"), max_tokens))
    return blocks.select("source", "page", "pos", F.posexplode(pieces).alias("sub", "text"))


def pack_blocks(blocks: DataFrame, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, merge_runts: bool = True) -> DataFrame:
    """chunks(source, index, text, start_page, end_page, token_count), the index within each document.

    A last chunk under `min_tokens` joins the one before if both stay under 1.2 times the ceiling. One shuffle, on
    the document.
    """
    docs = blocks.groupBy("source").agg(F.array_sort(F.collect_list(F.struct("page", "pos", "sub", "text"))).alias("b"))
    docs = docs.withColumn("starts", group_starts(F.transform("b", lambda b: F.length(b.text)), 2, max_tokens))
    if merge_runts:
        total = lambda own: F.aggregate(own, F.lit(-2).cast("long"), lambda a, b: a + 2 + F.length(b.text))
        before = F.try_element_at("starts", F.lit(-2))
        tail = total(F.expr("slice(b, element_at(starts, -1) + 1, size(b))"))
        both = total(F.expr("slice(b, try_element_at(starts, -2) + 1, size(b))"))
        runt = before.isNotNull() & (X.tokens_of_length(tail) < min_tokens) & (X.tokens_of_length(both) <= int(max_tokens * OVERFLOW))
        docs = docs.withColumn("starts", F.when(runt, F.expr("slice(starts, 1, size(starts) - 1)")).otherwise(F.col("starts")))
    page = lambda own: F.transform(own, lambda b: b.page)
    made = sliced(F.col("b"), F.col("starts"), lambda own: F.struct(F.array_join(F.transform(own, lambda b: b.text), "\n\n").alias("text"), F.array_min(page(own)).alias("start_page"), F.array_max(page(own)).alias("end_page")))
    out = docs.select("source", F.posexplode(made).alias("index", "c"))
    return out.select("source", "index", "c.*").withColumn("token_count", X.estimate_tokens(F.col("text")))


def _groups(units: list[str], separator: str, max_tokens: int, count: TokenCounter) -> list[list[int]]:
    """Greedy grouping with any counter: the units' numbers, group by group."""
    out: list[list[int]] = []
    for i, unit in enumerate(units):
        if out and count(separator.join([units[j] for j in out[-1]] + [unit])) <= max_tokens:
            out[-1].append(i)
        else:
            out.append([i])
    return out


def _pack_with(count: TokenCounter, max_tokens: int, min_tokens: int) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """The same pipeline for a counter that only Python can call, one document at a time."""
    import re

    ends = re.compile(r"(?<=[.!?])\s+(?=[A-Z\"'(\[])")

    def pieces(text: str) -> Iterator[str]:
        if count(text) <= max_tokens:
            yield text
            return
        sentences = ends.split(text)
        for group in _groups(sentences, " ", max_tokens, count):
            piece = " ".join(sentences[i] for i in group)
            words = piece.split()
            yield from [piece] if count(piece) <= max_tokens else (" ".join(words[i] for i in own) for own in _groups(words, " ", max_tokens, count))

    def pack(blocks: pd.DataFrame) -> pd.DataFrame:
        rows = [(r.page, p) for r in blocks.sort_values(["page", "pos"]).itertuples() for p in pieces(r.text)]
        groups = _groups([t for _, t in rows], "\n\n", max_tokens, count)
        joined = lambda own: "\n\n".join(rows[i][1] for i in own)
        if len(groups) > 1 and count(joined(groups[-1])) < min_tokens and count(joined(groups[-2] + groups[-1])) <= int(max_tokens * OVERFLOW):
            groups[-2:] = [groups[-2] + groups[-1]]
        made = [(blocks["source"].iloc[0], k, joined(own), min(rows[i][0] for i in own), max(rows[i][0] for i in own)) for k, own in enumerate(groups)]
        out = pd.DataFrame(made, columns=["source", "index", "text", "start_page", "end_page"])
        return out.assign(token_count=[count(t) for t in out["text"]])

    return pack


def chunk_documents(pages: DataFrame, *, max_tokens: int = MAX_TOKENS, min_tokens: int = MIN_TOKENS, token_counter: TokenCounter | None = None, document_order: str = "source") -> DataFrame:
    """Chunks of all documents, each document for itself, with one index over all, in the order of `document_order`.

    `token_counter` replaces the estimate of 3.5 characters a token by any Python function. Offsets come from one
    row for each document, in ranges of the order; chunks themselves are not sorted globally.
    """
    if max_tokens < min_tokens:
        raise ValueError("max_tokens must be >= min_tokens")
    blocks = split_blocks(pages)
    if token_counter is None:
        chunks = pack_blocks(explode_oversized(blocks, max_tokens), max_tokens, min_tokens)
    else:
        chunks = blocks.groupBy("source").applyInPandas(_pack_with(token_counter, max_tokens, min_tokens), "source string, index int, text string, start_page int, end_page int, token_count int")
    order = pages.groupBy("source").agg(F.min(document_order).alias("__order"))
    chunks = materialize(chunks, "chunks")  # counted, then numbered
    counts = chunks.groupBy("source").agg(F.count(F.lit(1)).alias("__n")).join(order, "source")
    offsets = running_offsets(counts, ["__order", "source"], "__n", "__at").select("source", "__at")
    out = chunks.join(offsets, "source").withColumn("index", (F.col("index") + F.col("__at")).cast("int"))
    return out.select("index", "text", "start_page", "end_page", "token_count", "source")


def chunk_totals(chunks: DataFrame) -> DataFrame:
    """Documents, chunks and the estimated tokens of all chunks."""
    return chunks.agg(F.countDistinct("source").alias("documents"), F.count(F.lit(1)).alias("chunks"), F.coalesce(F.sum("token_count"), F.lit(0)).cast("long").alias("tokens"))


def chunk_document(pages: DataFrame, **options) -> DataFrame:
    """Chunks of one document's pages."""
    return chunk_documents(pages, **options)
