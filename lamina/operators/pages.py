"""Raw pages to clean pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import text as X

EDGE_LINES = 2
REPEAT_SHARE = 0.6
LEAST_PAGES = 3


def _edge_prints(lines: Column) -> Column:
    """The distinct fingerprints of a page's first and last lines that are not blank."""

    def prints(filled: Column) -> Column:
        first, last = F.slice(filled, 1, EDGE_LINES), F.slice(filled, F.greatest(F.size(filled) - EDGE_LINES + 1, F.lit(1)), EDGE_LINES)
        return F.array_distinct(F.transform(F.concat(first, last), X.fingerprint))

    return X.let(F.filter(lines, lambda x: X.strip(x) != ""), prints)


def strip_running_lines(pages: DataFrame) -> DataFrame:
    """Remove headers and footers: lines at a page's edge whose fingerprint is at the edge of most of its document's
    pages. Documents of fewer than three pages stay. Repeats are counted among lines that are not blank, removal
    goes by raw position, so a header after blank lines is counted but stays.

    A null text counts as an empty page. Counting shuffles fingerprints with partial sums; only the few repeating
    ones are joined back, as one array for each document.
    """
    pages = pages.withColumn("__lines", F.split(F.coalesce("text", F.lit("")), "\n", -1))
    sizes = pages.groupBy("source").agg(F.count(F.lit(1)).alias("__pages"))
    counts = pages.select("source", F.explode(_edge_prints(F.col("__lines"))).alias("print")).groupBy("source", "print").agg(F.count(F.lit(1)).alias("hits"))
    least = F.greatest(F.lit(2), F.floor(F.col("__pages") * F.lit(REPEAT_SHARE)))
    repeating = counts.join(sizes.filter(F.col("__pages") >= LEAST_PAGES), "source").filter(F.col("hits") >= least).groupBy("source").agg(F.collect_set("print").alias("__gone"))
    n = F.size("__lines")
    kept = F.filter("__lines", lambda x, i: ~(((i < EDGE_LINES) | (i >= n - EDGE_LINES)) & F.array_contains("__gone", X.fingerprint(x))))
    out = pages.join(repeating, "source", "left")
    return out.withColumn("text", F.when(F.col("__gone").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n"))).drop("__lines", "__gone")


def finalize(pages: DataFrame) -> DataFrame:
    """Strip running lines, normalise each page, number the pages of a document from 1 in page order."""
    out = strip_running_lines(pages).withColumn("text", X.normalize(F.coalesce("text", F.lit(""))))
    return out.withColumn("page", F.row_number().over(Window.partitionBy("source").orderBy("page")).cast("int"))


def document_stats(pages: DataFrame) -> DataFrame:
    """text, page_count and char_count of each document."""
    texts = F.array_sort(F.collect_list(F.struct("page", "text")))
    joined = F.array_join(F.transform(F.filter(texts, lambda p: p.text != ""), lambda p: p.text), "\n\n")
    return pages.groupBy("source").agg(joined.alias("text"), F.count(F.lit(1)).alias("page_count"), F.sum(F.length("text")).alias("char_count"))
