"""Nearest neighbours by inner product with vantage-point trees per shard.

A vector x becomes (x, sqrt(M^2 - |x|^2)) with M the largest norm, a query (q, 0): the largest inner product is then
the smallest Euclidean distance, so the triangle inequality holds. Rows are dealt to cells around pivots, which are
fitted on a bounded sample; a cell is cut into shards of bounded size, each with a vantage-point tree. A query first
searches the trees of its own cell, then those of the cells whose bound (d(q, p) - d(q, own p)) / 2 is below its k-th
distance divided by `factor`. Inside a tree a child is skipped by the same rule on its bound. Factor one makes every
skip safe: the search is exact. Every result row comes out of a tree; the sample serves the pivots only.

Equal vectors are one node with its k + 1 smallest ids (no others can rank), and equal queries are searched once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from ..storage import materialize, table
from .sampling import sample_keys

#: Rows that the pivots are fitted on at most.
SAMPLE_ROWS = 16_384
MAX_CELLS = 4096
SHARD_ROWS = 8192
#: Queries that one task takes at most.
QUERY_ROWS = 8192
LEAF = 128
#: Measured recall at 20 and shares of rows visited are in the README.
FACTOR = 6.0
#: Rounding of a distance, as a share of the largest norm; it only widens the search.
SLACK = 1e-7


class Found:
    """The k nearest rows of each query so far, by score, then by id; -1 fills up."""

    def __init__(self, q: np.ndarray, k: int, least: np.ndarray, norm: float, slack: float):
        self.q, self.k, self.norm = q, k, norm
        self.rows = np.full((len(q), k), -1, np.int64)
        self.scores = np.full((len(q), k), -np.inf)
        self.least = least.copy()  # a row below this score cannot rank
        self.slack = slack
        self.square = (q * q).sum(axis=1)
        self.visited = np.zeros(len(q), np.int64)

    def tau(self, at: np.ndarray) -> np.ndarray:
        """The distance within which a row can still rank."""
        least = self.least[at]
        return np.where(np.isfinite(least), np.sqrt(np.maximum(self.square[at] + self.norm**2 - 2 * np.where(np.isfinite(least), least, 0), 0)), np.inf)

    def offer(self, at: np.ndarray, own: np.ndarray, x: np.ndarray, ids: np.ndarray) -> None:
        """Let the rows `own` compete for the queries `at`."""
        self.visited[at] += len(own)
        dots = self.q[at] @ x[own].T
        bar = self.least[at]
        fresh = np.flatnonzero(~np.isfinite(bar))
        if len(own) > self.k and len(fresh):
            bar[fresh] = np.partition(dots[fresh], -self.k, axis=1)[:, -self.k]
        i, j = np.nonzero(dots >= bar[:, None] - 1e-12 * self.norm**2)
        if not len(i):
            return
        asked, row = at[i], own[j]
        score = (self.q[asked] * x[row]).sum(axis=1)
        touched = np.unique(asked)
        old = self.rows[touched]
        a, b = np.nonzero(old >= 0)
        asked = np.concatenate([touched[a], asked])
        row = np.concatenate([old[a, b], row])
        score = np.concatenate([self.scores[touched][a, b], score])
        order = np.lexsort((ids[row], -score, asked))
        asked, row, score = asked[order], row[order], score[order]
        begin = np.flatnonzero(np.append(True, asked[1:] != asked[:-1]))
        place = np.arange(len(asked)) - np.repeat(begin, np.diff(np.append(begin, len(asked))))
        kept = place < self.k
        self.rows[asked[kept], place[kept]] = row[kept]
        self.scores[asked[kept], place[kept]] = score[kept]
        self.least[touched] = np.maximum(self.least[touched], self.scores[touched, self.k - 1])


class Tree:
    """A vantage-point tree over lifted rows; search runs for many queries at once."""

    def __init__(self, x: np.ndarray, norm: float, ids: np.ndarray, leaf: int = LEAF):
        self.x, self.norm, self.ids, self.leaf, self.leaves = x, norm, ids, leaf, 0
        self.lifted = lifted(x, norm)
        self.root = self._build(np.arange(len(x)))

    def _build(self, rows: np.ndarray):
        if len(rows) <= self.leaf:
            self.leaves += 1
            return (rows, self.leaves)
        # The row farthest from the first one: a vantage point at the edge separates best.
        own = self.lifted[rows]
        v = rows[np.argmax(((own - own[0]) ** 2).sum(axis=1))]
        d = np.sqrt(((own - self.lifted[v]) ** 2).sum(axis=1))
        order = np.argsort(d, kind="stable")
        rows, d = rows[order], d[order]
        half = len(rows) // 2
        return (self.lifted[v], d[half - 1], d[half], self._build(rows[:half]), self._build(rows[half:]))

    def search(self, q: np.ndarray, k: int, least: np.ndarray, factor: float) -> Found:
        """The k nearest rows of each query among those of a score of `least` at least."""
        found = Found(q, k, least, self.norm, SLACK * self.norm)
        home = np.zeros(len(q), np.int64)

        def near(node, at: np.ndarray) -> None:
            """Each query's own leaf, for a first bound."""
            if not len(at):
                return
            if len(node) == 2:
                home[at] = node[1]
                found.offer(at, node[0], self.x, self.ids)
                return
            point, inner, outer, inside, outside = node
            close = self._distance(q[at], point) <= (inner + outer) / 2
            near(inside, at[close])
            near(outside, at[~close])

        def rest(node, at: np.ndarray) -> None:
            if not len(at):
                return
            if len(node) == 2:
                found.offer(at[home[at] != node[1]], node[0], self.x, self.ids)
                return
            point, inner, outer, inside, outside = node
            d = self._distance(q[at], point)
            order = [(inside, d - inner), (outside, outer - d)]
            if 2 * (d <= (inner + outer) / 2).sum() < len(at):  # most queries' side first, so that bounds grow early
                order.reverse()
            for child, bound in order:
                rest(child, at[bound * factor <= found.tau(at) + found.slack])

        near(self.root, np.arange(len(q)))
        rest(self.root, np.arange(len(q)))
        return found

    @staticmethod
    def _distance(q: np.ndarray, point: np.ndarray) -> np.ndarray:
        """From queries, whose last coordinate is 0, to a lifted point."""
        return np.sqrt(((q - point[:-1]) ** 2).sum(axis=1) + point[-1] ** 2)


def lifted(x: np.ndarray, norm: float) -> np.ndarray:
    return np.concatenate([x, np.sqrt(np.maximum(norm * norm - (x * x).sum(axis=1), 0))[:, None]], axis=1)


def fit_pivots(x: np.ndarray, n: int, rounds: int = 8) -> np.ndarray:
    """Means of a bounded sample: deterministic starts, a few rounds."""
    pivots = x[np.random.default_rng(7).permutation(len(x))[:n]].copy()
    for _ in range(rounds):
        near = distances(x, pivots)[0]
        order = np.argsort(near, kind="stable")
        held, begin = np.unique(near[order], return_index=True)
        pivots[held] = np.add.reduceat(x[order], begin) / np.diff(np.append(begin, len(x)))[:, None]
    return pivots


def distances(q: np.ndarray, pivots: np.ndarray, within: np.ndarray | None = None, block: int = 512) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The nearest pivot of each row and its distance, in blocks of rows; with `within`, also all (row, pivot) whose
    distance is at most that of the nearest plus `within`."""
    own, low, rows, cells = [], [], [], []
    square = (pivots * pivots).sum(axis=1)
    for i in range(0, len(q), block):
        part = q[i : i + block]
        d = np.sqrt(np.maximum((part * part).sum(axis=1)[:, None] + square - 2 * part @ pivots.T, 0))
        own.append(d.argmin(axis=1))
        low.append(d.min(axis=1))
        if within is not None:
            a, b = np.nonzero(d <= (low[-1] + within[i : i + block])[:, None])
            rows.append(a + i)
            cells.append(b)
    flat = lambda parts, kind: np.concatenate(parts) if parts else np.zeros(0, kind)
    return flat(own, np.int64), flat(low, float), flat(rows, np.int64), flat(cells, np.int64)


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """A column of lists, all of one length and without nulls, in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def search_shard(vectors: pa.Table, queries: pa.Table, width: int, norm: float, k: int, factor: float) -> pa.Table:
    """The k best ids of each query in one shard, with exact scores."""
    x, q = matrix(vectors["vector"], width), matrix(queries["vector"], width)
    ids = vectors["ids"].combine_chunks() if len(vectors) else pa.array([], pa.list_(pa.int64()))
    begin, flat = ids.offsets.to_numpy()[: len(x) + 1], ids.values.to_numpy(zero_copy_only=False)
    k1, k2 = queries["k1"].to_numpy(), queries["k2"].to_numpy()
    if not len(x) or not len(q):
        asked = node = np.zeros(0, np.int64)
        score = np.zeros(0)
    else:
        found = Tree(x, norm, flat[begin[:-1]]).search(q, k, queries["least"].to_numpy(), factor)
        asked, place = np.nonzero(found.rows >= 0)
        node, score = found.rows[asked, place], found.scores[asked, place]
    many = begin[node + 1] - begin[node] if len(node) else np.zeros(0, np.int64)
    at = np.repeat(np.arange(len(node)), many)
    inner = np.arange(len(at)) - np.repeat(np.cumsum(many) - many, many)
    asked, score = asked[at], score[at]
    vec_id = flat[begin[node][at] + inner] if len(node) else np.zeros(0, np.int64)
    order = np.lexsort((vec_id, -score, asked))
    asked, score, vec_id = asked[order], score[order], vec_id[order]
    head = np.flatnonzero(np.append(True, asked[1:] != asked[:-1])) if len(asked) else np.zeros(0, np.int64)
    kept = np.arange(len(asked)) - np.repeat(head, np.diff(np.append(head, len(asked)))) < k
    return pa.table({"k1": pa.array(k1[asked[kept]], pa.int64()), "k2": pa.array(k2[asked[kept]], pa.int64()), "vec_id": pa.array(vec_id[kept], pa.int64()), "score": pa.array(score[kept], pa.float64())})


def nearest(vectors: DataFrame, is_query: str, *, k: int = 20, factor: float = FACTOR, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """The k nearest other rows of each query row: query_id, rank (from 1), vec_id, score (inner product in double).

    `is_query` is a SQL condition on the id column. Nearest first, ties to the smaller id. Edge cases: null ids and
    vectors that are null, empty, zero, of another length than most, or that hold null or non-finite components take
    no part; rows that share an id count as one; with k candidates or fewer all are returned; an empty table gives
    an empty result; other columns play no part.
    """
    spark = vectors.sparkSession
    schema = "query_id long, rank int, vec_id long, score double"
    element = vectors.schema[vector_column].dataType.elementType
    kind = "float" if isinstance(element, T.FloatType) else "double"  # floats travel as they are
    x = vectors.select(F.col(id_column).cast("long").alias("id"), F.col(vector_column).cast(f"array<{kind}>").alias("vector"), F.expr(is_query).alias("asked")).filter("id IS NOT NULL AND size(vector) > 0")
    x = x.filter(f"forall(vector, v -> v IS NOT NULL AND NOT isnan(v) AND abs(v) < {kind}('infinity')) AND exists(vector, v -> v <> 0)")
    most = x.groupBy(F.size("vector").alias("w")).count().orderBy(F.desc("count"), "w").first()
    if most is None:
        return spark.createDataFrame([], schema)
    width = int(most.w)
    # Adding 0 makes -0.0 equal to 0.0, as the products are.
    x = x.filter(F.size("vector") == width).withColumn("vector", F.transform("vector", lambda v: v + F.lit(0).cast(kind))).withColumns({"k1": F.xxhash64("vector"), "k2": F.xxhash64(F.lit(1), "vector")})
    rank = F.row_number().over(Window.partitionBy("k1", "k2").orderBy("id"))
    nodes = x.select("k1", "k2", "id", "vector").dropDuplicates(["k1", "k2", "id"]).withColumn("nth", rank).filter(F.col("nth") <= k + 1)
    nodes = nodes.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.sort_array(F.collect_list("id")).alias("ids"))
    nodes = materialize(nodes, "ann-nodes")
    square = F.aggregate("vector", F.lit(0.0), lambda a, v: a + v.cast("double") * v.cast("double"))
    count, norm = nodes.agg(F.count(F.lit(1)), F.max(F.sqrt(square))).first()
    norm *= 1 + 1e-12
    chosen = F.broadcast(sample_keys(nodes.select("k1", "k2"), SAMPLE_ROWS))  # at most SAMPLE_ROWS pairs of hashes
    sample = nodes.select("k1", "k2", "vector").join(chosen, ["k1", "k2"]).toArrow().sort_by([("k1", "ascending"), ("k2", "ascending")])
    n_cells = min(MAX_CELLS, len(sample), max(1, -(-2 * count // SHARD_ROWS)))
    pivots = spark.sparkContext.broadcast(fit_pivots(lifted(matrix(sample["vector"], width), norm), n_cells))

    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = distances(lifted(matrix(batch.column("vector"), width), norm), pivots.value)[0]
            yield batch.append_column("cell", pa.array(near, pa.int32()))

    nodes = materialize(nodes.mapInArrow(cells, f"k1 long, k2 long, vector array<{kind}>, ids array<long>, cell int"), "ann-cells")
    shards = nodes.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(SHARD_ROWS)).cast("int").alias("shards"))
    wanted = x.filter("asked").select("id", "k1", "k2").distinct()

    def to_cells(batches: Iterator[pa.RecordBatch], others: bool) -> Iterator[pa.RecordBatch]:
        """Each query's own cell, or the others that it has to search."""
        for batch in batches:
            q = matrix(batch.column("vector"), width)
            q = np.concatenate([q, np.zeros((len(q), 1))], axis=1)
            if not others:
                yield batch.append_column("cell", pa.array(distances(q, pivots.value)[0], pa.int32())).append_column("least", pa.array(np.full(len(q), -np.inf)))
                continue
            least = batch.column("least").to_numpy(zero_copy_only=False)
            tau = np.sqrt(np.maximum((q * q).sum(axis=1) + norm * norm - 2 * np.maximum(least, -norm * norm), 0))
            tau[~np.isfinite(least)] = np.inf
            own, _, at, cell = distances(q, pivots.value, within=2 * tau / factor + 2 * SLACK * norm)
            at, cell = at[own[at] != cell], cell[own[at] != cell]
            yield batch.take(pa.array(at)).append_column("cell", pa.array(cell, pa.int32()))

    def search(asked: DataFrame) -> DataFrame:
        blocks = asked.groupBy("cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(QUERY_ROWS)).cast("int").alias("blocks"))
        sizes = F.broadcast(shards.join(blocks, "cell"))  # at most MAX_CELLS rows
        left = nodes.join(sizes, "cell").withColumn("shard", F.pmod("k1", F.col("shards")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        right = asked.join(sizes, "cell").withColumn("block", F.pmod("k1", F.col("blocks")).cast("int")).withColumn("shard", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)))
        group = ["cell", "shard", "block"]
        left, right = left.select(*group, "k1", "k2", "vector", "ids"), right.select(*group, "k1", "k2", "vector", "least")
        return left.groupBy(*group).cogroup(right.groupBy(*group)).applyInArrow(lambda a, b: search_shard(a, b, width, norm, k + 1, factor), "k1 long, k2 long, vec_id long, score double")

    def best(found: DataFrame) -> DataFrame:
        order = Window.partitionBy("k1", "k2").orderBy(F.desc("score"), "vec_id")
        return found.withColumn("nth", F.row_number().over(order)).filter(F.col("nth") <= k + 1)

    queries = wanted.select("k1", "k2").distinct().join(nodes.select("k1", "k2", "vector"), ["k1", "k2"])
    fields = f"k1 long, k2 long, vector array<{kind}>"
    asked = materialize(queries.mapInArrow(lambda it: to_cells(it, False), f"{fields}, cell int, least double"), "ann-queries")
    first = materialize(best(search(asked)).drop("nth"), "ann-own")
    # The k + 1 best so far bound what can still rank; a query that found fewer has no bound yet.
    reach = first.groupBy("k1", "k2").agg(F.when(F.count(F.lit(1)) > k, F.min("score")).alias("least"))
    reach = asked.select("k1", "k2", "vector").join(reach, ["k1", "k2"], "left").withColumn("least", F.coalesce("least", F.lit(float("-inf"))))
    asked = materialize(reach.mapInArrow(lambda it: to_cells(it, True), f"{fields}, least double, cell int"), "ann-asked")
    lists = best(first.unionByName(search(asked))).groupBy("k1", "k2").agg(F.array_sort(F.collect_list(F.struct("nth", "vec_id", "score"))).alias("found"))
    out = wanted.join(lists, ["k1", "k2"]).select(F.col("id").alias("query_id"), F.posexplode(F.slice(F.filter("found", lambda r: r.vec_id != F.col("id")), 1, k)))
    return out.select("query_id", (F.col("pos") + 1).cast("int").alias("rank"), F.col("col.vec_id").alias("vec_id"), F.col("col.score").alias("score"))


def op9_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows by inner product of every row whose vec_id is divisible by 20."""
    return nearest(table(spark, sf_dir, "embeddings"), "vec_id % 20 = 0", k=20)
