"""Exact top-k search by integer inner product over an impact-ordered index, score at a time.

A vector's components become whole numbers. The rows are dealt by hash to blocks of about BLOCK vectors, and a
block posts every vector under each component, ordered by the component's value. To a query with weight w a
posting adds w times its value, less the least that any posting of the list adds: its impact, never negative. So
each list holds its postings by falling impact, from its one end or the other as w's sign asks.

Impacts are quantised to BANDS levels. A query takes the levels of all lists together, the highest first: the
segment of each list at this level is added to the sums of its vectors. What a vector has not met yet lies
below the level, so sum + level * (lists not met) bounds its score from above, and the sum bounds it from below. The
k-th best lower bound proves all vectors out whose upper bound is less. After a level that leaves few enough, or
the last one, the vectors that are not proven out are scored exactly; no other can be in the result.

Queries are dealt to every block and pass it one after the other, so a block is built once, holds BLOCK vectors, and no
vector is copied. The blocks' best are merged by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import durable

SCALE, EVERY, K = 256, 50, 5
BLOCK, BANDS, FEW = 16_384, 12, 1_024
# Sums of absolute components stay below this, so that every inner product is a long.
MOST = 1 << 31


def whole_numbers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of every component; null where one is null or not finite, or their absolute sum is MOST or more."""
    x = vector.cast("array<double>")
    usable = F.forall(x, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float(MOST)))
    numbers = F.transform(x, lambda v: F.floor(v * float(scale)))
    total = F.aggregate(numbers, F.lit(0.0), lambda a, v: a + F.abs(v).cast("double"))
    return F.when(usable, F.when(total < float(MOST), numbers))


class Block:
    """The index of one block: ids, vectors (rows of whole numbers), and per component the rows by value."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.order = np.ascontiguousarray(np.argsort(vectors, axis=0, kind="stable").T)
        self.values = np.take_along_axis(vectors.T, self.order, axis=1).astype(np.float64)

    def best(self, query: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k rows of largest score, ties to the smaller id: largest first."""
        rows = self.possible(query, k)
        scores = self.vectors[rows] @ query
        top = np.lexsort((self.ids[rows], -scores))[:k]
        return self.ids[rows[top]], scores[top]

    def possible(self, query: np.ndarray, k: int) -> np.ndarray:
        """Rows that are not proven out of the k best."""
        n, lists = len(self.ids), np.flatnonzero(query)
        if n <= k or not len(lists):
            return np.arange(n)
        weights = np.abs(query[lists]).astype(np.float64)
        rising = query[lists] > 0
        low, high = (self.values[lists, end].astype(np.float64) for end in (0, -1))
        highest = float((weights * (high - low)).max())
        slack = 1e-9 * highest * len(lists)  # more than all rounding of doubles
        floors = highest * np.arange(BANDS - 1, -1, -1) / BANDS
        # Where each list's segments end: rising ones are read from their last posting back.
        ends = np.array([np.searchsorted(self.values[i], a + floors / w, "left") if up else np.searchsorted(self.values[i], b - floors / w, "right")
                         for i, w, up, a, b in zip(lists, weights, rising, low, high)])
        ends[:, -1] = np.where(rising, 0, n)
        done = np.where(rising, n, 0)
        sums, met = np.zeros(n), np.zeros(n, np.int32)
        for band, floor in enumerate(floors.tolist()):
            for i, w, up, a, b, x, y in zip(lists, weights, rising, low, high, done.tolist(), ends[:, band].tolist()):
                if x != y:  # a list holds a row once, so its segment's sums are added in place
                    segment = slice(y, x) if up else slice(x, y)
                    rows = self.order[i, segment]
                    sums[rows] += w * (self.values[i, segment] - a) if up else w * (b - self.values[i, segment])
                    if floor:
                        met[rows] += 1
            done = ends[:, band]
            least = np.partition(sums, n - k)[n - k] - slack
            # What a row has not met lies below the level; at the last level nothing is left.
            left = sums + ((len(lists) - met) * floor if floor else 0.0) + slack >= least
            if np.count_nonzero(left) <= max(FEW, 2 * k):
                break
        return np.flatnonzero(left)


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, vector, ids): every different vector once, with its smallest k + 1 ids; node is the smallest.

    Map tasks cut their groups to k + 1 ids before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    near = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return near.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("node"), "vector", "ids")


def search(nodes: DataFrame, queries: DataFrame, k: int, block: int) -> DataFrame:
    """(query, node, score): of every block, its k best nodes for every query, of queries and nodes of one length."""
    blocks = max(1, -(-nodes.count() // block))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index, at, gathered = None, None, []
        for batch in batches:  # sorted by (length, block, asks): a block's vectors, then the queries
            size, number, asks = (np.asarray(batch.column(i)) for i in range(3))
            node, vectors = np.asarray(batch.column(3)), batch.column(4)
            edges = np.flatnonzero(np.r_[True, (size[1:] != size[:-1]) | (number[1:] != number[:-1]) | (asks[1:] != asks[:-1]), True]) \
                if len(size) else []
            for a, b in zip(edges, edges[1:]):
                here = int(size[a]), int(number[a])
                if here != at:
                    index, at, gathered = None, here, []
                numbers = np.asarray(vectors.slice(a, b - a).flatten()).reshape(b - a, here[0])
                if not asks[a]:
                    gathered.append((node[a:b], numbers))
                    continue
                if index is None and gathered:
                    index, gathered = Block(*(np.concatenate(x) for x in zip(*gathered))), []
                if index is None:
                    continue
                found = [(query, *index.best(vector, k)) for query, vector in zip(node[a:b], numbers)]
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.repeat([f[0] for f in found], [len(f[1]) for f in found])),
                    pa.array(np.concatenate([f[1] for f in found])), pa.array(np.concatenate([f[2] for f in found]))],
                    ["query", "node", "score"])

    number = F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int")
    posted = nodes.select(F.size("vector").alias("size"), number.alias("block"), F.lit(0).alias("asks"), "node", "vector")
    asking = queries.select(F.size("vector").alias("size"), F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"),
                            F.lit(1).alias("asks"), "node", "vector")
    dealt = posted.unionByName(asking).repartition("size", "block").sortWithinPartitions("size", "block", "asks")
    return dealt.mapInArrow(work, "query bigint, node bigint, score bigint")


def top_k(vectors: DataFrame, every: int = EVERY, k: int = K, block: int = BLOCK, scale: int = SCALE) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, its k other rows of highest score.

    The score is the inner product of floor(scale * x) over all components x, exactly; ties go to the smaller vec_id, and
    with fewer than k other rows all are returned. Vectors that are null, empty or hold null or
    non-finite components take no part, nor do those whose numbers add up, without signs, to MOST or
    more (their scores might leave a long), and rows without vec_id. Only vectors of the query's own length are
    compared. Repeated rows count once. Other columns are ignored; an empty table gives no rows.
    """
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), whole_numbers(vectors["embedding"], scale).alias("vector"))
    rows = durable(rows.filter(F.col("vec_id").isNotNull() & (F.size("vector") > 0)).distinct(), "numbers")
    nodes = durable(distinct_vectors(rows, k), "nodes")
    asking = rows.filter(F.col("vec_id") % every == 0).join(nodes.select("vector", "node"), "vector").select(F.col("vec_id").alias("query_id"), "node")
    asking = durable(asking, "asking")
    queries = nodes.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vector")
    found = search(nodes.select("node", "vector"), queries, k + 1, block)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    spread = best.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id")).distinct()
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = spread.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    lists = durable(ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list")), "lists")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = asking.join(lists, asking["node"] == lists["query"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).cast("int").alias("rank"), "x.vec_id", "x.score")
