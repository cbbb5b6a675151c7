"""Approximate nearest neighbours by a permutation index.

A vector is represented by the order of its nearest pivots: near vectors see the pivots in nearly the
same order. The rows are dealt by hash to index blocks of about BLOCK vectors. A block keeps an inverted
file per pivot: the vectors that have it among their first PLACES pivots, and its place there. A query
reads the files of its own pivots in every block and ranks the block's vectors by footrule distance
(the sum of differences of places; a pivot that one of the two lacks counts as standing last). The best
SHARE of the block are compared by inner product on the original vectors; the blocks' best are merged.

Pivots are a bounded sample of PIVOTS rows. Equal vectors are indexed once, with the smallest k + 1 ids
that have them, since no other can be in a result; so copies fill no file and nothing is lost.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskframe.session import durable

PIVOTS, PLACES = 256, 64
BLOCK, CHUNK = 8_192, 2_048
SHARE, LEAST = 1 / 8, 1_000


def usable(vector: Column) -> Column:
    """Not null, of some length, every component there and finite, and not zero."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vector.isNotNull() & (F.size(vector) > 0) & finite & F.exists(vector, lambda x: x != 0)


def same_length(vectors: DataFrame) -> DataFrame:
    """(vec_id, vector) of the usable vectors of the most frequent length, as doubles; each row once."""
    rows = vectors.select(vectors["vec_id"].cast("bigint").alias("vec_id"), vectors["embedding"].cast("array<double>").alias("vector"))
    rows = durable(rows.filter(F.col("vec_id").isNotNull() & usable(F.col("vector"))), "vectors")
    length = rows.groupBy(F.size("vector").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.filter(F.size("vector") == (length["n"] if length else 0)).distinct()


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """(node, vector, ids): every different vector once, with the smallest k + 1 ids; node is the smallest.

    Map tasks cut their groups to k + 1 ids before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy("vector").orderBy("vec_id"))
    near = rows.withColumn("rank", rank).filter(F.col("rank") <= k + 1)
    return near.groupBy("vector").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.element_at("ids", 1).alias("node"), "vector", "ids")


def permutations(vectors: np.ndarray, pivots: np.ndarray, places: int) -> np.ndarray:
    """The first `places` pivots of each vector, nearest (largest inner product) first."""
    return np.argsort(-(vectors @ pivots.T), axis=1, kind="stable")[:, :places]


def inverted_files(order: np.ndarray, pivots: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per pivot: the rows that hold it, and its place in each."""
    rows, places = np.divmod(np.arange(order.size), order.shape[1])
    by_pivot = np.argsort(order.ravel(), kind="stable")
    edges = np.searchsorted(order.ravel()[by_pivot], np.arange(pivots + 1))
    return [(rows[by_pivot[a:b]], places[by_pivot[a:b]]) for a, b in zip(edges, edges[1:])]


def closest(files: list, order: np.ndarray, rows: int, places: int, depth: int) -> np.ndarray:
    """The `depth` rows of least footrule distance from a query's pivots.

    Of two lists of one length the distance is a constant less 2 * (places - the later place) for each
    shared pivot, so that saving is added up over the query's files and the largest sums win.
    """
    saved = np.zeros(rows, np.int32)
    for place, pivot in enumerate(order.tolist()):
        found, there = files[pivot]
        saved[found] += (places - np.maximum(there, place)).astype(np.int32)
    return np.argpartition(-saved, depth - 1)[:depth] if depth < rows else np.arange(rows)


def search_blocks(nodes: DataFrame, queries: DataFrame, k: int, share: float, least: int) -> DataFrame:
    """(query, node, score): of every index block, the best k + 1 nodes for every query node."""
    spark = nodes.sparkSession
    sample = nodes.orderBy(F.xxhash64("node"), "node").limit(PIVOTS).select("vector").collect()
    pivots = np.array([r["vector"] for r in sample])
    places = min(PLACES, len(pivots))
    blocks, chunks = (max(1, -(-df.count() // size)) for df, size in ((nodes, BLOCK), (queries, CHUNK)))

    def dealt(df: DataFrame, own: str, parts: int, other: str, others: int) -> DataFrame:
        number = F.pmod(F.xxhash64("node"), F.lit(parts)).cast("int")
        return df.select("node", "vector", number.alias(own), F.explode(F.sequence(F.lit(0), F.lit(others - 1))).alias(other))

    def search(index: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(index) or not len(asked):
            return pd.DataFrame({"query": [], "node": [], "score": []})
        vectors, ids = np.stack(index["vector"].to_numpy()), index["node"].to_numpy()
        files = inverted_files(permutations(vectors, pivots, places), len(pivots))
        wanted = np.stack(asked["vector"].to_numpy())
        depth = min(len(ids), max(least, int(share * len(ids))))
        out = []
        for query, vector, order in zip(asked["node"].to_numpy(), wanted, permutations(wanted, pivots, places)):
            near = closest(files, order, len(ids), places, depth)
            scores = (vectors[near] * vector).sum(axis=1)
            best = np.lexsort((ids[near], -scores))[: k + 1]
            out.append((np.full(len(best), query), ids[near][best], scores[best]))
        return pd.DataFrame(dict(zip(("query", "node", "score"), map(np.concatenate, zip(*out)))))

    index = dealt(nodes, "block", blocks, "chunk", chunks).groupBy("block", "chunk")
    asked = dealt(queries, "chunk", chunks, "block", blocks).groupBy("block", "chunk")
    if not len(pivots):
        return spark.createDataFrame([], "query bigint, node bigint, score double")
    return index.cogroup(asked).applyInPandas(search, "query bigint, node bigint, score double")


def nearest(vectors: DataFrame, every: int = 20, k: int = 20, share: float = SHARE, least: int = LEAST) -> DataFrame:
    """(query_id, rank, vec_id, score): for each vec_id divisible by `every`, its k nearest other rows found.

    Nearest is the largest inner product in double precision, ties to the smaller vec_id. Vectors that
    are null, empty, zero or hold null or non-finite components, and those of another length than most
    (of equally frequent ones, the shorter), take no part. Repeated rows count once; a row without vec_id
    takes no part. With fewer than k other rows all are returned. Other columns are ignored.
    """
    rows = durable(same_length(vectors), "vectors")
    nodes = durable(distinct_vectors(rows, k), "nodes")
    asking = rows.filter(F.col("vec_id") % every == 0).join(nodes.select("vector", "node"), "vector").select(F.col("vec_id").alias("query_id"), "node")
    asking = durable(asking, "asking")
    queries = durable(nodes.join(asking.select("node").distinct(), "node", "left_semi").select("node", "vector"), "queries")
    found = search_blocks(nodes.select("node", "vector"), queries, k, share, least)
    order = Window.partitionBy("query").orderBy(F.desc("score"), "node")
    best = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    spread = best.join(nodes.select("node", "ids"), "node").select("query", "score", F.explode("ids").alias("vec_id"))
    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id")
    ranked = spread.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k + 1)
    lists = durable(ranked.groupBy("query").agg(F.sort_array(F.collect_list(F.struct("rank", "vec_id", "score"))).alias("list")), "lists")
    others = F.slice(F.filter("list", lambda x: x["vec_id"] != F.col("query_id")), 1, k)
    answers = asking.join(lists, asking["node"] == lists["query"]).select("query_id", F.posexplode(others).alias("at", "x"))
    return answers.select("query_id", (F.col("at") + 1).alias("rank"), "x.vec_id", "x.score")
