"""Near-duplicates by SimHash fingerprints, linked through BK-trees.

Two fingerprints that differ in at most two bits agree in six of eight bytes, so each distinct
fingerprint goes to the 28 shards named by six of its bytes. A shard holds at most 65,536 different
fingerprints whatever the corpus. A shard's BK-tree (children keyed by their Hamming distance to the
parent) is built where its rows meet and answers their radius searches, following only edges within
the radius. Searches link what they find by union, and a shard returns a spanning forest, never all
pairs. Connected components join the forests of all shards.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskframe.llm.common import keep_rows
from riskframe.llm.components import components
from riskframe.session import durable

SHINGLE, SEED, RADIUS = 3, 42, 2
BYTES = 8
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
HASHES_AT_ONCE = 1 << 16


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """SimHash of a text as an unsigned 64-bit number; 0 without words."""
    raw = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
    words = raw.split()  # of bytes: at ASCII white space only
    if not words:
        return 0
    body, lengths = b" ".join(words), np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    starts = ends - lengths
    k = min(shingle, len(words))
    spans = list(zip(starts[: len(words) - k + 1].tolist(), ends[k - 1:].tolist()))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(spans), HASHES_AT_ONCE):
        hashes = np.array([xxh64_intdigest(body[s:e], SEED) for s, e in spans[at: at + HASHES_AT_ONCE]], "<u8")
        bits = np.unpackbits(hashes.view(np.uint8), bitorder="little").reshape(-1, 64)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(spans), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, digest, print) for every row; `print` holds the bits in a signed long."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = np.array([fingerprint(t.as_py(), shingle) for t in batch.column(2)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints)], ["doc_id", "digest", "print"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"]).alias("digest"), docs["text"].alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, digest bigint, print bigint")


class BKTree:
    """Node: [value, place, children by distance]."""

    def __init__(self):
        self.root = None

    def add(self, value: int, place: int) -> None:
        if self.root is None:
            self.root = [value, place, {}]
            return
        node = self.root
        while True:
            distance = (value ^ node[0]).bit_count()
            child = node[2].get(distance)
            if child is None:
                node[2][distance] = [value, place, {}]
                return
            node = child

    def within(self, value: int, radius: int) -> list[int]:
        found, open_nodes = [], [self.root] if self.root else []
        while open_nodes:
            node = open_nodes.pop()
            distance = (value ^ node[0]).bit_count()
            if distance <= radius:
                found.append(node[1])
            for edge, child in node[2].items():
                if distance - radius <= edge <= distance + radius:
                    open_nodes.append(child)
        return found


def shard_forest(values: list[int], radius: int) -> list[tuple[int, int]]:
    """Places (i, j) of linked values that span the groups reachable within this shard."""
    tree, parent, forest = BKTree(), list(range(len(values))), []

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for place, value in enumerate(values):
        for other in tree.within(value, radius):
            a, b = root(place), root(other)
            if a != b:
                parent[a] = b
                forest.append((place, other))
        tree.add(value, place)
    return forest


def shards(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(shard, key, print): each distinct print under every choice of 8 - radius of its bytes."""
    keys = []
    for n, kept in enumerate(combinations(range(BYTES), BYTES - radius)):
        mask = sum(0xFF << (8 * b) for b in kept)
        signed = mask - (1 << 64) if mask >> 63 else mask
        keys.append(F.struct(F.lit(n).alias("shard"), F.col("print").bitwiseAND(F.lit(signed)).alias("key")))
    return prints.select("print", F.explode(F.array(*keys)).alias("s")).select("s.shard", "s.key", "print")


def links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """Edges (a, b) between distinct prints; two prints are connected iff a chain of links joins them."""
    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        open_shard, open_key, values = None, None, []

        def close() -> list[tuple[int, int]]:
            if len(values) < 2:
                return []
            unsigned = [v & 0xFFFFFFFFFFFFFFFF for v in values]
            return [(values[i], values[j]) for i, j in shard_forest(unsigned, radius)]

        for batch in batches:
            edges: list[tuple[int, int]] = []
            shard, key, print_ = batch["shard"].to_numpy(), batch["key"].to_numpy(), batch["print"].to_numpy()
            change = np.flatnonzero((shard[1:] != shard[:-1]) | (key[1:] != key[:-1])) + 1
            cuts = [0, *change.tolist(), len(batch)]
            for start, end in zip(cuts, cuts[1:]):
                if start == end:
                    continue
                if (shard[start], key[start]) != (open_shard, open_key):
                    edges += close()
                    open_shard, open_key, values = shard[start], key[start], []
                values.extend(print_[start:end].tolist())
            yield pd.DataFrame(edges, columns=["a", "b"]).astype("int64")
        yield pd.DataFrame(close(), columns=["a", "b"]).astype("int64")

    dealt = shards(prints, radius).repartition("shard", "key").sortWithinPartitions("shard", "key", "print")
    return dealt.mapInPandas(search, "a bigint, b bigint")


def membership(prints: DataFrame, roots: DataFrame) -> DataFrame:
    """(print, component_id, leads) for every row of `prints` (print, least) by `roots` (node, root); alone where it has none."""
    roots = roots.select(F.col("node").alias("print"), "root")
    rooted = prints.join(roots, "print", "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    rooted = durable(rooted, "rooted")
    classes = durable(rooted.groupBy("root").agg(
        F.min("least").alias("component_id"), F.min(F.struct(F.coalesce("least", F.lit(2**63 - 1)), "print"))["print"].alias("first")), "classes")
    return durable(rooted.join(classes, "root").select(
        "print", "component_id", (F.col("first") == F.col("print")).alias("leads")), "membership")


def near_duplicates(docs: DataFrame, shingle: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """One row per row of `docs` (doc_id, text): fingerprint (hex), component_id, kept, digest.

    component_id is the smallest doc_id reachable over links of at most `radius` bits. Null text has
    no words, and texts without words share fingerprint 0. A null doc_id counts for no component's
    smallest id, unless it has no other. `kept` marks one fingerprint's rows of the smallest id per
    component. Other columns are ignored; an empty table gives no rows.
    """
    rows = durable(fingerprints(docs, shingle), "fingerprints")
    prints = durable(rows.groupBy("print").agg(F.min("doc_id").alias("least")), "prints")
    edges = durable(links(prints, radius).distinct(), "links")
    return rows.join(membership(prints, components(edges)), "print").select(
        "doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id",
        (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), "digest")


def drop_near_duplicates(docs: DataFrame, **options) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns."""
    chosen = near_duplicates(docs, **options).filter("kept").groupBy("component_id", "doc_id", "fingerprint") \
        .agg(F.min("digest").alias("digest"))
    return keep_rows(docs, chosen.select("doc_id", "digest"))
