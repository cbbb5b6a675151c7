"""Near-duplicates by the Jaccard similarity of their five-word shingles.

Candidates come from two methods, and every candidate is decided by the exact similarity of its shingle sets.

* SimHash fingerprints of the shingle sets, searched within two bits by BK-trees (`simhash.links`): slightly changed copies.
* MinHash bands, for what fingerprints miss: of 100 least hashes per text, twenty bands of five name the text's
  buckets, so a pair of similarity 0.8 shares a bucket with a chance of 0.9996 (at 0.9 all but one in fifty million).

Within a bucket all pairs count that chains of links have not joined yet. First each member meets the bucket's first one.
Then texts leave that can have no further link: a link of two texts takes four ninths of all their shingles in common, and
each has at most as many as stand in other open texts too. The others meet the bucket's central text, the one with most such
shingles: of copies changed at random places most are further apart than 0.8, but each is half as far from what they are copies of.
Of those still open, the ones outside the bucket's largest group meet all whose bitmaps allow a link: a bit that only one of two
texts sets is a shingle that the other lacks. So a bucket of copies costs few comparisons of sets per member, also with copies
changed beyond 0.8 among them, and no link is left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from riskframe.llm.common import keep_rows
from riskframe.llm.components import components
from riskframe.llm.simhash import LOWER, SEED, links, membership
from riskframe.session import durable, step

SHINGLE, SIMILARITY = 5, (4, 5)
BANDS, ROWS = 20, 5
FIRST, GROWTH = 16, 8
CELLS = 16  # longs of a text's bitmap
HASHES_AT_ONCE, HASHES_HELD = 1 << 12, 1 << 20

_random = np.random.default_rng(SEED)
TIMES = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64) * np.uint64(2) + np.uint64(1)
PLUS = _random.integers(0, 1 << 63, (BANDS * ROWS, 1), np.uint64)


def normal(text: str | None) -> bytes:
    """The text's words in lower case (ASCII), set apart by single spaces."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").translate(LOWER).split())


def shingles(body: bytes) -> np.ndarray:
    """The hashes of the different shingles of a normal text; of all its words where it has fewer than five."""
    if not body:
        return np.zeros(0, np.uint64)
    lengths = np.fromiter(map(len, body.split(b" ")), np.int64)
    ends = np.cumsum(lengths + 1) - 1
    k = min(SHINGLE, len(lengths))
    spans = zip((ends - lengths)[: len(lengths) - k + 1].tolist(), ends[k - 1:].tolist())
    return np.unique(np.fromiter((xxh64_intdigest(body[s:e], SEED) for s, e in spans), np.uint64))


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash of different shingles: a bit is 1 if over half of the hashes have it; 0 without any."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        some = hashes[at: at + HASHES_AT_ONCE].astype("<u8").view(np.uint8)
        ones += np.unpackbits(some, bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def buckets(hashes: np.ndarray) -> list[int]:
    """A signed key per band."""
    if not len(hashes):
        return []
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for at in range(0, len(hashes), HASHES_AT_ONCE):
        least = np.minimum(least, (TIMES * hashes[at: at + HASHES_AT_ONCE] + PLUS).min(axis=1))
    keys = [xxh64_intdigest(band.tobytes(), n) for n, band in enumerate(least.reshape(BANDS, ROWS))]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def cells(hashes: np.ndarray) -> list[int]:
    """A bitmap in signed longs: each shingle sets the bit that its hash names."""
    bits = np.zeros(64 * CELLS, np.uint8)
    bits[(hashes % np.uint64(64 * CELLS)).astype(np.int64)] = 1
    return np.packbits(bits, bitorder="little").view("<i8").tolist()


def _portions(batch: pa.RecordBatch, column: int) -> Iterator[tuple[pa.RecordBatch, list[bytes], list[np.ndarray]]]:
    """Rows of a batch with their normal texts and shingles, in portions of bounded size."""
    at = 0
    while at < batch.num_rows:
        first, size, bodies, hashes = at, 0, [], []
        while at < batch.num_rows and size < HASHES_HELD:
            bodies.append(normal(batch.column(column)[at].as_py()))
            hashes.append(shingles(bodies[-1]))
            size += len(hashes[-1])
            at += 1
        yield batch.slice(first, at - first), bodies, hashes


def signatures(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, print, n, bits, buckets) for every row: a hash of the normal text, the number of its shingles, their SimHash, its buckets."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, bodies, hashes in _portions(batch, 2):
                prints = np.array([xxh64_intdigest(body, SEED) for body in bodies], np.uint64).view(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(prints), pa.array([len(h) for h in hashes], pa.int64()),
                     pa.array(np.array([fingerprint(h) for h in hashes], np.uint64).view(np.int64)),
                     pa.array([buckets(h) for h in hashes], pa.list_(pa.int64()))], ["doc_id", "digest", "print", "n", "bits", "buckets"])

    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.xxhash64(docs["text"]).alias("digest"), docs["text"].alias("text"))
    return rows.mapInArrow(scan, "doc_id bigint, digest bigint, print bigint, n bigint, bits bigint, buckets array<bigint>")


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(print, shingles, cells) of texts (print, text)."""
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, _, hashes in _portions(batch, 1):
                edges = pa.array(np.cumsum([0, *map(len, hashes)]), pa.int32())
                lists = pa.ListArray.from_arrays(edges, pa.array(np.concatenate(hashes).view(np.int64)))
                bitmaps = pa.array([cells(h) for h in hashes], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, bitmaps], ["print", "shingles", "cells"])

    return texts.select("print", "text").mapInArrow(scan, "print bigint, shingles array<bigint>, cells array<bigint>")


def sets_of(prints: DataFrame, nodes: DataFrame, docs: DataFrame) -> DataFrame:
    """(print, shingles, cells) of the texts that `prints` (print) names, stored."""
    wanted = prints.join(nodes.select("print", "digest"), "print")
    texts = docs.select(F.xxhash64(docs["text"]).alias("digest"), docs["text"].alias("text")).join(wanted, "digest")
    return durable(shingle_sets(texts.dropDuplicates(["print"])), "candidates")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Those of `pairs` (a, b) whose texts are similar; their shingle sets are compared in the JVM, pair by pair."""
    met = pairs.join(sets.select(F.col("print").alias("b"), F.col("shingles").alias("of_b")), "b") \
        .join(sets.select(F.col("print").alias("a"), F.col("shingles").alias("of_a")), "a")
    both = F.size(F.array_intersect("of_a", "of_b"))
    either = F.size("of_a") + F.size("of_b") - both
    return met.filter(SIMILARITY[1] * both >= SIMILARITY[0] * either).select("a", "b")


def alike_in_size(n: str, other: str) -> Column:
    return SIMILARITY[1] * F.least(n, other) >= SIMILARITY[0] * F.greatest(n, other)


def near_prints(nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) of `nodes` (print, n, bits) by their fingerprints: texts of one fingerprint meet its first text, and
    first texts meet where BK-trees link their fingerprints."""
    first = durable(nodes.groupBy("bits").agg(F.min(F.struct("print", "n")).alias("first")), "fingerprints")
    same = nodes.join(first, "bits").select("print", "n", F.col("first.print").alias("other"), F.col("first.n").alias("other_n"))
    ends = [first.select(F.col("bits").alias(c), F.col("first.print").alias(p), F.col("first.n").alias(n))
            for c, p, n in (("a", "print", "n"), ("b", "other", "other_n"))]
    linked = links(first.select(F.col("bits").alias("print"))).distinct().join(ends[0], "a").join(ends[1], "b")
    pairs = same.unionByName(linked.select(*same.columns)).filter((F.col("print") != F.col("other")) & alike_in_size("n", "other_n"))
    return pairs.select(F.least("print", "other").alias("a"), F.greatest("print", "other").alias("b"))


def open_members(now: DataFrame) -> DataFrame:
    """Rows of `now` (bucket, print, n, root) in buckets of several roots, with the bucket's `largest` root and how many are `outside` it."""
    sizes = now.groupBy("bucket", "root").agg(F.count("*").alias("size"))
    largest = sizes.groupBy("bucket").agg(F.max_by("root", F.struct("size", "root")).alias("largest"), F.sum("size").alias("members"),
                                          F.max("size").alias("size")).filter("members > size")
    return now.join(largest, "bucket").withColumn("outside", F.col("members") - F.col("size"))


def enough(shared: Column, n: Column | str, other: Column | str) -> Column:
    """Whether texts of `n` and `other` shingles that have `shared` in common, or fewer, can be similar."""
    return sum(SIMILARITY) * shared >= SIMILARITY[0] * (F.col(n) + F.col(other))


def lacking(cells: str, other: str) -> Column:
    """How many shingles of the text with bitmap `cells` the other one lacks, at least."""
    return sum(F.bit_count(F.get(cells, F.lit(i)).bitwiseAND(F.bitwise_not(F.get(other, F.lit(i))))) for i in range(CELLS))


def hopeful(members: DataFrame, sets: DataFrame) -> DataFrame:
    """Rows of `members` (bucket, print, n) that may be similar to another of their bucket, with the number of their shingles
    that are not theirs alone as `shared` and their `cells`."""
    held = sets.join(members.select("print").distinct(), "print", "left_semi").select("print", F.explode("shingles").alias("shingle"))
    alone = held.groupBy("shingle").agg(F.count("*").alias("texts"), F.min("print").alias("print")).filter("texts = 1") \
        .groupBy("print").agg(F.count("*").alias("alone"))
    least = members.groupBy("bucket").agg(F.min("n").alias("least"))
    counted = members.join(alone, "print", "left").withColumn("shared", F.col("n") - F.coalesce("alone", F.lit(0)))
    return counted.join(least, "bucket").filter((SIMILARITY[1] * F.col("shared") >= SIMILARITY[0] * F.col("n")) & enough(F.col("shared"), "n", "least")) \
        .join(sets.select("print", "cells"), "print").select(*members.columns, "shared", "cells")


def groups(nodes: DataFrame, docs: DataFrame, first: DataFrame | None = None) -> DataFrame:
    """(node, root) for each of `nodes` (print, n, buckets, digest) that is similar to another; `first` (a, b) are pairs to compare besides."""
    posted = nodes.select("print", "n", F.explode("buckets").alias("bucket"))
    shared = posted.groupBy("bucket").agg(F.count("*").alias("members")).filter("members > 1").select("bucket")
    members = durable(posted.join(shared, "bucket"), "buckets")

    def led(leaders: DataFrame) -> DataFrame:
        return leaders.withColumnsRenamed({"print": "leader", **{c: f"leader_{c}" for c in ("n", "shared", "cells", "root")}})

    def compared(now: DataFrame, leaders: DataFrame) -> DataFrame:
        may = (F.col("root") != F.col("leader_root")) & alike_in_size("n", "leader_n")
        if "cells" in now.columns:
            common = F.least("shared", "leader_shared", F.col("n") - lacking("cells", "leader_cells"), F.col("leader_n") - lacking("leader_cells", "cells"))
            may = may & enough(common, "n", "leader_n")
        met = now.join(leaders, "bucket").filter(may)
        return met.select(F.least("print", "leader").alias("a"), F.greatest("print", "leader").alias("b"))

    def prints_of(pairs: DataFrame) -> DataFrame:
        return pairs.select(F.explode(F.array("a", "b")).alias("print")).distinct()

    def leading(rows: DataFrame, first: Column) -> DataFrame:
        """Each bucket's row of `rows` with the least `first` as its leader."""
        fields = F.struct(*(c for c in rows.columns if c != "bucket"))
        return led(rows.groupBy("bucket").agg(F.min_by(fields, first).alias("first")).select("bucket", "first.*"))

    def rooted(roots: DataFrame) -> DataFrame:
        now = members.join(roots.withColumnRenamed("node", "print"), "print", "left").withColumn("root", F.coalesce("root", "print"))
        return durable(now, "rooted")

    # Every member meets its bucket's first one.
    alone = members.withColumn("root", F.col("print"))
    pairs = compared(alone, leading(alone, F.col("print")))
    tried = durable((pairs if first is None else pairs.unionByName(first)).distinct(), "pairs")
    sets = sets_of(prints_of(tried), nodes, docs)
    edges = durable(verified(tried, sets), "links")
    roots = durable(components(edges), "roots")
    # A bucket of two is decided now. In the others, texts that no other can be similar to leave.
    left = durable(open_members(rooted(roots)).filter("members > 2").select("bucket", "print", "n"), "open")
    unread = left.select("print").distinct().join(sets.select("print"), "print", "left_anti")
    sets = sets.unionByName(sets_of(unread, nodes, docs))
    members = durable(hopeful(left, sets), "hopeful")
    # Those left meet their bucket's central text.
    now = rooted(roots)
    pairs = durable(compared(now, leading(now, F.struct(-F.col("shared"), "print"))).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
    tried = tried.union(pairs)
    edges = edges.union(durable(verified(pairs, sets), "links"))
    roots = durable(components(edges), "roots")
    limit = FIRST
    while True:
        now = rooted(roots)
        outside = open_members(now).filter("root <> largest")
        leaders = outside.selectExpr("*", "row_number() OVER (PARTITION BY bucket ORDER BY shared DESC, print) AS nth").filter(F.col("nth") <= limit)
        leaders = durable(led(leaders.select(*now.columns, "outside")), "leaders")
        most = leaders.agg(F.max("outside")).first()[0] or 0
        if not most:
            return roots
        pairs = durable(compared(now, leaders).distinct().join(tried, ["a", "b"], "left_anti"), "pairs")
        tried = tried.union(pairs)
        edges = edges.union(durable(verified(pairs, sets), "links"))
        roots = durable(components(edges), "roots")
        if most <= limit:
            return roots
        limit *= GROWTH


def near_duplicates(docs: DataFrame) -> DataFrame:
    """One row per row of `docs` (doc_id, text): component_id, kept, print, digest.

    component_id is the smallest doc_id reachable over links of similarity 0.8 or more. Texts of the same words
    are alike, also those without words, and null texts are empty ones. Null ids and `kept` are as in
    `simhash.near_duplicates`. Repeated rows each give a row, no rows none. Other columns are ignored.
    """
    rows = durable(signatures(docs), "signatures")
    nodes = durable(rows.groupBy("print").agg(F.min("doc_id").alias("least"), F.min("digest").alias("digest"), F.first("n").alias("n"),
                                              F.first("bits").alias("bits"), F.first("buckets").alias("buckets")), "nodes")
    roots = groups(nodes, docs, near_prints(nodes))
    return rows.select("doc_id", "digest", "print").join(membership(nodes.select("print", "least"), roots), "print").select(
        "doc_id", "component_id", (F.col("leads") & F.col("doc_id").eqNullSafe(F.col("component_id"))).alias("kept"), "print", "digest")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """One document of each group of near-duplicates, with all its columns; of repeated rows one, of no rows none."""
    def chosen() -> DataFrame:
        kept = near_duplicates(docs).filter("kept").groupBy("component_id", "doc_id", "print").agg(F.min("digest").alias("digest"))
        return kept.select("doc_id", "digest")

    return keep_rows(docs, step(docs.sparkSession, chosen, "chosen"))
