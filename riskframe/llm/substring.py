"""Removal of repeated passages by level-wise doubling.

A passage that repeats at some length repeats at half that length, so windows are compared at one
length and only those that repeat are extended to twice that length, until none survives.

* Half length (25 words for passages of 50). Each passage holds 26 windows of this length, and equal
  passages hold the same ones; the one of least hash stands for the passage. So only about one window
  in 13 is compared, and no repeated passage can hide. The neighbouring passages that one window stands for
  are a segment; a half window that has one segment hash wherever it occurs has equal passages everywhere.
* Full length (50). Segments that are equal everywhere are decided as one. Elsewhere, at the edges of
  what was copied, the windows are compared by 128-bit hashes. This level decides what is removed:
  every word under a window that also starts in a document of smaller id.
* Twice, four times, ... These lengths measure how long the passages are. Each is searched like the full length: a
  passage is stood for by one of its windows of half its length, segments that are equal everywhere are decided as
  one, and the windows of the others are compared one by one. Only stretches whose windows of full length
  all have a repeated representative take part, since no others can repeat.

Hashes are built by doubling too: a window's hash joins those of its two halves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_digest

from riskframe.llm.common import find_words, id_key
from riskframe.session import durable

WINDOW = 50
MAX_WORDS_KNOWN = 200_000
MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xFF51AFD7ED558CCD))


class WordHashes(dict):
    """Word -> the eight bytes of its hash, for the words met of late."""

    def __missing__(self, word: str) -> bytes:
        value = xxh64_digest(word.encode("utf-8", "surrogatepass"))
        if len(self) >= MAX_WORDS_KNOWN:
            self.clear()
        if len(word) <= 64:
            self[word] = value
        return value

    def of(self, words: list[str]) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, words)), np.uint64)


def join_hashes(left: np.ndarray, right: np.ndarray, lane: int) -> np.ndarray:
    """Hashes of joined windows; `lane` picks one of two independent families."""
    mixed = left * MIX[lane] + (right ^ (right >> np.uint64(29))) * MIX[2]
    mixed ^= mixed >> np.uint64(32)
    return mixed * MIX[2] + np.uint64(lane)


def window_hashes(words: np.ndarray, length: int, lane: int = 0) -> np.ndarray:
    """Hashes of all windows of `length` words by doubling; windows of odd parts overlap."""
    have, hashes = 1, words
    while have < length:
        step = min(have, length - have)
        hashes = join_hashes(hashes[: max(0, len(hashes) - step)], hashes[step:], lane)
        have += step
    return hashes


def stand_ins(halves: np.ndarray, count: int) -> np.ndarray:
    """For each run of `count` neighbouring windows, the place of the one of least hash (the first of equals)."""
    if len(halves) < count:
        return np.empty(0, np.int64)
    # Sliding minimum by doubling: least of 1, 2, 4, ... neighbours.
    least, place, have = halves, np.arange(len(halves)), 1
    while have < count:
        step = min(have, count - have)
        a, b = least[: len(least) - step], least[step:]
        first = a <= b
        least, place = np.where(first, a, b), np.where(first, place[: len(a)], place[step:])
        have += step
    return place


def _halves(text: str | None, known: WordHashes, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    words = find_words(text or "")
    hashes = known.of(words)
    halves = window_hashes(hashes, window // 2) if len(words) >= window else np.empty(0, np.uint64)
    return hashes, halves, stand_ins(halves, window - window // 2 + 1)


def segments(halves: np.ndarray, places: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, hash of all their words) of each run of windows with one stand-in; places below zero have none.

    The first and the last window of a run overlap, so with their distance they fix all words of the run.
    """
    first = np.flatnonzero(np.diff(places, prepend=-1))
    count = np.diff(first, append=len(places))
    first, count = first[places[first] >= 0], count[places[first] >= 0]
    last, half = first + count - 1, window // 2
    value = count.astype(np.uint64)
    for start in (first, first + half, first + window - half, last, last + half, last + window - half):
        value = join_hashes(value, halves[start], 1)
    return first, count, value


def half_windows(docs: DataFrame, window: int) -> DataFrame:
    """(half, segment, doc_id, digest, at, n): the representative half-length windows of every document.

    Each stands for the `n` windows from `at` on; `segment` is the hash of all their words.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            found = []
            for doc_id, digest, text in zip(*(batch.column(i) for i in range(3))):
                _, halves, places = _halves(text.as_py(), known, window)
                if len(places):
                    at, count, value = segments(halves, places, window)
                    found.append((halves[places[at]].view(np.int64), value.view(np.int64), np.full(len(at), doc_id.as_py(), np.int64),
                                  np.full(len(at), digest.as_py(), np.int32), at.astype(np.int32), count.astype(np.int32)))
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in zip(*found)],
                                                 ["half", "segment", "doc_id", "digest", "at", "n"])

    rows = docs.filter(docs["doc_id"].isNotNull()).select(
        docs["doc_id"].cast("bigint").alias("doc_id"), F.hash(docs["text"]).alias("digest"), docs["text"].alias("text"))
    return rows.mapInArrow(scan, "half bigint, segment bigint, doc_id bigint, digest int, at int, n int")


def repeated_halves(halves: DataFrame) -> DataFrame:
    """Half windows that occur in several documents, gathered per document.

    `edged` are those with different segments somewhere, `even` the others; `spans` (digest, at, n) are
    windows of the even ones of which an earlier document has equals.
    """
    groups = halves.groupBy("half").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                        (F.min("segment") < F.max("segment")).alias("edge"))
    # Read back from a table, both sides of the join are shuffled anew and a common passage can be split.
    groups = durable(groups.filter("first < last").drop("last"), "halves-shared")
    return halves.join(groups, "half").groupBy("doc_id").agg(
        F.collect_set(F.when(F.col("edge"), F.col("half"))).alias("edged"),
        F.collect_set(F.when(~F.col("edge"), F.col("half"))).alias("even"),
        F.collect_list(F.when(~F.col("edge") & (F.col("doc_id") > F.col("first")), F.struct("digest", "at", "n"))).alias("spans"))


def longer(low: np.ndarray, shared: np.ndarray, window: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, hashes of the windows of half the length, stand-ins) for 2, 4, ... times `window`.

    `low` are the hashes of the windows of `window` words. The stand-in of a passage is -2 unless all of its windows are `shared`.
    """
    alone = np.concatenate([[0], np.cumsum(~shared)])
    length, halves = 2 * window, low
    while True:
        span = length - window + 1
        whole = alone[span:] == alone[:-span]
        if not whole.any():
            return
        yield length, halves, np.where(whole, stand_ins(halves, length // 2 + 1), -2)
        halves = join_hashes(halves[: -(length // 2)], halves[length // 2:], 0)
        length *= 2


def different(at: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One of each of a document's equal (high, low)."""
    kept = np.unique(join_hashes(high, low, 1), return_index=True)[1]
    return at[kept], high[kept], low[kept]


def _found(doc_id: int, digest: int, parts: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
    """Rows (doc_id, digest, length, at, high, low) of one document from (length, at, high, low)."""
    rows = sum(len(at) for _, at, _, _ in parts)
    lengths = np.concatenate([np.full(len(at), length, np.int64) for length, at, _, _ in parts])
    at, high, low = (np.concatenate([part[i] for part in parts]) for i in (1, 2, 3))
    return pa.RecordBatch.from_arrays(
        [pa.array(c) for c in (np.full(rows, doc_id, np.int64), np.full(rows, digest, np.int32), lengths, at.astype(np.int32), high.view(np.int64), low.view(np.int64))],
        ["doc_id", "digest", "length", "at", "high", "low"])


FOUND = "doc_id bigint, digest int, length bigint, at int, high bigint, low bigint"


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), F.hash(docs["text"]).alias("digest"), docs["text"].alias("text"))


def full_windows(docs: DataFrame, suspects: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, length, at, high, low): of length `window`, the windows at edges whose representative repeats, with the
    two hashes of their words; of 2, 4, ... times that length, the segments of passages all of whose windows have a repeated
    representative, with the hashes of the stand-in (`high`) and of all words (`low`).
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for doc_id, digest, text, edged, even in zip(*(batch.column(i) for i in range(5))):
                hashes, halves, places = _halves(text.as_py(), known, window)
                if not len(places):
                    continue
                low, high = (window_hashes(hashes, window, lane) for lane in (0, 1))
                edge, plain = (np.isin(halves[places], np.asarray(seen.values).view(np.uint64)) for seen in (edged, even))
                at = np.flatnonzero(edge)
                found = [(window, at, high[at], low[at])]
                for length, parts, stand in longer(low, edge | plain, window):
                    at, _, value = segments(parts, stand, length)
                    found.append((length, *different(at, parts[stand[at]], value)))
                if any(len(part[1]) for part in found):
                    yield _found(doc_id.as_py(), digest.as_py(), found)

    found = _texts(docs).join(suspects, "doc_id").select("doc_id", "digest", "text", "edged", "even")
    return found.mapInArrow(scan, FOUND)


def long_windows(docs: DataFrame, edged: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, length, at, high, low): the windows of 2, 4, ... times `window` words in segments that differ between documents,
    with the hashes of the stand-in and of all words. `edged` has the stand-ins (`halves`) and greatest length (`most`) of each document.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for doc_id, digest, text, wanted, most in zip(*(batch.column(i) for i in range(5))):
                low = window_hashes(known.of(find_words(text.as_py() or "")), window)
                wanted, most, found = np.asarray(wanted.values).view(np.uint64), most.as_py(), []
                for length, parts, stand in longer(low, np.ones(len(low), bool), window):
                    at = np.flatnonzero(np.isin(parts[stand], wanted))
                    found.append((length, *different(at, parts[stand[at]], join_hashes(parts[at], parts[at + length // 2], 0))))
                    if length == most:
                        break
                if any(len(part[1]) for part in found):
                    yield _found(doc_id.as_py(), digest.as_py(), found)

    # One plan at every size: few such documents would be broadcast, many not.
    found = _texts(docs).join(edged.hint("merge"), ["doc_id", "digest"]).select("doc_id", "digest", "text", "halves", "most")
    return found.mapInArrow(scan, FOUND)


def repeated(windows: DataFrame, keys: list[str]) -> DataFrame:
    """Windows with an equal one in another document, with the smallest id that has it as `first`."""
    groups = windows.groupBy(*keys).agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
    groups = durable(groups.filter("first < last").drop("last"), "windows-shared")
    return windows.join(groups, keys)


def repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """(doc_id, digest, spans, longest) of documents that repeat passages of earlier ones.

    `spans` (at, n) are runs of windows that also start in a document of smaller id; `longest` is the
    length of the longest level at which one was found.
    """
    suspects = durable(repeated_halves(durable(half_windows(docs, window), "half-windows")), "suspects")
    windows = durable(full_windows(docs, suspects, window), "full-windows")
    single = repeated(windows.filter(F.col("length") == window), ["high", "low"]).filter("doc_id > first").select(
        "doc_id", "digest", "at", F.lit(1).alias("n"))
    found = suspects.select("doc_id", F.inline("spans")).unionByName(single).groupBy("doc_id", "digest").agg(
        F.collect_list(F.struct("at", "n")).alias("spans"))
    longest = lengths(docs, windows.filter(F.col("length") > window), window).groupBy("doc_id", "digest").agg(F.max("length").alias("longest"))
    return found.join(longest, ["doc_id", "digest"], "left").withColumn("longest", F.coalesce("longest", F.lit(window).cast("bigint")))


def lengths(docs: DataFrame, parts: DataFrame, window: int) -> DataFrame:
    """(doc_id, digest, length): lengths at which a document repeats a passage of an earlier one, if 2, 4, ... times `window`;
    `parts` are the segments of these lengths."""
    groups = parts.groupBy("length", "high").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"),
                                                 (F.min("low") < F.max("low")).alias("edge"))
    groups = durable(groups.filter("first < last").drop("last"), "lengths-shared")
    met = durable(parts.select("doc_id", "digest", "length", "high").join(groups, ["length", "high"]), "lengths-met")
    even = met.filter("NOT edge AND doc_id > first").groupBy("doc_id", "digest").agg(F.max("length").alias("length"))
    # Edges matter where a later document could get a greater length than equal segments give it.
    open_ = met.filter("edge AND doc_id > first").join(even.withColumnRenamed("length", "known"), ["doc_id", "digest"], "left").filter(
        "known IS NULL OR length > known").select("length", "high").distinct()
    edged = met.filter("edge").drop("edge", "first").distinct().join(open_, ["length", "high"], "left_semi").groupBy("doc_id", "digest").agg(
        F.collect_set("high").alias("halves"), F.max("length").alias("most"))
    single = durable(long_windows(docs, durable(edged, "edged"), window), "long-windows")
    reached = repeated(single, ["length", "high", "low"]).filter("doc_id > first").select("doc_id", "digest", "length")
    return even.unionByName(reached)


def without_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per row of `docs` (doc_id, text): n_words, n_removed, longest, kept_text, kept_sha256.

    Words are runs without ASCII white space; the kept ones are joined by one space. Windows are
    judged on the input. Null text has no words. Rows without doc_id are neither removed from nor a
    reason to remove; rows of the same doc_id are no reason for each other. Other columns are ignored.
    """
    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for doc_id, text, spans, longest in zip(*(batch.column(i) for i in range(4))):
                words = find_words(text.as_py() or "")
                kept = words
                if spans.is_valid:
                    edges = np.zeros(len(words) + 1, np.int64)
                    starts, counts = map(np.asarray, spans.values.flatten())
                    np.add.at(edges, starts, 1)
                    np.add.at(edges, starts + counts - 1 + window, -1)
                    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
                body = " ".join(kept)
                sha = hashlib.sha256(body.encode("utf-8", "surrogatepass")).hexdigest()
                for column, value in zip(out, (doc_id.as_py(), len(words), len(words) - len(kept), longest.as_py() or 0, body, sha)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays([
                pa.array(c, t) for c, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()))],
                ["doc_id", "n_words", "n_removed", "longest", "kept_text", "kept_sha256"])

    found = repeats(docs, window).select(id_key("doc_id").alias("key"), "digest", "spans", "longest")
    rows = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"), id_key(docs["doc_id"]).alias("key"),
                       F.hash(docs["text"]).alias("digest"))
    return rows.join(found, ["key", "digest"], "left").select("doc_id", "text", "spans", "longest").mapInArrow(
        scan, "doc_id bigint, n_words bigint, n_removed bigint, longest bigint, kept_text string, kept_sha256 string")
