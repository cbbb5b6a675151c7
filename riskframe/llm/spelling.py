"""Spelling variants grouped under frequent words, by PartEnum signatures of letter multisets.

A word's letters are a multiset, that is a binary vector with one place per letter and occurrence. One
replaced letter moves the vector by a Hamming distance of two, one inserted or deleted letter by one. The places
are partitioned by letter, and signatures enumerate the partitions that may stay equal: two words of equal
length agree on all but two of PARTS partitions, words whose lengths differ by one on all but one of SHORT_PARTS.
So every near pair shares a signature, and pairs that share one are verified letter by letter.

One edit also leaves one half of the shorter word as it was. So rows meet per (length, side, half): a word is
posted under its own length and under one less, with the half such a shorter word would have, four rows in all.
Signatures are enumerated and joined where a half's words meet. A half with more than HOT rows is not
gathered: its rows are dealt out again by half and signature.

A near pair is counted once: the second half counts only pairs that the first does not show, and a pair that
several signatures show counts under the first of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskframe.session import durable

SHORTEST, LEAST, RARE, TIMES = 7, 2, 31, 10
PARTS, SHORT_PARTS = 4, 2
HOT = 20_000
ROWS_AT_ONCE, PAIRS_AT_ONCE, WIDE = 50_000, 500_000, 64

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Every signature: whether it is for equal lengths, and the partitions it leaves out.
SIGNATURES = [(True, left) for left in combinations(range(PARTS), 2)] + [(False, (left,)) for left in range(SHORT_PARTS)]
EQUAL = sum(equal for equal, _ in SIGNATURES)
FIRST_WITHOUT = np.array([next(n for n, (_, left) in enumerate(SIGNATURES[:EQUAL]) if part in left) for part in range(PARTS)])

_random = np.random.default_rng(12)
LETTERS = _random.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
MIX = np.uint64(0x9E3779B97F4A7C15)


def lower_ascii(word: Column) -> Column:
    """Only A-Z in lower case; a word of as many bytes as code points is ASCII throughout."""
    return F.when(F.length(word) == F.octet_length(word), F.lower(word)).otherwise(F.translate(word, UPPER, LOWER))


def words(docs: DataFrame, shortest: int = SHORTEST, least: int = LEAST) -> DataFrame:
    """(word, n): the words of all whole texts, after the deletions that the row's id and the run decide."""
    runs = docs.select(docs["doc_id"].cast("bigint").cast("string").alias("id"),
                       F.explode(F.regexp_extract_all(docs["text"], F.lit(f"[A-Za-zÀ-ÿ]{{{shortest},}}"), F.lit(0))).alias("run"))
    lowered = runs.select("id", lower_ascii(F.col("run")).alias("run"))
    hashed = lowered.select("run", F.crc32(F.concat("id", F.lit(":"), "run").cast("binary")).alias("h"))
    at = (F.col("h") % F.length("run")).cast("int")
    cut = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, F.length("run")))
    word = F.when(F.col("h") % RARE == 0, cut).otherwise(F.col("run"))
    counted = hashed.select(word.alias("word")).filter(F.length("word") >= shortest).groupBy("word").agg(F.count("*").alias("n"))
    return counted.filter(F.col("n") >= least)


def posted(counted: DataFrame) -> DataFrame:
    """(half, longer, side, word, n): each word's four meeting places; `longer` marks the place of a word one shorter."""
    def place(longer: int, side: int) -> Column:
        size = F.length("word") - longer
        start = F.floor(size / 2).cast("int")
        body = F.substring(F.col("word"), F.lit(1), start) if side == 0 else F.substring(F.col("word"), start + 1 + longer, F.length("word"))
        return F.struct(F.xxhash64(size, F.lit(side), body).alias("half"), F.lit(longer).alias("longer"), F.lit(side).alias("side"))

    places = F.array(*(place(longer, side) for longer in (0, 1) for side in (0, 1)))
    return counted.select(F.explode(places).alias("p"), "word", "n").select("p.half", "p.longer", "p.side", "word", "n")


class Letters:
    """Words of one batch as bytes (Latin-1 has all their letters): letter sums per partition, and padded rows."""

    def __init__(self, batch: list[str]):
        body = [w.encode("latin-1") for w in batch]
        self.words, self.size = batch, np.fromiter(map(len, body), np.int64, len(body))
        flat = np.frombuffer(b"".join(body), np.uint8)
        starts = np.cumsum(self.size) - self.size
        self.sums = {n: [np.add.reduceat(np.where(flat % n == part, LETTERS[flat], np.uint64(0)), starts) for part in range(n)]
                     for n in {PARTS, SHORT_PARTS}}
        width = min(WIDE, int(self.size.max()))
        self.left, self.right = (np.zeros((len(body), width), np.uint8) for _ in range(2))
        own = np.repeat(np.arange(len(body)), self.size)
        column = np.arange(len(flat)) - starts[own]
        fits = column < width
        self.left[own[fits], column[fits]] = flat[fits]
        column = self.size[own] - 1 - column  # from the end
        fits = column < width
        self.right[own[fits], column[fits]] = flat[fits]

    def signature(self, n: int) -> np.ndarray:
        equal, left = SIGNATURES[n]
        sums = self.sums[PARTS if equal else SHORT_PARTS]
        key = np.full(len(self.size), n + 1, np.uint64)
        for part in range(len(sums)):
            if part not in left:
                key = (key ^ sums[part]) * MIX
                key ^= key >> np.uint64(31)
        return key

    def verified(self, n: int, a: np.ndarray, b: np.ndarray, side: np.ndarray) -> np.ndarray:
        """Which pairs of words (a; b, of equal length or one longer) differ by one edit and count here."""
        equal = SIGNATURES[n][0]
        long = self.size[b] > WIDE
        if equal:
            differ = self.left[a] != self.left[b]
            good = differ.sum(axis=1) == 1
            at = differ.argmax(axis=1)
            parts = self.left[a, at] % PARTS, self.left[b, at] % PARTS
            good &= (parts[0] != parts[1]) | (FIRST_WITHOUT[parts[0]] == n)
        else:
            size = self.size[a]
            ahead, behind = (_common(x[a], x[b], size) for x in (self.left, self.right))
            good = (ahead + behind >= size) & ((side == 0) | (ahead < size // 2))
        for i in np.flatnonzero(long):
            good[i] = _near_long(self.words[a[i]], self.words[b[i]], n, side[i])
        return good


def _common(a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """How many first columns are equal, at most `size`."""
    differ = a != b
    return np.minimum(np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]), size)


def _near_long(a: str, b: str, n: int, side: int) -> bool:
    """`Letters.verified` of one pair of any length."""
    ahead = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), len(a))
    if len(a) == len(b):
        parts = [ord(w[ahead]) % PARTS for w in (a, b)] if ahead < len(a) else [0, 0]
        return ahead < len(a) and a[ahead + 1:] == b[ahead + 1:] and (parts[0] != parts[1] or FIRST_WITHOUT[parts[0]] == n)
    return a[ahead:] == b[ahead + 1:] and (side == 0 or ahead < len(a) // 2)


def _pairs(order: np.ndarray, key: np.ndarray, longer: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows to compare, in bounded portions: of each key the rows before one another, or, if the key has
    longer words, these with the others. `order` sorts by (key, longer)."""
    key, longer = key[order], longer[order]
    edge = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    start = np.repeat(edge, np.diff(np.r_[edge, len(key)]))
    place = np.arange(len(key))
    # A longer row meets the key's rows that are not; any other, in signatures of equal lengths, those before it.
    bases = np.cumsum(~longer)
    stop = start + bases - np.where(start > 0, bases[start - 1], 0)
    count = np.where(longer, stop - start, place - start)
    for rows, at in _portions(count):
        yield order[start[rows] + at], order[rows]


def _portions(count: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(row, 0 .. count[row] - 1), flat and in bounded portions."""
    ends = np.cumsum(count)
    total, done = int(ends[-1]) if len(ends) else 0, 0
    while done < total:
        flat = np.arange(done, min(done + PAIRS_AT_ONCE, total))
        rows = np.searchsorted(ends, flat, side="right")
        yield rows, flat - (ends[rows] - count[rows])
        done += len(flat)


def near_in_batch(half: np.ndarray, longer: np.ndarray, side: np.ndarray, only: np.ndarray, batch: list[str],
                  n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each row: how many near words it meets here, and the row of the near word that is most frequent (-1: none).

    `only` is the one signature a row of a hot half is here for, -1 for all.
    """
    letters = Letters(batch)
    first = np.array(sorted(range(len(batch)), key=lambda i: (-n[i], batch[i])))
    rank = np.empty(len(batch), np.int64)
    rank[first] = np.arange(len(batch))
    count, best = np.zeros(len(batch), np.int64), np.full(len(batch), len(batch))
    for number, (equal, _) in enumerate(SIGNATURES):
        here = np.flatnonzero(((only < 0) | (only == number)) & (~longer if equal else True))
        if not len(here):
            continue
        key = (letters.signature(number)[here] ^ half[here]) * MIX
        role = longer[here]
        for a, b in _pairs(np.lexsort((role, key)), key, role):
            a, b = here[a], here[b]
            if not equal:
                mixed = longer[b]
                a, b = a[mixed], b[mixed]
            same = half[a] == half[b]
            a, b = a[same], b[same]
            good = letters.verified(number, a, b, side[a])
            a, b = a[good], b[good]
            for one, other in ((a, b), (b, a)):
                count += np.bincount(one, minlength=len(count))
                np.minimum.at(best, one, rank[other])
    return count, np.where(best < len(batch), first[np.minimum(best, len(batch) - 1)], -1)


def _whole_halves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Rows that come sorted by half, in tables that do not cut a half."""
    kept: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        rows += batch.num_rows
        if rows >= ROWS_AT_ONCE:
            table = pa.Table.from_batches(kept)
            half = np.asarray(table.column("half"))
            cut = int(np.searchsorted(half, half[-1]))
            if cut:
                yield table.slice(0, cut)
                rest = table.slice(cut).combine_chunks()
                kept, rows = rest.to_batches(), rest.num_rows
    if kept:
        yield pa.Table.from_batches(kept)


def near_words(posts: DataFrame) -> DataFrame:
    """(word, n_near, best_n, best): partial results, which add up over the places where a word is posted."""
    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_halves(batches):
            half, longer, side, only, n = (np.asarray(table.column(c)) for c in ("half", "longer", "side", "only", "n"))
            batch = table.column("word").to_pylist()
            count, best = near_in_batch(half.view(np.uint64), longer == 1, side, only, batch, n)
            hit = np.flatnonzero(count)
            yield pa.RecordBatch.from_arrays(
                [pa.array([batch[i] for i in hit], pa.string()), pa.array(count[hit]), pa.array(n[best[hit]]),
                 pa.array([batch[i] for i in best[hit]], pa.string())], ["word", "n_near", "best_n", "best"])

    return posts.repartition("half").sortWithinPartitions("half").mapInArrow(meet, "word string, n_near bigint, best_n bigint, best string")


def dealt_by_signature(posts: DataFrame) -> DataFrame:
    """A row per post and signature, with a `half` of their own."""
    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            longer, half = np.asarray(batch.column("longer")), np.asarray(batch.column("half")).view(np.uint64)
            letters = Letters(batch.column("word").to_pylist())
            for number, (equal, _) in enumerate(SIGNATURES):
                here = np.flatnonzero(longer == 0) if equal else np.arange(batch.num_rows)
                key = ((letters.signature(number) ^ half) * MIX)[here]
                part = batch.take(pa.array(here))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), part.column("longer"), part.column("side"), pa.array(np.full(len(here), number, np.int32)),
                     part.column("word"), part.column("n")], ["half", "longer", "side", "only", "word", "n"])

    return posts.select("half", "longer", "side", "word", "n").mapInArrow(
        deal, "half bigint, longer int, side int, only int, word string, n bigint")


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for `forms` (word, form): the end of every chain, by doubling the distance followed.

    A form is at least ten times as frequent as its word, so chains are short and have no cycle.
    """
    ahead = durable(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        after = ahead.select(F.col("word").alias("root"), F.col("root").alias("further"))
        joined = ahead.join(after, "root", "left")
        ahead = durable(joined.select("word", F.coalesce("further", "root").alias("root"), F.col("further").isNotNull().alias("moved")), "roots")
        moved = not ahead.filter("moved").isEmpty()
        ahead = ahead.drop("moved")
        if not moved:
            return ahead


def variants(docs: DataFrame, hot: int = HOT, times: int = TIMES) -> DataFrame:
    """One row per word: form, root, n, n_near, form_n.

    Words come from all whole texts of `docs` (doc_id, text); null and empty texts have none, and in rows
    without doc_id no letter is deleted. Repeated rows count as often as they stand there. Of near
    words that are equally frequent the one first in code-point order is the form. No words give
    no rows. Other columns are ignored.
    """
    counted = durable(words(docs), "words")
    posts = posted(counted)
    crowded = posts.groupBy("half").count().filter(F.col("count") > hot).select("half")
    crowded = durable(crowded, "crowded")
    single = posts.join(crowded, "half", "left_anti").withColumn("only", F.lit(-1)).select("half", "longer", "side", "only", "word", "n")
    split = dealt_by_signature(posts.join(crowded, "half", "left_semi"))
    found = near_words(single.unionByName(split)).groupBy("word").agg(
        F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("less"), "best")).alias("top"))
    joined = counted.join(found, "word", "left")
    form_n = F.when(-F.col("top.less") >= F.col("n") * times, -F.col("top.less"))
    rows = durable(joined.select("word", F.when(form_n.isNotNull(), F.col("top.best")).alias("form"), "n",
                                 F.coalesce("n_near", F.lit(0)).cast("bigint").alias("n_near"), form_n.cast("bigint").alias("form_n")), "variants")
    ends = roots(rows.filter("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
