"""Runs of periodic words (maximal repetitions) by longest common extensions at harmonic grid places.

Every run of period q and length 2q or more covers two neighbouring places of the grid 0, q, 2q, ... So for
each period the common extensions of neighbouring grid places, forwards and backwards, give all its runs;
over all periods that is n (1 + 1/2 + 1/3 + ...) questions. A run that is met under a multiple of its
smallest period has the same ends there and is dropped.

A question is answered from a difference cover modulo COVER: among its residues each difference occurs, so
from any two places there is a step below COVER after which both stand on sampled places. Only suffixes
at sampled places are sorted, by doubling ranks of windows; the fewer than COVER words before them
are compared one by one, and the least common prefix between two sampled suffixes is a range minimum over
their neighbours' in sorted order, from a sparse table. A second index over the reversed words answers backwards.

Documents of an Arrow batch share an index of a bounded number of words; words of different documents
never are equal there. A longer document has an index of its own.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12
COVER, RESIDUES = 7, (1, 2, 4)
WORDS_AT_ONCE, QUESTIONS_AT_ONCE = 1 << 17, 1 << 19

_sampled = np.isin(np.arange(COVER), RESIDUES)
# STEP[a, b]: the least step after which residues a and b are both sampled.
STEP = np.array([[next(t for t in range(COVER) if _sampled[(a + t) % COVER] and _sampled[(b + t) % COVER]) for b in range(COVER)]
                 for a in range(COVER)])


def sort_ties(rank: np.ndarray, tied: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Set apart, by `key`, the places `tied` that share a rank; returns those that still do.

    A rank is how many places stand before it, so it holds while other ties are set apart.
    """
    order = np.lexsort((key, rank[tied]))
    places, key = tied[order], key[order]
    old = rank[places]
    group = np.r_[True, old[1:] != old[:-1]]
    first = group | np.r_[True, key[1:] != key[:-1]]
    number = np.arange(len(places))
    start = np.maximum.accumulate(np.where(group, number, 0))
    rank[places] = old + np.maximum.accumulate(np.where(first, number, 0)) - start
    alone = first & np.r_[first[1:], True]
    return places[~alone]


class Extensions:
    """Longest common extensions to the right of places in `codes` (whole numbers from 1)."""

    def __init__(self, codes: np.ndarray):
        n = len(codes)
        self.codes = np.zeros(n + COVER, np.int64)  # places past the end differ: extensions stop at the end
        self.codes[:n], self.n = codes, n
        places = [np.arange(r, n + COVER, COVER) for r in RESIDUES]
        sample = np.concatenate(places)
        last = np.cumsum([len(p) for p in places]) - 1
        self.number = np.full(n + 2 * COVER, -1, np.int64)
        self.number[sample] = np.arange(len(sample))
        end = np.repeat(last, [len(p) for p in places])
        # Windows of COVER words, packed few to a key; then doubled while suffixes are tied.
        bits = max(1, int(self.codes.max()).bit_length())
        padded, per_key = np.r_[self.codes, np.zeros(COVER, np.int64)], max(1, 62 // bits)
        rank, tied = np.zeros(len(sample), np.int64), np.arange(len(sample))
        for at in range(0, COVER, per_key):
            key = np.zeros(len(tied), np.int64)
            for step in range(at, min(COVER, at + per_key)):
                key = key << bits | padded[sample[tied] + step]
            tied = sort_ties(rank, tied, key)
        levels, apart = [rank.copy()], 1
        while len(tied):
            after = tied + apart
            key = np.where(after <= end[tied], rank[np.minimum(after, len(sample) - 1)], -1)
            before, tied = len(tied), sort_ties(rank, tied, key)
            if len(tied) == before and apart > len(sample):
                break  # equal to the end: only the zeros past it
            levels.append(rank.copy())
            apart *= 2
        order = np.argsort(rank, kind="stable")
        self.place = np.empty(len(sample), np.int64)
        self.place[order] = np.arange(len(sample))
        self.table = self._sparse(self._neighbours(levels, sample, order, end))

    def _neighbours(self, levels: list[np.ndarray], sample: np.ndarray, order: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Common prefix of each sorted suffix with the one before it, in words."""
        a, b = order[:-1].copy(), order[1:].copy()
        common, going = np.zeros(len(a), np.int64), np.ones(len(a), bool)
        for level in range(len(levels) - 1, -1, -1):
            equal = going & (levels[level][a] == levels[level][b])
            step = 1 << level
            common += equal * (COVER * step)
            a, b = a + equal * step, b + equal * step
            past = (a > end[order[:-1]]) | (b > end[order[1:]])
            going &= ~past
            a, b = np.where(past, 0, a), np.where(past, 0, b)
        live = np.flatnonzero(going)
        for _ in range(COVER - 1):
            x, y = sample[order[:-1][live]] + common[live], sample[order[1:][live]] + common[live]
            live = live[self._equal(x, y)]
            common[live] += 1
        return common

    def _equal(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        top = len(self.codes) - 1
        x, y = self.codes[np.minimum(x, top)], self.codes[np.minimum(y, top)]
        return (x == y) & (x > 0)

    @staticmethod
    def _sparse(values: np.ndarray) -> list[np.ndarray]:
        """Minima of 1, 2, 4, ... neighbouring values."""
        table, width = [values.astype(np.int32)], 1
        while 2 * width <= len(values):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        return table

    def _sorted_common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Common prefix of two different sampled suffixes: the least between their sorted places."""
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp((high - low).astype(np.float64))[1] - 1
        out = np.empty(len(x), np.int64)
        for k in np.unique(level).tolist():
            some = np.flatnonzero(level == k)
            row = self.table[k]
            out[some] = np.minimum(row[low[some]], row[high[some] - (1 << k)])
        return out

    def common(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """How many words from places x and y (x < y) on are equal."""
        step = STEP[x % COVER, y % COVER]
        out, live = np.zeros(len(x), np.int64), np.arange(len(x))
        for t in range(COVER - 1):
            here = live[step[live] > t]
            equal = self._equal(x[here] + t, y[here] + t)
            out[here[equal]] += 1
            live = np.r_[live[step[live] <= t], here[equal]] if len(here) else live
            if not len(here):
                break
        live = live[y[live] + step[live] < self.n]
        a, b = (self.place[self.number[z[live] + step[live]]] for z in (x, y))
        out[live] += self._sorted_common(a, b)
        return out


@dataclass
class Runs:
    """Runs of several documents, ordered by document, start and period; places count from the document's start."""

    doc: np.ndarray
    start: np.ndarray
    length: np.ndarray
    period: np.ndarray


def find_runs(sizes: np.ndarray, codes: np.ndarray, least: int = LEAST) -> Runs:
    """All runs of documents of `sizes` words whose `codes` stand one after the other.

    Codes are from 1 and shared by equal words of one document only.
    """
    n = len(codes)
    found: list[np.ndarray] = []
    if n:
        ends = np.cumsum(sizes)
        ahead, behind = Extensions(codes), Extensions(codes[::-1])
        here = codes.astype(np.int32) if codes.max() < 1 << 31 else codes
        before = np.roll(here, 1)
        before[0] = 0
        for doc, period, x in _grid(sizes):
            # Few pairs have equal words at the grid places or right before them; only these have extensions.
            y = x + period
            some = np.flatnonzero((here[x] == here[y]) | (before[x] == before[y]))
            doc, period, x, y = doc[some], period[some], x[some].astype(np.int64), y[some].astype(np.int64)
            right, left = np.zeros(len(x), np.int64), np.zeros(len(x), np.int64)
            some = np.flatnonzero(here[x] == here[y])
            right[some] = ahead.common(x[some], y[some])
            some = np.flatnonzero(before[x] == before[y])
            left[some] = behind.common(n - y[some], n - x[some])
            place = x - (ends[doc] - sizes[doc])
            whole = np.flatnonzero((left + right >= period) & (left + right + period >= least))
            found.append(_own(np.stack([doc[whole], (place - left)[whole], (left + right + period)[whole], period[whole]])))
    rows = _own(np.concatenate(found, axis=1)) if found else np.zeros((4, 0), np.int64)
    return Runs(*rows[:, np.lexsort((rows[3], rows[1], rows[0]))])


def _own(rows: np.ndarray) -> np.ndarray:
    """Of (document, start, length, period) with equal ends, the one of smallest period: the run's own."""
    rows = rows[:, np.lexsort((rows[3], rows[2], rows[1], rows[0]))]
    same = np.all(rows[:3, 1:] == rows[:3, :-1], axis=0)
    return rows[:, np.r_[True, ~same]] if rows.shape[1] else rows


def _grid(sizes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(document, period, grid place) for all periods up to half a document, in bounded portions.

    Places are in the joint numbering of all words.
    """
    periods = sizes // 2
    ends = np.cumsum(periods)
    starts = np.cumsum(sizes) - sizes
    number = np.int32 if sizes.sum() < 1 << 30 else np.int64
    total, done = int(ends[-1]) if len(ends) else 0, 0
    while done < total:
        flat = np.arange(done, min(done + QUESTIONS_AT_ONCE, total))
        doc = np.searchsorted(ends, flat, side="right")
        period = flat - (ends[doc] - periods[doc]) + 1
        count = (sizes[doc] - 1) // period  # grid places x with x + period inside the document
        reach = np.cumsum(count)
        fit = max(1, int(np.searchsorted(reach, QUESTIONS_AT_ONCE, side="right")))
        doc, period, count = doc[:fit], period[:fit].astype(number), count[:fit]
        # As steps from one place to the next: a period, or to the next period's first place.
        step = np.repeat(period, count)
        heads = reach[:fit] - count
        step[heads] = np.diff(starts[doc], prepend=0) - np.r_[0, (count[:-1] - 1) * period[:-1]]
        yield np.repeat(doc.astype(number), count), np.repeat(period, count), np.cumsum(step, dtype=number)
        done += fit


def planted(doc_id: int | None, words: list) -> list:
    """The document's words with the repetition that its id asks for; without an id, the words as they are."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + (i - a) % p] for i in range(a, n)]


def _sha(body: bytes) -> str:
    return hashlib.sha256(body).hexdigest()


def _described(words: list[bytes], start: np.ndarray, length: np.ndarray, period: np.ndarray) -> tuple:
    """The result columns of one document from its runs, ordered by start and period."""
    if not len(start):
        return 0, None, None, None, None, _sha(b""), _sha(b" ".join(words))
    best = int(np.lexsort((period, start, -length))[0])
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, start + period, 1)
    np.add.at(edges, start + length, -1)
    kept = [words[i] for i in np.flatnonzero(np.cumsum(edges[:-1]) == 0).tolist()]
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in zip(start.tolist(), length.tolist(), period.tolist()))
    return (len(start), int(start[best]), int(length[best]), int(period[best]), int(1000 * length[best] // period[best]),
            _sha(lines.encode()), _sha(b" ".join(kept)))


NAMES = ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
TYPES = [pa.int64()] * 6 + [pa.string()] * 2
SCHEMA = ", ".join(f"{n} {'string' if t == pa.string() else 'bigint'}" for n, t in zip(NAMES, TYPES))


def periodic_runs(docs: DataFrame, least: int = LEAST, plant: bool = True) -> DataFrame:
    """One row per row of `docs` (doc_id, text): its runs' number, the longest one, and digests.

    Whole texts are read; null and empty texts have no words and no runs. `collapsed_sha256` is of the
    text whose runs keep one period. A row without doc_id gets no planted repetition. Repeated rows
    each give a row, no rows none. Other columns are ignored.
    """
    def described(rows: list[tuple[int | None, list[bytes]]]) -> pa.RecordBatch:
        codes, top = [], 1
        for _, words in rows:
            known = dict(zip(dict.fromkeys(words), count(top)))
            codes.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
            top += len(known)
        runs = find_runs(np.array([len(w) for _, w in rows], np.int64), np.concatenate(codes), least)
        edges = np.searchsorted(runs.doc, np.arange(len(rows) + 1))
        out = [(doc_id, *_described(words, runs.start[a:b], runs.length[a:b], runs.period[a:b]))
               for (doc_id, words), a, b in zip(rows, edges, edges[1:])]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), TYPES)], NAMES)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, size = [], 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0), batch.column(1)):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()  # splits at ASCII white space
                if rows and size + len(words) > WORDS_AT_ONCE:
                    yield described(rows)
                    rows, size = [], 0
                words = planted(doc_id.as_py(), words) if plant else words
                rows.append((doc_id.as_py(), words))
                size += len(words)
        if rows:
            yield described(rows)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(work, SCHEMA)
