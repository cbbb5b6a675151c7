"""Toxicity scores from subword bags, learnt from labelled documents.

A bag is the average of the embeddings of its subwords (lower-case words and their character n-grams,
hashed into buckets), and a linear softmax on that average gives its score. Embeddings and softmax are trained
jointly. A misspelt or new word shares most of its n-grams, and so its vectors, with the words it
was made from.

A document has two such scores. One is of the bag of its different words. A few insults weigh little in a long
text, so a second model scores its passages of PASSAGE words, and the highest counts; it is trained on the passage
of each document that the first model scores highest. The document's score is a logistic function of both.

Training reads a bounded sample: at most SAMPLE labelled documents of each class, those of smallest
id hash. Their bags, not their texts, come to the driver: at most 2 * SAMPLE * BUCKETS counts.
Scoring reads every whole text. Since the softmax is linear, a word adds one number to each average,
which a task keeps for the words it met of late; a model is one number per bucket.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from riskframe.session import durable

SAMPLE = 1_500
BUCKETS = 1 << 17
SIZES = (3, 4, 5)
DIMENSIONS, EPOCHS, BATCH, RATE, DECAY, SEED = 8, 6, 32, 0.4, 1e-4, 7
FOLDS, CHECKED, PASSAGE = 5, 5, 40
# Words in each of the two generations of a task's table (some 300 bytes each), and characters looked up together.
MAX_KNOWN, AT_ONCE = 100_000, 1 << 20
MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0xFF51AFD7ED558CCD], np.uint64)

words_of = re.compile(r"\w+").findall


def subwords(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, counts): for all words one after the other, the buckets of their n-grams (repeats included) and of
    the whole word, with marks at both ends; and how many buckets each word has."""
    codes = np.frombuffer("".join(f"<{w}>" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.fromiter(map(len, words), np.int64, len(words)) + 2
    ends = np.cumsum(size)
    place = np.arange(len(codes)) - np.repeat(ends - size, size)
    room = np.repeat(size, size) - place  # letters from here to the end of the word
    hashes, owners = [np.add.reduceat(_mixed(codes * MIX[1] + place.astype(np.uint64) * MIX[2]), ends - size)], [np.arange(len(words))]
    value, owner = codes * MIX[0], np.repeat(np.arange(len(words)), size)
    for n in range(2, SIZES[-1] + 1):
        value = (value[:-1] * MIX[0] + codes[n - 1:]) * MIX[1]
        if n in SIZES:
            inside = np.flatnonzero(room[: len(value)] >= n)
            hashes.append(value[inside])
            owners.append(owner[inside])
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    return (_mixed(np.concatenate(hashes)) % np.uint64(BUCKETS)).astype(np.int64)[order], np.bincount(owner, minlength=len(words))


def _mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(31))) * MIX[2]
    return values ^ (values >> np.uint64(29))


def bag(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of some words and how often each occurs."""
    return np.unique(subwords(words)[0], return_counts=True) if words else (np.zeros(0, np.int64), np.zeros(0, np.int64))


@dataclass
class Model:
    """Score of a text: sigmoid(line[0] * average over its words + line[1] * highest average of a passage + line[2]).

    `weights` are those of the two averages; `prior` is the score of a text without words, or without `weights` of any.
    """

    prior: float
    weights: np.ndarray | None = None
    line: np.ndarray | None = None


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray) -> np.ndarray:
    """Embeddings and softmax by Adagrad on small batches; returns the weight of every bucket."""
    random = np.random.default_rng(SEED)
    embed = random.uniform(-1, 1, (BUCKETS, DIMENSIONS)) / DIMENSIONS
    soft, offset = random.uniform(-1, 1, (DIMENSIONS, 2)) / DIMENSIONS, np.zeros(2)
    seen_embed, seen_soft, seen_offset = np.full(BUCKETS, 1e-12), np.full(soft.shape, 1e-8), np.full(2, 1e-8)
    target = np.eye(2)[labels]
    filled = np.array([i for i, (buckets, _) in enumerate(bags) if len(buckets)], np.int64)
    for epoch in range(EPOCHS):
        for at in range(0, len(order := random.permutation(filled)), BATCH):
            some = order[at: at + BATCH]
            buckets = np.concatenate([bags[i][0] for i in some])
            shares = np.concatenate([bags[i][1] / bags[i][1].sum() for i in some])
            edges = np.cumsum([0, *(len(bags[i][0]) for i in some[:-1])])
            means = np.add.reduceat(embed[buckets] * shares[:, None], edges)
            logits = means @ soft + offset
            odds = np.exp(logits - logits.max(axis=1, keepdims=True))
            error = (odds / odds.sum(axis=1, keepdims=True) - target[some]) / len(some)
            back = error @ soft.T
            step_soft, step_offset = means.T @ error, error.sum(axis=0)
            owner = np.repeat(np.arange(len(some)), [len(bags[i][0]) for i in some])
            rows, inverse = np.unique(buckets, return_inverse=True)
            step = np.stack([np.bincount(inverse, shares * back[owner, d], len(rows)) for d in range(DIMENSIONS)], axis=1)
            step += DECAY * embed[rows] * np.bincount(inverse, shares, len(rows))[:, None]
            seen_embed[rows] += (step ** 2).mean(axis=1)
            embed[rows] -= RATE * step / np.sqrt(seen_embed[rows])[:, None]
            seen_soft += step_soft ** 2
            soft -= RATE * step_soft / np.sqrt(seen_soft)
            seen_offset += step_offset ** 2
            offset -= RATE * step_offset / np.sqrt(seen_offset)
    return embed @ (soft[:, 1] - soft[:, 0])


def calibrated(averages: np.ndarray, labels: np.ndarray, rate: float) -> np.ndarray:
    """(a, b, c) so that sigmoid(a * x + b * y + c) fits documents the training left out, at the true share of 1.

    The sample holds both labels alike, so its rows are weighted back. Newton steps on scaled averages.
    """
    middle, spread = averages.mean(axis=0), averages.std(axis=0) + 1e-9
    x = np.column_stack([(averages - middle) / spread, np.ones(len(averages))])
    weight = np.where(labels == 1, rate / labels.mean(), (1 - rate) / (1 - labels.mean()))
    line = np.array([1.0, 1.0, math.log(rate / (1 - rate))])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ line, -30, 30)))
        slope = x.T @ (weight * (p - labels)) + 1e-2 * line
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(3)
        line -= np.clip(np.linalg.solve(curve, slope), -2, 2)
    return np.array([*(line[:2] / spread), line[2] - line[:2] @ (middle / spread)])


def passages(words: list[str]) -> list[list[str]]:
    """Runs of PASSAGE words; the rest belongs to the last one."""
    n = max(1, len(words) // PASSAGE)
    return [words[k * PASSAGE: (k + 1) * PASSAGE if k < n - 1 else len(words)] for k in range(n)]


class Averages:
    """The two averages of texts under two lists of weights; words met of late are kept in two generations."""

    def __init__(self, weights: np.ndarray):
        self.weights = weights
        self.recent: dict[str, tuple[float, float, int]] = {}
        self.older: dict[str, tuple[float, float, int]] = {}

    def _of(self, words: list[str]) -> np.ndarray:
        """(sum of the first weights, of the second ones, number of subwords) of each word."""
        if len(self.recent) >= MAX_KNOWN:
            self.recent, self.older = {}, self.recent
        missing = set(words).difference(self.recent)
        again = missing.intersection(self.older)
        self.recent.update(zip(again, map(self.older.__getitem__, again)))
        if fresh := list(missing - again):
            buckets, counts = subwords(fresh)
            starts = np.cumsum(counts) - counts
            sums = [np.add.reduceat(w[buckets], starts).tolist() for w in self.weights]
            self.recent.update(zip(fresh, zip(*sums, counts.tolist())))
        return np.array(list(map(self.recent.__getitem__, words)))

    def of(self, texts: list[list[str]]) -> np.ndarray:
        """(average over the different words, highest average of a passage) of each list of words; 0, 0 of an empty one."""
        out, sizes = np.zeros((len(texts), 2)), np.fromiter(map(len, texts), np.int64, len(texts))
        filled = np.flatnonzero(sizes)
        if not len(filled):
            return out
        number = {w: i for i, w in enumerate(dict.fromkeys(chain.from_iterable(texts)))}
        first, second, count = self._of(list(number)).T
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(texts)), np.int64, sizes.sum())
        own = np.repeat(np.arange(len(texts)), sizes)
        text, word = np.divmod(np.unique(own * len(number) + ids), len(number))
        out[filled, 0] = (np.bincount(text, first[word], len(texts)) / np.bincount(text, count[word], len(texts)).clip(1))[filled]
        parts = np.maximum(1, sizes // PASSAGE) * (sizes > 0)
        place = np.arange(len(ids)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        passage = np.minimum(place // PASSAGE, parts[own] - 1) + (np.cumsum(parts) - parts)[own]
        means = np.bincount(passage, second[ids]) / np.bincount(passage, count[ids])
        out[filled, 1] = np.maximum.reduceat(means, (np.cumsum(parts) - parts)[filled])
        return out


def words_in(text: str | None) -> list[str]:
    return words_of((text or "").lower())


def score_texts(texts: list[str | None], model: Model, averages: Averages | None) -> Iterator[float]:
    """Scores of whole texts; words are looked up for some AT_ONCE characters of text together."""
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end] or "") <= AT_ONCE):
            size += len(texts[end] or "")
            end += 1
        some = [words_in(t) if averages is not None else [] for t in texts[at:end]]
        logits = averages.of(some) @ model.line[:2] + model.line[2] if averages is not None else np.zeros(len(some))
        for words, logit in zip(some, logits.tolist()):
            yield 1 / (1 + math.exp(-max(-700.0, min(700.0, logit)))) if words else model.prior
        at = end


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def labelled_sample(labels: DataFrame, label: str, sample: int) -> tuple[DataFrame, float]:
    """(doc_id, label) of at most `sample` rows per class outside the held-out fold, and the share of 1.

    Null ids and labels teach nothing; an id with both labels counts as 1.
    """
    known = labels.filter(labels["doc_id"].isNotNull() & labels[label].isNotNull() & (fold(labels["doc_id"]) != 0))
    known = known.groupBy(labels["doc_id"].alias("doc_id")).agg(F.max(labels[label]).cast("int").alias("label"))
    rate = known.agg(F.avg("label")).first()[0]
    classes = [known.filter(f"label = {y}").orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample) for y in (0, 1)]
    return classes[0].union(classes[1]), float(rate or 0.0)


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic", sample: int = SAMPLE) -> Model:
    """Train on a bounded sample of labelled rows of `docs` (doc_id, text); every CHECKED-th one of a label only calibrates."""
    spark = docs.sparkSession
    chosen, rate = labelled_sample(labels, label, sample)
    texts = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text"))
    # At most 2 * sample short rows: a bounded broadcast.
    rows = durable(texts.join(F.broadcast(chosen), "doc_id"), "labelled")

    def bags(weights=None):
        """Per row its whole bag, or, given weights, that of the passage of highest average."""
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = []
                for text in batch["text"]:
                    words = words_in(text)
                    if weights is not None and words:
                        all_bags = [bag(p) for p in passages(words)]
                        found.append(max(all_bags, key=lambda b: weights.value[b[0]] @ b[1] / b[1].sum()))
                    else:
                        found.append(bag(list(set(words))))
                yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "buckets": [b for b, _ in found], "counts": [c for _, c in found]})

        table = rows.mapInPandas(work, "doc_id bigint, label int, buckets array<int>, counts array<int>").toArrow()
        table = table.sort_by([("doc_id", "ascending"), ("label", "ascending")])
        # Views of the table's own 32-bit numbers: the driver holds them once.
        lists = [[x.values.to_numpy() for x in table.column(c)] for c in ("buckets", "counts")]
        return list(zip(*lists)), np.asarray(table.column("label"), np.int64), np.asarray(table.column("doc_id"), np.int64)

    def averages(weights):
        def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for batch in batches:
                found = Averages(weights.value).of([words_in(t) for t in batch["text"]])
                yield pd.DataFrame({"doc_id": batch["doc_id"], "label": batch["label"], "whole": found[:, 0], "passage": found[:, 1]})

        return rows.mapInPandas(work, "doc_id bigint, label int, whole double, passage double").toPandas()

    whole, known, ids = bags()
    teaches = np.ones(len(known), bool)
    for y in (0, 1):
        teaches[np.flatnonzero(known == y)[CHECKED - 1:: CHECKED]] = False
    if not 0 < rate < 1 or len(np.unique(known[teaches])) < 2 or len(np.unique(known[~teaches])) < 2:
        return Model(rate)
    taught = np.flatnonzero(teaches)
    first = train([whole[i] for i in taught], known[taught])
    del whole
    best = bags(spark.sparkContext.broadcast(first))[0]
    second = train([best[i] for i in taught], known[taught])
    del best
    pa.default_memory_pool().release_unused()
    weights = np.stack([first, second])
    left = averages(spark.sparkContext.broadcast(weights))
    left = left[left["doc_id"].isin(ids[~teaches])].sort_values(["doc_id", "label", "whole", "passage"])
    return Model(rate, weights, calibrated(left[["whole", "passage"]].to_numpy(), left["label"].to_numpy(), rate))


def score(model: Model, spark) -> callable:
    """A column function: text -> score."""
    shared = spark.sparkContext.broadcast(model)

    @F.pandas_udf(DoubleType())
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        own = shared.value
        averages = Averages(own.weights) if own.weights is not None else None
        for texts in batches:
            yield pd.Series(list(score_texts(texts.tolist(), own, averages)), dtype="float64")

    return scored


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """One row per row of `docs` (doc_id, text): held_out, score, predicted.

    Labels are learnt outside the held-out fold only, and only texts are scored. A text without words
    gets the share of label 1 among the labelled rows. Without enough labelled texts of both kinds every text gets
    that share. Null doc_id is not held out; repeated rows each give a row, no rows none. Other columns are ignored.
    """
    scored = score(fit(docs, labels, label), docs.sparkSession)
    rows = docs.select(docs["doc_id"].alias("doc_id"), F.coalesce(fold(docs["doc_id"]) == 0, F.lit(False)).alias("held_out"),
                       scored(docs["text"]).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> DataFrame:
    """Rows of `docs` that score below one half, with all their columns; null and empty texts, null ids and
    repeated rows are scored like any other. No rows give no rows."""
    scored = score(fit(docs, labels, label), docs.sparkSession)
    return docs.filter(scored(docs["text"]) < 0.5)
