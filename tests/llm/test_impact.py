"""Exact top-k search against scoring every row."""

import math
import random

import numpy as np
import pytest

from riskframe.llm import impact

SCHEMA = "vec_id bigint, embedding array<double>, node int, score string, rank int"


@pytest.fixture
def vectors(spark):
    def make(*rows):
        return spark.createDataFrame([(i, v, 1, "x", 2) for i, v in rows], SCHEMA)
    return make


def plain(rows, every=50, k=5):
    usable = {}
    for i, v in rows:
        if i is not None and v and None not in v and all(map(math.isfinite, v)) and sum(abs(math.floor(256 * x)) for x in v) < impact.MOST:
            usable[i] = [math.floor(256 * x) for x in v]
    out = []
    for q in sorted(i for i in usable if i % every == 0):
        scores = sorted((-sum(a * b for a, b in zip(usable[q], v)), i) for i, v in usable.items() if i != q and len(v) == len(usable[q]))
        out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return out


def found(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("block", [16_384, 60])
def test_scores_equal_brute_force(vectors, block):
    random.seed(block)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(0, 1500, 2)]
    rows += [(i, [random.choice([0.0, 0.5, -0.25]) for _ in range(8)]) for i in range(1501, 2000)]  # many ties
    rows += [(i, [1.0] * 8) for i in range(2000, 2100)] + [(2150, [0.0] * 8), (2200, [2.0 ** 22] * 8), (2250, [-3e5, 3e5] + [1e-9] * 6)]
    rows += [(2300, None), (2350, []), (2400, [None] * 8), (2450, [math.nan] * 8), (2500, [math.inf] * 8), (2550, [1e300] * 8), (None, [1.0] * 8)]
    rows += [(2600, [1.0, 2.0]), (2601, [3.0, -1.0]), (2602, [-1.0, 0.5]), (2650, [7.0])]
    assert found(impact.top_k(vectors(*rows, *rows[:60]), block=block)) == plain(rows)


def test_few_rows_and_none(vectors):
    assert found(impact.top_k(vectors())) == []
    assert found(impact.top_k(vectors((0, [1.0, 2.0])))) == []
    rows = [(0, [1.0, -2.0]), (50, [0.5, 0.5]), (7, [0.1, 0.2])]
    assert found(impact.top_k(vectors(*rows))) == plain(rows)


def test_search_stops_on_proof_before_the_last_level():
    random = np.random.default_rng(2)
    vectors = random.integers(-5, 6, (5_000, 16))
    query = np.zeros(16, np.int64)
    query[:3] = 100, -80, 60
    vectors[:40, :3] = np.array([90, -90, 90]) + random.integers(0, 10, (40, 3))
    block = impact.Block(np.arange(5_000), vectors.astype(np.int64))
    assert set(np.argsort(-(vectors @ query), kind="stable")[:5].tolist()) <= set(block.possible(query, 5).tolist())
    assert len(block.possible(query, 5)) <= impact.FEW
