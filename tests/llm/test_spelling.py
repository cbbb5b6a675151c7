"""Spelling variants against a brute-force version."""

import random
import re
import zlib
from collections import Counter

import pytest

from riskframe.llm import spelling

SCHEMA = "doc_id bigint, text string, word string, n int, root string, half int"


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, "x", 1, "y", 2) for i, t in rows], SCHEMA)
    return make


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    short, long = sorted((a, b), key=len)
    return any(long[:i] + long[i + 1:] == short for i in range(len(long)))


def plain(rows):
    counts = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = "".join(c.lower() if c.isascii() else c for c in run)
            h = zlib.crc32(f"{doc_id}:{run}".encode()) if doc_id is not None else 1
            if h % 31 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if n >= 2 and len(w) >= 7}
    near = {w: [v for v in counts if one_edit(w, v)] for w in counts}
    form = {}
    for w, n in counts.items():
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 10 * n else None
    out = []
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, n, len(near[w]), counts.get(form[w])))
    return sorted(out)


def found(df):
    return sorted((r["word"], r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in df.collect())


def some_rows(seed):
    random.seed(seed)
    stems = ["".join(random.choices("abcdeéÉàÿ×", k=random.randrange(6, 12))) for _ in range(12)] + ["aaaaaaaa", "ababababab", "q" * 70, "q" * 40 + "r" * 40]
    rows = [(None, "aaaaaaaa AAAAAAAA"), (0, None), (0, ""), (1, "short a b"), (1, "short a b")]
    for i in range(150):
        made = []
        for _ in range(30):
            w = list(random.choices(stems, weights=[2.0 ** -k for k in range(len(stems))])[0])
            for _ in range(random.choice([0, 0, 0, 1, 1, 2])):
                at, kind = random.randrange(len(w)), random.randrange(3)
                w[at: at + (kind != 0)] = [] if kind == 2 else [random.choice("abé")]
            made.append("".join(w) if random.random() < .9 else "".join(w).upper())
        rows.append((random.randrange(10 ** 6), random.choice([" ", ", ", "1", "\n"]).join(made)))
    return rows


@pytest.mark.parametrize("seed, hot", [(1, 20_000), (2, 3)])
def test_variants_equal_brute_force(docs, seed, hot):
    rows = some_rows(seed)
    expected = plain(rows)
    assert sum(r[1] is not None for r in expected) > 10
    assert found(spelling.variants(docs(*rows), hot=hot)) == expected


def test_small_batches_and_portions_change_nothing(docs, monkeypatch):
    rows = some_rows(3)
    monkeypatch.setattr(spelling, "ROWS_AT_ONCE", 7)
    monkeypatch.setattr(spelling, "PAIRS_AT_ONCE", 5)
    columns = [[] for _ in range(3)]
    words = [r[0] for r in plain(rows)]
    rows_of = [(longer, side, w) for w in words for longer in (0, 1) for side in (0, 1)]
    import numpy as np
    half = []
    for longer, side, w in rows_of:
        size = len(w) - longer
        half.append(hash((size, side, w[: size // 2] if side == 0 else w[size // 2 + longer:])))
    count, _ = spelling.near_in_batch(np.array(half, np.int64).view(np.uint64), np.array([r[0] == 1 for r in rows_of]), np.array([r[1] for r in rows_of]),
                                      np.full(len(half), -1), [r[2] for r in rows_of], np.ones(len(half), np.int64))
    near = Counter()
    for (_, _, w), n in zip(rows_of, count.tolist()):
        near[w] += n
    assert {w: near[w] for w in words} == {r[0]: r[4] for r in plain(rows)}


def test_chains_of_forms_end_in_the_root(docs):
    rows = [(None, "abcdefgh " * 500), (None, "abcdefgx " * 50), (None, "abcdefyx " * 5), (None, "abcdezyx abcdezyx")]
    assert [(r[0], r[1], r[2]) for r in found(spelling.variants(docs(*rows)))] == [
        ("abcdefgh", None, "abcdefgh"), ("abcdefgx", "abcdefgh", "abcdefgh"), ("abcdefyx", "abcdefgx", "abcdefgh"), ("abcdezyx", None, "abcdezyx")]


def test_no_words_give_no_rows(docs):
    assert found(spelling.variants(docs())) == found(spelling.variants(docs((1, None), (2, "")))) == []
