"""Periodic runs against a brute-force version."""

import hashlib
import random
import zlib

import numpy as np
import pytest

from riskframe.llm import periodic
from riskframe.llm.common import find_words

SCHEMA = "doc_id bigint, text string, start int, length int, period int, n_runs string"


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, 1, 2, 3, "x") for i, t in rows], SCHEMA)
    return make


def plain_runs(words, least=12):
    smallest = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j - i + q >= max(least, 2 * q):
                smallest.setdefault((i, j - i + q), q)
            i = max(j, i + 1)
    return sorted((start, length, q) for (start, length), q in smallest.items())


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain(doc_id, text):
    words = find_words(text or "")
    n, h = len(words), zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    if h % 10 == 0 and n:
        a, g = h // 10 % n, h // 10
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    return (doc_id, len(runs), *((best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4),
            sha("".join(f"{a},{b},{c}\n" for a, b, c in runs)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def some_words():
    words = []
    for _ in range(random.randrange(12)):
        block = [random.choice("abc"[: random.randrange(1, 4)]) for _ in range(random.randrange(1, 9))]
        words += block * random.randrange(1, 7)
    return words


@pytest.mark.parametrize("questions", [1 << 19, 5])
def test_runs_equal_brute_force(monkeypatch, questions):
    monkeypatch.setattr(periodic, "QUESTIONS_AT_ONCE", questions)
    random.seed(questions)
    for _ in range(60):
        words = [some_words() for _ in range(random.randrange(1, 6))]
        codes = [1 + 3 * n + "abc".index(w) for n, some in enumerate(words) for w in some]
        runs = periodic.find_runs(np.array(list(map(len, words))), np.array(codes, np.int64))
        found = [[] for _ in words]
        for doc, *run in zip(*(x.tolist() for x in (runs.doc, runs.start, runs.length, runs.period))):
            found[doc].append(tuple(run))
        assert found == [plain_runs(w) for w in words]


def test_common_extensions_equal_comparing():
    random.seed(4)
    codes = np.array([random.choice([1, 1, 1, 2]) for _ in range(300)])
    index = periodic.Extensions(codes)
    x, y = zip(*((i, j) for i in range(300) for j in range(i + 1, 300)))
    expected = [next((k for k in range(300 - j) if codes[i + k] != codes[j + k]), 300 - j) for i, j in zip(x, y)]
    assert index.common(np.array(x), np.array(y)).tolist() == expected


@pytest.mark.parametrize("at_once", [1 << 17, 40])
def test_rows_equal_brute_force(docs, monkeypatch, at_once):
    monkeypatch.setattr(periodic, "WORDS_AT_ONCE", at_once)
    random.seed(at_once)
    rows = [(None, "a " * 20), (None, None), (1, None), (2, ""), (3, " \n\t"), (4, "é\x1c b c"), (5, "x y " * 50), (5, "x y " * 50)]
    rows += [(i, random.choice([" ", "\n", " \x0b"]).join(some_words() + [str(k) for k in range(random.randrange(30))])) for i in range(10, 150)]
    expected = [plain(*r) for r in rows]
    assert sum(zlib.crc32(str(r[0]).encode()) % 10 == 0 for r in rows) > 5 and sum(r[1] > 1 for r in expected) > 20
    found = periodic.periodic_runs(docs(*rows))
    assert found.columns == periodic.NAMES and sorted(map(str, map(tuple, found.collect()))) == sorted(map(str, expected))


def test_long_documents_of_one_word_and_of_none_alike(docs):
    rows = [(7, "w " * 60_000), (8, " ".join(map(str, range(60_000)))), (9, " ".join(map(str, range(20_000))) + " z" * 40)]
    found = {r["doc_id"]: tuple(r)[1:6] for r in periodic.periodic_runs(docs(*rows), plant=False).collect()}
    assert found == {7: (1, 0, 60_000, 1, 60_000_000), 8: (0, None, None, None, None), 9: (1, 20_000, 40, 1, 40_000)}


def test_no_rows_give_no_rows(docs):
    assert periodic.periodic_runs(docs()).count() == 0
