"""Exact, near and substring deduplication against brute force on small tables."""

import hashlib
import random

import pytest
import xxhash
from pyspark.sql import functions as F

from riskframe.llm import exact, simhash, substring
from riskframe.llm.common import find_words
from riskframe.llm.components import components

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, digest string, row int, key int, keep_id int"


@pytest.fixture
def docs(spark):
    """docs((id, text), ...) with extra columns whose names the operators use themselves."""
    def make(*rows):
        return spark.createDataFrame([(i, t, "en", "s", 0, "x", 1, 2, 3) for i, t in rows], DOCS)
    return make


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


LONG = "A sentence that is long enough to be cut somewhere. " * 3000
ODD = [(1, "same text"), (2, "same text"), (3, None), (4, ""), (5, "same  text"), (6, LONG), (7, LONG), (8, LONG + "x"),
       (None, "same text"), (9, "one"), (9, "one"), (9, "two")]


def test_exact_duplicates(docs):
    rows = exact.exact_duplicates(docs(*ODD)).collect()
    assert len(rows) == len(ODD)
    sizes = {(r["doc_id"], r["text_sha256"]): (r["keep_id"], r["group_size"]) for r in rows}
    sha = {t: hashlib.sha256((t or "").encode()).hexdigest() for _, t in ODD}
    for doc_id, text in ODD:
        same = [i for i, t in ODD if (t or "") == (text or "")]
        assert sizes[doc_id, sha[text]] == (max(i for i in same if i is not None), len(same))
    kept = sorted((r["doc_id"], r["text_sha256"]) for r in rows if r["kept"])
    assert kept == sorted([(2, sha["same text"]), (4, sha[""]), (5, sha["same  text"]), (7, sha[LONG]), (8, sha[LONG + "x"]),
                           (9, sha["one"]), (9, sha["two"])])


def test_exact_duplicates_tell_colliding_chunks_apart(docs):
    weak = exact.exact_duplicates(docs(*ODD), identify=lambda c: F.length(c).cast("bigint"), least=4, most=8)
    strong = exact.exact_duplicates(docs(*ODD))
    key = lambda r: (str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
    assert sorted(map(key, weak.collect())) == sorted(map(key, strong.collect()))


def test_exact_filter_keeps_columns_and_one_of_repeated_rows(docs):
    left = exact.drop_exact_duplicates(docs(*ODD))
    assert left.columns == docs(*ODD).columns
    assert sorted((str(r["doc_id"]), r["text"] or "") for r in left.collect()) == sorted(
        [("2", "same text"), ("4", ""), ("5", "same  text"), ("7", LONG), ("8", LONG + "x"), ("9", "one"), ("9", "two")])


def test_chunks_join_to_the_text(spark):
    texts = [LONG, "", "no end", "a\n" * 900, "x" * 10_000, "é😀. " * 700]
    df = spark.createDataFrame([(t,) for t in texts], "text string").select("text", exact.cut(F.col("text")).alias("c"))
    assert all("".join(r["c"]) == r["text"] for r in df.collect())


def plain_print(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    words = find_words(lowered)
    shingles = [" ".join(words[i: i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, x in prints:
        for b, y in prints:
            if (x ^ y).bit_count() <= 2:
                p, q = find(a), find(b)
                root[max(p, q)] = min(p, q)
    return {i: find(i) for i, _ in prints}


def test_fingerprints():
    for text in (None, "", " \t", "one", "Two WORDS", "a b c", "É é Ü x\x1cy z", "the cat sat on the mat the cat sat", LONG):
        assert simhash.fingerprint(text) == plain_print(text)


def test_near_duplicates_equal_brute_force(docs):
    random.seed(3)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for g in range(12):
        base = random.choices(vocabulary, k=random.choice((0, 1, 2, 40, 400)))
        for _ in range(random.choice((1, 3, 9))):
            words = list(base)
            if words and random.random() < 0.7:
                words[random.randrange(len(words))] = "changed"
            rows.append((len(rows) + 5, " ".join(words)))
    rows += [(1, None), (2, ""), (900, "MiXed w1 w2 w3"), (901, "mixed W1 w2 w3")]
    found = by_id(simhash.near_duplicates(docs(*rows)))
    prints = [(i, plain_print(t)) for i, t in rows]
    classes = plain_components(prints)
    assert {i: (r["fingerprint"], r["component_id"]) for i, r in found.items()} == {i: (f"{p:016x}", classes[i]) for i, p in prints}
    left = simhash.drop_near_duplicates(docs(*rows))
    assert sorted(r["doc_id"] for r in left.collect()) == sorted(set(classes.values()))


def test_near_duplicates_of_odd_rows(docs):
    found = simhash.near_duplicates(docs(*ODD))
    assert found.count() == len(ODD)
    left = simhash.drop_near_duplicates(docs((None, "a b c"), (None, "a b c"), (4, "d e f"), (4, "d e f"), (4, "D E F")))
    assert sorted(str(r["doc_id"]) for r in left.collect()) == ["4", "None"]


def test_bk_forest_spans_what_links_reach():
    random.seed(1)
    values = list({random.getrandbits(64) & 0xFFFF_0000_0000_00FF for _ in range(50)} | {v << 3 for v in range(300)})
    pairs = simhash.shard_forest(values, 2)
    assert all((values[a] ^ values[b]).bit_count() <= 2 for a, b in pairs) and len(pairs) < len(values)
    prints = list(enumerate(values))
    root = {i: i for i, _ in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        p, q = find(a), find(b)
        root[max(p, q)] = min(p, q)
    assert {i: find(i) for i in root} == plain_components(prints)


def test_components(spark):
    chain = [(i, i + 1) for i in range(60)] + [(100, 200), (200, 100), (7, 7), (300, 100), (60, 5)]
    roots = {r["node"]: r["root"] for r in components(spark.createDataFrame(chain, "a bigint, b bigint")).collect()}
    assert roots == {**{i: 0 for i in range(61)}, 100: 100, 200: 100, 300: 100}
    assert components(spark.createDataFrame([], "a bigint, b bigint")).count() == 0


def plain_removal(rows, window):
    starts = {}
    for doc_id, text in rows:
        words = find_words(text or "")
        for p in range(len(words) - window + 1):
            key = tuple(words[p: p + window])
            if doc_id is not None:
                starts[key] = min(starts.get(key, doc_id), doc_id)
    out = []
    for doc_id, text in rows:
        words = find_words(text or "")
        gone = {q for p in range(len(words) - window + 1) if doc_id is not None and starts[tuple(words[p: p + window])] < doc_id
                for q in range(p, p + window)}
        kept = [w for i, w in enumerate(words) if i not in gone]
        out.append((str(doc_id), len(words), len(gone), hashlib.sha256(" ".join(kept).encode()).hexdigest()))
    return sorted(out)


@pytest.mark.parametrize("window", [50, 7])
def test_repeated_passages_equal_brute_force(docs, window):
    random.seed(window)
    vocabulary = [f"w{i}" for i in range(400)]
    passages = [random.choices(vocabulary, k=n) for n in (49, 50, 51, 120, 400)]
    rows = [(100, None), (101, ""), (102, "w1 " * 130), (103, "w1 " * 60), (None, " ".join(passages[2])), (7, " ".join(passages[3])),
            (7, " ".join(passages[3])), (7, " ".join(passages[4] + passages[3]))]
    for i in range(30):
        words = random.choices(vocabulary, k=random.choice((0, 3, 80)))
        for passage in random.sample(passages, 2):
            words = words + passage + random.choices(vocabulary, k=random.choice((0, 1, 30)))
        rows.append((i + 8, " ".join(words)))
    found = substring.without_repeats(docs(*rows), window).collect()
    assert sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in found) == plain_removal(rows, window)
    if window == 50:
        longest = {r["doc_id"]: r["longest"] for r in found}
        assert longest[100] == longest[102] == 0 and longest[103] == 50 and max(longest.values()) in (100, 200, 400)


def plain_longest(rows, window):
    """Of each document the greatest of 1, 2, 4, ... times `window` at which it has a window of an earlier one; 0 if none."""
    longest, length = {i: 0 for i, _ in rows}, window
    words = [(i, find_words(t or "")) for i, t in rows]
    while any(len(w) >= length for _, w in words):
        starts = {}
        for i, w in words:
            for p in range(len(w) - length + 1):
                key = " ".join(w[p: p + length])
                starts[key] = min(starts.get(key, i), i)
        for i, w in words:
            if any(starts[" ".join(w[p: p + length])] < i for p in range(len(w) - length + 1)):
                longest[i] = length
        length *= 2
    return longest


@pytest.mark.parametrize("window", [50, 8])
def test_longest_equals_brute_force(docs, window):
    """Also for passages barely longer than a level, at the ends of what was copied, and for a passage of one repeated word."""
    random.seed(window + 1)
    vocabulary = [f"w{i}" for i in range(300)]
    fill = lambda n: random.choices(vocabulary, k=n)
    texts = [["same"] * (window * 2), ["same"] * (window * 2 + 3) + fill(9), ["same"] * (window * 2 - 1)]
    whole = fill(window * 9)
    texts += [whole, fill(5) + whole[3:-4], whole[window: window * 5] + fill(3), whole + whole]
    for n in (2, 2.3, 4, 4.1, 3.98, 1.9, 8):
        passage = fill(round(window * n))
        for _ in range(random.choice((2, 3))):
            texts.append(fill(random.choice((0, 1, 40))) + passage + fill(random.choice((0, 2, 60))))
        texts.append(fill(4) + passage[: len(passage) // 2] + fill(1) + passage[len(passage) // 2:])
    random.shuffle(texts)
    rows = [(i * 3 + 1, " ".join(t)) for i, t in enumerate(texts)]
    found = {r["doc_id"]: r["longest"] for r in substring.without_repeats(docs(*rows), window).collect()}
    want = plain_longest(rows, window)
    assert found == want and {0, window, window * 2, window * 4, window * 8} <= set(want.values())


def test_empty_tables(docs):
    none = docs()
    assert exact.exact_duplicates(none).count() == 0 and exact.drop_exact_duplicates(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0 and substring.without_repeats(none).count() == 0
