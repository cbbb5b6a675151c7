"""The near-duplicate stage of the pipeline on copies of known similarity, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from riskframe.llm import jaccard

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


@pytest.fixture
def left(spark):
    """left([(id, text), ...]) -> ids that stay in the stage."""
    def run(rows):
        docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], DOCS)
        kept = corpus_pipeline.dissimilar(spark, docs, "")
        assert kept.columns == docs.columns
        return sorted((r["doc_id"] for r in kept.collect()), key=str)
    return run


def plain(text):
    words = (text or "").lower().split()
    return {tuple(words[i: i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def pair(rng, length, low, high):
    """A text and a copy with scattered replaced words whose similarity is from `low` to under `high`."""
    words = [f"w{rng.randrange(50_000)}" for _ in range(length)]
    while True:
        copy = list(words)
        for place in rng.sample(range(length), max(1, round(length * (1 - (low + high) / 2) / 10 * rng.uniform(0.7, 1.3)))):
            copy[place] = f"x{rng.randrange(50_000)}"
        if low <= similarity(plain(" ".join(words)), plain(" ".join(copy))) < high:
            return " ".join(words), " ".join(copy)


def test_recall_of_copies_from_similarity_0_8_on(left):
    rng, rows = random.Random(7), []
    bands = [(0.8, 0.85), (0.85, 0.9), (0.9, 0.96)]
    for n in range(600):
        a, b = pair(rng, rng.choice((200, 500, 2000)), *bands[n % 3])
        rows += [(2 * n, a), (2 * n + 1, b)]
    stay = set(left(rows))
    assert set(range(0, 1200, 2)) <= stay
    missed = [sum(2 * n + 1 in stay for n in range(k, 600, 3)) for k in range(3)]
    assert missed[0] <= 2 and missed[1:] == [0, 0], missed


def test_less_similar_texts_stay(left):
    rng, rows = random.Random(8), []
    for n in range(60):
        a, b = pair(rng, rng.choice((200, 500)), 0.7, 0.795)
        rows += [(2 * n, a), (2 * n + 1, b)]
    assert sorted(map(int, left(rows))) == list(range(120))


def test_groups_equal_brute_force(left):
    rng, rows = random.Random(9), []
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    for n in range(150):  # drifting copies: most are linked only by chains, and many share a bucket without a link
        words = list(base)
        for _ in range(rng.choice((0, 1, 2, 3, 6))):
            words[rng.randrange(100)] = f"x{rng.randrange(900)}"
        rows.append((n + 10, " ".join(words)))
        if n % 12 == 11:
            base = words
    rows += [(1, None), (2, " "), (3, "One two"), (4, "one  TWO"), (5, "one two three"), (None, "alone here"), (6, "a b c d e"), (7, "a b c d f")]
    sets = [plain(t) for _, t in rows]
    root = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    least = {}
    for (i, _), r in zip(rows, root):
        least[r] = min((x for x in (i, least.get(r)) if x is not None), default=None)
    assert left(rows) == sorted(least.values(), key=str)


def test_one_bucket_of_unlike_texts_is_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "FIRST", 2)
    docs = spark.createDataFrame([(i, " ".join(f"w{i // 2}-{k}" for k in range(60)) + " end" * (i % 2), "en", "s", 0) for i in range(60)], DOCS)
    nodes = jaccard.signatures(docs).select("print", "n", "digest", F.array(F.lit(1).cast("bigint")).alias("buckets"))
    found = jaccard.groups(nodes, docs).collect()
    assert len(found) == 60 and len({r["root"] for r in found}) == 30


def test_no_rows_repeated_rows_and_long_texts(left):
    assert left([]) == []
    long = " ".join(f"w{i}" for i in range(150_000))
    assert left([(1, long), (2, long + " end"), (3, None), (4, ""), (5, "a b"), (5, "a b"), (None, "c d")]) == [1, 3, 5, None]


def test_fingerprints_link_copies_that_no_bucket_holds(left, monkeypatch):
    rng = random.Random(11)
    words = [f"w{rng.randrange(900)}" for _ in range(2000)]
    other = [f"v{rng.randrange(900)}" for _ in range(2000)]
    monkeypatch.setattr(jaccard, "buckets", lambda hashes: [])
    assert left([(1, " ".join(words)), (2, " ".join(words) + " end"), (3, " ".join(other))]) == [1, 3]


def test_far_copies_of_one_text_cost_no_square_of_pairs(spark, monkeypatch):
    rng, k = random.Random(12), 60
    words = [f"w{n}" for n in range(200)]
    texts = [" ".join(f"x{i}-{n}" if n in places else w for n, w in enumerate(words))
             for i in range(k) for places in [set(rng.sample(range(0, 200, 6), 9 + i % 8))]]
    texts += [" ".join(words[:n]) for n in range(195, 201)]  # these are links, the others are 0.6 to 0.78 from the text
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    nodes = jaccard.signatures(docs).select("print", "n", "digest", F.array(F.lit(1).cast("bigint")).alias("buckets"))
    met, plain_verified = [], jaccard.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return plain_verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    found = jaccard.groups(nodes, docs).collect()
    sets = [plain(t) for t in texts]
    linked = {i for i in range(len(texts)) for j in range(len(texts)) if i != j and similarity(sets[i], sets[j]) >= 0.8}
    assert len(found) == len(linked) >= 6 and len({r["root"] for r in found}) == 1
    assert sum(met) < 5 * len(texts), met


def test_copies_just_too_far_apart_cost_no_square_of_pairs(spark, monkeypatch):
    rng, words, texts = random.Random(13), [f"w{n}" for n in range(150)], []
    for i in range(80):  # half are links of the plain text, half, cut short, hardly of any, though no count of shingles says so
        places = [rng.randrange(5, 40) + 45 * k for k in range(2 + i % 2)]
        texts.append(" ".join(f"x{i}-{n}" if n in places else w for n, w in enumerate(words[: 150 if i % 2 else 135])))
    texts.append(" ".join(words))
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(texts)], DOCS)
    nodes = jaccard.signatures(docs).select("print", "n", "digest", F.array(F.lit(1).cast("bigint")).alias("buckets"))
    met, plain_verified = [], jaccard.verified

    def counted(pairs, *rest):
        met.append(pairs.count())
        return plain_verified(pairs, *rest)

    monkeypatch.setattr(jaccard, "verified", counted)
    found = jaccard.groups(nodes, docs).collect()
    sets = [plain(t) for t in texts]
    root = list(range(len(sets)))
    for i in range(len(sets)):
        for j in range(i):
            if root[i] != root[j] and similarity(sets[i], sets[j]) >= 0.8:
                root = [root[j] if r == root[i] else r for r in root]
    sizes = [n for n in map(root.count, set(root)) if n > 1]
    assert len(found) == sum(sizes) and len({r["root"] for r in found}) == len(sizes)
    assert sum(met) < 4 * len(texts), met


def test_bitmaps_never_claim_more_than_a_text_lacks(spark):
    rng, rows = random.Random(14), []
    for _ in range(50):
        a, b = ({rng.randrange(1 << 63) for _ in range(rng.choice((0, 1, 40, 3000)))} for _ in range(2))
        b |= set(list(a)[: len(a) // 2])
        rows.append((*(jaccard.cells(jaccard.np.array(sorted(s), "u8")) for s in (a, b)), len(a - b)))
    least = spark.createDataFrame(rows, "a array<bigint>, b array<bigint>, lacks bigint").select(jaccard.lacking("a", "b").alias("least"), "lacks").collect()
    assert all(r.least <= r.lacks for r in least) and any(r.least > 30 for r in least)
