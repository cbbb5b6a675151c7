"""Mixing, neighbour search, the registered queries and the pipeline."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from riskframe.llm import mixing, neighbours
from riskframe.llm.common import find_words
from riskframe.llm.queries import QUERIES, SQL
from tests.check_queries import TESTDATA, canonical, connect

SF_DIR = f"{TESTDATA}/sf0.001"


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, s, 7, 8) for i, t, s in rows], "doc_id bigint, text string, source string, size int, position int")
    return make


def plain_targets(sizes):
    """Targets by giving the excess of full sources to the others until none is above."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    full, total = set(), 1.5 * sum(sizes.values())
    while True:
        rest = total - sum(2 * sizes[s] for s in full)
        open_weight = sum(weight[s] for s in sizes if s not in full)
        target = {s: 2.0 * sizes[s] if s in full else rest * weight[s] / open_weight for s in sizes}
        above = {s for s in sizes if s not in full and target[s] >= 2 * sizes[s]}
        if not above:
            return target
        full |= above


def some_documents(seed):
    random.seed(seed)
    rows = [(1, None, "a"), (2, "", "a"), (None, "x y", None), (3, "w " * 5000, "b"), (4, "p q", "empty"), (4, "p q", "empty"), (4, "p", "empty"), (5, "", "none")]
    for i in range(300):
        rows.append((i + 10, "w " * random.randrange(40), random.choice(["a", "a", "a", "b", "c", "é", "Z", None])))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_targets_and_words_taken(docs, seed):
    rows = some_documents(seed)
    found = mixing.mix(docs(*rows)).collect()
    assert len(found) == len(rows)
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len(find_words(text or ""))
    targets = plain_targets(sizes)
    taken, seen = Counter(), {r[0]: r[2] for r in rows}
    for r in found:
        source = seen[r["doc_id"]]
        assert r["source_size"] == sizes[source] and math.isclose(r["target"], targets[source], abs_tol=1e-6)
        assert 0 <= r["taken"] <= 2 * r["size"]
        taken[source] += r["taken"]
    assert all(taken[s] == math.floor(targets[s] + 1e-9) for s in sizes)
    positions = [r["position"] for r in found]
    assert positions == sorted(positions, key=lambda p: (p is None, p or 0)) and max(p for p in positions if p is not None) < sum(targets.values())


def test_mix_is_the_same_again(docs):
    rows = some_documents(3)
    assert sorted(map(str, mixing.mix(docs(*rows)).collect())) == sorted(map(str, mixing.mix(docs(*reversed(rows))).collect()))


def test_mixed_documents(docs):
    rows = some_documents(4)
    plan = mixing.mix(docs(*rows)).collect()
    left = mixing.mixed_documents(docs(*rows))
    assert left.columns == docs().columns
    starts = sum((r["position"] is not None) + (r["again"] is not None) for r in plan)
    assert left.count() == starts and mixing.mixed_documents(docs()).count() == 0 and mixing.mix(docs()).count() == 0


def test_ramps_shift_sources_in_time(docs):
    rows = [(i, "w " * 10, "ab"[i % 2]) for i in range(400)]
    found = mixing.mix(docs(*rows), weights=(1, 1), ramps=(9, -9), share=0.5).collect()
    half = max(r["position"] or 0 for r in found) / 2
    early = Counter("ab"[r["doc_id"] % 2] for r in found if r["position"] is not None and r["position"] < half)
    assert early["a"] > 2 * early["b"] > 0


def exact_neighbours(rows, k):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and None not in v and np.isfinite(v).all() and any(v)}
    out = []
    for q in sorted(usable):
        if q % 20 == 0:
            near = sorted((-float((v * usable[q]).sum()), i) for i, v in usable.items() if i != q)[:k]
            out += [(q, n + 1, i) for n, (_, i) in enumerate(near)]
    return out


def test_neighbours_of_small_tables_are_exact(spark):
    random.seed(9)
    rows = [(i, [random.gauss(0, 1) for _ in range(8)]) for i in range(300)]
    rows += [(i, [1.0] * 8) for i in range(400, 460)]  # copies
    rows += [(500, None), (520, []), (540, [0.0] * 8), (560, [float("nan")] * 8), (580, [None] * 8), (600, [float("inf")] * 8), (620, [1.0] * 3), (None, [1.0] * 8)]
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows + rows[:5]], "vec_id bigint, embedding array<float>, node int, ids int")
    as_float = [(i, [None if x is None else float(np.float32(x)) for x in v] if v is not None and len(v) == 8 else None) for i, v in rows]
    found = neighbours.nearest(df).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in found) == exact_neighbours(as_float, 20)
    assert neighbours.nearest(df.limit(0)).count() == 0
    assert neighbours.nearest(df.filter("vec_id IN (0, 1, 2)")).count() == 2


def test_recall_of_the_index(spark):
    rng = np.random.default_rng(0)
    vectors = rng.normal(size=(9_000, 32))
    vectors /= np.linalg.norm(vectors, axis=1, keepdims=True)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vectors)], "vec_id bigint, embedding array<double>")
    found = defaultdict(set)
    for r in neighbours.nearest(df).collect():
        found[r["query_id"]].add(r["vec_id"])
    hits = [len(found[q] & set(np.argsort(-np.where(np.arange(9_000) == q, -9, vectors @ vectors[q]), kind="stable")[:20].tolist())) for q in found]
    assert len(found) == 450 and sum(hits) / (20 * len(hits)) >= 0.9


@pytest.mark.parametrize("name", list(QUERIES))
def test_query_runs_and_equals_its_twin(spark, name):
    df = QUERIES[name](spark, SF_DIR)
    rows = df.collect()
    assert rows
    if name in SQL:
        result = connect(SF_DIR).execute(SQL[name])
        columns = [c[0] for c in result.description]
        assert sorted(columns) == sorted(df.columns)
        assert canonical(df.columns, rows) == canonical(columns, result.fetchall())


def plain_leaders(texts):
    """The smallest id of each group over links of a Jaccard similarity of 0.8 or more, by comparing all pairs."""
    sets = {}
    for i, text in texts.items():
        words = ["".join(c.lower() if c.isascii() else c for c in w) for w in find_words(text or "")]
        sets[i] = {tuple(words[k: k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    leader = {i: i for i in texts}

    def top(i):
        return i if leader[i] == i else top(leader[i])

    for a in texts:
        for b in texts:
            both = len(sets[a] & sets[b])
            if a < b and (5 * both >= 4 * (len(sets[a]) + len(sets[b]) - both)):
                low, high = sorted((top(a), top(b)))
                leader[high] = low
    return {top(i) for i in texts}


def test_pipeline_stages_take_effect(spark):
    import corpus_pipeline as pipeline
    from riskframe.llm import exact, toxicity
    from riskframe.session import durable
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labels = spark.read.parquet(f"{SF_DIR}/labels.parquet")
    frames, now = [], docs
    for name, stage in pipeline.STAGES:
        now = durable(stage(spark, now, SF_DIR), "stage")
        frames.append(now)
    toxic, single, apart, mixed, tokens = frames
    assert all(f.columns == docs.columns for f in frames[:-1])
    kept = {r["doc_id"] for r in toxicity.toxicity(docs, labels).filter("predicted = 0").collect()}
    assert {r["doc_id"] for r in toxic.collect()} == kept
    texts = {r["doc_id"]: r["text"] for r in toxic.collect()}
    last = {text: max(i for i, t in texts.items() if t == text) for text in texts.values()}
    assert {r["doc_id"] for r in single.collect()} == set(last.values())
    assert {r["doc_id"] for r in apart.collect()} == plain_leaders({r["doc_id"]: r["text"] for r in single.collect()})
    assert exact.exact_duplicates(apart).filter("NOT kept").count() == 0
    assert tokens.count() == mixed.count() > 0
    assert canonical(["n"], pipeline.run(spark, SF_DIR).selectExpr("n_tokens AS n").collect()) == canonical(["n"], tokens.selectExpr("n_tokens AS n").collect())
