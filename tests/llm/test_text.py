"""Tokens, pages, licenses and toxicity against brute force, round trips and held-out labels."""

import random

import pytest
import tiktoken

from riskframe.llm import bpe, licenses, pages, rollups, toxicity
from riskframe.llm.queries import SECOND_VOCABULARY, VOCABULARY, vocabulary

DOCS = "doc_id bigint, text string, lang string, source string, ids int, label int, score double"
PATH, PATTERN = vocabulary()


@pytest.fixture
def docs(spark):
    def make(*rows):
        return spark.createDataFrame([(i, t, None, None, 1, 2, 3.0) for i, t in rows], DOCS)
    return make


@pytest.fixture(scope="module")
def encoder():
    return bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(PATH)), PATTERN)


@pytest.fixture(scope="module")
def library():
    return tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.load_ranks(PATH), special_tokens={})


def test_encoding_equals_the_library(encoder, library):
    random.seed(5)
    parts = ["a", "b", " ", "  ", "th", "er", "ing", "é", "日本", "😀", "\n", "\t", "\x1c", "\xa0", "12", ".", "'s", "'ll", "aaaa", "ß", "-----", "<|endoftext|>"]
    texts = ["".join(random.choices(parts, k=random.randrange(40))) for _ in range(3000)]
    texts += ["", " ", "a" * 5000, "ab" * 3000, "-" * 3000, "\n" * 500, "日" * 800, " a  b \n c"]
    assert [encoder.encode(t) for t in texts] == [library.encode_ordinary(t) for t in texts]


@pytest.mark.parametrize("often", [0, 3])
def test_arcs_give_the_ids_of_the_library(encoder, library, monkeypatch, often):
    monkeypatch.setattr(bpe, "OFTEN", often)
    random.seed(often)
    for _ in range(1500):
        text = "".join(random.choices("abcdefgimnorstuéß ", k=random.randrange(25)))
        assert encoder.encode(text) == library.encode_ordinary(text)


@pytest.mark.parametrize("name", [VOCABULARY, SECOND_VOCABULARY])
def test_tokens_taken_apart_as_the_merges_make_them(name):
    ranks = bpe.load_ranks(vocabulary(name)[0])
    words = bpe.Vocabulary(ranks)
    random.seed(1)
    for token, rank in random.sample(sorted(ranks.items()), 4000):
        assert words.made(rank) == (bpe.merge(ranks, token) == [rank])


def test_tables_are_given_up_and_collection_goes_on():
    import gc
    with pytest.raises(ValueError), bpe.codec(PATH, PATTERN) as (encoder, _):
        encoder.encode("some words met for the first time")
        assert not gc.isenabled() and encoder.recent
        raise ValueError
    assert gc.isenabled() and not encoder.recent and not encoder.older and len(encoder.transducer.nodes) == 1


def test_tables_of_any_size_give_the_same_ids(library, monkeypatch):
    monkeypatch.setattr(bpe, "OFTEN", 2)
    monkeypatch.setattr(bpe, "MAX_STATES", 20)
    monkeypatch.setattr(bpe, "MAX_PIECES", 3)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 5)
    small = bpe.Encoder(bpe.Vocabulary(bpe.load_ranks(PATH)), PATTERN)
    text = "the quick brown foxes jumped unbelievably over thirteen lazy dogs " * 3
    assert small.encode(text) == library.encode_ordinary(text) == small.encode(text)


def test_emission_waits_for_bounded_lookahead(encoder, monkeypatch):
    monkeypatch.setattr(bpe, "OFTEN", 0)
    longest = max(encoder.transducer.length.values())
    encoder.encode("qwertyuiopasdfghjklzxcvbnm" * 40)
    assert max(len(state[1]) for state in encoder.transducer.nodes) <= 2 * longest


def test_decoding_in_portions(encoder):
    text = "naïve 日本語 😀 text"
    ids = encoder.encode(text)
    decoder = bpe.Decoder(encoder.transducer.bytes_of)
    assert "".join(decoder.feed([i]) for i in ids) + decoder.close() == text
    byte = {b: bpe.load_ranks(PATH)[bytes([b])] for b in range(256)}
    for raw in (b"\xe6\x97", b"\xff", b"a\xc3b", b"\xed\xa0\x80", b"\xf0\x9f\x98\x80", b"\xe6\x97\xe6\x97\xa5", b"\xf5\x80", b"\xf4\x90\x80\x80"):
        assert decoder.feed([byte[b] for b in raw]) + decoder.close() == raw.decode("utf-8", "replace")


def test_tokenise(docs, library):
    rows = [(1, None), (2, ""), (None, "a text"), (3, "a text"), (3, "a text"), (4, "long words " * 20_000)]
    found = bpe.tokenise(docs(*rows), PATH, PATTERN).collect()
    assert sorted((str(r["doc_id"]), r["ids"]) for r in found) == sorted((str(i), library.encode_ordinary(t or "")) for i, t in rows)
    assert all(r["n_tokens"] == len(r["ids"]) for r in found)
    assert bpe.tokenise(docs(), PATH, PATTERN).count() == 0


@pytest.mark.parametrize("page, text", [
    (None, ""), ("", ""), ("plain", "plain"),
    ("<p>one<p>two", "one\n\ntwo"),
    ("<title>t</title><body>a<br>b</body>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul></ul>d", "- a\n- b\n  - c\n\nd"),
    ("<ol start=3><li>a</li><li><p>b</p></li></ol>", "3. a\n4. b"),
    ("<table><tr><td>a<td>long cell<tr><td>wider<td>b</table>", "a     | long cell\nwider | b"),
    ("<table><tr><th colspan=2>x<th>y<tr><td>1<td>2<td>3</table>", "x |   | y\n1 | 2 | 3"),
    ("<div hidden>no</div><p style='display:none'>no</p><span aria-hidden=true>no</span>yes", "yes"),
    ("<script>var t = '</p>';</script><style>p{}</style>a<!-- no -->b", "ab"),
    ("a &amp; b &lt;i&gt; &nbsp;c", "a & b <i> \xa0c"),
    ("<pre>a\n  b</pre>", "a\n  b"),
    ("<b>bold</i> text</p> end", "bold text\n\nend"),
    ("<div>a<div>b</div></div>c", "a\nb\nc"),
    ("a < b <3", "a < b <3"),
    ("<p>a <b>b</b> <i>c</i>\n  d</p>", "a b c d"),
    ("<script>never closed", ""),
    ("<select><option>x<option>y</select><textarea>z</textarea>k", "k"),
])
def test_visible_text(page, text):
    assert pages.visible_text(page) == text


def test_pages(spark):
    df = spark.createDataFrame([(1, "u", "<p>a b<p>c", 1), (1, "u", "<p>a b<p>c", 1), (None, None, None, 2), (3, "v", "<div>" * 5000 + "deep", 3)],
                               "page_id bigint, url string, html string, text int")
    assert sorted((str(r["page_id"]), r["text"], r["n_lines"], r["n_words"]) for r in pages.extract(df).collect()) == [
        ("1", "a b\n\nc", 3, 3), ("1", "a b\n\nc", 3, 3), ("3", "deep", 1, 1), ("None", "", 0, 0)]


def plain_scan(text):
    words = licenses.words(text)
    starts, base = [], set()
    for phrase, label in licenses.PHRASES:
        p = phrase.split()
        for i in range(len(words) - len(p) + 1):
            if words[i: i + len(p)] == p:
                starts.append(i)
                base.add(label)
    labels, best, paragraphs, open_lines = set(base), 0.0, [], []
    for line in [*(text or "").split("\n"), ""]:
        if line.strip():
            open_lines.append(line)
        elif open_lines:
            paragraphs += ["\n".join(open_lines), *open_lines]
            open_lines = []
    for block in paragraphs:
        own = set(licenses.words(block))
        for label, template in licenses.TEMPLATES:
            t = set(licenses.words(template))
            if len(own & t) / len(t) >= licenses.THRESHOLD - 1e-12:
                labels.add(label)
                best = max(best, len(own & t) / len(t))
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)),
            1.0 if starts else best)


def test_license_scan_equals_brute_force(docs):
    random.seed(2)
    rows = [(1, None), (2, ""), (None, "MIT License"), (3, "x MIT-License, the apache LICENSE; General Public\nLicense"), (3, "mit license mit license"),
            (4, "word " * 50_000 + "mit license")]
    for label, template in licenses.TEMPLATES:
        words = template.split()
        for share in (1.0, 0.85, 0.7):
            kept = [w for w in words if random.random() < share]
            rows.append((len(rows) + 10, "intro\n\n" + " ".join(kept[: len(kept) // 2]) + "\n" + " ".join(kept[len(kept) // 2:]) + "\n\nend of it"))
    found = licenses.license_scan(docs(*rows)).collect()
    names = ("n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
    assert sorted(str((str(r["doc_id"]), *(r[n] for n in names))) for r in found) == sorted(str((str(i), *plain_scan(t))) for i, t in rows)
    assert licenses.license_scan(docs()).count() == 0


def test_toxicity_learns_spellings(spark, docs):
    random.seed(4)
    calm = [f"word{i}" for i in range(200)]
    rows, labels = [], []
    for i in range(500):
        toxic = i % 4 == 0
        words = random.choices(calm, k=30)
        if toxic:
            words[3:3] = random.sample(["horribleperson", "awfulhuman", "nastything"], 2)
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    rows += [(1000, "word1 word2 horriblepersons word3 awfulhumans"), (1001, None), (1002, ""), (None, "word1 word2"), (5, rows[5][1])]
    frame = spark.createDataFrame(labels + [(2000, 1), (None, 1), (3, None)], "doc_id bigint, toxic int")
    found = toxicity.toxicity(docs(*rows), frame).collect()
    assert len(found) == len(rows) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in found)
    by_id = {r["doc_id"]: r for r in found}
    held = [r for r in found if r["held_out"] and r["doc_id"] is not None and r["doc_id"] < 500]
    assert held and sum(r["predicted"] == (r["doc_id"] % 4 == 0) for r in held) / len(held) > 0.95
    assert by_id[1000]["predicted"] == 1 and by_id[1001]["predicted"] == by_id[1002]["predicted"] == 0
    left = toxicity.drop_toxic(docs(*rows), frame)
    assert left.columns == docs().columns and left.count() == sum(r["predicted"] == 0 for r in found)


def test_toxicity_without_labels(spark, docs):
    none = spark.createDataFrame([], "doc_id bigint, toxic int")
    assert [r["predicted"] for r in toxicity.toxicity(docs((1, "a"), (2, None)), none).collect()] == [0, 0]
    assert toxicity.toxicity(docs(), none).count() == 0


def test_rollup(spark):
    df = spark.createDataFrame([(1, "a b c", "en", "s", 9), (2, None, "en", "s", 9), (3, "ein zwei", "de", None, 9), (3, "ein zwei", "de", None, 9),
                                (4, "x", None, "t", 9)], "doc_id bigint, text string, lang string, source string, version int")
    paths = {"one": PATH, "two": vocabulary(SECOND_VOCABULARY)[0]}
    counts = rollups.stored_counts(df, paths, PATTERN)
    one, two = counts.filter("version = 'one'"), counts.filter("version = 'two'")
    plain = {(r["doc_id"], r["version"]): r["n_tokens"] for r in counts.collect()}
    rollup = rollups.Rollup(spark)
    rollup.commit("1", rollups.inserted(one))
    for _ in range(3):  # a batch that comes again changes nothing
        rollup.commit("2", rollups.revised(one.filter("doc_id = 3"), two.filter("doc_id = 3")))
    rollup.commit("3", rollups.deleted(one.filter("doc_id = 4")))
    rollup.commit("4", rollups.inserted(one.filter("false")))
    totals = {(r["source"], r["lang"], r["version"]): (r["documents"], r["tokens"]) for r in rollup.totals().collect()}
    assert totals == {("s", "en", "one"): (2, plain[1, "one"]), (None, "de", "two"): (2, 2 * plain[3, "two"])}
