"""Registered queries of the operators, each over its whole table, with SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskframe.llm import (bpe, exact, impact, licenses, mixing, neighbours, pages, periodic, rollups, simhash, spelling,
                           substring, toxicity)

VOCABULARY, SECOND_VOCABULARY = "byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def vocabulary(name: str = VOCABULARY) -> tuple[str, str]:
    """Path of a public vocabulary file, and the pattern that goes with it."""
    import public_tokenizers
    return public_tokenizers.path(name), public_tokenizers.PATTERN


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.without_repeats(table(spark, sf_dir, "documents")).drop("kept_text", "longest")


def op2_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(table(spark, sf_dir, "pages"))


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).drop("digest")


def op6_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.tokenise(table(spark, sf_dir, "documents"), *vocabulary(), with_ids=False)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents")).drop("digest")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.license_scan(table(spark, sf_dir, "documents")).drop("found")


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents come in under the first vocabulary; those not in English are counted anew under the
    second, in a batch that is committed twice; toxic ones are deleted."""
    path, pattern = vocabulary()
    paths = {VOCABULARY: path, SECOND_VOCABULARY: vocabulary(SECOND_VOCABULARY)[0]}
    counts = rollups.stored_counts(table(spark, sf_dir, "documents"), paths, pattern)
    first, second = (counts.filter(F.col("version") == v) for v in paths)
    foreign = ~F.col("lang").eqNullSafe("en")
    totals = rollups.Rollup(spark)
    totals.commit("1", rollups.inserted(first))
    for _ in range(2):
        totals.commit("2", rollups.revised(first.filter(foreign), second.filter(foreign)))
    toxic = table(spark, sf_dir, "labels").filter("toxic = 1").select("doc_id").distinct()
    now = first.filter(~foreign).unionByName(second.filter(foreign))
    totals.commit("3", rollups.deleted(now.join(toxic, "doc_id", "left_semi")))
    return totals.totals()


def op11_top_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return impact.top_k(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic.periodic_runs(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (
    op1_substring_dedup, op2_html_text, op3_toxicity, op4_simhash, op5_mixing, op6_neighbours, op7_bpe,
    op8_exact_dedup, op9_licenses, op10_token_counts, op11_top_scores, op12_spelling, op13_periodic_runs)}

WORDS = r"'[^\x20\x09-\x0D]+'"

SQL: dict[str, str] = {
    "op1_substring_dedup": fr"""
        WITH texts AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {WORDS}) AS words FROM documents),
        places AS (SELECT doc_id, words, unnest(generate_series(1, len(words))) AS place FROM texts),
        windows AS (SELECT doc_id, place, array_to_string(list_slice(words, place, place + 49), ' ') AS body
                    FROM places WHERE place + 49 <= len(words)),
        later AS (SELECT doc_id, place FROM (SELECT doc_id, place, min(doc_id) OVER (PARTITION BY body) AS first FROM windows) w
                  WHERE doc_id > first),
        gone AS (SELECT DISTINCT doc_id, unnest(generate_series(place, place + 49)) AS place FROM later),
        kept AS (SELECT p.doc_id, string_agg(words[p.place], ' ' ORDER BY p.place) AS body, count(*) AS n
                 FROM places p ANTI JOIN gone g ON p.doc_id = g.doc_id AND p.place = g.place GROUP BY p.doc_id)
        SELECT t.doc_id, len(words) AS n_words, len(words) - coalesce(n, 0) AS n_removed, sha256(coalesce(body, '')) AS kept_sha256
        FROM texts t LEFT JOIN kept k ON t.doc_id = k.doc_id""",
    "op5_mixing": fr"""
        WITH sized AS (
            SELECT doc_id, coalesce('a' || source, 'b') AS bucket, md5(coalesce(CAST(doc_id AS VARCHAR), text, '')) AS hashed,
                   CAST(coalesce(len(regexp_extract_all(text, {WORDS})), 0) AS BIGINT) AS size FROM documents),
        sources AS (
            SELECT bucket, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY bucket) - 1 AS rank FROM sized GROUP BY bucket),
        weighed AS (
            SELECT bucket, source_size, CAST(CASE rank % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS DOUBLE) AS weight,
                   CASE rank % 3 WHEN 0 THEN 5 WHEN 1 THEN 0 ELSE -5 END AS ramp, CAST(source_size * 2 AS DOUBLE) AS most FROM sources),
        summed AS (
            SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) * 1.5::DOUBLE AS words, sum(weight) OVER () AS weights,
                   coalesce(sum(most) OVER before, 0) AS given, coalesce(sum(weight) OVER before, 0) AS spent FROM weighed
            WINDOW before AS (ORDER BY most / weight, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
        marked AS (SELECT *, most * (weights - spent) <= (words - given) * weight AS full_ FROM summed),
        shared AS (
            SELECT *, words - sum(CASE WHEN full_ THEN most ELSE 0 END) OVER () AS rest,
                   sum(CASE WHEN full_ THEN 0 ELSE weight END) OVER () AS open FROM marked),
        aims AS (
            SELECT bucket, source_size, ramp, CASE WHEN full_ THEN most ELSE rest * weight / open END AS target FROM shared),
        demands AS (SELECT *, CAST(floor(target) AS BIGINT) AS demand FROM aims),
        bent AS (
            SELECT *, CAST(sum(demand * (10 + ramp)) OVER () AS DOUBLE) / 10.0::DOUBLE AS rise,
                   CAST(sum(demand * ramp) OVER () AS DOUBLE) / 10.0::DOUBLE AS bend, ramp / 10.0::DOUBLE AS a FROM demands),
        placed AS (
            SELECT doc_id, size, b.*, CAST(coalesce(sum(size) OVER (PARTITION BY s.bucket ORDER BY hashed, doc_id
                   ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM sized s JOIN bent b ON s.bucket = b.bucket),
        timed AS (
            SELECT *, CAST(start AS DOUBLE) / demand AS x, CAST(start + source_size AS DOUBLE) / demand AS y FROM placed),
        times AS (
            SELECT *, CASE WHEN start >= demand THEN NULL WHEN ramp = 0 THEN x
                           ELSE ((1.0::DOUBLE + a) - sqrt((1.0::DOUBLE + a) * (1.0::DOUBLE + a) - 4.0::DOUBLE * a * x)) / (2.0::DOUBLE * a) END AS t,
                   CASE WHEN start + source_size >= demand THEN NULL WHEN ramp = 0 THEN y
                        ELSE ((1.0::DOUBLE + a) - sqrt((1.0::DOUBLE + a) * (1.0::DOUBLE + a) - 4.0::DOUBLE * a * y)) / (2.0::DOUBLE * a) END AS u FROM timed)
        SELECT doc_id, size, source_size, target,
               least(size, greatest(0, demand - start)) + least(size, greatest(0, demand - start - source_size)) AS taken,
               CAST(round(rise * t - bend * t * t) AS BIGINT) AS position, CAST(round(rise * u - bend * u * u) AS BIGINT) AS again
        FROM times""",
    "op8_exact_dedup": """
        SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept,
               sha256(coalesce(text, '')) AS text_sha256
        FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))""",
    "op11_top_scores": """
        WITH numbers AS (
            SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS vector FROM embeddings
            WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: isfinite(x))) = len(embedding)),
        scored AS (
            SELECT q.vec_id AS query_id, n.vec_id, CAST(list_dot_product(q.vector, n.vector) AS BIGINT) AS score
            FROM numbers q JOIN numbers n ON q.vec_id <> n.vec_id AND len(q.vector) = len(n.vector) WHERE q.vec_id % 50 = 0)
        SELECT query_id, CAST(row_number() OVER best AS INT) AS rank, vec_id, score FROM scored
        WINDOW best AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY rank <= 5""",
    "op12_spelling": """
        WITH RECURSIVE bits AS (
            SELECT i, 0 AS k, CAST(i AS BIGINT) AS c FROM range(256) r(i)
            UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
        crc AS (SELECT list(c ORDER BY i) AS steps FROM bits WHERE k = 8),
        runs AS (
            SELECT CAST(CAST(doc_id AS BIGINT) AS VARCHAR) AS id,
                   unnest(regexp_extract_all(text, '[A-Za-z\u00C0-\u00FF]{7,}')) AS run FROM documents),
        lowered AS (SELECT id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n FROM runs GROUP BY ALL),
        named AS (SELECT *, hex(encode(id || ':' || run)) AS body FROM lowered),
        hashed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                list_transform(range(len(body) // 2), lambda i: CAST('0x' || substr(body, CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT)),
                lambda a, b: xor(a >> 8, steps[xor(a & 255, b) + 1]), 4294967295)) AS h FROM named, crc),
        cut AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % len(run)) || substr(run, h % len(run) + 2) ELSE run END AS word, n FROM hashed),
        words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM cut WHERE len(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        gaps AS (
            SELECT word, n, i, substr(word, 1, i) || substr(word, i + 2) AS rest
            FROM (SELECT word, n, unnest(range(len(word))) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other FROM gaps a JOIN gaps b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
            UNION SELECT a.word, b.word FROM words a JOIN gaps b ON a.word = b.rest
            UNION SELECT a.word, b.word FROM gaps a JOIN words b ON a.rest = b.word),
        best AS (
            SELECT x.word, count(*) AS n_near, first(other ORDER BY w.n DESC, encode(other)) AS top, max(w.n) AS top_n
            FROM near x JOIN words w ON x.other = w.word GROUP BY x.word),
        formed AS (
            SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN top_n >= 10 * w.n THEN top END AS form,
                   CASE WHEN top_n >= 10 * w.n THEN top_n END AS form_n FROM words w LEFT JOIN best b ON w.word = b.word),
        chain AS (
            SELECT word, word AS root, form FROM formed
            UNION ALL SELECT c.word, c.form, f.form FROM chain c JOIN formed f ON c.form = f.word)
        SELECT f.word, f.form, c.root, f.n, f.n_near, f.form_n FROM formed f JOIN chain c ON f.word = c.word AND c.form IS NULL""",
}
