"""The operators of this package as named queries over the whole tables, with DuckDB SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import (
    filter_audit,
    line_dedup,
    lm_scoring,
    minhash,
    minhash_dedup,
    mixing,
    packing,
    quality_classifier,
    quality_rules,
    resampling,
    sharding,
    simhash,
    suffix_dedup,
)
from .common import documents

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(function):
        QUERIES[name] = function
        if sql:
            ORACLE_SQL[name] = sql.strip()
        return function

    return add


def tokenizer_path() -> str:
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_packing")
def op1_packing(spark: SparkSession, folder: str) -> DataFrame:
    pieces = packing.pack(documents(spark, folder), tokenizer_path())
    return pieces.withColumn("ids_crc32", F.crc32("ids")).drop("ids")


@query("op2_line_dedup", r"""
WITH lines AS (
    SELECT doc_id, i, line,
        translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                  'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
    FROM (
        SELECT doc_id, generate_subscripts(parts, 1) AS i, unnest(parts) AS line
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents)
    )
), repeated AS (
    SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), judged AS (
    SELECT l.doc_id, l.i, l.line, r.key IS NOT NULL AND r.keeper <> l.doc_id AS dropped
    FROM lines l LEFT JOIN repeated r ON l.key = r.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
    sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
""")
def op2_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    done = line_dedup.dedup_lines(documents(spark, folder).select("doc_id", "text"))
    return done.select("doc_id", "n_lines", "n_dropped", F.sha2(F.encode("text", "utf-8"), 256).alias("kept_sha256"))


@query("op3_lm_scoring")
def op3_lm_scoring(spark: SparkSession, folder: str) -> DataFrame:
    return lm_scoring.score(documents(spark, folder))


@query("op4_sharding")
def op4_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.assign(documents(spark, folder)).withColumn("law", F.lit("key"))


@query("op5_suffix_dedup")
def op5_suffix_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = suffix_dedup.dedup_substrings(documents(spark, folder))
    return left.withColumn("kept_sha256", F.sha2("kept", 256)).drop("kept")


@query("op6_simhash")
def op6_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, folder)).select("doc_id", "fingerprint", "component_id")


@query("op7_quality_rules", r"""
WITH docs AS (
    SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), tokens AS (
    SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM docs
), windows AS (
    SELECT doc_id, i, word || ' ' || lead(word, 1) OVER w || ' ' || lead(word, 2) OVER w || ' ' || lead(word, 3) OVER w || ' ' || lead(word, 4) OVER w AS gram
    FROM tokens WINDOW w AS (PARTITION BY doc_id ORDER BY i)
), again AS (
    SELECT doc_id, i FROM windows WHERE gram IS NOT NULL QUALIFY count(*) OVER (PARTITION BY doc_id, gram) > 1
), repeats AS (
    SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM again, (SELECT unnest(range(5)) AS k) GROUP BY doc_id
), lines AS (
    SELECT doc_id, host, text, unnest(string_split(text, chr(10))) AS line FROM docs
), normal AS (
    SELECT *, len(regexp_extract_all(line, '[^\x20\x09-\x0D]+')) AS n, array_to_string(regexp_extract_all(
        translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), ' ') AS key
    FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), doubles AS (
    SELECT doc_id, (count(*) - count(DISTINCT line)) AS n_dup_lines FROM normal GROUP BY doc_id
), frequent AS (
    SELECT host, key, min(doc_id) AS keeper FROM normal GROUP BY host, key HAVING count(DISTINCT text) > 20
), lost AS (
    SELECT l.doc_id, sum(l.n)::BIGINT AS n FROM normal l JOIN frequent f ON l.key = f.key AND l.host IS NOT DISTINCT FROM f.host
    WHERE l.doc_id <> f.keeper GROUP BY l.doc_id
), judged AS (
    SELECT d.doc_id, len(d.words)::BIGINT AS n_words, length(regexp_replace(d.text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
        (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]+', '', 'g')))::BIGINT AS n_symbols,
        coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(r.n_repeat_words, 0)::BIGINT AS n_repeat_words,
        len(d.words)::BIGINT - coalesce(l.n, 0) AS n_left, l.n IS NOT NULL AS touched
    FROM docs d LEFT JOIN doubles u USING (doc_id) LEFT JOIN repeats r USING (doc_id) LEFT JOIN lost l USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    n_left, touched AND (n_left < 10 OR n_left < 0.3 * n_words) AS depleted,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND NOT (touched AND (n_left < 10 OR n_left < 0.3 * n_words)) AS kept
FROM judged
""")
def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules.judge(documents(spark, folder)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_left", "depleted", "kept"
    )


@query("op8_quality_classifier")
def op8_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    return quality_classifier.classify(documents(spark, folder), quality_classifier.labels_of(spark, folder))


@query("op9_fingerprints")
def op9_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    return minhash.compare_with_next(documents(spark, folder))


@query("op10_mixing", r"""
WITH sized AS (
    SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents
), totals AS (
    SELECT source, sum(size)::BIGINT AS n FROM sized GROUP BY source
), weighed AS (
    SELECT source, n, [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w FROM totals
), filling AS (  -- sources in the order in which they reach their cap
    SELECT *, row_number() OVER (ORDER BY 3 * n / w, source) AS k, sum(n) OVER () AS budget,
        (sum(n) OVER () - 3 * (sum(n) OVER before))::DOUBLE / (sum(w) OVER () - (sum(w) OVER before)) AS unit_ahead
    FROM (SELECT *, 0 AS x FROM weighed)
    WINDOW before AS (ORDER BY 3 * n / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), units AS (
    SELECT *, coalesce(unit_ahead, budget::DOUBLE / (SELECT sum(w) FROM weighed)) AS unit FROM filling
), level AS (
    SELECT min_by(unit, k) AS unit, min(k) AS k FROM units WHERE w * unit < 3 * n
), targets AS (
    SELECT u.source, u.n, CASE WHEN l.k IS NULL OR u.k < l.k THEN (3 * u.n)::DOUBLE ELSE u.w * l.unit END AS target FROM units u, level l
), planned AS (
    SELECT *, CASE WHEN n = 0 THEN 0 ELSE least(3, floor(target / n))::BIGINT END AS whole FROM targets
), drawn AS (
    SELECT s.*, p.n, p.target, p.whole, round(p.target - p.whole * p.n)::BIGINT AS rest,
        ('0x' || substr(md5(concat_ws(':', '17', doc_id, size)), 1, 15))::BIGINT AS draw
    FROM sized s JOIN planned p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, n AS source_size, target, (whole * size + greatest(0, least(size, rest - coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY draw % 16384, draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))))::BIGINT AS taken
FROM drawn
""")
def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.plan(documents(spark, folder)).select("doc_id", "size", "source_size", "target", "taken")


@query("op11_resampling", r"""
WITH table_of AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, i)) AS crcs
), docs AS (
    SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM documents
), aims AS (
    SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
    FROM benchmark
), corpus AS (
    SELECT doc_id, unnest(list_concat(words, list_transform(range(1, greatest(1, len(words))), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM docs
), wanted AS (
    SELECT unnest(list_concat(words, list_transform(range(1, greatest(1, len(words))), lambda i: words[i] || ' ' || words[i + 1]))) AS feature FROM aims
), per_feature AS (
    SELECT feature, sum(s)::BIGINT AS s, sum(t)::BIGINT AS t
    FROM (SELECT feature, 1 AS s, 0 AS t FROM corpus UNION ALL SELECT feature, 0, 1 FROM wanted) GROUP BY feature
), hashed AS (
    SELECT feature, s, t, xor(4294967295, list_reduce(
        list_transform(range(octet_length(encode(feature))), lambda i: ('0x' || substr(hex(encode(feature)), 2 * i + 1, 2))::BIGINT),
        lambda c, b: xor(c // 256, crcs[xor(c, b) % 256 + 1]), 4294967295)) % 10000 AS bucket
    FROM per_feature, table_of
), buckets AS (
    SELECT bucket, sum(s) AS s, sum(t) AS t, sum(sum(s)) OVER () AS all_s, sum(sum(t)) OVER () AS all_t FROM hashed GROUP BY bucket
), gains AS (
    SELECT bucket, floor(1000 * ln(((t + 1)::DOUBLE * (all_s + 10000)::DOUBLE) / ((s + 1)::DOUBLE * (all_t + 10000)::DOUBLE)))::BIGINT AS gain FROM buckets
), weighed AS (
    SELECT c.doc_id, count(*) AS n_features, floor(sum(g.gain)::DOUBLE / count(*))::BIGINT AS weight
    FROM corpus c JOIN hashed h USING (feature) JOIN gains g USING (bucket) GROUP BY c.doc_id
), scored AS (
    SELECT d.doc_id, len(d.words) AS n_words, coalesce(w.n_features, 0)::BIGINT AS n_features, coalesce(w.weight, 0)::BIGINT AS weight,
        coalesce(w.weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('7:' || coalesce(d.doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score
    FROM docs d LEFT JOIN weighed w ON d.doc_id IS NOT DISTINCT FROM w.doc_id
), ranked AS (
    SELECT doc_id, n_features, weight, score, n_words, count(*) FILTER (WHERE n_words >= 20) OVER () AS n,
        row_number() OVER (ORDER BY n_words < 20, score DESC, doc_id NULLS LAST, n_features) AS r
    FROM scored
)
SELECT doc_id, n_features, weight, score, CASE WHEN n_words >= 20 AND r <= 25 * n // 100 THEN r END AS rank FROM ranked
""")
def op11_resampling(spark: SparkSession, folder: str) -> DataFrame:
    return resampling.resample(documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))


@query("op12_filter_audit", r"""
WITH docs AS (
    SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words
    FROM documents
), failed AS (
    SELECT doc_id, part,
        CASE WHEN len(words) < 100 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 2 ELSE 0 END
        + CASE WHEN 100 * (length(text) - length(regexp_replace(text, '[A-Z]', '', 'g'))) > 10 * length(text) THEN 4 ELSE 0 END
        + CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 8 ELSE 0 END
        + CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY text) OR (doc_id IS NULL AND min(doc_id) OVER (PARTITION BY text) IS NOT NULL) THEN 16 ELSE 0 END AS mask
    FROM docs
), judged AS (
    SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id
), counts AS (
    SELECT part, mask, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic
    FROM failed LEFT JOIN judged USING (doc_id) GROUP BY part, mask
), letters AS (
    SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit
), orders AS (
    SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits
    FROM letters a, letters b, letters c, letters d, letters e WHERE a.bit | b.bit | c.bit | d.bit | e.bit = 31
), steps AS (
    SELECT filter_order, step, bits[step] AS bit, coalesce(list_sum(bits[:step - 1]), 0)::INT AS before FROM orders, (SELECT unnest(range(1, 6)) AS step)
), audited AS (
    SELECT part, filter_order, step, bit,
        coalesce(sum(n) FILTER (WHERE mask & (before | bit) = 0), 0)::BIGINT AS kept,
        coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS removed,
        coalesce(sum(n) FILTER (WHERE mask & bit <> 0 AND mask & before <> 0), 0)::BIGINT AS redundant,
        coalesce(sum(n) FILTER (WHERE mask = bit), 0)::BIGINT AS unique_fails,
        coalesce(sum(good) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS good_lost,
        coalesce(sum(toxic) FILTER (WHERE mask & bit <> 0 AND mask & before = 0), 0)::BIGINT AS toxic_lost
    FROM counts, steps GROUP BY part, filter_order, step, bit
)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
    (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley
FROM audited
""")
def op12_filter_audit(spark: SparkSession, folder: str) -> DataFrame:
    return filter_audit.audit(documents(spark, folder), spark.read.parquet(f"{folder}/labels.parquet"))


@query("op13_minhash_dedup", r"""
WITH RECURSIVE docs AS (
    SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS words FROM documents
), sets AS (
    SELECT doc_id, list_distinct(CASE WHEN words IS NULL OR len(words) = 0 THEN [] WHEN len(words) < 3 THEN [array_to_string(words, ' ')]
        ELSE list_transform(range(1, len(words) - 1), lambda i: words[i] || ' ' || words[i + 1] || ' ' || words[i + 2]) END) AS shingles
    FROM docs
), same AS (
    SELECT min(doc_id) AS node, list_sort(shingles) AS shingles, len(shingles) AS n FROM sets GROUP BY list_sort(shingles), len(shingles)
), members AS (
    SELECT s.doc_id, len(s.shingles) AS n, CASE WHEN len(s.shingles) = 0 THEN s.doc_id ELSE same.node END AS node
    FROM sets s JOIN same ON list_sort(s.shingles) = same.shingles
), posted AS (
    SELECT node, n, unnest(shingles) AS shingle FROM same
), links AS (
    SELECT a.node AS u, b.node AS v FROM posted a JOIN posted b ON a.shingle = b.shingle AND a.node < b.node AND 100 * least(a.n, b.n) >= 85 * greatest(a.n, b.n)
    GROUP BY a.node, b.node, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), edges AS (
    SELECT u, v FROM links UNION SELECT v, u FROM links
), reached AS (
    SELECT node AS origin, node AS met FROM members UNION SELECT r.origin, e.v FROM reached r JOIN edges e ON r.met = e.u
), named AS (
    SELECT origin, min(met) AS component_id FROM reached GROUP BY origin
)
SELECT m.doc_id, m.n::BIGINT AS n_shingles, c.component_id, m.doc_id = c.component_id AS kept FROM members m JOIN named c ON m.node = c.origin
""")
def op13_minhash_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return minhash_dedup.near_duplicates(documents(spark, folder))
