"""The registered queries of this subpackage and their reference SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from treeline.llm import (
    collocations,
    decontaminate,
    htmltext,
    mixing,
    quality_model,
    quality_rules,
    secretscan,
    simhash,
    tokenfiles,
    toxicity,
    urlfilter,
    warc,
    whitening,
)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_warc(spark: SparkSession, folder: str) -> DataFrame:
    records = warc.read_warc(warc.archive(spark, table(spark, folder, "pages")), keep_payload=False)
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), toxicity.held_out("doc_id", 5, 0)
    labels = table(spark, folder, "labels").filter(~held).select("doc_id", "toxic")
    scored = toxicity.score(docs, toxicity.fit(docs, labels))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


def op3_secrets(spark: SparkSession, folder: str) -> DataFrame:
    found = secretscan.scan(table(spark, folder, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


#: Fixed values of the registered list: verdict, host, path.
URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


def op4_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    judged = urlfilter.judge_urls(table(spark, folder, "pages"), URL_RULES)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op5_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.scan(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


WORD_TOKENIZER = "word_bpe_49k.json"
END_ID = 2


def op6_token_files(spark: SparkSession, folder: str) -> DataFrame:
    rows = tokenfiles.token_files(table(spark, folder, "documents"), public_tokenizers.path(WORD_TOKENIZER), END_ID)
    return rows.select("doc_id", F.col("first").alias("start"), "n_tokens", "ids_crc32")


def op7_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    judged = quality_rules.judge(table(spark, folder, "documents"))
    return judged.select("doc_id", *quality_rules.MEASURES, "base_failed", "kept")


def op8_simhash(spark: SparkSession, folder: str) -> DataFrame:
    groups = simhash.near_groups(table(spark, folder, "documents"))
    return groups.select("doc_id", F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id")


def op9_quality_model(spark: SparkSession, folder: str) -> DataFrame:
    docs, held = table(spark, folder, "documents"), toxicity.held_out("doc_id", 3, 1)
    labels = table(spark, folder, "labels").filter(~held).select("doc_id", "quality")
    rows = quality_model.measured(docs)
    scored = quality_model.score(rows, quality_model.fit(rows, labels))
    predicted = F.when(F.col("score") >= 0.5, 1).otherwise(0)
    return scored.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"))


def op10_mixing(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.taken_words(table(spark, folder, "documents"))


def op11_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows = whitening.whiten(table(spark, folder, "embeddings"))
    return rows.withColumn("deviation", F.col("deviation").try_cast("long"))


def op12_html_text(spark: SparkSession, folder: str) -> DataFrame:
    return htmltext.extract(table(spark, folder, "pages"))


def op13_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.phrases(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: query for name, query in list(globals().items()) if name.startswith("op") and name[2:3].isdigit()
}

SQL: dict[str, str] = {
    "op1_warc": """
        WITH p AS (
            SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes,
                   sha256(coalesce(html, '')) AS payload_digest
            FROM pages
        ), r AS (
            SELECT *, CASE WHEN payload_bytes >= 100
                           THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS original
            FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
               CASE WHEN page_id IS DISTINCT FROM original THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN page_id IS DISTINCT FROM original THEN original END AS refers_to
        FROM r
    """,
    "op4_url_filter": """
        WITH rules(verdict, host, path) AS (
            VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
                   ('block', 'net', '/es/'), ('block', 'net', '/fr/')
        ), p AS (
            SELECT page_id,
                   CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest
            FROM pages
        ), u AS (
            SELECT page_id,
                   translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                             'abcdefghijklmnopqrstuvwxyz') AS host,
                   regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path
            FROM p
        )
        SELECT u.page_id, any_value(u.host) AS host, any_value(u.path) AS path,
               arg_max(r.host || r.path, length(r.host || r.path)) AS rule,
               coalesce(arg_max(r.verdict, length(r.host || r.path)), 'allow') AS verdict
        FROM u LEFT JOIN rules r
          ON (u.host = r.host OR ends_with(u.host, '.' || r.host)) AND starts_with(u.path, r.path)
        GROUP BY u.page_id
    """,
    "op5_decontaminate": r"""
        WITH d AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM documents
        ), b AS (
            SELECT item_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
            FROM benchmark
        ), bw AS (
            SELECT DISTINCT item_id, least(len(words), 10) AS width,
                   array_to_string(words[i:i + least(len(words), 10) - 1], ' ') AS gram
            FROM (SELECT *, unnest(range(1, len(words) - least(len(words), 10) + 2)) AS i FROM b WHERE len(words) > 0)
        ), dw AS (
            SELECT doc_id, i, width, array_to_string(words[i:i + width - 1], ' ') AS gram
            FROM (SELECT d.*, width, unnest(range(1, len(words) - width + 2)) AS i
                  FROM d CROSS JOIN (SELECT DISTINCT width FROM bw) WHERE len(words) >= width)
        ), hits AS (
            SELECT doc_id, i, dw.width, item_id FROM dw JOIN bw USING (width, gram)
        ), hit_words AS (
            SELECT doc_id, count(DISTINCT w) AS n_hit
            FROM (SELECT doc_id, unnest(range(i, i + width)) AS w FROM hits) GROUP BY doc_id
        ), hit_items AS (
            SELECT doc_id, count(DISTINCT item_id) AS n_items,
                   string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
            FROM hits GROUP BY doc_id
        )
        SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit,
               coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
               n_hit IS NOT NULL AS contaminated
        FROM d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
    """,
    "op7_quality_rules": r"""
        WITH t AS (
            SELECT doc_id, coalesce(text, '') AS text,
                   regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words,
                   list_filter(string_split(coalesce(text, ''), chr(10)),
                               lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
            FROM documents
        ), w AS (
            SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS n
            FROM (SELECT doc_id, i, words[i:i + 7] AS gram
                  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 6)) AS i FROM t WHERE len(words) >= 8))
        ), r AS (
            SELECT doc_id, count(DISTINCT p) AS n_repeat_words
            FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM w WHERE n > 1) GROUP BY doc_id
        ), m AS (
            SELECT t.doc_id, CAST(len(words) AS BIGINT) AS n_words,
                   CAST(length(array_to_string(words, '')) AS BIGINT) AS word_chars,
                   CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
                   CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
                   coalesce(n_repeat_words, 0) AS n_repeat_words, len(lines) AS n_lines,
                   length(regexp_replace(text, '\P{Lu}+', '', 'g')) AS n_upper,
                   length(regexp_replace(text, '[^!]+', '', 'g')) AS n_marks,
                   len(list_filter(list_zip(words[1:-2], words[2:]), lambda x: x[1] = x[2])) AS n_stutter
            FROM t LEFT JOIN r USING (doc_id)
        ), f AS (
            SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM m
        )
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT (base_failed OR 20 * n_symbols > word_chars OR 2 * n_upper > word_chars OR 2 * n_marks > n_words
                    OR 2 * (n_lines - n_dup_lines) < n_lines OR 10 * n_stutter > 3 * n_words) AS kept
        FROM f
    """,
    "op13_collocations": r"""
        WITH pieces AS (
            SELECT coalesce(lang, 'und') AS lang,
                   unnest(string_split_regex(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[.,;:!?\x0A-\x0D]')) AS piece
            FROM documents
        ), w AS (
            SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM pieces
        ), g AS (
            SELECT lang, size, words[i:i + size - 1] AS phrase, count(*) AS f
            FROM (SELECT lang, words, size, unnest(range(1, len(words) - size + 2)) AS i
                  FROM w CROSS JOIN (VALUES (1), (2), (3), (4)) s(size) WHERE len(words) >= size)
            GROUP BY ALL
        ), c AS (
            SELECT * FROM g WHERE size >= 2 AND f >= 30
        ), cuts AS (
            SELECT c.lang, c.phrase, c.f AS a, k, one.f AS l, two.f AS r,
                   2000000::HUGEINT * c.f // (one.f + two.f)::HUGEINT AS score
            FROM (SELECT lang, phrase, f, size AS width, unnest(range(1, size)) AS k FROM c) c
            JOIN g one ON one.lang = c.lang AND one.phrase = c.phrase[1:k]
            JOIN g two ON two.lang = c.lang AND two.phrase = c.phrase[k + 1:c.width]
        ), best AS (
            SELECT lang, phrase, a, k, l, r, score FROM cuts
            QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
        ), inner_parts AS (
            SELECT lang, f, phrase[i:i + part - 1] AS phrase
            FROM (SELECT lang, phrase, size, f, part, unnest(range(1, size - part + 2)) AS i
                  FROM c CROSS JOIN (VALUES (2), (3)) s(part) WHERE part < size)
        ), absorbed AS (
            SELECT lang, phrase, max(f) AS longer FROM inner_parts GROUP BY ALL
        ), kept AS (
            SELECT b.*, array_to_string(b.phrase, ' ') AS spelled
            FROM best b LEFT JOIN absorbed x USING (lang, phrase)
            WHERE x.longer IS NULL OR 100::HUGEINT * x.longer < 80::HUGEINT * b.a
        ), ranked AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, spelled) AS rank FROM kept
        ), totals AS (
            SELECT lang, CAST(sum(f) AS BIGINT) AS n FROM g WHERE size = 1 GROUP BY lang
        )
        SELECT lang, rank, spelled AS phrase, a, l, r, n, CAST(score AS BIGINT) AS score
        FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
    """,
}
