"""Registered queries of the operators and their DuckDB SQL twins."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quayside.llm import (attribution, exact_dedup, filter_audit, langid, line_crf, mixing, packing, quality, sketch_join, spelling,
                          token_files, toxicity, warc)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.read(spark, token_files.write(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json")))


def op3_warc_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.read(spark, warc.write(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op4_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sketch_join.similar_groups(documents(spark, sf_dir), size=4, percent=85)


def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    langs, matrix = langid.learn(docs.where(~langid.held_out()))
    return langid.predict(docs, langs, matrix).withColumn("held_out", langid.held_out())


def op6_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").withColumn("low_quality", 1 - F.col("quality"))
    return toxicity.predict(docs, toxicity.fit(docs, labels, ["toxic", "low_quality"]))


def op7_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed_documents(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_quality_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    judged = quality.cascade(docs, report=quality.REPORTED).drop("rejected_by")
    base = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.withColumn("base_failed", base)


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_groups(documents(spark, sf_dir), keep="largest")


def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.attribute(documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), "most")


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return filter_audit.audit(filter_audit.cells(filter_audit.failures(documents(spark, sf_dir), labels)))


def op12_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet")
    field = line_crf.fit(docs, labels.where(~line_crf.held_out()))
    return line_crf.predict(docs, field).withColumn("held_out", line_crf.held_out())


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(spelling.word_counts(documents(spark, sf_dir)))


QUERIES = {
    "op1_source_mix": op1_source_mix,
    "op2_token_files": op2_token_files,
    "op5_language": op5_language,
    "op6_toxicity_chain": op6_toxicity_chain,
    "op7_best_fit_packing": op7_best_fit_packing,
    "op3_warc_segments": op3_warc_segments,
    "op4_sketch_join": op4_sketch_join,
    "op8_quality_cascade": op8_quality_cascade,
    "op9_exact_dedup": op9_exact_dedup,
    "op10_section_tokens": op10_section_tokens,
    "op11_filter_audit": op11_filter_audit,
    "op12_line_quality": op12_line_quality,
    "op13_spelling_variants": op13_spelling_variants,
}

_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

# Words, and per document the 3-word windows that occur at least twice.
_QUALITY = """
        WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        win AS (SELECT doc_id, i, w[i] AS a, w[i + 1] AS b, w[i + 2] AS c
                FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
        rep AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, a, b, c) AS n FROM win) WHERE n > 1),
        cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM rep) GROUP BY doc_id),
        lines AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup
                  FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS x FROM d)
                  WHERE regexp_matches(x, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
        f AS (SELECT d.doc_id, len(w) AS n_words,
                     coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
                     length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
                     coalesce(n_dup, 0) AS n_dup_lines, coalesce(n_lines, 0) AS n_lines, coalesce(cov.n, 0) AS n_repeat_words,
                     length(t) - length(replace(t, '!', '')) AS n_marks,
                     len(list_filter(w, lambda x: upper(x) = x AND lower(x) <> x)) AS n_upper
              FROM d LEFT JOIN cov ON cov.doc_id = d.doc_id LEFT JOIN lines ON lines.doc_id = d.doc_id),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
                     100 * n_symbols > 20 * n_words OR 100 * n_marks > 50 * n_words OR 100 * n_upper > 60 * n_words
                     OR (n_dup_lines >= 4 AND 100 * n_dup_lines > 50 * n_lines) AS more_failed FROM f)
"""

# Shingle sets, links and what they reach.
_SIMILAR = f"""
        WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        s AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 3), ' ') AS x
              FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 2))) AS i FROM w WHERE len(w) > 0)),
        n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
        meet AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY ALL),
        links AS (SELECT a, b FROM meet JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * i >= 85 * (p.n + q.n - i)),
        reach(a, b) AS (SELECT a, b FROM links UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a)
"""

ORACLE = {
    "op3_warc_segments": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha256(coalesce(html, '')) AS h FROM pages),
        q AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY h) ELSE page_id END AS first FROM p)
        SELECT page_id, n AS payload_bytes, h AS payload_digest,
               CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
               CASE WHEN first <> page_id THEN first END AS refers_to FROM q
    """,
    "op4_sketch_join": _SIMILAR + """
        SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles,
               least(w.doc_id, coalesce((SELECT min(b) FROM reach WHERE reach.a = w.doc_id), w.doc_id)) AS component_id
        FROM w LEFT JOIN n ON n.doc_id = w.doc_id
    """,
    "op8_quality_cascade": _QUALITY + """
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
               NOT base_failed AND NOT more_failed AS kept FROM v
    """,
    "op9_exact_dedup": f"""
        WITH d AS (SELECT doc_id, {_LOWERED} AS t FROM documents)
        SELECT doc_id,
               max(doc_id) OVER (PARTITION BY t) AS keep_id,
               count(*) OVER (PARTITION BY t) AS group_size,
               doc_id IS NOT DISTINCT FROM max(doc_id) OVER (PARTITION BY t) AS kept,
               sha256(t) AS text_sha256
        FROM d
    """,
    "op11_filter_audit": """
        WITH d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
                          regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
        f AS (SELECT doc_id, part,
                     (len(w) < 200)::INT + 2 * (100 * len(list_distinct(w)) < 50 * len(w))::INT
                     + 4 * (100 * (length(t) - length(regexp_replace(t, '[A-Z]', '', 'g'))) > 3 * length(t))::INT
                     + 8 * regexp_matches(t, '[#$%&*|]')::INT
                     + 16 * coalesce(doc_id > min(doc_id) OVER (PARTITION BY t), false)::INT AS mask FROM d),
        l AS (SELECT doc_id, coalesce(max(quality), 0) = 1 AS good, coalesce(max(toxic), 0) = 1 AS toxic FROM labels GROUP BY doc_id),
        c AS (SELECT part, mask, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (toxic) AS x
              FROM f LEFT JOIN l USING (doc_id) GROUP BY part, mask),
        s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS s),
        o AS (SELECT a.s || b.s || c.s || d.s || e.s AS o FROM s a, s b, s c, s d, s e
              WHERE len(list_distinct([a.s, b.s, c.s, d.s, e.s])) = 5),
        k AS (SELECT o, i, ord(o[i]) - 65 AS bit, list_sum(list_transform(range(1, i), lambda j: 1 << (ord(o[j]) - 65)))::INT AS early
              FROM o, (SELECT unnest(range(1, 6)) AS i)),
        z AS (SELECT part, o AS filter_order, i::INT AS step, bit,
                     sum(CASE WHEN mask & coalesce(early, 0) = 0 AND (mask >> bit) & 1 = 0 THEN n ELSE 0 END)::BIGINT AS kept,
                     sum(CASE WHEN mask & coalesce(early, 0) = 0 AND (mask >> bit) & 1 = 1 THEN n ELSE 0 END)::BIGINT AS removed,
                     sum(CASE WHEN mask & coalesce(early, 0) <> 0 AND (mask >> bit) & 1 = 1 THEN n ELSE 0 END)::BIGINT AS redundant,
                     sum(CASE WHEN mask = 1 << bit THEN n ELSE 0 END)::BIGINT AS unique_fails,
                     sum(CASE WHEN mask & coalesce(early, 0) = 0 AND (mask >> bit) & 1 = 1 THEN g ELSE 0 END)::BIGINT AS good_lost,
                     sum(CASE WHEN mask & coalesce(early, 0) = 0 AND (mask >> bit) & 1 = 1 THEN x ELSE 0 END)::BIGINT AS toxic_lost
              FROM c, k GROUP BY part, o, i, bit)
        SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
               (sum(removed) OVER (PARTITION BY part, bit))::BIGINT AS shapley FROM z
    """,
}
