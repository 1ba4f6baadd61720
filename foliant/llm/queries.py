"""The subpackage's queries by name, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm import bpe, decontaminate, lm_score, ordinal, passages, quality_rules, secrets, simhash, url_filter, warc
from foliant.llm.common import documents, shared_path

RANKS = "byte_bpe_multi_50k.tiktoken"


def op1_byte_level_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode_documents(documents(spark, sf_dir), public_tokenizers.path(RANKS), public_tokenizers.PATTERN, outputs=("ids_text", "decoded"))
    return coded.select("doc_id", "n_tokens", F.sha2(F.col("ids_text").cast("binary"), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    led = quality_rules.apply_policy(quality_rules.ledger(documents(spark, sf_dir)), "v1")
    failed = F.col("failed_bits").bitwiseAND(F.lit(quality_rules.mask("base"))) != 0
    return led.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), "kept", "failed_bits")


def op3_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


#: Host with path prefix, and what it decides.
URL_RULES = {"org/": "allow", "example.org/es/": "block", "example.org/en/1": "block", "com/fr/": "allow", "com/de/": "block"}


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The listed hosts, in place of a feed of them, are all hosts of the corpus whose first label is blog."""
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    feed = pages.select(url_filter.host_of(F.col("url")).alias("key")).where(F.col("key").startswith("blog.")).distinct()
    return url_filter.judge(pages, URL_RULES, feed).select("page_id", "host", "path", "rule", "verdict", "listed")


def op8_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(documents(spark, sf_dir)))


def op4_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.score(documents(spark, sf_dir))


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = ordinal.graded(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    found = ordinal.classify(documents(spark, sf_dir), labels)
    return found.select("doc_id", "expected_grade", F.col("tail")[0].alias("p_not_toxic"), F.col("tail")[1].alias("p_good"), "kept")


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(documents(spark, sf_dir))
    return found.select("doc_id", F.lpad(F.lower(F.hex("code")), 16, "0").alias("fingerprint"), "component_id")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.remove_repeats(documents(spark, sf_dir)).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op10_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_path(spark, "warc")
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    warc.write_archives(warc.deduplicated(spark, warc.headers(pages)), path)
    records = warc.read_archives(spark, path, blocks=False)
    return records.select(F.col("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", "refers_to")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline  # which itself imports this module

    return corpus_pipeline.run(spark, sf_dir)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_byte_level_bpe": op1_byte_level_bpe,
    "op2_quality_rules": op2_quality_rules,
    "op3_decontamination": op3_decontamination,
    "op4_lm_score": op4_lm_score,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash": op6_simhash,
    "op7_url_filter": op7_url_filter,
    "op8_secret_scan": op8_secret_scan,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_warc": op10_warc,
    "pipeline": pipeline,
}

#: Words as in the queries.
_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

ORACLES: dict[str, str] = {
    "op2_quality_rules": rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i+1] || ' ' || w[i+2] AS s FROM d, unnest(range(1, len(w) - 1)) AS r(i)),
c AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words FROM c, unnest(range(0, 3)) AS r(k) WHERE n > 1 GROUP BY doc_id),
l AS (SELECT doc_id, count(*) AS n_lines, count(*) - count(DISTINCT x) AS n_dup_lines FROM d, unnest(string_split(t, chr(10))) AS r(x) WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum([length(x) for x in w]), 0)::BIGINT AS word_chars,
  length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words,
  coalesce(n_lines, 0) AS n_lines, length(regexp_replace(t, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(t, '[^a-z]', '', 'g')) AS n_lower
  FROM d LEFT JOIN p USING (doc_id) LEFT JOIN l USING (doc_id)),
b AS (SELECT *, (CASE WHEN n_words < 50 THEN 1 ELSE 0 END + CASE WHEN 100 * n_repeat_words > 50 * n_words THEN 2 ELSE 0 END + CASE WHEN 10 * n_symbols > n_words THEN 4 ELSE 0 END
  + CASE WHEN 100 * n_dup_lines > 40 * n_lines THEN 8 ELSE 0 END + CASE WHEN word_chars < 3 * n_words THEN 16 ELSE 0 END + CASE WHEN word_chars > 10 * n_words THEN 32 ELSE 0 END
  + CASE WHEN n_upper > n_lower THEN 64 ELSE 0 END)::BIGINT AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (failed_bits & 3) <> 0 AS base_failed, failed_bits = 0 AS kept, failed_bits FROM b""",
    "op3_decontamination": r"""
WITH s AS (SELECT item_id AS id, 0 AS side, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') AS w FROM benchmark
  UNION ALL SELECT doc_id, 1, list_filter(regexp_split_to_array(lower(coalesce(text, '')), '[^\p{L}\p{N}]+'), lambda x: x <> '') FROM documents),
g AS (SELECT DISTINCT id, side, array_to_string(w[i:i+4], ' ') AS g FROM s, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS r(i) WHERE len(w) > 0),
q AS (SELECT id, count(*) AS n FROM g WHERE side = 0 GROUP BY id)
SELECT d.id AS doc_id, b.id AS item_id, any_value(q.n) AS n_shingles, count(*) AS n_shared FROM g AS b JOIN g AS d ON b.g = d.g AND b.side = 0 AND d.side = 1 JOIN q ON q.id = b.id
GROUP BY ALL HAVING 5 * count(*) >= 4 * any_value(q.n)""",
    "op7_url_filter": r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages),
p AS (SELECT page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(r, '^[^/?#]*([^?#]*)', 1) AS path FROM u),
rules(rule, act) AS (VALUES ('org/', 'allow'), ('example.org/es/', 'block'), ('example.org/en/1', 'block'), ('com/fr/', 'allow'), ('com/de/', 'block')),
f AS (SELECT p.*, (SELECT max_by(struct_pack(rule := rule, act := act), length(rule)) FROM rules
  WHERE (host = split_part(rule, '/', 1) OR ends_with(host, '.' || split_part(rule, '/', 1))) AND starts_with(path, substr(rule, strpos(rule, '/')))) AS m FROM p)
SELECT page_id, host, path, m.rule AS rule, coalesce(m.act, CASE WHEN starts_with(host, 'blog.') THEN 'block' ELSE 'allow' END) AS verdict, starts_with(host, 'blog.') AS listed FROM f""",
    "op10_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
x AS (SELECT page_id, octet_length(encode(h))::BIGINT AS payload_bytes, sha1(h) AS s, h FROM p),
d AS (SELECT page_id, payload_bytes, (SELECT string_agg(substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(s, 1 + 5 * k, 5))::BIGINT >> (15 - 5 * j)) & 31)::INT, 1), '' ORDER BY k, j)
  FROM unnest(range(0, 8)) AS a(k), unnest(range(0, 4)) AS b(j)) AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first_id FROM x)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d""",
}
