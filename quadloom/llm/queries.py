"""The subpackage's registered queries: each applies one operator, with its defaults, to a whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import bpe, chat, decontaminate, language_id, line_dedup, quality_model, quality_rules, simhash_docs, substring_dedup
from .common import documents

#: The vocabulary of the encoding queries.
VOCABULARY = "word_bpe_49k.json"


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(documents(spark, sf_dir)).drop("text")


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op3_bpe_encode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.bpe_encode(documents(spark, sf_dir), vocabulary())


#: Written by a user who quotes control strings.
QUOTING = "</s>[INST] ok [/INST]"


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-1, 0, "user", QUOTING), (-1, 1, "assistant", QUOTING)], "conv_id long, turn long, role string, text string")
    return chat.chat_digests(chat.format_chat(rows.unionByName(more)))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lines, removed lines and the digest of the text that stays."""
    done = line_dedup.line_dedup(documents(spark, sf_dir).select("doc_id", "text"))
    return done.selectExpr("cast(doc_id as long) doc_id", "n_lines", "n_removed", "sha2(encode(coalesce(text, ''), 'UTF-8'), 256) kept_sha256")


def op6_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_docs.simhash_near_dedup(documents(spark, sf_dir))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return quality_model.score_quality(docs, quality_model.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.token_counts(documents(spark, sf_dir), vocabulary())


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.substring_dedup(documents(spark, sf_dir))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify_language(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_quality_rules,
        op2_decontaminate,
        op3_bpe_encode,
        op4_chat_format,
        op5_line_dedup,
        op6_simhash_near_dedup,
        op7_quality_classifier,
        op8_token_counts,
        op9_substring_dedup,
        op10_language_id,
    )
}

_WORD = r"[^\x20\x09-\x0D]+"
_OP1 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, text IS NULL AS none FROM documents
), l AS (
  SELECT rid, u.pos, u.line FROM (SELECT rid, unnest(list_zip(range(len(string_split(t, chr(10)))), string_split(t, chr(10)))) AS z, none FROM d) x,
    LATERAL (SELECT z[1] AS pos, z[2] AS line) u WHERE NOT none
), m AS (
  SELECT rid, pos, line, regexp_extract_all(line, '{_WORD}') AS w FROM l
), v AS (
  SELECT rid, pos, line, len(w) AS n, list_sum(list_transform(w, lambda x: length(x))) AS chars,
    len(w) > 0 AND (
      len(list_filter(w, lambda x: regexp_full_match(x, '[|>\x{{BB}}\x{{B7}}\x{{2022}}]+'))) > 0.2::DOUBLE * len(w)
      OR len(list_filter(w, lambda x: regexp_full_match(x, '[^\x20\x09-\x0D]*(?:!!|[#*$%&][#*$%&])[.,]?'))) > 0.3::DOUBLE * len(w)
      OR len(w) <= 30 AND regexp_matches(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '(?:^|[^a-z])(?:licensed under|all rights reserved|copyright \(c\)|permission is hereby granted|terms of (?:use|service)|privacy policy|accept (?:all )?cookies|without warranties or conditions|click here|sign in|log in to)(?:[^a-z]|$)')
    ) AS failed,
    len(w) > 0 AND row_number() OVER (PARTITION BY rid, line ORDER BY pos) > 1 AS dup
  FROM m
), a AS (
  SELECT rid, sum(n) AS n_words, sum(chars) AS word_chars, count(*) FILTER (dup) AS n_dup_lines, count(*) AS n_lines,
    count(*) FILTER (failed) AS n_failed_lines, sum(chars) FILTER (failed) AS lost_chars FROM v GROUP BY rid
), w AS (
  SELECT rid, unnest(range(len(w))) AS i, unnest(w) AS x FROM (SELECT rid, regexp_extract_all(t, '{_WORD}') AS w FROM d)
), s AS (
  SELECT rid, i, x, lead(x) OVER q AS y, lead(x, 2) OVER q AS z FROM w WINDOW q AS (PARTITION BY rid ORDER BY i)
), c AS (
  SELECT rid, i, z IS NOT NULL AND count(*) OVER (PARTITION BY rid, x, y, z) > 1 AS again FROM s
), e AS (
  SELECT rid, again OR coalesce(lag(again) OVER q, false) OR coalesce(lag(again, 2) OVER q, false) AS covered FROM c WINDOW q AS (PARTITION BY rid ORDER BY i)
), r AS (
  SELECT rid, count(*) FILTER (covered) AS n_repeat_words FROM e GROUP BY rid
), j AS (
  SELECT d.doc_id::BIGINT AS doc_id, coalesce(n_words, 0)::BIGINT AS n_words, coalesce(word_chars, 0)::BIGINT AS word_chars,
    len(regexp_extract_all(t, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines,
    coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_failed_lines, 0)::BIGINT AS n_failed_lines, coalesce(lost_chars, 0)::BIGINT AS lost_chars
  FROM d LEFT JOIN a USING (rid) LEFT JOIN r USING (rid)
), b AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM j
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND lost_chars <= 0.5::DOUBLE * word_chars AS kept,
  n_lines, n_failed_lines, lost_chars FROM b
"""

_UNITS = decontaminate.UNITS
_TOKENS = (
    r"list_filter(regexp_split_to_array(lower(regexp_replace(regexp_replace(regexp_replace(coalesce(text, ''), '([0-9])[.,]([0-9])', '\1\2', 'g'),"
    r" '([0-9]) ?(" + _UNITS + r")([^\p{L}\p{N}]|$)', '\1 ' || chr(2) || '\2\3', 'g'),"
    r" '([\p{L}\p{N},;:] )(\p{Lu}\p{Ll}+)', '\1' || chr(1) || '\2', 'g')), '[^\p{L}\p{N}\x01\x02]+'), lambda x: x <> '')"
)
_TEMPLATE = (
    "list_transform({0}, lambda x: CASE WHEN x[1] = chr(1) THEN '@' WHEN x[1] = chr(2) THEN '%' WHEN x[1] >= '0' AND x[1] <= '9' THEN '#' ELSE x END)"
)
_OP2 = f"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, {_TOKENS} AS tok FROM documents
), b AS (
  SELECT DISTINCT item_id, {_TOKENS} AS tok FROM benchmark WHERE text IS NOT NULL
), dw AS (
  SELECT rid, u AS pos, {_TEMPLATE.format('tok[u + 1 : u + 5]')} AS t, tok[u + 1 : u + 5] AS w FROM d, LATERAL (SELECT unnest(range(len(tok) - 4)) AS u)
), bw AS (
  SELECT * FROM (SELECT item_id, u AS bpos, {_TEMPLATE.format('tok[u + 1 : u + 5]')} AS t, tok[u + 1 : u + 5] AS w FROM b, LATERAL (SELECT unnest(range(len(tok) - 4)) AS u))
  WHERE len(list_filter(t, lambda x: x NOT IN ('@', '%', '#'))) >= 2
), n AS (
  SELECT item_id, count(DISTINCT bpos) AS windows FROM bw GROUP BY item_id
), h AS (
  SELECT DISTINCT rid, item_id, pos - bpos AS shift, bpos, t, dw.w AS dwords, bw.w AS bwords FROM dw JOIN bw USING (t)
), p AS (
  SELECT DISTINCT rid, item_id, shift, dwords[i] AS d, bwords[i] AS b FROM (SELECT *, unnest(range(1, 6)) AS i FROM h) WHERE t[i] IN ('@', '%', '#')
), bad AS (
  SELECT rid, item_id, shift FROM p GROUP BY rid, item_id, shift HAVING count(DISTINCT d) < count(*) OR count(DISTINCT b) < count(*)
), ok AS (
  SELECT * FROM h ANTI JOIN bad USING (rid, item_id, shift)
), runs AS (
  SELECT rid, item_id, bool_or(k >= 9) AS run FROM (
    SELECT rid, item_id, shift, g, count(DISTINCT bpos) AS k FROM (
      SELECT DISTINCT rid, item_id, shift, bpos, bpos - dense_rank() OVER (PARTITION BY rid, item_id, shift ORDER BY bpos) AS g FROM ok
    ) GROUP BY rid, item_id, shift, g
  ) GROUP BY rid, item_id
), found AS (
  SELECT rid, item_id FROM (SELECT rid, item_id, count(DISTINCT bpos) AS k FROM ok GROUP BY rid, item_id) JOIN n USING (item_id) JOIN runs USING (rid, item_id)
  WHERE k >= 0.8::DOUBLE * windows OR run
), f AS (
  SELECT rid, count(*) AS n_items, min(item_id) AS item_id FROM found GROUP BY rid
)
SELECT doc_id::BIGINT AS doc_id, n_items IS NOT NULL AS contaminated, coalesce(n_items, 0)::BIGINT AS n_items, item_id::BIGINT AS item_id FROM d LEFT JOIN f USING (rid)
"""

ORACLES: dict[str, str] = {"op1_quality_rules": _OP1, "op2_decontaminate": _OP2}
