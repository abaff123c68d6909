"""The registered query of each operator of this subpackage, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, bwt, crf, html, lm, near, qgram, quality, rules, sharding

#: Rank file of the tokenizer; a parameter of the operator.
RANKS = "byte_bpe_multi_50k.tiktoken"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.classify(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score(_table(spark, sf_dir, "documents"))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign(_table(spark, sf_dir, "documents"))


def op4_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(_table(spark, sf_dir, "documents"), public_tokenizers.path(RANKS), public_tokenizers.PATTERN)


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qgram.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.classes(_table(spark, sf_dir, "documents"), k=3, percent=85)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crf.report(_table(spark, sf_dir, "documents"))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bwt.dedup(_table(spark, sf_dir, "documents"))


def op9_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = html.extract(_table(spark, sf_dir, "pages").select("page_id", "url", "html"))
    return pages.select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.report(_table(spark, sf_dir, "documents"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = (op1_quality_classifier, op2_lm_scoring, op3_sharding, op4_bpe, op5_decontamination, op6_near_duplicates, op7_pii, op8_suffix_dedup, op9_html_extraction, op10_quality_rules, pipeline)
    return {f.__name__: f for f in own}


_WORDS = r"list_filter(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'), lambda x: x <> '')"

#: Extendible hashing: the shortest prefix of the key whose rows fit.
_SHARDS = f"""
WITH r AS (
  SELECT doc_id, strlen(coalesce(text, ''))::BIGINT AS n_bytes,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS k
  FROM documents),
l AS (SELECT d AS depth, k >> (60 - d) AS b, sum(n_bytes)::BIGINT AS bytes FROM r, range(0, 61) t(d) GROUP BY 1, 2),
f AS (SELECT r.doc_id, r.n_bytes, r.k, min(l.depth) AS depth
      FROM r JOIN l ON l.b = r.k >> (60 - l.depth) WHERE l.bytes <= {sharding.SHARD_BYTES} GROUP BY 1, 2, 3)
SELECT f.doc_id, f.n_bytes,
       CASE WHEN f.depth = 0 THEN '' ELSE lpad(bin(f.k >> (60 - f.depth)), f.depth::INT, '0') END AS shard,
       f.depth::INT AS depth, l.bytes AS shard_bytes, false AS oversized
FROM f JOIN l ON l.depth = f.depth AND l.b = f.k >> (60 - f.depth)
"""

_RULES = rf"""
WITH w AS (
  SELECT doc_id, coalesce(text, '') AS text, {_WORDS} AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i:i + 7], ' ') AS gram FROM w, unnest(range(1, len(w) - 6)) t(i)),
s AS (SELECT doc_id, gram FROM g GROUP BY 1, 2 HAVING count(*) > 1),
c AS (SELECT doc_id, count(DISTINCT p)::BIGINT AS n FROM (SELECT g.doc_id, unnest(range(g.i, g.i + 8)) AS p FROM g JOIN s USING (doc_id, gram)) GROUP BY 1),
m AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, len(lines) AS n_lines, coalesce(c.n, 0) AS n_repeat_words
      FROM w LEFT JOIN c USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
       NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words OR 2 * n_symbols > n_words
            OR word_chars < 2 * n_words OR word_chars > 25 * n_words OR 2 * n_dup_lines > n_lines) AS kept
FROM m
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_sharding": _SHARDS, "op10_quality_rules": _RULES}
