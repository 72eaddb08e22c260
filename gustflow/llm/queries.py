"""Registered queries of the training-data operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from gustflow.llm.common import documents
from gustflow.llm.sql import DECONTAMINATION, merkle
from gustflow.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.langid import identify
    return identify(documents(spark, sf_dir))


@query
def op2_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.token_frames import roundtrip
    return roundtrip(documents(spark, sf_dir))


@query
def op3_line_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.line_quality import quality
    return quality(documents(spark, sf_dir))


@query
def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.secrets import secrets
    return secrets(documents(spark, sf_dir))


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.toxicity import classify
    return classify(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


@query
def op6_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.jaccard_join import join
    return join(documents(spark, sf_dir))


@query
def op7_bpe_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.bpe_words import encode
    return encode(documents(spark, sf_dir))


@query
def op8_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.substring_dedup import dedup
    return dedup(documents(spark, sf_dir))


@query
def op9_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.cross_polytope import near_duplicates
    prepare(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


@query
def op10_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.packing import pack
    return pack(documents(spark, sf_dir))


@query
def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.merkle import checked
    return checked(documents(spark, sf_dir))


@query
def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.periodic import analyse
    return analyse(documents(spark, sf_dir), tails=True)


@query
def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from gustflow.llm.decontam import contaminated
    return contaminated(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE["op11_merkle_manifest"] = merkle()

ORACLE["op13_decontamination"] = DECONTAMINATION

ORACLE["op3_line_quality"] = r"""
WITH base AS (
  SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS lines
  FROM documents),
grams AS (
  SELECT doc_id, i, list_slice(w, i, i + 2) AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM base)),
repeated AS (
  SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM grams) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + j) AS n FROM repeated, (SELECT unnest([0, 1, 2]) AS j) GROUP BY doc_id),
line AS (
  SELECT doc_id, host, t, lower(trim(regexp_replace(l, '[\x20\x09-\x0D]+', ' ', 'g'))) AS l
  FROM (SELECT doc_id, host, t, unnest(lines) AS l FROM base)),
frequent AS (
  SELECT host, l FROM (SELECT host, l, count(DISTINCT t) AS df FROM line GROUP BY host, l)
  JOIN (SELECT host, count(DISTINCT t) AS docs FROM base GROUP BY host) USING (host)
  WHERE df >= 10 AND df > least(0.1 * docs, sqrt(docs))),
lost AS (
  SELECT doc_id, sum(len(string_split(l, ' '))) AS n FROM line JOIN frequent USING (host, l) GROUP BY doc_id),
counted AS (
  SELECT b.doc_id, len(w) AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words, coalesce(x.n, 0) AS n_removed
  FROM base b LEFT JOIN covered c USING (doc_id) LEFT JOIN lost x USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
       NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND n_removed <= 0.5 * n_words AS kept,
       CAST(n_removed AS BIGINT) AS n_removed
FROM counted"""

ORACLE["op8_substring_dedup"] = r"""
WITH base AS (
  SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM documents),
windows AS (
  SELECT doc_id, i, sha256(array_to_string(list_slice(w, i, i + 34), ' ')) AS h
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM base)),
repeated AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY h) AS n FROM windows) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, i + j AS p FROM repeated, (SELECT unnest(range(35)) AS j)),
word AS (SELECT doc_id, p, w[p] AS word FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM base)),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT b.doc_id, len(w) AS n_words, len(w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.t, '')) AS kept_sha256
FROM base b LEFT JOIN kept k USING (doc_id)"""
