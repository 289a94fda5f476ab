"""The dealt operators bound to the driver's tables, with SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.alignment import aligned, link_counts, vocabulary_sizes
from paylens.llm.byte_bpe import byte_bpe
from paylens.llm.cap_filters import cap_links
from paylens.llm.context_tree import context_tree_scores
from paylens.llm.exact_dedup import exact_dedup
from paylens.llm.language_id import language_id
from paylens.llm.minhash_dedup import minhash_dedup
from paylens.llm.fill_middle import fill_middle, restored
from paylens.llm.landing import landed
from paylens.llm.mixing import mix_sources
from paylens.llm.personal_data import KINDS, personal_data
from paylens.llm.substring_dedup import substring_dedup
from paylens.llm.token_files import crc32_of_ids, token_files
from paylens.llm.toxicity import toxicity
from paylens.session import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_exact_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return exact_dedup(table(spark, sf, "documents")).drop("shuffled")


ORACLE["op1_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, length(coalesce(text, '')) AS n,
    sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', '', 'g')) AS text_sha256
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = first_value(doc_id) OVER w AS kept, text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
"""


@query
def op8_mix_sources(spark: SparkSession, sf: str) -> DataFrame:
    return mix_sources(table(spark, sf, "documents"))


@query
def op3_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    out = substring_dedup(table(spark, sf, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query
def op4_minhash_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return minhash_dedup(table(spark, sf, "documents"))


@query
def op7_context_tree(spark: SparkSession, sf: str) -> DataFrame:
    return context_tree_scores(table(spark, sf, "documents"))


@query
def op2_byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    out = byte_bpe(table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", F.sha2(F.array_join("ids", " ").cast("binary"), 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


@query
def op9_token_files(spark: SparkSession, sf: str) -> DataFrame:
    return crc32_of_ids(token_files(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json")))


@query
def op5_cap_filters(spark: SparkSession, sf: str) -> DataFrame:
    return cap_links(table(spark, sf, "embeddings"))


@query
def op6_toxicity(spark: SparkSession, sf: str) -> DataFrame:
    return toxicity(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query
def op10_personal_data(spark: SparkSession, sf: str) -> DataFrame:
    out = personal_data(table(spark, sf, "documents"))

    def line(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def number(kind: str):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    counts = [number(k) for k in KINDS]
    return out.select("doc_id", *counts, F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"))


@query
def op11_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    out = fill_middle(table(spark, sf, "documents"))
    return out.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(restored().cast("binary"), 256).alias("restored_sha256"))


ORACLE["op11_fill_middle"] = """
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS text, sha256('42:' || doc_id::VARCHAR) AS h,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS units
  FROM documents),
n AS (
  SELECT doc_id, text, units, len(units) AS n, ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
    ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM t),
cut AS (
  SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 50 THEN 'plain'
      WHEN h4 % 100 < 80 THEN 'spm' ELSE 'psm' END AS form
  FROM n),
parts AS (
  SELECT doc_id, n, form, text, array_to_string(units[1:a], '') AS p, array_to_string(units[a + 1:b], '') AS m,
    array_to_string(units[b + 1:], '') AS s
  FROM cut)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


@query
def op12_language_id(spark: SparkSession, sf: str) -> DataFrame:
    return language_id(table(spark, sf, "documents"))


@query
def op13_alignment(spark: SparkSession, sf: str) -> DataFrame:
    sides = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.PATTERN
    rows = aligned(table(spark, sf, "documents"), *sides)
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2(F.col("groups").cast("binary"), 256))
    rows = landed(rows.withColumn("groups_sha256", digest).drop("groups"), "aligned")
    return link_counts(rows, *vocabulary_sizes(*sides))
