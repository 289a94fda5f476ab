"""The corpus pipeline: five stages over whole documents, each on what the one before it kept.

A stage takes (spark, docs, sf_dir) and returns the documents it keeps, in the columns it was
given; the last returns token ids. Columns that a stage does not need pass through it untouched.
Rows that share an id share every decision, and so do rows without one. Empty input gives empty
output at every stage.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paylens.llm.byte_bpe import byte_bpe
from paylens.llm.exact_dedup import exact_dedup
from paylens.llm.landing import landed
from paylens.llm.minhash_dedup import minhash_dedup
from paylens.llm.mixing import mix_sources
from paylens.llm.toxicity import REJECT, fit, with_scores
from paylens.session import table


#: Documents are linked from a similarity of 0.80 on; a pair there meets in no band with a chance of (1 - 0.8 ** 5) ** 40, about 1.3e-7.
NEAR = {"threshold": 80, "bands": 40, "rows": 5}


def free_name(docs: DataFrame, name: str) -> str:
    """``name``, with underscores until no column has it; column names differ by more than case."""
    taken = {c.lower() for c in docs.columns}
    while name.lower() in taken:
        name += "_"
    return name


def _keep(docs: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows whose id is in ``kept``."""
    ids = kept.select(F.col("doc_id").alias("kept_id")).distinct()
    return docs.join(ids, docs["doc_id"].cast("long").eqNullSafe(ids["kept_id"]), "left_semi")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the rejection score; a document without text is clean."""
    score = free_name(docs, "score")
    scored = with_scores(docs, fit(docs, table(spark, sf_dir, "labels")), score_col=score)
    return scored.filter(F.col(score) < REJECT).drop(score)


def drop_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts, the longest."""
    return _keep(docs, exact_dedup(docs).filter("kept"))


def drop_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near duplicates, that of the smallest id."""
    return _keep(docs, minhash_dedup(docs, **NEAR).filter("kept"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it; of an id with several rows the most copies count."""
    names, n = docs.columns, free_name(docs, "copies")
    taken = mix_sources(docs).groupBy(F.col("doc_id").alias("mixed_id")).agg(F.max("copies").cast("int").alias(n)).filter(F.col(n) > 0)
    joined = docs.join(taken, docs["doc_id"].cast("long").eqNullSafe(taken["mixed_id"]))
    return joined.withColumn(n, F.explode(F.sequence(F.lit(1), F.col(n)))).select(*[docs[c] for c in names])


def tokenise(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded_sha256``: token ids, and the hash of the text that they decode to."""
    out = byte_bpe(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    return out.select("doc_id", "n_tokens", "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


STAGES = [("toxicity", drop_toxic), ("exact_dedup", drop_exact), ("near_dedup", drop_near), ("mix_sources", mix), ("byte_bpe", tokenise)]

#: SQL can't express the fitted score nor the sampled rounding; tests hold each stage against plain code.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = landed(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
