"""Written tables between the steps of an operator, and the blocks in which documents are dealt out."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paylens.session import ensure_checkpoint_dir

#: Rows without an id are dealt to this many blocks of their own, after all others.
NO_ID_BLOCKS = 1 << 20
NO_ID_FIRST = 1 << 61


def landed(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder that the cluster shares, and read again: cuts the lineage and survives lost executors."""
    path = f"{ensure_checkpoint_dir(df.sparkSession)}/llm-{uuid.uuid4().hex}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, text)`` alone, so that further columns of the input, whatever their names, never meet our own."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def block_of(rows_per_block: int) -> Column:
    """Blocks of neighbouring ids; their order is that of the ids. Rows without an id follow, by a hash of their text."""
    no_id = F.lit(NO_ID_FIRST) + F.pmod(F.xxhash64("text"), F.lit(NO_ID_BLOCKS))
    return F.coalesce(F.floor(F.col("doc_id") / F.lit(rows_per_block)).cast("long"), no_id)


def wide(spark, least: int = 64) -> int:
    """Number of buckets for exchanged arrays: never below the session's shuffle partitions."""
    return max(least, int(spark.conf.get("spark.sql.shuffle.partitions")))
