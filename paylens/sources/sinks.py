"""Writers: enveloped datasets, manifests, snapshots, exports and slices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def payload_digest(cols: list[str]) -> Column:
    """SHA-256 of a row's payload: names and values in the given order, a null told apart from an empty text."""
    parts = [F.concat(F.lit(f"{c}="), F.coalesce(F.concat(F.lit("'"), F.col(c).cast("string"), F.lit("'")), F.lit("null"))) for c in cols]
    return F.sha2(F.concat_ws("\n", *parts).cast("binary"), 256)


def write_dataset(df: DataFrame, path: str, source_id: str, generated_at: str, digest: str | None = None) -> None:
    """One dataset under its own partition; writing it again replaces only that partition. ``digest``
    names a column for the SHA-256 of each row's payload."""
    out = df.withColumn(digest, payload_digest(df.columns)) if digest else df
    out = out.withColumns({"source_id": F.lit(source_id), "generated_at": F.lit(generated_at)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def write_datasets(df: DataFrame, path: str, source_id: str, generated_at: str) -> None:
    """All datasets of a table, told apart by a column, in one pass."""
    out = df.withColumns({"source_id": F.col(source_id), "generated_at": F.lit(generated_at)})
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("source_id").parquet(path)


def append_snapshots(df: DataFrame, path: str) -> None:
    """Several runs, told apart by ``run_ts``, appended in one pass."""
    df.write.mode("append").parquet(path)


def append_snapshot(df: DataFrame, path: str, run_ts: str) -> None:
    """One run appended to the history; earlier runs are never touched."""
    df.withColumn("run_ts", F.lit(run_ts)).write.mode("append").parquet(path)


def last_two_runs(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(current, previous) run of a snapshot history."""
    runs = df.select("run_ts").distinct().orderBy(F.desc("run_ts")).limit(2)
    ends = F.broadcast(runs.agg(F.max("run_ts").alias("__now"), F.min("run_ts").alias("__before")))  # one row
    d = df.join(ends)
    return (
        d.filter("run_ts = __now").drop("__now", "__before"),
        d.filter("run_ts = __before AND __before <> __now").drop("__now", "__before"),
    )


def export_csv(df: DataFrame, path: str) -> None:
    """Header row, missing values as empty cells, quotes where needed. Nested columns become JSON text."""
    plain = [F.to_json(c).alias(c) if t.startswith(("array", "struct", "map")) else F.col(c) for c, t in df.dtypes]
    df.select(*plain).write.mode("overwrite").option("header", True).option("nullValue", "").option("emptyValue", "").option("escape", '"').csv(path)


def export_json(df: DataFrame, path: str, generated_at: str, note: str) -> None:
    """JSON lines that carry when and what they are; missing values stay visible."""
    out = df.withColumns({"generated_at": F.lit(generated_at), "note": F.lit(note)})
    out.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def write_slice(df: DataFrame, cols: list[str], path: str) -> None:
    """A narrow copy for a reader that needs few columns of a wide dataset."""
    df.select(*cols).write.mode("overwrite").parquet(path)
