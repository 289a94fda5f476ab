"""Event counts per window as a stream, and drift between neighbouring windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def windowed_counts(events: DataFrame, ts: str, key: str, size: str = "1 day", late: str = "2 hours") -> DataFrame:
    """Tumbling counts and sums per key with a watermark. ``ts`` may be without zone; event time needs one."""
    d = events.withColumn("__ts", F.col(ts).cast("timestamp")).withWatermark("__ts", late)
    g = d.groupBy(F.window("__ts", size), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return g.select(F.date_format("window.start", "yyyy-MM-dd HH:mm").alias("start"), key, "n", "total")


def between_windows(counts: DataFrame, key: str, start: str = "start", drop_pct: float = 15.0, growth_pct: float = 50.0, floor: int = 20) -> DataFrame:
    """Change of every window against the one before of the same key, with its verdict."""
    prev = F.lag("n").over(Window.partitionBy(key).orderBy(start))
    d = counts.withColumn("previous", prev).withColumn("change_pct", 100 * F.try_divide(F.col("n") - F.col("previous"), F.col("previous")))
    verdict = (
        F.when(F.col("previous").isNull(), "new")
        .when((F.col("change_pct") < -drop_pct) & (F.col("previous") >= floor), "drop")
        .when(F.col("change_pct") < -drop_pct, "flag_small")
        .when(F.col("change_pct") > growth_pct, "growth")
    )
    return d.withColumn("verdict", verdict)


def run_to_table(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Work off everything that is there now into Parquet (append streams)."""
    q = stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination()
