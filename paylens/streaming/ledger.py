"""Keyed state across runs: the company ledger and keyed upserts, as a batch merge and as a stream.

A key seen in a run is refreshed and its failures reset; a key probed but not seen gains a
failure and leaves at the third; a key that was not probed is left alone; a new key enters.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from paylens.streaming.generations import Generations

MAX_FAILURES = 3


def ledger_merge(state: DataFrame, probed: DataFrame, seen: DataFrame, now: str, max_failures: int = MAX_FAILURES) -> DataFrame:
    """State after one run, removed keys included with ``removed`` true.

    state: token, company, provider, job_count, last_seen_ok, consecutive_failures, first_verified_at.
    probed: token. seen: token, company, provider, job_count.
    """
    s = seen.select("token", *[F.col(c).alias(f"__{c}") for c in ("company", "provider", "job_count")], F.lit(True).alias("__seen"))
    p = probed.select("token").distinct().withColumn("__probed", F.lit(True))
    d = state.withColumn("__old", F.lit(True)).join(s, "token", "full_outer").join(p, "token", "left")
    is_seen = F.coalesce("__seen", F.lit(False))
    failed = ~is_seen & F.coalesce("__probed", F.lit(False))
    fails = F.when(is_seen, 0).when(failed, F.coalesce("consecutive_failures", F.lit(0)) + 1).otherwise(F.col("consecutive_failures"))
    pick = lambda c: F.when(is_seen, F.col(f"__{c}")).otherwise(F.col(c))
    return d.select(
        "token", pick("company").alias("company"), pick("provider").alias("provider"), pick("job_count").alias("job_count"),
        F.when(is_seen, F.lit(now)).otherwise(F.col("last_seen_ok")).alias("last_seen_ok"),
        fails.alias("consecutive_failures"),
        F.coalesce("first_verified_at", F.when(is_seen, F.lit(now))).alias("first_verified_at"),
        (failed & (fails >= max_failures)).alias("removed"),
    )


def _standing(key: str) -> str:
    return f"{key}, consecutive_failures int, last_seen_ok string, first_verified_at string, times_removed long, removed boolean"


def ledger_fold(state: DataFrame, runs: DataFrame, key: str, run: str, seen: str, max_failures: int = MAX_FAILURES) -> DataFrame:
    """The ledger ``state`` moved along later runs (key, run, seen), each run of a key once; same columns.

    A failure streak is a count since the last run that saw the key, or goes on from the state as long
    as none did. The third failure removes the key; a later sighting enters it anew. Keys never seen
    stay outside. Windows hold the given runs of one key.
    """
    up_to = Window.partitionBy(key).orderBy(run).rowsBetween(Window.unboundedPreceding, 0)
    d = runs.select(key, run, seen).withColumn("__spell", F.sum(F.col(seen).cast("int")).over(up_to))
    # spell 0 is what came before any sighting here: it goes on from the state of a key that is in
    spells = d.groupBy(key, "__spell").agg(
        F.count(F.lit(1)).alias("__runs"), F.min(run).alias("__from"), F.max(F.when(F.col(seen), F.col(run))).alias("__ok")
    )
    spells = spells.select(key, "__spell", "__from", "__ok", (F.col("__runs") - F.when(F.col("__spell") > 0, 1).otherwise(0)).alias("__f"))
    live = state.filter("NOT removed").select(key, F.lit(0).cast("long").alias("__spell"), F.col("first_verified_at").alias("__from"), F.col("last_seen_ok").alias("__ok"), F.col("consecutive_failures").cast("long").alias("__f"))
    spells = spells.withColumn("__new", F.lit(1)).unionByName(live.withColumn("__new", F.lit(0)))
    spells = spells.groupBy(key, "__spell").agg(
        F.coalesce(F.min(F.when(F.col("__new") == 0, F.col("__from"))), F.min("__from")).alias("__from"), F.max("__ok").alias("__ok"), F.sum("__f").alias("__f")
    )
    spells = spells.filter("__ok IS NOT NULL").withColumn("__gone", (F.col("__f") >= max_failures).cast("int"))
    before = Window.partitionBy(key).orderBy("__spell").rowsBetween(Window.unboundedPreceding, -1)
    spells = spells.withColumn("__entry", F.coalesce(F.sum("__gone").over(before), F.lit(0)))
    last = spells.groupBy(key).agg(F.max_by(F.struct("__f", "__ok", "__entry", "__gone"), "__spell").alias("l"), F.sum("__gone").alias("__times"))
    first = spells.groupBy(key, "__entry").agg(F.min_by("__from", "__spell").alias("__first"))
    moved = last.select(key, "__times", "l.*").join(first, [key, "__entry"]).withColumn("__moved", F.lit(True)).drop("__entry")
    out = state.join(moved, key, "full_outer")
    pick = lambda new, old: F.when(F.col("__moved"), new).otherwise(F.col(old))
    return out.select(
        key, pick(F.least(F.col("__f"), F.lit(max_failures)).cast("int"), "consecutive_failures").alias("consecutive_failures"), pick(F.col("__ok"), "last_seen_ok").alias("last_seen_ok"),
        pick(F.col("__first"), "first_verified_at").alias("first_verified_at"), (F.coalesce("times_removed", F.lit(0)) + F.coalesce("__times", F.lit(0))).cast("long").alias("times_removed"),
        pick(F.col("__gone") == 1, "removed").alias("removed"),
    )


def ledger_replay(runs: DataFrame, key: str, run: str, seen: str, max_failures: int = MAX_FAILURES) -> DataFrame:
    """The ledger after a whole history of runs (key, run, seen), in one pass."""
    none = runs.sparkSession.createDataFrame([], _standing(f"`{key}` {dict(runs.dtypes)[key]}"))
    return ledger_fold(none, runs, key, run, seen, max_failures)


def upsert_latest(old: DataFrame, new: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Union of two keyed tables in which the newest row of a key wins; the new side on ties."""
    both = old.withColumn("__new", F.lit(0)).unionByName(new.withColumn("__new", F.lit(1)), allowMissingColumns=True)
    cols = [c for c in both.columns if c not in (*keys, "__new")]
    picked = both.groupBy(*keys).agg(F.max_by(F.struct(*cols), F.struct(F.col(order), F.col("__new"))).alias("r"))
    return picked.select(*keys, *[F.col(f"r.{c}").alias(c) for c in cols])


# -------------------------------------------------------------------- streams

STANDING = _standing("key string")
OPEN = "key string, run string, seen boolean"


def run_ledger(runs: DataFrame, path: str, checkpoint: str, keep: int = 3, max_failures: int = MAX_FAILURES) -> None:
    """Work off a stream of (key, run, seen) into the ledger at ``path``.

    The newest ``keep`` runs stay open, so that their rows may come in any order and more than once;
    older ones are folded into one row per key. What comes later than that is set aside in ``late``.
    Each micro-batch writes a generation of its own from the one before, so a repeated one does not
    double anything, and state is one row per key and at most ``keep`` open rows, whatever the history.
    Runs carry an explicit, sortable id, because a micro-batch number is not one after a restart.
    """
    spark = runs.sparkSession

    def fold(batch: DataFrame, epoch: int) -> None:
        before, table = epoch - 1, Generations(spark, path)
        horizon = table.read("horizon", before, "run string").agg(F.max("run")).first()[0]
        fresh = batch.select("key", "run", "seen") if horizon is None else batch.filter(F.col("run") > horizon).select("key", "run", "seen")
        if horizon is not None:
            table.write(batch.filter(F.col("run") <= horizon).select("key", "run", "seen"), "late", epoch)
        # a run that saw a key in one of its rows saw it
        open_ = table.read("open", before, OPEN).unionByName(fresh).groupBy("key", "run").agg(F.max("seen").alias("seen"))
        newest = [r["run"] for r in open_.select("run").distinct().orderBy(F.desc("run")).limit(keep + 1).collect()]
        state = table.read("state", before, STANDING)
        if len(newest) > keep:
            horizon = newest[keep]
            state = ledger_fold(state, open_.filter(F.col("run") <= horizon), "key", "run", "seen", max_failures)
            open_ = open_.filter(F.col("run") > horizon)
        table.write(state, "state", epoch)
        table.write(open_, "open", epoch)
        table.write(spark.createDataFrame([(horizon,)] if horizon else [], "run string"), "horizon", epoch)
        for name in ("state", "open", "horizon"):
            table.drop(name, before - 1)

    q = runs.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def read_ledger(spark, path: str, max_failures: int = MAX_FAILURES) -> DataFrame:
    """The ledger as of the newest run that came in."""
    table = Generations(spark, path)
    last = table.newest("horizon")
    return ledger_fold(table.read("state", last, STANDING), table.read("open", last, OPEN), "key", "run", "seen", max_failures)


def read_late(spark, path: str) -> DataFrame:
    """Rows that came after their run was folded; they count for nothing."""
    table = Generations(spark, path)
    return table.all("late", OPEN)
