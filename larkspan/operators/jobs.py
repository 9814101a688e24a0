"""Background jobs: rates, visibility, life cycle, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

ADMIN = 10
FINAL = ("done", "failed", "cancelled")


def rate(progress: Column, elapsed: Column) -> Column:
    """Items a second to two places; 0 before anything is done or any time has passed."""
    return F.when((elapsed > 0) & (progress != 0), F.round(progress / elapsed * 100) / 100).otherwise(F.lit(0.0))


def eta(progress: Column, total: Column, elapsed: Column) -> Column:
    """Seconds left: 0 when nothing is left, -1 if unknown, as before anything is done or any time has passed."""
    left, speed = total - progress, rate(progress, elapsed)
    begun = (progress != 0) & (elapsed > 0)
    return F.when(~begun, -1).when(left <= 0, 0).when(speed > 0, F.ceil(left / speed)).otherwise(-1).cast("int")


def visible_to(viewer: int, level: int) -> Column:
    admin = F.lit(level >= ADMIN)
    v = F.col("visibility")
    return (v == "global") | (v == "user") & ((F.col("owner_user_id") == viewer) | admin) | (v == "role") & (F.lit(level) >= F.col("min_role_level")) | (v == "role") & admin


def newest_first(jobs: DataFrame) -> DataFrame:
    return jobs.orderBy(F.desc("created_at"), F.desc("id"))


def running(status: Column) -> Column:
    return status.isin("running", "pending")


# Seconds for which records are kept.
STATUS_TTL, DUPLICATES_TTL = 60, 900


def unexpired(jobs: DataFrame, now: str, minutes: int = 30) -> DataFrame:
    """jobs without those that ended longer ago."""
    return jobs.where(F.col("finished_at").isNull() | (F.col("finished_at") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {minutes} MINUTES")))


def fresh(records: DataFrame, now: str, seconds: int, key: list[str]) -> DataFrame:
    """The latest record (ts and others) of each key that is younger than `seconds`: what a store with expiring keys still holds."""
    young = records.where(F.col("ts") > F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL {seconds} SECONDS"))
    others = [c for c in records.columns if c not in ("ts", *key)]
    return young.groupBy(*key).agg(F.max(F.struct("ts", *others)).alias("_last")).select(*key, "_last.*")


def back_filled(messages: DataFrame, total: Column, stall_minutes: int = 10) -> DataFrame:
    """The end of each job's back-fill from its messages (job, ts, kind, ok, n): updated, failed, lost, current, stalled_at, reason.

    kinds: start (once), item (a worker's report on one row: ok or not), poll (n: the rows done by the counter that loses
    nothing). What a poll counts beyond the reports until then was lost on the way and counts as failed. A job
    is complete when reports and losses reach the total; it stalls where `stall_minutes` pass without a report or
    a higher poll, and what comes after isn't counted.
    """
    order = Window.partitionBy("job").orderBy("ts", "kind", "n")
    until = order.rowsBetween(Window.unboundedPreceding, -1)
    top = F.coalesce(F.max(F.when(F.col("kind") == "poll", F.col("n"))).over(until), F.lit(0))
    moves = F.col("kind").isin("start", "item") | (F.col("kind") == "poll") & (F.col("n") > top)
    steps = messages.withColumn("_moves", moves).where("_moves").withColumn("_before", F.lag("ts").over(order))
    late = F.col("ts") > F.col("_before") + F.expr(f"INTERVAL {stall_minutes} MINUTES")
    steps = steps.withColumn("_stall", F.min(F.when(late, F.col("_before"))).over(order.rowsBetween(Window.unboundedPreceding, 0))).where(F.col("_stall").isNull() | (F.col("ts") <= F.col("_stall")))
    # Reports and losses never go down: losses after a poll are what its counter is beyond reports and losses so far.
    reports = F.count_if(F.col("kind") == "item").over(order.rowsBetween(Window.unboundedPreceding, 0))
    short = F.max(F.when(F.col("kind") == "poll", F.greatest(F.col("n") - F.col("_reports"), F.lit(0)))).over(order.rowsBetween(Window.unboundedPreceding, 0))
    counted = steps.withColumn("_reports", reports).withColumn("_lost", F.coalesce(short, F.lit(0))).withColumn("_current", F.col("_reports") + F.col("_lost")).withColumn("_total", total)
    counted = counted.withColumn("_done", F.max((F.col("_current") >= F.col("_total")).cast("int")).over(until)).where(F.coalesce("_done", F.lit(0)) == 0)
    out = counted.groupBy("job").agg(
        F.count_if((F.col("kind") == "item") & F.col("ok")).alias("updated"), F.count_if((F.col("kind") == "item") & ~F.col("ok")).alias("_failed"), F.max("_lost").cast("long").alias("lost"), F.max("ts").alias("last_at"), F.max("_total").cast("long").alias("total")
    )
    current = F.col("updated") + F.col("_failed") + F.col("lost")
    return out.select("job", "total", "updated", (F.col("_failed") + F.col("lost")).alias("failed"), "lost", current.alias("current"), "last_at", F.when(current >= F.col("total"), "complete").otherwise("stalled").alias("reason"))


def states(log: DataFrame) -> DataFrame:
    """State and progress of each job from its events (job, seq, kind, n).

    kinds: start (only a pending job starts), done, failed, cancel (the first final one stays), set, add, total.
    """
    final = F.min_by("kind", F.when(F.col("kind").isin("done", "failed", "cancel"), F.col("seq")))
    ends = F.min(F.when(F.col("kind").isin("done", "failed", "cancel"), F.col("seq")))
    started = F.max((F.col("kind") == "start").cast("int")) == 1
    set_at = F.max(F.when(F.col("kind") == "set", F.col("seq")))
    facts = log.groupBy("job").agg(final.alias("final"), ends.alias("ends"), started.alias("started"), set_at.alias("set_at"))
    joined = log.join(facts, "job")
    live = joined.where(F.col("ends").isNull() | (F.col("seq") < F.col("ends")))
    last_set = F.max_by("n", F.when(F.col("kind") == "set", F.col("seq")))
    after = F.max(F.when(F.col("kind") == "set", F.col("seq")))
    sums = live.groupBy("job").agg(last_set.alias("base"), after.alias("at"), F.max_by("n", F.when(F.col("kind") == "total", F.col("seq"))).alias("total"))
    added = live.where("kind = 'add'").join(sums.select("job", "at"), "job").where("at IS NULL OR seq > at").groupBy("job").agg(F.sum("n").alias("added"))
    out = facts.join(sums, "job", "left").join(added, "job", "left")
    status = F.when(F.col("final") == "cancel", "cancelled").when(F.col("final").isNotNull(), F.col("final")).when(F.col("started"), "running").otherwise("pending")
    return out.select("job", status.alias("status"), (F.coalesce("base", F.lit(0)) + F.coalesce("added", F.lit(0))).cast("long").alias("progress"), F.coalesce("total", F.lit(0)).cast("long").alias("total"))
