"""Running forms of the event folds, as Structured Streaming queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEASE_S = 45


def stream_tally(events: DataFrame) -> DataFrame:
    """Events by type; for update or complete mode."""
    return events.groupBy("type").agg(F.count(F.lit(1)).alias("n"))


def stream_metrics(events: DataFrame, width: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """Per tumbling window: events, reuses, recomputes and the reuse rate; windows close when the watermark passes them."""
    n = lambda t: F.count_if(F.col("type") == t)
    per = events.withWatermark("ts", late).groupBy(F.window("ts", width)).agg(F.count(F.lit(1)).alias("n"), n("view").alias("reuse"), n("click").alias("recompute"))
    return per.select(F.col("window.start").alias("start"), "n", "reuse", "recompute", F.try_divide("reuse", F.col("reuse") + F.col("recompute")).alias("reuse_rate"))


def dedup_events(events: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Events without replays inside the watermark."""
    return events.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)


def reaper(heartbeats: DataFrame, lease_s: int = LEASE_S, late: str = "10 seconds") -> DataFrame:
    """(work_key, fence, expired_at) of open claims whose lease has run out, once each, from a stream of (work_key, fence, open, ts).

    Every event renews the lease, and one that is not open ends the claim. Session windows of a lease's length end where no event
    renews them, so the watermark alone decides and state goes with its window; in append mode.
    """
    window = F.session_window("ts", f"{lease_s} seconds")
    # the highest fence decides, then time: a zombie's late heartbeat does not bring an ended claim back
    last = heartbeats.withWatermark("ts", late).groupBy("work_key", window).agg(F.max_by(F.struct("open", "fence"), F.struct("fence", "ts")).alias("last"))
    return last.where("last.open").select("work_key", "last.fence", F.col("session_window.end").alias("expired_at"))


def stage_status(events: DataFrame) -> DataFrame:
    """(run_id, stage, status, runtime_s) from a stream of (run_id, stage, type, ts): the newest event of each stage decides."""
    newest = events.groupBy("run_id", "stage").agg(F.max_by("type", "ts").alias("type"), F.max_by(F.when(F.col("type") == "stage.started", F.col("ts")), F.when(F.col("type") == "stage.started", F.col("ts"))).alias("started"), F.max("ts").alias("last"))
    status = F.when(F.col("type") == "stage.started", "Running").when(F.col("type") == "stage.completed", "Succeeded").when(F.col("type") == "stage.failed", "Failed").otherwise("Planned")
    ended = F.col("type").isin("stage.completed", "stage.failed")
    return newest.select("run_id", "stage", status.alias("status"), F.when(ended, F.unix_seconds("last") - F.unix_seconds("started")).alias("runtime_s"))
