"""Folds of an event log: batch forms, of which keepsake.streaming has the running ones.

Events have event_id, ts, user_id (the run they belong to), event_type and value.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PERIOD_S = 300


def tally(events: DataFrame) -> DataFrame:
    return events.groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("user_id").alias("users"), F.round(F.sum("value"), 2).alias("total"))


def unknown_types(events: DataFrame, known: list[str]) -> DataFrame:
    return events.where(~F.col("event_type").isin(known)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))


def period_start(ts: Column, seconds: int = PERIOD_S) -> Column:
    return F.floor(F.unix_micros(ts.cast("timestamp")) / F.lit(seconds * 1_000_000)) * seconds


def metrics(events: DataFrame, seconds: int = PERIOD_S) -> DataFrame:
    """Per tumbling period: events, reuses (view), recomputes (click), errors and the reuse rate."""
    n = lambda t: F.count_if(F.col("event_type") == t)
    per = events.groupBy(period_start(F.col("ts"), seconds).alias("start_s")).agg(F.count(F.lit(1)).alias("n"), n("view").alias("reuse"), n("click").alias("recompute"), n("error").alias("errors"))
    return per.withColumn("reuse_rate", F.try_divide("reuse", F.col("reuse") + F.col("recompute")))


def quantile_sketch(rows: DataFrame, keys: list[str], value: Column, error: float = 0.01) -> DataFrame:
    """(keys, bucket, n): how many values fall into each bucket of a logarithmic scale; sums of n over keys merge sketches exactly.

    A bucket's middle is within `error` (relative) of each of its values; those of at most 0 are in the bucket null, which counts as 0.
    """
    growth = math.log((1 + error) / (1 - error))
    bucket = F.when(value > 0, F.ceil(F.log(value.cast("double")) / growth).cast("long"))
    return rows.where(value.isNotNull()).groupBy(*keys, bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def merge_sketches(sketch: DataFrame, keys: list[str | Column]) -> DataFrame:
    """The sketch over coarser keys."""
    return sketch.groupBy(*keys, "bucket").agg(F.sum("n").alias("n"))


def sketch_quantile(sketch: DataFrame, keys: list[str], share: float = 0.5, error: float = 0.01) -> DataFrame:
    """(keys, n, bucket, value): the bucket of the value whose rank is the share of all rounded up, and its middle.

    A key has as many rows as its values have orders of magnitude times a constant.
    """
    place = Window.partitionBy(*keys).orderBy(F.col("bucket").asc_nulls_first())
    rows = sketch.withColumn("_upto", F.sum("n").over(place)).withColumn("_all", F.sum("n").over(Window.partitionBy(*keys)))
    growth = (1 + error) / (1 - error)
    at = rows.where((F.col("_upto") >= F.ceil(F.col("_all") * share)) & (F.col("_upto") - F.col("n") < F.ceil(F.col("_all") * share)))
    return at.select(*keys, F.col("_all").alias("n"), "bucket", F.coalesce(2 * F.pow(F.lit(growth), F.col("bucket")) / (growth + 1), F.lit(0.0)).alias("value"))


def latency_medians(events: DataFrame, kind: str, seconds: int, error: float = 0.01) -> DataFrame:
    """(start_s, n, bucket, value): the median of value over the events of one kind in each tumbling period."""
    sketch = quantile_sketch(events.where(F.col("event_type") == kind).withColumn("start_s", period_start(F.col("ts"), seconds)), ["start_s"], F.col("value"), error)
    return sketch_quantile(sketch, ["start_s"], 0.5, error)


#: The phase after each type of claim event.
PHASES = {"claim.acquired": "owned", "claim.takeover": "took_over", "claim.contended": "contended", "claim.subscribed": "subscribed", "claim.subscribe_completed": "subscribe_completed", "claim.lease_expired": "lease_expired", "claim.completed": "completed", "claim.failed": "failed"}
#: Phases after which a claim is over.
TERMINAL_PHASES = ("subscribe_completed", "completed", "failed")


def next_claim(state: tuple | None, kind: str, owner: str | None, fence: int | None, at: int, took_over_from: str | None = None, worker: str | None = None) -> tuple:
    """(phase, owner, challenger, fence, beats, anchor, last) after one event; an event with a lower fence than an earlier one changes nothing.

    A contended claim's event names its incumbent as owner, and the worker that has seen it is the challenger; so is
    one that subscribes. Heartbeats renew the lease and bring an expired one back. at: in milliseconds.
    """
    phase, own, challenger, top, beats, anchor, last = state or ("", None, None, None, 0, at, at)
    if fence is not None and top is not None and fence < top:
        return phase, own, challenger, top, beats, anchor, last
    top, last = top if fence is None else fence, max(last, at)
    if kind == "claim.heartbeat":
        return ("owned" if phase == "lease_expired" else phase), own, challenger, top, beats + 1, at, last
    if kind == "claim.acquired":
        return "owned", owner, None, top, 0, at, last
    if kind == "claim.takeover":
        return "took_over", owner, took_over_from if took_over_from is not None else own, top, 0, at, last
    if kind == "claim.contended":
        return "contended", owner, worker, top, beats, at, last
    if kind == "claim.subscribed":
        return "subscribed", owner if owner else own, challenger if challenger is not None else worker, top, beats, anchor, last
    return PHASES.get(kind, phase), own, challenger, top, beats, anchor, last


def claims_board(events: DataFrame) -> DataFrame:
    """(work_key, phase, owner, challenger, fence, beats, anchor): where each claim stands after all its events, in the order of (ts, seq).

    events: work_key, seq, ts, type, owner, fence, took_over_from, worker; next_claim() says what an event does. Leases
    do not run out here: lease_view() tells that as of a time.
    """
    order = Window.partitionBy("work_key").orderBy("ts", "seq")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    rows = events.where(F.col("type").isin("claim.heartbeat", *PHASES)).withColumn("_top", F.max("fence").over(before))
    rows = rows.where(F.col("fence").isNull() | F.col("_top").isNull() | (F.col("fence") >= F.col("_top")))
    is_ = lambda *kinds: F.col("type").isin(*[f"claim.{k}" for k in kinds])
    named = is_("acquired", "takeover", "contended") | (is_("subscribed") & (F.coalesce("owner", F.lit("")) != ""))
    rows = rows.withColumn("_owner", F.last(F.when(named, F.struct("owner")), ignorenulls=True).over(before)["owner"])
    rows = rows.withColumn("_at", F.struct("ts", "seq"))
    newest = lambda what, when: F.max_by(F.when(when, F.struct(what.alias("v"))), F.when(when, F.col("_at")))["v"]
    place = lambda when: F.max(F.when(when, F.col("_at")))
    # the newest event of each kind decides; marks of places let the counts that depend on them follow
    marks = rows.groupBy("work_key").agg(
        newest(F.col("type"), ~is_("heartbeat")).alias("_kind"), place(~is_("heartbeat")).alias("_kind_at"), place(is_("heartbeat")).alias("_beat_at"), newest(F.col("owner"), named).alias("owner"), F.max("fence").alias("fence"),
        place(is_("acquired", "takeover")).alias("_start_at"), place(is_("acquired", "takeover", "contended")).alias("_rival_at"), F.max(F.when(is_("acquired", "takeover", "contended", "heartbeat"), F.col("ts"))).alias("_renewed"), F.min("ts").alias("_first"),
        newest(F.when(is_("takeover"), F.coalesce("took_over_from", "_owner")).when(is_("contended"), F.col("worker")), is_("acquired", "takeover", "contended")).alias("_rival"),
    )
    later = rows.join(marks.select("work_key", "_start_at", "_rival_at"), "work_key")
    subscribes = is_("subscribed") & F.col("worker").isNotNull() & (F.col("_rival_at").isNull() | (F.col("_at") > F.col("_rival_at")))
    counts = later.groupBy("work_key").agg(F.count_if(is_("heartbeat") & (F.col("_start_at").isNull() | (F.col("_at") > F.col("_start_at")))).alias("beats"), F.min_by(F.when(subscribes, F.col("worker")), F.when(subscribes, F.col("_at"))).alias("_subscriber"))
    names = F.create_map(*[F.lit(x) for pair in PHASES.items() for x in pair])
    phase = F.when((F.col("_kind") == "claim.lease_expired") & (F.col("_beat_at") > F.col("_kind_at")), "owned").otherwise(F.coalesce(names[F.col("_kind")], F.lit("")))
    return marks.join(counts, "work_key").select("work_key", phase.alias("phase"), "owner", F.coalesce("_rival", "_subscriber").alias("challenger"), "fence", "beats", F.coalesce("_renewed", "_first").alias("anchor"))


def alarms(per_period: DataFrame, breach: Column, periods: int, seconds: int = PERIOD_S) -> DataFrame:
    """Starts of periods in which breach has held for so many periods on end; a missing period does not breach.

    A breach counts for its own period and the following ones, so no order of all periods is needed.
    """
    hit = per_period.where(breach).select("start_s")
    spread = hit.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda k: F.col("start_s") + k * seconds)).alias("start_s"))
    full = spread.groupBy("start_s").agg(F.count(F.lit(1)).alias("k")).where(F.col("k") == periods)
    return full.select("start_s")


def alarm_runs(events: DataFrame, value: Column, breach: Column, periods: int, seconds: int = PERIOD_S) -> DataFrame:
    """(start_s, value): starts of periods in which a measure has been in breach for so many periods on end, with its value summed over them.

    value: an aggregate over the events of one period; breach: a condition on it, as column value. A period without
    events is not in breach.
    """
    hit = events.groupBy(period_start(F.col("ts"), seconds).alias("start_s")).agg(value.alias("value")).where(breach)
    spread = hit.select(F.explode(F.transform(F.sequence(F.lit(0), F.lit(periods - 1)), lambda k: F.col("start_s") + k * seconds)).alias("start_s"), "value")
    return spread.groupBy("start_s").agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("value")).where(F.col("k") == periods).select("start_s", "value")


def attach_probes(events: DataFrame, probe: str = "signup", stages: tuple[str, ...] = ("view", "click", "purchase")) -> DataFrame:
    """(event_id, stage_id): each probe with the latest stage event of its run until then."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    stage = F.max(F.when(F.col("event_type").isin(*stages), F.col("event_id"))).over(w)
    return events.withColumn("stage_id", stage).where(F.col("event_type") == probe).select("event_id", "stage_id")


def coverage_share(sample: Column, population: Column) -> Column:
    """The share of a population that a sample covers, from 0 to 1; null without a population."""
    return F.when(population > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), sample / population)))


#: The status after each type of event.
STATUS = {"plan.completed": "Planned", "stage.started": "Running", "stage.completed": "Succeeded", "stage.failed": "Failed"}


def stage_status(events: DataFrame) -> DataFrame:
    """(run_id, stage, status, error, runtime_s): where each stage stands after its newest event; partial aggregates only.

    events: run_id, stage, seq, type, ts, error_class, message. run.started begins anew: what came before it does
    not count. An error, as class and message, is that of a failure that nothing has followed.
    """
    began = events.where("type = 'run.started'").groupBy("run_id").agg(F.max("seq").alias("_began"))
    rows = events.where(F.col("type").isin(*STATUS)).join(began, "run_id", "left").where(F.col("seq") > F.coalesce("_began", F.lit(-1)))
    start, end = F.col("type") == "stage.started", F.col("type").isin("stage.completed", "stage.failed")
    text = F.concat_ws(": ", "error_class", "message")
    last = rows.groupBy("run_id", "stage").agg(F.max_by("type", "seq").alias("type"), F.max_by(F.when(start, F.col("ts")), F.when(start, F.col("seq"))).alias("_start"), F.max_by(F.when(end, F.col("ts")), F.when(end, F.col("seq"))).alias("_end"), F.max_by(text, "seq").alias("_error"))
    names = F.create_map(*[F.lit(x) for pair in STATUS.items() for x in pair])
    return last.select("run_id", "stage", names[F.col("type")].alias("status"), F.when(F.col("type") == "stage.failed", F.col("_error")).alias("error"), F.when(end, F.unix_seconds(F.col("_end").cast("timestamp")) - F.unix_seconds(F.col("_start").cast("timestamp"))).alias("runtime_s"))


def quarantine_feed(events: DataFrame, quarantine: str = "error", reversal: str = "view", within_s: int | None = None) -> DataFrame:
    """(event_id, reversed_by): each quarantine with the next reversal of its run, at most within_s seconds later if that is given."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    if within_s is not None:
        own = events.where(F.col("event_type") == quarantine).select("event_id", "user_id", "ts")
        back = events.where(F.col("event_type") == reversal).select("user_id", F.col("event_id").alias("_r"), F.col("ts").alias("_at"))
        after = (F.col("_at") > F.col("ts")) | ((F.col("_at") == F.col("ts")) & (F.col("_r") > F.col("event_id")))
        near = own.join(back, "user_id").where(after & (F.col("_at") <= F.col("ts") + F.make_dt_interval(secs=F.lit(within_s)))).groupBy("event_id").agg(F.min("_r").alias("reversed_by"))
        return own.select("event_id").join(near, "event_id", "left")
    return events.withColumn("reversed_by", F.min(F.when(F.col("event_type") == reversal, F.col("event_id"))).over(w)).where(F.col("event_type") == quarantine).select("event_id", "reversed_by")


def latest_status(events: DataFrame) -> DataFrame:
    """The newest event of each run, by a partial aggregate."""
    return events.groupBy("user_id").agg(F.max_by(F.struct("event_type", "event_id"), F.struct("ts", "event_id")).alias("_l")).select("user_id", F.col("_l.event_type").alias("status"), F.col("_l.event_id").alias("event_id"))


def lease_view(board: DataFrame, as_of: Column, lease_s: int = 45, beat_s: int = 10) -> DataFrame:
    """board (anchor, terminal) with seconds of lease left (0 at least, null once terminal) and whether a heartbeat is overdue."""
    age = F.unix_seconds(as_of.cast("timestamp")) - F.unix_seconds(F.col("anchor").cast("timestamp"))
    return board.withColumn("lease_left_s", F.when(~F.col("terminal"), F.greatest(F.lit(0), lease_s - age))).withColumn("overdue", F.when(~F.col("terminal"), age > beat_s))
