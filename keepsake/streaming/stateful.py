"""Folds with state of their own: transformWithState, and joins of streams.

The session's state store must be RocksDB (spark.sql.streaming.stateStore.providerClass). State is small for each
key and ends by event-time timers.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor

from keepsake.operators.events import PHASES, STATUS, TERMINAL_PHASES, next_claim

LEASE_S, KEEP_S = 45, 600


def _ordered(rows: Iterator[pd.DataFrame], by: list[str]) -> pd.DataFrame:
    """One key's rows of one batch."""
    return pd.concat(list(rows)).sort_values(by, kind="stable")


def _value(x, kind=str):
    return None if x is None or pd.isna(x) else kind(x)


class _OneTimer(StatefulProcessor):
    """Keeps at most one event-time timer a key."""

    def init(self, handle) -> None:
        self.handle = handle

    def at(self, ms: int | None) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        if ms is not None:
            self.handle.registerTimer(int(ms))

    def close(self) -> None:
        pass


class _Claims(_OneTimer):
    def __init__(self, lease_s: int, keep_s: int):
        self.lease_ms, self.keep_ms = lease_s * 1000, keep_s * 1000

    def init(self, handle) -> None:
        super().init(handle)
        self.claim = handle.getValueState("claim", "phase string, owner string, challenger string, fence long, beats long, anchor long, last long")

    def _row(self, key, now: tuple) -> pd.DataFrame:
        return pd.DataFrame([(key[0], *now[:5])], columns=["work_key", "phase", "owner", "challenger", "fence", "beats"])

    def handleInputRows(self, key, rows, timerValues):
        now = self.claim.get() if self.claim.exists() else None
        for r in _ordered(rows, ["ms"]).itertuples(index=False):
            now = next_claim(now, r.type, _value(r.owner), _value(r.fence, int), int(r.ms), _value(r.took_over_from), _value(r.worker))
        self.claim.update(tuple(now))
        # an ended claim stays as a tombstone with its fence; a running one until its lease is over
        self.at(max(now[6] + self.keep_ms if now[0] in TERMINAL_PHASES else now[5] + self.lease_ms, timerValues.getCurrentWatermarkInMs() + 1))
        yield self._row(key, now)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        now = tuple(self.claim.get())
        if now[0] in (*TERMINAL_PHASES, "lease_expired"):
            self.claim.clear()
            return
        now = ("lease_expired", *now[1:])
        self.claim.update(now)
        self.at(expiredTimerInfo.getExpiryTimeInMs() + self.keep_ms)
        yield self._row(key, now)


def claim_board(events: DataFrame, lease_s: int = LEASE_S, keep_s: int = KEEP_S, late: str = "10 minutes") -> DataFrame:
    """The board of claims (work_key, phase, owner, challenger, fence, beats) from a stream of claim events; in update mode.

    events: work_key, type, owner, fence, ts, and if known took_over_from and worker (who has seen the event). A
    batch's events count in the order of their times; the batch form is keepsake.operators.events.claims_board(). A
    claim whose lease runs out by the watermark is reported as lease_expired. Ended and expired claims keep
    their fence for another keep_s seconds of event time, so that stale events of theirs change nothing.
    """
    given = lambda c: F.col(c) if c in events.columns else F.lit(None).cast("string").alias(c)
    rows = events.withWatermark("ts", late).select("work_key", "type", "owner", F.col("fence").cast("long").alias("fence"), given("took_over_from"), given("worker"), "ts", F.unix_millis("ts").alias("ms"))
    return rows.groupBy("work_key").transformWithStateInPandas(_Claims(lease_s, keep_s), "work_key string, phase string, owner string, challenger string, fence long, beats long", "Update", "EventTime")


class _Stages(_OneTimer):
    def __init__(self, keep_s: int):
        self.keep_ms = keep_s * 1000

    def init(self, handle) -> None:
        super().init(handle)
        self.began = handle.getValueState("began", "seq long, last_ms long")
        self.stages = handle.getMapState("stages", "stage string", "seq long, type string, error string, start_seq long, start_s long, end_seq long, end_s long")

    def handleInputRows(self, key, rows, timerValues):
        batch = _ordered(rows, ["seq"])
        began, last = self.began.get() if self.began.exists() else (-1, 0)
        starts = batch.loc[batch["type"] == "run.started", "seq"]
        changed: dict[str, tuple | None] = {}
        if len(starts) and int(starts.max()) > began:
            began = int(starts.max())
            # what came before it goes; newest values decide, so nothing that stays is lost
            changed = {k[0]: _since(tuple(v), began) for k, v in list(self.stages.iterator())}
        for r in batch.itertuples(index=False):
            if r.type not in STATUS or r.stage is None or int(r.seq) <= began:
                continue
            if r.stage not in changed:
                changed[r.stage] = tuple(self.stages.getValue((r.stage,))) if self.stages.containsKey((r.stage,)) else None
            seq, kind, error, start_seq, start_s, end_seq, end_s = changed[r.stage] or (-1, "", None, -1, None, -1, None)
            n = int(r.seq)
            if n > seq:
                seq, kind, error = n, r.type, ": ".join(x for x in (_value(r.error_class), _value(r.message)) if x is not None)
            if r.type == "stage.started" and n > start_seq:
                start_seq, start_s = n, int(r.seconds)
            if r.type in ("stage.completed", "stage.failed") and n > end_seq:
                end_seq, end_s = n, int(r.seconds)
            changed[r.stage] = (seq, kind, error, start_seq, start_s, end_seq, end_s)
        out = []
        for stage, v in changed.items():
            if v is None:
                self.stages.removeKey((stage,))
                out.append((key[0], stage, None, None, None, began))
                continue
            self.stages.updateValue((stage,), v)
            ended = v[1] in ("stage.completed", "stage.failed")
            out.append((key[0], stage, STATUS[v[1]], v[2] if v[1] == "stage.failed" else None, v[6] - v[4] if ended and v[4] is not None else None, v[0]))
        last = max(last, int(batch["ms"].max()))
        self.began.update((began, last))
        self.at(max(last + self.keep_ms, timerValues.getCurrentWatermarkInMs() + 1))
        if out:
            yield pd.DataFrame(out, columns=["run_id", "stage", "status", "error", "runtime_s", "seq"]).astype({"runtime_s": "Int64"})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.stages.clear()
        self.began.clear()
        return iter(())


def _since(v: tuple, began: int) -> tuple | None:
    seq, kind, error, start_seq, start_s, end_seq, end_s = v
    if seq <= began:
        return None
    return (seq, kind, error, *((start_seq, start_s) if start_seq > began else (-1, None)), *((end_seq, end_s) if end_seq > began else (-1, None)))


def stage_board(events: DataFrame, keep_s: int = 7 * 86_400, late: str = "10 minutes") -> DataFrame:
    """(run_id, stage, status, error, runtime_s, seq): each change of where a stage stands, from a stream of stage events; in update mode.

    events: run_id, stage, seq, type, ts, error_class, message. The newest row (by seq) of a run and stage is that of
    keepsake.operators.events.stage_status(), whatever the order in which events come: of each kind of event only the
    one with the highest seq is kept. run.started resets all stages of its run, which are reported once without a
    status. A run's state ends keep_s after its last event.
    """
    rows = events.withWatermark("ts", late).select("run_id", "stage", F.col("seq").cast("long").alias("seq"), "type", "ts", "error_class", "message", F.unix_seconds("ts").alias("seconds"), F.unix_millis("ts").alias("ms"))
    return rows.groupBy("run_id").transformWithStateInPandas(_Stages(keep_s), "run_id string, stage string, status string, error string, runtime_s long, seq long", "Update", "EventTime")


class _Probes(_OneTimer):
    """Holds a run's events until the watermark has passed them, then takes them in order."""

    def __init__(self, keep_s: int):
        self.keep_ms = keep_s * 1000

    def init(self, handle) -> None:
        super().init(handle)
        self.waiting = handle.getListState("waiting", "us long, event_id long, probe boolean")
        self.running = handle.getValueState("running", "stage_id long, last_ms long")

    def handleInputRows(self, key, rows, timerValues):
        for frame in rows:
            frame = frame[frame["kind"].notna()]
            if len(frame):
                self.waiting.appendList([(int(u), int(e), bool(p)) for u, e, p in zip(frame["us"], frame["event_id"], frame["kind"], strict=True)])
        if self.waiting.exists() and (waiting := list(self.waiting.get())):
            self.at(max(min(r[0] for r in waiting) // 1000 + 1, timerValues.getCurrentWatermarkInMs() + 1))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        passed = timerValues.getCurrentWatermarkInMs()
        stage, last = self.running.get() if self.running.exists() else (None, 0)
        waiting = sorted(tuple(r) for r in self.waiting.get()) if self.waiting.exists() else []
        ready = [r for r in waiting if r[0] // 1000 < passed]
        out = []
        for us, event_id, probe in ready:
            if probe:
                out.append((event_id, stage))
            else:
                stage = event_id if stage is None else max(stage, event_id)
            last = us // 1000
        rest = waiting[len(ready) :]
        self.running.update((stage, last))
        if rest:
            self.waiting.put(rest)
            self.at(max(rest[0][0] // 1000 + 1, passed + 1))
        elif ready or passed < last + self.keep_ms:
            self.waiting.clear()
            self.at(max(last + self.keep_ms, passed + 1))
        else:
            self.running.clear()
        if out:
            yield pd.DataFrame(out, columns=["event_id", "stage_id"]).astype({"stage_id": "Int64"})


def attach_probes(events: DataFrame, probe: str = "signup", stages: tuple[str, ...] = ("view", "click", "purchase"), keep_s: int = 7 * 86_400, late: str = "10 minutes") -> DataFrame:
    """(event_id, stage_id): each probe with the newest stage event of its run until then, as a stream; in append or update mode.

    Events (event_id, ts, user_id, event_type) may come in any order inside the watermark: a run's wait until it has passed them.
    The batch form is keepsake.operators.events.attach_probes(). A run without events for keep_s seconds is forgotten.
    """
    rows = events.withWatermark("ts", late)
    # all events move the watermark, so others than these go through the state as well, and leave nothing in it
    kind = F.when(F.col("event_type") == probe, 1).when(F.col("event_type").isin(*stages), 0)
    rows = rows.select("user_id", "ts", F.unix_micros("ts").alias("us"), F.col("event_id").cast("long").alias("event_id"), kind.alias("kind"))
    return rows.groupBy("user_id").transformWithStateInPandas(_Probes(keep_s), "event_id long, stage_id long", "Append", "EventTime")


def quarantine_feed(events: DataFrame, within: str, quarantine: str = "error", reversal: str = "view", late: str = "10 minutes") -> DataFrame:
    """(event_id, reversed_by): each quarantine with the reversal of its run that has the lowest id of those after it, as a stream; in append mode.

    A left outer join of two streams with a bound in time, then the first of several reversals. A quarantine is
    reported once, when the watermark has passed it by the bound: with no reversal if none has come until then. The
    batch form is keepsake.operators.events.quarantine_feed() with the same bound.
    """
    # conditions on the time too, so that they stay above the watermark, which all events move
    kind = F.when(F.col("ts").isNotNull(), F.col("event_type"))
    events = events.withWatermark("ts", late)
    own = events.where(kind == quarantine).select(F.col("ts").alias("q_ts"), F.col("user_id").alias("q_run"), "event_id")
    back = events.where(kind == reversal).select(F.col("ts").alias("r_ts"), F.col("user_id").alias("r_run"), F.col("event_id").alias("r_id"))
    after = (F.col("r_ts") > F.col("q_ts")) | ((F.col("r_ts") == F.col("q_ts")) & (F.col("r_id") > F.col("event_id")))
    both = own.join(back, (F.col("q_run") == F.col("r_run")) & (F.col("r_ts") >= F.col("q_ts")) & (F.col("r_ts") <= F.col("q_ts") + F.expr(f"INTERVAL {within}")) & after, "leftOuter")
    return both.groupBy("event_id", "q_ts").agg(F.min("r_id").alias("reversed_by")).select("event_id", "reversed_by")


def alarm_stream(events: DataFrame, value: Column, breach: Column, periods: int, seconds: int, late: str = "10 minutes") -> DataFrame:
    """(start_s, value): starts of periods in which a measure has been in breach for so many periods on end, with its value summed over them; in append mode.

    value: an aggregate over the events of one period; breach: a condition on it, as column value. Two stateful
    aggregates, one over periods and one over runs of them; a period without events is not in breach.
    """
    per = events.withWatermark("ts", late).groupBy(F.window("ts", f"{seconds} seconds")).agg(value.alias("value"))
    hit = per.where(breach).select(F.window_time("window").alias("at"), "value")
    run = hit.groupBy(F.window("at", f"{seconds * periods} seconds", f"{seconds} seconds").alias("run")).agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("value"))
    return run.where(F.col("k") == periods).select((F.unix_seconds("run.end") - seconds).alias("start_s"), "value")
