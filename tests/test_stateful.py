"""Stateful streams against their batch twins, on a log that is replayed out of order."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from keepsake.operators import events as ev
from keepsake.streaming import folds, stateful
from tests.test_streaming import at, drain, stream

STORE = "spark.sql.streaming.stateStore.providerClass"


@pytest.fixture(scope="module", autouse=True)
def rocks(spark):
    before = spark.conf.get(STORE)
    spark.conf.set(STORE, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(STORE, before)


SCHEMA = "event_id long, ts timestamp, user_id long, event_type string, value double"
KINDS = ["view", "click", "purchase", "signup", "error"]


@pytest.fixture(scope="module")
def log():
    r = random.Random(5)
    times = sorted(r.randrange(86_400 * 1000) for _ in range(400))
    return [(k, datetime(2024, 1, 1) + timedelta(milliseconds=t), r.randrange(9), r.choice(KINDS), r.randrange(1, 4000) / 100) for k, t in enumerate(times)]


@pytest.fixture(scope="module")
def batch(spark, log):
    return spark.createDataFrame(log, SCHEMA).cache()


@pytest.fixture
def replay(spark, log, tmp_path):
    """The log shuffled over its first and second half, then what moves the watermark past it."""
    r = random.Random(6)
    halves = [log[:200], log[200:]]
    for h in halves:
        r.shuffle(h)
    far = [[(10_000 + k, datetime(2024, 3, 1 + k), 99, "other", 0.0)] for k in range(3)]
    return stream(spark, tmp_path, [halves[0][:90], halves[0][90:], halves[1][:120], halves[1][120:], *far], SCHEMA)


def same(a, b):
    return sorted(map(tuple, a), key=str) == sorted(map(tuple, b), key=str)


def test_probes_as_a_stream(spark, batch, replay):
    got = drain(spark, stateful.attach_probes(replay, late="1 day"), "probes", "append")
    assert same(got, ev.attach_probes(batch).collect()) and len(got) > 50


def test_quarantines_as_a_stream(spark, batch, replay):
    got = drain(spark, stateful.quarantine_feed(replay, "2 hours", late="1 day"), "feed", "append")
    assert same(got, ev.quarantine_feed(batch, within_s=7200).collect())
    assert any(r.reversed_by is None for r in got) and any(r.reversed_by is not None for r in got)
    # a bound that no pair exceeds is no bound
    assert same(ev.quarantine_feed(batch, within_s=86_400 * 2).collect(), ev.quarantine_feed(batch).collect())


def test_late_missing_and_double_reversals(spark, tmp_path):
    rows = [[(1, at(0), 1, "error", 0.0), (2, at(5), 1, "view", 0.0), (3, at(9), 1, "view", 0.0), (4, at(10), 2, "error", 0.0)], [(5, at(11), 3, "error", 0.0), (6, at(200), 3, "view", 0.0)], [(7, at(900), 9, "other", 0.0)], [(8, at(901), 9, "other", 0.0)], [(9, at(1900), 9, "view", 0.0)], [(10, at(1901), 9, "view", 0.0)]]
    got = drain(spark, stateful.quarantine_feed(stream(spark, tmp_path, rows, SCHEMA), "60 seconds", late="0 seconds"), "reversals", "append")
    assert {tuple(r) for r in got} == {(1, 2), (4, None), (5, None)}


def alarms_of(found):
    return {(r.start_s, round(r.value, 6)) for r in found}


@pytest.mark.parametrize("name", ["reuse_rate", "retries", "failures"])
def test_alarms_as_streams(spark, batch, replay, name):
    kind, v = F.col("event_type"), F.col("value")
    value, breach, periods, seconds = {
        "reuse_rate": (F.try_divide(F.count_if(kind == "view"), F.count_if(kind.isin("view", "click"))), v < 0.6, 3, 3600), "retries": (F.sum(F.when(kind == "purchase", v)), v > 10, 2, 3600), "failures": (F.count_if(kind == "error"), v > 0, 1, 60),
    }[name]
    got = drain(spark, stateful.alarm_stream(replay, value, breach, periods, seconds, late="1 day"), f"alarm_{name}", "append")
    want = alarms_of(ev.alarm_runs(batch, value, breach, periods, seconds).collect())
    assert alarms_of(got) == want and len(got) == len(want) and want


def test_missing_periods_do_not_breach(spark):
    rows = [(k, at(s), 1, "error", 1.0) for k, s in enumerate([0, 60, 240, 300])]
    got = ev.alarm_runs(spark.createDataFrame(rows, SCHEMA), F.count_if(F.col("event_type") == "error"), F.col("value") > 0, 2, 60)
    assert {r.start_s % 3600 for r in got.collect()} == {60, 300}


# --- stages


def stage_events(events):
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "purchase", "plan.completed").when(t == "view", "stage.started").when(t == "click", "stage.completed").when(t == "error", "stage.failed").when(k % 3 == 0, "run.started").otherwise("other")
    return events.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("run_id"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("stage"), k.alias("seq"), kind.alias("type"), "ts", F.when(k % 2 == 0, "E").alias("error_class"), F.col("event_id").cast("string").alias("message"))


def test_stages_as_a_stream(spark, batch, replay):
    got = drain(spark, stateful.stage_board(stage_events(replay), late="1 day"), "stage_board", "update")
    last = {}
    for r in got:
        last[r.run_id, r.stage] = tuple(r)[:5]  # rows of one key come in the order of batches
    now = [v for v in last.values() if v[2] is not None and v[0] != "r99"]
    assert same(now, ev.stage_status(stage_events(batch)).collect())
    assert any(r.status is None for r in got) and any(r.error for r in got)


# --- claims

CLAIM = "work_key string, type string, owner string, fence long, took_over_from string, worker string, ts timestamp"


def claim(key, kind, s, owner=None, fence=None, took=None, worker=None):
    return (key, f"claim.{kind}", owner, fence, took, worker, at(s))


def test_claims_board_as_a_stream(spark, tmp_path):
    batches = [
        [claim("k", "heartbeat", 5), claim("k", "acquired", 0, "a", 1), claim("c", "contended", 1, "inc", 4, worker="me"), claim("s", "subscribed", 2, "own", worker="me"), claim("lost", "acquired", 2, "y", 1)],
        [claim("k", "takeover", 60, "b", 2), claim("k", "heartbeat", 61, fence=1), claim("c", "subscribed", 50, worker="other"), claim("s", "subscribe_completed", 62)],
        [claim("k", "completed", 90, fence=2), claim("k", "acquired", 91, "zombie", 1), claim("late", "lease_expired", 92), claim("late", "heartbeat", 93)],
        [claim("k", "acquired", 95, "zombie", 1), claim("k", "heartbeat", 96, fence=1)],
        [claim("x", "acquired", 400, "n", 1)],
        [claim("x", "heartbeat", 410)],
    ]
    board = stateful.claim_board(stream(spark, tmp_path, batches, CLAIM), late="0 seconds", keep_s=120)
    got = [tuple(r) for r in drain(spark, board, "claims_board", "update")]
    assert {("k", "owned", "a", None, 1, 1), ("k", "took_over", "b", "a", 2, 0), ("k", "completed", "b", "a", 2, 0), ("c", "contended", "inc", "me", 4, 0), ("s", "subscribed", "own", "me", None, 0), ("s", "subscribe_completed", "own", "me", None, 0)} <= set(got)
    assert ("lost", "lease_expired", "y", None, 1, 0) in got and ("late", "owned", None, None, None, 1) in got
    assert [r for r in got if r[0] == "k"][-1][1:3] == ("completed", "b")  # stale fences change nothing after the end
    everything = [(k, *row) for k, row in enumerate(x for b in batches for x in b)]
    twin = {r.work_key: tuple(r)[:6] for r in ev.claims_board(spark.createDataFrame(everything, f"seq long, {CLAIM}")).collect()}
    assert twin["k"] == ("k", "completed", "b", "a", 2, 0) and twin["c"] == ("c", "subscribed", "inc", "me", 4, 0) and twin["late"] == ("late", "owned", None, None, None, 1)


def test_claims_board_equals_the_fold(spark):
    r = random.Random(8)
    kinds = ["heartbeat", *[k.removeprefix("claim.") for k in ev.PHASES]]
    rows = []
    for n in range(600):
        rows.append((n, *claim(f"k{r.randrange(8)}", r.choice(kinds), r.randrange(3000), r.choice([None, "", "a", "b"]), r.choice([None, n // 100, n // 100 - 1]), r.choice([None, "t"]), r.choice([None, "w", "v"]))))
    want = {}
    for n, key, kind, owner, fence, took, worker, ts in sorted(rows, key=lambda x: (x[7], x[0])):
        want[key] = ev.next_claim(want.get(key), kind, owner, fence, int(ts.timestamp() * 1000), took, worker)
    got = {x.work_key: tuple(x)[1:6] for x in ev.claims_board(spark.createDataFrame(rows, f"seq long, {CLAIM}")).collect()}
    assert got == {k: v[:5] for k, v in want.items()}


def test_reaper_goes_by_the_fence(spark, tmp_path):
    schema = "work_key string, fence long, open boolean, ts timestamp"
    batches = [[("a", 5, True, at(0)), ("a", 5, False, at(10)), ("a", 4, True, at(20))], [("z", 1, True, at(300))], [("z", 1, True, at(301))]]
    got = drain(spark, folds.reaper(stream(spark, tmp_path, batches, schema), late="0 seconds"), "fenced_reaper", "append")
    assert not [r for r in got if r.work_key == "a"]


# --- sketches


def test_sketches_merge_exactly(spark, batch):
    keyed = batch.withColumn("start_s", ev.period_start(F.col("ts"), 300))
    fine = ev.quantile_sketch(keyed, ["start_s"], F.col("value"))
    merged = ev.merge_sketches(fine, [F.lit(1).alias("all")])
    direct = ev.quantile_sketch(keyed.withColumn("all", F.lit(1)), ["all"], F.col("value"))
    assert same(merged.collect(), direct.collect())
    values = sorted(r.value for r in batch.select("value").collect())
    for share in (0.01, 0.5, 0.9, 1.0):
        found = ev.sketch_quantile(merged, ["all"], share).first()
        exact = values[-(-int(len(values) * share * 1000) // 1000) - 1]
        assert abs(found.value - exact) <= 0.0100001 * exact and found.n == len(values)
    odd = spark.createDataFrame([(1, 0.0), (1, -3.0), (1, None), (2, 1e-9), (2, 1e18), (2, 5.0)], "g int, value double")
    got = {r.g: (r.n, round(r.value, 3)) for r in ev.sketch_quantile(ev.quantile_sketch(odd, ["g"], F.col("value")), ["g"]).collect()}
    assert got[1] == (2, 0.0) and got[2][0] == 3 and abs(got[2][1] - 5) <= 0.05
