"""Running folds against their definition, over files that arrive one after another."""

from datetime import datetime

from pyspark.sql import functions as F

from keepsake.operators.events import lease_view
from keepsake.streaming import folds, stateful


def drain(spark, df, name, mode):
    q = df.writeStream.outputMode(mode).format("memory").queryName(name).trigger(availableNow=True).start()
    assert q.awaitTermination(600)
    assert q.exception() is None
    return spark.table(name).collect()


def stream(spark, tmp_path, batches, schema):
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{k}"))
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path))


def at(s):
    return datetime(2024, 1, 1, 0, s // 60, s % 60)


def test_tally_metrics_and_dedup(spark, tmp_path):
    schema = "event_id long, type string, ts timestamp"
    batches = [[(1, "view", at(0)), (2, "click", at(10)), (1, "view", at(0))], [(3, "view", at(400)), (2, "click", at(10))]]
    events = stream(spark, tmp_path, batches, schema)
    last = {r.type: r.n for r in drain(spark, folds.stream_tally(events), "tally", "complete")}
    assert last == {"view": 3, "click": 2}
    assert sorted(r.event_id for r in drain(spark, folds.dedup_events(events, ["event_id"]), "once", "append")) == [1, 2, 3]
    windows = {(r.start.minute, r.n, r.reuse) for r in drain(spark, folds.stream_metrics(events, late="0 seconds"), "metrics", "update")}
    assert (5, 1, 1) in windows


def test_stage_status(spark, tmp_path):
    schema = "run_id string, stage string, type string, ts timestamp"
    batches = [[("r", "env", "stage.started", at(1)), ("r", "eval", "stage.started", at(2))], [("r", "env", "stage.completed", at(9))]]
    got = drain(spark, folds.stage_status(stream(spark, tmp_path, batches, schema)), "stages", "complete")
    assert {(r.stage, r.status, r.runtime_s) for r in got} == {("env", "Succeeded", 8), ("eval", "Running", None)}


def test_claim_board(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema = "work_key string, type string, owner string, fence long, ts timestamp"
    batches = [
        [("k", "claim.heartbeat", None, None, at(5)), ("k", "claim.acquired", "a", 1, at(0)), ("m", "claim.acquired", "z", 1, at(1)), ("lost", "claim.acquired", "y", 1, at(2))],
        [("k", "claim.takeover", "b", 2, at(60)), ("k", "claim.heartbeat", None, 1, at(61)), ("m", "claim.completed", None, 1, at(62))],
        [("k", "claim.heartbeat", None, 2, at(90)), ("k", "claim.heartbeat", None, 2, at(170))],
        [("k", "claim.heartbeat", None, 2, at(200))],
    ]
    got = drain(spark, stateful.claim_board(stream(spark, tmp_path, batches, schema), late="0 seconds"), "board", "update")
    seen = {(r.work_key, r.phase, r.owner, r.challenger, r.fence, r.beats) for r in got}
    assert {("k", "owned", "a", None, 1, 1), ("k", "took_over", "b", "a", 2, 0), ("m", "completed", "z", None, 1, 0), ("lost", "lease_expired", "y", None, 1, 0)} <= seen
    assert not any(k == "m" and phase == "lease_expired" for k, phase, *_ in seen)  # its state went when it was done


def test_reaper(spark, tmp_path):
    schema = "work_key string, fence long, open boolean, ts timestamp"
    batches = [[("a", 1, True, at(0)), ("b", 3, True, at(0)), ("c", 1, True, at(5))], [("b", 3, True, at(40)), ("c", 1, False, at(10))], [("z", 1, True, at(80))], [("z", 1, True, at(300))], [("z", 2, True, at(900))]]
    got = {(r.work_key, r.fence, r.expired_at) for r in drain(spark, folds.reaper(stream(spark, tmp_path, batches, schema), late="0 seconds"), "reaper", "append")}
    assert {("a", 1, at(45)), ("b", 3, at(85))} <= got and not any(k == "c" for k, *_ in got)


def test_lease_view(spark):
    board = spark.createDataFrame([("a", at(0), False), ("b", at(50), False), ("c", at(0), True)], "k string, anchor timestamp, terminal boolean")
    got = {r.k: (r.lease_left_s, r.overdue) for r in lease_view(board, F.lit(at(55))).collect()}
    assert got == {"a": (0, True), "b": (40, False), "c": (None, None)}
