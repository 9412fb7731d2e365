"""Guarded queries, failure search on both sides of its size, plans by level, canonical ids, receipts and other cases."""

import threading
import time

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake import fixtures
from keepsake.functions import canon, tasks
from keepsake.functions.scratch import cut
from keepsake.operators import claims, codegraph, corpus, derivations, identity, incremental, memory, trace
from keepsake.plans import guard


def test_guard_refuses_all_but_queries(spark):
    t = spark.range(500)
    for sql in (
        "SELECT TRANSFORM (a) USING 'cat' AS (b string) FROM VALUES (1) v(a)", "SELECT count(*) FROM text.`/etc/passwd`", "SELECT * FROM parquet.`/x` JOIN {t} USING (id)", "SELECT * FROM other", "SELECT (SELECT max(value) FROM text.`/etc/hosts`) FROM {t}",
        "DROP TABLE x", "SET a=b", "SHOW TABLES", "EXPLAIN SELECT 1", "SELECT java_method('java.lang.System', 'exit', 0)", "SELECT 1; SELECT 2", "CACHE TABLE x", "INSERT INTO x SELECT 1", "SELECT * FROM read_files('/x')", "WITH a AS (SELECT * FROM b) SELECT * FROM a",
    ):
        with pytest.raises(guard.Refused):
            guard.safe_select(spark, sql, t=t)


def test_guard_limits(spark):
    t = spark.range(500)
    n = lambda sql: guard.safe_select(spark, sql, t=t).count()
    assert n("WITH x AS (SELECT id FROM {t}) SELECT * FROM x LIMIT 100") == 100
    assert n("WITH x AS (SELECT id FROM {t} LIMIT 3), y AS (SELECT * FROM x) SELECT * FROM y") == 3
    assert n("SELECT id FROM {t} LIMIT 100 OFFSET 1") == 100 and n("SELECT id FROM {t}") == 25
    assert n("SELECT id FROM {t} WHERE rlike(cast(id AS string), '^a{2}|1{1}$') LIMIT 9") == 9
    assert n("SELECT a.id FROM {t} a JOIN (VALUES (1), (2)) b(id) ON a.id = b.id") == 2
    assert n("SELECT * FROM range(7)") == 7 and not [v.name for v in spark.catalog.listTables() if "guarded" in v.name]


def test_guard_ends_a_slow_query(spark):
    slow = spark.range(4, numPartitions=2).select(F.expr("aggregate(sequence(1, 2000000), 0L, (a, x) -> a + length(sha2(cast(x + id AS string), 512)))").alias("x"))
    other: list = []
    beside = threading.Thread(target=lambda: other.append(spark.range(10).count()))
    began = time.time()
    with pytest.raises(guard.TimedOut):
        beside.start()
        guard.payload(spark.range(64, numPartitions=64).crossJoin(slow), seconds=1)
    beside.join()
    assert other == [10] and time.time() - began < 60
    assert guard.payload(guard.safe_select(spark, "SELECT 1 AS a"))[0] == '[{"a":1}]'


def test_failure_search_is_the_same_at_every_size(spark):
    signatures = spark.createDataFrame([(k, f"s{k % 3}" if k % 7 else None, f"e{k % 2}", [float(k % 5), 1.0, float(k)]) for k in range(60)], "signature_id long, stage string, error_class string, embedding array<double>")
    asked = [(q, s, e, [1.0, float(q), 2.0]) for q, (s, e) in enumerate([("s0", "e1"), (None, "e0"), ("s1", None), (None, None), ("s9", "e0"), (None, None)])]
    queries = spark.createDataFrame(asked, "query_id long, stage string, error_class string, vector array<double>")
    for more in ({}, {"by_error": False, "by_stage": False}):
        found = [sorted((r.query_id, r.place, r.signature_id, r.distance) for r in memory.search_failures(signatures, queries, k=4, most_bytes=size, **more).collect()) for size in (1 << 20, 0)]
        assert found[0] == found[1] and {x[0] for x in found[0]} >= {0, 1, 2, 3, 5}
    assert memory.search_failures(signatures, queries.limit(0)).count() == 0


def test_failure_search_equals_every_pair(spark, monkeypatch):
    """Odd vectors, many copies and many blocks, against cosine_distance() of every pair."""
    rng = np.random.default_rng(5)
    odd = [None, [], [0.0] * 4, [1.0, None, 2.0, 3.0], [1.0, 2.0], [float("nan"), 1.0, 1.0, 1.0], [float("inf"), 1.0, 1.0, 1.0], [1e200] * 4, [1e-200] * 4, [-0.0, 1.0, 0.0, 0.0]]
    vectors = [odd[k % 10] if k % 4 == 0 else [1.0, 2.0, 3.0, 4.0] if k % 4 == 1 else rng.normal(size=4).tolist() for k in range(240)]
    rows = [(f"i{k:03d}" if k % 50 else None, None if k % 13 == 0 else f"s{k % 2}", f"e{k % 3}", v) for k, v in enumerate(vectors)]
    signatures = spark.createDataFrame(rows, "signature_id string, stage string, error_class string, embedding array<double>")
    asked = [(q, [None, "s0", "s1"][q % 3], [None, "e0"][q % 2], v) for q, v in enumerate([*odd, *vectors[1:40]])]
    queries = spark.createDataFrame(asked, "query_id long, stage string, error_class string, vector array<double>")
    same = lambda a, b: F.col(a).isNull() | (F.col(a) == F.col(b))
    pairs = queries.toDF("query_id", "a", "b", "v").join(signatures, same("a", "stage") & same("b", "error_class")).withColumn("distance", memory.cosine_distance(F.col("embedding"), F.col("v")))
    placed = pairs.withColumn("place", F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("signature_id")))).where("place <= 5")
    read = lambda df: sorted((r.query_id, r.place, repr(r.distance), str(r.signature_id)) for r in df.select("query_id", "place", "distance", "signature_id").collect())
    want = read(placed)
    for block, tile in ((1 << 15, 1 << 22), (50, 60)):
        monkeypatch.setattr(memory, "BLOCK_ROWS", block)
        monkeypatch.setattr(memory, "TILE_PAIRS", tile)
        for size in (1 << 20, 1000):
            got = read(memory.search_failures(signatures, queries, k=5, most_bytes=size))
            assert [x[:3] for x in got] == [x[:3] for x in want] and {x for x in got if x[3] != "None"} == {x for x in want if x[3] != "None"}


def test_failure_search_makes_no_row_for_a_pair(spark):
    """Only k rows of a block for each query leave a task: a plan that joins every pair had one for each."""
    signatures = spark.range(3000).select(F.col("id").alias("signature_id"), F.lit("s").alias("stage"), F.lit("e").alias("error_class"), F.array(F.sin("id"), F.cos("id")).cast("array<float>").alias("embedding"))
    found = memory.search_failures(signatures, signatures.where("signature_id % 20 = 0").select(F.col("signature_id").alias("query_id"), "stage", "error_class", F.col("embedding").alias("vector")))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "FlatMapCoGroupsInArrow" in plan and "Join" not in plan and found.count() == 8 * 150


def test_trace_accesses_read_the_events_once(spark):
    """Sockets and random bytes come out of the fold's own reading of the events, in which other calls keep their descriptors."""
    calls = [("socket", "AF_INET", "3"), ("openat", 'AT_FDCWD, "a", O_RDONLY', "4"), ("getrandom", '"x", 8, 0', "8"), ("mmap", "NULL, 1, PROT_READ, MAP_PRIVATE, 4, 0", "0x7f"), ("connect", "3", "-1 EPERM (x)")]
    events = spark.createDataFrame([("t", n, 1, "syscall", *c) for n, c in enumerate(calls)], "trace_id string, line_no long, pid long, kind string, name string, args string, ret string").repartition(3)
    found = trace.trace_accesses(events, "/w")
    assert sorted((r.line_no, r.kind, r.ref, r.mode) for r in found.collect()) == [(0, "socket", "socket", "network"), (1, "file", "a", "read"), (2, "device", "device:getrandom", "read"), (3, "file", "a", "read"), (4, "socket", "connect", "network")]
    assert "Union" not in found._jdf.queryExecution().optimizedPlan().toString()


def test_whole_calls_are_read_by_one_pattern_once(spark):
    """Conditions on what was parsed do not repeat the patterns, of which a whole call needs one."""
    texts = ["1 open(\"a)=b\") =  3 ", "2\topen() = 4\n", "2 close(1) = -1 E (x) = y", "1\nopen\n3\na\n", "3 read(1) = 0\nx", "3 +++ exited with 1 +++", "x", "4 open( = 3", "12345678901 f(\u00e9,\\t$1) \t=\t ?"]
    parsed = trace.parse_trace(spark.createDataFrame(list(enumerate(texts)), "line_no int, line string"))
    assert sorted(map(tuple, parsed.drop("line").collect())) == [
        (0, "syscall", 1, "open", '"a)=b"', "3"), (1, "syscall", 2, "open", "", "4"), (2, "syscall", 2, "close", "1) = -1 E (x", "y"), (3, "unparsed", -1, "unparsed", "", ""), (4, "unparsed", -1, "unparsed", "", ""),
        (5, "exit", 3, "exit", "", "1"), (6, "unparsed", -1, "unparsed", "", ""), (7, "unparsed", -1, "unparsed", "", ""), (8, "syscall", 12345678901, "f", "\u00e9,\\t$1", "?"),
    ]
    some = parsed.where("kind = 'syscall' and name in ('open', 'close')")
    plan = some._jdf.queryExecution().optimizedPlan().toString()
    assert some.count() == 3 and plan.count("=\\s*(.+)$") == 1 and not [x for x in plan.split("\n") if "Filter" in x and "RLIKE" in x]


def test_traces_are_dealt_out_by_their_lines(spark):
    """Few shuffle partitions do not make large tasks; calls that touch nothing stay in the fold."""
    lines = spark.range(600).select((F.col("id") % 40).alias("trace_id"), F.col("id").alias("line_no"), F.when(F.col("id") % 3 == 0, '1 open("/a", O_RDONLY) = 3').when(F.col("id") % 3 == 1, "1 close(3) = 0").otherwise("1 mmap(NULL, 1, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f").alias("line"))
    events, _ = trace.join_resumed(trace.parse_trace(lines))
    few, many = trace.trace_accesses(events), trace.trace_accesses(events, rows=9 * tasks.TASK_ROWS)
    assert many.rdd.getNumPartitions() == 9 and sorted(few.collect()) == sorted(many.collect())
    met = trace.by_trace(lines, 9 * tasks.TASK_ROWS).select("trace_id", F.spark_partition_id().alias("task")).distinct()
    assert met.count() == 40
    calls, silent = (trace.resolve_calls(events, silent=x) for x in (False, True))
    assert silent.count() == 600 and calls.where("path is null and name <> 'open'").count() == 0
    assert sorted(calls.where("path is not null").collect()) == sorted(r for r in silent.collect() if r.path is not None)


def test_names_are_resolved_without_broadcasts(spark, monkeypatch):
    """Tables that every round looks up do not pass through the driver."""
    plans = []
    monkeypatch.setattr(codegraph, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    units = spark.createDataFrame([("a", "<module>"), ("b", "<module>"), ("b", "x")], "module string, name string")
    bindings = spark.createDataFrame([("a", "x", "b", "x")], "module string, local string, origin string, name string")
    found = codegraph.resolve(spark.createDataFrame([("a:f", "a", ["x"])], "src string, module string, path array<string>"), units, bindings)
    assert sorted(r.dst for r in found.collect()) == ["a:<module>", "b:x"]
    assert len(plans) > 6 and not [p for p in plans if "Broadcast" in p]


def test_rows_without_a_key_meet_in_no_one_task(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = spark.range(400).select(F.col("id").alias("work_key"), F.when(F.col("id") % 100 == 0, F.col("id")).alias("rule_id"))
        rules = spark.range(0, 400, 100).select(F.col("id").alias("rule_id"), F.lit("ACTIVE").alias("rule_state")).unionByName(spark.createDataFrame([(None, "none")], "rule_id long, rule_state string"))
        met = claims._join_named(rows, rules, "rule_id").withColumn("task", F.spark_partition_id()).collect()
        assert len(met) == 400 and {r.work_key for r in met if r.rule_state == "ACTIVE"} == {0, 100, 200, 300} and not [r for r in met if r.rule_state == "none"]
        assert "_spread" in claims._join_named(rows, rules, "rule_id")._jdf.queryExecution().executedPlan().toString().split("Exchange hashpartitioning(")[1].split(")")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_texts_are_not_batched_by_thousands(spark):
    """A vector's seed is hashed by Spark, and texts become canonical row by row."""
    plan = lambda c: spark.range(3).select(F.col("id").cast("string").alias("t")).select(c)._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" in plan(corpus.hash_embed(F.col("t"))) and "BatchEvalPython" in plan(canon.canonical_json(F.col("t")))
    rows = spark.createDataFrame([(1, ""), (2, None)], "id int, t string").select("id", corpus.hash_embed(F.col("t")).alias("v")).collect()
    assert rows[0].v == rows[1].v and len(rows[0].v) == 64


def test_graphs_probed_twice_are_walked_once(spark, monkeypatch):
    from keepsake.queries import corpus as queries

    walks = []
    monkeypatch.setattr(corpus, "reachable", lambda edges, roots: walks.append(1) or roots.select("node", F.lit(0).alias("depth")))
    inputs = spark.createDataFrame([("a1", "a3")], "ref string, artifact_id string")
    found = queries.c3_probe_struct(inputs, spark.createDataFrame([("a1", 1)], "artifact_id string, k int"))
    assert sorted((r.change, r.passed) for r in found.collect()) == [("inside", False), ("outside", True)] and len(walks) == 2


def test_audited_rows_are_dealt_out_by_their_number(spark, monkeypatch, tmp_path):
    """A task sorts TASK_ROWS rows or so, however few partitions the session's shuffles have (4 here)."""
    monkeypatch.setattr(tasks, "TASK_ROWS", 50)
    log = spark.range(2000).select((F.col("id") % 500).alias("work_key"), F.floor(F.col("id") / 500).alias("attempt"), F.when(F.col("id") % 500 == 7, -F.col("id")).otherwise(F.col("id")).alias("fence"), ((F.col("id") % 500 != 9) & (F.col("id") < 500)).alias("won"))
    for rows in ((), (2000,)):
        assert sorted(map(tuple, claims.audit_races(log, *rows).collect())) == [(7, 1, False), (9, 0, True)]
        lost = claims.audit_races(log.withColumn("won", F.lit(False)), *rows).groupBy(F.spark_partition_id()).count().collect()
        assert len(lost) > 30 and sum(r["count"] for r in lost) == 500
    spark.range(1000).select((F.col("id") % 300).alias("l_orderkey"), F.lit(1).alias("l_linenumber"), F.col("id").alias("l_partkey"), "id", F.lit(2).alias("l_suppkey"), F.lit(1.0).alias("l_extendedprice"), F.lit(1.0).alias("l_quantity")).write.parquet(f"{tmp_path}/lineitem.parquet")
    commits = fixtures.load(spark, str(tmp_path), "commits")
    assert commits.rdd.getNumPartitions() == 20 and {r.attempt: r.n for r in commits.groupBy("attempt").agg(F.count("*").alias("n")).collect()} == {1: 300, 2: 300, 3: 300, 4: 100}


def test_texts_of_changed_buckets_are_mapped_without_python(spark):
    from keepsake.queries import incremental as queries

    docs = spark.createDataFrame([(k, None if k % 10 == 3 else "é😀" * k) for k in range(200)], "doc_id long, text string")
    mutated = docs.where("doc_id < 150").withColumn("text", F.when(F.col("doc_id") % 50 == 1, "x").otherwise(F.col("text")))
    found = queries.a9_map_changed(docs, mutated)
    assert "Pandas" not in found._jdf.queryExecution().optimizedPlan().toString()
    leaves = spark.createDataFrame([(b, "COMPUTE" if b % 2 else "RESTORE") for b in range(64)], "bucket int, action string")
    rows = mutated.select(incremental.bucket_of(incremental.id_bytes("doc_id")).alias("bucket"), "text")
    in_python = incremental.map_changed(rows, leaves, lambda frames: (x.assign(n=x["text"].str.len())[["bucket", "n"]] for x in frames), "bucket int, n long")
    built_in = incremental.map_changed(rows, leaves, lambda x: x.select("bucket", F.length("text").cast("long").alias("n")), restored=in_python.limit(0))
    assert sorted(map(str, built_in.collect())) == sorted(map(str, in_python.collect())) and 0 < built_in.count() < 150
    old, new = (incremental.leaf_keys(queries._leaves(x), "g", "digest") for x in (docs, mutated))
    todo = {r.bucket for r in incremental.diff_leaves(new, old).collect() if r.action == "COMPUTE"}
    kept = [r for r in rows.collect() if r.bucket in todo]
    assert found.first() == (len(kept), sum(len(r.text or "") for r in kept), len(todo))


def test_datasets_are_compared_as_narrow_rows(spark):
    from keepsake.queries import incremental as queries

    nan = float("nan")
    rows = [(1, "a", b"a", 0.0), (1, "a", b"a", -0.0), (2, "", None, nan), (2, None, b"", nan), (3, "é😀", b"x", None), (None, None, None, None), (None, None, None, None)]
    a = spark.createDataFrame(rows, "k int, `a.b` string, c binary, d double")
    b = spark.createDataFrame([*rows[1:6], (2, None, None, nan), (3, "é", b"x", None), (3, "é", b"x", None)], "k long, `a.b` string, c binary, d double")
    for x, y in ((a, b), (b, a), (a, a.repartition(3)), (a, b.limit(0)), (a.limit(0), b), (a.limit(0), a.limit(0)), (a.select("k"), b.select("k")), (a, b.select(F.col("k").alias("z"), "`a.b`", "c", "d"))):
        want = (x.exceptAll(y).count(), y.exceptAll(x).count())
        assert incremental.datasets_equal(x, y).first() == (*want, want == (0, 0))
    docs = spark.createDataFrame([(k, "long text " * 2000 + str(k)) for k in range(50)], "doc_id long, text string")
    found = queries.a17_datasets_equal(docs, docs.where("doc_id < 40"))
    assert sorted((r.other, r.only_a, r.only_b, r.equal) for r in found.collect()) == [("itself", 0, 0, True), ("mutated", 10, 0, False)]
    dealt = [x.split("Repartition 5")[1].split("\n")[1] for x in [found._jdf.queryExecution().optimizedPlan().toString()] if "Repartition 5" in x]
    assert len(dealt) == 1 and "sha2" in dealt[0]


def test_projection_of_empty_and_missing_texts_equals_sql(spark, tmp_path):
    import duckdb

    from keepsake.queries import ORACLE, QUERIES

    rows = [(0, "a"), (1, "b"), (2, None), (3, None), (4, ""), (5, " "), (6, ""), (None, "c"), (None, None), (-3, "d"), (-4, ""), (1 << 40, "é")]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    want = duckdb.connect().sql(ORACLE["a10_text_projection"].replace("documents", f"'{tmp_path}/documents.parquet/*.parquet'")).fetchall()
    assert sorted(map(tuple, QUERIES["a10_text_projection"](spark, str(tmp_path)).collect()), key=repr) == sorted(want, key=repr)


def test_plan_keys(spark):
    stages = spark.createDataFrame([(p, s, "c", "k", "e") for p in ("p", "q") for s in "abcd"], "plan string, stage string, config string, code string, env string")
    edges = spark.createDataFrame([("p", "b", "a"), ("p", "c", "b"), ("p", "d", "c"), ("p", "d", "a"), ("q", "b", "a"), ("q", "c", "a")], "plan string, stage string, parent string")
    none = spark.createDataFrame([], "plan string, stage string, artifact_id string")
    got = {(r.plan, r.stage): r for r in identity.plan_keys(stages, edges, none).collect()}
    assert [got["p", s].level for s in "abcd"] == [0, 1, 2, 3] and [got["q", s].level for s in "abcd"] == [0, 1, 1, 0]
    assert [got["p", s].provisional for s in "abcd"] == [False, True, True, True]
    done = spark.createDataFrame([("p", "b", "x")], none.schema)
    after = {(r.plan, r.stage): r for r in identity.plan_keys(stages, edges, done).collect()}
    assert after["p", "a"].work_key == got["p", "a"].work_key and after["p", "c"].work_key != got["p", "c"].work_key and not after["p", "c"].provisional
    assert after["p", "d"].work_key != got["p", "d"].work_key and after["p", "d"].provisional  # a changed key above reaches down
    assert after["q", "d"].work_key == got["q", "d"].work_key
    for bad in ([("p", "a", "d"), ("p", "d", "a")], [("p", "a", "unknown")]):
        with pytest.raises(ValueError, match="cycle"):
            identity.plan_keys(stages, spark.createDataFrame(bad, edges.schema), none)
    assert identity.plan_keys(stages.limit(0), edges.limit(0), none).count() == 0


def test_canonical_ids(spark):
    escaped = '"' + chr(92) + 'u0061"'
    raw = ['"a"', escaped, '"a","b"', "-0", "0", " 7 ", '"7"', "true", "1.5", '"x', '""', "[1]", '"é"', escaped.replace("0061", "00e9"), '"a" 1', None, "01"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(incremental.typed_ids(F.col("raw"))).collect()]
    assert got == ['"a"', '"a"', None, "0", "0", "7", '"7"', None, None, None, '""', None, '"é"', '"é"', None, None, None]
    rows = spark.createDataFrame([(1, '"a"'), (2, escaped), (3, "-0"), (4, "0")], "line long, raw string")
    assert sorted((r.line, r.first_line, r.problem) for r in incremental.validate_ids(rows, "id", "line", "raw").collect()) == [(2, 1, "duplicate"), (4, 3, "duplicate")]


def test_vectors_are_compared_in_their_own_type(spark):
    a = spark.createDataFrame([(1, [1.0, 2.0])], "id long, v array<double>")
    b = a.withColumn("v", F.transform("v", lambda x: x + 1e-12))
    assert corpus.probe_vectors(a, a, "id", "v", "s").first().passed and not corpus.probe_vectors(a, b, "id", "v", "s").first().passed
    with pytest.raises(TypeError):
        corpus.probe_vectors(a, a.withColumn("v", F.col("v").cast("array<float>")), "id", "v", "s")


def test_keys_read_twice_and_missing_blobs(spark):
    failures = spark.createDataFrame([("r", "eval", "ValueError: x")], "run_id string, stage string, traceback string")
    reads = spark.createDataFrame([("r", "lr", "1"), ("r", "lr", "2"), ("r", "bs", "8")], "run_id string, key string, value string")
    assert derivations.failure_signatures(failures, reads, ["lr", "bs"]).first().features == {"bs": "8", "lr": "2"}
    roots = spark.createDataFrame([("root",)], "root_id string")
    leaves = spark.createDataFrame([("root", 0, "a", "d0"), ("root", 1, "b", "d1"), ("root", 2, "gone", "d2")], "root_id string, ordinal int, child_id string, slice_digest string")
    made = spark.createDataFrame([("root", "w", "B"), ("a", "w", "BA"), ("b", "w", "BB")], "derivation_id string, work_key string, blob_digest string")
    blobs = spark.createDataFrame([("B", "at", 1), ("BA", "at", 2)], "blob_digest string, location string, size int")
    got = derivations.receipts(roots, leaves, made, blobs).first()
    assert (got.n_leaves, got.n_unavailable) == (3, 2) and '"child_id":"gone","ordinal":2' in got.receipt
