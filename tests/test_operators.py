"""Operators on small tables of their own."""

import hashlib
import json

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from keepsake.functions.canon import FramedDigest, canonical_json, canonical_json_bytes, digest_column
from keepsake.operators import claims, codegraph, corpus, incremental, ledger, lineage, memory, trace
from keepsake.plans import guard
from keepsake.sources import io


def rows(df):
    return sorted(tuple(r) for r in df.collect())


def test_canonical_json(spark):
    raw = ['{"b": 1e16, "a": "é", "c": null}', "not json", None]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(canonical_json(F.col("raw"))).collect()]
    assert got == ['{"a":"\\u00e9","b":1e+16,"c":null}', None, None]


def test_digest_columns_are_framed(spark):
    df = spark.createDataFrame([("a", "bc"), ("ab", "c"), (None, "abc")], "x string, y string")
    assert len({r[0] for r in df.select(digest_column("t", F.col("x"), F.col("y"))).collect()}) == 3


def test_buckets_and_slices_match_hashlib(spark):
    ids = list(range(300)) + [10**12]
    df = spark.createDataFrame([(i, f"row {i}") for i in ids], "id long, row string")
    bucketed = incremental.bucketize(df, "id", 16)
    want = {i: int.from_bytes(hashlib.sha256(str(i).encode()).digest()[:8], "big") % 16 for i in ids}
    assert {r.id: r.bucket for r in bucketed.collect()} == want
    digests = {}
    for i in sorted(ids, key=str):
        digests.setdefault(want[i], FramedDigest("slice", bucket=want[i])).add(f"row {i}".encode())
    assert {r.bucket: r.slice_digest for r in incremental.slice_digests(bucketed, "row").collect()} == {b: d.hex() for b, d in digests.items()}


@settings(max_examples=8, deadline=None)
@given(st.dictionaries(st.integers(0, 500), st.text(max_size=5), min_size=1, max_size=25), st.data())
def test_one_edit_changes_one_bucket(spark, table, data):
    leaves = lambda t: incremental.multiset_digests(spark.createDataFrame(list(t.items()), "id long, text string"), incremental.bucket_of(incremental.id_bytes("id")), F.concat_ws(":", "id", "text"))
    edited = data.draw(st.sampled_from(sorted(table)))
    other = table | {edited: table[edited] + "x"}
    assert incremental.changed_buckets(leaves(table), leaves(other)).count() == 1
    assert incremental.changed_buckets(leaves(table), leaves(table)).count() == 0


def test_ids(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "a"), (4, None), (5, "a")], "line long, id string")
    assert rows(incremental.validate_ids(df, "id", "line").na.fill(-1)) == [(3, 1, "duplicate"), (4, -1, "missing"), (5, 1, "duplicate")]


def test_merkle_root_needs_every_bucket(spark):
    df = spark.createDataFrame([(0, "x"), (1, "y"), (2, "z")], "bucket int, slice_digest string")
    root = incremental.merkle_root(df, 3).first()
    assert root.complete and len(root.root) == 64
    assert incremental.merkle_root(df.where("bucket <> 1"), 3).first() == (False, None)
    assert incremental.merkle_root(df.withColumn("slice_digest", F.lit("q")), 3).first().root != root.root


def test_savings_fixture(spark):
    reused = spark.createDataFrame([(95000, 610, 2.0, 4096.0)], "duration_ms long, latency_ms long, vcpu double, mem_mib double")
    rates = spark.createDataFrame([("vcpu_hour", 0.04048), ("gib_hour", 0.004445)], "resource_kind string, usd double")
    out = ledger.savings(reused, rates).first()
    hours = 94.39 / 3600
    cost = 0.04048 * 2 * hours + 0.004445 * 4 * hours
    assert out.net_seconds == 94.39 and out.cost_usd == pytest.approx(cost, abs=1e-6)
    assert out.formula == f"94.4s x ${cost / 94.39:.7f}/s = ${cost:.4f}"
    slower = ledger.savings(reused.withColumn("latency_ms", F.lit(100000)), rates).first()
    assert "slower" in slower.formula and slower.formula.endswith("additional")
    none = ledger.savings(reused, rates.where("resource_kind = 'vcpu_hour'")).first()
    assert none.cost_usd is None and none.no_cost_reason
    assert ledger.savings(reused.limit(0), rates).first().net_seconds == 0


def test_ledger_rules_with_nulls(spark):
    df = spark.createDataFrame([(1, "REUSE", "reuse", None, 5), (2, "REUSE", "reuse", "model", 5), (3, "REUSE", "reuse", "probe", -1), (4, "RECOMPUTE", "recompute", None, 5), (5, None, "reuse", "identity", None)], "decision_id long, action string, verdict string, authorized_by string, latency_ms long")
    assert rows(ledger.validate_decisions(df)) == [(1, "authority"), (2, "authority"), (3, "latency"), (5, "action,latency")]


def test_lineage(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", "y")], "src string, dst string")
    assert rows(lineage.reachable(edges, spark.createDataFrame([("a",)], "node string"))) == [("a", 0), ("b", 1), ("c", 2)]
    artifacts = spark.createDataFrame([("a", None), ("b", 1), ("c", None), ("x", None)], "artifact_id string, quarantined_at int")
    inputs = spark.createDataFrame([("b", "upstream", "a"), ("c", "upstream", "b")], "artifact_id string, kind string, ref string")
    after, new = lineage.quarantine(artifacts, inputs, artifacts.where("artifact_id = 'a'"), F.lit(9))
    assert rows(after.na.fill(0)) == [("a", 9), ("b", 1), ("c", 9), ("x", 0)] and rows(new) == [("a",), ("c",)]
    assert lineage.quarantine(after, inputs, artifacts.where("artifact_id = 'a'"), F.lit(10))[1].count() == 0
    with pytest.raises(ValueError):
        lineage.unquarantine(artifacts, "a", " ")


def test_reachable_in_deep_graphs(spark):
    import random

    r = random.Random(6)
    edges = [(k, k + 1) for k in range(22)] + [(r.randrange(30), r.randrange(30)) for _ in range(12)] + [(40, 41)]
    depth, at = {0: 0}, [0]
    while at:
        at = [b for a in at for x, b in edges if x == a and b not in depth and not depth.update({b: depth[a] + 1})]
    got = lineage.reachable(spark.createDataFrame(edges, "src long, dst long"), spark.createDataFrame([(0,)], "node long"))
    assert dict(rows(got)) == depth and len(depth) > 22


def test_commit_outcomes(spark):
    attempts = spark.createDataFrame([(1, 0, "i", "b", 1, "accepted"), (1, 0, "i", "b", 2, "accepted"), (1, 0, "i", "z", 3, "accepted"), (1, 0, "i", "b", 4, "stale_fence"), (2, 0, "i", "b", 1, "stale_fence"), (2, 0, "i", "c", 2, "accepted")], "work_key long, chunk int, input string, blob string, attempt int, reason string")
    got = claims.classify_commits(attempts, ["work_key", "chunk"], ["attempt"]).orderBy("work_key", "attempt")
    assert [r.outcome for r in got.collect()] == ["COMMITTED", "ALREADY_PRESENT", "NONDETERMINISTIC", "REJECTED_FENCE", "REJECTED_FENCE", "COMMITTED"]


def test_causal_keys_and_tiers(spark):
    df = spark.createDataFrame(
        [
            (1, [("train.learning_rate", "0.1")], {"lr": "0.1"}),
            (2, [("embedding_dim", "384")], {"input_dim": "384", "embedding_dim": "768"}),
            (3, [("train.lr", "0.2")], {"lr": "0.1"}),
            (4, [("other", "1")], {"lr": "0.1"}),
            (5, [], {"lr": "0.1"}),
        ],
        "id int, changes array<struct<key:string,`from`:string>>, s map<string,string>",
    )
    assert [r[0] for r in df.orderBy("id").select(memory.causal_keys(F.col("changes"), F.col("s"))).collect()] == [["lr"], ["embedding_dim", "input_dim"], None, None, None]
    t = lambda causal, agreeing, stage, cls, versions, d: spark.range(1).select(memory.tier(F.lit(causal).cast("array<string>") if causal is None else F.array(*map(F.lit, causal)), F.array(*map(F.lit, agreeing)).cast("array<string>"), F.lit(stage), F.lit(cls), F.lit(versions), F.lit(d))).first()[0]
    assert t(["lr"], ["lr"], False, True, True, 0.9) == "exact"
    assert t(["lr", "dim"], ["lr"], True, True, True, 0.1) == "strong_semantic"
    assert t(["lr"], [], True, True, True, 0.1) == "weak"
    assert t(None, ["lr"], True, True, True, 0.36) == "none"


def test_metrics_match_definition(spark):
    y, p = [0, 0, 1, 1, 2, 3], [0, 1, 1, 1, 0, 4]
    out = corpus.classification_metrics(spark.createDataFrame(list(zip(y, p, strict=True)), "y int, yhat int")).first()
    labels = sorted(set(y) | set(p))
    f1 = [2 * sum(a == b == k for a, b in zip(y, p, strict=True)) / (y.count(k) + p.count(k)) for k in labels]
    assert out.accuracy == 0.5 and out.macro_f1 == pytest.approx(np.mean(f1)) and out.n_examples == 6
    with pytest.raises(ValueError):
        corpus.classification_metrics(spark.range(1), metrics=("accuracy", "accuracy"))


@pytest.mark.parametrize("n,k", [(10, 3), (3, 5), (7, 7), (100, 8), (1, 1)])
def test_shards(spark, n, k):
    got = corpus.assign_shards(spark.range(n).withColumnRenamed("id", "doc_id"), k).orderBy("doc_id").collect()
    sizes = [n // k + (i < n % k) for i in range(k)]
    assert [r.shard for r in got] == [i for i, s in enumerate(sizes) for _ in range(s)]


def test_probes(spark):
    a = spark.createDataFrame([(i, [float(i), -0.0]) for i in range(100)], "id long, v array<float>")
    same = corpus.probe_vectors(a, a, "id", "v", "s", 10).first()
    assert same.passed and same.sample_size == 10 and same.population_size == 100
    zero = a.withColumn("v", F.transform("v", lambda x: F.abs(x)))
    assert not corpus.probe_vectors(a, zero, "id", "v", "s", 10).first().passed  # 0.0 is not -0.0
    t = spark.createDataFrame([(i, str(i)) for i in range(35)], "id long, x string")
    assert corpus.probe_table(t, t.repartition(7), "id").first().passed
    assert corpus.probe_table(t, t.where("id <> 34"), "id").first().detail == "rows"
    assert corpus.probe_table(t, t.withColumn("x", F.when(F.col("id") == 10, "!").otherwise(F.col("x"))), "id").first().detail == "checksum"
    assert corpus.probe_table(t, t.select("x", "id"), "id").first().detail == "schema"
    assert corpus.probe_table(t.limit(0), t.limit(0), "id").first().passed
    same = spark.createDataFrame([(i // 3, str(i // 3)) for i in range(60)], "id long, x string")  # rows that share id, and all else
    assert corpus.probe_table(same, same.repartition(5), "id").first().passed


def test_probe_table_of_any_layout(spark, monkeypatch):
    monkeypatch.setattr(corpus, "FOLDED", 64)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        t = spark.range(30_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("x"))
        few, many = t.repartition(3), t.repartition(23, "x")
        assert corpus.probe_table(few, many, "id").first().passed
        assert corpus.probe_table(few, many.withColumn("x", F.when(F.col("id") == 20_000, "!").otherwise(F.col("x"))), "id").first().detail == "checksum"
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_generated_corpus(spark):
    got = [r.text for r in corpus.generate_corpus(spark, 16, ["The pump", "A valve"], ["opens", "shuts"], ["early", "late"], ["today", "again"]).orderBy("id").collect()]
    assert got[0] == "The pump opens early today" and got[3] == "A valve shuts early again" and len(set(got)) == 8


def test_redaction(spark):
    df = spark.createDataFrame([("Password: abc x\napi TOKEN=q1 monkey: z",)], "t string")
    assert corpus.redact(df, "t").first().t == "Password: [REDACTED] x\napi TOKEN=[REDACTED] monkey: z"


TRACE = """1 execve("/bin/x", ["x"], 0x1) = 0
1 chdir("/work") = 0
1 openat(AT_FDCWD, "in.txt", O_RDONLY) = 3</work/in.txt>
1 openat(AT_FDCWD, "gone", O_RDONLY) = -1 ENOENT (No such file or directory)
1 openat(AT_FDCWD, "in.txt", O_RDONLY <unfinished ...>
2 socket(AF_INET, SOCK_STREAM, 0) = 4
1 <... openat resumed>) = 3</work/in.txt>
2 <... read resumed>"x", 1) = 1
1 rename("a", "b") = 0
2 write(1, "x", 1 <unfinished ...>
what is this
2 +++ killed by SIGKILL +++
1 +++ exited with 3 +++"""


def test_trace(spark):
    lines = spark.createDataFrame([("t", n, x) for n, x in enumerate(TRACE.split("\n"))] + [("u", 0, "7 +++ exited with 0 +++"), ("u", 1, "  ")], "trace_id string, line_no int, line string")
    parsed = trace.parse_trace(lines)
    assert parsed.count() == 14
    events, reasons = trace.join_resumed(parsed)
    assert {r.reason for r in reasons.collect()} == {"orphan_resumed_line", "truncated_unfinished:1", "unparsed:what is this"}
    assert events.where("line_no = 6 and trace_id = 't'").first().name == "openat"
    exits = trace.reconcile_exit(events, spark.createDataFrame([("t", 2), ("u", 0), ("v", 0)], "trace_id string, status int"))
    assert rows(exits.na.fill("", ["reason"]).na.fill(-9)) == [("t", 3, "exit_status_disagreement"), ("u", 0, ""), ("v", -9, "missing_top_level_exit_record")]
    got = {(r.kind, r.ref, r.mode) for r in trace.trace_accesses(events).collect()}
    assert got == {("subprocess", "/bin/x", "execute"), ("file", "/work/in.txt", "read"), ("file", "/work/gone", "negative"), ("socket", "socket", "network"), ("file", "/work/a", "write"), ("file", "/work/b", "write")}
    about = spark.createDataFrame([("t", True, True, "shadow"), ("u", True, False, "deterministic-file"), ("v", True, True, "shadow")], "trace_id string, platform_ok boolean, image_pinned boolean, contract string")
    states = {r.trace_id: r.state for r in trace.coverage(about, events, trace.trace_accesses(events), reasons, "/work/out").collect()}
    assert states == {"t": "INCOMPLETE_TRACE_LOSS", "u": "INCOMPLETE_PLATFORM", "v": "SHADOW_UNQUALIFIED"}
    clean = reasons.limit(0)
    assert {r.trace_id: r.state for r in trace.coverage(about, events, trace.trace_accesses(events), clean, "/work/out").collect()}["t"] == "INCOMPLETE_NETWORK"


def test_directories_of_processes(spark):
    text = """1 chdir("/work") = 0
1 clone(child_stack=NULL) = 2
2 openat(AT_FDCWD, "a", O_RDONLY) = 3</work/a>
2 chdir("sub") = 0
2 openat(AT_FDCWD, "b", O_RDONLY) = 3</work/sub/b>
1 openat(AT_FDCWD, "c", O_RDONLY) = 4</work/c>
1 fchdir(5</other>) = 0
1 vfork() = 9
9 openat(AT_FDCWD, "d", O_RDONLY) = 3</other/d>
9 openat(7</deep>, "e", O_RDONLY) = 4</deep/e>
9 chdir("gone") = -1 ENOENT (No such file or directory)
9 chdir("../up") = 0
9 openat(AT_FDCWD, "f", O_RDONLY) = 3</up/f>"""
    lines = spark.createDataFrame([("t", n, x) for n, x in enumerate(text.split("\n"))], "trace_id string, line_no int, line string")
    events, _ = trace.join_resumed(trace.parse_trace(lines))
    got = {(r.line_no, r.ref) for r in trace.trace_accesses(events).where("mode = 'read'").collect()}
    assert got == {(2, "/work/a"), (4, "/work/sub/b"), (5, "/work/c"), (8, "/other/d"), (9, "/deep/e"), (12, "/up/f")}


def accesses(spark, text, **more):
    lines = spark.createDataFrame([("t", n, x.strip()) for n, x in enumerate(text.strip().split("\n"))], "trace_id string, line_no int, line string")
    events, _ = trace.join_resumed(trace.parse_trace(lines))
    return sorted((r.line_no, r.kind, r.ref, r.mode) for r in trace.trace_accesses(events, **more).collect())


def test_descriptors_without_noted_paths(spark):
    got = accesses(spark, """1 chdir("/work") = 0
        1 openat(AT_FDCWD, "sub", O_RDONLY|O_DIRECTORY|O_CLOEXEC) = 3
        1 openat(3, "a, b", O_RDONLY) = 4
        1 dup(4) = 5
        1 close(4) = 0
        1 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 5, 0) = 0x7f
        1 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 4, 0) = 0x7f
        1 getdents64(3, 0x55 /* 3 entries */, 32768) = 80
        1 fchdir(3) = 0
        1 open("c", O_RDONLY) = 4
        1 fcntl(4, F_DUPFD_CLOEXEC, 10) = 10
        1 execve("/bin/y", ["y"], 0x7f) = 0
        1 openat(3, "gone", O_RDONLY) = 6
        1 fstat(10, {st_mode=S_IFREG|0644}) = 0
        1 fstat(4, {st_mode=S_IFREG|0644}) = 0
        1 close_range(3, 9, 0) = 0
        1 fstat(4, {st_mode=S_IFREG|0644}) = 0
        1 openat(AT_FDCWD, "d\\303\\251", O_RDONLY) = 3
        1 openat(AT_FDCWD, "cut"..., O_RDONLY) = 3
        1 renameat2(3, "../x", AT_FDCWD, "y", RENAME_NOREPLACE) = 0""")
    assert got == [
        (1, "directory", "/work/sub", "enumerate"), (2, "file", "/work/sub/a, b", "read"), (5, "file", "/work/sub/a, b", "read"), (7, "directory", "/work/sub", "enumerate"), (9, "file", "/work/sub/c", "read"),
        (11, "subprocess", "/bin/y", "execute"), (14, "file", "/work/sub/c", "read"), (17, "file", "/work/sub/dé", "read"), (19, "file", "/work/sub/x", "write"), (19, "file", "/work/sub/y", "write"),
    ]


def test_descriptors_shared_and_copied_on_fork(spark):
    got = accesses(spark, """1 openat(AT_FDCWD, "/a", O_RDONLY) = 3
        1 clone(child_stack=NULL, flags=CLONE_VM|CLONE_FS|CLONE_FILES|SIGCHLD) = 2
        1 clone3({flags=0, exit_signal=SIGCHLD}, 88) = 4
        2 close(3) = 0
        2 chdir("/home") = 0
        1 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f
        4 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f
        1 open("rel", O_RDONLY) = 3
        4 open("rel", O_RDONLY) = -1 ENOENT (No such file or directory)
        2 fcntl(3, F_SETFD, FD_CLOEXEC) = 0
        2 execve("/bin/z", ["z"], 0x7f) = 0
        2 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f
        1 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f
        2 getrandom("x", 8, 0) = 8
        2 open("/dev/urandom", O_RDONLY) = 5
        2 stat("dir", {st_mode=S_IFDIR|0755}) = 0
        2 readlink("plain", 0x7f, 99) = -1 EINVAL (Invalid argument)
        2 fork() = -1 EAGAIN (Resource temporarily unavailable)""", workspace="/w")
    assert got == [
        (0, "file", "/a", "read"), (6, "file", "/a", "read"), (7, "file", "/home/rel", "read"), (8, "file", "rel", "negative"), (10, "subprocess", "/bin/z", "execute"), (12, "file", "/home/rel", "read"),
        (13, "device", "device:getrandom", "read"), (14, "device", "device:urandom", "read"), (16, "file", "/home/plain", "negative"),
    ]


def test_traces_are_apart(spark):
    lines = [(t, n, x) for t in ("t", "u", None) for n, x in enumerate([f'1 openat(AT_FDCWD, "/{t}", O_RDONLY) = 3' if t else "1 close(3) = 0", "1 mmap(NULL, 5, PROT_READ, MAP_PRIVATE, 3, 0) = 0x7f"])]
    events, _ = trace.join_resumed(trace.parse_trace(spark.createDataFrame(lines, "trace_id string, line_no int, line string")))
    assert sorted((r.trace_id, r.line_no, r.ref) for r in trace.trace_accesses(events).collect()) == [("t", 0, "/t"), ("t", 1, "/t"), ("u", 0, "/u"), ("u", 1, "/u")]
    assert trace.trace_accesses(events.limit(0)).count() == 0


def test_companion_drift_and_invariants(spark, tmp_path):
    r = spark.createDataFrame([("t", "file", "a", "read", "h"), ("t", "file", "n", "negative", "absent")], "trace_id string, kind string, ref string, mode string, version string")
    more = spark.createDataFrame([("t", "file", "a", "read", "other"), ("t", "file", "b", "read", "h")], r.schema)
    assert rows(trace.merge_companion(r, more).select("ref", "version")) == [("a", "h"), ("b", "h"), ("n", "absent")]
    bad = r.unionByName(r.limit(0)).unionByName(spark.createDataFrame([("t", "file", "x", "negative", "h"), ("t", "file", "y", "read", "absent"), ("t", "file", "a", "read", "h")], r.schema))
    assert rows(trace.validate_traces(bad)) == [("t", "a", "repeated"), ("t", "x", "absence"), ("t", "y", "absence")]
    io_of = lambda rows_: spark.createDataFrame(rows_, "trace_id string, ref string, version string")
    predicted = io_of([("same", "a", "1"), ("new", "a", "1"), ("edit", "a", "1"), ("less", "a", "1"), ("net", "a", "1")])
    actual = io_of([("same", "a", "1"), ("new", "a", "1"), ("new", "b", "1"), ("edit", "a", "2"), ("net", "a", "1")])
    network = spark.createDataFrame([("net",), ("only",)], "trace_id string")
    assert rows(trace.detect_drift(predicted, actual, network).na.fill("")) == [("edit", "changed_inputs"), ("less", "changed_inputs"), ("net", "network"), ("new", "hidden_input"), ("only", "network"), ("same", "")]
    reads = spark.createDataFrame([("fit", "lr"), ("fit", "seed"), ("eval", "k")], "stage string, key string")
    assert rows(trace.downstream_only_config(spark.createDataFrame([("lr",), ("zz",)], "key string"), reads)) == [("eval", "downstream_only", []), ("fit", "affected", ["lr"])]


def test_trace_resources(spark):
    r = spark.createDataFrame([("t", "file", "/p/x", "read", "syscall", "hash", 1), ("t", "file", "a", "read", "python", "hash", 5), ("t", "file", "a", "read", "syscall", "symlink", 4), ("t", "file", "a", "read", "syscall", "hash", 2), ("t", "file", "a", "negative", "syscall", "hash", 0), ("t", "file", "n", "negative", "syscall", "hash", 0)], "trace_id string, kind string, ref string, mode string, source string, resolver string, line_no int")
    one = trace.dedup_resources(r)
    assert one.where("ref = 'a' and mode = 'read'").first().line_no == 2
    assert rows(trace.prune_resources(one, "/p").select("ref", "mode")) == [("a", "read"), ("n", "negative")]
    assert rows(trace.semantic_resources(one).select("ref").distinct()) == [("a",), ("n",)]
    manifest = spark.createDataFrame([("a", "h1")], "path string, sha256 string")
    assert rows(trace.resolve_versions(one.where("ref <> '/p/x'"), manifest).select("ref", "mode", "version")) == [("a", "negative", "absent"), ("a", "read", "h1"), ("n", "negative", "absent")]
    seen = spark.createDataFrame([(1, "k", 1), (2, "k", 2), (3, "k", 3)], "observation_id int, semantic_key string, created_at int")
    inputs = spark.createDataFrame([(1, "a", "h1"), (2, "a", "h1"), (2, "n", "absent"), (3, "a", "h0")], "observation_id int, path string, version string")
    assert rows(trace.resolve_inputs(seen, inputs, manifest)) == [("k", 2)]
    states = spark.createDataFrame([("shadow", "COMPLETE_DECLARED"), ("jsonl-map", "SHADOW_UNQUALIFIED"), ("jsonl-map", "INCOMPLETE_NETWORK")], "c string, o string")
    assert [x[0] for x in states.select(trace.declared_coverage(F.col("c"), F.col("o"))).collect()] == ["SHADOW_UNQUALIFIED", "COMPLETE_DECLARED", "INCOMPLETE_NETWORK"]


def test_code_graph(spark):
    a = 'import b\nfrom b import helper as h\nLIMIT = 3\n\ndef run():\n    """Doc."""\n    return h(LIMIT) + b.other()\n\ndef sly():\n    return eval("1")\n'
    b = "def helper(x):\n    return x\n\ndef other():\n    return 1\n"
    files = spark.createDataFrame([("a", a), ("b", b), ("broken", "def (")], "module string, text string")
    units, edges = codegraph.extract_code_graph(files)
    assert {r.unit_id for r in units.collect()} == {"a:<module>", "a:LIMIT", "a:run", "a:sly", "b:<module>", "b:helper", "b:other"}
    assert {("a:run", "b:helper"), ("a:run", "b:other"), ("a:run", "a:LIMIT"), ("b:helper", "b:<module>")} <= {tuple(r) for r in edges.collect()}
    assert [r.unit_id for r in units.where("size(escapes) > 0").collect()] == ["a:sly"]
    new, _ = codegraph.extract_code_graph(spark.createDataFrame([("a", a.replace('"""Doc."""', '"""Other."""').replace("LIMIT = 3", "LIMIT  =  3  # three").replace('eval("1")', "2")), ("b", b)], "module string, text string"))
    none = spark.createDataFrame([], "hazard string")
    changes = {r.unit_id: r.change for r in codegraph.classify_comment_format(units, new, none).collect()}
    assert (changes["a:run"], changes["a:LIMIT"], changes["a:sly"], changes["b:helper"]) == ("comment_only", "formatting_only", "code", "formatting_only")


def test_refusals_by_what_reachable_code_does(spark):
    old = "import threading\n\ndef run():\n    return helper()\n\ndef helper():\n    'Doc.'\n    return run.__doc__\n\ndef far():\n    return getattr(far, 'x')\n"
    units, edges = codegraph.extract_code_graph(spark.createDataFrame([("m", old)], "module string, text string"))
    entries = spark.createDataFrame([("m:run",)], "node string")
    hazards = codegraph.hazards_in(units, lineage.reachable(edges, entries))
    assert rows(hazards) == [("reads_docs",), ("spawns",)]
    new, _ = codegraph.extract_code_graph(spark.createDataFrame([("m", old.replace("'Doc.'", "'Other.'"))], "module string, text string"))
    got = {r.unit_id: (r.change, r.refused) for r in codegraph.classify_comment_format(units, new, hazards).collect()}
    assert got["m:helper"] == ("comment_only", "reads_docs") and got["m:run"] == ("formatting_only", None)
    head = "import logging\nlog = logging.getLogger('x')\n"
    pairs = spark.createDataFrame([("a", head + "def f():\n    log.info('a')\n    return 1\n", head + "def f():\n    return 1\n"), ("b", "def _a():\n    return 1\n", "def _b():\n    return 1\n")], "module string, old string, new string")
    assert rows(codegraph.classify_sources(pairs, hazards).na.fill("")) == [("a", "logging_only", "spawns"), ("b", "private_rename", "")]
    far = spark.createDataFrame([("m:far",)], "node string")
    ids, escapes = units.select(F.col("unit_id").alias("node")), units.where("size(escapes) > 0").select(F.col("unit_id").alias("node"))
    assert codegraph.classify_unreachable(edges, edges, entries, ids, far, escapes).first() == (True, False, "ok")
    assert codegraph.classify_unreachable(edges, edges, entries, ids, entries, escapes).first() == (False, False, "changed units can be reached")
    assert codegraph.classify_unreachable(edges, edges, far, ids, entries, escapes).first() == (True, True, "reach is unsound")
    assert codegraph.classify_unreachable(edges, edges, entries, far, far, escapes).first() == (False, False, "no entry point in the new graph")


def test_escapes(spark):
    text = "import importlib as il\nfrom pkg_resources import iter_entry_points as it\n\ndef a():\n    return il.import_module('x')\n\ndef b():\n    return vars(a)\n\ndef c():\n    return it('g')\n\ndef d():\n    return 1\n"
    units, _ = codegraph.extract_code_graph(spark.createDataFrame([("m", text)], "module string, text string"))
    assert {r.name for r in units.where("size(escapes) > 0").collect()} == {"a", "b", "c", "<module>"}


def test_guard(spark):
    bad = ["", "select 1; select 2", "drop table x", "with x as (select 1) insert into y select * from x", "explain select 1", "set a = 1", "cache table x", "create table x as select 1", "begin select 1; end", "select java_method('java.lang.System', 'exit', 1)"]
    bad += ["select * from (select reflect('java.lang.System', 'exit', 1))", "with x as (select java_method('a', 'b')) select * from x", "select 1 where exists (select java_method('a', 'b'))"]
    for sql in bad:
        with pytest.raises(guard.Refused):
            guard.parsed(spark, sql)
    df = spark.range(500)
    assert guard.safe_select(spark, "SELECT id AS `set`, 'drop; insert' AS x FROM {t}", t=df).count() == 25
    assert guard.safe_select(spark, "SELECT id FROM {t} LIMIT 400", t=df).count() == 200
    assert guard.safe_select(spark, "WITH a AS (SELECT id FROM {t} LIMIT 9) SELECT count(*) FROM a UNION ALL SELECT 1", t=df).count() == 2
    text, cut = guard.payload(guard.safe_select(spark, "SELECT id FROM {t} WHERE id < 2", t=df))
    assert json.loads(text) == [{"id": 0}, {"id": 1}] and not cut
    text, cut = guard.payload(df.select(F.repeat(F.lit("x"), 100_000).alias("x")))
    assert cut and len(text) == guard.MOST_BYTES


def test_sources_and_sinks(spark, tmp_path):
    source = tmp_path / "in.jsonl"
    source.write_text('{"id": "b", "x": 1}\n\n{"id": 7}\n{"id": "7"}\n')
    got = io.read_jsonl(spark, str(source), "id").collect()
    assert [r.id for r in got] == ['"b"', "7", '"7"']
    io.write_jsonl(spark.createDataFrame([("b", "2"), ("a", "1"), ("c", "3")], "id string, line string"), str(tmp_path / "out"), "id", "line")
    lines = [x for f in sorted((tmp_path / "out").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines == ["1", "2", "3"]
    features = spark.createDataFrame([(1, [1.0, 2.0])], "doc_id long, embedding array<double>")
    io.write_features(features, str(tmp_path / "features"), 2)
    assert io.read_features(spark, str(tmp_path / "features")).first().embedding == [1.0, 2.0]
    with pytest.raises(Exception, match="dimension"):
        io.write_features(features, str(tmp_path / "bad"), 3)
    log = tmp_path / "log.jsonl"
    log.write_text('{"version":1,"type":"new.kind","timestamp":"2024-01-01T00:00:00Z","run_id":"r","payload":{"a":1}}\nbroken\n')
    events = io.read_events(spark, str(log)).collect()
    assert [r.type for r in events] == ["new.kind", None] and json.loads(events[0].payload) == {"a": 1}
    blobs = spark.createDataFrame([(hashlib.sha256(x).hexdigest(), bytearray(x)) for x in (b"one", b"two", b"two")], "digest string, content binary")
    io.publish_content(blobs, str(tmp_path / "cas"))
    stored = spark.read.parquet(str(tmp_path / "cas"))
    assert stored.count() == 2 and io.publish_content(blobs.limit(0), str(tmp_path / "cas2"), stored).count() == 0
    manifest = stored.select("digest", "size").unionByName(spark.createDataFrame([("nowhere", 1)], "digest string, size int"))
    assert sorted(r.status for r in io.verify_content(manifest, stored).collect()) == ["ok", "ok", "unavailable"]
    assert io.verify_content(stored.select("digest", F.lit(99).alias("size")), stored).where("status = 'mismatch'").count() == 2


def test_canonical_bytes():
    assert canonical_json_bytes({"b": [1, 2.5], "a": "é"}) == b'{"a":"\\u00e9","b":[1,2.5]}'


LOG = "import logging\nlog = logging.getLogger(__name__)\n"


@pytest.mark.parametrize(
    "old,new,change",
    [
        ("def f():\n    return 1\n", "def f():\n    # why\n    return 1\n", "unchanged"),
        (LOG + "def f():\n    log.info('a')\n    return 1\n", LOG + "def f():\n    return 1\n", "logging_only"),
        (LOG + "def f():\n    log.info(g())\n    return 1\n", LOG + "def f():\n    return 1\n", "code"),
        (LOG + "def f():\n    log.setLevel(1)\n    return 1\n", LOG + "def f():\n    return 1\n", "code"),
        ("log = []\ndef f():\n    log.append(1)\n    return 1\n", "log = []\ndef f():\n    return 1\n", "code"),
        ("log = []\ndef f():\n    log.info(1)\n    return 1\n", "log = []\ndef f():\n    return 1\n", "code"),
        (LOG + "def f(log):\n    log.info(1)\n    return 1\n", LOG + "def f(log):\n    return 1\n", "code"),
        (LOG + "def f(x):\n    log.info(x.y)\n    return 1\n", LOG + "def f(x):\n    return 1\n", "code"),
        ("def _a():\n    return 1\ndef f(x):\n    return getattr(x, 'y')\n", "def _b():\n    return 1\ndef f(x):\n    return getattr(x, 'y')\n", "code"),
        ("def _a():\n    return 1\ndef f():\n    return _a()\n", "def _b():\n    return 1\ndef f():\n    return _b()\n", "private_rename"),
        ("def _a():\n    return '_a'\n", "def _b():\n    return '_a'\n", "code"),
        ("x = 1\n", "x = 2\n", "code"),
    ],
)
def test_source_changes(old, new, change):
    assert codegraph.change_of(old, new) == change


def test_embedding_by_shards(spark):
    df = spark.createDataFrame([(i, i % 3, None if i == 4 else "x" * i) for i in range(40)], "doc_id long, shard int, text string")
    got = corpus.embed(df.repartition(5), lambda texts: [[len(t), 0.5] for t in texts], 2)
    assert sorted((r.doc_id, r.embedding) for r in got.collect()) == [(i, [0.0 if i == 4 else float(i), 0.5]) for i in range(40)]
    want = {k: hashlib.sha256(b"".join(np.array([0 if i == 4 else i, 0.5], "<f4").tobytes() for i in range(k, 40, 3))).hexdigest() for k in range(3)}
    assert {r.shard: r.digest for r in corpus.shard_digests(got).collect()} == want
    with pytest.raises(Exception, match="the encoder gave"):
        corpus.embed(df, lambda texts: [[1.0] for _ in texts], 2).collect()


def test_config_edges_and_drift(spark):
    """Operators without a table of their own among the given ones."""
    from keepsake.operators import identity

    specs = spark.createDataFrame([(1, ["a", "b"], "/x", "linux"), (2, ["a", "b"], "/x", "linux"), (3, ["b", "a"], "/x", "linux")], "id int, argv array<string>, cwd string, platform string")
    d = {r.id: r.spec_digest for r in identity.spec_digest(specs, ["argv", "cwd", "platform"]).collect()}
    assert d[1] == d[2] != d[3]
    keys = {r[0]: (r[1], r[2]) for r in specs.select("id", identity.semantic_key(F.col("cwd"), F.to_json("argv"), F.col("platform")), identity.semantic_key(F.col("cwd"), F.to_json("argv"), F.lit("other"))).collect()}
    assert keys[1] == keys[2] and keys[1][0] != keys[1][1] and keys[3][0] != keys[1][0]
    envs = spark.createDataFrame([(1, {"a": "1", "b": "2"}), (2, {"b": "2", "a": "1"}), (3, {"a": "1"})], "id int, packages map<string,string>")
    e = {r.id: r.digest for r in identity.env_fingerprint(envs, ["packages"]).collect()}
    assert e[1] == e[2] != e[3]
    plans = spark.createDataFrame([("p", "e", "d", [("f.py", "c")], "g", ["q"]), ("r", "e", "none", [], "g", [])], "artifact_id string, env string, data string, code array<struct<ref:string,digest:string>>, config string, upstream array<string>")
    edges = {(r.artifact_id, r.kind, r.ref) for r in identity.artifact_inputs(plans, "none").collect()}
    assert edges == {("p", "env", "env"), ("p", "data", "data"), ("p", "config", "config"), ("p", "code", "f.py"), ("p", "upstream", "q"), ("r", "env", "env"), ("r", "config", "config")}
    slices = spark.createDataFrame([(0, "x"), (1, "y")], "bucket int, slice_digest string")
    assert identity.dataset_digest(slices).first() == identity.dataset_digest(slices.repartition(2)).first() != identity.dataset_digest(slices.where("bucket = 0")).first()
    edges, units = spark.createDataFrame([("c1", "a", "b"), ("c2", "a", "c")], "commit string, src string, dst string"), spark.createDataFrame([("a", "1"), ("b", "1")], "unit_id string, digest string")
    new_edges, new_units = lineage.upsert_code_graph(edges, units, spark.createDataFrame([("c2", "b", "c")], edges.schema), spark.createDataFrame([("b", "2")], units.schema), "c2")
    assert rows(new_edges) == [("c1", "a", "b"), ("c2", "b", "c")] and rows(new_units) == [("a", "1"), ("b", "2")]
    reads = spark.createDataFrame([(1, "input_dim", "3"), (1, "embedding_dim", "4"), (2, "input_dim", "3"), (2, "embedding_dim", "3"), (3, "input_dim", "3")], "plan_id int, key string, value string")
    assert rows(memory.shape_mismatch(reads)) == [(1, "3", "4")]


def test_memory_appends(spark, tmp_path):
    path, signatures = str(tmp_path / "s"), spark.createDataFrame([(1, [0.5, 0.5])], "signature_id int, embedding array<float>")
    memory.append_signatures(signatures, path, 2)
    with pytest.raises(Exception, match="dimension is not 3"):
        memory.append_signatures(signatures, path, 3)
    fixes = spark.createDataFrame([(7, 1), (8, 99)], "remediation_id int, signature_id int")
    assert rows(memory.append_remediations(fixes, spark.read.parquet(path), str(tmp_path / "r"))) == [(8, 99)]
    assert rows(spark.read.parquet(str(tmp_path / "r"))) == [(7, 1)]


def test_failure_signatures(spark):
    from keepsake.operators import derivations

    failures = spark.createDataFrame([("r", "eval", "Traceback\n  File x\nValueError: bad shape\n\n"), ("s", "env", "")], "run_id string, stage string, traceback string")
    reads = spark.createDataFrame([("r", "lr", "0.1"), ("r", "secret", "x")], "run_id string, key string, value string")
    got = {r.run_id: (r.error_class, r.last_line, r.features) for r in derivations.failure_signatures(failures, reads, ["lr"]).collect()}
    assert got["r"] == ("ValueError", "ValueError: bad shape", {"lr": "0.1"}) and got["s"][2] is None
    full = {r.run_id: r for r in derivations.failure_signatures(failures, reads, ["lr"], lambda text: corpus.hash_embed(text, 8)).collect()}
    assert full["r"].summary == "eval | ValueError | ValueError: bad shape | lr=0.1" and len(full["s"].embedding) == 8
