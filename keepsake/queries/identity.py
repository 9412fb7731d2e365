"""Queries of fingerprints."""

from pyspark.sql import functions as F

from keepsake.operators import identity as op
from keepsake.queries.registry import Registry, framed, summed

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


def _set(table, by, label, *members):
    return f"SELECT {by}, {summed(label, 'm')} AS digest FROM (SELECT DISTINCT {by}, {framed(label + '-member', *members)} AS m FROM {table}) GROUP BY {by}"


@R.query("decisions", sql=_set("(SELECT stage, action AS key, verdict AS value FROM {decisions})", "stage", "config", "key", "value"))
def d1_config_fingerprint(dec):
    return op.config_fingerprint(dec.select("stage", F.col("action").alias("key"), F.col("verdict").alias("value")))


@R.query("artifacts", sql=_set("(SELECT stage, artifact_id AS unit_id, size_bytes AS unit_digest FROM {artifacts})", "stage", "code", "unit_id", "unit_digest"))
def d2_code_fingerprint(artifacts):
    return op.code_fingerprint(artifacts.select("stage", F.col("artifact_id").alias("unit_id"), F.col("size_bytes").alias("unit_digest")))


@R.query("artifacts", "artifact_inputs", sql="WITH ups AS (" + _set("(SELECT artifact_id AS stage, ref AS up FROM {artifact_inputs})", "stage", "upstream", "up") + f") SELECT artifact_id AS stage, {framed('work', 'artifact_id', 'size_bytes', 'duration_ms', 'k', 'digest')} AS work_key, false AS provisional FROM {{artifacts}} LEFT JOIN ups ON artifact_id = ups.stage")
def d4_work_keys(artifacts, inputs):
    stages = artifacts.select(F.col("artifact_id").alias("stage"), F.col("size_bytes").alias("config"), F.col("duration_ms").alias("code"), F.col("k").alias("env"))
    upstream = inputs.select(F.col("artifact_id").alias("stage"), F.col("ref").alias("artifact_id"), F.lit(None).cast("string").alias("planned_key"))
    return op.work_keys(stages, upstream).select("stage", "work_key", "provisional")


@R.query("fragments", sql=_set("(SELECT work_key AS trace_id, 'file' AS kind, part AS ref, CASE WHEN fragment_index % 2 = 0 THEN 'read' ELSE 'write' END AS mode, duration_ms AS version FROM {fragments} WHERE fragment_index % 2 = 0)", "trace_id", "resources", "kind", "ref", "mode", "version"))
def d8_resource_set_digest(fragments):
    rows = fragments.select(F.col("work_key").alias("trace_id"), F.lit("file").alias("kind"), F.col("part").alias("ref"), F.when(F.col("fragment_index") % 2 == 0, "read").otherwise("write").alias("mode"), F.col("duration_ms").alias("version"))
    return op.resource_set_digest(rows, ["read"])


@R.query("claims", sql=f"SELECT work_key, CASE WHEN fence >= 1 THEN {framed('claim', 'stage', 'work_key', 'fence')} END AS claim_key FROM {{claims}}")
def d10_claim_key(claims):
    return claims.select("work_key", op.claim_key(F.col("stage"), F.col("work_key"), F.col("fence")).alias("claim_key"))


@R.query("artifacts", sql="""WITH s AS (SELECT k % 3 AS ns, k % 7 AS a, k % 2 AS o, CASE WHEN k % 5 > 0 THEN k % 5 END AS img, k % 4 AS net, k % 6 AS runs FROM {artifacts}), d AS (SELECT DISTINCT ns, a, o, coalesce(img, -1) AS img, net, runs FROM s)
SELECT 'spec' AS identity, count(*) AS n FROM d UNION ALL SELECT 'compatibility', count(*) FROM (SELECT DISTINCT a, o, img, net FROM d) UNION ALL SELECT 'coverage_profile', count(*) FROM (SELECT DISTINCT img = -1, net FROM d)
UNION ALL SELECT 'platform', count(*) FROM (SELECT DISTINCT img FROM d) UNION ALL SELECT 'output_contract', count(*) FROM (SELECT DISTINCT o FROM d)""")
def d7_spec_identities(artifacts):
    k, text = F.col("k"), lambda m: (F.col("k") % m).cast("string")
    platform = F.struct(F.lit("linux").alias("os"), F.lit("x86").alias("arch"), F.when(k % 5 > 0, text(5)).alias("image_digest"))
    purity = F.struct(F.lit("c").alias("contract_id"), text(4).alias("network"), F.lit("t").alias("clock"), F.lit("r").alias("random"), F.array(F.lit("HOME")).alias("env_names"), (k % 6).alias("qualification_runs"))
    versions = [F.lit("1").alias(c) for c in ("tracer_version", "companion_version", "adapter_registry_version")]
    specs = artifacts.select(text(3).alias("namespace_id"), F.array(F.lit("run"), text(7)).alias("argv"), F.lit(".").alias("cwd_rel"), F.struct(text(2).alias("path_rel"), F.lit("file").alias("kind")).alias("output"), platform.alias("platform"), purity.alias("purity"), F.lit(None).cast("struct<adapter_id: string>").alias("adapter"), *versions)
    listed = F.explode(F.array(*[F.struct(F.lit(i).alias("identity"), F.col(f"{i}_digest").alias("digest")) for i in op.IDENTITIES])).alias("x")
    return op.spec_identities(specs).select(listed).select("x.*").groupBy("identity").agg(F.count_distinct("digest").alias("n"))


#: Parents of each stage of a plan.
_PARENTS = {"s0": [], "s1": ["s0"], "s2": ["s0", "s1"], "s3": ["s2"], "s4": ["s1", "s3"]}


def _planned_sql() -> str:
    """A level after the other, each from the keys of those before it; s0 is done in every third plan and s2 in every fifth."""
    done = {"s0": "p.k % 3 = 0", "s2": "p.k % 5 = 0"}
    parts = ["p AS (SELECT p_partkey AS k FROM {part})"]
    for s, parents in _PARENTS.items():
        ups = [f"SELECT p.k, CASE WHEN {done.get(u, 'false')} THEN concat('{u}-', cast(p.k AS string)) ELSE concat('planned:', x.work_key) END AS up FROM p JOIN {u} x ON x.k = p.k" for u in parents] or ["SELECT k, '' AS up FROM p WHERE false"]
        parts.append(f"u{s} AS (SELECT k, up FROM ({' UNION ALL '.join(ups)}))")
        parts.append(f"d{s} AS ({_set(f'u{s}', 'k', 'upstream', 'up')})")
        opened = " OR ".join(f"NOT ({done.get(u, 'false')})" for u in parents) or "false"
        key = framed("work", "stage", "config", "code", "env", "digest")
        parts.append(f"{s} AS (SELECT p.k, stage, {key} AS work_key, {opened} AS provisional FROM (SELECT p.k, '{s}' AS stage, p.k AS config, p.k % 7 AS code, 'e' AS env, digest FROM p LEFT JOIN d{s} d ON d.k = p.k) p)")
    return "WITH " + ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT k AS plan, stage, work_key, provisional FROM {s}" for s in _PARENTS)


@R.query("part", sql=_planned_sql())
def d4_plan_keys(part):
    """Plans of five stages in five levels, some of whose stages are done."""
    k = F.col("p_partkey")
    stages = part.select(k.alias("plan"), F.explode(F.array(*map(F.lit, _PARENTS))).alias("stage"), k.alias("config"), (k % 7).alias("code"), F.lit("e").alias("env"))
    pairs = [(s, u) for s, us in _PARENTS.items() for u in us]
    edges = part.select(k.alias("plan"), F.explode(F.array(*[F.struct(F.lit(s).alias("stage"), F.lit(u).alias("parent")) for s, u in pairs])).alias("e")).select("plan", "e.*")
    done = part.select(k.alias("plan"), F.explode(F.array_compact(F.array(F.when(k % 3 == 0, "s0"), F.when(k % 5 == 0, "s2")))).alias("stage"))
    artifacts = done.select("plan", "stage", F.concat_ws("-", "stage", F.col("plan").cast("string")).alias("artifact_id"))
    return op.plan_keys(stages, edges, artifacts).select("plan", "stage", "work_key", "provisional")
