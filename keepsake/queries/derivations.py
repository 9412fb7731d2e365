"""Queries of derivation snapshots."""

from pyspark.sql import functions as F

from keepsake.operators import derivations as op
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle


@R.query("decisions", "claims", sql="""WITH d AS (SELECT decision_id, created_at, decision_id AS derivation_id, CASE WHEN decision_id % 3 = 0 THEN decision_id END AS observation_id FROM {decisions} ORDER BY created_at DESC, decision_id DESC LIMIT 500)
SELECT decision_id, CASE WHEN observation_id % 2 = 0 THEN 'VALIDATED' END AS lifecycle, c.state, c.owner_id AS run_id FROM d LEFT JOIN {claims} c ON c.work_key = decision_id * 2""")
def f13_executions(decisions, claims):
    k = F.col("decision_id")
    dec = decisions.select("decision_id", "created_at", k.alias("derivation_id"), F.when(k % 3 == 0, k).alias("observation_id"))
    observations = decisions.where(k % 2 == 0).select(k.alias("observation_id"), k.alias("trace_digest"), F.lit("VALIDATED").alias("lifecycle"))
    traces = decisions.select(k.alias("trace_digest"), F.lit("x").alias("coverage"))
    derivations = decisions.select(k.alias("derivation_id"), k.alias("blob_digest"), (k * 2).alias("work_key"))
    blobs = decisions.select(k.alias("blob_digest"), F.lit("VALID").alias("blob_state"))
    held = claims.select("work_key", "state", F.col("owner_id").alias("run_id"))
    runs = claims.select(F.col("owner_id").alias("run_id"), F.lit("t").alias("task")).distinct()
    return op.executions(dec, observations, traces, derivations, blobs, held, runs, 500).select("decision_id", "lifecycle", "state", "run_id")


@R.query("fragments", "claims", sql="""WITH r AS (SELECT work_key AS root_id, owner_id AS root_key, owner_id AS root_run FROM {claims} QUALIFY row_number() OVER (PARTITION BY owner_id ORDER BY claimed_at DESC, work_key DESC) = 1)
SELECT root_key, fragment_index AS ordinal, part AS derivation_id, CASE WHEN c.owner_id IS NOT DISTINCT FROM root_run THEN 'COMPUTED' ELSE 'RESTORE' END AS action FROM r JOIN {fragments} f ON f.work_key = root_id LEFT JOIN {claims} c ON c.work_key = part""")
def f14_leaf_map(fragments, claims):
    roots = claims.select(F.col("work_key").alias("root_id"), F.col("owner_id").alias("work_key"), F.col("owner_id").alias("root_run"), F.col("claimed_at").alias("created_at"))
    leaves = fragments.select(F.col("work_key").alias("root_id"), F.col("fragment_index").alias("ordinal"), F.col("part").alias("derivation_id"))
    derivations = fragments.select(F.col("part").alias("derivation_id")).distinct().select("derivation_id", F.col("derivation_id").alias("work_key"), F.col("derivation_id").alias("blob_digest"))
    held = claims.select("work_key", "state", F.col("owner_id").alias("run_id"), "fence")
    return op.leaf_map(roots, leaves, derivations, held).select("root_key", "ordinal", "derivation_id", "action")


@R.query("fragments", sql="SELECT work_key AS receipt_id, count(*) FILTER (part % 7 > 1) AS ok, count(*) FILTER (part % 7 = 1) AS mismatch, count(*) FILTER (part % 7 = 0) AS unavailable FROM {fragments} GROUP BY 1")
def f17_verify_receipts(fragments):
    receipts = fragments.select(F.col("work_key").alias("receipt_id"), F.col("part").alias("digest"))
    verified = fragments.select(F.col("part").alias("digest")).distinct().where("digest % 7 <> 0").withColumn("status", F.when(F.col("digest") % 7 == 1, "mismatch").otherwise("ok"))
    return op.verify_receipts(receipts, verified)


@R.query("claims", sql="""SELECT work_key, 1 AS generation, CASE WHEN work_key % 4 = 0 THEN 'INVALIDATED' ELSE 'PUBLISHED' END AS gen_state, work_key % 4 <> 0 AS is_head FROM {claims} UNION ALL SELECT work_key, 2, 'PENDING', true FROM {claims} WHERE work_key % 4 = 0""")
def g13_invalidate(claims):
    k = F.col("work_key")
    generations = claims.select("work_key", F.lit(1).alias("generation"), F.lit("PUBLISHED").alias("gen_state"), F.lit(True).alias("is_head"))
    derivations = claims.select("work_key", F.lit(1).alias("generation"), k.alias("blob_digest"), F.lit(False).alias("quarantined"))
    blobs = claims.select(k.alias("blob_digest"), F.lit("VALID").alias("blob_state"))
    return op.invalidate_generations(generations.where(k % 4 == 0), generations, derivations, blobs, claims)["generations"]


@R.query("artifacts", sql="""SELECT k AS rule_id, 1 AS revision, CASE WHEN k % 5 = 0 THEN 'SUPERSEDED' ELSE 'ACTIVE' END AS rule_state, k % 5 <> 0 AS is_head FROM {artifacts}
UNION ALL SELECT k, 2, CASE WHEN k % 10 = 0 THEN 'DISABLED' ELSE 'TIGHTENED' END, true FROM {artifacts} WHERE k % 5 = 0""")
def g15_tighten_rules(artifacts):
    rules = op.ensure_rules(artifacts.limit(0).select(F.col("k").alias("rule_id"), F.lit(1).alias("revision"), F.lit("").alias("rule_state"), F.lit(True).alias("is_head")), artifacts.select(F.col("k").alias("rule_id")))
    against = artifacts.select(F.col("k").alias("rule_id"), F.when(F.col("k") % 5 == 0, 1).otherwise(9).alias("revision"), F.lit("seen").alias("evidence"), F.when(F.col("k") % 10 == 0, "recompute").otherwise("probe").alias("authority"))
    return op.tighten_rules(rules, against, F.col("authority"))


_PATH = """WITH d AS (SELECT DISTINCT part AS derivation_id FROM {fragments})
SELECT f.work_key AS root_id, f.fragment_index AS ordinal, CASE WHEN d.derivation_id % 50 = f.work_key % 50 THEN 'COMPUTED' ELSE 'RESTORE' END AS action, CASE WHEN d.derivation_id % 50 <> f.work_key % 50 THEN 'identity' END AS authorized_by, c.fence, coalesce(s.n, 0) AS subscribers
FROM {fragments} f JOIN d ON d.derivation_id = f.part LEFT JOIN {claims} c ON c.work_key = f.part LEFT JOIN (SELECT owner_id, count(*) AS n FROM {claims} GROUP BY 1) s ON s.owner_id = f.part"""


def _leaves(fragments):
    return fragments.select(F.col("work_key").alias("root_id"), F.col("fragment_index").alias("ordinal"), F.col("part").alias("child_id"), F.col("duration_ms").cast("string").alias("slice_digest"))


def _derivations(fragments):
    d = F.col("derivation_id")
    return fragments.select(F.col("part").alias("derivation_id")).distinct().select("derivation_id", d.alias("work_key"), F.lit(1).alias("generation"), d.alias("blob_digest"), F.lit("PUBLISHED").alias("state"), (d % 50).alias("run_id"))


@R.query("fragments", "claims", sql=_PATH)
def f15_leaf_path(fragments, claims):
    roots = fragments.select(F.col("work_key").alias("root_id")).distinct().withColumn("root_run", F.col("root_id") % 50)
    subscribers = claims.select(F.col("owner_id").alias("work_key"), F.lit(1).alias("generation"))
    return op.leaf_path(roots, _leaves(fragments), _derivations(fragments), claims, subscribers).select("root_id", "ordinal", "action", "authorized_by", "fence", "subscribers")


@R.query("fragments", sql="""WITH l AS (SELECT work_key AS root_id, fragment_index AS ordinal, part, duration_ms FROM {fragments}), parts AS (SELECT DISTINCT part FROM {fragments}),
places AS (SELECT part, CASE WHEN part % 6 <> 0 THEN concat(',"location":"cas/', cast(part AS varchar), '"') ELSE '' END AS place, CASE WHEN part % 6 <> 0 THEN concat(',"size":', cast(part * 10 AS varchar)) ELSE '' END AS size FROM parts),
j AS (SELECT root_id, count(*) AS n, count(*) FILTER (part % 6 = 0) AS lost, string_agg(concat('{"blob_digest":', cast(part AS varchar), ',"child_id":', cast(part AS varchar), place, ',"ordinal":', cast(ordinal AS varchar), size, ',"slice_digest":"', cast(duration_ms AS varchar), '"}'), ',' ORDER BY ordinal) AS s FROM l JOIN places USING (part) GROUP BY 1)
SELECT part AS root_id, coalesce(n, 0) AS n_leaves, coalesce(lost, 0) AS n_unavailable, concat('{"blob_digest":', cast(part AS varchar), ',"leaves":[', coalesce(s, ''), ']', place, ',"root_id":', cast(part AS varchar), size, ',"work_key":', cast(part AS varchar), '}') AS receipt FROM places LEFT JOIN j ON root_id = part""")
def f16_receipts(fragments):
    derivations = _derivations(fragments)
    b = F.col("blob_digest")
    blobs = derivations.where(b % 6 != 0).select("blob_digest", F.concat(F.lit("cas/"), b.cast("string")).alias("location"), (b * 10).alias("size"))
    return op.receipts(derivations.select(F.col("derivation_id").alias("root_id")), _leaves(fragments), derivations, blobs)


_TOP = "SELECT '{0}' AS scenario, cast(row_number() OVER (ORDER BY {3}) AS integer) AS place, cast({1} AS varchar) AS ref, cast({2} AS varchar) AS note FROM {4} QUALIFY row_number() OVER (ORDER BY {3}) <= {5}"


@R.query("decisions", "transfers", "fragments", "signatures", "remediations", sql=" UNION ALL ".join([
    _TOP.format("reuse", "decision_id", "stage", "created_at DESC, decision_id DESC", "{decisions} WHERE verdict = 'reuse'", 5), _TOP.format("verdicts", "decision_id", "verdict", "created_at DESC, decision_id DESC", "{decisions} WHERE verdict IN ('reuse', 'recompute')", 10),
    "SELECT 'takeover' AS scenario, 0 AS place, NULL AS ref, 'no transfer' AS note", _TOP.format("fragments", "work_key", "n", "n DESC, work_key DESC", "(SELECT work_key, count(*) AS n FROM {fragments} GROUP BY 1)", 2),
    _TOP.format("failures", "signature_id", "coalesce(cast(remediation_id AS varchar), 'none')", "s.created_at DESC, signature_id DESC", "{signatures} s LEFT JOIN (SELECT signature_id, remediation_id FROM {remediations}) r USING (signature_id)", 5)]))
def f18_replay_scenarios(decisions, transfers, fragments, signatures, remediations):
    return op.replay_scenarios(decisions, transfers.where("to_fence < 0"), fragments, signatures, remediations)
