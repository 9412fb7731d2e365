"""Queries of claims, fragments, commits and derivations."""

from pyspark.sql import functions as F

from keepsake.operators import claims as op
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_AS_OF = "1998-01-01 00:00:00"


def as_of(df, column="lease_expires_at"):
    return F.lit(_AS_OF).cast(df.schema[column].dataType)


@R.query("claims", "fragments", "transfers", sql=f"""WITH newest AS (SELECT * FROM {{claims}} WHERE stage <> 'race_test' ORDER BY claimed_at DESC, work_key DESC LIMIT 200),
f AS (SELECT work_key, count(*) AS n, max(fragment_index) AS m FROM {{fragments}} GROUP BY 1), t AS (SELECT work_key, string_agg(reason, ',' ORDER BY to_fence DESC, reason DESC) AS r FROM {{transfers}} GROUP BY 1)
SELECT work_key, state, owner_id, fence, cast(epoch(lease_expires_at) - epoch(TIMESTAMP '{_AS_OF}') AS bigint) AS seconds_left, coalesce(n, 0) AS n_fragments, m AS last_fragment, coalesce(r, '') AS transfers FROM newest LEFT JOIN f USING (work_key) LEFT JOIN t USING (work_key)""")
def g1_claims_board(claims, fragments, transfers):
    return op.claims_board(claims, fragments, transfers, as_of(claims), 200)


@R.query("fragments", sql="SELECT work_key, count(*) AS n_fragments, max(fragment_index) AS last_fragment, sum(duration_ms) AS duration_ms FROM {fragments} GROUP BY 1")
def g2_fragment_progress(fragments):
    return op.fragment_progress(fragments)


@R.query("claims", sql=f"SELECT CASE WHEN state IN ('CLAIMED', 'RUNNING') AND lease_expires_at < TIMESTAMP '{_AS_OF}' THEN 'ABANDONED' ELSE state END AS state, count(*) AS n, sum(work_key) AS keys FROM {{claims}} GROUP BY 1")
def g3_reap(claims):
    return op.reap(claims, as_of(claims))[0].groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.sum("work_key").alias("keys"))


@R.query("claims", sql=f"""SELECT r.work_key, CASE WHEN state IS NULL THEN 'owner' WHEN state = 'SUCCEEDED' THEN 'reuse' WHEN lease_expires_at < TIMESTAMP '{_AS_OF}' THEN 'takeover:lease_expired' ELSE 'subscriber' END AS role
FROM (SELECT work_key * 2 AS work_key FROM {{claims}}) r LEFT JOIN {{claims}} c ON r.work_key = c.work_key""")
def g4_claim_roles(claims):
    return op.claim_roles(claims.select((F.col("work_key") * 2).alias("work_key")), claims, as_of(claims))


def _attempts(commits, claims):
    return op.fence_gate(commits.join(claims.select("work_key", "owner_id"), "work_key").withColumn("fence", 1 + F.col("work_key") % 4 - F.when(F.col("input") % 9 == 0, 1).otherwise(0)), claims)


_GATED = """WITH gated AS (SELECT k.*, CASE WHEN c.state NOT IN ('CLAIMED', 'RUNNING') THEN 'not_open' WHEN k.input % 9 = 0 THEN 'stale_fence' ELSE 'accepted' END AS reason FROM {commits} k JOIN {claims} c USING (work_key)) """


@R.query("commits", "claims", sql=_GATED + "SELECT reason, count(*) AS n, sum(work_key) AS keys FROM gated GROUP BY 1")
def g5_fence_gate(commits, claims):
    return _attempts(commits, claims).groupBy("reason").agg(F.count(F.lit(1)).alias("n"), F.sum("work_key").alias("keys"))


@R.query("commits", "claims", sql=_GATED + """SELECT work_key, chunk, attempt, CASE WHEN reason <> 'accepted' THEN 'REJECTED_FENCE' WHEN k = 1 THEN 'COMMITTED' WHEN input = i AND blob = b THEN 'ALREADY_PRESENT' ELSE 'NONDETERMINISTIC' END AS outcome
FROM (SELECT *, row_number() OVER w AS k, first_value(input) OVER w AS i, first_value(blob) OVER w AS b FROM gated WINDOW w AS (PARTITION BY work_key, chunk ORDER BY reason <> 'accepted', attempt))""")
def g6_classify_commits(commits, claims):
    return op.classify_commits(_attempts(commits, claims), ["work_key", "chunk"], ["attempt"]).select("work_key", "chunk", "attempt", "outcome")


@R.query("claims", "artifacts", sql="""WITH r AS (SELECT work_key, fence, owner_id, work_key % 7 AS m FROM {claims})
SELECT work_key, CASE WHEN m = 0 THEN 'REJECTED_FENCE' WHEN m = 1 THEN 'ALREADY_PRESENT' WHEN m = 2 OR m = 3 THEN 'REJECTED_FENCE' WHEN m = 4 OR m = 5 THEN 'STALE_AUTHORITY' ELSE CASE WHEN work_key % 3 = 0 THEN 'STALE_AUTHORITY' ELSE 'PUBLISHED' END END AS outcome FROM r""")
def g7_publications(claims, artifacts):
    m = F.col("work_key") % 7
    requests = claims.select("work_key", F.col("work_key").alias("request_id"), F.lit("op").alias("operation_id"), "owner_id", "fence", F.when(m == 4, F.col("work_key")).alias("observation_id"), F.when(m == 5, F.col("work_key")).alias("rule_id"), F.lit(1).alias("rule_revision"))
    generations = claims.where(m != 0).select("work_key", F.when(m == 2, "INVALIDATED").otherwise("RUNNING").alias("gen_state"), F.when(m == 1, "op").alias("current_operation"), F.col("owner_id").alias("gen_owner"), (F.col("fence") + F.when(m == 3, 1).otherwise(0)).alias("gen_fence"))
    observations = claims.where(m == 4).select(F.col("work_key").alias("observation_id"), F.col("work_key").alias("observed_key"), F.lit("SUPERSEDED").alias("lifecycle"))
    rules = claims.where(m == 5).select(F.col("work_key").alias("rule_id"), F.lit(2).alias("live_revision"), F.lit("ACTIVE").alias("rule_state"))
    children = claims.where(m == 6).select(F.col("work_key").alias("request_id"), F.lit("PUBLISHED").alias("child_state"), (F.col("work_key") % 3 == 0).alias("quarantined"))
    return op.classify_publications(requests, generations, observations, rules, children).select("work_key", "outcome")


@R.query("claims", sql="SELECT work_key FROM {claims} WHERE work_key % 5 <> 0 AND work_key % 7 <> 0 AND work_key % 11 <> 0 AND NOT (work_key % 2 = 0 AND work_key % 3 = 0)")
def g9_current_derivations(claims):
    k = F.col("work_key")
    derivations = claims.select("work_key", F.lit(1).alias("generation"), (k % 5 == 0).alias("quarantined"), k.alias("blob_digest"), F.when(k % 2 == 0, k).alias("observation_id"), F.when(k % 11 == 0, k).alias("rule_id"), F.lit(1).alias("rule_revision"))
    generations = claims.select("work_key", F.lit(1).alias("generation"), F.lit(True).alias("is_head"), F.lit("PUBLISHED").alias("gen_state"))
    blobs = claims.select(k.alias("blob_digest"), F.when(k % 7 == 0, "INVALID").otherwise("VALID").alias("blob_state"))
    observations = claims.select(k.alias("observation_id"), F.when(k % 3 == 0, "CANDIDATE").otherwise("VALIDATED").alias("lifecycle"))
    rules = claims.select(k.alias("rule_id"), F.lit(2).alias("live_revision"), F.lit("TIGHTENED").alias("rule_state"))
    return op.current_derivations(derivations, generations, blobs, observations, rules).select("work_key")


@R.query("claims", sql="SELECT work_key FROM (SELECT work_key, row_number() OVER (PARTITION BY owner_id ORDER BY claimed_at DESC, work_key DESC) AS k FROM {claims} WHERE state = 'RUNNING') WHERE k <= 8")
def g10_select_observations(claims):
    seen = claims.select(F.col("work_key").alias("observation_id"), F.col("owner_id").alias("compatibility_key"), F.when(F.col("state") == "RUNNING", "VALIDATED").otherwise("CANDIDATE").alias("lifecycle"), F.col("claimed_at").alias("created_at"))
    return op.select_observations(seen, "VALIDATED").select(F.col("observation_id").alias("work_key"))


@R.query("claims", sql="""WITH b AS (SELECT work_key, work_key % 3 AS priors, work_key % 2 AS resolvable, work_key % 5 = 0 AS adapter, work_key % 7 = 0 AS candidate, work_key % 11 = 0 AS shadow, work_key % 4 < 2 AS cur, CASE WHEN work_key % 13 > 0 THEN 'ACTIVE' END AS rs, work_key % 17 = 0 AS tight, work_key % 19 = 0 AS coal FROM {claims})
SELECT work_key, CASE WHEN priors > 0 AND resolvable = 0 THEN 'REFUSE_REUSE' WHEN priors = 0 AND NOT adapter AND NOT candidate THEN 'RUN_SHADOW_LEARN' WHEN shadow THEN 'RUN_SHADOW_LEARN' WHEN NOT cur AND candidate THEN 'RUN_ISOLATED_QUALIFICATION'
WHEN cur AND rs IS NULL THEN 'REFUSE_REUSE' WHEN cur THEN 'RESTORE' WHEN tight AND NOT coal THEN 'REFUSE_REUSE' WHEN priors = 0 AND NOT coal THEN 'RUN_SHADOW_LEARN' ELSE 'RUN' END AS decision FROM b""")
def g18_reuse_eligibility(claims):
    k = F.col("work_key")
    rows = claims.select("work_key", (k % 3).alias("priors"), (k % 2).alias("resolvable"), (k % 5 == 0).alias("has_adapter"), (k % 7 == 0).alias("has_candidate"), (k % 11 == 0).alias("shadow"), (k % 4 < 2).alias("has_current"), F.when(k % 13 > 0, "ACTIVE").alias("rule_state"), F.lit("restore").alias("rule_authority"), F.lit(False).alias("rule_needs_probe"), F.lit(False).alias("revision_differs"), (k % 17 == 0).alias("tightened"), (k % 19 == 0).alias("coalescing"))
    return op.reuse_eligibility(rows).select("work_key", "decision")


@R.query("fragments", sql="SELECT work_key, i AS fragment_index FROM (SELECT DISTINCT work_key FROM {fragments}) CROSS JOIN range(1, 8) t(i) WHERE (work_key, i) NOT IN (SELECT work_key, fragment_index FROM {fragments})")
def g20_pending_fragments(fragments):
    expected = fragments.select("work_key").distinct().select("work_key", F.explode(F.sequence(F.lit(1), F.lit(7))).alias("fragment_index"))
    return op.pending_fragments(expected, fragments)


@R.query("commits", "lineitem", sql="""WITH l AS (SELECT work_key * 10 + chunk AS work_key, attempt, 1 + attempt - CASE WHEN input % 40 = 0 THEN 2 ELSE 0 END AS fence, attempt = 1 OR blob % 50 = 0 AS won FROM {commits}),
r AS (SELECT work_key, won, coalesce(fence > lag(fence) OVER (PARTITION BY work_key ORDER BY attempt), true) AS up FROM l)
SELECT work_key, winners, fences_rise FROM (SELECT work_key, count(*) FILTER (won) AS winners, bool_and(up) AS fences_rise FROM r GROUP BY 1) WHERE winners <> 1 OR NOT fences_rise""")
def g21_audit_races(commits, items):
    log = commits.select((F.col("work_key") * 10 + F.col("chunk")).alias("work_key"), "attempt", (1 + F.col("attempt") - F.when(F.col("input") % 40 == 0, 2).otherwise(0)).alias("fence"), ((F.col("attempt") == 1) | (F.col("blob") % 50 == 0)).alias("won"))
    return op.audit_races(log, items.count())  # a commit for each row


@R.query("fragments", sql="""SELECT work_key, n_chunks, window_s, CASE WHEN n_chunks > 1 AND window_s > 0 THEN 'sub_leaf_resume_candidate' ELSE 'whole_stage_takeover' END AS mode
FROM (SELECT work_key, count(*) AS n_chunks, cast(max(epoch(created_at)) - min(epoch(created_at)) AS bigint) AS window_s FROM {fragments} GROUP BY 1)""")
def g22_chunk_timing(fragments):
    return op.chunk_timing(fragments, F.unix_seconds(F.col("created_at").cast("timestamp")))


@R.query("claims", sql="""WITH b AS (SELECT work_key, fence, state, work_key % 3 AS m FROM {claims})
SELECT work_key, CASE WHEN m = 0 THEN 'PUBLISHED' ELSE 'RUNNING' END AS gen_state, CASE WHEN m = 0 AND state IN ('CLAIMED', 'RUNNING') THEN 'SUCCEEDED' ELSE state END AS state, CASE WHEN m = 0 THEN 'COMPLETED' ELSE 'LIVE' END AS sub_state,
  CASE WHEN m = 0 THEN CASE WHEN work_key % 2 = 0 THEN 'REUSE' ELSE 'RECOMPUTE' END END AS action, CASE WHEN m = 0 AND work_key % 2 = 0 THEN 'probe' END AS authorized_by, CASE WHEN m = 0 THEN 2 ELSE 0 END AS n_edges FROM b""")
def g8_apply_publications(claims):
    k = F.col("work_key")
    published = claims.where(k % 3 == 0).select("work_key", k.alias("request_id"), F.lit(1).alias("generation"), k.alias("derivation_id"), F.lit("op").alias("operation_id"), "owner_id", "fence", k.alias("observation_id"), F.lit("probe").alias("authority"))
    generations = claims.select("work_key", F.lit(1).alias("generation"), F.lit("RUNNING").alias("gen_state"), F.lit(None).cast("bigint").alias("derivation_id"), F.lit(None).cast("string").alias("current_operation"))
    subscribers = claims.select("work_key", F.lit(1).alias("generation"), k.alias("subscriber_id"), F.lit("LIVE").alias("state"))
    leaves = claims.select(k.alias("request_id"), F.explode(F.sequence(F.lit(0), F.lit(1))).alias("ordinal")).withColumn("child_id", F.col("request_id") * 10 + F.col("ordinal"))
    observations = claims.select(k.alias("observation_id"), F.when(k % 2 == 0, "VALIDATED").otherwise("CANDIDATE").alias("lifecycle"))
    out = op.apply_publications(published, generations, claims, subscribers, leaves, observations)
    edges = out["edges"].groupBy(F.col("parent_id").alias("work_key")).agg(F.count("child_id").alias("n_edges"))
    rows = out["generations"].select("work_key", "gen_state").join(out["claims"].select("work_key", "state"), "work_key").join(out["subscribers"].select("work_key", F.col("state").alias("sub_state")), "work_key")
    rows = rows.join(out["decisions"].select("work_key", "action", "authorized_by"), "work_key", "left").join(edges, "work_key", "left")
    return rows.withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


_SEEN = "(SELECT work_key AS observation_id, owner_id AS semantic_key, CASE WHEN state = 'RUNNING' THEN 'CANDIDATE' WHEN state = 'SUCCEEDED' THEN 'VALIDATED' ELSE 'INCOMPLETE' END AS lifecycle, claimed_at AS created_at FROM {claims})"


def _seen(claims):
    lifecycle = F.when(F.col("state") == "RUNNING", "CANDIDATE").when(F.col("state") == "SUCCEEDED", "VALIDATED").otherwise("INCOMPLETE")
    return claims.select(F.col("work_key").alias("observation_id"), F.col("owner_id").alias("semantic_key"), lifecycle.alias("lifecycle"), F.col("claimed_at").alias("created_at"))


@R.query("claims", sql=f"SELECT semantic_key, observation_id FROM {_SEEN} WHERE lifecycle = 'CANDIDATE' QUALIFY row_number() OVER (PARTITION BY semantic_key ORDER BY created_at DESC, observation_id DESC) = 1")
def g11_candidate_observation(claims):
    return op.candidate_observation(_seen(claims)).select("semantic_key", "observation_id")


@R.query("claims", sql=f"SELECT lifecycle, count(*) AS n FROM (SELECT CASE WHEN observation_id % 7 = 0 AND lifecycle IN ('CANDIDATE', 'VALIDATED') THEN 'SUPERSEDED' WHEN observation_id % 5 = 0 AND lifecycle = 'CANDIDATE' THEN 'VALIDATED' ELSE lifecycle END AS lifecycle FROM {_SEEN}) GROUP BY 1")
def g12_promote_supersede(claims):
    seen = _seen(claims)
    promoted = op.promote(seen, seen.where("observation_id % 5 = 0"))
    return op.supersede(promoted, seen.where("observation_id % 7 = 0")).groupBy("lifecycle").agg(F.count("observation_id").alias("n"))


_REVISIONS = "(SELECT k AS rule_id, r AS revision, CASE WHEN r < 1 + k % 2 THEN 'SUPERSEDED' WHEN k % 6 < 3 THEN 'TIGHTENED' ELSE 'ACTIVE' END AS rule_state, CASE k % 3 WHEN 0 THEN 'probe' WHEN 1 THEN 'recompute' ELSE 'identity' END AS required_authority FROM {artifacts} CROSS JOIN range(1, 3) t(r) WHERE r <= 1 + k % 2)"


def _authority(artifacts):
    k, r = F.col("k"), F.col("revision")
    state = F.when(r < 1 + k % 2, "SUPERSEDED").when(k % 6 < 3, "TIGHTENED").otherwise("ACTIVE")
    needs = F.when(k % 3 == 0, "probe").when(k % 3 == 1, "recompute").otherwise("identity")
    revisions = artifacts.select("k", F.explode(F.sequence(F.lit(1), (1 + k % 2).cast("int"))).alias("revision")).select(k.alias("rule_id"), "revision", state.alias("rule_state"), needs.alias("required_authority"))
    return op.rule_authority(artifacts.select(k.alias("rule_id"), (1 + k % 2).cast("int").alias("current_revision")), revisions)


@R.query("artifacts", sql=f"SELECT rule_id, revision, rule_state, required_authority FROM {_REVISIONS} WHERE revision = 1 + rule_id % 2")
def g16_rule_authority(artifacts):
    return _authority(artifacts)


@R.query("artifacts", sql=f"""WITH live AS (SELECT * FROM {_REVISIONS} WHERE revision = 1 + rule_id % 2),
d AS (SELECT a.k AS work_key, CASE WHEN a.k % 5 <> 0 THEN a.k END AS rule_id, a.k % 4 <> 0 AS q FROM {{artifacts}} a)
SELECT work_key, CASE WHEN NOT q THEN NULL WHEN d.rule_id IS NULL THEN 'quarantined, by no rule' WHEN revision <> 1 THEN concat('rule ', cast(d.rule_id AS varchar), ' was tightened to revision ', cast(revision AS varchar), ' and requires ', required_authority)
  WHEN rule_state IN ('DISABLED', 'TIGHTENED') AND required_authority IN ('probe', 'recompute') THEN concat('rule ', cast(d.rule_id AS varchar), ' requires ', required_authority) ELSE 'quarantined, after a contradiction' END AS reason FROM d LEFT JOIN live USING (rule_id)""")
def g17_refusal_reason(artifacts):
    k = F.col("k")
    newest = artifacts.select(k.alias("derivation_id"), k.alias("work_key"), F.when(k % 5 != 0, k).alias("rule_id"), F.lit(1).alias("rule_revision"), F.when(k % 8 == 1, "QUARANTINED").otherwise("PUBLISHED").alias("state"), ((k % 4 != 0) & (k % 8 != 1)).alias("quarantined"), F.lit(2).alias("created_at"))
    older = newest.withColumn("created_at", F.lit(1)).withColumn("quarantined", F.lit(True))
    return op.refusal_reason(artifacts.select(k.alias("work_key")), newest.unionByName(older), _authority(artifacts))


@R.query("fragments", sql="""WITH s AS (SELECT work_key, fragment_index AS subscriber_id, CASE WHEN part % 5 = 0 THEN 'DETACHED' ELSE 'LIVE' END AS state FROM {fragments}), r AS (SELECT work_key, subscriber_id FROM s WHERE subscriber_id <= 3 UNION SELECT work_key, 99 FROM s WHERE work_key % 9 = 0),
l AS (SELECT work_key, count(*) AS n FROM s WHERE state = 'LIVE' AND subscriber_id > 3 GROUP BY 1)
SELECT work_key, subscriber_id, CASE WHEN state IS NULL THEN 'NOT_FOUND' WHEN state <> 'LIVE' THEN 'ALREADY_DETACHED' WHEN n IS NULL THEN 'LAST_INTEREST' ELSE 'DETACHED' END AS outcome FROM r LEFT JOIN s USING (work_key, subscriber_id) LEFT JOIN l USING (work_key)""")
def g19_detach(fragments):
    subscribers = fragments.select("work_key", F.col("fragment_index").alias("subscriber_id"), F.when(F.col("part") % 5 == 0, "DETACHED").otherwise("LIVE").alias("state"))
    requests = subscribers.where("subscriber_id <= 3").select("work_key", "subscriber_id").unionByName(subscribers.where("work_key % 9 = 0").select("work_key", F.lit(99).cast(subscribers.schema["subscriber_id"].dataType).alias("subscriber_id")))
    return op.detach(subscribers, requests, ["work_key"])[1]


@R.query("commits", sql="SELECT blob AS blob_digest, blob * 10 AS size FROM (SELECT DISTINCT blob FROM {commits}) WHERE blob % 4 <> 0 AND blob IN (SELECT blob FROM {commits} WHERE attempt > 1)")
def g23_valid_blobs(commits):
    blobs = commits.select(F.col("blob").alias("blob_digest")).distinct().select("blob_digest", (F.col("blob_digest") * 10).alias("size"), F.when(F.col("blob_digest") % 4 == 0, "INVALID").otherwise("VALID").alias("blob_state"))
    return op.valid_blobs(blobs, commits.where("attempt > 1").select(F.col("blob").alias("blob_digest"))).select("blob_digest", "size")
