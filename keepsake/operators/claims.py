"""Analysis of leases, fences, fragments and commits, as snapshots in and snapshots out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.tasks import dealt

OPEN_STATES = ["CLAIMED", "RUNNING"]


def fragment_progress(fragments: DataFrame) -> DataFrame:
    return fragments.groupBy("work_key").agg(F.count(F.lit(1)).alias("n_fragments"), F.max("fragment_index").alias("last_fragment"), F.coalesce(F.sum("duration_ms"), F.lit(0)).alias("duration_ms"))


def claims_board(claims: DataFrame, fragments: DataFrame, transfers: DataFrame, as_of: Column, n: int, validation_stage: str = "race_test") -> DataFrame:
    """The n newest claims with seconds left of the lease (negative: may be taken over), fragments and transfers."""
    newest = claims.where(F.col("stage") != validation_stage).orderBy(F.desc("claimed_at"), F.desc("work_key")).limit(n)
    moves = transfers.groupBy("work_key").agg(F.array_join(F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("to_fence", "reason")))), lambda x: x["reason"]), ",").alias("transfers"))
    left = F.unix_seconds(F.col("lease_expires_at").cast("timestamp")) - F.unix_seconds(as_of.cast("timestamp"))
    return newest.join(fragment_progress(fragments), "work_key", "left").join(moves, "work_key", "left").select("work_key", "state", "owner_id", "fence", left.alias("seconds_left"), F.coalesce("n_fragments", F.lit(0)).alias("n_fragments"), "last_fragment", F.coalesce("transfers", F.lit("")).alias("transfers"))


def reap(claims: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, reaped rows): open claims whose lease ended before as_of become ABANDONED."""
    dead = F.coalesce(F.col("state").isin(OPEN_STATES) & (F.col("lease_expires_at") < as_of), F.lit(False))
    return claims.withColumn("state", F.when(dead, "ABANDONED").otherwise(F.col("state"))), claims.where(dead)


def claim_roles(requests: DataFrame, claims: DataFrame, as_of: Column) -> DataFrame:
    """requests with the role that a requester gets: owner, reuse, takeover (with its reason) or subscriber."""
    state, lease = F.col("state"), F.col("lease_expires_at")
    role = F.when(state.isNull(), "owner").when(state == "SUCCEEDED", "reuse").when(state.isin("FAILED", "ABANDONED"), "takeover:prior_terminal").when(lease < as_of, "takeover:lease_expired").otherwise("subscriber")
    return requests.join(claims.select("work_key", "state", "lease_expires_at"), "work_key", "left").withColumn("role", role).drop("state", "lease_expires_at")


def fence_gate(rows: DataFrame, claims: DataFrame) -> DataFrame:
    """rows (work_key, owner_id, fence, ...) with reason: accepted, or why the claim does not let them write."""
    live = claims.select("work_key", F.col("state").alias("_state"), F.col("owner_id").alias("_owner"), F.col("fence").alias("_fence"))
    reason = F.when(F.col("_state").isNull(), "no_claim").when(~F.col("_state").isin(OPEN_STATES), "not_open").when(~F.col("owner_id").eqNullSafe(F.col("_owner")), "other_owner").when(~F.col("fence").eqNullSafe(F.col("_fence")), "stale_fence").otherwise("accepted")
    return rows.join(live, "work_key", "left").withColumn("reason", reason).drop("_state", "_owner", "_fence")


def classify_commits(attempts: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """attempts (accepted by the fence, with input and blob) with outcome, in order within each key.

    The first of a key commits; later ones are ALREADY_PRESENT where they agree
    with it on input and blob, else NONDETERMINISTIC. Rows whose reason is not
    accepted are REJECTED_FENCE, before anything else.
    """
    ok = F.col("reason") == "accepted"
    w = Window.partitionBy(*keys).orderBy(F.when(ok, 0).otherwise(1), *order)
    first, k = F.first(F.struct("input", "blob")).over(w), F.row_number().over(w)
    outcome = F.when(~ok, "REJECTED_FENCE").when(k == 1, "COMMITTED").when(first.eqNullSafe(F.struct("input", "blob")), "ALREADY_PRESENT").otherwise("NONDETERMINISTIC")
    return attempts.withColumn("outcome", outcome)


def pending_fragments(expected: DataFrame, fragments: DataFrame) -> DataFrame:
    return expected.join(fragments.select("work_key", "fragment_index"), ["work_key", "fragment_index"], "left_anti")


def clear_fragments(fragments: DataFrame, claims: DataFrame) -> DataFrame:
    """Fragments of keys that have not succeeded."""
    return fragments.join(claims.where("state = 'SUCCEEDED'").select("work_key"), "work_key", "left_anti")


def audit_races(log: DataFrame, rows: int | None = None) -> DataFrame:
    """(work_key, winners, fences_rise) of keys without exactly one winner or with a fence that does not rise; log: work_key, attempt, fence, won, of so many rows, if known."""
    w = Window.partitionBy("work_key").orderBy("attempt")
    rises = dealt(log, "work_key", rows=rows).withColumn("_up", F.coalesce(F.col("fence") > F.lag("fence").over(w), F.lit(True)))
    per = rises.groupBy("work_key").agg(F.count_if("won").alias("winners"), F.bool_and("_up").alias("fences_rise"))
    return per.where((F.col("winners") != 1) | ~F.col("fences_rise"))


def chunk_timing(fragments: DataFrame, seconds: Column) -> DataFrame:
    """Per key: chunks, seconds from the first to the last, and whether a takeover could resume inside the leaf."""
    per = fragments.groupBy("work_key").agg(F.count(F.lit(1)).alias("n_chunks"), (F.max(seconds) - F.min(seconds)).alias("window_s"))
    return per.withColumn("mode", F.when((F.col("n_chunks") > 1) & (F.col("window_s") > 0), "sub_leaf_resume_candidate").otherwise("whole_stage_takeover"))


def live_subscribers(subscribers: DataFrame, as_of: Column) -> DataFrame:
    return subscribers.where((F.col("state") == "LIVE") & (F.col("lease_expires_at") > as_of))


def register_interest(current: DataFrame, requests: DataFrame, keys: list[str]) -> DataFrame:
    """current with each new request once."""
    return current.unionByName(requests.dropDuplicates(keys).join(current.select(*keys), keys, "left_anti"))


# --- derivations: publication, current state, eligibility


def _join_named(rows: DataFrame, others: DataFrame, key: str) -> DataFrame:
    """A left join by key, in which rows that name none are dealt out by work_key instead of all meeting in the task of null."""
    dealt = rows.withColumn("_spread", F.when(F.col(key).isNull(), F.xxhash64("work_key")).otherwise(0))
    # always 0, as a value of the row: a constant would be taken out of the key of the shuffle
    return dealt.join(others.withColumn("_spread", F.pmod(F.xxhash64(key), F.lit(1))), [key, "_spread"], "left").drop("_spread")


def classify_publications(requests: DataFrame, generations: DataFrame, observations: DataFrame, rules: DataFrame, children: DataFrame) -> DataFrame:
    """requests with outcome PUBLISHED, ALREADY_PRESENT, REJECTED_FENCE or STALE_AUTHORITY; tests apply in this order.

    requests: request_id, work_key, operation_id, owner_id, fence, observation_id, rule_id, rule_revision.
    generations: work_key, gen_state, current_operation, gen_owner, gen_fence. observations: observation_id,
    observed_key, lifecycle. rules: rule_id, live_revision, rule_state. children: request_id, child_state, quarantined.
    """
    bad = children.groupBy("request_id").agg(F.bool_and(F.coalesce((F.col("child_state") == "PUBLISHED") & ~F.col("quarantined"), F.lit(False))).alias("_children"))
    rows = requests.join(generations, "work_key", "left")
    rows = _join_named(_join_named(rows, observations, "observation_id"), rules, "rule_id").join(bad, "request_id", "left")
    fence = (F.col("owner_id").eqNullSafe(F.col("gen_owner"))) & F.col("fence").eqNullSafe(F.col("gen_fence"))
    seen = F.col("observation_id").isNull() | F.coalesce((F.col("observed_key") == F.col("work_key")) & ~F.col("lifecycle").isin("INVALIDATED", "SUPERSEDED", "INCOMPLETE"), F.lit(False))
    ruled = F.col("rule_id").isNull() | F.coalesce((F.col("live_revision") == F.col("rule_revision")) & F.col("rule_state").isin("ACTIVE", "TIGHTENED"), F.lit(False))
    outcome = (
        F.when(F.col("gen_state").isNull(), "REJECTED_FENCE")
        .when(F.col("operation_id").eqNullSafe(F.col("current_operation")), "ALREADY_PRESENT")
        .when((F.col("gen_state") == "INVALIDATED") | ~fence, "REJECTED_FENCE")
        .when(~seen | ~ruled | ~F.coalesce("_children", F.lit(True)), "STALE_AUTHORITY")
        .otherwise("PUBLISHED")
    )
    return rows.select(*requests.columns, outcome.alias("outcome"))


def current_derivations(derivations: DataFrame, generations: DataFrame, blobs: DataFrame, observations: DataFrame, rules: DataFrame) -> DataFrame:
    """Derivations that may be restored now: published, not quarantined, of a valid blob, and with live authority where they name any."""
    live = derivations.join(generations.where("is_head and gen_state = 'PUBLISHED'").select("work_key", "generation"), ["work_key", "generation"]).where("not quarantined")
    live = live.join(blobs.where("blob_state = 'VALID'").select("blob_digest"), "blob_digest", "left_semi")
    live = _join_named(live, observations.select("observation_id", "lifecycle"), "observation_id").where("observation_id is null or lifecycle = 'VALIDATED'")
    live = _join_named(live, rules.select("rule_id", "live_revision", "rule_state"), "rule_id").where("rule_id is null or (live_revision = rule_revision and rule_state in ('ACTIVE', 'TIGHTENED'))")
    return live.select(*derivations.columns)


def reuse_eligibility(requests: DataFrame) -> DataFrame:
    """requests with decision; columns: priors, resolvable (numbers of earlier runs), has_adapter, has_candidate, shadow,
    has_current, rule_state, rule_authority, rule_needs_probe, revision_differs, tightened, coalescing (booleans)."""
    c = F.col
    current = c("has_current")
    decision = (
        F.when((c("priors") > 0) & (c("resolvable") == 0), "REFUSE_REUSE")
        .when((c("priors") == 0) & ~c("has_adapter") & ~c("has_candidate"), "RUN_SHADOW_LEARN")
        .when(c("shadow"), "RUN_SHADOW_LEARN")
        .when(~current & c("has_candidate"), "RUN_ISOLATED_QUALIFICATION")
        .when(current & (c("rule_state").isNull() | (c("rule_state") == "DISABLED") | (c("rule_authority") == "recompute")), "REFUSE_REUSE")
        .when(current & c("rule_needs_probe") & c("revision_differs"), "REFUSE_REUSE")
        .when(current, "RESTORE")
        .when(c("tightened") & ~c("coalescing"), "REFUSE_REUSE")
        .when((c("priors") == 0) & ~c("coalescing"), "RUN_SHADOW_LEARN")
        .otherwise("RUN")
    )
    return requests.withColumn("decision", decision)


def select_observations(observations: DataFrame, state: str, n: int = 8) -> DataFrame:
    """The n newest observations in a state for each compatibility key."""
    w = Window.partitionBy("compatibility_key").orderBy(F.desc("created_at"), F.desc("observation_id"))
    return observations.where(F.col("lifecycle") == state).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n).drop("_k")


def promote(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """CANDIDATE becomes VALIDATED for ids."""
    hit = observations.join(ids.select("observation_id").distinct().withColumn("_hit", F.lit(True)), "observation_id", "left")
    return hit.withColumn("lifecycle", F.when(F.col("_hit") & (F.col("lifecycle") == "CANDIDATE"), "VALIDATED").otherwise(F.col("lifecycle"))).drop("_hit")


def supersede(observations: DataFrame, ids: DataFrame) -> DataFrame:
    """CANDIDATE and VALIDATED become SUPERSEDED for ids; other states stay."""
    hit = observations.join(ids.select("observation_id").distinct().withColumn("_hit", F.lit(True)), "observation_id", "left")
    return hit.withColumn("lifecycle", F.when(F.col("_hit") & F.col("lifecycle").isin("CANDIDATE", "VALIDATED"), "SUPERSEDED").otherwise(F.col("lifecycle"))).drop("_hit")


def candidate_observation(observations: DataFrame) -> DataFrame:
    """The newest candidate of each semantic key, by a partial aggregate."""
    newest = F.max_by(F.struct(*observations.columns), F.struct("created_at", "observation_id")).alias("_o")
    return observations.where("lifecycle = 'CANDIDATE'").groupBy("semantic_key").agg(newest).select("_o.*")


def detach(subscribers: DataFrame, requests: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(next subscribers, requests with outcome): each request (keys, subscriber_id) gives up its interest.

    NOT_FOUND without such a subscriber, ALREADY_DETACHED where it is not live, LAST_INTEREST where no live one
    of its keys remains once all requests have been served, else DETACHED. A request counts once.
    """
    who = [*keys, "subscriber_id"]
    asked = requests.select(*who).distinct()
    marked = subscribers.join(asked.withColumn("_asked", F.lit(True)), who, "left")
    leaves = F.coalesce(F.col("_asked"), F.lit(False)) & (F.col("state") == "LIVE")
    after = marked.withColumn("state", F.when(leaves, "DETACHED").otherwise(F.col("state"))).drop("_asked")
    left = after.where("state = 'LIVE'").groupBy(*keys).agg(F.count(F.lit(1)).alias("_left"))
    found = asked.join(subscribers.select(*who, "state"), who, "left").join(left, keys, "left")
    outcome = F.when(F.col("state").isNull(), "NOT_FOUND").when(F.col("state") != "LIVE", "ALREADY_DETACHED").when(F.col("_left").isNull(), "LAST_INTEREST").otherwise("DETACHED")
    return after.select(*subscribers.columns), found.select(*who, outcome.alias("outcome"))


def valid_blobs(blobs: DataFrame, digests: DataFrame) -> DataFrame:
    """The blobs that digests (blob_digest) name and that are VALID."""
    return blobs.where("blob_state = 'VALID'").join(digests.select("blob_digest").distinct(), "blob_digest", "left_semi")


def rule_authority(heads: DataFrame, revisions: DataFrame) -> DataFrame:
    """(rule_id, revision, rule_state, required_authority) of the live revision of each rule; heads: rule_id, current_revision."""
    live = (heads["rule_id"] == revisions["rule_id"]) & (heads["current_revision"] == revisions["revision"])
    return heads.join(revisions, live).select(heads["rule_id"], "revision", "rule_state", "required_authority")


def refusal_reason(keys: DataFrame, derivations: DataFrame, authority: DataFrame) -> DataFrame:
    """keys (work_key) with reason: why the newest derivation of each may not be reused, null where nothing speaks against it.

    derivations: derivation_id, work_key, rule_id, rule_revision, state, quarantined, created_at. authority: of rule_authority().
    """
    newest = derivations.groupBy("work_key").agg(F.max_by(F.struct("rule_id", "rule_revision", "state", "quarantined"), F.struct("created_at", "derivation_id")).alias("d")).select("work_key", "d.*")
    rows = keys.join(newest, "work_key", "left").join(authority.withColumnRenamed("revision", "_live"), "rule_id", "left")
    rule, needs = F.col("rule_id").cast("string"), F.col("required_authority")
    reason = (
        F.when(~(F.coalesce("quarantined", F.lit(False)) | F.coalesce(F.col("state") == "QUARANTINED", F.lit(False))), None)
        .when(F.col("rule_id").isNull(), "quarantined, by no rule")
        .when(F.col("_live") != F.col("rule_revision"), F.concat(F.lit("rule "), rule, F.lit(" was tightened to revision "), F.col("_live").cast("string"), F.lit(" and requires "), needs))
        .when(F.col("rule_state").isin("DISABLED", "TIGHTENED") & needs.isin("probe", "recompute"), F.concat(F.lit("rule "), rule, F.lit(" requires "), needs))
        .otherwise("quarantined, after a contradiction")
    )
    return rows.select(*keys.columns, reason.alias("reason"))


def apply_publications(published: DataFrame, generations: DataFrame, claims: DataFrame, subscribers: DataFrame, leaves: DataFrame, observations: DataFrame) -> dict[str, DataFrame]:
    """The next snapshots, and the new rows, after requests whose outcome was PUBLISHED (classify_publications()).

    published: request_id, work_key, generation, derivation_id, operation_id, owner_id, fence, observation_id, authority.
    The generation becomes PUBLISHED with the derivation, the claim SUCCEEDED, live subscribers COMPLETED; edges lead from the
    derivation to its leaves (request_id, ordinal, child_id); a decision says reuse, and by what authority, only
    where the observation is VALIDATED.
    """
    key = ["work_key", "generation"]
    done = published.select(*key, F.col("derivation_id").alias("_derivation"), F.col("operation_id").alias("_operation"))
    hit = F.col("_derivation").isNotNull()
    marked = generations.join(done, key, "left")
    owned = claims.join(published.select("work_key", "owner_id", "fence", F.col("derivation_id").alias("_derivation")), ["work_key", "owner_id", "fence"], "left")
    closes = hit & F.col("state").isin(OPEN_STATES)
    waiting = subscribers.join(done, key, "left")
    decided = published.join(observations.select("observation_id", "lifecycle"), "observation_id", "left")
    reuse = F.coalesce(F.col("lifecycle") == "VALIDATED", F.lit(False))
    return {
        "generations": marked.withColumn("gen_state", F.when(hit, "PUBLISHED").otherwise(F.col("gen_state"))).withColumn("derivation_id", F.coalesce("_derivation", "derivation_id")).withColumn("current_operation", F.coalesce("_operation", "current_operation")).select(*generations.columns),
        "claims": owned.withColumn("state", F.when(closes, "SUCCEEDED").otherwise(F.col("state"))).select(*claims.columns),
        "subscribers": waiting.withColumn("state", F.when(hit & (F.col("state") == "LIVE"), "COMPLETED").otherwise(F.col("state"))).select(*subscribers.columns),
        "edges": published.join(leaves, "request_id").select(F.col("derivation_id").alias("parent_id"), "ordinal", "child_id"),
        "decisions": decided.select("request_id", "work_key", "derivation_id", F.when(reuse, "REUSE").otherwise("RECOMPUTE").alias("action"), F.when(reuse, "reuse").otherwise("recompute").alias("verdict"), F.when(reuse, F.col("authority")).alias("authorized_by")),
    }
