"""Derivation snapshots: execution listings, leaf maps, receipts, invalidation and rule tightening."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def executions(decisions: DataFrame, observations: DataFrame, traces: DataFrame, derivations: DataFrame, blobs: DataFrame, claims: DataFrame, runs: DataFrame, newest: int) -> DataFrame:
    """The newest decisions with what they observed, derived, stored and ran; rows without any of these stay.

    Keys: decisions observation_id, derivation_id; observations trace_digest; derivations blob_digest, work_key; claims work_key, run_id.
    """
    rows = decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).limit(newest)
    rows = rows.join(observations.select("observation_id", "trace_digest", "lifecycle"), "observation_id", "left").join(traces.select("trace_digest", "coverage"), "trace_digest", "left")
    rows = rows.join(derivations.select("derivation_id", "blob_digest", "work_key"), "derivation_id", "left").join(blobs.select("blob_digest", "blob_state"), "blob_digest", "left")
    return rows.join(claims.select("work_key", "state", "run_id"), "work_key", "left").join(runs.select("run_id", "task"), "run_id", "left")


def leaf_map(roots: DataFrame, leaves: DataFrame, derivations: DataFrame, claims: DataFrame) -> DataFrame:
    """(ordinal, derivation_id, blob_digest, state, run_id, action, authorized_by) of the newest published root of each key.

    A leaf that the root's own run made is COMPUTED; one of another run is RESTORE, authorised by identity.
    roots: root_id, work_key, root_run, created_at. leaves: root_id, ordinal, derivation_id.
    """
    w = Window.partitionBy("work_key").orderBy(F.desc("created_at"), F.desc("root_id"))
    newest = roots.withColumn("_k", F.row_number().over(w)).where("_k = 1").select("root_id", F.col("work_key").alias("root_key"), "root_run")
    rows = newest.join(leaves, "root_id").join(derivations.select("derivation_id", "work_key", "blob_digest"), "derivation_id").join(claims.select("work_key", "state", "run_id", "fence"), "work_key", "left")
    restored = ~F.col("run_id").eqNullSafe(F.col("root_run"))
    return rows.select("root_key", "ordinal", "derivation_id", "blob_digest", "state", "run_id", "fence", F.when(restored, "RESTORE").otherwise("COMPUTED").alias("action"), F.when(restored, "identity").alias("authorized_by"))


def with_subscribers(leaf_rows: DataFrame, subscribers: DataFrame) -> DataFrame:
    """leaf_rows with the number of subscribers of their derivation."""
    n = subscribers.groupBy("derivation_id").agg(F.count(F.lit(1)).alias("subscribers"))
    return leaf_rows.join(n, "derivation_id", "left").withColumn("subscribers", F.coalesce("subscribers", F.lit(0)))


def leaf_path(roots: DataFrame, leaves: DataFrame, derivations: DataFrame, claims: DataFrame, subscribers: DataFrame) -> DataFrame:
    """(root_id, ordinal, child_id, slice_digest, blob_digest, state, action, authorized_by, owner_id, fence, subscribers) of all leaves of each root.

    A leaf that the root's run produced is COMPUTED; another is RESTORE, authorised by identity. roots: root_id, root_run.
    leaves: root_id, ordinal, child_id, slice_digest. derivations: derivation_id, work_key, generation, blob_digest, state,
    run_id. claims: work_key, owner_id, fence. subscribers: work_key, generation.
    """
    waiting = subscribers.groupBy("work_key", "generation").agg(F.count(F.lit(1)).alias("subscribers"))
    child = derivations.withColumnRenamed("derivation_id", "child_id")
    rows = roots.join(leaves, "root_id").join(child, "child_id").join(claims.select("work_key", "owner_id", "fence"), "work_key", "left").join(waiting, ["work_key", "generation"], "left")
    restored = ~F.col("run_id").eqNullSafe(F.col("root_run"))
    return rows.select("root_id", "ordinal", "child_id", "slice_digest", "blob_digest", "state", F.when(restored, "RESTORE").otherwise("COMPUTED").alias("action"), F.when(restored, "identity").alias("authorized_by"), "owner_id", "fence", F.coalesce("subscribers", F.lit(0)).alias("subscribers"))


def receipts(roots: DataFrame, leaves: DataFrame, derivations: DataFrame, blobs: DataFrame) -> DataFrame:
    """(root_id, n_leaves, n_unavailable, receipt): canonical JSON of each root, its leaves in order, and where their blobs are.

    A leaf whose derivation or blob is not known is listed without what is not known, and counted as unavailable. roots: root_id. leaves: root_id, ordinal, child_id, slice_digest. derivations: derivation_id,
    work_key, blob_digest. blobs: blob_digest, location, size. A root's leaves are as many as it has buckets.
    """
    stored = derivations.join(blobs.select("blob_digest", "location", "size"), "blob_digest", "left")
    leaf = leaves.join(stored.withColumnRenamed("derivation_id", "child_id"), "child_id", "left")
    # JSON objects keep the order of a struct's fields, so these are sorted by name
    listed = leaf.groupBy("root_id").agg(F.array_sort(F.collect_list(F.struct("ordinal", "blob_digest", "child_id", "location", "size", "slice_digest"))).alias("_leaves"), F.count(F.lit(1)).alias("_n"), F.count_if(F.col("location").isNull()).alias("_lost"))
    whole = roots.select("root_id").join(stored.withColumnRenamed("derivation_id", "root_id"), "root_id").join(listed, "root_id", "left")
    parts = F.transform(F.coalesce("_leaves", F.array().cast(listed.schema["_leaves"].dataType)), lambda x: F.struct(x["blob_digest"].alias("blob_digest"), x["child_id"].alias("child_id"), x["location"].alias("location"), x["ordinal"].alias("ordinal"), x["size"].alias("size"), x["slice_digest"].alias("slice_digest")))
    body = F.to_json(F.struct("blob_digest", parts.alias("leaves"), "location", "root_id", "size", "work_key"))
    return whole.select("root_id", F.coalesce("_n", F.lit(0)).alias("n_leaves"), F.coalesce("_lost", F.lit(0)).alias("n_unavailable"), body.alias("receipt"))


def replay_scenarios(decisions: DataFrame, transfers: DataFrame, fragments: DataFrame, failures: DataFrame, remediations: DataFrame, n_reuse: int = 5, n_verdicts: int = 10, n_transfers: int = 6, n_fragments: int = 2) -> DataFrame:
    """(scenario, place, ref, note) of what can be shown again; a scenario without material is one row that says why.

    1 reuse: the newest reuse decisions. 2 verdicts: the newest decisions, if both reuse and recompute are among all.
    3 takeover: the newest transfers and the keys with most fragments. 4 failures, each with its best remediation.
    """
    newest = lambda df, order, k: df.orderBy(*order).limit(k)
    placed = lambda df, scenario, ref, note, *order: df.select(F.lit(scenario).alias("scenario"), F.row_number().over(Window.orderBy(*order)).cast("int").alias("place"), ref.cast("string").alias("ref"), note.cast("string").alias("note"))  # noqa: E731  of a few rows
    latest = [F.desc("created_at"), F.desc("decision_id")]
    reuse = placed(newest(decisions.where("verdict = 'reuse'"), latest, n_reuse), "reuse", F.col("decision_id"), F.col("stage"), *latest)
    both = decisions.agg(F.count_if(F.col("verdict") == "reuse").alias("_a"), F.count_if(F.col("verdict") == "recompute").alias("_b")).where("_a > 0 and _b > 0")
    some = newest(decisions.where("verdict in ('reuse', 'recompute')"), latest, n_verdicts).join(both)  # one row, or none
    verdicts = placed(some, "verdicts", F.col("decision_id"), F.col("verdict"), *latest)
    moved = [F.desc("to_fence"), F.desc("work_key")]
    takeover = placed(newest(transfers, moved, n_transfers), "takeover", F.col("work_key"), F.col("reason"), *moved)
    counted = [F.desc("n"), F.desc("work_key")]
    rollup = placed(newest(fragments.groupBy("work_key").agg(F.count(F.lit(1)).alias("n")), counted, n_fragments), "fragments", F.col("work_key"), F.col("n"), *counted)
    best = remediations.groupBy("signature_id").agg(F.max_by("remediation_id", F.struct("succeeded", "created_at", "remediation_id")).alias("_r"))
    first = [F.desc("created_at"), F.desc("signature_id")]
    failed = placed(newest(failures.join(best, "signature_id", "left"), first, n_reuse), "failures", F.col("signature_id"), F.coalesce(F.col("_r").cast("string"), F.lit("none")), *first)
    found = reuse.unionByName(verdicts).unionByName(takeover).unionByName(rollup).unionByName(failed)
    names = decisions.sparkSession.createDataFrame([("reuse", "no reuse decision"), ("verdicts", "not both verdicts"), ("takeover", "no transfer"), ("fragments", "no fragment"), ("failures", "no failure")], "scenario string, note string")
    missing = names.join(found.select("scenario").distinct(), "scenario", "left_anti").select("scenario", F.lit(0).alias("place"), F.lit(None).cast("string").alias("ref"), "note")
    return found.unionByName(missing)


def verify_receipts(receipts: DataFrame, verified: DataFrame) -> DataFrame:
    """(receipt_id, ok, mismatch, unavailable): counts over the blobs that each receipt names; verified: digest, status."""
    rows = receipts.join(verified, "digest", "left").withColumn("status", F.coalesce("status", F.lit("unavailable")))
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return rows.groupBy("receipt_id").agg(n("ok"), n("mismatch"), n("unavailable"))


def invalidate_generations(bad: DataFrame, generations: DataFrame, derivations: DataFrame, blobs: DataFrame, claims: DataFrame) -> dict[str, DataFrame]:
    """The next snapshots after the generations in bad (work_key, generation) are found wrong.

    Their blobs become INVALID, derivations quarantined, generations INVALIDATED and
    no longer heads; each key gets a PENDING head generation one higher and its
    claim a fence one higher.
    """
    hit = bad.select("work_key", "generation").distinct().withColumn("_bad", F.lit(True))
    marked = generations.join(hit, ["work_key", "generation"], "left")
    wrong = F.coalesce("_bad", F.lit(False))
    renewed = marked.where("_bad and is_head").select("work_key", (F.col("generation") + 1).alias("generation"), F.lit("PENDING").alias("gen_state"), F.lit(True).alias("is_head"))
    old = marked.select("work_key", "generation", F.when(wrong, "INVALIDATED").otherwise(F.col("gen_state")).alias("gen_state"), (F.col("is_head") & ~wrong).alias("is_head"))
    dead = derivations.join(hit, ["work_key", "generation"], "left")
    spoiled = dead.where("_bad").select("blob_digest").distinct().withColumn("_spoiled", F.lit(True))
    keys = renewed.select("work_key").withColumn("_new", F.lit(1))
    return {
        "generations": old.unionByName(renewed),
        "derivations": dead.withColumn("quarantined", F.col("quarantined") | wrong).select(*derivations.columns),
        "blobs": blobs.join(spoiled, "blob_digest", "left").withColumn("blob_state", F.when(F.col("_spoiled"), "INVALID").otherwise(F.col("blob_state"))).select(*blobs.columns),
        "claims": claims.join(keys, "work_key", "left").withColumn("fence", F.col("fence") + F.coalesce("_new", F.lit(0))).withColumn("state", F.when(F.col("_new") == 1, "PENDING").otherwise(F.col("state"))).select(*claims.columns),
    }


def ensure_rules(current: DataFrame, wanted: DataFrame) -> DataFrame:
    """current with each missing rule at revision 1, ACTIVE."""
    new = wanted.select("rule_id").distinct().join(current.select("rule_id"), "rule_id", "left_anti")
    return current.unionByName(new.select("rule_id", F.lit(1).alias("revision"), F.lit("ACTIVE").alias("rule_state"), F.lit(True).alias("is_head")))


def tighten_rules(rules: DataFrame, contradictions: DataFrame, authority: Column) -> DataFrame:
    """rules after contradictions (rule_id, revision, evidence): the head is superseded by a TIGHTENED one, or a DISABLED one where authority is recompute.

    Contradictions without evidence, or of a revision that is not the head, change nothing.
    """
    good = contradictions.where(F.trim(F.coalesce("evidence", F.lit(""))) != "").select("rule_id", "revision", authority.alias("_authority")).dropDuplicates(["rule_id", "revision"])
    hit = rules.join(good.withColumn("_hit", F.lit(True)), ["rule_id", "revision"], "left")
    change = F.coalesce(F.col("_hit") & F.col("is_head"), F.lit(False))
    old = hit.select("rule_id", "revision", F.when(change, "SUPERSEDED").otherwise(F.col("rule_state")).alias("rule_state"), (F.col("is_head") & ~change).alias("is_head"))
    new = hit.where(change).select("rule_id", (F.col("revision") + 1).alias("revision"), F.when(F.col("_authority") == "recompute", "DISABLED").otherwise("TIGHTENED").alias("rule_state"), F.lit(True).alias("is_head"))
    return old.unionByName(new)


def failure_signatures(failures: DataFrame, reads: DataFrame, allowed: list[str], encoder: Callable[[Column], Column] | None = None) -> DataFrame:
    """(run_id, error_class, last_line, summary, features[, embedding]): what a failure's traceback and recorded configuration say.

    failures: run_id, stage, traceback. reads: run_id, key, value; of a key read with several values the largest counts. The last line is cut at 500 characters. encoder turns
    the summary into a vector.
    """
    last = F.trim(F.try_element_at(F.filter(F.split("traceback", "\n"), lambda x: F.trim(x) != ""), F.lit(-1)))
    once = reads.where(F.col("key").isin(allowed)).groupBy("run_id", "key").agg(F.max("value").alias("value"))
    features = once.groupBy("run_id").agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("key", "value")))).alias("features"))
    rows = failures.select("run_id", "stage", last.alias("_last")).join(features, "run_id", "left")
    known = F.array_join(F.transform(F.array_sort(F.map_keys(F.coalesce("features", F.create_map().cast("map<string,string>")))), lambda k: F.concat(k, F.lit("="), F.element_at("features", k))), ", ")
    line, kind = F.substring(F.coalesce("_last", F.lit("")), 1, 500), F.regexp_extract("_last", r"^([\w.]+)", 1)
    summary = F.concat_ws(" | ", "stage", F.coalesce(kind, F.lit("")), line, known)
    out = rows.select("run_id", kind.alias("error_class"), F.substring("_last", 1, 500).alias("last_line"), summary.alias("summary"), "features")
    return out if encoder is None else out.withColumn("embedding", encoder(F.col("summary")))
