"""Analytics of the reuse ledger: what was decided, what it saved and what it cost."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed values.
STAGES = ["env", "dataset", "features", "checkpoint", "eval"]
DEFAULT_SECONDS = {"env": 2.0, "dataset": 9.0, "features": 95.0, "checkpoint": 28.0, "eval": 4.0}
OTHER_SECONDS, DEFAULT_VCPU, DEFAULT_MIB = 30.0, 2.0, 4096.0
AUTHORITIES = ["probe", "structural", "identity"]
ACTIONS = ["REUSE", "RECOMPUTE", "SUBSCRIBE", "RESUME", "REFUSE_DOOMED", "REFUSE_DUPLICATE", "PUBLISH", "QUARANTINE"]
VERDICTS = ["reuse", "recompute", "subscribed", "resumed", "refused", "published", "quarantined"]
#: Prefixes of artifacts that validation runs leave behind.
TEST_PREFIXES = ("s3://test/",)


def is_product(uri: Column) -> Column:
    test = F.lit(False)
    for p in TEST_PREFIXES:
        test = test | uri.startswith(p)
    return ~test


def product_decisions(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """Decisions on real work keys that cite no artifact or an existing one of no validation run."""
    dec = decisions.where(F.col("work_key").rlike("^[0-9a-f]{64}$"))
    good = artifacts.where(is_product(F.col("s3_uri"))).select(F.col("artifact_id").alias("candidate_artifact_id"))
    cited = dec.where(F.col("candidate_artifact_id").isNotNull()).join(good, "candidate_artifact_id", "left_semi")
    return dec.where(F.col("candidate_artifact_id").isNull()).unionByName(cited)


def latest(df: DataFrame, by: list[str], *order: Column) -> DataFrame:
    """The first row of each group in the given order."""
    return df.withColumn("_k", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).where("_k = 1").drop("_k")


def pipeline_status(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """A row for each stage: its latest product decision with the artifact that it cites, or the newest artifact if there is no decision."""
    stages = decisions.sparkSession.createDataFrame([(k, s) for k, s in enumerate(STAGES)], "ordinal int, stage string")
    dec = latest(product_decisions(decisions, artifacts), ["stage"], F.desc("created_at"), F.desc("decision_id")).select("stage", "decision_id", "action", "candidate_artifact_id")
    real = artifacts.where(is_product(F.col("s3_uri")))
    newest = latest(real, ["stage"], F.desc("created_at"), F.desc("artifact_id")).select("stage", F.col("artifact_id").alias("newest"))
    own = real.select(F.col("artifact_id").alias("candidate_artifact_id"), F.col("artifact_id").alias("own"))
    out = stages.join(dec, "stage", "left").join(newest, "stage", "left").join(own, "candidate_artifact_id", "left")
    return out.select("ordinal", "stage", "decision_id", "action", F.when(F.col("decision_id").isNull(), F.col("newest")).otherwise(F.col("own")).alias("artifact_id"))


def list_decisions(decisions: DataFrame, limit: int, offset: int = 0) -> DataFrame:
    return decisions.orderBy(F.desc("created_at"), F.desc("decision_id")).offset(offset).limit(limit)


def decision_detail(decisions: DataFrame, probes: DataFrame, inputs: DataFrame) -> DataFrame:
    """Decisions with their probe and the number of inputs of the artifact that they cite."""
    n = inputs.groupBy(F.col("artifact_id").alias("candidate_artifact_id")).agg(F.count(F.lit(1)).alias("n_inputs"))
    return decisions.join(probes, "decision_id", "left").join(n, "candidate_artifact_id", "left")


def decisions_for_artifact(decisions: DataFrame, artifact_ids: list[str]) -> DataFrame:
    return decisions.where(F.col("candidate_artifact_id").isin(artifact_ids)).orderBy(F.desc("created_at"), F.desc("decision_id"))


def latest_refusal(decisions: DataFrame) -> DataFrame:
    return list_decisions(decisions.where("verdict = 'refused'"), 1)


def savings_counts(decisions: DataFrame) -> DataFrame:
    n = lambda c: F.count_if(F.expr(c))
    return decisions.agg(
        n("verdict = 'reuse'").alias("reused"),
        n("verdict = 'recompute'").alias("recomputed"),
        n("action in ('REFUSE_DUPLICATE', 'SUBSCRIBE')").alias("duplicates"),
        n("action = 'REFUSE_DOOMED'").alias("doomed"),
        n("action = 'RESUME'").alias("resumed"),
        F.count(F.lit(1)).alias("total"),
    )


def reused_artifacts(decisions: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(duration_ms, latency_ms, vcpu, mem_mib) of each reuse that cites a known artifact."""
    return decisions.where("verdict = 'reuse'").join(artifacts.select(F.col("artifact_id").alias("candidate_artifact_id"), "duration_ms", "vcpu", "mem_mib"), "candidate_artifact_id").select("duration_ms", "latency_ms", "vcpu", "mem_mib")


def savings_time(reused: DataFrame) -> DataFrame:
    avoided, probe = F.coalesce(F.sum("duration_ms"), F.lit(0)) / 1000.0, F.coalesce(F.sum("latency_ms"), F.lit(0)) / 1000.0
    return reused.agg(F.count(F.lit(1)).alias("artifacts"), F.round(avoided - probe, 3).alias("net_seconds"), F.round(probe, 3).alias("probe_seconds"))


def savings(reused: DataFrame, rates: DataFrame) -> DataFrame:
    """Net seconds and what they would have cost; without both rates no cost, but a reason."""
    hours = (F.col("duration_ms") - F.col("latency_ms")) / 1000.0 / 3600.0
    sums = reused.agg(F.coalesce(F.sum((F.col("duration_ms") - F.col("latency_ms")) / 1000.0), F.lit(0.0)).alias("net"), F.coalesce(F.sum(F.col("vcpu") * hours), F.lit(0.0)).alias("cpu_hours"), F.coalesce(F.sum(F.col("mem_mib") / 1024.0 * hours), F.lit(0.0)).alias("gib_hours"))
    rate = lambda k: F.max(F.when(F.col("resource_kind") == k, F.col("usd")))
    both = sums.join(rates.agg(rate("vcpu_hour").alias("r_cpu"), rate("gib_hour").alias("r_gib")))  # one row each
    cost = F.col("r_cpu") * F.col("cpu_hours") + F.col("r_gib") * F.col("gib_hours")
    both = both.withColumn("cost", cost).withColumn("per_s", F.when(F.col("cost").isNotNull(), F.coalesce(F.try_divide("cost", "net"), F.lit(0.0))))
    text = F.when(F.col("net") < 0, F.format_string("%.1fs slower x $%.7f/s = $%.4f additional", F.abs("net"), F.abs("per_s"), F.abs("cost"))).otherwise(F.format_string("%.1fs x $%.7f/s = $%.4f", "net", "per_s", "cost"))
    return both.select(F.round("net", 3).alias("net_seconds"), F.round("cost", 6).alias("cost_usd"), F.round("per_s", 10).alias("usd_per_second"), F.when(F.col("cost").isNotNull(), text).alias("formula"), F.when(F.col("cost").isNull(), "a rate is missing").alias("no_cost_reason"))


def estimate_cost(artifacts: DataFrame, rates: DataFrame) -> DataFrame:
    """(stage, seconds, cost_usd) that the next run of each stage is expected to take, from earlier runs or defaults."""
    spark = artifacts.sparkSession
    stages = spark.createDataFrame([(s, DEFAULT_SECONDS.get(s, OTHER_SECONDS)) for s in STAGES], "stage string, preset double")
    seen = artifacts.groupBy("stage").agg((F.avg("duration_ms") / 1000.0).alias("mean"))
    rate = lambda k: F.max(F.when(F.col("resource_kind") == k, F.col("usd")))
    one = rates.agg(rate("vcpu_hour").alias("r_cpu"), rate("gib_hour").alias("r_gib"))
    seconds = F.coalesce("mean", "preset")
    return stages.join(seen, "stage", "left").join(one).select("stage", F.round(seconds, 6).alias("seconds"), F.round(seconds / 3600.0 * (DEFAULT_VCPU * F.col("r_cpu") + DEFAULT_MIB / 1024.0 * F.col("r_gib")), 9).alias("cost_usd"))


def escalations(projected: DataFrame, approval: float) -> DataFrame:
    return projected.where(F.col("cost_usd") > approval)


def validate_decisions(decisions: DataFrame) -> DataFrame:
    """(decision_id, violations) of rows that break a rule; a comparison with null breaks it."""
    holds = lambda c: F.coalesce(c, F.lit(False))
    rules = [
        ("action", holds(F.col("action").isin(ACTIONS))),
        ("verdict", holds(F.col("verdict").isin(VERDICTS))),
        ("authority", (F.col("verdict") != "reuse") | holds(F.col("authorized_by").isin(AUTHORITIES))),
        ("latency", holds(F.col("latency_ms") >= 0)),
    ]
    broken = F.filter(F.array(*[F.when(~ok, F.lit(name)) for name, ok in rules]), lambda x: x.isNotNull())
    return decisions.select("decision_id", F.array_join(broken, ",").alias("violations")).where("violations <> ''")


def usage_tally(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("stage").agg(*[F.count_if(F.col("action") == a).alias(a.lower()) for a in ACTIONS[:6]], F.count(F.lit(1)).alias("total"))


def authority_label(proposed: Column, authorized: Column) -> Column:
    return F.coalesce(F.nullif(authorized, F.lit("")), F.concat(F.nullif(proposed, F.lit("")), F.lit(" (proposal only)")), F.lit("unattributed (not authorized)"))
