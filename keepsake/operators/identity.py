"""Fingerprints of configurations, code, environments, resources and work.

A set's digest is the digest of the exact sums of four parts of its members'
digests: order-free, computed by partial aggregation, and so without a list of all
members in one row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.functions.canon import digest_column, sum_digest
from keepsake.functions.scratch import cut


def set_digest(df: DataFrame, by: list[str], label: str, *members: Column) -> DataFrame:
    """(by, digest) of the distinct members (tuples of columns) of each group."""
    rows = df.select(*by, digest_column(f"{label}-member", *members).alias("_m")).distinct()
    return rows.groupBy(*by).agg(sum_digest(label, F.col("_m")).alias("digest"))


def config_fingerprint(reads: DataFrame) -> DataFrame:
    """(stage, digest) of the keys and values that a stage has read."""
    return set_digest(reads, ["stage"], "config", F.col("key"), F.col("value"))


def code_fingerprint(units: DataFrame) -> DataFrame:
    """(stage, digest) of the code units that a stage reaches."""
    return set_digest(units, ["stage"], "code", F.col("unit_id"), F.col("unit_digest"))


def env_fingerprint(environments: DataFrame, columns: list[str]) -> DataFrame:
    """environments with digest over the named columns; maps count by sorted entries."""
    text = lambda f: F.to_json(F.array_sort(F.map_entries(f.name))) if f.dataType.typeName() == "map" else F.col(f.name)
    return environments.withColumn("digest", digest_column("env", *[text(environments.schema[c]) for c in sorted(columns)]))


def work_keys(stages: DataFrame, upstream: DataFrame, keys: tuple[str, ...] = ("stage",)) -> DataFrame:
    """stages (stage, config, code, env) with work_key and provisional; upstream: stage, artifact_id (null: not known yet).

    Keys depend on the set of upstream artifacts; a stage with an unknown one is provisional.
    keys: the columns that tell stages apart.
    """
    keys = list(keys)
    known = upstream.select(*keys, F.coalesce("artifact_id", F.concat(F.lit("planned:"), F.col("planned_key"))).alias("up"), F.col("artifact_id").isNull().alias("open"))
    ups = set_digest(known, keys, "upstream", F.col("up")).withColumnRenamed("digest", "_up")
    is_open = known.groupBy(*keys).agg(F.bool_or("open").alias("_open"))
    rows = stages.join(ups, keys, "left").join(is_open, keys, "left")
    key = digest_column("work", F.col("stage"), F.col("config"), F.col("code"), F.col("env"), F.col("_up"))
    return rows.select(*stages.columns, F.when(F.trim("stage") != "", key).alias("work_key"), F.coalesce("_open", F.lit(False)).alias("provisional"))


def plan_keys(stages: DataFrame, edges: DataFrame, artifacts: DataFrame, most_levels: int = 1000) -> DataFrame:
    """stages (plan, stage, config, code, env) with work_key, provisional and level, for many plans at once, level by level.

    edges: plan, stage, parent. artifacts: plan, stage, artifact_id of stages that are done. A stage's key takes its parents'
    artifacts, and of parents without one planned:<their key>, which makes it provisional. A stage is planned in the round
    after the last of its parents, so there are as many rounds as the longest path has stages; a cycle, or a parent that is
    neither a stage nor done, raises.
    """
    keys = ["plan", "stage"]
    own = stages.select(*keys, "config", "code", "env")
    done = artifacts.select("plan", F.col("stage").alias("parent"), "artifact_id")
    ups = cut(edges.select(*keys, "parent").distinct().join(done, ["plan", "parent"], "left"))
    left = cut(own)
    planned = cut(own.limit(0).select("*", F.lit("").alias("work_key"), F.lit(False).alias("provisional"), F.lit(0).alias("level")))
    for level in range(most_levels):
        if left.isEmpty():
            return planned
        above = planned.select("plan", F.col("stage").alias("parent"), F.col("work_key").alias("planned_key"))
        known = ups.join(above, ["plan", "parent"], "left")
        ready = left.join(known.where("artifact_id is null and planned_key is null").select(*keys).distinct(), keys, "left_anti")
        made = cut(work_keys(ready, known.join(ready.select(*keys), keys, "left_semi"), tuple(keys)).withColumn("level", F.lit(level)))
        if made.isEmpty():
            raise ValueError("plans have a cycle, or a parent that is neither a stage nor done")
        planned = cut(planned.unionByName(made))
        left = cut(left.join(made.select(*keys), keys, "left_anti"))
    raise RuntimeError(f"plans are deeper than {most_levels} levels")


def resource_set_digest(resources: DataFrame, modes: list[str] | None = None) -> DataFrame:
    """(trace_id, digest) of the resources (kind, ref, mode, version) of each trace, or those of some modes."""
    rows = resources if modes is None else resources.where(F.col("mode").isin(modes))
    return set_digest(rows, ["trace_id"], "resources", F.col("kind"), F.col("ref"), F.col("mode"), F.col("version"))


def spec_digest(specs: DataFrame, columns: list[str]) -> DataFrame:
    return specs.withColumn("spec_digest", digest_column("spec", *[F.to_json(F.struct(F.col(c))) for c in sorted(columns)]))


#: What each identity of an execution's specification covers: columns, or fields of struct columns.
_PURITY = [f"purity.{x}" for x in ("contract_id", "network", "clock", "random", "env_names")]
_VERSIONS = ["tracer_version", "companion_version", "adapter_registry_version"]
IDENTITIES = {
    "spec": ["namespace_id", "argv", "cwd_rel", "output", "platform", "purity", "adapter", *_VERSIONS],
    "compatibility": ["argv", "cwd_rel", "output", "platform", *_PURITY, "adapter", *_VERSIONS],
    "coverage_profile": ["platform.os", "platform.arch", "image_pinned", *_PURITY, "adapter", *_VERSIONS],
    "platform": ["platform"],
    "output_contract": ["output"],
}


def spec_identities(specs: DataFrame, identities: dict[str, list[str]] = IDENTITIES) -> DataFrame:
    """specs with <name>_digest for each identity.

    Specs that agree on compatibility may share observations, whatever their namespace and number of qualification runs; a
    coverage profile asks whether an image is pinned, not which. A null adapter or image is a value of its own.
    """
    rows = specs.withColumn("image_pinned", F.col("platform.image_digest").isNotNull())
    covered = lambda c: F.to_json(F.struct(F.col(c).alias("v")))
    return rows.select(*specs.columns, *[digest_column(name, *[F.lit(x) for x in parts], *[covered(c) for c in parts]).alias(f"{name}_digest") for name, parts in identities.items()])


def semantic_key(spec: Column, inputs: Column, platform: Column) -> Column:
    """A key of what is computed: invariant to path, host, clock and revision, which are no part of it."""
    return digest_column("semantic", spec, inputs, platform)


def claim_key(namespace: Column, key: Column, generation: Column) -> Column:
    return F.when(generation >= 1, digest_column("claim", namespace, key, generation))


def artifact_inputs(plans: DataFrame, empty_data: str) -> DataFrame:
    """(artifact_id, kind, ref, digest) edges of plans (artifact_id, env, data, code: array of struct(ref, digest), config, upstream: array of string)."""
    one = lambda kind, c: plans.select("artifact_id", F.lit(kind).alias("kind"), F.lit(kind).alias("ref"), F.col(c).alias("digest"))
    code = plans.select("artifact_id", F.lit("code").alias("kind"), F.inline("code"))
    up = plans.select("artifact_id", F.lit("upstream").alias("kind"), F.explode("upstream").alias("ref")).withColumn("digest", F.sha2("ref", 256))
    return one("env", "env").unionByName(one("data", "data").where(F.col("digest") != empty_data)).unionByName(one("config", "config")).unionByName(code).unionByName(up)


def dataset_digest(slices: DataFrame) -> DataFrame:
    """One row: the digest of a dataset from its buckets' digests (bucket, slice_digest), in two levels."""
    return set_digest(slices.withColumn("_all", F.lit(0)), ["_all"], "dataset", F.col("bucket"), F.col("slice_digest")).select("digest")
