"""Lineage: reachability, quarantine and snapshots of provenance edges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.functions.scratch import cut

KINDS = ["code", "config", "data", "upstream", "env"]


#: Steps along edges that one round takes.
HOPS = 4


def reachable(edges: DataFrame, roots: DataFrame, most_rounds: int = 1000) -> DataFrame:
    """(node, depth) of nodes that roots (node) reach along edges (src, dst), by a frontier that shrinks to nothing.

    Each round follows HOPS edges before it looks up what is known already, so a deep graph takes a
    quarter of the rounds.
    """
    edges = cut(edges.select("src", "dst").distinct())
    seen = cut(roots.select("node").distinct().withColumn("depth", F.lit(0)))
    frontier = seen
    for start in range(0, most_rounds * HOPS, HOPS):
        steps, at = None, frontier.where(F.col("depth") == start).select("node")
        for hop in range(1, HOPS + 1):
            at = edges.join(at.select(F.col("node").alias("src")), "src", "left_semi").select(F.col("dst").alias("node")).distinct()
            here = at.withColumn("depth", F.lit(start + hop))
            steps = here if steps is None else steps.unionByName(here)
        new = steps.groupBy("node").agg(F.min("depth").alias("depth")).join(seen.select("node"), "node", "left_anti")
        frontier = cut(new)
        if frontier.isEmpty():
            return seen
        seen = cut(seen.unionByName(frontier)) if start % (10 * HOPS) == 0 else seen.unionByName(frontier)
        if frontier.where(F.col("depth") == start + HOPS).isEmpty():
            return seen
    raise RuntimeError(f"not closed after {most_rounds} rounds")


def is_sound(reached: DataFrame, escapes: DataFrame) -> DataFrame:
    """One row: nodes reached, and whether none of them has an escape."""
    hit = reached.join(escapes.select("node").distinct().withColumn("_e", F.lit(1)), "node", "left")
    return hit.agg(F.count(F.lit(1)).alias("nodes"), F.count("_e").alias("escapes")).withColumn("sound", F.col("escapes") == 0)


def downstream(inputs: DataFrame, ids: DataFrame) -> DataFrame:
    return inputs.where("kind = 'upstream'").join(ids.select(F.col("artifact_id").alias("ref")), "ref", "left_semi").select("artifact_id").distinct()


def quarantine(artifacts: DataFrame, inputs: DataFrame, seeds: DataFrame, as_of: Column) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, newly quarantined ids): seeds and all built on them; earlier timestamps stay and are walked through."""
    edges = inputs.where("kind = 'upstream'").select(F.col("ref").alias("src"), F.col("artifact_id").alias("dst"))
    hit = reachable(edges, seeds.select(F.col("artifact_id").alias("node"))).select(F.col("node").alias("artifact_id"), F.lit(True).alias("_hit"))
    marked = artifacts.join(hit, "artifact_id", "left")
    new = marked.where("_hit and quarantined_at is null").select("artifact_id")
    return marked.withColumn("quarantined_at", F.coalesce("quarantined_at", F.when(F.col("_hit"), as_of))).drop("_hit"), new


def unquarantine(artifacts: DataFrame, artifact_id: str, reason: str) -> tuple[DataFrame, DataFrame]:
    """(next snapshot, audit rows): exactly one artifact, never what is built on it."""
    if not reason.strip():
        raise ValueError("a reason is needed")
    this = F.col("artifact_id") == artifact_id
    audit = artifacts.where(this & F.col("quarantined_at").isNotNull()).select("artifact_id", F.lit(reason).alias("reason"))
    return artifacts.withColumn("quarantined_at", F.when(~this, F.col("quarantined_at"))), audit


def latest_artifacts(artifacts: DataFrame) -> DataFrame:
    """The newest artifact of each stage that is not quarantined."""
    return artifacts.where("quarantined_at is null").groupBy("stage").agg(F.max_by("artifact_id", F.struct("created_at", "artifact_id")).alias("artifact_id"))


def explain_artifacts(artifacts: DataFrame, inputs: DataFrame, decisions: DataFrame, contradictions: DataFrame) -> DataFrame:
    """Artifacts with the numbers of their inputs, direct dependants, citing decisions and contradictions."""
    a = inputs.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_inputs"))
    b = inputs.where("kind = 'upstream'").groupBy(F.col("ref").alias("artifact_id")).agg(F.count_distinct("artifact_id").alias("n_downstream"))
    c = decisions.groupBy(F.col("candidate_artifact_id").alias("artifact_id")).agg(F.count(F.lit(1)).alias("n_decisions"))
    d = contradictions.groupBy("artifact_id").agg(F.count(F.lit(1)).alias("n_contradictions"))
    out = artifacts
    for counts in (a, b, c, d):
        out = out.join(counts, "artifact_id", "left")
    return out.select("artifact_id", "stage", *[F.coalesce(n, F.lit(0)).alias(n) for n in ("n_inputs", "n_downstream", "n_decisions", "n_contradictions")])


def explain_lists(artifacts: DataFrame, inputs: DataFrame, decisions: DataFrame, contradictions: DataFrame) -> DataFrame:
    """(artifact_id, list, place, ref, note): what explains each artifact, a row for each entry and its place from 1.

    inputs by kind and reference, noted with their digest; dependants by id; the decisions that cite it and its
    contradictions, newest first, noted with their time (timestamps in microseconds). artifacts: those asked for.
    """
    asked = artifacts.select("artifact_id").distinct()
    entry = lambda df, name, ref, note, *order: df.select("artifact_id", F.lit(name).alias("list"), ref.cast("string").alias("ref"), note.cast("string").alias("note"), F.row_number().over(Window.partitionBy("artifact_id").orderBy(*order)).alias("place"))
    own = inputs.join(asked, "artifact_id", "left_semi").select("artifact_id", "kind", "ref", "digest").distinct()
    built = inputs.where("kind = 'upstream'").select(F.col("ref").alias("artifact_id"), F.col("artifact_id").alias("by")).distinct().join(asked, "artifact_id", "left_semi")
    cited = decisions.withColumnRenamed("candidate_artifact_id", "artifact_id").join(asked, "artifact_id", "left_semi")
    against = contradictions.join(asked, "artifact_id", "left_semi")
    time = lambda df: F.unix_micros(F.col("created_at").cast("timestamp")) if df.schema["created_at"].dataType.typeName().startswith("timestamp") else F.col("created_at")
    parts = [
        entry(own, "inputs", F.concat_ws(":", "kind", "ref"), F.col("digest"), "kind", "ref", "digest"),
        entry(built, "dependants", F.col("by"), F.lit(None), "by"),
        entry(cited, "decisions", F.col("decision_id"), time(cited), F.desc("created_at"), F.desc("decision_id")),
        entry(against, "contradictions", F.col("contradiction_id"), time(against), F.desc("created_at"), F.desc("contradiction_id")),
    ]
    return reduce(DataFrame.unionByName, parts)


def contradictions_for(contradictions: DataFrame, artifact_id: str) -> DataFrame:
    """Contradictions of one artifact, newest first."""
    return contradictions.where(F.col("artifact_id") == artifact_id).orderBy(F.col("created_at").desc(), F.col("contradiction_id").desc())


def artifacts_by_id(artifacts: DataFrame, ids: DataFrame) -> DataFrame:
    """The artifacts that ids (artifact_id) name."""
    return artifacts.join(ids.select("artifact_id").distinct(), "artifact_id", "left_semi")


def inputs_by_id(inputs: DataFrame, ids: DataFrame) -> DataFrame:
    """The edges of the artifacts that ids name, each once."""
    return inputs.join(ids.select("artifact_id").distinct(), "artifact_id", "left_semi").distinct()


def derivations_by_blob(derivations: DataFrame, blobs: DataFrame) -> DataFrame:
    """Published derivations whose result is one of blobs (blob_digest): what a bad blob invalidates."""
    return derivations.where("state = 'PUBLISHED'").join(blobs.select("blob_digest").distinct(), "blob_digest", "left_semi")


def insert_absent(current: DataFrame, new: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """current and, of each new key, the first row."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in new.columns]), order).alias("_r")).select("_r.*")
    return current.unionByName(first.join(current.select(*keys), keys, "left_anti"))


def edge_conflicts(current: DataFrame, new: DataFrame) -> DataFrame:
    """(artifact_id, kind, ref, problem): another digest than recorded, repeated in the batch, or of unknown kind."""
    key = ["artifact_id", "kind", "ref"]
    other = new.join(current.withColumnRenamed("digest", "_digest"), key).where("digest <> _digest").select(*key, F.lit("digest").alias("problem"))
    twice = new.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*key, F.lit("repeated").alias("problem"))
    unknown = new.where(~F.col("kind").isin(KINDS)).select(*key, F.lit("kind").alias("problem"))
    return other.unionByName(twice).unionByName(unknown).distinct()


def upsert_code_graph(edges: DataFrame, units: DataFrame, new_edges: DataFrame, new_units: DataFrame, commit: str) -> tuple[DataFrame, DataFrame]:
    """(edges, units): the edges of one commit replaced, units replaced by id."""
    return edges.where(F.col("commit") != commit).unionByName(new_edges), units.join(new_units.select("unit_id"), "unit_id", "left_anti").unionByName(new_units)
