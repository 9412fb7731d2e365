"""Queries of the lineage graph."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from keepsake.operators import lineage as op
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_REACH = "WITH RECURSIVE reach(node) AS (SELECT 'a1' UNION SELECT artifact_id FROM reach JOIN {artifact_inputs} ON ref = node) "


def _edges(inputs):
    return inputs.select(F.col("ref").alias("src"), F.col("artifact_id").alias("dst"))


def _seed(df, *ids):
    return df.sparkSession.createDataFrame([(i,) for i in ids], "artifact_id string")


@R.query("artifact_inputs", sql="WITH RECURSIVE reach(node, depth) AS (SELECT 'a1', 0 UNION SELECT artifact_id, depth + 1 FROM reach JOIN {artifact_inputs} ON ref = node) SELECT node, min(depth) AS depth FROM reach GROUP BY 1")
def e1_reachable(inputs):
    return op.reachable(_edges(inputs), _seed(inputs, "a1").withColumnRenamed("artifact_id", "node"))


@R.query("artifact_inputs", "artifacts", sql=_REACH + "SELECT count(*) AS nodes, count(*) FILTER (k % 173 = 172) AS escapes, count(*) FILTER (k % 173 = 172) = 0 AS sound FROM reach JOIN {artifacts} ON node = artifact_id")
def e1_sound(inputs, artifacts):
    reached = op.reachable(_edges(inputs), _seed(inputs, "a1").withColumnRenamed("artifact_id", "node"))
    return op.is_sound(reached, artifacts.where("k % 173 = 172").select(F.col("artifact_id").alias("node")))


@R.query("artifact_inputs", "artifacts", sql="SELECT DISTINCT artifact_id FROM {artifact_inputs} WHERE ref IN (SELECT artifact_id FROM {artifacts} WHERE stage = 'features')")
def e2_downstream(inputs, artifacts):
    return op.downstream(inputs, artifacts.where("stage = 'features'"))


@R.query("artifacts", "artifact_inputs", sql=_REACH + "SELECT artifact_id, CASE WHEN k % 10 = 3 THEN 5 WHEN node IS NOT NULL THEN 99 END AS quarantined_at FROM {artifacts} LEFT JOIN reach ON node = artifact_id")
def e3_quarantine(artifacts, inputs):
    marked = artifacts.withColumn("quarantined_at", F.when(F.col("k") % 10 == 3, 5))
    return op.quarantine(marked, inputs, _seed(inputs, "a1"), F.lit(99))[0].select("artifact_id", "quarantined_at")


@R.query("artifacts", sql="SELECT artifact_id, CASE WHEN k % 10 = 3 AND k <> 13 THEN 5 END AS quarantined_at FROM {artifacts}")
def e4_unquarantine(artifacts):
    marked = artifacts.withColumn("quarantined_at", F.when(F.col("k") % 10 == 3, 5))
    return op.unquarantine(marked, "a13", "checked again")[0].select("artifact_id", "quarantined_at")


@R.query("artifacts", sql="SELECT stage, artifact_id FROM (SELECT stage, artifact_id, row_number() OVER (PARTITION BY stage ORDER BY created_at DESC, artifact_id DESC) AS n FROM {artifacts} WHERE k % 10 <> 3) WHERE n = 1")
def e6_latest_artifacts(artifacts):
    return op.latest_artifacts(artifacts.withColumn("quarantined_at", F.when(F.col("k") % 10 == 3, 5)))


_CONTRADICTIONS = "(SELECT decision_id AS contradiction_id, candidate_artifact_id AS artifact_id, latency_ms AS created_at FROM {decisions} WHERE decision_id % 7 = 0 AND candidate_artifact_id IS NOT NULL)"


def _contradictions(decisions):
    return decisions.where("decision_id % 7 = 0 and candidate_artifact_id is not null").select(F.col("decision_id").alias("contradiction_id"), F.col("candidate_artifact_id").alias("artifact_id"), F.col("latency_ms").alias("created_at"))


@R.query("artifacts", "artifact_inputs", "decisions", sql=f"""SELECT artifact_id, stage, coalesce(a.n, 0) AS n_inputs, coalesce(b.n, 0) AS n_downstream, coalesce(c.n, 0) AS n_decisions, coalesce(d.n, 0) AS n_contradictions FROM {{artifacts}}
LEFT JOIN (SELECT artifact_id, count(*) AS n FROM {{artifact_inputs}} GROUP BY 1) a USING (artifact_id) LEFT JOIN (SELECT ref AS artifact_id, count(DISTINCT artifact_id) AS n FROM {{artifact_inputs}} GROUP BY 1) b USING (artifact_id)
LEFT JOIN (SELECT candidate_artifact_id AS artifact_id, count(*) AS n FROM {{decisions}} GROUP BY 1) c USING (artifact_id) LEFT JOIN (SELECT artifact_id, count(*) AS n FROM {_CONTRADICTIONS} GROUP BY 1) d USING (artifact_id)""")
def e8_explain_artifacts(artifacts, inputs, decisions):
    return op.explain_artifacts(artifacts, inputs, decisions, _contradictions(decisions))


@R.query("artifacts", "artifact_inputs", "decisions", sql=f"""WITH a AS (SELECT artifact_id FROM {{artifacts}} WHERE stage IN ('features', 'eval')),
e AS (SELECT artifact_id, 'inputs' AS list, concat(kind, ':', ref) AS ref, digest AS note, row_number() OVER (PARTITION BY artifact_id ORDER BY kind, ref, digest) AS place FROM (SELECT DISTINCT artifact_id, kind, ref, digest FROM {{artifact_inputs}})
UNION ALL SELECT ref, 'dependants', artifact_id, NULL, row_number() OVER (PARTITION BY ref ORDER BY artifact_id) FROM (SELECT DISTINCT ref, artifact_id FROM {{artifact_inputs}} WHERE kind = 'upstream')
UNION ALL SELECT candidate_artifact_id, 'decisions', cast(decision_id AS string), cast(epoch_us(created_at) AS string), row_number() OVER (PARTITION BY candidate_artifact_id ORDER BY created_at DESC, decision_id DESC) FROM {{decisions}}
UNION ALL SELECT artifact_id, 'contradictions', cast(contradiction_id AS string), cast(created_at AS string), row_number() OVER (PARTITION BY artifact_id ORDER BY created_at DESC, contradiction_id DESC) FROM {_CONTRADICTIONS})
SELECT e.* FROM e JOIN a USING (artifact_id)""")
def e8_explain_lists(artifacts, inputs, decisions):
    return op.explain_lists(artifacts.where("stage in ('features', 'eval')"), inputs, decisions, _contradictions(decisions))


@R.query("decisions", sql=f"SELECT contradiction_id, created_at, row_number() OVER (ORDER BY created_at DESC, contradiction_id DESC) AS place FROM {_CONTRADICTIONS} WHERE artifact_id = 'a7'")
def e5_contradictions(decisions):
    newest_first = op.contradictions_for(_contradictions(decisions), "a7")
    return newest_first.select("contradiction_id", "created_at", F.row_number().over(Window.orderBy(F.col("created_at").desc(), F.col("contradiction_id").desc())).alias("place"))  # one artifact's


@R.query("artifacts", "artifact_inputs", "decisions", sql="SELECT a.artifact_id, a.size_bytes, i.ref, i.digest FROM {artifacts} a LEFT JOIN (SELECT DISTINCT artifact_id, ref, digest FROM {artifact_inputs}) i USING (artifact_id) WHERE a.artifact_id IN (SELECT candidate_artifact_id FROM {decisions} WHERE action = 'REUSE')")
def e7_artifacts_by_id(artifacts, inputs, decisions):
    ids = decisions.where("action = 'REUSE'").select(F.col("candidate_artifact_id").alias("artifact_id"))
    edges = op.inputs_by_id(inputs, ids).select("artifact_id", "ref", "digest")
    return op.artifacts_by_id(artifacts, ids).select("artifact_id", "size_bytes").join(edges, "artifact_id", "left")


@R.query("commits", sql="SELECT work_key, chunk, blob AS blob_digest FROM {commits} WHERE attempt = 1 AND work_key % 3 <> 0 AND blob IN (SELECT blob FROM {commits} WHERE input % 50 = 7)")
def e11_derivations_by_blob(commits):
    derivations = commits.where("attempt = 1").select("work_key", "chunk", F.col("blob").alias("blob_digest"), F.when(F.col("work_key") % 3 != 0, "PUBLISHED").otherwise("CANDIDATE").alias("state"))
    return op.derivations_by_blob(derivations, commits.where("input % 50 = 7").select(F.col("blob").alias("blob_digest"))).select("work_key", "chunk", "blob_digest")


@R.query("fragments", "commits", sql="""SELECT work_key, chunk, input FROM (SELECT work_key, fragment_index AS chunk, part AS input FROM {fragments} WHERE work_key % 2 = 0 UNION ALL SELECT work_key, chunk, input FROM {commits} WHERE work_key % 2 = 1 AND attempt = 1)""")
def e9_insert_absent(fragments, commits):
    current = fragments.where("work_key % 2 = 0").select("work_key", F.col("fragment_index").alias("chunk"), F.col("part").alias("input"), F.lit(0).cast("int").alias("attempt"))
    new = commits.select("work_key", "chunk", "input", F.col("attempt").cast("int").alias("attempt"))
    return op.insert_absent(current, new, ["work_key", "chunk"], F.col("attempt")).select("work_key", "chunk", "input")


@R.query("artifact_inputs", sql="""SELECT artifact_id, kind, ref, problem FROM (SELECT artifact_id, kind, ref, 'digest' AS problem FROM {artifact_inputs} WHERE cast(substr(artifact_id, 2) AS bigint) % 30 = 0
UNION ALL SELECT artifact_id, 'other', ref, 'kind' FROM {artifact_inputs} WHERE cast(substr(artifact_id, 2) AS bigint) % 41 = 0 UNION ALL SELECT artifact_id, kind, ref, 'repeated' FROM {artifact_inputs} WHERE cast(substr(artifact_id, 2) AS bigint) % 50 = 0)""")
def e10_edge_conflicts(inputs):
    k = F.substring("artifact_id", 2, 20).cast("bigint")
    new = inputs.withColumn("digest", F.when(k % 30 == 0, "other").otherwise(F.col("digest")))
    new = new.unionByName(inputs.where(k % 41 == 0).withColumn("kind", F.lit("other"))).unionByName(new.where(k % 50 == 0))
    return op.edge_conflicts(inputs, new)
