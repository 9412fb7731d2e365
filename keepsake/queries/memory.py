"""Queries of the failure memory."""

from pyspark.sql import functions as F

from keepsake.operators import memory as op
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_SEARCHED = "signature_id", "stage", "error_class", "embedding"
_SEARCH = """found AS (SELECT q.signature_id AS query_id, s.signature_id, s.stage, s.error_class, list_cosine_distance(list_transform(s.embedding, lambda x: cast(x AS double)), list_transform(q.embedding, lambda x: cast(x AS double))) AS distance
FROM {signatures} s JOIN {signatures} q ON q.signature_id % 20 = 0 AND s.stage = q.stage AND s.error_class = q.error_class),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, signature_id) AS place FROM found) WHERE place <= 8)"""


def _queries(signatures):
    return signatures.where("signature_id % 20 = 0").select(F.col("signature_id").alias("query_id"), "stage", "error_class", F.col("embedding").alias("vector"))


@R.query("signatures", sql=f"WITH {_SEARCH} SELECT query_id, signature_id, place, round(distance, 5) + 0.0 AS distance FROM top")
def h1_search_failures(signatures):
    return op.search_failures(signatures.select(*_SEARCHED), _queries(signatures)).select("query_id", "signature_id", "place", (F.round("distance", 5) + 0.0).alias("distance"))


@R.query("remediations", sql="SELECT signature_id, remediation_id, to_value FROM {remediations} WHERE succeeded")
def h3_latest_remediation(remediations):
    return op.latest_remediation(remediations).select("signature_id", "remediation_id", "to_value")


def _structured(df):
    return F.create_map(F.lit("num_labels"), F.col("num_labels").cast("string"), F.lit("batch_size"), F.col("batch_size").cast("string"), F.lit("framework_version"), F.col("framework_version"), F.lit("instance_kind"), F.col("instance_kind"))


def _causal(signatures, remediations):
    rows = signatures.join(remediations.select("signature_id", "changed_key", "from_value"), "signature_id")
    changes = F.array(F.struct(F.col("changed_key").alias("key"), F.col("from_value").cast("string").alias("from")))
    return rows.select("signature_id", op.causal_keys(changes, _structured(rows)).alias("causal"))


@R.query("signatures", "remediations", sql="SELECT signature_id, CASE WHEN signature_id % 10 <> 0 THEN 'num_labels' ELSE '' END AS causal FROM {remediations}")
def h4_causal_keys(signatures, remediations):
    return _causal(signatures, remediations).select("signature_id", F.coalesce(F.array_join("causal", ","), F.lit("")).alias("causal"))


def _tiers(signatures, remediations):
    found = op.search_failures(signatures, _queries(signatures)).join(_causal(signatures, remediations), "signature_id", "left")
    plan = signatures.select(F.col("signature_id").alias("query_id"), _structured(signatures).alias("plan"), F.col("stage").alias("p_stage"), F.col("error_class").alias("p_class"), F.col("framework_version").alias("p_version"), F.col("instance_kind").alias("p_kind"))
    rows = found.join(plan, "query_id")
    versions = F.col("framework_version").eqNullSafe(F.col("p_version")) & F.col("instance_kind").eqNullSafe(F.col("p_kind"))
    return rows.withColumn("tier", op.tier(F.col("causal"), op.agreeing_keys(_structured(rows), F.col("plan")), F.col("stage") == F.col("p_stage"), F.col("error_class") == F.col("p_class"), versions, F.col("distance")))


_TIER = f"""WITH {_SEARCH}, tiers AS (SELECT query_id, signature_id, place, CASE
  WHEN r.signature_id IS NOT NULL AND s.num_labels = q.num_labels AND s.framework_version = q.framework_version AND s.instance_kind = q.instance_kind THEN 'exact'
  WHEN r.signature_id IS NOT NULL AND distance <= 0.15 AND s.num_labels = q.num_labels THEN 'strong_semantic' WHEN distance <= 0.35 THEN 'weak' ELSE 'none' END AS tier
  FROM top t JOIN {{signatures}} s USING (signature_id) JOIN {{signatures}} q ON q.signature_id = t.query_id LEFT JOIN (SELECT signature_id FROM {{remediations}} WHERE signature_id % 10 <> 0) r USING (signature_id)) """


@R.query("signatures", "remediations", sql=_TIER + "SELECT query_id, signature_id, tier FROM tiers")
def h5_tiers(signatures, remediations):
    return _tiers(signatures, remediations).select("query_id", "signature_id", "tier")


@R.query("signatures", "remediations", sql=_TIER + """SELECT p.signature_id AS query_id, tier IS NOT NULL AND p.signature_id % 60 <> 0 AS blocked, CASE WHEN p.signature_id % 60 <> 0 THEN tier END AS tier, CASE WHEN p.signature_id % 60 <> 0 THEN b.signature_id END AS signature_id,
  CASE WHEN p.signature_id % 60 <> 0 THEN m.remediation_id END AS remediation_id, CASE WHEN p.signature_id % 60 = 0 THEN 'no embedding' END AS reason FROM {signatures} p
LEFT JOIN (SELECT * FROM tiers WHERE tier = 'exact' QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY place) = 1) b ON b.query_id = p.signature_id LEFT JOIN (SELECT * FROM {remediations} WHERE succeeded) m ON m.signature_id = b.signature_id WHERE p.signature_id % 20 = 0""")
def h6_preflight(signatures, remediations):
    plans = _queries(signatures).withColumn("vector", F.when(F.col("query_id") % 60 != 0, F.col("vector")))
    return op.preflight(plans, _tiers(signatures, remediations), remediations)


@R.query("signatures", sql="""WITH found AS (SELECT q.signature_id AS query_id, s.signature_id, list_cosine_distance(list_transform(s.embedding, lambda x: cast(x AS double)), list_transform(q.embedding, lambda x: cast(x AS double))) AS distance
FROM {signatures} s JOIN {signatures} q ON q.signature_id % 20 = 0 AND (q.signature_id % 40 = 0 OR s.stage = q.stage))
SELECT query_id, signature_id, place FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, signature_id) AS place FROM found) WHERE place <= 8""")
def h2_search_any_stage(signatures):
    queries = _queries(signatures).withColumn("stage", F.when(F.col("query_id") % 40 != 0, F.col("stage")))
    return op.search_failures(signatures.select(*_SEARCHED), queries, by_error=False).select("query_id", "signature_id", "place")


@R.query("signatures", "remediations", sql=_TIER + """SELECT t.query_id, t.signature_id, t.tier, t.tier IN ('exact', 'strong_semantic') AS blocks, CASE WHEN t.tier = 'weak' THEN 'advisory: does not block' END AS advisory,
  concat_ws(',', CASE WHEN s.batch_size = q.batch_size THEN 'batch_size' END, CASE WHEN s.framework_version = q.framework_version THEN 'framework_version' END, CASE WHEN s.instance_kind = q.instance_kind THEN 'instance_kind' END, CASE WHEN s.num_labels = q.num_labels THEN 'num_labels' END) AS agreeing,
  CASE WHEN s.signature_id % 3 = 0 THEN 3 ELSE 4 END AS n_known, r.remediation_id AS best_remediation, r.succeeded AS remediation_succeeded
FROM tiers t JOIN {signatures} s ON s.signature_id = t.signature_id JOIN {signatures} q ON q.signature_id = t.query_id LEFT JOIN {remediations} r ON r.signature_id = t.signature_id""")
def h7_memory_view(signatures, remediations):
    rows = _tiers(signatures, remediations)
    rows = rows.withColumn("agreeing", op.agreeing_keys(_structured(rows), F.col("plan"))).withColumn("structured", F.map_concat(F.map_filter(_structured(rows), lambda k, _: k != "batch_size"), F.create_map(F.lit("batch_size"), F.when(F.col("signature_id") % 3 != 0, F.col("batch_size").cast("string")))))
    return op.memory_view(rows, remediations).select("query_id", "signature_id", "tier", "blocks", "advisory", F.array_join("agreeing", ",").alias("agreeing"), F.size(F.map_keys("structured")).alias("n_known"), "best_remediation", "remediation_succeeded")


@R.query("signatures", "embeddings", sql="""WITH r AS (SELECT signature_id, CASE WHEN signature_id % 4 = 0 THEN 'other' ELSE 'text' END AS space, embedding, signature_id % 5 <> 0 AS active FROM {signatures} UNION ALL SELECT vec_id, 'text', list_slice(embedding, 1, 63), true FROM {embeddings} WHERE vec_id % 9 = 0 UNION ALL SELECT vec_id, 'lost', embedding, true FROM {embeddings} WHERE vec_id % 11 = 0),
n AS (SELECT *, sqrt(list_sum(list_transform(embedding, lambda x: cast(x AS double) * cast(x AS double)))) AS norm FROM r WHERE active),
p AS (SELECT signature_id, space, 'unknown_space' AS problem FROM n WHERE space = 'lost' UNION ALL SELECT signature_id, space, 'dimension' FROM n WHERE space <> 'lost' AND len(embedding) <> 64 UNION ALL SELECT signature_id, space, 'not_normalised' FROM n WHERE space = 'other' AND abs(norm - 1) > 1e-3
UNION ALL SELECT signature_id, space, 'repeated' FROM n GROUP BY 1, 2 HAVING count(*) > 1) SELECT problem, count(*) AS n, count(DISTINCT signature_id) AS signatures FROM p GROUP BY 1""")
def h11_embedding_problems(signatures, embeddings):
    k = F.col("vec_id")
    revisions = signatures.select("signature_id", F.when(F.col("signature_id") % 4 == 0, "other").otherwise("text").alias("space"), "embedding", (F.col("signature_id") % 5 != 0).alias("active"))
    revisions = revisions.unionByName(embeddings.where(k % 9 == 0).select(k.alias("signature_id"), F.lit("text").alias("space"), F.slice("embedding", 1, 63).alias("embedding"), F.lit(True).alias("active")))
    revisions = revisions.unionByName(embeddings.where(k % 11 == 0).select(k.alias("signature_id"), F.lit("lost").alias("space"), "embedding", F.lit(True).alias("active")))
    spaces = signatures.sparkSession.createDataFrame([("text", 64, False), ("other", 64, True)], "space string, dim int, normalised boolean")
    return op.embedding_problems(revisions, spaces).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("signature_id").alias("signatures"))


@R.query("signatures", sql="SELECT signature_id AS plan_id, cast(batch_size AS varchar) AS input_dim, cast(32 * (1 + num_labels % 3) AS varchar) AS embedding_dim FROM {signatures} WHERE batch_size <> 32 * (1 + num_labels % 3)")
def h8_shape_mismatch(signatures):
    read = lambda key, value: signatures.select(F.col("signature_id").alias("plan_id"), F.lit(key).alias("key"), value.cast("string").alias("value"))
    return op.shape_mismatch(read("input_dim", F.col("batch_size")).unionByName(read("embedding_dim", 32 * (1 + F.col("num_labels") % 3))).unionByName(read("other", F.lit(1))))


@R.query("remediations", sql="""WITH c AS (SELECT concat('run', cast(signature_id AS string)) AS key, cast(from_value AS string) AS value FROM {remediations}), n AS (SELECT concat('run', cast(signature_id + 2 AS string)) AS key, cast(to_value AS string) AS value FROM {remediations} WHERE succeeded)
SELECT key, coalesce(n.value, c.value) AS value FROM c FULL JOIN n USING (key)""")
def h10_apply_remediation(remediations):
    config = remediations.select(F.concat(F.lit("run"), F.col("signature_id").cast("string")).alias("key"), F.col("from_value").cast("string").alias("value"))
    changes = remediations.where("succeeded").select(F.concat(F.lit("run"), (F.col("signature_id") + 2).cast("string")).alias("key"), F.col("to_value").cast("string").alias("value"))
    return op.apply_remediation(config, changes)
