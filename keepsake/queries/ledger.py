"""Queries of the reuse ledger."""

from pyspark.sql import functions as F

from keepsake.operators import ledger as op
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
#: The two seeded rates, in dollars.
RATES = [("vcpu_hour", 0.04048), ("gib_hour", 0.004445)]
_PRODUCT = """product AS (SELECT * FROM {decisions} d WHERE length(work_key) = 64 AND regexp_full_match(work_key, '[0-9a-f]+') AND (candidate_artifact_id IS NULL OR EXISTS (SELECT 1 FROM {artifacts} a WHERE a.artifact_id = d.candidate_artifact_id AND NOT starts_with(a.s3_uri, 's3://test/'))))"""
_P = f"WITH {_PRODUCT} "
_REUSED = _P.rstrip() + ", reused AS (SELECT duration_ms, latency_ms, vcpu, mem_mib FROM product p JOIN {artifacts} a ON p.candidate_artifact_id = a.artifact_id WHERE verdict = 'reuse') "
_STAGES = "(VALUES (0, 'env', 2.0), (1, 'dataset', 9.0), (2, 'features', 95.0), (3, 'checkpoint', 28.0), (4, 'eval', 4.0)) s(ordinal, stage, preset)"


def _rates(df):
    return df.sparkSession.createDataFrame(RATES, "resource_kind string, usd double")


@R.query("decisions", "artifacts", sql=_P + "SELECT decision_id, stage, action FROM product")
def f1_product_decisions(dec, art):
    return op.product_decisions(dec, art).select("decision_id", "stage", "action")


@R.query("decisions", "artifacts", sql=_P + f""", d AS (SELECT * FROM product QUALIFY row_number() OVER (PARTITION BY stage ORDER BY created_at DESC, decision_id DESC) = 1),
a AS (SELECT * FROM {{artifacts}} WHERE NOT starts_with(s3_uri, 's3://test/')), n AS (SELECT * FROM a QUALIFY row_number() OVER (PARTITION BY stage ORDER BY created_at DESC, artifact_id DESC) = 1)
SELECT ordinal, stage, decision_id, action, CASE WHEN decision_id IS NULL THEN n.artifact_id ELSE a.artifact_id END AS artifact_id FROM {_STAGES} LEFT JOIN d USING (stage) LEFT JOIN n USING (stage) LEFT JOIN a ON a.artifact_id = d.candidate_artifact_id""")
def f2_pipeline_status(dec, art):
    return op.pipeline_status(dec, art)


@R.query("decisions", sql="SELECT decision_id, action FROM {decisions} ORDER BY created_at DESC, decision_id DESC LIMIT 50 OFFSET 20")
def f3_list_decisions(dec):
    return op.list_decisions(dec, 50, 20).select("decision_id", "action")


@R.query("decisions", "artifact_inputs", sql="""WITH n AS (SELECT artifact_id, count(*) AS n_inputs FROM {artifact_inputs} GROUP BY 1)
SELECT decision_id, CASE WHEN action = 'REUSE' AND decision_id % 4 = 0 THEN 64 END AS sample_size, n_inputs FROM {decisions} LEFT JOIN n ON candidate_artifact_id = artifact_id""")
def f4_decision_detail(dec, inputs):
    probes = dec.where("action = 'REUSE' and decision_id % 4 = 0").select("decision_id", F.lit(64).alias("sample_size"))
    return op.decision_detail(dec, probes, inputs).select("decision_id", "sample_size", "n_inputs")


@R.query("decisions", sql="SELECT decision_id FROM {decisions} WHERE candidate_artifact_id IN ('a1', 'a7')")
def f5_decisions_for_artifact(dec):
    return op.decisions_for_artifact(dec, ["a1", "a7"]).select("decision_id")


@R.query("decisions", sql="SELECT decision_id, stage FROM {decisions} WHERE verdict = 'refused' ORDER BY created_at DESC, decision_id DESC LIMIT 1")
def f6_latest_refusal(dec):
    return op.latest_refusal(dec).select("decision_id", "stage")


@R.query("decisions", "artifacts", sql=_P + "SELECT count(*) FILTER (verdict = 'reuse') AS reused, count(*) FILTER (verdict = 'recompute') AS recomputed, count(*) FILTER (action IN ('REFUSE_DUPLICATE', 'SUBSCRIBE')) AS duplicates, count(*) FILTER (action = 'REFUSE_DOOMED') AS doomed, count(*) FILTER (action = 'RESUME') AS resumed, count(*) AS total FROM product")
def f7_savings_counts(dec, art):
    return op.savings_counts(op.product_decisions(dec, art))


@R.query("decisions", "artifacts", sql=_REUSED + "SELECT count(*) AS artifacts, round(coalesce(sum(duration_ms), 0) / 1000.0 - coalesce(sum(latency_ms), 0) / 1000.0, 3) AS net_seconds, round(coalesce(sum(latency_ms), 0) / 1000.0, 3) AS probe_seconds FROM reused")
def f8_savings_time(dec, art):
    return op.savings_time(op.reused_artifacts(op.product_decisions(dec, art), art))


@R.query("decisions", "artifacts", sql=_REUSED + """, s AS (SELECT sum((duration_ms - latency_ms) / 1000.0) AS net, sum(vcpu * (duration_ms - latency_ms) / 3600000.0) * 0.04048 + sum(mem_mib / 1024.0 * (duration_ms - latency_ms) / 3600000.0) * 0.004445 AS cost FROM reused)
SELECT round(net, 3) AS net_seconds, round(cost, 4) AS cost_usd, round(cost / net, 9) AS usd_per_second, printf('%.1fs x $%.7f/s = $%.4f', net, cost / net, cost) AS formula FROM s""")
def f9_savings_cost(dec, art):
    out = op.savings(op.reused_artifacts(op.product_decisions(dec, art), art), _rates(dec))
    return out.select("net_seconds", F.round("cost_usd", 4).alias("cost_usd"), F.round("usd_per_second", 9).alias("usd_per_second"), "formula")


@R.query("artifacts", sql=f"""WITH m AS (SELECT stage, avg(duration_ms) / 1000.0 AS mean FROM {{artifacts}} GROUP BY 1)
SELECT stage, round(coalesce(mean, preset), 6) AS seconds, round(coalesce(mean, preset) / 3600.0 * (2.0 * 0.04048 + 4.0 * 0.004445), 9) AS cost_usd FROM {_STAGES} LEFT JOIN m USING (stage)""")
def f10_cost_projection(art):
    return op.estimate_cost(art, _rates(art))


@R.query("decisions", sql="""SELECT decision_id, concat_ws(',', CASE WHEN verdict = 'reuse' AND (authorized_by IS NULL OR authorized_by NOT IN ('probe', 'structural', 'identity')) THEN 'authority' END, CASE WHEN latency_ms IS NULL OR latency_ms < 0 THEN 'latency' END) AS violations FROM {decisions} WHERE violations <> ''""")
def f11_validate_decisions(dec):
    return op.validate_decisions(dec)


@R.query("artifacts", sql="SELECT stage FROM (SELECT stage, avg(duration_ms) / 3600000.0 * (2.0 * 0.04048 + 4.0 * 0.004445) AS c FROM {artifacts} GROUP BY 1) WHERE c > 0.0005")
def f12_escalations(art):
    return op.escalations(op.estimate_cost(art, _rates(art)), 0.0005).select("stage")


@R.query("decisions", sql="SELECT stage, count(*) FILTER (action = 'REUSE') AS reuse, count(*) FILTER (action = 'RECOMPUTE') AS recompute, count(*) FILTER (action = 'SUBSCRIBE') AS subscribe, count(*) FILTER (action = 'RESUME') AS resume, count(*) FILTER (action = 'REFUSE_DOOMED') AS refuse_doomed, count(*) FILTER (action = 'REFUSE_DUPLICATE') AS refuse_duplicate, count(*) AS total FROM {decisions} GROUP BY stage")
def f20_usage_tally(dec):
    return op.usage_tally(dec)


@R.query("decisions", sql="SELECT decision_id, CASE WHEN authorized_by IS NOT NULL THEN authorized_by WHEN action = 'REUSE' THEN 'planner (proposal only)' ELSE 'unattributed (not authorized)' END AS authority FROM {decisions}")
def f21_authority(dec):
    proposed = F.when(F.col("action") == "REUSE", "planner")
    return dec.select("decision_id", op.authority_label(proposed, F.col("authorized_by")).alias("authority"))
