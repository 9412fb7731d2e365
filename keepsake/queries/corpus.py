"""Queries of corpus preparation, evaluation, probes and event metrics."""

from pyspark.sql import functions as F

from keepsake.operators import corpus as op
from keepsake.operators import events as ev
from keepsake.queries.registry import Registry

R = Registry()
QUERIES, ORACLE = R.queries, R.oracle
_METRICS = """counts AS (SELECT y, yhat, count(*) AS n FROM x GROUP BY 1, 2), labels AS (SELECT y AS l FROM counts UNION SELECT yhat FROM counts),
f AS (SELECT l, coalesce(sum(n) FILTER (y = l AND yhat = l), 0) AS tp, coalesce(sum(n) FILTER (y = l), 0) AS t, coalesce(sum(n) FILTER (yhat = l), 0) AS g FROM labels CROSS JOIN counts GROUP BY l)
SELECT cast(sum(t) AS bigint) AS n_examples, round(sum(tp) / sum(t), 9) AS accuracy, round(avg(2.0 * tp / (t + g)), 9) AS macro_f1 FROM f"""


@R.query("documents", sql="SELECT doc_id, length(t) AS n, sha256(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(text, '[\\s\\x0B\x85\xa0  -     　]+', ' ', 'g')) AS t FROM {documents}) WHERE length(t) > 0")
def b1_normalize_text(docs):
    return op.normalize_text(docs).select("doc_id", F.length("text").alias("n"), F.sha2("text", 256).alias("digest"))


@R.query("documents", sql="SELECT count(*) AS rows, count(*) FILTER (doc_id % 5 <> 0) AS train, count(*) FILTER (doc_id % 5 = 0) AS test FROM {documents}")
def b4_split_summary(docs):
    return op.split_summary(op.modulus_split(docs))


@R.query("documents", sql="SELECT doc_id, cast(ntile(7) OVER (ORDER BY doc_id) - 1 AS integer) AS shard FROM {documents}")
def b5_assign_shards(docs):
    return op.assign_shards(docs.select("doc_id"), 7)


@R.query("documents")
def b7_hash_embed(docs):
    return docs.select("doc_id", op.hash_embed(F.col("text")).alias("embedding"))


@R.query("documents")
def b6_embed_shards(docs):
    def lengths(texts):
        return [[len(t), t.count(" "), t.count("\n"), 1.0] for t in texts]

    shards = op.assign_shards(docs.select("doc_id", "text"), 7)
    return op.shard_digests(op.embed(shards, lengths, 4))


@R.query("snapshot", "embeddings", sql="SELECT doc_id, target, len(embedding) AS dim, label FROM {snapshot} JOIN (SELECT vec_id AS doc_id, embedding, label FROM {embeddings}) USING (doc_id)")
def b8_join_features(snapshot, embeddings):
    return op.join_features(snapshot, embeddings.withColumnRenamed("vec_id", "doc_id")).select("doc_id", "target", F.size("embedding").alias("dim"), "label")


@R.query("embeddings")
def b10_train_and_score(embeddings):
    rows = op.modulus_split(embeddings, 5, "vec_id")
    model = op.train_classifier(rows, "embedding", "label", classes=10, dim=64, hidden=32, rounds=30)
    return op.score(model, rows.where("split = 'test'"), "embedding").select("vec_id", "label", "yhat")


@R.query("scores", sql="WITH x AS (SELECT * FROM {scores}), " + _METRICS)
def b11_metrics(scores):
    return op.classification_metrics(scores).select("n_examples", F.round("accuracy", 9).alias("accuracy"), F.round("macro_f1", 9).alias("macro_f1"))


@R.query("decisions", sql="SELECT DISTINCT stage, k AS key, CASE WHEN stage = 'eval' AND k = 'lr' THEN '0.5' ELSE 'preset' END AS value, NOT (stage = 'eval' AND k = 'lr') AS defaulted FROM {decisions} CROSS JOIN (VALUES ('lr'), ('seed')) t(k)")
def b12_effective_config(dec):
    defaults = dec.select("stage").distinct().select("stage", F.explode(F.array(F.lit("lr"), F.lit("seed"))).alias("key"), F.lit("preset").alias("value"))
    return op.effective_config(defaults.where("stage = 'eval' and key = 'lr'").withColumn("value", F.lit("0.5")), defaults)


@R.query("documents", sql="SELECT lang, count(*) AS n FROM {documents} GROUP BY 1")
def b13_category_counts(docs):
    return op.category_counts(docs, "lang")


@R.query("documents", sql="SELECT doc_id FROM {documents} ORDER BY sha256(concat('salt:', cast(doc_id AS string))), doc_id LIMIT 64")
def c1_hash_select(docs):
    return op.hash_select(docs, "doc_id", "salt", 64).select("doc_id")


@R.query("artifacts", sql="""WITH c AS (SELECT 'some' AS other, count(*) AS n, count(*) FILTER (stage IS DISTINCT FROM CASE WHEN k % 9 <> 0 THEN stage END) AS bad FROM {artifacts} UNION ALL SELECT 'none', count(*), count(*) FILTER (stage IS DISTINCT FROM stage) FROM {artifacts})
SELECT other, 'P1' AS probe_type, bad = 0 AS passed, n AS population_size, cast(bad AS varchar) AS detail FROM c""")
def c2_probe_env(artifacts):
    a = artifacts.select("artifact_id", F.col("stage").alias("env"))
    b = artifacts.select("artifact_id", F.when(F.col("k") % 9 != 0, F.col("stage")).alias("env"))
    compared = lambda x, name: op.probe_env(a, x, "artifact_id", "env").select(F.lit(name).alias("other"), "probe_type", "passed", "population_size", "detail")
    return compared(b, "some").unionByName(compared(a, "none"))


_SUBTREE = """WITH RECURSIVE olds(node) AS (SELECT 'a1' UNION SELECT artifact_id FROM olds JOIN {artifact_inputs} ON ref = node),
news(node) AS (SELECT 'a1' UNION SELECT artifact_id FROM news JOIN (SELECT * FROM {artifact_inputs} WHERE cast(substr(artifact_id, 2) AS bigint) % 5 <> 3) e ON ref = node),
reached AS (SELECT node, cast(substr(node, 2) AS bigint) AS k FROM (SELECT node FROM olds UNION SELECT node FROM news)) """


@R.query("artifact_inputs", "artifacts", sql=_SUBTREE + """, c AS (SELECT 'inside' AS change, count(*) AS n, count(*) FILTER (k % 7 = 1) AS changed, count(*) FILTER (k % 173 = 172) AS escapes FROM reached
UNION ALL SELECT 'outside', count(*), count(*) FILTER (k IN (2, 5, 6)), 0 FROM reached)
SELECT change, 'P2' AS probe_type, changed = 0 AND escapes = 0 AS passed, n AS population_size, concat(cast(changed AS varchar), ',', cast(escapes AS varchar)) AS detail FROM c""")
def c3_probe_struct(inputs, artifacts):
    old = inputs.select(F.col("ref").alias("src"), F.col("artifact_id").alias("dst"))
    new = old.where(F.substring("dst", 2, 20).cast("bigint") % 5 != 3)
    units = artifacts.select(F.col("artifact_id").alias("node"), "k")
    entry = units.where("k = 1").select("node")
    reached = op.reached_in_either(old, new, entry)
    probe = lambda changed, escapes, name: op.probe_struct(old, new, entry, changed, escapes, reached).select(F.lit(name).alias("change"), "probe_type", "passed", "population_size", "detail")
    return probe(units.where("k % 7 = 1"), units.where("k % 173 = 172"), "inside").unionByName(probe(units.where("k in (2, 5, 6)"), units.where("k < 0"), "outside"))


@R.query("embeddings", sql="""WITH s AS (SELECT vec_id FROM {embeddings} ORDER BY sha256(concat('p3:', cast(vec_id AS string))), vec_id LIMIT 64)
SELECT count(*) AS sample_size, count(*) FILTER (vec_id % 7 = 0) = 0 AS passed, coalesce(string_agg(cast(vec_id AS varchar), ',' ORDER BY vec_id) FILTER (vec_id % 7 = 0), '') AS detail FROM s""")
def c4_probe_vectors(embeddings):
    other = embeddings.withColumn("embedding", F.when(F.col("vec_id") % 7 == 0, F.transform("embedding", lambda x: x + F.lit(1.0).cast("float"))).otherwise(F.col("embedding")))
    return op.probe_vectors(embeddings, other, "vec_id", "embedding", "p3").select("sample_size", "passed", "detail")


@R.query("embeddings", sql="""WITH s AS (SELECT vec_id FROM {embeddings} ORDER BY sha256(concat('p4:', cast(vec_id AS string))), vec_id LIMIT 128)
SELECT 'some' AS other, count(*) AS sample_size, count(*) FILTER (vec_id % 11 = 0) = 0 AS passed, coalesce(string_agg(cast(vec_id AS varchar), ',' ORDER BY vec_id) FILTER (vec_id % 11 = 0), '') AS detail FROM s
UNION ALL SELECT 'none', count(*), true, '' FROM s""")
def c5_probe_scores(embeddings):
    a = embeddings.select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 0.5).alias("logits"))
    b = a.withColumn("logits", F.when(F.col("vec_id") % 11 == 0, F.transform("logits", lambda x: x + 1e-12)).otherwise(F.col("logits")))
    compared = lambda x, name: op.probe_scores(a, x, "vec_id", "logits", "p4").select(F.lit(name).alias("other"), "sample_size", "passed", "detail")
    return compared(b, "some").unionByName(compared(a.repartition(3), "none"))


_PLACED = "SELECT *, row_number() OVER (ORDER BY doc_id) AS p FROM"


@R.query("documents", "mutated", sql=f"""WITH a AS ({_PLACED} {{documents}}), b AS ({_PLACED} {{mutated}}), c AS ({_PLACED} (SELECT doc_id, CASE WHEN doc_id = 20 THEN 'other' ELSE text END AS text, lang, source, n_chars FROM {{documents}}) x),
pairs AS (SELECT 'rows' AS other, (SELECT count(*) FROM b) AS m, (SELECT count(*) FROM (SELECT * FROM a WHERE p % 10 = 1 EXCEPT SELECT * FROM b)) AS d UNION ALL SELECT 'same', (SELECT count(*) FROM a), (SELECT count(*) FROM (SELECT * FROM a WHERE p % 10 = 1 EXCEPT SELECT * FROM a)) UNION ALL SELECT 'text', (SELECT count(*) FROM c), (SELECT count(*) FROM (SELECT * FROM a WHERE p % 10 = 1 EXCEPT SELECT * FROM c)))
SELECT other, 'P5' AS probe_type, n = m AND d = 0 AS passed, n AS population_size, (n + 9) // 10 AS sample_size, CASE WHEN n <> m THEN 'rows' WHEN d > 0 THEN 'checksum' ELSE '' END AS detail FROM pairs, (SELECT count(*) AS n FROM a) t""")
def c6_probe_table(docs, mutated):
    text = docs.withColumn("text", F.when(F.col("doc_id") == 20, "other").otherwise(F.col("text")))
    own = op.table_checksums(docs, "doc_id")
    compared = lambda x, name: op.probe_table(docs, x, "doc_id", checksums=own).select(F.lit(name).alias("other"), "probe_type", "passed", "population_size", "sample_size", "detail")
    return compared(mutated, "rows").unionByName(compared(docs.repartition(23), "same")).unionByName(compared(text, "text"))


@R.query("scores", sql="""WITH picked AS (SELECT * FROM {scores} ORDER BY sha256(concat('eval_slice:accuracy,macro_f1:', cast(vec_id AS string))), vec_id LIMIT 200),
x AS (SELECT count(*) AS n, count(*) FILTER (y = yhat) AS a, count(*) FILTER (y = CASE WHEN vec_id % 13 = 0 THEN (yhat + 3) % 10 ELSE yhat END) AS b FROM picked)
SELECT 'other' AS other, 'P6' AS probe_type, a = b AS passed, n AS sample_size, 'accuracy,macro_f1' AS detail FROM x UNION ALL SELECT 'same', 'P6', a = a, n, 'accuracy,macro_f1' FROM x""")
def c7_probe_metrics(scores):
    other = scores.withColumn("yhat", F.when(F.col("vec_id") % 13 == 0, (F.col("yhat") + 3) % 10).otherwise(F.col("yhat")))
    compared = lambda x, name: op.probe_metrics(scores, x, "vec_id").select(F.lit(name).alias("other"), "probe_type", "passed", "sample_size", "detail")
    return compared(other, "other").unionByName(compared(scores.repartition(3), "same"))


@R.query("decisions", sql="SELECT decision_id, sha256(concat(stage, chr(31), action, chr(31), cast(latency_ms AS string))) AS digest FROM {decisions}")
def c8_evidence_digest(dec):
    from keepsake.functions.canon import evidence_digest

    return dec.select("decision_id", evidence_digest(F.col("stage"), F.col("action"), F.col("latency_ms").cast("string")).alias("digest"))


@R.query("documents", sql=r"SELECT doc_id, sha256(regexp_replace(text, '\b(password|secret|token|key)(\s*[:=]\s*)\S+', '\1\2[REDACTED]', 'gi')) AS digest FROM {documents}")
def j20_redact(docs):
    return op.redact(docs, "text").select("doc_id", F.sha2("text", 256).alias("digest"))


# --- events

_WINDOWS = """w AS (SELECT epoch_us(ts) // 300000000 AS win, count(*) FILTER (event_type = 'view') AS reuse, count(*) FILTER (event_type = 'click') AS recompute, count(*) FILTER (event_type = 'error') AS errors, count(*) AS n FROM {events} GROUP BY 1)"""


@R.query("events", sql="SELECT event_type, count(*) AS n, count(DISTINCT user_id) AS users, round(sum(value), 2) AS total FROM {events} GROUP BY 1")
def i4_usage_tally(events):
    return ev.tally(events)


@R.query("events", sql="SELECT event_type, count(*) AS n FROM {events} WHERE event_type NOT IN ('view', 'click', 'purchase') GROUP BY 1")
def i8_unknown_types(events):
    return ev.unknown_types(events, ["view", "click", "purchase"])


@R.query("events", sql=f"WITH {_WINDOWS} SELECT win * 300 AS start_s, n, reuse, recompute, errors, round(reuse / nullif(reuse + recompute, 0), 9) AS reuse_rate FROM w")
def i9_metrics(events):
    return ev.metrics(events).withColumn("reuse_rate", F.round("reuse_rate", 9))


@R.query("events", sql=f"""WITH {_WINDOWS}, b AS (SELECT win, coalesce(reuse / nullif(reuse + recompute, 0) < 0.6, false) AS low FROM w),
g AS (SELECT win, low, sum(CASE WHEN low THEN 1 ELSE 0 END) OVER (ORDER BY win RANGE BETWEEN 1 PRECEDING AND CURRENT ROW) AS k FROM b) SELECT win * 300 AS start_s FROM g WHERE k = 2""")
def i10_alarms(events):
    return ev.alarms(ev.metrics(events), F.col("reuse_rate") < 0.6, periods=2)


@R.query("events", sql="""WITH m AS (SELECT user_id, event_id, event_type, max(CASE WHEN event_type IN ('view', 'click', 'purchase') THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS stage_id FROM {events})
SELECT event_id, stage_id, CASE WHEN event_id % 100 > 10 THEN round(greatest(0.0, least(1.0, (event_id % 70 - 3) / (event_id % 100 - 10))), 9) END AS coverage FROM m WHERE event_type = 'signup'""")
def i2_attach_probes(events):
    k = F.col("event_id")
    return ev.attach_probes(events).withColumn("coverage", F.round(ev.coverage_share(k % 70 - 3, k % 100 - 10), 9))


@R.query("events", sql="""WITH e AS (SELECT user_id AS run_id, concat('s', cast(event_id % 5 AS varchar)) AS stage, event_id AS seq, ts, event_type AS t FROM {events}),
b AS (SELECT run_id, max(seq) AS began FROM e WHERE t = 'signup' AND seq % 3 = 0 GROUP BY 1), r AS (SELECT e.* FROM e LEFT JOIN b USING (run_id) WHERE t <> 'signup' AND seq > coalesce(began, -1))
SELECT run_id, stage, CASE arg_max(t, seq) WHEN 'purchase' THEN 'Planned' WHEN 'view' THEN 'Running' WHEN 'click' THEN 'Succeeded' ELSE 'Failed' END AS status, CASE WHEN arg_max(t, seq) = 'error' THEN concat('E: ', cast(max(seq) AS varchar)) END AS error,
  CASE WHEN arg_max(t, seq) IN ('click', 'error') THEN cast(floor(epoch(arg_max(ts, seq) FILTER (t IN ('click', 'error')))) AS bigint) - cast(floor(epoch(arg_max(ts, seq) FILTER (t = 'view'))) AS bigint) END AS runtime_s FROM r GROUP BY 1, 2""")
def i1_stage_fold(events):
    k, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "purchase", "plan.completed").when(t == "view", "stage.started").when(t == "click", "stage.completed").when(t == "error", "stage.failed").when(k % 3 == 0, "run.started").otherwise("other")
    return ev.stage_status(events.select(F.col("user_id").alias("run_id"), F.concat(F.lit("s"), (k % 5).cast("string")).alias("stage"), k.alias("seq"), kind.alias("type"), "ts", F.lit("E").alias("error_class"), k.cast("string").alias("message")))


@R.query("events", sql="""WITH q AS (SELECT user_id, event_id, event_type, min(CASE WHEN event_type = 'view' THEN event_id END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS reversed_by FROM {events})
SELECT event_id, reversed_by FROM q WHERE event_type = 'error'""")
def i7_quarantine_feed(events):
    return ev.quarantine_feed(events)


@R.query("events", sql="""SELECT user_id, event_type AS status, event_id FROM {events} QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def i1_stage_status(events):
    return ev.latest_status(events)


_CLAIM_KINDS = ["acquired", "heartbeat", "takeover", "contended", "subscribed", "heartbeat", "lease_expired", "heartbeat", "subscribe_completed", "completed", "failed"]
_KIND = "CASE event_id % 11 " + " ".join(f"WHEN {k} THEN 'claim.{v}'" for k, v in enumerate(_CLAIM_KINDS)) + " END"


@R.query("events", sql=f"""WITH RECURSIVE e AS (SELECT user_id AS work_key, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i, epoch_us(ts) AS us, {_KIND} AS t, CASE WHEN event_id % 5 > 0 THEN concat('o', cast(event_id % 7 AS varchar)) END AS owner,
  CASE WHEN event_id % 4 > 0 THEN event_id // 400 - 3 * cast(event_id % 10 = 9 AS bigint) END AS fence, CASE WHEN event_id % 3 = 0 THEN concat('p', cast(event_id % 7 AS varchar)) END AS from_, CASE WHEN event_id % 8 > 1 THEN concat('w', cast(event_id % 3 AS varchar)) END AS worker FROM {{events}}),
f(work_key, i, phase, owner, challenger, fence, beats, anchor) AS (
  SELECT work_key, cast(0 AS bigint), cast('' AS varchar), cast(NULL AS varchar), cast(NULL AS varchar), cast(NULL AS bigint), cast(0 AS bigint), us FROM e WHERE i = 1
  UNION ALL SELECT f.work_key, e.i,
    CASE WHEN e.fence < f.fence THEN f.phase WHEN t = 'claim.heartbeat' THEN CASE f.phase WHEN 'lease_expired' THEN 'owned' ELSE f.phase END WHEN t = 'claim.acquired' THEN 'owned' WHEN t = 'claim.takeover' THEN 'took_over' ELSE substr(t, 7) END,
    CASE WHEN e.fence < f.fence THEN f.owner WHEN t IN ('claim.acquired', 'claim.takeover', 'claim.contended') THEN e.owner WHEN t = 'claim.subscribed' THEN coalesce(e.owner, f.owner) ELSE f.owner END,
    CASE WHEN e.fence < f.fence THEN f.challenger WHEN t = 'claim.acquired' THEN NULL WHEN t = 'claim.takeover' THEN coalesce(from_, f.owner) WHEN t = 'claim.contended' THEN worker WHEN t = 'claim.subscribed' THEN coalesce(f.challenger, worker) ELSE f.challenger END,
    coalesce(greatest(e.fence, f.fence), e.fence, f.fence),
    CASE WHEN e.fence < f.fence THEN f.beats WHEN t IN ('claim.acquired', 'claim.takeover') THEN 0 WHEN t = 'claim.heartbeat' THEN f.beats + 1 ELSE f.beats END,
    CASE WHEN e.fence < f.fence THEN f.anchor WHEN t IN ('claim.acquired', 'claim.takeover', 'claim.contended', 'claim.heartbeat') THEN us ELSE f.anchor END
  FROM f JOIN e ON e.work_key = f.work_key AND e.i = f.i + 1)
SELECT work_key, phase, owner, challenger, fence, beats, anchor FROM f QUALIFY row_number() OVER (PARTITION BY work_key ORDER BY i DESC) = 1""")
def i3_claims_board(events):
    """Claims by user, whose events are of the nine types in turn, some with a fence that is behind."""
    k = F.col("event_id")
    kind = F.get(F.array(*[F.lit(f"claim.{x}") for x in _CLAIM_KINDS]), (k % 11).cast("int"))
    text = lambda p, n: F.concat(F.lit(p), (k % n).cast("string"))
    fence = F.when(k % 4 > 0, F.floor(k / 400) - 3 * (k % 10 == 9).cast("long"))
    claims = events.select(F.col("user_id").alias("work_key"), k.alias("seq"), "ts", kind.alias("type"), F.when(k % 5 > 0, text("o", 7)).alias("owner"), fence.alias("fence"), F.when(k % 3 == 0, text("p", 7)).alias("took_over_from"), F.when(k % 8 > 1, text("w", 3)).alias("worker"))
    return ev.claims_board(claims).withColumn("anchor", F.unix_micros(F.col("anchor").cast("timestamp")))


def _median_sql(seconds: int) -> str:
    return f"""WITH v AS (SELECT epoch_us(ts) // {seconds * 1_000_000} * {seconds} AS start_s, value, row_number() OVER (PARTITION BY epoch_us(ts) // {seconds * 1_000_000} ORDER BY value) AS i, count(*) OVER (PARTITION BY epoch_us(ts) // {seconds * 1_000_000}) AS n FROM {{events}} WHERE event_type = 'signup' AND value IS NOT NULL),
m AS (SELECT start_s, n, value AS exact, CASE WHEN value > 0 THEN cast(ceil(ln(value) / ln(1.01 / 0.99)) AS bigint) END AS bucket FROM v WHERE i = (n + 1) // 2)
SELECT start_s, n, bucket, round(coalesce(2 * power(1.01 / 0.99, bucket) / (1.01 / 0.99 + 1), 0.0), 6) AS value, true AS within FROM m"""


def _measured(found, events, seconds):
    """found, with whether its value is within the stated error of the exact median."""
    rows = events.where((F.col("event_type") == "signup") & F.col("value").isNotNull())
    exact = rows.groupBy(ev.period_start(F.col("ts"), seconds).alias("start_s")).agg(F.expr("percentile_disc(0.5) WITHIN GROUP (ORDER BY value)").alias("exact"))
    return found.join(exact, "start_s").select("start_s", "n", "bucket", F.round("value", 6).alias("value"), (F.abs(F.col("value") - F.col("exact")) <= 0.0100001 * F.col("exact")).alias("within"))


@R.query("events", sql=_median_sql(3600))
def i9_latency_medians(events):
    return _measured(ev.latency_medians(events, "signup", 3600), events, 3600)


@R.query("events", sql=_median_sql(86_400))
def i9_rolled_up_medians(events):
    """Sketches of five minutes, merged to days."""
    fine = ev.quantile_sketch(events.where(F.col("event_type") == "signup").withColumn("start_s", ev.period_start(F.col("ts"), 300)), ["start_s"], F.col("value"))
    days = ev.merge_sketches(fine.withColumn("start_s", F.floor(F.col("start_s") / 86_400) * 86_400), ["start_s"])
    return _measured(ev.sketch_quantile(days, ["start_s"]), events, 86_400)


_ALARMS = [("reuse_rate", "count(*) FILTER (event_type = 'view') / nullif(count(*) FILTER (event_type IN ('view', 'click')), 0)", "v < 0.6", 3, 3600), ("retries", "sum(value) FILTER (event_type = 'purchase')", "v > 50", 2, 3600), ("failures", "count(*) FILTER (event_type = 'error')", "v > 0", 1, 60)]


@R.query("events", sql=" UNION ALL ".join(f"""SELECT '{name}' AS alarm, here * {seconds} AS start_s, round(total, 6) AS value FROM (SELECT here, sum(v) OVER w AS total, count(*) OVER w AS k FROM (SELECT epoch_us(ts) // {seconds * 1_000_000} AS here, {v} AS v FROM {{events}} GROUP BY 1) WHERE {breach} WINDOW w AS (ORDER BY here RANGE BETWEEN {periods - 1} PRECEDING AND CURRENT ROW)) WHERE k = {periods}""" for name, v, breach, periods, seconds in _ALARMS))
def i10_alarm_sums(events):
    kind, v = F.col("event_type"), F.col("value")
    rate = F.try_divide(F.count_if(kind == "view"), F.count_if(kind.isin("view", "click")))
    runs = [("reuse_rate", rate, v < 0.6, 3, 3600), ("retries", F.sum(F.when(kind == "purchase", v)), v > 50, 2, 3600), ("failures", F.count_if(kind == "error").cast("double"), v > 0, 1, 60)]
    found = [ev.alarm_runs(events, value, breach, periods, seconds).select(F.lit(name).alias("alarm"), "start_s", F.round("value", 6).alias("value")) for name, value, breach, periods, seconds in runs]
    return found[0].unionByName(found[1]).unionByName(found[2])
