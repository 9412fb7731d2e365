"""Logical tables as projections of the given ones, in one SQL text for Spark and DuckDB."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from keepsake.functions.tasks import dealt

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def _by(column: str, *values: str) -> str:
    return f"CASE {column} % {len(values)} " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in enumerate(values)) + " END"


_STAGES = ("env", "dataset", "features", "checkpoint", "eval")

#: Each text reads {tables} or earlier fixtures; sha(x) stands for the hexadecimal sha256 of a text.
FIXTURES: dict[str, Callable[[Callable[[str], str]], str]] = {
    "decisions": lambda sha: f"""SELECT event_id AS decision_id,
  CASE WHEN event_id % 50 = 0 THEN concat('race-', cast(event_id AS string)) ELSE {sha("cast(user_id AS string)")} END AS work_key,
  {_by("event_id", *_STAGES)} AS stage,
  CASE event_type WHEN 'view' THEN 'REUSE' WHEN 'click' THEN 'RECOMPUTE' WHEN 'purchase' THEN 'SUBSCRIBE' WHEN 'signup' THEN 'RESUME' ELSE 'REFUSE_DOOMED' END AS action,
  CASE event_type WHEN 'view' THEN 'reuse' WHEN 'click' THEN 'recompute' WHEN 'purchase' THEN 'subscribed' WHEN 'signup' THEN 'resumed' ELSE 'refused' END AS verdict,
  CASE WHEN event_type = 'view' AND event_id % 40 <> 0 THEN 'identity' END AS authorized_by,
  CASE WHEN event_type IN ('view', 'click') AND event_id % 3 <> 0 THEN concat('a', cast(event_id % 200 AS string)) END AS candidate_artifact_id,
  cast(floor(value * 10) AS bigint) AS latency_ms, ts AS created_at FROM {{events}}""",
    "artifacts": lambda sha: f"""SELECT concat('a', cast(p_partkey AS string)) AS artifact_id, p_partkey AS k, {_by("p_partkey", *_STAGES)} AS stage,
  CASE WHEN p_partkey % 11 = 0 THEN concat('s3://test/', cast(p_partkey AS string)) ELSE concat('s3://lake/', cast(p_partkey AS string)) END AS s3_uri,
  cast(floor(p_retailprice * 100) AS bigint) AS size_bytes, (p_partkey * 37) % 100000 AS duration_ms, cast(2.0 AS double) AS vcpu, cast(4096 AS double) AS mem_mib, p_partkey AS created_at FROM {{part}}""",
    "artifact_inputs": lambda sha: f"""SELECT concat('a', cast(p_partkey AS string)) AS artifact_id, 'upstream' AS kind, concat('a', cast(cast(floor((p_partkey - 1) / 2) AS bigint) AS string)) AS ref,
  {sha("concat('a', cast(cast(floor((p_partkey - 1) / 2) AS bigint) AS string))")} AS digest FROM {{part}} WHERE p_partkey > 0""",
    "claims": lambda sha: """SELECT o_orderkey AS work_key, CASE o_orderstatus WHEN 'F' THEN 'SUCCEEDED' WHEN 'O' THEN 'RUNNING' ELSE 'CLAIMED' END AS state, o_custkey AS owner_id, 1 + o_orderkey % 4 AS fence,
  o_orderdate + INTERVAL 45 SECOND AS lease_expires_at, CASE WHEN o_orderkey % 20 = 0 THEN 'race_test' ELSE 'map' END AS stage, o_orderdate AS claimed_at FROM {orders}""",
    "fragments": lambda sha: """SELECT l_orderkey AS work_key, l_linenumber AS fragment_index, min(l_partkey) AS part, cast(floor(min(l_extendedprice)) AS bigint) AS duration_ms, min(l_shipdate) AS created_at
  FROM {lineitem} GROUP BY l_orderkey, l_linenumber""",
    "transfers": lambda sha: """SELECT work_key, fence - 1 AS from_fence, fence AS to_fence, CASE WHEN work_key % 2 = 0 THEN 'lease_expired' ELSE 'prior_terminal' END AS reason FROM {claims} WHERE fence > 1""",
    "commits": lambda sha: """SELECT l_orderkey AS work_key, l_linenumber AS chunk, l_partkey AS input, l_suppkey AS blob, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey, l_suppkey, l_extendedprice, l_quantity) AS attempt FROM {lineitem}""",
    "signatures": lambda sha: f"""SELECT vec_id AS signature_id, {_by("label", *_STAGES)} AS stage, {_by("label", "ShapeError", "OutOfMemory", "Timeout")} AS error_class, embedding, label AS num_labels, 32 * (1 + vec_id % 3) AS batch_size,
  {_by("vec_id", "small", "large")} AS instance_kind, {_by("vec_id", "2.1", "2.2")} AS framework_version, vec_id AS created_at FROM {{embeddings}}""",
    "remediations": lambda sha: """SELECT vec_id AS remediation_id, vec_id AS signature_id, 'train.num_labels' AS changed_key, CASE WHEN vec_id % 10 = 0 THEN label + 1 ELSE label END AS from_value, label + 1 AS to_value, vec_id % 4 = 0 AS succeeded, vec_id AS created_at
  FROM {embeddings} WHERE vec_id % 2 = 0""",
    "scores": lambda sha: """SELECT vec_id, label AS y, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS yhat FROM {embeddings}""",
    "mutated": lambda sha: """SELECT doc_id, CASE WHEN doc_id % 97 = 0 THEN concat(text, ' changed') ELSE text END AS text, lang, source, n_chars FROM {documents} WHERE doc_id % 101 <> 5""",
    "snapshot": lambda sha: """SELECT d.doc_id, d.text, coalesce(l.quality, 0) AS target FROM {documents} d LEFT JOIN {labels} l ON d.doc_id = l.doc_id""",
}

#: Tables whose rows a fixture's window sorts, and the one of its keys that deals them out; joins by it later need no other shuffle.
SORTED = {"commits": {"lineitem": "l_orderkey"}}


def _needs(text: str) -> list[str]:
    return list(dict.fromkeys(re.findall(r"\{(\w+)\}", text)))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table or a fixture over it."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    text = FIXTURES[name](lambda x: f"sha2({x}, 256)")
    keys, given = SORTED.get(name, {}), {n: load(spark, sf_dir, n) for n in _needs(text)}
    return spark.sql(text, **{n: dealt(df, keys[n]) if n in keys else df for n, df in given.items()})


def duckdb_sql(body: str) -> str:
    """body with the fixtures that it names in {braces} put before it."""
    order: list[str] = []

    def add(name: str) -> None:
        if name in FIXTURES and name not in order:
            for n in _needs(FIXTURES[name](lambda x: x)):
                add(n)
            order.append(name)

    for n in _needs(body):
        add(n)
    plain = lambda s: re.sub(r"\{(\w+)\}", r"\1", s)
    with_ = ",\n".join(f"{n} AS ({plain(FIXTURES[n](lambda x: f'sha256({x})'))})" for n in order)
    body = plain(body).strip()
    if not with_:
        return body
    if re.match(r"WITH RECURSIVE\b", body):
        return f"WITH RECURSIVE {with_},\n{body[len('WITH RECURSIVE') :]}"
    return f"WITH {with_},\n{body[4:]}" if re.match(r"WITH\b", body) else f"WITH {with_}\n{body}"
