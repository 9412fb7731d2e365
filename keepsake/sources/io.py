"""Sources and sinks: JSON lines, snapshots, features, event logs and content-addressed files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EVENT_SCHEMA = "version int, type string, timestamp string, run_id string, payload string"


def read_jsonl(spark: SparkSession, path: str, id_field: str) -> DataFrame:
    """(line, id, raw): lines that are not blank, with the id as canonical text (numbers bare, strings quoted); raw is kept."""
    rows = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("line"), F.col("value").alias("raw"))
    value = F.get_json_object("raw", f"$.{id_field}")
    quoted = F.col("raw").rlike(rf'"{id_field}"\s*:\s*"')
    return rows.select("line", F.when(quoted, F.to_json(F.array(value)).substr(F.lit(2), F.length(F.to_json(F.array(value))) - 2)).otherwise(value).alias("id"), "raw")


def write_jsonl(df: DataFrame, path: str, id_col: str, line_col: str) -> None:
    """One line for each row, in the order of ids over all part files."""
    df.select(id_col, line_col).repartitionByRange(id_col).sortWithinPartitions(id_col).select(F.col(line_col).alias("value")).write.text(path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text", "cast(target as int) target", "cast(target_name as string) target_name")


def write_features(df: DataFrame, path: str, dim: int) -> None:
    """(doc_id, embedding) as Parquet; a vector of another length fails the write."""
    checked = F.when(F.size("embedding") == dim, F.col("embedding").cast("array<float>")).otherwise(F.raise_error(F.lit(f"embedding is not of dimension {dim}")))
    df.select(F.col("doc_id").cast("bigint").alias("doc_id"), checked.alias("embedding")).write.parquet(path)


def read_features(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("doc_id bigint, embedding array<float>").parquet(path)


def events_of(lines: DataFrame) -> DataFrame:
    """Events from a column value of JSON texts; what is not JSON becomes type null with its text in raw."""
    parsed = F.from_json("value", EVENT_SCHEMA, {"mode": "PERMISSIVE"})
    return lines.select(F.col("value").alias("raw"), parsed.alias("e")).select("raw", "e.version", "e.type", F.to_timestamp("e.timestamp").alias("ts"), "e.run_id", "e.payload")


def read_events(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """The event log as a table, or as a stream of new files."""
    return events_of(spark.readStream.text(path) if streaming else spark.read.text(path))


def read_companion_log(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Rows of a JSON-lines log; lines that do not parse are skipped."""
    return spark.read.text(path).select(F.from_json("value", schema, {"mode": "PERMISSIVE"}).alias("r")).where("r is not null").select("r.*").dropna("all")


def publish_content(rows: DataFrame, root: str, existing: DataFrame | None = None) -> DataFrame:
    """Append (digest, content) under root, partitioned by the digest's first byte, once for each digest; returns what was new.

    Rows whose content does not hash to their digest fail the job.
    """
    digest = F.sha2("content", 256)
    checked = rows.withColumn("digest", F.when(F.col("digest") == digest, F.col("digest")).otherwise(F.raise_error(F.lit("content does not match its digest"))))
    new = checked.dropDuplicates(["digest"])
    if existing is not None:
        new = new.join(existing.select("digest"), "digest", "left_anti")
    new = new.select("digest", "content", F.length("content").alias("size"), F.substring("digest", 1, 2).alias("shard"))
    new.write.mode("append").partitionBy("shard").parquet(root)
    return new


def verify_content(manifest: DataFrame, stored: DataFrame) -> DataFrame:
    """(digest, status) of manifest rows (digest, size): ok, unavailable, or mismatch in digest or size."""
    found = stored.select("digest", F.sha2("content", 256).alias("_d"), F.length("content").alias("_s"))
    rows = manifest.join(found, "digest", "left")
    return rows.select("digest", F.when(F.col("_d").isNull(), "unavailable").when((F.col("_d") != F.col("digest")) | (F.col("_s") != F.col("size")), "mismatch").otherwise("ok").alias("status"))
