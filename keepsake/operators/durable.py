"""A map over microchunks that survives killed jobs: what has been computed is committed, and only the rest is computed again.

Work is dealt into waves of chunks. A wave is one Spark job that writes its chunks' outputs into a folder of its
own; the folder counts once Spark has marked it as complete, so a wave is committed as a whole or not at
all, and lost executors cost tasks, not waves. The folders are the commit log. A chunk is told by the digest of its
input, so the log serves every later run over the same rows, whatever else has changed, and two
runs at once do no harm: of several commits of a chunk the one with the lowest folder name counts.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType, _parse_datatype_string

from keepsake.functions.scratch import cut
from keepsake.operators.incremental import chunk_digests, microchunks, pending_chunks

_OWN = ["_chunk_key", "_position"]


class MissingChunks(RuntimeError):
    """Chunks that should be there are not, or lack rows."""


def _waves(spark: SparkSession, path: str) -> list[str]:
    """Folders of committed waves."""
    pattern = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/wave-*/_SUCCESS")
    found = pattern.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(pattern)
    return sorted(x.getPath().getParent().toString() for x in found)


def committed(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """(chunk_key, position, wave, columns of schema) of all commits, each chunk from one wave."""
    out = _parse_datatype_string(schema)
    full = StructType([StructField("_chunk_key", StringType()), StructField("_position", LongType()), *out.fields])
    folders = _waves(spark, path)
    if not folders:
        return spark.createDataFrame([], full).select(F.col("_chunk_key").alias("chunk_key"), F.col("_position").alias("position"), F.lit("").alias("wave"), *out.names)
    wave = F.regexp_extract(F.col("_metadata.file_path"), r"(wave-[0-9a-f]+)", 1)
    rows = spark.read.schema(full).parquet(*folders).select(F.col("_chunk_key").alias("chunk_key"), F.col("_position").alias("position"), wave.alias("wave"), *out.names)
    first = rows.groupBy("chunk_key").agg(F.min("wave").alias("_first"))
    return rows.join(first, "chunk_key").where(F.col("wave") == F.col("_first")).drop("_first")


def run_chunks(rows: DataFrame, row_col: str, mapper: Callable[[dict], dict], schema: str, path: str, globals_digest: str, size: int = 8, waves: int = 8) -> DataFrame:
    """(bucket, chunk, position, restored, columns of schema): mapper's output for each of rows, computed where path has no commit of its chunk.

    rows: bucket, id_bytes and what the mapper reads; row_col is the text that a chunk's digest is of, and must tell all that
    the mapper depends on, with globals_digest. The mapper gets one record at a time, so batches cannot change its
    results, and returns one record. A chunk without all its rows at the end raises MissingChunks.
    """
    spark = rows.sparkSession
    out = _parse_datatype_string(schema)
    full = StructType([StructField("_chunk_key", StringType()), StructField("_position", LongType()), *out.fields])

    def in_task(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            made = []
            for r in b.to_dict("records"):
                given = mapper({k: v for k, v in r.items() if k not in _OWN})
                made.append((r["_chunk_key"], r["_position"], *(given[n] for n in out.names)))
            yield pd.DataFrame(made, columns=full.names)

    placed = microchunks(rows, size)
    expected = cut(chunk_digests(placed, row_col, globals_digest).select("bucket", "chunk", "n_rows", "chunk_key"))
    before = cut(committed(spark, path, schema).select("chunk_key").distinct())
    todo = cut(pending_chunks(expected, before, ["chunk_key"]).withColumn("_wave", F.pmod(F.xxhash64("chunk_key"), F.lit(waves))))
    wanted = todo.select("bucket", "chunk", F.col("chunk_key").alias("_chunk_key"), "_wave")
    given = cut(placed.join(wanted, ["bucket", "chunk"]).withColumn("_position", F.col("position").cast("long")).drop("chunk", "position"))
    for w in sorted(r["_wave"] for r in todo.select("_wave").distinct().collect()):
        given.where(F.col("_wave") == w).drop("_wave").mapInPandas(in_task, full).write.parquet(f"{path}/wave-{uuid.uuid4().hex}")
    done = committed(spark, path, schema)
    counts = done.groupBy("chunk_key").agg(F.count(F.lit(1)).alias("_n"))
    missing = expected.join(counts, "chunk_key", "left").where(F.coalesce("_n", F.lit(0)) != F.col("n_rows"))
    if lost := missing.limit(5).collect():
        raise MissingChunks(f"chunks {[(r['bucket'], r['chunk']) for r in lost]} and perhaps others are missing or lack rows")
    old = before.withColumn("restored", F.lit(True))
    return expected.join(done, "chunk_key").join(old, "chunk_key", "left").select("bucket", "chunk", "position", F.coalesce("restored", F.lit(False)).alias("restored"), *out.names)
