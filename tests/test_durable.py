"""A map that is killed half-way, and what the next run computes."""

import uuid
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from keepsake.operators import durable, incremental

SCHEMA = "doc_id long, value string"


def rows_of(spark, n=200):
    docs = spark.range(n).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    return incremental.bucketize(docs, "doc_id", 8)


def mapper_of(folder: Path, fails: int | None = None):
    where = str(folder)

    def mapper(row):
        if row["doc_id"] == fails:
            raise RuntimeError("killed")
        with open(f"{where}/{uuid.uuid4().hex}", "w") as f:
            f.write(str(row["doc_id"]))
        return {"doc_id": row["doc_id"], "value": row["text"].upper()}

    return mapper


def computed(folder: Path) -> list[int]:
    return sorted(int(f.read_text()) for f in folder.iterdir())


def result(df):
    return sorted((r.bucket, r.chunk, r.position, r.doc_id, r.value) for r in df.collect())


def test_a_killed_map_goes_on(spark, tmp_path):
    rows, log = rows_of(spark), str(tmp_path / "log")
    seen = [tmp_path / x for x in ("first", "second", "third", "clean")]
    for s in seen:
        s.mkdir()
    run = lambda mapper, where: durable.run_chunks(rows, "text", mapper, SCHEMA, where, "g", waves=4)
    with pytest.raises(Exception, match="killed"):
        run(mapper_of(seen[0], fails=77), log)
    kept = {r.doc_id for r in durable.committed(spark, log, SCHEMA).collect()}
    assert 77 not in kept and 0 < len(kept) < 200
    second = run(mapper_of(seen[1]), log)
    assert computed(seen[1]) == sorted(set(range(200)) - kept)  # only what is missing, each once
    assert {r.doc_id for r in second.where("restored").collect()} == kept
    clean = run(mapper_of(seen[3]), str(tmp_path / "other"))
    assert result(second) == result(clean) and computed(seen[3]) == list(range(200))
    assert result(run(mapper_of(seen[2]), log)) == result(clean) and computed(seen[2]) == []


def test_changed_rows_and_globals_are_computed_again(spark, tmp_path):
    rows, log, seen = rows_of(spark, 100), str(tmp_path / "log"), tmp_path / "seen"
    seen.mkdir()
    quiet = lambda row: {"doc_id": row["doc_id"], "value": row["text"]}
    durable.run_chunks(rows, "text", quiet, SCHEMA, log, "g", waves=2)
    changed = rows.withColumn("text", F.when(F.col("doc_id") == 5, "new").otherwise(F.col("text")))
    out = durable.run_chunks(changed, "text", mapper_of(seen), SCHEMA, log, "g", waves=2)
    assert 5 in computed(seen) and len(computed(seen)) <= 8 and [r.value for r in out.where("doc_id = 5").collect()] == ["NEW"] and out.count() == 100
    assert not durable.run_chunks(rows, "text", quiet, SCHEMA, log, "other", waves=2).where("restored").count()


def test_unmarked_waves_repeats_and_losses(spark, tmp_path):
    rows, log = rows_of(spark, 60), tmp_path / "log"
    quiet = lambda row: {"doc_id": row["doc_id"], "value": row["text"]}
    want = result(durable.run_chunks(rows, "text", quiet, SCHEMA, str(log), "g", waves=1))
    wave = next(log.glob("wave-*"))
    # a second commit of the same chunks changes nothing
    spark.read.parquet(str(wave)).write.parquet(str(log / f"wave-{'f' * 32}"))
    assert result(durable.run_chunks(rows, "text", quiet, SCHEMA, str(log), "g", waves=1)) == want
    # a wave that Spark has not marked as complete is none
    for w in log.glob("wave-*"):
        (w / "_SUCCESS").unlink()
    again = durable.run_chunks(rows, "text", quiet, SCHEMA, str(log), "g", waves=1)
    assert result(again) == want and not again.where("restored").count()
    # a chunk that has lost rows is an error, not a smaller result
    odd = tmp_path / "odd"
    spark.read.parquet(str(wave)).where("doc_id <> 7").write.parquet(str(odd / "wave-0"))
    with pytest.raises(durable.MissingChunks):
        durable.run_chunks(rows, "text", quiet, SCHEMA, str(odd), "g", waves=1)
    assert durable.run_chunks(rows.limit(0), "text", quiet, SCHEMA, str(tmp_path / "none"), "g").count() == 0
