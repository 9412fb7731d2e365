"""Incremental keyed map: stable buckets, digests, and recomputing only what changed."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, StringType

from keepsake.functions.canon import FramedDigest, digest_column, number_of, sum_digest

BUCKETS = 64
CHUNK_ROWS = 8
#: Rows whose bytes are copied together for a digest.
FRAMED_ROWS = 64
#: Buckets up to which those to compute are sent to all tasks; the number of buckets is a parameter.
MOST_BROADCAST = 100_000


def id_bytes(id_col: str) -> Column:
    """Canonical text of a typed id: digits for whole numbers, quoted for strings."""
    return F.col(id_col).cast("string")


def bucket_of(id_text: Column, buckets: int = BUCKETS) -> Column:
    """The first eight bytes of sha256 as an unsigned number, modulo the number of buckets."""
    return (number_of(F.sha2(id_text, 256)) % F.lit(buckets)).cast("int")


def typed_ids(raw: Column) -> Column:
    """A JSON id's canonical text, or null for what is neither a string nor a whole number: 7 and "7" differ, true is no id.

    A string's escapes are resolved and written anew, so texts of equal strings are equal; -0 is 0.
    """
    raw = F.trim(raw)
    whole = F.when(raw == "-0", "0").otherwise(raw)
    values = F.from_json(F.concat(F.lit("["), raw, F.lit("]")), "array<string>")
    anew = F.to_json(values)
    return F.when(raw.rlike(r"^-?(0|[1-9][0-9]*)$"), whole).when(raw.startswith('"') & (F.size(values) == 1) & F.get(values, 0).isNotNull(), F.substr(anew, F.lit(2), F.length(anew) - 2))


def validate_ids(rows: DataFrame, id_col: str, line_col: str, raw_col: str | None = None) -> DataFrame:
    """(line, first_line, problem) of missing and of repeated ids, and, of raw_col's JSON texts, of ids of a wrong type (missing: null or "null")."""
    if raw_col is not None:
        rows = rows.withColumn(id_col, typed_ids(F.col(raw_col)))
        lost = F.col(raw_col).isNull() | (F.trim(raw_col) == "null")
        wrong = rows.where(F.col(id_col).isNull() & ~lost).select(F.col(line_col).alias("line"), F.lit(None).cast("long").alias("first_line"), F.lit("type").alias("problem"))
        return wrong.unionByName(validate_ids(rows.where(F.col(id_col).isNotNull() | lost), id_col, line_col))
    missing = rows.where(F.col(id_col).isNull()).select(F.col(line_col).alias("line"), F.lit(None).cast("long").alias("first_line"), F.lit("missing").alias("problem"))
    first = rows.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.min(line_col).cast("long").alias("first_line"), F.count(F.lit(1)).alias("n")).where("n > 1")
    repeated = rows.join(first, id_col).where(F.col(line_col) > F.col("first_line")).select(F.col(line_col).alias("line"), "first_line", F.lit("duplicate").alias("problem"))
    return missing.unionByName(repeated)


def bucketize(rows: DataFrame, id_col: str, buckets: int = BUCKETS) -> DataFrame:
    """rows with id_bytes and bucket; each bucket in one partition, in the order of id_bytes."""
    rows = rows.withColumn("id_bytes", id_bytes(id_col)).withColumn("bucket", bucket_of(F.col("id_bytes"), buckets))
    return rows.repartition(buckets, "bucket").sortWithinPartitions("bucket", "id_bytes")


def multiset_digests(rows: DataFrame, bucket: Column, row_text: Column) -> DataFrame:
    """(bucket, n_rows, digest): an order-free digest that partial aggregation computes, for buckets of any size."""
    return rows.groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("n_rows"), sum_digest("rows", F.sha2(row_text, 256)).alias("digest"))


def slice_digests(bucketed: DataFrame, row_col: str) -> DataFrame:
    """(bucket, n_rows, slice_digest) of bucketize()'s rows: one pass in order over Arrow batches, in constant memory."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, total, n = None, None, 0
        for batch in batches:
            done, buckets = [], batch.column(0).to_numpy()
            texts = pc.fill_null(batch.column(1), "").cast(pa.binary())
            data, ends = memoryview(texts.buffers()[2] or b""), np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
            lengths = np.diff(ends).astype(">u8").tobytes()
            cuts = np.flatnonzero(np.diff(buckets)) + 1
            for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(buckets)], strict=True):
                if len(buckets) and buckets[a] != bucket:
                    if total is not None:
                        done.append((bucket, n, total.hex()))
                    bucket, total, n = int(buckets[a]), FramedDigest("slice", bucket=int(buckets[a])), 0
                # what add() would hash for each row, laid out for a few rows at a time
                for some in range(a, b, FRAMED_ROWS):
                    total.framed(b"".join(x for k in range(some, min(some + FRAMED_ROWS, b)) for x in (lengths[8 * k : 8 * k + 8], data[ends[k] : ends[k + 1]])))
                n += b - a
            yield of(done)
        if total is not None:
            yield of([(bucket, n, total.hex())])

    def of(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.string())], names=["bucket", "n_rows", "slice_digest"])

    return bucketed.select("bucket", F.col(row_col).cast("string").alias("row")).mapInArrow(digest, "bucket int, n_rows long, slice_digest string")


def microchunks(rows: DataFrame, size: int = CHUNK_ROWS) -> DataFrame:
    """rows (bucket, id_bytes, ...) with position in the bucket and chunk number."""
    at = F.row_number().over(Window.partitionBy("bucket").orderBy("id_bytes")) - 1
    return rows.withColumn("position", at).withColumn("chunk", F.floor(F.col("position") / size).cast("int"))


def chunk_digests(chunks: DataFrame, row_col: str, globals_digest: str) -> DataFrame:
    """(bucket, chunk, n_rows, chunk_digest, chunk_key) of microchunks()'s rows: a chunk has CHUNK_ROWS rows at most, so its list is short."""
    listed = F.array_sort(F.collect_list(F.struct("position", F.col(row_col).cast("string").alias("row"))))
    framed = F.concat_ws("|", F.transform(listed, lambda x: F.concat(F.length(F.coalesce(x["row"], F.lit(""))).cast("string"), F.lit(":"), F.coalesce(x["row"], F.lit("")))))
    made = chunks.groupBy("bucket", "chunk").agg(F.count(F.lit(1)).alias("n_rows"), F.sha2(framed, 256).alias("chunk_digest"))
    return made.withColumn("chunk_key", digest_column("chunk", F.lit(globals_digest), F.col("bucket"), F.col("chunk"), F.col("chunk_digest")))


def leaf_keys(slices: DataFrame, globals_digest: str, digest_col: str = "slice_digest") -> DataFrame:
    return slices.withColumn("leaf_key", digest_column("leaf", F.lit(globals_digest), F.col("bucket"), F.col(digest_col)))


def diff_leaves(new: DataFrame, current: DataFrame, key: str = "leaf_key") -> DataFrame:
    """new with action: RESTORE where its key has a current derivation, else COMPUTE."""
    known = current.select(F.col(key).alias("_known")).distinct()
    return new.join(known, F.col(key) == F.col("_known"), "left").withColumn("action", F.when(F.col("_known").isNotNull(), "RESTORE").otherwise("COMPUTE")).drop("_known")


def map_changed(rows: DataFrame, leaves: DataFrame, mapper: Callable, schema: str | None = None, restored: DataFrame | None = None) -> DataFrame:
    """mapper over the rows of leaves to COMPUTE, with what other leaves have restored.

    Without a schema, mapper makes a DataFrame of a DataFrame, so that built-in functions send no row to Python. With
    one, it is as for mapInPandas, whose batches of thousands of long texts fill a worker.
    """
    todo = leaves.where("action = 'COMPUTE'").select("bucket").distinct()
    few = todo.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    changed = rows.join(F.broadcast(todo) if few else todo, "bucket", "left_semi")
    made = mapper(changed) if schema is None else changed.mapInPandas(mapper, schema)
    return made if restored is None else made.unionByName(restored)


def text_for_row(text: Column, canonical: Column) -> Column:
    """A non-empty text, else the row's canonical form."""
    return F.when(F.length(text) > 0, text).otherwise(canonical)


def pending_chunks(expected: DataFrame, committed: DataFrame, keys: list[str]) -> DataFrame:
    return expected.join(committed.select(*keys).distinct(), keys, "left_anti")


def reduce_leaves(outputs: DataFrame, id_col: str = "id_bytes") -> DataFrame:
    """All outputs in one global order of ids."""
    return outputs.orderBy(id_col)


def verify_bijection(inputs: DataFrame, outputs: DataFrame, id_col: str) -> DataFrame:
    """One row: how many ids are missing, extra or repeated in the outputs."""
    a = inputs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_in"))
    b = outputs.groupBy(id_col).agg(F.count(F.lit(1)).alias("n_out"))
    both = a.join(b, id_col, "full")
    return both.agg(F.count_if(F.col("n_out").isNull()).alias("missing"), F.count_if(F.col("n_in").isNull()).alias("extra"), F.count_if(F.col("n_out") > 1).alias("duplicate"))


def merkle_root(leaves: DataFrame, buckets: int, digest_col: str = "slice_digest") -> DataFrame:
    """(complete, root): the digest of all buckets' digests in order; null unless each of 0..buckets-1 is there once."""
    listed = F.array_sort(F.collect_list(F.struct("bucket", F.col(digest_col).alias("d"))))  # at most one entry for each bucket
    grouped = leaves.agg(listed.alias("l"), F.count(F.lit(1)).alias("n"), F.count_distinct("bucket").alias("k"), F.min("bucket").alias("low"), F.max("bucket").alias("high"))
    complete = (F.col("n") == buckets) & (F.col("k") == buckets) & (F.col("low") == 0) & (F.col("high") == buckets - 1)
    text = F.concat_ws(",", F.transform("l", lambda x: F.concat_ws(":", x["bucket"].cast("string"), x["d"])))
    return grouped.select(F.coalesce(complete, F.lit(False)).alias("complete"), F.when(complete, digest_column("root", text)).alias("root"))


def root_summary(leaves: DataFrame) -> DataFrame:
    return leaves.agg(F.sum("n_rows").alias("row_count"), F.count_if(F.col("action") == "RESTORE").alias("reused_leaves"), F.count_if(F.col("action") == "COMPUTE").alias("computed_leaves"))


def changed_buckets(old: DataFrame, new: DataFrame, digest_col: str = "digest") -> DataFrame:
    """(bucket, change) of buckets whose digests differ: added, removed or edited."""
    a, b = (x.select("bucket", F.col(digest_col).alias(n)) for x, n in ((old, "_old"), (new, "_new")))
    both = a.join(b, "bucket", "full").where(~F.col("_old").eqNullSafe(F.col("_new")))
    return both.select("bucket", F.when(F.col("_old").isNull(), "added").when(F.col("_new").isNull(), "removed").otherwise("edited").alias("change"))


def row_digests(rows: DataFrame) -> DataFrame:
    """rows with each text and each binary value as its sha256: narrow rows, equal where the rows are."""
    hashed = [F.unhex(F.sha2(F.col(f"`{f.name}`").cast("binary"), 256)).alias(f.name) if f.dataType in (StringType(), BinaryType()) else F.col(f"`{f.name}`") for f in rows.schema]
    return rows.select(*hashed)


def datasets_equal(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row: rows only in a, rows only in b (with repeats), and whether there are none. Rows meet once, as row_digests()."""
    names = [f"c{k}" for k in range(len(a.columns))]
    both = a.toDF(*names).withColumn("side", F.lit(1)).union(b.toDF(*names).withColumn("side", F.lit(-1)))
    more = row_digests(both).groupBy(*names).agg(F.sum("side").alias("more"))
    counted = more.agg(*[F.coalesce(F.sum(F.greatest(n, F.lit(0))), F.lit(0)).alias(c) for c, n in (("only_a", F.col("more")), ("only_b", -F.col("more")))])
    return counted.select("only_a", "only_b", ((F.col("only_a") == 0) & (F.col("only_b") == 0)).alias("equal"))
