"""Token ids in ORC: documents in ascending id order, for pruned and parallel reads.

ORC stores the ids with integer run-length encoding in stripes that Spark reads
in parallel; row indexes and Bloom filters on doc_id let a reader skip stripes
and row groups. Each file holds one range of ids.

Edge cases. Null text counts as empty (its end id alone). Null ids come first.
Rows that share an id stand in the order of their texts. An empty table
gives an empty folder, read as no rows. Other input columns play no part.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, text_of
from keepsake.llm.tokens import encoder

SCHEMA = "doc_id long, ids array<int>"
STRIPE_BYTES = 16 << 20
ROW_INDEX_STRIDE = 5_000


def write_token_file(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encode every text, append end_id, and write (doc_id, ids) in ascending doc_id order."""

    def encode(batches):
        for batch in batches:
            for first, ids, count in encoder(tokenizer).encode(batch.column(1), end_id):
                offsets = pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(count)), pa.ListArray.from_arrays(offsets, pa.array(ids.astype(np.int32)))], names=["doc_id", "ids"])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    with Scratch(docs.sparkSession):
        writer = ordered.mapInArrow(encode, SCHEMA).write.option("orc.stripe.size", STRIPE_BYTES).option("orc.row.index.stride", ROW_INDEX_STRIDE)
        writer.option("orc.bloom.filter.columns", "doc_id").option("compression", "zstd").orc(path)


def read_token_file(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """(doc_id, ids); with doc_ids, only these, found by file statistics, row indexes and Bloom filters."""
    rows = spark.read.schema(SCHEMA).orc(path)
    return rows if doc_ids is None else rows.where(F.col("doc_id").isin(doc_ids))


def token_index(spark: SparkSession, path: str) -> DataFrame:
    """For each document of a token file: (doc_id, start, n_tokens, ids_crc32), from what the files hold, in their order.

    A file is read in parts by several tasks; a row's place is that of its part and its number there.
    """

    def digest(batches):
        last, seen = None, 0
        for batch in batches:
            lists = batch.column(3)
            block = np.stack([batch.column(0).to_numpy(), batch.column(1).to_numpy()])
            begins = np.flatnonzero((np.diff(block, axis=1) != 0).any(axis=0)) + 1 if len(batch) else []
            # numbers from the last change of file or part on; the first rows go on where the batch before has ended
            starts = np.concatenate([[0], begins]).astype(np.int64)
            places = np.arange(len(batch)) - np.repeat(starts, np.diff(np.append(starts, len(batch))))
            if len(batch):
                places[: starts[1] if len(starts) > 1 else None] += seen if last == tuple(block[:, 0]) else 0
                last, seen = tuple(block[:, -1]), int(places[-1]) + 1
            ends = lists.offsets.to_numpy().astype(np.int64)
            data = memoryview(np.ascontiguousarray(lists.values.to_numpy()).astype("<i4", copy=False)).cast("B")
            crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(places, pa.int64()), pa.array(np.diff(ends)), pa.array(crc, pa.int64())], names=["file", "part", "doc_id", "place", "n_tokens", "ids_crc32"])

    rows = read_token_file(spark, path).select(F.xxhash64("_metadata.file_name").alias("file"), F.col("_metadata.file_block_start").alias("part"), "doc_id", "ids")
    # the files are read once, into a narrow table
    with Scratch(spark) as tmp:
        rows = tmp.result(rows.mapInArrow(digest, "file long, part long, doc_id long, place long, n_tokens long, ids_crc32 long"), "tokens")
    # one row for each file: a running sum over these gives the ids before each file
    files = rows.groupBy("file").agg(F.sum("n_tokens").alias("_sum"), F.min("doc_id").alias("_least"), F.count_if(F.col("doc_id").isNull()).alias("_nulls"))
    before = Window.orderBy(F.col("_nulls") == 0, "_least", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("file").orderBy("part", "place").rowsBetween(Window.unboundedPreceding, -1)
    return rows.join(files, "file").select("doc_id", (F.col("_before") + F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).alias("start"), "n_tokens", "ids_crc32")
