"""Best-two-fit packing of tokenised documents into fixed-length training sequences.

Pieces are dealt at random into groups of about `group_size`, and each group is
packed in one task: fill a sequence greedily with the largest pieces that fit,
then, if a gap is left, take its smallest piece out and put in the two unpacked
pieces that fill the widened gap most tightly. Only a group's last sequence is
short of pieces, so the loss against packing all at once is below one sequence
in each group, whatever the size of the corpus.

Edge cases. Null text counts as empty; an empty document is its end id alone.
A null id is kept. Repeated rows are packed once for each row. An empty table
gives an empty result. Other columns of the input play no part.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, bisect_right, insort

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, text_of
from keepsake.llm.tokens import encoder

CAPACITY = 4096
GROUP_SIZE = 16_384


def token_pieces(docs: DataFrame, tokenizer: str, end_id: int = 1, capacity: int = CAPACITY, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): each document's ids with end_id appended, cut where longer than capacity."""

    def encode(batches):
        for batch in batches:
            doc_id = batch.column(0)
            for first, ids, count in encoder(tokenizer).encode(batch.column(1), end_id):
                n = -(-count // capacity)  # pieces of each document
                doc = np.repeat(np.arange(len(count)), n)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
                start = piece * capacity
                length = np.minimum(count[doc] - start, capacity)
                ends = np.cumsum(length)
                data = memoryview(ids.astype("<u4", copy=False)).cast("B")
                crc = [zlib.crc32(data[4 * (b - k) : 4 * b]) for b, k in zip(ends.tolist(), length.tolist(), strict=True)]
                out = [doc_id.take(pa.array(doc + first)), pa.array(piece.astype(np.int32)), pa.array(start), pa.array(length), pa.array(crc, pa.int64())]
                if with_ids:
                    out.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, names=["doc_id", "piece", "start", "length", "ids_crc32", "ids"][: len(out)])

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    return rows.mapInArrow(encode, "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<int>" * with_ids)


def best_two_fit(lengths: list[int], capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Bin and offset of each length (each from 1 to capacity)."""
    stacks: dict[int, list[int]] = {}
    for i, n in enumerate(lengths):
        stacks.setdefault(n, []).append(i)
    sizes = sorted(stacks)
    bins, offsets = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64)

    def take(n: int) -> int:
        stack = stacks[n]
        i = stack.pop()
        if not stack:
            del stacks[n], sizes[bisect_left(sizes, n)]
        return i

    def put_back(n: int, i: int) -> None:
        if n not in stacks:
            stacks[n] = []
            insort(sizes, n)
        stacks[n].append(i)

    def tightest_two(room: int, least: int) -> tuple[int, int] | None:
        """Sizes a <= b that are at hand, of the largest sum in (least, room]."""
        best, found = least, None
        low, high = 0, bisect_right(sizes, room - 1) - 1
        while low <= high:
            a, b = sizes[low], sizes[high]
            if a + b > room:
                high -= 1
                continue
            if a + b > best and (low < high or len(stacks[a]) > 1):
                best, found = a + b, (a, b)
                if best == room:
                    break
            low += 1
        return found

    number = 0
    while sizes:
        n = sizes[-1]
        filled, gap = [(n, take(n))], capacity - n
        while gap and sizes and sizes[0] <= gap:
            n = sizes[bisect_right(sizes, gap) - 1]
            filled.append((n, take(n)))
            gap -= n
        if gap and sizes:
            n, i = filled[-1]  # pieces went in by falling size
            if two := tightest_two(gap + n, n):
                filled[-1:] = [(k, take(k)) for k in two]
                put_back(n, i)
        at = 0
        for n, i in filled:
            bins[i], offsets[i] = number, at
            at += n
        number += 1
    return bins, offsets


def pack(pieces: DataFrame, capacity: int = CAPACITY, group_size: int = GROUP_SIZE) -> DataFrame:
    """pieces (with a column length from 1 to capacity) with sequence_id and offset.

    A piece of full length is a sequence of its own. Sequence ids are distinct
    numbers without other meaning.
    """
    with Scratch(pieces.sparkSession) as tmp:
        pieces = tmp.result(pieces.withColumn("_row", F.monotonically_increasing_id()), "pieces")
    short = pieces.where(F.col("length") < capacity)
    groups = max(1, -(-short.count() // group_size))
    columns = [c for c in pieces.columns if c != "_row"]
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema if f.name != "_row"] + ["sequence_id long", "offset long"])

    def in_task(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("_row")
        bins, offsets = best_two_fit(rows["length"].tolist(), capacity)
        return rows[columns].assign(sequence_id=key[0] * (1 << 32) + bins, offset=offsets)

    group = F.pmod(F.xxhash64("_row"), F.lit(groups)).alias("_group")
    packed = short.groupBy(group).applyInPandas(in_task, schema)
    full = pieces.where(F.col("length") >= capacity).select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    return packed.unionByName(full)
