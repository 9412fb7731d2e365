"""Which hashes of a chunk other chunks, or other rows of it, hold too.

Most hashes of a corpus stand in one place only. To find the others, each chunk
sends its distinct hashes once, packed and with its own counts, to the bucket that
the hash belongs to; a bucket counts what meets there and answers each chunk with
its shared hashes. A hash that fills the corpus counts once for each chunk, a
bucket holds about BUCKET hashes for any corpus, and what travels is
COUNTED bytes a hash instead of a row.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Hashes that a chunk and a bucket hold.
CHUNK, BUCKET = 1 << 18, 1 << 21
#: Bytes of a hash that are counted, the high ones; equal ones of different hashes only make a hash look shared.
COUNTED = 6
_DROP = np.uint64(64 - 8 * COUNTED)


class Chunks:
    """Numbers the rows of a task by chunks of about CHUNK hashes."""

    def __init__(self, partition: int):
        self.chunk, self.held = partition << 32, 0

    def of(self, sizes: np.ndarray) -> np.ndarray:
        """The chunk of each row, by its number of hashes."""
        numbers = np.empty(len(sizes), np.int64)
        for k, n in enumerate(sizes.tolist()):
            self.held += n
            numbers[k] = self.chunk
            if self.held >= CHUNK:
                self.chunk, self.held = self.chunk + 1, 0
        return numbers


def counted(hashes: np.ndarray) -> np.ndarray:
    """The part of hashes that is counted, in its place."""
    return hashes >> _DROP << _DROP


def _packed(hashes: np.ndarray) -> bytes:
    return np.ascontiguousarray(hashes.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, 8 - COUNTED :]).tobytes()


def _unpacked(data: list[bytes]) -> np.ndarray:
    flat = np.frombuffer(b"".join(data), np.uint8).reshape(-1, COUNTED)
    whole = np.zeros((len(flat), 8), np.uint8)
    whole[:, 8 - COUNTED :] = flat
    return whole.reshape(-1).view("<u8")


def shared_hashes(rows: DataFrame, total: int, limit: int = 1 << 64) -> DataFrame:
    """(chunk, hashes, levels): the packed hashes below limit of each chunk that stand in several rows, and the levels of their counts.

    rows: (chunk, array of hashes, each once in its row), those of a chunk one after another. total: about how many
    hashes there are in all.
    """
    buckets = max(1, -(-total // BUCKET))
    span, limit = np.uint64(-(-limit >> int(_DROP)) // buckets + 1), np.uint64(limit - 1)

    def send(batches):
        held, chunk = [], None
        for batch in batches:
            flat, ends = batch.column(1).values.to_numpy().view(np.uint64), batch.column(1).offsets.to_numpy()
            for k, c in enumerate(batch.column(0).to_pylist()):
                if c != chunk and held:
                    yield out(chunk, held)
                    held = []
                chunk = c
                held.append(flat[ends[k] : ends[k + 1]])
        if held:
            yield out(chunk, held)

    def out(chunk: int, held: list[np.ndarray]) -> pa.RecordBatch:
        hashes = np.concatenate(held)
        hashes, count = np.unique(hashes[hashes <= limit] >> _DROP, return_counts=True)
        bucket = (hashes // span).astype(np.int64)
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        starts = [0, *cuts.tolist()] if len(hashes) else []
        packed, count = _packed(hashes << _DROP), np.minimum(count, 255).astype(np.uint8).tobytes()
        both = list(zip(starts, [*starts[1:], len(hashes)], strict=True))
        return pa.RecordBatch.from_arrays([pa.array(bucket[starts], pa.int64()), pa.array([chunk] * len(starts), pa.int64()), pa.array([packed[COUNTED * a : COUNTED * b] for a, b in both], pa.binary()), pa.array([count[a:b] for a, b in both], pa.binary())], names=["bucket", "chunk", "hashes", "counts"])

    def count(rows: pa.Table) -> pa.Table:
        data = rows.column("hashes").to_pylist()
        hashes = _unpacked(data)
        of = np.repeat(np.arange(len(data)), [len(x) // COUNTED for x in data])
        _, place = np.unique(hashes, return_inverse=True)
        total = np.bincount(place, weights=np.frombuffer(b"".join(rows.column("counts").to_pylist()), np.uint8))[place]
        several = total > 1
        level = np.minimum(4 * np.log2(total[several]), 255).astype(np.uint8)
        cuts = np.searchsorted(of[several], np.arange(1, len(data)))
        return pa.table({"chunk": rows.column("chunk"), "hashes": pa.array([_packed(x) for x in np.split(hashes[several], cuts)], pa.binary()), "levels": pa.array([x.tobytes() for x in np.split(level, cuts)], pa.binary())})

    sent = rows.mapInArrow(send, "bucket long, chunk long, hashes binary, counts binary")
    return sent.groupBy("bucket").applyInArrow(count, "chunk long, hashes binary, levels binary")


def levels_of(hashes: np.ndarray, answers: pa.Table) -> np.ndarray:
    """The level of each hash of a chunk by its answers (hashes, levels): 0 if no other row holds it, else 4 at least."""
    known = _unpacked(answers.column("hashes").to_pylist())
    order = np.argsort(known, kind="stable")
    known = np.append(known[order], np.uint64(2**64 - 1))
    level = np.append(np.frombuffer(b"".join(answers.column("levels").to_pylist()), np.uint8)[order], np.uint8(0)).astype(np.int64)
    hashes = counted(hashes)
    at = np.searchsorted(known, hashes)
    return np.where(known[at] == hashes, level[at], 0)
