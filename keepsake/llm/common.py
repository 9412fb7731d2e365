"""What the corpus operators share: scratch tables, size-checked broadcasts, text hashing.

Row identity. A document row is identified by its id together with a hash of its
text, both null-safe, so repeated rows get the same decision and rows that share
an id but not a text stay apart.
"""

from __future__ import annotations

import re
import sys
import tempfile
import threading
import types
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes that a size-checked broadcast may have, by its number of rows and the width of its fixed-size columns.
BROADCAST_BYTES = 24 << 20


#: Rows and bytes of what is sent to Python at a time.
ARROW_BATCH = {"spark.sql.execution.arrow.maxRecordsPerBatch": "1000", "spark.sql.execution.arrow.maxBytesPerBatch": str(4 << 20)}


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or one of our own on a master that runs in this process."""
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if where is None:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        where = tempfile.mkdtemp(prefix="keepsake-")
        spark.conf.set("spark.checkpoint.dir", where)
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(where)
    return where.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    path = spark._jvm.org.apache.hadoop.fs.Path(path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


class Scratch:
    """Tables in the shared folder that one piece of work owns; they are deleted when its with-block ends.

    They cut lineage and survive lost executors. What a lazy result still reads
    is written with result() instead: such tables are narrow, and stay until
    drop_results().
    """

    def __init__(self, spark: SparkSession):
        self.spark, self.path, self.tables = spark, f"{shared_dir(spark)}/keepsake-work-{uuid.uuid4().hex}", 0
        self.broadcasts: list = []
        self.bucketed: list[str] = []

    def __enter__(self) -> Scratch:
        # texts travel to Python in small batches here, for the memory of executors; the first to open sets that, the last to close ends it
        with _lock:
            if not _open:
                _settings.update({k: self.spark.conf.get(k, None) for k in ARROW_BATCH})
                for k, v in ARROW_BATCH.items():
                    self.spark.conf.set(k, v)
            _open.add(self.path)
        return self

    def __exit__(self, *_) -> None:
        with _lock:
            _open.discard(self.path)
            if not _open:
                for k, v in _settings.items():
                    self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        for x in self.broadcasts:
            x.destroy()
        for name in self.bucketed:
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        delete(self.spark, self.path)

    def _written(self, df: DataFrame, path: str) -> DataFrame:
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def save(self, df: DataFrame, name: str) -> DataFrame:
        """df, written and read again."""
        self.tables += 1
        return self._written(df, f"{self.path}/{self.tables}-{name}")

    def save_bucketed(self, df: DataFrame, name: str, key: str) -> DataFrame:
        """df, written in as many buckets of key as there are shuffle partitions: work by key needs no shuffle of it."""
        self.tables += 1
        table = f"keepsake_{uuid.uuid4().hex}"
        self.bucketed.append(table)
        n = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        df.write.bucketBy(n, key).option("path", f"{self.path}/{self.tables}-{name}").option("compression", "zstd").saveAsTable(table)
        return self.spark.table(table)

    def result(self, df: DataFrame, name: str) -> DataFrame:
        """df, written where it outlives this scratch space."""
        path = f"{shared_dir(self.spark)}/keepsake-result-{uuid.uuid4().hex}-{name}"
        _results.setdefault(self.spark.sparkContext.applicationId, []).append(path)
        return self._written(df, path)

    def broadcast(self, value):
        """A value of plain arrays for all executors, which goes with the scratch space."""
        self.broadcasts.append(self.spark.sparkContext.broadcast(value))
        return self.broadcasts[-1]


#: Scratch spaces that are open, and the session's own settings meanwhile.
_open: set[str] = set()
_settings: dict[str, str | None] = {}
_lock = threading.Lock()

#: Paths of result tables by application, for drop_results() alone.
_results: dict[str, list[str]] = {}


def drop_results(spark: SparkSession) -> None:
    """Delete the result tables of this application; frames that operators have returned can't be read any more."""
    for path in _results.pop(spark.sparkContext.applicationId, []):
        delete(spark, path)


def small_or_not(df: DataFrame, most: int = BROADCAST_BYTES) -> DataFrame:
    """Mark a saved table of fixed-size columns for broadcast if it is small; a larger one is joined by a shuffle."""
    rows = most // (16 + 8 * len(df.columns))
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def text_of(column: str) -> Column:
    """The text as a string; null counts as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def keep_in_worker(name: str, make):
    """A value made once in each Python worker process."""
    state = sys.modules.setdefault("_keepsake_worker", types.ModuleType("_keepsake_worker"))
    if not hasattr(state, name):
        setattr(state, name, make())
    return getattr(state, name)


# --- hashing of words in Arrow text columns, without a Python loop over words

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
#: Bytes that are hashed at a time; a longer text is one chunk of its own.
CHUNK_BYTES = 1 << 19


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A bijection of 64-bit values that spreads all bits."""
    with np.errstate(over="ignore"):
        x = x + np.uint64((0x632BE59BD9B4E019 * (seed + 1)) & (2**64 - 1))
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def byte_values(fold_case: bool) -> np.ndarray:
    """A random value for each byte; with fold_case, A-Z share those of a-z."""
    values = mix(np.arange(256, dtype=np.uint64), 77)
    if fold_case:
        values[65:91] = values[97:123]
    return values


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    def make():
        with np.errstate(over="ignore"):
            return [np.concatenate([[np.uint64(1)], np.cumprod(np.full(size, b, np.uint64))]) for b in (_BASE, _INVERSE)]

    size = max(n, CHUNK_BYTES + 1)
    if n <= CHUNK_BYTES + 1:
        return tuple(keep_in_worker("powers", make))
    return tuple(make())


def slices(texts: pa.Array, size: int):
    """(first row, texts without nulls) in stretches of about size bytes; a longer text is a stretch of its own.

    Memory that the stretch before has taken is given back.
    """
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + size, "right")))
        yield first, pc.fill_null(texts.slice(first, last - first), pa.scalar("", texts.type))
        pa.default_memory_pool().release_unused()
        first = last


def chunks(texts: pa.Array):
    """(first row, last row, bytes, end of each row's text) of texts that each got a final line feed, in pieces of about CHUNK_BYTES."""
    text = lambda x: pa.scalar(x, texts.type)
    for first, some in slices(texts, CHUNK_BYTES):
        some = pc.binary_join_element_wise(some, text("\n"), text(""))
        n = len(some)
        ends = np.frombuffer(some.buffers()[1], np.int64 if pa.types.is_large_string(some.type) else np.int32).astype(np.int64)[some.offset : some.offset + n + 1]
        yield first, first + n, np.frombuffer(some.buffers()[2], np.uint8)[ends[0] : ends[-1]], ends[1:] - ends[0]


class Substrings:
    """64-bit hashes of any stretches of a sequence, in constant time each. values: a random 64-bit number for each item."""

    def __init__(self, values: np.ndarray):
        power, self.inverse = _powers(len(values))
        with np.errstate(over="ignore"):
            self.sums = np.concatenate([[np.uint64(0)], np.cumsum(values * power[: len(values)])])

    def hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix((self.sums[end] - self.sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def split_changed(docs: DataFrame, removed: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """docs that removed (doc_id, hash, gone) does not name, and the others with their gone. removed is saved and has a row for each document.

    Only documents that change are shuffled together with what they lose.
    """
    ids = small_or_not(removed.select("doc_id", "hash"))
    named = docs.select(F.col(id_col).cast("long").alias("_doc"), F.xxhash64(text_of(text_col)).alias("_hash"), F.struct("*").alias("_row"))
    on = lambda left, right: left["_doc"].eqNullSafe(right["doc_id"]) & (left["_hash"] == right["hash"])
    changed = named.join(ids, on(named, ids), "left_semi")
    return named.join(ids, on(named, ids), "left_anti").select("_row.*"), changed.join(removed, on(changed, removed)).select("_row", "gone")


SPACES = np.zeros(256, bool)
SPACES[[0x20, 9, 10, 11, 12, 13]] = True


def runs(member: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edge = np.diff(np.concatenate([[0], member.view(np.int8), [0]]))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def rolling(hashes: np.ndarray, width: int, seed: int = 0) -> np.ndarray:
    """Hash of each run of width consecutive values."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(n, np.uint64)
        for j in range(width):
            total += hashes[j : j + n] * (mix(np.array([1000 * seed + j], np.uint64), 5)[0] | np.uint64(1))
    return mix(total, seed)
