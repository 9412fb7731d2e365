"""Fill-in-middle transformation: documents cut at two token boundaries and laid out for infilling.

A text is cut into units, each a word with the white space before it; white space
that ends a text is a unit of its own. The ends of units, in code points, are kept in a
BoundarySet: one container for each 65,536 offsets, held as a sorted array, a
bitmap or runs, whichever is smallest, with the cardinalities before each container.
A cut after k units is select(k - 1): a search for the container, then a
select inside it.

Where to cut and how to lay out follows from a hash of a seed and the document's id,
so every run and every layout of the table gives the same result. A text without
units, one that holds a marker, and the share that is not drawn stay plain. restore()
rebuilds the exact text.

Edge cases. Null text counts as empty; an empty text is plain with no units. A null
id hashes like an empty one. Repeated rows get the same cut; rows that share an
id but not a text share the draws. An empty table gives an empty result. Texts
of any length are cut whole. Input columns of any name are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from keepsake.llm.common import slices, text_of

SEED = 42
#: Percent of documents that are transformed, and of these the percent that get the order suffix, prefix, middle.
FIM_PERCENT, SPM_PERCENT = 50, 80
#: What stands before prefix, suffix and middle.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_SLICE = 1 << 20


class ArrayContainer:
    """Sorted 16-bit values."""

    def __init__(self, low: np.ndarray):
        self.low = low.astype(np.uint16)

    def select(self, k: int) -> int:
        return int(self.low[k])


class BitmapContainer:
    """65,536 bits, with the number of bits set before each 64-bit word."""

    def __init__(self, low: np.ndarray):
        bits = np.zeros(1 << 16, np.uint8)
        bits[low] = 1
        self.words = np.packbits(bits, bitorder="little").view("<u8")
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])

    def select(self, k: int) -> int:
        w = int(np.searchsorted(self.before, k, "right")) - 1
        inside = np.flatnonzero(np.unpackbits(self.words[w : w + 1].view(np.uint8), bitorder="little"))
        return w * 64 + int(inside[k - self.before[w]])


class RunContainer:
    """Starts of runs, with the number of values before each run."""

    def __init__(self, starts: np.ndarray, lengths: np.ndarray):
        self.starts, self.before = starts.astype(np.uint16), np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])

    def select(self, k: int) -> int:
        r = int(np.searchsorted(self.before, k, "right")) - 1
        return int(self.starts[r]) + k - int(self.before[r])


def container(low: np.ndarray) -> ArrayContainer | BitmapContainer | RunContainer:
    """The smallest container of sorted distinct values below 65,536: 2 bytes a value, 8 KiB, or 4 bytes a run."""
    first = np.flatnonzero(np.diff(low, prepend=-2) != 1)
    array, runs = 2 * len(low), 4 * len(first)
    if runs < min(array, 1 << 13):
        return RunContainer(low[first], np.diff(first, append=len(low)))
    return ArrayContainer(low) if array <= 1 << 13 else BitmapContainer(low)


class BoundarySet:
    """A compressed set of offsets that answers select."""

    def __init__(self, offsets: np.ndarray):
        """offsets: sorted and distinct."""
        high = offsets >> 16
        self.keys, first = np.unique(high, return_index=True)
        self.containers = [container(x & 0xFFFF) for x in np.split(offsets, first[1:])] if len(offsets) else []
        self.before = np.append(first, len(offsets))

    def __len__(self) -> int:
        return int(self.before[-1])

    def select(self, k: int) -> int:
        """The k-th smallest offset, from 0."""
        c = int(np.searchsorted(self.before, k, "right")) - 1
        return (int(self.keys[c]) << 16) + self.containers[c].select(k - int(self.before[c]))


def unit_ends(text: str) -> np.ndarray:
    """Offsets, in code points, after each unit of text."""
    points = np.frombuffer(text.encode("utf-32-le"), "<u4")
    space = (points == 0x20) | ((points >= 9) & (points <= 13))
    ends = np.flatnonzero(~space & np.append(space[1:], True)) + 1
    return np.append(ends, len(points)) if len(points) and space[-1] else ends


def cut(text: str, draws: tuple[int, int, int, int], fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix and of the middle, output) of one text."""
    ends = BoundarySet(unit_ends(text))
    n = len(ends)
    if not n or draws[2] % 100 >= fim_percent or PREFIX in text or SUFFIX in text or MIDDLE in text:
        return n, "plain", None, None, text
    a, b = sorted(ends.select(k - 1) if k else 0 for k in (draws[0] % (n + 1), draws[1] % (n + 1)))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if draws[3] % 100 < spm_percent:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def draws_of(id_col: str, seed: int = SEED) -> Column:
    """Four unsigned 32-bit numbers from the sha256 of seed:id."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)])


def transform(docs: DataFrame, columns: list[str], id_col: str = "doc_id", text_col: str = "text", seed: int = SEED, fim_percent: int = FIM_PERCENT, spm_percent: int = SPM_PERCENT) -> DataFrame:
    """(_row: struct of columns, n, form: plain, psm or spm, prefix_chars, middle_chars, output) for each document."""

    def in_task(batches):
        for batch in batches:
            for first, texts in slices(batch.column(1), _SLICE):
                draws = batch.column(2).slice(first, len(texts)).to_pylist()
                made = [cut(t, d, fim_percent, spm_percent) for t, d in zip(texts.to_pylist(), draws, strict=True)]
                out = [pa.array(x, kind) for x, kind in zip(zip(*made, strict=True), (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), *out], names=["_row", "n", "form", "prefix_chars", "middle_chars", "output"])

    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), text_of(text_col).alias("_text"), draws_of(id_col, seed).alias("_draws"))
    fields = [("n", LongType()), ("form", StringType()), ("prefix_chars", LongType()), ("middle_chars", LongType()), ("output", StringType())]
    return rows.mapInArrow(in_task, StructType([rows.schema["_row"], *[StructField(*f) for f in fields]]))


def restore(form: Column, output: Column) -> Column:
    """The exact text from an output and its form; a cut text holds no marker, so each marker stands once."""
    part = F.split(output, f"{PREFIX}|{SUFFIX}|{MIDDLE}", -1)
    return F.when(form == "psm", F.concat(part[1], part[3], part[2])).when(form == "spm", F.concat(part[2], part[3], part[1])).otherwise(output)


def oracle(table: str = "documents") -> str:
    """The registered query's result in DuckDB SQL."""
    draw = lambda k: f"cast(concat('0x', substr(h, {8 * k + 1}, 8)) AS ubigint)"
    return rf"""
WITH hashed AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS u, sha256(concat('{SEED}:', cast(doc_id AS string))) AS h FROM {table}),
drawn AS (SELECT doc_id, t, u, len(u) AS n, cast({draw(0)} % (len(u) + 1) AS bigint) AS k1, cast({draw(1)} % (len(u) + 1) AS bigint) AS k2, {draw(2)} % 100 AS p, {draw(3)} % 100 AS q FROM hashed),
cuts AS (SELECT doc_id, t, n, CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR p >= {FIM_PERCENT} THEN 'plain' WHEN q < {SPM_PERCENT} THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:least(k1, k2)], '') AS a, array_to_string(u[least(k1, k2) + 1:greatest(k1, k2)], '') AS b, array_to_string(u[greatest(k1, k2) + 1:], '') AS c FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(a) END AS prefix_chars, CASE WHEN form <> 'plain' THEN length(b) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN concat('{PREFIX}', a, '{SUFFIX}', c, '{MIDDLE}', b) ELSE concat('{SUFFIX}', c, '{PREFIX}', a, '{MIDDLE}', b) END) AS output_sha256, sha256(t) AS restored_sha256
FROM cuts
"""
