"""Filter interaction audit: what each of five filters removes, in every order in which they could run.

A document's truth table is a 32-bit survival word: bit S is set if the document
passes all filters of the subset S. Words are counted by position for
each part and label: carry-save adders turn three words of one weight into one of the same
and one of the double weight until one word of each weight is left, so 32 counters
advance with a few bitwise operations on whole arrays. The counts of survivors of
the 32 subsets give every figure of all 120 orders.

The counts are added up in tasks and merged by sums; the only other shuffles are of
narrow rows: digests of texts with their smallest id, and labels by id where
these are too large for a broadcast.

Edge cases. Null or empty text has no words (it fails A) and is identical to other
empty texts. A null source is the part ''. A null id counts as the largest and has no
label. Repeated rows count once each; a row is no copy of another with the same
id. Several labels of one id count together: good or toxic if one says so. A
null label is no label. An empty table gives an empty result. Other columns
play no part.
"""

from __future__ import annotations

import itertools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, small_or_not, text_of

FILTERS = "ABCDE"
SUBSETS = 1 << len(FILTERS)
#: Parts and labels that a task counts at a time; it passes on what it has before it holds more.
HELD = 4_096


def survival_word(mask: int) -> int:
    """Bit S is set if no filter of the subset S is in mask."""
    return sum(1 << s for s in range(SUBSETS) if not s & mask)


def positional_popcount(words: np.ndarray) -> np.ndarray:
    """How many words have each of the 32 bits set, by carry-save adders."""
    counts, weight = np.zeros(32, np.int64), 1
    while len(words):
        carries = []
        while len(words) >= 3:
            third = len(words) // 3
            a, b, c, rest = words[:third], words[third : 2 * third], words[2 * third : 3 * third], words[3 * third :]
            half = a ^ b
            carries.append((a & b) | (half & c))
            words = np.concatenate([half ^ c, rest])
        if len(words) == 2:
            carries.append(words[:1] & words[1:])
            words = words[:1] ^ words[1:]
        counts += weight * np.unpackbits(words.astype("<u4").view(np.uint8), bitorder="little").astype(np.int64)
        words, weight = np.concatenate(carries) if carries else words[:0], 2 * weight
    return counts


def failures(text: Column) -> list[Column]:
    """What the filters A to D find in a text."""
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n = F.size(words)
    return [n < 200, 100 * F.size(F.array_distinct(words)) < 50 * n, 100 * F.regexp_count(text, F.lit("[A-Z]")) > 2 * F.length(text), text.rlike(r"[#$%&*|]")]


def survival_words(docs: DataFrame, labels: DataFrame, tmp: Scratch, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, label: 1 for good plus 2 for toxic, word: as a signed 32-bit integer) of each document; read while tmp is open."""
    rows = docs.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text_of(text_col).alias("_text"))
    own = sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failures(F.col("_text")))), F.lit(0))
    rows = tmp.save(rows.select("id", "part", F.unhex(F.sha2("_text", 256)).alias("digest"), own.alias("mask")), "measured")
    # a text that fills the corpus is one row a task before it is shuffled
    copied = rows.groupBy("digest").agg(F.min("id").alias("least"), F.max(F.coalesce("id", F.lit((1 << 63) - 1))).alias("most")).where("least < most").select("digest", "least")
    rows = rows.join(small_or_not(tmp.save(copied, "copied")), "digest", "left")
    copy = F.col("least").isNotNull() & (F.col("id").isNull() | (F.col("least") < F.col("id")))
    rows = rows.select("id", "part", (F.col("mask") + F.when(copy, 16).otherwise(0)).alias("mask"), F.when(F.col("id").isNull(), F.hash("digest")).otherwise(0).alias("spread"))
    known = labels.select(F.col("doc_id").cast("long").alias("id"), (F.when(F.col("quality") == 1, 1).otherwise(0)).alias("good"), (F.when(F.col("toxic") == 1, 1).otherwise(0)).alias("bad")).where("id is not null")
    known = tmp.save(known.groupBy("id").agg((F.max("good") + 2 * F.max("bad")).alias("label")).where("label > 0").withColumn("spread", F.lit(0)), "labels")
    # rows without an id match no label; spread keeps them from one task
    rows = rows.join(small_or_not(known), ["id", "spread"], "left")
    table = F.array(*[F.lit(int(np.uint32(survival_word(m)).astype(np.int32))) for m in range(SUBSETS)])
    return rows.select("part", F.coalesce("label", F.lit(0)).alias("label"), F.get(table, F.col("mask")).alias("word"))


def survivors(words: DataFrame) -> DataFrame:
    """(part, subset, kept, good, toxic): documents that pass all filters of each subset, of all, of good and of toxic ones."""

    def passed_on(counts: dict[tuple[str, int], np.ndarray]) -> pa.RecordBatch:
        n = len(counts)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.repeat([p for p, _ in counts], SUBSETS), pa.string()), pa.array(np.repeat([x for _, x in counts], SUBSETS), pa.int32()), pa.array(np.tile(np.arange(SUBSETS), n), pa.int32()), pa.array(np.concatenate(list(counts.values())), pa.int64())],
            names=["part", "label", "subset", "n"],
        )

    def in_task(batches):
        counts: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            group = batch.column(0).dictionary_encode()
            parts = group.dictionary.to_pylist()
            key = group.indices.to_numpy().astype(np.int64) * 4 + batch.column(1).to_numpy()
            order = np.argsort(key, kind="stable")
            word = batch.column(2).to_numpy().view(np.uint32)[order]
            keys, first = np.unique(key[order], return_index=True)
            for k, some in zip(keys.tolist(), np.split(word, first[1:]), strict=True):
                at = (parts[k // 4], k % 4)
                counts[at] = counts.get(at, 0) + positional_popcount(some)
            if len(counts) > HELD:
                yield passed_on(counts)
                counts = {}
        if counts:
            yield passed_on(counts)

    each = words.mapInArrow(in_task, "part string, label int, subset int, n long")
    of = lambda bit: F.sum(F.when(F.col("label").bitwiseAND(bit) > 0, F.col("n")).otherwise(0))
    return each.groupBy("part", "subset").agg(F.sum("n").alias("kept"), of(1).alias("good"), of(2).alias("toxic"))


def orders(counts: DataFrame) -> DataFrame:
    """The audit's rows from survivors(): (part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley)."""
    by_part = counts.groupBy("part").agg(F.sort_array(F.collect_list(F.struct("subset", "kept", "good", "toxic"))).alias("s"))  # 32 rows a part
    s, all_of, size = F.col("s"), SUBSETS - 1, len(FILTERS)
    orders_before = [1, 1, 2, 6, 24]  # orders of k filters
    shapley = F.array(
        *[
            sum(orders_before[n := x.bit_count()] * orders_before[size - 1 - n] * (s[x]["kept"] - s[x | 1 << f]["kept"]) for x in range(SUBSETS) if not x >> f & 1)
            for f in range(size)
        ]
    )
    rows = by_part.select("part", "s", shapley.alias("fair"), F.explode(F.split(F.lit(",".join(map("".join, itertools.permutations(FILTERS)))), ",")).alias("filter_order"))
    rows = rows.select("*", F.explode(F.sequence(F.lit(1), F.lit(size))).alias("step"))
    before = sum((F.when(F.instr("filter_order", x) < F.col("step"), 1 << k).otherwise(0) for k, x in enumerate(FILTERS)), F.lit(0))
    rows = rows.withColumn("before", before).withColumn("f", F.ascii(F.expr("substring(filter_order, step, 1)")) - ord("A"))
    rows = rows.withColumn("bit", F.expr("shiftleft(1, f)")).withColumn("after", F.col("before") + F.col("bit"))
    at = lambda subset, what="kept": F.get(s, subset)[what]
    removed = at(F.col("before")) - at(F.col("after"))
    lost = lambda what: at(F.col("before"), what) - at(F.col("after"), what)
    return rows.select(
        "part", "filter_order", "step", at(F.col("after")).alias("kept"), removed.alias("removed"), (at(F.lit(0)) - at(F.col("bit")) - removed).alias("redundant"),
        (at(F.lit(all_of) - F.col("bit")) - at(F.lit(all_of))).alias("unique_fails"), lost("good").alias("good_lost"), lost("toxic").alias("toxic_lost"), F.get("fair", F.col("f")).alias("shapley"),
    )


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters and step."""
    with Scratch(docs.sparkSession) as tmp:
        return orders(tmp.result(survivors(survival_words(docs, labels, tmp, id_col, text_col, part_col)), "survivors"))


def oracle() -> str:
    """The registered query's result in DuckDB SQL, each step counted from the documents' masks."""
    return r"""
WITH texts AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
least AS (SELECT t, min(doc_id) AS least FROM texts GROUP BY t),
known AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS bad FROM labels GROUP BY doc_id),
masks AS (SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
  CASE WHEN len(w) < 200 THEN 1 ELSE 0 END + CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 2 ELSE 0 END + CASE WHEN 100 * len(regexp_extract_all(t, '[A-Z]')) > 2 * length(t) THEN 4 ELSE 0 END
  + CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 8 ELSE 0 END + CASE WHEN least < doc_id THEN 16 ELSE 0 END AS mask
  FROM texts JOIN least USING (t) LEFT JOIN known USING (doc_id)),
counted AS (SELECT part, mask, good, bad, count(*) AS n FROM masks GROUP BY ALL),
letters(x, bit) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders AS (SELECT concat(a.x, b.x, c.x, d.x, e.x) AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM letters a, letters b, letters c, letters d, letters e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
steps AS (SELECT filter_order, cast(s AS int) AS step, bits[s] AS bit, cast(coalesce(list_sum(bits[1:s - 1]), 0) AS int) AS before FROM orders, range(1, 6) r(s)),
rows_ AS (SELECT part, filter_order, step, bit, sum(n) FILTER (mask & (before | bit) = 0) AS kept, sum(n) FILTER (mask & before = 0 AND mask & bit > 0) AS removed, sum(n) FILTER (mask & before > 0 AND mask & bit > 0) AS redundant,
  sum(n) FILTER (mask = bit) AS unique_fails, sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND good = 1) AS good_lost, sum(n) FILTER (mask & before = 0 AND mask & bit > 0 AND bad = 1) AS toxic_lost
  FROM counted, steps GROUP BY part, filter_order, step, bit)
SELECT part, filter_order, step, cast(coalesce(kept, 0) AS bigint) AS kept, cast(coalesce(removed, 0) AS bigint) AS removed, cast(coalesce(redundant, 0) AS bigint) AS redundant, cast(coalesce(unique_fails, 0) AS bigint) AS unique_fails,
  cast(coalesce(good_lost, 0) AS bigint) AS good_lost, cast(coalesce(toxic_lost, 0) AS bigint) AS toxic_lost, cast(coalesce(sum(removed) OVER (PARTITION BY part, bit), 0) AS bigint) AS shapley
FROM rows_
"""
