"""N-gram Jaccard join by grouped prefixes, with the components of its links.

A document's set holds its distinct five-word shingles (all its words as one
shingle if it has fewer). Two documents are linked when the Jaccard similarity
of their sets reaches the threshold. The join is exact up to 64-bit hashes:

1. Documents of equal sets collapse into one set.
2. Shingles have one global order. Those whose hash lies in the lowest part LOW
   of the hash range are counted over all sets, and stand from rare to common;
   the others follow by hash. The counts are made where the hashes meet, and each
   chunk of sets gets those that are shared (shared.py). A set's prefix is so long that two similar sets always
   share a shingle of it, so a set whose prefix holds only shingles of its own has no
   partner and leaves the join. Sets of equal size and prefix collapse into one
   group, and only groups enter the join.
3. Each group is first compared with one of the groups that are drawn for its prefix
   shingles, one for each shingle: of those that share most of them the nearest by
   its sketch. So most near copies meet in stars instead of in all pairs.
4. Then all pairs of groups that share a prefix shingle but are not yet in one
   component are filtered where they meet: the shorter set's shingle must stand in its
   shorter prefix, what stands behind it must leave room for what similar sets share, and
   so must the sketches, which bound from below how much two sets differ. Pairs
   that are left are expanded to their sets and verified. What is in one component
   already needs no pair, so large groups of near copies stay linear.

A pair is verified by whole texts: each set's text goes once to every pair that
it has with a first set, whose own text goes once for SHARE shingles of partners.

Edge cases. Null or empty text, or text without words, has an empty set and no
links. Null ids take part and count as the largest id. Repeated rows and rows
that share an id are documents of their own with equal or different sets. An
empty table gives an empty result. Input columns of any name are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keepsake.llm.common import SPACES, Scratch, Substrings, byte_values, chunks, mix, rolling, runs, small_or_not, text_of
from keepsake.llm.components import components
from keepsake.llm.shared import Chunks, levels_of, shared_hashes

WORDS = 5
#: Least similarity, in percent.
THRESHOLD = 75
#: Part of the hash range whose shingles are counted; a prefix is about a quarter of a set.
LOW = 0.35
LIMIT = int(LOW * 2**64)
#: Shingles of the partners that are compared with one first set in one group.
SHARE = 1 << 19
#: Shingles before a shared one that may have found a pair already.
LOOK_BACK = 4
#: Hubs of a group whose sketches are compared.
HUBS = 8
#: 64-bit words of a set's sketch.
SKETCH = 16
#: Sets up to which their components are sent to all tasks.
MOST_BROADCAST = 500_000
_LAST = (1 << 63) - 1


def shingle_sets(texts: pa.Array, width: int = WORDS):
    """For each stretch of rows: (first row, sorted hashes of all sets one after another, size of each)."""
    values = byte_values(fold_case=True)
    for first, _, data, ends in chunks(texts):
        start, end = runs(~SPACES[data])
        words = Substrings(values[data]).hash(start, end)
        doc = np.searchsorted(ends, start, "right")
        n_words = np.bincount(doc, minlength=len(ends))
        begin = np.cumsum(n_words) - n_words
        whole = rolling(words, width)
        inside = doc[: len(whole)] == doc[width - 1 :] if len(whole) else np.empty(0, bool)
        hashes, owner = whole[inside], doc[: len(whole)][inside]
        for k in range(1, width):  # too short for a shingle
            few = np.flatnonzero(n_words == k)
            if len(few):
                hashes, owner = np.concatenate([hashes, rolling(words, k, seed=k)[begin[few]]]), np.concatenate([owner, few])
        order = np.argsort(owner, kind="stable")
        hashes, owner = hashes[order], owner[order]
        bounds = np.cumsum(np.bincount(owner, minlength=len(ends))).tolist()
        for a, b in zip([0, *bounds], bounds, strict=False):
            hashes[a:b].sort()
        distinct = np.ones(len(hashes), bool)
        distinct[1:] = (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1])
        yield first, hashes[distinct], np.bincount(owner[distinct], minlength=len(ends))


def least_overlap(n_a, n_b, threshold: int):
    """Shared shingles that two sets of these sizes need."""
    return F.ceil(threshold * (n_a + n_b) / F.lit(100 + threshold)) if isinstance(n_a, Column) else -(-threshold * (n_a + n_b) // (100 + threshold))


def prefix_length(n, threshold: int):
    """Shingles of a set of n of which two similar sets share one."""
    return n - -(-threshold * n // 100) + 1


def _sets(source: DataFrame, width: int) -> DataFrame:
    """(_row, doc_id, hash, n, s1, s2): size and digest of each row's set."""

    def total(values: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            sums = np.concatenate([[np.uint64(0)], np.cumsum(values)])
            ends = np.cumsum(sizes)
            return (sums[ends] - sums[ends - sizes]).view(np.int64)

    def compute(batches):
        for batch in batches:
            for first, hashes, n in shingle_sets(batch.column(3), width):
                own = [batch.column(j).slice(first, len(n)) for j in range(3)]
                yield pa.RecordBatch.from_arrays([*own, pa.array(n.astype(np.int64)), pa.array(total(mix(hashes, 1), n)), pa.array(total(mix(hashes, 2), n))], names=["_row", "doc_id", "hash", "n", "s1", "s2"])

    return source.select("_row", "doc_id", "hash", "text").mapInArrow(compute, "_row long, doc_id long, hash long, n long, s1 long, s2 long")


def _lowest(texts: DataFrame, width: int, threshold: int) -> DataFrame:
    """(chunk, set_id, n, sketch, lowest): the hashes below LOW of each set (set_id, text), by size, and as many more as its prefix may need.

    sketch: the parity of the set's hashes at each of 64 * SKETCH places; two sets differ at least where their parities do.
    """
    limit = np.uint64(LIMIT)

    def compute(batches):
        numbers = Chunks(TaskContext.get().partitionId())
        for batch in batches:
            for first, hashes, n in shingle_sets(batch.column(1), width):
                ends = np.cumsum(n)
                below = np.concatenate([[0], np.cumsum(hashes < limit)])
                take = np.maximum(below[ends] - below[ends - n], np.where(n > 0, prefix_length(n, threshold), 0))
                kept = np.arange(len(hashes)) - np.repeat(ends - n, n) < np.repeat(take, n)
                parity = np.zeros(len(n) * SKETCH, np.uint64)
                place = mix(hashes, 7)
                np.bitwise_xor.at(parity, np.repeat(np.arange(len(n)) * SKETCH, n) + (place >> np.uint64(32)).astype(np.int64) % SKETCH, np.uint64(1) << (place & np.uint64(63)))
                sketch = pa.ListArray.from_arrays(pa.array(np.arange(0, len(parity) + 1, SKETCH, dtype=np.int32)), pa.array(parity.view(np.int64)))
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(take)]).astype(np.int32)), pa.array(hashes[kept].view(np.int64)))
                yield pa.RecordBatch.from_arrays([pa.array(numbers.of(take)), batch.column(0).slice(first, len(n)), pa.array(n.astype(np.int64)), sketch, lists], names=["chunk", "set_id", "n", "sketch", "lowest"])

    return texts.mapInArrow(compute, "chunk long, set_id long, n long, sketch array<bigint>, lowest array<bigint>")


def _prefixes(lowest: DataFrame, shared: DataFrame, threshold: int) -> DataFrame:
    """(set_id, n, sketch, g1, g2, prefix: shingles (h, i) that other sets may hold, with their places) of sets that have any; g1, g2: digest of the whole prefix."""

    def join(sets: pa.Table, found: pa.Table) -> pa.Table:
        lists = sets.column("lowest").combine_chunks()
        flat, size = lists.flatten().to_numpy().view(np.uint64), lists.value_lengths().to_numpy()
        rank = np.where(flat >= np.uint64(LIMIT), 256, levels_of(flat, found))
        owner = np.repeat(np.arange(len(size)), size)
        order = np.lexsort((flat, rank, owner))
        flat, rank = flat[order], rank[order]
        n = sets.column("n").to_numpy()
        p = np.where(n > 0, prefix_length(n, threshold), 0)
        ends = np.cumsum(size)
        i = np.arange(len(flat)) - np.repeat(ends - size, size)
        ahead = i < np.repeat(p, size)
        with np.errstate(over="ignore"):
            digest = [np.concatenate([[np.uint64(0)], np.cumsum(np.where(ahead, mix(flat, k), np.uint64(0)))]) for k in (3, 4)]
            g1, g2 = ((d[ends] - d[ends - size]).view(np.int64) for d in digest)
        wanted = ahead & (rank > 0)
        count = np.bincount(owner[wanted], minlength=len(size))
        prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(count)]).astype(np.int32)), pa.StructArray.from_arrays([pa.array(flat[wanted].view(np.int64)), pa.array(i[wanted].astype(np.int32))], names=["h", "i"]))
        some = pa.array(count > 0)
        return pa.table({"set_id": sets.column("set_id").filter(some), "n": pa.array(n.astype(np.int32)).filter(some), "sketch": sets.column("sketch").filter(some), "g1": pa.array(g1).filter(some), "g2": pa.array(g2).filter(some), "prefix": prefix.filter(some)})

    return lowest.groupBy("chunk").cogroup(shared.groupBy("chunk")).applyInArrow(join, "set_id long, n int, sketch array<bigint>, g1 long, g2 long, prefix array<struct<h: bigint, i: int>>")


def _verified(pairs: DataFrame, sets: DataFrame, docs: DataFrame, width: int, threshold: int, tmp: Scratch) -> DataFrame:
    """Those of pairs (a, b: set ids) that reach the threshold, by their documents' whole texts."""
    pairs = tmp.save(pairs.select("a", "b").distinct(), "pairs")
    # partners of one b are split so that they hold about SHARE shingles together
    parts = pairs.groupBy("b").agg(F.count("a").alias("k")).join(sets.select(F.col("set_id").alias("b"), "n"), "b").select("b", F.ceil(F.col("k") * F.col("n") / SHARE).alias("parts"))
    part = F.pmod(F.xxhash64("a"), F.col("parts")).alias("part")
    sent = pairs.join(parts, "b").select(F.col("a").alias("set_id"), "b", part)
    sent = sent.unionByName(sent.select(F.col("b").alias("set_id"), "b", "part").distinct())
    sent = small_or_not(tmp.save(sent.join(sets.select("set_id", "doc_id", "hash"), "set_id"), "sent"))
    texts = docs.join(sent, docs["doc_id"].eqNullSafe(sent["doc_id"]) & (docs["hash"] == sent["hash"])).select("b", "part", "set_id", "text")

    def compare(rows: pa.Table) -> pa.Table:
        ids, b = rows.column("set_id").to_numpy(), rows.column("b")[0].as_py()
        own = np.flatnonzero(ids == b)[:1]
        first = next(_each(rows.column("text").take(pa.array(own)), width))
        keep = np.zeros(len(ids), bool)
        for i, x in enumerate(_each(rows.column("text"), width)):
            shared = len(np.intersect1d(first, x, assume_unique=True))
            keep[i] = ids[i] != b and 100 * shared >= threshold * (len(first) + len(x) - shared)
        return pa.table({"a": ids[keep], "b": np.full(keep.sum(), b, np.int64)})

    return tmp.save(texts.groupBy("b", "part").applyInArrow(compare, "a long, b long"), "links")


def _each(texts: pa.ChunkedArray, width: int):
    for _, hashes, n in shingle_sets(texts.combine_chunks(), width):
        yield from np.split(hashes, np.cumsum(n)[:-1])


def _differ(a: str, b: str) -> Column:
    """At how many places two sketches differ."""
    return F.aggregate(F.zip_with(a, b, lambda p, q: F.bit_count(p.bitwiseXOR(q))), F.lit(0), lambda total, k: total + k)


def _open(tokens: DataFrame, member_of: DataFrame, few: bool) -> tuple[DataFrame, DataFrame]:
    """(gid, low, high: components of its sets), and the tokens that groups of several components hold, with `one`: the group's component, or null for several."""
    spread = member_of.groupBy("gid").agg(F.min("component").alias("low"), F.max("component").alias("high"))
    named = tokens.join(F.broadcast(spread) if few else spread, "gid")
    mixed = named.groupBy("h").agg(F.min("low").alias("l"), F.max("high").alias("m")).where("l <> m").select("h")
    return spread, named.join(mixed, "h").select("h", "gid", "i", "n", "slack", F.when(F.col("low") == F.col("high"), F.col("low")).alias("one"))


def _merged(member_of: DataFrame, links: DataFrame, tmp: Scratch) -> DataFrame:
    """member_of after links (a, b: set ids); only links between components count, each once, so their number does not grow with the pairs of a group."""
    x, y = (member_of.select(F.col("set_id").alias(k), F.col("component").alias(f"c{k}")) for k in "ab")
    between = links.join(x, "a").join(y, "b").where("ca <> cb").select(F.col("ca").alias("a"), F.col("cb").alias("b"))
    label = small_or_not(tmp.save(components(between, tmp), "components"))
    merged = member_of.join(label.select(F.col("node").alias("component"), F.col("component").alias("_to")), "component", "left")
    return tmp.save(merged.select("set_id", "gid", "n", F.coalesce("_to", "component").alias("component")), "member_of")


def _promising(pairs: DataFrame, sketches: DataFrame, threshold: int) -> DataFrame:
    """Those of pairs (a, b: set ids) whose sketches leave room for the threshold, with the number of places at which they differ."""
    x, y = (sketches.select(F.col("set_id").alias(k), F.col("n").alias(f"n_{k}"), F.col("sketch").alias(f"s_{k}")) for k in "ab")
    pairs = pairs.join(x, "a").join(y, "b").select("a", "b", "n_a", "n_b", _differ("s_a", "s_b").alias("differ"))
    return pairs.where(F.col("differ") <= F.col("n_a") + F.col("n_b") - 2 * least_overlap(F.col("n_a"), F.col("n_b"), threshold)).select("a", "b", "differ")


def link(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """(doc_id, hash, n_shingles, component) for each row; hash: of the row's text; equal component: linked, directly or not."""
    with Scratch(docs.sparkSession) as tmp:
        return _link(docs, id_col, text_col, width, threshold, tmp)


def _link(docs: DataFrame, id_col: str, text_col: str, width: int, threshold: int, tmp: Scratch) -> DataFrame:
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text")).withColumn("hash", F.xxhash64("text"))
    rows = tmp.save(_sets(source.withColumn("_row", F.monotonically_increasing_id()), width), "rows")
    # equal sets
    full = rows.where("n > 0")
    ids = full.groupBy("n", "s1", "s2").agg(F.min("_row").alias("set_id"))
    of_row = tmp.save(full.join(ids, ["n", "s1", "s2"]).select("_row", "set_id", "doc_id", "hash", "n"), "sets")
    sets = of_row.where("_row = set_id").drop("_row")
    # one text for each set; rows of one id and text have one set
    wanted = small_or_not(tmp.save(sets.groupBy("doc_id", "hash").agg(F.min("set_id").alias("set_id")), "wanted"))
    texts = source.join(wanted, source["doc_id"].eqNullSafe(wanted["doc_id"]) & (source["hash"] == wanted["hash"])).select("set_id", "text")
    lowest = tmp.save(_lowest(texts, width, threshold), "lowest")
    shared = shared_hashes(lowest.select("chunk", "lowest"), int(LOW * (sets.agg(F.sum("n")).first()[0] or 0)), LIMIT)
    prefixes = tmp.save(_prefixes(lowest, shared, threshold).dropDuplicates(["set_id"]), "prefixes")
    # equal sizes and prefixes; slack: how far the sketches of a group lie from its first one's
    groups = prefixes.groupBy("n", "g1", "g2").agg(F.min("set_id").alias("gid"))
    members = tmp.save(prefixes.select("set_id", "n", "g1", "g2").join(groups, ["n", "g1", "g2"]).select("set_id", "gid", "n"), "members")
    several = members.where("set_id <> gid")
    x, y = (prefixes.select(F.col("set_id").alias(k), F.col("sketch").alias(f"s_{k}")) for k in ("set_id", "gid"))
    slack = several.join(x, "set_id").join(y, "gid").groupBy("gid").agg(F.max(_differ("s_set_id", "s_gid")).alias("slack"))
    first = members.where("set_id = gid").select("gid").join(slack, "gid", "left").select(F.col("gid").alias("set_id"), F.coalesce("slack", F.lit(0)).alias("slack"))
    tokens = prefixes.join(small_or_not(tmp.save(first, "groups")), "set_id").select(F.inline("prefix"), F.col("set_id").alias("gid"), "n", "slack")
    repeated = tokens.groupBy("h").agg(F.count("gid").alias("k")).where("k > 1").select("h")
    tokens = tmp.save(tokens.join(repeated, "h"), "tokens")
    sketches = prefixes.select("set_id", "n", "sketch")
    # a star for each shingle; a group has no more hubs than prefix shingles, and goes to the nearest of the best ones by its sketch
    few = members.limit(MOST_BROADCAST + 1).count() <= MOST_BROADCAST
    hubs = tokens.groupBy("h").agg(F.min_by("gid", F.struct(F.xxhash64("gid"), "gid")).alias("b"))
    stars = tokens.join(hubs, "h").where("gid <> b").groupBy(F.col("gid").alias("a"), "b").agg(F.count("h").alias("c"))
    best = F.slice(F.array_sort(F.collect_list(F.struct(-F.col("c"), F.xxhash64("a", "b"), "b"))), 1, HUBS)
    stars = stars.groupBy("a").agg(best.alias("best")).select("a", F.explode("best.b").alias("b"))
    stars = _promising(stars, sketches, threshold).groupBy("a").agg(F.min_by("b", F.struct("differ", "b")).alias("b"))
    stars = stars.unionByName(several.select(F.col("set_id").alias("a"), F.col("gid").alias("b")))
    member_of = _merged(members.withColumn("component", F.col("set_id")), _verified(stars, sets, source, width, threshold, tmp), tmp)
    # all pairs of groups that are not in one component; b is the shorter one, or the one of larger id
    spread, open_tokens = _open(tokens, member_of, few)
    open_tokens = open_tokens.join(sketches.withColumnRenamed("set_id", "gid").drop("n"), "gid")
    in_order = Window.partitionBy("gid").orderBy("i")  # a prefix
    before = [F.lag("h", k).over(in_order).alias(f"p{k}") for k in range(1, LOOK_BACK + 1)]
    open_tokens = tmp.save(open_tokens.select("h", "gid", "i", "n", "slack", "one", *before, *[F.col("sketch")[k].alias(f"s{k}") for k in range(SKETCH)]), "open")
    x, y = (open_tokens.select("h", F.col("gid").alias(k), *[F.col(c).alias(f"{c}_{k}") for c in open_tokens.columns[2:]]) for k in "ab")
    # of two similar sets the shorter one holds a shared shingle in a prefix that is shorter still
    y = y.where(F.col("i_b") <= F.col("n_b") - least_overlap(F.col("n_b"), F.col("n_b"), threshold))
    overlap = f"ceil({threshold} * (n_a + n_b) / {100 + threshold})"
    can = f"100 * n_b >= {threshold} * n_a and least(n_a - i_a, n_b - i_b) >= {overlap}"
    differ = " + ".join(f"bit_count(s{k}_a ^ s{k}_b)" for k in range(SKETCH))
    # where one of the shingles just before is shared as well, that one has found the pair: it passes all that this one passes
    known = " or ".join(f"p{j}_a in ({', '.join(f'p{k}_b' for k in range(1, LOOK_BACK + 1))})" for j in range(1, LOOK_BACK + 1))
    pairs = x.join(y, (x["h"] == y["h"]) & F.expr(f"(n_b < n_a or n_b = n_a and a < b) and not coalesce(one_a = one_b, false) and {can} and not coalesce({known}, false) and {differ} <= n_a + n_b - 2 * {overlap} + slack_a + slack_b")).select("a", "b").distinct()
    inside = spread.where("low <> high").select(F.col("gid").alias("a"), F.col("gid").alias("b"))
    x, y = (member_of.select(F.col("gid").alias(k), F.col("set_id").alias(f"set_{k}"), F.col("component").alias(f"component_{k}")) for k in "ab")
    pairs = pairs.unionByName(inside).join(x, "a").join(y, "b").where("component_a <> component_b and (a <> b or set_a < set_b)").select(F.col("set_a").alias("a"), F.col("set_b").alias("b"))
    member_of = _merged(member_of, _verified(_promising(pairs, sketches, threshold), sets, source, width, threshold, tmp), tmp)
    label = member_of.select("set_id", "component")
    found = of_row.select("_row", "set_id").join(label, "set_id", "left").select("_row", F.coalesce("component", "set_id").alias("component"))
    return tmp.result(rows.select("_row", "doc_id", "hash", F.col("n").alias("n_shingles")).join(found, "_row", "left").select("doc_id", "hash", "n_shingles", F.coalesce("component", F.col("_row")).alias("component")), "linked")


def with_component_id(linked: DataFrame) -> DataFrame:
    """linked, with component_id: the smallest doc_id of the component."""
    least = linked.groupBy("component").agg(F.min("doc_id").alias("component_id"))
    return linked.join(least, "component")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, threshold: int = THRESHOLD) -> DataFrame:
    """The rows of docs, unchanged, without those linked to a kept one: of each component the row of the smallest id stays.

    Rows that share that id are told apart by their text's hash; identical rows stay together.
    """
    last = lambda c: F.coalesce(c, F.lit(_LAST))
    with Scratch(docs.sparkSession) as tmp:
        linked = _link(docs, id_col, text_col, width, threshold, tmp)
        least = linked.groupBy("component").agg(F.min(F.struct(last("doc_id").alias("i"), F.col("hash").alias("h"))).alias("first"), F.count("hash").alias("k")).where("k > 1")
        gone = linked.join(least, "component").where((last("doc_id") != F.col("first.i")) | (F.col("hash") != F.col("first.h")))
        gone = small_or_not(tmp.result(gone.select(F.col("doc_id").alias("_gone"), F.col("hash").alias("_gone_hash")).distinct(), "gone"))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(text_of(text_col)) == gone["_gone_hash"]), "left_anti")
