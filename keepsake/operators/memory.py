"""Failure memory: filtered vector search, causal features, tiers and preflight."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

STRONG, WEAK = 0.15, 0.35
#: Names that a configuration key's last part stands for.
ALIASES = {"max_seq_length": "max_seq_len", "learning_rate": "lr"}


def cosine_distance(a: Column, b: Column) -> Column:
    """1 - cosine in double precision; null where a vector is zero."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return 1.0 - F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


#: Signatures that a task compares with a block of queries, and pairs whose scores it holds at a time.
BLOCK_ROWS, TILE_PAIRS = 32_768, 1 << 22
#: Far above the rounding of a product of unit vectors: what is within this of the k-th is measured anew.
MARGIN = 1e-9


def search_failures(signatures: DataFrame, queries: DataFrame, k: int = 8, by_error: bool = True, by_stage: bool = True, most_bytes: int = 24 << 20) -> DataFrame:
    """The k nearest signatures of each query (query_id, stage, error_class, vector): of its stage, and class, if asked.

    With by_stage False, and for queries whose stage is null, all stages count; the same holds for classes. The result has
    the columns of signatures but the embedding. Blocks of BLOCK_ROWS signatures meet blocks of queries of most_bytes that
    name the same stage and class; a block gives k rows for each of its queries, by products of matrices, and all that are
    as near as these by MARGIN are measured as cosine_distance() does.
    """
    text = lambda c, asked, to: (F.col(c).cast("string") if asked else F.lit(None).cast("string")).alias(to)
    q = queries.select("query_id", text("stage", by_stage, "_stage"), text("error_class", by_error, "_class"), _numbers(queries, "vector").alias("_vector"))
    q = q.withColumn("_kind", F.when(F.col("_stage").isNotNull(), 2).otherwise(0) + F.when(F.col("_class").isNotNull(), 1).otherwise(0)).fillna("", ["_stage", "_class"])
    kinds = q.groupBy("_kind").agg(F.count(F.lit(1)).alias("n"), F.max(F.size("_vector")).alias("width")).collect()  # at most four
    width, n = max([1, *[x["width"] or 0 for x in kinds]]), sum(x["n"] for x in kinds)
    blocks, salts = max(1, -(-n // max(1, most_bytes // (64 + 8 * width)))), max(1, -(-signatures.count() // BLOCK_ROWS))
    named = [F.struct(F.lit(x["_kind"]).alias("_kind"), (F.col("stage").cast("string") if x["_kind"] & 2 else F.lit("")).alias("_stage"), (F.col("error_class").cast("string") if x["_kind"] & 1 else F.lit("")).alias("_class")) for x in kinds]
    meet = F.filter(F.array(*named), lambda x: x["_stage"].isNotNull() & x["_class"].isNotNull()) if kinds else F.array().cast("array<struct<_kind:int,_stage:string,_class:string>>")
    each = lambda m: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(m - 1).cast("long")))
    shown = [c for c in signatures.columns if c != "embedding"]
    left = signatures.select(*shown, _numbers(signatures, "embedding").alias("embedding"), F.pmod(F.xxhash64("signature_id"), F.lit(salts)).alias("_salt"), F.explode(meet).alias("_key")).select("*", "_key.*", each(blocks).alias("_block")).drop("_key")
    right = q.select("*", F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("_block"), each(salts).alias("_salt"))
    key = ["_kind", "_stage", "_class", "_salt", "_block"]
    kinds_of = StructType([StructField("query_id", q.schema["query_id"].dataType), *[signatures.schema[c] for c in shown], StructField("distance", DoubleType())])

    def in_task(rows: pa.Table, asked: pa.Table) -> pa.Table:
        rows = rows.take(pc.sort_indices(rows, sort_keys=[("signature_id", "ascending")], null_placement="at_start"))
        of_query, of_row, distance = nearest(rows.column("embedding"), asked.column("_vector"), k)
        found = rows.select(shown).take(pa.array(of_row))
        columns = [asked.column("query_id").take(pa.array(of_query)), *found.columns, distance]
        return pa.table(columns, names=["query_id", *shown, "distance"])

    near = left.groupBy(*key).cogroup(right.groupBy(*key)).applyInArrow(in_task, kinds_of).select(*shown, "query_id", "distance")
    last = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), F.col("signature_id"))
    return near.withColumn("place", F.row_number().over(last)).where(F.col("place") <= k)


def _numbers(df: DataFrame, c: str) -> Column:
    return F.col(c) if df.schema[c].dataType.simpleString() == "array<float>" else F.col(c).cast("array<double>")


def _vectors(column: pa.ChunkedArray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Places and matrix of the vectors of each width; -1: those that are null or hold nulls."""
    lists = column.combine_chunks()
    lists = lists.combine_chunks() if isinstance(lists, pa.ChunkedArray) else lists
    ends, values = lists.offsets.to_numpy().astype(np.int64), lists.values
    widths = np.diff(ends)
    nulls = np.concatenate([[0], np.cumsum(values.is_null().to_numpy(zero_copy_only=False))])
    widths[(nulls[ends[1:]] > nulls[ends[:-1]]) | lists.is_null().to_numpy(zero_copy_only=False)] = -1
    flat = values.to_numpy(zero_copy_only=False).astype(np.float64)
    at = lambda w: np.flatnonzero(widths == w)
    return {int(w): (at(w), flat[ends[at(w)][:, None] + np.arange(max(w, 0))]) for w in np.unique(widths)}


def _exact(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """cosine_distance() of rows, added up in the same order; null: masked."""
    dot = lambda x, y: np.cumsum(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))
    size = np.sqrt(dot(a, a)) * np.sqrt(dot(b, b))
    return np.ma.array(1.0 - dot(a, b) / np.where(size == 0, 1.0, size), mask=size == 0)


def nearest(rows: pa.ChunkedArray, queries: pa.ChunkedArray, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Places of queries and of their k nearest rows, and distances; of rows equally far the first, NaN and then null last."""
    with np.errstate(all="ignore"):
        return _nearest(_vectors(rows), _vectors(queries), k)


def _nearest(rows: dict, queries: dict, k: int) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    out = [(np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0), np.empty(0, np.int64))]
    few = {}
    for width, (places, vectors) in rows.items():  # of equal vectors only the first k can be asked for
        seen = Counter()
        first = [i for i, v in enumerate(vectors) if not seen.update((key := v.tobytes(),)) and seen[key] <= k]
        few[width] = places[first], vectors[first]
    for width, (asked, x) in queries.items():
        at, y = few.get(width, (np.empty(0, np.int64), np.empty((0, max(width, 0)))))
        # vectors that cannot be compared are null far away, as are all for a query that holds no numbers
        unlike = np.sort(np.concatenate([np.empty(0, np.int64), *[rows[w][0] for w in rows if w != width or width < 0]]))[:k]
        at, y = (at, y) if width >= 0 else (at[:0], y[:0])
        lengths = [np.sqrt(np.einsum("ij,ij->i", m, m)) for m in (x, y)]
        tame = [np.isfinite(n) & (n > 1e-100) & (n < 1e100) for n in lengths]
        units = [m / np.where(t, n, 1.0)[:, None] for m, n, t in zip((x, y), lengths, tame, strict=True)]
        smooth, odd = np.flatnonzero(tame[1]), np.flatnonzero(~tame[1])
        step = max(1, TILE_PAIRS // max(1, len(y)))
        for start in range(0, len(x), step):
            tile = np.arange(start, min(start + step, len(x)))
            plain, rest = tile[tame[0][tile]], tile[~tame[0][tile]]
            pairs = [(np.repeat(plain, len(odd)), np.tile(odd, len(plain))), (np.repeat(rest, len(y)), np.tile(np.arange(len(y)), len(rest)))]
            if len(plain) and len(smooth):
                score = units[0][plain] @ units[1][smooth].T
                if len(smooth) > k:
                    a, b = np.nonzero(score >= np.partition(score, len(smooth) - k, axis=1)[:, len(smooth) - k, None] - MARGIN)
                else:
                    a, b = np.indices(score.shape).reshape(2, -1)
                pairs.append((plain[a], smooth[b]))
            a, b = (np.concatenate(p) for p in zip(*pairs, strict=True))
            far = [_exact(x[a[i : i + 65536]], y[b[i : i + 65536]]) for i in range(0, len(a), 65536)]
            far = np.ma.concatenate(far) if far else np.ma.array(np.empty(0), mask=np.empty(0, bool))
            rank = np.where(np.ma.getmaskarray(far), 2, np.isnan(far.data))
            a = np.concatenate([asked[a], np.repeat(asked[tile], len(unlike))])
            b = np.concatenate([at[b], np.tile(unlike, len(tile))])
            d = np.concatenate([np.where(rank == 0, far.data, 0.0), np.zeros(len(b) - len(rank))])
            rank = np.concatenate([rank, np.full(len(b) - len(rank), 2)])
            order = np.lexsort((b, d, rank, a))
            a, b, d, rank = a[order], b[order], d[order], rank[order]
            good = np.arange(len(a)) - np.searchsorted(a, a) < k
            out.append((a[good], b[good], np.where(rank[good] == 1, np.nan, d[good]), rank[good]))
    a, b, d, rank = (np.concatenate(c) for c in zip(*out, strict=True))
    return a, b, pa.array(d, pa.float64(), mask=rank == 2)


#: Fixed value: what is said of a weak match.
ADVISORY = "advisory: does not block"


def memory_view(tiered: DataFrame, remediations: DataFrame) -> DataFrame:
    """Matches as they are shown: tier, whether it blocks, an advisory label for weak ones only, features sorted, known ones alone, and the best remediation.

    tiered: query_id, signature_id, place, distance, tier, causal, agreeing (arrays), structured (map).
    """
    best = latest_remediation(remediations, succeeded_only=False).select("signature_id", F.col("remediation_id").alias("best_remediation"), F.col("succeeded").alias("remediation_succeeded"))
    rows = tiered.join(best, "signature_id", "left")
    known = F.map_filter("structured", lambda _, v: v.isNotNull())
    return rows.select("query_id", "signature_id", "place", "distance", "tier", F.col("tier").isin("exact", "strong_semantic").alias("blocks"), F.when(F.col("tier") == "weak", ADVISORY).alias("advisory"), F.array_sort("agreeing").alias("agreeing"), F.array_sort("causal").alias("causal"), known.alias("structured"), "best_remediation", "remediation_succeeded")


def embedding_problems(revisions: DataFrame, spaces: DataFrame) -> DataFrame:
    """(signature_id, space, problem) of active embeddings that break a rule of their space (space, dim, normalised).

    unknown_space, dimension, not_normalised, or repeated where a signature has several active ones in a space.
    """
    rows = revisions.where("active").join(spaces, "space", "left")
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    checks = F.array_compact(F.array(F.when(F.col("dim").isNull(), "unknown_space"), F.when(F.size("embedding") != F.col("dim"), "dimension"), F.when(F.col("normalised") & (F.abs(norm - 1) > 1e-3), "not_normalised")))
    single = rows.select("signature_id", "space", F.explode(checks).alias("problem"))
    twice = rows.groupBy("signature_id", "space").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("signature_id", "space", F.lit("repeated").alias("problem"))
    return single.unionByName(twice)


def active_embeddings(revisions: DataFrame, spaces: DataFrame, space: str) -> DataFrame:
    """Active embeddings of one space that break none of its rules."""
    bad = embedding_problems(revisions, spaces).where(F.col("space") == space).select("signature_id").distinct()
    return revisions.where(F.col("active") & (F.col("space") == space)).join(bad, "signature_id", "left_anti")


def append_signatures(new: DataFrame, path: str, dim: int) -> None:
    """Append signatures (with a column embedding) to a table; a vector of another dimension fails the write."""
    checked = F.when(F.size("embedding") == dim, F.col("embedding")).otherwise(F.raise_error(F.concat(F.lit(f"dimension is not {dim}: "), F.size("embedding").cast("string"))))
    new.withColumn("embedding", checked).write.mode("append").parquet(path)


def append_remediations(new: DataFrame, signatures: DataFrame, path: str) -> DataFrame:
    """Append the remediations whose signature is known to a table; returns the others."""
    new.join(signatures.select("signature_id"), "signature_id", "left_semi").select(*new.columns).write.mode("append").parquet(path)
    return new.join(signatures.select("signature_id"), "signature_id", "left_anti").select(*new.columns)


def latest_remediation(remediations: DataFrame, succeeded_only: bool = True) -> DataFrame:
    """The newest remediation of each signature; successful ones first, or only these."""
    rows = remediations.where("succeeded") if succeeded_only else remediations
    return rows.groupBy("signature_id").agg(F.max_by(F.struct(*remediations.columns), F.struct("succeeded", "created_at", "remediation_id")).alias("_r")).select("_r.*")


def structured_key(config_key: Column) -> Column:
    """The feature that a configuration key stands for."""
    leaf = F.try_element_at(F.split(config_key, r"\."), F.lit(-1))
    for name, to in ALIASES.items():
        leaf = F.when(leaf == name, to).otherwise(leaf)
    return F.when(config_key == "embedding_dim", "input_dim").otherwise(leaf)


def causal_keys(changes: Column, structured: Column) -> Column:
    """Sorted features that a remediation changed (array of key, from), or null unless each is known and was as recorded.

    structured: map of feature to text. input_dim brings embedding_dim with it where that is recorded.
    """
    known = F.forall(changes, lambda c: F.coalesce(F.element_at(structured, structured_key(c["key"])) == c["from"], F.lit(False)))
    keys = F.transform(changes, lambda c: structured_key(c["key"]))
    more = F.when(F.array_contains(keys, "input_dim") & F.element_at(structured, "embedding_dim").isNotNull(), F.array(F.lit("embedding_dim"))).otherwise(F.array().cast("array<string>"))
    return F.when((F.size(changes) > 0) & known, F.array_sort(F.array_union(keys, more)))


def agreeing_keys(failure: Column, plan: Column) -> Column:
    """Sorted features that both maps hold with equal values."""
    return F.array_sort(F.filter(F.map_keys(failure), lambda k: F.coalesce(F.element_at(failure, k) == F.element_at(plan, k), F.lit(False))))


def tier(causal: Column, agreeing: Column, same_stage: Column, same_class: Column, same_versions: Column, distance: Column) -> Column:
    """exact, strong_semantic, weak or none; the first that fits."""
    covered = F.size(F.array_except(causal, agreeing)) == 0
    return (
        F.when(causal.isNotNull() & covered & same_class & same_versions, "exact")
        .when(causal.isNotNull() & (distance <= STRONG) & same_stage & same_class & F.arrays_overlap(causal, agreeing), "strong_semantic")
        .when(distance <= WEAK, "weak")
        .otherwise("none")
    )


def preflight(plans: DataFrame, matches: DataFrame, remediations: DataFrame, strict: bool = True) -> DataFrame:
    """plans (query_id, vector) with blocked, tier, signature_id and best remediation of the nearest match that blocks, and why a plan passes unsearched.

    Plans without a match that blocks pass, and so do plans without a vector, with a reason: what cannot be searched is not held up.
    """
    blocking = ["exact"] if strict else ["exact", "strong_semantic"]
    first = matches.where(F.col("tier").isin(blocking)).groupBy("query_id").agg(F.min_by(F.struct("tier", "signature_id"), "place").alias("m"))
    rows = plans.select("query_id", F.col("vector").isNull().alias("_blind")).join(first, "query_id", "left").select("query_id", "_blind", "m.tier", "m.signature_id")
    fix = latest_remediation(remediations).select("signature_id", "remediation_id")
    seen = F.col("signature_id").isNotNull() & ~F.col("_blind")
    return rows.join(fix, "signature_id", "left").select("query_id", seen.alias("blocked"), F.when(seen, F.col("tier")).alias("tier"), F.when(seen, F.col("signature_id")).alias("signature_id"), F.when(seen, F.col("remediation_id")).alias("remediation_id"), F.when(F.col("_blind"), "no embedding").alias("reason"))


def apply_remediation(config: DataFrame, changes: DataFrame) -> DataFrame:
    """config (key, value) with the changes' values, and their new keys."""
    return config.join(changes.withColumnRenamed("value", "_new"), "key", "full").select("key", F.coalesce("_new", "value").alias("value"))


def shape_mismatch(reads: DataFrame) -> DataFrame:
    """(plan_id, input_dim, embedding_dim) of plans whose configured input_dim differs from the features' embedding_dim; reads: plan_id, key, value."""
    wide = reads.groupBy("plan_id").agg(F.max(F.when(F.col("key") == "input_dim", F.col("value"))).alias("input_dim"), F.max(F.when(F.col("key") == "embedding_dim", F.col("value"))).alias("embedding_dim"))
    return wide.where("input_dim <> embedding_dim")
