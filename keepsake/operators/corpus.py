"""Corpus preparation, features, evaluation and equivalence probes."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StructField, StructType

from keepsake.functions.canon import evidence_digest
from keepsake.functions.scratch import cut
from keepsake.operators.lineage import reachable

METRICS = ("accuracy", "macro_f1")


def normalize_text(df: DataFrame, text_col: str = "text") -> DataFrame:
    """Runs of Unicode white space become one space; rows that become empty go."""
    return df.withColumn(text_col, F.trim(F.regexp_replace(text_col, r"(?U)\s+", " "))).where(F.length(text_col) > 0)


def modulus_split(df: DataFrame, n: int = 5, id_col: str = "doc_id") -> DataFrame:
    if n < 2:
        raise ValueError("n must be at least 2")
    return df.withColumn("split", F.when(F.pmod(F.col(id_col), F.lit(n)) == 0, "test").otherwise("train"))


def split_summary(df: DataFrame) -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col("split") == "train").alias("train"), F.count_if(F.col("split") == "test").alias("test"))


def row_places(df: DataFrame, by: str | list[str], name: str = "place") -> DataFrame:
    """df with each row's place (from 1) in the order of by, without one global window.

    Rows are range-partitioned; a running sum over one count for each partition gives each its offset.
    """
    by = [by] if isinstance(by, str) else by
    ranged = cut(df.repartitionByRange(*by).withColumn("_part", F.spark_partition_id()))
    counts = ranged.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by))
    return ranged.join(counts.select("_part", before.alias("_before")), "_part").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def assign_shards(df: DataFrame, shards: int, by: str = "doc_id") -> DataFrame:
    """df with shard (from 0): contiguous in the order of by; the first n mod shards get one row more."""
    placed = row_places(df, by, "_place")
    total = placed.agg(F.count(F.lit(1)).alias("_total"))
    small, more = F.floor(F.col("_total") / shards), F.col("_total") % shards
    at = F.col("_place") - 1
    inside = F.when(at < more * (small + 1), F.floor(at / (small + 1))).otherwise(more + F.floor((at - more * (small + 1)) / F.greatest(small, F.lit(1))))
    return placed.join(total).withColumn("shard", inside.cast("int")).drop("_place", "_total")  # one total


def hash_embed(text: Column, dim: int = 64) -> Column:
    """A unit vector that the text's sha256 seeds; the built-in stand-in for an encoder.

    Spark takes the sha256, so that no text goes to a Python worker.
    """

    def vector(seed: bytes) -> np.ndarray:
        data, k = b"", 0
        while len(data) < 4 * dim:
            data += hashlib.sha256(seed + k.to_bytes(4, "big")).digest()
            k += 1
        v = np.frombuffer(data[: 4 * dim], ">u4").astype(np.float64) / 2**31 - 1.0
        return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)

    @F.pandas_udf("array<float>")
    def embed(seeds: pd.Series) -> pd.Series:
        return seeds.map(vector)

    return embed(F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256)))


def embed(df: DataFrame, encoder: Callable[[list[str]], np.ndarray], dim: int, text_col: str = "text") -> DataFrame:
    """df with embedding (array of float): encoder turns a list of texts into rows of numbers, in Arrow batches.

    Null texts count as empty. A result of another shape fails the job.
    """

    def compute(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = ["" if t is None else t for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            vectors = np.asarray(encoder(texts), np.float32) if texts else np.empty((0, dim), np.float32)
            if vectors.shape != (len(texts), dim):
                raise ValueError(f"the encoder gave {vectors.shape}, not {(len(texts), dim)}")
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, dim * len(texts) + 1, dim, dtype=np.int32)), pa.array(vectors.reshape(-1)))
            yield pa.RecordBatch.from_arrays([*batch.columns, lists], names=[*batch.schema.names, "embedding"])

    return df.mapInArrow(compute, StructType([*df.schema.fields, StructField("embedding", ArrayType(FloatType()))]))


def shard_digests(features: DataFrame, order_by: str = "doc_id") -> DataFrame:
    """(shard, n_rows, digest): sha256 of each shard's vectors as little-endian 32-bit floats in the order of order_by, in constant memory."""

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, total, n, done = None, None, 0, []
        for batch in batches:
            for k, vector in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != shard:
                    done += [(shard, n, total.hexdigest())] if total else []
                    shard, total, n = k, hashlib.sha256(), 0
                total.update(vector.values.to_numpy(zero_copy_only=False).astype("<f4").tobytes())
                n += 1
        done += [(shard, n, total.hexdigest())] if total else []
        yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], pa.int32()), pa.array([d[1] for d in done], pa.int64()), pa.array([d[2] for d in done], pa.string())], names=["shard", "n_rows", "digest"])

    ordered = features.select(F.col("shard").cast("int").alias("shard"), "embedding", order_by).repartition("shard").sortWithinPartitions("shard", order_by)
    return ordered.select("shard", "embedding").mapInArrow(digest, "shard int, n_rows long, digest string")


def join_features(dataset: DataFrame, features: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return dataset.join(features, id_col)


def train_classifier(df: DataFrame, features_col: str, label_col: str, classes: int, dim: int, hidden: int = 64, seed: int = 1337, rounds: int = 50):
    """A multilayer perceptron on array features of the rows whose split is train."""
    from pyspark.ml.classification import MultilayerPerceptronClassifier
    from pyspark.ml.functions import array_to_vector

    rows = df.where("split = 'train'").select(array_to_vector(F.col(features_col).cast("array<double>")).alias("features"), F.col(label_col).cast("double").alias("label"))
    return MultilayerPerceptronClassifier(layers=[dim, hidden, classes], seed=seed, maxIter=rounds).fit(rows)


def score(model, df: DataFrame, features_col: str) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return model.transform(df.withColumn("features", array_to_vector(F.col(features_col).cast("array<double>")))).withColumn("yhat", F.col("prediction").cast("int")).drop("features", "rawPrediction", "probability", "prediction")


def classification_metrics(df: DataFrame, y: str = "y", yhat: str = "yhat", metrics: tuple[str, ...] = METRICS) -> DataFrame:
    """One row: n_examples and the metrics asked for; macro-F1 over labels that occur as true or predicted, 0 where undefined."""
    if not metrics or len(set(metrics)) < len(metrics) or set(metrics) - set(METRICS):
        raise ValueError("metrics must be distinct and among " + ", ".join(METRICS))
    counts = df.groupBy(F.col(y).alias("y"), F.col(yhat).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    per = counts.select(F.explode(F.array(F.struct(F.col("y").alias("label"), F.lit(1).alias("t"), F.lit(0).alias("q")), F.struct(F.col("p").alias("label"), F.lit(0).alias("t"), F.lit(1).alias("q")))).alias("x"), "n", (F.col("y") == F.col("p")).alias("hit"))
    per = per.groupBy("x.label").agg(F.sum(F.when(F.col("x.t") == 1, F.col("n")).otherwise(0)).alias("true"), F.sum(F.when(F.col("x.q") == 1, F.col("n")).otherwise(0)).alias("guess"), F.sum(F.when(F.col("hit") & (F.col("x.t") == 1), F.col("n")).otherwise(0)).alias("tp"))
    f1 = F.coalesce(F.try_divide(2.0 * F.col("tp"), F.col("true") + F.col("guess")), F.lit(0.0))
    out = per.agg(F.sum("true").alias("n_examples"), (F.sum("tp") / F.sum("true")).alias("accuracy"), F.avg(f1).alias("macro_f1"))
    return out.select("n_examples", *metrics)


def effective_config(configured: DataFrame, defaults: DataFrame) -> DataFrame:
    """(stage, key, value, defaulted) of every key that is read."""
    return defaults.withColumnRenamed("value", "_default").join(configured, ["stage", "key"], "left").select("stage", "key", F.coalesce("value", "_default").alias("value"), F.col("value").isNull().alias("defaulted"))


def category_counts(df: DataFrame, by: str) -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n"))


# --- probes


def hash_select(df: DataFrame, id_col: str, salt: str, k: int) -> DataFrame:
    """The min(k, n) rows of the smallest sha256 of salt and id: a top-k, never a full sort in one task."""
    return df.orderBy(F.sha2(F.concat(F.lit(f"{salt}:"), F.col(id_col).cast("string")), 256), id_col).limit(k)


def probe_row(probe: str, passed: Column, population: Column, sample: Column, detail: Column) -> list[Column]:
    return [F.lit(probe).alias("probe_type"), passed.alias("passed"), population.cast("long").alias("population_size"), sample.cast("long").alias("sample_size"), F.lit("bitwise").alias("tolerance"), evidence_digest(F.lit(probe), passed.cast("string"), detail).alias("evidence_digest"), detail.alias("detail")]


def probe_env(recorded: DataFrame, current: DataFrame, key: str, digest: str) -> DataFrame:
    """One row: whether every recorded environment digest equals the current one."""
    both = recorded.select(key, F.col(digest).alias("a")).join(current.select(key, F.col(digest).alias("b")), key, "left")
    bad = both.agg(F.count(F.lit(1)).alias("n"), F.count_if(~F.col("a").eqNullSafe(F.col("b"))).alias("bad"))
    return bad.select(*probe_row("P1", F.col("bad") == 0, F.col("n"), F.col("n"), F.col("bad").cast("string")))


def reached_in_either(old: DataFrame, new: DataFrame, entries: DataFrame) -> DataFrame:
    """Distinct nodes that the entry points reach in the old or the new graph, each walked by itself, kept in a table."""
    return cut(reachable(old, entries).select("node").unionByName(reachable(new, entries).select("node")).distinct())


def probe_struct(old: DataFrame, new: DataFrame, entries: DataFrame, changed: DataFrame, escapes: DataFrame, reached: DataFrame | None = None) -> DataFrame:
    """One row: whether no changed unit (node) can be reached from the entry points in the old or the new graph (src, dst).

    A reachable unit with an escape may reach anything, so then the probe fails. detail: counts of both.
    reached: that of reached_in_either(), where the same graphs are probed several times.
    """
    reached = reached_in_either(old, new, entries) if reached is None else reached
    hit = lambda rows, name: reached.join(rows.select("node").distinct(), "node", "left_semi").agg(F.count("node").alias(name))
    counts = reached.agg(F.count("node").alias("n")).join(hit(changed, "changed")).join(hit(escapes, "escapes"))  # one row each
    passed = (F.col("changed") == 0) & (F.col("escapes") == 0)
    return counts.select(*probe_row("P2", passed, F.col("n"), F.col("n"), F.concat_ws(",", F.col("changed").cast("string"), F.col("escapes").cast("string"))))


def probe_vectors(recorded: DataFrame, recomputed: DataFrame, id_col: str, vector_col: str, salt: str, k: int = 64) -> DataFrame:
    """One row: whether k sampled vectors are bit for bit the same; detail lists ids that differ or are missing."""
    sample = hash_select(recorded.select(id_col), id_col, salt, k)
    return _same_vectors("P3", recorded, recomputed, sample, id_col, vector_col)


def probe_scores(a: DataFrame, b: DataFrame, id_col: str, scores_col: str, salt: str, k: int = 128) -> DataFrame:
    """One row: whether two models' scores (an array for each row) are bit for bit the same on k sampled rows."""
    return _same_vectors("P4", a, b, hash_select(a.select(id_col), id_col, salt, k), id_col, scores_col)


def _same_vectors(probe: str, recorded: DataFrame, recomputed: DataFrame, sample: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    kind, other = (x.schema[vector_col].dataType.simpleString() for x in (recorded, recomputed))
    if kind != other or kind not in ("array<float>", "array<double>"):
        raise TypeError(f"bits of {kind} and {other} can't be compared")
    # a number's shortest text tells all its bits but those of NaN
    bits = lambda c: F.transform(c, lambda x: F.hex(x.cast("string")))
    a, b = (x.select(id_col, bits(F.col(vector_col)).alias(n)) for x, n in ((recorded, "_a"), (recomputed, "_b")))
    both = F.broadcast(sample).join(a, id_col).join(b, id_col, "left")  # at most k rows
    out = both.agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list(F.when(~F.col("_a").eqNullSafe(F.col("_b")), F.col(id_col)))).alias("bad"))
    total = recorded.agg(F.count(F.lit(1)).alias("total"))
    return out.join(total).select(*probe_row(probe, F.size("bad") == 0, F.col("total"), F.col("n"), F.array_join(F.col("bad").cast("array<string>"), ",")))


#: Entries that are folded into one digest at a time.
FOLDED = 4096


def ordered_digest(rows: DataFrame, place: str, columns: list[str], n: int | None = None) -> DataFrame:
    """One row: a digest of each column's values (null: empty) in the order of place, which numbers them from 0.

    Folded in blocks that places alone fix, level by level until one block is left, so it is the same for every layout
    of the table and no list is longer than FOLDED. n: the number of rows, counted if it is not given.
    """
    def listed(c: str):
        return F.to_json(F.struct(F.transform("_rows", lambda x: F.coalesce(x[c].cast("string"), F.lit(""))).alias("v")))

    level, left = rows.select(F.col(place).alias("_at"), *columns), rows.count() if n is None else n
    while True:
        entries = F.array_sort(F.collect_list(F.struct("_at", *columns)))
        grouped = level.groupBy(F.floor(F.col("_at") / FOLDED).cast("long").alias("_block")).agg(entries.alias("_rows"))
        level, left = grouped.select(F.col("_block").alias("_at"), *[F.sha2(listed(c), 256).alias(c) for c in columns]), -(-left // FOLDED)
        if left <= 1:
            return level.drop("_at")


def table_checksums(df: DataFrame, order_by: str, stride: int = 10) -> DataFrame:
    """(rows, sampled, checksum): every stride-th row in the order of order_by, one digest for each column, folded by name.

    Only order_by and a hash of the row are ranked; the columns of what is sampled alone are digested. Rows that share
    order_by stand in the order of their hashes, so equal tables of any layout have equal checksums.
    """
    names = sorted(df.columns)
    row = F.xxhash64(F.to_json(F.struct(*[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(names)])))
    keyed = df.select(F.col(f"`{order_by}`").alias("_by"), row.alias("_row"), *[F.col(f"`{c}`").alias(f"c{j}") for j, c in enumerate(names)])
    ranked = row_places(keyed.select("_by", "_row"), ["_by", "_row"], "_place")
    placed = cut(ranked.where((F.col("_place") - 1) % stride == 0).select("_by", "_row", F.floor((F.col("_place") - 1) / stride).alias("_place")))
    sampled = placed.count()
    wanted = placed.select("_by", "_row").distinct()
    same = lambda x, y: x["_by"].eqNullSafe(y["_by"]) & (x["_row"] == y["_row"])
    content = keyed.join(wanted, same(keyed, wanted), "left_semi").dropDuplicates(["_by", "_row"])
    content = content.select("_by", "_row", *[F.sha2(F.to_json(F.struct(F.col(f"c{j}").alias("v"))), 256).alias(f"c{j}") for j in range(len(names))])
    rows = placed.join(content, same(placed, content)).select("_place", *[f"c{j}" for j in range(len(names))])
    digests = ordered_digest(rows, "_place", [f"c{j}" for j in range(len(names))], sampled)
    checksum = F.sha2(F.concat_ws("|", *[x for j, c in enumerate(names) for x in (F.lit(c), F.col(f"c{j}"))]), 256)
    total = df.agg(F.count(F.lit(1)).alias("rows"))
    # one row each; an empty table has no digest
    one = total.join(digests.select(checksum.alias("checksum")), F.lit(True), "left")
    return cut(one.select("rows", F.ceil(F.col("rows") / stride).alias("sampled"), F.coalesce("checksum", F.lit("")).alias("checksum")))


def probe_table(a: DataFrame, b: DataFrame, order_by: str, stride: int = 10, checksums: DataFrame | None = None) -> DataFrame:
    """One row: same names, types and order of columns, same number of rows, same checksum of every stride-th row.

    checksums: those of a by table_checksums(), where it is compared several times.
    """
    same = [(f.name, f.dataType.simpleString()) for f in a.schema] == [(f.name, f.dataType.simpleString()) for f in b.schema]
    if not same:
        return a.agg(F.count(F.lit(1)).alias("n")).select(*probe_row("P5", F.lit(False), F.col("n"), F.lit(0), F.lit("schema")))
    x = (table_checksums(a, order_by, stride) if checksums is None else checksums).toDF("rows", "sampled", "sum_a")
    y = table_checksums(b, order_by, stride).toDF("rows", "sampled", "sum_b")
    both = x.join(y.withColumnRenamed("rows", "rows_b").withColumnRenamed("sampled", "sampled_b"))
    passed = (F.col("rows") == F.col("rows_b")) & (F.col("sum_a") == F.col("sum_b"))
    return both.select(*probe_row("P5", passed, F.col("rows"), F.col("sampled"), F.when(F.col("rows") != F.col("rows_b"), "rows").when(~passed, "checksum").otherwise("")))


def probe_metrics(a: DataFrame, b: DataFrame, id_col: str, metrics: tuple[str, ...] = METRICS, k: int = 200) -> DataFrame:
    """One row: whether both give the same metrics on the same k sampled rows (columns y, yhat)."""
    picked = F.broadcast(hash_select(a.select(id_col), id_col, "eval_slice:" + ",".join(metrics), k))  # at most k rows
    x, y = (classification_metrics(df.join(picked, id_col, "left_semi"), metrics=metrics).toDF("n_" + s, *[f"{m}_{s}" for m in metrics]) for df, s in ((a, "a"), (b, "b")))
    both = x.join(y)
    same = F.col("n_a").eqNullSafe(F.col("n_b"))
    for m in metrics:
        same = same & F.col(f"{m}_a").eqNullSafe(F.col(f"{m}_b"))
    return both.select(*probe_row("P6", same, F.lit(k), F.col("n_a"), F.lit(",".join(metrics))))


def generate_corpus(spark, n: int, subjects: list[str], verbs: list[str], objects: list[str], tails: list[str]) -> DataFrame:
    """n rows (id, text) by a mixed-radix walk over four vocabularies."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (F.pmod(i, F.lit(len(values))) + 1).cast("int"))
    i = F.col("id")
    text = F.concat_ws(" ", pick(subjects, i), pick(verbs, F.floor(i / len(subjects))), pick(objects, F.floor(i / (len(subjects) * len(verbs)))), pick(tails, i))
    return spark.range(n).select(F.format_string("doc-%06d", i).alias("id"), F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 20))).alias("text"))


def redact(df: DataFrame, column: str) -> DataFrame:
    """The value after password, secret, token or key and a colon or equals sign becomes [REDACTED]."""
    return df.withColumn(column, F.regexp_replace(column, r"(?i)\b(password|secret|token|key)(\s*[:=]\s*)\S+", "$1$2[REDACTED]"))
