"""Toxicity by a chain of linear classifiers.

The categories are predicted one after another. Each model is a logistic
regression over the presence of those hashed words and symbol runs whose rates
differ clearly between labelled rows with and without the category, and over the
probabilities of the earlier categories; in training these are out-of-fold
predictions, so a later model does not rely on how well an earlier one knows its
own training rows. The models are fitted on at most SAMPLE labelled rows, those
of the smallest id hashes; every document is scored.

Edge cases. Null or empty text has no features and gets each model's base
probability. Labels that are null or whose id is null or has no document are not
used; without labelled rows every probability is 0. Null ids and repeated rows
are scored like any other row. Of several documents of one labelled id the one with
the smallest text hash is used, and of several labels of one id the largest of each
category. An empty table gives an empty result. Input columns of any name are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import SPACES, Substrings, byte_values, chunks, runs, text_of
from keepsake.llm.decontam import WORD

SAMPLE = 10_000
FOLDS = 3
#: Probability of the last category from which a document counts as toxic; low, since a missed toxic document costs more than a lost clean one.
THRESHOLD = 0.3
BITS = 20
LEAST_ROWS, LEAST_Z = 5, 5.0
STEPS, RATE, PENALTY = 400, 2.0, 1e-5
#: Category and the condition on the labels table that defines it; earlier ones feed later ones.
CATEGORIES = [("low_quality", "quality = 0"), ("toxic", "toxic = 1")]


def features(texts: pa.Array):
    """For each stretch of rows: (first row, number of rows, row and hash bucket of each word and symbol run)."""
    values = byte_values(fold_case=True)
    for first, last, data, ends in chunks(texts):
        words, symbols = runs(WORD[data]), runs(~WORD[data] & ~SPACES[data])
        sub = Substrings(values[data])
        start = np.concatenate([words[0], symbols[0]])
        bucket = (sub.hash(start, np.concatenate([words[1], symbols[1]])) >> np.uint64(64 - BITS)).astype(np.int64)
        yield first, last - first, np.searchsorted(ends, start, "right"), bucket


class Model:
    """Weights of hash buckets and of earlier probabilities."""

    def __init__(self, x: list[np.ndarray], earlier: np.ndarray, y: np.ndarray):
        rows = np.repeat(np.arange(len(x)), [len(b) for b in x])
        flat = np.concatenate(x) if len(x) else np.empty(0, np.int64)
        with_y = np.bincount(flat, weights=y[rows], minlength=1 << BITS)
        total = np.bincount(flat, minlength=1 << BITS)
        n, n1 = max(len(y), 1), max(float(y.sum()), 1.0)
        n0 = max(n - n1, 1.0)
        p = np.clip(total / n, 1e-9, 1 - 1e-9)
        z = (with_y / n1 - (total - with_y) / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0))
        self.buckets = np.flatnonzero((total >= LEAST_ROWS) & (np.abs(z) >= LEAST_Z))
        column = np.full(1 << BITS, -1)
        column[self.buckets] = np.arange(len(self.buckets))
        used = column[flat] >= 0
        rows, cols = rows[used], column[flat[used]]
        k, m = len(self.buckets), earlier.shape[1]
        w, step = np.zeros(k + m + 1), np.zeros(k + m + 1)
        base = np.clip(y.mean() if len(y) else 0.0, 1e-6, 1 - 1e-6)
        w[-1] = np.log(base / (1 - base))
        for _ in range(STEPS if len(y) else 0):
            r = 1 / (1 + np.exp(-np.clip(np.bincount(rows, weights=w[cols], minlength=len(y)) + earlier @ w[k : k + m] + w[-1], -40, 40))) - y
            g = np.concatenate([np.bincount(cols, weights=r[rows], minlength=k), earlier.T @ r, [r.sum()]]) / len(y) + PENALTY * w
            step += g * g
            w -= RATE * g / np.sqrt(step + 1e-12)
        self.weights, self.earlier, self.bias = w[:k], w[k : k + m], w[-1]

    def table(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.buckets] = self.weights
        return out

    def predict(self, score: np.ndarray, earlier: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(score + earlier @ self.earlier + self.bias, -40, 40)))


def fit_chain(x: list[np.ndarray], labels: np.ndarray, folds: np.ndarray) -> list[Model]:
    """A model for each column of labels; x: distinct buckets of each row."""
    earlier, models = np.empty((len(x), 0)), []
    for j in range(labels.shape[1]):
        y = labels[:, j].astype(float)
        models.append(Model(x, earlier, y))
        out_of_fold = np.zeros(len(x))
        for f in range(FOLDS):
            train, held = np.flatnonzero(folds != f), np.flatnonzero(folds == f)
            m = Model([x[i] for i in train], earlier[train], y[train])
            table = m.table()
            out_of_fold[held] = m.predict(np.array([table[x[i]].sum() for i in held]), earlier[held])
        earlier = np.column_stack([earlier, out_of_fold])
    return models


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id_col: str = "doc_id", categories=CATEGORIES, sample: int = SAMPLE) -> list[Model]:
    conditions = [F.expr(c).cast("boolean").alias(f"_y{j}") for j, (_, c) in enumerate(categories)]
    marked = labels.select(F.col(label_id_col).cast("long").alias("_id"), *conditions).where(" and ".join(f"_y{j} is not null" for j in range(len(categories))) + " and _id is not null")
    # a bounded number of labelled ids, the same ones for any layout of the table
    marked = marked.groupBy("_id").agg(*[F.max(f"_y{j}").alias(f"_y{j}") for j in range(len(categories))])
    marked = F.broadcast(marked.orderBy(F.xxhash64("_id"), "_id").limit(sample))
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), text_of(text_col).alias("_text")).join(marked, "_id")

    def compute(batches):
        for batch in batches:
            found = []
            for _, n, row, bucket in features(batch.column(1)):
                both = np.unique(row << BITS | bucket)
                found += np.split((both & ((1 << BITS) - 1)).astype(np.int32), np.searchsorted(both >> BITS, np.arange(1, n)))
            ends = np.cumsum([0, *map(len, found)]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.empty(0, np.int32), *found])))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(batch.column(2 + j) for j in range(len(categories))), lists], names=["id", *(f"y{j}" for j in range(len(categories))), "buckets"])

    schema = "id long, " + "".join(f"y{j} boolean, " for j in range(len(categories))) + "buckets array<int>"
    # one document for each labelled id, so the sample stays bounded where documents repeat
    first = F.min_by(F.struct("_text", *[f"_y{j}" for j in range(len(categories))]), F.struct(F.xxhash64("_text"), "_text")).alias("first")
    got = rows.groupBy("_id").agg(first).select("_id", "first.*").mapInArrow(compute, schema).toPandas().sort_values("id")
    return fit_chain([np.asarray(b, np.int64) for b in got["buckets"]], got[[f"y{j}" for j in range(len(categories))]].to_numpy(bool), (got["id"].to_numpy(np.int64) // 7 % FOLDS))


def score(docs: DataFrame, models: list[Model], columns: list[str], text_col: str = "text", categories=CATEGORIES) -> DataFrame:
    """(columns, p_<category> for each category)."""
    used = np.unique(np.concatenate([m.buckets for m in models]))
    at = np.zeros(1 << BITS, np.int32)
    at[used] = np.arange(1, len(used) + 1)
    weights = np.vstack([np.zeros(len(models)), np.column_stack([m.table()[used] for m in models])])
    own = F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row")
    rows = docs.select(own, text_of(text_col).alias("_text"))
    names = [f"p_{c}" for c, _ in categories]

    def compute(batches):
        for batch in batches:
            parts = [np.empty((0, len(models)))]
            for _, n, row, bucket in features(batch.column(1)):
                column = at[bucket]
                hit = column > 0
                both = np.unique(row[hit] << 32 | column[hit])
                row, column = both >> 32, both & 0xFFFFFFFF
                p = np.empty((n, 0))
                for j, m in enumerate(models):
                    p = np.column_stack([p, m.predict(np.bincount(row, weights=weights[column, j], minlength=n), p)])
                parts.append(p)
            p = np.round(np.concatenate(parts), 6)
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, p.T)], names=["_row", *names])

    return rows.mapInArrow(compute, f"_row {rows.schema['_row'].dataType.simpleString()}, " + ", ".join(f"{c} double" for c in names)).select("_row.*", *names)
