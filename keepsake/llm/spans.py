"""Substring dedup by sliding spans of sentences.

A sentence ends at a word that ends in ".", "!" or "?", at a line's end, or
after MAX_WORDS words. Every run of at least SENTENCES consecutive sentences with
at least LEAST_WORDS words is hashed (96 bits, words only, A-Z folded). Cuts after
MAX_WORDS words depend on where a long sentence starts, so runs of LONG_RUN words are
hashed too wherever sentences are long, and these are chosen by content (winnowing):
of each WINDOW neighbouring ones that of least hash, the first of equal ones. Copies
of a passage of LONG_RUN + WINDOW - 1 = 50 words thus share a run whatever stands
before them, and a run of LONG_RUN words holds a whole sentence at least.

Runs whose hash stands in one place only are left out first (shared.py). The others
of all documents are joined on their hash, and sentences whose words all
lie in runs which are not the first of their hash are removed. The first is the one
in the smallest doc_id and there the earliest; rows that share this id all count as
first. A sentence that lies only partly in such runs stays.

Edge cases. Null or empty text has no sentences. Null ids count as the largest
id. Repeated rows are rows of one id. Text that stands between removed sentences
stays as it is; a document may become empty. An empty table gives an empty
result. Input columns of any name are allowed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import SPACES, Scratch, Substrings, byte_values, chunks, mix, runs, small_or_not, split_changed, text_of
from keepsake.llm.shared import Chunks, levels_of, shared_hashes

SENTENCES = 3
LEAST_WORDS = 15
MAX_WORDS = 12
#: Words of a run that is chosen by content, and neighbouring ones of which one is chosen.
LONG_RUN, WINDOW = 2 * MAX_WORDS, 27
_LAST = (1 << 63) - 1
_SPANS = "array<struct<i: int, m: int>>"


class Sentences:
    """Sentences of a stretch of rows: doc, first byte, first and end word of each; spans of them."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        self.ends = ends
        start, end = runs(~SPACES[data])
        self.word_doc = np.searchsorted(ends, start, "right")
        feeds = np.concatenate([[0], np.cumsum(data == 10)])
        closes = np.isin(data[end - 1], np.frombuffer(b".!?", np.uint8))
        if len(start):
            closes[:-1] |= feeds[start[1:]] > feeds[end[:-1]]
            closes[-1] = True
        opens = np.concatenate([[True], closes[:-1]])[: len(start)]
        self.whole = np.flatnonzero(opens)
        at = np.arange(len(start))
        opens |= (at - np.maximum.accumulate(np.where(opens, at, 0))) % MAX_WORDS == 0
        self.first_word = np.flatnonzero(opens)
        self.end_word = np.append(self.first_word[1:], len(start))[: len(self.first_word)]
        self.doc = self.word_doc[self.first_word]
        self.first_byte = start[self.first_word]
        self.words = Substrings(byte_values(fold_case=True)[data]).hash(start, end)

    def _by_content(self) -> np.ndarray:
        """First words of the runs of LONG_RUN words that are chosen by content."""
        n = len(self.words)
        size = np.diff(np.append(self.whole, n))
        n_long = np.concatenate([[0], np.cumsum(np.repeat(size > MAX_WORDS, size))])
        width = LONG_RUN + WINDOW - 1
        begin = np.arange(max(n - width + 1, 0))
        # what is cut off at either end of a passage may look short; without a long sentence between, whole sentences are enough
        long = n_long[begin + width - MAX_WORDS] > n_long[begin + MAX_WORDS]
        begin = begin[long & (self.word_doc[begin] == self.word_doc[begin + width - 1])]
        at = np.arange(max(n - LONG_RUN + 1, 0))
        runs_at = Substrings(mix(self.words, 13)).hash(at, at + LONG_RUN)
        least, place = runs_at[begin], begin.copy()
        for j in range(1, WINDOW):
            other = runs_at[begin + j]
            less = other < least
            least[less] = other[less]
            place[less] = begin[less] + j
        return np.unique(place)

    def spans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(first word, end word, two hashes) of each run."""
        n = len(self.doc)
        i = np.arange(n)
        last = np.maximum(i + SENTENCES - 1, np.searchsorted(self.end_word, self.first_word + LEAST_WORDS, "left"))
        i = i[last < n]
        last = last[last < n]
        inside = self.doc[i] == self.doc[last]
        first, end = self.first_word[i[inside]], self.end_word[last[inside]]
        more = self._by_content()
        known = first[end - first == LONG_RUN]
        more = more[~np.isin(more, known)]
        first, end = np.concatenate([first, more]), np.concatenate([end, more + LONG_RUN])
        hashes = [Substrings(mix(self.words, k)).hash(first, end) for k in (11, 12)]
        return first, end, *hashes


def _runs_of(docs: DataFrame) -> DataFrame:
    """(chunk, doc_id, hash, h, g, i, m, again: arrays): the spans of each document.

    Each is m words from the i-th; h and g hash it, one entry for each h of a document; again: places of later ones that
    are equal in their own document.
    """
    kinds = {"h": pa.int64(), "g": pa.int32(), "i": pa.int32(), "m": pa.int32()}

    def compute(batches):
        numbers = Chunks(TaskContext.get().partitionId())
        for batch in batches:
            for first, last, data, ends in chunks(batch.column(2)):
                s = Sentences(data, ends)
                i, end, h1, h2 = s.spans()
                doc = s.word_doc[i]
                order = np.lexsort((i, h2, h1, doc))
                i, end, h1, h2, doc = i[order], end[order], h1[order], h2[order], doc[order]
                again = np.zeros(len(i), bool)
                again[1:] = (doc[1:] == doc[:-1]) & (h1[1:] == h1[:-1]) & (h2[1:] == h2[:-1])
                place = (i - np.searchsorted(s.word_doc, doc)).astype(np.int32)

                def lists(which: np.ndarray, values: dict) -> list[pa.Array]:
                    offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[which], minlength=last - first))]).astype(np.int32))
                    return [pa.ListArray.from_arrays(offsets, pa.array(v[which], kinds[k])) for k, v in values.items()]

                own = {"h": h1.view(np.int64), "g": (h2 >> np.uint64(32)).astype(np.uint32).view(np.int32), "i": place, "m": (end - i).astype(np.int32)}
                n = np.bincount(doc[~again], minlength=last - first)
                rows = [pa.array(numbers.of(n)), batch.column(0).slice(first, last - first), batch.column(1).slice(first, last - first), *lists(~again, own)]
                offsets = pa.array(np.concatenate([[0], np.cumsum(np.bincount(doc[again], minlength=last - first))]).astype(np.int32))
                rows.append(pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(own[k][again], kinds[k]) for k in "im"], names=["i", "m"])))
                yield pa.RecordBatch.from_arrays(rows, names=["chunk", "doc_id", "hash", *own, "again"])

    return docs.mapInArrow(compute, f"chunk long, doc_id long, hash long, h array<bigint>, g array<int>, i array<int>, m array<int>, again {_SPANS}")


def _shared_spans(found: DataFrame, tmp: Scratch) -> DataFrame:
    """(doc_id, hash, h, g, i, m) of the spans whose hash other rows hold too."""
    total = found.agg(F.sum(F.size("h"))).first()[0] or 0
    answers = shared_hashes(found.select("chunk", "h"), total)

    def pick(rows: pa.Table, answers: pa.Table) -> pa.Table:
        h = rows.column("h").combine_chunks()
        shared = levels_of(h.flatten().to_numpy().view(np.uint64), answers) > 0
        owner = pa.array(np.repeat(np.arange(len(h)), h.value_lengths().to_numpy())[shared])
        keep = pa.array(shared)
        return pa.table({"doc_id": rows.column("doc_id").take(owner), "hash": rows.column("hash").take(owner), **{c: rows.column(c).combine_chunks().flatten().filter(keep) for c in "hgim"}})

    rows = found.select("chunk", "doc_id", "hash", "h", "g", "i", "m").groupBy("chunk")
    return tmp.save(rows.cogroup(answers.groupBy("chunk")).applyInArrow(pick, "doc_id long, hash long, h long, g int, i int, m int"), "shared")


def repeated_spans(docs: DataFrame, tmp: Scratch, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, hash, gone: array of (i, m)): for each document that has any, its spans of m words that are not the first."""
    text = text_of(text_col)
    found = tmp.save(_runs_of(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))), "spans")
    shared = _shared_spans(found, tmp)
    place = F.coalesce("doc_id", F.lit(_LAST))
    # spans that stand in several documents, with the smallest id; a table of its own, so that Spark can split what many documents share
    several = tmp.save(shared.groupBy("h", "g").agg(F.min(place).alias("least"), F.max(place).alias("most")).where("least < most").select("h", "g", "least"), "several")
    later = shared.join(small_or_not(several), ["h", "g"]).where(place > F.col("least")).select("doc_id", "hash", "i", "m")
    later = later.unionByName(found.where(F.size("again") > 0).select("doc_id", "hash", F.inline("again")))
    return tmp.result(later.groupBy("doc_id", "hash").agg(F.sort_array(F.collect_set(F.struct("i", "m"))).alias("gone")), "gone")


def _cleaner(text_at: int, with_counts: bool):
    def apply(batches):
        for batch in batches:
            row = batch.column(0)
            texts = row.field(text_at)
            gone = batch.column(1).to_pylist() if batch.num_columns > 1 else [None] * batch.num_rows
            new, total, dropped = [], [], []
            for first, last, data, ends in chunks(texts):
                s = Sentences(data, ends)
                bounds = np.searchsorted(s.doc, np.arange(last - first + 1))
                for k in range(last - first):
                    a, b = bounds[k], bounds[k + 1]
                    words = int(s.end_word[b - 1] - s.first_word[a]) if b > a else 0
                    drop = np.zeros(words + 1, np.int32)
                    for g in gone[first + k] or ():
                        drop[g["i"]] += 1
                        drop[g["i"] + g["m"]] -= 1
                    covered = np.concatenate([[0], np.cumsum(np.cumsum(drop[:-1]) > 0)])
                    first_word, end_word = (x[a:b] - (s.first_word[a] if b > a else 0) for x in (s.first_word, s.end_word))
                    drop = covered[end_word] - covered[first_word] == end_word - first_word
                    begin, end = (int(ends[k - 1]) if k else 0), int(ends[k]) - 1
                    edges = np.append(s.first_byte[a:b], end)
                    kept = [data[begin : edges[0]].tobytes()] + [data[edges[j] : edges[j + 1]].tobytes() for j in np.flatnonzero(~drop)]
                    new.append(b"".join(kept).decode("utf-8"))
                    total.append(b - a)
                    dropped.append(int(drop.sum()))
            fields = [row.type.field(j) for j in range(row.type.num_fields)]
            columns = [pa.array(new, pa.string()).cast(fields[j].type) if j == text_at else row.field(j) for j in range(len(fields))]
            out = [pa.StructArray.from_arrays(columns, fields=fields)]
            names = ["_row"]
            if with_counts:
                out += [pa.array(total, pa.int64()), pa.array(dropped, pa.int64())]
                names += ["n_sentences", "n_removed"]
            yield pa.RecordBatch.from_arrays(out, names=names)

    return apply


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = False) -> DataFrame:
    """(_row: struct of all columns of docs, with the text that is left[, n_sentences, n_removed]).

    A text that loses nothing keeps its bytes; a null text becomes empty.
    """
    with Scratch(docs.sparkSession) as tmp:
        rows, changed = split_changed(docs, repeated_spans(docs, tmp, id_col, text_col), id_col, text_col)
    apply = _cleaner(docs.columns.index(text_col), with_counts)
    kind = docs.schema.simpleString()
    schema = f"_row {kind}" + ", n_sentences long, n_removed long" * with_counts
    return rows.select(F.struct("*").alias("_row")).mapInArrow(apply, schema).unionByName(changed.mapInArrow(apply, schema))
