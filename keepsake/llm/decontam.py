"""Benchmark decontamination: BM25 search with block-max WAND, then overlap checks.

Test items, cut into sections of at most SECTION words, are indexed by word; a
posting's impact is its BM25 weight as a share of what the section itself would
score, so one threshold serves all sections. Every passage (WINDOW words, a new
one every STRIDE words) of every document is a query. The commonest words, up to
a share SMALL of the threshold in any section, cannot reach it by themselves, so
a passage is passed over if for no section its other words' impacts sum to the
rest (first with repeated words, in one sweep over the text, then without); the others are searched with block-max WAND and all sections at or above
the threshold are retrieved. A hit
counts if the passage holds enough of the section's word triples (the question)
and of the words of its last sentence (the answer).

The index goes to every task, as flat arrays of some four bytes a byte of its items; items are dealt into shards of about shard_bytes, one
pass over the documents each, so its size is bounded for any benchmark. Document
frequencies and the mean length are those of all sections, so scores do not depend
on the shards.

Words are runs of letters, digits and non-ASCII bytes, with A-Z folded.

Edge cases. Null or empty texts and items have no words and match nothing. Null
document ids are reported as null. Repeated rows are reported once. Empty tables
give an empty result. Input columns of any name are allowed.
"""

from __future__ import annotations

from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, Substrings, byte_values, chunks, rolling, runs, small_or_not, text_of

WINDOW, STRIDE, SECTION = 96, 16, 64
THRESHOLD, QUESTION, ANSWER = 0.5, 0.5, 0.5
SHARD_BYTES = 16 << 20
K1, B = 1.2, 0.75
BLOCK = 64
#: Postings of a word beyond which a search reads them in place.
LONG = 16 * BLOCK
#: Share of the threshold that the commonest words of any section may make up together.
SMALL = 0.4

WORD = np.zeros(256, bool)
WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True


def word_hashes(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    start, end = runs(WORD[data])
    return Substrings(byte_values(fold_case=True)[data]).hash(start, end), start, end


class Sections:
    """Words of all sections of texts, one after the other: hash, section, whether the word is of the answer; item, by its place, of each section."""

    def __init__(self, texts: pa.Array):
        words, section, answer, item = [np.empty(0, np.uint64)], [np.empty(0, np.int64)], [np.empty(0, bool)], [np.empty(0, np.int64)]
        n_sections = 0
        for first, last, data, ends in chunks(texts):
            hashes, start, end = word_hashes(data)
            of = np.searchsorted(ends, start, "right")
            n = np.bincount(of, minlength=last - first)
            j = np.arange(len(of)) - (np.cumsum(n) - n)[of]
            # a sentence ends behind a word that is not its item's last; an item of one sentence has no answer of its own
            stop = np.isin(data[end], np.frombuffer(b".!?\n", np.uint8)) & (j < n[of] - 1)
            behind = np.zeros(last - first, np.int64)
            np.maximum.at(behind, of[stop], j[stop] + 1)
            # sections as even as can be, the longer ones first
            parts = -(-n // SECTION)
            size, longer = (n // np.maximum(parts, 1))[of], (n % np.maximum(parts, 1))[of]
            part = np.where(j < longer * (size + 1), j // (size + 1), longer + (j - longer * (size + 1)) // np.maximum(size, 1))
            words.append(hashes)
            section.append(n_sections + (np.cumsum(parts) - parts)[of] + part)
            answer.append((behind[of] > 0) & (j >= behind[of]) & (part == parts[of] - 1))
            item.append(first + np.repeat(np.arange(last - first), parts))
            n_sections += int(parts.sum())
        self.words, self.section, self.answer, self.item = map(np.concatenate, (words, section, answer, item))
        self.length = np.bincount(self.section, minlength=n_sections)


def triples(words: np.ndarray) -> np.ndarray:
    """Distinct hashes of the word triples of a sequence, or of the whole sequence if it is shorter."""
    width = min(3, len(words))
    return np.unique(rolling(words, width, width)) if width else np.empty(0, np.uint64)


def _groups(group: np.ndarray, values: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(begin of each group, values): the distinct values of each of n groups, sorted."""
    order = np.lexsort((values, group))
    group, values = group[order], values[order]
    new = np.append(True, (group[1:] != group[:-1]) | (values[1:] != values[:-1]))[: len(group)]
    return np.append(0, np.cumsum(np.bincount(group[new], minlength=n))).astype(np.int32), values[new]


class Index:
    """Postings of word hashes over sections in flat arrays, in blocks with their largest impacts.

    A posting is a section and a count (5 bytes); impacts follow from the word's idf and
    the section's length. Each section's commonest words, up to a share SMALL of the
    threshold (its slack), are left out of the rare ones' postings, which hold impacts
    rounded up (8 bytes). df: words, sorted, and in how many sections of all shards each
    stands; n and mean: the number and mean length of those sections.
    """

    def __init__(self, item_ids: list, texts: list[str], df: tuple[np.ndarray, np.ndarray], n: int, mean: float):
        x = Sections(pa.array(texts, pa.large_string()))
        self.n_sections = n_sections = len(x.item)
        self.ids, self.null = np.array([i or 0 for i in item_ids], np.int64), np.array([i is None for i in item_ids], bool)
        self.item = x.item.astype(np.int32)
        self.words, term = np.unique(x.words, return_inverse=True)
        frequency = df[1][np.searchsorted(df[0], self.words)] if len(self.words) else np.empty(0)
        self.idf = np.log(1 + (n - frequency + 0.5) / (frequency + 0.5))
        self.answer_begin, self.answer = _groups(x.section[x.answer], term[x.answer].astype(np.int32), n_sections)
        # triples by the section that holds all three words, shorter sections whole
        first = np.cumsum(x.length) - x.length
        groups, hashes = [], []
        for width in (1, 2, 3):
            at = np.flatnonzero(x.section[: max(0, len(x.words) - 2)] == x.section[2:]) if width == 3 else first[x.length == width]
            groups.append(x.section[at])
            hashes.append(rolling(x.words, width, width)[at])
        self.triple_begin, self.triple = _groups(np.concatenate(groups), np.concatenate(hashes), n_sections)
        del groups, hashes
        posting, count = np.unique(term * max(n_sections, 1) + x.section, return_counts=True)
        term, section = posting // max(n_sections, 1), posting % max(n_sections, 1)
        self.sections, self.counts = section.astype(np.int32), count.astype(np.uint8)
        self.begin = self._offsets(term)
        self.norm = K1 * (1 - B + B * x.length / mean)
        self.total = np.ones(n_sections)
        impact = self.impacts(term, self.sections, self.counts)
        self.total = np.bincount(section, weights=impact, minlength=n_sections)
        impact = impact / self.total[section]
        blocks = -(-np.diff(self.begin) // BLOCK)
        self.block_begin = np.append(0, np.cumsum(blocks)).astype(np.int32)
        starts = np.repeat(self.begin[:-1], blocks) + BLOCK * (np.arange(self.block_begin[-1]) - np.repeat(self.block_begin[:-1], blocks))
        self.block_most = np.maximum.reduceat(impact, starts) if len(starts) else np.empty(0)
        self.most = np.maximum.reduceat(impact, self.begin[:-1]) if len(starts) else np.empty(0)
        order = np.lexsort((term, -frequency[term], section))
        summed = np.cumsum(impact[order])
        head = np.cumsum(np.bincount(section, minlength=n_sections)) - np.bincount(section, minlength=n_sections)
        summed -= (summed - impact[order])[head][section[order]]
        common = np.zeros(len(order), bool)
        common[order] = summed <= SMALL * THRESHOLD
        self.slack = np.bincount(section[common], weights=impact[common], minlength=n_sections)
        self.rare_begin = self._offsets(term[~common])
        self.rare_sections = self.sections[~common]
        self.rare_impacts = np.nextafter(impact[~common].astype(np.float32), np.float32(2))
        self.seen = np.zeros(1 << 16, bool)
        self.seen[(self.words[np.diff(self.rare_begin) > 0] >> np.uint64(48)).astype(np.int64)] = True

    def _offsets(self, term: np.ndarray) -> np.ndarray:
        return np.append(0, np.cumsum(np.bincount(term, minlength=len(self.words)))).astype(np.int32)

    def nbytes(self) -> int:
        """Bytes of all arrays."""
        return sum(x.nbytes for x in vars(self).values() if isinstance(x, np.ndarray))

    def impacts(self, term, section, count):
        """Share that words which stand count times in a section have in what the section itself would score."""
        return self.idf[term] * count * (K1 + 1) / (count + self.norm[section]) / self.total[section]

    def terms(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places of the words that the index holds, their terms)."""
        if not len(self.words):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        term = np.minimum(np.searchsorted(self.words, words), len(self.words) - 1)
        place = np.flatnonzero(self.words[term] == words)
        return place, term[place]

    def _rare(self, term: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number of each term's rare postings, all of them)."""
        begin = self.rare_begin[term].astype(np.int64)
        n = self.rare_begin[term + 1] - begin
        return n, np.repeat(begin - np.cumsum(n) + n, n) + np.arange(n.sum())

    def starts(self, words: np.ndarray) -> np.ndarray:
        """Places of words from which on some section's rare words may sum to what the threshold needs within a window."""
        place = np.flatnonzero(self.seen[(words >> np.uint64(48)).astype(np.int64)])
        hit, term = self.terms(words[place])
        place = place[hit]
        n, posting = self._rare(term)
        section = self.rare_sections[posting].astype(np.int64)
        key = section * (len(words) + WINDOW) + np.repeat(place, n)
        order = np.argsort(key)
        key, section = key[order], section[order]
        total = np.concatenate([[0.0], np.cumsum(self.rare_impacts[posting[order]], dtype=np.float64)])
        inside = total[np.searchsorted(key, key + WINDOW)] - total[:-1]
        return key[inside >= THRESHOLD - self.slack[section] - 1e-9] % (len(words) + WINDOW)

    def possible(self, words: np.ndarray) -> bool:
        """Whether the rare ones of these distinct words reach what some section needs."""
        _, posting = self._rare(self.terms(words)[1])
        return bool((np.bincount(self.rare_sections[posting], weights=self.rare_impacts[posting], minlength=self.n_sections) >= THRESHOLD - self.slack - 1e-9).any())

    def search(self, words: np.ndarray) -> list[tuple[int, float]]:
        """All (section, score) at or above the threshold for distinct words, by block-max WAND."""
        # of each list: place in it, its sections, its blocks' largest impacts, its largest impact, its term; a long one stays an array
        lists = []
        for t in self.terms(words)[1].tolist():
            sections = self.sections[self.begin[t] : self.begin[t + 1]]
            lists.append([0, sections if len(sections) > LONG else sections.tolist(), self.block_most[self.block_begin[t] : self.block_begin[t + 1]], float(self.most[t]), t])
        found, end = [], self.n_sections
        at = lambda x: x[1][x[0]] if x[0] < len(x[1]) else end
        while True:
            lists = sorted((x for x in lists if x[0] < len(x[1])), key=at)
            total, pivot = 0.0, None
            for k, x in enumerate(lists):
                total += x[3]
                if total >= THRESHOLD - 1e-12:
                    pivot = k
                    break
            if pivot is None:
                return found
            section = int(at(lists[pivot]))
            while pivot + 1 < len(lists) and at(lists[pivot + 1]) == section:
                pivot += 1
            ahead = lists[: pivot + 1]
            blocks = [bisect_left(x[1], section, x[0]) // BLOCK for x in ahead]
            if sum(x[2][min(b, len(x[2]) - 1)] for x, b in zip(ahead, blocks, strict=True)) >= THRESHOLD - 1e-12:
                if at(ahead[0]) == section:
                    # summed in the order of hashes, which is the same in every shard
                    term, place = np.array(sorted((x[4], x[0]) for x in ahead)).T
                    score = float(self.impacts(term, section, self.counts[self.begin[term] + place]).sum())
                    if score >= THRESHOLD - 1e-12:
                        found.append((section, score))
                    for x in ahead:
                        x[0] += 1
                else:
                    for x in ahead:
                        if at(x) < section:
                            x[0] = bisect_left(x[1], section, x[0])
            else:  # on to where some block ends, or the next list begins
                skip = min([x[1][min((b + 1) * BLOCK, len(x[1])) - 1] + 1 for x, b in zip(ahead, blocks, strict=True)] + [at(x) for x in lists[pivot + 1 : pivot + 2]])
                skip = max(int(skip), section + 1)
                for x in ahead:
                    x[0] = bisect_left(x[1], skip, x[0])

    def overlap(self, section: int, passage: np.ndarray) -> tuple[float, float]:
        """Shares of a section's word triples and of its answer's words that a passage holds; without an answer 1."""
        question = self.triple[self.triple_begin[section] : self.triple_begin[section + 1]]
        answer = self.answer[self.answer_begin[section] : self.answer_begin[section + 1]]
        return float(np.isin(question, triples(passage)).mean()), float(np.isin(answer, self.terms(passage)[1]).mean()) if len(answer) else 1.0


def _matches(docs: DataFrame, index: Index) -> DataFrame:
    def compute(batches):
        idx = index
        for batch in batches:
            rows: list[tuple] = []
            for first, _, data, ends in chunks(batch.column(2)):
                words, start, _ = word_hashes(data)
                bounds = np.searchsorted(start, np.concatenate([[0], ends]))
                # passages by their first word; a document's last one may be shorter
                n = np.maximum(1, -(-(np.diff(bounds) - WINDOW) // STRIDE) + 1)
                doc = np.repeat(np.arange(len(n)), n)
                begin = bounds[doc] + STRIDE * (np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n))
                end = np.minimum(begin + WINDOW, bounds[doc + 1])
                # those that hold a place found by starts()
                place = idx.starts(words)
                of = np.searchsorted(bounds, place, "right") - 1
                low = np.cumsum(n)[of] - n[of] + np.maximum(0, (place - bounds[of] - WINDOW) // STRIDE + 1)
                high = np.cumsum(n)[of] - n[of] + np.minimum(n[of] - 1, (place - bounds[of]) // STRIDE)
                marks = np.bincount(low, minlength=len(doc) + 1) - np.bincount(high + 1, minlength=len(doc) + 1) if len(place) else np.zeros(len(doc) + 1, int)
                for k in np.flatnonzero(np.cumsum(marks)[: len(doc)] > 0).tolist():
                    passage = words[begin[k] : end[k]]
                    if not idx.possible(np.unique(passage)):
                        continue
                    for section, score in idx.search(np.unique(passage)):
                        question, answer = idx.overlap(section, passage)
                        if question >= QUESTION and answer >= ANSWER:
                            item = idx.item[section]
                            rows.append((first + int(doc[k]), None if idx.null[item] else int(idx.ids[item]), score, int(begin[k] - bounds[doc[k]]), question, answer))
            rows_of = pa.array([r[0] for r in rows], pa.int64())
            kinds = (pa.int64(), pa.float64(), pa.int64(), pa.float64(), pa.float64())
            yield pa.RecordBatch.from_arrays([batch.column(0).take(rows_of), batch.column(1).take(rows_of), *(pa.array([r[j + 1] for r in rows], kind) for j, kind in enumerate(kinds))], names=["doc_id", "hash", "item_id", "score", "word", "question", "answer"])

    return docs.mapInArrow(compute, "doc_id long, hash long, item_id long, score double, word long, question double, answer double")


def _frequencies(items: DataFrame, tmp: Scratch) -> tuple[DataFrame, int, float]:
    """(shard, word, df) for the words of each shard of items (shard, text), and the number and mean length of all sections."""

    def compute(batches):
        for batch in batches:
            x = Sections(batch.column(1))
            words, term = np.unique(x.words, return_inverse=True)
            pair = np.unique(x.section * max(len(words), 1) + term)  # a word counts once a section
            shard = batch.column(0).to_numpy()[x.item[pair // max(len(words), 1)]].astype(np.int64)
            both, n = np.unique(shard * max(len(words), 1) + pair % max(len(words), 1), return_counts=True)
            # a row without a word holds the number of sections and of their words
            columns = ([*both // max(len(words), 1), None], [*words.view(np.int64)[both % max(len(words), 1)], None], [*n, len(x.item)], [None] * len(both) + [len(x.words)])
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["shard", "word", "n", "length"])

    found = tmp.save(items.select("shard", "text").mapInArrow(compute, "shard int, word long, n long, length long"), "words")
    n, length = found.where("word is null").agg(F.sum("n"), F.sum("length")).first()
    df = found.where("word is not null").groupBy("word").agg(F.sum("n").alias("df"))
    of_shard = found.where("word is not null").select("shard", "word").distinct().join(df, "word")
    return tmp.save(of_shard, "df"), n or 0, max(1.0, (length or 0) / max(n or 0, 1))


def contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """(doc_id, hash, item_id, score, word, question, answer): for each document and item that match, the best passage and its first word."""
    text = text_of(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    items = items.select(F.col(item_col).cast("long").alias("item_id"), text_of(item_text_col).alias("text"))
    with Scratch(docs.sparkSession) as tmp:
        shards = max(1, -(-(items.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // shard_bytes))
        items = tmp.save(items.withColumn("shard", F.pmod(F.xxhash64(F.monotonically_increasing_id(), "item_id", "text"), F.lit(shards)).cast("int")), "items")
        frequencies, n, mean = _frequencies(items, tmp)
        found = None
        for k in range(shards):
            of_shard = frequencies.where(F.col("shard") == k).select("word", "df").toArrow()
            words, df = of_shard["word"].to_numpy().view(np.uint64), of_shard["df"].to_numpy()
            order = np.argsort(words)
            shard = sorted((r["item_id"] is None, r["item_id"] or 0, r["text"]) for r in items.where(F.col("shard") == k).collect())
            some = _matches(source, Index([None if null else i for null, i, _ in shard], [t for *_, t in shard], (words[order], df[order]), n, mean))
            found = some if found is None else found.unionByName(some)
    best = F.max_by(F.struct("score", "word", "question", "answer"), F.struct("score", -F.col("word"))).alias("best")
    return found.groupBy("doc_id", "hash", "item_id").agg(best).select("doc_id", "hash", "item_id", "best.*")


def remove_contaminated(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **columns) -> DataFrame:
    """The rows of docs, unchanged, that match no item."""
    gone = contaminated(docs, items, id_col, text_col, **columns).select(F.col("doc_id").alias("_gone"), F.col("hash").alias("_gone_hash")).distinct()
    with Scratch(docs.sparkSession) as tmp:
        gone = small_or_not(tmp.result(gone, "contaminated"))
    return docs.join(gone, docs[id_col].cast("long").eqNullSafe(gone["_gone"]) & (F.xxhash64(F.coalesce(docs[text_col].cast("string"), F.lit(""))) == gone["_gone_hash"]), "left_anti")
