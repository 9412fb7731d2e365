"""Line dedup by a segment-partition edit join.

Lines (trimmed of ASCII white space) that are equal or within EDITS edits of each
other, directly or through others, form a class; a class's first line stays and
its other lines go. The first is the one in the smallest doc_id and there the
earliest; rows that share this id all count as first.

Equal lines are grouped by 128-bit hashes. For the rest, a line of length L is
cut into EDITS + 1 segments, so a line within EDITS edits holds one of them
unchanged at a place that differs by few characters. Segments are keyed by
length, number and content; a line probes the keys of every length from
L - EDITS to L at the places that its edits allow. An edit changes the parity of
at most four pairs of neighbouring characters, so pairs that meet are dropped if
64 parities differ in more; the others are verified by a banded bit-parallel edit
distance. A line is first compared with the first
line of every key, a star for each key; after that only pairs that are not yet in
one class are. A key with more than HOT such comparisons is split first: without
the segment that its lines share, they are cut into EDITS + 1 segments again, and
only those that share one of these as well are compared; again until no key is hot.
What is left of two lines that an alignment with the shared segment links is within
EDITS edits too, so no link is lost; whole lines are verified, so none is made up.

Lines without a word are never touched; lines shorter than near_length
characters, an argument of EDITS + 1 or more, are only compared for equality: two
edits turn a short heading or number into any other.

Edge cases. Null or empty text has no lines. Null ids count as the largest id.
Repeated rows are rows of one id. An empty table gives an empty result. Input
columns of any name are allowed. A document whose lines all go becomes empty.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keepsake.llm.common import Scratch, Substrings, chunks, mix, small_or_not, split_changed, text_of
from keepsake.llm.components import components

EDITS = 2
#: Least characters of a line that may be a near copy, unless another length is asked for.
NEAR_LENGTH = 24
#: Bits of the filter of segment keys, a broadcast of 2 ** BITS / 8 bytes for any corpus.
BITS = 27
#: Lines whose keys a task remembers to have sent.
REMEMBERED = 1 << 20
#: Comparisons (own lines times lines) beyond which a key is split by further segments.
HOT = 1 << 16
#: Pair parities that may differ.
PARITIES = 4 * EDITS
_LAST = (1 << 63) - 1


class Lines:
    """Lines of a stretch of rows, by code points: doc, number, start, end (trimmed), hashes; blank ones left out."""

    def __init__(self, data: np.ndarray, ends: np.ndarray):
        points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
        doc_ends = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[ends]
        feeds = np.flatnonzero(points == 10)
        start, end = np.concatenate([[0], feeds[:-1] + 1])[: len(feeds)], feeds
        doc = np.searchsorted(doc_ends, start, "right")
        begin = np.searchsorted(doc, np.arange(len(ends)))
        number = np.arange(len(start)) - begin[doc]
        blank = (points == 32) | ((points >= 9) & (points <= 13))
        solid = np.flatnonzero(~blank)
        first, last = np.searchsorted(solid, start), np.searchsorted(solid, end)
        kept = last > first
        self.doc, self.number = doc[kept], number[kept]
        self.start, self.end = solid[first[kept]], solid[last[kept] - 1] + 1
        wide = points.astype(np.uint64)
        pairs = np.uint64(1) << (mix(wide[:-1] << np.uint64(32) | wide[1:], 25) & np.uint64(63))
        parity = np.concatenate([[np.uint64(0)], np.bitwise_xor.accumulate(pairs)]) if len(pairs) else np.zeros(1, np.uint64)
        self.parity = parity[self.end - 1] ^ parity[self.start]
        self.points = Substrings(mix(points.astype(np.uint64), 21))
        self.h1 = self.points.hash(self.start, self.end)
        self.h2 = mix(Substrings(mix(points.astype(np.uint64), 22)).hash(self.start, self.end), 23)

    def keys(self, which: np.ndarray):
        """(line, key, own, form) of the segments (own) and probes of lines given by index, all long enough; form tells _cut() where."""
        lines, keys, owns, forms = [], [], [], []
        length = self.end[which] - self.start[which]
        for less in range(EDITS + 1):  # segments of lines that are so much shorter
            size = length - less
            base, longer = size // (EDITS + 1), size % (EDITS + 1)
            for i in range(EDITS + 1):
                # the last segments take what the division leaves
                at = base * i + np.maximum(0, i - (EDITS + 1 - longer))
                width = base + (i >= EDITS + 1 - longer)
                low, high = max(-i, less - (EDITS - i)), min(i, less + EDITS - i)
                for shift in range(low, high + 1):
                    begin = self.start[which] + at + shift
                    fits = (at + shift >= 0) & (at + shift + width <= length)
                    with np.errstate(over="ignore"):
                        key = mix(self.points.hash(begin[fits], (begin + width)[fits]) + (size[fits] * (EDITS + 1) + i).astype(np.uint64), 24)
                    lines.append(which[fits])
                    keys.append(key)
                    owns.append(np.full(len(key), less == 0 and shift == 0))
                    forms.append(np.full(len(key), (less * (EDITS + 1) + i) * (2 * EDITS + 1) + shift + EDITS, np.int8))
        return np.concatenate(lines), np.concatenate(keys), np.concatenate(owns), np.concatenate(forms)


def edits_within(a: str, b: str, most: int) -> bool:
    """Whether the edit distance of a and b is at most `most`: bit-parallel, in a band that slides along the diagonal."""
    if a == b:
        return True
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > most:
        return False
    p = 0
    while p < len(b) and a[p] == b[p]:
        p += 1
    q = 0
    while q < len(b) - p and a[-1 - q] == b[-1 - q]:
        q += 1
    a, b = a[p : len(a) - q], b[p : len(b) - q]
    if len(a) <= most:
        return True  # at most one edit for each character of the longer
    if not b:
        return False
    width = 2 * most + 1
    mask = (1 << width) - 1
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | (1 << i)
    # bit k of the band in column j is row j + k - most of a; rows above a count as matched vertical steps
    vp, vn, score, bottom = (mask << most) & mask, 0, most, 1 << (width - 1)
    row_bit = bottom >> 1
    for j, c in enumerate(b):
        at = places.get(c, 0)
        offset = j - most
        match = ((at >> offset) if offset >= 0 else (at << -offset)) & mask
        d0 = (((match & vp) + vp) ^ vp) & mask | match | vn
        hp = (vn | ~(d0 | vp)) & mask
        hn = d0 & vp
        if j < len(a) - most:
            score += not d0 & bottom
        else:
            score += bool(hp & row_bit) - bool(hn & row_bit)
            row_bit >>= 1
        vp = (hn | ~((d0 >> 1) | hp)) & mask
        vn = (d0 >> 1) & hp
        if score > 2 * most + len(b) - len(a) + most:
            return False
    return score <= most


def _scan(docs: DataFrame, near_length: int) -> DataFrame:
    """Rows (kind 0: doc_id, hash, number, h1, h2) of lines and (kind 1: h1, h2) of filter words: place and bits."""

    def compute(batches):
        own = np.zeros(1 << (BITS - 6), np.uint64)
        for batch in batches:
            for first, _, data, ends in chunks(batch.column(2)):
                x = Lines(data, ends)
                rows = pa.array(x.doc + first)
                yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(rows), np.int8)), batch.column(0).take(rows), batch.column(1).take(rows), pa.array(x.number.astype(np.int32)), pa.array(x.h1.view(np.int64)), pa.array(x.h2.view(np.int64))], names=["kind", "doc_id", "hash", "number", "h1", "h2"])
                near = np.flatnonzero(x.end - x.start >= near_length)
                _, keys, mine, _ = x.keys(near)
                place = keys[mine] >> np.uint64(64 - BITS)
                np.bitwise_or.at(own, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        used = np.flatnonzero(own)
        null = pa.nulls(len(used), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(np.ones(len(used), np.int8)), null, null, pa.nulls(len(used), pa.int32()), pa.array(used), pa.array(own[used].view(np.int64))], names=["kind", "doc_id", "hash", "number", "h1", "h2"])

    return docs.mapInArrow(compute, "kind tinyint, doc_id long, hash long, number int, h1 long, h2 long")


def _keys(docs: DataFrame, filter_words, near_length: int) -> DataFrame:
    """(key, own, form, line, parity): segment keys, and those probes that some segment may match."""

    def compute(batches):
        words = filter_words.value
        sent = np.zeros(REMEMBERED, np.uint64)
        for batch in batches:
            for _, _, data, ends in chunks(batch.column(2)):
                x = Lines(data, ends)
                near = np.flatnonzero(x.end - x.start >= near_length)
                near = near[np.unique(x.h1[near], return_index=True)[1]]
                slot = (x.h1[near] % np.uint64(REMEMBERED)).astype(np.int64)
                new = sent[slot] != x.h1[near]
                sent[slot] = x.h1[near]
                line, keys, own, form = x.keys(near[new])
                place = keys >> np.uint64(64 - BITS)
                hit = own | ((words[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)).astype(bool)
                yield pa.RecordBatch.from_arrays([pa.array(keys[hit].view(np.int64)), pa.array(own[hit]), pa.array(form[hit]), pa.array(x.h1[line[hit]].view(np.int64)), pa.array(x.parity[line[hit]].view(np.int64))], names=["key", "own", "form", "line", "parity"])

    return docs.mapInArrow(compute, "key long, own boolean, form tinyint, line long, parity long")


def _texts(needed: DataFrame, lines: DataFrame, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """(h1, t): the text of each line that needed (h1) names."""
    needed = small_or_not(tmp.save(needed.distinct(), "needed"))
    at = F.struct(F.coalesce("doc_id", F.lit(_LAST)).alias("p"), "doc_id", "hash", "number")
    at = lines.join(needed, "h1", "left_semi").groupBy("h1").agg(F.min(at).alias("at"))
    at = tmp.save(at.groupBy("at.doc_id", "at.hash").agg(F.collect_list(F.struct("h1", "at.number")).alias("wanted")), "places")
    ids = small_or_not(at.select("doc_id", "hash"))
    found = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]) & (docs["hash"] == ids["hash"]), "left_semi").dropDuplicates(["doc_id", "hash"])
    found = found.join(at, found["doc_id"].eqNullSafe(at["doc_id"]) & (found["hash"] == at["hash"])).select(F.split("text", "\n").alias("all"), "wanted")
    return found.select(F.inline(F.transform("wanted", lambda w: F.struct(w["h1"].alias("h1"), F.regexp_replace(F.get("all", w["number"]), r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", "").alias("t")))))


def _within(pairs: DataFrame) -> DataFrame:
    """(a, b) of those pairs (a, b, t_a, t_b) whose texts are within EDITS edits."""

    def compare(batches):
        for batch in batches:
            keep = [edits_within(x, y, EDITS) for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(2), batch.column(3))], names=["a", "b"])

    return pairs.select("t_a", "t_b", "a", "b").mapInArrow(compare, "a long, b long")


def _verified(pairs: DataFrame, lines: DataFrame, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """Those of pairs (a, b: line hashes) that are within EDITS edits."""
    pairs = tmp.save(pairs.select("a", "b").distinct(), "pairs")
    texts = _texts(pairs.select(F.col("a").alias("h1")).union(pairs.select("b")), lines, docs, tmp)
    x, y = (texts.select(F.col("h1").alias(k), F.col("t").alias(f"t_{k}")) for k in "ab")
    return tmp.save(_within(pairs.join(x, "a").join(y, "b")), "links")


def _open(shared: DataFrame, label: DataFrame, tmp: Scratch) -> DataFrame:
    """Rows of those keys of shared whose lines are of several classes, with class and hot."""
    named = shared.join(label.withColumnRenamed("node", "line"), "line", "left").withColumn("class", F.coalesce("component", "line")).drop("component")
    size = F.count_if("own") * F.count("key")
    open_keys = named.groupBy("key").agg(F.min("class").alias("l"), F.max("class").alias("m"), (size > HOT).alias("hot")).where("l <> m").select("key", "hot")
    return tmp.save(named.join(open_keys, "key"), "open")


def _pairs(named: DataFrame, *more: str) -> DataFrame:
    """Pairs of an own line and another one of its key, of different classes, as a and b with the columns more of each."""
    x, y = (named.select("key", F.col("own").alias(f"own_{k}"), F.col("line").alias(k), F.col("parity").alias(f"parity_{k}"), F.col("class").alias(f"class_{k}"), *(F.col(m).alias(f"{m}_{k}") for m in more)) for k in "ab")
    return x.where("own_a").join(y, (x["key"] == y["key"]) & F.expr(f"class_a <> class_b and (not own_b or a < b) and bit_count(parity_a ^ parity_b) <= {PARITIES}"))


def _cut(text, less, number, shift):
    """(begin, width) of segment number, shifted, where text has less characters more than the line that is cut."""
    size = F.length(text) - less
    longer = size % (EDITS + 1)
    base = ((size - longer) / (EDITS + 1)).cast("int")
    return base * number + F.greatest(F.lit(0), number - (EDITS + 1 - longer)) + shift, base + F.when(number >= EDITS + 1 - longer, 1).otherwise(0)


def _without(text, begin, width):
    return F.concat(F.substring(text, F.lit(1), begin), F.substring(text, begin + width + 1, F.length(text)))


def _segments(rows: DataFrame) -> DataFrame:
    """Rows (key, own, line, parity, less, t, whole) by the segments of t, what is left of their lines, which t loses."""
    shifts = [(i, s) for i in range(EDITS + 1) for s in range(-i, i + 1)]
    at = F.explode(F.array(*(F.struct(F.lit(i).alias("i"), F.lit(s).alias("s")) for i, s in shifts)))
    rows = rows.select("*", at.alias("at")).where(F.expr(f"at.s between less - ({EDITS} - at.i) and less + {EDITS} - at.i"))
    begin, width = _cut(F.col("t"), F.col("less"), F.col("at.i"), F.col("at.s"))
    rows = rows.withColumn("begin", begin).withColumn("width", width).where("begin >= 0 and begin + width <= length(t)")
    key = F.xxhash64("key", F.length("t") - F.col("less"), "at.i", F.substring(F.col("t"), F.col("begin") + 1, F.col("width")))
    return rows.select(key.alias("key"), F.expr("own and less = 0 and at.s = 0").alias("own"), "line", "parity", "less", _without(F.col("t"), F.col("begin"), F.col("width")).alias("t"), "whole")


def _hot_links(hot: DataFrame, links: DataFrame, lines: DataFrame, docs: DataFrame, tmp: Scratch) -> DataFrame:
    """links, and those between lines of hot keys: by further segments until no key is hot."""
    texts = _texts(hot.select(F.col("line").alias("h1")), lines, docs, tmp)
    form = lambda of: F.expr(of).cast("int")
    less, number, shift = form(f"form div {(EDITS + 1) * (2 * EDITS + 1)}"), form(f"form div {2 * EDITS + 1} % {EDITS + 1}"), form(f"form % {2 * EDITS + 1} - {EDITS}")
    begin, width = _cut(F.col("t"), F.col("less"), number, shift)
    rows = hot.withColumn("less", less).join(texts.withColumnRenamed("h1", "line"), "line").withColumn("begin", begin).withColumn("width", width)
    rows = rows.select("key", "own", "line", "parity", "less", _without(F.col("t"), F.col("begin"), F.col("width")).alias("t"), F.col("t").alias("whole"))
    while True:
        keys = tmp.save(_segments(rows).distinct(), "keys")
        first = F.when(F.col("own"), F.struct("line", "parity", "whole"))
        several = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.min(first).alias("hub")).where("low < high and hub is not null").drop("low", "high")
        shared = tmp.save(keys.join(several, "key"), "shared")
        stars = shared.where(f"line <> hub.line and bit_count(parity ^ hub.parity) <= {PARITIES}").select(F.col("line").alias("a"), F.col("hub.line").alias("b"), F.col("whole").alias("t_a"), F.col("hub.whole").alias("t_b"))
        links = tmp.save(links.unionByName(_within(stars)).distinct(), "links")
        named = _open(shared.drop("hub"), components(links, tmp), tmp)
        # what is too short for further segments is compared as it is
        short = F.expr(f"length(t) - less <= {EDITS}")
        pairs = _pairs(named.where(~F.col("hot") | short), "whole").withColumnsRenamed({"whole_a": "t_a", "whole_b": "t_b"})
        links = tmp.save(links.unionByName(_within(pairs)).distinct(), "links")
        rows = named.where(F.col("hot") & ~short)
        if rows.isEmpty():
            return links


def repeated_lines(docs: DataFrame, tmp: Scratch, id_col: str = "doc_id", text_col: str = "text", near_length: int = NEAR_LENGTH) -> DataFrame:
    """(doc_id, hash, gone: numbers of lines, from 0): for each document that has any, its lines that are not the first of their class."""
    if near_length <= EDITS:
        raise ValueError(f"near_length must be above {EDITS}")
    text = text_of(text_col)
    source = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    scanned = tmp.save(_scan(source, near_length), "scan")
    words = np.zeros(1 << (BITS - 6), np.uint64)
    found = scanned.where("kind = 1").groupBy("h1").agg(F.bit_or("h2").alias("bits")).toArrow()
    words[found["h1"].to_numpy()] = found["bits"].to_numpy().view(np.uint64)
    lines = scanned.where("kind = 0").drop("kind")
    # each task sends a line once or a few times; only keys that several lines share go on
    keys = tmp.save(_keys(source, tmp.broadcast(words), near_length), "keys")
    first = F.when(F.col("own"), F.col("line"))
    several = keys.groupBy("key").agg(F.min("line").alias("low"), F.max("line").alias("high"), F.min(first).alias("hub"), F.min_by("parity", first).alias("hub_parity")).where("low < high and hub is not null").drop("low", "high")
    shared = tmp.save(keys.join(several, "key").distinct(), "shared")
    near = _verified(shared.where(f"line <> hub and bit_count(parity ^ hub_parity) <= {PARITIES}").select(F.col("line").alias("a"), F.col("hub").alias("b")), lines, source, tmp)
    label = components(near, tmp)
    named = _open(shared.drop("hub", "hub_parity"), label, tmp)
    more = _verified(_pairs(named.where("not hot")).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")), lines, source, tmp)
    links = near.unionByName(more)
    hot = named.where("hot")
    if not hot.isEmpty():
        links = _hot_links(hot, links, lines, source, tmp)
    label = components(links, tmp).select(F.col("node").alias("h1"), "component")
    classed = lines.join(small_or_not(tmp.save(label, "classes")), "h1", "left").select("doc_id", "hash", "number", F.coalesce("component", "h1").alias("k1"), F.when(F.col("component").isNull(), F.col("h2")).otherwise(0).alias("k2"))
    by_doc = classed.groupBy("doc_id", "hash", "k1", "k2").agg(F.sort_array(F.collect_set("number")).alias("numbers"))
    place = F.coalesce("doc_id", F.lit(_LAST))
    by_doc = tmp.save(by_doc.withColumn("place", place), "bydoc")
    # a table of its own, so that Spark can split what stands in many documents
    first = tmp.save(by_doc.groupBy("k1", "k2").agg(F.min("place").alias("least"), F.count("place").alias("n")).where("n > 1").select("k1", "k2", "least"), "first")
    gone = by_doc.join(small_or_not(first), ["k1", "k2"]).where("place > least").select("doc_id", "hash", "numbers")
    inside = by_doc.where(F.size("numbers") > 1).select("doc_id", "hash", F.slice("numbers", 2, 1 << 30).alias("numbers"))
    return tmp.result(gone.unionByName(inside).groupBy("doc_id", "hash").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("numbers")))).alias("gone")), "gone")


def remove_repeated(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", with_counts: bool = False, near_length: int = NEAR_LENGTH) -> DataFrame:
    """(_row: struct of all columns of docs, with the lines that are left[, n_lines, removed]).

    A text that loses nothing stays as it is. n_lines counts lines with a word;
    removed lists the numbers of lines that go, from 0.
    """
    with Scratch(docs.sparkSession) as tmp:
        rows, changed = split_changed(docs, repeated_lines(docs, tmp, id_col, text_col, near_length), id_col, text_col)
    rows = rows.select(F.struct("*").alias("_row")).withColumn("gone", F.array().cast("array<int>")).unionByName(changed)
    split = F.split(F.coalesce(F.col(f"_row.`{text_col}`").cast("string"), F.lit("")), "\n")
    left = F.array_join(F.filter(split, lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.col("_row").withField(f"`{text_col}`", F.when(F.size("gone") > 0, left.cast(docs.schema[text_col].dataType)).otherwise(F.col(f"_row.`{text_col}`")))
    out = [new.alias("_row")]
    if with_counts:
        out += [F.size(F.filter(split, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))).cast("long").alias("n_lines"), F.col("gone").alias("removed")]
    return rows.select(*out)
