"""Operators against brute force, with the edge cases of cases.py."""

import hashlib
import itertools
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keepsake.llm import components, decontam, jaccard, licenses, lines, packing, quality, spans, tokenfile, toxicity, urls
from keepsake.llm.common import Scratch, drop_results, shared_dir
from tests.llm.cases import frame, lower, texts, words

TOKENIZER = public_tokenizers.path("word_bpe_49k.json")
LAST = (1 << 63) - 1


@pytest.fixture(scope="module")
def rows():
    return texts()


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="module")
def none(spark):
    return frame(spark, [])


@pytest.fixture(scope="module")
def ids_of():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(TOKENIZER)
    return lambda text, end: t.encode(text or "", add_special_tokens=False).ids + [end]


def key(i):
    return LAST if i is None else i


# --- scratch tables


def test_scratch(spark):
    from pathlib import Path

    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    with pytest.raises(ZeroDivisionError), Scratch(spark) as tmp:
        own, kept = tmp.save(spark.range(5), "own"), tmp.result(spark.range(3), "kept")
        assert spark.conf.get(name) != before and own.count() == 5 and Path(tmp.path.removeprefix("file:")).exists()
        raise ZeroDivisionError
    assert spark.conf.get(name) == before and kept.count() == 3 and not Path(tmp.path.removeprefix("file:")).exists()
    drop_results(spark)
    assert not [p for p in folder.iterdir() if p.name.startswith("keepsake-")]


# --- hashes that several rows hold


def test_shared_hashes(spark, monkeypatch):
    import random

    from keepsake.llm import shared

    monkeypatch.setattr(shared, "BUCKET", 100)
    r = random.Random(3)
    pool = [r.getrandbits(64) >> 16 << 16 for _ in range(400)]
    rows = [(k // 4, sorted({r.choice(pool) if r.random() < 0.4 else r.getrandbits(64) >> 16 << 16 for _ in range(r.randint(0, 12))} | ({pool[0]} if k % 2 else set()))) for k in range(200)]
    signed = lambda h: h - (1 << 64) if h >> 63 else h
    df = spark.createDataFrame([(c, [signed(h) for h in hs]) for c, hs in rows], "chunk long, h array<bigint>").repartitionByRange(3, "chunk").sortWithinPartitions("chunk")
    limit = 3 << 62
    total = Counter(h for _, hs in rows for h in hs if h < limit)
    answers = defaultdict(list)
    for x in shared.shared_hashes(df, sum(total.values()), limit).collect():
        answers[x.chunk].append(x)
    for c, hs in rows:
        import pyarrow as pa

        table = pa.table({"hashes": pa.array([bytes(x.hashes) for x in answers[c]], pa.binary()), "levels": pa.array([bytes(x.levels) for x in answers[c]], pa.binary())})
        got = shared.levels_of(np.array(hs, np.uint64), table).tolist()
        assert got == [int(4 * np.log2(min(total[h], 1 << 30))) if total[h] > 1 else 0 for h in hs]


# --- 1 line dedup


def distance(a, b):
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        p, d[0] = d[0], i
        for j, y in enumerate(b, 1):
            p, d[j] = d[j], min(d[j] + 1, d[j - 1] + 1, p + (x != y))
    return d[-1]


def test_edit_distance_band():
    import random

    r = random.Random(0)
    for _ in range(3000):
        a = "".join(r.choice("abc") for _ in range(r.randint(0, 12)))
        b = "".join(c for c in a if r.random() > 0.1) + "".join(r.choice("abc") for _ in range(r.randint(0, 2)))
        for most in (1, 2, 3):
            assert lines.edits_within(a, b, most) == (distance(a, b) <= most)


def brute_lines(rows):
    seen = sorted({(key(i), t or "") for i, t in rows})
    found, first = [], {}
    for i, t in seen:
        for n, line in enumerate(t.split("\n")):
            if line := line.strip(" \t\n\x0b\x0c\r"):
                found.append((i, t, n, line))
                first.setdefault(line, line)
    parent = dict(first)

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    long = [x for x in first if len(x) >= lines.NEAR_LENGTH]
    for a, b in itertools.combinations(long, 2):
        if abs(len(a) - len(b)) <= 2 and lines.edits_within(a, b, lines.EDITS):
            parent[root(a)] = root(b)
    least = {}
    for i, _, _, line in found:
        least[root(line)] = min(least.get(root(line), LAST), i)
    gone = defaultdict(set)
    here = set()
    for i, t, n, line in found:
        c = root(line)
        if i > least[c] or (i, t, c) in here:
            gone[i, t].add(n)
        here.add((i, t, c))
    return gone


def test_line_dedup(docs, rows, none):
    gone = brute_lines(rows)
    got = Counter((key(r._row.doc_id), r._row.text, tuple(r.removed)) for r in lines.remove_repeated(docs, with_counts=True).collect())
    want = Counter()
    for i, t in rows:
        drop = gone.get((key(i), t or ""), set())
        want[key(i), "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop) if drop else t, tuple(sorted(drop))] += 1
    assert got == want
    assert lines.remove_repeated(none).collect() == []


def test_hot_segments_are_split(spark, monkeypatch):
    """Lines that share segments are compared by further ones: with every key hot, the classes are those of brute force."""
    import random

    monkeypatch.setattr(lines, "HOT", 1)
    r = random.Random(3)
    made = ["".join(r.choice("ab é😀") for _ in range(3)) + "one start of " + "".join(r.choice("abcd") for _ in range(r.randint(12, 14))) for _ in range(60)]
    made += ["-" * k for k in (24, 25, 26, 30)] + ["x" * 12 + c * 12 for c in "xyz"]
    for x in made[:60]:
        y = list(x)
        for _ in range(r.randint(1, 3)):
            k = r.randrange(len(y))
            y[k : k + 1] = r.choice([[], [y[k], "q"], ["z"]])
        made.append("".join(y))
    rows = [(k, x + "\n" + r.choice(made)) for k, x in enumerate(made)]
    gone = brute_lines(rows)
    got = {(x._row.doc_id): set(x.removed) for x in lines.remove_repeated(frame(spark, rows), with_counts=True).collect()}
    assert got == {k: gone.get((k, t), set()) for k, t in rows} and any(got.values())


def test_lines_of_one_start(spark, monkeypatch):
    """The lines of one start that are compared grow with their number, not with its square."""
    compared = []
    whole = lines._pairs
    monkeypatch.setattr(lines, "_pairs", lambda named, *more: compared.append(named.groupBy("key").agg((F.count_if("own") * F.count("key")).alias("n")).agg(F.sum("n")).first()[0] or 0) or whole(named, *more))
    table = spark.range(4000).select(F.col("id").alias("doc_id"), F.concat(F.lit("a start: "), F.substring(F.sha2(F.col("id").cast("string"), 256), 1, 18)).alias("text"))
    assert lines.remove_repeated(table, with_counts=True).agg(F.sum(F.size("removed"))).first()[0] == 0
    assert sum(compared) < 100 * 4000


# --- 2 packing and 7 token files


def test_pieces_and_packing(docs, rows, none, ids_of):
    out = packing.pack(packing.token_pieces(docs, TOKENIZER, capacity=256), capacity=256, group_size=50).collect()
    want = Counter()
    for i, t in rows:
        ids = ids_of(t, 1)
        for p in range(0, len(ids), 256):
            part = ids[p : p + 256]
            want[i, p // 256, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    bins = defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    for pieces in bins.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 256
    total = sum(r.length for r in out)
    assert len(bins) <= -(-total // 256) + len(out) // 50 + 2
    assert packing.pack(packing.token_pieces(none, TOKENIZER)).collect() == []


@pytest.mark.parametrize("lengths", [[5] * 7, [10, 1, 1, 1], [6, 5, 5, 4], list(range(1, 11)), [3, 3, 2, 2, 2], [1]])
def test_best_two_fit(lengths):
    bins, offsets = packing.best_two_fit(lengths, 10)
    for b in set(bins.tolist()):
        inside = sorted((int(offsets[i]), lengths[i]) for i in np.flatnonzero(bins == b))
        assert sum(n for _, n in inside) <= 10 and [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
    assert lengths != [6, 5, 5, 4] or len(set(bins.tolist())) == 2


def greedy_bins(lengths, capacity):
    """Bins of the same filling without the swap."""
    left, n = sorted(lengths), 0
    while left:
        room, n = capacity, n + 1
        while left and left[0] <= room:
            k = max(i for i, x in enumerate(left) if x <= room)
            room -= left.pop(k)
    return n


@pytest.mark.parametrize("lengths,with_swap,without", [([9, 3, 8, 4, 1, 4, 3, 3, 3], 4, 5), ([6, 3, 2, 2, 2, 5], 2, 3)])
def test_two_replace_one(lengths, with_swap, without):
    bins, _ = packing.best_two_fit(lengths, 10)
    assert (len(set(bins.tolist())), greedy_bins(lengths, 10)) == (with_swap, without)


def test_token_file(spark, docs, rows, none, ids_of, tmp_path):
    path = str(tmp_path / "tokens")
    tokenfile.write_token_file(docs, path, TOKENIZER)
    back = tokenfile.read_token_file(spark, path)
    assert Counter((r.doc_id, tuple(r.ids)) for r in back.collect()) == Counter((i, tuple(ids_of(t, 2))) for i, t in rows)
    assert {r.doc_id for r in tokenfile.read_token_file(spark, path, [3, 11]).collect()} == {3, 11}
    index = sorted(tokenfile.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [r.start for r in index] == list(itertools.accumulate([0] + [r.n_tokens for r in index[:-1]]))
    assert [r.doc_id is not None and r.doc_id for r in index] == sorted((r.doc_id is not None and r.doc_id for r in index), key=lambda x: (x is not False, x))
    crcs = Counter((i, len(ids := ids_of(t, 2)), zlib.crc32(np.array(ids, "<u4").tobytes())) for i, t in rows)
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in index) == crcs
    empty = str(tmp_path / "empty")
    tokenfile.write_token_file(none, empty, TOKENIZER)
    assert tokenfile.token_index(spark, empty).collect() == []


def test_repeated_ids_stand_as_in_the_file(spark, ids_of, tmp_path):
    rows = [(7, f"word{k} " * (5 - k)) for k in range(5)] + [(7, "word0 " * 5), (3, "x"), (None, "b"), (None, "a a")]
    path = str(tmp_path / "ties")
    tokenfile.write_token_file(frame(spark, rows).repartition(3), path, TOKENIZER)
    files = sorted((tmp_path / "ties").glob("*.orc"))
    from pyarrow import orc

    in_files = sorted(([r for r in orc.ORCFile(f).read().to_pylist()] for f in files), key=lambda x: (bool(x) and x[0]["doc_id"] is not None, x[0]["doc_id"] or 0) if x else (True, LAST))
    flat = [r for f in in_files for r in f]
    index = sorted(tokenfile.token_index(spark, path).collect(), key=lambda r: r.start)
    assert [(r.doc_id, r.n_tokens, r.ids_crc32) for r in index] == [(r["doc_id"], len(r["ids"]), zlib.crc32(np.array(r["ids"], "<u4").tobytes())) for r in flat]
    assert [r.start for r in index] == list(itertools.accumulate([0] + [r.n_tokens for r in index[:-1]]))


def test_registered_token_file_leaves_nothing(spark):
    import os
    from pathlib import Path

    if not os.path.isdir("/root/testdata/sf0.001"):
        pytest.skip("the given tables are not here")
    from keepsake.llm.queries import QUERIES

    assert QUERIES["op7_token_orc"](spark, "/root/testdata/sf0.001").count() > 0
    drop_results(spark)
    assert not [p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("keepsake-")]


def test_token_file_prunes(spark, none, tmp_path):
    """Row indexes and Bloom filters on doc_id: a lookup reads few row groups of few files."""
    from pyarrow import orc

    docs = spark.range(40_000).select((F.col("id") * 2).alias("doc_id"), F.concat_ws(" ", F.sha2(F.col("id").cast("string"), 256), F.lit("some words")).alias("text"))
    path = str(tmp_path / "tokens")
    tokenfile.write_token_file(docs.repartition(6), path, TOKENIZER)
    files = [f for f in sorted((tmp_path / "tokens").glob("*.orc"))]
    spans = sorted((min(ids), max(ids)) for f in files if (ids := orc.ORCFile(f).read(columns=["doc_id"])["doc_id"].to_pylist()))
    assert all(a[1] < b[0] for a, b in itertools.pairwise(spans))  # ranges of ids that do not meet
    raw = [f.read_bytes() for f in files]
    assert all(orc.ORCFile(f).nstripes >= 1 and orc.ORCFile(f).compression == "ZSTD" for f in files) and any(len(x) > 1000 for x in raw)

    def rows_read(frame):
        frame.collect()
        metrics = frame._jdf.queryExecution().executedPlan().collectLeaves().head().metrics()
        return metrics.apply("numOutputRows").value()

    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        one = tokenfile.read_token_file(spark, path, [30_000])
        assert [r.doc_id for r in one.collect()] == [30_000] and "PushedFilters: [In(doc_id" in one._jdf.queryExecution().toString() or "EqualTo(doc_id" in one._jdf.queryExecution().toString()
        assert rows_read(one) <= 2 * tokenfile.ROW_INDEX_STRIDE < rows_read(tokenfile.read_token_file(spark, path))
        # an odd id lies inside a row group's range, so only its Bloom filter can tell that it is not there
        assert rows_read(tokenfile.read_token_file(spark, path, [30_001])) == 0
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


# --- 3 licences


def test_licences(docs, rows, none):
    got = {(r._row.doc_id, r._row.text): r for r in licenses.scan(docs, ["doc_id", "text"]).collect()}
    import re

    for i, t in rows:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
        places = [(k, label) for phrase, label in licenses.NAMED for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
        r = got[i, t]
        assert (r.n_words, r.n_base) == (len(w), len(places))
        assert (r.first_word, r.last_word) == ((min(places)[0], max(places)[0]) if places else (None, None))
        assert r.base_labels == ",".join(sorted({x for _, x in places}))
    by_text = {k[1]: r.labels for k, r in got.items()}
    assert by_text["Released under the MIT License."] == "mit"
    assert by_text["x Licensed under CC BY-NC 4.0. y"] == "cc-by,cc-by-nc"
    assert licenses.scan(none, ["doc_id"]).collect() == []


def test_licences_of_other_versions(spark):
    texts = {
        "Licensed under the GNU General Public License version 2": "gpl",
        "This work is licensed under the GNU General Public License version 3": "gpl,gpl-3.0",
        "Licensed under the Apache License, Version 1.1": "apache",
        "Licensed under the Apache License, Version 2.0": "apache,apache-2.0",
        "This work is licensed under a Creative Commons Attribution 3.0 International License": "",
        "This work is licensed under a Creative Commons Attribution 4.0 International License": "cc-by-4.0",
        "Licensed under CC BY-NC 4.0": "cc-by,cc-by-nc",
        "Licensed under CC X-NC 4.0": "",
    }
    found = licenses.scan(frame(spark, list(enumerate(texts))), ["text"]).collect()
    assert {r._row.text: r.labels for r in found} == texts


def test_two_notices_in_a_file(spark):
    notices = [(label, text) for label, text, _ in licenses.NOTICES]
    files = [(a, b, f"{x}\n\nSome words stand between these two.\n\n{y}") for (a, x), (b, y) in itertools.permutations(notices, 2)]
    labels = {r._row.text: set(r.labels.split(",")) for r in licenses.scan(frame(spark, [(k, t) for k, (*_, t) in enumerate(files)]), ["text"]).collect()}
    assert len(files) == len(notices) * (len(notices) - 1) and [(a, b) for a, b, t in files if not {a, b} <= labels[t]] == []


def test_all_notices_in_a_file(spark):
    whole = "\n\n".join(f"{text}\nand so on" for _, text, _ in licenses.NOTICES)
    found = licenses.scan(frame(spark, [(1, whole), (2, "no licence here")]), ["doc_id"]).collect()
    labels = {r._row.doc_id: set(r.labels.split(",")) for r in found}
    assert labels[1] >= {label for label, _, _ in licenses.NOTICES} and labels[2] == {""}


def test_headers_and_prose_that_share_phrases(spark):
    fsf = "is free software; you can redistribute it and/or modify it under the terms of the GNU {} Public License as published by the Free Software Foundation"
    texts = {
        "This library " + fsf.format("Lesser General"): "lgpl,lgpl-notice",
        "This program " + fsf.format("General"): "gpl,gpl-notice",
        "This program " + fsf.format("Affero General"): "agpl-notice",
        "The tool reads source and binary forms of programs.": "",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:": "bsd",
        "permission is hereby granted free of charge to any person obtaining a copy": "",  # the second phrase is missing
        "GNU General public licen\u017fe and MIT \u212aicense": "",  # letters that only a full lower case maps to ASCII
    }
    found = licenses.scan(frame(spark, list(enumerate(texts))), ["text"]).collect()
    assert {r._row.text: r.labels for r in found} == texts


def test_phrases_are_compared_at_candidates_only(spark, docs, rows):
    """Prose made of the templates' common words has places where a phrase could begin, and hardly a candidate."""
    common = "the license you may use this software free of charge for any purpose in source and binary forms subject to the terms of the public license "
    df = frame(spark, rows + [(9000 + k, common * 20) for k in range(50)] + [(8000, "Released under the MIT License.")])
    rare = licenses.rare_words(df)
    assert all(sum(len([1 for t, _ in ps if t == k]) for ps in rare.values()) == licenses.AGREEING for k in range(len(licenses.TEMPLATES)))
    got = licenses.matches(df, ["doc_id"], "text", rare).select("_row.doc_id", "words", F.size("candidates").alias("tests"), F.size("found").alias("found")).collect()
    starts = {p.split()[0] for _, of in licenses.TEMPLATES for _, _, p in of}
    could = sum(w.lower() in starts for r in got for w in r.words)
    tests = sum(r.tests for r in got)
    assert sum(r.found for r in got) <= tests < could / 20
    # the index decides: without its words nothing is found
    assert licenses.matches(df, ["doc_id"], "text", {"zzz": [(0, 0)]}).where("size(found) > 0").count() == 0


# --- 4 toxicity


def test_chain_learns(spark, none):
    import random

    r = random.Random(1)
    vocabulary = [f"w{k}" for k in range(300)]
    data = []
    for i in range(900):
        w = [r.choice(vocabulary) for _ in range(r.randint(20, 80))]
        bad, toxic = r.random() < 0.3, r.random() < 0.25
        if bad:
            w.insert(r.randrange(len(w)), "###")
        if toxic:
            w.insert(r.randrange(len(w)), r.choice(["grr", "argh"]))
        data.append((i, " ".join(w), int(not bad), int(toxic)))
    docs = frame(spark, [(i, t) for i, t, *_ in data] + [(None, None), (5000, "")])
    labels = spark.createDataFrame([(i, q, t) for i, _, q, t in data[:600]] + [(None, 1, 1), (7, None, 1), (99999, 1, 0)], "doc_id long, quality int, toxic int")
    models = toxicity.train(docs, labels)
    out = {r.doc_id: r for r in toxicity.score(docs, models, ["doc_id"]).collect()}
    held = data[600:]
    assert np.mean([(out[i].p_toxic >= toxicity.THRESHOLD) == bool(t) for i, _, _, t in held]) > 0.97
    assert np.mean([(out[i].p_low_quality >= 0.5) == (q == 0) for i, _, q, _ in held]) > 0.97
    assert toxicity.score(none, models, ["doc_id"]).collect() == []
    nothing = toxicity.train(docs, labels.limit(0))
    assert all(r.p_toxic < 0.01 for r in toxicity.score(docs, nothing, ["doc_id"]).collect())


def test_chain_equals_plain_loop(spark):
    """Probabilities by a plain loop over words, with the ties of ids that are given twice."""
    import random
    import re

    r = random.Random(7)
    data = [(i, " ".join(r.choice(["ok", "fine", "grr" if i % 4 == 0 else "well", "###" if i % 3 == 0 else "so"]) for _ in range(12))) for i in range(120)]
    docs = frame(spark, [*data, (5, "a b c"), (5, "a b d"), (7, None), (None, "grr")])
    labels = spark.createDataFrame([(i, int(i % 3 != 0), int(i % 4 == 0)) for i in range(100)] + [(9, 1, 1), (9, 1, 0)], "doc_id long, quality int, toxic int")
    models = toxicity.train(docs, labels)
    got = Counter((x.doc_id, x._text, x.p_low_quality, x.p_toxic) for x in toxicity.score(docs.withColumn("_text", F.coalesce("text", F.lit(""))), models, ["doc_id", "_text"]).collect())
    tables = [m.table().astype(float) for m in models]

    def bucket(token):
        data = np.frombuffer(token.encode(), np.uint8)
        return int((toxicity.Substrings(toxicity.byte_values(fold_case=True)[data]).hash(np.array([0]), np.array([len(data)])) >> np.uint64(64 - toxicity.BITS))[0])

    want = Counter()
    for i, t in [(x.doc_id, x.text) for x in docs.collect()]:
        buckets = {bucket(x) for x in re.findall(r"[0-9A-Za-z\u0080-\U0010ffff]+|[^\s0-9A-Za-z\u0080-\U0010ffff]+", t or "")}
        p = []
        for m, table in zip(models, tables, strict=True):
            z = sum(table[b] for b in buckets) + sum(w * x for w, x in zip(m.earlier, p, strict=True)) + m.bias
            p.append(1 / (1 + np.exp(-z)))
        want[i, t or "", round(p[0], 4), round(p[1], 4)] += 1
    assert Counter({(i, t, round(a, 4), round(b, 4)): n for (i, t, a, b), n in got.items()}) == want
    # the same models for any layout: of two documents of one id, and of two labels, a defined one is used
    again = toxicity.train(docs.repartition(7), labels.repartition(3))
    assert [m.bias for m in again] == [m.bias for m in models] and all((a.weights == b.weights).all() for a, b in zip(again, models, strict=True))


def test_executors_without_the_package(tmp_path):
    """Only the driver can import the package: workers get functions and models by value."""
    import os
    import subprocess
    import sys
    from pathlib import Path

    script = tmp_path / "job.py"
    script.write_text(
        """
import sys
from pyspark.sql import SparkSession
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").config("spark.checkpoint.dir", sys.argv[2]).getOrCreate()
sys.path.insert(0, sys.argv[1])
from keepsake.llm import decontam, lines, toxicity
docs = spark.createDataFrame([(i, f"word{i} " * 30 + ("grr" if i % 2 else "nice") + " what is the tallest mountain of all the northern lands. it is the old one.") for i in range(60)], "doc_id long, text string")
labels = docs.selectExpr("doc_id", "1 as quality", "cast(doc_id % 2 as int) as toxic")
items = spark.createDataFrame([(1, "what is the tallest mountain of all the northern lands. it is the old one.")], "item_id long, text string")
assert toxicity.score(docs, toxicity.train(docs, labels), ["doc_id"]).where("p_toxic > 0.5").count() == 30
assert decontam.contaminated(docs, items).count() == 60
assert lines.remove_repeated(docs).count() == 60
print("fine")
"""
    )
    root = str(Path(__file__).resolve().parents[2])
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    done = subprocess.run([sys.executable, str(script), root, str(tmp_path / "shared")], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert done.stdout.strip().endswith("fine"), done.stderr[-3000:]


# --- 5 Jaccard join


def brute_sets(rows):
    out = []
    for i, t in rows:
        w = words(lower(t))
        out.append((i, t, frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])))
    return out


def test_jaccard_join(docs, rows, none):
    sets = brute_sets(rows)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][2], sets[b][2]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    least = {}
    for k, (i, *_) in enumerate(sets):
        least[root(k)] = min(least.get(root(k), LAST), key(i))
    got = jaccard.with_component_id(jaccard.link(docs)).collect()
    assert Counter((key(r.doc_id), r.n_shingles, key(r.component_id)) for r in got) == Counter((key(i), len(s), least[root(k)]) for k, (i, _, s) in enumerate(sets))
    kept = jaccard.keep_one(docs).collect()
    groups = defaultdict(set)
    for k, (i, t, _) in enumerate(sets):
        groups[root(k)].add((key(i), t or ""))
    left = Counter((key(r.doc_id), r.text or "") for r in kept)
    assert all(sum(x in left for x in g) == 1 for g in groups.values())
    assert all(min(x[0] for x in g) in {x[0] for x in g if x in left} for g in groups.values())
    assert jaccard.link(none).collect() == []


def test_components(spark):
    links = spark.createDataFrame([(9, 8), (8, 7), (7, 6), (6, 5), (1, 2), (3, 2), (4, 4)], "a long, b long")
    with Scratch(spark) as tmp:
        assert {(r.node, r.component) for r in components.components(links, tmp).collect()} == {(k, 5) for k in range(5, 10)} | {(1, 1), (2, 1), (3, 1)}


def test_chains_across_groups(spark):
    # a chain in which each text links to the next only, so no star covers it
    base = [f"t{k}" for k in range(60)]
    chain = [" ".join(base[s : s + 40]) for s in range(0, 12, 3)]
    docs = frame(spark, list(enumerate(chain)))
    got = {r.component_id for r in jaccard.with_component_id(jaccard.link(docs)).collect()}
    assert got == {0}


# --- 6 URLs


def test_urls(spark):
    pages = [
        (0, "http://A.Example.NET/en/x?q#f", ""),
        (1, "https://a.example.net/de/", '<a href="https://bad.net/x">'),
        (2, "https://example.com/de/y", None),
        (3, "https://x.example.com", '<a href="//a.example.net/">'),
        (4, "https://shady.io/", '<a href=https://only.net/>'),
        (5, "https://only.net/z", ""),
        (6, "https://y.org/fr/1", '<a href="https://friend.io/a">'),
        (7, "https://friend.io/", '<a href="https://only.net/">'),
        (8, None, None),
        (9, "no scheme", ""),
        (None, "https://net", ""),
        (5, "https://only.net/z", ""),
    ]
    df = spark.createDataFrame([(*p, "x", "x") for p in pages], "page_id long, url string, html string, host string, verdict string")
    got = [(r.page_id, r.host, r.path, r.rule, r.verdict) for r in urls.judge(df, ["page_id"]).collect()]
    by_id = {g[0]: g[1:] for g in got}
    assert len(got) == len(pages)
    assert by_id[0] == ("a.example.net", "/en/x", "example.net/en/", "allow")
    assert by_id[1] == ("a.example.net", "/de/", "net/", "block")
    assert by_id[2] == ("example.com", "/de/y", "example.com/de/", "block")
    assert by_id[3] == ("x.example.com", "", None, "block")  # all pages of its domain are blocked, and it links to blocked ones
    assert by_id[4][2:] == (None, "block")  # links to a blocked host only
    assert by_id[6] == ("y.org", "/fr/1", "org/fr/", "allow")
    assert by_id[7][2:] == (None, "allow")  # trusted more than distrusted
    assert by_id[8] == by_id[9] == ("", "", None, "allow")
    assert by_id[None] == ("net", "", None, "allow")
    assert urls.judge(df.limit(0), ["page_id"]).collect() == []


def of_kind(spark, rows, names, kind=0):
    return spark.createDataFrame([(kind, *r) for r in rows], "kind int, " + ", ".join(f"{n} string" for n in names))


def brute_rank(edges, seeds):
    """Personalised PageRank by its definition, from seeds that weigh alike or as they say; what ends at a host without edges goes back to the seeds."""
    out = Counter(s for s, _ in edges)
    weights = seeds if isinstance(seeds, dict) else dict.fromkeys(seeds, 1.0)
    seeds = {h: w / sum(weights.values()) for h, w in weights.items()}
    rank = dict(seeds)
    for _ in range(400):
        new, back = defaultdict(float), 1 - urls.DAMPING
        for h, x in rank.items():
            back += urls.DAMPING * x * (not out[h])
        for s, d in edges:
            new[d] += urls.DAMPING * rank.get(s, 0.0) / out[s]
        for h, w in seeds.items():
            new[h] += back * w
        rank = new
    return rank


@pytest.mark.parametrize("small", [urls.SMALL_GRAPH, 0])
def test_page_rank(spark, monkeypatch, small):
    monkeypatch.setattr(urls, "SMALL_GRAPH", small)
    edges = [("a", "b"), ("b", "c"), ("a", "c"), ("c", "a"), ("d", "a"), ("c", "end")]
    with Scratch(spark) as tmp:
        both = of_kind(spark, edges, ("src", "dst")).unionByName(of_kind(spark, [(d, s) for s, d in edges], ("src", "dst"), 1))
        seeds = of_kind(spark, [("a",)], ("host",)).unionByName(of_kind(spark, [("b",), ("c",)], ("host",), 1)).withColumn("weight", F.lit(0.7))
        got = {(r.kind, r.host): r.score for r in urls.spread(both, seeds, tmp).collect()}
    want = {(0, h): x for h, x in brute_rank(edges, ["a"]).items()} | {(1, h): x for h, x in brute_rank([(d, s) for s, d in edges], ["b", "c"]).items()}
    assert got == pytest.approx({k: x for k, x in want.items() if x}, abs=1e-3)


def test_page_rank_reaches_far_hosts(spark):
    edges = [(f"h{k}", f"h{k + 1}") for k in range(14)]
    seeds = of_kind(spark, [("h0",)], ("host",)).withColumn("weight", F.lit(1.0))
    with Scratch(spark) as tmp:
        got = {r.host: r.score for r in urls.spread(of_kind(spark, edges, ("src", "dst")), seeds, tmp).collect()}
        assert got == pytest.approx(brute_rank(edges, ["h0"])) and got["h14"] > 0
        with pytest.raises(RuntimeError):  # not settled
            urls.spread(of_kind(spark, [("h0", "h1"), ("h1", "h0")], ("src", "dst")), seeds, tmp, rounds=4)


def test_hosts_of_one_site_share_trust(spark):
    """Pages without links to other hosts, as in the given tables: only edges between a host and its domain carry anything."""
    hosts = spark.createDataFrame([("www.a.example.org",), ("b.example.org",), ("localhost",), ("10.0.0.1",), ("",), ("x..y",)], "host string")
    edges = {(r.src, r.dst) for r in urls.domain_edges(hosts).collect()}
    up = {("www.a.example.org", "a.example.org"), ("a.example.org", "example.org"), ("b.example.org", "example.org")}
    assert edges == up | {(d, s) for s, d in up}
    rules = [("block", "evil.site.io", "/"), ("allow", "good.pages.io", "/ok/")]
    pages = [(0, "http://evil.site.io/x"), (1, "http://other.site.io/y"), (2, "http://good.pages.io/ok/1"), (3, "http://new.pages.io/z"), (4, "http://far.net/")]
    df = spark.createDataFrame([(i, u, '<a href="/own">x</a>' * 3) for i, u in pages], "page_id long, url string, html string")
    got = {r.page_id: r for r in urls.judge(df, ["page_id"], rules=rules).collect()}
    assert [got[k].verdict for k in range(5)] == ["block", "block", "allow", "allow", "allow"]
    assert got[1].rule is None and got[1].distrust > 0 and got[3].trust > 0 and got[4].trust == got[4].distrust == 0
    chain = [("evil.site.io", "site.io"), ("other.site.io", "site.io"), ("good.pages.io", "pages.io"), ("new.pages.io", "pages.io")]
    chain += [(d, s) for s, d in chain]
    assert got[1].distrust == pytest.approx(brute_rank(chain, ["evil.site.io"])["other.site.io"], abs=1e-3)


def test_shares_of_pages_weigh_and_suffixes_join_nobody(spark):
    rules = [("block", "bad.com", "/de/"), ("block", "a.co.uk", "/"), ("allow", "good.org", "/ok/")]
    urls_ = [f"http://bad.com/{'de' if k < 8 else 'en'}/{k}" for k in range(10)] + [f"http://mild.com/{k}" for k in range(3)] + ["http://a.co.uk/1", "http://b.co.uk/2", "http://www.a.co.uk/3", "http://good.org/ok/1", "http://good.org/x"]
    urls_ += [f"http://once.io/{k}" for k in range(4)] + ["http://even.net/1"]
    rules += [("block", "once.io", "/0"), ("block", "even.net", "/none"), ("allow", "even.net", "/none")]
    df = spark.createDataFrame([(k, u, "") for k, u in enumerate(urls_)], "page_id long, url string, html string")
    got = {urls_[r.page_id]: r for r in urls.judge(df, ["page_id"], rules=rules).collect()}
    assert got["http://bad.com/en/9"].verdict == "block" and got["http://bad.com/en/9"].rule is None  # most of its host is blocked
    edges = [("a.co.uk", "www.a.co.uk"), ("www.a.co.uk", "a.co.uk")]
    weights = {"bad.com": 0.8, "a.co.uk": 1.0, "www.a.co.uk": 1.0, "once.io": 0.25}
    whole = sum(weights.values())
    for h, u in (("bad.com", "http://bad.com/en/9"), ("www.a.co.uk", "http://www.a.co.uk/3"), ("once.io", "http://once.io/3")):
        assert got[u].distrust == pytest.approx(whole * brute_rank(edges, weights)[h], abs=1e-3)
    assert {got[u].verdict for u in urls_ if "mild" in u} == {"allow"} and got["http://b.co.uk/2"].verdict == "allow"
    assert got["http://www.a.co.uk/3"].rule == "a.co.uk/" and got["http://good.org/x"].trust == pytest.approx(0.5, abs=1e-3)
    assert got["http://b.co.uk/2"].distrust == 0 and got["http://once.io/3"].verdict == ("block" if got["http://once.io/3"].distrust >= urls.LEAST_DISTRUST else "allow")
    assert got["http://even.net/1"].verdict == "allow"


def test_equal_trust_and_distrust_allow(spark):
    rules = [("block", "x.com", "/b"), ("allow", "x.com", "/a")]
    pages = [(0, "http://x.com/a", ""), (1, "http://x.com/b", ""), (2, "http://x.com/c", "<a href='/own'>" + "z" * 3_000_000)]
    got = {r.page_id: r for r in urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), ["page_id"], rules=rules).collect()}
    assert got[2].verdict == "allow" and got[2].trust > 0 and got[2].distrust > 0


# --- 8 quality


def test_quality(docs, rows, none):
    import re

    got = quality.score(docs, ["doc_id", "text"]).collect()
    want = Counter()
    for i, t in rows:
        w, seen, repeated = words(t), set(), 0
        for line in (t or "").split("\n"):
            if words(line):
                repeated += line in seen
                seen.add(line)
        c = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        covered = {j for k in range(len(w) - 7) if c[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        want[i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), repeated, len(covered), len(w) < 20 or 100 * len(covered) > 30 * len(w)] += 1
    assert Counter((r._row.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == want
    assert all(not r.kept for r in got if r.base_failed)
    kept = quality.filter_quality(docs)
    assert kept.columns == docs.columns and kept.count() == sum(r.kept for r in got)
    clean = {t for i, t in rows[:40]}
    assert all(r.kept for r in got if r._row.text in clean)
    assert quality.score(none, ["doc_id"]).collect() == []
    # posteriors by a plain loop over documents, from the same start until nothing moves
    votes = [tuple(r._votes) for r in got]
    prior, right = 0.8, [(0.9, 0.5)] * len(votes[0])
    for _ in range(3000):
        good = []
        for v in votes:
            g, b = prior, 1 - prior
            for x, (p, q) in zip(v, right, strict=True):
                if x:
                    g, b = g * (p if x > 0 else 1 - p), b * (q if x < 0 else 1 - q)
            good.append(g / (g + b))
        prior = (sum(good) + 1) / (len(votes) + 2)
        right = [((sum(g for g, v in zip(good, votes, strict=True) if v[j] > 0) + 1) / (sum(g for g, v in zip(good, votes, strict=True) if v[j]) + 2), (sum(1 - g for g, v in zip(good, votes, strict=True) if v[j] < 0) + 1) / (sum(1 - g for g, v in zip(good, votes, strict=True) if v[j]) + 2)) for j in range(len(right))]
    assert [r.quality for r in got] == pytest.approx(good, abs=1e-4)
    assert all(r.kept == (not r.base_failed and r.quality >= quality.THRESHOLD) for r in got)


# --- 9 decontamination


def test_decontamination(spark, docs, rows, none):
    import random

    r = random.Random(5)
    items = [(k, " ".join(r.choice("abcdefgh") * r.randint(1, 4) + str(r.randrange(50)) for _ in range(r.randint(12, 50))) + ". Answer" + str(k) + ".") for k in range(30)]
    hidden = [(1000 + k, f"{rows[k][1]}\n{t.upper()} {rows[k + 1][1]}") for k, t in items[:20]]
    table = frame(spark, rows + hidden)
    benchmark = spark.createDataFrame(items + [(90, None), (91, ""), (None, "too short")], "item_id long, text string")
    got = {(x.doc_id, x.item_id) for x in decontam.contaminated(table, benchmark).collect()}
    assert got == {(1000 + k, k) for k in range(20)}
    left = decontam.remove_contaminated(table, benchmark)
    assert left.columns == table.columns and left.count() == len(rows)
    rows_of = lambda x: sorted((r.doc_id, r.item_id, r.score, r.word, r.question, r.answer) for r in x.collect())
    assert rows_of(decontam.contaminated(table, benchmark)) == rows_of(decontam.contaminated(table, benchmark, shard_bytes=1 + sum(len(t) for _, t in items) // 5))
    assert decontam.contaminated(none, benchmark).collect() == [] and decontam.contaminated(docs, benchmark.limit(0)).collect() == []


def bm25_index(items):
    """An index of items that are one section each, and a plain scorer: {section: score} of all sections for a set of words."""
    hashed = [decontam.word_hashes(np.frombuffer(t.encode(), np.uint8))[0].tolist() for t in items]
    df = Counter(w for h in hashed for w in set(h))
    mean = sum(map(len, hashed)) / len(items)

    def weight(w, h):
        f = h.count(w)
        return np.log(1 + (len(items) - df[w] + 0.5) / (df[w] + 0.5)) * f * (decontam.K1 + 1) / (f + decontam.K1 * (1 - decontam.B + decontam.B * len(h) / mean))

    def scores(query):
        return {s: sum(weight(w, h) for w in query & set(h)) / sum(weight(w, h) for w in set(h)) for s, h in enumerate(hashed)}

    known = np.array(sorted(df), np.uint64)
    return decontam.Index(list(range(len(items))), items, (known, np.array([df[int(w)] for w in known])), len(items), mean), scores


def test_wand_equals_full_scan():
    import random

    r = random.Random(2)
    index, scores = bm25_index([" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 12))) for _ in range(300)])
    for _ in range(200):
        query = decontam.word_hashes(np.frombuffer(" ".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(1, 12))).encode(), np.uint8))[0]
        want = {s: x for s, x in scores(set(query.tolist())).items() if x >= decontam.THRESHOLD - 1e-12}
        assert dict(index.search(np.unique(query))) == pytest.approx(want)
        # the filters before the search lose nothing
        if want:
            assert index.possible(np.unique(query)) and len(index.starts(query))


def plain_sections(text):
    """(words, answer words) of each section by plain Python."""
    found = list(re.finditer(r"[0-9a-z\x80-\U0010ffff]+", text.lower()))
    words = [m.group() for m in found]
    last = max((i + 1 for i, m in enumerate(found[:-1]) if text[m.end() : m.end() + 1] in tuple(".!?\n")), default=0)
    parts = np.array_split(np.arange(len(words)), -(-len(words) // decontam.SECTION)) if words else []
    return [([words[i] for i in p], {words[i] for i in p if last and i >= last and p[-1] == len(words) - 1}) for p in parts]


def test_sections_triples_and_answers():
    import random

    r = random.Random(9)
    items = ["", "one", "two words", "a b c. d", "  .  ", "no stop at all", "é ü. ß!"] + ["".join(r.choice(["ab ", "c", "d. ", "e\n", "f? ", "é "]) for _ in range(r.randint(1, 400))) for _ in range(60)]
    h = lambda t: decontam.word_hashes(np.frombuffer(t.encode(), np.uint8))[0]
    known = np.unique(np.concatenate([h(t) for t in items]))
    index = decontam.Index([*range(len(items) - 1), None], items, (known, np.ones(len(known), np.int64)), 100, 20.0)
    want = [(i, w, a) for i, t in enumerate(items) for w, a in plain_sections(t)]
    assert index.item.tolist() == [i for i, _, _ in want] and index.null.sum() == 1
    for s, (_, w, a) in enumerate(want):
        assert len(index.triple[index.triple_begin[s] : index.triple_begin[s + 1]]) == len({tuple(w[i : i + 3]) for i in range(max(1, len(w) - 2))})
        assert set(index.words[index.answer[index.answer_begin[s] : index.answer_begin[s + 1]]].tolist()) == {int(h(x)[0]) for x in a}
        assert index.overlap(s, h(" ".join(w))) == (1.0, 1.0)


def test_index_is_small():
    """A worker holds at most four bytes for a byte of benchmark, also where an item's words are mostly its own section's."""
    import random

    r = random.Random(4)
    vocabulary = ["".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9))) for _ in range(20_000)]
    items = [" ".join(r.choices(vocabulary, k=r.randint(30, 120))) + ". " + r.choice(vocabulary) + "." for _ in range(4_000)]
    known = np.unique(np.concatenate([decontam.word_hashes(np.frombuffer(t.encode(), np.uint8))[0] for t in items]))
    index = decontam.Index(list(range(len(items))), items, (known, np.full(len(known), 10)), len(items), 60.0)
    assert index.nbytes() <= 4 * sum(len(t) for t in items)


# --- 10 spans


def brute_spans(rows):
    def sentences(t):
        out, cur = [], []
        for line in (t or "").split("\n"):
            for w in words(line):
                cur.append(w)
                if w[-1] in ".!?":
                    out.append(cur)
                    cur = []
            if cur:
                out.append(cur)
                cur = []
        return [s[k : k + spans.MAX_WORDS] for s in out for k in range(0, len(s), spans.MAX_WORDS)]

    least, found = {}, []
    for i, t in sorted({(key(i), t or "") for i, t in rows}):
        s = sentences(t)
        for a in range(len(s)):
            b = a + spans.SENTENCES
            while b <= len(s) and sum(map(len, s[a:b])) < spans.LEAST_WORDS:
                b += 1
            if b <= len(s):
                h = lower(" ".join(w for x in s[a:b] for w in x))
                least[h] = min(least.get(h, LAST), i)
                found.append((i, t, a, b, h))
    gone, here = defaultdict(set), set()
    for i, t, a, b, h in found:
        if i > least[h] or (i, t, h) in here:
            gone[i, t].update(range(a, b))
        here.add((i, t, h))
    return sentences, gone


def test_spans(docs, rows, none):
    sentences, gone = brute_spans(rows)
    got = Counter((key(r._row.doc_id), " ".join(words(r._row.text)), r.n_sentences, r.n_removed) for r in spans.remove_repeated(docs, with_counts=True).collect())
    want = Counter()
    for i, t in rows:
        s, drop = sentences(t), gone.get((key(i), t or ""), set())
        want[key(i), " ".join(w for k, x in enumerate(s) if k not in drop for w in x), len(s), len(drop)] += 1
    assert got == want
    assert spans.remove_repeated(none).collect() == []


@pytest.mark.parametrize("seed", range(4))
def test_long_passages_at_any_phase(spark, seed):
    import random

    r = random.Random(seed)
    some = lambda n: [f"w{r.randrange(10**9)}" for _ in range(n)]
    passage = some(50)
    docs = frame(spark, [(k, " ".join(some(7 + k) + passage + some(k))) for k in range(14)])
    left = {x._row.doc_id: (x._row.text.split(), x.n_removed) for x in spans.remove_repeated(docs, with_counts=True).collect()}
    assert left[0][1] == 0
    for k in range(1, 14):
        lost = set(passage) - set(left[k][0])
        assert len(lost) >= spans.MAX_WORDS and len(left[k][0]) == 7 + 2 * k + 50 - len(lost)


def test_long_passage_again_in_its_document(spark):
    passage = [f"p{k}" for k in range(60)]
    docs = frame(spark, [(0, " ".join(passage + [f"x{k}" for k in range(17)] + passage))])
    (row,) = spans.remove_repeated(docs, with_counts=True).collect()
    kept = row._row.text.split()
    assert row.n_removed > 0 and set(kept) >= set(passage) and kept[:60] == passage


# --- the pipeline


# --- the pipeline


def plain_pipeline(rows, items, quality_of, ids_of):
    """The five stages in plain Python; quality_of: verdict of the quality rules, which test_quality compares."""
    docs = [(i, t) for i, t in rows if quality_of[i, t]]
    gone = brute_lines(docs)
    left = []
    for i, t in docs:
        drop = gone.get((key(i), t), set())
        new = "\n".join(x for n, x in enumerate(t.split("\n")) if n not in drop)
        if not drop or words(new):
            left.append((i, new))
    sets = brute_sets(left)
    parent = list(range(len(sets)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(range(len(sets)), 2):
        x, y = sets[a][2], sets[b][2]
        if x and y and 100 * len(x & y) >= 75 * len(x | y):
            parent[root(a)] = root(b)
    groups = defaultdict(set)
    for k, (i, t, _) in enumerate(sets):
        groups[root(k)].add((key(i), t))
    # which of several texts of the smallest id stays is a matter of hashes; the fixture has none in one group
    first = {k: min(g) for k, g in groups.items()}
    assert all(sum(x[0] == min(g)[0] for x in g) == 1 for g in groups.values())
    left = [(i, t) for k, (i, t, _) in enumerate(sets) if (key(i), t) == first[root(k)]]
    # an item counts as held where all of its words stand in a row
    held = lambda t: any(" ".join(words(lower(item))) in " ".join(words(lower(t))) for item in items)
    left = [(i, t) for i, t in left if not held(t)]
    out = Counter()
    for i, t in left:
        ids = ids_of(t, 1)
        for p in range(0, len(ids), packing.CAPACITY):
            part = ids[p : p + packing.CAPACITY]
            out[i, p // packing.CAPACITY, p, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    return left, out


def pipeline_rows():
    import random

    r = random.Random(11)
    vocabulary = ["".join(r.choice("abcdefghijklmnop") for _ in range(r.randint(3, 9))) for _ in range(1500)]
    prose = lambda n: "\n".join(" ".join(r.choice(vocabulary) for _ in range(11)).capitalize() + "." for _ in range(n))
    items = [" ".join(r.choice(vocabulary) for _ in range(26)) + ". " + " ".join(r.choice(vocabulary) for _ in range(5)) + "." for _ in range(4)]
    docs = [prose(r.randint(8, 30)) for _ in range(50)]
    line = "This one line stands in many documents of this table."
    docs += [f"{line}\n{prose(12)}" for _ in range(5)] + [f"{prose(9)}\n{x}\n{prose(4)}" for x in items]
    for width in (6, 7, 8, 9, 13):  # near copies that are wrapped otherwise, so that line dedup leaves them
        w = [*docs[0].split(), f"end{width}"]
        docs.append("\n".join(" ".join(w[j : j + width]) for j in range(0, len(w), width)))
    docs += ["", None, "#### | |", "word " * 60, "a###b " * 50, prose(500)]
    rows = list(enumerate(docs))
    return rows + [(3, docs[3]), (None, prose(9))], items


def test_pipeline_equals_plain_python(spark, ids_of, tmp_path):
    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    rows, items = pipeline_rows()
    docs = frame(spark, rows).select("doc_id", "text", "lang", "source", "n_chars", F.col("hash").alias("_gone"), F.lit(1).alias("_row"))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    verdicts = {(r._row.doc_id, r._row.text): r.kept for r in quality.score(frame(spark, rows), ["doc_id", "text"]).collect()}
    left, want = plain_pipeline(rows, items, verdicts, ids_of)
    assert 0 < sum(not v for v in verdicts.values()) < 10 and len(left) < len(rows) - 10
    table, drops = spark.read.parquet(str(tmp_path / "documents.parquet")), []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, table, str(tmp_path))
        assert out.schema.simpleString() == table.schema.simpleString()
        out.write.parquet(str(tmp_path / name))
        drops.append(table.count() - out.count())
        table = spark.read.parquet(str(tmp_path / name))
    assert drops[0] > 0 and drops[2] > 0 and drops[3] == len(items)
    assert Counter((r.doc_id, r.text, r.n_chars, r._gone, r._row) for r in table.collect()) == Counter((i, t, len(t), "x", 1) for i, t in left)
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want


def test_stages_of_several_pipelines(spark, rows, docs, none, tmp_path):
    """Stages are built before earlier ones are read, for two tables at once; afterwards the shared folder is as it was."""
    from pathlib import Path

    corpus_pipeline = pytest.importorskip("corpus_pipeline")
    drop_results(spark)
    folder = Path(shared_dir(spark).removeprefix("file:"))
    before = set(folder.iterdir())
    spark.createDataFrame([(1, "no such thing in any of these documents at all, is there?")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    tables = [docs.select("doc_id", "text", "lang"), docs.where("doc_id < 20").select("doc_id", "text"), none.select("doc_id", "text", "n_chars")]
    built = [[stage(spark, t, str(tmp_path)) for t in tables] for _, stage in corpus_pipeline.STAGES]
    assert len(set(folder.iterdir()) - before) <= 2 * len(tables) * len(built)
    for (name, _), outs in reversed(list(zip(corpus_pipeline.STAGES, built, strict=True))):
        counts = [o.count() for o in outs]
        assert counts[0] >= counts[1] > 0 == counts[2], name
        assert name == "best_fit_packing" or [o.columns for o in outs] == [t.columns for t in tables]
    drop_results(spark)
    assert set(folder.iterdir()) == before


@pytest.mark.parametrize("name", ["op3_rare_word_licences", "op5_grouped_prefix_join"])
def test_query_equals_sql(spark, docs, name, tmp_path):
    """The registered query against its SQL, on the awkward cases; rows of one id and other texts are told apart by neither, so ids are made distinct."""
    import duckdb

    from keepsake.llm import queries

    distinct = docs.select("text").repartition(1).withColumn("doc_id", F.monotonically_increasing_id())
    distinct.write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    got, want = queries.QUERIES[name](spark, str(tmp_path)), con.sql(queries.ORACLE[name])
    columns = sorted(got.columns)
    at = [want.columns.index(c) for c in columns]
    assert sorted(map(repr, ([r[c] for c in columns] for r in got.collect()))) == sorted(map(repr, ([r[k] for k in at] for r in want.fetchall())))


def test_short_lines_by_argument(spark):
    docs = frame(spark, [(1, "abc\nlong enough to be near"), (2, "abd\nlong enough to be neat"), (3, "xyz")])
    removed = lambda n: {r._row.doc_id: r.removed for r in lines.remove_repeated(docs, with_counts=True, near_length=n).collect()}
    assert removed(24) == {1: [], 2: [], 3: []} and removed(20) == {1: [], 2: [1], 3: []} and removed(3) == {1: [], 2: [0, 1], 3: []}
    with pytest.raises(ValueError):
        lines.remove_repeated(docs, near_length=2)


def test_large_groups_of_near_copies(spark):
    """Stars and pairs against all pairs: many texts around the threshold, which no single star covers."""
    import random

    r = random.Random(4)
    base = [f"w{k}" for k in range(120)]
    texts = []
    for k in range(150):
        w = list(base)
        for j in r.sample(range(120), r.randint(1, 6)):
            w[j] = f"n{k}x{j}" if r.random() < 0.5 else f"v{j}"
        texts.append(" ".join(w))
    got = {x.doc_id: x.component_id for x in jaccard.with_component_id(jaccard.link(frame(spark, list(enumerate(texts))))).collect()}
    sets = [s for _, _, s in brute_sets(list(enumerate(texts)))]
    least = list(range(len(sets)))
    for _ in range(len(sets)):
        new = [min([least[a]] + [least[b] for b in range(len(sets)) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]) for a in range(len(sets))]
        if new == least:
            break
        least = new
    assert got == dict(enumerate(least)) and 1 < len(set(least)) < 150
