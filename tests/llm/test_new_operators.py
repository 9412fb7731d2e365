"""Byte-level BPE, fill-in-middle and the filter audit against brute force and SQL."""

import base64
import hashlib
import itertools
import os
import random
import re
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from keepsake.llm import audit, bpe, fim
from keepsake.llm.common import Scratch, drop_results, shared_dir
from tests.llm.cases import frame, texts, words

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def rows():
    more = ["<|endoftext|>a", "<P>x y", "a <S", "<M>", "tail  \n", "  lead", " nbsp x", "don't DON'T we'll", "x" * 3000, " " * 5000, "日本語 " * 40, "a\tb\r\n\x0bc\x0c", "﻿a\x00b", "12345 1a2b", "\U0001f600" * 7]
    base = texts()
    return base + list(enumerate(more, 1000)) + [(2000, "x y " * 30_000)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


# --- 11 byte-level BPE


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("chunk_bytes", [1, 20_000, bpe.CHUNK_BYTES])
def test_encode_and_decode(spark, rows, docs, tiktoken_encoding, chunk_bytes):
    with Scratch(spark) as tmp:
        tokens = bpe.encode(docs, ["doc_id", "text", "kept", "_text"], RANKS, public_tokenizers.PATTERN, tmp, chunk_bytes=chunk_bytes)
        got = bpe.decode(tokens, RANKS).collect()
    own = Counter((r._row.doc_id, r._row.text, tuple(np.frombuffer(bytes(r.ids), "<u4").tolist()), bytes(r.decoded)) for r in got)
    assert own == Counter((i, t, tuple(tiktoken_encoding.encode_ordinary(t or "")), (t or "").encode()) for i, t in rows)
    assert all(r._row.kept == "x" for r in got)


def test_words_are_encoded_once(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)

    class Counting:
        def encode_words(self, batch):
            import uuid

            with open(f"{folder}/{uuid.uuid4().hex}", "w") as f:
                f.write("\n".join(batch))
            return [len(w).to_bytes(4, "little") for w in batch]

    monkeypatch.setattr(bpe, "vocabulary", lambda path: Counting())
    monkeypatch.setattr(bpe, "HELD_WORDS", 5)
    docs = frame(spark, [(k, f"the same words {k % 7} and others") for k in range(300)]).repartition(6)
    with Scratch(spark) as tmp:
        got = bpe.encode(docs, ["doc_id"], RANKS, public_tokenizers.PATTERN, tmp, chunk_bytes=500).collect()
    assert all(np.frombuffer(bytes(r.ids), "<u4").tolist() == [3, 5, 6, 2, 4, 7] for r in got) and len(got) == 300
    encoded = [w for f in tmp_path.iterdir() for w in f.read_text().split("\n") if w]
    assert len(encoded) == len(set(encoded)) == 12


def test_bpe_awkward(spark, tiktoken_encoding):
    none = frame(spark, [])
    with Scratch(spark) as tmp:
        assert bpe.decode(bpe.encode(none, ["doc_id"], RANKS, public_tokenizers.PATTERN, tmp), RANKS).count() == 0
        only_null = bpe.encode(frame(spark, [(1, None), (None, "")]), ["doc_id"], RANKS, public_tokenizers.PATTERN, tmp)
        assert [(bytes(r.ids), bytes(r.decoded)) for r in bpe.decode(only_null, RANKS).collect()] == [(b"", b"")] * 2
    with pytest.raises(Exception, match="not in the vocabulary"):
        bpe.decode(spark.createDataFrame([(np.array([60_000], "<u4").tobytes(),)], "ids binary"), RANKS).collect()
    assert bpe.decode(spark.createDataFrame([(None,)], "ids binary"), RANKS).collect()[0].decoded == b""


def test_registered_bpe(spark, tiktoken_encoding):
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    from keepsake.llm.queries import QUERIES

    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in QUERIES["op11_distinct_word_bpe"](spark, SF).collect()}
    want = set()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        ids = np.array(tiktoken_encoding.encode_ordinary(r.text or ""), "<u4")
        want.add((r.doc_id, len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256((r.text or "").encode()).hexdigest()))
    assert got == want
    drop_results(spark)
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("keepsake_")]


# --- 12 fill-in-middle


def test_boundary_set_selects():
    r = random.Random(1)
    sets = [range(0), range(5), range(1 << 18), range(0, 300_000, 2), range(7, 300_000, 40), sorted(r.sample(range(1 << 20), 90_000)), [*range(100), *range(65_530, 65_600), 1 << 24]]
    kinds = set()
    for offsets in sets:
        offsets = np.array(offsets, np.int64)
        s = fim.BoundarySet(offsets)
        assert len(s) == len(offsets)
        kinds |= {type(c) for c in s.containers}
        for k in [*range(min(len(s), 50)), *(r.randrange(len(s)) for _ in range(300 if len(s) else 0)), *([len(s) - 1] if len(s) else [])]:
            assert s.select(k) == offsets[k]
    assert kinds == {fim.ArrayContainer, fim.BitmapContainer, fim.RunContainer}


UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def brute_fim(i, text):
    text = text or ""
    units = UNIT.findall(text)
    digest = hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    return (n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h[3] % 100 < 80 else (n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")


def test_unit_ends(rows):
    for _, t in rows:
        assert fim.unit_ends(t or "").tolist() == list(itertools.accumulate(map(len, UNIT.findall(t or ""))))


def test_fim(spark, rows, docs):
    got = fim.transform(docs, ["doc_id", "text", "_text", "hash"]).withColumn("restored", fim.restore(F.col("form"), F.col("output"))).collect()
    own = Counter((r._row.doc_id, r._row.text, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got)
    assert own == Counter((i, t, *brute_fim(i, t)) for i, t in rows)
    assert all(r.restored == (r._row.text or "") for r in got)
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(frame(spark, []), ["doc_id"]).count() == 0


def test_cuts_of_huge_texts(spark):
    rows = [(k, ("ab " * 150_000 if k % 2 else "x" * 200_000 + " y" * 9 + "\n")) for k in range(12)]
    got = fim.transform(frame(spark, rows), ["doc_id"]).withColumn("restored", fim.restore(F.col("form"), F.col("output"))).collect()
    by_id = dict(rows)
    assert all((r.n, r.form, r.prefix_chars, r.middle_chars, r.output) == brute_fim(r._row.doc_id, by_id[r._row.doc_id]) and r.restored == by_id[r._row.doc_id] for r in got)


# --- 13 filter audit


def test_positional_popcount():
    r = np.random.default_rng(2)
    for n in [0, 1, 2, 3, 4, 5, 17, 1000, 4099]:
        w = r.integers(0, 1 << 32, n, dtype=np.uint32)
        assert audit.positional_popcount(w).tolist() == [int((w >> k & 1).sum()) for k in range(32)]
    assert audit.positional_popcount(np.full(70_000, 0xFFFFFFFF, np.uint32)).tolist() == [70_000] * 32


def brute_audit(rows, labels):
    """rows: (id, text, source)."""
    least = {}
    for i, t, _ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    docs = []
    for i, t, source in rows:
        t = t or ""
        w = words(t)
        fails = {
            "A": len(w) < 200, "B": 100 * len(set(w)) < 50 * len(w), "C": 100 * len(re.findall("[A-Z]", t)) > 2 * len(t), "D": bool(re.search(r"[#$%&*|]", t)),
            "E": t in least and (i is None or least[t] < i),
        }
        own = [x for x in labels if x[0] == i and i is not None]
        docs.append((source or "", {f for f, x in fails.items() if x}, any(q == 1 for _, q, _ in own), any(x == 1 for _, _, x in own)))
    out, fair = {}, Counter()
    for order in map("".join, itertools.permutations("ABCDE")):
        for part in {d[0] for d in docs}:
            left = [d for d in docs if d[0] == part]
            every = left
            for step, f in enumerate(order, 1):
                gone, left = [d for d in left if f in d[1]], [d for d in left if f not in d[1]]
                fails = sum(f in d[1] for d in every)
                out[part, order, step] = [len(left), len(gone), fails - len(gone), sum(d[1] == {f} for d in every), sum(d[2] for d in gone), sum(d[3] for d in gone)]
                fair[part, f] += len(gone)
    return {(p, o, s, *x, fair[p, o[s - 1]]) for (p, o, s), x in out.items()}


def test_audit(spark, rows, monkeypatch):
    monkeypatch.setattr(audit, "HELD", 3)
    some = [(i, t, None if k % 11 == 0 else f"s{k % 3}") for k, (i, t) in enumerate(rows)]
    some += [(5000 + k, "the same text", "hot") for k in range(200)] + [(None, "the same text", "hot"), (None, None, None)]
    labels = [(k, k % 2, k % 3 == 0) for k in range(0, 60)] + [(4, 1, 0), (5001, None, 1), (5002, 1, None), (None, 1, 1)]
    docs = spark.createDataFrame([(i, t, s, "x", "x", "x", 1) for i, t, s in some], "doc_id long, text string, source string, part string, mask string, digest string, id int").repartition(5)
    known = spark.createDataFrame([(i, q, None if x is None else int(x)) for i, q, x in labels], "doc_id long, quality int, toxic int")
    want = brute_audit(some, [(i, q, None if x is None else int(x)) for i, q, x in labels])
    got = audit.audit(docs, known)
    assert {tuple(r) for r in got.collect()} == want and got.count() == len(want)
    assert audit.audit(docs.limit(0), known).count() == 0
    # the joins beyond the size of a broadcast give the same
    monkeypatch.setattr(audit, "small_or_not", lambda df: df)
    assert {tuple(r) for r in audit.audit(docs, known.unionByName(known)).collect()} == want


# --- registered queries against their SQL


@pytest.mark.parametrize("name", ["op12_boundary_fim", "op13_survival_words"])
def test_equals_sql(spark, name):
    if not os.path.isdir(SF):
        pytest.skip("the given tables are not here")
    import duckdb

    from keepsake.llm.queries import ORACLE, QUERIES

    con = duckdb.connect()
    for table in ("documents", "labels"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    want = con.sql(ORACLE[name])
    got = QUERIES[name](spark, SF)
    assert sorted(got.columns) == sorted(want.columns)
    assert Counter(tuple(r) for r in got.select(want.columns).collect()) == Counter(want.fetchall())


def test_no_tables_stay(spark):
    from pathlib import Path

    drop_results(spark)
    assert not [p for p in Path(shared_dir(spark).removeprefix("file:")).iterdir() if p.name.startswith("keepsake-work")]
