"""Byte-level BPE of whole corpora, each distinct word encoded once.

Texts are split into pre-tokens by the vocabulary's pattern, chunk by chunk. A chunk
(some texts of one task, about CHUNK_BYTES) keeps its pre-tokens as positions of codes,
which stay where they are, and sends each of its distinct words out once. The words of all
chunks are shuffled by word and sorted, so equal ones meet; each distinct word is
encoded once, and its ids go back to every chunk that has it. There the ids are laid
out by position. A word that fills the corpus is one row for each chunk.

What stays is written bucketed by chunk, so that ids that come back are joined
to it without shuffling it again.

Decoding joins ids with the table of tokens and their bytes, which has a row for each id
of the vocabulary, whatever the corpus, and so is held by every task.

Edge cases. Null text counts as empty and has no ids; its bytes are empty. Null ids of
documents and repeated rows are kept as they are. Special tokens are ordinary
text. A word of any length is one word. An empty table gives an empty result. Input
columns of any name are allowed. Decoding an id that the vocabulary lacks raises.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, LongType, StringType, StructField, StructType

from keepsake.llm.common import Scratch, keep_in_worker, slices, text_of

#: Bytes of text of a chunk, and those that are split at a time; a longer text is a chunk of its own.
CHUNK_BYTES, SPLIT_BYTES = 32 << 20, 1 << 20
#: Words that a task encodes before it sends their ids back.
HELD_WORDS = 200_000


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes and ids of a vocabulary file: base64 and a number in each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Vocabulary:
    def __init__(self, path: str):
        import tiktoken

        ranks = read_ranks(path)
        # every text is one piece
        self.encoding = tiktoken.Encoding("keepsake", pat_str=r"(?s:.+)", mergeable_ranks=ranks, special_tokens={})
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            tokens[i] = token
        self.bytes = np.frombuffer(b"".join(tokens), np.uint8)
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length

    def encode_words(self, words: list[str]) -> list[bytes]:
        return [np.array(ids, "<u4").tobytes() for ids in self.encoding.encode_ordinary_batch(words, num_threads=1)]

    def decode(self, ids: np.ndarray) -> bytes:
        if len(ids) and (int(ids.max()) >= len(self.length) or not self.length[ids].all()):
            raise ValueError("an id is not in the vocabulary")
        return gather(self.bytes, self.start, self.length, ids).tobytes()


def vocabulary(path: str) -> Vocabulary:
    return keep_in_worker(f"bpe {path}", lambda: Vocabulary(path))


def planes(values: np.ndarray) -> bytes:
    """Unsigned 32-bit integers, all lowest bytes first: the bytes of small numbers compress well that way."""
    return values.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def from_planes(data: pa.Scalar) -> np.ndarray:
    buffer = data.as_buffer()
    return np.frombuffer(buffer or b"", np.uint8).reshape(4, -1).T.copy().view("<u4").ravel() if buffer.size else np.empty(0, "<u4")


def gather(values: np.ndarray, start: np.ndarray, length: np.ndarray, which: np.ndarray) -> np.ndarray:
    """values[start:start + length] of each entry of which, one after another."""
    n = length[which]
    ends = np.cumsum(n)
    return values[np.repeat(start[which] - ends + n, n) + np.arange(ends[-1] if len(ends) else 0)]


def _chunks(rows: DataFrame, pattern: str, chunk_bytes: int) -> DataFrame:
    """(chunk, _row, codes: planes of the text's pre-tokens' codes, words: on a chunk's first row, its distinct words by code).

    A chunk's most frequent words get its lowest codes.
    """

    def in_task(batches: Iterator[pa.RecordBatch]):
        import regex

        find = regex.compile(pattern).findall
        task, number = TaskContext.get().partitionId(), 0
        own, codes, words, size = [], [], {}, 0

        def closed() -> pa.RecordBatch:
            some = pa.concat_arrays(own)
            order = np.argsort(-sum(np.bincount(c, minlength=len(words)) for c in pieces(codes)), kind="stable")
            rank = np.empty(len(order), "<u4")
            rank[order] = np.arange(len(order))
            listed = pa.ListArray.from_arrays(pa.array([0, *[len(words)] * len(some)], pa.int32()), pa.array(list(words), pa.string()).take(pa.array(order)))
            listed = pc.if_else(pa.array(np.arange(len(some)) == 0), listed, pa.scalar(None, listed.type))
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(some), (task << 32) + number)), some, pa.array([planes(rank[c]) for c in codes], pa.binary()), listed], names=["chunk", "_row", "codes", "words"])

        def pieces(arrays: list[np.ndarray]) -> Iterator[np.ndarray]:
            """Few long arrays of many short ones."""
            for at in range(0, len(arrays), 1000):
                yield np.concatenate(arrays[at : at + 1000])

        for batch in batches:
            for first, texts in slices(batch.column(1), SPLIT_BYTES):
                own.append(batch.column(0).slice(first, len(texts)))
                for text in texts.to_pylist():
                    found = find(text)
                    codes.append(np.fromiter([words.setdefault(w, len(words)) for w in found], "<u4", len(found)))
                size += texts.nbytes
                if size >= chunk_bytes:
                    yield closed()
                    own, codes, words, size, number = [], [], {}, 0, number + 1
        if own:
            yield closed()

    schema = StructType([StructField("chunk", LongType()), rows.schema["_row"], StructField("codes", BinaryType()), StructField("words", ArrayType(StringType()))])
    return rows.mapInArrow(in_task, schema)


def _encoded(words: DataFrame, ranks: str) -> DataFrame:
    """(chunk, codes, lengths, ids): of words (chunk, code, word), a word encoded once for all chunks.

    The words of a chunk that a task has at hand go back as one row: planes of the steps between sorted codes, of
    the numbers of ids and of the ids. A task holds HELD_WORDS at a time.
    """

    def packed(chunk: np.ndarray, code: np.ndarray, which: np.ndarray, ids: list[bytes]) -> pa.RecordBatch:
        order = np.lexsort([code, chunk])
        chunk, code, which = chunk[order], code[order].astype(np.int64), which[order]
        length = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        values, start = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(length) - length
        cuts = [*np.flatnonzero(np.diff(chunk, prepend=chunk[0] - 1)).tolist(), len(chunk)]
        made = [(chunk[a], planes(np.diff(code[a:b], prepend=0)), planes(length[which[a:b]]), planes(gather(values, start, length, which[a:b]))) for a, b in zip(cuts, cuts[1:])]
        kinds = (pa.int64(), pa.binary(), pa.binary(), pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*made), kinds)], names=["chunk", "codes", "lengths", "ids"])

    def in_task(batches: Iterator[pa.RecordBatch]):
        last, ids = None, []
        chunks, codes, which, held = [], [], [], 0
        for batch in batches:
            word = batch.column(2)
            if not len(word):
                continue
            new = np.append(word[0].as_py() != last, pc.not_equal(word.slice(1), word.slice(0, len(word) - 1)).to_numpy(zero_copy_only=False)).astype(bool)
            which.append(np.cumsum(new) + len(ids) - 1)
            ids += vocabulary(ranks).encode_words(word.filter(pa.array(new)).to_pylist())
            last = word[len(word) - 1].as_py()
            chunks.append(batch.column(0).to_numpy())
            codes.append(batch.column(1).to_numpy())
            held += len(word)
            if held >= HELD_WORDS:
                yield packed(np.concatenate(chunks), np.concatenate(codes), np.concatenate(which), ids)
                # the last word may go on
                ids, chunks, codes, which, held = ids[-1:], [], [], [], 0
        if held:
            yield packed(np.concatenate(chunks), np.concatenate(codes), np.concatenate(which), ids)

    return words.repartition("word").sortWithinPartitions("word").mapInArrow(in_task, "chunk long, codes binary, lengths binary, ids binary")


def encode(docs: DataFrame, columns: list[str], ranks: str, pattern: str, tmp: Scratch, text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """(_row: struct of columns, ids: as little-endian unsigned 32-bit integers) for each document; read while tmp is open.

    ranks: path of a vocabulary's ranks, which every executor has; pattern: its pre-tokens.
    """
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), text_of(text_col).alias("_text"))
    chunks = tmp.save_bucketed(_chunks(rows, pattern, chunk_bytes), "chunks", "chunk")
    words = chunks.where("words is not null").select("chunk", F.posexplode("words").alias("code", "word"))

    def laid_out(left: pa.Table, right: pa.Table) -> pa.Table:
        """One chunk's texts, and the ids of its words."""
        code = [np.cumsum(from_planes(c), dtype=np.int64) for c in right.column("codes")]
        length, values = ([from_planes(x) for x in right.column(name)] for name in ("lengths", "ids"))
        code, length, values = (np.concatenate(x) if x else np.empty(0, np.int64) for x in (code, length, values))
        ends, by_code = np.cumsum(length, dtype=np.int64), np.argsort(code)
        start, length = (ends - length)[by_code], length[by_code].astype(np.int64)
        ids = [gather(values, start, length, from_planes(c)).tobytes() for c in left.column("codes")]
        return pa.table([left.column("_row"), pa.array(ids, pa.binary())], names=["_row", "ids"])

    texts = chunks.select("chunk", "_row", "codes").groupBy("chunk")
    return texts.cogroup(_encoded(words, ranks).groupBy("chunk")).applyInArrow(laid_out, StructType([rows.schema["_row"], StructField("ids", BinaryType())]))


def decode(tokens: DataFrame, ranks: str, ids_col: str = "ids") -> DataFrame:
    """tokens with a column decoded: the bytes of ids_col (little-endian unsigned 32-bit ids; null counts as empty)."""
    at = tokens.columns.index(ids_col)

    def in_task(batches: Iterator[pa.RecordBatch]):
        table = vocabulary(ranks)
        for batch in batches:
            for first, ids in slices(batch.column(at), 4 * SPLIT_BYTES):
                out = [table.decode(np.frombuffer(x.as_buffer(), "<u4")) if x.as_buffer().size else b"" for x in ids]
                yield pa.RecordBatch.from_arrays([*[c.slice(first, len(ids)) for c in batch.columns], pa.array(out, pa.binary())], names=[*batch.schema.names, "decoded"])

    return tokens.mapInArrow(in_task, StructType([*tokens.schema.fields, StructField("decoded", BinaryType())]))
