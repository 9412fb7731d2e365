"""Token ids of whole Arrow text columns, by the tokenizers library.

White space separates tokens in the word-level vocabulary used here, so a text's
ids are those of its white-space-separated pieces, one after another. A batch is
split in Arrow, only pieces that the worker has not met are encoded, and the ids
are laid out with numpy. Texts that hold "<|", the start of a special token, are
encoded whole.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from keepsake.llm.common import keep_in_worker, slices

#: Pieces whose ids a worker remembers: about 80 MB.
REMEMBERED = 400_000
#: Bytes of text that are split at a time.
SPLIT_BYTES = 2 << 20
#: Pieces that are one word for the vocabulary; many of them are encoded as one text.
_WORD = re.compile("[a-zà-öø-ÿ]+").fullmatch
_TOGETHER = 64


class Encoder:
    """Rows of ids are unsigned 32-bit and little-endian throughout."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        self.word_end = np.zeros(self.tokenizer.get_vocab_size() + 1, bool)
        self.word_end[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        ids = self.library([" ".join(words[i : i + _TOGETHER]) for i in range(0, len(words), _TOGETHER)])
        ids = np.concatenate(ids) if ids else np.empty(0, "<u4")
        cuts = ((np.flatnonzero(self.word_end[ids]) + 1) * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] for a, b in zip([0, *cuts], cuts, strict=False)]

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        known = self.known
        out = list(map(known.get, pieces))
        missing = [i for i, x in enumerate(out) if x is None]
        words, others = [], []
        for i in missing:
            (words if _WORD(pieces[i]) else others).append(i)
        for some, ids in ((words, self._words([pieces[i] for i in words])), (others, [x.tobytes() for x in self.library([pieces[i] for i in others])])):
            for i, x in zip(some, ids, strict=True):
                out[i] = x
        known.update((pieces[i], out[i]) for i in missing[: max(0, REMEMBERED - len(known))])
        return out

    def encode(self, texts: pa.Array, end_id: int):
        """For each stretch of rows: (first row, ids of all its texts, each with end_id appended, length of each)."""
        for first, some in slices(texts, SPLIT_BYTES):
            yield first, *self._encode(some, end_id)

    def _encode(self, texts: pa.Array, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        special = pc.match_substring(texts, "<|").to_numpy(zero_copy_only=False)
        plain = pc.if_else(pa.array(special), "", texts) if special.any() else texts
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        words = pc.dictionary_encode(split.flatten())
        row_end = np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))
        pieces = [*self._pieces(words.dictionary.to_numpy(zero_copy_only=False).tolist()), np.uint32(end_id).tobytes()]
        codes = np.insert(words.indices.to_numpy(), row_end, len(pieces) - 1)  # the end id is a last piece of each row
        # each piece's ids are laid out from its place in all_ids
        all_ids, size = np.frombuffer(b"".join(pieces), "<u4"), np.fromiter(map(len, pieces), np.int32, len(pieces)) // 4
        begin = np.cumsum(size) - size
        length = size[codes]
        piece_end = np.cumsum(length, dtype=np.int64)
        ids = all_ids[np.repeat(begin[codes] - piece_end + length, length) + np.arange(piece_end[-1] if len(codes) else 0)]
        ends = piece_end[row_end + np.arange(len(row_end))]
        count = np.diff(np.concatenate([[0], ends]))
        if special.any():
            parts = np.split(ids, ends[:-1])
            for i in np.flatnonzero(special):
                parts[i] = np.append(self.library([texts[int(i)].as_py()])[0], np.uint32(end_id))
            ids, count = np.concatenate(parts), np.array([len(p) for p in parts])
        return ids, count


def encoder(path: str) -> Encoder:
    return keep_in_worker(f"encoder {path}", lambda: Encoder(path))
