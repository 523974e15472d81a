"""Token ids of whole batches: the distinct units of a batch are encoded once, the rest is numpy."""

from __future__ import annotations

import os
from array import array
from functools import lru_cache
from unicodedata import is_normalized

import numpy as np
import pyarrow as pa

from lens.llm.common import BLANK, lowered, rows_of, utf8

CACHE = 300_000
_LETTER, _DIGIT, _SIGN, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    out = np.full(256, _SIGN, np.uint8)
    out[0x61:0x7B] = out[0x41:0x5B] = _LETTER
    out[0x30:0x3A] = _DIGIT
    out[0x80:] = out[0x27] = _OTHER
    out[BLANK] = 0
    return out


_CLASS = _classes()


class WordEncoder:
    """For tokenizers that drop white space, fold case and encode runs of letters, digits and signs by themselves, such as
    word_bpe_49k.json: the ids of a text are those of its units, one after the other.

    Units are words, cut further between ASCII letters, digits and signs. An apostrophe or a character outside ASCII may
    belong to what is on either side, so nothing is cut beside one; and where a batch may hold a special token's string,
    its words stay whole and as they are.
    """

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.known: dict[bytes, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)  # ids that end a run
        self.last[[k for token, k in vocabulary.items() if token.endswith("</w>")]] = True

    def units(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """For each unit its row and its place among the batch's distinct units, and these units' ids as bytes."""
        return self._cut(column)[:3]

    def _cut(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """What units() returns, and the byte where each unit starts."""
        data, at = utf8(column)
        kind = _CLASS[data]
        if special := b"<|" in data.tobytes():
            kind = (kind > 0).astype(np.uint8)
        else:
            data = lowered(data)
        start = kind > 0
        if len(kind):
            before, now = kind[:-1], kind[1:]
            start[1:] &= (before == 0) | ((before != now) & (before != _OTHER) & (now != _OTHER))
        if special:
            start[1:] = (kind[1:] > 0) & (kind[:-1] == 0)
        heads = at[:-1][at[:-1] < len(kind)]
        start[heads] = kind[heads] > 0
        first, full = np.flatnonzero(start), kind > 0
        ends = np.concatenate([[0], np.cumsum(full, dtype=np.int64)])[np.concatenate([first, [len(kind)]])]
        every = pa.Array.from_buffers(pa.large_binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(data[full]))]).dictionary_encode()
        return rows_of(first, at), every.indices.to_numpy().astype(np.int64), self.encode(every.dictionary.to_pylist()), first

    def leaves(self, column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each row where its units start, in code points, and their tokens."""
        row, index, distinct, first = self._cut(column)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct))[index] // 4
        data, at = utf8(column)
        points = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int64)])
        starts = points[first] - points[at[row]]
        ends = np.searchsorted(row, np.arange(1, len(column)))
        return list(zip(np.split(starts, ends), np.split(sizes, ends), strict=True))

    def counts(self, words: list[str]) -> list[int]:
        """How many ids each word has; words that were met before aren't encoded again."""
        return [len(x) // 4 for x in self.encode([w.encode() for w in words])]

    def encode(self, units: list[bytes]) -> list[bytes]:
        if len(self.known) > CACHE:
            self.known.clear()
        new = [u for u in units if u not in self.known]
        letters, rest = [], []
        for u in new:
            text = u.decode()
            (letters if text.isalpha() and text.lower().isalpha() and is_normalized("NFC", text) else rest).append(text)
        groups = [letters[k : k + 200] for k in range(0, len(letters), 200)]
        for k in range(0, len(groups), 20):
            some = groups[k : k + 20]
            for group, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(g) for g in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, np.uint32)
                ends = 4 * np.flatnonzero(self.last[ids]) + 4
                if len(ends) != len(group):  # some unit is more than one run
                    rest += group
                    continue
                raw = ids.tobytes()
                for text, start, end in zip(group, [0, *ends[:-1].tolist()], ends.tolist(), strict=True):
                    self.known[text.encode()] = raw[start:end]
        for k in range(0, len(rest), 4096):
            some = rest[k : k + 4096]
            for text, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                self.known[text.encode()] = array("I", e.ids).tobytes()
        return [self.known[u] for u in units]

    def ids(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch, each text followed by the id `end`, and where each text starts (one more at the end)."""
        row, index, distinct = self.units(column)
        distinct = [*distinct, array("I", [end]).tobytes()]
        index = np.insert(index, np.searchsorted(row, np.arange(len(column)), "right"), len(distinct) - 1)
        sizes = np.fromiter(map(len, distinct), np.int64, len(distinct)) // 4
        flat, begins = np.frombuffer(b"".join(distinct), np.uint32), np.concatenate([[0], np.cumsum(sizes)[:-1]])
        size = sizes[index]
        after = np.cumsum(size)
        out = flat[np.arange(after[-1] if len(after) else 0) + np.repeat(begins[index] - after + size, size)]
        return out, np.concatenate([[0], after[np.flatnonzero(index == len(distinct) - 1)]])


@lru_cache(maxsize=1)
def word_encoder(path: str) -> WordEncoder:
    """One for all tasks of a worker process, which then share what it knows."""
    return WordEncoder(path)
