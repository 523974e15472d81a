"""Token counts that follow edits: each document has a segment tree over its pre-tokens, whose sums are characters and
tokens. An edit re-encodes the pre-tokens that it touches and one on either side, and updates the sums above them.

Pre-tokens are the encoder's units, found for whole batches, and words where an edit has been. Where an edit leaves what may
begin a special token's string, the words around it are encoded whole, which is how the encoder takes them. A leaf holds
one pre-token at first, and more where edits put some in; the tree is built anew where they are too many."""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lens.llm.common import plain, small_batches, table
from lens.llm.packing import vocabulary
from lens.llm.tokens import WordEncoder, word_encoder

SCHEMA = "doc_id long, n_tokens long, n_edits long, n_tokens_after long, n_reencoded_chars long, n_chars_after long"
_WORD, _BLANK = re.compile(r"([^\x20\x09-\x0D]+)[\x20\x09-\x0D]*"), re.compile(r"[\x20\x09-\x0D]")
MOST_A_LEAF = 32

Piece = tuple[str, int]  # a pre-token with the blanks behind it, and its tokens

Edit = tuple[int, int, str]  # from, to, and what comes there instead, in code points of the text as it is by then


class CountTree:
    """A text's pre-tokens, with sums over ranges of them. A leaf is a pre-token with the blanks behind it; the first one also
    has those before it. `leaves`: the text's, if they are known already."""

    def __init__(self, encoder: WordEncoder, text: str, leaves: tuple[np.ndarray, np.ndarray] | None = None) -> None:
        self.encoder, self.source, self.reencoded = encoder, text, 0
        self.changed: dict[int, list[Piece]] = {}
        starts, counts = leaves or encoder.leaves(pa.array([text]))[0]
        n = max(1, len(starts))
        self.bounds = np.zeros(n + 1, np.int64)
        self.bounds[1:-1], self.bounds[-1] = starts[1:], len(text)
        self._build(self.bounds[1:] - self.bounds[:-1], counts)

    def _build(self, sizes: np.ndarray, counts: np.ndarray) -> None:
        self.leaves = 1 << (max(1, len(sizes)) - 1).bit_length()
        self.sums = np.zeros((2 * self.leaves, 2), np.int64)  # node k has 2k and 2k + 1 below it
        self.sums[self.leaves : self.leaves + len(sizes), 0] = sizes
        self.sums[self.leaves : self.leaves + len(counts), 1] = counts
        level = self.leaves
        while level > 1:
            np.add(self.sums[level : 2 * level : 2], self.sums[level + 1 : 2 * level : 2], out=self.sums[level // 2 : level])
            level //= 2
        self.up = np.arange(self.leaves.bit_length())  # from a leaf to the root

    @property
    def chars(self) -> int:
        return int(self.sums[1, 0])

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    def leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that a character is in (the last one with characters, for the end of the text), and where it starts."""
        node, before = 1, 0
        place = min(place, self.chars - 1)
        while node < self.leaves:
            node *= 2
            if place >= before + self.sums[node, 0]:
                before += int(self.sums[node, 0])
                node += 1
        return node - self.leaves, before

    def pieces_of(self, leaf: int) -> list[Piece]:
        if leaf in self.changed:
            return self.changed[leaf]
        if leaf >= len(self.bounds) - 1:
            return []
        return [(self.source[self.bounds[leaf] : self.bounds[leaf + 1]], int(self.sums[leaf + self.leaves, 1]))]

    def put(self, leaf: int, pieces: list[Piece]) -> None:
        if not pieces and not self.sums[leaf + self.leaves].any():
            return
        self.changed[leaf] = pieces
        new = (sum(len(text) for text, _ in pieces), sum(n for _, n in pieces))
        node = leaf + self.leaves
        self.sums[node >> self.up] += new - self.sums[node]

    def _cut(self, text: str) -> list[Piece]:
        """The words of a text with the blanks behind them, encoded; the first also has the blanks before it."""
        found = list(_WORD.finditer(text))
        if not found:
            return [(text, 0)] if text else []
        counts = self.encoder.counts([m[1] for m in found])
        return [(m[0] if k else text[: m.end()], n) for k, (m, n) in enumerate(zip(found, counts, strict=True))]

    def edit(self, start: int, end: int, new: str) -> None:
        if not self.chars:
            self.put(0, self._cut(new))
            self.reencoded += len(new)
            return
        first, before = self.leaf_at(start)
        last, at = self.leaf_at(max(start, end - 1))
        if before:  # the one before, or the nearest that holds anything
            first, before = self.leaf_at(before - 1)
        after = at + int(self.sums[last + self.leaves, 0])
        if after < self.chars:
            last, at = self.leaf_at(after)
        pieces = [p for k in range(first, last + 1) for p in self.pieces_of(k) if p[0]]
        places = [0, *accumulate(len(text) for text, _ in pieces)]
        low = max(0, bisect_right(places, start - before, 0, len(pieces)) - 2)  # one on either side of those that are touched
        high = min(len(pieces), bisect_right(places, max(start, end - 1) - before, 0, len(pieces)) + 1)
        region = "".join(text for text, _ in pieces[low:high])
        region = region[: start - before - places[low]] + new + region[end - before - places[low] :]
        if "<|" in region:  # whole words: as far as blanks, or the text's ends
            while (low or before) and not _BLANK.match(region):
                if not low:
                    first, before = self.leaf_at(before - 1)
                    more = [p for p in self.pieces_of(first) if p[0]]
                    pieces, low, high = more + pieces, len(more), high + len(more)
                if _BLANK.match(pieces[low - 1][0][-1]):
                    break
                low -= 1
                region = pieces[low][0] + region
            while (high < len(pieces) or at + int(self.sums[last + self.leaves, 0]) < self.chars) and not _BLANK.match(region, max(0, len(region) - 1)):
                if high == len(pieces):
                    last, at = self.leaf_at(at + int(self.sums[last + self.leaves, 0]))
                    pieces += [p for p in self.pieces_of(last) if p[0]]
                region += pieces[high][0]
                high += 1
        pieces[low:high] = self._cut(region)
        self.reencoded += len(region)
        share = -(-len(pieces) // (last - first + 1))
        for k in range(first, last + 1):
            self.put(k, pieces[(k - first) * share : (k - first + 1) * share])
        if share > MOST_A_LEAF:
            pieces = [p for k in range(self.leaves) for p in self.pieces_of(k) if p[0]]
            self.changed, self.bounds = {k: [p] for k, p in enumerate(pieces)}, self.bounds[:1]
            self._build(np.array([len(text) for text, _ in pieces]), np.array([n for _, n in pieces]))

    def text(self) -> str:
        return "".join(text for k in range(self.leaves) for text, _ in self.pieces_of(k))


def usual_edits(rank: int, n: int) -> list[Edit]:
    """Three edits that depend on a number and the text's length only: for the query, which has no edits of its own."""
    a, b, c = (rank >> 3) % (n + 1), (rank >> 17) % (n + 1), (rank >> 31) % (n + 1)
    cut = min(n, b + 7)
    return [(a, a, " new words, 12"), (min(b, n), cut, ""), (min(c, n), min(c + 3, n), "X")]


def edited_counts(docs: DataFrame, tokenizer: str, edits=usual_edits) -> DataFrame:
    """A row for each row of docs (doc_id, text): its tokens before and after the edits that `edits` gives for a hash of the
    doc_id and the text's length, how many characters were encoded again, and how long the text has become.

    Null texts count as empty; a null doc_id stays null; equal rows each get a row; an empty table gives none; further
    columns are ignored. Edits beyond the end of the text as it is by then apply at its end.
    """
    small_batches(docs.sparkSession)
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_encoder(tokenizer)
        for batch in batches:
            rows = []
            for doc_id, rank, text, leaves in zip(*(batch.column(k).to_pylist() for k in range(3)), encoder.leaves(batch.column(2)), strict=True):
                tree = CountTree(encoder, text or "", leaves)
                before, todo = tree.tokens, edits(rank & (2**63 - 1), tree.chars)
                for start, end, new in todo:
                    tree.edit(min(start, tree.chars), min(max(start, end), tree.chars), new)
                rows.append((doc_id, before, len(todo), tree.tokens, tree.reencoded, tree.chars))
            columns = list(zip(*rows, strict=True)) if rows else [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names)

    return plain(docs, "doc_id", "text").select(F.col("doc_id").cast("long"), F.xxhash64("doc_id"), "text").mapInArrow(run, SCHEMA)


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return edited_counts(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))


QUERIES = {"op7_token_counts": op7_token_counts}
SQL: dict[str, str] = {}
