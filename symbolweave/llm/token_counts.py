"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A byte-pair tokenizer encodes each pre-token on its own, and where a pre-token ends depends
on no more than its own characters and the next two.  So the tokens of a text are the sum over
its pre-tokens, and an edit changes only those that it touches, those that end just before it, and
those behind it up to the first place where old and new borders agree.

A document's pre-tokens lie in leaves of a few dozen.  The tree above them holds the sums of
characters and of tokens: it leads from a place in the text to its leaf, and an edit encodes
the region it touches, puts it in place of the old leaves' content, and updates the sums above.
A leaf that has grown too long makes the tree anew from the counts, without encoding.

Edits are (start, length, replacement) in characters, applied one after the other, each to
the text that the last one left.  Places outside the text are moved to its nearest end; an edit
that is null, or whose start is, is skipped, a null length is 0 and a null replacement is empty.
A null text is empty, without tokens.  Repeated rows are edited each on its own; nulls elsewhere do
not matter, and an empty table gives an empty result.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.text import chunks

LEAF, LONGEST_LEAF = 32, 256
# Characters behind its end that decide a pre-token: a run of blanks gives its last one to the
# next word, so it looks at that blank and at the character behind it.
AHEAD = 2
REMEMBERED = 400_000


class Encoder:
    """Counts of pre-tokens under a byte-pair vocabulary of ranks; what it remembers is bounded."""

    def __init__(self, path: str, pattern: str) -> None:
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self._encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        # the tokenizer's blanks are those of Unicode, without the separators U+001C to U+001F
        self.pattern = regex.compile(pattern)
        self._known: dict[str, int] = {}

    def counts(self, pretokens: list[str]) -> list[int]:
        known = self._known
        if len(known) > REMEMBERED:
            known.clear()
        for new in set(pretokens).difference(known):
            known[new] = len(self._encoding.encode_ordinary(new))
        return [known[p] for p in pretokens]

    def whole(self, text: str) -> int:
        return len(self._encoding.encode_ordinary(text))


@lru_cache(maxsize=4)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


class CountTree:
    """A text, its pre-tokens' sizes and counts by leaf, and the sums above them."""

    def __init__(self, text: str, encoder: Encoder) -> None:
        self.text, self.encoder = text, encoder
        pretokens = encoder.pattern.findall(text)
        self.encoded = len(pretokens)
        self._build(list(map(len, pretokens)), encoder.counts(pretokens))

    def _build(self, sizes: list[int], counts: list[int]) -> None:
        self.leaves = [(sizes[k : k + LEAF], counts[k : k + LEAF]) for k in range(0, len(sizes), LEAF)] or [([], [])]
        level = np.zeros((len(self.leaves), 2), np.int64)
        if sizes:
            heads = np.arange(0, len(sizes), LEAF)
            level[:, 0], level[:, 1] = np.add.reduceat(sizes, heads), np.add.reduceat(counts, heads)
        self.levels = [level]
        while len(level) > 1:
            if len(level) % 2:
                level = np.vstack([level, np.zeros((1, 2), np.int64)])
                self.levels[-1] = level
            level = level[0::2] + level[1::2]
            self.levels.append(level)

    @property
    def tokens(self) -> int:
        return int(self.levels[-1][0, 1])

    @property
    def pretokens(self) -> int:
        return sum(len(sizes) for sizes, _ in self.leaves)

    def _leaf_at(self, place: int) -> tuple[int, int]:
        """The leaf that holds a character, the last one for a place behind the text, and where it begins."""
        node, begin = 0, 0
        for level in reversed(self.levels[:-1]):
            node *= 2
            left = int(level[node, 0])
            if place >= begin + left and node + 1 < len(level) and int(level[node + 1, 0]):
                begin, node = begin + left, node + 1
        return node, begin

    def _set(self, leaf: int, sizes: list[int], counts: list[int]) -> None:
        self.leaves[leaf] = (sizes, counts)
        value = np.array([sum(sizes), sum(counts)], np.int64)
        change = value - self.levels[0][leaf]
        for level in self.levels:
            level[leaf] += change
            leaf //= 2

    def edit(self, start: int, length: int, replacement: str) -> int:
        """Apply an edit; how many pre-tokens were encoded for it."""
        start = min(max(start, 0), len(self.text))
        end = min(start + max(length, 0), len(self.text))
        shift = len(replacement) - (end - start)
        self.text = self.text[:start] + replacement + self.text[end:]
        # the first pre-token that the edit touches, or that ends so near that it looked at what changes
        leaf, begin = self._leaf_at(max(start - AHEAD, 0))
        sizes, counts = self.leaves[leaf]
        first, at = 0, begin
        while first < len(sizes) and at + sizes[first] <= start - AHEAD:
            at += sizes[first]
            first += 1
        head_sizes, head_counts = sizes[:first], counts[:first]
        # old borders behind the edit, leaf by leaf, until a new one agrees
        last, k, border = leaf, first, at
        new: list[str] = []
        place = at
        while place < len(self.text):
            found = self.encoder.pattern.match(self.text, place)
            new.append(found.group())
            place = found.end()
            if place >= start + len(replacement):
                while border < place - shift:
                    if k == len(self.leaves[last][0]):
                        last, k = last + 1, 0
                        continue
                    border += self.leaves[last][0][k]
                    k += 1
                if border == place - shift and border >= end:
                    break
        else:  # the text ends here, and so does all that was
            last, k = len(self.leaves) - 1, len(self.leaves[-1][0])
        tail_sizes, tail_counts = self.leaves[last][0][k:], self.leaves[last][1][k:]
        for gone in range(leaf + 1, last + 1):
            self._set(gone, [], [])
        self._set(leaf, head_sizes + list(map(len, new)) + tail_sizes, head_counts + self.encoder.counts(new) + tail_counts)
        self.encoded += len(new)
        if len(self.leaves[leaf][0]) > LONGEST_LEAF:
            self._build([s for x, _ in self.leaves for s in x], [c for _, x in self.leaves for c in x])
        return len(new)


COUNTED = ("doc_id long, n_pretokens long, tokens_before long, tokens_after long, n_edits int, n_reencoded long, "
           "chars_after long")


def edited_counts(docs: DataFrame, edits: Column, ranks: str, pattern: str) -> DataFrame:
    """Tokens of each text before and after its ``edits``, an array of (start, length, replacement).

    ``ranks`` is the path of a file of byte-pair ranks and ``pattern`` splits texts into pre-tokens.
    ``n_reencoded`` are the pre-tokens that the edits made it encode.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                       edits.cast("array<struct<start: int, length: int, replacement: string>>").alias("edits"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = encoder(ranks, pattern)
        for chunk in chunks(batches):
            out = []
            for doc_id, text, changes in zip(*(chunk.column(k).to_pylist() for k in range(3)), strict=True):
                tree = CountTree(text, counter)
                size, before = tree.encoded, tree.tokens
                done = [tree.edit(c["start"], c["length"] or 0, c["replacement"] or "")
                        for c in changes or () if c and c["start"] is not None]
                out.append((doc_id, size, before, tree.tokens, len(done), sum(done), len(tree.text)))
            kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True), kinds, strict=True)],
                                             names=[c.split()[0] for c in COUNTED.split(", ")])

    return rows.mapInArrow(task, COUNTED)
