"""Token ids of texts by a public tokenizer that never joins across blanks.

Texts are split at ASCII blanks and each distinct word is tokenised once while it is
remembered, so the cost follows the vocabulary more than the text.  This is exact for a
tokenizer that drops white space before it forms tokens, which ``WordTokens`` relies on.
"""

from __future__ import annotations

import os

from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from symbolweave.llm.text import blank_separated

# Bytes that one worker remembers words in (texts, ids and about 200 bytes an entry for Python's
# own objects); then it begins anew, so memory is bounded whatever the words look like.
REMEMBERED_BYTES = 144 << 20
ENTRY_BYTES = 200
BATCH = 4096


class WordTokens:
    """Reads a tokenizer file; ``lower`` says that it makes no difference between A-Z and a-z.

    Marks of punctuation at a word's end, behind a letter or digit, are tokens of their own in such a
    tokenizer, so words with and without them are one entry.
    """

    MARKS = ".,!?;:"

    def __init__(self, path: str, lower: bool = True) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.lower = Tokenizer.from_file(path), lower
        self._forget()

    def _forget(self) -> None:
        self.number: dict[str, int] = {}
        self.held = 0
        self.sizes = np.zeros(0, np.int64)
        self.ids = np.zeros(0, np.uint32)

    def _numbers(self, words: list[str]) -> np.ndarray:
        """The entries of different words; new ones are tokenised."""
        known, found = self.number, list(map(self.number.get, words))
        new = [w for w, n in zip(words, found, strict=True) if n is None]
        sizes, ids = [self.sizes], [self.ids]
        for at in range(0, len(new), BATCH):
            part = [e.ids for e in self.tokenizer.encode_batch_fast(new[at : at + BATCH], add_special_tokens=False)]
            sizes.append(np.fromiter(map(len, part), np.int64, len(part)))
            ids.append(np.array([i for p in part for i in p], np.uint32))
        if new:
            self.held += sum(map(len, new)) + ENTRY_BYTES * len(new) + sum(i.nbytes for i in ids[1:])
            known.update(zip(new, range(len(known), len(known) + len(new)), strict=True))
            self.sizes, self.ids = np.concatenate(sizes), np.concatenate(ids)
            found = [known[w] if n is None else n for w, n in zip(words, found, strict=True)]
        return np.array(found, np.int64)

    def encode(self, column: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids, each text's followed by ``end`` if there is one, and where each text begins."""
        # special tokens are found as they are written, so a text that may hold one keeps its case
        lower = self.lower and not pc.any(pc.match_substring(column, "<|")).as_py()
        words, starts = blank_separated(column, lower=lower)
        coded = words.dictionary_encode()
        codes = np.asarray(coded.indices, dtype=np.int64)
        bare = pc.ascii_rtrim(coded.dictionary, self.MARKS)
        parted = pc.match_substring_regex(bare, r"[A-Za-z0-9]$")
        parted = pc.and_(parted, pc.not_equal(pc.binary_length(bare), pc.binary_length(coded.dictionary)))
        stems = pc.if_else(parted, bare, coded.dictionary).dictionary_encode()
        split = parted.to_numpy(zero_copy_only=False)
        tails = np.zeros(len(coded.dictionary), np.int64)
        if self.held > REMEMBERED_BYTES:
            self._forget()
        heads = self._numbers(stems.dictionary.to_pylist())[np.asarray(stems.indices)] if len(words) else tails
        if split.any():
            rows = np.flatnonzero(split)
            kept = pc.binary_length(bare).to_numpy(zero_copy_only=False)[rows].tolist()
            ends = pa.array([w[n:] for w, n in zip(
                coded.dictionary.take(pa.array(rows)).cast(pa.large_binary()).to_pylist(), kept, strict=True)]).dictionary_encode()
            tails[rows] = self._numbers([e.decode() for e in ends.dictionary.to_pylist()])[np.asarray(ends.indices)] + 1
        # a word is its stem's ids, then its marks'
        both = np.stack([heads[codes] + 1, tails[codes]], axis=1).ravel()
        sizes = np.concatenate([[0], self.sizes])[both]
        first = np.concatenate([[0], np.cumsum(self.sizes) - self.sizes])[both]
        ends = np.cumsum(sizes)
        ids = self.ids[np.repeat(first - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)]
        begins = np.concatenate([[0], ends])[2 * starts]
        if end is None:
            return ids, begins
        out = np.full(len(ids) + len(starts) - 1, end, np.uint32)
        own = np.ones(len(out), bool)
        begins = begins + np.arange(len(begins))
        own[begins[1:] - 1] = False
        out[own] = ids
        return out, begins


@lru_cache(maxsize=2)
def word_tokens(path: str) -> WordTokens:
    """One for each worker process, so that tasks share what it remembers."""
    return WordTokens(path)
