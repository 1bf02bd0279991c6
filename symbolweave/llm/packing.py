"""Packing texts into sequences of tokens: shortest pack first, over the histogram of lengths.

1. One pass over the texts makes token ids and cuts each document at every ``size`` tokens; of each
   piece only its place, its length and a checksum of its ids are written down, with its
   number among the pieces of that length in its task.
2. The histogram of lengths - at most ``size`` numbers, whatever the corpus - is packed: lengths
   are placed longest first, each into the packs with the most room; a pack stands for
   all sequences of one pattern, with their count.  Lengths that fit no open pack open as
   many new ones as they fill.
3. Patterns are joined back by rank: the r-th piece of a length takes the r-th place of that
   length among the patterns.  Ranks are numbers within a task plus what earlier tasks
   have, so no length has to meet in one task.

The patterns are bounded by ``size`` too, and are what is sent to the tasks.  A null or empty text
is its end token alone.  Repeated rows are packed each on its own; a null ``doc_id`` stays
null.  An empty table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.lineage import cut
from symbolweave.llm.text import chunks, id_and_text, small_batches
from symbolweave.llm.word_tokens import word_tokens

SIZE, END = 4096, 2
# Bytes of text encoded together: ids, codes and checksums are a small multiple of it.
TOGETHER = 2 << 20

PIECES = "doc_id long, start long, length int, ids_crc32 long, doc_tokens long, part int, number long"
Pattern = tuple[tuple[int, int], ...]  # (length, how often), longest first


def shortest_pack_first(histogram: dict[int, int], size: int = SIZE) -> list[tuple[int, Pattern]]:
    """Counts and patterns of packs of at most ``size``, for a histogram of lengths."""
    open_packs: dict[int, list[tuple[int, Pattern]]] = defaultdict(list)  # by room

    for length in sorted(histogram, reverse=True):
        left = histogram[length]
        room = size
        while left:
            while room >= length and not open_packs.get(room):
                room -= 1
            if room < length:
                break
            count, pattern = open_packs[room].pop()
            used = min(count, left)
            if used < count:
                open_packs[room].append((count - used, pattern))
            same = pattern[-1][1] if pattern[-1][0] == length else 0
            kept = pattern[:-1] if same else pattern
            open_packs[room - length].append((used, (*kept, (length, same + 1))))
            left -= used
        each = size // length
        for count, often in ((left // each, each), (1 if left % each else 0, left % each)):
            if count:
                open_packs[size - often * length].append((count, ((length, often),)))
    merged: dict[Pattern, int] = defaultdict(int)
    for packs in open_packs.values():
        for count, pattern in packs:
            merged[pattern] += count
    return [(count, pattern) for pattern, count in merged.items()]


def _cut_pieces(tokenizer: str, end: int, size: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = word_tokens(tokenizer), TaskContext.get().partitionId()
        seen = np.zeros(size + 1, np.int64)
        for chunk in chunks(batches, TOGETHER):
            ids, begins = words.encode(chunk.column(1), end)
            body, rows = memoryview(ids.astype("<u4")).cast("B"), []
            for doc_id, lo, hi in zip(chunk.column(0).to_pylist(), begins[:-1].tolist(), begins[1:].tolist(), strict=True):
                for at in range(lo, hi, size):
                    to = min(at + size, hi)
                    rows.append((doc_id, at - lo, to - at, zlib.crc32(body[4 * at : 4 * to]), hi - lo, part, int(seen[to - at])))
                    seen[to - at] += 1
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                             names=[c.split()[0] for c in PIECES.split(", ")])

    return task


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, packs: list[tuple[int, Pattern]]) -> None:
        by_length: dict[int, list[tuple[int, int, int, int, int]]] = defaultdict(list)
        first = 0
        for count, pattern in packs:
            offset, total = 0, sum(length * often for length, often in pattern)
            for length, often in pattern:
                by_length[length].append((count * often, often, first, offset, total))
                offset += length * often
            first += count
        self.of = {}
        for length, rows in by_length.items():
            table = np.array(rows, np.int64)
            self.of[length] = (np.cumsum(table[:, 0]) - table[:, 0], *table[:, 1:].T)

    def look_up(self, length: np.ndarray, rank: np.ndarray) -> np.ndarray:
        """Rows of sequence, offset and the sequence's tokens."""
        out = np.zeros((3, len(length)), np.int64)
        for value in np.unique(length).tolist():
            mine = np.flatnonzero(length == value)
            starts, often, first, offset, total = self.of[value]
            at = np.searchsorted(starts, rank[mine], "right") - 1
            within = rank[mine] - starts[at]
            out[0, mine] = first[at] + within // often[at]
            out[1, mine] = offset[at] + within % often[at] * value
            out[2, mine] = total[at]
        return out


PLACED = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, "
          "sequence_tokens long, padded_to long")


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, end: int = END) -> DataFrame:
    """One row per piece: its document and place there, and its sequence and place there.

    ``tokenizer`` is the path of a tokenizer file; ``sequence_tokens`` are those a sequence holds, and
    ``padded_to`` is ``size``, or that number itself if it is a power of two.
    """
    spark = docs.sparkSession
    with small_batches(spark):
        pieces = cut(id_and_text(docs).mapInArrow(_cut_pieces(tokenizer, end, size), PIECES), "pieces").df
    per_task = cut(pieces.groupBy("length", "part").agg(F.count(F.lit(1)).alias("n")), "lengths").df
    histogram = {r.length: r.n for r in per_task.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    sent = spark.sparkContext.broadcast(Places(shortest_pack_first(histogram, size)))
    earlier = Window.partitionBy("length").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    before = per_task.select("length", "part", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before"))
    ranked = pieces.join(before, ["length", "part"]).select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("before") + F.col("number")).alias("rank"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length = batch.column(2).to_numpy()
            sequence, offset, total = sent.value.look_up(length, batch.column(5).to_numpy())
            padded = np.where(total & (total - 1) == 0, total, size)
            columns = [batch.column(0), batch.column(1), pa.array(length.astype(np.int64)), batch.column(3), batch.column(4),
                       *map(pa.array, (sequence, offset, total, padded))]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in PLACED.split(", ")])

    return ranked.mapInArrow(task, PLACED)
