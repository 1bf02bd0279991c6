"""Benchmark decontamination: BM25 search of test items with every passage of every text.

Index.  Items are cut into segments of at most ``SEGMENT`` words.  Spark counts terms, document
frequencies and lengths and writes one impact per term and segment: its BM25 weight as a share
of what the segment itself would score, so one threshold serves all.  An index is held as
postings sorted by segment, with the highest impact of each term, and of each term within
each block of ``BLOCK`` segments.  A large set of items makes several indexes of at most about
``POSTINGS`` postings; each is sent to the tasks and all texts are searched with it.

Search, block-max WAND over a batch of passages at a time:
1. a passage whose terms' highest impacts do not add up to the threshold is done;
2. its weakest terms that together stay below the threshold lead to no candidates: only
   the postings of the others, by block, are opened;
3. a block whose own highest impacts stay below the threshold is skipped;
4. the segments of what is left are scored in full.  Nothing above the threshold is missed.

Verification.  A segment's item is compared with the passage and its surroundings: a share of
the three-word sequences of its question (all but the last sentence) and of its answer (the
last one, if it is long enough, or else the last third of the words) must both be there.

Words are ``[^\\x20\\x09-\\x0D]+`` without punctuation at their ends, A-Z in lower case.  Items without
words, and null or empty texts, match nothing.  Repeated rows are reported each; items with equal
texts are reported each.  Empty tables of either kind give an empty result.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import cut
from symbolweave.llm.text import blank_separated, chunks, hash_words, id_and_text, join_hashes

PASSAGE, STRIDE, SEGMENT = 96, 48, 48
THRESHOLD, OVERLAP = 0.5, 0.5
GRAM, LEAST_WORDS = 3, 5
K1, B = 1.2, 0.75
BLOCK = 8
POSTINGS = 1_000_000
# Bytes of text searched together: each word of a passage leads to several rows of arrays.
TOGETHER = 1 << 20
# Entries of a full table of terms and blocks, or segments, that is kept beside the postings.
TABLE = 4_000_000
EDGES = "!?.,;:\"'()[]{}#*$%&|<>-_"


def coded_terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of different words, every text's words as numbers of these, and where each text begins."""
    words, starts = blank_separated(column)
    coded = words.dictionary_encode()
    bare = pc.ascii_trim(coded.dictionary, EDGES)
    hashed = hash_words(bare)
    empty = pc.equal(bare, "").to_numpy(zero_copy_only=False)
    codes = np.asarray(coded.indices)
    if not empty.any():
        return hashed, codes, starts
    full = ~empty[codes]
    return hashed, codes[full], np.concatenate([[0], np.cumsum(full)])[starts]


def terms(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of every text's words in order, and where each text begins."""
    hashed, codes, starts = coded_terms(column)
    return hashed[codes] if len(codes) else np.zeros(0, np.uint64), starts


def _grams(words: np.ndarray, size: int = GRAM) -> np.ndarray:
    """Distinct hashes of sequences of ``size`` words."""
    out = words[: max(len(words) - size + 1, 0)]
    for k in range(1, size):
        out = join_hashes(out, words[k : len(words) - size + 1 + k]) if len(out) else out
    return np.unique(out)


def question_and_answer(text: str) -> tuple[str, str]:
    """All but the last sentence, and the last one; if one is too short to tell, the last third.

    Of an item too short for that, both are the whole.
    """
    parts = re.split(r"(?<=[.?!])\s+|\n+", text.strip())
    halves = [" ".join(parts[:-1]), parts[-1]]
    if min(len(h.split()) for h in halves) < LEAST_WORDS:
        words = text.split()
        at = len(words) - len(words) // 3
        halves = [" ".join(words[:at]), " ".join(words[at:])]
    return tuple(halves) if min(len(h.split()) for h in halves) >= GRAM else (text, text)


ITEMS = "item long, item_id long, segment int, size int, question array<long>, answer array<long>, n_words int, term long, tf int"


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for row, item_id, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
            words = terms(pa.array([text], pa.large_string()))[0]
            gram = max(1, min(GRAM, len(words)))
            halves = [_grams(terms(pa.array([p], pa.large_string()))[0], gram).view(np.int64).tolist()
                      for p in question_and_answer(text)]
            count = max(1, -(-len(words) // SEGMENT))
            for k, part in enumerate(np.array_split(words, count)):
                for term, tf in zip(*np.unique(part, return_counts=True), strict=True):
                    out.append((row, item_id, k, len(part), *halves, len(words), int(np.int64(term.view(np.int64))), int(tf)))
        kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.int32(), pa.int64(), pa.int32()]
        columns = zip(*out, strict=True) if out else [[] for _ in kinds]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                         names=[c.split()[0] for c in ITEMS.split(", ")])


@dataclass
class Index:
    """Postings of segments, and what is known of their items."""

    terms: np.ndarray  # sorted
    best: np.ndarray  # highest impact of each term
    post_keys: np.ndarray  # term's number times segments plus segment, sorted
    post_impacts: np.ndarray
    block_keys: np.ndarray  # term's number times blocks plus block, sorted
    block_impacts: np.ndarray
    block_starts: np.ndarray  # of each term in ``block_keys``
    segments: int
    item_of: np.ndarray  # of each segment
    items: list[tuple[int, np.ndarray, np.ndarray, int]]  # item_id, question, answer, words
    # the same as full tables, if these are small
    block_table: np.ndarray | None = None
    post_table: np.ndarray | None = None

    def tabled(self) -> Index:
        for name, keys, values, width in (("block_table", self.block_keys, self.block_impacts, self.blocks),
                                          ("post_table", self.post_keys, self.post_impacts, self.segments)):
            if len(self.terms) * width <= TABLE:
                table = np.zeros(len(self.terms) * width)
                table[keys] = values
                setattr(self, name, table)
        return self

    @property
    def blocks(self) -> int:
        return -(-self.segments // BLOCK)


def _index(rows: list) -> Index:
    """Out of (item, item_id, segment, question, answer, n_words, term, impact)."""
    segment_of, item_of, items, number = {}, [], [], {}
    for r in rows:
        if r.item not in number:
            number[r.item] = len(items)
            items.append((r.item_id, *(np.array(x, np.int64).view(np.uint64) for x in (r.question, r.answer)), r.n_words))
        if (r.item, r.segment) not in segment_of:
            segment_of[r.item, r.segment] = len(item_of)
            item_of.append(number[r.item])
    hashed = np.array([r.term for r in rows], np.int64).view(np.uint64)
    segment = np.array([segment_of[r.item, r.segment] for r in rows], np.int64)
    impact = np.array([r.impact for r in rows])
    known, term = np.unique(hashed, return_inverse=True)
    count, blocks = len(item_of), -(-len(item_of) // BLOCK)
    order = np.argsort(term * count + segment)
    keys = (term * count + segment)[order]
    by_block = term[order] * blocks + segment[order] // BLOCK
    heads = np.flatnonzero(np.append(True, by_block[1:] != by_block[:-1]))
    starts = np.searchsorted(by_block[heads] // blocks, np.arange(len(known) + 1))
    high = np.maximum.reduceat(impact[order], heads)
    return Index(known, np.maximum.reduceat(high, starts[:-1]), keys, impact[order], by_block[heads], high, starts,
                 count, np.array(item_of), items).tabled()


def build_indexes(items: DataFrame, postings: int = POSTINGS) -> Iterator[Index]:
    """Indexes of ``items`` (``item_id``, ``text``), one at a time; each is bounded, whatever the table's size."""
    rows = items.select(F.col("item_id").cast("long").alias("item_id"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = cut(rows.withColumn("item", F.monotonically_increasing_id()), "items").df
    posts = cut(rows.select("item", "item_id", "text").mapInArrow(_segments, ITEMS), "postings")
    if not posts.rows:
        return
    lengths = posts.df.select("item", "segment", "size").distinct()
    whole = lengths.agg(F.count(F.lit(1)).alias("n"), F.avg("size").alias("mean")).first()
    frequency = posts.df.groupBy("term").agg(F.count(F.lit(1)).alias("df"))
    idf = F.log(1 + (whole.n - F.col("df") + 0.5) / (F.col("df") + 0.5))
    damped = F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("size") / whole.mean))
    weighed = posts.df.join(frequency, "term").withColumn("weight", idf * damped)
    own = weighed.groupBy("item", "segment").agg(F.sum("weight").alias("own"))
    impacts = cut(weighed.join(own, ["item", "segment"]).select(
        "item", "item_id", "segment", "question", "answer", "n_words", "term", (F.col("weight") / F.col("own")).alias("impact")),
        "impacts").df
    parts = math.ceil(posts.rows / postings)
    for part in range(parts):
        found = impacts.filter(F.pmod(F.xxhash64("item"), F.lit(parts)) == part).collect()
        if found:
            yield _index(sorted(found, key=lambda r: (r.item, r.segment, r.term)))


def _expand(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of slices, each repeated for its members, and the members' places."""
    owner = np.repeat(np.arange(len(starts)), sizes)
    return owner, np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + starts[owner]


def _at(table: np.ndarray | None, keys: np.ndarray, values: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """The values behind keys, zero where there is none."""
    if table is not None:
        return table[wanted]
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], 0.0)


def search(index: Index, passage: np.ndarray, term: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Passages, segments and scores at or above the threshold.

    ``passage`` and ``term`` are distinct pairs of a passage's and a term's number, sorted.
    """
    none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
    slack = threshold - 1e-9
    if not len(term):
        return none
    bound = np.bincount(passage, index.best[term])
    keep = bound[passage] >= slack
    passage, term = passage[keep], term[keep]
    if not len(term):
        return none
    order = np.lexsort((index.best[term], passage))
    passage, term = passage[order], term[order]
    heads = np.flatnonzero(np.append(True, passage[1:] != passage[:-1]))
    sizes = np.diff(np.append(heads, len(passage)))
    number = np.repeat(np.arange(len(heads)), sizes)
    sums = np.cumsum(index.best[term])
    sums -= np.repeat(sums[heads] - index.best[term[heads]], sizes)
    essential = np.flatnonzero(sums >= slack)
    owner, place = _expand(index.block_starts[term[essential]],
                           index.block_starts[term[essential] + 1] - index.block_starts[term[essential]])
    pairs = np.unique(number[essential][owner] * index.blocks + index.block_keys[place] % index.blocks)
    which, block = pairs // index.blocks, pairs % index.blocks
    owner, place = _expand(heads[which], sizes[which])
    high = np.bincount(owner, _at(index.block_table, index.block_keys, index.block_impacts, term[place] * index.blocks + block[owner]), len(pairs))
    which, block = which[high >= slack], block[high >= slack]
    if not len(which):
        return none
    segment = (block[:, None] * BLOCK + np.arange(BLOCK)).ravel()
    which = np.repeat(which, BLOCK)
    inside = segment < index.segments
    which, segment = which[inside], segment[inside]
    owner, place = _expand(heads[which], sizes[which])
    score = np.bincount(owner, _at(index.post_table, index.post_keys, index.post_impacts, term[place] * index.segments + segment[owner]), len(which))
    hit = score >= slack
    return passage[heads[which[hit]]], segment[hit], score[hit]


FOUND = "doc_id long, item_id long, n_passages int, score double, question_overlap double, answer_overlap double"


def _found(index: Index, ids: list, column: pa.Array, threshold: float, overlap: float) -> list[tuple]:
    hashed, codes, starts = coded_terms(column)
    if not len(codes):
        return []
    near = np.minimum(np.searchsorted(index.terms, hashed), len(index.terms) - 1)
    at = np.where(index.terms[near] == hashed, near, -1)[codes]
    known = np.flatnonzero(at >= 0)
    counts = np.diff(starts)
    passages = np.maximum(1, -(-(counts - (PASSAGE - STRIDE)) // STRIDE))  # windows of each text
    base = np.concatenate([[0], np.cumsum(passages)])
    row = np.searchsorted(starts, known, "right") - 1
    within = (known - starts[row]) // STRIDE
    # a word is in the window that begins in its stride, and in the one before
    both = np.concatenate([base[row] + np.minimum(within, passages[row] - 1), (base[row] + within - 1)[within > 0]])
    term = np.concatenate([at[known], at[known][within > 0]])
    # a window may be listed twice for a word at a text's end
    keys = np.sort(both * len(index.terms) + term)
    keys = keys[np.append(True, keys[1:] != keys[:-1])] if len(keys) else keys
    passage, segment, score = search(index, keys // len(index.terms), keys % len(index.terms), threshold)
    hits: dict[tuple[int, int], list] = {}
    rows = np.searchsorted(base, passage, "right") - 1
    for r, p, s, value in zip(rows.tolist(), passage.tolist(), segment.tolist(), score.tolist(), strict=True):
        hits.setdefault((r, int(index.item_of[s])), []).append((p - int(base[r]), value))
    out = []
    for (r, item), found in sorted(hits.items()):
        item_id, question, answer, size = index.items[item]
        text = hashed[codes[starts[r] : starts[r + 1]]]
        near = np.unique(np.concatenate([
            _grams(text[max(0, p * STRIDE - size) : p * STRIDE + PASSAGE + size], min(GRAM, size)) for p in sorted({p for p, _ in found})]))
        shares = [len(np.intersect1d(near, part, assume_unique=True)) / len(part) if len(part) else 1.0
                  for part in (question, answer)]
        if min(shares) >= overlap:
            out.append((ids[r], item_id, len({p for p, _ in found}), max(v for _, v in found), *shares))
    return out


def contaminated(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
                 postings: int = POSTINGS) -> DataFrame:
    """A row for each text and item it holds, with the passages found, the best score and both overlaps."""
    texts, result = id_and_text(docs), None
    kinds = [pa.int64(), pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64()]
    names = [c.split()[0] for c in FOUND.split(", ")]
    for index in build_indexes(items, postings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches, TOGETHER):
                rows = _found(sent.value, chunk.column(0).to_pylist(), chunk.column(1), threshold, overlap)
                columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)

        part = texts.mapInArrow(task, FOUND)
        result = part if result is None else result.unionByName(part)
    return docs.sparkSession.createDataFrame([], FOUND) if result is None else result


def keep(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, overlap: float = OVERLAP,
         postings: int = POSTINGS) -> DataFrame:
    """The rows of ``docs`` that hold no item; each is judged where it is read, so nothing is shuffled."""
    at = docs.columns.index("text")
    for index in build_indexes(items, postings):
        sent = docs.sparkSession.sparkContext.broadcast(index)

        def task(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            for chunk in chunks(batches, TOGETHER):
                rows = list(range(chunk.num_rows))
                found = _found(sent.value, rows, chunk.column(at), threshold, overlap)
                clean = np.ones(len(rows), bool)
                clean[[row for row, *_ in found]] = False
                yield chunk.filter(pa.array(clean))

        docs = docs.mapInArrow(task, docs.schema)
    return docs
