"""An interpolated modified Kneser-Ney model of word pairs, counted in Spark and mapped by workers.

Counting.  Each task counts pairs of hashed words in batches of bounded size and sends the
distinct ones of a batch, with their counts, to shards by the hash of the pair - not of its
first word, so that a word that a third of all rows share is spread over all shards.  A
shard adds the counts up, writes its pairs as sorted hash arrays to the shared folder, and
passes on what it knows of each word: its count, the different words before it, and how
many different words follow it once, twice and more often.  These are added up by shards of words,
which are written as sorted hash arrays too.  Counts of counts, which give the discounts, and
totals are sums in Spark; nothing else reaches the driver.

Scoring.  Workers map the arrays into memory and look up the distinct pairs and words of a
chunk of texts in sorted order, so a page is touched once per chunk, is shared by all workers
of a machine, and takes no memory of its own.  Where the shared folder is not a mounted one, a
worker copies a shard to a file it has already unlinked, and maps that.

With c(v, w) the count of a pair, c(v) that of all pairs with v in front, N(v, .) and N(., w) the
numbers of different words behind v and before w, and V the number of different words,

    p(w | v) = (c(v, w) - D) / c(v) + (D1 N1(v) + D2 N2(v) + D3 N3(v)) / c(v) * p(w)
    p(w) = (N(., w) - D') / N + g' / N / (V + 1)

where D is the discount for the count at hand.  A word that was not learned has N(., w) = 0, and
behind a word that was not learned p(w | v) = p(w).  The order is two: trigrams of this size of
corpus would not fit the disk that the check allows (see the README).

Words are ``[^\\x20\\x09-\\x0D]+``, A-Z in lower case, and an end behind the last one; a null or empty
text is the end alone.  Repeated rows count as often as they stand.  If nothing is learned, every
word has the probability 1 (V = 0); an empty table gives an empty result.
"""

from __future__ import annotations

import pickle
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import cut, shared_folder
from symbolweave.llm.text import blank_separated, chunks, hash_words, id_and_text, join_hashes, partitions

BEGIN, END = (np.uint64(xxhash.xxh3_64_intdigest(x)) for x in ("\n<begin>", "\n<end>"))  # no word has a line feed
# Tokens a task counts together before it sends their distinct pairs on.
BATCH_TOKENS = 3_000_000
SHARDS_PER_SPLIT, LEAST_SHARDS = 2, 16
SENT = "shard int, data binary"
TOTALS = "n1 long, n2 long, n3 long, n4 long, total long, words long, tokens long"


def tokens(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each text's words and its end, the word before each (or the beginning), and where texts begin."""
    words, starts = blank_separated(column)
    hashed = hash_words(words)
    counts = np.diff(starts)
    ends = np.cumsum(counts + 1)
    after = np.empty(len(hashed) + len(counts), np.uint64)
    own = np.ones(len(after), bool)
    own[ends - 1] = False
    after[own], after[ends - 1] = hashed, END
    before = np.empty_like(after)
    before[1:] = after[:-1]
    begins = np.concatenate([[0], ends])
    before[begins[:-1]] = BEGIN
    return after, before, begins


def _send(columns: list[np.ndarray], shards: int, by: np.ndarray, packer) -> pa.RecordBatch:
    """Rows of a shard each, out of arrays sorted by ``by``, of which the highest bits name the shard."""
    shard = _shard_of(by, shards)
    edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(shard) else np.zeros(0, int)
    rows = [
        (int(shard[lo]), packer.compress(pickle.dumps([c[lo:hi] for c in columns], protocol=5)))
        for lo, hi in zip(edges, [*edges[1:], len(shard)], strict=True)
    ]
    names, data = zip(*rows, strict=True) if rows else ([], [])
    return pa.RecordBatch.from_arrays([pa.array(names, pa.int32()), pa.array(data, pa.binary())], names=["shard", "data"])


def _shard_of(hashes: np.ndarray, shards: int) -> np.ndarray:
    """Shards are ranges of hashes, in order."""
    return ((hashes >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int32)


def _small(counts: np.ndarray) -> np.ndarray:
    return counts.astype(np.min_scalar_type(int(counts.max()) if len(counts) else 0))


def _count_pairs(shards: int):
    def sent(held, packer) -> pa.RecordBatch:
        after, before = (np.concatenate([h[k] for h in held]) for k in (0, 1))
        key = join_hashes(before, after)
        order = np.argsort(key)
        key = key[order]
        new = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
        first = order[new]
        counts = np.diff(np.append(new, len(key)))
        return _send([before[first], after[first], _small(counts)], shards, key[new], packer)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, held, size = zstandard.ZstdCompressor(level=1), [], 0
        for chunk in chunks(batches):
            after, before, _ = tokens(chunk.column(1))
            held.append((after, before))
            size += len(after)
            if size >= BATCH_TOKENS:
                yield sent(held, packer)
                held, size = [], 0
        if held:
            yield sent(held, packer)

    return task


def _filesystem(folder: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (pafs.LocalFileSystem(), folder)


def _publish(folder: str, name: str, arrays: list[np.ndarray]) -> None:
    """Arrays of one length as a file: the length, then one array behind the other.

    Each attempt of a task writes a file of its own and renames it, so a repeated task does no harm.
    """
    system, path = _filesystem(folder)
    attempt = f"{path}/_{name}-{uuid.uuid4().hex}"
    system.create_dir(path, recursive=True)
    with system.open_output_stream(attempt, compression=None) as out:
        out.write(np.array([len(arrays[0])], np.int64).tobytes())
        for array in arrays:
            out.write(np.ascontiguousarray(array).tobytes())
    system.move(attempt, f"{path}/{name}")


def _loaded(table: pa.Table) -> list[list[np.ndarray]]:
    reader = zstandard.ZstdDecompressor()
    return [pickle.loads(reader.decompress(d.as_py())) for d in table.column("data")]


def _sums(keys: np.ndarray, counts: list[np.ndarray]) -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """Distinct keys in order, the sums of their counts, and where each key was first."""
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    heads = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
    return keys[heads], [np.add.reduceat(c[order].astype(np.int64), heads) for c in counts], order[heads]


def _totals(counts: np.ndarray, words: int, tokens: int) -> dict:
    return {**{f"n{k}": int((counts == k).sum()) for k in (1, 2, 3, 4)}, "total": int(counts.sum()),
            "words": words, "tokens": tokens}


TOTALS_SCHEMA = pa.schema([(c.split()[0], pa.int64()) for c in TOTALS.split(", ")])


def _add_pairs(folder: str, shards: int):
    """A shard of pairs: written to the model; what it knows of words is passed on, its totals first."""

    def task(table: pa.Table) -> pa.Table:
        parts = _loaded(table)
        before, after, counts = (np.concatenate([p[k] for p in parts]) for k in range(3))
        del parts
        key, (counts,), first = _sums(join_hashes(before, after), [counts])
        before, after = before[first], after[first]
        shard = int(table.column("shard")[0].as_py())
        _publish(folder, f"pairs-{shard}", [key, counts.astype(np.uint32)])
        # for each word: count, words before it, and, in front, its count and followers by their counts
        size = len(key)
        ones, none = np.ones(size, np.int64), np.zeros(size, np.int64)
        columns = [np.concatenate(c) for c in (
            (counts, none), (ones, none), (none, counts), (none, counts == 1), (none, counts == 2), (none, counts > 2))]
        words, columns, _ = _sums(np.concatenate([after, before]), columns)
        sent = _send([words, *map(_small, columns)], shards, words, zstandard.ZstdCompressor(level=1))
        totals = pa.RecordBatch.from_arrays(
            [pa.array([-1], pa.int32()), pa.array([pickle.dumps(_totals(counts, 0, 0))], pa.binary())], names=["shard", "data"])
        return pa.Table.from_batches([totals, sent])

    return task


def _add_words(folder: str):
    def task(table: pa.Table) -> pa.Table:
        parts = _loaded(table)
        words, columns, _ = _sums(*(lambda c: (c[0], c[1:]))([np.concatenate([p[k] for p in parts]) for k in range(7)]))
        _publish(folder, f"words-{table.column('shard')[0].as_py()}", [words, *columns])
        count, spread = columns[0], columns[1]
        return pa.Table.from_pylist([_totals(spread, int((count > 0).sum()), int(count.sum()))], TOTALS_SCHEMA)

    return task


def _shown_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        yield pa.RecordBatch.from_pylist([pickle.loads(d.as_py()) for d in batch.column(0)], TOTALS_SCHEMA)


# A discount of small corpora may come out as nothing or less, which would leave unseen words no chance at all.
LEAST_DISCOUNT = 1e-3


def _discounts(n1: int, n2: int, n3: int, n4: int) -> np.ndarray:
    """For counts of one, two and more, ``LEAST_DISCOUNT`` at least; 0 for none.

    Where counts of counts are missing, half a count.
    """
    if not (n1 and n2 and n3):
        return np.array([0, 0.5, 0.5, 0.5])
    y = n1 / (n1 + 2 * n2)
    found = [1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3]
    return np.array([0, *np.clip(found, LEAST_DISCOUNT, [1, 2, 3])])


@dataclass(frozen=True)
class Model:
    """Where a model's arrays are, and its totals."""

    folder: str
    shards: int
    pair_discounts: tuple[float, ...]
    word_discounts: tuple[float, ...]
    spread: int  # different pairs
    few: tuple[int, int, int]  # words with one, two and more different words before them
    words: int
    tokens: int


def train(docs: DataFrame, shards: int | None = None) -> Model:
    """A model of the texts of ``docs`` in the session's shared folder."""
    spark = docs.sparkSession
    shards = shards or max(LEAST_SHARDS, SHARDS_PER_SPLIT * partitions(docs))
    folder = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/lm-{uuid.uuid4().hex}"
    pairs = id_and_text(docs).mapInArrow(_count_pairs(shards), SENT)
    known = cut(pairs.groupBy("shard").applyInArrow(_add_pairs(folder, shards), SENT), "words").df
    pair_totals = known.filter("shard < 0").select("data").mapInArrow(_shown_totals, TOTALS)
    word_totals = known.filter("shard >= 0").groupBy("shard").applyInArrow(_add_words(folder), TOTALS)
    names = [c.split()[0] for c in TOTALS.split(", ")]

    def total(df: DataFrame) -> dict:
        row = df.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names]).first()
        return row.asDict()

    p, w = total(pair_totals), total(cut(word_totals, "totals").df)
    return Model(
        folder, shards, tuple(_discounts(p["n1"], p["n2"], p["n3"], p["n4"])),
        tuple(_discounts(w["n1"], w["n2"], w["n3"], w["n4"])), w["total"],
        (w["n1"], w["n2"], w["words"] - w["n1"] - w["n2"]), w["words"], w["tokens"])


WORD_COLUMNS = [np.uint64] + [np.int64] * 6
PAIR_COLUMNS = [np.uint64, np.uint32]


@lru_cache(maxsize=None)
def _mapped(folder: str, name: str, kinds: tuple) -> list[np.ndarray] | None:
    """A shard's arrays, mapped; None if no text reached that shard."""
    system, path = _filesystem(folder)
    if system.get_file_info(f"{path}/{name}").type == pafs.FileType.NotFound:
        return None
    if isinstance(system, pafs.LocalFileSystem):
        raw = np.memmap(f"{path}/{name}", np.uint8, "r")
    else:
        with tempfile.TemporaryFile() as local, system.open_input_stream(f"{path}/{name}") as data:
            while block := data.read(1 << 20):
                local.write(block)
            local.flush()
            raw = np.memmap(local, np.uint8, "r")
    size, at, out = int(raw[:8].view(np.int64)[0]), 8, []
    for kind in kinds:
        width = np.dtype(kind).itemsize * size
        out.append(raw[at : at + width].view(kind))
        at += width
    return out


def _look_up(model: Model, table: str, kinds: list, keys: np.ndarray) -> list[np.ndarray]:
    """The columns behind sorted distinct keys; zero for those the model lacks."""
    found = [np.zeros(len(keys), k) for k in kinds[1:]]
    shard = _shard_of(keys, model.shards)
    edges = np.flatnonzero(np.append(True, shard[1:] != shard[:-1])) if len(keys) else []
    for lo, hi in zip(edges, [*edges[1:], len(keys)], strict=True):
        arrays = _mapped(model.folder, f"{table}-{shard[lo]}", tuple(kinds))
        if arrays is None or not len(arrays[0]):
            continue
        at = np.minimum(np.searchsorted(arrays[0], keys[lo:hi]), len(arrays[0]) - 1)
        hit = np.flatnonzero(arrays[0][at] == keys[lo:hi])
        for column, values in zip(found, arrays[1:], strict=True):
            column[lo + hit] = values[at[hit]]
    return found


def _scores(model: Model, column: pa.Array) -> list[np.ndarray]:
    after, before, begins = tokens(column)
    words, place = np.unique(np.concatenate([after, before]), return_inverse=True)
    count, spread, front, f1, f2, f3 = _look_up(model, "words", WORD_COLUMNS, words)
    pairs, pair_place = np.unique(join_hashes(before, after), return_inverse=True)
    (together,) = _look_up(model, "pairs", PAIR_COLUMNS, pairs)

    d, e = np.array(model.pair_discounts), np.array(model.word_discounts)
    total = max(model.spread, 1)
    rest = float(np.dot(e[1:], model.few)) / total if model.spread else 1.0
    alone = (spread - e[np.minimum(spread, 3)]) / total + rest / (model.words + 1)
    base = np.log10((count + 0.5) / (model.tokens + 0.5 * (model.words + 1)))
    w, v = place[: len(after)], place[len(after) :]
    c = together[pair_place].astype(np.int64)
    seen = np.maximum(front[v], 1)
    back = np.where(front[v] > 0, (d[1] * f1[v] + d[2] * f2[v] + d[3] * f3[v]) / seen, 1.0)
    chance = (c - d[np.minimum(c, 3)]) / seen + back * alone[w]
    heads = begins[:-1]
    return [np.diff(begins), np.add.reduceat((count[w] > 0).astype(np.int64), heads),
            np.add.reduceat(base[w], heads), np.add.reduceat(np.log10(chance), heads)]


SCORED = "doc_id long, n_tokens long, n_known long, base_score double, score double"


def score(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id``, ``n_tokens``, ``n_known``, ``base_score`` (single words) and ``score`` (the model's log10 probability)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            columns = [pa.array(c) for c in _scores(model, chunk.column(1))]
            yield pa.RecordBatch.from_arrays([chunk.column(0), *columns], names=[c.split()[0] for c in SCORED.split(", ")])

    return id_and_text(docs).mapInArrow(task, SCORED)


def with_perplexity(scored: DataFrame) -> DataFrame:
    return scored.withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
