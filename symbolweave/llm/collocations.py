"""Phrases whose words occur together, by set-oriented mining (SETM) over persisted occurrence relations.

Each task turns its texts into blocks: relations of (place, word), in order of place.  A gap between
pieces is a place without a word, so equal neighbours in a block are what a merge join on piece and adjacent
position gives; a piece never leaves its block, so that join moves nothing.  Then, for lengths 1, 2, ...:

1. Group-count.  A block's different phrases are counted where they are, then added up over blocks.  From two words
   on, blocks first send short hashes with small counts; a bucket of hashes tells each block, bit by bit, which of
   them can reach ``least``.  A shared hash can only let too much through.
2. Semi-join.  The relation keeps places of phrases that passed.
3. Extension.  Places whose phrase and whose next place's phrase both stayed hold the candidates of the next length.

What passed is counted exactly, by its words' ids (an id is the first block and code of a word, so no two words share
one).  Every relation is a table in the shared folder.  A phrase that is everywhere has one row for each block.

Null texts are empty, a null ``lang`` is ``und``; languages are counted apart.  An empty table gives no phrase.
Long texts and long words are taken whole: a block is closed behind the text that fills it.
Counts must stay under 10^16, so that a million times their square fits a decimal of 38 digits.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.lineage import cut
from symbolweave.llm.text import chunks, join_hashes, mix, release, text_bytes

LEAST, LONGEST, SHARE, TOP = 10, 3, 50, 2000
BLOCK_WORDS = 1 << 20  # occurrences in a block, and those of one more chunk of texts at most
BLOCKS_A_TASK = 1 << 10
BUCKET_HASHES = 1 << 21  # phrases of blocks in a bucket, about
SALTS = 64

FOUND = "block long, code int, lang string, word string, n long, relation binary"
STEP = "block long, bucket int, hashes binary, counts binary, lang string, ids array<long>, n long, relation binary"

# What separates words, and what ends a piece too.
BLANKS, STOPS = b"\x20\x09", b".,;:!?\x0a\x0b\x0c\x0d"
_KIND = np.zeros(256, np.uint8)
_KIND[list(BLANKS)] = 1
_KIND[list(STOPS)] = 2


def words_in_pieces(column: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of a string column in lower case, and which of them begin a piece."""
    data, offsets = text_bytes(pc.ascii_lower(column))
    kind = _KIND[data]
    inside = kind == 0
    texts = offsets[:-1][np.diff(offsets) > 0]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    begins[texts] = inside[texts]
    starts = np.flatnonzero(begins)
    body = data[inside]
    lengths = np.add.reduceat(inside, starts, dtype=np.int64) if len(starts) else np.zeros(0, np.int64)
    stops = kind == 2
    stops[texts] |= True
    passed = np.cumsum(stops)[starts]
    fresh = np.ones(len(starts), bool)
    fresh[1:] = passed[1:] != passed[:-1]
    ends = np.concatenate([[0], np.cumsum(lengths)])
    words = pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(body)])
    return words, fresh


def _pack(**arrays) -> bytes:
    return zstandard.compress(pickle.dumps(arrays, protocol=5), 1)


def _unpack(packed: bytes) -> dict:
    return pickle.loads(zstandard.decompress(packed))


class _Block:
    """The relation of some texts' words: codes in order, -1 before each piece."""

    def __init__(self) -> None:
        self.codes: dict[tuple[str, str], int] = {}
        self.places: list[np.ndarray] = []
        self.counts = np.zeros(0, np.int64)
        self.size = 0

    def add(self, lang: str, column: pa.Array) -> None:
        words, fresh = words_in_pieces(column)
        if not len(words):
            return
        coded = words.dictionary_encode()
        known = self.codes
        own = np.fromiter((known.setdefault((lang, w), len(known)) for w in coded.dictionary.to_pylist()), np.int32, len(coded.dictionary))
        places = own[np.asarray(coded.indices)]
        more = np.bincount(places, minlength=len(known))
        more[: len(self.counts)] += self.counts
        self.counts = more
        out = np.full(len(places) + int(fresh.sum()), -1, np.int32)
        out[np.arange(len(places)) + np.cumsum(fresh)] = places
        self.places.append(out)
        self.size += len(places)

    def rows(self, block: int) -> Iterator[pa.RecordBatch]:
        langs, words = zip(*self.codes, strict=True)
        names = [c.split()[0] for c in FOUND.split(", ")]
        relation = _pack(places=np.concatenate(self.places))
        for at in range(0, len(words), 1 << 16):
            n = min(1 << 16, len(words) - at)
            yield pa.RecordBatch.from_arrays([
                pa.array(np.full(n, block)), pa.array(np.arange(at, at + n, dtype=np.int32)),
                pa.array(langs[at : at + n], pa.string()), pa.array(words[at : at + n], pa.string()),
                pa.array(self.counts[at : at + n]), pa.nulls(n, pa.binary())], names=names)
        yield pa.RecordBatch.from_arrays([
            pa.array([block], pa.int64()), pa.nulls(1, pa.int32()), pa.nulls(1, pa.string()), pa.nulls(1, pa.string()),
            pa.nulls(1, pa.int64()), pa.array([relation], pa.binary())], names=names)


def _occurrences(block_words: int):
    """The blocks of a task's (lang, text) rows: their different words with counts, and their relations."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, block = TaskContext.get().partitionId() * BLOCKS_A_TASK, _Block()
        for chunk in chunks(batches):
            langs = chunk.column(0).dictionary_encode()
            for code, lang in enumerate(langs.dictionary.to_pylist()):
                block.add(lang, chunk.column(1).filter(pc.equal(langs.indices, code)))
            if block.size >= block_words:
                yield from block.rows(number)
                number, block = number + 1, _Block()
        if block.codes:
            yield from block.rows(number)
        del block
        release()

    return task


def _steps(**columns) -> pa.RecordBatch:
    """Rows of ``STEP``; a column that is not given is null."""
    kinds = {"block": pa.int64(), "bucket": pa.int32(), "hashes": pa.binary(), "counts": pa.binary(), "lang": pa.string(),
             "ids": pa.list_(pa.int64()), "n": pa.int64(), "relation": pa.binary()}
    rows = len(next(iter(columns.values())))
    return pa.RecordBatch.from_arrays(
        [columns[c] if isinstance(columns.get(c), pa.Array) else pa.array(columns[c], k) if c in columns else pa.nulls(rows, k)
         for c, k in kinds.items()], names=list(kinds))


class _Phrases:
    """The different phrases of one length in a block: places, words' ids, languages, counts and hashes."""

    def __init__(self, places: np.ndarray, ids: np.ndarray, langs: list[str], lang: np.ndarray) -> None:
        self.places, self.ids, self.langs, self.lang = places, ids, langs, lang

    def longer(self) -> "_Phrases":
        """Phrases of one word more: each place's phrase joined with the one that begins a word behind it."""
        at = np.flatnonzero((self.places[:-1] >= 0) & (self.places[1:] >= 0))
        pairs = self.places[at].astype(np.int64) * len(self.ids) + self.places[at + 1]
        found, codes = np.unique(pairs, return_inverse=True)
        first, second = found // max(1, len(self.ids)), found % max(1, len(self.ids))
        places = np.full(len(self.places), -1, np.int32)
        places[at] = codes
        return _Phrases(places, np.concatenate([self.ids[first], self.ids[second][:, -1:]], axis=1), self.langs, self.lang[first])

    def counts(self) -> np.ndarray:
        return np.bincount(self.places[self.places >= 0], minlength=len(self.ids))

    def hashes(self) -> np.ndarray:
        value = mix(self.ids[:, 0].astype(np.uint64))
        for k in range(1, self.ids.shape[1]):
            value = join_hashes(value, self.ids[:, k].astype(np.uint64))
        return value

    def by_bucket(self, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The order of phrases by bucket and hash, where each bucket begins there, and the hashes in it."""
        hashes = self.hashes()
        bucket = (hashes >> np.uint64(32)) % np.uint64(buckets)
        order = np.lexsort((hashes & np.uint64(0xFFFFFFFF), bucket))
        return order, np.searchsorted(bucket[order], np.arange(buckets + 1, dtype=np.uint64)), hashes[order].astype(np.uint32)

    def sent(self, block: int, buckets: int) -> pa.RecordBatch:
        """A row for each bucket: the block's hashes there, in order, and their counts up to 255."""
        order, starts, hashes = self.by_bucket(buckets)
        counts = np.minimum(self.counts()[order], 255).astype(np.uint8)
        used = np.flatnonzero(np.diff(starts)).tolist()
        return _steps(
            block=[block] * len(used), bucket=used,
            hashes=[hashes[starts[b] : starts[b + 1]].tobytes() for b in used],
            counts=[zstandard.compress(counts[starts[b] : starts[b + 1]].tobytes(), 1) for b in used])

    def kept(self, passed: np.ndarray) -> "_Phrases":
        """The phrases that passed; runs of empty places shrink to one."""
        new = np.where(passed, np.cumsum(passed) - 1, -1).astype(np.int32)
        places = np.where(self.places >= 0, new[self.places] if len(new) else -1, -1)
        stay = places >= 0
        stay[1:] |= stay[:-1]
        return _Phrases(places[stay].astype(np.int32), self.ids[passed], self.langs, self.lang[passed])

    def relation(self) -> bytes:
        return _pack(places=self.places, ids=self.ids, langs=self.langs, lang=self.lang)

    def exact(self, passed: np.ndarray) -> pa.RecordBatch:
        n, (rows, width) = self.counts()[passed], self.ids[passed].shape
        ids = pa.ListArray.from_arrays(pa.array(np.arange(rows + 1, dtype=np.int32) * width), pa.array(self.ids[passed].ravel()))
        langs = pa.DictionaryArray.from_arrays(pa.array(self.lang[passed].astype(np.int32)), pa.array(self.langs, pa.string()))
        return _steps(lang=langs.cast(pa.string()), ids=ids, n=n)


def _words_passed(buckets: int):
    """A block's relation of words, cut down to the frequent ones; hashes of its pairs."""

    def task(key: tuple, relation: pa.Table, kept: pa.Table) -> pa.Table:
        block, langs = key[0].as_py(), pc.unique(kept.column("lang"))
        code, ids = kept.column("code").to_numpy(), kept.column("id").to_numpy()
        places = _unpack(relation.column("relation")[0].as_py())["places"]
        of = np.full(int(max(places.max(), code.max(initial=0))) + 1, -1, np.int64)
        of[code] = np.arange(len(code))
        lang = pc.index_in(kept.column("lang"), langs).to_numpy().astype(np.int32)
        words = _Phrases(np.where(places >= 0, of[places], -1).astype(np.int32), ids.reshape(-1, 1), langs.to_pylist(), lang)
        words = words.kept(np.ones(len(ids), bool))
        out = [_steps(block=[block], relation=[words.relation()]), words.longer().sent(block, buckets)]
        release()
        return pa.Table.from_batches(out)

    return task


def _phrases_passed(buckets: int, last: bool):
    """The same for phrases of two words and more, which are joined anew; counts of those that passed."""

    def task(key: tuple, relation: pa.Table, bits: pa.Table) -> pa.Table:
        block, held = key[0].as_py(), _unpack(relation.column("relation")[0].as_py())
        found = _Phrases(**held).longer()
        order, starts, _ = found.by_bucket(buckets)
        passed = np.zeros(len(order), bool)
        for bucket, packed in zip(bits.column("bucket").to_pylist(), bits.column("bits").to_pylist(), strict=True):
            lo, hi = starts[bucket], starts[bucket + 1]
            passed[order[lo:hi]] = np.unpackbits(np.frombuffer(packed, np.uint8), count=hi - lo).astype(bool)
        out = [found.exact(passed)]
        if not last:
            kept = found.kept(passed)
            out += [_steps(block=[block], relation=[kept.relation()]), kept.longer().sent(block, buckets)]
        release()
        return pa.Table.from_batches(out)

    return task


def _can_reach(least: int):
    """For all blocks' hashes in a bucket, one bit each: is their sum ``least`` or more?"""

    def task(table: pa.Table) -> pa.Table:
        hashes = [np.frombuffer(h, np.uint32) for h in table.column("hashes").to_pylist()]
        counts = [np.frombuffer(zstandard.decompress(c), np.uint8) for c in table.column("counts").to_pylist()]
        every = np.concatenate(hashes)
        order = np.argsort(every, kind="stable")
        inside = every[order]
        first = np.ones(len(inside), bool)
        first[1:] = inside[1:] != inside[:-1]
        sums = np.add.reduceat(np.concatenate(counts)[order].astype(np.int64), np.flatnonzero(first))
        passed = np.zeros(len(every), bool)
        passed[order] = (sums >= least)[np.cumsum(first) - 1]
        ends = np.cumsum([len(h) for h in hashes])
        bits = [np.packbits(passed[hi - len(h) : hi]).tobytes() for h, hi in zip(hashes, ends, strict=True)]
        release()
        return pa.table({"block": table.column("block"), "bucket": table.column("bucket"), "bits": pa.array(bits, pa.binary())})

    return task


def _whole(value: Column | str) -> Column:
    return (F.col(value) if isinstance(value, str) else value).cast("decimal(38,0)")


def phrases(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, block_words: int = BLOCK_WORDS,
            bucket_hashes: int = BUCKET_HASHES) -> tuple[DataFrame, DataFrame]:
    """All phrases of up to ``longest`` words found ``least`` times, and the words of each language.

    Phrases are (lang, ids, words, n, heads, tails): how often they, their first 1, 2, ... and their last 1, 2, ...
    words occur.  The second table is (lang, words).
    """
    texts = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"),
                        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    found = cut(texts.mapInArrow(_occurrences(block_words), FOUND), "occurrences").df
    words = found.filter("relation is null").drop("relation")
    spoken = cut(words.groupBy("lang").agg(F.sum("n").alias("words")), "spoken")
    total = sum(r.words for r in spoken.df.agg(F.sum("words").alias("words")).collect() if r.words)
    buckets = max(1, -(-total // bucket_hashes))

    own = (F.col("block") * F.lit(1 << 31) + F.col("code")).alias("own")
    same = Window.partitionBy("lang", "word")
    frequent = cut(
        words.select("block", "code", "lang", "word", "n", own)
        .withColumn("f", F.sum("n").over(same)).withColumn("id", F.min("own").over(same))
        .filter(F.col("f") >= least).select("block", "code", "lang", "word", "f", "id", (F.col("id") == F.col("own")).alias("first")),
        "words").df
    known = [frequent.filter("first").select(
        "lang", F.array("id").alias("ids"), F.array("word").alias("words"), F.col("f").alias("n"),
        F.array("f").alias("heads"), F.array("f").alias("tails"))]

    relation = found.filter("relation is not null").select("block", "relation")
    step = cut(relation.groupBy("block").cogroup(frequent.select("block", "code", "lang", "id").groupBy("block"))
               .applyInArrow(_words_passed(buckets), STEP), "step").df
    for size in range(2, longest + 1):
        sent = step.filter("hashes is not null").select("block", "bucket", "hashes", "counts")
        bits = sent.groupBy("bucket").applyInArrow(_can_reach(least), "block long, bucket int, bits binary")
        relation = step.filter("relation is not null").select("block", "relation")
        step = cut(relation.groupBy("block").cogroup(bits.groupBy("block"))
                   .applyInArrow(_phrases_passed(buckets, size == longest), STEP), "step").df
        counted = step.filter("ids is not null").groupBy("lang", "ids").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)
        shorter = known[-1]
        head = shorter.select("lang", F.col("ids").alias("head_ids"), F.col("words").alias("head_words"), "heads")
        tail = shorter.select("lang", F.col("ids").alias("tail_ids"), F.col("words").alias("tail_words"), "tails")
        whole = (
            counted.withColumn("head_ids", F.slice("ids", 1, size - 1)).withColumn("tail_ids", F.slice("ids", 2, size - 1))
            .join(head, ["lang", "head_ids"]).join(tail, ["lang", "tail_ids"])
        )
        known.append(cut(whole.select(
            "lang", "ids", F.concat("head_words", F.array(F.element_at("tail_words", -1))).alias("words"), "n",
            F.concat("heads", F.array("n")).alias("heads"), F.concat("tails", F.array("n")).alias("tails")), "phrases").df)
    every = known[0]
    for more in known[1:]:
        every = every.unionByName(more)
    return every, spoken.df


def collocations(docs: DataFrame, least: int = LEAST, longest: int = LONGEST, share: int = SHARE, top: int = TOP, **sizes: int) -> DataFrame:
    """The best ``top`` phrases of each language: (lang, rank, phrase, a, l, r, n, score).

    A phrase of two words or more scores ``floor(1000000 a a / (l r))`` at its worst cut.  It goes if a phrase of one
    word more holds it and occurs ``share`` percent as often or more; longer holders occur no more often than those.
    """
    found, spoken = phrases(docs, least, longest, **sizes)
    within = found.filter(F.size("ids") > 2).select(
        "lang", "n", F.explode(F.array(F.expr("slice(ids, 1, size(ids) - 1)"), F.expr("slice(ids, 2, size(ids) - 1)"))).alias("ids"))
    within = within.groupBy("lang", "ids").agg(F.max("n").alias("longer"))
    cuts = F.transform(F.sequence(F.lit(1), F.size("ids") - 1), lambda k: F.struct(
        k.alias("k"), F.element_at("heads", k).alias("l"), F.element_at("tails", F.size("ids") - k).alias("r")))
    best = F.array_min(F.transform("cuts", lambda c: F.struct(
        F.call_function("div", _whole("n") * _whole("n") * _whole(F.lit(1_000_000)), _whole(c["l"]) * _whole(c["r"])).alias("score"),
        c["k"].alias("k"), c["l"].alias("l"), c["r"].alias("r"))))
    left = (
        found.filter(F.size("ids") > 1).join(within, ["lang", "ids"], "left")
        .filter(F.col("longer").isNull() | (F.lit(100) * F.col("longer") < F.lit(share) * F.col("n")))
        .withColumn("cuts", cuts).withColumn("best", best)
        .select("lang", F.array_join("words", " ").alias("phrase"), F.col("n").alias("a"),
                F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    )
    left = cut(left, "scored").df
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of a language are among the best of its parts, so no task sorts a whole language
    parts = Window.partitionBy("lang", F.pmod(F.xxhash64("phrase"), F.lit(SALTS))).orderBy(*order)
    some = left.withColumn("in_part", F.row_number().over(parts)).filter(F.col("in_part") <= top)
    ranked = some.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order))).filter(F.col("rank") <= top)
    return ranked.join(F.broadcast(spoken) if spoken_is_small(spoken) else spoken, "lang").select(
        "lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


def spoken_is_small(spoken: DataFrame) -> bool:
    """Languages are few; a table with very many is joined without a broadcast."""
    return spoken.limit(10_001).count() <= 10_000
