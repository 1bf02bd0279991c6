"""Ranked search over stored postings instead of texts.

A posting is a word of a node: its places in one column, with the node's length and kind.  Postings are
bucketed by word and sorted inside, so a query reads the folders of its words only; a word of the query
that may be unfinished is looked up in the sorted dictionary first.  Changes append postings under a batch
number and mark nodes as dead before it; a query reads both and drops what is dead.

Substrings have postings of their own: every three letters of a node's name, and of a path, once however many nodes
it has.  The nodes that have all of a part's threes, or whose path has, are fetched, by their buckets, and tested; a
part of one or two letters is looked for by a scan.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property, reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.functions.text import ascii_lower, contains_folded, long_words, words
from symbolweave.lineage import Cut, bucket_of, cut, join_frontier, join_keyed, stored_buckets
from symbolweave.operators.fulltext import TEXT_COLUMNS, Match, Phrase, best_first, matches, phrases_of, read_match, scored
from symbolweave.operators.lookup import nodes_by_name
from symbolweave.schema import NODE_COLUMNS

POSTINGS = T.StructType([
    T.StructField("term", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("place", T.IntegerType()),
    T.StructField("positions", T.ArrayType(T.IntegerType())),
    T.StructField("length", T.LongType()),
    T.StructField("kind", T.StringType()),
    T.StructField("batch", T.LongType()),
])
TERMS = T.StructType([T.StructField("start", T.StringType()), T.StructField("term", T.StringType())])
GRAMS = T.StructType([
    T.StructField("gram", T.StringType()),
    T.StructField("id", T.StringType()),
    T.StructField("place", T.IntegerType()),
    T.StructField("batch", T.LongType()),
])
GRAM = 3
PART_COLUMNS = ("name", "file_path")
NAME, PATH = range(len(PART_COLUMNS))
DEAD = T.StructType([T.StructField("id", T.StringType()), T.StructField("until", T.LongType())])


@dataclass(frozen=True)
class StoredIndex:
    """Stored postings, words and threes of letters, each read when first asked for, and what BM25 needs of all nodes.

    ``dead_rows`` is how many nodes are listed as dead.
    """

    read: Callable[[str], DataFrame]
    dead_rows: int
    rows: int
    length: int

    @cached_property
    def postings(self) -> DataFrame:
        return self.read("postings")

    @cached_property
    def terms(self) -> DataFrame:
        return self.read("terms")

    @cached_property
    def grams(self) -> DataFrame:
        return self.read("grams")

    @cached_property
    def dead(self) -> Cut | None:
        """Until which batch the postings of a node are dead; None if none are."""
        if not self.dead_rows:
            return None
        return Cut(self.read("dead").groupBy("id").agg(F.max("until").alias("until")), self.dead_rows)


LOWERED = np.arange(256, dtype=np.uint8)
LOWERED[ord("A") : ord("Z") + 1] += 32
IN_WORD = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def _texts() -> list[Column]:
    """The text columns for ``_split``: as they are if they are ASCII, else as their words."""

    def text(name: str) -> Column:
        plain = F.is_valid_utf8(name) & (F.length(name) == F.octet_length(name))
        return F.when(F.col(name).isNull(), "").when(plain, F.col(name)).otherwise(F.array_join(words(name), " "))

    return [text(c).alias(f"t{k}") for k, c in enumerate(TEXT_COLUMNS)]


def _split(texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
    """The words of some texts one after the other, and how many each text has."""
    ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1]
    letters = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]]
    ends = ends - ends[0]
    inside = IN_WORD[letters]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    firsts = ends[:-1][np.diff(ends) > 0]
    begins[firsts] = inside[firsts]
    at, kept = np.flatnonzero(begins), LOWERED[letters[inside]]
    before = np.cumsum(inside) - inside
    offsets = np.append(before[at], len(kept)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(at), pa.py_buffer(offsets), pa.py_buffer(kept))
    return found, np.diff(np.searchsorted(at, ends))


def figures_of(nodes: DataFrame, bucket: str) -> DataFrame:
    """Rows and words of each bucket of nodes, as (bucket, rows, words)."""
    schema = T.StructType([T.StructField(bucket, T.IntegerType()), T.StructField("rows", T.LongType()), T.StructField("words", T.LongType())])

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            length = np.sum([_split(rows.column(f"t{k}"))[1] for k in range(len(TEXT_COLUMNS))], axis=0, dtype=np.int64)
            numbers, of = np.unique(rows.column(bucket).to_numpy(), return_inverse=True)
            sums = np.zeros(len(numbers), np.int64)
            np.add.at(sums, of, length)
            yield pa.RecordBatch.from_arrays(
                [pa.array(numbers.astype(np.int32)), pa.array(np.bincount(of, minlength=len(numbers))), pa.array(sums)], names=schema.fieldNames())

    counted = nodes.select(bucket, *_texts()).mapInArrow(task, schema)
    return counted.groupBy(bucket).agg(F.sum("rows").alias("rows"), F.sum("words").alias("words"))


def postings_of(nodes: DataFrame, batch: int) -> DataFrame:
    """The postings of nodes, as of a batch.

    The words of a batch of nodes are numbered and sorted together by numpy, so nothing is shuffled for it.
    """
    split = nodes.select("id", "kind", *_texts())

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            many = rows.num_rows
            lists, sizes = zip(*[_split(rows.column(f"t{k}")) for k in range(len(TEXT_COLUMNS))])
            length = np.sum(sizes, axis=0, dtype=np.int64)
            numbered = pa.concat_arrays(lists).dictionary_encode()
            word = numbered.indices.to_numpy()
            row = np.concatenate([np.repeat(np.arange(many), n) for n in sizes])
            place = np.repeat(np.arange(len(lists)), [n.sum() for n in sizes])
            at = np.concatenate([np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) for n in sizes])
            order = np.lexsort((at, word, place, row))
            row, place, word, at = row[order], place[order], word[order], at[order]
            new = np.ones(len(row), bool)
            new[1:] = (row[1:] != row[:-1]) | (place[1:] != place[:-1]) | (word[1:] != word[:-1])
            starts = np.flatnonzero(new)
            of = pa.array(row[starts])
            positions = pa.ListArray.from_arrays(pa.array(np.append(starts, len(row)).astype(np.int32)), pa.array(at.astype(np.int32)))
            yield pa.RecordBatch.from_arrays(
                [numbered.dictionary.take(pa.array(word[starts])), rows.column("id").take(of), pa.array(place[starts].astype(np.int32)), positions,
                 pa.array(length[row[starts]]), rows.column("kind").take(of), pa.array(np.full(len(starts), batch, np.int64))],
                names=POSTINGS.fieldNames())

    return split.mapInArrow(task, POSTINGS)


def terms_of(postings: DataFrame) -> DataFrame:
    """The different words of postings, with the letter they begin with."""
    return postings.select("term").distinct().select(F.substring("term", 1, 1).alias("start"), "term")


def grams_of(nodes: DataFrame, batch: int) -> DataFrame:
    """The different threes of letters in nodes' names and in their paths, as of a batch; a path's ``id`` is the path.

    A three is one number, of 21 bits a letter, so numpy finds the different ones of a batch of texts.
    """
    names = nodes.select("id", F.col("name").alias("text"), F.lit(NAME).alias("place"))
    paths = nodes.select(F.col("file_path").alias("id")).distinct().select("id", F.col("id").alias("text"), F.lit(PATH).alias("place"))

    texts = names.unionByName(paths).select("id", "place", F.make_valid_utf8(F.coalesce("text", F.lit(""))).alias("text"))

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            texts = rows.column("text").to_pylist()
            letters = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32).astype(np.int64)
            letters[(letters >= ord("A")) & (letters <= ord("Z"))] += 32
            of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
            inside = of[: 1 - GRAM] == of[GRAM - 1 :]
            code, of = reduce(lambda a, b: a << 21 | b, [letters[k : len(letters) + 1 + k - GRAM] for k in range(GRAM)])[inside], of[: 1 - GRAM][inside]
            different, number = np.unique(code, return_inverse=True)
            each = np.unique(of * np.int64(len(different)) + number)
            of, number = np.divmod(each, max(len(different), 1))
            grams = pa.array(["".join(chr(c >> 21 * k & 0x1FFFFF) for k in reversed(range(GRAM))) for c in different.tolist()], pa.string())
            of = pa.array(of)
            yield pa.RecordBatch.from_arrays(
                [grams.take(pa.array(number)), rows.column("id").take(of), rows.column("place").take(of), pa.array(np.full(len(each), batch, np.int64))],
                names=GRAMS.fieldNames())

    return texts.mapInArrow(task, GRAMS)


def alive(rows: DataFrame, dead: Cut | None) -> DataFrame:
    """Postings (words or threes) written since their node was last replaced or deleted."""
    if dead is None:
        return rows
    marked = join_frontier(rows, dead, "id", F.col(rows.columns[0]), "left")
    return marked.filter(F.col("until").isNull() | (F.col("batch") >= F.col("until"))).drop("until")


def _in_bucket_of(table: DataFrame, key: str, value: str) -> Column:
    """Rows with a value, looked for in its bucket alone."""
    test = F.col(key) == value
    for column in stored_buckets(table):
        test = test & (F.col(column) == bucket_of(F.lit(value), int(column.rsplit("_", 1)[1])))
    return test


def _found(index: StoredIndex, wanted: list[tuple[str, bool]]) -> DataFrame:
    """Postings of the wanted words (or beginnings, where the flag is set), with the number of the wanted word as ``slot``."""
    parts = []
    for slot, (word, prefix) in enumerate(wanted):
        if not prefix:
            rows = index.postings.filter(_in_bucket_of(index.postings, "term", word))
        else:
            begun = index.terms.filter(_in_bucket_of(index.terms, "start", word[:1]) & F.col("term").startswith(word))
            rows = join_frontier(index.postings, cut(begun.select("term").distinct(), "terms"), "term", F.col("id"), "left_semi")
        parts.append(rows.select(*POSTINGS.fieldNames(), F.lit(slot).alias("slot")))
    return reduce(DataFrame.unionByName, parts)


def phrase_counts(index: StoredIndex, phrases: list[Phrase], kind: str | None = None) -> DataFrame:
    """Nodes with any of the phrases' words: (id, length), whether they are ``of_kind``, and occurrences ``f0, f1, …``.

    The places of words are gathered for phrases of several words only; single words are summed up in numbers, which
    Spark adds up in place.
    """
    wanted = list(dict.fromkeys((w, p.prefix and i == len(p.words) - 1) for p in phrases for i, w in enumerate(p.words)))
    rows = alive(_found(index, wanted), index.dead)

    def slots(phrase: Phrase) -> list[int]:
        return [wanted.index((w, phrase.prefix and i == len(phrase.words) - 1)) for i, w in enumerate(phrase.words)]

    def searched(phrase: Phrase) -> list[int]:
        return [TEXT_COLUMNS.index(phrase.column)] if phrase.column else list(range(len(TEXT_COLUMNS)))

    single = {p: F.sum(F.when((F.col("slot") == slots(p)[0]) & F.col("place").isin(searched(p)), F.size("positions")))
              for p in phrases if len(p.words) == 1}
    places = {(s, c): f"p{s}_{c}" for p in phrases if p not in single for s in slots(p) for c in searched(p)}
    held = rows.groupBy("id").agg(
        F.first("length").alias("length"), *_of_kind(kind, F.first),
        *[F.coalesce(total, F.lit(0)).alias(f"s{phrases.index(p)}") for p, total in single.items()],
        *[F.flatten(F.collect_list(F.when((F.col("slot") == s) & (F.col("place") == c), F.col("positions")))).alias(name)
          for (s, c), name in places.items()])

    def followed(first: Column, rest: list[Column]) -> Column:
        """How many places of the first word have the others right behind."""
        return F.size(F.filter(first, lambda at: reduce(
            lambda a, b: a & b, [F.array_contains(r, at + i) for i, r in enumerate(rest, 1)])))

    def freq(phrase: Phrase) -> Column:
        if phrase in single:
            return F.col(f"s{phrases.index(phrase)}")
        at = slots(phrase)
        found = [followed(F.col(places[at[0], c]), [F.col(places[s, c]) for s in at[1:]]) for c in searched(phrase)]
        return reduce(lambda a, b: a + b, found)

    flag = ["of_kind"] if kind else []
    return held.select("id", "length", *flag, *[freq(p).cast("long").alias(f"f{i}") for i, p in enumerate(phrases)])


def _of_kind(kind: str | None, over: Callable[[Column], Column] = lambda c: c) -> list[Column]:
    return [over(F.col("kind") == kind).alias("of_kind")] if kind else []


def _counted(index: StoredIndex, query: str, kind: str | None) -> tuple[Match, list[Phrase], DataFrame]:
    match = read_match(query)
    phrases = phrases_of(match)
    if not phrases:
        none = index.postings.limit(0).select("id", "length", *_of_kind(kind))
        return match, phrases, none
    return match, phrases, phrase_counts(index, phrases, kind)


def _fetched(nodes: DataFrame, winners: DataFrame, *more: str) -> DataFrame:
    """The wide rows of some ids; those few ids prune the scan to their buckets."""
    return join_keyed(nodes, cut(winners, "winners"), "id").select(*NODE_COLUMNS, *more)


def search(nodes: DataFrame, index: StoredIndex, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """What ``fulltext.search`` finds in stored nodes, by their index."""
    if not query.strip():
        return nodes_by_name(nodes.select(*NODE_COLUMNS), kind, limit).withColumn("score", F.lit(0.0))
    match, phrases, counts = _counted(index, query, kind)
    hits = scored(counts, match, phrases, ("id", "of_kind") if kind else ("id",), (index.rows, index.length))
    if kind:
        hits = hits.filter("of_kind")
    winners = hits.orderBy(*best_first()).limit(limit).select("id", "score")
    return _fetched(nodes, winners, "score").orderBy(*best_first())


def search_prefix(nodes: DataFrame, index: StoredIndex, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Search as typed: the last word may be unfinished."""
    return search(nodes, index, f"{query}*" if query.strip() else query, kind, limit)


def search_members(nodes: DataFrame, index: StoredIndex, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
    """What ``fulltext.search_members`` finds: matching nodes without ranking, first ids first."""
    try:
        match, phrases, counts = _counted(index, query, kind)
    except ValueError:
        return nodes.select(*NODE_COLUMNS).limit(0)
    picked = counts.filter(matches(match, {p: F.col(f"f{i}") for i, p in enumerate(phrases)}))
    if kind:
        picked = picked.filter("of_kind")
    return _fetched(nodes, picked.select("id").orderBy("id").limit(limit)).orderBy("id")


def with_part(nodes: DataFrame, index: StoredIndex, parts: list[str], columns: tuple[str, ...] = ("name",)) -> DataFrame:
    """Nodes with any of some texts in any of some columns, ASCII letters in either case."""
    test = reduce(lambda a, b: a | b, [contains_folded(c, part) for part in parts for c in columns])
    if any(len(part) < GRAM for part in parts):
        return nodes.select(*NODE_COLUMNS).filter(test)
    found = []
    for part in parts:
        small = ascii_lower(part)
        grams = sorted({small[k : k + GRAM] for k in range(len(small) - GRAM + 1)})
        looked_up = index.grams.filter(reduce(lambda a, b: a | b, [_in_bucket_of(index.grams, "gram", g) for g in grams]))
        looked_up = looked_up.select(*GRAMS.fieldNames())

        def with_all(rows: DataFrame, n: int = len(grams)) -> DataFrame:
            return rows.groupBy("id").agg(F.count_distinct("gram").alias("n")).filter(F.col("n") == n).select("id")

        if "name" in columns:
            found.append(with_all(alive(looked_up.filter(F.col("place") == NAME), index.dead)))
        if "file_path" in columns:
            paths = with_all(looked_up.filter(F.col("place") == PATH)).filter(contains_folded("id", part))
            paths = cut(paths.withColumnRenamed("id", "file_path"), "paths")
            found.append(join_frontier(index.read("members"), paths, "file_path", F.col("id"), "left_semi").select("id"))
    return _fetched(nodes, reduce(DataFrame.unionByName, found).distinct()).filter(test)


def name_contains_any(nodes: DataFrame, index: StoredIndex, task: str, limit: int = 30) -> DataFrame:
    """What ``fulltext.name_contains_any`` finds, by the index."""
    wanted = long_words(task)
    if not wanted:
        return nodes.select(*NODE_COLUMNS).limit(0)
    return with_part(nodes, index, wanted).orderBy("id").limit(limit)


def explore(nodes: DataFrame, index: StoredIndex, query: str, limit: int = 50) -> DataFrame:
    """What ``fulltext.explore`` finds, by the index."""
    return with_part(nodes, index, [query], PART_COLUMNS).orderBy("id").limit(limit)
