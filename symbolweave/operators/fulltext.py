"""Ranked full-text search over the text columns of rows that have no index; ``postings`` searches a stored graph.

A search reads the texts once.  That pass counts each phrase per row, keeps the
rows that match (narrow: id, kind, lengths, counts) and, as observed metrics,
gathers the corpus figures BM25 needs over *all* rows.  Ranking then runs on the
narrow matches, and the wide rows are fetched for the winners only.  Nothing is
shuffled but the top-k.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

from symbolweave.functions.text import contains_folded, fold_word, long_words, words
from symbolweave.lineage import BROADCAST_ROWS, cut
from symbolweave.operators.lookup import nodes_by_name

TEXT_COLUMNS = ("name", "signature", "metadata")

# Fixed values of the ranking function.
K1 = 1.2
B = 0.75
IDF_FLOOR = 1e-6


@dataclass(frozen=True)
class Phrase:
    """Consecutive words in one column; the last may be a prefix."""

    words: tuple[str, ...]
    prefix: bool = False
    column: str | None = None


# A match text is a choice (OR) of conjunctions (AND) of exclusions (NOT); the
# first phrase list of an exclusion must match, the others must not.
Exclusion = list[list[Phrase]]
Match = list[list[Exclusion]]

_ITEM = re.compile(
    r'\s*(?:(?P<column>\w+)\s*:\s*)?(?:"(?P<quoted>(?:[^"]|"")*)"|(?P<bare>\w+))(?P<star>\s*\*)?\s*'
)
_BREAK = re.compile(r"[\W_]+")


def read_match(text: str, columns: tuple[str, ...] = TEXT_COLUMNS) -> Match:
    """Read words, "phrases", prefix*, column:word, and AND, OR, NOT between them."""
    items, at = [], 0
    while at < len(text):
        found = _ITEM.match(text, at)
        if not found:
            raise ValueError(f"cannot read search text at {text[at:]!r}")
        at = found.end()
        bare, quoted, column = found["bare"], found["quoted"], found["column"]
        if bare in ("AND", "OR", "NOT") and not column and not found["star"]:
            items.append(bare)
            continue
        if column and column not in columns:
            raise ValueError(f"no such column: {column}")
        body = bare if bare is not None else quoted.replace('""', '"')
        parts = tuple(w for w in _BREAK.split(fold_word(body)) if w)
        items.append(Phrase(parts, bool(found["star"]), column))

    def split(seq: list, word: str) -> list[list]:
        groups: list[list] = [[]]
        for item in seq:
            if item == word:
                groups.append([])
            else:
                groups[-1].append(item)
        if any(not g for g in groups):
            raise ValueError(f"search text lacks a side of {word}: {text!r}")
        return groups

    return [[split(part, "NOT") for part in split(choice, "AND")] for choice in split(items, "OR")]


def phrases_of(match: Match) -> list[Phrase]:
    found = [p for choice in match for part in choice for group in part for p in group]
    return list(dict.fromkeys(p for p in found if p.words))


def _occurrences(tokens: Column, phrase: Phrase) -> Column:
    """How often the phrase occurs in one column's word list."""

    def same(token: Column, place: int) -> Column:
        last = place == len(phrase.words) - 1
        if phrase.prefix and last:
            return token.startswith(phrase.words[place])
        return token == phrase.words[place]

    if len(phrase.words) == 1:
        return F.size(F.filter(tokens, lambda t: same(t, 0)))
    places = F.sequence(F.lit(0), F.size(tokens) - len(phrase.words))
    hits = F.filter(
        F.when(F.size(tokens) >= len(phrase.words), places).otherwise(F.array().cast("array<int>")),
        lambda at: reduce(
            lambda a, b: a & b,
            [same(F.get(tokens, at + i), i) for i in range(len(phrase.words))],
        ),
    )
    return F.size(hits)


def matches(match: Match, count: dict[Phrase, Column]) -> Column:
    def group(phrases: list[Phrase]) -> Column:
        tests = [count[p] > 0 for p in phrases if p.words]
        return reduce(lambda a, b: a & b, tests, F.lit(True)) if tests else F.lit(False)

    def part(groups: Exclusion) -> Column:
        return reduce(lambda a, b: a & ~b, [group(g) for g in groups])

    choices = [reduce(lambda a, b: a & b, [part(p) for p in choice]) for choice in match]
    return reduce(lambda a, b: a | b, choices)


def phrase_counts(
    rows: DataFrame, phrases: list[Phrase], columns: tuple[str, ...], keep: list[str],
    fold_accents: bool = True,
) -> DataFrame:
    """Per row: words in all columns (``length``) and occurrences ``f0, f1, …``."""
    tokens = rows.select(*keep, *[words(c, fold_accents).alias(f"_w_{c}") for c in columns])
    total = reduce(lambda a, b: a + b, [F.size(f"_w_{c}") for c in columns])

    def freq(phrase: Phrase) -> Column:
        searched = [phrase.column] if phrase.column else columns
        found = [_occurrences(F.col(f"_w_{c}"), phrase) for c in searched]
        return reduce(lambda a, b: a + b, found)

    return tokens.select(
        *keep,
        total.cast("bigint").alias("length"),
        *[freq(p).cast("bigint").alias(f"f{i}") for i, p in enumerate(phrases)],
    )


def scored(
    counts: DataFrame, match: Match, phrases: list[Phrase], keep: tuple[str, ...], corpus: tuple[int, int] | None = None
) -> DataFrame:
    """Matching rows of phrase counts as (keep…, score).

    ``corpus`` is how many rows and words there are; without it ``counts`` has every row, and they are observed there.
    """
    excluded = {p for choice in match for part in choice for group in part[1:] for p in group}
    seen = Observation()
    observed = counts.observe(
        seen,
        F.count(F.lit(1)).alias("rows"),
        F.sum("length").alias("length"),
        *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(phrases))],
    )
    count = {p: F.col(f"f{i}") for i, p in enumerate(phrases)}
    hits = cut(observed.filter(matches(match, count)), "matches")
    total, length = corpus or (seen.get["rows"] or 0, seen.get["length"] or 0)
    average = length / max(total, 1)
    share = F.lit(1 - B) + F.lit(B) * F.col("length") / F.lit(float(average or 1.0))
    score = F.lit(0.0)
    for i, phrase in enumerate(phrases):
        if phrase in excluded:
            continue
        having = seen.get[f"n{i}"] or 0
        weight = F.log(F.lit((total - having + 0.5) / (having + 0.5)))
        weight = F.when(weight <= 0, F.lit(IDF_FLOOR)).otherwise(weight)
        f = F.col(f"f{i}")
        score = score + weight * (f * (K1 + 1)) / (f + K1 * share)
    return hits.df.select(*keep, score.alias("score"))


def scored_matches(
    rows: DataFrame,
    text: str,
    columns: tuple[str, ...] = TEXT_COLUMNS,
    keep: tuple[str, ...] = ("id", "kind"),
    fold_accents: bool = True,
) -> DataFrame:
    """Matching rows as (keep…, score); the better a match, the higher its score."""
    match = read_match(text, columns)
    phrases = phrases_of(match)
    return scored(phrase_counts(rows, phrases, columns, list(keep), fold_accents), match, phrases, keep)


def best_first() -> list[Column]:
    """Scores are compared to nine digits, so that equal scores tie on every engine."""
    return [F.round("score", 9).desc(), F.col("id").asc()]


def search(
    nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20, fold_accents: bool = True
) -> DataFrame:
    """Best matches first, with their score; a blank query lists nodes by name."""
    if not query.strip():
        return nodes_by_name(nodes, kind, limit).withColumn("score", F.lit(0.0))
    hits = scored_matches(nodes, query, fold_accents=fold_accents)
    if kind:
        hits = hits.filter(F.col("kind") == kind)
    winners = hits.orderBy(*best_first()).limit(limit).select("id", "score")
    side = F.broadcast(winners) if limit <= BROADCAST_ROWS else winners
    return nodes.join(side, "id").select(*nodes.columns, "score").orderBy(*best_first())


def search_prefix(nodes: DataFrame, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
    """Search as typed: the last word may be unfinished."""
    return search(nodes, f"{query}*" if query.strip() else query, kind, limit)


def search_members(
    nodes: DataFrame, query: str, kind: str | None = None, limit: int = 20, safe: bool = True
) -> DataFrame:
    """Matching nodes without ranking, first ids first.

    With ``safe`` a query that cannot be read finds nothing.
    """
    try:
        match = read_match(query)
    except ValueError:
        if not safe:
            raise
        return nodes.limit(0)
    phrases = phrases_of(match)
    picked = nodes if not kind else nodes.filter(F.col("kind") == kind)
    counts = phrase_counts(picked, phrases, TEXT_COLUMNS, ["id"])
    count = {p: F.col(f"f{i}") for i, p in enumerate(phrases)}
    winners = counts.filter(matches(match, count)).select("id").orderBy("id").limit(limit)
    side = F.broadcast(winners) if limit <= BROADCAST_ROWS else winners
    return nodes.join(side, "id").select(*nodes.columns).orderBy("id")


def name_contains_any(nodes: DataFrame, task: str, limit: int = 30) -> DataFrame:
    """Nodes whose name contains any longer word of a task, first ids first."""
    wanted = long_words(task)
    if not wanted:
        return nodes.limit(0)
    tests = [contains_folded("name", w) for w in wanted]
    return nodes.filter(reduce(lambda a, b: a | b, tests)).orderBy("id").limit(limit)


def explore(nodes: DataFrame, query: str, limit: int = 50) -> DataFrame:
    """Nodes whose name or path contains the query, first ids first."""
    test = contains_folded("name", query) | contains_folded("file_path", query)
    return nodes.filter(test).orderBy("id").limit(limit)
