"""Quality rules: a table of thresholds compiled into one projection of built-in functions.

A rule names a measure and the least and greatest value it may have.  ``judge`` computes
every measure and the verdict in column expressions over one row; nothing is shuffled and
no user function runs.  Words are ``[^\\x20\\x09-\\x0D]+``; a null text has none.

Nulls in other columns pass through untouched.  A text without words fails the base rule
(fewer than 50 words).  Repeated rows are judged alike, each on its own; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NOT_BLANK = "[^\t-\r ]"
NO_SYMBOLS = "[^#*$%&|<>]+"
LEAST_WORDS = 50
MOST_REPEATED = 50  # per cent of the words

# The commonest function words of the languages that are kept; as they stand, or with a capital.
STOP_WORDS = sorted(x for w in set(
    "the of and to in is that it for was on with as be by this are or from at an a not have "
    "le la les de des et un une du en que qui dans pour sur au avec est il ne pas ce "
    "der die das und den von zu mit sich nicht ein eine auf dem ist im auch als es an "
    "el los las y que del se por con para su al lo una esta como no".split()
) for x in (w, w.capitalize()))


@dataclass(frozen=True)
class Rule:
    """``measure`` must lie within ``least`` and ``most``; a limit that is None is open."""

    measure: str
    least: float | None = None
    most: float | None = None


RULES = (
    Rule("mean_word_chars", least=2.0, most=20.0),
    Rule("longest_word_share", most=0.5),
    Rule("symbols_per_word", most=0.25),
    Rule("exclamations_per_word", most=0.25),
    Rule("stop_word_share", least=0.05),
    Rule("dup_line_share", most=0.5),
    Rule("pipe_line_share", most=0.5),
)


def _size(column: Column) -> Column:
    return F.size(column).cast("long")


def _count(text: Column, character: str) -> Column:
    """How often an ASCII character stands in a text."""
    return F.octet_length(text) - F.octet_length(F.replace(text, F.lit(character), F.lit("")))


def _words(text: Column) -> Column:
    return F.filter(F.split(text, "[\t-\r ]+"), lambda w: w != "")


def _repeat_words(words: Column) -> Column:
    """Words inside three-word windows that the text has twice or more.

    Windows are hashed first; only if two hashes agree are the windows themselves compared:
    sorted, equal neighbours give the positions that recur, and each position covers three
    words less what the next one covers too.
    """

    def windows(make) -> Column:
        return F.transform(F.slice(words, F.lit(1), F.greatest(F.size(words) - 2, F.lit(0))),
                           lambda x, i: make(x, F.get(words, i + 1), F.get(words, i + 2), i))

    def recurring(ordered: Column) -> Column:
        return F.transform(
            F.filter(ordered, lambda x, k: (x["s"] == F.get(ordered, k - 1)["s"])
                     | (x["s"] == F.get(ordered, k + 1)["s"])),
            lambda x: x["i"],
        )

    def covered(places: Column) -> Column:
        return F.aggregate(
            F.sort_array(places),
            F.struct(F.lit(0).alias("n"), F.lit(-3).alias("last")),
            lambda a, p: F.struct(
                (a["n"] + F.least(F.lit(3), p - a["last"])).cast("int").alias("n"), p.alias("last")
            ),
        )["n"]

    hashes = windows(lambda a, b, c, i: F.xxhash64(a, b, c))
    exact = F.sort_array(windows(lambda a, b, c, i: F.struct(
        F.xxhash64(a, b, c).alias("h"), F.concat_ws(" ", a, b, c).alias("s"), i.alias("i"))))
    # a binding of one element, so that the sorted windows are made once per row
    places = F.transform(F.array(exact), lambda o: covered(recurring(o)))
    differ = F.size(F.array_distinct(hashes)) == F.greatest(F.size(words) - 2, F.lit(0))
    return F.when(differ, F.lit(0)).otherwise(F.get(places, 0)).cast("long")


def measures(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """Every base figure of a text, out of its words and its lines that have a word."""
    return {
        "n_words": _size(words),
        "word_chars": F.length(F.array_join(words, "")).cast("long"),
        "n_symbols": F.length(F.regexp_replace(text, NO_SYMBOLS, "")).cast("long"),
        "n_dup_lines": _size(lines) - _size(F.array_distinct(lines)),
        "n_repeat_words": _repeat_words(words),
    }


def ratios(text: Column, words: Column, lines: Column) -> dict[str, Column]:
    """What the threshold table may name, out of columns that ``measures`` made."""
    n = F.greatest(F.col("n_words"), F.lit(1))
    n_lines = F.greatest(_size(lines), F.lit(1))
    return {
        "mean_word_chars": F.col("word_chars") / n,
        "longest_word_share": F.coalesce(
            F.array_max(F.transform(words, lambda w: F.length(w))) / F.greatest(F.col("word_chars"), F.lit(1)),
            F.lit(0.0)),
        "symbols_per_word": F.col("n_symbols") / n,
        "exclamations_per_word": _count(text, "!") / n,
        "stop_word_share": _size(F.filter(words, lambda w: w.isin(STOP_WORDS))) / n,
        "dup_line_share": F.col("n_dup_lines") / n_lines,
        "pipe_line_share": _size(F.filter(lines, lambda x: _count(x, "|") > 2))
        / n_lines,
    }


def compiled(rules: tuple[Rule, ...], columns: dict[str, Column]) -> Column:
    """The names of the measures that fail, as one expression."""
    broken = []
    for rule in rules:
        value, fails = columns[rule.measure], F.lit(False)
        if rule.least is not None:
            fails = fails | (value < rule.least)
        if rule.most is not None:
            fails = fails | (value > rule.most)
        broken.append(F.when(fails, F.lit(rule.measure)))
    return F.array_compact(F.array(*broken))


def judge(docs: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text") -> DataFrame:
    """``docs`` with the base figures, ``base_failed``, ``failed_rules`` and ``kept``.

    Columns of ``docs`` that have one of these names are replaced.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    split = docs.withColumns({
        "_words": _words(body),
        "_lines": F.filter(F.split(body, "\n"), lambda x: x.rlike(NOT_BLANK)),
    })
    base = measures(body, F.col("_words"), F.col("_lines"))
    counted = split.withColumns(base)
    failed = (F.col("n_words") < LEAST_WORDS) | (
        100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))
    return (
        counted.withColumn("base_failed", failed)
        .withColumn("failed_rules", compiled(rules, ratios(body, F.col("_words"), F.col("_lines"))))
        .withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
        .drop("_words", "_lines")
    )


def keep(docs: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The rows of ``docs`` that pass, with the columns they had."""
    columns = docs.columns
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"),
                       F.col("text").alias("_text"))
    # The number keeps Spark from copying the verdict's whole expression into the filter.
    judged = judge(held, rules, "_text").withColumn("_number", F.monotonically_increasing_id())
    return judged.filter(F.col("kept") & (F.col("_number") >= 0)).select("_row.*")
