"""Ranking against the formula worked out row by row, and what can be asked."""

import math
import re

import pytest

from symbolweave.functions.text import ACCENTED, fold_word
from symbolweave.operators import fulltext, outline

TEXTS = {
    "n1": ("calculate_total", "def calculate_total(items)", "{}"),
    "n2": ("getFullName", "function getFullName total", '{"a": "total"}'),
    "n3": ("total", "total total total", "{}"),
    "n4": ("Café", "crème brûlée total", "{}"),
    "n5": ("other", "nothing here", "{}"),
    "n6": ("total_calculate", "total of items", "{}"),
}


@pytest.fixture
def nodes(spark):
    rows = [
        (i, f"/src/{i}.py", n, "function" if i < "n4" else "class", s, 1, 2, None, "python", m)
        for i, (n, s, m) in TEXTS.items()
    ]
    from symbolweave.schema import NODES

    return spark.createDataFrame(rows, NODES)


def split(text):
    return [w for w in re.split(r"[\W_]+", fold_word(text)) if w]


def brute(counter_list, accept):
    """Scores by the formula, over all rows."""
    rows = {i: [split(c) for c in cols] for i, cols in TEXTS.items()}
    total, average = len(rows), sum(len(w) for cols in rows.values() for w in cols) / len(rows)
    found = {}
    counts = {i: [sum(c(words) for words in cols) for c in counter_list] for i, cols in rows.items()}
    for i, f in counts.items():
        if not accept(f):
            continue
        length, score = sum(len(w) for w in rows[i]), 0.0
        for k, count in enumerate(f):
            held = sum(1 for other in counts.values() if other[k] > 0)
            weight = max(math.log((total - held + 0.5) / (held + 0.5)), 0) or 1e-6
            score += weight * count * 2.2 / (count + 1.2 * (0.25 + 0.75 * length / average))
        found[i] = score
    return found


def word(w):
    return lambda words: words.count(w)


def scores(df):
    return {r.id: r.score for r in df.collect()}


@pytest.mark.parametrize(
    "query, counters, accept",
    [
        ("total", [word("total")], lambda f: f[0] > 0),
        ("calculate items", [word("calculate"), word("items")], lambda f: f[0] > 0 and f[1] > 0),
        ("items OR getfullname", [word("items"), word("getfullname")], lambda f: f[0] + f[1] > 0),
        ("creme", [word("creme")], lambda f: f[0] > 0),
        ("tot*", [lambda ws: sum(w.startswith("tot") for w in ws)], lambda f: f[0] > 0),
        ("calculate_total", [lambda ws: sum(ws[i:i + 2] == ["calculate", "total"] for i in range(len(ws)))],
         lambda f: f[0] > 0),
    ],
)
def test_scores_follow_the_formula(nodes, query, counters, accept):
    wanted, found = brute(counters, accept), scores(fulltext.search(nodes, query))
    assert wanted.keys() == found.keys() and wanted
    assert all(abs(wanted[i] - found[i]) < 1e-12 for i in wanted)


def test_precedence_and_columns(nodes):
    ids = lambda q: set(scores(fulltext.search(nodes, q)))
    assert ids("total NOT calculate items") == {"n2", "n3", "n4"}
    assert ids("total NOT calculate OR other") == {"n2", "n3", "n4", "n5"}
    assert ids("metadata:total") == {"n2"}
    assert ids('"total of"') == {"n6"}
    assert ids("full") == set()


@pytest.mark.parametrize("bad", ["a.b", "a + b", "x-y", "nowhere:x", "a OR", "NOT a", "(a b)"])
def test_unreadable_queries(nodes, bad):
    with pytest.raises(ValueError):
        fulltext.search(nodes, bad)
    assert fulltext.search_members(nodes, bad).count() == 0


def test_kind_limit_and_blank(nodes):
    assert set(scores(fulltext.search(nodes, "total", kind="class"))) == {"n4", "n6"}
    assert fulltext.search(nodes, "total", limit=2).count() == 2
    assert [r.name for r in fulltext.search(nodes, "  ", limit=2).collect()] == ["Café", "calculate_total"]
    assert {r.id for r in fulltext.search_prefix(nodes, "calc").collect()} == {"n1", "n6"}


def test_substring_searches(nodes):
    assert {r.id for r in fulltext.name_contains_any(nodes, "A FULL total").collect()} == {"n1", "n2", "n3", "n6"}
    assert fulltext.name_contains_any(nodes, "a b").count() == 0
    assert {r.id for r in fulltext.explore(nodes, "SRC/N5").collect()} == {"n5"}


def test_context_groups_by_file_name(nodes):
    row = outline.by_basename(fulltext.search(nodes, "creme")).first()
    assert (row.file, row.symbols) == ("n4.py", 1)
    assert row.lines == ["  `Café` (class) — `crème brûlée total`"]


def test_accents_fold_to_single_letters():
    assert fold_word("Crème Ñandú") == "creme nandu" and "ß" not in ACCENTED
