"""Small tables with the odd cases every operator has to take."""

import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
ITEMS = ["Which tide lifts the northern gauge when the valve is shut? It is the second tide of the long autumn night.",
         "Name the metal of the old mill wheel in the lower valley. The wheel was cast from grey iron by the river."]


def prose(seed: int, words: int) -> str:
    rng = random.Random(seed)
    syllables = "an be cor de el fi gan ho in jo ka lu mer no os pri qua rin sol tur".split()
    out = ["".join(rng.choice(syllables) for _ in range(rng.randint(1, 4))) for _ in range(words)]
    for k in range(0, words, 6):
        out[k] = "the"
    for k in range(9, words, 11):
        out[k] += ".\n" if k % 2 else "."
    return " ".join(out)


def rows():
    a, b, c = prose(1, 120), prose(2, 150), prose(3, 90)
    near = a.split(" ")
    near[60] = "changed"
    texts = [
        a, " ".join(near), a.upper(), b, c, b,
        None, "", "   \n\t ", "one", "one two", "One  Two",
        b[:300] + " " + c[100:400], "é" * 80 + " ß ñ 漢字 " + "é" * 80, "é" * 80 + " ß ñ 漢字 " + "é" * 80,
        "a" * 3000, "ha ha ha " * 400, "### $$$ %%% " * 40, "MIT License\nGNU General Public License. cc-by CC BY",
        prose(5, 60) + " " + ITEMS[0] + " " + prose(6, 60), prose(7, 20) + " " + ITEMS[1],
        prose(8, 12000), "x\x00y\x0bz\x0cw \x1c\u00a0end", "line one here\nline one here\n\nline one here\n",
    ]
    made = [(k, t, "en", "s", len(t) if t is not None else None) for k, t in enumerate(texts)]
    # a row that comes twice, two texts under one id, and no id at all
    return [*made, made[4], (4, prose(9, 80), None, None, None), (None, a, "en", "s", 1), (None, None, None, None, None)]


@pytest.fixture(scope="session")
def odd_rows():
    return rows()


@pytest.fixture(scope="session")
def odd_docs(spark, odd_rows):
    return spark.createDataFrame(odd_rows, COLUMNS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], COLUMNS)


@pytest.fixture(scope="session")
def items(spark):
    return spark.createDataFrame(list(enumerate(ITEMS)) + [(7, ""), (8, None), (None, "ha ha")], "item_id long, text string")
