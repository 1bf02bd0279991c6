"""Text expressions: paths, words, accents, substring search."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def basename(path: Column | str) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column | str) -> Column:
    """The file extension with its dot, as written; empty when there is none."""
    return F.regexp_extract(basename(path), r"^.+(\.[^.]+)$", 1)


def short(text: Column | str, length: int) -> Column:
    return F.substring(F.coalesce(text, F.lit("")), 1, length)


def one_line(text: Column | str, length: int) -> Column:
    """The first characters of a text with line breaks as blanks, trimmed."""
    return F.trim(F.translate(short(text, length), "\n", " "))


def strip(text: Column | str) -> Column:
    return F.regexp_replace(text, r"^\s+|\s+$", "")


UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def folded_ascii(text: Column | str) -> Column:
    return F.translate(text, UPPER, LOWER)


def ascii_lower(text: str) -> str:
    return text.translate(str.maketrans(UPPER, LOWER))


def contains_folded(text: Column | str, part: str) -> Column:
    """Substring test that ignores the case of ASCII letters only."""
    return folded_ascii(text).contains(ascii_lower(part))


def long_words(task: str, shortest: int = 3) -> list[str]:
    """Lower-case words of a task description, short ones left out."""
    return [word for word in task.lower().split() if len(word) >= shortest]


def _accent_pairs() -> tuple[str, str]:
    """Single letters whose canonical decomposition is a base letter and marks."""
    marked, plain = [], []
    for code in range(0xC0, 0x2000):
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and unicodedata.category(parts[0])[0] == "L":
            if all(unicodedata.category(p) == "Mn" for p in parts[1:]) and chr(code).lower() == chr(code):
                marked.append(chr(code))
                plain.append(parts[0])
    return "".join(marked), "".join(plain)


ACCENTED, UNACCENTED = _accent_pairs()


def folded(text: Column | str) -> Column:
    """Lower case without accents, the way the full-text index sees words."""
    return F.translate(F.lower(text), ACCENTED, UNACCENTED)


def fold_word(word: str) -> str:
    return word.lower().translate(str.maketrans(ACCENTED, UNACCENTED))


# Everything but letters, numbers and private-use characters separates words.
WORD_BREAK = r"[^\p{L}\p{N}\p{Co}]+"


def words(text: Column | str, fold_accents: bool = True) -> Column:
    base = folded(text) if fold_accents else F.lower(text)
    return F.filter(F.split(F.coalesce(base, F.lit("")), WORD_BREAK), lambda w: w != "")
