"""License scans: ordered signature rules behind a keyword prefilter.

A rule is a regular expression with a label, a priority, a confidence and a keyword that
every match of it contains.  Runs of blanks, and line breaks with the comment marks around
them, are folded to one blank first, so names and notices may be wrapped.  One pass of an
Aho-Corasick automaton over the folded text finds the keywords; only the rules of those
found are tried.  Their matches are detections over intervals of the text.  Taken in the
order of priority, then length, a detection whose interval lies within one already taken
is suppressed; the labels of the rest stand.

Beside it, phrases are found at word level (words are runs of ASCII letters and digits and
of anything beyond ASCII, A-Z in lower case), each at every place where its words stand in
a row; their labels are never suppressed.  Texts are scanned whole, in tasks that hold a
few megabytes at a time; nothing is shuffled.

A null or empty text has no words, no labels and the score 0.  Repeated rows are scanned
each on its own, and nulls elsewhere do not matter.  An empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from symbolweave.llm.text import chunks, id_and_text, text_bytes

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}

# What is known of each license: its label, the keyword, a regular expression for its name,
# and one for its short identifier.  Rules are made from this table and the forms below.
FAMILIES = (
    ("gpl", "gpl", r"(?:gnu )?gpl", r"gpl"),
    ("gpl", "general public", r"gnu general public licen[cs]e", r"gpl"),
    ("lgpl", "lgpl", r"(?:gnu )?lgpl", r"lgpl"),
    ("lgpl", "lesser general", r"gnu lesser general public licen[cs]e", r"lgpl"),
    ("lgpl", "library general", r"gnu library general public licen[cs]e", r"lgpl"),
    ("agpl", "agpl", r"(?:gnu )?agpl", r"agpl"),
    ("agpl", "affero", r"gnu affero general public licen[cs]e", r"agpl"),
    ("fdl", "free documentation", r"gnu free documentation licen[cs]e", r"gfdl"),
    ("apache", "apache", r"apache(?: software)? licen[cs]e", r"apache"),
    ("mit", "mit", r"(?:the )?mit(?:/x11)? licen[cs]e", r"mit"),
    ("bsd", "bsd", r"(?:new |modified |simplified |[234].clause )?bsd(?: style)? licen[cs]e", r"bsd(?:-[0234]-clause)?"),
    ("isc", "isc", r"isc licen[cs]e", r"isc"),
    ("mpl", "mozilla", r"mozilla public licen[cs]e", r"mpl"),
    ("mpl", "mpl", r"mpl", r"mpl"),
    ("epl", "eclipse", r"eclipse public licen[cs]e", r"epl"),
    ("edl", "eclipse distribution", r"eclipse distribution licen[cs]e", r"edl"),
    ("cddl", "cddl", r"cddl", r"cddl"),
    ("cddl", "common development", r"common development and distribution licen[cs]e", r"cddl"),
    ("cpl", "common public", r"common public licen[cs]e", r"cpl"),
    ("artistic", "artistic", r"(?:perl )?artistic licen[cs]e", r"artistic"),
    ("zlib", "zlib", r"zlib(?:/libpng)? licen[cs]e", r"zlib"),
    ("libpng", "libpng", r"libpng licen[cs]e", r"libpng"),
    ("boost", "boost", r"boost software licen[cs]e", r"bsl"),
    ("unlicense", "unlicense", r"(?:the )?unlicense", r"unlicense"),
    ("wtfpl", "wtfpl", r"wtfpl", r"wtfpl"),
    ("cc0", "cc0", r"cc0", r"cc0"),
    ("cc-by-nc-nd", "nc-nd", r"cc[ -]by-nc-nd", r"cc-by-nc-nd"),
    ("cc-by-nc-sa", "nc-sa", r"cc[ -]by-nc-sa", r"cc-by-nc-sa"),
    ("cc-by-nc", "by-nc", r"cc[ -]by-nc", r"cc-by-nc"),
    ("cc-by-nd", "by-nd", r"cc[ -]by-nd", r"cc-by-nd"),
    ("cc-by-sa", "by-sa", r"cc[ -]by-sa", r"cc-by-sa"),
    ("cc-by", "cc", r"cc[ -]by", r"cc-by"),
    ("cc-by-sa", "share", r"creative commons attribution.share.?alike", r"cc-by-sa"),
    ("cc-by-nc", "noncommercial", r"creative commons attribution.noncommercial", r"cc-by-nc"),
    ("cc-by", "attribution", r"creative commons attribution", r"cc-by"),
    ("python", "python", r"python software foundation licen[cs]e", r"psf"),
    ("php", "php", r"php licen[cs]e", r"php"),
    ("ruby", "ruby", r"ruby licen[cs]e", r"ruby"),
    ("openssl", "openssl", r"openssl licen[cs]e", r"openssl"),
    ("postgresql", "postgresql", r"postgresql licen[cs]e", r"postgresql"),
    ("w3c", "w3c", r"w3c (?:software )?licen[cs]e", r"w3c"),
    ("ofl", "open font", r"sil open font licen[cs]e", r"ofl"),
    ("eupl", "european union", r"european union public licen[cs]e", r"eupl"),
    ("osl", "open software", r"open software licen[cs]e", r"osl"),
    ("afl", "academic free", r"academic free licen[cs]e", r"afl"),
    ("ms-pl", "microsoft public", r"microsoft public licen[cs]e", r"ms-pl"),
    ("ms-rl", "microsoft reciprocal", r"microsoft reciprocal licen[cs]e", r"ms-rl"),
    ("upl", "universal permissive", r"universal permissive licen[cs]e", r"upl"),
    ("odbl", "open database", r"open database licen[cs]e", r"odbl"),
    ("ncsa", "illinois", r"university of illinois(?:/ncsa)? open source licen[cs]e", r"ncsa"),
    ("bsl", "business source", r"business source licen[cs]e", r"busl"),
)

# The forms in which a license is named: priority (smaller goes first), confidence, keyword
# (None: the family's), pattern.
_VERSION = r"(?:,? ?(?:version|v\.?)? ?[0-9](?:\.[0-9])?)?"
FORMS = (
    (1, 1.0, "spdx-license-identifier:", r"spdx-license-identifier: ?{short}(?:-[0-9][0-9.]*)?(?:-only|-or-later)?"),
    (2, 0.95, None, r"(?:licensed|released|distributed|available|published) under (?:the )?(?:terms of (?:the )?)?{name}" + _VERSION),
    (3, 0.9, None, r"(?:under|subject to) the (?:terms|conditions)(?: and conditions)? of (?:the )?{name}" + _VERSION),
    (4, 0.85, None, r"licen[cs]e: ?(?:the )?{name}" + _VERSION),
    (4, 0.8, "license:", r"license: ?{short}(?:[- ]v?[0-9](?:\.[0-9])?)?"),
    (5, 0.7, None, r"{name},? (?:version|v\.?) ?[0-9](?:\.[0-9])?"),
    (6, 0.5, None, r"{name}"),
)

# Texts of licenses and notices that name none.
NOTICES = (
    ("mit", "permission is hereby granted", 1, 1.0,
     r"permission is hereby granted, free of charge, to any person obtaining a copy"),
    ("isc", "permission to use, copy", 1, 1.0,
     r"permission to use, copy, modify,? and(?:/or)? distribute this software"),
    ("bsd", "redistribution and use", 1, 1.0, r"redistribution and use in source and binary forms"),
    ("gpl", "free software", 2, 0.9, r"this (?:program|library) is free software[;:,] you can redistribute it"),
    ("unlicense", "unencumbered", 1, 1.0, r"free and unencumbered software released into the public domain"),
    ("public-domain", "public domain", 6, 0.6, r"(?:placed|released|dedicated|is) (?:in|into|to) the public domain"),
    ("proprietary", "all rights reserved", 7, 0.4, r"all rights reserved"),
    ("proprietary", "confidential", 7, 0.5, r"proprietary and confidential"),
    ("apache", "apache.org/licenses", 2, 0.95, r"apache\.org/licenses/license-2\.0"),
    ("gpl", "gnu.org/licenses", 3, 0.8, r"gnu\.org/licenses/"),
    ("cc-by", "creativecommons.org", 3, 0.8, r"creativecommons\.org/licenses/by/"),
    ("mit", "opensource.org", 3, 0.8, r"opensource\.org/licenses/mit"),
)


@dataclass(frozen=True)
class Signature:
    """``pattern`` is tried on folded lower-case text if ``keyword`` stands in it."""

    label: str
    keyword: str
    priority: int
    confidence: float
    pattern: str


def signatures() -> list[Signature]:
    """Every rule, in the order in which overlapping detections are resolved."""
    made = [
        Signature(label, needs or keyword, priority, confidence,
                  rf"(?<![a-z0-9-])(?:{form.format(name=name, short=short)})(?![a-z0-9-])")
        for label, keyword, name, short in FAMILIES for priority, confidence, needs, form in FORMS
    ]
    made += [Signature(*notice[:4], rf"(?<![a-z0-9]){notice[4]}(?![a-z0-9])") for notice in NOTICES]
    return sorted(made, key=lambda s: s.priority)


@cache
def _compiled(rules: tuple[Signature, ...]):
    automaton, by_keyword = ahocorasick.Automaton(), defaultdict(list)
    for rank, rule in enumerate(rules):
        by_keyword[rule.keyword].append((rank, re.compile(rule.pattern)))
    for keyword in by_keyword:
        automaton.add_word(keyword, keyword)
    automaton.make_automaton()
    return automaton, dict(by_keyword)


# Comment marks before a line's text, and behind it where a blank sets them off (else they may belong to a word or an address).
_BREAK = r"\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029"
_LEAD = (r"(?:[*#;%!|>+'\"\\~]++|//++|/\*++|--++>?|<!--++|\(\*++|\{-|-(?=\s)|\*/|\.\\\"|\.\.(?=\s)|(?:dnl|rem)(?=\s))")
_TRAIL = r"(?:[*#;%|+'\"\\~]++/?|//++|--++>?|\*\)|-\})"
_GAP = re.compile(
    rf"(?:[^\S{_BREAK}]++{_TRAIL})?+[^\S{_BREAK}]*+[{_BREAK}](?:\s*+{_LEAD})*+\s*+|\s\s++|[^\S ]")


def _unfolded(text: str) -> Callable[[int], int]:
    """Places in a text out of places in what is left of it when its gaps are folded."""
    blanks, removed = [], [0]
    for m in _GAP.finditer(text):
        blanks.append(m.start() - removed[-1])
        removed.append(removed[-1] + m.end() - m.start() - 1)
    return lambda at: at + removed[bisect_left(blanks, at)]


def detect(text: str, rules: tuple[Signature, ...]) -> list[tuple[int, int, Signature]]:
    """Intervals and rules of the detections that stand, in the order of their places."""
    automaton, by_keyword = _compiled(rules)
    whole, text = text, _GAP.sub(" ", text)
    found = {keyword for _, keyword in automaton.iter(text)}
    if not found:
        return []
    hits = [
        (rules[rank].priority, m.start() - m.end(), m.start(), rank)
        for keyword in found for rank, pattern in by_keyword[keyword] for m in pattern.finditer(text)
    ]
    taken: list[tuple[int, int, Signature]] = []
    reach: list[tuple[int, int]] = []  # of what is taken, sorted; none holds another
    for _, minus, start, rank in sorted(hits):
        end = start - minus
        if not _within(reach, start, end):
            taken.append((start, end, rules[rank]))
    if not taken:
        return []
    place = _unfolded(whole)
    return sorted(((place(start), place(end), rule) for start, end, rule in taken), key=lambda t: t[:2])


def _within(reach: list[tuple[int, int]], start: int, end: int) -> bool:
    """Whether an interval lies in one of ``reach``; if not, it joins them."""
    at = bisect_right(reach, (start, float("inf")))
    if at and reach[at - 1][1] >= end:
        return True
    to = at
    while to < len(reach) and reach[to][1] <= end:
        to += 1
    reach[at:to] = [(start, end)]
    return False


_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True


def phrase_places(
    data: np.ndarray, offsets: np.ndarray, phrases: dict[str, str]
) -> tuple[np.ndarray, list[list[tuple[int, str]]]]:
    """Words in each lower-case text, and the (first word's number, label) of every place of a phrase."""
    count = len(offsets) - 1
    # a zero byte behind each text keeps words from running on into the next one
    offsets = offsets + np.arange(count + 1)
    body = np.zeros(offsets[-1], np.uint8)
    own = np.ones(len(body), bool)
    own[offsets[1:] - 1] = False
    body[own] = data
    inside = _WORD[body]
    starts = np.flatnonzero(inside & ~np.concatenate([[False], inside[:-1]]))
    first = np.searchsorted(starts, offsets)
    places: list[list[tuple[int, str]]] = [[] for _ in range(count)]
    body = body.tobytes()
    for phrase, label in phrases.items():
        pattern = re.compile(
            rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+".join(re.escape(w.encode()) for w in phrase.split(" "))
            + rb"(?![0-9a-z\x80-\xff])")
        m = pattern.search(body)
        while m:
            row = int(np.searchsorted(offsets, m.start(), "right")) - 1
            if m.end() < offsets[row + 1] and not (m.start() and _WORD[body[m.start() - 1]]):
                places[row].append((int(np.searchsorted(starts, m.start()) - first[row]), label))
            m = pattern.search(body, m.start() + 1)
    return np.diff(first), places


SCHEMA = ("doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, "
          "labels string, score double, n_detections long")


def scan(docs: DataFrame, phrases: dict[str, str] | None = None, rules: list[Signature] | None = None) -> DataFrame:
    """One row per document: its words, the phrases' places, the labels and the highest confidence."""
    rules, phrases = tuple(rules or signatures()), phrases or PHRASES

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            data, offsets = text_bytes(chunk.column(1))
            data = _LOWER[data]
            n_words, places = phrase_places(data, offsets, phrases)
            body = data.tobytes()
            rows = []
            for k, row in enumerate(places):
                text = body[offsets[k] : offsets[k + 1]].decode("utf-8", "replace")
                standing = detect(text, rules)
                base = {label for _, label in row}
                at = [place for place, _ in row]
                rows.append((
                    int(n_words[k]), len(row), min(at, default=None), max(at, default=None),
                    ",".join(sorted(base)), ",".join(sorted(base | {s.label for *_, s in standing})),
                    max([1.0] * bool(row) + [s.confidence for *_, s in standing], default=0.0), len(standing)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), *(pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True))],
                names=[c.split()[0] for c in SCHEMA.split(", ")])

    return id_and_text(docs).mapInArrow(task, SCHEMA)
