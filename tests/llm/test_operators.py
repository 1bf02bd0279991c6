"""Every operator against brute force, on tables with nulls, ties, repeats, long texts and clashing columns."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from symbolweave.llm import (
    components,
    decontamination,
    kneser_ney,
    license_scan,
    near_duplicates,
    packing,
    quality_rules,
    queries,
    suffix_dedup,
    suffix_sort,
    token_counts,
    toxicity,
    url_filters,
)

BLANK = re.compile(r"[^\x20\x09-\x0D]+")
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
CLASHING = ["n_words", "kept", "score", "host", "print", "bucket", "part", "term", "edits", "_words", "node", "sketch"]


def clashing(df):
    """``df`` with further columns whose names operators use themselves."""
    return df.select("*", *[F.lit("clash").alias(c) for c in CLASHING if c not in df.columns])


def words(text):
    return BLANK.findall((text or "").translate(FOLD))


def plain(rows):
    return sorted(map(repr, rows))


def same(found, wanted):
    assert plain(tuple(r) for r in found) == plain(wanted)


# 1 license scan


def license_facts(text):
    found = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(FOLD))
    places = [(k, label) for phrase, label in license_scan.PHRASES.items()
              for k in range(len(found)) if found[k : k + len(phrase.split())] == phrase.split()]
    at = [k for k, _ in places]
    return (len(found), len(places), min(at, default=None), max(at, default=None), ",".join(sorted({x for _, x in places})))


def test_license_scan(odd_docs, odd_rows, no_docs):
    found = license_scan.scan(clashing(odd_docs)).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")
    same(found.collect(), [(r[0], *license_facts(r[1])) for r in odd_rows])
    assert license_scan.scan(no_docs).count() == 0


def test_license_rules():
    rules = tuple(license_scan.signatures())
    assert len(rules) > 300 and [r.priority for r in rules] == sorted(r.priority for r in rules)
    labels = lambda text: [s.label for *_, s in license_scan.detect(text, rules)]
    assert labels("licensed under the apache license, version 2.0") == ["apache"]
    # the longer license contains the name of the shorter one, which is suppressed
    assert labels("under the terms of the gnu lesser general public license") == ["lgpl"]
    assert labels("cc by-nc-sa 4.0") == ["cc-by-nc-sa"]
    assert labels("spdx-license-identifier: mpl-2.0 and mit license") == ["mpl", "mit"]
    assert labels("permitted") == []


def written_out(pattern):
    """Texts of every way through a pattern's alternatives and options; look-arounds are left out."""
    def ways(parsed):
        out = [""]
        for kind, value in parsed:
            kind = str(kind)
            if kind == "LITERAL":
                heads = [chr(value)]
            elif kind == "ANY":
                heads = ["~"]
            elif kind == "IN":
                heads = [chr(v if str(k) == "LITERAL" else v[0]) for k, v in value]
            elif kind == "BRANCH":
                heads = [x for part in value[1] for x in ways(part)]
            elif kind == "SUBPATTERN":
                heads = ways(value[3])
            elif kind == "MAX_REPEAT":
                heads = [x for n in {value[0], value[0] + 1} for x in (ways(value[2]) if n == 1 else [""])]
            else:
                assert kind == "ASSERT_NOT", kind
                continue
            out = list(dict.fromkeys(a + b for a in out for b in heads))
        return out

    return ways(re._parser.parse(pattern))


def test_keywords_lie_in_every_match():
    rules = tuple(license_scan.signatures())
    for rule in rules:
        texts = written_out(rule.pattern)
        assert texts and all(re.fullmatch(rule.pattern, x) and rule.keyword in x for x in texts), rule
    for name in ("gnu library general public license", "gnu lesser general public license"):
        assert [s.label for *_, s in license_scan.detect(name, rules)] == ["lgpl"]


def test_wrapped_licenses():
    rules = tuple(license_scan.signatures())
    names = {
        "apache license, version 2.0": "apache", "gnu general public license": "gpl", "mozilla public license": "mpl",
        "gnu lesser general public license": "lgpl", "gnu affero general public license": "agpl",
        "permission is hereby granted, free of charge, to any person obtaining a copy": "mit",
        "permission to use, copy, modify, and/or distribute this software": "isc",
        "redistribution and use in source and binary forms": "bsd",
        "this program is free software; you can redistribute it": "gpl",
        "licensed under the terms of the mit license": "mit", "creative commons attribution share alike": "cc-by-sa",
    }
    gaps = ["  ", "\t", "\n", "\r\n", "\r", "\u00a0", "\n * ", "\n# ", "\n#", "\n// ", "\n  /// ", "\n-- ", "\n;; ", "\n% ", "\n> ",
            " *\n * ", "   #\n#   ", " */\n/* ", " \"\n  \"", " \\\n", "\n *\n * ", "\n\n", "\ndnl ", "\nrem ", "\n! ", "\n+ * "]
    for name, label in names.items():
        plain_found = [(s.label, s.pattern) for *_, s in license_scan.detect(f"/* {name} */", rules)]
        assert [x for x, _ in plain_found] == [label]
        for gap in gaps:
            for at in [k for k, c in enumerate(name) if c == " "]:
                wrapped = name[:at] + gap + name[at + 1 :]
                text = f"/*\n * {wrapped}\n */\n\nint  x;"
                found = license_scan.detect(text, rules)
                assert [(s.label, s.pattern) for *_, s in found] == plain_found, (name, gap)
                assert [text[a:b] for a, b, _ in found] == [wrapped]  # places are those of the text as it came
    # what ends a word at the end of a line is no comment mark, and neither is what begins one
    for text, label in {"see gnu.org/licenses/\nfor it": "gpl", "cc-by\n": "cc-by", "the mit/x11\nlicense": "mit"}.items():
        assert [s.label for *_, s in license_scan.detect(text, rules)] == [label]
    for text in ("cc-by-\nsa", "the mit.\nlicense", "gnu general\npublicity license"):
        assert not license_scan.detect(text, rules)


def test_wrapped_licenses_in_documents(spark):
    made = [(1, "Permission is hereby granted, free of charge, to any\nperson obtaining  a copy"), (2, "GNU Lesser General\n * Public License")]
    found = license_scan.scan(spark.createDataFrame(made, "doc_id long, text string"))
    same(found.select("doc_id", "labels", "score", "n_detections").collect(), [(1, "mit", 1.0, 1), (2, "lgpl", 0.5, 1)])


# 2 decontamination


def test_decontamination(odd_docs, no_docs, items):
    found = decontamination.contaminated(clashing(odd_docs), clashing(items)).collect()
    assert {(r.doc_id, r.item_id) for r in found} == {(16, None), (19, 0), (20, 1)}
    kept = decontamination.keep(clashing(odd_docs), items)
    assert kept.columns == clashing(odd_docs).columns
    assert kept.count() == odd_docs.count() - 3
    assert decontamination.contaminated(no_docs, items).count() == 0
    assert decontamination.contaminated(odd_docs, items.limit(0)).count() == 0
    assert decontamination.keep(odd_docs, items.limit(0)).count() == odd_docs.count()


def test_search_finds_all_that_scores_enough(spark):
    rng = random.Random(4)
    vocabulary = [f"w{k}" for k in range(60)]
    made = [(k, " ".join(rng.choices(vocabulary, k=rng.randint(3, 40)))) for k in range(70)]
    (index,) = decontamination.build_indexes(spark.createDataFrame(made, "item_id long, text string"))
    impacts = collections.defaultdict(dict)
    for key, value in zip(index.post_keys, index.post_impacts, strict=True):
        impacts[key % index.segments][key // index.segments] = value
    passages = [sorted(rng.sample(range(len(index.terms)), rng.randint(0, 30))) for _ in range(300)]
    passage = np.repeat(np.arange(300), [len(p) for p in passages])
    term = np.array([t for p in passages for t in p])
    for tabled in (True, False):
        if not tabled:
            index.block_table = index.post_table = None
        p, s, score = decontamination.search(index, passage, term, 0.4)
        wanted = {(k, j): v for k, terms in enumerate(passages) for j in range(index.segments)
                  if (v := sum(impacts[j].get(t, 0) for t in terms)) >= 0.4}
        assert {(int(a), int(b)): pytest.approx(c) for a, b, c in zip(p, s, score, strict=True)} == wanted and wanted
    # an index in parts finds the same
    parts = list(decontamination.build_indexes(spark.createDataFrame(made, "item_id long, text string"), postings=200))
    assert len(parts) > 1 and sum(len(x.items) for x in parts) == 70


# 3 repeated strings


def repeats(rows, length=50):
    first, out = {}, []
    order = sorted(rows, key=lambda r: (r[0] is None, r[0]))
    for r in order:
        body, key = (r[1] or "").encode(), (r[0] is None, r[0])
        for k in range(len(body) - length + 1):
            first.setdefault(body[k : k + length], key)
    for r in order:
        body, key = (r[1] or "").encode(), (r[0] is None, r[0])
        keep = np.ones(len(body), np.int8)
        for k in range(len(body) - length + 1):
            if first[body[k : k + length]] != key:
                keep[k : k + length] = 0
        kept = np.frombuffer(body, np.uint8)[keep == 1].tobytes()
        out.append((r[0], len(body), len(body) - len(kept), int((np.diff(keep, prepend=1) == -1).sum()),
                    hashlib.sha256(kept).hexdigest()))
    return out


@pytest.mark.parametrize("buckets", [1, 7])
def test_repeated_bytes(odd_docs, odd_rows, no_docs, monkeypatch, buckets):
    found = suffix_dedup.repeated_bytes(clashing(odd_docs), buckets=buckets)
    same(found.collect(), repeats(odd_rows))
    assert suffix_dedup.repeated_bytes(no_docs).count() == 0


def _settled(spark, docs, buckets):
    """The pieces' rows that reach the buckets, and what the buckets make of them in this process."""
    (rows,) = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).toArrow().combine_chunks().to_batches()
    routed = pa.Table.from_batches(list(suffix_dedup._route_pieces(50, buckets, 1)(iter([rows]))))
    made = [suffix_dedup._settle(50, 1)(routed.filter(pc.equal(routed["bucket"], b))) for b in range(buckets)]
    covered = set()
    for blob in pa.concat_tables(made)["data"].to_pylist():
        for doc, tag, begin, end in zip(*suffix_dedup._unpack(blob), strict=True):
            covered.update((int(doc), int(tag), k) for k in range(begin, end))
    return routed, covered


def test_pieces_in_several_passes(spark, odd_docs, monkeypatch):
    """A bucket's pieces sorted a few at a time, or settled at once where one anchor holds most, give what one sort gives."""
    _, wanted = _settled(spark, odd_docs, 1)
    sizes, whole = [], suffix_dedup._repeated
    monkeypatch.setattr(suffix_dedup, "_repeated", lambda parts, length: sizes.append(sum(len(p[0]) for p in parts)) or whole(parts, length))
    monkeypatch.setattr(suffix_dedup, "PACKED", 1000)
    monkeypatch.setattr(suffix_dedup, "BLOCK", 1000)
    routed, found = _settled(spark, odd_docs, 1)
    together = sum(sizes)
    sizes.clear()
    monkeypatch.setattr(suffix_dedup, "SORTED", 5000)
    assert found == wanted and _settled(spark, odd_docs, 1)[1] == wanted and len(wanted) > 1000
    assert len(sizes) > 5 and max(sizes) < together / 3


def test_buckets_follow_the_bytes(spark, monkeypatch):
    """As many buckets for the same texts in one split as in many."""
    docs = spark.createDataFrame([(k, f"text {k} " * 300) for k in range(40)], "doc_id long, text string")
    held = docs.agg(F.sum(F.octet_length("text"))).first()[0]
    monkeypatch.setattr(suffix_dedup, "SHARD_BYTES", held // 200 + 1)
    monkeypatch.setattr(suffix_dedup, "BUCKET_BYTES", held // 150 + 1)
    assert suffix_dedup._numbers(docs.coalesce(1)) == suffix_dedup._numbers(docs.repartition(30))
    shards, buckets = suffix_dedup._numbers(docs.coalesce(1))
    assert 190 <= shards <= 200 and 140 <= buckets <= 150


def test_long_text_in_blocks(monkeypatch):
    texts = [("ab" * 40 + str(k) * 3).encode() * 30 for k in range(4)]
    monkeypatch.setattr(suffix_dedup, "BLOCK", 500)
    covered = collections.Counter()
    for block in suffix_dedup._blocks(texts, 50):
        for row, at, part in block:
            assert texts[row][at : at + len(part)] == part
            covered.update((row, at + k) for k in range(len(part) - 49))
    assert covered == {(row, k): 1 for row, t in enumerate(texts) for k in range(len(t) - 49)}


def test_shortened_texts(odd_docs, odd_rows):
    kept = suffix_dedup.keep(clashing(odd_docs))
    assert kept.columns == clashing(odd_docs).columns
    by_id = collections.Counter(r.doc_id for r in kept.select("doc_id").collect())
    # the later copies of whole texts are gone, and so are the null row's text's copies
    assert by_id[5] == 0 and by_id[14] == 0 and by_id[0] == 1 and by_id[6] == 1 and by_id[None] == 1


@pytest.mark.parametrize("shallow", [8, 24, 48])
def test_deep_shallow_order(shallow):
    rng = np.random.default_rng(shallow)
    for _ in range(60):
        base = rng.integers(97, 99, rng.integers(5, 60)).astype(np.uint8).tobytes()
        data, limit = b"".join(base[rng.integers(0, 3) :] for _ in range(rng.integers(1, 60))), int(rng.integers(4, 50))
        body = np.frombuffer(data + bytes(64), np.uint8)
        starts = rng.integers(0, max(len(data) - limit, 1), 150)
        order, classes = suffix_sort.deep_shallow(body, starts, limit, shallow)
        keys = [body[starts[k] : starts[k] + limit].tobytes() for k in order]
        assert keys == sorted(keys) and sorted(order) == list(range(150))
        assert all((a == b) == (x == y) for a, b, x, y in zip(keys, keys[1:], classes, classes[1:], strict=False))


# 4 near duplicates


def shingles(text, size):
    w = words(text)
    return {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} or ({tuple(w)} if w else set())


def groups(rows, size):
    sets = [shingles(r[1], size) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    out = []
    for k, r in enumerate(rows):
        ids = [rows[j][0] for j in range(len(rows)) if label[j] == label[k] and rows[j][0] is not None]
        first = min(ids, default=None) if sets[k] else r[0]
        out.append((r[0], len(sets[k]), first, r[0] == first))
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates(odd_docs, odd_rows, no_docs, size):
    same(near_duplicates.near_duplicates(clashing(odd_docs), size).collect(), groups(odd_rows, size))
    if size == 2:
        assert near_duplicates.near_duplicates(no_docs, size).count() == 0
        return
    kept = near_duplicates.keep(clashing(odd_docs), size)
    assert kept.columns == clashing(odd_docs).columns
    assert {1, 2, 5}.isdisjoint(r.doc_id for r in kept.collect())


def representatives(rows, size):
    """For each group one (doc_id, text), and all rows without a shingle once."""
    held, out = collections.defaultdict(list), set()
    sets = [shingles(r[1], size) for r in rows]
    label = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * shared >= 80 * (len(sets[i]) + len(sets[j]) - shared):
                old, new = label[i], label[j]
                label = [new if x == old else x for x in label]
    for k, r in enumerate(rows):
        if sets[k]:
            held[label[k]].append((r[0] is None, r[0] or 0, hashlib.md5(r[1].encode()).digest(), r[0], r[1]))
        else:
            out.add((r[0], r[1]))
    return out | {min(group)[3:] for group in held.values()}


def test_one_row_of_each_group_stays_whatever_its_id(spark, odd_docs, odd_rows):
    """Texts that share an id with others, and near copies without ids."""
    a, b, c = (" ".join(f"{x}{k}" for k in range(60)) for x in "abc")
    more = [(1, a), (5, a + " extra"), (5, b), (None, c), (None, c + " extra"), (None, c + " other"), (5, b + " more"), (6, b), (None, ""), (7, "")]
    rows = [*odd_rows, *[(None if i is None else i + 100, t, None, None, None) for i, t in more]]
    docs = spark.createDataFrame(rows, odd_docs.schema).repartition(3)
    kept = [(r.doc_id, r.text) for r in near_duplicates.keep(clashing(docs), 5).collect()]
    assert len(kept) == len(set(kept)) and set(kept) == representatives(rows, 5)


def test_near_duplicates_of_a_large_group(spark, monkeypatch):
    """Copies that are near their source but not always one another, in blocks and shards of a few."""
    for name, value in (("FEW", 3), ("MANY", 5), ("TEXTS_PER_SHARD", 10)):
        monkeypatch.setattr(near_duplicates, name, value)
    rng, base, made = random.Random(5), [f"t{k}" for k in range(80)], []
    for k in range(120):
        text = list(base)
        for at in rng.sample(range(80), rng.randint(1, 9)):
            text[at] = f"x{rng.randint(0, 30)}"
        made.append((k, " ".join(text), None, None, None))
    docs = spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long")
    same(near_duplicates.near_duplicates(docs, 2).collect(), groups(made, 2))


def test_components(spark):
    rng = random.Random(6)
    links = [(k, k + 1) for k in range(30)] + [(100, 100 + rng.randint(1, 40)) for _ in range(30)] + [
        (rng.randint(200, 260), rng.randint(200, 260)) for _ in range(50)]
    found = {r.node: r.label for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    label = {n: n for link in links for n in link}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    assert found == {n: x for n, x in label.items() if n != x}


# 5 packing


def test_packing(odd_docs, odd_rows, no_docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    found = packing.pack(clashing(odd_docs), path).collect()
    pieces, wanted = collections.Counter(), collections.Counter()
    for r in found:
        pieces[r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens] += 1
    for r in odd_rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [2], "<u4")
        at = 0
        while at < len(ids):
            part = ids[at : at + 4096]
            wanted[r[0], at, len(part), zlib.crc32(part.tobytes()), len(ids)] += 1
            at += 4096
    assert pieces == wanted
    sequences = collections.defaultdict(list)
    for r in found:
        sequences[r.sequence_id].append(r)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == parts[0].sequence_tokens <= 4096
        assert parts[0].padded_to == (at if at & (at - 1) == 0 else 4096)
    assert packing.pack(no_docs, path).count() == 0


def test_shortest_pack_first():
    rng = random.Random(7)
    for histogram in ({5: 1_000_000_000}, {4096: 3, 1: 10**12}, {3000: 7, 1000: 5, 90: 100, 6: 1},
                      {rng.randint(1, 4096): rng.randint(1, 50) for _ in range(500)}):
        packs, placed = packing.shortest_pack_first(histogram), collections.Counter()
        for count, pattern in packs:
            assert sum(length * often for length, often in pattern) <= 4096
            for length, often in pattern:
                placed[length] += count * often
        assert placed == histogram and len(packs) < 5000
        places = packing.Places(packs)
        for length, n in histogram.items():
            if n <= 50:
                spots = places.look_up(np.full(n, length), np.arange(n))
                assert len({tuple(x) for x in spots[:2].T}) == n


# 6 quality rules


def quality_facts(text):
    w, text = BLANK.findall(text or ""), text or ""
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {k + j for k in range(len(w) - 2) if windows[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in text.split("\n") if BLANK.search(x)]
    failed = len(w) < 50 or 100 * len(covered) > 50 * len(w)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered), failed


def test_quality_rules(odd_docs, odd_rows, no_docs):
    judged = quality_rules.judge(clashing(odd_docs))
    found = judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same(found.collect(), [(r[0], *quality_facts(r[1])) for r in odd_rows])
    verdicts = [(r.kept, r.base_failed) for r in judged.select("kept", "base_failed").collect()]
    assert (True, True) not in verdicts and (True, False) in verdicts
    kept = quality_rules.keep(clashing(odd_docs))
    assert kept.columns == clashing(odd_docs).columns and kept.count() == sum(k for k, _ in verdicts)
    assert {r.doc_id for r in kept.collect()} >= {0, 3, 4, None} and 17 not in {r.doc_id for r in kept.collect()}
    assert quality_rules.judge(no_docs).count() == 0


# 7 language model


def test_registered_kneser_ney(spark, odd_docs, odd_rows, tmp_path):
    """The query with all its columns, on a model of its own rows that are not held out."""
    clashing(odd_docs).write.parquet(f"{tmp_path}/documents.parquet")
    out = lambda key: key is not None and zlib.crc32(str(key).encode()) % 5 == 1
    learned = [[*words(r[1]), "\n"] for r in odd_rows if not out(r[0])]
    one, two = collections.Counter(), collections.Counter()
    for tokens in learned:
        one.update(tokens)
        two.update(zip(["", *tokens], tokens, strict=False))
    total, different = sum(one.values()), len(one)
    spread, front, follow = collections.Counter(w for _, w in two), collections.Counter(), collections.defaultdict(collections.Counter)
    for (v, _), c in two.items():
        front[v] += c
        follow[v][min(c, 3)] += 1

    def discounts(counts):  # modified Kneser-Ney of Chen and Goodman
        n = collections.Counter(counts)
        return kneser_ney._discounts(n[1], n[2], n[3], n[4])

    d, e = discounts(two.values()), discounts(spread.values())
    rest = sum(e[min(c, 3)] for c in spread.values()) / len(two)

    def chance(v, w):
        alone = ((spread[w] - e[min(spread[w], 3)]) if w in spread else 0) / len(two) + rest / (different + 1)
        if not front[v]:
            return alone
        seen = two[v, w] - d[min(two[v, w], 3)] if (v, w) in two else 0
        return (seen + sum(d[k] * n for k, n in follow[v].items()) * alone) / front[v]

    wanted = []
    for r in odd_rows:
        tokens = [*words(r[1]), "\n"]
        wanted.append((str(r[0]), out(r[0]), len(tokens), sum(t in one for t in tokens), total,
                       sum(math.log10((one[t] + 0.5) / (total + 0.5 * (different + 1))) for t in tokens),
                       sum(math.log10(chance(v, t)) for v, t in zip(["", *tokens], tokens, strict=False))))
    found = queries.op7_kneser_ney(spark, str(tmp_path))
    assert found.columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]
    assert {x[1] for x in wanted} == {True, False}
    got = [(str(r[0]), *r[1:]) for r in found.collect()]
    for a, b in zip(sorted(wanted), sorted(got), strict=True):
        assert b[:5] == a[:5] and b[5:] == pytest.approx(a[5:], rel=1e-9)


def test_kneser_ney_scores_are_finite(spark):
    """Two short texts whose counts of counts give a discount of nothing or less, and unknown words."""
    docs = spark.createDataFrame([(0, "a b a b a c a d"), (1, "a b b b")], "doc_id long, text string")
    odd = spark.createDataFrame([(2, "x y z"), (3, "d c b a"), (4, ""), (5, None)], "doc_id long, text string")
    for learned in (docs, docs.filter("doc_id = 0"), docs.filter("doc_id = 1"), docs.limit(0)):
        scored = kneser_ney.with_perplexity(kneser_ney.score(odd, kneser_ney.train(learned))).collect()
        assert all(math.isfinite(r.score) and r.score <= 1e-12 and math.isfinite(r.perplexity) for r in scored)
        assert all(r.perplexity == pytest.approx(10 ** (-r.score / r.n_tokens)) for r in scored)


def test_oracles_are_sql():
    assert all(isinstance(sql, str) for sql in queries.ORACLES.values())


@pytest.mark.parametrize("shards", [1, 5])
def test_kneser_ney(odd_docs, odd_rows, no_docs, shards):
    model = kneser_ney.train(clashing(odd_docs).filter("doc_id % 3 != 1"), shards)
    learned = [[*words(r[1]), "\n"] for r in odd_rows if r[0] is not None and r[0] % 3 != 1]
    one, two = collections.Counter(), collections.Counter()
    for tokens in learned:
        one.update(tokens)
        two.update(zip(["", *tokens], tokens, strict=False))
    total, different = sum(one.values()), len(one)
    spread, front, follow = collections.Counter(w for _, w in two), collections.Counter(), collections.defaultdict(lambda: [0] * 4)
    for (v, _), c in two.items():
        front[v] += c
        follow[v][min(c, 3)] += 1

    def discounts(counts):
        n = collections.Counter(counts)
        return kneser_ney._discounts(n[1], n[2], n[3], n[4])

    d, e = discounts(two.values()), discounts(spread.values())
    rest = sum(e[min(c, 3)] for c in spread.values()) / len(two)
    alone = lambda w: (spread[w] - e[min(spread[w], 3)]) / len(two) + rest / (different + 1)

    def chance(v, w):
        if not front[v]:
            return alone(w)
        c = two[v, w]
        return (c - d[min(c, 3)]) / front[v] + sum(d[k] * follow[v][k] for k in (1, 2, 3)) / front[v] * alone(w)

    for v in list(front)[:20]:
        assert sum(chance(v, w) for w in one) + chance(v, "never seen") == pytest.approx(1)
    assert (model.tokens, model.words) == (total, different)
    wanted = collections.defaultdict(list)
    for r in odd_rows:
        tokens = [*words(r[1]), "\n"]
        wanted[r[0]].append((len(tokens), sum(one[t] > 0 for t in tokens),
                             sum(math.log10((one[t] + 0.5) / (total + 0.5 * (different + 1))) for t in tokens),
                             sum(math.log10(chance(v, t)) for v, t in zip(["", *tokens], tokens, strict=False))))
    found = collections.defaultdict(list)
    for r in kneser_ney.score(clashing(odd_docs), model).collect():
        found[r.doc_id].append(tuple(r)[1:])
    for key, rows in wanted.items():
        for a, b in zip(sorted(rows), sorted(found[key]), strict=True):
            assert b == pytest.approx(a, rel=1e-9)
    empty = kneser_ney.train(no_docs)
    assert [tuple(r)[1:3] for r in kneser_ney.score(odd_docs.filter("doc_id = 10"), empty).collect()] == [(3, 0)]


# 8 url filters


def fits(host, path, rules):
    found = [(len(h + p), len(h), v, h + p) for h, p, v in rules
             if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(found)[2:] if found else ("allow", None)


@pytest.mark.parametrize("slabs", [1, 4, 30])
def test_url_filters(spark, slabs):
    rng = random.Random(8)
    labels, parts = ["a", "b", "org", "x-y", "com"], ["", "/", "/a", "/a/", "/ab", "/a/b", "/é"]
    rules = {(".".join(rng.choices(labels, k=rng.randint(1, 3))), rng.choice(parts[1:])): rng.choice(["allow", "block"]) for _ in range(40)}
    rules = [(h, p, v) for (h, p), v in rules.items()]
    urls = [None, "", "no scheme/a", "http://", "HTTP://A.ORG/a?q://x", "x://a.b.org:80/a", "http://é.org/é#f", "://org/a//b?", "http://org."]
    urls += ["http://" + ".".join(rng.choices(labels, k=rng.randint(1, 5))) + rng.choice(parts) + rng.choice(["", "?q", "#f/a"]) for _ in range(300)]
    urls += ["http://a.org/a"] * 50
    pages = clashing(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).drop("host")
    made = spark.createDataFrame(rules, "host string, path string, verdict string")
    found = url_filters.judge(pages, made, slabs=slabs).collect()
    wanted = []
    for k, url in enumerate(urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.match(r"[^/?#]*", rest).group()
        path = re.match(r"[^?#]*", rest[len(host) :]).group()
        verdict, rule = fits(host.translate(FOLD), path, rules)
        wanted.append((k, host.translate(FOLD), path, rule, verdict))
    same(found, wanted)
    assert url_filters.judge(pages.limit(0), made).count() == 0
    assert {r.verdict for r in url_filters.judge(pages, made.limit(0)).collect()} == {"allow"}


# 9 toxicity


def test_pairs_of_terms_are_learned():
    """Two words that are harmless alone and toxic together: no sum of weights can tell."""
    rng, texts, labels = random.Random(9), [], []
    for _ in range(1200):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        texts.append(" ".join(rng.sample("river stone cloud table green north".split(), 4) + ["insult"] * one + ["group"] * two))
        labels.append(int(one and two))
    import pyarrow as pa

    terms, starts = toxicity.features(pa.array(texts[:900]), 12)
    machine = toxicity.learn(terms, starts, labels[:900], 12, epochs=60)
    scores = machine.scores(pa.array(texts[900:]))
    assert np.mean((scores >= 0.5) == np.array(labels[900:])) > 0.98


def test_terms_that_do_not_tell_alone():
    """A pair whose terms have equal shares in both classes, and a slur in a few toxic rows only."""
    import pyarrow as pa

    rng, made = random.Random(19), []
    fill = lambda: [f"v{int(1000 * rng.random() ** 2)}" for _ in range(20)]
    for k in range(2000):
        toxic, kind = k % 2, k // 2 % 4
        more = ([["insult", "group"], [], ["curse"], ["curse"]] if toxic else [["insult"], ["group"], [], []])[kind]
        made.append((" ".join(fill() + more + ["slur"] * (toxic and kind == 1 and k < 100)), toxic))
    for word in ("insult", "group"):
        shares = collections.Counter(y for text, y in made if word in text.split())
        assert shares[0] == shares[1] == 250
    assert sum("slur" in text.split() for text, _ in made) < 15
    machine = toxicity.learn(*toxicity.features(pa.array([t for t, _ in made]), 18), [y for _, y in made])
    score = lambda *more: np.median(machine.scores(pa.array([" ".join([*fill(), *more]) for _ in range(100)])))
    assert score("insult", "group") > 0.5 and score("curse") > 0.9
    assert max(score("insult"), score("group")) < 0.25
    assert score("slur") > score() + 0.2
    again = toxicity.Machine.unpacked(machine.packed())
    texts = pa.array(["insult group", "slur", "", None])
    assert again.scores(texts).tolist() == machine.scores(texts).tolist()


def test_toxicity(spark, odd_docs, no_docs):
    folder = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{folder}/{n}.parquet") for n in ("documents", "labels"))
    marked = {r.doc_id: r.toxic for r in labels.collect()}
    found = [r for r in queries.op9_toxicity(spark, folder).collect() if r.held_out and r.doc_id in marked]
    right = np.mean([r.predicted == marked[r.doc_id] for r in found])
    assert right > 0.9 and all(0 <= r.score <= 1 for r in found)
    model = toxicity.fit(docs, labels)
    assert toxicity.score(clashing(odd_docs), model).count() == odd_docs.count()
    assert toxicity.score(no_docs, model).count() == 0
    odd = spark.createDataFrame([(1, None), (None, 1), (2, 7), (999_999, 1)], "doc_id long, toxic int")
    flat = toxicity.fit(odd_docs, odd)
    assert len({r.score for r in toxicity.score(odd_docs, flat).collect()}) == 1


# 10 token counts


@pytest.fixture(scope="module")
def encoder():
    return token_counts.encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def test_counts_follow_edits(encoder):
    rng = random.Random(10)
    pool = "ab 's're \n\t  1\uff12é!? ll"
    text = lambda n: "".join(rng.choice(pool) for _ in range(n))
    for round_ in range(300):
        tree = token_counts.CountTree(text(rng.choice([0, 1, 5, 40, 400, 3000 if round_ % 20 == 0 else 10])), encoder)
        for _ in range(rng.randint(1, 10)):
            tree.edit(rng.randint(-2, len(tree.text) + 3), rng.choice([0, 1, 3, 30, 200]), text(rng.choice([0, 1, 3, 30, 600])))
            assert tree.tokens == encoder.whole(tree.text)
            assert sum(sum(s) for s, _ in tree.leaves) == len(tree.text) == tree.levels[-1][0, 0]


def test_small_edits_encode_little(encoder):
    tree = token_counts.CountTree("some words of a long text " * 2000, encoder)
    assert tree.edit(20_000, 3, "new") < 10


def test_edited_counts(spark, odd_docs, odd_rows, no_docs, encoder):
    edits = F.expr("""array(
        named_struct('start', 3, 'length', cast(null AS int), 'replacement', 'new'), null,
        named_struct('start', 0, 'length', 2, 'replacement', cast(null AS string)),
        named_struct('start', cast(null AS int), 'length', 2, 'replacement', 'no'))""")
    args = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    found = token_counts.edited_counts(clashing(odd_docs), edits, *args)
    wanted = []
    for r in odd_rows:
        text = r[1] or ""
        after = (text[:3] + "new" + text[3:])[2:]
        wanted.append((r[0], encoder.whole(text), encoder.whole(after), 2, len(after)))
    same(found.select("doc_id", "tokens_before", "tokens_after", "n_edits", "chars_after").collect(), wanted)
    assert token_counts.edited_counts(no_docs, edits, *args).count() == 0
    none = token_counts.edited_counts(odd_docs, F.lit(None), *args)
    assert none.filter("tokens_before != tokens_after").count() == 0
