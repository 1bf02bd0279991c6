"""Conversation trie, phrases and page texts against brute force, with nulls, ties, repeats, long rows and clashing columns."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from symbolweave.llm import collocations, html_templates, prefix_trie, queries

FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def clashing(df):
    """``df`` with further columns whose names operators use themselves."""
    names = ["print", "key", "shard", "n", "ids", "block", "code", "relation", "word", "host", "path", "template", "own", "depth"]
    return df.select("*", *[F.lit("clash").alias(c) for c in names if c not in df.columns])


# 11 conversation trie


def beginnings(rows):
    """Every node of the rebuilt conversations, by dictionaries."""
    own = collections.defaultdict(list)
    for conv_id, turn, role, text in rows:
        if conv_id is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest()
            own[conv_id].append(((turn is not None, turn or 0, tie), (role, text)))
    own = {c: [t for _, t in sorted(turns)] for c, turns in own.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        head = own.get(c - (abs(c) % 100) * (1 if c >= 0 else -1), [])
        paths[c] = tuple(head[:h]) + tuple(turns[h:])
    members = collections.defaultdict(list)
    for c, path in paths.items():
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
    out, inner_nodes = [], {n[:-1] for n in members if n}
    for node, held in members.items():
        below = [n for n in members if n[: len(node)] == node]
        inner = {n[: len(node) + 1] for n in below if len(n) > len(node)}
        leaves = [n for n in below if n not in inner_nodes]
        ends = ",".join(str(c) for c in sorted(held) if len(paths[c]) == len(node))
        saved = sum((len(members[n]) - 1) * len(n[-1][1]) for n in below if n)
        out.append((min(held), len(node), min(members[node[:-1]]) if node else None, len(held), len(inner), len(leaves), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def made_conversations():
    rng = random.Random(11)
    rows = []
    for c in [*range(0, 40), *range(100, 130), 205, 250, 300, 301, -1, -100, -130]:
        for t in range(rng.choice([1, 2, 3, 6, 9])):
            rows.append((c, t, rng.choice(["user", "assistant"]), rng.choice(["yes", "no", "é漢", "", "maybe so"])))
    rows += [(7, None, "user", "null first"), (8, 1, None, None), (8, 1, None, None), (8, 1, "user", "tie"), (None, 1, "user", "nobody")]
    rows += [(400 + k, 0, "user", "hot start") for k in range(60)] + [(500, t, "user", f"long {t}") for t in range(300)]
    rows += [(501 + k, t, "user", f"long {t}") for k in range(3) for t in range(290 + k)]
    return rows


CONVERSATIONS = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("partitions", ["3", "40"])
def test_trie(spark, partitions):
    rows = made_conversations()
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", partitions)
    try:
        found = prefix_trie.trie(prefix_trie.rebuilt(clashing(spark.createDataFrame(rows, CONVERSATIONS).repartition(3))))
        assert found.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == beginnings(rows)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


def test_trie_sql_agrees(spark):
    rows = [r for r in made_conversations() if r[0] is None or r[0] < 500]
    conversations = pa.table({c: [r[k] for r in rows] for k, c in enumerate(["conv_id", "turn", "role", "text"])})
    with duckdb.connect() as con:
        con.register("conversations", conversations)
        found = con.execute(queries.ORACLES["op11_prefix_trie"]).fetchall()
    assert sorted(found, key=str) == beginnings(rows)


def test_trie_without_rows(spark):
    none = spark.createDataFrame([(None, 1, "a", "b")], CONVERSATIONS)
    assert prefix_trie.trie(prefix_trie.rebuilt(none)).count() == 0
    assert prefix_trie.trie(prefix_trie.rebuilt(none.limit(0))).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_parentheses(seed):
    rng = random.Random(seed)
    bits, depth = [], 0
    for _ in range(rng.choice([0, 5, 600, 9000])):
        step = rng.random() < rng.choice([0.3, 0.9]) or depth == 0
        bits.append(step)
        depth += 1 if step else -1
    bits = [True, *bits, *[False] * (depth + 1)]
    stack, close = [], {}
    for k, bit in enumerate(bits):
        if bit:
            stack.append(k)
        else:
            close[stack.pop()] = k
    tree = prefix_trie.Parentheses(np.array(bits))
    assert tree.find_close(tree.opens, 100).tolist() == [close[k] for k in tree.opens.tolist()]


# 12 phrases


def best_phrases(rows, least=10, top=2000):
    counts, spoken = collections.defaultdict(collections.Counter), collections.Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(FOLD)):
            words = re.findall(r"[^\x20\x09]+", piece)
            spoken[lang] += len(words)
            for size in (1, 2, 3):
                for k in range(len(words) - size + 1):
                    counts[lang][tuple(words[k : k + size])] += 1
    out = []
    for lang, f in counts.items():
        held = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        longer = collections.Counter()
        for p, a in held.items():
            if len(p) == 3:
                for part in (p[:2], p[1:]):
                    longer[part] = max(longer[part], a)
        scored = []
        for p, a in held.items():
            if longer[p] and 100 * longer[p] >= 50 * a:
                continue
            score, _, l, r = min((10**6 * a * a // (f[p[:k]] * f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            scored.append((-score, -a, " ".join(p).encode(), l, r))
        for rank, (score, a, phrase, l, r) in enumerate(sorted(scored)[:top], 1):
            out.append((lang, rank, phrase.decode(), -a, l, r, spoken[lang], -score))
    return sorted(out, key=str)


def made_texts():
    rng = random.Random(12)
    vocabulary = ["the", "of", "New", "york", "city", "é", "漢字", "a b", "x\x1cy", "no-break", "zz"]
    rows = [("en" if k % 3 else None, " ".join(rng.choice(vocabulary[: 3 + k % 9]) + rng.choice(["", "", "", ".", ",\t", "\n", "!"])
                                                for _ in range(rng.choice([1, 5, 40])))) for k in range(250)]
    rows += [("de", "new york city new york city " * 3000), ("de", None), ("de", ""), ("xx", "one two"), ("de", "a" * 5000 + " " + "b" * 5000)]
    return rows + [rows[1]] * 12


TEXTS = "lang string, text string"


@pytest.mark.parametrize("sizes", [{}, {"block_words": 50, "bucket_hashes": 7}])
def test_phrases(spark, sizes):
    rows, setting = made_texts(), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "3")  # with small blocks and buckets, many of them
    try:
        found = collocations.collocations(clashing(spark.createDataFrame(rows, TEXTS).repartition(4)), **sizes)
        assert found.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
        assert sorted((tuple(r) for r in found.collect()), key=str) == best_phrases(rows)
    finally:
        spark.conf.set(setting, before)


def test_phrases_top_and_length(spark):
    rows = [("en", "p q r s t " * 20 + "p q " * 5), ("en", "q r s t u. " * 12)]
    docs = spark.createDataFrame(rows, TEXTS)
    assert sorted((tuple(r) for r in collocations.collocations(docs, top=3).collect()), key=str) == best_phrases(rows, top=3)
    longer, _ = collocations.phrases(docs, least=12, longest=5)
    counts = {tuple(r.words): r.n for r in longer.collect()}
    words = [re.findall(r"[^ ]+", piece) for _, text in rows for piece in text.split(".")]
    for size in range(1, 6):
        every = collections.Counter(tuple(w[k : k + size]) for w in words for k in range(len(w) - size + 1))
        assert {p: n for p, n in counts.items() if len(p) == size} == {p: n for p, n in every.items() if n >= 12}


def test_phrases_without_rows(spark):
    assert collocations.collocations(spark.createDataFrame([], TEXTS)).count() == 0
    assert collocations.collocations(spark.createDataFrame([("en", None), (None, " ., ")], TEXTS)).count() == 0


def test_phrases_sql_agrees():
    rows = made_texts()
    with duckdb.connect() as con:
        con.register("documents", pa.table({"lang": [r[0] for r in rows], "text": [r[1] for r in rows]}))
        assert sorted(con.execute(queries.ORACLES["op12_collocations"]).fetchall(), key=str) == best_phrases(rows)


# 13 page texts


def page_of(host, k, paragraphs, style="article"):
    menu = "".join(f'<li><a href="/{k}/{j}">entry {j} of {k}</a></li>' for j in range(3 + k % 4))
    body = "".join(f"<p>{p}</p>" for p in paragraphs)
    if style == "article":
        main = f"<article><h1>Title {k} &amp; more</h1>{body}</article>"
    elif style == "named":
        main = (f'<div class="sidebar wide-12"><p>side {k} of the page</p></div><div id="content"><h1>Title {k} &amp; more</h1>{body}'
                f'<section class="comments"><p>I liked {k}</p></section></div>')
    else:
        main = f'<div class="c{style}"><h1>Title {k} &amp; more</h1>{body}</div>'
    return (k, f"http://{host}/{k}", f"<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style><script>var a='</p>';</script></head>"
            f"<body><nav><ul>{menu}</ul></nav><!-- note {k} --><div class='ad'>buy {k} now</div>{main}<footer>&copy; {host} {k}</footer></body></html>")


def wanted_of(k, paragraphs):
    return "\n".join([f"Title {k} & more", *paragraphs])


PAGES = "page_id long, url string, html string"


def texts_of(spark, rows):
    found = html_templates.extract(clashing(spark.createDataFrame(rows, PAGES).repartition(3)))
    assert found.columns == ["page_id", "url", "text", "n_chars"]
    rows = found.collect()
    assert all(r.n_chars == len(r.text) for r in rows)
    return {r.page_id: r.text for r in rows}


@pytest.mark.parametrize("style", ["article", "named", "7"])
def test_pages_of_a_host(spark, style):
    rng = random.Random(13)
    paragraphs = {k: [" ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.choice([6, 30, 90]))) for _ in range(rng.choice([2, 4, 7]))] for k in range(30)}
    found = texts_of(spark, [page_of("news.example.com", k, p, style) for k, p in paragraphs.items()])
    assert found == {k: wanted_of(k, p) for k, p in paragraphs.items()}


def test_text_on_every_page_is_template(spark):
    paragraphs = {k: [f"w{k} " * 60 + "end", "Read more of our offers here"] for k in range(12)}
    found = texts_of(spark, [page_of("a.example.com", k, p) for k, p in paragraphs.items()])
    assert found == {k: wanted_of(k, p[:1]) for k, p in paragraphs.items()}
    # the same article everywhere is no template, and neither are a few pages
    same = {k: ["one text for all of them " * 8] for k in range(12)}
    assert texts_of(spark, [page_of("b.example.com", k, p) for k, p in same.items()]) == {
        k: wanted_of(k, [" ".join(p[0].split())]) for k, p in same.items()}
    few = {k: p for k, p in paragraphs.items() if k < 5}
    assert texts_of(spark, [page_of("c.example.com", k, p) for k, p in few.items()]) == {k: wanted_of(k, p) for k, p in few.items()}


def test_odd_pages(spark):
    shell = "<html><body><nav>menu</nav><article>{}</article><footer>end</footer></body></html>"
    cases = {
        0: (None, ""), 1: ("", ""), 2: ("plain words only", "plain words only"),
        3: ("<p>a<b>b</b> c<br>d &lt;e&gt; &#233;&nbsp;&amp;amp; &am</p><p>\n x\n\t y </p>", "ab c d <e> é &amp; &am\nx y"),
        4: (shell.format("<p>open <b>bold<br><p>next<ul><li>one<li>two</ul>"), "open bold\nnext\none\ntwo"),
        5: (shell.format("<p>text</p><form><input><button>send</button></form><script>x</script><aside>side</aside><div class='comments'>me too</div>"), "text"),
        6: ("<article><p>unclosed", "unclosed"), 7: ("<article><p>before<!-- never closed <p>x", "before"),
        8: ("<article><p>a < b and c > d <3</p></article>", "a < b and c > d <3"),
        9: ("<html><body><script>document.write('<article>no</article>')</script><main><p>" + "long word " * 20000 + "</p></main>", "long word " * 19999 + "long word"),
        10: (shell.format("<p title='a > b'>quoted</p><p class=\"x>never ends</p>"), None),
    }
    rows = [(k, None if k % 2 else f"no scheme {k}", html) for k, (html, _) in cases.items()] + [(None, None, "<p>nobody</p>")]
    found = texts_of(spark, rows + rows[3:4])
    assert {k: t for k, t in found.items() if k not in (None, 10)} == {k: t for k, (_, t) in cases.items() if k != 10}
    assert found[None] == "nobody" and found[10].startswith("quoted")
    assert html_templates.extract(spark.createDataFrame([], PAGES)).count() == 0


def test_classes_by_occurrence_vectors(spark):
    """Fingerprints group the tokens that vectors laid out in full group, whatever tasks saw which pages."""
    rows = [page_of(f"h{k % 2}.example.com", k, ["p"] * (1 + k % 5), ["article", "8"][k % 3 == 0]) for k in range(40)]
    docs = spark.createDataFrame(rows, PAGES).repartition(5)
    marks = docs.select(html_templates.host_of("url").alias("host"), "url", "html").mapInArrow(html_templates._mark, html_templates.MARKS)
    found, _ = html_templates.classes(marks)
    groups = collections.defaultdict(set)
    for r in found.collect():
        groups[r.host, r["class"]].add(r.path)
    vectors = collections.defaultdict(dict)
    for k, url, html in rows:
        page = html_templates.Page(html)
        for at, path in enumerate(page.paths):
            if page.apart[at] != 1:
                vectors[url.split("/")[2], path][k] = page.counts[at]
    wanted = collections.defaultdict(set)
    for (host, path), vector in vectors.items():
        wanted[host, tuple(sorted(vector.items()))].add(path)
    assert {(h, frozenset(p)) for (h, _), p in groups.items()} == {(h, frozenset(p)) for (h, _), p in wanted.items()}
