"""Main text of web pages by templates deduced from pages of the same host (equivalence classes of tokens).

1. A page's tokens are its elements, told apart by the path of block elements and their names down to them.  A
   token's occurrence vector has its count on each page of the host.  Vectors are never laid out: each page has two
   random numbers, and the sums of count times number over all pages are alike only for equal vectors.  Such sums
   add up, so tasks send one row for each token and host, however many pages a host has.
2. Tokens of a host with one vector are an equivalence class.  A class is valid if it is on enough of the
   host's pages and its tokens come in one order on all of them.  Paths nest classes: the parent of a class is
   the class of the nearest element around it.  Text that stands on every page of a host with many different pages
   belongs to the template too; a task sends only what is on all pages it saw, which loses none.
3. The template of a host names the element that holds the main text - a token of a valid class, once on a page - and
   the elements that do not belong to it: those of HTML for menus, forms, footers and the like, and those named so,
   unless the heading, the main element or all of the host's text is in them.
4. Extraction walks each page along the template: what is in the main element, not in an excluded one and not template
   text, is a slot's content and is kept, block by block.  A page that lacks the main element is judged by its own figures.

Pages are read twice and never shuffled; templates are broadcast if they are small, else joined over salts.  Tokens on
under one in 100 of a host's pages are left out of its template (their text counts for the elements around
them), so a template is bounded by the size of pages.  Rows without a host are judged page by page.  Null or empty html gives
an empty text; markup that is never closed ends with the page; repeated rows are all answered.
"""

from __future__ import annotations

import html as entities
import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import BROADCAST_ROWS, Cut, cut, join_frontier
from symbolweave.llm.text import release

# Fixed values of HTML: elements that make a block, those without content, those whose content is no markup, and which
# open elements of the same kind a start tag ends, up to which element around them.
BLOCKS = frozenset(
    "html head title body address article aside blockquote center dd details dialog dir div dl dt fieldset figcaption figure "
    "footer form h1 h2 h3 h4 h5 h6 header hgroup hr legend li main menu nav ol optgroup option p pre section summary table "
    "caption colgroup tbody td tfoot th thead tr ul search".split())
EMPTY = frozenset("area base br col embed hr img input link meta param source track wbr".split())
RAW = frozenset("script style textarea title noscript iframe noembed noframes template xmp".split())
ENDS = {"li": ("li", ("ul", "ol", "menu")), "dt": ("dt dd", ("dl",)), "dd": ("dt dd", ("dl",)), "option": ("option", ("select",)),
        "tr": ("tr td th", ("table",)), "td": ("td th", ("tr", "table")), "th": ("td th", ("tr", "table"))}
# Elements that never hold the main text, and names (of classes, ids and roles) that say the same.
APART = frozenset(
    "head title nav footer aside form menu dialog search script style noscript template iframe object svg canvas button select "
    "textarea fieldset label audio video map".split())
NAMED_APART = frozenset(
    "ad ads adv advert adverts advertisement advertising adsense sponsor sponsored sponsors promo promotion banner sidebar menu "
    "nav navbar navigation breadcrumb breadcrumbs footer masthead cookie cookies consent gdpr notice notices alert popup modal overlay "
    "newsletter subscribe subscription signup login comment comments commentlist respond reply replies disqus discussion share "
    "sharing social related recommended recommendations widget toolbar pagination pager copyright contentinfo complementary "
    "search".split())
COMMENTS = frozenset("comment comments commentlist respond reply replies disqus discussion".split())
INLINE = APART - BLOCKS | {"a"}
MAIN = ("article", "main")

SUPPORT = 0.3  # of a host's pages that have a valid class
RARE = 100
WHOLE_SHARE = 0.98  # of the text: an element named apart that holds more is what the page is about
MOST_SHARE = 0.5  # of the text an element called article or main has to hold
MAIN_SHARE = 0.95  # of the text the main element holds, if no element is called article or main
DIFFERENT = 10  # different pages of a host before its common text counts as template
COMMON_SHARE = 0.2  # of a page's text that may be template
TEMPLATE_BYTES = 32 << 20
HELD = 100_000

MARKS = ("host string, path string, token long, named boolean, r1 long, r2 long, pages long, total long, chars long, text long, "
         "in_order array<long>, digest long")

_TAG = re.compile(
    r"<!--.*?(?:-->|\Z)|<[!?][^>]*>|<(/?)([a-zA-Z][^\s/>]*)([^>\"']*(?:(?:\"[^\"]*\"|'[^']*')[^>\"']*)*)>|<(/?)([a-zA-Z][^\s/>]*)([^>]*)>", re.S)
_NAMES = re.compile(r"(?<![\w-])(class|id|role)\s*=\s*(?:\"([^\"]*)\"|'([^']*)'|([^\s\"'>]+))", re.I)
_WORD = re.compile(r"[A-Z]?[a-z]+|[A-Z]+")


def _label(tag: str, attributes: str) -> tuple[str, bool]:
    """What tells an element from others, and whether its names set it apart."""
    if tag in ("html", "body") or "=" not in attributes:
        return tag, False
    found = sorted(f"{kind.lower()}={a or b or c}" for kind, a, b, c in _NAMES.findall(attributes))
    words = {w.lower() for value in found for w in _WORD.findall(value.split("=", 1)[1])}
    label = " ".join([tag, *found])
    return re.sub(r"\d+", "0", label).replace("/", "|"), bool(words & (COMMENTS if tag in MAIN else NAMED_APART))


class Page:
    """A page's elements by path and its runs of text.

    Path 0 is the page itself.  ``apart`` is 1 for an element that HTML sets apart, or one inside of it, and 2 for
    one that its own name does.
    """

    def __init__(self, html: str) -> None:
        self.paths, self.parents, self.tags, self.apart, self.counts = [""], [-1], [""], [0], [1]
        self._known: dict[tuple[int, str], int] = {}
        self.runs: list[tuple[int, int, str]] = []  # path, block, text as written
        self._block = 0
        self._read(html)

    def _enter(self, parent: int, tag: str, attributes: str) -> int:
        label, named = _label(tag, attributes)
        at = self._known.get((parent, label))
        if at is None:
            at = self._known[parent, label] = len(self.paths)
            self.paths.append(f"{self.paths[parent]}/{label}")
            self.parents.append(parent)
            self.tags.append(tag)
            self.counts.append(0)
            inside = self.apart[parent] == 1 or tag in APART or (tag == "header" and not self._within(parent, MAIN))
            self.apart.append(1 if inside else 2 if named else 0)
        self.counts[at] += 1
        return at

    def _within(self, at: int, tags: tuple[str, ...]) -> bool:
        while at >= 0:
            if self.tags[at] in tags:
                return True
            at = self.parents[at]
        return False

    def _read(self, html: str) -> None:
        at, stack = 0, [("", 0)]

        def leave(tags: tuple[str, ...], within: tuple[str, ...] = ()) -> None:
            for k in range(len(stack) - 1, 0, -1):
                if stack[k][0] in tags:
                    del stack[k:]
                    return
                if stack[k][0] in within:
                    return

        while True:
            found = _TAG.search(html, at)
            if (found.start() if found else len(html)) > at:
                self.runs.append((stack[-1][1], self._block, html[at : found.start() if found else len(html)]))
            if not found:
                return
            at = found.end()
            tag = found[2] or found[5]
            if not tag:
                continue
            tag, closing = tag.lower(), found[1] or found[4]
            block = tag in BLOCKS
            if block:
                self._block += 1
            if closing:
                if block or tag in INLINE:
                    leave((tag,))
                continue
            if tag == "br":
                self.runs.append((stack[-1][1], self._block, " "))
            if block:
                leave(("p",), ("table", "button"))
            if tag in ENDS:
                same, within = ENDS[tag]
                leave(tuple(same.split()), within)
            if tag in RAW:
                closed = re.compile(rf"</{tag}(?=[\s/>])[^>]*>", re.I).search(html, at)
                at = closed.end() if closed else len(html)
                self._enter(stack[-1][1], tag, found[3] or found[6] or "")
                continue
            if block or tag in INLINE:
                inside = stack[-1][1] if tag == "a" else self._enter(stack[-1][1], tag, found[3] or found[6] or "")
                if tag not in EMPTY:
                    stack.append((tag, inside))

    def chars(self) -> list[int]:
        """For each path the characters in it and below that HTML does not set apart."""
        out = [0] * len(self.paths)
        for path, _, text in self.runs:
            if self.apart[path] != 1:
                n = len(text.strip())
                while path >= 0:
                    out[path] += n
                    path = self.parents[path]
        return out


def _around(path: str) -> Iterator[str]:
    """The paths of all elements around one, nearest first."""
    while path:
        path = path[: path.rindex("/")]
        yield path


def _tag(path: str) -> str:
    return path.rsplit("/", 1)[-1].split(" ")[0]


def choose(elements: dict[str, tuple[int, bool, bool]]) -> tuple[str, frozenset[str]]:
    """The main element and those set apart by name, of {path: (characters, once on a page, named apart)}.

    A name says nothing about an element around the page's heading or main element, or around all of its text.  An
    element called article or main is the main one if it holds most of what is left, else the
    innermost that holds nearly all of it.
    """
    total = elements.get("", (0, True, False))[0]
    central = {outer for p, (_, _, named) in elements.items() if _tag(p) in ("h1", *MAIN) and not named for outer in _around(p)}
    apart = {p for p, (chars, _, named) in elements.items() if named and p not in central and chars <= WHOLE_SHARE * total}
    apart = frozenset(p for p in apart if not apart.intersection(_around(p)))
    left = {p: chars for p, (chars, _, _) in elements.items()}
    for path in apart:
        for outer in _around(path):
            if outer in left:
                left[outer] -= elements[path][0]
    whole = left.get("", 0)

    def inside(path: str) -> bool:
        return path in apart or bool(apart.intersection(_around(path)))

    once = [p for p, (_, single, _) in elements.items() if single and p and not inside(p)]
    for tag in MAIN:
        called = [p for p in once if _tag(p) == tag and left[p] >= MOST_SHARE * whole]
        if called:
            return max(called, key=lambda p: (left[p], len(p), p)), apart
    holding = [p for p in once if left[p] >= MAIN_SHARE * whole and _tag(p) not in ("p", "h1")]
    return (max(holding, key=lambda p: (p.count("/"), p)) if holding and whole else ""), apart


def own_template(page: Page) -> tuple[str, frozenset[str]]:
    """What ``choose`` says by a page alone: an element called article or main, else the page."""
    chars = page.chars()
    root, apart = choose({p: (chars[k], page.counts[k] == 1, page.apart[k] == 2) for k, p in enumerate(page.paths) if page.apart[k] != 1})
    return (root if _tag(root) in MAIN else ""), apart


def main_text(page: Page, root: str, apart: frozenset[str], common: frozenset[int] = frozenset()) -> str:
    """The slots' contents below ``root``, one line for each block."""
    if root not in page.paths:
        return main_text(page, *own_template(page), common)
    kept: list[tuple[bool, bool]] = []  # in the main element, in one that is set apart
    for k, path in enumerate(page.paths):
        inner = page.parents[k] >= 0 and kept[page.parents[k]][0]
        out = page.apart[k] == 1 or path in apart or (page.parents[k] >= 0 and kept[page.parents[k]][1])
        kept.append(((inner or path == root) and not out, out))
    blocks: dict[int, list[str]] = defaultdict(list)
    for path, block, text in page.runs:
        if kept[path][0]:
            blocks[block].append(text)
    lines = [line for line in (" ".join(entities.unescape("".join(b)).split()) for b in blocks.values()) if line]
    if common:
        slots = [line for line in lines if _hash(line) not in common]
        if sum(map(len, slots)) >= (1 - COMMON_SHARE) * sum(map(len, lines)):
            lines = slots
    return "\n".join(lines)


def _hash(text: str) -> int:
    """A hash as Spark's ``long``."""
    return xxhash.xxh3_64_intdigest(text.encode("utf-8", "surrogatepass")) - (1 << 63)


class _Marks:
    """What a task has seen of some hosts."""

    def __init__(self) -> None:
        self.elements: dict[tuple[str, str, bool], list[int]] = {}
        self.common: dict[str, set[int]] = {}
        self.pages: Counter = Counter()
        self.skeletons: list[dict] = []

    def add(self, host: str, page: Page, key: str) -> None:
        r1, r2 = xxhash.xxh3_64_intdigest(key, 1) >> 33, xxhash.xxh3_64_intdigest(key, 2) >> 33
        chars = page.chars()
        for k, path in enumerate(page.paths):
            if page.apart[k] != 1:
                held = self.elements.setdefault((host, path, page.apart[k] == 2), [0, 0, 0, 0, 0])
                for at, more in enumerate((r1 * page.counts[k], r2 * page.counts[k], 1, page.counts[k], chars[k])):
                    held[at] += more
        blocks: dict[int, list[str]] = defaultdict(list)
        for path, block, text in page.runs:
            if page.apart[path] != 1:
                blocks[block].append(text)
        lines = [" ".join(entities.unescape("".join(b)).split()) for b in blocks.values()]
        seen = {_hash(line) for line in lines if line}
        self.common[host] = self.common[host] & seen if host in self.common else seen
        self.pages[host] += 1
        self.skeletons.append({
            "host": host, "in_order": [_hash(p) for k, p in enumerate(page.paths) if page.apart[k] != 1], "digest": _hash("\n".join(lines))})

    def rows(self) -> list[dict]:
        out = [{"host": host, "path": path, "token": _hash(path), "named": named, "r1": r1, "r2": r2, "pages": pages, "total": total, "chars": chars}
               for (host, path, named), (r1, r2, pages, total, chars) in self.elements.items()]
        out += [{"host": host, "text": text, "pages": self.pages[host]} for host, texts in self.common.items() for text in texts]
        return out + self.skeletons


_MARKS = pa.schema([("host", pa.string()), ("path", pa.string()), ("token", pa.int64()), ("named", pa.bool_()), ("r1", pa.int64()), ("r2", pa.int64()),
                    ("pages", pa.int64()), ("total", pa.int64()), ("chars", pa.int64()), ("text", pa.int64()),
                    ("in_order", pa.list_(pa.int64())), ("digest", pa.int64())])


def _mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The marks of (host, key, html) rows."""
    marks = _Marks()
    for batch in batches:
        for host, key, html in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
            marks.add(host.as_py(), Page(html.as_py()), key.as_py())
            if len(marks.elements) + 20 * len(marks.skeletons) > HELD:
                yield pa.RecordBatch.from_pylist(marks.rows(), schema=_MARKS)
                marks = _Marks()
    if marks.skeletons:
        yield pa.RecordBatch.from_pylist(marks.rows(), schema=_MARKS)
    release()


def _template(table: pa.Table) -> pa.Table:
    """A host's template out of its elements and common texts."""
    rows = table.select(["path", "chars", "single", "named"]).to_pylist()
    root, apart = choose({r["path"]: (r["chars"], r["single"], r["named"]) for r in rows})
    common = frozenset(table.column("common")[0].as_py() or ())
    return pa.table({"host": table.column("host").slice(0, 1), "template": pa.array([pickle.dumps((root, apart, common))], pa.binary())})


def host_of(url) -> F.Column:
    """What is behind the first ``://`` of an address, in lower case; empty if there is none."""
    return F.lower(F.regexp_extract(F.coalesce(F.col(url).cast("string"), F.lit("")), r"(?s)^.*?://([^/?#]*)", 1))


def classes(marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The equivalence classes of each host, and figures of hosts.

    Elements are (host, path, token, named, class, pages, total, chars, host_pages, valid, parent); ``parent`` is the class
    around an element's.
    """
    skeletons = marks.filter("in_order is not null").select("host", "in_order", "digest")
    hosts = cut(skeletons.groupBy("host").agg(F.count("*").alias("host_pages"), F.count_distinct("digest").alias("different")), "hosts")
    total = marks.filter("path is not null").groupBy("host", "path", "token", "named").agg(
        *[F.sum(F.col(c).cast("decimal(20,0)")).alias(c) for c in ("r1", "r2")],
        *[F.sum(c).alias(c) for c in ("pages", "total", "chars")])
    elements = cut(
        join_frontier(total, hosts, "host", F.col("token")).filter(F.col("pages") * RARE >= F.col("host_pages")).select(
            "host", "path", "token", "named", F.concat_ws("-", "r1", "r2", "pages", "total").alias("class"), "pages", "total", "chars", "host_pages",
            F.concat_ws("|", F.col("token").cast("string"), "host").alias("key")),
        "elements")
    placed = skeletons.select("host", F.monotonically_increasing_id().alias("page"), F.posexplode("in_order").alias("at", "token"))
    placed = placed.withColumn("key", F.concat_ws("|", F.col("token").cast("string"), "host")).select("key", "page", "at")
    looked_up = Cut(elements.df.select("key", "host", "token", "class"), elements.rows)
    order = (
        join_frontier(placed, looked_up, "key", F.col("page"))
        .groupBy("page", "host", "class")
        .agg(F.xxhash64(F.sort_array(F.collect_list(F.struct("at", "token")))["token"]).alias("order"))
        .groupBy("host", "class").agg((F.min("order") == F.max("order")).alias("ordered"))
    )
    judged = elements.df.join(order, ["host", "class"]).withColumn(
        "valid", F.col("ordered") & (F.col("pages") >= F.lit(SUPPORT) * F.col("host_pages")))
    outer = judged.select("host", F.col("path").alias("around"), F.col("class").alias("outer"))
    nested = judged.withColumn("around", F.regexp_extract("path", r"(?s)^(.*)/[^/]*$", 1)).join(outer, ["host", "around"], "left")
    parent = F.when((F.col("path") != "") & (F.col("outer") != F.col("class")), F.col("outer")).alias("parent")
    return nested.select("host", "path", "token", "named", "class", "pages", "total", "chars", "host_pages", "valid", parent), hosts.df


def templates(marks: DataFrame) -> DataFrame:
    """(host, template) rows: the main element, elements set apart by name, common texts."""
    elements, hosts = classes(marks)
    texts = marks.filter("text is not null").groupBy("host", "text").agg(F.sum("pages").alias("pages"))
    common = (
        texts.join(hosts, "host").filter((F.col("pages") == F.col("host_pages")) & (F.col("different") >= DIFFERENT))
        .groupBy("host").agg(F.collect_list("text").alias("common"))
    )
    single = (F.col("pages") == F.col("total")) & F.col("valid")
    rows = elements.select("host", "path", "chars", single.alias("single"), "named").join(common, "host", "left")
    return rows.groupBy("host").applyInArrow(_template, "host string, template binary")


@lru_cache(maxsize=256)
def _loaded(template: bytes) -> tuple[str, frozenset[str], frozenset[int]]:
    return pickle.loads(template)


def _extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(page_id, url, html, template) rows as their main texts."""
    for batch in batches:
        texts = []
        for html, template in zip(batch.column(2), batch.column(3).to_pylist(), strict=True):
            page = Page(html.as_py())
            texts.append(main_text(page, *(_loaded(template) if template else own_template(page))))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), batch.column(1), pa.array(texts, pa.string()), pa.array(map(len, texts), pa.int64())],
            names=["page_id", "url", "text", "n_chars"])
    release()


def extract(pages: DataFrame) -> DataFrame:
    """(page_id, url, text, n_chars) for every page."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).alias("html"), host_of("url").alias("host"))
    key = F.concat_ws("|", F.col("page_id").cast("string"), "url", F.length("html").cast("string"))
    marks = cut(rows.filter("host != ''").select("host", key.alias("key"), "html").mapInArrow(_mark, MARKS), "marks").df
    found = cut(templates(marks), "templates")
    size = found.df.agg(F.sum(F.length("template"))).first()[0] or 0
    if size > TEMPLATE_BYTES:
        found = Cut(found.df, max(found.rows, BROADCAST_ROWS + 1))
    return join_frontier(rows, found, "host", F.col("page_id"), "left").select("page_id", "url", "html", "template").mapInArrow(
        _extract, "page_id long, url string, text string, n_chars long")
