"""Answers as text.  Rows are streamed to the reader, never gathered first."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.functions.text import basename
from symbolweave.plans.graph import CodeGraph


def _rows(df: DataFrame) -> Iterator:
    return df.toLocalIterator(prefetchPartitions=True)


def _table(header: list[str], rows: Iterator[list]) -> Iterator[str]:
    yield "| " + " | ".join(header) + " |"
    yield "|" + "---|" * len(header)
    for row in rows:
        yield "| " + " | ".join(str(v) for v in row) + " |"


def _or(lines: Iterator[str], nothing: str) -> Iterator[str]:
    first = next(lines, None)
    if first is None:
        yield nothing
        return
    yield first
    yield from lines


def hits(df: DataFrame, nothing: str = "No results found.") -> Iterator[str]:
    """Search results: name, place and the start of the signature."""

    def lines() -> Iterator[str]:
        for r in _rows(df):
            yield f"  {r.name} ({r.kind})"
            yield f"  {r.file_path}:{r.line_start}"
            if r.signature:
                yield f"  {r.signature[:120]}"
            yield ""

    return _or(lines(), nothing)


def neighbours(df: DataFrame, nothing: str) -> Iterator[str]:
    """Callers or callees, nearest first."""

    def lines() -> Iterator[str]:
        for r in _rows(df.orderBy("hop", "name", "id")):
            yield f"  {r.name} ({r.edge_kind})"
            yield f"  {r.file_path}:{r.line_start}"
            yield ""

    return _or(lines(), nothing)


def neighbour_table(df: DataFrame, who: str) -> Iterator[str]:
    shown = df.orderBy("hop", "name", "id").select(
        "name", "kind", "edge_kind", F.concat(basename("file_path"), F.lit(":"), "line_start")
    )
    return _table([who, "Kind", "Via", "File"], (list(r) for r in _rows(shown)))


def impact(df: DataFrame) -> Iterator[str]:
    """Nodes under a heading per depth."""

    def lines() -> Iterator[str]:
        depth = None
        for r in _rows(df.orderBy("depth", "name", "id")):
            if r.depth != depth:
                depth = r.depth
                yield f"Depth {depth}:"
            yield f"  {r.name} ({r.kind})"
            yield f"  {r.file_path}:{r.line_start}"
            yield ""

    return _or(lines(), "No impact found.")


def edge_walk(df: DataFrame, label: str, nothing: str) -> Iterator[str]:
    order = ["depth", "source_id", "target_id", "kind"]
    return _or((f"{r[label]} via {r.kind}" for r in _rows(df.orderBy(*order))), nothing)


def impact_walk(df: DataFrame) -> Iterator[str]:
    def lines() -> Iterator[str]:
        depth = None
        for r in _rows(df.orderBy("depth", "source_id", "target_id", "kind")):
            if r.depth != depth:
                depth = r.depth
                yield f"Depth {depth}:"
            yield f"  {r.source_label} -> {r.target_label} ({r.kind})"

    return _or(lines(), "No impact found.")


def trace(df: DataFrame) -> Iterator[str]:
    found = df.first()
    if found is None:
        yield "No path found between these symbols."
    else:
        yield f"**Path ({found.depth} hops):** {' → '.join(found.path)}"


def trace_walks(df: DataFrame) -> Iterator[str]:
    lines = (
        f"{r.source_id} -> {r.target_id} ({r.kind}) at {r.file_path}:{r.line_number} (depth: {r.depth})"
        for r in _rows(df)
    )
    return _or(lines, "No path found.")


def context(df: DataFrame, task: str) -> Iterator[str]:
    """Symbols that match a task, under a heading per file."""
    symbols = files = 0
    for r in _rows(df):
        if not files:
            yield f"## Context: {task}"
            yield ""
        yield f"### {r.file}"
        yield from r.lines
        yield ""
        symbols, files = symbols + r.symbols, files + 1
    if files:
        yield f"_{symbols} symbols in {files} files_"
    else:
        yield f"No symbols matching '{task}'. Try a broader query."


def ranked_context(df: DataFrame, task: str) -> Iterator[str]:
    yield f"# Code Context: {task}"
    yield ""
    for r in _rows(df):
        yield f"## {r.kind_title}: {r.name}"
        if r.signature:
            yield f"   {r.signature}"
        yield f"   File: {r.file_path}:{r.line_start}"
        yield f"   References: {r.references}"
        yield ""


def explore(df: DataFrame) -> Iterator[str]:
    def lines() -> Iterator[str]:
        for r in _rows(df):
            yield f"{r.file_path}:"
            yield from (f"  {entry}" for entry in r.entries)

    return _or(lines(), "No symbols found.")


def node(df: DataFrame) -> Iterator[str]:
    r = df.first()
    if r is None:
        yield "Node not found."
        return
    yield f"## {r.name} ({r.kind})"
    yield f"**File:** `{r.file_path}:{r.line_start}`"
    if r.signature:
        yield f"```\n{r.signature}\n```"


def repo_map(graph: CodeGraph, limit: int = 25) -> Iterator[str]:
    """Top files and top symbols as two tables."""
    files = graph.file_summary(limit).select(basename("file"), "symbols", "edges", "kinds")
    symbols = graph.top_symbols(limit).select(
        "name", "kind", F.concat(basename("file"), F.lit(":"), "line"), "refs"
    )
    yield from ["## Codebase Overview", "", "### Top files"]
    yield from _table(["File", "Symbols", "References", "Kinds"], (list(r) for r in _rows(files)))
    yield from ["", "### Top symbols"]
    yield from _table(["Symbol", "Kind", "File", "Refs"], (list(r) for r in _rows(symbols)))


def _largest_first(counts: dict[str, int]) -> list[tuple[str, int]]:
    return sorted(counts.items(), key=lambda item: (-item[1], item[0]))


def validation(df: DataFrame) -> Iterator[str]:
    r = df.first()
    yield f"Files:      {r.total_files}"
    yield f"Symbols:    {r.total_nodes}"
    yield f"Edges:      {r.total_edges}"
    for title, counts in (("kind", r.by_kind), ("edge kind", r.by_edge_kind), ("language", r.by_language)):
        yield ""
        yield f"By {title}:"
        yield from (f"  {name}: {count}" for name, count in _largest_first(counts))
    yield ""
    yield f"Parent-child relationships: {r.nodes_with_parent}"
    yield f"  ⚠  Orphan parent refs: {r.orphan_parent_refs}" if r.orphan_parent_refs else "  No orphan refs"


def status(df: DataFrame) -> Iterator[str]:
    r = df.first()
    yield f"**{r.total_files}** files · **{r.total_nodes}** symbols · **{r.total_edges}** edges"
    yield ""
    yield "By kind: " + ", ".join(f"{kind}:{count}" for kind, count in _largest_first(r.by_kind))


def similar(df: DataFrame) -> Iterator[str]:
    def lines() -> Iterator[str]:
        for r in _rows(df):
            yield f"  {r.name} ({r.kind})  similarity: {r.similarity:.3f}"
            yield f"  {r.file_path}:{r.line_start}"
            if r.signature:
                yield f"  {r.signature[:120]}"
            yield ""

    return _or(lines(), "No similar symbols found. Run `embed` first.")
