"""Command line: build a graph from sources and ask it questions."""

from __future__ import annotations

import argparse
import sys
import time
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from symbolweave.config import load_options
from symbolweave.lineage import cut
from symbolweave.plans import reports
from symbolweave.plans.graph import CodeGraph
from symbolweave.plans.parse import parse, parsed_edges, parsed_nodes
from symbolweave.session import cluster_session
from symbolweave.sources.repos import read_archives
from symbolweave.sources.tree import is_source, language_of

SEPARATOR = "\n---\n"


def answer(graph: CodeGraph, command: str, text: str) -> Iterator[str]:
    """One line of the line protocol: a command word and the rest of the line."""
    if command == "ping":
        return iter(["pong"])
    if command == "search":
        return reports.hits(graph.search(text), "No symbols found.")
    if command == "callers":
        return reports.neighbours(graph.callers(text), "No callers found.")
    if command == "impact":
        return reports.impact(graph.impact(text))
    if command == "context":
        return reports.ranked_context(graph.ranked_context(), text)
    if command == "similar":
        return reports.similar(graph.similar_text(text))
    return iter([f"unknown: {command}"])


def serve(graph: CodeGraph, lines=sys.stdin, out=sys.stdout) -> None:
    """Answer "command text" lines on standard input until it ends."""
    for line in lines:
        if not line.strip():
            continue
        command, _, text = line.strip().partition(" ")
        try:
            for k, told in enumerate(answer(graph, command, text.strip())):
                out.write(f"\n{told}" if k else told)
        except ValueError as bad_query:
            out.write(f"error: {bad_query}")
        out.write(SEPARATOR)
        out.flush()


def _parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="symbolweave", description=__doc__)
    top.add_argument("--data-dir", help="where graphs are kept")
    top.add_argument("--config", help="a YAML file of options")
    commands = top.add_subparsers(dest="command", required=True)

    def add(name: str, *words: str, **numbers: int) -> argparse.ArgumentParser:
        sub = commands.add_parser(name)
        for word in words:
            sub.add_argument(word)
        for option, default in numbers.items():
            sub.add_argument(f"--{option}", type=int, default=default)
        return sub

    add("init")
    index = add("index", "path")
    index.add_argument("--routes", action="store_true", help="also find web routes")
    index.add_argument("--scip-json", help="JSON output of a symbol indexer to merge")
    follow = add("watch", "path", seconds=2)
    follow.add_argument("--once", action="store_true", help="bring the graph up to date and stop")
    add("search", "query", limit=20).add_argument("--kind")
    add("prefix", "query", limit=50).add_argument("--kind")
    for name in ("callers", "callees"):
        add(name, "node_id", depth=1)
        add(f"{name}-edges", "node_id", depth=1)
    for name in ("impact", "impact-edges"):
        add(name, "node_id", depth=3)
    add("trace", "source", "target")
    add("trace-walks", "source", "target")
    add("node", "node_id")
    add("context", "task", limit=15)
    add("explore", "query")
    add("map", limit=25)
    add("validate")
    add("status")
    add("embed")
    add("similar", "query", limit=10)
    add("export", "folder")
    add("analyze", "archives")
    add("serve")
    return top


def run(graph: CodeGraph, args: argparse.Namespace, extensions: list[str]) -> Iterator[str]:
    name = args.command
    if name == "init":
        graph.init()
        return iter([f"Initialized in {graph.folder}"])
    if name == "index":
        found = graph.index(args.path, extensions or None, args.routes, args.scip_json).first()
        return iter([f"Files indexed: {found.files_indexed}", f"Symbols found: {found.symbols_found}",
                     f"Edges found: {found.edges_found}"])
    if name == "watch":
        return follow(graph, args.path, extensions or None, args.seconds, args.once)
    if name == "analyze":
        return iter([f"Files unpacked: {analyze(graph, args.archives)}"])
    if name == "embed":
        return iter([f"Embedded {graph.embed()} symbols."])
    if name == "export":
        graph.export(args.folder)
        return iter([f"Exported to {args.folder}"])
    answers = {
        "search": lambda: reports.hits(graph.search(args.query, args.kind, args.limit)),
        "prefix": lambda: reports.hits(graph.search_prefix(args.query, args.kind, args.limit)),
        "callers": lambda: reports.neighbours(graph.callers(args.node_id, args.depth), "No callers found."),
        "callees": lambda: reports.neighbours(graph.callees(args.node_id, args.depth), "No callees found."),
        "callers-edges": lambda: reports.edge_walk(
            graph.caller_edges(args.node_id, args.depth), "source_label", "No callers found."),
        "callees-edges": lambda: reports.edge_walk(
            graph.callee_edges(args.node_id, args.depth), "target_label", "No callees found."),
        "impact": lambda: reports.impact(graph.impact(args.node_id, args.depth)),
        "impact-edges": lambda: reports.impact_walk(graph.impact_edges(args.node_id, args.depth)),
        "trace": lambda: reports.trace(graph.trace(args.source, args.target)),
        "trace-walks": lambda: reports.trace_walks(graph.trace_walks(args.source, args.target)),
        "node": lambda: reports.node(graph.node(args.node_id)),
        "context": lambda: reports.context(graph.context(args.task, args.limit), args.task),
        "explore": lambda: reports.explore(graph.explore(args.query)),
        "map": lambda: reports.repo_map(graph, args.limit),
        "validate": lambda: reports.validation(graph.validate()),
        "status": lambda: reports.status(graph.validate()),
        "similar": lambda: reports.similar(graph.similar_text(args.query, args.limit)),
    }
    return answers[name]()


def follow(graph: CodeGraph, root: str, extensions: list[str] | None, seconds: int, once: bool) -> Iterator[str]:
    """Keep a graph like a source tree, until stopped."""
    state = f"{graph.folder}/watch"
    while True:
        changed = graph.watch(root, state, extensions)
        if changed or once:
            yield f"Files changed: {changed}"
        yield from (f"Not read: {r.path} ({r.error})" for r in graph.bad_files(state).limit(100).toLocalIterator() if changed)
        if once:
            return
        time.sleep(seconds)


def analyze(graph: CodeGraph, archives: str) -> int:
    """Index the sources inside fetched repository archives; returns their number."""
    texts = read_archives(graph.spark, archives).filter(is_source("path"))
    unpacked = texts.select(
        F.concat("archive", F.lit("/"), "path").alias("path"), language_of("path").alias("language"), "text"
    )
    files = cut(unpacked, "unpacked")
    parsed = cut(parse(files.df), "parsed").df
    graph.merge(parsed_nodes(parsed), parsed_edges(parsed))
    return files.rows


def main(argv: list[str] | None = None) -> None:
    args = _parser().parse_args(argv)
    options = load_options(args.config)
    folder = f"{args.data_dir.rstrip('/')}/graph" if args.data_dir else options.graph_dir
    spark = SparkSession.getActiveSession() or cluster_session()
    if not args.data_dir and options.data_dir.startswith("~") and not spark.sparkContext.master.startswith("local"):
        raise SystemExit("on a cluster, name a folder that all machines share with --data-dir")
    graph = CodeGraph(spark, folder, options.buckets)
    if args.command == "serve":
        serve(graph)
        return
    for line in run(graph, args, options.watch_extensions):
        print(line)


if __name__ == "__main__":
    main()
