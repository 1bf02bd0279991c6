"""Parsing, file trees, logs, archives, the change stream and the command line."""

import io
import json
import os
import zipfile

import pytest
from pyspark.sql import functions as F

from symbolweave import cli, config
from symbolweave.functions import display, names, vectors
from symbolweave.operators import rank, similar, upsert
from symbolweave.plans.graph import CodeGraph
from symbolweave.plans.parse import _scopes, index_counts, parse, parsed_edges, parsed_nodes
from symbolweave.schema import EDGES, NODES
from symbolweave.sources import dependency_maps, repos, runlog, scip, store, tree
from symbolweave.sources.tree import LANGUAGE_OF, language_of
from symbolweave.streaming import watch

# One small file per language: its text, and its symbols as (name, kind, first line).
SAMPLES = {
    "queue.py": (
        "import heapq\n\n\nclass Queue:\n    def push(self, job):\n        heapq.heappush(self.jobs, job)\n\n\n"
        "async def drain(queue):\n    return queue\n",
        {("Queue", "class", 4), ("Queue.push", "method", 5), ("drain", "function", 9)}),
    "cart.ts": (
        "interface Item {\n  price: number;\n}\n\nclass Cart {\n  total(items: Item[]): number {\n    return sum(items);\n"
        "  }\n}\n\nfunction sum(items: Item[]): number {\n  return 0;\n}\n",
        {("Item", "interface", 1), ("Cart", "class", 5), ("Cart.total", "method", 6), ("sum", "function", 11)}),
    "panel.jsx": (
        "class Panel {\n  render() {\n    return draw(this);\n  }\n}\nfunction draw(panel) {\n  return panel;\n}\n",
        {("Panel", "class", 1), ("Panel.render", "method", 2), ("draw", "function", 6)}),
    "tide.go": (
        "package tide\n\ntype Gauge struct {\n\tlevel int\n}\n\nfunc (g *Gauge) Read() int {\n\treturn g.level\n}\n\n"
        "func open(name string) *Gauge {\n\treturn nil\n}\n",
        {("Gauge", "class", 3), ("Read", "method", 7), ("open", "function", 11)}),
    "Valve.java": (
        "interface Port {}\n\npublic class Valve {\n    private int turns;\n\n    public void close(int by) {\n        turns += by;\n"
        "    }\n}\n",
        {("Port", "interface", 1), ("Valve", "class", 3), ("Valve.close", "method", 6)}),
    "orbit.rs": (
        "pub struct Orbit {\n    period: f64,\n}\n\npub fn decay(orbit: &Orbit) -> f64 {\n    orbit.period\n}\n",
        {("Orbit", "class", 1), ("decay", "function", 5)}),
    "kiln.rb": (
        "class Kiln\n  def fire(degrees)\n    warm degrees\n  end\nend\n\ndef warm(degrees)\n  degrees\nend\n",
        {("Kiln", "class", 1), ("fire", "function", 2), ("warm", "function", 7)}),
    "loom.php": (
        "<?php\ninterface Thread {}\n\nclass Loom {\n    public $width = 3;\n}\n\nfunction weave($rows) {\n    return $rows;\n}\n",
        {("Thread", "interface", 2), ("Loom", "class", 4), ("weave", "function", 8)}),
    "ring.h": (
        "struct ring {\n    int size;\n};\n\nint ring_next(struct ring *r) {\n    return r->size;\n}\n",
        {("ring", "class", 1), ("ring_next", "function", 5)}),
    "lathe.cc": (
        "class Lathe {\n    int speed;\n};\n\nint spin(int by) {\n    return by;\n}\n",
        {("Lathe", "class", 1), ("spin", "function", 5)}),
    "Dune.swift": (
        "struct Dune {\n    func shift() -> Int {\n        return 1\n    }\n}\n\nfunc blow(dune: Dune) -> Int {\n    return dune.shift()\n}\n",
        {("Dune", "class", 1), ("Dune.shift", "method", 2), ("blow", "function", 7)}),
    "grove.kts": (
        "class Grove {\n    fun prune(by: Int): Int {\n        return by\n    }\n}\n\nfun plant(count: Int): Grove {\n    return Grove()\n}\n",
        {("Grove", "class", 1), ("Grove.prune", "method", 2), ("plant", "function", 7)}),
    "mill.sc": (
        "class Mill {\n  def grind(sacks: Int): Int = {\n    sacks\n  }\n}\n\ndef build(): Mill = {\n  make()\n}\n",
        {("Mill", "class", 1), ("Mill.grind", "method", 2), ("build", "function", 7)}),
}
NESTED = """\
class Outer:
    class Inner:
        def deep(self):
            text = '''
def not_here(): pass
'''
            return helper(
    text)

        def after(self): pass
    value = 1


def last():
    # def commented(): pass
    return "def quoted(): pass"
"""


def files(spark, pairs):
    rows = spark.createDataFrame([(p, t) for p, t in pairs], "path string, text string")
    return rows.withColumn("language", language_of("path"))


def test_every_language_yields_its_symbols(spark):
    found = parsed_nodes(parse(files(spark, [(f"/s/{name}", text) for name, (text, _) in SAMPLES.items()])))
    symbols = {}
    for r in found.collect():
        symbols.setdefault(r.file_path, set()).add((r.name.split(":")[-1], r.kind, r.line_start))
    assert symbols == {f"/s/{name}": wanted for name, (_, wanted) in SAMPLES.items()}
    assert len(LANGUAGE_OF) == 21 and len(set(LANGUAGE_OF.values())) == 12


def test_nested_scopes_and_text_that_is_no_code(spark):
    parsed = parse(files(spark, [("/s/n.py", NESTED)]))
    rows = {r.name.split(":")[-1]: r for r in parsed_nodes(parsed).collect()}
    assert {k: (r.kind, r.line_start, r.line_end) for k, r in rows.items()} == {
        "Outer": ("class", 1, 11), "Outer.Inner": ("class", 2, 10),
        "Inner.deep": ("method", 3, 8), "Inner.after": ("method", 10, 10), "last": ("function", 14, 16),
    }
    # the inner class is known by its own name only, so its methods' parent is no node
    assert rows["Inner.deep"].parent_id == "/s/n.py:Inner"
    assert rank.orphan_parents(parsed_nodes(parsed)).first().children == 2
    assert {(r.target_id, r.line_number) for r in parsed_edges(parsed).collect()} == {("helper", 7)}
    assert rows["last"].signature.startswith("def last(): # def commented()")


def test_files_with_nothing_to_find(spark):
    pairs = [("/e.py", ""), ("/b.py", "def broken(:\n  x = (\n"), ("/x.xyz", "def a(): pass"), ("/u.ts", "}}} class")]
    names = [r.name for r in parsed_nodes(parse(files(spark, pairs))).collect()]
    assert names in ([], ["broken"])


def test_scope_matching():
    assert _scopes("\nd(){\n}\nd(){}", []) == [[1, 2, -1, 0], [3, 3, -1, 0]]
    assert _scopes("\nC{d(){}A{d(){}}}", []) == [[1, 1, -1, 0], [1, 1, 0, 1], [1, 1, 0, 1], [1, 1, 0, 1]]
    assert _scopes("\nX{d(){}}", [])[1][3] == 2


def make_tree(tmp_path):
    root = tmp_path / "tree"
    (root / "pkg").mkdir(parents=True)
    (root / "node_modules").mkdir()
    (root / "pkg" / "app.py").write_text("import os\n\n@app.route('/home')\ndef home():\n    return run(os)\n")
    (root / "pkg" / "web.ts").write_text("export class Page { show() { home(); } }\n")
    (root / "pkg" / "UPPER.PY").write_text("def skipped(): pass\n")
    (root / "pkg" / "bad.py").write_bytes(b"\xff\xfe def x")
    (root / "node_modules" / "dep.js").write_text("function dep() {}\n")
    return root


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory):
    tmp = tmp_path_factory.mktemp("graph")
    root = make_tree(tmp)
    graph = CodeGraph(spark, str(tmp / "graph"), buckets=2)
    counts = graph.index(str(root), with_routes=True).first()
    return graph, root, counts


def test_index_counts(indexed):
    graph, root, counts = indexed
    assert counts.asDict() == {"files_indexed": 2, "files_failed": 1, "symbols_found": 3, "edges_found": 4}
    assert {r.name.split(":")[-1] for r in graph.nodes.collect()} == {"home", "Page", "Page.show", "/home"}
    route = graph.node(f"{root}/pkg/app.py:route:/home").first()
    assert (route.kind, route.signature) == ("route", "flask: /home")
    detail = graph.node_with_source(f"{root}/pkg/app.py:home", str(root)).first()
    assert detail.source.startswith("import os")


def test_command_line_answers(indexed):
    graph, root, _ = indexed
    out = io.StringIO()
    cli.serve(graph, ["ping\n", "\n", "search home\n", "callers nobody\n", "search a.b\n", "what now\n"], out)
    replies = out.getvalue().split(cli.SEPARATOR)
    assert replies[0] == "pong" and "  home (function)" in replies[1]
    assert replies[2] == "No callers found." and replies[3].startswith("error: ")
    assert replies[4] == "unknown: what"
    run = lambda *words: "\n".join(cli.run(graph, cli._parser().parse_args(words), []))
    assert "Files:      2" in run("validate") and "By kind: " in run("status")
    assert "| app.py | 2 | 3 | function,route |" in run("map")
    assert "### web.ts" in run("context", "page")
    assert "No path found" in run("trace", "a", "b")
    assert f"{root}/pkg/app.py via calls" in run("callers-edges", "run", "--depth", "0")
    assert run("embed") == "Embedded 4 symbols."
    assert run("similar", "page show").splitlines()[0].startswith("  ")


def test_archives_are_indexed_like_trees(spark, tmp_path):
    with zipfile.ZipFile(tmp_path / "repo.zip", "w") as archive:
        archive.writestr("own-repo-abc/src/m.py", "def inside(): pass\n")
        archive.writestr("own-repo-abc/build/no.py", "def outside(): pass\n")
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=2)
    assert cli.analyze(graph, str(tmp_path)) == 1
    assert [r.id for r in graph.nodes.collect()] == ["repo/src/m.py:inside"]
    with pytest.raises(Exception, match="archive too large"):
        repos.read_archives(spark, str(tmp_path), largest_mb=0).count()


def test_archive_entries_are_dealt_over_tasks(spark, tmp_path, monkeypatch):
    made = {f"top/d{k}/f{k}.py": f"def f{k}(): pass  # é\n" * (k + 1) for k in range(40)}
    for name, method in (("a.zip", zipfile.ZIP_DEFLATED), ("sub/b.zip", zipfile.ZIP_STORED), ("c.zip", zipfile.ZIP_BZIP2)):
        (tmp_path / name).parent.mkdir(exist_ok=True)
        with zipfile.ZipFile(tmp_path / name, "w", method) as archive:
            archive.mkdir("top/empty")
            for path, text in made.items():
                archive.writestr(path, text)
    monkeypatch.setattr(repos, "ENTRIES_PER_TASK", 10)
    found = repos.read_archives(spark, str(tmp_path))
    assert found.rdd.getNumPartitions() == 13
    wanted = {(a, path.split("/", 1)[1], text) for a in "abc" for path, text in made.items()}
    assert {tuple(r) for r in found.collect()} == wanted and found.count() == 120
    one = found.filter("archive = 'a'").select(F.spark_partition_id().alias("p")).distinct().count()
    assert one > 5  # several tasks read one archive


def test_repository_cache(spark, tmp_path):
    entry = tmp_path / "k1"
    (entry / "repo").mkdir(parents=True)
    (entry / "manifest.json").write_text(json.dumps({"url": "o/r", "branch": "main", "commit": "abc", "cloned_at": 1.0}))
    (entry / "repo" / "f").write_text("12345")
    held = repos.read_manifests(spark, str(tmp_path))
    sizes = repos.read_cache_files(spark, str(tmp_path))
    assert held.first().commit == "abc"
    freed = repos.expired(held, sizes, "2100-01-01 00:00:00").first()
    assert freed.key == "k1" and freed.bytes == 5 + (entry / "manifest.json").stat().st_size
    assert repos.expired(held, sizes, "2000-01-01 00:00:00").count() == 0


def test_indexer_json(spark, tmp_path):
    occ = lambda s, r=None: {"symbol": s, **({} if r is None else {"symbol_roles": r})}
    (tmp_path / "index.json").write_text(json.dumps({"documents": [
        {"relative_path": "a.py", "occurrences": [occ("p a/main().", 0), occ("p b/Helper#process().", 0)]},
        {"relative_path": "b.py", "occurrences": [occ("p b/Helper#", 1), occ("p b/Helper#process().", 1), occ("p b/Helper#")],
         "symbols": [{"symbol": "p b/Helper#"}]},
    ]}))
    stored = spark.createDataFrame([], NODES)
    nodes, edges, counts = scip.convert(scip.read_index(spark, str(tmp_path / "index.json")), "/r", stored)
    assert {(r.id, r.kind, r.language) for r in nodes.collect()} == {
        ("/r/b.py:Helper", "class", "python"), ("/r/b.py:Helper.process", "method", "python")}
    assert {(r.source_id, r.target_id, r.kind) for r in edges.collect()} == {
        ("/r/a.py", "/r/b.py:Helper.process", "calls"), ("/r/b.py", "/r/b.py:Helper", "references")}
    assert counts.first().asDict() == {"nodes_added": 2, "references_resolved": 2}


def test_symbols_are_taken_apart_once(spark, monkeypatch):
    """What a symbol says is kept with its mention, by methods the JVM compiles; odd texts say what they did."""
    seen, cut_, limit = [], scip.cut, "spark.sql.codegen.hugeMethodLimit"
    monkeypatch.setattr(scip, "cut", lambda df, label: seen.append(
        (df._jdf.queryExecution().optimizedPlan().toString().count("substring_index"), int(spark.conf.get(limit)))) or cut_(df, label))
    before = spark.conf.get(limit)
    documents = spark.createDataFrame([(0, "a.py", [("p a/f().", 1), ("p a/f().", 0)], [("p a/C#",)])], "doc_no long, relative_path string, occurrences array<struct<symbol string, symbol_roles int>>, symbols array<struct<symbol string>>")
    nodes, edges, _ = scip.convert(documents, "/r", spark.createDataFrame([], NODES))
    assert {r.id for r in nodes.collect()} == {"/r/a.py:f", "/r/a.py:C"} and edges.count() == 1
    assert seen[0][0] > 0 and not any(n for n, _ in seen[1:]) and seen[0][1] <= 8000 and spark.conf.get(limit) == before
    odd = {"p a/`f.py`/C#": ("C", "class"), "a/C#m().": ("C.m", "method"), "a/C#m().(x)": None, "a/C#x)).": ("C.x))", "method"), "a/C#m..)\n": ("C.m\n", "method"),
           "a/C#m)\nn)": ("C.m)\nn", "method"), "a/f().g().": ("f().g", "function"), "a/f().g": ("f", "method"), "a/f(+1).": ("f", "function"), "a/é().": ("é", "function"),
           "a/v`": ("v", "symbol"), "a/d/": None, "": None, "().": None}
    found = spark.createDataFrame([(k,) for k in odd], "s string").select("s", names.indexed_symbol("s").alias("n"))
    assert {r.s: r.n and tuple(r.n) for r in found.collect()} == odd


def test_marks_are_found_once(spark):
    """The optimizer does not copy the search for marks into each use, and counting parses a file once."""
    files = spark.createDataFrame([("/q.py", "python", "class A:\n    def f(self):\n        g()\n", None)], "path string, language string, text string, error string")
    parsed = parse(files)
    plan = parsed_nodes(parsed)._jdf.queryExecution().optimizedPlan().toString()
    assert "nest(array_join(marks" in plan
    counted = index_counts(files, parsed)
    assert counted._jdf.queryExecution().optimizedPlan().toString().count("nest(") == 1
    assert counted.first().asDict() == {"files_indexed": 1, "files_failed": 0, "symbols_found": 2, "edges_found": 1}


def test_dependency_maps(spark):
    used = spark.createDataFrame([("/a.py", {"_": ["os.path"], "f": ["g", "g"]})], dependency_maps.USAGES)
    assert {tuple(r)[:3] for r in dependency_maps.usage_edges(used).collect()} == {
        ("/a.py", "os.path", "imports"), ("/a.py:f", "g", "calls")}


def test_run_logs_and_medians(spark, tmp_path):
    log = tmp_path / "with-1.json"
    log.write_text("\n".join(json.dumps(e) for e in [
        {"type": "text", "timestamp": 10.0},
        {"type": "tool_use"},
        {"type": "step_finish", "timestamp": 12.5, "part": {"cost": 0.5, "tokens": {"total": 100, "cache": {"read": 7}}}},
        {"type": "step_finish", "timestamp": 11.0, "part": {"cost": 0.25, "tokens": {"total": 50, "cache": {"read": 3}}}},
    ]))
    row = runlog.run_totals(runlog.read_run_logs(spark, str(log))).first()
    assert (row.cost, row.tokens, row.tool_calls, row.time_seconds, row.cache_reads) == (0.75, 150, 1, 1.0, 10)
    values = [("odd", v) for v in (50, 10, 30, 20, 40)] + [("even", v) for v in (10, 20, 30, 40)] + [("same", 3)] * 6
    rows = spark.createDataFrame(values, "g string, v int")
    assert {r.g: r.median for r in runlog.exact_medians(rows, ["g"], "v").collect()} == {"odd": 30, "even": 25, "same": 3}


def test_shown_numbers(spark):
    row = spark.range(1).select(
        display.savings(F.lit(50.0), F.lit(100.0)).alias("half"), display.savings(F.lit(1.0), F.lit(0.0)).alias("none"),
        display.amount(F.lit(1_590_000.0)).alias("m"), display.amount(F.lit(1_590.0)).alias("k"),
        display.duration(F.lit(125.0)).alias("t"), display.cost(F.lit(1.5)).alias("c"),
    ).first()
    assert tuple(row) == ("50.0% ↓", "N/A", "1.5M", "1.5k", "2m 05s", "$1.50")


def test_vectors(spark):
    rows = spark.createDataFrame(
        [("zero", [0.0, 0.0, 0.0]), ("short", [3.0, 4.0]), ("same", [1.0, 2.0, 2.0]), ("long", [1.0, 2.0, 2.0, 4.0])],
        "node_id string, vector array<float>",
    )
    found = {r.node_id: r.similarity for r in similar.similar_vectors(rows, [1.0, 2.0, 2.0], 10).collect()}
    assert found == pytest.approx({"zero": 0.0, "short": 11 / 15, "same": 1.0, "long": 9 / 15})
    query = F.array(*[F.lit(x) for x in (1.0, 2.0, 2.0)])
    by_columns = {r.node_id: r.s for r in rows.select("node_id", vectors.cosine(F.col("vector"), query).alias("s")).collect()}
    assert by_columns == pytest.approx(found)
    back = rows.select(vectors.unpack_floats(vectors.pack_floats("vector")).alias("v"), "vector").collect()
    assert all(r.v == r.vector for r in back)


def test_embedders_run_in_batches(spark, make_graph):
    nodes, _ = make_graph("abc", [])

    def make():
        return lambda texts: [[float(len(t)), float(len(texts))] for t in texts]

    rows = similar.index_embeddings(nodes.coalesce(1), make, "lengths", batch=2).collect()
    assert {r.node_id: r.vector for r in rows} == {"a": [15, 2], "b": [15, 2], "c": [15, 1]}
    assert rows[0].model == "lengths" and rows[0].dimensions == 2


def test_upserts_and_deletes(spark, make_graph):
    nodes, edges = make_graph("ab", [("a", "b"), ("/a.py", "os", "imports")])
    twice = nodes.filter("id = 'a'").select("*", F.lit(1).alias("seq")).unionByName(
        nodes.filter("id = 'a'").withColumn("kind", F.lit("class")).withColumn("seq", F.lit(2)))
    merged = {r.id: r.kind for r in upsert.upsert_nodes(nodes, twice, ["seq"]).collect()}
    assert merged == {"a": "class", "b": "function"}
    kept_nodes, kept_edges = upsert.delete_file(nodes, edges, "/a.py")
    assert [r.id for r in kept_nodes.collect()] == ["b"]
    assert [r.source_id for r in kept_edges.collect()] == ["/a.py"]
    edges = edges.withColumn("file_path", F.lit("/a.py"))
    assert upsert.delete_file(nodes, edges, "/a.py", purge_file_edges=True)[1].count() == 0
    paths = spark.createDataFrame([("/a.py",)], "file_path string")
    assert upsert.delete_files(nodes, edges, paths)[1].count() == 1
    held = spark.createDataFrame([("a",), ("b",)], "node_id string")
    assert [r.node_id for r in upsert.delete_embeddings_of(held, kept_nodes).collect()] == ["b"]


def test_change_stream(spark, tmp_path):
    base = spark.createDataFrame(
        [("/a.py:old", "/a.py", "old", "function", "", 1, 1, None, "python", "{}"),
         ("/k.py:kept", "/k.py", "kept", "function", "", 1, 1, None, "python", "{}")], NODES)
    links = spark.createDataFrame([("/k.py:kept", "/a.py:old", "calls", "/k.py", 1)], EDGES)
    log = watch.start_log(base, links, str(tmp_path / "log"))
    events = tmp_path / "events"
    events.mkdir()

    def send(name, rows):
        (events / name).write_text("\n".join(json.dumps(dict(zip(("path", "op", "ts", "text"), r))) for r in rows))
        stream = spark.readStream.schema(watch.EVENTS).json(str(events))
        watch.watch(stream, log, str(tmp_path / "checkpoint"), available_now=True).awaitTermination()
        nodes, edges = watch.current_graph(spark, log)
        return {r.name for r in nodes.collect()}, edges.count()

    at = "2024-01-01T00:00:0"
    first = send("1.json", [
        ("/a.py", "modified", at + "1Z", "def mid(): pass\n"), ("/a.py", "modified", at + "2Z", "def new():\n  kept()\n"),
        ("/n.rb", "created", at + "3Z", "def no; end\n")])
    assert first == ({"new", "kept"}, 1)
    assert send("2.json", [("/a.py", "deleted", at + "4Z", None), ("/b.go", "created", at + "5Z", "func B() {}\n")]) == (
        {"kept", "B"}, 1)
    compacted = watch.compact(spark, log, str(tmp_path / "log2"))
    assert {r.name for r in watch.current_graph(spark, compacted)[0].collect()} == {"kept", "B"}


def test_debounce_on_a_stream(spark, tmp_path):
    events = tmp_path / "events"
    events.mkdir()
    rows = [("/a.py", "created", "00.000"), ("/a.py", "modified", "00.300"), ("/a.py", "deleted", "02.000"),
            ("/z.py", "created", "59.000")]
    lines = [json.dumps({"path": p, "op": o, "ts": f"2024-01-01T00:00:{t}Z", "text": ""}) for p, o, t in rows]
    (events / "1.json").write_text("\n".join(lines))
    stream = spark.readStream.schema(watch.EVENTS).json(str(events))
    query = (watch.debounced_stream(stream, late="1 second").writeStream.format("memory").queryName("bursts")
             .outputMode("append").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start())
    query.awaitTermination()
    found = {(r.op, r.cleared) for r in spark.table("bursts").filter("path = '/a.py'").collect()}
    assert found == {("modified", True), ("deleted", True)}


def test_options(tmp_path, monkeypatch):
    path = tmp_path / "o.yml"
    path.write_text("data_dir: /data\nuse_scip: true\nunknown: 1\n")
    monkeypatch.setenv("SYMBOLWEAVE_WATCH_EXTENSIONS", ".py,.go")
    monkeypatch.setenv("SYMBOLWEAVE_DATA_DIR", "/env")
    options = config.load_options(str(path))
    assert options.graph_dir == "/env/graph" and options.use_scip
    assert options.watch_extensions == [".py", ".go"] and options.languages == ["python", "typescript", "go"]


def test_scan_finds_every_file_once_under_its_own_path(spark, tmp_path):
    root = tmp_path / "build" / "pkg"
    names = ["__init__.py", "_private.py", "_lib/m.py", ".tool/run.py", "sub/pkg/m.py", "m.py", "a/b/c/d/e.go"]
    for name in names:
        (root / name).parent.mkdir(parents=True, exist_ok=True)
        (root / name).write_text("x = 1\n")
    hidden = root / "node_modules" / "big.js"
    hidden.parent.mkdir()
    hidden.write_text("no")
    hidden.chmod(0)
    (root / "note.txt").write_text("no")
    wanted = sorted(f"{root}/{n}" for n in names)
    for spelled in (str(root), f"{root}/", f"{tmp_path}/./build/pkg", f"{tmp_path}/build/../build/pkg"):
        assert sorted(r.path for r in tree.read_tree(spark, spelled).collect()) == wanted


def test_graph_survives_writes(spark, tmp_path, monkeypatch):
    for name, text in (("one/a.py", "def a(): pass\n"), ("two/b.py", "def b(): pass\n")):
        (tmp_path / name).parent.mkdir()
        (tmp_path / name).write_text(text)
    graph = CodeGraph(spark, str(tmp_path / "graph"), buckets=2)
    graph.init().index(str(tmp_path / "one"))
    graph.index(str(tmp_path / "two"))
    names = lambda: {r.name.split(":")[-1] for r in graph.nodes.collect()}
    assert names() == {"a", "b"}
    graph.init()
    assert names() == {"a", "b"}
    written = []

    def failing(rows, folder, table, buckets):
        written.append(table)
        if len(written) == 2:
            raise OSError("killed")
        return write(rows, folder, table, buckets)

    write = store._write
    monkeypatch.setattr(store, "_write", failing)
    with pytest.raises(OSError):
        graph.delete_file(f"{tmp_path}/one/a.py")
    assert names() == {"a", "b"}
    monkeypatch.undo()
    graph.delete_file(f"{tmp_path}/one/a.py")
    assert names() == {"b"}
    assert store.remove_old(spark, graph.folder) >= 2 and names() == {"b"}


def test_every_node_has_a_vector(spark, make_graph):
    nodes, _ = make_graph(["a"], [])
    bare = nodes.withColumns({"id": F.lit("_"), "name": F.lit("_"), "signature": F.lit("")})
    found = similar.hashed_embeddings(nodes.unionByName(bare)).collect()
    assert {r.node_id: any(r.vector) for r in found} == {"a": True, "_": False}


def test_no_indent_and_no_nesting_hides_a_symbol(spark):
    blanks = " " * 60
    parsed = parse(files(spark, [
        ("/d/a.py", f"def f():\n    if f:\n{blanks}import deepmod\n{blanks}from far.away import thing\n"),
        ("/d/b.ts", f"{blanks}import {{ one }} from 'lib';\nfunction wide(a = g(h(i(1)))) {{ return a; }}\n"
                    "function cb(c: (e: (k: string) => void) => void) { c(1); }\n"
                    "class T { run(cb: (e: (k: string) => void) => void) { cb(2); } }\n"),
        ("/d/C.java", f"{blanks}import a.b.Deep;\nclass C {{ void run(@X(a = @Y(b = @Z(1))) int p) {{ p(); }} }}\n"),
    ]))
    names = {r.name.split(":")[-1] for r in parsed_nodes(parsed).collect()}
    assert names == {"f", "wide", "cb", "T", "T.run", "C", "C.run"}
    imports = {r.target_id for r in parsed_edges(parsed).filter("kind = 'imports'").collect()}
    assert imports == {"deepmod", "thing", "one", "lib", "a.b.Deep"}


def test_callers_after_parsing(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "m.py").write_text("def low(): pass\n\ndef high():\n    return low()\n")
    graph = CodeGraph(spark, str(tmp_path / "graph"), buckets=2)
    graph.index(str(tmp_path / "src"))
    low = f"{tmp_path}/src/m.py:low"
    assert graph.edges.filter("kind = 'calls'").first().target_id == "low"
    graph.resolve()
    assert graph.edges.filter("kind = 'calls'").first().target_id == low
    assert graph.nodes.count() == 2


def test_a_scope_leaves_no_table_behind(spark):
    from symbolweave.lineage import cut, scope

    with scope(spark):
        inner = cut(spark.range(3), "inner").df
        path = inner.inputFiles()[0]
        assert inner.count() == 3
    assert not os.path.exists(path.removeprefix("file://"))
