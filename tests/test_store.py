"""The saved graph under change: buckets that are written anew, readers of older states, the index over words."""

import contextlib
import os
import random

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from symbolweave import lineage
from symbolweave.functions.text import words
from symbolweave.lineage import cut
from symbolweave.operators import fulltext, postings, rank, upsert
from symbolweave.plans.graph import CodeGraph
from symbolweave.schema import EDGE_COLUMNS, EDGE_KEY, EDGES, NODE_COLUMNS, NODES
from symbolweave.sources import store

WORDS = "load save config Total über naïve x y parse_tree HTTPServer find".split()


def made(spark, seed, ids, files=5):
    rng = random.Random(seed)
    nodes = [(f"n{i}", f"/f{rng.randrange(files)}.py", "_".join(rng.sample(WORDS, 2)), rng.choice(["function", "class"]),
              " ".join(rng.choices(WORDS, k=rng.randrange(6))) or None, i, i + 1, None, "python", rng.choice(["{}", '{"a": "save"}', None]))
             for i in ids]
    links = {(f"n{rng.choice(ids)}", f"n{rng.choice(ids)}", rng.choice(["calls", "imports"])) for _ in range(2 * len(ids))}
    edges = [(*link, f"/f{rng.randrange(files)}.py", seed) for link in sorted(links)]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(edges, EDGES)


def rows(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


QUERIES = ["save config", "save OR total", '"parse tree" OR tot*', "load NOT save", "naive uber", "name:x OR signature:y",
           'metadata:"a save"', "nothing"]


def agree(graph, queries=QUERIES, parts=("SAVE_con", "ind parse over", "fi", "/F1")):
    """All tables say the same, and the index finds what a scan of the nodes finds."""
    held = store.load_graph(graph.spark, graph.folder)
    nodes = held.nodes.cache()
    assert rows(held.links.by_source, EDGE_COLUMNS) == rows(held.links.by_target, EDGE_COLUMNS)
    assert rows(held.members, ["file_path", "id"]) == rows(nodes, ["file_path", "id"])
    assert rows(held.degrees, ["id", "edge_count"]) == rows(rank.in_degrees(held.edges), ["id", "edge_count"])
    ranked = rank.ranked_by(held.bucketed_nodes, held.degrees, 7).select("id", "edge_count").collect()
    assert ranked == rank.node_rankings(nodes, held.edges, 7).select("id", "edge_count").collect()
    for k, query in enumerate(queries):
        kind = ("class", None)[k % 2]
        wanted = [(r.id, round(r.score, 9)) for r in fulltext.search(nodes, query, kind, 50).collect()]
        found = postings.search(held.bucketed_nodes, held.index, query, kind, 50).collect()
        assert [(r.id, round(r.score, 9)) for r in found] == wanted, query
    members = postings.search_members(held.bucketed_nodes, held.index, queries[0], None, 50)
    assert rows(members, NODE_COLUMNS) == rows(fulltext.search_members(nodes, queries[0], None, 50), NODE_COLUMNS)
    for text in parts:
        for plain, stored in ((fulltext.name_contains_any, postings.name_contains_any), (fulltext.explore, postings.explore)):
            found = [r.id for r in stored(held.bucketed_nodes, held.index, text, 50).collect()]
            assert found == [r.id for r in plain(nodes, text, 50).collect()], text
    nodes.unpersist()


def test_changes_equal_plain_merges(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=4)
    nodes, edges = made(spark, 1, range(60))
    graph.save(nodes, edges)
    more, links = made(spark, 2, range(40, 90), files=7)
    before = store.load_graph(spark, graph.folder)
    graph.merge(more, links)
    nodes, edges = (cut(df, "plain").df for df in (
        upsert.upsert_nodes(nodes, more, ["line_start"]), upsert.upsert_edges(edges, links, ["line_number"])))
    assert rows(graph.nodes, NODE_COLUMNS) == rows(nodes, NODE_COLUMNS)
    assert rows(graph.edges, EDGE_COLUMNS) == rows(edges, EDGE_COLUMNS)
    assert before.nodes.count() == 60  # a reader of the state before still can
    agree(graph)
    for path, purge in (("/f1.py", False), ("/f2.py", True), ("/nowhere.py", True)):
        graph.delete_file(path, purge)
        nodes, edges = (cut(df, "plain").df for df in upsert.delete_file(nodes, edges, path, purge))
        assert rows(graph.nodes, NODE_COLUMNS) == rows(nodes, NODE_COLUMNS)
        assert rows(graph.edges, EDGE_COLUMNS) == rows(edges, EDGE_COLUMNS)
    assert rows(graph.nodes_in_file("/f3.py"), NODE_COLUMNS) == rows(nodes.filter("file_path = '/f3.py'"), NODE_COLUMNS)
    agree(graph, ["save OR total", '"parse tree" OR tot*'], ["Save"])


def test_only_touched_buckets_are_written(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=64)
    nodes, edges = made(spark, 3, range(200), files=60)
    graph.save(nodes, edges)
    one = nodes.filter("id = 'n7'").withColumn("name", F.lit("fresh_word"))
    written = graph.merge(one, edges.limit(0))
    assert written == {"nodes": 1, "members": 1, "edges_by_source": 0, "edges_by_target": 0}
    assert [r.id for r in graph.search("fresh").collect()] == ["n7"]
    path = nodes.filter("id = 'n9'").first().file_path
    ids = {r.id for r in nodes.filter(F.col("file_path") == path).collect()}
    touching = [r for r in edges.collect() if ids & {r.source_id, r.target_id}]
    written = graph.delete_file(path)
    assert written["members"] == 1 and written["nodes"] <= len(ids)
    assert written["edges_by_source"] <= len({r.source_id for r in touching} | ids)
    assert written["edges_by_target"] <= len({r.target_id for r in touching} | ids)


def test_deltas_are_folded(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(store, "MOST_DELTAS", 2)
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=2)
    nodes, edges = made(spark, 4, range(12))
    graph.save(nodes, edges)
    for name in ("first_x", "second_y", "third_zz"):
        graph.merge(nodes.filter("id = 'n3'").withColumn("name", F.lit(name)), edges.limit(0))
    held = store.manifest(spark, graph.folder)
    assert (held.batch, held.deltas, held.dead) == (3, 1, 1)
    assert [r.name for r in graph.search("third").collect()] == ["third_zz"] and graph.search("first OR second").count() == 0
    assert store.remove_old(spark, graph.folder) > 0
    agree(graph, ["total OR save", "third"], ["rd_"])


ODD = ["", None, "Order#7 ORDER#7 order_7", "ÄrgerNaïve İx ΣΑΣ ǅ", "a", "ab", "abcabcABC", "日本語コード 日本語", "x\u0301y\ue000z", "\x00\x7f~A1",
       "tab\tand\nline", "Ⅷ½ ²x", "😀😀😀 b😀", " lead", "trail_", "ſtraße K"]


def test_words_and_threes_of_odd_texts(spark):
    """What numpy splits is what Spark's expressions say."""
    texts = [(f"n{i}", ODD[-i], ODD[i], "function", ODD[i - 3], i, i, None, "go", ODD[i - 5]) for i in range(len(ODD))]
    nodes = spark.createDataFrame([(r[0], r[1], r[2], *r[3:]) for r in texts], NODES).coalesce(1)
    wanted = set()
    for place, name in enumerate(postings.TEXT_COLUMNS):
        for row in nodes.select("id", F.posexplode(words(name))).collect():
            wanted.add((row.col, row.id, place, row.pos))
    found = postings.postings_of(nodes, 3).select("term", "id", "place", F.explode("positions")).collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted
    lengths = {i: sum(w[1] == i for w in wanted) for i in {w[1] for w in wanted}}
    assert {(r.id, r.length) for r in postings.postings_of(nodes, 3).collect()} == set(lengths.items())
    buckets = nodes.withColumn("b", F.pmod("line_start", F.lit(3)))
    figures = {r.b: (r.rows, r.words) for r in postings.figures_of(buckets, "b").collect()}
    assert figures == {r.b: (r.n, r.w) for r in buckets.groupBy("b").agg(
        F.count("*").alias("n"), F.sum(sum(F.size(words(c)) for c in postings.TEXT_COLUMNS)).alias("w")).collect()}

    def threes(text):
        text = (text or "").translate({c: c + 32 for c in range(65, 91)})
        return {text[k : k + 3] for k in range(len(text) - 2)}

    wanted = {(g, r[0], postings.NAME) for r in texts for g in threes(r[2])} | {(g, r[1], postings.PATH) for r in texts for g in threes(r[1])}
    found = postings.grams_of(nodes, 3).select("gram", "id", "place").collect()
    assert len(found) == len(wanted) and {tuple(r) for r in found} == wanted


def test_single_words_are_added_up_in_place(spark, tmp_path):
    """A word that millions of nodes have is counted without lists, which Spark sorts and spills."""
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=4)
    graph.save(*made(spark, 6, range(50)))
    index = store.load_graph(spark, graph.folder).index
    for query, lists in (("total OR name:save AND x", False), ('"parse tree"', True)):
        counts = postings.phrase_counts(index, fulltext.phrases_of(fulltext.read_match(query)), "class")
        assert ("collect_list" in counts._jdf.queryExecution().executedPlan().toString()) == lists
    assert {f.name for f in counts.schema} == {"id", "length", "of_kind", "f0"}


def test_nodes_are_read_in_small_parts(spark, tmp_path):
    """Tasks that make many rows of each node read little: a row group has no more than 4 MB, whatever a file has."""
    nodes = spark.range(0, 40_000, 1, 1).select(
        F.format_string("n%d", "id").alias("id"), F.lit("/a.py").alias("file_path"), F.lit("x").alias("name"), F.lit("function").alias("kind"),
        F.repeat(F.sha2(F.col("id").cast("string"), 512), 3).alias("signature"), F.lit(1).cast("long").alias("line_start"),
        F.lit(1).cast("long").alias("line_end"), F.lit(None).cast("string").alias("parent_id"), F.lit("go").alias("language"), F.lit("{}").alias("metadata"))
    nodes = nodes.select(*[F.col(f.name).cast(f.dataType) for f in NODES])
    store.save_graph(nodes, spark.createDataFrame([], EDGES), str(tmp_path / "g"), 1, ["nodes"])
    groups = []
    for file in (tmp_path / "g" / "nodes").rglob("*.parquet"):
        held = pq.ParquetFile(file).metadata
        groups += [held.row_group(k).total_byte_size for k in range(held.num_row_groups)]
    assert sum(groups) > 12 << 20 and max(groups) < 6 << 20


def test_a_search_reads_its_words_buckets(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=16)
    graph.save(*made(spark, 5, range(80)))
    index = store.load_graph(spark, graph.folder).index
    plan = postings.phrase_counts(index, fulltext.phrases_of(fulltext.read_match("total")))._jdf.queryExecution().toString()
    filters = [line for line in plan.split("\n") if "PartitionFilters" in line]
    assert filters and all("bucket_of_16" in line.split("PartitionFilters")[1].split("]")[0] for line in filters)
    assert graph.search("total", limit=1).count() == 1


def test_empty_graphs(spark, tmp_path):
    graph = CodeGraph(spark, str(tmp_path / "g"), buckets=2).init()
    assert graph.nodes.count() == 0 and graph.search("total").count() == 0 and graph.search_members("a OR b*").count() == 0
    assert graph.nodes_in_file("/a.py").count() == 0
    nodes, edges = made(spark, 6, range(5))
    graph.merge(nodes, edges)
    assert rows(graph.nodes, NODE_COLUMNS) == rows(nodes, NODE_COLUMNS)
    assert rows(graph.edges, EDGE_KEY) == rows(edges, EDGE_KEY)
    for r in nodes.select("file_path").distinct().collect():
        graph.delete_file(r.file_path)
    assert graph.nodes.count() == graph.edges.count() == 0
    with pytest.raises(FileNotFoundError):
        store.load_graph(spark, str(tmp_path / "nothing"))


def test_what_the_index_is_made_of(spark):
    """A path's threes are there once, however many nodes it has, and postings are made without a shuffle."""
    nodes = spark.createDataFrame([(f"n{i}", "/a/deep.py", f"f{i}", "function", "x y x", i, i, None, "python", None) for i in range(40)], NODES)
    paths = postings.grams_of(nodes, 0).filter(F.col("place") == 1)
    assert sorted(r.gram for r in paths.collect()) == sorted({"/a/deep.py"[k : k + 3] for k in range(8)})
    made_of = postings.postings_of(nodes, 0)
    assert "Exchange" not in made_of._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in made_of.filter("id = 'n7' and term = 'x'").select("place", "positions", "length").collect()] == [(1, [0, 2], 4)]


def test_tables_are_laid_out_when_asked_for(spark, tmp_path):
    """Only what is asked for is written, the rest can follow, and a table that is not there is no empty one."""
    nodes, edges = made(spark, 7, range(50))
    whole, part = str(tmp_path / "whole"), str(tmp_path / "part")
    store.save_graph(nodes, edges, whole, 4)
    store.save_graph(nodes, edges, part, 4, ["edges_by_target"])
    held = store.load_graph(spark, part)
    assert rows(held.links.by_target, EDGE_COLUMNS) == rows(edges, EDGE_COLUMNS)
    for missing in (lambda: held.nodes, lambda: held.links.by_source, lambda: held.index.postings):
        with pytest.raises(LookupError):
            missing()
    with pytest.raises(LookupError):
        store.merge_rows(nodes, edges, part)
    store.lay_out(nodes, edges, part, ["terms"])
    assert set(store.manifest(spark, part).lacking) == {"members", "grams", "edges_by_source", "degrees"}
    store.lay_out(nodes, edges, part, list(store.LAYOUTS))
    one, other = store.load_graph(spark, whole), store.load_graph(spark, part)
    for table, (schema, _) in store.TABLES.items():
        assert rows(one.read(table), schema.fieldNames()) == rows(other.read(table), schema.fieldNames())
    assert (one.index.rows, one.index.length) == (other.index.rows, other.index.length)


def test_a_write_has_tasks_by_its_bytes(spark, tmp_path, monkeypatch):
    """What a task sorts is bounded by the bytes its rows come from, also when one id has them all."""
    monkeypatch.setattr(lineage, "TASK_BYTES", 4_000)
    hub = spark.range(3000).select(
        F.concat(F.lit("n"), "id").alias("source_id"), F.lit("hub").alias("target_id"), F.lit("calls").alias("kind"),
        F.lit("/f.py").alias("file_path"), F.lit(1).alias("line_number"))
    kept = cut(hub, "hub").df
    tasks = lineage.tasks_of(kept)
    assert tasks > 3
    _, buckets = store._write(kept, str(tmp_path), "edges_by_target", 4)
    files = list((tmp_path / "edges_by_target").rglob("*.parquet"))
    assert len(buckets) == 1 and max(spark.read.parquet(str(f)).count() for f in files) < 3000


def test_degrees_are_counted_by_tasks_of_bounded_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(lineage, "TASK_BYTES", 100)
    _, edges = made(spark, 8, range(300))
    kept = cut(edges, "edges").df
    found = rank.total_degrees(kept)
    assert f"{lineage.tasks_of(kept)}), REPARTITION_BY_NUM" in found._jdf.queryExecution().executedPlan().toString().replace("], ", "], ")
    wanted = {}
    for r in edges.collect():
        for end in {r.source_id, r.target_id}:
            wanted[end] = wanted.get(end, 0) + 1
    assert {r.id: r.refs for r in found.collect()} == wanted


def test_layouts_read_little_at_once(spark, tmp_path, monkeypatch):
    """While a table is laid out its input is read in small parts, unless smaller ones are set; then what was set holds again."""
    files, fetched = "spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before, seen = (spark.conf.get(files), spark.conf.get(fetched)), []

    @contextlib.contextmanager
    def watched(session):
        with lineage.small_reads(session):
            seen.append((spark.conf.get(files), spark.conf.get(fetched)))
            yield

    monkeypatch.setattr(store, "small_reads", watched)
    nodes, edges = made(spark, 3, range(40))
    store.save_graph(nodes, edges, str(tmp_path / "g"), buckets=1)
    assert len(seen) == len(store.LAYOUTS) and set(seen) == {(str(lineage.READ_BYTES), str(lineage.FETCHED_BYTES))}
    assert (spark.conf.get(files), spark.conf.get(fetched)) == before
    spark.conf.set(files, "1m")
    try:
        with pytest.raises(ZeroDivisionError), lineage.small_reads(spark):
            assert spark.conf.get(files) == "1m" and 1 / 0
        assert (spark.conf.get(files), spark.conf.get(fetched)) == ("1m", before[1])
    finally:
        spark.conf.set(files, before[0])


def test_postings_have_more_tasks_than_nodes(spark, tmp_path):
    """They have several rows a node, so a task gets the words of fewer nodes."""
    nodes, edges = made(spark, 4, range(200))
    store.save_graph(nodes, edges, str(tmp_path / "n"), buckets=1, tables=["nodes"])
    nodes = store.load_graph(spark, str(tmp_path / "n")).nodes
    store.save_graph(nodes, edges, str(tmp_path / "g"), buckets=1)
    written = {t: sum(f.endswith(".parquet") for _, _, files in os.walk(tmp_path / "g" / t) for f in files) for t in ("nodes", "postings", "grams")}
    assert written == {"nodes": 1, "postings": 4, "grams": 4}
    held = store.load_graph(spark, str(tmp_path / "g"))
    assert rows(held.index.terms, ["start", "term"]) == rows(held.index.postings.selectExpr("substring(term, 1, 1) start", "term").distinct(), ["start", "term"])


def test_left_out_rows_by_hashes(spark, monkeypatch):
    """Keys too many to broadcast leave out what they would in a join, also where others share their hash; rows are not shuffled."""
    schema = "a string, b string, c long"
    keys = [(f"k{i}", f"v{i}") for i in range(0, 300, 3)] + [("x", None), (None, "y"), (None, None), ("k3", "v3"), ("z", "")]
    rows_ = [(f"k{i % 150}", f"v{i % 140}", i) for i in range(600)] + [("x", None, 1), (None, "x", 2), ("y", None, 3), (None, None, 4), ("x", "y", 5), ("z", "", 6)]
    held, table = cut(spark.createDataFrame(keys, "a string, b string"), "keys"), cut(spark.createDataFrame(rows_, schema), "rows").df
    wanted = table.join(held.df, ["a", "b"], "left_anti")
    one = cut(held.df.select("a"), "keys")
    ends = table.join(one.df, "a", "left_anti").join(one.df.withColumnRenamed("a", "b"), "b", "left_anti")
    for broadcast in (lineage.BROADCAST_ROWS, 0):
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", broadcast)
        assert rows(lineage.leave_out(table, held, ["a", "b"]), "abc") == rows(wanted, "abc")
        assert rows(lineage.leave_out(table, one, ["a"], ["b"]), "abc") == rows(ends, "abc")
    plan = lineage.leave_out(table, one, ["a"])._jdf.queryExecution().executedPlan().toString()
    assert "ArrowEvalPython" in plan and "hashpartitioning" not in plan


def test_a_change_of_some_tables(spark, tmp_path, monkeypatch):
    """Tables that are laid out change as in a whole graph, with many keys as with few, and the others can follow."""
    nodes, edges = made(spark, 9, range(70))
    more, links = made(spark, 10, range(50, 100), files=7)
    whole = str(tmp_path / "whole")
    store.save_graph(nodes, edges, whole, 4)

    def change(at):
        store.merge_rows(more, links, at)
        store.remove_old(spark, at)
        store.delete_files(spark.createDataFrame([("/f1.py",)], "file_path string"), at)

    change(whole)
    one = store.load_graph(spark, whole)
    for k, tables in enumerate((["nodes"], ["nodes", "edges_by_source"], ["degrees", "nodes"], ["terms", "members"])):
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", (0, 100_000)[k % 2])
        part = str(tmp_path / f"part{k}")
        store.save_graph(nodes, edges, part, 4, tables)
        change(part)
        lacking = store.manifest(spark, part).lacking
        assert not set(lacking) & set(tables) and len(lacking) >= 4
        if "edges_by_source" in lacking and "edges_by_target" in lacking:
            with pytest.raises(LookupError):
                store.lay_out(nodes, edges, part, ["degrees"])
        store.lay_out(nodes, edges, part, ["members", "postings", "terms", "grams"])
        if k in (1, 2):
            store.lay_out(nodes, edges, part, list(store.LAYOUTS))
        other = store.load_graph(spark, part)
        for table in set(store.LAYOUTS) - set(store.manifest(spark, part).lacking) - {"postings", "grams", "terms"}:
            columns = store.TABLES[table][0].fieldNames()
            assert rows(one.read(table), columns) == rows(other.read(table), columns), table
        for query in ("save OR total", '"parse tree" OR tot*'):
            assert [(r.id, r.score) for r in postings.search(one.bucketed_nodes, one.index, query).collect()] == [
                (r.id, r.score) for r in postings.search(other.bucketed_nodes, other.index, query).collect()]
        assert rows(postings.explore(one.bucketed_nodes, one.index, "ave_"), ["id"]) == rows(postings.explore(other.bucketed_nodes, other.index, "ave_"), ["id"])


def test_writes_leave_no_shuffles(spark, tmp_path):
    """The files of a shuffle go with the write that needed it."""

    def shuffled():
        return {b for b in spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks().mkString(" ").split() if "shuffle" in b}

    before = shuffled()
    cut(spark.range(5000).repartition(4, "id"), "dealt")
    store.save_graph(*made(spark, 11, range(30)), str(tmp_path / "g"), 2, ["nodes", "edges_by_source"])
    assert shuffled() <= before and spark.conf.get(lineage.CLEANUP) == "false"


def test_changes_are_laid_out_again(spark, tmp_path, monkeypatch):
    """A change writes what is left as it reads it, without a shuffle, until that has left many files."""
    monkeypatch.setattr(store, "MOST_FILES", 2)
    at, dealt, files, write = str(tmp_path / "g"), [], [], store._write
    nodes, edges = made(spark, 12, range(40))
    store.save_graph(nodes, edges, at, 1, ["nodes"])
    monkeypatch.setattr(store, "_write", lambda rows_, folder, table, buckets: dealt.append(rows_.count()) or write(rows_, folder, table, buckets))
    for k in range(9):
        store.merge_rows(nodes.filter(f"id = 'n{k}'").withColumn("name", F.lit(f"name {k}")), edges.limit(0), at)
        files.append(len(store.load_graph(spark, at).nodes.inputFiles()))
    assert set(dealt) == {1, 40} and dealt.count(1) >= 5 and max(files) <= 6  # what arrives, or all rows
    held = store.load_graph(spark, at).nodes
    assert held.count() == 40 and held.filter("id = 'n8'").first().name == "name 8"
