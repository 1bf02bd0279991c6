"""Small graphs that pin what each traversal means, and random ones against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from symbolweave import lineage
from symbolweave.operators import neighbours, walks
from symbolweave.sources import store

CYCLE2 = [("a", "b"), ("b", "a")]
CYCLE3 = [("a", "b"), ("b", "c"), ("c", "a")]
SELF = [("a", "a"), ("a", "b")]
DIAMOND = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d")]
DANGLING = [("a", "x"), ("x", "c")]
CHAIN = [("a", "b"), ("b", "c"), ("c", "d")]


def hops(df):
    return {(r.hop, r.id) for r in df.collect()}


def path(df):
    row = df.first()
    return None if row is None else (row.depth, list(row.path))


def test_chain(make_graph):
    nodes, edges = make_graph("abcd", CHAIN)
    assert hops(neighbours.callers(nodes, edges, "c", 1)) == {(1, "b")}
    assert hops(neighbours.callers(nodes, edges, "c", 2)) == {(1, "b"), (2, "a")}
    assert hops(neighbours.callees(nodes, edges, "a", 1)) == {(1, "b")}
    impact = {(r.depth, r.id) for r in neighbours.impact_radius(nodes, edges, "b", 3).collect()}
    assert impact == {(1, "a"), (1, "c"), (2, "d")}


def test_start_comes_back_through_a_cycle(make_graph):
    nodes, edges = make_graph("ab", CYCLE2)
    assert hops(neighbours.callees(nodes, edges, "a", 2)) == {(1, "b"), (2, "a")}


def test_self_loop_is_no_neighbour(make_graph):
    nodes, edges = make_graph("ab", SELF)
    assert hops(neighbours.callees(nodes, edges, "a", 1)) == {(1, "b")}


def test_missing_node_stops_nodes_but_not_edges(make_graph):
    nodes, edges = make_graph("ac", DANGLING)
    assert hops(neighbours.callees(nodes, edges, "a", 3)) == set()
    assert path(walks.trace_path(edges, "a", "c")) == (1, ["a", "x", "c"])
    walk = walks.labelled(walks.callee_edges(edges, "a", 1), nodes, ["target_id"])
    assert {(r.depth, r.target_label) for r in walk.collect()} == {(0, "x"), (1, "name_c (function)")}


def test_two_kinds_give_one_neighbour_and_two_edges(make_graph):
    nodes, edges = make_graph("ab", [("a", "b", "imports"), ("a", "b", "calls")])
    assert [(r.id, r.edge_kind) for r in neighbours.callees(nodes, edges, "a", 1).collect()] == [("b", "calls")]
    assert walks.callee_edges(edges, "a", 0).count() == 2


def test_edge_walk_has_one_level_more(make_graph):
    nodes, edges = make_graph("abcd", CHAIN)
    walk = {(r.depth, r.source_id) for r in walks.caller_edges(edges, "d", 1).collect()}
    assert walk == {(0, "c"), (1, "b")}


def test_trace(make_graph):
    _, cycle2 = make_graph("ab", CYCLE2)
    _, cycle3 = make_graph("abc", CYCLE3)
    _, self_loop = make_graph("ab", SELF)
    _, diamond = make_graph("abcd", DIAMOND)
    assert path(walks.trace_path(cycle2, "a", "a")) is None
    assert path(walks.trace_path(cycle3, "a", "a")) == (2, ["a", "b", "c", "a"])
    assert path(walks.trace_path(self_loop, "a", "a")) == (0, ["a", "a"])
    assert path(walks.trace_path(diamond, "a", "d")) == (1, ["a", "b", "d"])
    assert path(walks.trace_path(diamond, "d", "a")) is None


def test_closed_trace_may_pass_a_node_twice(make_graph):
    # out along s-a, round b-c, and home the way it came
    _, edges = make_graph("sabc", [("s", "a"), ("a", "b"), ("b", "c"), ("c", "a"), ("a", "s")])
    assert path(walks.trace_path(edges, "s", "s")) == (4, ["s", "a", "b", "c", "a", "s"])


def brute_rounds(ids, links, start, depth, forward):
    current, visited, found = {start}, set(), set()
    for hop in range(1, depth + 1):
        ends = {(t if forward else s) for s, t in links if (s if forward else t) in current}
        fresh = {e for e in ends if e in ids and e not in current and e not in visited}
        found |= {(hop, e) for e in fresh}
        visited |= fresh
        current = fresh
    return found


def brute_walk_paths(links, source, limit, backtrack):
    level = [(s, t, [s, t]) for s, t in links if s == source]
    for depth in range(limit + 1):
        yield depth, level
        level = [
            (t, u, steps + [u]) for s, t, steps in level for v, u in links if v == t and (backtrack or u != s)
        ]


def brute_trace(links, source, target, limit):
    for depth, level in brute_walk_paths(links, source, limit, False):
        hits = [steps for _, t, steps in level if t == target]
        if hits:
            return depth, min(hits)
    return None


def brute_impact_edges(links, start, depth):
    level = {e for e in links if start in e}
    found = {(0, *e) for e in level}
    for d in range(1, depth + 1):
        starts, stops = {t for _, t in level}, {s for s, _ in level}
        level = {e for e in links if e[0] in starts or e[1] in stops}
        found |= {(d, *e) for e in level}
    return found


@pytest.mark.parametrize("seed", range(2))
@pytest.mark.parametrize("broadcast", [True, False])
def test_random_graphs(make_graph, monkeypatch, seed, broadcast):
    """Also with every frontier too large to broadcast, so that joins are salted."""
    if not broadcast:
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(lineage, "SALTS", 3)
    rng = random.Random(seed)
    names = [f"n{i}" for i in range(9)]
    links = sorted({(rng.choice(names), rng.choice(names)) for _ in range(16)})
    ids = set(names[:7])
    nodes, edges = make_graph(sorted(ids), links)
    assert hops(neighbours.callees(nodes, edges, "n0", 3)) == brute_rounds(ids, links, "n0", 3, True)
    assert hops(neighbours.callers(nodes, edges, "n1", 2)) == brute_rounds(ids, links, "n1", 2, False)
    for source, target in (("n0", "n5"), ("n2", "n2")):
        assert path(walks.trace_path(edges, source, target)) == brute_trace(links, source, target, 9)
    impact = {(r.depth, r.source_id, r.target_id) for r in walks.impact_edges(edges, "n3", 2).collect()}
    assert impact == brute_impact_edges(links, "n3", 2)


def test_trace_walks_are_the_first_twenty(make_graph, monkeypatch):
    rng = random.Random(5)
    names = [f"n{i}" for i in range(6)]
    links = sorted({(rng.choice(names), rng.choice(names)) for _ in range(14)})
    _, edges = make_graph(names, links)
    wanted = []
    for depth, level in brute_walk_paths(links, "n0", 10, True):
        wanted += sorted((depth, steps[:-1]) for _, t, steps in level if t == "n3")
    found = [(r.depth, r.path_str.split(" -> ")) for r in walks.trace_walks(edges, "n0", "n3").collect()]
    assert len(wanted) >= 20 and found == wanted[:20]


def test_symbols_with_callers(make_graph):
    links = [(f"c{i}", "h") for i in range(8)] + [("h", "h"), ("h", "c1")]
    nodes, edges = make_graph(["h"] + [f"c{i}" for i in range(8)], links)
    row = neighbours.symbols_with_callers(nodes.filter("id = 'h'"), nodes, edges).first()
    assert row.called_by == [f"name_c{i} (calls)" for i in range(5)]
    assert row.calls == ["name_c1 (calls)"]


def test_saved_graph_is_read_by_bucket(spark, make_graph, tmp_path):
    nodes, edges = make_graph("abcd", CHAIN)
    store.save_graph(nodes, edges, str(tmp_path), buckets=4)
    saved = store.load_graph(spark, str(tmp_path))
    assert hops(neighbours.callers(saved.bucketed_nodes, saved.links, "d", 3)) == {(1, "c"), (2, "b"), (3, "a")}
    one = lineage.Cut(spark.createDataFrame([("d",)], "target_id string"), 1)
    plan = lineage.prune(saved.links.by_target, one, "target_id")._jdf.queryExecution().executedPlan().toString()
    assert "bucket_of_4" in plan.split("PartitionFilters")[1].split("PushedFilters")[0]
    assert "target_id" in plan.split("PushedFilters")[1]
    assert {tuple(r) for r in saved.edges.collect()} == {tuple(r) for r in edges.collect()}


def test_impact_names_are_distinct_per_depth(make_graph):
    nodes, edges = make_graph("abc", [("a", "b"), ("a", "c")])
    twins = nodes.withColumn("name", F.when(F.col("id") == "c", "name_b").otherwise(F.col("name")))
    walk = walks.impact_edges(edges, "a", 0)
    assert {(r.depth, r.name, r.file_path) for r in walks.impact_names(walk, twins).collect()} == {
        (0, "name_a", "/a.py"), (0, "name_b", "/b.py")}


@pytest.mark.parametrize("broadcast", [True, False])
def test_deletes_and_merges_of_any_size(spark, make_graph, monkeypatch, broadcast):
    """Large deletes and merges take other joins, with the same result."""
    from symbolweave.operators import upsert

    if not broadcast:
        monkeypatch.setattr(lineage, "BROADCAST_ROWS", 0)
    nodes, edges = make_graph("abcd", [*CHAIN, ("d", "a"), ("x", "y")])
    paths = spark.createDataFrame([("/a.py",), ("/a.py",), ("/none.py",)], "file_path string")
    kept_nodes, kept_edges = upsert.delete_files(nodes, edges, paths)
    assert {r.id for r in kept_nodes.collect()} == {"b", "c", "d"}
    assert {(r.source_id, r.target_id) for r in kept_edges.collect()} == {("b", "c"), ("c", "d"), ("x", "y")}
    fresh = nodes.filter("id in ('a', 'b')").withColumn("kind", F.lit("class"))
    fresh = fresh.unionByName(fresh.filter("id = 'a'").withColumn("id", F.lit("new")))
    merged = {r.id: r.kind for r in upsert.upsert_nodes(nodes, fresh, ["line_start"]).collect()}
    assert merged == {"a": "class", "b": "class", "c": "function", "d": "function", "new": "class"}
    added = {r.id: r.kind for r in upsert.insert_absent_nodes(nodes, fresh, ["line_start"]).collect()}
    assert added == {**{i: "function" for i in "abcd"}, "new": "class"}


def test_large_sides_are_shuffled(spark, monkeypatch):
    """However few bytes their files have; and a side that is copied has a bound on its copies."""
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(lineage, "COPIED_ROWS", 300, raising=False)
    arcs = spark.range(2000).selectExpr("cast(id % 7 as string) near", "cast(id as string) far")
    for rows, how in ((100, "inner"), (100, "left_anti"), (400, "inner"), (400, "left_anti")):
        ends = lineage.cut(spark.range(rows).selectExpr("cast(id as string) near"), "ends")
        found = lineage.join_frontier(arcs, ends, "near", F.col("far"), how)
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastExchange" not in plan and ("_salt" in plan) == (rows == 100)
        assert found.count() == (2000 if how == "inner" else 0)
        keyed = lineage.join_keyed(ends.df, lineage.Cut(arcs.select("near").distinct(), 400), "near", how)
        assert "BroadcastExchange" not in keyed._jdf.queryExecution().executedPlan().toString()
        assert keyed.count() == (7 if how == "inner" else rows - 7)


def test_many_keys_leave_little_to_shuffle(spark, make_graph, tmp_path, monkeypatch):
    """Keys that are not broadcast as they are leave out stored rows by their hashes, up to a number of them."""
    nodes, edges = make_graph("abcd", [*CHAIN, ("a", "d"), ("x", "d")])
    store.save_graph(nodes, edges, str(tmp_path), buckets=4)
    saved = store.load_graph(spark, str(tmp_path))
    monkeypatch.setattr(lineage, "BROADCAST_ROWS", 1)
    for most, hashed in ((2, False), (3, True)):
        monkeypatch.setattr(lineage, "HASHED_KEYS", most, raising=False)
        ends = lineage.cut(spark.createDataFrame([("d",), ("c",), (None,)], "target_id string"), "ends")
        monkeypatch.setattr(lineage, "FEW_KEYS", 0)
        found = lineage.join_frontier(saved.links.by_target, ends, "target_id", F.col("source_id"), "left_semi")
        assert ("BroadcastExchange" in found._jdf.queryExecution().executedPlan().toString()) == hashed
        assert {(r.source_id, r.target_id) for r in found.collect()} == {("c", "d"), ("a", "d"), ("x", "d"), ("b", "c")}
        assert hops(neighbours.callers(saved.bucketed_nodes, saved.links, "d", 3)) == hops(neighbours.callers(nodes, edges, "d", 3))


def test_labels_and_names_are_read_by_bucket(spark, make_graph, tmp_path):
    nodes, edges = make_graph("abcd", CHAIN)
    store.save_graph(nodes, edges, str(tmp_path), buckets=4)
    saved = store.load_graph(spark, str(tmp_path))
    walk = walks.impact_edges(saved.links, "a", 0)
    for found in (walks.impact_names(walk, saved.bucketed_nodes), walks.labelled(walk, saved.bucketed_nodes, ["source_id", "target_id"])):
        plan = found._jdf.queryExecution().executedPlan().toString()
        read = [line for line in plan.splitlines() if "FileScan" in line and ",name#" in line]
        assert read and all("bucket_of_4" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in read)
        assert len(found.collect()) == (2 if "name" in found.columns else 1)
