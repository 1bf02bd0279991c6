"""Traversals over edges alone: walks by level and path tracing.

Edge ends need not be nodes here, and an edge may show up again at a later
level.  What is carried between rounds is always the distinct set of ends (or a
bounded number of best paths per end), never one row per walk, because the
number of walks grows exponentially while the result does not depend on it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from symbolweave.lineage import Cut, cut, join_frontier, join_keyed, stored_buckets
from symbolweave.sources.store import StoredEdges, into, out_of

TRACE_DEPTH = 15
TRACE_WALK_DEPTH = 10
TRACE_WALK_ROWS = 20


def _one(df: DataFrame, **values) -> Cut:
    row = df.sparkSession.range(1).select(*[F.lit(v).alias(k) for k, v in values.items()])
    return Cut(row, 1)


def _union(parts: list[DataFrame], like: DataFrame) -> DataFrame:
    if not parts:
        return like.limit(0)
    result = parts[0]
    for part in parts[1:]:
        result = result.unionByName(part)
    return result


def _no_edges(arcs: DataFrame) -> DataFrame:
    return arcs.select("source_id", "target_id", "kind", F.lit(0).alias("depth"))


def _levels(edges: DataFrame | StoredEdges, node_id: str, depth: int, near: str, far: str) -> DataFrame:
    stored = into(edges) if near == "target_id" else out_of(edges)
    arcs = stored.select("source_id", "target_id", "kind", *stored_buckets(stored))
    frontier = _one(stored, **{near: node_id})
    parts = []
    for level in range(depth + 1):
        hit = join_frontier(arcs, frontier, near, spread_by=F.col(far), how="left_semi")
        hit = hit.select("source_id", "target_id", "kind", F.lit(level).alias("depth"))
        if level == depth:
            parts.append(hit)
            break
        kept = cut(hit, f"walk{level}")
        if not kept.rows:
            break
        parts.append(kept.df)
        frontier = cut(kept.df.select(F.col(far).alias(near)).distinct(), f"ends{level}")
    return _union(parts, _no_edges(arcs))


def caller_edges(edges: DataFrame | StoredEdges, node_id: str, depth: int = 1) -> DataFrame:
    """Edges met walking backwards from ``node_id``, levels 0 to ``depth``."""
    return _levels(edges, node_id, depth, near="target_id", far="source_id")


def callee_edges(edges: DataFrame | StoredEdges, node_id: str, depth: int = 1) -> DataFrame:
    """Edges met walking forwards from ``node_id``, levels 0 to ``depth``."""
    return _levels(edges, node_id, depth, near="source_id", far="target_id")


def impact_edges(edges: DataFrame | StoredEdges, node_id: str, depth: int = 3) -> DataFrame:
    """Edges reached from those touching ``node_id``, levels 0 to ``depth``.

    The next level holds the edges that start where one of this level ends, or
    end where one of this level starts.
    """
    forward, backward = out_of(edges), into(edges)
    forward = forward.select("source_id", "target_id", "kind", *stored_buckets(forward))
    backward = backward.select("source_id", "target_id", "kind", *stored_buckets(backward))
    starts = _one(forward, source_id=node_id)
    stops = _one(forward, target_id=node_id)
    parts = []
    for level in range(depth + 1):
        after = join_frontier(forward, starts, "source_id", F.col("target_id"), "left_semi")
        before = join_frontier(backward, stops, "target_id", F.col("source_id"), "left_semi")
        hit = after.unionByName(before).distinct()
        hit = hit.select("source_id", "target_id", "kind", F.lit(level).alias("depth"))
        if level == depth:
            parts.append(hit)
            break
        kept = cut(hit, f"impact{level}")
        if not kept.rows:
            break
        parts.append(kept.df)
        starts = cut(kept.df.select(F.col("target_id").alias("source_id")).distinct(), f"starts{level}")
        stops = cut(kept.df.select(F.col("source_id").alias("target_id")).distinct(), f"stops{level}")
    return _union(parts, _no_edges(forward))


def impact_names(walk: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct node names at each depth of an impact walk."""
    ends = cut(walk.select("depth", F.explode(F.array("source_id", "target_id")).alias("id")).distinct(), "ends")
    named = join_keyed(nodes.select("id", "name", "kind", "file_path", "line_start", *stored_buckets(nodes)), ends, "id")
    first = F.min_by(F.struct("kind", "file_path", "line_start"), F.col("id")).alias("at")
    return named.groupBy("depth", "name").agg(first).select("depth", "name", "at.*")


def labelled(walk: DataFrame, nodes: DataFrame, ends: list[str]) -> DataFrame:
    """Add "name (kind)" for each named end, or its id when it is no node.

    A hub end may fill very many rows, so labels are looked up once per distinct
    id, and the hub's rows are spread by their other end when labels come back.
    """
    result = walk
    for end in ends:
        other = "target_id" if end == "source_id" else "source_id"
        ids = cut(walk.select(F.col(end).alias("id")).distinct(), "labels")
        label = F.concat("name", F.lit(" ("), "kind", F.lit(")")).alias("label")
        names = join_keyed(nodes.select("id", "name", "kind", *stored_buckets(nodes)), ids, "id")
        labels = Cut(names.select(F.col("id").alias(end), label), ids.rows)
        column = end.replace("_id", "_label")
        result = join_frontier(result, labels, end, spread_by=F.col(other), how="left")
        result = result.withColumn(column, F.coalesce("label", end)).drop("label")
    return result


def trace_path(edges: DataFrame | StoredEdges, source: str, target: str) -> DataFrame:
    """The shortest edge path from source to target, as (depth, path).

    ``depth`` is 0 for a direct edge and at most 15; a path may not step
    straight back to where it came from.  Among equally short paths the
    smallest in element order is returned.  No row means no path.
    """
    return _closed_path(edges, source) if source == target else _open_path(edges, source, target)


def _open_path(edges: DataFrame | StoredEdges, source: str, target: str) -> DataFrame:
    """A path between different ends, searched from both.

    A shortest path meets no node twice, so each side settles a node once, with its smallest path from the source
    or to the target.  Whichever side has the smaller frontier takes the next level.  The sides meet first when
    their levels add up to the shortest length; then every node they share at those levels is on a shortest path, and
    the smallest of them is the smallest way to such a node, followed by the smallest way on.
    """
    sides = {}
    for side, stored, near, far, start in (("out", out_of(edges), "source_id", "target_id", source),
                                           ("in", into(edges), "target_id", "source_id", target)):
        arcs = stored.select(F.col(near).alias("id"), F.col(far).alias("next"), *stored_buckets(stored))
        first = Cut(_one(stored, id=start).df.select("id", F.array("id").alias("path")), 1)
        sides[side] = {"arcs": arcs, "frontier": first, "settled": first.df.select("id"), "levels": 0}
    none = sides["out"]["frontier"].df.limit(0).select(F.lit(0).alias("depth"), "path")
    for length in range(1, TRACE_DEPTH + 2):
        name = min(sides, key=lambda s: sides[s]["frontier"].rows)
        side, other = sides[name], sides["in" if name == "out" else "out"]
        step = join_frontier(side["arcs"], side["frontier"], "id", spread_by=F.col("next"))
        onward = F.concat("path", F.array("next")) if name == "out" else F.concat(F.array("next"), "path")
        step = step.groupBy(F.col("next").alias("id")).agg(F.min(onward).alias("path"))
        reached = cut(step.join(side["settled"], "id", "left_anti"), f"trace-{name}{length}")
        side["frontier"], side["settled"] = reached, side["settled"].unionByName(reached.df.select("id"))
        if not reached.rows:
            return none
        there = other["frontier"].df.select("id", F.col("path").alias("rest"))
        met = cut(reached.df.join(F.broadcast(there) if other["frontier"].small else there, "id"), "met")
        if met.rows:
            way, rest = ("path", "rest") if name == "out" else ("rest", "path")
            whole = F.concat(way, F.slice(rest, 2, TRACE_DEPTH + 2))
            return met.df.agg(F.min(whole).alias("path")).select(F.lit(length - 1).alias("depth"), "path")
    return none


def _closed_path(edges: DataFrame | StoredEdges, start: str) -> DataFrame:
    """A path from a node back to itself.

    It may have to leave a node twice, by different ways in, so edges are settled instead of nodes, and a node goes
    on with its two best ways in: whatever the next step is, one of the two does not step back.
    """
    stored = out_of(edges)
    arcs = stored.select("source_id", "target_id", *stored_buckets(stored))
    settle = ["source_id", "target_id"]
    previous = F.get(F.col("path"), F.size("path") - 2)
    best = Window.partitionBy("source_id").orderBy("path")
    frontier = Cut(_one(arcs, source_id=start).df.select("source_id", F.array("source_id").alias("path")), 1)
    settled = None
    for depth in range(TRACE_DEPTH + 1):
        step = join_frontier(arcs, frontier, "source_id", spread_by=F.col("target_id"))
        step = step.filter(previous.isNull() | (F.col("target_id") != previous))
        step = step.groupBy(*settle).agg(F.min(F.concat("path", F.array("target_id"))).alias("path"))
        if settled is not None:
            step = step.join(settled, settle, "left_anti")
        reached = cut(step, f"trace{depth}")
        hit = reached.df.filter(F.col("target_id") == start)
        result = hit.groupBy().agg(F.min("path").alias("path")).filter(F.col("path").isNotNull())
        result = result.select(F.lit(depth).alias("depth"), "path")
        if not reached.rows or not hit.isEmpty():
            return result
        keys = reached.df.select(*settle)
        settled = keys if settled is None else settled.unionByName(keys)
        onward = reached.df.select(F.col("target_id").alias("source_id"), "path")
        ranked = onward.withColumn("place", F.row_number().over(best))
        frontier = cut(ranked.filter(F.col("place") <= 2).drop("place"), f"ways{depth}")
    return result


def trace_walks(edges: DataFrame | StoredEdges, source: str, target: str) -> DataFrame:
    """Up to 20 final edges of walks from source to target, shortest first.

    A row is the last edge of a walk, its depth (0 for a direct edge, at most
    10) and the ids the walk left from; walks may repeat nodes.  Only the 20
    smallest walks into each id can be the start of one of the first 20
    results, so no more than those go on from any level.
    """
    stored, last = out_of(edges), into(edges)
    last = last.filter(F.col("target_id") == target)
    last = last.select("source_id", "target_id", "kind", "file_path", "line_number")
    arcs = stored.select("source_id", "target_id", *stored_buckets(stored))
    smallest = Window.partitionBy("source_id").orderBy("path")
    first = _one(arcs, source_id=source).df.select("source_id", F.array("source_id").alias("path"))
    frontier = Cut(first, 1)
    parts, found = [], 0
    for depth in range(TRACE_WALK_DEPTH + 1):
        arrived = join_frontier(last, frontier, "source_id", F.col("kind"))
        ends = cut(arrived.withColumn("depth", F.lit(depth)), f"ends{depth}")
        if ends.rows:
            parts.append(ends.df)
            found += ends.rows
        if found >= TRACE_WALK_ROWS or depth == TRACE_WALK_DEPTH:
            break
        step = join_frontier(arcs, frontier, "source_id", F.col("target_id"))
        onward = (
            step.select(
                F.col("target_id").alias("source_id"),
                F.concat("path", F.array("target_id")).alias("path"),
            )
            .distinct()
            .withColumn("place", F.row_number().over(smallest))
            .filter(F.col("place") <= TRACE_WALK_ROWS)
            .drop("place")
        )
        frontier = cut(onward, f"walks{depth}")
        if not frontier.rows:
            break
    like = last.withColumn("path", F.array("source_id")).withColumn("depth", F.lit(0))
    return (
        _union(parts, like)
        .orderBy("depth", "path", "kind")
        .limit(TRACE_WALK_ROWS)
        .select("source_id", "target_id", "kind", "file_path", "line_number", "depth",
                F.array_join("path", " -> ").alias("path_str"))
    )
