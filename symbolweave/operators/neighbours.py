"""Breadth-first neighbourhoods over nodes: callers, callees, impact radius.

Each round writes what it reached, so the plan stays as small as one round and
a lost executor costs at most that round.  Within a round the edges found are
reduced to one row per reached id *before* anything else is joined.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import Cut, cut, join_frontier, join_keyed, stored_buckets
from symbolweave.schema import NODE_COLUMNS
from symbolweave.sources.store import StoredEdges, arcs_of, into, out_of


def _start(df: DataFrame, node_id: str) -> Cut:
    one = df.sparkSession.range(1).select(F.lit(node_id).alias("near"))
    return Cut(one, 1)


def _rounds(
    nodes: DataFrame, arcs: DataFrame, node_id: str, depth: int, returns_to_start: bool
) -> DataFrame:
    """Reach outwards along ``arcs(near, far, edge_kind)``, level by level.

    A level holds the real nodes first reached there.  With
    ``returns_to_start`` the start may be reached again from level 2 on.
    """
    frontier = _start(nodes, node_id)
    visited = frontier.df.select(F.col("near").alias("id"))
    levels: list[DataFrame] = []
    for level in range(1, depth + 1):
        reached = (
            join_frontier(arcs, frontier, "near", spread_by=F.col("far"))
            .groupBy(F.col("far").alias("id"))
            .agg(F.min("edge_kind").alias("edge_kind"))
            .join(visited, "id", "left_anti")
        )
        found = cut(reached, f"reached{level}")
        if not found.rows:
            break
        real = join_keyed(nodes, found, "id").select(*NODE_COLUMNS, "edge_kind").withColumn("hop", F.lit(level))
        if level == depth:
            levels.append(real)
            break
        kept = cut(real, f"level{level}")
        if not kept.rows:
            break
        levels.append(kept.df)
        ids = kept.df.select("id")
        visited = ids if returns_to_start and level == 1 else visited.unionByName(ids)
        frontier = Cut(ids.withColumnRenamed("id", "near"), kept.rows)
    if not levels:
        empty = nodes.select(*NODE_COLUMNS).limit(0)
        return empty.withColumn("edge_kind", F.lit("")).withColumn("hop", F.lit(0))
    result = levels[0]
    for more in levels[1:]:
        result = result.unionByName(more)
    return result


def callers(
    nodes: DataFrame, edges: DataFrame | StoredEdges, node_id: str, depth: int = 1
) -> DataFrame:
    """Nodes with a path of at most ``depth`` edges into ``node_id``."""
    arcs = arcs_of(into(edges), "target_id", "source_id")
    return _rounds(nodes, arcs, node_id, depth, returns_to_start=True)


def callees(
    nodes: DataFrame, edges: DataFrame | StoredEdges, node_id: str, depth: int = 1
) -> DataFrame:
    """Nodes that ``node_id`` reaches in at most ``depth`` edges."""
    arcs = arcs_of(out_of(edges), "source_id", "target_id")
    return _rounds(nodes, arcs, node_id, depth, returns_to_start=True)


def impact_radius(
    nodes: DataFrame, edges: DataFrame | StoredEdges, node_id: str, max_depth: int = 3
) -> DataFrame:
    """Nodes within ``max_depth`` edges in either direction, by first depth."""
    forward = arcs_of(out_of(edges), "source_id", "target_id")
    backward = arcs_of(into(edges), "target_id", "source_id")
    found = _rounds(nodes, forward.unionByName(backward), node_id, max_depth, returns_to_start=False)
    return found.drop("edge_kind").withColumnRenamed("hop", "depth")


def symbols_with_callers(
    hits: DataFrame, nodes: DataFrame, edges: DataFrame | StoredEdges, shown: int = 5
) -> DataFrame:
    """Search hits, each with its first few direct callers and callees.

    The hits are written once and counted, so each use of them is a small read and joins
    go by their number; stored edges and nodes are pruned to what the hits touch.
    Neighbours are cut to ``shown`` per hit on the map side before they are gathered, which
    keeps a hub's neighbour list from ever meeting in one task.
    """
    from pyspark.sql import Window

    found = cut(hits, "hits")
    hits = found.df

    def side(near: str, far: str, name: str) -> DataFrame:
        wanted = Cut(hits.select(F.col("id").alias(near)), found.rows)
        table = into(edges) if near == "target_id" else out_of(edges)
        pairs = cut(
            join_frontier(table, wanted, near, F.col(far))
            .filter(F.col(far) != F.col(near))
            .groupBy(F.col(near).alias("hit"), F.col(far).alias("id"))
            .agg(F.min("kind").alias("edge_kind")),
            "neighbours",
        )
        others = cut(pairs.df.select("id").distinct(), "others")
        names = join_keyed(nodes.select("id", F.col("name").alias("other"), *stored_buckets(nodes)), others, "id")
        pairs = pairs.df.join(names.select("id", "other"), "id")
        first = Window.partitionBy("hit").orderBy("other", "id")
        label = F.concat("other", F.lit(" ("), "edge_kind", F.lit(")"))
        return (
            pairs.withColumn("place", F.row_number().over(first))
            .filter(F.col("place") <= shown)
            .groupBy(F.col("hit").alias("id"))
            .agg(F.array_sort(F.collect_list(F.struct("place", label.alias("label")))).alias("found"))
            .select("id", F.col("found.label").alias(name))
        )

    nothing = F.array().cast("array<string>")
    return (
        hits.join(side("target_id", "source_id", "called_by"), "id", "left")
        .join(side("source_id", "target_id", "calls"), "id", "left")
        .select(
            "id",
            "name",
            "kind",
            F.col("file_path").alias("file"),
            F.col("line_start").alias("line"),
            F.substring(F.coalesce("signature", F.lit("")), 1, 120).alias("sig"),
            F.coalesce("called_by", nothing).alias("called_by"),
            F.coalesce("calls", nothing).alias("calls"),
        )
    )
