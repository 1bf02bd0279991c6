"""Counts and rankings over the whole graph.

Every count is combined on the map side first, so a hub id or file that holds a
third of all rows crosses the shuffle as one row per map task.  Rankings order
narrow rows; wide columns are fetched afterwards for the few winners only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import BROADCAST_ROWS, cut, join_keyed, stored_buckets, tasks_of


def _fetch(nodes: DataFrame, winners: DataFrame, limit: int) -> DataFrame:
    """All node columns for at most ``limit`` ranked ids; of stored nodes only those ids' buckets are read."""
    if stored_buckets(nodes):
        return join_keyed(nodes, cut(winners, "winners"), "id")
    side = F.broadcast(winners) if limit <= BROADCAST_ROWS else winners
    return nodes.join(side, "id")


def in_degrees(edges: DataFrame) -> DataFrame:
    return edges.groupBy(F.col("target_id").alias("id")).agg(F.count("*").alias("edge_count"))


def total_degrees(edges: DataFrame) -> DataFrame:
    """Edges touching each id at either end; a self loop counts once.

    Most ids are sources of few edges, so what a task counts is as large as what it reads: edges are
    dealt over tasks by their bytes first, however large the input's splits are.
    """
    edges = edges.select("source_id", "target_id")
    if tasks := tasks_of(edges):
        edges = edges.repartition(max(tasks, edges.sparkSession.sparkContext.defaultParallelism), "source_id", "target_id")
    ends = edges.select(F.explode(F.array_distinct(F.array("source_id", "target_id"))).alias("id"))
    return ends.groupBy("id").agg(F.count("*").alias("refs"))


def node_rankings(nodes: DataFrame, edges: DataFrame, limit: int = 50) -> DataFrame:
    """Nodes by how many edges point at them, then by name."""
    return ranked_by(nodes, in_degrees(edges), limit)


def ranked_by(nodes: DataFrame, degrees: DataFrame, limit: int = 50) -> DataFrame:
    """The same out of (id, edge_count) rows, such as a stored graph keeps."""
    order = [F.desc("edge_count"), F.asc("name"), F.asc("id")]
    winners = (
        nodes.select("id", "name")
        .join(degrees.select("id", "edge_count"), "id", "left")
        .withColumn("edge_count", F.coalesce("edge_count", F.lit(0).cast("bigint")))
        .orderBy(*order)
        .limit(limit)
        .select("id", "edge_count")
    )
    return _fetch(nodes, winners, limit).orderBy(*order)


def top_symbols(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Nodes by edges at either end, with the first 120 signature characters."""
    order = [F.desc("refs"), F.asc("name"), F.asc("id")]
    winners = (
        nodes.select("id", "name")
        .join(total_degrees(edges), "id", "left")
        .withColumn("refs", F.coalesce("refs", F.lit(0).cast("bigint")))
        .orderBy(*order)
        .limit(limit)
        .select("id", "refs")
    )
    return (
        _fetch(nodes, winners, limit)
        .orderBy(*order)
        .select(
            "name",
            "kind",
            F.col("file_path").alias("file"),
            F.col("line_start").alias("line"),
            F.substring(F.coalesce("signature", F.lit("")), 1, 120).alias("sig"),
            "refs",
        )
    )


def file_summary(nodes: DataFrame, edges: DataFrame, limit: int = 20) -> DataFrame:
    """Files by symbols plus edges recorded in them.

    Node ids are unique, so counting rows counts distinct ids.  Grouping by
    (file, kind) first keeps the kind lists as short as the kinds there are.
    """
    per_kind = nodes.groupBy("file_path", "kind").agg(F.count("*").alias("n"))
    files = per_kind.groupBy("file_path").agg(
        F.sum("n").alias("symbols"),
        F.array_join(F.array_sort(F.collect_list("kind")), ",").alias("kinds"),
    )
    refs = edges.groupBy("file_path").agg(F.count("*").alias("edges"))
    return (
        files.join(refs, "file_path", "left")
        .withColumn("edges", F.coalesce("edges", F.lit(0).cast("bigint")))
        .orderBy((F.col("symbols") + F.col("edges")).desc(), "file_path")
        .limit(limit)
        .select(F.col("file_path").alias("file"), "symbols", "edges", "kinds")
    )


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count("*").alias("cnt")).orderBy(F.desc("cnt"), column)


def orphan_parents(nodes: DataFrame) -> DataFrame:
    """Parent ids that no node has, with how many nodes name them."""
    named = nodes.filter(F.col("parent_id").isNotNull())
    per_parent = named.groupBy("parent_id").agg(F.count("*").alias("children"))
    known = nodes.select(F.col("id").alias("parent_id"))
    return per_parent.join(known, "parent_id", "left_anti")


def _as_map(counts: DataFrame, column: str) -> Column:
    pairs = counts.agg(F.map_from_entries(F.collect_list(F.struct(column, "cnt"))).alias("m"))
    return pairs.scalar()


def validation_report(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One row of totals, histograms by kind and language, and orphan counts.

    Node figures all come from one pass pre-grouped by (file, kind, language),
    edge figures from one pass by kind.
    """
    parented = F.count_if(F.col("parent_id").isNotNull()).alias("parented")
    cells = nodes.groupBy("file_path", "kind", "language").agg(F.count("*").alias("n"), parented)

    def folded(column: str) -> Column:
        counts = cells.groupBy(column).agg(F.sum("n").alias("cnt"))
        return _as_map(counts, column)

    edge_kinds = edges.groupBy("kind").agg(F.count("*").alias("cnt"))
    zero = F.lit(0).cast("bigint")
    totals = cells.agg(
        F.count_distinct("file_path").alias("total_files"),
        F.coalesce(F.sum("n"), zero).alias("total_nodes"),
        F.coalesce(F.sum("parented"), zero).alias("nodes_with_parent"),
    )
    return totals.select(
        "total_files",
        "total_nodes",
        F.coalesce(edge_kinds.agg(F.sum("cnt")).scalar(), zero).alias("total_edges"),
        folded("kind").alias("by_kind"),
        _as_map(edge_kinds, "kind").alias("by_edge_kind"),
        folded("language").alias("by_language"),
        "nodes_with_parent",
        F.coalesce(orphan_parents(nodes).agg(F.sum("children")).scalar(), zero).alias(
            "orphan_parent_refs"
        ),
    )


def status(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Row counts and whether the text columns needed for search are there."""
    searchable = {"name", "signature", "metadata"} <= set(nodes.columns)
    return nodes.agg(F.count("*").alias("nodes")).select(
        F.lit("healthy").alias("status"),
        "nodes",
        edges.agg(F.count("*")).scalar().alias("edges"),
        F.lit("available" if searchable else "unavailable").alias("fts"),
    )


def ranked_context(nodes: DataFrame, edges: DataFrame, max_nodes: int = 30) -> DataFrame:
    """The rows a task context lists: top nodes by references with display fields."""
    return node_rankings(nodes, edges, max_nodes).select(
        F.initcap("kind").alias("kind_title"),
        "name",
        "signature",
        "file_path",
        "line_start",
        F.col("edge_count").alias("references"),
    )
