"""Last-write-wins merges and per-file deletes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import Cut, cut, join_frontier, join_keyed, merged
from symbolweave.schema import EDGE_COLUMNS, EDGE_KEY, NODE_COLUMNS


def last_wins(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Keep, per key, the row with the highest ``order``.

    ``max_by`` is combined on the map side, so a key written millions of times
    ships one row per map task.
    """
    rest = [c for c in columns if c not in key]
    newest = F.max_by(F.struct(*rest), F.struct(*order)).alias("newest")
    return rows.groupBy(*key).agg(newest).select(*key, "newest.*").select(*columns)


def first_wins(rows: DataFrame, key: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Keep, per key, the row with the lowest ``order``."""
    rest = [c for c in columns if c not in key]
    oldest = F.min_by(F.struct(*rest), F.struct(*order)).alias("oldest")
    return rows.groupBy(*key).agg(oldest).select(*key, "oldest.*").select(*columns)


def _merged(stored: DataFrame, newest: DataFrame, key: list[str], columns: list[str]) -> DataFrame:
    """Stored rows without a newer one, and the newer ones.

    The arriving rows are counted first: a small batch is broadcast, so that the
    stored table is not shuffled for it.
    """
    arrived = cut(newest, "arrived")
    keys = Cut(arrived.df.select(*key), arrived.rows)
    kept = join_keyed(stored.select(*columns), keys, key, "left_anti")
    return kept.select(*columns).unionByName(arrived.df)


def upsert_nodes(stored: DataFrame, arriving: DataFrame, order: list[str]) -> DataFrame:
    """Merge arriving node rows over the stored ones; every column is replaced."""
    newest = last_wins(arriving, ["id"], order, NODE_COLUMNS)
    return _merged(stored, newest, ["id"], NODE_COLUMNS)


def upsert_edges(stored: DataFrame, arriving: DataFrame, order: list[str]) -> DataFrame:
    """Merge arriving edge rows; a conflict replaces file path and line number."""
    newest = last_wins(arriving, EDGE_KEY, order, EDGE_COLUMNS)
    return _merged(stored, newest, EDGE_KEY, EDGE_COLUMNS)


def insert_absent_nodes(stored: DataFrame, arriving: DataFrame, order: list[str]) -> DataFrame:
    """Add only nodes whose id is new; stored rows stay as they are."""
    fresh = cut(first_wins(arriving, ["id"], order, NODE_COLUMNS), "arrived")
    held = join_keyed(stored.select("id"), Cut(fresh.df.select("id"), fresh.rows), "id", "left_semi")
    new = fresh.df.join(held if fresh.small else merged(held), "id", "left_anti").select(*NODE_COLUMNS)
    return stored.select(*NODE_COLUMNS).unionByName(new)


def delete_files(
    nodes: DataFrame,
    edges: DataFrame,
    paths: DataFrame,
    purge_file_edges: bool = False,
) -> tuple[DataFrame, DataFrame]:
    """Drop the nodes of some files and every edge that touches one of them.

    Edges whose source is the bare file path stay unless ``purge_file_edges``.
    One file may hold very many nodes and one node very many edges, so large
    deletes spread both over tasks.
    """
    files = cut(paths.select("file_path").distinct(), "files")
    inside = join_frontier(nodes.select("id", "file_path"), files, "file_path", F.col("id"), "left_semi")
    kept_nodes = join_frontier(nodes, files, "file_path", F.col("id"), "left_anti")
    kept_edges = without_ends(edges, cut(inside.select("id"), "gone"))
    if purge_file_edges:
        kept_edges = join_frontier(kept_edges, files, "file_path", F.col("source_id"), "left_anti")
    return kept_nodes.select(*nodes.columns), kept_edges.select(*edges.columns)


def without_ends(edges: DataFrame, gone: Cut) -> DataFrame:
    """Edges with neither end among the deleted ids."""
    for end, other in (("source_id", "target_id"), ("target_id", "source_id")):
        ids = Cut(gone.df.withColumnRenamed("id", end), gone.rows)
        edges = join_frontier(edges, ids, end, F.col(other), "left_anti")
    return edges


def delete_file(
    nodes: DataFrame, edges: DataFrame, file_path: str, purge_file_edges: bool = False
) -> tuple[DataFrame, DataFrame]:
    """``delete_files`` for one path; the path filter reaches the scan."""
    gone = cut(nodes.filter(F.col("file_path") == file_path).select("id"), "gone")
    kept_edges = without_ends(edges, gone)
    if purge_file_edges:
        kept_edges = kept_edges.filter(F.col("file_path") != file_path)
    return nodes.filter(F.col("file_path") != file_path), kept_edges.select(*edges.columns)


def delete_embeddings_of(embeddings: DataFrame, kept_nodes: DataFrame) -> DataFrame:
    """Vectors whose node still exists."""
    return embeddings.join(
        kept_nodes.select(F.col("id").alias("node_id")), "node_id", "left_semi"
    ).select(*embeddings.columns)
