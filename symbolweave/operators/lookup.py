"""Point reads and plain projections over the graph tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def node_by_id(nodes: DataFrame, node_id: str) -> DataFrame:
    return nodes.filter(F.col("id") == node_id)


def nodes_in_file(nodes: DataFrame, file_path: str) -> DataFrame:
    return nodes.filter(F.col("file_path") == file_path).orderBy("line_start", "id")


def node_with_source(nodes: DataFrame, files: DataFrame, node_id: str) -> DataFrame:
    """The node and its file's text, null when the file cannot be read."""
    texts = files.select(F.col("path").alias("file_path"), F.col("text").alias("source"))
    return node_by_id(nodes, node_id).join(texts, "file_path", "left").select(*nodes.columns, "source")


def decoded_metadata(nodes: DataFrame) -> DataFrame:
    """Nodes with ``metadata`` decoded to a map; null or blank text is empty."""
    text = F.coalesce(F.nullif(F.trim("metadata"), F.lit("")), F.lit("{}"))
    return nodes.withColumn(
        "metadata", F.from_json(text, T.MapType(T.StringType(), T.StringType()))
    )


def nodes_by_name(nodes: DataFrame, kind: str | None = None, limit: int = 20) -> DataFrame:
    """What a blank search returns: the first nodes by name."""
    picked = nodes if not kind else nodes.filter(F.col("kind") == kind)
    return picked.orderBy("name", "id").limit(limit)


def export_nodes(nodes: DataFrame) -> DataFrame:
    """Node rows as the dashboard reads them."""
    return nodes.select(
        "id",
        "name",
        "kind",
        F.col("file_path").alias("file"),
        F.col("line_start").alias("line"),
        F.coalesce("signature", F.lit("")).alias("signature"),
    )


def export_edges(edges: DataFrame) -> DataFrame:
    """Edge rows as the dashboard reads them."""
    return edges.select(
        F.col("source_id").alias("source"), F.col("target_id").alias("target"), "kind"
    )


def write_export(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """Write the graph as JSON lines, nodes in name order across the part files."""
    export_nodes(nodes).orderBy("name", "id").write.mode("overwrite").json(f"{folder}/nodes")
    export_edges(edges).write.mode("overwrite").json(f"{folder}/edges")
