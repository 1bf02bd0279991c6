"""An extension: bare names that calls and imports were written with, to the symbols they mean.

A parsed call names its target as the source text does.  If exactly one node has that name as
the last part of its own, the edge is pointed at this node; a name that several nodes
share, or none, stays as it is, and so does a target that is a node already.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.schema import EDGE_COLUMNS, EDGE_KEY


def short_name(name: Column | str) -> Column:
    """The part of a name behind its last full stop, colon or slash."""
    return F.regexp_extract(name, r"[^.:/]+$", 0)


def resolve_edges(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """``edges`` with bare targets resolved; of those that become one, the first by file and line.

    Both lookups are unique on their key, so a target that very many edges share lies on the
    side that adaptive execution splits.
    """
    known = nodes.select(F.col("id").alias("target_id"), F.lit(True).alias("known"))
    named = nodes.groupBy(short_name("name").alias("target_id")).agg(
        F.count(F.lit(1)).alias("n"), F.min("id").alias("meant"))
    only = named.filter((F.col("n") == 1) & (F.col("target_id") != "")).select("target_id", "meant")
    target = F.when(F.col("known").isNotNull(), F.col("target_id")).otherwise(F.coalesce("meant", "target_id"))
    resolved = edges.join(known, "target_id", "left").join(only, "target_id", "left").select(
        "source_id", target.alias("target_id"), "kind", "file_path", "line_number")
    first = F.min(F.struct("file_path", "line_number")).alias("first")
    return resolved.groupBy(*EDGE_KEY).agg(first).select(*EDGE_KEY, "first.*").select(*EDGE_COLUMNS)
