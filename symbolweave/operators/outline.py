"""Search results grouped by file or by depth, for display.

The inputs are results of top-k searches or of walks.  Lists are gathered per
group, so they stay as long as the result a reader asked for.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.functions.text import basename, one_line


def by_basename(hits: DataFrame) -> DataFrame:
    """One row per file name with its display lines, in result order."""
    signature = one_line("signature", 80)
    line = F.concat(
        F.lit("  `"), "name", F.lit("` ("), "kind", F.lit(")"),
        F.when(F.coalesce(F.col("signature"), F.lit("")) != "",
               F.concat(F.lit(" — `"), signature, F.lit("`"))).otherwise(""),
    )
    placed = F.struct(F.round("score", 9).alias("score"), "id", line.alias("line"))
    ordered = F.array_sort(
        F.collect_list(placed),
        lambda a, b: F.when(a["score"] > b["score"], -1).when(a["score"] < b["score"], 1)
        .when(a["id"] < b["id"], -1).when(a["id"] > b["id"], 1).otherwise(0),
    )
    return (
        hits.groupBy(basename("file_path").alias("file"))
        .agg(ordered.alias("found"))
        .select("file", F.size("found").cast("bigint").alias("symbols"), F.col("found.line").alias("lines"))
        .orderBy("file")
    )


def by_file(hits: DataFrame) -> DataFrame:
    """One row per path with "name (kind) :line" entries, first ids first."""
    entry = F.concat("name", F.lit(" ("), "kind", F.lit(") :"), F.col("line_start").cast("string"))
    return (
        hits.groupBy("file_path")
        .agg(F.array_sort(F.collect_list(F.struct("id", entry.alias("entry")))).alias("found"))
        .select("file_path", F.element_at("found.id", 1).alias("first_id"),
                F.col("found.entry").alias("entries"))
        .orderBy("first_id")
    )
