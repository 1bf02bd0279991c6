"""Nodes and edges from per-file entity and usage maps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.schema import EDGE_COLUMNS, NODE_COLUMNS

ENTITY = T.StructType(
    [
        T.StructField("entity_type", T.StringType()),
        T.StructField("lineno", T.IntegerType()),
        T.StructField("endno", T.IntegerType()),
    ]
)
# One row per file in both inputs.
ENTITIES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("entities", T.MapType(T.StringType(), ENTITY)),
    ]
)
USAGES = T.StructType(
    [
        T.StructField("file_path", T.StringType()),
        T.StructField("usages", T.MapType(T.StringType(), T.ArrayType(T.StringType()))),
    ]
)
WHOLE_FILE = "_"


def entity_nodes(entities: DataFrame) -> DataFrame:
    """A node per entity; files are unique, so ids are."""
    rows = entities.select("file_path", F.explode("entities").alias("name", "e"))
    columns = {
        "id": F.concat("file_path", F.lit(":"), "name"),
        "file_path": F.col("file_path"),
        "name": F.col("name"),
        "kind": F.coalesce("e.entity_type", F.lit("symbol")),
        "signature": F.lit(""),
        "line_start": F.coalesce("e.lineno", F.lit(0)),
        "line_end": F.coalesce("e.endno", F.lit(0)),
        "parent_id": F.lit(None).cast("string"),
        "language": F.lit("python"),
        "metadata": F.lit("{}"),
    }
    return rows.select(*[columns[c].alias(c) for c in NODE_COLUMNS])


def usage_edges(usages: DataFrame) -> DataFrame:
    """An edge per used name; a dotted name is an import, a plain one a call."""
    rows = usages.select("file_path", F.explode("usages").alias("user", "used")).select(
        "file_path", "user", F.explode("used").alias("target_id")
    )
    source = F.when(F.col("user") == WHOLE_FILE, F.col("file_path")).otherwise(
        F.concat("file_path", F.lit(":"), "user")
    )
    kind = F.when(F.col("target_id").contains("."), "imports").otherwise("calls")
    return (
        rows.select(source.alias("source_id"), "target_id", kind.alias("kind"), "file_path",
                    F.lit(0).alias("line_number"))
        .dropDuplicates(["source_id", "target_id", "kind"])
        .select(*EDGE_COLUMNS)
    )
