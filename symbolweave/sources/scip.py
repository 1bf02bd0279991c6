"""Symbols and references from a type-aware indexer's JSON output."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.functions.names import indexed_language, indexed_symbol, reference_kind
from symbolweave.lineage import Cut, compiled_methods, cut, join_frontier, join_keyed, merged
from symbolweave.operators.upsert import first_wins
from symbolweave.schema import EDGE_COLUMNS, NODE_COLUMNS

_OCCURRENCE = T.StructType(
    [T.StructField("symbol", T.StringType()), T.StructField("symbol_roles", T.IntegerType())]
)
_SYMBOL = T.StructType([T.StructField("symbol", T.StringType())])
DOCUMENT = T.StructType(
    [
        T.StructField("relative_path", T.StringType()),
        T.StructField("occurrences", T.ArrayType(_OCCURRENCE)),
        T.StructField("symbols", T.ArrayType(_SYMBOL)),
    ]
)
INDEX = T.StructType([T.StructField("documents", T.ArrayType(DOCUMENT))])

DEFINITION = 1
# Kinds a bare symbol entry may add.
LISTED_KINDS = ["class", "interface", "function", "method"]


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """One row per document, numbered in the order of the index."""
    index = spark.read.schema(INDEX).option("multiLine", "true").json(path)
    return index.select(F.posexplode("documents").alias("doc_no", "doc")).select("doc_no", "doc.*")


def _defines() -> Column:
    return (F.col("place.list") == 0) & (F.col("roles").bitwiseAND(DEFINITION) == DEFINITION)


def _mentions(documents: DataFrame, root: str) -> DataFrame:
    """Every symbol mention with its place (document, list, position), and what the symbol says where it defines one."""
    path = F.coalesce("relative_path", F.lit(""))
    listed = F.transform(
        F.coalesce("symbols", F.array()),
        lambda s, i: F.struct(
            F.lit(1).alias("list"), i.alias("at"), s["symbol"].alias("symbol"), F.lit(None).cast("int").alias("roles")
        ),
    )
    seen = F.transform(
        F.coalesce("occurrences", F.array()),
        lambda o, i: F.struct(
            F.lit(0).alias("list"), i.alias("at"), o["symbol"].alias("symbol"),
            F.coalesce(o["symbol_roles"], F.lit(0)).alias("roles"),
        ),
    )
    return (
        documents.select(
            "doc_no",
            F.concat(F.lit(root + "/"), path).alias("file_path"),
            indexed_language(path).alias("language"),
            F.explode_outer(F.concat(seen, listed)).alias("m"),
        )
        .select("file_path", "language", F.struct("doc_no", "m.list", "m.at").alias("place"), "m.symbol", "m.roles")
        .filter(F.coalesce("symbol", F.lit("")) != "")
        .filter(~F.col("symbol").startswith("local "))
        .withColumn("as", F.when((F.col("place.list") == 1) | _defines(), indexed_symbol("symbol")))
    )


def convert(documents: DataFrame, root: str, stored: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(new nodes, edges, counts) for an index over a tree rooted at ``root``.

    Definitions of all documents are known before references are resolved; the
    last definition of a symbol counts, the first one of a node makes it.  A
    symbol that very many references name is spread over tasks by file.
    """
    with compiled_methods(documents.sparkSession):
        mentions = cut(_mentions(documents, root), "mentions").df  # read three times below; symbols are taken apart once
    defined = mentions.filter(F.col("as").isNotNull()).filter(_defines() | F.col("as.kind").isin(LISTED_KINDS))
    defined = defined.select(
        "symbol",
        F.concat("file_path", F.lit(":"), F.col("as.name")).alias("id"),
        "file_path",
        F.col("as.name").alias("name"),
        F.col("as.kind").alias("kind"),
        "language",
        "place",
    )
    candidates = cut(first_wins(defined, ["id"], ["place"], ["id", "file_path", "name", "kind", "language"]), "defined")
    held = join_keyed(stored.select("id", F.col("kind").alias("held_kind")), candidates, "id")
    held = cut(held.select("id", "held_kind"), "held")
    fresh = join_keyed(candidates.df, Cut(held.df.select("id"), held.rows), "id", "left_anti").withColumns({
        "signature": F.lit(""), "line_start": F.lit(0), "line_end": F.lit(0),
        "parent_id": F.lit(None).cast("string"), "metadata": F.lit("{}")}).select(*NODE_COLUMNS)

    kinds = join_keyed(candidates.df.select("id", "kind"), held, "id", "left")
    kinds = kinds.select("id", F.coalesce("held_kind", "kind").alias("kind"))
    target_of = defined.groupBy("symbol").agg(F.max_by("id", "place").alias("id"))
    targets = target_of.join(kinds if candidates.small else merged(kinds), "id").select(
        "symbol", F.col("id").alias("target_id"), reference_kind("kind").alias("kind")
    )

    references = (
        mentions.filter((F.col("place.list") == 0) & (F.col("roles") == 0))
        .groupBy("file_path", "symbol")
        .agg(F.count("*").alias("times"))
    )
    resolved = join_frontier(references, cut(targets, "targets"), "symbol", F.col("file_path"))
    links = cut(
        resolved.groupBy(F.col("file_path").alias("source_id"), "target_id", "kind").agg(
            F.sum("times").alias("times")
        ),
        "links",
    ).df
    edges = links.select(
        "source_id", "target_id", "kind", F.col("source_id").alias("file_path"), F.lit(0).alias("line_number")
    ).select(*EDGE_COLUMNS)
    counts = fresh.agg(F.count("*").alias("nodes_added")).select(
        "nodes_added",
        F.coalesce(links.agg(F.sum("times")).scalar(), F.lit(0).cast("bigint")).alias("references_resolved"),
    )
    return fresh, edges, counts
