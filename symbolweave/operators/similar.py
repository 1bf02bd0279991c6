"""Vectors for symbols and nearest-vector search."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolweave.functions.text import words
from symbolweave.lineage import BROADCAST_ROWS
from symbolweave.schema import EMBEDDINGS

BATCH = 32
DIMENSIONS = 384

Embedder = Callable[[list[str]], list[list[float]]]


def similar_vectors(
    vectors: DataFrame, query: Sequence[float], limit: int = 10,
    key: str = "node_id", column: str = "vector",
) -> DataFrame:
    """The ``limit`` rows most similar to the query, as (key, similarity).

    Each task keeps only its own best rows before the final top-k.
    """
    scored = similarities(vectors, query, key, column)
    return scored.orderBy(F.round("similarity", 9).desc(), key).limit(limit)


def similarities(
    vectors: DataFrame, query: Sequence[float], key: str = "node_id", column: str = "vector"
) -> DataFrame:
    """(key, similarity) of every vector, in one pass over Arrow batches."""
    wanted = np.asarray(query, dtype=np.float64)
    length = float(np.sqrt(wanted @ wanted))

    @F.arrow_udf("double")
    def similarity(batch: pa.Array) -> pa.Array:
        sizes = np.asarray(batch.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
        flat = batch.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(sizes) else sizes
        place = np.arange(len(flat)) - np.repeat(starts, sizes)
        used = place < len(wanted)
        factors = np.where(used, wanted[np.minimum(place, len(wanted) - 1)], 0.0)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        dots = np.bincount(owner, flat * factors, len(sizes))
        norms = np.sqrt(np.bincount(owner, flat * flat, len(sizes)))
        scale = norms * length
        return pa.array(np.divide(dots, scale, out=np.zeros(len(sizes)), where=scale > 0))

    return vectors.select(key, similarity(F.col(column)).alias("similarity"))


def search_similar(
    nodes: DataFrame, vectors: DataFrame, query: Sequence[float], limit: int = 10
) -> DataFrame:
    """Nodes by similarity of their vector to the query vector.

    Vectors of ids that are no node must not take a place in the result.  They are
    scored first, so that ids and figures cross the shuffle and vectors do not.
    """
    scored = similarities(vectors, query).withColumnRenamed("node_id", "id")
    known = scored.join(nodes.select("id"), "id", "left_semi")
    best = known.orderBy(F.round("similarity", 9).desc(), "id").limit(limit)
    side = F.broadcast(best) if limit <= BROADCAST_ROWS else best
    return (
        nodes.join(side, "id")
        .select(*nodes.columns, "similarity")
        .orderBy(F.round("similarity", 9).desc(), "id")
    )


def embedding_text(nodes: DataFrame) -> DataFrame:
    """The text a symbol is embedded by: its name, then its signature or name."""
    described = F.coalesce(F.nullif("signature", F.lit("")), "name")
    return nodes.select(
        F.col("id").alias("node_id"), F.concat("name", F.lit(": "), described).alias("text")
    )


def index_embeddings(
    nodes: DataFrame, make_embedder: Callable[[], Embedder], model: str, batch: int = BATCH
) -> DataFrame:
    """Embed every node's text with a model loaded once per task.

    ``make_embedder`` runs on the executors, so it must be importable there.
    """

    def embed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model_fn = make_embedder()
        schema = pa.schema(
            [("node_id", pa.string()), ("vector", pa.list_(pa.float32())),
             ("model", pa.string()), ("dimensions", pa.int32())]
        )
        for rows in batches:
            for start in range(0, rows.num_rows, batch):
                part = rows.slice(start, batch)
                vectors = model_fn(part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("node_id"),
                     pa.array([np.asarray(v, np.float32) for v in vectors], pa.list_(pa.float32())),
                     pa.array([model] * part.num_rows, pa.string()),
                     pa.array([len(v) for v in vectors], pa.int32())],
                    schema=schema,
                )

    return embedding_text(nodes).mapInArrow(embed, EMBEDDINGS)


def hashed_vectors(
    texts: DataFrame, key: str = "node_id", dimensions: int = DIMENSIONS, every_key: bool = False
) -> DataFrame:
    """Offline vectors: word counts hashed into ``dimensions`` places.

    A text's places are found in its row and gathered by key once; a numpy count of them is the vector.
    A text without words is left out, or all zero with ``every_key``.
    """
    place = lambda w: (F.conv(F.substring(F.md5(w), 1, 8), 16, 10).cast("bigint") % dimensions).cast("int")
    placed = texts.select(key, F.transform(words("text"), place).alias("places"))
    filled = placed.filter(F.size("places") > 0).groupBy(key).agg(F.flatten(F.collect_list("places")).alias("at"))
    if every_key:
        none = F.array().cast("array<int>")
        filled = texts.select(key).join(filled, key, "left").select(key, F.coalesce("at", none).alias("at"))

    @F.arrow_udf("array<float>")
    def counted(at: pa.Array) -> pa.Array:
        sizes = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        cells = np.repeat(np.arange(len(sizes)) * dimensions, sizes) + at.flatten().to_numpy(zero_copy_only=False)
        weights = np.bincount(cells.astype(np.int64), minlength=len(sizes) * dimensions).astype(np.float32)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(sizes) + 1) * dimensions, pa.int32()), pa.array(weights))

    return filled.select(key, counted("at").alias("vector"))


def hashed_embeddings(nodes: DataFrame, dimensions: int = DIMENSIONS) -> DataFrame:
    vectors = hashed_vectors(embedding_text(nodes), dimensions=dimensions, every_key=True)
    return vectors.select("node_id", "vector", F.lit("hashed").alias("model"), F.lit(dimensions).alias("dimensions"))


def hashed_query(spark: SparkSession, text: str, dimensions: int = DIMENSIONS) -> list[float]:
    """The hashed vector of one query text; all zero if it has no words."""
    one = spark.range(1).select(F.col("id").alias("node_id"), F.lit(text).alias("text"))
    row = hashed_vectors(one, dimensions=dimensions).first()
    return list(row["vector"]) if row else [0.0] * dimensions

