"""Keeping a graph up to date from file-change events.

Every micro-batch appends what it changed, under its batch number: the files it
cleared, the nodes and the edges it parsed, and how each of its rows fared.  Nothing stored is
rewritten, and a batch that is replayed after a failure overwrites only itself.  Readers merge:
the last write of a node or edge stays, unless its file was cleared later.  A row that cannot be read
or parsed stops nothing; it is kept with its error until a later batch has its path again.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from symbolweave.functions.text import suffix
from symbolweave.lineage import Cut, cut, join_frontier, scope
from symbolweave.operators.upsert import last_wins
from symbolweave.plans.parse import parse, parsed_edges, parsed_nodes
from symbolweave.schema import EDGE_COLUMNS, EDGE_KEY, EDGES, NODE_COLUMNS, NODES
from symbolweave.sources.tree import language_of

# What is watched unless told otherwise, and the quiet time.
WATCHED = [".py", ".ts", ".js", ".go"]
DEBOUNCE_MS = 500
CLEARING = ["modified", "deleted"]
EVENTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts", T.TimestampType()),
        T.StructField("text", T.StringType()),
    ]
)
FIRST_BATCH = -1


def watched(events: DataFrame, extensions: list[str] | None = None) -> DataFrame:
    return events.filter(suffix("path").isin(extensions or WATCHED))


def latest_changes(events: DataFrame, order: list[str]) -> DataFrame:
    """One row per path: the last operation and text, and whether it was cleared (or a burst of it, if events are bursts).

    All aggregates combine on the map side, however often one path changes.
    """
    last = F.max_by(F.struct("op", "text"), F.struct(*order)).alias("last")
    clears = F.col("cleared") if "cleared" in events.columns else F.col("op").isin(CLEARING)
    cleared = F.max(clears).alias("cleared")
    return events.groupBy("path").agg(last, cleared).select("path", "last.op", "last.text", "cleared")


def debounced(events: DataFrame, debounce_ms: int = DEBOUNCE_MS, tie: str = "ts") -> DataFrame:
    """Bursts of events per path: (path, op, first_ts, last_ts, events).

    A burst ends when a path is quiet for longer than the debounce time.  Events
    within one debounce-long slot always belong together, so they are folded on
    the map side first; what is then sorted per path is one row per busy slot.
    """
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    gap = debounce_ms * 1000
    slots = (
        events.withColumn("_us", micros)
        .groupBy("path", F.floor(F.col("_us") / gap).alias("slot"))
        .agg(
            F.min("_us").alias("first"),
            F.max("_us").alias("last"),
            F.max_by("op", F.struct("_us", tie)).alias("op"),
            F.count("*").alias("n"),
        )
    )
    in_order = Window.partitionBy("path").orderBy("slot")
    quiet = F.col("first") - F.lag("last").over(in_order) > gap
    bursts = slots.withColumn("burst", F.count_if(quiet).over(in_order))
    return (
        bursts.groupBy("path", "burst")
        .agg(
            F.max_by("op", "slot").alias("op"),
            F.min("first").alias("first"),
            F.max("last").alias("last"),
            F.sum("n").alias("events"),
        )
        .select(
            "path", "op", F.timestamp_micros("first").alias("first_ts"),
            F.timestamp_micros("last").alias("last_ts"), "events",
        )
    )


def debounced_stream(events: DataFrame, debounce_ms: int = DEBOUNCE_MS, late: str = "1 minute") -> DataFrame:
    """The same on a stream: one row per burst, once the watermark has passed it."""
    burst = F.session_window("ts", f"{debounce_ms} milliseconds")
    last = F.max_by(F.struct("op", "text"), F.col("ts")).alias("last")
    cleared = F.max(F.col("op").isin(CLEARING)).alias("cleared")
    return (
        events.withWatermark("ts", late)
        .groupBy("path", burst)
        .agg(last, cleared, F.max("ts").alias("ts"))
        .select("path", "last.op", "ts", "last.text", "cleared")
    )


@dataclass(frozen=True)
class ChangeLog:
    """The append-only tables below one folder."""

    folder: str

    def write(self, batch: int, cleared: DataFrame, nodes: DataFrame, edges: DataFrame, fates: DataFrame) -> None:
        for name, rows in (("cleared", cleared), ("nodes", nodes), ("edges", edges), ("fates", fates)):
            rows.write.mode("overwrite").parquet(f"{self.folder}/{name}/batch={batch}")

    def read(self, spark: SparkSession, name: str, schema: T.StructType) -> DataFrame:
        layout = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
        return spark.read.schema(layout).parquet(f"{self.folder}/{name}")


_CLEARED = T.StructType([T.StructField("file_path", T.StringType())])
# How a batch's row fared: ``error`` is null if well, and the row is kept if not.
FATES = T.StructType([T.StructField(c, T.StringType()) for c in ("path", "op", "text", "error")])


def start_log(nodes: DataFrame, edges: DataFrame, folder: str) -> ChangeLog:
    """A log that begins with a whole graph."""
    log = ChangeLog(folder)
    spark = nodes.sparkSession
    none, fared = spark.createDataFrame([], _CLEARED), spark.createDataFrame([], FATES)
    log.write(FIRST_BATCH, none, nodes.select(*NODE_COLUMNS), edges.select(*EDGE_COLUMNS), fared)
    return log


def parsed_changes(changes: DataFrame) -> tuple[Cut, DataFrame]:
    """The files of ``latest_changes`` parsed, and how each row fared.

    A row whose text is missing, or cannot be parsed, fares badly by itself; ``error`` may be there before.
    """
    given = F.col("error") if "error" in changes.columns else F.lit(None).cast("string")
    kept = cut(changes.select(
        "path", "op", "text", F.when(F.col("op") != "deleted", F.coalesce(given, F.when(F.col("text").isNull(), "no text"))).alias("error")), "kept").df
    present = kept.filter((F.col("op") != "deleted") & F.col("error").isNull())
    parsed = cut(parse(present.select("path", language_of("path").alias("language"), "text")), "parsed")
    failed = parsed.df.filter("error is not null").select("path", F.col("error").alias("failed"))
    error = F.coalesce("error", "failed")
    fates = kept.join(failed, "path", "left").select(
        "path", "op", F.when(error.isNotNull(), F.col("text")).alias("text"), error.alias("error"))
    return parsed, fates


def apply_batch(log: ChangeLog, changes: DataFrame, batch: int) -> None:
    """Append one batch of ``latest_changes``: clear, then parse what is there."""
    with scope(changes.sparkSession):
        cleared = changes.filter("cleared").select(F.col("path").alias("file_path"))
        parsed, fates = parsed_changes(changes)
        log.write(batch, cleared, parsed_nodes(parsed.df), parsed_edges(parsed.df), fates)


def bad_records(spark: SparkSession, log: ChangeLog) -> DataFrame:
    """(path, op, text, error, batch) of the paths whose last row could not be applied."""
    fates = log.read(spark, "fates", FATES)
    last = F.max_by(F.struct("op", "text", "error"), F.col("batch")).alias("last")
    return fates.groupBy("path").agg(last, F.max("batch").alias("batch")).select("path", "last.*", "batch").filter("error is not null")


def retry(spark: SparkSession, log: ChangeLog, batch: int, texts: DataFrame | None = None) -> None:
    """Apply the bad records again as a batch, with new (path, text) rows where there are any."""
    bad = bad_records(spark, log).select("path", "op", F.col("text").alias("kept"))
    if texts is None:
        again = bad.withColumn("text", F.col("kept"))
    else:
        again = bad.join(texts.select("path", "text"), "path", "left").withColumn("text", F.coalesce("text", "kept"))
    apply_batch(log, again.select("path", "op", "text", F.lit(False).alias("cleared")), batch)


def current_graph(spark: SparkSession, log: ChangeLog) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges as of the last batch.

    An edge goes when a node at either end is cleared after the edge was
    written, also if the node's file is then parsed anew.
    """
    nodes = log.read(spark, "nodes", NODES)
    edges = log.read(spark, "edges", EDGES)
    cleared = log.read(spark, "cleared", _CLEARED).groupBy("file_path").agg(F.max("batch").alias("until"))
    marked = join_frontier(nodes, cut(cleared, "cleared"), "file_path", F.col("id"), "left")
    gone = F.col("batch") < F.col("until")
    alive = last_wins(marked.filter(F.coalesce(~gone, F.lit(True))), ["id"], ["batch"], NODE_COLUMNS)

    dead = cut(marked.filter(gone).groupBy("id").agg(F.max("until").alias("until")), "dead")
    kept = last_wins(edges, EDGE_KEY, ["batch"], [*EDGE_COLUMNS, "batch"])
    for end, other in (("source_id", "target_id"), ("target_id", "source_id")):
        died = Cut(dead.df.select(F.col("id").alias(end), "until"), dead.rows)
        kept = join_frontier(kept, died, end, F.col(other), "left").filter(
            F.col("until").isNull() | (F.col("batch") >= F.col("until"))
        ).drop("until")
    return alive, kept.select(*EDGE_COLUMNS)


def compact(spark: SparkSession, log: ChangeLog, folder: str) -> ChangeLog:
    """The current graph as the first batch of a new log."""
    return start_log(*current_graph(spark, log), folder)


def watch(
    events: DataFrame, log: ChangeLog, checkpoint: str,
    extensions: list[str] | None = None, available_now: bool = False, debounce_ms: int | None = None, late: str = "1 minute",
) -> StreamingQuery:
    """Apply a stream of (path, op, ts, text) events to a log, batch by batch.

    With ``debounce_ms`` bursts of a path are one change each, once the watermark is past them: open bursts with
    their last text and whether they cleared the path are state, so they survive restarts.  Events more than
    ``late`` behind are dropped, and counted in the query's progress (``numRowsDroppedByWatermark``).
    """
    picked = watched(events, extensions)

    def each(batch: DataFrame, number: int) -> None:
        apply_batch(log, latest_changes(batch, ["ts", "op"]), number)

    source = picked if debounce_ms is None else debounced_stream(picked, debounce_ms, late)
    writer = source.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
