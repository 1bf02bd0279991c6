"""The graph on disk: nodes once, edges laid out for both directions, and what is looked up by file or by word.

Each table is split into bucket folders by a hash of what it is looked up by, and each file inside is sorted by it, so
a lookup reads the folders of its keys and, in their files, the few pages whose value range holds them.  A bucket is
cut into slices by a hash of the next column, so the edges of a hub id are spread over many files and
many writing tasks instead of one.  There are as many tasks as the input has stretches of ``lineage.TASK_BYTES``, so what a
task sorts does not grow with the graph, and nothing is computed twice, as it would be to sample ranges.

A manifest names, for each table, the writes in use and the buckets in use of each.  A change writes the buckets it
touches anew and then swaps the manifest in one rename, so readers see all of it or nothing, and the rest of the
graph is neither read nor written.  Postings are not rewritten: a change appends to them and lists the nodes whose
earlier postings are dead, until ``MOST_DELTAS`` changes are folded.  One writer at a time is assumed.

What a change leaves of a bucket is written as it is read, without a shuffle, and what arrives is written beside it;
once that has left ``MOST_FILES`` times as many files as there need be, the buckets are laid out as at first.  A change applies to the tables that
are laid out; others can follow if they are made from those.
"""

from __future__ import annotations

import copy
import json
import uuid
from collections.abc import Callable
from dataclasses import asdict, dataclass, field
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.lineage import (
    Cut, bucket_column, bucket_of, cut, files_of, join_frontier, join_keyed, leave_out, shuffles_removed, small_reads, stored_buckets, tasks_of,
)
from symbolweave.operators.postings import (
    DEAD, GRAMS, NAME, PATH, POSTINGS, TERMS, StoredIndex, alive, figures_of, grams_of, postings_of, terms_of,
)
from symbolweave.operators.rank import in_degrees
from symbolweave.schema import EDGE_COLUMNS, EDGE_KEY, EDGES, EMBEDDINGS, NODE_COLUMNS, NODES

BUCKETS = 256
MOST_DELTAS = 16
MOST_FILES = 4  # for each file that a first layout has at most, before what a change touches is laid out again
SLICES = 1024  # of a bucket, dealt over tasks
TASKS = {"postings": 4, "grams": 4}  # for each stretch of nodes: these have several rows a node, and more in a hot word's bucket
WRITTEN = {"nodes": {"parquet.block.size": str(4 << 20)}}  # others are made from nodes, by tasks that read little: no row group is larger

DEGREES = T.StructType([T.StructField("id", T.StringType()), T.StructField("edge_count", T.LongType())])
MEMBERS = T.StructType([T.StructField("file_path", T.StringType()), T.StructField("id", T.StringType())])
# Each table's columns, and what it is bucketed (the first) and sorted by.
TABLES: dict[str, tuple[T.StructType, list[str]]] = {
    "nodes": (NODES, ["id"]),
    "edges_by_source": (EDGES, ["source_id", "target_id"]),
    "edges_by_target": (EDGES, ["target_id", "source_id"]),
    "degrees": (DEGREES, ["id"]),
    "members": (MEMBERS, ["file_path", "id"]),
    "postings": (POSTINGS, ["term", "id"]),
    "terms": (TERMS, ["start", "term"]),
    "grams": (GRAMS, ["gram", "id"]),
    "dead": (DEAD, ["id"]),
}
# The tables a graph is laid out in, each with the one it is made from.
LAYOUTS = {"nodes": None, "members": "nodes", "postings": "nodes", "terms": "postings", "grams": "nodes",
           "edges_by_source": None, "edges_by_target": None, "degrees": "edges_by_target"}


@dataclass(frozen=True)
class StoredEdges:
    """Edges in both layouts, each read when first asked for."""

    read: Callable[[str], DataFrame]

    @cached_property
    def by_source(self) -> DataFrame:
        return self.read("edges_by_source")

    @cached_property
    def by_target(self) -> DataFrame:
        return self.read("edges_by_target")


@dataclass(frozen=True)
class StoredGraph:
    """Tables of a saved graph, each read when first asked for; the bucket columns serve lookups only."""

    read: Callable[[str], DataFrame]
    index: StoredIndex

    @cached_property
    def bucketed_nodes(self) -> DataFrame:
        return self.read("nodes")

    @cached_property
    def links(self) -> StoredEdges:
        return StoredEdges(self.read)

    @cached_property
    def members(self) -> DataFrame:
        return self.read("members")

    @cached_property
    def degrees(self) -> DataFrame:
        """How many edges point at an id, kept with each bucket of edges by target."""
        return self.read("degrees")

    @property
    def nodes(self) -> DataFrame:
        return self.bucketed_nodes.select(*NODE_COLUMNS)

    @property
    def edges(self) -> DataFrame:
        return self.links.by_source.select(*EDGE_COLUMNS)


def out_of(edges: DataFrame | StoredEdges) -> DataFrame:
    """Edges laid out for lookups by source."""
    return edges.by_source if isinstance(edges, StoredEdges) else edges


def into(edges: DataFrame | StoredEdges) -> DataFrame:
    """Edges laid out for lookups by target."""
    return edges.by_target if isinstance(edges, StoredEdges) else edges


def arcs_of(edges: DataFrame, near: str, far: str) -> DataFrame:
    """Edges as (near, far, edge_kind), with the bucket of ``near`` if stored."""
    return edges.select(
        F.col(near).alias("near"), F.col(far).alias("far"), F.col("kind").alias("edge_kind"),
        *stored_buckets(edges),
    )


@dataclass
class Manifest:
    """What a graph consists of; its size follows the number of buckets.

    ``tables`` has, by table and write, how many buckets were written and which are in use; ``figures`` the
    rows and words of each bucket of nodes; ``dead`` how many rows the list of dead nodes has; ``lacking`` the
    tables that are not laid out yet.
    """

    buckets: int
    batch: int = 0
    deltas: int = 0
    dead: int = 0
    tables: dict[str, dict[str, tuple[int, list[int]]]] = field(default_factory=dict)
    figures: dict[str, tuple[int, int]] = field(default_factory=dict)
    lacking: list[str] = field(default_factory=list)

    def without(self, table: str, buckets: set[int]) -> None:
        """Put buckets of a table out of use."""
        held = {w: (n, [b for b in used if b not in buckets]) for w, (n, used) in self.tables.get(table, {}).items()}
        self.tables[table] = {w: (n, used) for w, (n, used) in held.items() if used}

    def add(self, table: str, write: str, buckets: list[int]) -> None:
        if buckets:
            self.tables.setdefault(table, {})[write] = (len(buckets), buckets)


def _pointer(spark: SparkSession, folder: str):
    """The file that holds the manifest in use, and the file system it is on."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/CURRENT")
    return path, path.getFileSystem(spark._jsc.hadoopConfiguration())


def manifest(spark: SparkSession, folder: str) -> Manifest | None:
    """The manifest in use; None before the first save."""
    path, system = _pointer(spark, folder)
    if not system.exists(path):
        return None
    stream = system.open(path)
    try:
        return Manifest(**json.loads(bytearray(stream.readAllBytes()).decode()))
    finally:
        stream.close()


def _publish(spark: SparkSession, folder: str, new: Manifest) -> None:
    """Point readers at a manifest, in one rename."""
    path, system = _pointer(spark, folder)
    path = path.makeQualified(system.getUri(), system.getWorkingDirectory())
    written = spark._jvm.org.apache.hadoop.fs.Path(path.getParent(), f"CURRENT-{uuid.uuid4().hex}")
    stream = system.create(written, True)
    stream.write(bytearray(json.dumps(asdict(new)).encode()))
    stream.close()
    kinds = getattr(spark._jvm.org.apache.hadoop.fs, "Options$Rename")
    over = spark.sparkContext._gateway.new_array(kinds, 1)
    over[0] = kinds.OVERWRITE
    context = spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(system.getUri(), spark._jsc.hadoopConfiguration())
    context.rename(written, path, over)


def _names(spark: SparkSession, path: str) -> list[str]:
    """The entries of a folder."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = at.getFileSystem(spark._jsc.hadoopConfiguration())
    return [entry.getPath().getName() for entry in system.listStatus(at)] if system.exists(at) else []


def _write(rows: DataFrame, folder: str, table: str, buckets: int | tuple[int, set[int]]) -> tuple[str, list[int]]:
    """Write rows of a table; the write's name and the buckets that have any.

    ``buckets`` is how many there are, or that and which of them rows fall into.  A task gets neighbouring slices of buckets.
    """
    buckets, into = buckets if isinstance(buckets, tuple) else (buckets, None)
    (schema, by), column = TABLES[table], bucket_column(buckets)
    laid_out = rows.select(*schema.fieldNames()).withColumn(column, bucket_of(by[0], buckets))
    path = f"{folder}/{table}/write={uuid.uuid4().hex}"
    stretches = tasks_of(rows, into)
    tasks = stretches * TASKS.get(table, 1) if stretches else int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    among = sorted(into) if into else range(buckets)
    place = F.get(F.array(*[F.lit(among.index(b) if b in among else 0) for b in range(buckets)]), F.col(column)) if into else F.col(column)
    slice_ = place.cast("long") * SLICES + F.pmod(F.hash(by[-1]), F.lit(SLICES))
    return _written(laid_out.repartitionById(tasks, F.floor(slice_ * tasks / (len(among) * SLICES)).cast("int")), table, column, path)


def _write_in_place(rows: DataFrame, folder: str, table: str, buckets: int) -> tuple[str, list[int]]:
    """Write rows that were read from a table's buckets and not shuffled since: by the tasks that read them, each in its order."""
    column, path = bucket_column(buckets), f"{folder}/{table}/write={uuid.uuid4().hex}"
    return _written(rows.select(*TABLES[table][0].fieldNames(), column), table, column, path)


def _written(rows: DataFrame, table: str, column: str, path: str) -> tuple[str, list[int]]:
    """Write dealt rows as sorted files below bucket folders; the write's name and the buckets that have any."""
    with small_reads(rows.sparkSession), shuffles_removed(rows.sparkSession):
        rows.sortWithinPartitions(column, *TABLES[table][1]).write.options(**WRITTEN.get(table, {})).partitionBy(column).parquet(path)
    return path.rsplit("=", 1)[1], sorted(int(n.split("=")[1]) for n in _names(rows.sparkSession, path) if n.startswith(column))


def _read(spark: SparkSession, folder: str, table: str, held: Manifest) -> DataFrame:
    if table in held.lacking:
        raise LookupError(f"{table} is not laid out in {folder}")
    schema, column = TABLES[table][0], bucket_column(held.buckets)
    layout = T.StructType([*schema.fields, T.StructField(column, T.IntegerType())])
    paths = []
    for write, (written, used) in held.tables.get(table, {}).items():
        at = f"{folder}/{table}/write={write}"
        paths += [at] if len(used) == written else [f"{at}/{column}={b}" for b in used]
    if not paths:
        return spark.createDataFrame([], layout)
    return spark.read.option("basePath", f"{folder}/{table}").schema(layout).parquet(*paths).select(*layout.fieldNames())


def load_graph(spark: SparkSession, folder: str) -> StoredGraph:
    held = manifest(spark, folder)
    if held is None:
        raise FileNotFoundError(f"no graph in {folder}")
    return _loaded(spark, folder, held)


def _loaded(spark: SparkSession, folder: str, held: Manifest) -> StoredGraph:
    def read(table: str) -> DataFrame:
        return _read(spark, folder, table, held)

    rows, length = (sum(f[k] for f in held.figures.values()) for k in (0, 1))
    return StoredGraph(read, StoredIndex(read, held.dead, rows, length))


def _figures(spark: SparkSession, folder: str, held: Manifest, buckets: set[int] | None = None) -> dict[str, tuple[int, int]]:
    """Rows and words of buckets of nodes."""
    column = bucket_column(held.buckets)
    nodes = _read(spark, folder, "nodes", held)
    if buckets is not None:
        nodes = nodes.filter(F.col(column).isin(sorted(buckets)))
    found = figures_of(nodes, column).collect()
    return {str(r[0]): (r.rows, r.words) for r in found}


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str, buckets: int = BUCKETS, tables: list[str] | None = None) -> None:
    """Write a whole graph; readers switch over once all of it is there.

    What fails half-way leaves the graph in use as it was.  Earlier writes stay, for readers that began on them;
    ``remove_old`` deletes them.  With ``tables`` only those are laid out, and what they are made from; ``lay_out`` adds others.
    """
    _publish(edges.sparkSession, folder, _laid_out(nodes, edges, folder, Manifest(buckets, lacking=list(LAYOUTS)), tables))


def lay_out(nodes: DataFrame, edges: DataFrame, folder: str, tables: list[str]) -> None:
    """Add tables that a graph lacks, out of the rows it was saved from; of a graph that was changed since, out of its other tables."""
    held = manifest(edges.sparkSession, folder)
    if set(tables) & set(held.lacking):
        if held.batch and {"edges_by_source", "edges_by_target"} <= set(held.lacking) and set(tables) & {"edges_by_source", "edges_by_target", "degrees"}:
            raise LookupError(f"edges were not laid out in {folder} when it was changed")
        _publish(edges.sparkSession, folder, _laid_out(nodes, edges, folder, held, tables))


def _laid_out(nodes: DataFrame, edges: DataFrame, folder: str, new: Manifest, tables: list[str] | None) -> Manifest:
    spark, wanted = edges.sparkSession, set(LAYOUTS if tables is None else tables)
    for table in reversed(LAYOUTS):
        if table in wanted and LAYOUTS[table]:
            wanted.add(LAYOUTS[table])
    made = {
        "nodes": lambda: nodes, "members": lambda: _read(spark, folder, "nodes", new),
        "postings": lambda: postings_of(_read(spark, folder, "nodes", new), new.batch),
        "terms": lambda: terms_of(_read(spark, folder, "postings", new)),
        "grams": lambda: grams_of(_read(spark, folder, "nodes", new), new.batch),
        "edges_by_source": lambda: edges if "edges_by_target" in new.lacking else _read(spark, folder, "edges_by_target", new),
        "edges_by_target": lambda: edges if "edges_by_source" in new.lacking else _read(spark, folder, "edges_by_source", new),
        "degrees": lambda: in_degrees(_read(spark, folder, "edges_by_target", new)),
    }
    for table in LAYOUTS:
        if table in wanted and table in new.lacking:
            new.add(table, *_write(made[table](), folder, table, new.buckets))
            new.lacking.remove(table)
            if table == "postings":
                new.figures = _figures(spark, folder, new)
    return new


def replace_edges(edges: DataFrame, folder: str) -> None:
    """Write all edges anew and leave the nodes as they are."""
    new = manifest(edges.sparkSession, folder)
    made = ["edges_by_source", "edges_by_target", "degrees"]
    for table in made:
        new.tables[table] = {}
    new.lacking += [t for t in made if t not in new.lacking]
    _publish(edges.sparkSession, folder, _laid_out(edges, edges, folder, new, made))


def _touched(keys: DataFrame, key: str, buckets: int) -> set[int]:
    """The buckets some keys fall into: no more than there are."""
    return {r.b for r in keys.select(bucket_of(key, buckets).alias("b")).distinct().collect()}


class _Change:
    """A change of a stored graph, which is there once it is published."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder
        self.new = manifest(spark, folder)
        if "nodes" in self.new.lacking:
            raise LookupError(f"nodes are not laid out in {folder}")
        self.held = _loaded(spark, folder, copy.deepcopy(self.new))  # the graph before the change
        self.new.batch += 1
        self.column = bucket_column(self.new.buckets)
        self.rewritten: dict[str, int] = {}

    def touched(self, keys: DataFrame, key: str) -> set[int]:
        return _touched(keys, key, self.new.buckets)

    def has(self, *tables: str) -> bool:
        """Whether any of some tables is laid out."""
        return not set(tables) <= set(self.new.lacking)

    def rewrite(self, table: str, buckets: Callable[[], set[int]], left: Callable[[DataFrame], DataFrame], arriving: DataFrame | None = None) -> None:
        """Write some buckets of a table anew: what is left of their rows, which ``left`` does not shuffle, and what arrives."""
        if not self.has(table):
            return
        buckets = buckets()
        self.rewritten[table] = len(buckets)
        if not buckets:
            return
        stored = self.held.read(table)
        kept = left(stored.filter(F.col(self.column).isin(sorted(buckets))))
        files = sum(map(len, files_of(stored, buckets).values()))
        if files <= MOST_FILES * ((tasks_of(stored, buckets) or 0) + len(buckets)):
            written = [_write_in_place(kept, self.folder, table, self.new.buckets)]
            if arriving is not None:
                written.append(_write(arriving, self.folder, table, (self.new.buckets, buckets)))
        else:
            kept = kept.drop(self.column)
            written = [_write(kept if arriving is None else kept.unionByName(arriving), self.folder, table, (self.new.buckets, buckets))]
        self.new.without(table, buckets)
        for write, found in written:
            self.new.add(table, write, found)
        if table == "edges_by_target" and self.has("degrees"):  # ids and targets fall into the same buckets
            there = _read(self.spark, self.folder, table, self.new).filter(F.col(self.column).isin(sorted(buckets)))
            write, found = _write(in_degrees(there), self.folder, "degrees", (self.new.buckets, buckets))
            self.new.without("degrees", buckets)
            self.new.add("degrees", write, found)

    def append(self, table: str, rows: DataFrame) -> None:
        self.new.add(table, *_write(rows, self.folder, table, self.new.buckets))

    def die(self, ids: Cut) -> None:
        """Nodes whose postings before this change are dead."""
        if ids.rows and self.has("postings", "grams"):
            self.append("dead", ids.df.select("id", F.lit(self.new.batch).cast("long").alias("until")))
            self.new.dead += ids.rows

    def publish(self, buckets: set[int]) -> dict[str, int]:
        """Make the change seen; ``buckets`` are those of nodes that it rewrote.  How many buckets of each table were."""
        for bucket in map(str, buckets):
            self.new.figures.pop(bucket, None)
        if buckets and self.has("postings"):
            self.new.figures |= _figures(self.spark, self.folder, self.new, buckets)
        self.new.deltas += 1
        if self.new.deltas >= MOST_DELTAS:
            _fold(self.spark, self.folder, self.new)
        _publish(self.spark, self.folder, self.new)
        return self.rewritten


def _fold(spark: SparkSession, folder: str, new: Manifest) -> None:
    """Write the live postings and their words anew, without what changes left behind."""
    held, column = _loaded(spark, folder, copy.deepcopy(new)), bucket_column(new.buckets)
    written = {}
    if "postings" not in new.lacking:
        written["postings"] = _write(alive(held.index.postings.drop(column), held.index.dead), folder, "postings", new.buckets)
    if "grams" not in new.lacking:
        grams = held.index.grams.drop(column)
        paths = grams.filter(F.col("place") == PATH).withColumn("batch", F.lit(new.batch).cast("long")).distinct()
        there = held.bucketed_nodes if "members" in new.lacking else held.members
        paths = paths.join(there.select(F.col("file_path").alias("id")), "id", "left_semi")
        parts = alive(grams.filter(F.col("place") == NAME), held.index.dead).unionByName(paths)
        written["grams"] = _write(parts, folder, "grams", new.buckets)
    for table in ("postings", "terms", "grams", "dead"):
        new.tables[table] = {}
    for table, found in written.items():
        new.add(table, *found)
    if "terms" not in new.lacking:
        new.add("terms", *_write(terms_of(_read(spark, folder, "postings", new)), folder, "terms", new.buckets))
    new.deltas = new.dead = 0


def merge_rows(nodes: DataFrame, edges: DataFrame, folder: str) -> dict[str, int]:
    """Put nodes (one row an id) and edges (one row a key) over a stored graph; how many buckets were written anew.

    Arriving rows are counted first: a small batch is broadcast, and of a larger one the hashes leave out stored rows.
    """
    change = _Change(nodes.sparkSession, folder)
    held, arrived, links = change.held, cut(nodes.select(*NODE_COLUMNS), "arrived"), cut(edges.select(*EDGE_COLUMNS), "arrived")
    ids = Cut(arrived.df.select("id"), arrived.rows)
    here = change.touched(ids.df, "id")
    change.rewrite("nodes", lambda: here, lambda rows: leave_out(rows, ids, ["id"]), arrived.df)
    if change.has("members", "postings", "grams"):
        before = cut(join_keyed(held.bucketed_nodes, ids, "id", "left_semi").select("id", "file_path"), "before")
        placed = arrived.df.select("file_path", "id")
        files = before.df.select("file_path").union(placed.select("file_path"))
        change.rewrite("members", lambda: change.touched(files, "file_path"), lambda rows: leave_out(rows, ids, ["id"]), placed)
    keys = Cut(links.df.select(*EDGE_KEY), links.rows)
    for table, end in (("edges_by_source", "source_id"), ("edges_by_target", "target_id")):
        change.rewrite(table, lambda end=end: change.touched(links.df, end), lambda rows: leave_out(rows, keys, EDGE_KEY), links.df)
    if arrived.rows and change.has("postings"):
        written = cut(postings_of(arrived.df, change.new.batch), "postings").df
        change.append("postings", written)
        if change.has("terms"):
            change.append("terms", terms_of(written))
    if arrived.rows and change.has("grams"):
        change.append("grams", grams_of(arrived.df, change.new.batch))
    if change.has("postings", "grams"):
        change.die(Cut(before.df.select("id"), before.rows))
    return change.publish(here)


def delete_files(paths: DataFrame, folder: str, purge_file_edges: bool = False) -> dict[str, int]:
    """Drop the nodes of some files and every edge that touches one; how many buckets were written anew.

    Edges whose source is the bare file path stay unless ``purge_file_edges``.  Nodes too many to broadcast are taken
    to have edges in every bucket.
    """
    change = _Change(paths.sparkSession, folder)
    held, every = change.held, set(range(change.new.buckets))
    files = cut(paths.select("file_path").distinct(), "files")
    placed = held.members if change.has("members") else held.bucketed_nodes.select("id", "file_path")
    gone = cut(join_frontier(placed, files, "file_path", F.col("id"), "left_semi").select("id"), "gone")

    here = change.touched(gone.df, "id")
    change.rewrite("nodes", lambda: here, lambda rows: leave_out(rows, gone, ["id"]))
    change.rewrite("members", lambda: change.touched(files.df, "file_path"), lambda rows: leave_out(rows, files, ["file_path"]))

    def laid_out_by(end: str) -> DataFrame:
        """Edges to be looked up by an end: in the layout for it, or else in the other."""
        table, other = ("edges_by_source", "edges_by_target") if end == "source_id" else ("edges_by_target", "edges_by_source")
        return held.read(table) if change.has(table) else held.read(other).select(*EDGE_COLUMNS)

    def touched(near: str, far: str) -> set[int]:
        """The buckets, by their near end, of the edges that go."""
        if not gone.small:
            return every
        ids = Cut(gone.df.withColumnRenamed("id", far), gone.rows)
        found = here | change.touched(join_frontier(laid_out_by(far), ids, far, F.col(near), "left_semi").select(near), near)
        if purge_file_edges:
            found |= change.touched(own.df, near)
        return found

    def kept(rows: DataFrame) -> DataFrame:
        rows = leave_out(rows, gone, ["source_id"], ["target_id"])
        return leave_out(rows, files, ["file_path"]) if purge_file_edges else rows

    if purge_file_edges and change.has("edges_by_source", "edges_by_target"):
        edges = laid_out_by("source_id").select("source_id", "target_id", "file_path")
        own = cut(join_frontier(edges, files, "file_path", F.col("source_id"), "left_semi"), "own")
    change.rewrite("edges_by_source", lambda: touched("source_id", "target_id"), kept)
    change.rewrite("edges_by_target", lambda: touched("target_id", "source_id"), kept)
    change.die(gone)
    return change.publish(here)


def nodes_of_files(graph: StoredGraph, paths: Cut) -> DataFrame:
    """The nodes of some files: their ids by file, then those ids' buckets."""
    ids = cut(join_frontier(graph.members, paths, "file_path", F.col("id"), "left_semi").select("id"), "members")
    return join_keyed(graph.bucketed_nodes, ids, "id").select(*NODE_COLUMNS)


def remove_old(spark: SparkSession, folder: str) -> int:
    """Delete the writes that are in use no more; how many there were."""
    held, gone = manifest(spark, folder), 0
    for table in TABLES if held else ():
        for name in _names(spark, f"{folder}/{table}"):
            if name.startswith("write=") and name[6:] not in held.tables.get(table, {}):
                path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{table}/{name}")
                gone += bool(path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True))
    return gone


def save_embeddings(embeddings: DataFrame, folder: str) -> None:
    embeddings.write.mode("overwrite").parquet(f"{folder}/embeddings")


def load_embeddings(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.schema(EMBEDDINGS).parquet(f"{folder}/embeddings")


def vector_of(embeddings: DataFrame, node_id: str) -> DataFrame:
    return embeddings.filter(F.col("node_id") == node_id)
