"""A saved graph and everything that can be asked of it.

Every method returns a DataFrame that is not yet computed, apart from the rounds
of a traversal; nothing of the graph is held in the driver.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolweave.lineage import Cut, cut, scope
from symbolweave.operators import lookup, neighbours, outline, postings, rank, resolve, similar, upsert, walks
from symbolweave.plans.parse import index_counts, parse, parsed_edges, parsed_nodes
from symbolweave.schema import EDGE_KEY, EDGES, NODES
from symbolweave.sources import routes, scip, store, tree
from symbolweave.streaming import files, watch


class CodeGraph:
    def __init__(self, spark: SparkSession, folder: str, buckets: int = store.BUCKETS):
        self.spark, self.folder, self.buckets = spark, folder.rstrip("/"), buckets

    # building

    def save(self, nodes: DataFrame, edges: DataFrame) -> "CodeGraph":
        store.save_graph(nodes, edges, self.folder, self.buckets)
        return self

    def init(self) -> "CodeGraph":
        """An empty graph where there is none; one that is there stays as it is."""
        if store.manifest(self.spark, self.folder):
            return self
        return self.save(self.spark.createDataFrame([], NODES), self.spark.createDataFrame([], EDGES))

    def index(
        self, root: str, extensions: list[str] | None = None, with_routes: bool = False,
        scip_index: str | None = None,
    ) -> DataFrame:
        """Parse a source tree into this graph; returns the counts.

        What it finds is merged over what the graph holds.  Files are parsed once, into a
        written table that the counts, nodes and edges are then read from; files that cannot be
        read are listed by ``tree.read_tree``, with their errors.
        """
        sources = tree.read_tree(self.spark, root, extensions)
        parsed = cut(parse(sources), "parsed").df
        counts = index_counts(sources.select("path", "error"), parsed)
        nodes, edges = parsed_nodes(parsed), parsed_edges(parsed)
        if with_routes:
            found = routes.index_routes(tree.read_all_texts(self.spark, root), root)
            nodes = nodes.join(found, "id", "left_anti").unionByName(found)
        if scip_index:
            documents = scip.read_index(self.spark, scip_index)
            fresh, links, _ = scip.convert(documents, root.rstrip("/"), nodes)
            nodes = nodes.unionByName(fresh)
            kept = edges.join(links, ["source_id", "target_id", "kind"], "left_anti")
            edges = kept.select(*links.columns).unionByName(links)
        self.merge(nodes, edges)
        return counts

    def merge(self, nodes: DataFrame, edges: DataFrame) -> dict[str, int]:
        """Put rows over those of this graph with the same key; of rows with one key, the one on the latest line.

        Only the buckets they fall into are written anew; how many, by table.
        """
        self.init()
        newest = (upsert.last_wins(nodes, ["id"], ["line_start", "name"], NODES.fieldNames()),
                  upsert.last_wins(edges, EDGE_KEY, ["line_number", "file_path"], EDGES.fieldNames()))
        return store.merge_rows(*newest, self.folder)

    def resolve(self) -> "CodeGraph":
        """Point edges with bare names at the nodes they mean, where that is one; see ``operators.resolve``."""
        store.replace_edges(resolve.resolve_edges(self.nodes, self.edges), self.folder)
        return self

    def delete_file(self, file_path: str, purge_file_edges: bool = False) -> dict[str, int]:
        """Drop a file's nodes and every edge that touches one; how many buckets were written anew, by table."""
        return self.delete_files([file_path], purge_file_edges)

    def delete_files(self, file_paths: list[str], purge_file_edges: bool = False) -> dict[str, int]:
        paths = self.spark.createDataFrame([(p,) for p in file_paths], "file_path string")
        return store.delete_files(paths, self.folder, purge_file_edges)

    def watch(self, root: str, state: str, extensions: list[str] | None = None) -> int:
        """Bring this graph up to date with a source tree; the number of files that changed since the last time.

        ``state`` keeps listings, the stream's checkpoint, and the table of files that could not be read
        (``bad_files``).  Call it as often as the graph should follow; what fails half-way is done by the next call.
        """
        self.init()
        number = files.take_snapshot(self.spark, root, state, extensions)
        changed = 0

        def each(batch: DataFrame, number: int) -> None:
            nonlocal changed
            with scope(self.spark):
                changes = cut(files.latest_with_texts(batch, root), "latest")
                changed += changes.rows
                gone = changes.df.filter("cleared").select(F.col("path").alias("file_path"))
                store.delete_files(gone, self.folder)
                parsed, fates = watch.parsed_changes(changes.df)
                self.merge(parsed_nodes(parsed.df), parsed_edges(parsed.df))
                fates.write.mode("overwrite").parquet(f"{state}/fates/batch={number}")

        files.catch_up(self.spark, state, each, f"{state}/checkpoint", number)
        return changed

    def bad_files(self, state: str) -> DataFrame:
        """(path, op, text, error, batch) of the watched files that could not be read or parsed when they last changed."""
        return watch.bad_records(self.spark, watch.ChangeLog(state))

    def merged(self, nodes: DataFrame, edges: DataFrame, order: list[str], folder: str) -> "CodeGraph":
        """This graph with rows merged over it, saved to another folder."""
        into = CodeGraph(self.spark, folder, self.buckets)
        return into.save(
            upsert.upsert_nodes(self.nodes, nodes, order), upsert.upsert_edges(self.edges, edges, order)
        )

    # tables

    @property
    def _stored(self) -> store.StoredGraph:
        return store.load_graph(self.spark, self.folder)

    @property
    def nodes(self) -> DataFrame:
        return self._stored.nodes

    @property
    def edges(self) -> DataFrame:
        return self._stored.edges

    @property
    def embeddings(self) -> DataFrame:
        return store.load_embeddings(self.spark, self.folder)

    # questions

    def node(self, node_id: str) -> DataFrame:
        return lookup.node_by_id(self._bucket_of(node_id), node_id)

    def node_with_source(self, node_id: str, root: str) -> DataFrame:
        """A node and its file's text; only that file is opened."""
        nodes = self._bucket_of(node_id)
        found = lookup.node_by_id(nodes, node_id).select("file_path").first()
        texts = tree.read_text(self.spark, root, found.file_path if found else "")
        return lookup.node_with_source(nodes, texts, node_id)

    def _bucket_of(self, node_id: str) -> DataFrame:
        """The nodes of the bucket an id falls into."""
        stored = self._stored.bucketed_nodes
        column = store.stored_buckets(stored)[0]
        bucket = store.bucket_of(F.lit(node_id), int(column.rsplit("_", 1)[1]))
        return stored.filter(F.col(column) == bucket).select(*NODES.fieldNames())

    def nodes_in_file(self, file_path: str) -> DataFrame:
        """A file's nodes, by the ids listed under it."""
        path = self.spark.createDataFrame([(file_path,)], "file_path string")
        return lookup.nodes_in_file(store.nodes_of_files(self._stored, Cut(path, 1)), file_path)

    def search(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        stored = self._stored
        return postings.search(stored.bucketed_nodes, stored.index, query, kind, limit)

    def search_prefix(self, query: str, kind: str | None = None, limit: int = 50) -> DataFrame:
        stored = self._stored
        return postings.search_prefix(stored.bucketed_nodes, stored.index, query, kind, limit)

    def search_members(self, query: str, kind: str | None = None, limit: int = 20) -> DataFrame:
        stored = self._stored
        return postings.search_members(stored.bucketed_nodes, stored.index, query, kind, limit)

    def callers(self, node_id: str, depth: int = 1) -> DataFrame:
        return neighbours.callers(self._stored.bucketed_nodes, self._stored.links, node_id, depth)

    def callees(self, node_id: str, depth: int = 1) -> DataFrame:
        return neighbours.callees(self._stored.bucketed_nodes, self._stored.links, node_id, depth)

    def impact(self, node_id: str, depth: int = 3) -> DataFrame:
        return neighbours.impact_radius(self._stored.bucketed_nodes, self._stored.links, node_id, depth)

    def trace(self, source: str, target: str) -> DataFrame:
        return walks.trace_path(self._stored.links, source, target)

    def trace_walks(self, source: str, target: str) -> DataFrame:
        return walks.trace_walks(self._stored.links, source, target)

    def caller_edges(self, node_id: str, depth: int = 1) -> DataFrame:
        walk = walks.caller_edges(self._stored.links, node_id, depth)
        return walks.labelled(walk, self._stored.bucketed_nodes, ["source_id"])

    def callee_edges(self, node_id: str, depth: int = 1) -> DataFrame:
        walk = walks.callee_edges(self._stored.links, node_id, depth)
        return walks.labelled(walk, self._stored.bucketed_nodes, ["target_id"])

    def impact_edges(self, node_id: str, depth: int = 3) -> DataFrame:
        walk = walks.impact_edges(self._stored.links, node_id, depth)
        return walks.labelled(walk, self._stored.bucketed_nodes, ["source_id", "target_id"])

    def impact_names(self, node_id: str, depth: int = 3) -> DataFrame:
        return walks.impact_names(walks.impact_edges(self._stored.links, node_id, depth), self.nodes)

    def symbols_with_callers(self, query: str, limit: int = 10) -> DataFrame:
        return neighbours.symbols_with_callers(
            self.search(query, limit=limit), self._stored.bucketed_nodes, self._stored.links)

    def rankings(self, limit: int = 50) -> DataFrame:
        stored = self._stored
        return rank.ranked_by(stored.bucketed_nodes, stored.degrees, limit).select(*NODES.fieldNames(), "edge_count")

    def file_summary(self, limit: int = 20) -> DataFrame:
        return rank.file_summary(self.nodes, self.edges, limit)

    def top_symbols(self, limit: int = 20) -> DataFrame:
        return rank.top_symbols(self.nodes, self.edges, limit)

    def ranked_context(self, max_nodes: int = 30) -> DataFrame:
        return rank.ranked_context(self.nodes, self.edges, max_nodes)

    def context(self, task: str, max_nodes: int = 15) -> DataFrame:
        return outline.by_basename(self.search(task, limit=max_nodes))

    def name_context(self, task: str, max_nodes: int = 30) -> DataFrame:
        stored = self._stored
        return postings.name_contains_any(stored.bucketed_nodes, stored.index, task, max_nodes)

    def explore(self, query: str) -> DataFrame:
        stored = self._stored
        return outline.by_file(postings.explore(stored.bucketed_nodes, stored.index, query))

    def validate(self) -> DataFrame:
        return rank.validation_report(self.nodes, self.edges)

    def status(self) -> DataFrame:
        return rank.status(self.nodes, self.edges)

    def export(self, folder: str) -> None:
        lookup.write_export(self.nodes, self.edges, folder)

    # vectors

    def embed(self, make_embedder: Callable[[], similar.Embedder] | None = None, model: str = "local") -> int:
        """Store a vector per node; without an embedder, hashed word counts."""
        if make_embedder:
            vectors = similar.index_embeddings(self.nodes, make_embedder, model)
        else:
            vectors = similar.hashed_embeddings(self.nodes)
        store.save_embeddings(vectors, self.folder)
        return self.embeddings.count()

    def similar(self, vector: Sequence[float], limit: int = 10) -> DataFrame:
        return similar.search_similar(self.nodes, self.embeddings, vector, limit)

    def similar_text(self, text: str, limit: int = 10) -> DataFrame:
        """For graphs embedded without an embedder."""
        return self.similar(similar.hashed_query(self.spark, text), limit)
