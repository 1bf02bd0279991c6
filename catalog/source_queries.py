"""Queries over source files, routes, indexer output and logs derived from the tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from catalog.source_texts import SOURCES
from symbolweave.functions import names
from symbolweave.functions.names import lookup
from symbolweave.operators import similar
from symbolweave.plans import parse
from symbolweave.sources import dependency_maps, repos, routes, runlog, scip, tree
from symbolweave.sources.tables import read_table, table_nodes


def written_sources(spark: SparkSession, folder: str) -> DataFrame:
    """One source file per order, in one of twelve languages."""
    # Three narrow columns are spread out, so that parsing uses every core.
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    number = (F.col("o_orderkey") % len(SOURCES)).cast("string")
    text = lookup(number, {str(i): s[1] for i, s in enumerate(SOURCES)})
    for mark, column in (("@k", "o_orderkey"), ("@c", "o_custkey"), ("@s", "o_orderstatus")):
        text = F.replace(text, F.lit(mark), F.col(column).cast("string"))
    path = F.concat(
        F.lit("src/"), "o_orderstatus", F.lit("/o"), F.col("o_orderkey").cast("string"),
        lookup(number, {str(i): s[0] for i, s in enumerate(SOURCES)}),
    )
    return orders.select(
        path.alias("path"), tree.language_of(path).alias("language"), text.alias("text"),
        F.lit(None).cast("string").alias("error"),
    )


def parse_symbols(spark, folder):
    return parse.parsed_nodes(parse.parse(written_sources(spark, folder)))


def parse_edges(spark, folder):
    return parse.parsed_edges(parse.parse(written_sources(spark, folder)))


def index_counts(spark, folder):
    files = written_sources(spark, folder)
    return parse.index_counts(files, parse.parse(files))


def page_script_calls(spark, folder):
    """Calls made in the inline scripts of web pages, by name."""
    pages = read_table(spark, folder, "pages")
    scripts = F.array_join(F.regexp_extract_all("html", F.lit(r"(?s)<script>(.*?)</script>"), 1), "\n")
    files = pages.select(
        F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".js")).alias("path"),
        F.lit("typescript").alias("language"), scripts.alias("text"),
    )
    calls = parse.parsed_references(parse.parse(files)).filter(F.col("kind") == "calls")
    return calls.groupBy("target_id").agg(
        F.count("*").alias("times"), F.count_distinct("source_id").alias("pages")
    )


def tree_filter(spark, folder):
    """Which of the documents' paths a tree scan would index, by language."""
    documents = read_table(spark, folder, "documents")
    key = F.col("doc_id")
    folders = ["src", "lib/node_modules", "app/.git/hooks", "dist", "web/src", "builds"]
    extensions = [".py", ".TS", ".js", ".tsx", ".go", ".txt", ".h", ".tar.gz", "", ".scala", ".kts"]
    at = lambda values, n: F.element_at(F.array(*[F.lit(v) for v in values]), (n + 1).cast("int"))
    path = F.concat(
        "source", F.lit("/"), at(folders, key % len(folders)), F.lit("/f"), key.cast("string"),
        at(extensions, key % len(extensions)),
    )
    return (
        documents.filter(tree.is_source(path))
        .groupBy(tree.language_of(path).alias("language"))
        .agg(F.count("*").alias("files"))
    )


def written_routes(spark: SparkSession, folder: str) -> DataFrame:
    """Web application files: one per order, plus what marks the frameworks."""
    orders = read_table(spark, folder, "orders")
    k = F.col("o_orderkey").cast("string")
    kind = F.col("o_orderkey") % 4
    text = (
        F.when(kind == 0, F.concat(
            F.lit("urlpatterns = [\n  path('a"), k, F.lit("/', V.as_view()),\n  re_path('b"), k,
            F.lit("/', W.as_view()),\n  path('c/',\n V.as_view())\n]")))
        .when(kind == 1, F.concat(
            F.lit("@app.route('/f"), k, F.lit("')\ndef f(): pass\n@api.get(\"/g"), k, F.lit("\")\ndef g(): pass\n")))
        .when(kind == 2, F.concat(
            F.lit("app.get('/x"), k, F.lit("', show)\nrouter.use(\"/y"), k, F.lit("\",  handler)\napp.get('z', no)\n")))
        .otherwise(F.concat(F.lit("flask and django, order "), k))
    )
    file_name = (
        F.when(kind == 0, "urls.py").when(kind == 1, "app.py").when(kind == 2, "web.js").otherwise("requirements.txt")
    )
    made = orders.select(F.concat(F.lit("root/o"), k, F.lit("/"), file_name).alias("path"), text.alias("text"))
    package = read_table(spark, folder, "region").agg(F.min("r_name").alias("r_name")).select(
        F.lit("root/package.json").alias("path"),
        F.concat(F.lit('{"name": "'), "r_name", F.lit('", "devDependencies": {"express": "4"}}')).alias("text"),
    )
    return made.unionByName(package)


def framework_detect(spark, folder):
    return routes.detect_frameworks(written_routes(spark, folder), "root")


def route_extract(spark, folder):
    return routes.index_routes(written_routes(spark, folder), "root")


def _indexer_documents(spark: SparkSession, folder: str) -> DataFrame:
    """Indexer output: an order defines a class and a method, and uses its customer's."""
    orders = read_table(spark, folder, "orders").select("o_orderkey", "o_custkey", "o_orderstatus")
    orders = orders.repartition(spark.sparkContext.defaultParallelism, "o_orderkey")
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")

    def occurrence(symbol: Column, roles: int) -> Column:
        return F.struct(symbol.alias("symbol"), F.lit(roles).alias("symbol_roles"))

    own = F.concat(F.lit("s npm pkg 1 src/`o"), k, F.lit(".ts`/Order"), k, F.lit("#"))
    return orders.select(
        F.col("o_orderkey").alias("doc_no"),
        F.concat(F.lit("src/o"), k, F.lit(".ts")).alias("relative_path"),
        F.array(
            occurrence(own, 1),
            occurrence(F.concat(own, F.lit("total().")), 1),
            occurrence(F.concat(F.lit("s npm pkg 1 src/c/buyer"), c, F.lit("().")), 1),
            occurrence(F.concat(F.lit("s npm pkg 1 src/c/flag"), F.col("o_orderstatus")), 3),
            occurrence(F.lit("local 7"), 1),
            occurrence(F.concat(own, F.lit("total().(tax)")), 1),
            occurrence(F.concat(F.lit("s npm pkg 1 src/c/buyer"), c, F.lit("().")), 0),
            occurrence(F.concat(F.lit("s npm pkg 1 src/c/flag"), F.col("o_orderstatus")), 0),
            occurrence(own, 0),
            occurrence(own, 0),
            occurrence(F.lit("s npm pkg 1 src/none/gone()."), 0),
            occurrence(own, 2),
        ).alias("occurrences"),
        F.array(
            F.struct(F.concat(F.lit("s npm pkg 1 src/x/Extra"), k, F.lit("#")).alias("symbol")),
            F.struct(F.concat(F.lit("s npm pkg 1 src/x/plain"), k).alias("symbol")),
        ).alias("symbols"),
    )


def _indexed(spark, folder):
    """Converted over a store of every table's nodes, which already holds one order file's class."""
    moved = F.when(F.col("id") == "orders:0", F.lit("/repo/src/o0.ts:Order0"))
    held = table_nodes(spark, folder).withColumns({
        "kind": F.when(moved.isNotNull(), F.lit("function")).otherwise(F.col("kind")),
        "id": F.coalesce(moved, "id"),
    })
    return scip.convert(_indexer_documents(spark, folder), "/repo", held)


def scip_nodes(spark, folder):
    return _indexed(spark, folder)[0]


def scip_edges(spark, folder):
    return _indexed(spark, folder)[1]


def scip_counts(spark, folder):
    return _indexed(spark, folder)[2]


def scip_symbol_parse(spark, folder):
    """Every symbol shape, for every part."""
    parts = read_table(spark, folder, "part")
    k = F.col("p_partkey").cast("string")
    shapes = [
        F.concat(F.lit("s a/`f.py`/Part"), k, F.lit("#")),
        F.concat(F.lit("s a/`f.py`/Part"), k, F.lit("#size().")),
        F.concat(F.lit("s a/Part"), k, F.lit("#size().(unit)")),
        F.concat(F.lit("local "), k),
        F.concat(F.lit("s a/`make"), k, F.lit("`().")),
        F.concat(F.lit("s a/make"), k, F.lit("().inner")),
        F.concat(F.lit("s a/make"), k, F.lit("(+1).")),
        F.concat(F.lit("s a/value"), k, F.lit("`")),
        F.concat(F.lit("s a/dir"), k, F.lit("/")),
        F.concat(F.lit("s a/Part"), k, F.lit("#deep#name.")),
    ]
    symbol = F.element_at(F.array(*shapes), (F.col("p_partkey") % len(shapes) + 1).cast("int"))
    parsed = names.indexed_symbol(symbol)
    return parts.select(
        F.col("p_partkey"), symbol.alias("symbol"), parsed["name"].alias("name"), parsed["kind"].alias("kind")
    )


def git_url_parse(spark, folder):
    parts = read_table(spark, folder, "part")
    k, owner = F.col("p_partkey").cast("string"), F.regexp_replace(F.lower("p_type"), " ", "-")
    repo = F.concat(F.lit("repo"), k)
    urls = [
        F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo),
        F.concat(F.lit(" http://www.github.com/"), owner, F.lit("/"), repo, F.lit(".git/")),
        F.concat(F.lit("https://github.com/"), owner, F.lit("/"), repo, F.lit("/tree/dev/src/a b")),
        F.concat(F.lit("git@github.com:"), owner, F.lit("/"), repo, F.lit(".git")),
        F.concat(F.lit("https://gitlab.com/"), owner, F.lit("/"), repo, F.lit("/-/tree/v1")),
        F.concat(F.lit("https://bitbucket.org/"), owner, F.lit("/"), repo, F.lit("/src/main/lib/")),
        F.concat(F.lit("https://example.com/"), owner, F.lit("/"), repo),
        F.concat(F.lit("https://github.com/gitlab/"), repo),
    ]
    url = F.element_at(F.array(*urls), (F.col("p_partkey") % len(urls) + 1).cast("int"))
    r = names.repository(url)
    return parts.select(
        "p_partkey", r["platform"].alias("platform"), r["owner"].alias("owner"), r["name"].alias("name"),
        r["branch"].alias("branch"), r["subpath"].alias("subpath"),
        names.archive_address(r["platform"], r["owner"], r["name"], r["branch"]).alias("archive_url"),
    )


def head_commit(spark, folder):
    """The commit of archive responses: in the file name, in the address, or absent."""
    parts = read_table(spark, folder, "part")
    sha = F.substring(F.md5(F.col("p_partkey").cast("string")), 1, 10)
    case = F.col("p_partkey") % 3
    disposition = F.when(case == 0, F.concat(F.lit("attachment; filename=own-repo-"), sha, F.lit(".zip")))
    address = F.when(case == 1, F.concat(F.lit("https://host/own/"), sha, F.lit("/"))).otherwise("https://host/own/main")
    return parts.select("p_partkey", names.head_commit(disposition, address).alias("commit"))


def _repos(spark, folder) -> DataFrame:
    """One repository per customer; the commit wanted changes with the segment."""
    customer = read_table(spark, folder, "customer")
    return customer.select(
        "c_custkey", F.col("c_mktsegment").alias("owner"), F.col("c_name").alias("name"),
        F.lit("main").alias("branch"), F.sha2(F.concat("c_name", "c_mktsegment"), 256).alias("commit"),
    )


def _manifests(spark, folder) -> DataFrame:
    """The newest fetch of each repository; an even one is out of date."""
    customer = read_table(spark, folder, "customer")
    newest = read_table(spark, folder, "orders").groupBy("o_custkey").agg(F.max("o_orderdate").alias("written"))
    kept = customer.join(newest, F.col("c_custkey") == F.col("o_custkey"))
    current = F.sha2(F.concat("c_name", "c_mktsegment"), 256)
    return kept.select(
        names.cache_key(F.col("c_mktsegment"), F.col("c_name"), F.lit("main")).alias("key"),
        F.when(F.col("c_custkey") % 2 == 1, current).otherwise("stale").alias("commit"),
        "written",
    )


def repo_cache_hits(spark, folder):
    hits = repos.cached(_repos(spark, folder), _manifests(spark, folder))
    return hits.select("key", "owner", "name", "branch", "hit")


def repo_cache_expired(spark, folder):
    """Cache entries not fetched since some day, and the bytes they hold."""
    customer = read_table(spark, folder, "customer")
    orders = read_table(spark, folder, "orders")
    files = orders.join(customer, F.col("o_custkey") == F.col("c_custkey")).select(
        names.cache_key(F.col("c_mktsegment"), F.col("c_name"), F.lit("main")).alias("key"),
        F.floor("o_totalprice").alias("length"),
    )
    return repos.expired(_manifests(spark, folder), files, "2001-01-01 00:00:00", 365)


def dependency_nodes(spark, folder):
    """Entity maps, one file per nation, entity type by region."""
    nation = read_table(spark, folder, "nation")
    entity = F.struct(
        F.when(F.col("n_regionkey") % 2 == 0, "class").alias("entity_type"),
        F.col("n_nationkey").alias("lineno"), (F.col("n_nationkey") + 5).alias("endno"),
    )
    files = nation.select(
        F.concat(F.lit("/src/"), "n_name", F.lit(".py")).alias("file_path"),
        F.create_map(F.concat(F.lit("a"), F.col("n_nationkey")), entity,
                     F.concat(F.lit("b"), F.col("n_nationkey")), entity).alias("entities"),
    )
    return dependency_maps.entity_nodes(files)


def dependency_edges(spark, folder):
    """Usage maps, one file per order."""
    orders = read_table(spark, folder, "orders")
    k = F.col("o_orderkey").cast("string")
    files = orders.select(
        F.concat(F.lit("/src/o"), k, F.lit(".py")).alias("file_path"),
        F.create_map(
            F.lit("_"), F.array(F.lit("os.path"), F.concat(F.lit("run"), F.col("o_custkey")), F.lit("os.path")),
            F.concat(F.lit("f"), k), F.array(F.lit("g"), F.concat(F.lit("m."), "o_orderstatus")),
        ).alias("usages"),
    )
    return dependency_maps.usage_edges(files)


def _runs(spark, folder) -> DataFrame:
    """An agent log per user out of the event stream, through JSON lines."""
    events = read_table(spark, folder, "events")
    kind = F.when(F.col("event_type") == "purchase", "step_finish").when(
        F.col("event_type") == "click", "tool_use"
    ).otherwise("text")
    n = F.from_json("props", "k bigint")["k"]
    line = F.to_json(
        F.struct(
            kind.alias("type"),
            F.when(F.col("event_type") != "signup", F.unix_seconds(F.col("ts").cast("timestamp")).cast("double")).alias("timestamp"),
            F.struct(
                F.floor("value").cast("double").alias("cost"),
                F.struct((n * 100).alias("total"), F.struct(n.alias("read")).alias("cache")).alias("tokens"),
            ).alias("part"),
        )
    )
    logs = events.select(
        F.col("user_id").alias("run"), F.col("event_id").alias("seq"),
        F.from_json(line, runlog.RUN_LOG).alias("e"),
    ).select("run", "seq", "e.*")
    return runlog.run_totals(logs)


def run_totals(spark, folder):
    return _runs(spark, folder)


def _arms(spark, folder) -> DataFrame:
    arm = F.when(F.col("run") % 3 == 0, "with").otherwise("without")
    return runlog.arm_medians(_runs(spark, folder).withColumn("arm", arm))


def run_medians(spark, folder):
    return _arms(spark, folder)


def run_savings(spark, folder):
    return runlog.savings_report(_arms(spark, folder))


def order_medians(spark, folder):
    """Medians that need the whole cluster: line item prices per return flag."""
    items = read_table(spark, folder, "lineitem")
    return runlog.exact_medians(items, ["l_returnflag"], "l_quantity")


def similar_topk(spark, folder):
    vectors = read_table(spark, folder, "embeddings")
    query = vectors.filter(F.col("vec_id") == 0).select("embedding").first()[0]
    found = similar.similar_vectors(vectors, query, 20, "vec_id", "embedding")
    return found.select("vec_id", F.round("similarity", 6).alias("similarity"))


def similar_nodes(spark, folder):
    """Parts by the vector that shares their key, longer query than the vectors."""
    vectors = read_table(spark, folder, "embeddings").select(
        F.concat(F.lit("part:"), "vec_id").alias("node_id"), F.col("embedding").alias("vector")
    )
    row = vectors.filter(F.col("node_id") == "part:7").first()
    found = similar.search_similar(table_nodes(spark, folder), vectors, [*row["vector"], 0.5], 10)
    return found.select("id", "name", "kind", F.round("similarity", 6).alias("similarity"))


def embedding_texts(spark, folder):
    return similar.embedding_text(table_nodes(spark, folder))


def embed_symbols(spark, folder):
    """Offline vectors of all symbols, as the places that are not zero."""
    vectors = similar.hashed_vectors(similar.embedding_text(table_nodes(spark, folder)))
    places = F.filter(F.sequence(F.lit(0), F.size("vector") - 1), lambda i: F.get("vector", i) != 0)
    held = vectors.select("node_id", "vector", places.alias("places"))
    weighed = F.transform("places", lambda i: F.struct(i.alias("place"), F.get("vector", i).cast("double").alias("weight")))
    kept = held.select("node_id", F.inline_outer(weighed))
    return kept.filter(F.col("place").isNotNull())


QUERIES = {
    f.__name__: f
    for f in (
        parse_symbols, parse_edges, index_counts, page_script_calls, tree_filter, framework_detect,
        route_extract, scip_nodes, scip_edges, scip_counts, scip_symbol_parse, git_url_parse,
        head_commit, repo_cache_hits, repo_cache_expired, dependency_nodes, dependency_edges,
        run_totals, run_medians, run_savings, order_medians, similar_topk, similar_nodes,
        embedding_texts, embed_symbols,
    )
}
