"""A graph over relational tables: rows become symbols, foreign keys become edges.

The mapping is fixed, so the same graph can be spelled in SQL and checked.
Edges that several rows imply keep the highest line number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from symbolweave.schema import EDGES, NODES


_SCHEMAS: dict[str, StructType] = {}


def read_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table; its schema is read from the file footers the first time only."""
    path = f"{folder}/{name}.parquet"
    if path not in _SCHEMAS:
        _SCHEMAS[path] = spark.read.parquet(path).schema
    return spark.read.schema(_SCHEMAS[path]).parquet(path)


def _text(*parts: str | Column) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _shape(df: DataFrame, schema, **columns) -> DataFrame:
    picked = [columns[f.name].cast(f.dataType).alias(f.name) for f in schema]
    return df.select(*picked)


def table_nodes(spark: SparkSession, folder: str) -> DataFrame:
    """One symbol per region, nation, supplier, customer, order and part."""

    def build(table, key, group, name, kind, signature, parent, language, metadata):
        df = read_table(spark, folder, table)
        return _shape(
            df,
            NODES,
            id=_text(f"{table}:", F.col(key)),
            file_path=_text(f"{table}/", group, ".sql"),
            name=name,
            kind=F.lit(kind),
            signature=signature,
            line_start=F.col(key),
            line_end=F.col(key),
            parent_id=parent,
            language=F.lit(language),
            metadata=metadata,
        )

    c = F.col
    none = F.lit(None)
    empty = F.lit("{}")
    parts = [
        build("region", "r_regionkey", F.lit("all"), c("r_name"), "interface",
              _text("region ", c("r_name")), none, "python", empty),
        build("nation", "n_nationkey", c("n_regionkey"), c("n_name"), "class",
              _text("nation ", c("n_name")), _text("region:", c("n_regionkey")), "python", empty),
        build("supplier", "s_suppkey", c("s_nationkey"), c("s_name"), "function",
              _text("supplier ", c("s_name")), _text("nation:", c("s_nationkey")), "go", empty),
        build("customer", "c_custkey", c("c_mktsegment"), c("c_name"), "function",
              _text(c("c_name"), " buys ", c("c_mktsegment")),
              _text("nation:", c("c_nationkey")), "typescript",
              _text('{"segment": "', c("c_mktsegment"), '"}')),
        build("orders", "o_orderkey", c("o_orderpriority"), _text("Order#", c("o_orderkey")),
              "method", _text("order status ", c("o_orderstatus")),
              _text("customer:", c("o_custkey")), "python",
              _text('{"status": "', c("o_orderstatus"), '"}')),
        build("part", "p_partkey", c("p_brand"), c("p_name"), "symbol",
              _text(c("p_type"), " ", c("p_brand"), " size ", c("p_size")), none, "go",
              _text('{"brand": "', c("p_brand"), '"}')),
    ]
    nodes = parts[0]
    for part in parts[1:]:
        nodes = nodes.unionByName(part)
    return nodes


def table_edge_rows(spark: SparkSession, folder: str, folded: bool = False) -> DataFrame:
    """Every edge a row implies, as often as rows imply it unless ``folded``."""

    def items(*keys: str) -> DataFrame:
        rows = read_table(spark, folder, "lineitem").select(*keys, "l_linenumber")
        if not folded:
            return rows
        return rows.groupBy(*keys).agg(F.max("l_linenumber").alias("l_linenumber"))

    def build(df, source, target, kind, path, line):
        return _shape(
            df, EDGES, source_id=source, target_id=target, kind=F.lit(kind),
            file_path=path, line_number=line,
        )

    c = F.col
    nation = read_table(spark, folder, "nation")
    supplier = read_table(spark, folder, "supplier")
    customer = read_table(spark, folder, "customer")
    orders = read_table(spark, folder, "orders")
    order_id, order_file = _text("orders:", c("o_orderkey")), _text("orders/", c("o_orderpriority"), ".sql")
    buyer = _text("customer:", c("o_custkey"))
    part_id = _text("part:", c("l_partkey"))
    item_file = F.lit("lineitem.sql")
    rows = [
        build(nation, _text("nation:", c("n_nationkey")), _text("region:", c("n_regionkey")),
              "references", _text("nation/", c("n_regionkey"), ".sql"), c("n_nationkey")),
        build(supplier, _text("supplier:", c("s_suppkey")), _text("nation:", c("s_nationkey")),
              "references", _text("supplier/", c("s_nationkey"), ".sql"), c("s_suppkey")),
        build(customer, _text("customer:", c("c_custkey")), _text("nation:", c("c_nationkey")),
              "references", _text("customer/", c("c_mktsegment"), ".sql"), c("c_custkey")),
        build(orders, order_id, buyer, "calls", order_file, c("o_orderkey")),
        build(orders.filter(c("o_orderstatus") == "F"), order_id, buyer, "references",
              order_file, c("o_orderkey")),
        build(orders.filter(c("o_orderpriority") == "1-URGENT"), buyer, order_id, "references",
              order_file, c("o_orderkey")),
        build(items("l_orderkey", "l_partkey"), _text("orders:", c("l_orderkey")), part_id, "calls", item_file, c("l_linenumber")),
        build(items("l_partkey", "l_suppkey"), part_id, _text("supplier:", c("l_suppkey")), "imports", item_file, c("l_linenumber")),
    ]
    edges = rows[0]
    for row in rows[1:]:
        edges = edges.unionByName(row)
    return edges


def table_edges(spark: SparkSession, folder: str) -> DataFrame:
    """Edges unique on (source, target, kind); duplicates keep the last line.

    Only line items repeat an edge.  They are folded on their numeric keys,
    before any id text is made, so the shuffle carries three small numbers.
    """
    return table_edge_rows(spark, folder, folded=True)
