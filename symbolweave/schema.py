"""Column layouts shared by every operator.

``nodes`` holds one row per symbol (``id`` is unique), ``edges`` one row per
``(source_id, target_id, kind)``.  Edge ends are plain text and need not exist
in ``nodes``.
"""

from pyspark.sql import types as T

NODE_FIELDS = [
    ("id", T.StringType()),
    ("file_path", T.StringType()),
    ("name", T.StringType()),
    ("kind", T.StringType()),
    ("signature", T.StringType()),
    ("line_start", T.IntegerType()),
    ("line_end", T.IntegerType()),
    ("parent_id", T.StringType()),
    ("language", T.StringType()),
    ("metadata", T.StringType()),
]
EDGE_FIELDS = [
    ("source_id", T.StringType()),
    ("target_id", T.StringType()),
    ("kind", T.StringType()),
    ("file_path", T.StringType()),
    ("line_number", T.IntegerType()),
]

NODES = T.StructType([T.StructField(n, t) for n, t in NODE_FIELDS])
EDGES = T.StructType([T.StructField(n, t) for n, t in EDGE_FIELDS])
EMBEDDINGS = T.StructType(
    [
        T.StructField("node_id", T.StringType()),
        T.StructField("vector", T.ArrayType(T.FloatType())),
        T.StructField("model", T.StringType()),
        T.StructField("dimensions", T.IntegerType()),
    ]
)
FILE_EVENTS = T.StructType(
    [
        T.StructField("path", T.StringType()),
        T.StructField("op", T.StringType()),
        T.StructField("ts", T.TimestampType()),
    ]
)

NODE_COLUMNS = NODES.fieldNames()
EDGE_COLUMNS = EDGES.fieldNames()
EDGE_KEY = ["source_id", "target_id", "kind"]
