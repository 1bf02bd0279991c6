"""Repository archives already fetched, and the cache that knows them.

Fetching over the network is left to whatever places archives in the folder.
"""

from __future__ import annotations

import bz2
import re
import struct
import zipfile
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from symbolweave.functions.names import cache_key
from symbolweave.lineage import cut
from symbolweave.sources.listing import absolute, list_files, opened

LARGEST_MB = 500
CACHE_DAYS = 7
# Characters of files, and entries, that leave a task together; packed bytes and entries that one task reads.
BATCH_CHARACTERS, BATCH_ENTRIES = 4 << 20, 50_000
BYTES_PER_TASK, ENTRIES_PER_TASK = 32 << 20, 20_000
PARTS = 64
TEXTS = "archive string, path string, text string"
# Fixed value of the format: the header in front of an entry; its last two numbers are lengths of what follows it.
LOCAL_HEADER = "<4s5H3L2H"
MANIFEST = T.StructType(
    [
        T.StructField("url", T.StringType()),
        T.StructField("branch", T.StringType()),
        T.StructField("commit", T.StringType()),
        T.StructField("cloned_at", T.DoubleType()),
    ]
)


ENTRIES = "archive string, at string, name string, start long, packed long, size long, method int"


def list_entries(spark: SparkSession, folder: str, largest_mb: int = LARGEST_MB) -> DataFrame:
    """One row for each file inside zip archives: where its bytes begin, how many they are, how they are packed.

    Only the directories at the archives' ends are read.  The size limit is checked on the listing, so an
    oversized archive fails before anything of it is loaded.
    """
    listed = list_files(spark, folder, [], [".zip"])
    too_large = F.concat(F.lit("archive too large: "), "path")
    checked = listed.filter(
        F.when(F.col("length") > largest_mb * 1024 * 1024, F.raise_error(too_large).cast("boolean"))
        .otherwise(F.lit(True))
    )
    base = absolute(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(base)
        for given in batches:
            for at in given.column("path").to_pylist():
                stem = re.sub(r"\.zip$", "", at.rsplit("/", 1)[-1])
                with system.open_input_file(f"{root}/{at}") as data, zipfile.ZipFile(data) as archive:
                    rows = [(stem, at, e.filename, e.header_offset, e.compress_size, e.file_size, e.compress_type)
                            for e in archive.infolist() if not e.is_dir()]
                for k in range(0, len(rows), BATCH_ENTRIES):
                    yield _columns(rows[k : k + BATCH_ENTRIES], [pa.string()] * 3 + [pa.int64()] * 3 + [pa.int32()], ENTRIES)

    return cut(checked.select("path").repartition(PARTS, "path").mapInArrow(task, ENTRIES), "entries").df


def _columns(rows: list[tuple], kinds: list[pa.DataType], schema: str) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                                      names=[c.split()[0] for c in schema.split(", ")])


def _unpacked(data: pa.NativeFile, start: int, packed: int, method: int) -> bytes:
    """An entry's bytes, by its own range of the archive."""
    data.seek(start)
    size = struct.calcsize(LOCAL_HEADER)
    names, extra = struct.unpack(LOCAL_HEADER, data.read(size))[-2:]
    data.seek(start + size + names + extra)
    content = data.read(packed)
    if method == zipfile.ZIP_STORED:
        return content
    if method == zipfile.ZIP_DEFLATED:
        return zlib.decompressobj(-zlib.MAX_WBITS).decompress(content)
    return {zipfile.ZIP_BZIP2: bz2.decompress}[method](content)


def read_archives(spark: SparkSession, folder: str, largest_mb: int = LARGEST_MB) -> DataFrame:
    """Files inside zip archives as (archive, path, text), the top folder left off.

    Entries are dealt over tasks by their bytes; a task reads the ranges of its own and holds one at a time, so many
    tasks work on one archive and none holds it.
    """
    entries = list_entries(spark, folder, largest_mb)
    size = entries.agg(F.sum("packed").alias("bytes"), F.count("*").alias("n")).first()
    tasks = max(1, min((size.bytes or 0) // BYTES_PER_TASK + size.n // ENTRIES_PER_TASK + 1, 100_000))
    base = absolute(folder)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, root = opened(base)
        at, data = None, None
        for given in batches:
            rows, held = [], 0
            for row in given.to_pylist():
                if row["at"] != at:
                    at, data = row["at"], system.open_input_file(f"{root}/{row['at']}")
                text = _unpacked(data, row["start"], row["packed"], row["method"]).decode("utf-8", "replace")
                rows.append((row["archive"], row["name"].split("/", 1)[-1], text))
                held += len(text)
                if held >= BATCH_CHARACTERS:
                    yield _columns(rows, [pa.string()] * 3, TEXTS)
                    rows, held = [], 0
            if rows:
                yield _columns(rows, [pa.string()] * 3, TEXTS)

    dealt = entries.repartition(tasks, F.xxhash64("at", "start")).sortWithinPartitions("at", "start")
    return dealt.mapInArrow(task, TEXTS)


def keyed(repos: DataFrame) -> DataFrame:
    return repos.withColumn("key", cache_key(F.col("owner"), F.col("name"), F.col("branch")))


def cached(repos: DataFrame, manifests: DataFrame) -> DataFrame:
    """Repositories with ``hit``: is this very commit in the cache?

    Both sides are unique on the key.
    """
    held = manifests.select("key", F.col("commit").alias("held_commit"))
    hit = F.coalesce(F.col("commit") == F.col("held_commit"), F.lit(False))
    return keyed(repos).join(held, "key", "left").withColumn("hit", hit).drop("held_commit")


def expired(manifests: DataFrame, files: DataFrame, now: str, days: int = CACHE_DAYS) -> DataFrame:
    """Cache entries older than some days and the bytes their files take.

    ``manifests`` has (key, written), ``files`` has (key, length).
    """
    age = F.to_timestamp(F.lit(now)).cast("double") - F.col("written").cast("timestamp").cast("double")
    old = manifests.filter(age > days * 86400).select("key")
    sizes = files.groupBy("key").agg(F.sum("length").alias("bytes"))
    return old.join(sizes, "key", "left").withColumn("bytes", F.coalesce("bytes", F.lit(0).cast("bigint")))


def read_manifests(spark: SparkSession, folder: str) -> DataFrame:
    """Manifests under ``folder/<key>/manifest.json`` with the time they were written."""
    rows = spark.read.schema(MANIFEST).option("multiLine", "true").json(f"{folder}/*/manifest.json")
    path = F.col("_metadata.file_path")
    return rows.select(
        F.element_at(F.split(path, "/"), -2).alias("key"),
        "*",
        F.col("_metadata.file_modification_time").alias("written"),
    )


def read_cache_files(spark: SparkSession, folder: str) -> DataFrame:
    """(key, length) of every cached file; only the listing is read."""
    files = list_files(spark, folder, [])
    return files.select(F.substring_index("path", "/", 1).alias("key"), "length")
