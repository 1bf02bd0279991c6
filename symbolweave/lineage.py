"""Cutting lineage between rounds of an iterative job, and joins that know sizes.

A round's result is written as a table into the shared folder the cluster names
in ``spark.checkpoint.dir``.  A written table survives the loss of any executor,
is computed once, and is read back column by column.  The row count comes from
an ``Observation`` on the write itself, so it costs no extra job, and it decides
whether the table is small enough to broadcast.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

# Rows of narrow ids (and at most a 16-step path) that may be broadcast:
# about 100 MB at the very worst, a few MB in practice.
BROADCAST_ROWS = 100_000
# Most copies of each frontier row when the frontier is too large to broadcast; a hub
# holding a third of all edges is then spread over this many tasks.
SALTS = 32
# Rows that the copies of a frontier may come to.  A frontier that is larger itself is not
# copied: its keys are a good part of all, and Spark splits the partition of a hub (skew join).
COPIED_ROWS = 4_000_000
# So few keys are passed to a scan as a list.
FEW_KEYS = 200
# Bytes of compressed input whose rows one task sorts and writes: a million narrow rows, more or less.
TASK_BYTES = 4 << 20
MANY_FILES = 10
# Bytes of files, and of a shuffle, that a task reads where rows are laid out; in memory they are many times as large,
# the more so as a node becomes ten rows or more of words and threes of letters.
READ_BYTES, FETCHED_BYTES = 4 << 20, 16 << 20
# So many keys are broadcast as hashes at most, to leave out most of a stored table before it is shuffled.
HASHED_KEYS = 2_000_000
# So many hashes of keys are held in a Python worker at most (eight bytes each), to leave out stored rows without a shuffle.
HELD_KEYS = 16_000_000
# Bytes of a method beyond which the JVM never compiles it, and Spark's own bound for fused operators, which is higher.
COMPILED_BYTES, METHOD_LIMIT = 8000, "spark.sql.codegen.hugeMethodLimit"
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@dataclass(frozen=True)
class Cut:
    """A written intermediate table and its row count."""

    df: DataFrame
    rows: int

    @property
    def small(self) -> bool:
        return self.rows <= BROADCAST_ROWS


def shared_folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a temporary one only for local masters."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if folder:
        return folder
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
    folder = tempfile.mkdtemp(prefix="symbolweave-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir()


_OPEN = threading.local()


@contextmanager
def scope(spark: SparkSession) -> Iterator[None]:
    """Whatever ``cut`` writes inside is deleted at the end.

    Results are lazy: use it around work that consumes them, such as a batch of a stream.
    """
    stack = _OPEN.__dict__.setdefault("stack", [])
    stack.append([])
    try:
        yield
    finally:
        for written in stack.pop():
            path = spark._jvm.org.apache.hadoop.fs.Path(written)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def small_reads(spark: SparkSession) -> Iterator[None]:
    """Tasks planned inside read less at once, as rows on their way into a shuffle are held in memory, or spilled."""
    most = {"spark.sql.files.maxPartitionBytes": READ_BYTES, "spark.sql.adaptive.advisoryPartitionSizeInBytes": FETCHED_BYTES}
    told = {name: spark.conf.get(name) for name in most}
    for name, value in told.items():
        if spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(value) > most[name]:
            spark.conf.set(name, str(most[name]))
    try:
        yield
    finally:
        for name, value in told.items():
            spark.conf.set(name, value)


@contextmanager
def compiled_methods(spark: SparkSession) -> Iterator[None]:
    """Plans made inside are not fused where that gives a method too long for the JVM to compile, which would be interpreted for every row."""
    told = spark.conf.get(METHOD_LIMIT)
    spark.conf.set(METHOD_LIMIT, str(min(int(told), COMPILED_BYTES)))
    try:
        yield
    finally:
        spark.conf.set(METHOD_LIMIT, told)


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What writes inside shuffle is deleted as soon as each is done; else it stays until the driver happens to collect garbage."""
    told = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        if told is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, told)


def cut(df: DataFrame, label: str) -> Cut:
    """Write ``df`` to the shared folder and read it back as a fresh plan."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{spark.sparkContext.applicationId}/{label}-{uuid.uuid4().hex}"
    if _OPEN.__dict__.get("stack"):
        _OPEN.stack[-1].append(path)
    seen = Observation()
    with shuffles_removed(spark):
        df.observe(seen, F.count(F.lit(1)).alias("rows")).write.parquet(path)
    return Cut(spark.read.schema(df.schema).parquet(path), seen.get["rows"])


def bucket_column(buckets: int) -> str:
    """The partition column of a stored table with that many buckets."""
    return f"bucket_of_{buckets}"


def bucket_of(key: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(buckets)).cast("int")


def stored_buckets(table: DataFrame) -> list[str]:
    """The bucket column of a stored table; nothing for any other."""
    return [c for c in table.columns if c.startswith("bucket_of_")]


def files_of(rows: DataFrame, buckets: set[int] | None = None) -> dict[str, list[str]]:
    """The files rows come from, by folder; of stored tables only those of some ``buckets``, if they are given."""
    names: dict[str, list[str]] = {}
    for file in rows.inputFiles():
        parent, name = file.rsplit("/", 1)
        stored = parent.rsplit("/", 1)[1].startswith("bucket_of_")
        if buckets is None or not stored or int(parent.rsplit("=", 1)[1]) in buckets:
            names.setdefault(parent, []).append(name)
    return names


def tasks_of(rows: DataFrame, buckets: set[int] | None = None) -> int | None:
    """How many tasks are to share rows, by the files they come from; None if they come from none."""
    spark, names, found = rows.sparkSession, files_of(rows, buckets), 0
    for parent, inside in names.items():
        # a folder of many files holds nothing else, so one call tells its bytes
        for address in [parent] if len(inside) > MANY_FILES else [f"{parent}/{name}" for name in inside]:
            at = spark._jvm.org.apache.hadoop.fs.Path(spark._jvm.java.net.URI(address))
            found += at.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(at).getLength()
    return found // TASK_BYTES + 1 if names else None


def prune(table: DataFrame, keys: Cut, key: str) -> DataFrame:
    """Restrict a stored, bucketed table to the buckets some keys fall into.

    What is looked up here is bounded by the number of buckets, or by a few
    hundred ids; the pruning then happens in the scan, by folder and by the
    value range of each sorted file.  Keys too many to broadcast leave their hashes
    for it, so that the join behind shuffles few rows that have no partner.
    The bucket column is dropped.
    """
    column = stored_buckets(table)
    if not column:
        return table
    buckets = int(column[0].rsplit("_", 1)[1])
    if keys.rows <= FEW_KEYS:
        found = keys.df.select(F.col(key).alias("k"), bucket_of(key, buckets).alias("b")).collect()
        table = table.filter(F.col(column[0]).isin(sorted({r.b for r in found})))
        table = table.filter(F.col(key).isin([r.k for r in found]))
    elif keys.small:
        found = keys.df.select(bucket_of(key, buckets).alias("b")).distinct().collect()
        if len(found) < buckets:
            table = table.filter(F.col(column[0]).isin([r.b for r in found]))
    elif keys.rows <= HASHED_KEYS:
        hashes = keys.df.select(F.xxhash64(key).alias("_hash")).distinct()
        table = table.withColumn("_hash", F.xxhash64(key)).join(F.broadcast(hashes), "_hash", "left_semi").drop("_hash")
    return table.drop(column[0])


def join_frontier(
    big: DataFrame, frontier: Cut, key: str, spread_by: Column, how: str = "inner"
) -> DataFrame:
    """Join a huge table to a frontier on ``key`` without piling up on hub keys.

    ``frontier`` has ``key`` as a column.  A small frontier is broadcast, so the
    huge side is never shuffled.  A larger one is copied once per salt and the
    huge side salted by ``spread_by``, which varies inside a hub key; the copies
    are so few that they come to no more than ``COPIED_ROWS``.
    """
    if how in ("inner", "left_semi"):
        big = prune(big, frontier, key)
    if frontier.small:
        return big.join(F.broadcast(frontier.df), key, how)
    copies = min(SALTS, COPIED_ROWS // frontier.rows)
    if copies < 2:
        return big.join(merged(frontier.df), key, how)
    salts = F.explode(F.sequence(F.lit(0), F.lit(copies - 1)))
    salted = big.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.lit(copies)).cast("int"))
    return salted.join(merged(frontier.df.withColumn("_salt", salts)), [key, "_salt"], how).drop("_salt")


def merged(side: DataFrame) -> DataFrame:
    """A join's side that is shuffled, whatever its size is taken for.

    Spark goes by the compressed bytes of the files and takes no account of rows that are
    copied, so it would hand millions of narrow rows to the driver, to broadcast them.
    """
    return side.hint("merge")


def join_keyed(wide: DataFrame, keyed: Cut, key: str | list[str], how: str = "inner") -> DataFrame:
    """Join a table unique on ``key`` to a counted one; no key can be hot here."""
    if how in ("inner", "left_semi") and isinstance(key, str):
        wide = prune(wide, keyed, key)
    return wide.join(F.broadcast(keyed.df) if keyed.small else merged(keyed.df), key, how)


def leave_out(rows: DataFrame, keys: Cut, *ends: list[str]) -> DataFrame:
    """Rows none of whose ``ends`` is among some keys; an end has the columns that stand for those of ``keys``.

    Rows are not shuffled, so those of a stored table stay in their buckets and in their order.  Few keys are
    broadcast.  Of more the workers hold hashes; which other keys of the rows share one of these is found before, by
    the different keys alone, so no row goes by its hash.  Only beyond ``HELD_KEYS`` both sides are shuffled.
    """
    names = keys.df.columns
    if not keys.small and keys.rows <= HELD_KEYS:
        whole = keys.df.dropna()  # a null equals nothing
        hashes = cut(whole.select(F.xxhash64(*names).alias("_hash")), "hashes").df
        held = _held_in(hashes.inputFiles())
        found = reduce(DataFrame.unionByName, [
            rows.select(*[F.col(c).alias(n) for c, n in zip(end, names, strict=True)]).filter(held(F.xxhash64(*end))) for end in ends])
        others = cut(found.distinct().join(merged(keys.df), names, "left_anti").select(F.xxhash64(*names).alias("_hash")).distinct(), "hashes")
        if others.rows <= FEW_KEYS:
            shared = [r[0] for r in others.df.collect()]
            for end in ends:
                rows = rows.filter(~held(F.xxhash64(*end)) | F.xxhash64(*end).isin(shared))
                if shared:
                    some = whole.filter(F.xxhash64(*names).isin(shared)).distinct()
                    rows = rows.join(F.broadcast(some.toDF(*end)), end, "left_anti")
            return rows
    for end in ends:
        some = Cut(keys.df.toDF(*end), keys.rows)
        if len(end) > 1:
            rows = join_keyed(rows, some, end, "left_anti")
        else:
            rows = join_frontier(rows, some, end[0], F.xxhash64(*rows.columns), "left_anti")
    return rows


_HASHES: dict[str, np.ndarray] = {}


def _hashes_of(files: list[str]) -> np.ndarray:
    """The sorted hashes some files hold; a worker keeps those it was last asked for."""
    if files[0] not in _HASHES:
        _HASHES.clear()
        system = pafs.FileSystem.from_uri(files[0])[0]
        parts = [pq.read_table(pafs.FileSystem.from_uri(f)[1], filesystem=system).column("_hash").to_numpy() for f in files]
        _HASHES[files[0]] = np.sort(np.concatenate(parts))
    return _HASHES[files[0]]


def _held_in(files: list[str]):
    """Whether a hash is among those in some files."""

    @F.arrow_udf("boolean")
    def held(asked: pa.Array) -> pa.Array:
        hashes, wanted = _hashes_of(files), asked.to_numpy(zero_copy_only=False)
        at = np.minimum(np.searchsorted(hashes, wanted), len(hashes) - 1)
        return pa.array(hashes[at] == wanted)

    return held
