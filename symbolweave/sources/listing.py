"""Every file below a folder, hidden ones too, without reading any.

Spark's own listing leaves out names that begin with ``_`` or ``.``.  Here folders are
listed by tasks: each walks down from the folders it was given, up to a bound, and hands
the folders it has not reached to the next round.  A small tree takes one round, and a large one
is spread over all executors.  Any storage that pyarrow can open is read.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from symbolweave.lineage import cut

# Folders that one task lists before it leaves the rest to the next round.
FOLDERS_PER_TASK = 500
# Folders given to one task, and bytes of files that one task reads.
TOGETHER, BYTES_PER_TASK = 50, 64 << 20
LISTED = "path string, folder boolean, length long, modified long"


def absolute(root: str) -> str:
    """A root as an address or an absolute path, without a slash at its end."""
    return (root if "://" in root or root.startswith("file:") else os.path.abspath(root)).rstrip("/")


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" in path or path.startswith("file:"):
        return pafs.FileSystem.from_uri(path)
    return pafs.LocalFileSystem(), path


def _listing(root: str, skipped: list[str], suffixes: list[str] | None):
    def wanted(name: str) -> bool:
        return suffixes is None or os.path.splitext(name)[1] in suffixes

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, base = opened(root)
        for batch in batches:
            waiting, done = batch.column(0).to_pylist(), 0
            while waiting and done < FOLDERS_PER_TASK:
                folder, rows = waiting.pop(), []
                done += 1
                for entry in system.get_file_info(pafs.FileSelector(f"{base}/{folder}" if folder else base)):
                    below = f"{folder}/{entry.base_name}" if folder else entry.base_name
                    if entry.type == pafs.FileType.Directory and entry.base_name not in skipped:
                        waiting.append(below)
                    elif entry.type == pafs.FileType.File and wanted(entry.base_name):
                        rows.append((below, False, entry.size, entry.mtime_ns // 1000))
                yield _rows(rows)
            yield _rows([(folder, True, 0, 0) for folder in waiting])

    return task


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ((), (), (), ())
    kinds = (pa.string(), pa.bool_(), pa.int64(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)],
                                      names=["path", "folder", "length", "modified"])


def list_files(spark: SparkSession, root: str, skipped: list[str], suffixes: list[str] | None = None) -> DataFrame:
    """(``path`` below ``root``, ``length``, ``modified``) of the files, without folders of a name in ``skipped``.

    ``modified`` is in microseconds since 1970.
    """
    found, rounds = spark.createDataFrame([("",)], "path string"), []
    left = 1
    while left:
        tasks = max(1, min(left // TOGETHER, 10_000))
        step = cut(found.repartition(tasks).mapInArrow(_listing(absolute(root), skipped, suffixes), LISTED), "listing")
        rounds.append(step.df.filter(~F.col("folder")).select("path", "length", "modified"))
        found = step.df.filter("folder").select("path")
        left = found.count()
    files = rounds[0]
    for more in rounds[1:]:
        files = files.unionByName(more)
    return files


def read_files(files: DataFrame, root: str) -> DataFrame:
    """(``path`` below ``root``, ``content``) of listed files; nothing else is opened.

    The content of a file that is gone, or that cannot be opened, is null.
    """
    size = files.agg(F.sum("length").alias("bytes"), F.count(F.lit(1)).alias("n")).first()
    tasks = max(1, min((size.bytes or 0) // BYTES_PER_TASK + size.n // 10_000 + 1, 100_000))
    base = absolute(root)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, folder = opened(base)
        for batch in batches:
            for path in batch.column(0).to_pylist():
                try:
                    with system.open_input_stream(f"{folder}/{path}", compression=None) as data:
                        content = data.read()
                except OSError:
                    content = None
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([content], pa.large_binary()).cast(pa.binary())],
                                                 names=["path", "content"])

    return files.select("path").repartition(tasks, "path").mapInArrow(task, "path string, content binary")
