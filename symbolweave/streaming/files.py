"""A stream of the changes of a source tree.

``take_snapshot`` lists the tree with tasks and keeps the listing as a table, numbered and bucketed by a hash of the
path.  The stream's offsets are those numbers.  A micro-batch compares each snapshot with the one before it, bucket by
bucket and so spread over tasks: a path only the later one has was created, one only the earlier one has was
deleted, one with another length or time of change was modified.  What was told is in the checkpoint, so a
restart tells nothing twice and leaves nothing out; snapshots that no restart can need are removed.
"""

from __future__ import annotations

import datetime
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.dataset as dataset
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from symbolweave.lineage import bucket_of, cut
from symbolweave.sources.listing import absolute, list_files, opened
from symbolweave.sources.tree import LANGUAGE_OF, SKIPPED_FOLDERS, read_sources

BUCKETS = 32
CHANGES = "path string, op string, ts timestamp, length long, snapshot long"


def _numbers(state: str) -> list[int]:
    """The numbers of the complete snapshots; a listing that was cut short has no mark of success."""
    system, base = opened(state)
    entries = system.get_file_info(pafs.FileSelector(f"{base}/snapshots", allow_not_found=True))
    numbers = sorted(int(e.base_name.split("=")[1]) for e in entries if e.base_name.startswith("number="))
    return [n for n in numbers if system.get_file_info(f"{base}/snapshots/number={n}/_SUCCESS").type == pafs.FileType.File]


def take_snapshot(spark: SparkSession, root: str, state: str, extensions: list[str] | None = None, buckets: int = BUCKETS) -> int:
    """List the sources below ``root`` into the next snapshot of ``state``; its number.

    ``buckets`` must stay the same for a state; there should be so many that a task can hold one.
    """
    state = absolute(state)
    number = max(_numbers(state), default=0) + 1
    files = list_files(spark, root, SKIPPED_FOLDERS, extensions or list(LANGUAGE_OF))
    rows = files.withColumn("bucket", bucket_of("path", buckets))
    rows.repartition(buckets, "bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{state}/snapshots/number={number}")
    return number


@dataclass
class _Step(InputPartition):
    """A bucket of a snapshot and of the one before it."""

    number: int
    bucket: int


class _Reader(DataSourceStreamReader):
    def __init__(self, state: str, buckets: int) -> None:
        self.state, self.buckets = state, buckets

    def initialOffset(self) -> dict:
        return {"snapshot": 0}

    def latestOffset(self) -> dict:
        return {"snapshot": max(_numbers(self.state), default=0)}

    def partitions(self, start: dict, end: dict) -> list[_Step]:
        return [_Step(n, b) for n in range(start["snapshot"] + 1, end["snapshot"] + 1) for b in range(self.buckets)]

    def _bucket(self, number: int, bucket: int) -> dict[str, tuple[int, int]]:
        system, base = opened(self.state)
        at = f"{base}/snapshots/number={number}/bucket={bucket}"
        if system.get_file_info(at).type != pafs.FileType.Directory:
            return {}
        rows = dataset.dataset(at, filesystem=system, format="parquet").to_table(columns=["path", "length", "modified"])
        return dict(zip(rows.column("path").to_pylist(), zip(rows.column("length").to_pylist(), rows.column("modified").to_pylist(), strict=True), strict=True))

    def read(self, partition: _Step) -> Iterator[tuple]:
        before, now = self._bucket(partition.number - 1, partition.bucket), self._bucket(partition.number, partition.bucket)
        start = datetime.datetime(1970, 1, 1, tzinfo=datetime.timezone.utc)
        last = start
        for path, (length, modified) in now.items():
            last = max(last, at := start + datetime.timedelta(microseconds=modified))
            if before.get(path) != (length, modified):
                yield path, "modified" if path in before else "created", at, length, partition.number
        for path, (length, _) in before.items():
            if path not in now:
                yield path, "deleted", last, length, partition.number

    def commit(self, end: dict) -> None:
        """What is before the last snapshot told is compared no more."""
        system, base = opened(self.state)
        for number in _numbers(self.state):
            if number < end["snapshot"]:
                system.delete_dir(f"{base}/snapshots/number={number}")


class TreeChanges(DataSource):
    """``spark.readStream.format("tree_changes").option("state", …)``, with ``buckets`` as in the snapshots."""

    @classmethod
    def name(cls) -> str:
        return "tree_changes"

    def schema(self) -> str:
        return CHANGES

    def streamReader(self, schema) -> _Reader:
        return _Reader(self.options["state"], int(self.options.get("buckets", BUCKETS)))


def read_changes(spark: SparkSession, state: str, buckets: int = BUCKETS) -> DataFrame:
    """The stream of (path below the root, op, ts, length, snapshot) rows."""
    spark.dataSource.register(TreeChanges)
    return spark.readStream.format("tree_changes").option("state", absolute(state)).option("buckets", buckets).load()


def catch_up(
    spark: SparkSession, state: str, each: Callable[[DataFrame, int], None], checkpoint: str, number: int, buckets: int = BUCKETS
) -> None:
    """Hand the changes up to a snapshot to ``each``, batch by batch, and stop.

    A run that begins with a batch that failed before does that one alone, so there may have to be another.
    """
    reached = 0
    while reached < number:
        query = read_changes(spark, state, buckets).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint)
        query = query.trigger(availableNow=True).start()
        query.awaitTermination()
        progress = query.lastProgress
        if progress is None:
            return
        reached = int(re.search(r"\d+", str(progress.sources[0].endOffset))[0])  # {"snapshot": number}


def latest_with_texts(changes: DataFrame, root: str) -> DataFrame:
    """One row for each path of a batch, as ``watch.latest_changes`` has them, with texts and errors.

    Only files that are there are opened, each once; paths are absolute.
    """
    last = F.max_by(F.struct("op", "length"), F.col("snapshot")).alias("last")
    cleared = F.max(F.col("op").isin("modified", "deleted")).alias("cleared")
    kept = cut(changes.groupBy("path").agg(last, cleared).select("path", "last.op", "last.length", "cleared"), "changes").df
    texts = read_sources(kept.filter("op != 'deleted'"), root).select("path", "text", "error")
    named = kept.select(F.concat(F.lit(absolute(root) + "/"), "path").alias("path"), "op", "cleared")
    return named.join(texts, "path", "left")
