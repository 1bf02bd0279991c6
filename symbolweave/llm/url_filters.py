"""URL filters: a sort-merge range join of addresses with nested prefix rules.

A rule is a host and a path prefix.  It fits an address if its host is the address's host
or one above it, and the address's path starts with its path.  Written as one key - the
host's labels in reverse, each ended by a full stop, then a zero byte, then the path - a
rule is an interval: exactly the keys that start with its own.  An address has one key for
each host at or above its own, so a rule fits it if one of these keys lies in the interval.

Keys of rules and addresses are dealt into slabs along their order, sorted, and swept; a
stack holds the rules whose intervals are open, the innermost on top.  A rule that reaches
over several slabs is sent to each of them, so slabs need nothing of one another.  Slab
borders are quantiles of a bounded sample, which only balances the work; rows of one key
are told apart by a hash, so that a key that many rows share is split too.

Addresses that differ only after the path are judged once, and verdicts are joined back on
host and path.  A null address, or one without ``://``, has an empty host and path, fits no
rule and takes ``otherwise``.  Repeated rows are all returned; of rules with the same host
and path, one that blocks wins.  Empty tables, of addresses or rules, are allowed.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import cut
from symbolweave.llm.text import partitions

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Keys sampled for each slab, to place the borders; the sample reaches the driver.
SAMPLED = 32
MOST_SLABS = 2000

PLACED = "slab int, key binary, kind int, host string, path string, rule string, verdict string"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """What stands between ``://`` and the path, A-Z in lower case, and the path."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, LOWER), path


def _key(labels: Column, path: Column) -> Column:
    """``labels`` from the top of the host downwards."""
    return F.encode(F.concat(F.array_join(F.transform(labels, lambda x: F.concat(x, F.lit("."))), ""),
                             F.lit("\0"), path), "utf-8")


def _labels(host: Column) -> Column:
    return F.reverse(F.split(host, "\\."))


def _spread(rules: DataFrame, addresses: DataFrame, slabs: int) -> DataFrame:
    """Both sides with the slab of each row; a rule once for each slab it reaches."""
    sample = (
        addresses.select("key", "salt").orderBy(F.xxhash64("salt", "key")).limit(SAMPLED * slabs).collect()
    )
    order = sorted((bytes(r.key), r.salt) for r in sample)
    borders = [order[k * len(order) // slabs] for k in range(1, slabs)] if order else []

    def rules_to_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for key, rule, verdict in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                first = bisect_right(borders, (key, -(1 << 63)))
                last = bisect_right(borders, (key + b"\xff", 0))
                out += [(slab, key, 0, "", "", rule, verdict) for slab in range(first, last + 1)]
            yield _batch(out)

    def addresses_to_slabs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, salts = batch.column(0), batch.column(1).to_pylist()
            slab = [bisect_right(borders, pair) for pair in zip(keys.to_pylist(), salts, strict=True)]
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [pa.array(slab, pa.int32()), keys, pa.array([1] * n, pa.int32()), batch.column(2),
                 batch.column(3), pa.nulls(n, pa.string()), pa.nulls(n, pa.string())], names=NAMES)

    return rules.select("key", "rule", "verdict").mapInArrow(rules_to_slabs, PLACED).unionByName(
        addresses.select("key", "salt", "host", "path").mapInArrow(addresses_to_slabs, PLACED))


NAMES = [c.split()[0] for c in PLACED.split(", ")]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.binary(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.string()]
    columns = zip(*rows, strict=True) if rows else [[] for _ in kinds]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=NAMES)


def _sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of slab, key and kind: each address with the innermost rule open at its key."""
    stack: list[tuple[bytes, str, str]] = []
    slab = None
    for batch in batches:
        out: list[list] = [[], [], [], []]
        rows = zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True)
        for at, key, kind, host, path, rule, verdict in rows:
            if at != slab:
                slab, stack = at, []
            while stack and not key.startswith(stack[-1][0]):
                stack.pop()
            if kind == 0:
                stack.append((key, rule, verdict))
            elif stack:
                for column, value in zip(out, (host, path, *stack[-1][1:]), strict=True):
                    column.append(value)
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.string()) for c in out],
                                         names=["host", "path", "rule", "verdict"])


def fitting(addresses: DataFrame, rules: DataFrame, slabs: int) -> DataFrame:
    """The longest fitting rule of each distinct (``host``, ``path``) that has one."""
    held = rules.select(
        _key(_labels(F.col("host")), F.col("path")).alias("key"),
        F.concat("host", "path").alias("rule"), "verdict")
    labels = _labels(F.col("host"))
    above = addresses.filter(F.col("host") != "").select(
        "host", "path", F.xxhash64("host", "path").alias("salt"), labels.alias("labels"),
        F.explode(F.sequence(F.lit(1), F.size(labels))).alias("n"))
    above = above.select("host", "path", "salt", _key(F.slice("labels", F.lit(1), F.col("n")), F.col("path")).alias("key"))
    placed = _spread(held, above, slabs)
    swept = (
        placed.repartition(slabs, "slab").sortWithinPartitions("slab", "key", "kind", "verdict")
        .mapInArrow(_sweep, "host string, path string, rule string, verdict string")
    )
    length = F.struct(F.length("rule"), F.instr("rule", "/"), F.col("verdict"))
    return swept.groupBy("host", "path").agg(
        F.max_by(F.struct("rule", "verdict"), length).alias("best")).select("host", "path", "best.*")


def judge(pages: DataFrame, rules: DataFrame, otherwise: str = "allow", slabs: int | None = None) -> DataFrame:
    """``page_id``, ``host``, ``path``, ``rule`` and ``verdict`` of every row of ``pages`` (``page_id``, ``url``).

    ``rules`` has ``host``, ``path`` and ``verdict``; the longest fitting rule wins, of two
    equally long ones that with the longer host.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", host.alias("host"), path.alias("path"))
    slabs = slabs or min(MOST_SLABS, 4 * partitions(pages))
    distinct = cut(split.select("host", "path").distinct(), "addresses").df
    best = fitting(distinct, rules, slabs)
    return split.join(best, ["host", "path"], "left").select(
        "page_id", "host", "path", "rule", F.coalesce("verdict", F.lit(otherwise)).alias("verdict"))
