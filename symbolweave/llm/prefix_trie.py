"""The trie of all beginnings of conversations, as balanced parentheses cut into shards.

1. A conversation becomes one row: 16 bytes of SHA-256 for each turn, joined to a key, and the sizes of
   its texts.  Texts are not moved.  ``rebuilt`` puts the first turns of another conversation in front.
2. Equal keys are combined: rows are dealt by ranges of (key, id), so a key that a third of all
   conversations share is spread over many tasks; each makes a few pieces of its ids, and only those meet
   in one stream, in order, for the digest of the ids.
3. Different keys are dealt by ranges, so a shard is an interval of the trie in preorder.  It is written
   down as balanced parentheses.  Blocks of their excess keep least and greatest values, in a tree over the
   blocks; ``find_close`` searches it and so delimits each node's subtree.  The number of ``()`` pairs before a
   place counts leaves, running sums give members and savings.
4. A beginning that goes on in the next shard lies on the spine both share.  Each shard knows how many turns its
   first key shares with the key before the shard, and its last key with the one behind it.  What a
   spine's nodes have in each shard adds up: a node, a child and a leaf are counted by the first shard that
   holds them.  Spine rows alone are grouped; nodes whose parent is on a spine look its id up.

Shards are as many as the turns need (``SHARD_TURNS``), so a task's memory is bounded, by the turns of one
conversation at least: those are 40 bytes each.  Rows without ``conv_id`` belong to no conversation and are left
out.  Null roles and texts are empty.  Turns with one number, repeated rows too, are all kept, in the order of
SHA-256 of (length of role, ``:``, role, text).  A table without conversations gives no node, not even a root.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import Cut, cut, join_frontier
from symbolweave.llm.text import release

PRINT = 16  # bytes of a turn in a key
SHARD_TURNS = 500_000
PIECE_IDS = 100_000
BLOCK = 256  # parentheses in a block
NO_ENDS = hashlib.sha256(b"").hexdigest()

PIECES = "key binary, sizes array<int>, first_id long, n long, ids string"
LISTED = "shard int, key binary, sizes array<int>, conv_id long, n long, ends string"
PARTS = ("print binary, parent_print binary, spine boolean, conv_id long, depth long, parent_conv_id long, n_convs long, "
         "n_children long, n_leaves long, saved_tokens long, ends string")


class Parentheses:
    """A balanced sequence, ``True`` opening, that finds the ends of subtrees."""

    def __init__(self, bits: np.ndarray) -> None:
        self.opens = np.flatnonzero(bits)
        self.opened = np.cumsum(bits)
        pairs = np.zeros(len(bits), bool)
        pairs[:-1] = bits[:-1] & ~bits[1:]
        self.pairs = np.cumsum(pairs)
        excess = np.cumsum(np.where(bits, 1, -1)).astype(np.int32)
        blocks = -(-len(excess) // BLOCK)
        # what is behind the end is out of reach of any search
        self.excess = np.full((blocks, BLOCK), np.iinfo(np.int32).max, np.int32)
        self.excess.ravel()[: len(excess)] = excess
        self.leaves = 1 << max(0, (blocks - 1).bit_length())
        self.least = np.full(2 * self.leaves, np.iinfo(np.int32).max, np.int32)
        self.greatest = np.full(2 * self.leaves, np.iinfo(np.int32).min, np.int32)
        self.least[self.leaves : self.leaves + blocks] = self.excess.min(axis=1)
        inside = np.where(self.excess == np.iinfo(np.int32).max, np.iinfo(np.int32).min, self.excess)
        self.greatest[self.leaves : self.leaves + blocks] = inside.max(axis=1)
        row = self.leaves >> 1
        while row:
            at = np.arange(row, 2 * row)
            self.least[at] = np.minimum(self.least[2 * at], self.least[2 * at + 1])
            self.greatest[at] = np.maximum(self.greatest[2 * at], self.greatest[2 * at + 1])
            row >>= 1

    def _holds(self, at: np.ndarray, wanted: np.ndarray) -> np.ndarray:
        """Excess moves by ones, so a block holds every value between its least and its greatest."""
        return (self.least[at] <= wanted) & (wanted <= self.greatest[at])

    def _first_in(self, block: np.ndarray, wanted: np.ndarray, after: np.ndarray) -> np.ndarray:
        """The first place in each block, behind ``after``, with the wanted excess; -1 for none."""
        hits = (self.excess[block] == wanted[:, None]) & (np.arange(BLOCK) > after[:, None])
        return np.where(hits.any(axis=1), block * BLOCK + hits.argmax(axis=1), -1)

    def find_close(self, opens: np.ndarray, together: int = 1 << 14) -> np.ndarray:
        """Where the parentheses at ``opens`` close."""
        parts = [self._find(opens[at : at + together]) for at in range(0, len(opens), together)]
        return np.concatenate(parts) if parts else opens

    def _find(self, opens: np.ndarray) -> np.ndarray:
        block = opens // BLOCK
        wanted = self.excess.ravel()[opens] - 1
        found = self._first_in(block, wanted, opens % BLOCK)
        rest = np.flatnonzero(found < 0)
        at, looked = block[rest] + self.leaves, wanted[rest]
        going = np.ones(len(rest), bool)
        while going.any():  # up, until a block to the right holds what is wanted
            left = going & (at % 2 == 0)
            hit = left.copy()
            hit[left] = self._holds(at[left] + 1, looked[left])
            at[hit] += 1
            going &= ~hit
            at[going] >>= 1
        while len(at) and (at < self.leaves).any():  # down, to the first block that does
            down = at < self.leaves
            child = 2 * at[down]
            at[down] = np.where(self._holds(child, looked[down]), child, child + 1)
        found[rest] = self._first_in(at - self.leaves, looked, np.full(len(rest), -1))
        return found


class RangeLeast:
    """The least value of any range of an array."""

    def __init__(self, values: np.ndarray) -> None:
        self.rows = [values]
        while 2 << (len(self.rows) - 1) <= len(values):
            half, last = 1 << (len(self.rows) - 1), self.rows[-1]
            self.rows.append(np.minimum(last[:-half], last[half:]))

    def of(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        level = np.floor(np.log2(hi - lo)).astype(np.int64)
        out = np.empty(len(lo), np.int64)
        for k in np.unique(level).tolist():
            mine = level == k
            out[mine] = np.minimum(self.rows[k][lo[mine]], self.rows[k][hi[mine] - (1 << k)])
        return out


def shared_turns(a: bytes | None, b: bytes | None) -> int:
    """How many turns two keys begin with alike; -1 if one is missing."""
    if a is None or b is None:
        return -1
    n = min(len(a), len(b)) // PRINT
    x, y = (np.frombuffer(k, f"V{PRINT}", n) if n else np.zeros(0) for k in (a, b))
    different = np.flatnonzero(x != y)
    return int(different[0]) if len(different) else n


def _shared_with_previous(turns: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each sorted key, how many turns it shares with the one before; 0 for the first."""
    sizes = np.diff(starts)
    both = np.minimum(sizes[1:], sizes[:-1])
    rows = np.repeat(np.arange(len(both)), both)
    within = np.arange(len(rows)) - np.repeat(np.cumsum(both) - both, both)
    same = (turns[starts[1:-1][rows] + within] == turns[starts[:-2][rows] + within]).all(axis=1)
    shared = both.copy()
    np.minimum.at(shared, rows[~same], within[~same])
    return np.concatenate([[0], shared])


def _spine_prints(key: bytes, turns: int) -> list[bytes]:
    """A name for each beginning of a key, of none to ``turns`` turns."""
    running = hashlib.blake2b(digest_size=16)
    out = [running.digest()]
    for at in range(0, turns * PRINT, PRINT):
        running.update(key[at : at + PRINT])
        out.append(running.copy().digest())
    return out


def shard_nodes(keys: list[bytes], sizes: np.ndarray, ids: np.ndarray, counts: np.ndarray, ends: list[str],
                left: int, right: int) -> pa.Table:
    """The nodes of a shard of different sorted keys.

    ``sizes`` are those of all turns in a row, ``left`` and ``right`` what the first and last key share with their
    neighbours outside, -1 without one.
    """
    length = np.array([len(k) // PRINT for k in keys], np.int64)
    starts = np.concatenate([[0], np.cumsum(length)])
    shared = _shared_with_previous(np.frombuffer(b"".join(keys), "<u8").reshape(-1, PRINT // 8), starts)
    new = length - shared
    total = 1 + int(new.sum())
    runs = np.zeros(2 * len(keys) + 2, np.int64)
    runs[0], runs[-1] = 1, length[-1] + 1
    runs[2:-1:2], runs[3:-1:2] = new, length[:-1] - shared[1:]
    bits = np.repeat(np.arange(len(runs)) % 2 == 0, runs)
    tree = Parentheses(bits)
    close = tree.find_close(tree.opens)
    until = tree.opened[close]

    owner = np.concatenate([[0], np.repeat(np.arange(len(keys)), new)])
    depth = np.concatenate([[0], np.arange(total - 1) - np.repeat(np.cumsum(new) - new, new) + np.repeat(shared, new) + 1])
    weight = np.concatenate([[0], sizes[(starts[owner] + depth - 1)[1:]]]).astype(np.int64)
    last_node = np.cumsum(new)
    to = np.searchsorted(last_node, until)
    running = np.concatenate([[0], np.cumsum(counts)])
    members = running[to] - running[owner]

    node = np.arange(total)
    on_left = (node <= left) & (owner == 0)
    on_right = (until == total) & (depth <= right)
    spine = on_left | on_right
    gain = np.concatenate([[0], np.cumsum(members * weight - np.where(on_left, 0, weight))])
    before = tree.opens - 1
    leaves = tree.pairs[close] - np.where(before < 0, 0, tree.pairs[before])
    if right == length[-1]:
        leaves = leaves - (until == total)
    by_depth = np.sort(depth * (total + 1) + node)
    children = (np.searchsorted(by_depth, (depth + 1) * (total + 1) + until)
                - np.searchsorted(by_depth, (depth + 1) * (total + 1) + node)) - (on_left & (depth < left))
    parent = by_depth[np.maximum(np.searchsorted(by_depth, (depth - 1) * (total + 1) + node) - 1, 0)] % (total + 1)

    prints = np.full(total, None, object)
    first, last = np.flatnonzero(on_left), np.flatnonzero(on_right)
    for nodes, key in ((first, keys[0]), (last, keys[-1])):
        if len(nodes):
            prints[nodes] = np.array(_spine_prints(key, len(nodes) - 1), object)
    least = RangeLeast(ids).of(owner, to)
    below = (depth > 0) & spine[parent]
    ended = np.full(total, None, object)
    ended[last_node] = ends
    known = (depth > 0) & ~below
    return pa.table({
        "print": pa.array(prints, pa.binary()),
        "parent_print": pa.array(np.where(below, prints[parent], None), pa.binary()),
        "spine": spine, "conv_id": least, "depth": depth,
        "parent_conv_id": pa.array(least[parent], pa.int64(), mask=~known),
        "n_convs": members, "n_children": children, "n_leaves": leaves, "saved_tokens": gain[until] - gain[node],
        "ends": pa.array(ended, pa.string()),
    })


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (key, sizes, id) rows as pieces of equal keys, each with a bounded number of ids."""
    schema = pa.schema([("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("first_id", pa.int64()), ("n", pa.int64()),
                        ("ids", pa.string())])
    key, held, sizes, out = None, [], None, []

    def piece():
        return {"key": key, "sizes": sizes, "first_id": held[0], "n": len(held), "ids": ",".join(map(str, held))}

    for batch in batches:
        keys, ids = batch.column(0).to_pylist(), batch.column(2).to_pylist()
        for at, (each, conv_id) in enumerate(zip(keys, ids, strict=True)):
            if held and (each != key or len(held) >= PIECE_IDS):
                out.append(piece())
                held = []
            if not held:
                key, sizes = each, batch.column(1)[at].as_py()
            held.append(conv_id)
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if held:
        yield pa.RecordBatch.from_pylist([piece()], schema=schema)


def _list(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces as one row for each key; the ids go through the digest piece by piece."""
    shard = TaskContext.get().partitionId()
    schema = pa.schema([("shard", pa.int32()), ("key", pa.binary()), ("sizes", pa.list_(pa.int32())), ("conv_id", pa.int64()),
                        ("n", pa.int64()), ("ends", pa.string())])
    row, digest, out = None, None, []

    def done():
        return {**row, "ends": digest.hexdigest()}

    for batch in batches:
        for piece in batch.to_pylist():
            if row and piece["key"] == row["key"]:
                row["n"] += piece["n"]
                digest.update(("," + piece["ids"]).encode())
                continue
            if row:
                out.append(done())
            row = {"shard": shard, "key": piece["key"], "sizes": piece["sizes"], "conv_id": piece["first_id"], "n": piece["n"]}
            digest = hashlib.sha256(piece["ids"].encode())
        if out:
            yield pa.RecordBatch.from_pylist(out, schema=schema)
            out = []
    if row:
        yield pa.RecordBatch.from_pylist([done()], schema=schema)


def _shard(table: pa.Table) -> pa.Table:
    table = table.sort_by("key").combine_chunks()
    sizes = pc.list_flatten(table.column("sizes")).to_numpy(zero_copy_only=False)
    out = shard_nodes(table.column("key").to_pylist(), sizes, table.column("conv_id").to_numpy(), table.column("n").to_numpy(),
                      table.column("ends").to_pylist(), table.column("left")[0].as_py(), table.column("right")[0].as_py())
    release()
    return out


def _borders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        shard, least, greatest, before, behind = (batch.column(k).to_pylist() for k in range(5))
        yield pa.RecordBatch.from_arrays([
            pa.array(shard, pa.int32()), pa.array(map(shared_turns, before, least), pa.int32()),
            pa.array(map(shared_turns, greatest, behind), pa.int32())], names=["shard", "left", "right"])


def as_turns(conversations: DataFrame) -> DataFrame:
    """One row a conversation: (conv_id, turns), a turn being (print, size), in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    whole = F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256)
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.struct(F.col("turn").cast("long").alias("turn"), whole.alias("print"), F.length(text).alias("size")).alias("turn"),
    ).filter("conv_id is not null")
    turns = F.transform(F.sort_array(F.collect_list("turn")), lambda t: F.struct(
        F.substring(t["print"], 1, 2 * PRINT).alias("print"), t["size"].alias("size")))
    return rows.groupBy("conv_id").agg(turns.alias("turns"))


def rebuilt(conversations: DataFrame, family: int = 100, most: int = 5) -> DataFrame:
    """Conversations that begin as the first of their family does: its first h turns, then their own after h.

    h is the unsigned CRC-32 of the id's digits modulo ``most`` + 1; the first of a family has an id that
    ``family`` divides.
    """
    own = cut(as_turns(conversations), "turns").df
    h = (F.crc32(F.col("conv_id").cast("string")) % (most + 1)).cast("int")
    heads = own.filter(F.col("conv_id") % family == 0).select(
        F.col("conv_id").alias("head_id"), F.slice("turns", 1, most).alias("head"))
    joined = own.join(heads, F.col("conv_id") - F.col("conv_id") % family == F.col("head_id"), "left")
    front = F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), h)).otherwise(F.slice("turns", F.lit(1), F.lit(0)))
    return joined.select("conv_id", F.concat(front, F.slice("turns", h + 1, F.size("turns"))).alias("turns"))


def trie(conversations: DataFrame) -> DataFrame:
    """The nodes of all beginnings of (conv_id, turns) rows, see ``as_turns``; ids must differ.

    A node is named by its smallest member ``conv_id`` and its ``depth``; ``saved_tokens`` are the characters that
    members of its subtree need not store again.
    """
    spark = conversations.sparkSession
    paths = cut(conversations.select(
        F.unhex(F.array_join(F.transform("turns", lambda t: t["print"]), "")).alias("key"),
        F.transform("turns", lambda t: t["size"]).cast("array<int>").alias("sizes"), "conv_id"), "paths").df
    turns = paths.agg(F.sum(F.size("sizes").cast("long") + 1).alias("n")).first().n or 0
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-turns // SHARD_TURNS))
    dealt = paths.repartitionByRange(shards, "key", "conv_id").sortWithinPartitions("key", "conv_id")
    pieces = cut(dealt.mapInArrow(_combine, PIECES), "pieces").df
    in_order = pieces.repartitionByRange(shards, "key").sortWithinPartitions("key", "first_id")
    listed = cut(in_order.mapInArrow(_list, LISTED), "listed").df

    ends = cut(listed.groupBy("shard").agg(F.min("key").alias("least"), F.max("key").alias("greatest")), "ends").df
    numbers = sorted(r.shard for r in ends.select("shard").collect())
    beside = spark.createDataFrame(list(zip(numbers, [None, *numbers], [*numbers[1:], None], strict=False)),
                                   "shard int, before int, behind int")
    around = (
        ends.join(beside, "shard")
        .join(ends.select(F.col("shard").alias("before"), F.col("greatest").alias("last")), "before", "left")
        .join(ends.select(F.col("shard").alias("behind"), F.col("least").alias("next")), "behind", "left")
        .select("shard", "least", "greatest", "last", "next")
    )
    borders = cut(around.mapInArrow(_borders, "shard int, left int, right int"), "borders")
    parts = cut(
        listed.join(F.broadcast(borders.df) if borders.small else borders.df, "shard").groupBy("shard").applyInArrow(_shard, PARTS),
        "nodes").df

    figures = ["n_convs", "n_children", "n_leaves", "saved_tokens"]
    spine = cut(parts.filter("spine").groupBy("print").agg(
        F.max("parent_print").alias("parent_print"), F.min("conv_id").alias("conv_id"), F.max("depth").alias("depth"),
        *[F.sum(c).alias(c) for c in figures], F.max("ends").alias("ends")), "spine")
    parents = Cut(spine.df.select(F.col("print").alias("parent_print"), F.col("conv_id").alias("parent_conv_id")), spine.rows)
    columns = ["conv_id", "depth", "parent_conv_id", *figures, F.coalesce("ends", F.lit(NO_ENDS)).alias("ends_sha256")]

    def with_parent(rows: DataFrame) -> DataFrame:
        return join_frontier(rows, parents, "parent_print", F.struct("conv_id", "depth"), "left").select(*columns)

    plain = parts.filter("not spine and parent_print is null").select(*columns)
    pending = parts.filter("not spine and parent_print is not null").drop("parent_conv_id")
    return plain.unionByName(with_parent(pending)).unionByName(with_parent(spine.df))
