"""Near-duplicates by circulant MinHash, banding and exact verification.

A document is the set of its distinct word shingles.  Circulant MinHash takes two
permutations instead of one per coordinate: the first scatters shingles over a universe of
``UNIVERSE`` places, and coordinate k is the smallest value of the second one, shifted by k
places, over the set.  The shifts of one place are neighbours in memory, so a signature is
a running minimum over slices of one table.

1. Documents with equal sets form a class; one of them stands for it from then on.
2. Signatures are cut into bands; classes that agree in a band share a bucket.
3. In each bucket every class is compared with the smallest one, its centre: first by the
   signatures, then exactly, on the full sets.  Links so found are joined to components.
4. In buckets that still hold several components, the classes outside the most frequent one are
   compared with all of the bucket, in blocks; what has close signatures leaves a block
   as one row for a class and many others.  These lists meet the texts in shards, and only
   links leave them.  So all links between bucket mates count, a group of thousands of
   copies needs one comparison each, and no table holds a group's pairs.

With 32 bands of 5 a pair of similarity 0.8 shares no bucket with a chance of about 3e-6;
two signatures of 160 coordinates are estimated below 0.66 at 0.8 with about 5e-6.

Nothing is collected but counts, and every link is confirmed on the full sets.  A null or
empty text, or one without words, has an empty set and is linked with nothing.  Rows that
share a ``doc_id`` are judged by their own texts; a null ``doc_id`` stands behind all others.
An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.lineage import cut
from symbolweave.llm.components import components, composed, relabelled
from symbolweave.llm.text import chunks, id_and_text, mix, shingle_sets

BANDS, ROWS = 32, 5
UNIVERSE = 1 << 20
# Bits of the first permutation's place that are used, and shingles looked at together.
SHIFT, BLOCK = np.uint64(44), 1 << 14
# Estimated similarity below this is taken as no link.
CLOSE = 0.66
# Classes of a bucket that are compared in one block: those outside its main component, and all.
FEW, MANY = 128, 512
# Texts that a task holds while it verifies what is asked of them.
TEXTS_PER_SHARD = 1500


def _circle(width: int) -> np.ndarray:
    """The second permutation, its beginning repeated at its end: row s holds the values of place s under each shift."""
    values = np.random.default_rng(20).permutation(UNIVERSE).astype(np.int32)
    return np.lib.stride_tricks.sliding_window_view(np.concatenate([values, values[: width - 1]]), width)


def signatures(shingles: np.ndarray, starts: np.ndarray, width: int) -> np.ndarray:
    """A row of ``width`` coordinates for each set that is not empty, in order."""
    circle = _circle(width)
    places = (mix(shingles ^ np.uint64(0x5851F42D4C957F2D)) >> SHIFT).astype(np.int64)
    starts = starts[:-1][np.diff(starts) > 0].tolist() + [len(shingles)]
    out = np.empty((len(starts) - 1, width), np.int32)
    at = 0
    while at < len(out):
        to = at + 1
        while to < len(out) and starts[to + 1] - starts[at] <= BLOCK:
            to += 1
        if to == at + 1:  # a large set, piece by piece
            out[at] = np.min([circle[places[k : min(k + BLOCK, starts[to])]].min(axis=0)
                              for k in range(starts[at], starts[to], BLOCK)], axis=0)
        else:
            block = circle[places[starts[at] : starts[to]]]
            out[at:to] = np.minimum.reduceat(block, np.array(starts[at:to]) - starts[at], axis=0)
        at = to
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key for each band of each signature."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(bands, dtype=np.uint64), parts.shape[:2]).copy()
    for k in range(rows):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + parts[:, :, k])
    return keys


def _signed(size: int, bands: int, rows: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            shingles, starts = shingle_sets(chunk.column(1), size)
            counts = np.diff(starts)
            full = np.flatnonzero(counts)
            signature = signatures(shingles, starts, bands * rows)
            keys = band_keys(signature, bands, rows)
            prints = [None] * len(counts)
            for k in full:
                prints[k] = xxhash.xxh3_128_digest(shingles[starts[k] : starts[k + 1]].tobytes())
            ends = np.concatenate([[0], np.cumsum((counts > 0) * bands)])
            sketches, tags = [None] * len(counts), [None] * len(counts)
            for k, sketch, key in zip(full, signature.astype(np.uint8), keys.astype(np.uint32), strict=True):
                sketches[k], tags[k] = sketch.tobytes(), key.tobytes()
            yield pa.RecordBatch.from_arrays([
                chunk.column(0), chunk.column(2), pa.array(counts, pa.int64()), pa.array(prints, pa.binary()),
                pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys.ravel().view(np.int64))),
                pa.array(sketches, pa.binary()), pa.array(tags, pa.binary()),
            ], names=["doc_id", "digest", "n_shingles", "print", "bands", "sketch", "tags"])

    return task


def _compressed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    packer = zstandard.ZstdCompressor(level=3)
    for chunk in chunks(batches):
        packed = [packer.compress(t) for t in chunk.column(1).cast(pa.binary()).to_pylist()]
        yield pa.RecordBatch.from_arrays([chunk.column(0), pa.array(packed, pa.binary())], names=["doc_id", "packed"])


def _own_text(size: int):
    """Only rows whose text gives the set that is looked for."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                shingles, starts = shingle_sets(_texts(part.column(2)), size)
                same = [p == xxhash.xxh3_128_digest(shingles[a:b].tobytes())
                        for p, a, b in zip(part.column(1).to_pylist(), starts, starts[1:], strict=False)]
                yield part.filter(pa.array(same, pa.bool_())).select([0, 2])

    return task


def _texts(packed: pa.Array) -> pa.Array:
    reader = zstandard.ZstdDecompressor()
    return pa.array([reader.decompress(z).decode() for z in packed.to_pylist()], pa.large_string())


def _links(size: int, least: int):
    """Pairs (``a``, ``b``, ``packed_a``, ``packed_b``) whose sets are similar enough."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                (x, xs), (y, ys) = (shingle_sets(_texts(part.column(k)), size) for k in (2, 3))
                linked = []
                for k in range(part.num_rows):
                    one, two = x[xs[k] : xs[k + 1]], y[ys[k] : ys[k + 1]]
                    shared = len(np.intersect1d(one, two, assume_unique=True))
                    linked.append(100 * shared >= least * (len(one) + len(two) - shared))
                yield part.filter(pa.array(linked, pa.bool_())).select([0, 1])

    return task


def _close(one: np.ndarray, two: np.ndarray) -> np.ndarray:
    """Whether signatures, of which the last 8 bits are kept, are near enough to be compared exactly."""
    agree = (one == two).mean(axis=-1)
    return (agree - 1 / 256) / (1 - 1 / 256) >= CLOSE


def _close_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of pairs (``a``, ``b``, ``sketch_a``, ``sketch_b``), those with close signatures."""
    for batch in batches:
        if batch.num_rows:
            one, two = (np.frombuffer(b"".join(batch.column(k).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                        for k in (2, 3))
            yield batch.filter(pa.array(_close(one, two))).select([0, 1])


def _block_pairs(least: int, shards: int):
    """Close pairs of classes of different components within each run of equal (key, block, part)."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: pa.Table | None = None
        for batch in batches:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([rest, table]) if rest is not None else table
            yield from _runs(table, False, least, shards)
            ids = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
            last = np.flatnonzero((ids != ids[-1]).any(axis=1))
            rest = table.slice(int(last[-1]) + 1 if len(last) else 0).combine_chunks()
        if rest is not None:
            yield from _runs(rest, True, least, shards)

    return task


def _runs(table: pa.Table, whole: bool, least: int, shards: int) -> Iterator[pa.RecordBatch]:
    if not table.num_rows:
        return
    ids = np.stack([table.column(k).to_numpy() for k in range(3)], axis=1)
    edges = np.flatnonzero((ids[1:] != ids[:-1]).any(axis=1)) + 1
    edges = [0, *edges.tolist(), *([table.num_rows] if whole else [])]
    few, node, label, band, count = (table.column(k).to_numpy() for k in (3, 4, 5, 6, 7))
    sketch, tags = (np.frombuffer(b"".join(table.column(k).to_pylist()), kind).reshape(table.num_rows, -1)
                    for k, kind in ((8, np.uint8), (9, np.uint32)))
    out: list[tuple[int, int, list[int]]] = []
    for at, to in zip(edges, edges[1:], strict=False):
        ones, twos = np.flatnonzero(few[at:to] == 1) + at, np.flatnonzero(few[at:to] == 0) + at
        for one in ones:
            others = twos[label[twos] != label[one]]
            # sets of too different sizes cannot be linked
            sizes = np.sort(np.stack([count[others], np.full(len(others), count[one])]), axis=0)
            others = others[100 * sizes[0] >= least * sizes[1]]
            # a pair is met in the first band that it shares
            others = others[(tags[others] == tags[one]).argmax(axis=1) == band[one]]
            others = others[_close(sketch[others], sketch[one])]
            if len(others):
                shard = _shard(node[others], shards)
                order = np.argsort(shard, kind="stable")
                heads = np.flatnonzero(np.append(True, np.diff(shard[order]) != 0))
                out += [(int(shard[part[0]]), int(node[one]), node[others[part]].tolist())
                        for part in np.split(order, heads[1:])]
    columns = zip(*out, strict=True) if out else [[], [], []]
    yield pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)],
        names=["shard", "a", "others"])


def _shard(nodes: np.ndarray, shards: int) -> np.ndarray:
    return (mix(nodes.astype(np.int64).view(np.uint64)) % np.uint64(shards)).astype(np.int32)


def _dealt_texts(shards: int):
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            nodes = batch.column(0).to_numpy()
            yield pa.RecordBatch.from_arrays([pa.array(_shard(nodes, shards)), batch.column(0), batch.column(1)],
                                             names=["shard", "node", "packed"])

    return task


def _links_of_shard(size: int, least: int):
    """Requests (``a``, ``others``, ``packed``) against the texts of a shard: only links leave it."""

    def task(requests: pa.Table, texts: pa.Table) -> pa.Table:
        wanted = requests.column("others").to_pylist()
        needed = np.unique(np.concatenate([np.array(w, np.int64) for w in wanted])) if wanted else np.zeros(0, np.int64)
        nodes = texts.column("node").to_numpy()
        rows = np.flatnonzero(np.isin(nodes, needed))
        nodes = nodes[rows]
        packed = texts.column("packed").take(pa.array(rows)).combine_chunks()
        sets: dict[int, np.ndarray] = {}
        for at in range(0, len(rows), 200):
            shingles, starts = shingle_sets(_texts(packed.slice(at, 200)), size)
            sets |= {int(n): shingles[i:j] for n, i, j in zip(nodes[at : at + 200], starts, starts[1:], strict=False)}
        found: dict[int, np.ndarray] = {}
        out: list[tuple[int, int]] = []
        for a, others, text in zip(requests.column("a").to_pylist(), wanted, requests.column("packed"), strict=True):
            if a not in found:
                found[a] = shingle_sets(_texts(pa.array([text.as_py()], pa.binary())), size)[0]
            own = found[a]
            others = [b for b in others if b in sets]
            for at in range(0, len(others), 500):
                part = others[at : at + 500]
                lengths = np.array([len(sets[b]) for b in part])
                every = np.concatenate([sets[b] for b in part])
                place = np.minimum(np.searchsorted(own, every), len(own) - 1)
                shared = np.add.reduceat((own[place] == every).astype(np.int64), np.cumsum(lengths) - lengths)
                linked = 100 * shared >= least * (len(own) + lengths - shared)
                out += [(min(a, part[k]), max(a, part[k])) for k in np.flatnonzero(linked)]
        one, two = zip(*out, strict=True) if out else ((), ())
        return pa.table({"a": pa.array(one, pa.int64()), "b": pa.array(two, pa.int64())})

    return task


def _leftover_requests(mates: DataFrame, labels: DataFrame, classes: DataFrame, least: int, shards: int) -> DataFrame:
    """Bucket mates in different components with close signatures: a class, and others of one shard of texts."""
    node = F.col("node")
    told = mates.join(labels, "node", "left").select("key", "band", "node", F.coalesce("label", "node").alias("label"))
    told = cut(told, "mates").df
    counts = told.groupBy("key", "label").agg(F.count(F.lit(1)).alias("n"))
    mixed = counts.groupBy("key").agg(
        F.sum("n").alias("n"), F.max(F.struct("n", "label")).alias("main"), F.count(F.lit(1)).alias("labels"))
    mixed = mixed.filter("labels > 1").select(
        "key", F.col("main.label").alias("main"),
        F.ceil(F.col("n") / MANY).cast("int").alias("blocks"),
        F.ceil((F.col("n") - F.col("main.n")) / FEW).cast("int").alias("parts"))
    rows = told.join(mixed, "key").join(classes.select("node", "n_shingles", "sketch", "tags"), "node")
    carried = ["node", "label", "band", "n_shingles", "sketch", "tags"]
    block, part = F.pmod(F.xxhash64(node), F.col("blocks")), F.pmod(F.xxhash64(node, F.lit(1)), F.col("parts"))
    every = rows.select("key", block.cast("int").alias("block"), F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"),
                        F.lit(0).alias("few"), *carried)
    few = rows.filter(F.col("label") != F.col("main")).select(
        "key", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"), part.cast("int").alias("part"),
        F.lit(1).alias("few"), *carried)
    dealt = every.unionByName(few).repartition("key", "block", "part").sortWithinPartitions("key", "block", "part")
    return dealt.mapInArrow(_block_pairs(least, shards), "shard int, a long, others array<long>")


def _digest() -> Column:
    """Tells texts apart, a null one being empty."""
    return F.unhex(F.md5(F.coalesce(F.col("text").cast("string"), F.lit(""))))


def _grouped(docs: DataFrame, size: int, least: int, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(doc_id, digest, n_shingles, label, component_id) of every row; ``label`` tells groups apart, null for no shingles."""
    docs = id_and_text(docs)
    signed = cut(docs.withColumn("digest", _digest()).mapInArrow(
        _signed(size, bands, rows),
        "doc_id long, digest binary, n_shingles long, print binary, bands array<long>, sketch binary, tags binary"), "signed").df
    classes = cut(
        signed.filter("n_shingles > 0").groupBy("print")
        .agg(F.min("doc_id").alias("first_id"), *[F.first(c).alias(c) for c in ("n_shingles", "bands", "sketch", "tags")])
        .withColumn("node", F.monotonically_increasing_id()), "classes").df
    banded = classes.select("node", F.posexplode("bands").alias("band", "key"))
    shared = banded.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("centre")).filter("n > 1")
    mates = cut(banded.join(shared.select("key", "centre"), "key"), "buckets").df

    wanted = mates.select("node").distinct().join(classes.select("node", "first_id", "print"), "node")
    packed = docs.mapInArrow(_compressed, "doc_id long, packed binary")
    texts = cut(
        packed.join(wanted, packed.doc_id.eqNullSafe(wanted.first_id)).select("node", "print", "packed")
        .mapInArrow(_own_text(size), "node long, packed binary").dropDuplicates(["node"]), "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        one = texts.df.select(F.col("node").alias("a"), F.col("packed").alias("packed_a"))
        two = texts.df.select(F.col("node").alias("b"), F.col("packed").alias("packed_b"))
        joined = pairs.join(one, "a").join(two, "b").select("a", "b", "packed_a", "packed_b")
        return cut(joined.mapInArrow(_links(size, least), "a long, b long"), "verified").df

    stars = mates.filter("node != centre").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct()
    sketch = classes.select("node", "sketch")
    stars = cut(
        stars.join(sketch.toDF("a", "sketch_a"), "a").join(sketch.toDF("b", "sketch_b"), "b")
        .select("a", "b", "sketch_a", "sketch_b").mapInArrow(_close_pairs, "a long, b long"), "stars").df
    links = verified(stars)
    labels = components(links)
    shards = max(1, texts.rows // TEXTS_PER_SHARD)
    requests = cut(_leftover_requests(mates.select("key", "band", "node"), labels, classes, least, shards), "requests")
    if requests.rows:
        asked = requests.df.join(texts.df.select(F.col("node").alias("a"), "packed"), "a")
        dealt = texts.df.mapInArrow(_dealt_texts(shards), "shard int, node long, packed binary")
        more = cut(asked.groupBy("shard").cogroup(dealt.groupBy("shard"))
                   .applyInArrow(_links_of_shard(size, least), "a long, b long"), "verified").df
        labels = cut(composed(labels, components(relabelled(more, labels))), "labels").df

    told = classes.select("node", "print", "first_id").join(labels, "node", "left").select(
        "print", "first_id", F.coalesce("label", "node").alias("label"))
    told = cut(told, "told").df
    first = told.groupBy("label").agg(F.min("first_id").alias("component_id"))
    by_print = told.join(first, "label").select("print", "label", "component_id")
    alone = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        signed.select("doc_id", "digest", "n_shingles", "print").join(by_print, "print", "left")
        .select("doc_id", "digest", "n_shingles", "label", alone.alias("component_id"))
    )


def near_duplicates(docs: DataFrame, size: int = 5, least: int = 80, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """``doc_id``, ``n_shingles``, ``component_id`` and ``kept`` of every row of ``docs``.

    Sets of ``size``-word shingles are linked if their similarity is ``least`` per cent or more.
    """
    return _grouped(docs, size, least, bands, rows).select(
        "doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def keep(docs: DataFrame, size: int = 5, least: int = 80) -> DataFrame:
    """One row of ``docs`` for each group: of the smallest ``doc_id`` (a null one comes last), then of the smallest digest.

    Rows without a shingle stay; of rows with one ``doc_id`` and text, one does.
    """
    rows = _grouped(docs, size, least)
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first")
    chosen = rows.filter("n_shingles > 0").groupBy("label").agg(first).select("first.doc_id", "first.digest")
    empty = rows.filter("n_shingles = 0").select("doc_id", "digest").distinct()
    kept = chosen.unionByName(empty).select(F.col("doc_id").alias("_kept"), F.col("digest").alias("_kept_digest"))
    marked = docs.withColumn("_digest", _digest())
    stay = marked.join(kept, marked.doc_id.eqNullSafe(F.col("_kept")) & (F.col("_digest") == F.col("_kept_digest")), "left_semi")
    return stay.drop("_digest").dropDuplicates(["doc_id", "text"])
