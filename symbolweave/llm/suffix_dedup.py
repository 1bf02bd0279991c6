"""Exact removal of repeated strings across documents, by sorted suffixes.

Every byte covered by a string of ``length`` bytes that also starts in a document with a
smaller ``doc_id`` is removed; strings are judged on the input.

Strings that are equal must meet in one task.  In each string of ``length`` bytes the
``GRAM`` bytes with the smallest hash are its anchor; strings in a row mostly share their
anchor and travel together, as one piece of text, to the bucket of the anchor's hash.
Within a block of text a piece that occurs in several documents is settled at once for all
but the first of them, so that one that a third of all documents share reaches its bucket
once per block.  A bucket sorts its pieces' suffixes from the anchor on; where anchors agree but
pieces differ, all their strings are sorted as suffixes, deep-shallow, and the smallest
``doc_id`` of each class of equal strings decides.  Runs found there travel to the bucket of
their document and meet its text.

Texts travel compressed, and pieces of several blocks together, since small packages compress badly.  A very long
text is cut into overlapping blocks; the number of buckets follows the bytes of all texts, however they are split, and
a bucket's pieces are sorted in several passes by their anchors, so memory is bounded by the package and by the pass.

A null text is empty, and one shorter than ``length`` bytes keeps everything.  Rows with
equal ``doc_id`` do not remove from one another; a null ``doc_id`` counts as the largest.
Repeated rows are all returned.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import LongType, StringType, StructField, StructType

from symbolweave.llm.suffix_sort import WORD, deep_shallow, words_at
from symbolweave.llm.text import chunks, id_and_text, mix, release

LENGTH, GRAM = 50, 12
BLOCK, STEP = 4 << 20, 1 << 18
# Bytes of text whose pieces are packed together, and of pieces that are sorted at once.
PACKED, SORTED = 16 << 20, 32 << 20
# Bytes of text in a bucket of documents, and in one of pieces once there are many of those.
SHARD_BYTES, BUCKET_BYTES = 8 << 20, 32 << 20
LEAST_BUCKETS, MANY_BUCKETS = 24, 96
LAST = (1 << 63) - 1

ROUTED = "bucket int, kind int, data binary"
REPORT = StructType([StructField(c, StringType() if c == "kept_sha256" else LongType())
                     for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")])


def _pack(packer, *arrays) -> bytes:
    return packer.compress(pickle.dumps(arrays, protocol=5))


def _unpack(data: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(data))


def _shard(ids: np.ndarray, buckets: int) -> np.ndarray:
    return (mix(ids.astype(np.int64).view(np.uint64)) % np.uint64(buckets)).astype(np.int32)


def _tag(text: bytes) -> int:
    """Tells texts apart that share a ``doc_id``."""
    return xxhash.xxh3_64_intdigest(text) & 0xFFFFFFFF


def _blocks(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (row, first byte, bytes) of at most about ``BLOCK`` bytes; no string is split or repeated."""
    block, held = [], 0
    for row, text in enumerate(texts):
        for at in range(0, max(len(text) - length + 1, 0), BLOCK):
            part = text[at : at + BLOCK + length - 1]
            if held and held + len(part) > BLOCK:
                yield block
                block, held = [], 0
            block.append((row, at, part))
            held += len(part)
    if block:
        yield block


def _hashes(data: np.ndarray, at: slice | np.ndarray) -> np.ndarray:
    """Hashes of the ``GRAM`` bytes that begin at some places."""
    words = np.lib.stride_tricks.sliding_window_view(data, WORD)
    front, back = (np.ascontiguousarray(w[at]).view("<u8").ravel() for w in (words, words[GRAM - WORD :]))
    return mix(front * np.uint64(0x9E3779B97F4A7C15) + mix(back))


def _pieces(data: np.ndarray, offsets: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First and last string of every piece, its anchor's place and the anchor's hash.

    ``offsets`` are where parts begin (and the last one ends); no string crosses them.
    """
    bits = np.uint64(max(1, (len(data) - GRAM + 1).bit_length()))
    places, span = (np.uint64(1) << bits) - np.uint64(1), length - GRAM + 1
    anchors = np.empty(max(len(data) - length + 1, 0), np.int64)
    for at in range(0, len(anchors), STEP):  # step by step, as hashes and places are many times the text
        to = min(at + STEP, len(anchors))
        low = _hashes(data, np.s_[at : to + span - 1]) & ~places
        low |= np.arange(at, to + span - 1, dtype=np.uint64)
        reach = 1
        while reach * 2 <= span:
            low = np.minimum(low[:-reach], low[reach:])
            reach *= 2
        if span > reach:
            low = np.minimum(low[: len(low) - (span - reach)], low[span - reach :])
        anchors[at:to] = low & places
    valid = np.ones(len(anchors), bool)  # strings within one part
    for end in offsets[1:-1]:
        valid[max(end - length + 1, 0) : end] = False
    new = valid.copy()
    new[1:] &= (anchors[1:] != anchors[:-1]) | ~valid[:-1]
    first = np.flatnonzero(new)
    done = valid.copy()
    done[:-1] &= new[1:] | ~valid[1:]
    return first, np.flatnonzero(done), anchors[first], _hashes(data, anchors[first])


def _gather(data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The bytes of slices, one behind the other."""
    ends = np.cumsum(sizes)
    return data[np.repeat((starts - ends + sizes).astype(np.int32), sizes) + np.arange(ends[-1] if len(ends) else 0, dtype=np.int32)]


def _ids(column: pa.Array) -> np.ndarray:
    return np.array([LAST if i is None else i for i in column.to_pylist()], np.int64)


def _route_texts(buckets: int):
    """Compressed texts, and what else a row has, to their documents' buckets."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for chunk in chunks(batches):
            texts = chunk.column(1).cast(pa.binary()).to_pylist()
            shards = _shard(_ids(chunk.column(0)), buckets).tolist()
            rows = zip(*(chunk.column(k).to_pylist() if k != 1 else texts for k in range(chunk.num_columns)), strict=True)
            yield _routed([(s, 0, packer.compress(pickle.dumps(row, protocol=5))) for s, row in zip(shards, rows, strict=True)])

    return task


def _route_pieces(length: int, buckets: int, shards: int):
    """Pieces to the buckets of their anchors, and runs settled at once to those of their documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        held, size = {}, 0
        for chunk in chunks(batches):
            ids, texts = _ids(chunk.column(0)), chunk.column(1).cast(pa.binary()).to_pylist()
            tags = np.array([_tag(t) for t in texts], np.uint32)
            for block in _blocks(texts, length):
                runs, pieces = _block_rows(block, ids, tags, length, buckets, shards, packer)
                for bucket, part in pieces:
                    held.setdefault(bucket, []).append(part)
                yield _routed(runs)
                size += sum(len(part) for *_, part in block)
                if size >= PACKED:
                    yield from _packages(held, packer)
                    size = 0
        yield from _packages(held, packer)

    return task


def _packages(held: dict[int, list[tuple]], packer) -> Iterator[pa.RecordBatch]:
    """Rows of the pieces held for each bucket, a few at a time; they are held no more then."""
    rows, size = [], 0
    while held:
        bucket, parts = held.popitem()
        *whole, which, at = _joined(parts)
        rows.append((bucket, 1, _pack(packer, *whole, np.diff(which, prepend=0).astype(np.int32), np.diff(at, prepend=0))))
        size += len(rows[-1][2])
        if size > BLOCK:
            yield _routed(rows)
            rows, size = [], 0
    if rows:
        yield _routed(rows)


def _opened(data: bytes) -> tuple:
    """The pieces of a package."""
    *whole, which, at = _unpack(data)
    return (*whole, np.cumsum(which), np.cumsum(at))


# Pieces are a tuple: their bytes, sizes, anchors and how many places each has; the documents' ids and tags; the
# document's number and the first byte of every place.


def _joined(parts: list[tuple]) -> tuple:
    """Pieces of several blocks or packages as one."""
    before = np.cumsum([0, *(len(p[4]) for p in parts[:-1])])
    which = np.concatenate([p[6] + n for p, n in zip(parts, before, strict=True)])
    return (*(np.concatenate([p[k] for p in parts]) for k in range(6)), which, np.concatenate([p[7] for p in parts]))


def _chosen(pieces: tuple, mine: np.ndarray) -> tuple:
    """Some of the pieces."""
    data, size, left, per, ids, tags, which, at = pieces
    start, places = np.cumsum(size, dtype=np.int64) - size, np.repeat(mine, per)
    docs, which = np.unique(which[places], return_inverse=True)
    return _gather(data, start[mine], size[mine]), size[mine], left[mine], per[mine], ids[docs], tags[docs], which.astype(np.int32), at[places]


def _side_by_side(data, first, sizes, left, length, *by) -> tuple[np.ndarray, np.ndarray]:
    """An order with equal pieces together, those by some columns, and which equal the one before; ``data`` ends with spare bytes."""
    words = [words_at(data, first + k, first + sizes) for k in range(0, 2 * length - GRAM, WORD)]
    content = mix(left.astype(np.uint64) * np.uint64(256) + sizes.astype(np.uint64))
    for word in words:
        content = mix(content + word)
    order = np.lexsort((*by, content))
    same = np.zeros(len(order), bool)
    a, b = order[1:], order[:-1]
    same[1:] = (content[a] == content[b]) & (sizes[a] == sizes[b]) & (left[a] == left[b])
    for word in words:
        same[1:] &= word[a] == word[b]
    return order, same


def _routed(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays(
        [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int32(), pa.binary()), strict=True)],
        names=["bucket", "kind", "data"])


def _block_rows(block, ids, tags, length, buckets, shards, packer) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, tuple]]]:
    """Rows of the runs a block settles, and its other pieces by bucket."""
    data = np.frombuffer(b"".join(part for *_, part in block), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(part) for *_, part in block])])
    rows, begins = (np.array([b[k] for b in block], np.int64) for k in (0, 1))
    first, last, anchor, hashed = _pieces(data, offsets, length)
    sizes = last - first + length
    part = np.searchsorted(offsets, first, "right") - 1
    owner, at = rows[part], first - offsets[part] + begins[part]

    # equal pieces side by side: by a hash of their bytes, then compared word by word
    order, same = _side_by_side(np.append(data, np.zeros(2 * length, np.uint8)), first, sizes, anchor - first, length, at, owner, ids[owner])
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    repeated = ids[owner[order]] > ids[owner[order[head]]]

    gone = order[repeated]
    runs = _runs_rows(ids[owner[gone]], tags[owner[gone]], at[gone], at[gone] + sizes[gone], shards, packer)
    out = []
    sent, leads = order[~repeated], ~same[~repeated]
    unique = sent[leads]
    per = np.diff(np.append(np.flatnonzero(leads), len(sent)))
    bucket = (hashed[unique] % np.uint64(buckets)).astype(np.int64)
    group = np.lexsort((first[unique], bucket))  # in the order of the text, which compresses best
    edges = np.flatnonzero(np.append(True, np.diff(bucket[group]) != 0)) if len(group) else []
    start = np.cumsum(per) - per
    for lo, hi in zip(edges, [*edges[1:], len(group)], strict=True):
        mine = group[lo:hi]
        own = sent[np.repeat(start[mine] - np.cumsum(per[mine]) + per[mine], per[mine]) + np.arange(per[mine].sum())]
        docs, which = np.unique(owner[own], return_inverse=True)
        u = unique[mine]
        out.append((int(bucket[mine[0]]), (
            _gather(data, first[u], sizes[u]), sizes[u].astype(np.uint8 if length < 120 else np.int32),
            (anchor[u] - first[u]).astype(np.uint8 if length < 120 else np.int32), per[mine].astype(np.int32),
            ids[docs], tags[docs], which.astype(np.int32), at[own])))
    return runs, out


def _runs_rows(ids, tags, begins, ends, shards, packer) -> list[tuple[int, int, bytes]]:
    """Runs of documents' bytes, merged, for the buckets of their documents."""
    if not len(ids):
        return []
    order = np.lexsort((begins, tags, ids))
    ids, tags, begins, ends = ids[order], tags[order], begins[order], ends[order]
    other = np.append(True, (ids[1:] != ids[:-1]) | (tags[1:] != tags[:-1]))
    # the farthest end so far within a document, all in one running maximum
    base = np.cumsum(other) * (int(ends.max()) + 1)
    far = np.maximum.accumulate(ends + base) - base
    new = other.copy()
    new[1:] |= begins[1:] > far[:-1]
    heads = np.flatnonzero(new)
    tails = np.append(heads[1:], len(new)) - 1
    ids, tags, begins, ends = ids[heads], tags[heads], begins[heads], far[tails]
    shard = _shard(ids, shards)
    group = np.argsort(shard, kind="stable")
    edges = np.flatnonzero(np.append(True, np.diff(shard[group]) != 0))
    return [
        (int(shard[group[lo]]), 2, _pack(packer, *(x[group[lo:hi]] for x in (ids, tags, begins, ends))))
        for lo, hi in zip(edges, [*edges[1:], len(group)], strict=True)
    ]


def _settle(length: int, shards: int):
    """A bucket's pieces to the runs that are to go; runs settled before pass through."""

    def task(table: pa.Table) -> pa.Table:
        packer = zstandard.ZstdCompressor(level=3)
        kinds, blobs = table.column("kind").to_numpy(), table.column("data")
        out = [(int(table.column("bucket")[0].as_py()), 2, blobs[int(k)].as_py()) for k in np.flatnonzero(kinds == 2)]
        packed = np.flatnonzero(kinds == 1).tolist()
        passes = -(-sum(zstandard.frame_content_size(blobs[k].as_buffer()) for k in packed) // SORTED)
        for number in range(passes):
            held, size, most = [], 0, 2 * SORTED
            for k in packed:
                held.append(_of_pass(_opened(blobs[k].as_buffer()), number, passes))
                size += len(held[-1][0])
                if size > most:  # an anchor that is very frequent: mostly equal pieces
                    pieces, runs = _settled_at_once(_joined(held), length)
                    out += _runs_rows(*runs, shards, packer)
                    held, size = [pieces], len(pieces[0])
                    most = max(most, 2 * size)
            out += _runs_rows(*_repeated(held, length), shards, packer)
            release()
        return pa.Table.from_batches([_routed(out)])

    return task


def _of_pass(pieces: tuple, number: int, passes: int) -> tuple:
    """The pieces whose anchors are sorted in one of several passes."""
    data, size, left = pieces[:3]
    if passes == 1:
        return (np.frombuffer(data, np.uint8), *pieces[1:])
    data = np.frombuffer(data, np.uint8)
    anchors = _hashes(data, np.cumsum(size, dtype=np.int64) - size + left)
    return _chosen((data, *pieces[1:]), mix(anchors + np.uint64(1)) % np.uint64(passes) == number)


def _settled_at_once(pieces: tuple, length: int) -> tuple[tuple, tuple]:
    """Of equal pieces those of the smallest identifier, and the runs of the others, which are repeated as a whole."""
    data, size, left, per, ids, tags, which, at = pieces
    doc = ids[which[np.cumsum(per) - per]]
    first, sizes = np.cumsum(size, dtype=np.int64) - size, size.astype(np.int64)
    order, same = _side_by_side(np.append(data, np.zeros(2 * length, np.uint8)), first, sizes, left.astype(np.int64), length, doc)
    head = np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))
    goes = np.zeros(len(order), bool)
    goes[order] = doc[order] > doc[order[head]]
    gone = np.repeat(goes, per)
    owner, begin = which[gone], at[gone]
    return _chosen(pieces, ~goes), (ids[owner], tags[owner], begin, begin + np.repeat(sizes, per)[gone])


def _repeated(parts: list[tuple], length: int) -> tuple[np.ndarray, ...]:
    """Owner, tag, begin and end of the runs that pieces of documents with smaller identifiers repeat."""
    data, size, left, per, ids, tags, which, at = _joined(parts)
    parts.clear()  # the largest arrays are held once only
    data = np.append(data, np.zeros(2 * length, np.uint8))
    size, left, per = (c.astype(np.int64) for c in (size, left, per))
    ids, tags = ids[which], tags[which]
    start, place = np.cumsum(size) - size, np.cumsum(per) - per
    doc = ids[place]  # all places of a piece are in documents of one identifier

    order, anchors = deep_shallow(data, start + left, GRAM, GRAM)
    count = np.bincount(anchors, minlength=len(anchors))[anchors]
    order, anchors = order[count > 1], anchors[count > 1]
    if not len(order):
        return tuple(np.zeros(0, t) for t in (np.int64, np.uint32, np.int64, np.int64))

    # equal pieces of one anchor side by side
    words = np.stack([words_at(data, start[order] + k, start[order] + size[order])
                      for k in range(0, 2 * length - GRAM, WORD)])
    by = np.lexsort((*words, size[order], left[order], anchors))
    order, anchors, words = order[by], anchors[by], words[:, by]
    new = np.ones(len(order), bool)
    new[1:] = ((anchors[1:] != anchors[:-1]) | (size[order][1:] != size[order][:-1])
               | (left[order][1:] != left[order][:-1]) | (words[:, 1:] != words[:, :-1]).any(axis=0))
    heads = np.flatnonzero(new)
    least = np.minimum.reduceat(doc[order], heads)  # of each distinct piece
    kind = np.cumsum(new) - 1
    kinds_of_anchor = np.bincount(anchors[heads], minlength=int(anchors.max()) + 1)
    mixed = kinds_of_anchor[anchors[heads]] > 1

    runs = []
    whole = (doc[order] > least[kind]) & ~mixed[kind]
    runs.append((order[whole], np.zeros(whole.sum(), np.int64), size[order[whole]]))
    if mixed.any():
        shown = np.flatnonzero(mixed)  # distinct pieces whose strings have to be sorted
        leader = order[heads[shown]]
        strings = size[leader] - length + 1
        owner = np.repeat(np.arange(len(shown)), strings)
        within = np.arange(strings.sum()) - np.repeat(np.cumsum(strings) - strings, strings)
        found = least[shown][owner]
        low, high = _may_repeat(data, start[leader], size[leader], left[leader], anchors[heads[shown]], length)
        some = np.flatnonzero((within >= low[owner]) & (within < high[owner]))
        if len(some):
            by_suffix, classes = deep_shallow(data, start[leader][owner[some]] + within[some], length)
            begin = np.flatnonzero(np.append(True, classes[1:] != classes[:-1]))
            smallest = np.minimum.reduceat(found[some[by_suffix]], begin)
            found[some[by_suffix]] = np.repeat(smallest, np.diff(np.append(begin, len(classes))))
        back = np.full(len(heads), -1)
        back[shown] = np.arange(len(shown))
        members = np.flatnonzero(mixed[kind])
        piece, own = order[members], back[kind[members]]
        base = np.cumsum(strings) - strings
        each = np.repeat(np.arange(len(members)), strings[own])
        k = np.arange(len(each)) - np.repeat(np.cumsum(strings[own]) - strings[own], strings[own])
        goes = found[base[own][each] + k] < doc[piece][each]
        runs.append((piece[each[goes]], k[goes], k[goes] + length))
    piece, low, high = (np.concatenate([r[k] for r in runs]) for k in range(3))
    copies = per[piece]
    spot = np.repeat(place[piece] - np.cumsum(copies) + copies, copies) + np.arange(copies.sum())
    low, high = np.repeat(low, copies), np.repeat(high, copies)
    return ids[spot], tags[spot], at[spot] + low, at[spot] + high


def _may_repeat(data, start, size, left, anchor, length) -> tuple[np.ndarray, np.ndarray]:
    """The range of each piece's strings that another piece of its anchor may have too.

    A string reaches ``half`` bytes beyond the anchor on one side at least.  So pieces that agree
    with no other one in ``half`` bytes behind the anchor share no string that reaches as far to
    that side, and the same in front of it.
    """
    half = (length - GRAM) // 2

    def shared(begin: np.ndarray, there: np.ndarray) -> np.ndarray:
        key = mix(anchor.astype(np.uint64) + np.uint64(1))
        for k in range(0, half, WORD):
            key = mix(key + words_at(data, np.maximum(begin + k, 0), begin + half))
        key = np.where(there, key, mix(np.arange(len(key), dtype=np.uint64) ^ key[::-1]))
        _, place, count = np.unique(key, return_inverse=True, return_counts=True)
        return (count[place] > 1) & there

    at = start + left
    behind = shared(at + GRAM, size - left - GRAM >= half)
    front = shared(at - half, left >= half)
    # the string that begins at ``left - half`` has as much on either side, at an even length
    middle = left - half
    low = np.where(front, 0, np.maximum(middle, 0))
    high = np.where(behind, size - length + 1, np.minimum(middle + 1 + (length - GRAM) % 2, size - length + 1))
    return low, np.where(front | behind, high, 0)


def _cut_out(make, schema: pa.Schema):
    """A bucket's texts and their bytes' marks (1: stays), handed to ``make(text, marks, row)`` for a row of the result."""

    def task(table: pa.Table) -> pa.Table:
        kinds, blobs = table.column("kind").to_numpy(), table.column("data")
        found = [_unpack(blobs[int(k)].as_py()) for k in np.flatnonzero(kinds == 2)]
        columns = [np.concatenate([f[k] for f in found]) for k in range(4)] if found else []
        order = np.lexsort((columns[1], columns[0])) if found else []
        ids, tags, begins, ends = (c[order] for c in columns) if found else [np.zeros(0, np.int64)] * 4
        rows = []
        for k in np.flatnonzero(kinds == 0):
            row = _unpack(blobs[int(k)].as_py())
            doc_id, text = row[0], row[1] or b""
            key = LAST if doc_id is None else doc_id
            lo, hi = np.searchsorted(ids, key, "left"), np.searchsorted(ids, key, "right")
            keep = np.ones(len(text), np.uint8)
            for j in np.flatnonzero(tags[lo:hi] == _tag(text)) + lo if hi > lo else ():
                keep[begins[j] : ends[j]] = 0
            rows += make(text, keep, row)
        release()
        return pa.Table.from_pylist(rows, schema)

    return task


def _report(text: bytes, keep: np.ndarray, row: tuple) -> list[dict]:
    kept = np.frombuffer(text, np.uint8)[keep == 1].tobytes()
    gone = np.diff(keep.astype(np.int8), prepend=1) == -1
    return [{"doc_id": row[0], "n_bytes": len(text), "n_removed": len(text) - len(kept), "n_spans": int(gone.sum()),
             "kept_sha256": hashlib.sha256(kept).hexdigest()}]


def _shortened(names: list[str]):
    def make(text: bytes, keep: np.ndarray, row: tuple) -> list[dict]:
        kept = np.frombuffer(text, np.uint8)[keep == 1].tobytes().decode("utf-8", "ignore")
        if not kept and text:
            return []
        return [dict(zip(names, row, strict=True)) | {"text": row[1] if row[1] is None else kept}]

    return make


def _numbers(docs: DataFrame) -> tuple[int, int]:
    """How many buckets of documents there are, and of pieces: by the bytes of the texts, whatever the input's splits hold."""
    held = id_and_text(docs).agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    shards = max(LEAST_BUCKETS, -(-held // SHARD_BYTES))
    return shards, max(min(shards, MANY_BUCKETS), -(-held // BUCKET_BYTES))


def _cut_texts(docs: DataFrame, rows: DataFrame, make, schema: StructType, length: int, buckets: int | None) -> DataFrame:
    """``rows`` begin with ``doc_id`` and ``text`` and may have more."""
    shards, buckets = (buckets, buckets) if buckets else _numbers(docs)
    texts = rows.mapInArrow(_route_texts(shards), ROUTED)
    pieces = id_and_text(docs).mapInArrow(_route_pieces(length, buckets, shards), ROUTED)
    runs = pieces.groupBy("bucket").applyInArrow(_settle(length, shards), ROUTED)
    return texts.unionByName(runs).groupBy("bucket").applyInArrow(_cut_out(make, to_arrow_schema(schema)), schema)


def repeated_bytes(docs: DataFrame, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """One row per document: its bytes, those removed, their runs and the digest of what is left."""
    return _cut_texts(docs, id_and_text(docs), _report, REPORT, length, buckets)


def keep(docs: DataFrame, length: int = LENGTH, buckets: int | None = None) -> DataFrame:
    """``docs`` with their texts shortened; a text of which nothing is left goes, a null stays.

    Characters that a removal broke go too.
    """
    names = ["doc_id", "text", *(c for c in docs.columns if c not in ("doc_id", "text"))]
    rows = docs.select(*[f"`{c}`" for c in names])
    return _cut_texts(docs, rows, _shortened(names), rows.schema, length, buckets).select(*[f"`{c}`" for c in docs.columns])
