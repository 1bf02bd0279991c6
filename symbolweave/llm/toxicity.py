"""Toxicity: a factorization machine over hashed terms.

A text's features are its distinct terms (words without punctuation at their ends, A-Z in lower
case) hashed into ``2 ** bits`` buckets.  Buckets of fewer than ``LEAST_ROWS`` learned rows have no
weight, all others have a linear one and factors.  The machine's score adds to a linear weight for
each term the product of two terms' factors for each pair, so that a pair of terms - an insult
and a group it is aimed at - can weigh more, or less, than both alone, even if neither tells
anything alone.  The pair sum is computed from sums of factors, in time linear in the terms.

In the linear sum a term's value grows with what its shares in the two classes show (a
two-proportion test) but is never 0, and a text's values have the length 1: noise is shrunk,
not left out.  In the pair sum all terms count alike, each 1 / sqrt(number of a text's features).

The model is fitted on at most ``FIT_ROWS`` labelled rows of each class, those with the
smallest hashes of their identifier: a stated bound, so one task fits it, and its size does
not depend on the corpus (``2 ** bits`` times 1 + ``rank`` numbers).  That is what is sent to
the tasks that score, which read whole texts and shuffle nothing.

Labels that are null or whose document is missing are left out; so is a null identifier.
If a class has no labelled row, every score is the share of toxic labels (0.5 without any).
A null or empty text has no features and scores by the intercept alone.  Repeated rows are
scored alike, and an empty table gives an empty result.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from symbolweave.llm.text import blank_separated, chunks, hash_words, id_and_text

FIT_ROWS = 4000
THRESHOLD = 0.7
# A bucket must be in so many learned rows: one row's own terms say nothing of others.
LEAST_ROWS = 2
# Standard errors between a bucket's two shares at which its linear value is a half.
HALF_Z = 4.0


def held_out(doc_id: Column, folds: int = 3) -> Column:
    """Rows that are never learned from."""
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 1


def features(column: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct buckets of each text's terms, and where each text's begin."""
    words, starts = blank_separated(column)
    coded = words.dictionary_encode()
    bare = pc.ascii_trim(coded.dictionary, "!?.,;:\"'()[]{}#*$%&|<>-_")
    buckets = (hash_words(bare) >> np.uint64(64 - bits)).astype(np.int64)
    buckets = np.where(pc.equal(bare, "").to_numpy(zero_copy_only=False), -1, buckets)
    codes = np.asarray(coded.indices, dtype=np.int64)
    rows = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
    keys = (rows << bits) + buckets[codes] if len(codes) else np.zeros(0, np.int64)
    keys = np.unique(keys[buckets[codes] >= 0]) if len(codes) else keys
    rows = keys >> bits
    return keys & ((1 << bits) - 1), np.searchsorted(rows, np.arange(len(starts)))


@dataclass
class Machine:
    """Intercept, linear values and weights, and factors of a factorization machine."""

    intercept: float
    kept: np.ndarray
    value: np.ndarray
    linear: np.ndarray
    factors: np.ndarray
    bits: int

    def known(self, terms: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Buckets as places in the weights, those without a weight left out."""
        place = np.full(1 << self.bits, -1, np.int32)
        place[self.kept] = np.arange(len(self.kept))
        found = place[terms]
        before = np.concatenate([[0], np.cumsum(found >= 0)])
        return found[found >= 0], before[starts]

    def logits(self, terms: np.ndarray, starts: np.ndarray) -> np.ndarray:
        counts = np.diff(starts)
        out = np.full(len(counts), self.intercept)
        full = np.flatnonzero(counts)
        if not len(full):
            return out
        at, scale = starts[full], 1 / np.sqrt(counts[full])
        value = self.value[terms]
        out[full] += np.add.reduceat(self.linear[terms] * value, at) / np.sqrt(np.add.reduceat(value * value, at))
        vectors = self.factors[terms]
        sums = np.add.reduceat(vectors, at, axis=0)
        squares = np.add.reduceat(vectors * vectors, at, axis=0)
        out[full] += 0.5 * (sums * sums - squares).sum(axis=1) * scale * scale
        return out

    def scores(self, texts: pa.Array) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(*self.known(*features(texts, self.bits))), -30, 30)))

    def packed(self) -> bytes:
        out = io.BytesIO()
        np.savez(out, intercept=self.intercept, kept=self.kept, value=self.value, linear=self.linear, factors=self.factors, bits=self.bits)
        return out.getvalue()

    @staticmethod
    def unpacked(data: bytes) -> Machine:
        x = np.load(io.BytesIO(data))
        return Machine(float(x["intercept"]), x["kept"], x["value"], x["linear"], x["factors"], int(x["bits"]))


def evidence(terms: np.ndarray, starts: np.ndarray, labels: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """The buckets of ``LEAST_ROWS`` rows or more, and their linear values: above 0, and near 1 if the shares differ by more than chance."""
    toxic = np.repeat(labels == 1, np.diff(starts))
    n1, n0 = max((labels == 1).sum(), 1), max((labels != 1).sum(), 1)
    one, zero = (np.bincount(terms[toxic == t], minlength=1 << bits) for t in (True, False))
    kept = np.flatnonzero(one + zero >= LEAST_ROWS)
    one, zero = one[kept], zero[kept]
    both = (one + zero) / (n1 + n0)
    error = np.sqrt(np.maximum(both * (1 - both), 1e-9) * (1 / n1 + 1 / n0))
    odd = ((one / n1 - zero / n0) / error) ** 2 + 0.01
    return kept, (odd / (odd + HALF_Z**2)).astype(np.float32)


def learn(terms: np.ndarray, starts: np.ndarray, labels: list[int], bits: int = 18, rank: int = 4,
          epochs: int = 20, rate: float = 0.5, shrink: float = 1e-4, shrink_factors: float = 5e-4, seed: int = 7) -> Machine:
    """A machine fitted by mini-batch AdaGrad on the logistic loss, out of what ``features`` returns."""
    random = np.random.default_rng(seed)
    labels = np.asarray(labels, float)
    share = labels.mean() if len(labels) else 0.5
    kept, value = evidence(terms, starts, labels, bits)
    model = Machine(float(np.log(max(share, 1e-6) / max(1 - share, 1e-6))), kept, value,
                    np.zeros(len(kept), np.float32), np.zeros((len(kept), rank), np.float32), bits)
    if not len(kept):
        return model
    terms, starts = model.known(terms, starts)
    model.intercept, size = 0.0, len(kept)
    model.factors += random.normal(0, 0.01, (size, rank)).astype(np.float32)
    seen = [1e-6, np.full(size, 1e-6, np.float32), np.full((size, rank), 1e-6, np.float32)]
    weight = np.where(labels == 1, 0.5 / share, 0.5 / (1 - share))
    step = 64
    for _ in range(epochs):
        order = random.permutation(len(labels))
        for k in range(0, len(order), step):
            rows = order[k : k + step]
            counts = starts[rows + 1] - starts[rows]
            begin = np.concatenate([[0], np.cumsum(counts)])
            local = np.repeat(np.arange(len(rows)), counts)
            t = terms[np.repeat(starts[rows] - begin[:-1], counts) + np.arange(begin[-1])]
            error = 1 / (1 + np.exp(-np.clip(model.logits(t, begin), -30, 30))) - labels[rows]
            error *= weight[rows] / len(rows)
            gradient = float(error.sum())
            seen[0] += gradient * gradient
            model.intercept -= rate * gradient / np.sqrt(seen[0])
            if not len(t):
                continue
            vectors = model.factors[t]
            sums, full = np.zeros((len(rows), rank), np.float32), np.flatnonzero(counts)
            sums[full] = np.add.reduceat(vectors, begin[full], axis=0)
            value = model.value[t]
            by_term = (error / np.sqrt(np.maximum(np.bincount(local, value * value, len(rows)), 1e-9)))[local] * value
            by_pair = (error / np.maximum(counts, 1))[local][:, None] * (sums[local] - vectors)
            used, inverse = np.unique(t, return_inverse=True)
            linear = np.bincount(inverse, by_term) + shrink * model.linear[used]
            seen[1][used] += linear * linear
            model.linear[used] -= rate * linear / np.sqrt(seen[1][used])
            factors = np.stack([np.bincount(inverse, by_pair[:, j]) for j in range(rank)], axis=1)
            factors += shrink_factors * model.factors[used]
            seen[2][used] += factors * factors
            model.factors[used] -= rate * factors / np.sqrt(seen[2][used])
    return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, bits: int = 18, rank: int = 4) -> bytes:
    """A packed machine, learned from ``docs`` (``doc_id``, ``text``) as ``labels`` (``doc_id``, ``toxic``) marks them."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
    marked = marked.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = F.xxhash64("doc_id")
    chosen = None
    for label in (0, 1):  # the rows with the smallest hashes, of each class
        part = marked.filter(F.col("toxic") == label).orderBy(order, "doc_id").limit(rows)
        chosen = part if chosen is None else chosen.unionByName(part)
    sample = id_and_text(docs).join(F.broadcast(chosen), "doc_id").dropDuplicates(["doc_id"])

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for chunk in chunks(batches):
            terms, starts = features(chunk.column(1), bits)
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), chunk.column(2), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(terms, pa.int32()))],
                names=["doc_id", "toxic", "terms"])

    def learned(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        starts = np.concatenate([[0], np.cumsum([len(t) for t in group.terms])])
        terms = np.concatenate(group.terms.tolist()).astype(np.int64)
        return pd.DataFrame({"model": [learn(terms, starts, group.toxic.tolist(), bits, rank).packed()]})

    found = (
        sample.select("doc_id", "text", "toxic").mapInArrow(hashed, "doc_id long, toxic int, terms array<int>")
        .groupBy().applyInPandas(learned, "model binary").collect()
    )
    none = np.zeros(0, np.int64)
    return bytes(found[0].model) if found else learn(none, none, [], bits, rank).packed()


def score(docs: DataFrame, model: bytes, threshold: float = THRESHOLD) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Machine.unpacked(sent.value)
        for chunk in chunks(batches):
            yield pa.RecordBatch.from_arrays(
                [chunk.column(0), pa.array(machine.scores(chunk.column(1)), pa.float64())], names=["doc_id", "score"])

    scored = id_and_text(docs).mapInArrow(task, "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score",
                         (F.col("score") >= threshold).cast("int").alias("predicted"))
