"""Quality classifier: supervised subword embeddings, trained here by stochastic gradient descent.

A document is the average of the learned vectors of all its tokens: hashed words, word pairs (a word
right after itself is one token whatever the word), byte n-grams of the raw text and n-grams of its
shape (case, digits, white space and marks). A softmax layer on the average gives the score.

Training takes a sample of labelled documents whose size is a parameter; the tasks turn them into
hashed counts and the driver runs the descent. As both layers are linear, scoring folds them to one
number a bucket: a document's score is the sigmoid of the mean over its tokens, in one pass over the
whole texts with no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import remainder
from .words import mix, slabs, word_bounds, word_hashes

BUCKETS = 1 << 17
#: Labelled documents that training may see, half of them for each label: the documented bound.
TRAIN_DOCS = 4000
DIM, EPOCHS, RATE, SEED = 8, 12, 0.8, 7
BYTE_GRAM, SHAPE_GRAM = 3, 5

# shape of a byte: a letter class, a digit, white space, a line end, or the mark itself
_SHAPE = np.arange(256, dtype=np.uint64)
_SHAPE[97:123] = _SHAPE[128:] = ord("a")
_SHAPE[65:91] = ord("A")
_SHAPE[48:58] = ord("0")
_SHAPE[[9, 11, 12, 13]] = ord(" ")


def _grams(data: np.ndarray, off: np.ndarray, n: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of n consecutive bytes and the row of each; none reaches into the next row."""
    if len(data) < n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    width = len(data) - n + 1
    out = np.full(width, salt, np.uint64)
    for k in range(n):
        out = out * np.uint64(0x100000001B3) + data[k : k + width].astype(np.uint64)
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    keep = row[:width] == row[n - 1 :]
    return out[keep], row[:width][keep]


def tokens(data: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of all tokens of a slab, one kind after the other."""
    start, end, first = word_bounds(data, off)
    words = word_hashes(data, start, end, lower=False)
    row = np.repeat(np.arange(len(first) - 1), np.diff(first))
    yield _bucket(words, 1), row
    inside = row[1:] == row[:-1]
    pairs = np.where(words[1:] == words[:-1], np.uint64(0), words[:-1] * np.uint64(0x9E3779B97F4A7C15) + words[1:])
    yield _bucket(pairs[inside], 2), row[1:][inside]
    hashes, row = _grams(data, off, BYTE_GRAM, 3)
    yield _bucket(hashes, 3), row
    hashes, row = _grams(_SHAPE[data], off, SHAPE_GRAM, 4)
    yield _bucket(hashes, 4), row


def _bucket(hashes: np.ndarray, kind: int) -> np.ndarray:
    return (mix(hashes + np.uint64(kind) * np.uint64(0xC2B2AE3D27D4EB4F)) & np.uint64(BUCKETS - 1)).astype(np.int64)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(label, text) to (label, buckets, shares), the arrays as bytes."""
    for batch in batches:
        labels, ids, shares = [], [], []
        for lo, hi, data, off in slabs(batch.column(1)):
            with np.errstate(over="ignore"):
                found = list(tokens(data, off))
            bucket, row = (np.concatenate(x) for x in zip(*found, strict=True))
            pair, n = np.unique(row * BUCKETS + bucket, return_counts=True)
            cut = np.searchsorted(pair, np.arange(hi - lo + 1) * BUCKETS)
            for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True)):
                labels.append(batch.column(0)[lo + k].as_py())
                ids.append((pair[a:b] % BUCKETS).astype(np.int32).tobytes())
                shares.append((n[a:b] / max(1, n[a:b].sum())).astype(np.float32).tobytes())
        yield pa.RecordBatch.from_arrays(
            [pa.array(labels, pa.int32()), pa.array(ids, pa.binary()), pa.array(shares, pa.binary())], names=["label", "ids", "shares"]
        )


@dataclass
class Model:
    """One number for each bucket, and the bias, of the log-odds of label 1."""

    weight: np.ndarray
    bias: float


def descend(samples: list[tuple[int, np.ndarray, np.ndarray]]) -> Model:
    """Embeddings and output layer by stochastic gradient descent, a document at a time."""
    rng = np.random.default_rng(SEED)
    table = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    out, bias = rng.normal(0, 0.1, (DIM, 2)).astype(np.float32), np.zeros(2, np.float32)
    done, steps = 0, EPOCHS * max(1, len(samples))
    for _ in range(EPOCHS):
        for k in rng.permutation(len(samples)):
            rate = np.float32(RATE * (1 - done / steps))
            done += 1
            label, ids, shares = samples[k]
            mean = shares @ table[ids]
            z = mean @ out + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[label] -= 1
            back = out @ p
            out -= rate * np.outer(mean, p)
            bias -= rate * p
            # a share is a small fraction: the step on a vector is scaled up by the number of distinct tokens
            table[ids] -= (rate * np.float32(len(ids) ** 0.5)) * np.outer(shares, back)
    side = out[:, 1] - out[:, 0]
    return Model((table @ side).astype(np.float64), float(bias[1] - bias[0]))


def train(docs: DataFrame, labels: DataFrame, allowed: Column, max_docs: int = TRAIN_DOCS) -> Model:
    """Fit on labelled documents whose doc_id passes `allowed`.

    At most max_docs / 2 documents of each label, those of the smallest id hash, and one row of each (the smallest
    text of those that share the id), so that max_docs bounds what comes to the driver. An id with two
    different labels, or a null one, teaches nothing. With one label only, or none, the model is
    that label's constant (0.5 without any).
    """
    known = (
        labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & allowed)
        .groupBy("doc_id")
        .agg(F.min("quality").alias("label"), F.max("quality").alias("most"))
        .filter("label = most")
        .select(F.col("doc_id").alias("known_id"), "label")
    )
    have = known.join(docs.select("doc_id"), F.col("known_id") == F.col("doc_id"), "left_semi")
    picked = [have.filter(F.col("label") == k).orderBy(F.xxhash64("known_id"), "known_id").limit(max_docs // 2) for k in (0, 1)]
    chosen = [(int(r["known_id"]), int(r["label"])) for p in picked for r in p.collect()]
    spark = docs.sparkSession
    small = F.broadcast(spark.createDataFrame(chosen, "known_id long, label int"))  # at most max_docs rows
    sampled = docs.join(small, docs["doc_id"] == small["known_id"]).groupBy("known_id", "label").agg(F.min("text").alias("text")).select("label", "text")
    rows = sampled.mapInArrow(_counts, "label int, ids binary, shares binary").collect()
    samples = sorted((r["label"], bytes(r["ids"]), bytes(r["shares"])) for r in rows)  # one order for any number of tasks
    found = [(k, np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for k, i, s in samples if i]
    kinds = {k for k, _, _ in found}
    if len(kinds) < 2:
        return Model(np.zeros(BUCKETS), {(): 0.0, (0,): -20.0, (1,): 20.0}[tuple(kinds)])
    return descend(found)


def scores_of(model: Model, column: pa.Array) -> np.ndarray:
    out = np.empty(len(column))
    for lo, hi, data, off in slabs(column):
        total, n = np.zeros(hi - lo), np.zeros(hi - lo)
        with np.errstate(over="ignore"):
            for bucket, row in tokens(data, off):
                total += np.bincount(row, model.weight[bucket], hi - lo)
                n += np.bincount(row, minlength=hi - lo)
        out[lo:hi] = total / np.maximum(n, 1) + model.bias
    return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def _score(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(scores_of(model, batch.column(2)))], names=["doc_id", "held_out", "score"]
            )

    return run


def score(docs: DataFrame, labels: DataFrame, threshold: float = 0.7, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """doc_id, held_out, score and predicted (1 from `threshold` on) of every row of docs.

    Learns only from ids whose crc32 modulo 4 is not 2; those with 2 are held out. Only doc_id and
    text are read of docs, doc_id and quality of labels. Null or empty text, or one too short for any
    token, has the score of the bias alone. A null id is not held out and teaches nothing. Repeated
    rows are scored alike; of rows that share an id one is learned from. Empty table: empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    model = train(rows, labels.select("doc_id", "quality"), remainder() != 2, max_docs)
    scored = rows.select("doc_id", (remainder() == 2).alias("held_out"), "text").mapInArrow(
        _score(model), "doc_id long, held_out boolean, score double"
    )
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def accept(docs: DataFrame, labels: DataFrame, threshold: float = 0.7) -> DataFrame:
    """The rows of docs whose text reaches the threshold, with all their columns, in one pass.

    Trained as score() is. Null, empty and very short texts have the score of the bias alone, and stay or go with it;
    rows that repeat an id, or have none, are judged each by its text. Empty table: empty result.
    """
    model = train(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels.select("doc_id", "quality"), remainder() != 2)
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores_of(model, batch.column(at)) >= threshold))

    return docs.mapInArrow(run, docs.schema)
