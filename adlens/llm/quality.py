"""Quality classifier: supervised subword embeddings.

Every word, every pair of neighbouring words and every 3- to 5-byte piece of a
word (with its ends marked) is hashed to one of ``BUCKETS`` learned vectors; a
document is the average of its vectors; a softmax layer gives the two class
probabilities.  A pair of equal words hashes to one common bucket, so that
repetition itself is a feature.  Training is plain numpy stochastic gradient
descent, one document a step, with a learning rate for each vector that falls
with the vector's past gradients.

The model is fitted in one task on at most ``max_docs`` labelled rows (lowest
hash of the id first), which bounds that task; every row is scored.  As the
output layer is linear, a trained model reduces to one number per bucket: that
table (``BUCKETS`` floats) is all that scoring tasks receive.

Null or empty texts get the score of the bias alone.  Labels that are null
count as missing; repeated rows are scored (and, when labelled, sampled) each.
Without labelled rows of both classes every score is 0.5 or the only class's
rate, smoothed.  Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .textkit import SPACE, Chunk, chunks, map_batches, segment_hashes

BUCKETS = 1 << 16
DIM = 12
PIECES = (3, 4, 5)
MAX_DOCS = 4000
EPOCHS = 8
RATE = 0.4
SEED = 7
#: Bucket of a word that repeats the word before it.
REPEAT = 0


def features(chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """(bucket, text number) of the words, the pairs and the pieces of a chunk."""
    data = chunk.data
    starts, ends, text = chunk.words()
    words = segment_hashes(data, starts, ends)
    groups = [((words % np.uint64(BUCKETS)).astype(np.int32), text)]
    near = text[1:] == text[:-1]
    pair = ((words[1:] * np.uint64(31) + words[:-1]) % np.uint64(BUCKETS)).astype(np.int32)
    pair[words[1:] == words[:-1]] = REPEAT
    groups.append((pair[near], text[1:][near]))
    # pieces of words: their inner bytes are no white space, their ends may be
    codes = np.where(SPACE[data], np.uint32(32), data).astype(np.uint32)
    solid = ~SPACE[data]
    owner = np.repeat(np.arange(chunk.n, dtype=np.int32), np.diff(chunk.offsets))
    buckets, owners = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)]
    h = codes.copy()
    inner = np.ones(len(data), dtype=bool)
    for n in range(2, max(PIECES) + 1):
        if len(data) < n:
            break
        # h[i] covers bytes i .. i+n-1; inner[i]: bytes i+1 .. i+n-2 are solid
        h = h[:-1] * np.uint32(0x01000193) + codes[n - 1:]
        inner = inner[:-1] if n == 2 else inner[:-1] & solid[n - 2:-1]
        if n in PIECES:
            at = np.flatnonzero(inner & (owner[:len(h)] == owner[n - 1:]))
            g = h[at] * np.uint32(0x85EBCA6B)
            buckets.append(((g ^ (g >> np.uint32(15))) % np.uint32(BUCKETS)).astype(np.int32))
            owners.append(owner[at])
    groups.append((np.concatenate(buckets), np.concatenate(owners)))
    return groups


def shares(chunk: Chunk) -> list[tuple[np.ndarray, np.ndarray]]:
    """Per text: its distinct buckets and the share of each in the average.

    Words, pairs and pieces are averaged on their own, then together, so the
    many pieces of a word don't drown the word and its neighbour.
    """
    parts = []
    for bucket, owner in features(chunk):
        count = np.bincount(owner, minlength=chunk.n)
        order = np.argsort(owner, kind="stable")
        parts.append((bucket[order], np.concatenate([[0], np.cumsum(count)])))
    out = []
    for i in range(chunk.n):
        own = [bucket[at[i]:at[i + 1]] for bucket, at in parts]
        weight = np.concatenate([np.full(len(x), 1 / (len(own) * max(len(x), 1))) for x in own])
        names, which = np.unique(np.concatenate(own), return_inverse=True)
        out.append((names.astype(np.int32), np.bincount(which, weights=weight, minlength=len(names))
                    .astype(np.float32)))
    return out


@dataclass
class Model:
    """One number per bucket (its share of the logit) and the bias."""

    weights: np.ndarray
    bias: float

    def scores(self, chunk: Chunk) -> np.ndarray:
        z = np.full(chunk.n, self.bias)
        groups = features(chunk)
        for bucket, owner in groups:
            total = np.bincount(owner, weights=self.weights[bucket], minlength=chunk.n)
            z += total / (len(groups) * np.maximum(np.bincount(owner, minlength=chunk.n), 1))
        return 1 / (1 + np.exp(-z))


def train(docs: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, dim: int = DIM,
          epochs: int = EPOCHS, rate: float = RATE, seed: int = SEED) -> Model:
    """Fit on documents given as (buckets, shares of the document)."""
    ones = float(labels.sum())
    start = float(np.log((ones + 0.5) / (len(labels) - ones + 0.5)))
    if not docs or ones in (0.0, float(len(labels))):
        return Model(np.zeros(BUCKETS), start)
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer = rng.uniform(-1 / dim, 1 / dim, (dim, 2)).astype(np.float32)
    bias = np.array([0.0, start], dtype=np.float32)
    past = np.full(BUCKETS, 1e-8, dtype=np.float32)
    past_layer = np.full((dim, 2), 1e-8, dtype=np.float32)
    for epoch in range(epochs):
        step = rate * (1 - epoch / epochs)
        for i in rng.permutation(len(docs)):
            bucket, share = docs[i]
            if len(bucket) == 0:
                continue
            hidden = share @ vectors[bucket]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[labels[i]] -= 1
            back = layer @ p
            g = np.outer(hidden, p)
            past_layer += g * g
            layer -= step * g / np.sqrt(past_layer)
            bias -= 0.1 * step * p
            past[bucket] += share * share * float(back @ back)
            vectors[bucket] -= (step * share / np.sqrt(past[bucket]))[:, None] * back
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float64), float(bias[1] - bias[0]))


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "label",
        max_docs: int = MAX_DOCS) -> Model:
    """Fit on the ``max_docs`` rows of ``labelled`` with the lowest id hashes.

    The rows become bucket shares where they are read; one task then trains.
    """
    rows = labelled.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"),
                           F.col(label_col).cast("int").alias("label")).where("label is not null")

    def count(batches):
        for b in batches:
            out = [names.astype("<i4").tobytes() + share.astype("<f4").tobytes()
                   for c in chunks(b.column(1)) for names, share in shares(c)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), b.column(2)],
                                             ["id", "shares", "label"])

    def learn(batches):
        docs, labels, ids = [], [], []
        for b in batches:
            for i, raw, label in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist()):
                half = len(raw) // 2
                docs.append((np.frombuffer(raw[:half], dtype="<i4"), np.frombuffer(raw[half:], dtype="<f4")))
                labels.append(int(label == 1))
                ids.append((i is not None, i or 0, zlib.crc32(raw)))
        order = sorted(range(len(ids)), key=ids.__getitem__)  # the same order on every run
        m = train([docs[i] for i in order], np.array([labels[i] for i in order], dtype=np.int64))
        yield pa.RecordBatch.from_arrays([pa.array([m.weights.astype("<f8").tobytes()], pa.binary()),
                                          pa.array([m.bias])], ["weights", "bias"])

    spark = labelled.sparkSession
    sample = rows.orderBy(F.xxhash64("id"), "id", F.xxhash64("text")).limit(max_docs)
    counted = map_batches(sample, count, "id long, shares binary, label int")
    got = counted.coalesce(1).mapInArrow(learn, "weights binary, bias double").collect()
    if not got:
        return Model(np.zeros(BUCKETS), 0.0)
    return Model(np.frombuffer(bytes(got[0]["weights"]), dtype="<f8"), got[0]["bias"])


def sample_labels(labels: DataFrame, label_col: str, holdout: int, remainder: int,
                  max_docs: int) -> DataFrame:
    """The ``max_docs`` labelled ids of lowest hash outside the held-out fold."""
    fold = F.crc32(F.col("doc_id").cast("string")) % holdout
    return (labels.where((fold != remainder) & F.col(label_col).isNotNull())
            .select("doc_id", F.col(label_col).cast("int").alias("label"))
            .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(max_docs))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text",
          threshold: float = 0.3) -> DataFrame:
    """(doc_id, score, predicted) of every row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for b in batches:
            s = [shared.value.scores(c) for c in chunks(b.column(1))]
            s = np.concatenate(s) if s else np.zeros(0)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "score", "predicted"])

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double, predicted int")


def keep(df: DataFrame, model: Model, text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """The rows of ``df``, all columns, that the model predicts to be good."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    place = df.columns.index(text_col)

    def run(batches):
        for b in batches:
            s = [shared.value.scores(c) for c in chunks(b.column(place).cast(pa.string()))]
            yield b.filter(pa.array(np.concatenate(s) >= threshold)) if s else b

    return map_batches(df, run, df.schema)


def fit_on(docs: DataFrame, labels: DataFrame, max_docs: int = MAX_DOCS) -> Model:
    """Fit on documents with a quality label whose crc32 of the id, modulo 5, is not 0."""
    ids = sample_labels(labels, "quality", 5, 0, max_docs)
    # at most max_docs short rows: small enough to broadcast
    return fit(docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id"), max_docs=max_docs)
