"""Quality classifier: random-indexing word vectors, pooled per document, and a two-layer network.

1. Vocabulary: tokens (words, runs of symbols, and the pseudo-words UPPER and AGAIN for a word in capitals
   and for a word equal to the one before) are hashed into BUCKETS buckets, so its size is fixed.
2. Random indexing: each bucket has a fixed sparse index vector with one +1 and one -1. A pass over ALL
   documents adds, for each token, the index vectors of its neighbours up to REACH away. These are sums of
   integers, so they don't depend on how rows are dealt out. Each task keeps one table of fixed size and
   emits a row for each bucket it met; a grouped sum with map-side combine adds them up.
3. Pooling: the word vector is its context vector, scaled to unit length, plus its own index vector. A
   document's vector is the mean over its tokens, with the vector's norm and the log of the length.
4. Network: tanh hidden layer, sigmoid output, trained with numpy on at most FIT_ROWS labelled rows
   (chosen by a hash of doc_id, one text for each id); a tenth of them is set aside for the temperature that
   calibrates the output.

Only the text is an input. Labels are learned only from rows that ``train`` admits. Null and empty texts
have the vector 0 and hence a score like any other. Without labels of both kinds each score is 0.5. Texts of any
length are taken whole, in pieces; an empty table has no scores; repeated rows repeat their score. An input column
named score is replaced by the result; other names cannot clash. The driver gets FIT_ROWS rows and BUCKETS word
vectors at most, whatever the tables hold.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_rows, named, others, ready
from lodestone.llm.words import mix, tokens, word_hash

BITS, DIM, REACH = 15, 32, 2
BUCKETS = 1 << BITS
FIT_ROWS = 8_000
HIDDEN, EPOCHS, BATCH, RATE, DECAY = 24, 30, 128, 5e-3, 1e-4
SEED = 20
THRESHOLD = 0.3
_UPPER, _AGAIN = (word_hash(w) >> (64 - BITS) for w in ("uppercasemark", "repeatedmark"))


def _index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """Where each bucket's index vector is +1 and -1: two different dimensions."""
    h = mix(np.arange(1, BUCKETS + 1, dtype=np.uint64))
    plus = (h % np.uint64(DIM)).astype(np.int64)
    return plus, (plus + 1 + (h >> np.uint64(32)).astype(np.int64) % (DIM - 1)) % DIM


def _words(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Row offsets and buckets for groups of rows; pseudo-words stand behind the word they mark."""
    for t in tokens(col, symbols=True, context=True):
        n = len(t.hashes)
        again = np.zeros(n, bool)
        if n:
            again[1:] = t.hashes[1:] == t.hashes[:-1]
            again[t.offsets[:-1][t.offsets[:-1] < n]] = False
        each = 1 + t.shouted.astype(np.int64) + again
        at = np.concatenate([[0], np.cumsum(each)])
        out = np.empty(at[-1], np.int64)
        out[at[:-1]] = (t.hashes >> np.uint64(64 - BITS)).astype(np.int64)
        out[at[:-1][t.shouted] + 1] = _UPPER
        out[at[1:][again] - 1] = _AGAIN
        yield at[t.offsets], out


def word_vectors(docs: DataFrame) -> np.ndarray:
    """BUCKETS x DIM word vectors from all rows of ``docs``."""
    ready(docs.sparkSession)
    schema = ", ".join(["bucket int", *(f"v{k} bigint" for k in range(DIM))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plus, minus = _index_vectors()
        total = np.zeros(BUCKETS * DIM)
        met = np.zeros(BUCKETS, bool)
        for batch in batches:
            for offsets, w in _words(batch.column(0)):
                met[w] = True
                row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
                cells, signs = [], []
                for k in range(1, REACH + 1):
                    if len(w) > k:
                        same = row[k:] == row[:-k]
                        a, b = w[:-k][same], w[k:][same]
                        for x, y in ((a, b), (b, a)):
                            cells += [x * DIM + plus[y], x * DIM + minus[y]]
                            signs += [np.ones(len(x)), -np.ones(len(x))]
                if cells:
                    total += np.bincount(np.concatenate(cells), np.concatenate(signs), BUCKETS * DIM)
        at = np.flatnonzero(met)
        got = total.reshape(BUCKETS, DIM)[at].astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(np.ascontiguousarray(got[:, k])) for k in range(DIM))], ["bucket", *(f"v{k}" for k in range(DIM))])

    sums = docs.select("text").mapInArrow(run, schema).groupBy("bucket").agg(*(F.sum(f"v{k}").alias(f"v{k}") for k in range(DIM))).toPandas()
    context = np.zeros((BUCKETS, DIM))
    context[sums["bucket"].to_numpy()] = sums.drop(columns="bucket").to_numpy(np.float64)
    context /= np.maximum(np.linalg.norm(context, axis=1, keepdims=True), 1e-9)
    plus, minus = _index_vectors()
    context[np.arange(BUCKETS), plus] += 1
    context[np.arange(BUCKETS), minus] -= 1
    return context.astype(np.float32)


def pool(col: pa.Array, vectors: np.ndarray) -> np.ndarray:
    """A row of DIM + 2 numbers for each text."""
    out = [np.zeros((0, DIM + 2))]
    for offsets, w in _words(col):
        n = np.diff(offsets)
        mean = np.zeros((len(n), DIM))
        full = np.flatnonzero(n)
        if len(full):
            mean[full] = np.add.reduceat(vectors[w], offsets[:-1][full], axis=0, dtype=np.float64) / n[full, None]
        out.append(np.concatenate([mean, np.linalg.norm(mean, axis=1, keepdims=True), np.log1p(n)[:, None]], axis=1))
    return np.concatenate(out)


class Network(NamedTuple):
    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logits(x) / self.temperature, -35, 35)))


def train_network(x: np.ndarray, y: np.ndarray) -> Network:
    """Adam on the log loss, then the temperature with the least log loss on rows that weren't trained on."""
    width = x.shape[1]
    if len(y) < 20 or y.min() == y.max():
        return Network(np.zeros(width), np.ones(width), np.zeros((width, 1)), np.zeros(1), np.zeros(1), 0.0, 1.0)
    rng = np.random.default_rng(SEED)
    order = rng.permutation(len(y))
    aside, used = order[: len(y) // 10], order[len(y) // 10 :]
    mean, scale = x[used].mean(axis=0), x[used].std(axis=0) + 1e-6
    z = (x - mean) / scale
    p = [rng.normal(0, width**-0.5, (width, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.zeros(1)]
    m, v, step = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p], 0
    for _ in range(EPOCHS):
        for at in np.array_split(rng.permutation(used), max(1, len(used) // BATCH)):
            h = np.tanh(z[at] @ p[0] + p[1])
            d = (1 / (1 + np.exp(-np.clip(h @ p[2] + p[3], -35, 35))) - y[at]) / len(at)
            dh = d[:, None] * p[2] * (1 - h * h)
            step += 1
            for k, g in enumerate((z[at].T @ dh + DECAY * p[0], dh.sum(axis=0), h.T @ d + DECAY * p[2], d.sum(keepdims=True))):
                m[k], v[k] = 0.9 * m[k] + 0.1 * g, 0.999 * v[k] + 0.001 * g * g
                p[k] = p[k] - RATE * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
    net = Network(mean, scale, p[0], p[1], p[2], float(p[3][0]), 1.0)
    logits, t = net.logits(x[aside]), np.geomspace(0.25, 8, 61)
    losses = [np.logaddexp(0, np.where(y[aside] > 0, -1, 1) * logits / k).mean() for k in t]
    return net._replace(temperature=float(t[int(np.argmin(losses))]))


class Quality(NamedTuple):
    vectors: np.ndarray
    network: Network


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Quality:
    """``train`` is a condition on labels.doc_id: rows it does not admit are never looked at.

    A doc_id labelled more than once counts as good if any of its labels says so; null labels are left out.
    """
    spark = ready(docs.sparkSession)
    vectors = word_vectors(docs)
    sent = spark.sparkContext.broadcast(vectors)  # BUCKETS x DIM numbers
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull())
    known = known if train is None else known.where(train)
    sample = known.groupBy(F.col("doc_id").alias("__id")).agg(F.max("quality").cast("double").alias("__y")).orderBy(F.xxhash64("__id"), "__id").limit(FIT_ROWS)
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__y").alias("__y")).select("text", "__y", "doc_id")  # an id may be on many rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pool(batch.column(0), sent.value)
            yield pa.RecordBatch.from_arrays([batch.column(1), batch.column(2), pa.array(list(x), pa.list_(pa.float64()))], ["y", "id", "x"])

    got = rows.mapInArrow(run, "y double, id bigint, x array<double>").toPandas()
    x = np.stack(list(got["x"])) if len(got) else np.zeros((0, DIM + 2))
    order = np.lexsort([*x.T, got["id"].to_numpy()])  # the same training order however the rows came in
    return Quality(vectors, train_network(x[order], got["y"].to_numpy(np.float64)[order]))


def score(docs: DataFrame, model: Quality, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep``, then score double, the calibrated probability of good quality."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        vectors, network = sent.value
        return lambda col: [pa.array(network.probabilities(pool(col, vectors)))]

    return by_rows(docs, others(docs, "score double") if keep is None else keep, [named(text)], "score double", make)
