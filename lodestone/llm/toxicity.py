"""Toxicity as an ordinal severity: a cumulative-link model over sparse hashed words.

P(grade > k) = sigmoid(w.x - b_k) with b_0 <= b_1 <= b_2: all thresholds share the weights w. The result
is the expected severity, the sum of these probabilities. x holds log(1 + count) for each hashed word.

Grades. The label table says toxic or not. The grade of a toxic row is how many occurrences of the
learned marker words it holds (GRADE_CUTS); rows not toxic have grade 0. Marker words are the hashed words
whose smoothed log-odds between the two labels is at least MARKER_LOG_ODDS in the fitting sample.

Scale. The fit takes at most FIT_ROWS labelled rows, chosen by a hash of doc_id, one text for each id, and
collects their sparse features; scoring is row by row, with the weights (BUCKETS numbers) broadcast. No shuffle of
texts but those of the sample. Null and empty texts have the score of the intercepts alone. Repeated labels of one
doc_id count once, as the largest; labels that are null are left out; without any label of both kinds all scores
are 0. Texts of any length are taken whole, in pieces; an empty table has no scores; repeated rows repeat theirs; of
equally likely grades the lowest is taken. Input columns with the names of results are replaced; others cannot clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_rows, named, others, ready
from lodestone.llm.words import tokens

BITS = 18
BUCKETS = 1 << BITS
#: Bound on the labelled rows that a fit looks at.
FIT_ROWS = 8_000
GRADE_CUTS = (3, 6)
MARKER_LOG_ODDS = 3.0
#: Words of fewer rows never enter the model.
LEAST_ROWS = 2
#: The L1 penalty, in rows: a word enters only if its rows together say more than so many. The words that enter are
#: then fitted again with the smaller penalty, which shrinks their weights less.
PENALTY, REFIT_PENALTY = 2.0, 0.3
STEPS, RATE = 150, 0.1
#: Rejected from here on: P(grade >= 1).
REJECT = 0.5


class Severity(NamedTuple):
    weights: np.ndarray  # float64, by bucket
    cuts: np.ndarray  # thresholds in order


def features(col: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For groups of rows: offsets of the rows, buckets, log(1 + count), each bucket once a row."""
    for t in tokens(col):
        n = len(t.offsets) - 1
        row = np.repeat(np.arange(n), np.diff(t.offsets))
        key, count = np.unique((row << BITS) | (t.hashes >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
        yield np.searchsorted(key, np.arange(n + 1) << BITS), key & (BUCKETS - 1), np.log1p(count)


def sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sum of each row's values; 0 for a row without any."""
    total = np.concatenate([np.zeros((1, *values.shape[1:])), np.cumsum(values, axis=0, dtype=np.float64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -35, 35)))


def cuts_of(free: np.ndarray) -> np.ndarray:
    """Thresholds in order, from the first one and the logs of the gaps."""
    return free[0] + np.concatenate([[0.0], np.cumsum(np.exp(free[1:]))])


def ordinal_loss(offsets: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, w: np.ndarray, free: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log likelihood and its gradients by the weights and by ``free``."""
    n, k, each = len(grade), len(free), np.arange(len(grade))
    row = np.repeat(each, np.diff(offsets))
    score = sums(value * w[index], offsets)
    p = np.concatenate([np.ones((n, 1)), sigmoid(score[:, None] - cuts_of(free)), np.zeros((n, 1))], axis=1)
    own = np.maximum(p[each, grade] - p[each, grade + 1], 1e-9)
    d = p * (1 - p)  # slopes of the cumulative probabilities
    to_score = (d[each, grade] - d[each, grade + 1]) / own
    to_cut = np.zeros((n, k))
    low, high = grade > 0, grade < k
    to_cut[np.flatnonzero(low), grade[low] - 1] -= (d[each, grade] / own)[low]
    to_cut[np.flatnonzero(high), grade[high]] += (d[each, grade + 1] / own)[high]
    g_cut = to_cut.sum(axis=0)
    g_free = np.concatenate([[g_cut.sum()], np.cumsum(g_cut[::-1])[::-1][1:] * np.exp(free[1:])])
    return -np.log(own).mean(), -np.bincount(index, value * to_score[row], len(w)) / n, -g_free / n


def fit_ordinal(offsets: np.ndarray, index: np.ndarray, value: np.ndarray, grade: np.ndarray, levels: int, width: int, penalty: float = REFIT_PENALTY) -> Severity:
    """Maximum likelihood with an L1 penalty on the weights, by proximal Adam steps over all rows."""
    k = levels - 1
    rate = np.clip((grade[:, None] > np.arange(k)[None]).mean(axis=0), 1e-3, 1 - 1e-3)
    w = np.zeros(width)
    free = np.concatenate([[-np.log(rate[0] / (1 - rate[0]))], np.full(k - 1, np.log(0.5))])
    m, v = np.zeros(width + k), np.zeros(width + k)
    for step in range(1, STEPS + 1):
        g = np.concatenate(ordinal_loss(offsets, index, value, grade, w, free)[1:])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        move = RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-6)
        w -= move[:width]
        free -= move[width:]
        scale = RATE / (np.sqrt(v[:width] / (1 - 0.999**step)) + 1e-6)
        w = np.sign(w) * np.maximum(np.abs(w) - scale * penalty / len(grade), 0)
    return Severity(w, cuts_of(free))


def fit(docs: DataFrame, labels: DataFrame, train: Column | None = None) -> Severity:
    """``train`` is a condition on labels.doc_id: rows it does not admit are never looked at."""
    ready(docs.sparkSession)
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull())
    sample = (
        (known if train is None else known.where(train))
        .groupBy(F.col("doc_id").alias("__id")).agg((F.max("toxic") > 0).alias("__toxic"))
        .orderBy(F.xxhash64("__id"), "__id").limit(FIT_ROWS)
    )
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), F.col("doc_id") == F.col("__id"))
    rows = rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("__toxic").alias("__toxic"))  # an id may be on many rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            toxic, at = batch.column(1), 0
            for offsets, index, value in features(batch.column(0)):
                n = len(offsets) - 1
                lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(x)) for x in (index.astype(np.int32), value.astype(np.float32))]
                yield pa.RecordBatch.from_arrays([toxic.slice(at, n), *lists], ["toxic", "index", "value"])
                at += n

    got = rows.select("text", "__toxic").mapInArrow(run, "toxic boolean, index array<int>, value array<float>").toArrow()
    toxic, index, value = (got.column(c).combine_chunks() for c in ("toxic", "index", "value"))
    lengths = index.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return train_severity(np.concatenate([[0], np.cumsum(lengths)]), index.flatten().to_numpy().astype(np.int64), value.flatten().to_numpy().astype(np.float64), toxic.to_numpy(zero_copy_only=False).astype(bool))


def train_severity(offsets: np.ndarray, index: np.ndarray, value: np.ndarray, toxic: np.ndarray) -> Severity:
    """The model from the sparse features of the rows of a sample, and whether they are toxic."""
    if not toxic.any() or toxic.all():
        return Severity(np.zeros(BUCKETS), np.full(len(GRADE_CUTS) + 1, 35.0))
    row = np.repeat(np.arange(len(toxic)), np.diff(offsets))
    seen = [np.bincount(index[toxic[row] == x], minlength=BUCKETS) for x in (False, True)]
    used = seen[0] + seen[1] >= LEAST_ROWS
    odds = np.log((seen[1] + 0.5) / (toxic.sum() + 1)) - np.log((seen[0] + 0.5) / ((~toxic).sum() + 1))
    hits = sums(np.where(used & (odds >= MARKER_LOG_ODDS), 1.0, 0.0)[index] * np.expm1(value), offsets)
    grade = np.where(toxic, 1 + sum((hits >= c).astype(int) for c in GRADE_CUTS), 0)
    w = np.zeros(BUCKETS)
    for penalty in (PENALTY, REFIT_PENALTY):
        columns, kept = np.flatnonzero(used), used[index]
        place = np.zeros(BUCKETS, np.int64)
        place[columns] = np.arange(len(columns))
        fitted = fit_ordinal(np.concatenate([[0], np.cumsum(kept)])[offsets], place[index[kept]], value[kept], grade, len(GRADE_CUTS) + 2, len(columns), penalty)
        w[:] = 0
        w[columns] = fitted.weights
        used = w != 0
    return Severity(w, fitted.cuts)


NEW = "severity double, p_toxic double, grade int, toxic boolean"


def score(docs: DataFrame, model: Severity, keep: list[str] | None = None, text: str = "text") -> DataFrame:
    """Columns ``keep``, then severity double (0 to 3), p_toxic double, grade int (the likeliest), toxic boolean."""
    ready(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def make():
        w, cuts = sent.value

        def run(col: pa.Array) -> list[pa.Array]:
            got = [sums(value * w[index], offsets) for offsets, index, value in features(col)]
            x = np.concatenate(got) if got else np.zeros(0)
            above = sigmoid(x[:, None] - cuts)
            each = np.concatenate([np.ones((len(x), 1)), above], axis=1) - np.concatenate([above, np.zeros((len(x), 1))], axis=1)
            return [pa.array(c) for c in (above.sum(axis=1), above[:, 0], each.argmax(axis=1).astype(np.int32), above[:, 0] >= REJECT)]

        return run

    return by_rows(docs, others(docs, NEW) if keep is None else keep, [named(text)], NEW, make)
