"""Toxicity by logistic regression over hashed word n-grams and skip-grams, learnt by FTRL-proximal.

Features of a text: the presence of each word, each pair of neighbours and each pair with one word between, hashed to
2**BITS coordinates. Every coordinate has its own learning rate; the L1 term keeps weights at exactly zero until their
evidence exceeds it, so the model is a short list of weights, which is broadcast (McMahan et al., "Ad click
prediction", 2013). Words are runs of letters, digits and bytes beyond ASCII; A to Z are folded.

The model is fitted on a bounded sample of labelled rows: about MOST_ROWS, half of them toxic where there are so
many, of about MOST_FEATURES features, chosen by the hash of doc_id and learnt from in the order of the hashes of
doc_id and text, so that reruns agree. The intercept is then moved back to the share of toxic rows among all labels.
Only text is an input.

Defined results: a null text is an empty one, whose score is the intercept's; a doc_id with several labels is toxic if
any says so; labels with nulls, and null doc_ids, are never learnt from; without labels of both kinds every score is
the smoothed share of toxic labels.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusloom.llm import textvec
from corpusloom.llm.common import materialise

BITS = 20
MOST_ROWS = 12_000
#: Features in the sample, in all; with more, a share of its rows by hash.
MOST_FEATURES = 40_000_000
EPOCHS = 8
RATE, BETA, L1, L2 = 1.0, 1.0, 16.0, 0.1
FOLDS = 5
_U = np.uint64


def held_out(doc_id: Column) -> Column:
    """Whether crc32 of doc_id as text is divisible by FOLDS; a null doc_id is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % FOLDS == 0, F.lit(True))


def features(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(text, coordinate) of every feature of every text, repeats included."""
    w = textvec.words(column, lower=True, separator=textvec.PUNCTUATION)
    h, text = w.hashes, w.text_of
    texts, coordinates = [text], [h]
    with np.errstate(over="ignore"):
        for gap in (1, 2):
            if len(h) > gap:
                same = text[:-gap] == text[gap:]
                pair = textvec.mix64(h[:-gap] * _U(2 * gap + 1) + (h[gap:] ^ _U(0x9E3779B97F4A7C15 * gap & (1 << 64) - 1)))
                texts.append(text[:-gap][same])
                coordinates.append(pair[same])
    return np.concatenate(texts), (np.concatenate(coordinates) >> _U(64 - BITS)).astype(np.int32)


@textvec.releasing
def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(order, tie, label, text) to (order, tie, label, distinct coordinates)."""
    for batch in batches:
        for piece in textvec.pieces(batch, "text"):
            text, at = features(piece.column(3))
            both = np.unique((text.astype(np.int64) << 32) | at)
            ends = np.searchsorted(both, np.arange(piece.num_rows + 1, dtype=np.int64) << 32)
            lists = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((both & 0xFFFFFFFF).astype(np.int32)))
            yield pa.record_batch([*piece.columns[:3], lists], names=["order", "tie", "label", "at"])


class Ftrl:
    """FTRL-proximal for logistic loss; the last coordinate is the intercept, free of L1."""

    def __init__(self, size: int = 1 << BITS) -> None:
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def weights(self, at: np.ndarray) -> np.ndarray:
        z = self.z[at]
        l1 = np.where(at == len(self.z) - 1, 0.0, L1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(self.n[at])) / RATE + L2))

    def step(self, at: np.ndarray, label: int) -> None:
        w = self.weights(at)
        g = 1 / (1 + math.exp(-min(35.0, max(-35.0, float(w.sum()))))) - label
        n = self.n[at]
        self.z[at] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / RATE * w
        self.n[at] = n + g * g


@textvec.releasing
def _train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bounded sample, in order, to the weights that aren't zero; coordinate 2**BITS is the intercept."""
    rows = []
    for batch in batches:
        for label, at in zip(batch.column(2).to_pylist(), batch.column(3), strict=True):
            rows.append((label, np.append(at.values.to_numpy(), np.int32(1 << BITS))))
    model = Ftrl()
    for _ in range(EPOCHS):
        for label, at in rows:
            model.step(at, label)
    every = np.arange((1 << BITS) + 1)
    w = model.weights(every)
    kept = np.flatnonzero(w)
    yield pa.record_batch([pa.array(kept.astype(np.int32)), pa.array(w[kept])], names=["at", "weight"])


def fit(docs: DataFrame, labels: DataFrame) -> dict[int, float]:
    """Weights by coordinate. docs: (doc_id, text); labels: (doc_id, toxic). Held-out rows are not looked at."""
    known = labels.filter("doc_id is not null and toxic is not null").groupBy("doc_id").agg(F.max("toxic").alias("label"))
    known = materialise(known.filter(~held_out(F.col("doc_id"))).select("doc_id", F.col("label").cast("int").alias("label"), F.xxhash64("doc_id").alias("order")), "labels")
    count = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    toxic, clean = count.get(1, 0), count.get(0, 0)
    prior = math.log((toxic + 1) / (clean + 1))
    if not toxic or not clean:
        return {1 << BITS: prior}
    share = {1: min(1.0, MOST_ROWS / 2 / toxic), 0: min(1.0, MOST_ROWS / 2 / clean)}
    limit = F.when(F.col("label") == 1, share[1]).otherwise(share[0]) * float(1 << 31)
    sample = known.filter((F.col("order").bitwiseAND((1 << 31) - 1)) < limit)
    # About MOST_ROWS rows of three numbers: a broadcast with a bound.
    found = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(sample), "doc_id").select("order", F.xxhash64("text").alias("tie"), "label", "text")
    rows = materialise(found.mapInArrow(_rows, "order long, tie long, label int, at array<int>"), "features")
    total = rows.agg(F.coalesce(F.sum(F.size("at")), F.lit(0))).first()[0]
    if total > MOST_FEATURES:
        rows = rows.filter(F.pmod(F.xxhash64("order", "tie"), F.lit(1 << 20)) < int(MOST_FEATURES / total * (1 << 20)))
    fitted = rows.repartition(1).sortWithinPartitions("order", "tie").mapInArrow(_train, "at int, weight double")
    weights = {r["at"]: r["weight"] for r in fitted.collect()}
    sampled = math.log((toxic * share[1] + 1) / (clean * share[0] + 1))
    weights[1 << BITS] = weights.get(1 << BITS, 0.0) + prior - sampled
    return weights


class Scorer:
    """mapInArrow function: (doc_id, held_out, text) to scores; model: a broadcast of at most 2**BITS + 1 weights."""

    def __init__(self, model) -> None:
        self.model = model

    @textvec.releasing
    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dense = np.zeros((1 << BITS) + 1)
        at, weight = self.model.value
        dense[at] = weight
        used = dense != 0
        for batch in batches:
            for piece in textvec.pieces(batch, "text"):
                text, at = features(piece.column(2))
                hit = used[at]
                both = np.unique((text[hit].astype(np.int64) << 32) | at[hit])
                total = np.bincount(both >> 32, dense[both & 0xFFFFFFFF], piece.num_rows) + dense[-1]
                score = 1 / (1 + np.exp(-np.clip(total, -35, 35)))
                yield pa.record_batch([piece.column(0), piece.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])


def score(docs: DataFrame, weights: dict[int, float]) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row."""
    schema = T.StructType([docs.schema["doc_id"], T.StructField("held_out", T.BooleanType()), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    plain = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    model = (np.array(list(weights), np.int64), np.array(list(weights.values())))
    return plain.mapInArrow(Scorer(docs.sparkSession.sparkContext.broadcast(model)), schema)
