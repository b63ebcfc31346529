"""Toxicity: a linear classifier over character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import textkernel as K
from .chargrams import codepoints, grams, logistic


class Model(NamedTuple):
    """score = sigmoid(bias + sum of table over the distinct n-gram buckets of a text)."""

    table: np.ndarray
    bias: float
    orders: tuple[int, ...]
    bits: int


def _features(points: np.ndarray, a: int, b: int, buckets: list[np.ndarray], orders: tuple[int, ...]) -> np.ndarray:
    """The distinct buckets of one document in each order, as scoring sums them."""
    return np.concatenate([np.unique(h[a : max(a, b - n + 1)]) for h, n in zip(buckets, orders)])


def learn(samples: list[np.ndarray], y: np.ndarray, orders: tuple[int, ...], bits: int, min_documents: int = 5, smoothing: float = 1.0, l2: float = 2e-4, steps: int = 150) -> Model:
    """Trains on arrays of buckets, distinct in each order. With one class or none, scores are its smoothed share."""
    size = 1 << bits
    n1, n0 = float((y == 1).sum()), float((y == 0).sum())
    prior = float(np.log((n1 + 1) / (n0 + 1)))
    table = np.zeros(size, np.float32)
    if not n1 or not n0:
        return Model(table, prior if len(y) else -2.0, orders, bits)
    p, q = np.zeros(size, np.int32), np.zeros(size, np.int32)
    for own, label in zip(samples, y):
        np.add.at(p if label == 1 else q, own, 1)
    # Ratios are taken of the buckets that enough documents hold, never of whole rows of the sample.
    use = np.flatnonzero(p + q >= min_documents)
    hot, cold = p[use].astype(float), q[use].astype(float)
    del p, q
    ratio = np.log((hot + smoothing) / (n1 + 2 * smoothing)) - np.log((cold + smoothing) / (n0 + 2 * smoothing))
    # A ratio within the noise of its counts says nothing about a class.
    sure = np.abs(ratio) > 2.5 * np.sqrt(1 / (hot + smoothing) + 1 / (cold + smoothing))
    use, ratio = use[sure], ratio[sure]
    number = np.full(size, -1, np.int32)
    number[use] = np.arange(len(use), dtype=np.int32)
    kept = [c[c >= 0] for c in (number[own] for own in samples)]
    rows, cols = np.repeat(np.arange(len(kept), dtype=np.int32), [len(c) for c in kept]), np.concatenate(kept)
    weight = np.where(y == 1, np.sqrt(n0 / n1), 1.0)  # misses cost more than their share
    w, bias = logistic(rows, cols, ratio[cols], y.astype(float), weight, len(use), l2, steps, 0.02)
    table[use] = w * ratio
    return Model(table, bias, orders, bits)


def fit(docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", orders: tuple[int, ...] = (4, 5, 6), bits: int = 22, sample_positive: int = 1500, sample_negative: int = 3000) -> Model:
    """Trains on a bounded sample of labelled documents, chosen by a hash of their id.

    At most ``sample_positive`` and ``sample_negative`` documents are used, each with its
    whole text.  Rows with a null id, label or text take no part.  Give only the labels that may be learnt from.
    """
    known = labels.select(F.col(id_col).alias("_id"), F.col(label_col).cast("int").alias("_y")).where("_id is not null and _y in (0, 1)")
    ids = {x._id: x._y for y, n in ((1, sample_positive), (0, sample_negative)) for x in known.where(F.col("_y") == y).orderBy(F.xxhash64("_id"), "_id").limit(n).collect()}

    @K.tidy
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            who = batch.column(0)
            for chunk in K.chunks(batch.column(1)):
                points, at = codepoints(chunk)
                buckets = [grams(points, n, bits) for n in orders]
                out = [_features(points, a, b, buckets, orders).astype(np.uint32).tobytes() for a, b in zip(at[:-1], at[1:])]
                yield pa.RecordBatch.from_arrays([who.slice(chunk.first, chunk.n), pa.array(out, pa.binary())], ["_id", "f"])

    if not ids:
        return learn([], np.zeros(0), orders, bits)
    texts = docs.select(F.col(id_col).alias("_id"), F.col(text_col).alias("_text")).where(F.col("_id").isin(list(ids)) & F.col("_text").isNotNull())
    # One partition at a time comes to the driver.
    found = texts.mapInArrow(rows, f"_id {docs.schema[id_col].dataType.simpleString()}, f binary").toLocalIterator()
    got = sorted(((r._id, np.frombuffer(bytes(r.f), np.uint32)) for r in found), key=lambda x: (x[0], len(x[1])))
    return learn([f for _, f in got], np.array([ids[i] for i, _ in got]), orders, bits)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores every whole text: ``id_col``, score double in 0 to 1, predicted int.

    Null and empty texts get the score of a text without n-grams.  Repeated rows
    are scored each; other columns are not read.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.table, model.bias))  # 2**bits floats at any input size
    orders, bits = model.orders, model.bits

    @K.tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, bias = shared.value
        for batch in batches:
            who = batch.column(0)
            for chunk in K.chunks(batch.column(1)):
                points, at = codepoints(chunk)
                total = np.zeros(chunk.n)
                for n in orders:
                    h = grams(points, n, bits)
                    value = table[h]
                    # Most n-grams carry no weight; only the others have to be told apart.
                    some = np.flatnonzero(value)
                    owner = np.searchsorted(at, some, "right") - 1
                    inside = some + n <= at[owner + 1]
                    some, owner = some[inside], owner[inside]
                    key = np.unique(owner.astype(np.uint64) << np.uint64(32) | h[some])
                    total += np.bincount((key >> np.uint64(32)).astype(np.int64), table[(key & np.uint64(0xFFFFFFFF)).astype(np.int64)], chunk.n)
                p = 1 / (1 + np.exp(-np.clip(total + bias, -500, 500)))
                yield pa.RecordBatch.from_arrays([who.slice(chunk.first, chunk.n), pa.array(p), pa.array((p >= 0.5).astype(np.int32))], [id_col, "score", "predicted"])

    return docs.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, score double, predicted int")
