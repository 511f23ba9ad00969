"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are binary: single words, pairs of neighbours and pairs with one word
between them, hashed into ``2**BITS`` coordinates. Training goes a few
times through a bounded sample of labelled rows (at most ``MAX_TRAIN`` rows and
``MAX_FEATURES`` features, those with the smallest hashes of their ids, so the choice is
random and repeatable); executors compute the features, the driver gets compact index
arrays of the sample only. Each coordinate has its own learning rate, and L1 keeps all but
some thousand weights at zero. Rate and L1 are chosen inside the training sample: each setting
of ``GRID`` is fitted on a part of it and rated on another part, and the best is fitted on all.
Labels of the held-out fold are never read. The weights, at most ``2**BITS`` however large the
corpus, are broadcast to score every document.

Defined results: a null or empty text has no features and gets the score of the
bias; repeated rows get equal scores; without any labelled row every score is
0.5; rows of labels with a null id or label are ignored; of several texts under one id the one with the
smallest hash is learnt from; ids of any type; an empty table gives an
empty result; only id and text feed the score.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..session import materialise
from .common import crc_remainder, map_texts

#: Coordinates of the hashed feature space, as a power of two.
BITS = 22
#: Labelled rows, and distinct features in them, that training reads at most; rows that settings are tried on.
MAX_TRAIN, MAX_FEATURES, TRIAL = 16_000, 20_000_000, 4_000
#: FTRL-proximal: smoothing of the rate, L2, passes over the sample.
BETA, L2, EPOCHS = 1.0, 0.5, 3
#: (learning rate, L1) that are tried.
GRID = ((0.3, 4.0), (1.0, 2.0), (2.0, 4.0), (1.0, 8.0), (1.0, 4.0))
#: Kinds of features: words, neighbours, pairs with one word between.
_SALT = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)
_APART = bytes.maketrans(b"!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~", b" " * 31)


def features(text: bytes) -> np.ndarray:
    """The hashed coordinates of a text, repeats included."""
    words = text.lower().translate(_APART).split()
    h = np.array(list(map(zlib.crc32, words)), dtype=np.uint64)
    if not len(h):
        return np.zeros(0, dtype=np.int32)
    x = h * _SALT[0]
    parts = [x, (x[:-1] ^ (x[:-1] >> np.uint64(29))) * _SALT[1] + x[1:], (x[:-2] ^ (x[:-2] >> np.uint64(31))) * _SALT[2] + x[2:]]
    y = np.concatenate(parts)
    y = (y ^ (y >> np.uint64(33))) * _MIX
    return (y >> np.uint64(64 - BITS)).astype(np.int32)


class Model:
    """Sparse weights: ``index`` (sorted), ``weight`` and ``bias``."""

    def __init__(self, index: np.ndarray, weight: np.ndarray, bias: float):
        self.index, self.weight, self.bias = index, weight, bias

    @property
    def trained(self) -> bool:
        return bool(len(self.index)) or self.bias != 0.0

    def dense(self) -> np.ndarray:
        w = np.zeros(1 << BITS, dtype=np.float32)
        w[self.index] = self.weight
        return w

    def score(self, text: bytes, dense: np.ndarray) -> float:
        x = features(text)
        hit = np.unique(x[dense[x] != 0])
        return 1 / (1 + math.exp(-max(-40.0, min(40.0, self.bias + float(dense[hit].sum(dtype=np.float64))))))


def fit(rows: list[tuple[np.ndarray, int]], alpha: float = 1.0, l1: float = 4.0) -> Model:
    """FTRL-proximal over (distinct coordinates, label) pairs, in the given order."""
    z, n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    last = 1 << BITS  # the bias is one more coordinate, without L1
    for _ in range(EPOCHS):
        for x, y in rows:
            zx, nx = z[x], n[x]
            w = np.where(np.abs(zx) <= l1, 0.0, -(zx - np.sign(zx) * l1) / ((BETA + np.sqrt(nx)) / alpha + L2))
            b = -z[last] / ((BETA + math.sqrt(n[last])) / alpha + L2)
            g = 1 / (1 + math.exp(-max(-40.0, min(40.0, b + w.sum())))) - y
            s = (np.sqrt(nx + g * g) - np.sqrt(nx)) / alpha
            z[x] = zx + g - s * w
            n[x] = nx + g * g
            sb = (math.sqrt(n[last] + g * g) - math.sqrt(n[last])) / alpha
            z[last] += g - sb * b
            n[last] += g * g
    bias = float(-z[last] / ((BETA + math.sqrt(n[last])) / alpha + L2))
    index = np.flatnonzero((z[:last] > l1) | (z[:last] < -l1))
    z, n = z[index], n[index]
    return Model(index.astype(np.int32), (-(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / alpha + L2)).astype(np.float32), bias)


def loss(model: Model, rows: list[tuple[np.ndarray, int]]) -> float:
    """Mean logistic loss."""
    dense, total = model.dense(), 0.0
    for x, y in rows:
        s = max(-40.0, min(40.0, model.bias + float(dense[x].sum(dtype=np.float64))))
        total += math.log1p(math.exp(-s if y else s))
    return total / len(rows)


def choose(rows: list[tuple[np.ndarray, int]]) -> tuple[float, float]:
    """The setting of GRID with the least loss on every fourth row of the first TRIAL, fitted on the others; ties to the first."""
    part = rows[:TRIAL]
    fitted, rated = [r for k, r in enumerate(part) if k % 4], part[::4]
    if not fitted or not rated:
        return GRID[-1]
    return min(GRID, key=lambda s: loss(fit(fitted, *s), rated))


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic",
    max_rows: int = MAX_TRAIN, folds: int = 5) -> Model:
    """Fit on labelled rows outside the held-out fold (crc32 of the id mod ``folds`` is 0)."""
    chosen = (
        labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & (crc_remainder(id_col, folds) != 0))
        .select(F.col(id_col).alias("__lid"), F.col(label_col).cast("int").alias("__label"))
        .distinct()
        .orderBy(F.xxhash64("__lid"), "__lid", "__label")
        .limit(max_rows)
    )
    texts = docs.select(F.col(id_col).alias("__lid"), F.col(text_col).alias("__body")).join(F.broadcast(chosen), "__lid")  # max_rows narrow rows
    texts = texts.withColumn("__text_hash", F.xxhash64(F.coalesce("__body", F.lit(""))))

    def make():
        return lambda _, texts: {"x": [np.unique(features(t)).tobytes() for t in texts]}

    rows = map_texts(texts, "__label", "__body", make, [("x", "binary", pa.binary())], keep=True)
    rows = materialise(rows.groupBy("__lid", "__label").agg(F.min_by("x", "__text_hash").alias("x")), "features")
    # at most max_rows rows: by hash, as many as have MAX_FEATURES features together
    n = (F.octet_length("x") / 4).cast("long")
    before = F.sum(n).over(Window.orderBy(F.xxhash64("__lid"), "__lid", "__label"))
    within = materialise(rows.select("__lid", "__label", n.alias("n"), before.alias("before")).where(F.col("before") <= MAX_FEATURES), "within")
    total = within.agg(F.sum("n")).first()[0] or 0
    chosen_rows = rows.join(F.broadcast(within.select("__lid", "__label")), ["__lid", "__label"], "left_semi")
    # one partition at a time into one array: neither the JVM nor Python holds the sample a second time
    every, at, sized = np.empty(total, dtype=np.int32), 0, []
    for lid, y, x in chosen_rows.select("__lid", "__label", "x").toLocalIterator():
        x = np.frombuffer(x, dtype=np.int32)
        every[at : at + len(x)] = x
        sized.append(((zlib.crc32(f"order{lid}".encode()), str(lid), y), at, at + len(x)))
        at += len(x)
    sample = [(every[low:high], key[2]) for key, low, high in sorted(sized)]
    return fit(sample, *choose(sample))


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", keep: bool = False) -> DataFrame:
    """id and ``score`` (0 to 1) of every whole text; with ``keep`` beside all columns."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        dense = m.dense()
        return lambda _, texts: {"score": [m.score(t, dense) for t in texts]}

    return map_texts(df, id_col, text_col, make, [("score", "double", pa.float64())], keep)


def predictions(docs: DataFrame, labels: DataFrame, folds: int = 5) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = train(docs, labels, folds=folds)
    return score(docs, model).select("doc_id", (crc_remainder("doc_id", folds) == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))
