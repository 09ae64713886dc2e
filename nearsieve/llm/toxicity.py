"""Toxicity of whole texts: a recurrent network over all overlapping windows.

A document's score is a calibrated function of its highest window logit and the
number of its windows. The network learns from labels of documents: the window
of a toxic document that scores highest stands for it, negatives are windows
of other documents, the highest and some at random; choice and fit alternate.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearsieve.llm.env import read_table, slices
from nearsieve.llm.gru import Adam, Network, distinct
from nearsieve.llm.words import Words

WINDOW, STRIDE = 32, 24
#: Labelled documents and words that a model is fitted on, at most.
POSITIVES, NEGATIVES, VOCABULARY = 1200, 2400, 20_000
ROUNDS, EPOCHS, BATCH, LEAST_STEPS = 3, 3, 128, 120
LOGIT = 12.0  # window logits are held within this
FAVOURED = 1.5  # log odds
REJECT = 0.3


def cut_windows(first: np.ndarray, window: int = WINDOW, stride: int = STRIDE) -> tuple[np.ndarray, np.ndarray]:
    """Word indices (-1: none) of all windows of all texts, and each window's text.
    Every word is in a window; the last one of a text ends with it."""
    size = np.diff(first)
    count = np.where(size > 0, 1 + np.maximum(0, -(-(size - window) // stride)), 0)
    row = np.repeat(np.arange(len(size)), count)
    k = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = np.minimum(k * stride, np.maximum(0, size[row] - window))
    inside = start[:, None] + np.arange(window)
    return np.where(inside < size[row, None], first[row, None] + inside, -1).astype(np.int32), row


@dataclass
class Model:
    vocabulary: np.ndarray
    net: Network
    calibration: tuple[float, ...]

    def document_scores(self, texts: pa.Array) -> np.ndarray:
        words = Words(texts)
        where, row = cut_windows(words.first)
        logits = self.net.logits(distinct(words, self.vocabulary), where) if len(where) else np.zeros(0, np.float32)
        return calibrated(self.calibration, pooled(logits, row, len(texts)))


def pooled(logits: np.ndarray, row: np.ndarray, texts: int) -> np.ndarray:
    """Per text: its highest window logit, how many windows are toxic, on a log scale, the log of
    how many there are, and 1. A text without windows is as clean as can be."""
    logits = np.clip(logits.astype(np.float64), -LOGIT, LOGIT)
    top = np.full(texts, -LOGIT)
    np.maximum.at(top, row, logits)
    toxic = np.bincount(row, 1 / (1 + np.exp(-logits)), texts)
    return np.stack([top, np.log(toxic + 0.05), np.log1p(np.bincount(row, minlength=texts)), np.ones(texts)], axis=1)


def calibrated(weights: tuple, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ np.array(weights), -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Logistic regression, shrunk towards the logit itself; Newton steps are halved until they help."""
    prior, stiff = np.array([0.5, 0.0, 0.0, 0.0]), np.array([2.0, 2.0, 2.0, 0.5])

    def cost(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + 0.5 * np.sum(stiff * (w - prior) ** 2))

    w = prior.copy()
    for _ in range(40):
        p = calibrated(tuple(w), x)
        hess = (x * (p * (1 - p))[:, None]).T @ x + np.diag(stiff)
        step = np.linalg.solve(hess, x.T @ (p - y) + stiff * (w - prior))
        while np.abs(step).max() > 1e-7 and cost(w - step) > cost(w):
            step /= 2
        w = w - step
    return (max(float(w[0]), 0.05), max(float(w[1]), 0.0), *map(float, w[2:]))


def fit(texts: list[str], labels: np.ndarray, seed: int = 11) -> Model:
    """A model of these documents. Every fifth calibrates and is seen by no gradient.

    Without documents of both classes the model scores every text by the share of toxic ones.
    """
    labels = np.asarray(labels, np.float32)
    share = float(labels.mean()) if len(labels) else 0.0
    words = Words.of(texts)
    if not 0 < share < 1 or not (labels[words.row] == 0).any():
        prior = min(max(share, 1e-3), 1 - 1e-3)
        return Model(np.zeros(0, np.uint64), Network(0), (0.0, 0.0, 0.0, float(np.log(prior / (1 - prior)))))
    r = np.random.default_rng(seed)
    held = np.arange(len(labels)) % 5 == 4
    if not (0 < labels[held].sum() < held.sum()) or not (0 < labels[~held].sum() < (~held).sum()):
        held[:] = False
    if not (labels[words.row[~held[words.row]]] == 0).any():
        held[:] = False
    # words by the number of documents that have them, ties by hash
    order = np.argsort(words.hash, kind="stable").astype(np.int32)  # rows ascend already
    h, d = words.hash[order], words.row[order].astype(np.int32)
    del order
    once = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
    h, d = h[once], d[once]
    hashes, begin, count = np.unique(h, return_index=True, return_counts=True)
    del once
    vocabulary = np.sort(hashes[np.lexsort((hashes, -count))[:VOCABULARY]])
    # first guess of the window that stands for a document: the word most typical of toxic ones
    toxic = np.add.reduceat(labels[d], begin)
    at = np.searchsorted(hashes, words.hash).astype(np.int32)
    others = np.maximum(toxic[at] - labels[words.row], 0)  # a document says nothing about itself
    own = np.log((others + 0.5) / (labels.sum() + 1)) - np.log((count[at] - toxic[at] + 0.5) / (len(labels) - labels.sum() + 1))
    where, row = cut_windows(words.first)
    own = own.astype(np.float32)
    guess = np.concatenate([np.where(w >= 0, own[w], -np.inf).max(axis=1) for w in np.array_split(where, 1 + len(where) // 4096)])
    # a toxic document without any word that other toxic ones favour is taken for a wrong label
    best = np.full(len(labels), -np.inf)
    np.maximum.at(best, row, guess)
    trusted = (labels == 0) | (best >= FAVOURED)
    if (trusted & (labels > 0) & ~held).sum() < 5:
        trusted[:] = True
    text = distinct(words, vocabulary)
    del others, at, h, d
    net = Network(len(vocabulary))
    adam = Adam(net)
    clean = np.flatnonzero((labels[words.row] == 0) & ~held[words.row])
    y_row, used = labels[row] > 0, (~held & trusted)[row]
    for turn in range(ROUNDS):
        logit = guess if turn == 0 else net.logits(text, where)
        order = np.lexsort((-logit, row))
        rank = np.empty(len(row), np.int64)
        rank[order] = np.arange(len(row)) - np.searchsorted(row, row[order])
        pos = np.flatnonzero(y_row & used & (rank == 0))
        neg = np.flatnonzero(~y_row & used & (rank == 0))
        rest = np.flatnonzero(~y_row & used & (rank > 0))
        neg = np.concatenate([neg, r.choice(rest, min(len(rest), 2 * len(pos) + 500), replace=False)])
        times = max(1, min(8, len(neg) // max(1, 3 * len(pos))))
        chosen = np.concatenate([np.repeat(pos, times), neg])
        target = np.concatenate([np.ones(len(pos) * times, np.float32), np.zeros(len(neg), np.float32)])
        for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(chosen)))):
            shuffled = r.permutation(len(chosen))
            for i in range(0, len(shuffled), BATCH):
                part = shuffled[i : i + BATCH]
                w = where[chosen[part]]
                # half of the other words of a toxic window are exchanged for words of clean texts
                swap = (target[part] > 0)[:, None] & (w >= 0) & (own[w] < FAVOURED) & (r.random(w.shape) < 0.5)
                w = np.where(swap, clean[r.integers(0, len(clean), w.shape)], w)
                small, flat = text.only(w[w >= 0])
                local = np.full(w.shape, -1)
                local[w >= 0] = flat
                adam.step(net.gradients(small, local, target[part], r.random(len(small.known)) < 0.15)[1])
    x = pooled(net.logits(text, where), row, len(labels))
    judged = held if held.any() else np.ones(len(labels), bool)
    return Model(vocabulary, net, _calibrate(x[judged], labels[judged].astype(np.float64)))


def fold(doc_id: Column) -> Column:
    return F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 4


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on labelled documents whose fold is not 2: at most POSITIVES toxic and NEGATIVES
    other ones, the first by a hash of doc_id. Null ids, texts and labels teach nothing.

    One task gathers their texts and fits; only the model, of a fixed largest size, comes to the driver."""
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).filter("toxic IN (0, 1) AND doc_id IS NOT NULL")
    known = known.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).filter(fold(F.col("doc_id")) != 2)
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id")).filter("doc_id IS NOT NULL").distinct()
    pool, order = known.join(ids, "doc_id", "left_semi"), F.xxhash64("doc_id")
    parts = [pool.filter(F.col("toxic") == y).orderBy(order, "doc_id").limit(n) for y, n in ((1, POSITIVES), (0, NEGATIVES))]
    chosen = F.broadcast(parts[0].union(parts[1]))  # POSITIVES + NEGATIVES rows
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).filter("text IS NOT NULL")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, toxic = {}, {}
        for batch in batches:
            for i, text, y in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "text", "toxic")), strict=True):
                found[i], toxic[i] = max(found.get(i, ""), text), y  # a text for each chosen id
        if found:
            names = sorted(found, key=lambda i: ((i * 2654435761) & 0xFFFFFFFF, i))
            model = fit([found[i] for i in names], np.array([toxic[i] for i in names]))
            yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    made = texts.join(chosen, "doc_id").select("doc_id", "text", "toxic").repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(made[0].model) if made else fit([], np.zeros(0))


def scores(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of whole texts. The model has a fixed largest size and is broadcast.

    Null and empty texts have no window and a low score of their own. Repeated
    rows and null ids keep their rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield pa.record_batch([batch.column("doc_id"), pa.array(shared.value.document_scores(batch.column("text")))], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double")


def drop_toxic(docs: DataFrame, model: Model, reject: float = REJECT) -> DataFrame:
    """The rows of ``docs`` whose own text scores below ``reject``, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            yield batch.filter(pa.array(shared.value.document_scores(batch.column("text").cast(pa.string())) < reject))

    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    found = scores(docs, learn(docs, read_table(spark, sf_dir, "labels")))
    return found.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", F.when(F.col("score") >= REJECT, 1).otherwise(0).alias("predicted"))
