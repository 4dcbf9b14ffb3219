"""Quality classifier: naive Bayes support vectors over hashed word and word-shape n-grams.

Indicators of n-grams are scaled by the classes' log-count ratios; a linear hinge-loss model is fitted
to them by dual coordinate descent. The fit takes a bounded, documented sample of labelled rows; every
whole text is scored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import id_remainder, kind_of, labelled_sample, stored


def features(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, n-gram id below 2**bits), by text."""
    text, ids = grams.quality_grams(texts)
    return grams.distinct(text, ids >> np.uint64(64 - bits))


def sampled_features(docs: DataFrame, sample: DataFrame, most: int, of: Callable[[list[str]], tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Labels, row starts and feature ids of at most `most` labelled documents, on the driver.
    of: distinct (text number, id) of some texts.

    sample has at most `most` rows of two numbers, so it goes by broadcast; ids that repeat in docs
    are cut to `most` rows again, by hash of id and features, before anything is collected.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grams.by_batch(batches, 1):
            text, ids = of(texts)
            cuts = np.searchsorted(text, np.arange(len(texts) + 1))
            lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), pa.array(ids.astype(np.int32)))
            yield pa.RecordBatch.from_arrays([batch.column(0), lists], ["label", "ids"])

    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id").select("label", "text")
    rows = rows.mapInArrow(run, "label int, ids array<int>")
    got = stored(rows, "labelled-features").orderBy(F.xxhash64("ids", "label"), "label").limit(most).toArrow()
    lists = got.column("ids").combine_chunks()
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], pa.list_(pa.int32()))
    starts = lists.offsets.to_numpy() if len(lists) else np.zeros(1, np.int64)
    return got.column("label").to_numpy(), starts, lists.values.to_numpy() if len(lists) else np.empty(0, np.int32)


def dual_descent(starts: np.ndarray, ids: np.ndarray, values: np.ndarray, y: np.ndarray, cost: np.ndarray, size: int, passes: int) -> np.ndarray:
    """Weights minimising |w|^2 / 2 + sum of cost * hinge, y in -1, +1: one dual variable at a time,
    kept between 0 and its cost, in an order drawn from a fixed seed."""
    w, alpha, rng = np.zeros(size), np.zeros(len(y)), np.random.default_rng(11)
    norms = np.add.reduceat(values * values, starts[:-1]) if len(values) else np.zeros(len(y))
    rows = [(ids[a:b], values[a:b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True)]
    for _ in range(passes):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            if not norms[i]:
                continue
            gradient = y[i] * (w[at] @ x) - 1
            new = min(max(alpha[i] - gradient / norms[i], 0.0), cost[i])
            step = new - alpha[i]
            if step:
                w[at] += step * y[i] * x
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w


def calibrated(margins: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """a, b of 1 / (1 + exp(-(a * margin + b))), by Newton steps with smoothed targets and a light ridge."""
    pos, neg = (y > 0).sum(), (y <= 0).sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    x, theta = np.stack([margins, np.ones_like(margins)], 1), np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ theta, -30, 30)))
        slope = x.T @ (p - target) + 1e-3 * (theta - [1.0, 0.0])
        theta -= np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2), slope)
    return float(max(theta[0], 1e-6)), float(theta[1])


class Model:
    """A weight per n-gram id (0 for ids never seen), a bias and the calibration."""

    def __init__(self, weights: np.ndarray, bias: float, scale: float, shift: float):
        self.weights, self.bias, self.scale, self.shift = weights.astype(np.float32), bias, scale, shift

    def score(self, texts: list[str]) -> np.ndarray:
        text, ids = features(texts, len(self.weights).bit_length() - 1)
        total = np.bincount(text, self.weights[ids], len(texts))
        count = np.bincount(text, minlength=len(texts))
        margin = total / np.sqrt(np.maximum(count, 1)) + self.bias
        return 1 / (1 + np.exp(-np.clip(self.scale * margin + self.shift, -30, 30)))


def fit(y: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int, alpha: float = 1.0, cost: float = 1.0, passes: int = 12) -> Model:
    """From labels 0/1 and each row's distinct feature ids. Rows are scaled by 1 / sqrt(features).
    With one class only, or no row, the score is that class's smoothed share."""
    y, size = np.where(y > 0, 1.0, -1.0), 1 << bits
    pos, neg = (y > 0).sum(), (y < 0).sum()
    if not pos or not neg:
        return Model(np.zeros(size), 0.0, 0.0, float(np.log((pos + 1) / (neg + 1))))
    row = np.repeat(np.arange(len(y)), np.diff(starts))
    p = np.bincount(ids[y[row] > 0], minlength=size) + alpha
    q = np.bincount(ids[y[row] < 0], minlength=size) + alpha
    ratio = np.log(p / (pos + 2 * alpha)) - np.log(q / (neg + 2 * alpha))
    scale = 1 / np.sqrt(np.maximum(np.diff(starts), 1))
    values = ratio[ids] * scale[row]
    # A constant term of its own: one more feature for every row.
    ids_b = np.insert(ids.astype(np.int64), starts[1:], size)
    values_b = np.insert(values, starts[1:], 1.0)
    starts_b = starts + np.arange(len(starts))
    costs = np.where(y > 0, cost * len(y) / (2 * pos), cost * len(y) / (2 * neg))
    w = dual_descent(starts_b, ids_b, values_b, y, costs, size + 1, passes)
    weights, bias = w[:size] * ratio, float(w[size])
    margins = np.bincount(row, weights[ids] * scale[row], len(y)) + bias
    return Model(weights, bias, *calibrated(margins, y))


def scored(docs: DataFrame, model) -> DataFrame:
    """(doc_id, score) of every row of docs (doc_id, text), whole texts, null as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grams.by_batch(batches, 1):
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(shared.value.score(texts), pa.float64())], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, score double")


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int, bits: int) -> Model:
    sample = labelled_sample(labels, "quality", usable, most)
    return fit(*sampled_features(docs, sample, most, lambda texts: features(texts, bits)), bits)


def quality(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_labelled: int = 12_000, bits: int = 18) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5), per row of docs.

    docs needs doc_id and text, labels doc_id and quality. The model is fitted on the max_labelled
    labelled rows with the smallest hash of doc_id among those not held out (by default crc32(doc_id as
    text) mod 3 = 1 is); rows without a label or id aren't used. Scores come from texts alone. Null
    and empty texts get the bias's score. Without any label, or with one class, all get one score.
    Repeated rows give repeated rows; other columns are ignored.
    """
    out = id_remainder("doc_id", 3) == 1 if held_out is None else held_out
    model = train(docs, labels, ~out, max_labelled, bits)
    rows = scored(docs, model).withColumn("held_out", out)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
