"""Toxicity: a factorization machine over hashed terms.

Besides a weight per term it learns a short vector per term, so that pairs of terms (an insult and a
group that is named with it) count apart from either alone. Terms are lower-cased words and their first
letters, hashed to a table of fixed size; no term is left out. The fit takes a bounded, documented
sample of labelled rows; every whole text is scored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import id_remainder, labelled_sample, packed
from .quality import calibrated, sampled_features, scored

#: Rows of a sample that are learned from together.
BLOCK = 128


def term_ids(texts: list[str], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text number, term hash below 2**bits), by text."""
    text, ids = grams.terms(texts)
    return grams.distinct(text, ids >> np.uint64(64 - bits))


class Model:
    """Factorization machine over hashed terms, with the calibration of its margin."""

    def __init__(self, bias: float, w: np.ndarray, v: np.ndarray, scale: float = 1.0, shift: float = 0.0):
        self.bias, self.w, self.v, self.scale, self.shift = bias, w.astype(np.float32), v.astype(np.float32), scale, shift

    def margins(self, text: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
        """Of n texts, from (text number, term) pairs."""
        out = self.bias + np.bincount(text, self.w[at], n)
        for f in range(self.v.shape[1]):
            x = self.v[at, f]
            out += 0.5 * (np.bincount(text, x, n) ** 2 - np.bincount(text, x * x, n))
        return out

    def score(self, texts: list[str]) -> np.ndarray:
        text, at = term_ids(texts, len(self.w).bit_length() - 1)
        return 1 / (1 + np.exp(-np.clip(self.scale * self.margins(text, at, len(texts)) + self.shift, -30, 30)))


class Block:
    """Some rows of a sample that are learned from together: their terms, and each one's places in them."""

    def __init__(self, rows: np.ndarray, starts: np.ndarray, ids: np.ndarray):
        rows = rows[starts[rows + 1] > starts[rows]]
        lens = starts[rows + 1] - starts[rows]
        self.rows, self.first = rows, np.cumsum(lens) - lens
        at = ids[np.repeat(starts[rows] - self.first, lens) + np.arange(lens.sum())]
        self.terms, place = np.unique(at, return_inverse=True)
        # Half-size numbers: all blocks of a sample are held at once.
        self.place, self.row = place.astype(np.int32), np.repeat(np.arange(len(rows), dtype=np.int32), lens)
        order = np.argsort(self.place, kind="stable")
        self.row_by_term, self.term_first = self.row[order], np.searchsorted(self.place[order], np.arange(len(self.terms)))


def fit(
    y: np.ndarray, starts: np.ndarray, ids: np.ndarray, bits: int, factors: int = 4, linear: int = 3, passes: int = 16, patience: int = 4,
    rate: float = 1.0, sparsity: float = 15.0, vector_rate: float = 0.1, ridge: float = 1.0,
) -> Model:
    """From labels 0/1 and each row's distinct terms. Logistic loss, classes weighed alike.

    Weights follow the leader with an absolute-value penalty, which leaves a term that tells little at 0;
    vectors take adaptive gradient steps, but only after `linear` passes over the weights alone. A fifth
    of the rows isn't learned from: of all passes the one with the least loss on them is kept, so vectors
    stay where pairs tell something, and the fit ends after `patience` passes that better nothing. With one class only, or no row, the score is that class's smoothed share.
    """
    rng, size = np.random.default_rng(5), 1 << bits
    pos, neg = int((y > 0).sum()), int((y <= 0).sum())
    w, start = np.zeros(size, np.float32), rng.normal(0, 0.02, (size, factors)).astype(np.float32)
    if not pos or not neg:
        return Model(0.0, w, np.zeros((size, factors)), 0.0, float(np.log((pos + 1) / (neg + 1))))
    weight = np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))
    order = rng.permutation(len(y))
    aside = order[: len(y) // 5] if min(pos, neg) >= 10 else order[:0]
    learned = order[len(aside) :]
    blocks = [Block(rows, starts, ids) for rows in np.array_split(learned, max(1, len(learned) // BLOCK))]
    checked = Block(aside if len(aside) else learned, starts, ids)
    v = np.zeros((size, factors), np.float32)
    bias, bias_g, z, g_sum, v_g = 0.0, 1.0, np.zeros(size), np.zeros(size), np.ones((size, factors), np.float32)
    best, least, last = Model(0.0, w, v[:, :0]), np.inf, 0
    for turn in range(passes):
        if turn == linear:
            v = start
        if turn >= max(linear, last) + patience:
            break
        for k in rng.permutation(len(blocks)):
            block = blocks[k]
            if not len(block.rows):
                continue
            u, truth = block.terms, y[block.rows] > 0
            wu, vu = w[u], v[u]
            margin = bias + np.add.reduceat(wu[block.place], block.first)
            if turn >= linear:
                x = vu[block.place]
                sums = np.add.reduceat(x, block.first, axis=0)
                margin = margin + 0.5 * (sums * sums - np.add.reduceat(x * x, block.first, axis=0)).sum(1)
            slope = weight[block.rows] * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - truth)
            bias_g += slope.sum() ** 2
            bias -= rate * slope.sum() / np.sqrt(bias_g)
            by_term = slope[block.row_by_term]
            g = np.add.reduceat(by_term, block.term_first)
            if turn >= linear:
                g_v = np.add.reduceat((slope[:, None] * sums)[block.row_by_term], block.term_first, axis=0) + (ridge - g)[:, None] * vu
                v_g[u] += g_v * g_v
                v[u] = vu - vector_rate * g_v / np.sqrt(v_g[u])
            after = g_sum[u] + g * g
            z[u] += g - (np.sqrt(after) - np.sqrt(g_sum[u])) / rate * wu
            g_sum[u] = after
            over = np.sign(z[u]) * np.maximum(np.abs(z[u]) - sparsity, 0)
            w[u] = -over * rate / (1 + np.sqrt(after))
        model = Model(bias, w, v if turn >= linear else v[:, :0])
        margin, truth = model.margins(checked.row, checked.terms[checked.place], len(checked.rows)), y[checked.rows] > 0
        loss = (weight[checked.rows] * np.logaddexp(0, np.where(truth, -margin, margin))).sum()
        if loss < least:
            best, least, last = Model(bias, w.copy(), model.v.copy()), loss, turn + 1
    text = np.repeat(np.arange(len(y)), np.diff(starts))
    best.scale, best.shift = calibrated(best.margins(text, ids, len(y)), y)
    return best


def train(docs: DataFrame, labels: DataFrame, usable: Column, most: int, bits: int) -> Model:
    """From the at most `most` labelled rows that labelled_sample() chooses."""
    sample = labelled_sample(labels, "toxic", usable, most)
    y, starts, ids = sampled_features(docs, sample, most, lambda texts: term_ids(texts, bits))
    return fit(y, starts, ids, bits)


def toxicity(docs: DataFrame, labels: DataFrame, held_out: Column | None = None, max_labelled: int = 12_000, bits: int = 20) -> DataFrame:
    """doc_id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= 0.5), per row of docs.

    docs needs doc_id and text, labels doc_id and toxic. The model is fitted on the max_labelled
    labelled rows with the smallest hash of doc_id among those not held out (by default crc32(doc_id as
    text) mod 5 = 0 is); rows without a label or id aren't used. Scores come from texts alone. Null,
    empty and wordless texts get the bias's score. Without any label, or with one class, all get one
    score. Repeated rows give repeated rows; other columns are ignored.
    """
    out = id_remainder("doc_id", 5) == 0 if held_out is None else held_out
    model = train(docs, labels, ~out, max_labelled, bits)
    rows = scored(docs, model).withColumn("held_out", out)
    return rows.select("doc_id", "held_out", "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5, max_labelled: int = 12_000, bits: int = 20) -> DataFrame:
    """docs, all columns, whose score is below threshold. Labels of the held-out fifth aren't used.

    Null, empty and wordless texts have the bias's score, so all of them stay or go; so do all rows when
    no label of either class is there. Repeated rows share one fate; an empty table stays empty; other
    columns may have any name.
    """
    model = train(docs, labels, id_remainder("doc_id", 5) != 0, max_labelled, bits)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    rows = packed(docs, F.col("text").alias("words"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in grams.by_batch(batches, 1):
            yield batch.filter(pa.array(shared.value.score(texts) < threshold))

    return rows.mapInArrow(run, rows.schema).select("row.*")
