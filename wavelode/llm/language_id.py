"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import grams
from .common import id_remainder, kind_of

LENGTHS = (1, 2, 3)
UNKNOWN = "und"


def gram_ids(texts: list[str], size: int) -> tuple[list[np.ndarray], np.ndarray]:
    """For each n-gram length an array of hashed ids below `size`, one per position, and where each
    text's positions start. Texts are lower-cased, runs of non-letters become one blank and texts end
    in one; n-grams that would cross a text's end have id `size`."""
    codes, starts = grams.points([t.lower() for t in texts])
    codes = np.where(grams.LETTER[codes], codes, 32)
    ends = starts[1:] - 1
    keep = np.concatenate(([True], (codes[1:] != 32) | (codes[:-1] != 32)))
    keep[ends] = True
    codes, starts = codes[keep].astype(np.uint32), np.concatenate(([0], np.cumsum(keep)))[starts]
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(codes))
    bits, out, h = np.uint32(33 - size.bit_length()), [], codes
    for n in LENGTHS:
        if n > 1:
            h = h[:-1] * np.uint32(0x01000193) + codes[n - 1 :] * np.uint32(0x85EBCA6B)
        ids = ((h ^ (h >> np.uint32(15))) * np.uint32(0x9E3779B1) + np.uint32(n * 0x2C1B3C6D & 0xFFFFFFFF)) >> bits
        out.append(np.where(left[: len(ids)] >= n, ids.astype(np.int64), size))
    return out, starts[:-1]


def count_grams(rows: DataFrame, size: int) -> DataFrame:
    """(lang, id, n) over rows (lang, text), summed: each task adds up its own texts first. id -1
    counts documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: dict[str, np.ndarray] = {}
        for batch, texts in grams.by_batch(batches, 1):
            langs = np.array(batch.column(0).to_pylist(), object)
            ids, starts = gram_ids(texts, size)
            for lang in set(langs):
                own = counts.setdefault(lang, np.zeros(size + 2, np.int64))
                mine = langs == lang
                own[-1] += mine.sum()
                for x in ids:
                    at = np.repeat(mine, np.diff(np.concatenate((starts, [len(ids[0])]))))[: len(x)]
                    own[:-1] += np.bincount(x[at], minlength=size + 1)
        for lang, own in counts.items():
            own[size] = 0
            there = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(there)), pa.array(np.where(there > size, -1, there), pa.int32()), pa.array(own[there])],
                ["lang", "id", "n"],
            )

    return rows.select("lang", "text").mapInArrow(run, "lang string, id int, n long").groupBy("lang", "id").agg(F.sum("n").alias("n"))


class Model:
    """Languages, and of each a column of log probabilities with 0 for the id beyond the last."""

    def __init__(self, langs: list[str], priors: np.ndarray, table: np.ndarray):
        self.langs, self.priors, self.table = langs, priors, table


def train(docs: DataFrame, size: int = 1 << 15, alpha: float = 0.1) -> Model:
    """Counts over all rows of docs (lang, text) with both given; the driver gets at most `size`
    counts per language. No such row: a model without languages."""
    rows = count_grams(docs.where("lang is not null and text is not null"), size).toArrow().to_pydict()
    langs = sorted(set(rows["lang"]))
    counts = np.zeros((len(langs), size + 1))
    for lang, i, n in zip(rows["lang"], rows["id"], rows["n"], strict=True):
        counts[langs.index(lang), i] = n
    docs_of, grams_of = counts[:, -1], counts[:, :-1] + alpha
    table = np.zeros((len(langs), size + 1))
    table[:, :-1] = np.log(grams_of / grams_of.sum(1, keepdims=True))
    return Model(langs, np.log((docs_of + 1) / (docs_of.sum() + len(langs))) if langs else docs_of, table)


def scores(texts: list[str], model: Model) -> np.ndarray:
    """Log joint probability of each text with each language."""
    ids, starts = gram_ids(texts, model.table.shape[1] - 1)
    out = np.tile(model.priors, (len(texts), 1))
    for j, column in enumerate(model.table):
        total = np.zeros(len(ids[0]))
        for x in ids:
            total[: len(x)] += column[x]
        out[:, j] += np.add.reduceat(total, starts)
    return out


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) for every row of docs (doc_id, text), from the text alone.

    score is the language's posterior probability. Null, empty and letterless texts, and all texts
    under a model without languages, give 'und' with score 0. Ties go to the language that sorts
    first. Repeated rows give repeated rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch, texts in grams.by_batch(batches, 1):
            known = np.array([bool(model.langs) and any(map(str.isalpha, t)) for t in texts])
            langs, score = np.full(len(texts), UNKNOWN, object), np.zeros(len(texts))
            if known.any():
                logs = scores([t for t, k in zip(texts, known, strict=True) if k], model)
                best = logs.argmax(1)
                langs[known] = np.array(model.langs, object)[best]
                score[known] = 1 / np.exp(logs - logs.max(1, keepdims=True)).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind_of(docs, 'doc_id')}, lang_pred string, score double")


def language_id(docs: DataFrame, held_out: Column | None = None, **options) -> DataFrame:
    """doc_id, held_out, lang_pred, score: learns from docs (doc_id, text, lang) that aren't held out
    and predicts all. By default crc32(doc_id as text) mod 4 = 2 is held out."""
    out = id_remainder("doc_id", 4) == 2 if held_out is None else held_out
    model = train(docs.where(~out), **options)
    return identify(docs, model).withColumn("held_out", out).select("doc_id", "held_out", "lang_pred", "score")
