"""The quality model held against plain n-grams, counts and sums."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wavelode.llm import grams, quality


def texts(n, seed=4):
    rng = random.Random(seed)
    some = ["Harbour", "wall", "the", "THE", "Straße", "été", "naïve", "x1", "99", "3.14", "a-b", "…", "汉字", "😀", "don't", "--", "O'Neil"]
    return ["", " ", "one", *(rng.choice([" ", "\n", "\t "]).join(rng.choice(some) for _ in range(rng.randint(1, 12))) for _ in range(n))]


def plain_grams(text):
    """Words, pairs of words, and one to three shapes of words."""

    def kind(c):
        if ord(c) >= 1 << 16:
            return "other"
        return "upper" if c.isupper() else "lower" if c.isalpha() else "digit" if c.isdigit() else c if 32 < ord(c) < 127 else "other"

    words, low, shapes = text.split(), text.lower().split(), []
    for k, word in enumerate(words):
        kinds = [kind(c) for c in word]
        shapes.append((tuple(x for j, x in enumerate(kinds) if j == 0 or kinds[j - 1] != x), k > 0 and low[k] == low[k - 1]))
    out = {("word", w) for w in low} | {("pair", *p) for p in zip(low, low[1:], strict=False)}
    for n in (1, 2, 3):
        out |= {("shapes", *shapes[k : k + n]) for k in range(len(shapes) - n + 1)}
    return out


def test_grams_equal_plain_ngrams():
    """Every n-gram has a hash of its own, which stands in the same texts as the n-gram does."""
    all_texts = texts(80)
    where, hashed = defaultdict(set), defaultdict(set)
    for k, text in enumerate(all_texts):
        for g in plain_grams(text):
            where[g].add(k)
    for k, h in zip(*(a.tolist() for a in grams.quality_grams(all_texts)), strict=True):
        hashed[h].add(k)
    assert len(hashed) == len(where) > 400
    assert Counter(map(frozenset, hashed.values())) == Counter(map(frozenset, where.values()))


def test_fit_minimises_the_hinge_loss_of_scaled_indicators():
    rng = random.Random(9)
    rows = [(int(rng.random() < 0.4), plain_grams(t)) for t in texts(60, 6)[2:]]
    number = {g: k for k, g in enumerate(sorted({g for _, gs in rows for g in gs}, key=repr))}
    y, starts = np.array([label for label, _ in rows]), np.cumsum([0] + [len(gs) for _, gs in rows])
    ids = np.concatenate([sorted(number[g] for g in gs) for _, gs in rows])
    model = quality.fit(y, starts, ids, 12, passes=3000)
    pos, neg = sum(label for label, _ in rows), sum(1 - label for label, _ in rows)
    ratio = {}
    for g in number:
        p, q = (1 + sum(g in gs for label, gs in rows if label == want) for want in (1, 0))
        ratio[g] = math.log(p / (pos + 2)) - math.log(q / (neg + 2))
    x = np.zeros((len(rows), len(number) + 1))
    for i, (_, gs) in enumerate(rows):
        for g in gs:
            x[i, number[g]] = ratio[g] / math.sqrt(len(gs))
        x[i, -1] = 1
    sign, cost = np.where(y > 0, 1, -1), np.where(y > 0, len(y) / (2 * pos), len(y) / (2 * neg))
    loss = lambda w: w @ w / 2 + (cost * np.maximum(0, 1 - sign * (x @ w))).sum()
    scale = np.array([ratio[g] for g in number])
    told = np.abs(scale) > 1e-9
    found = np.append(np.divide(model.weights[: len(number)], scale, out=np.zeros(len(number)), where=told), model.bias)
    noise = np.random.default_rng(2)
    assert all(loss(found) <= loss(found + noise.normal(size=len(found)) * s) + 1e-3 for s in (0.1, 0.01, 0.001) for _ in range(100))


def test_scores_equal_plain_sums(spark):
    rows = [(k, t) for k, t in enumerate([*texts(60, 7), None, "word " * 60_000])]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(k, int("wall" in (t or ""))) for k, t in rows], "doc_id long, quality int")
    model = quality.train(table, marks, F.lit(True), 1000, 20)
    found = quality.quality(table, marks, F.lit(False), bits=20).collect()
    assert sorted(r.doc_id for r in found) == [k for k, _ in rows]
    for r in found:
        ids = set(quality.features([rows[r.doc_id][1] or ""], 20)[1].tolist())
        margin = model.bias + sum(float(model.weights[i]) for i in ids) / math.sqrt(max(len(ids), 1))
        assert r.score == pytest.approx(1 / (1 + math.exp(-max(min(model.scale * margin + model.shift, 30), -30))), abs=1e-5)
        assert r.predicted == int(r.score >= 0.5) and r.held_out is False
