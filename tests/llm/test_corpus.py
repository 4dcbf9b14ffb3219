"""The corpus operators against brute force, exact round trips and held-out accuracy, on small fixtures."""

import hashlib
import pickle
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from wavelode.llm import embedding_dedup, exact_dedup, html_extraction, language_id, mixing, pieces, quality, simhash, toxicity
from wavelode.llm.common import attach, maybe_in
from wavelode.llm.components import components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, rows):
    return spark.createDataFrame([(i, t, lang, source, len(t or "")) for i, t, lang, source in rows], SCHEMA)


def some_docs(n=120, seed=3):
    rng = random.Random(seed)
    words = ["alpha", "Beta", "gamma", "delta", "omega", "the", "of", "and", "été", "Über"]
    out = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(1, 60))), rng.choice(["en", "fr", None]), rng.choice(["a", "b", "hot", "hot", None])) for i in range(n)]
    out += [(n, None, "en", "a"), (n + 1, "", "en", "b"), (n + 2, " \t\n", None, None), (n + 3, "w " * 30000, "en", "hot")]
    return out


def united(nodes, links):
    root = {v: v for v in nodes}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return {v: find(v) for v in nodes}


def brute_mix(rows, seed=20):
    size = {i: len((t or "").encode().split()) for i, t, _, _ in rows}
    by = defaultdict(list)
    for i, _, _, s in rows:
        by[s].append(i)
    order = sorted([s for s in by if s is not None]) + ([None] if None in by else [])
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    total = {s: sum(size[i] for i in by[s]) for s in order}
    target, open_, left = dict.fromkeys(order, 0.0), set(order), 1.5 * sum(total.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * total[s]}
        if not over:
            for s in open_:
                target[s] = level * weight[s]
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
        open_ -= over
    taken = {}
    for s in order:
        base = int(target[s] // total[s]) if total[s] else 0
        need = target[s] - base * total[s]
        h = {i: int(hashlib.md5(f"{i}:{seed}".encode()).hexdigest()[:15], 16) for i in by[s]}
        upto = 0
        for i in sorted(by[s], key=h.get):
            more = 1 if upto + size[i] <= need or 2 * (need - upto) >= size[i] else 0
            more = more if upto <= need else 0
            upto += size[i]
            taken[i] = size[i] * (base + more)
    return size, total, target, taken


def test_mix_equals_brute_force(spark):
    rows = some_docs()
    got = {r.doc_id: r for r in mixing.mix(docs_of(spark, rows)).collect()}
    size, total, target, taken = brute_mix(rows)
    assert len(got) == len(rows)
    for i, _, _, s in rows:
        assert (got[i].size, got[i].source_size) == (size[i], total[s])
        assert got[i].target == pytest.approx(target[s])
        if size[i]:
            assert got[i].taken == taken[i]
        assert got[i].taken <= 2 * size[i]


def test_mix_edges(spark):
    assert mixing.mix(docs_of(spark, [])).count() == 0
    assert {r.taken for r in mixing.mix(docs_of(spark, [(1, None, None, None), (2, "", None, "a")])).collect()} == {0}
    clash = docs_of(spark, some_docs(30)).withColumn("h", F.lit("x")).withColumn("salt", F.lit("y")).withColumn("limit", F.lit(1))
    plan = {r.doc_id: r.copies for r in mixing.mix(clash).collect()}
    out = mixing.mixed(clash)
    assert out.columns == clash.columns
    assert Counter(r.doc_id for r in out.collect()) == Counter({i: c for i, c in plan.items() if c})
    same = docs_of(spark, [(7, "a b c", "en", "s")] * 5 + [(8, "d", "en", "t")])
    assert mixing.mix(same).where("doc_id = 7").select("taken").distinct().count() == 1  # rows of one id share one fate


def brute_dedup(rows):
    groups = defaultdict(list)
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for i, t, *_ in rows:
        groups[(t or "").translate(lower)].append(i)
    return {i: (max(g), len(g), i == max(g)) for g in groups.values() for i in g}


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda t: F.unhex(F.substring(F.sha2(t.cast("binary"), 256), 1, 1)), lambda t: F.unhex(F.lit("00"))])
def test_exact_dedup_equals_brute_force_even_when_digests_clash(spark, digest):
    rows = some_docs(60) + [(1000 + k, "SAME text É" if k % 2 else "same TEXT É", None, "a") for k in range(40)] + [(2000, "same text é", None, "a"), (2001, None, None, None)]
    got = exact_dedup.exact_dedup(docs_of(spark, rows).repartition(5), digest, files_per_batch=2).collect()
    want = brute_dedup(rows)
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want and len(got) == len(rows)


def test_exact_dedup_is_a_stream_that_meets_its_state(spark, tmp_path, monkeypatch):
    rows = some_docs(60) + [(1000 + k, f"again {k % 7}", None, "a") for k in range(300)]
    docs_of(spark, rows).repartition(9).write.parquet(f"{tmp_path}/docs")
    batches, write = [], exact_dedup.shared_folder
    monkeypatch.setattr(exact_dedup, "shared_folder", lambda s, label: batches.append((label, write(s, label))) or batches[-1][1])
    docs = spark.read.parquet(f"{tmp_path}/docs")
    got = exact_dedup.exact_dedup(docs).collect()
    assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == brute_dedup(rows) and len(got) == len(rows)
    keys = spark.read.parquet(dict(batches)["dedup-keys"])
    assert keys.select("batch").distinct().count() >= 3  # later batches met what the state kept of earlier ones
    assert keys.groupBy("digest").agg(F.countDistinct("batch").alias("b")).where("b > 1").count() >= 5
    # The locator leads to the text itself, the same in another reading.
    places = {(r.locator.file, r.locator.row): r.doc_id for r in exact_dedup.located(docs).collect()}
    assert len(places) == len(rows) and places == {(r.locator.file, r.locator.row): r.doc_id for r in exact_dedup.located(docs.where("true")).repartition(3).collect()}


def test_exact_dedup_edges(spark):
    assert exact_dedup.exact_dedup(docs_of(spark, [])).count() == 0
    rows = docs_of(spark, [(5, "x", None, None)] * 3 + [(4, "X", None, None), (None, "x", None, None), (None, "y", None, None)])
    got = exact_dedup.exact_dedup(rows).collect()
    assert [r.kept for r in got if r.group_size == 5].count(True) == 1 and all(r.keep_id == 5 for r in got if r.group_size == 5)
    kept = exact_dedup.deduplicated(rows.withColumn("digest", F.lit(1)).withColumn("_bit", F.lit(2)))
    assert sorted((r.doc_id or -1, r.text) for r in kept.collect()) == [(-1, "y"), (5, "x")]


def brute_fingerprint(text, shingle=4):
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    words = [w for w in (text or "").translate(lower).replace("\t", " ").replace("\n", " ").replace("\v", " ").replace("\f", " ").replace("\r", " ").split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[k : k + shingle]) for k in range(max(1, len(words) - shingle + 1))]
    hashes = [xxhash.xxh64_intdigest(g.encode(), seed=42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def test_fingerprints_equal_brute_force():
    texts = [None, "", " \t", "one", "One two", "a b c d", "a b c d e", "É x\x85y z w  v", *[t for _, t, *_ in some_docs(40)][:40]]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]


def test_ball_links_join_what_all_pairs_join(spark):
    rng, fps = random.Random(5), []
    for _ in range(60):
        x = rng.getrandbits(64)
        fps.append(x)
        for _ in range(rng.randint(0, 4)):
            y = rng.choice(fps[-3:])
            for b in rng.sample(range(64), rng.randint(1, 6)):
                y ^= 1 << b
            fps.append(y)
    fps = sorted(set(fps))
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in signed], "fp long"), len(fps)).collect()
    assert all(((r.a ^ r.b) & (1 << 64) - 1).bit_count() <= 4 for r in links)
    want = united(signed, [(a, b) for k, a in enumerate(signed) for b in signed[:k] if ((a ^ b) & (1 << 64) - 1).bit_count() <= 4])
    assert united(signed, [(r.a, r.b) for r in links]) == want


def test_ball_links_with_more_buckets_than_a_ball_reaches(spark, monkeypatch):
    fps = [1, 3, 0xF0, 0xFF00, 0xFF03, 1 << 62, (1 << 62) | 15]
    monkeypatch.setattr(simhash, "IN_TASK", 3)
    monkeypatch.setattr(simhash, "VARIANTS", 1 << 8)
    links = simhash.fingerprint_links(spark.createDataFrame([(f,) for f in fps], "fp long"), len(fps)).collect()
    want = united(fps, [(a, b) for a in fps for b in fps if a < b and (a ^ b).bit_count() <= 4])
    assert united(fps, [(r.a, r.b) for r in links]) == want


def test_near_dedup_equals_brute_force(spark):
    base = [t for _, t, *_ in some_docs(25, 9)][:25]
    rows = [(i, t, None, None) for i, t in enumerate(base)]
    rows += [(100 + k, base[k % 5] + (" more" if k % 2 else ""), None, None) for k in range(20)] + [(200, None, None, None), (201, "", None, None)]
    got = {r.doc_id: r for r in simhash.near_dedup(docs_of(spark, rows)).collect()}
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows}
    want = united(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert {i: r.component_id for i, r in got.items()} == want
    kept = simhash.near_deduplicated(docs_of(spark, rows).withColumn("fp", F.lit(0)))
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i in want if want[i] == i)
    assert simhash.near_dedup(docs_of(spark, [])).count() == 0


def test_components_of_chains_stars_and_loops(spark):
    links = [(k, k + 1) for k in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(7, 7), (200, 201), (201, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(links, "a long, b long")).collect()}
    want = united({v for x in links for v in x}, links)
    assert got == {v: r for v, r in want.items()}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("members", [1 << 14, 40])
def test_vectors_equal_brute_force(spark, monkeypatch, members):
    monkeypatch.setattr(embedding_dedup, "MEMBERS", members)  # 40: lists are cut into blocks
    rng = np.random.default_rng(1)
    base = rng.normal(size=(300, 24))
    near = [b + rng.normal(size=24) * s for b in base[:60] for s in (0.02, 0.1, 0.2)]
    x = np.concatenate([base, near, base[:3], base[:3] * 2]).astype(np.float32).tolist()
    rows = [(i, v) for i, v in enumerate(x)] + [(9000, None), (9001, []), (9002, [0.0] * 24), (9003, [float("nan")] + [1.0] * 23), (9004, [None] + [1.0] * 23), (9005, [float("inf")] * 24), (9006, [1.0, 2.0])]
    got = {r.vec_id: r for r in embedding_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    u = np.array(x, np.float32).astype(float)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    links = [(a, b) for a, b in zip(*np.nonzero(u @ u.T >= 0.9), strict=True) if a < b]
    found = sum(got[i].n_links for i in range(len(x))) / 2
    assert found <= len(links) and found >= 0.99 * len(links)
    want = united(range(len(x)), links)
    assert sum(got[i].component_id != want[i] for i in range(len(x))) <= 2
    assert all((got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True) for i in range(9000, 9007))
    # A group of near vectors, a large part of all.
    heap = rng.normal(size=24) + rng.normal(size=(200, 24)) * 0.08
    lone = rng.normal(size=(100, 24))
    y = np.concatenate([heap, lone]).astype(np.float32)
    some = spark.createDataFrame(list(enumerate(y.tolist())), "vec_id long, embedding array<float>").withColumn("label", F.lit(1))
    u = y.astype(float) / np.linalg.norm(y.astype(float), axis=1, keepdims=True)
    near = (u @ u.T >= 0.9).sum(1) - 1
    hits = [r.n_links for r in embedding_dedup.near_vectors(some).orderBy("vec_id").collect()]
    assert all(h <= w for h, w in zip(hits, near, strict=True)) and sum(hits) >= 0.99 * near.sum() > 30_000
    assert embedding_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_collision_probability_is_the_simulated_one():
    plan = embedding_dedup.Plan(10_000, 0.9)
    rng = np.random.default_rng(0)
    x = rng.normal(size=4_000_000)
    y = 0.9 * x + np.sqrt(1 - 0.81) * rng.normal(size=len(x))
    share = ((x >= plan.start) & (y >= plan.start) & (np.abs(x - y) <= plan.window)).mean()
    assert share == pytest.approx(plan.collision(0.9), rel=0.05) and plan.least >= 2


def test_language_on_held_out_rows(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = language_id.language_id(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 20 and sum(r.lang == r.lang_pred for r in rows) >= 0.95 * len(rows)


def test_language_edges(spark):
    rows = [(1, None, "en", None), (2, "123 !!", "en", None), (3, "", None, None), (4, "hello there", "en", None), (5, "bonjour", None, None), (8, "some more words", "en", None)]
    got = {r.doc_id: r for r in language_id.language_id(docs_of(spark, rows), F.lit(False)).collect()}
    assert [got[i].lang_pred for i in (1, 2, 3, 4, 5)] == ["und", "und", "und", "en", "en"] and all(0 <= r.score <= 1 for r in got.values())
    assert [r.lang_pred for r in language_id.language_id(docs_of(spark, [(1, "text", None, None)])).collect()] == ["und"]
    assert language_id.language_id(docs_of(spark, [])).count() == 0
    odd = [(1, "½ ²", None, None), (2, "Ⅷ ①", None, None), (3, "_ 5", None, None), (4, "\U0001f600", None, None), (5, "ª", None, None), (6, "\U00020000", None, None), (7, "hello", "en", None)]
    got = {r.doc_id: r.lang_pred for r in language_id.language_id(docs_of(spark, odd), F.lit(False)).collect()}
    assert [got[i] for i in range(1, 8)] == ["und"] * 4 + ["en"] * 3


def brute_languages(learned, texts, alpha=0.1, size=1 << 15):
    """Multinomial naive Bayes with dictionaries; ids of n-grams come one by one from the hash."""
    def ids(text):
        clean = re.sub(r"[^a-zéü]+", " ", text.lower()) + " "
        clean = re.sub(" +", " ", clean)
        return [int(i) for n in (1, 2, 3) for k in range(len(clean) - n + 1) for i in [one_id(clean[k : k + n], n)]]

    def one_id(gram, n):
        h = ord(gram[0])
        for a, b in zip(range(n - 1), range(1, n), strict=True):
            del a
            h = h * 0x01000193 + ord(gram[b]) * 0x85EBCA6B & 0xFFFFFFFF
        return ((h ^ (h >> 15)) * 0x9E3779B1 + (n * 0x2C1B3C6D & 0xFFFFFFFF) & 0xFFFFFFFF) >> (33 - size.bit_length())

    counts, docs = defaultdict(Counter), Counter()
    for text, lang in learned:
        docs[lang] += 1
        counts[lang].update(ids(text))
    out = []
    for text in texts:
        logs = {}
        for lang in sorted(docs):
            total = sum(counts[lang].values()) + alpha * size
            logs[lang] = np.log((docs[lang] + 1) / (sum(docs.values()) + len(docs))) + sum(np.log((counts[lang][i] + alpha) / total) for i in ids(text))
        best = max(logs, key=lambda x: (logs[x], [-ord(c) for c in x]))
        out.append((best, 1 / sum(np.exp(v - logs[best]) for v in logs.values())))
    return out


def test_language_scores_equal_brute_force(spark):
    rng = random.Random(7)
    words = {"en": ["the", "of", "and", "with", "under"], "fr": ["été", "le", "et", "dans", "sur"], "de": ["über", "und", "der", "mit"]}
    rows = [(k, " ".join(rng.choice(words[lang] + ["a", "alpha"]) for _ in range(rng.randint(1, 9))), lang if k % 3 else None, None) for k, lang in enumerate(rng.choices(list(words), k=60))]
    got = {r.doc_id: r for r in language_id.language_id(docs_of(spark, rows), F.lit(False)).collect()}
    want = brute_languages([(t, lang) for _, t, lang, _ in rows if lang], [t for _, t, *_ in rows])
    for (k, *_), (lang, score) in zip(rows, want, strict=True):
        assert got[k].lang_pred == lang and got[k].score == pytest.approx(score, rel=1e-6)


def test_grams_do_not_depend_on_the_batch():
    texts = ["Hello wörld", "", "a", "İstanbul ABC", "x" * 50, "one two three"]
    alone = [language_id.gram_ids([t], 1 << 12) for t in texts]
    ids, starts = language_id.gram_ids(texts, 1 << 12)
    for k, (own, _) in enumerate(alone):
        end = starts[k + 1] if k + 1 < len(starts) else len(ids[0])
        for n in range(3):
            assert sorted(x for x in ids[n][starts[k] : end] if x < 1 << 12) == sorted(x for x in own[n] if x < 1 << 12)
    for f in (quality.features, toxicity.term_ids):
        text, got = f(texts, 18)
        for k, t in enumerate(texts):
            assert got[text == k].tolist() == f([t], 18)[1].tolist()


def held_out_accuracy(rows, labels, name):
    pairs = [(r.predicted, x[name]) for r in rows for x in [labels.get(r.doc_id)] if r.held_out and x]
    return sum(a == b for a, b in pairs) / len(pairs)


def test_quality_on_held_out_rows(spark, small):
    big = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = quality.quality(spark.read.parquet(f"{big}/documents.parquet"), labels).collect()
    assert held_out_accuracy(rows, {r.doc_id: r for r in labels.collect()}, "quality") >= 0.95


def test_toxicity_on_held_out_rows(spark, small):
    big = small.replace("0.001", "0.01")
    labels = spark.read.parquet(f"{big}/labels.parquet")
    rows = toxicity.toxicity(spark.read.parquet(f"{big}/documents.parquet"), labels).collect()
    assert held_out_accuracy(rows, {r.doc_id: r for r in labels.collect()}, "toxic") >= 0.93


@pytest.mark.parametrize(("work", "name"), [(quality.quality, "quality"), (toxicity.toxicity, "toxic")])
def test_classifier_edges(spark, work, name):
    docs = docs_of(spark, [(1, None, None, None), (2, "", None, None), (3, "w " * 9000, None, None), (3, "w", None, None), (None, "z", None, None)])
    schema = "doc_id long, quality int, toxic int"
    for rows in ([], [(1, 1, 1), (2, None, None), (None, 0, 0), (3, 1, 1)], [(k, k % 2, k % 2) for k in range(4)] * 2):
        out = work(docs, spark.createDataFrame(rows, schema)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in out)
    assert work(docs_of(spark, []), spark.createDataFrame([], schema)).count() == 0


def test_factorization_machine_equals_brute_force():
    rng = np.random.default_rng(2)
    model = toxicity.Model(0.3, rng.normal(size=8), rng.normal(size=(8, 3)), 1.5, -0.2)
    rows = [[0, 3, 5], [], [1], [0, 1, 2, 3, 4, 5, 6, 7]]
    got = model.margins(np.repeat(np.arange(4), [len(r) for r in rows]), np.array([i for r in rows for i in r]), 4)
    for r, m in zip(rows, got, strict=True):
        pairs = sum(float(model.v[a] @ model.v[b]) for a in r for b in r if a < b)
        assert m == pytest.approx(0.3 + sum(float(model.w[i]) for i in r) + pairs, abs=1e-5)


def test_toxicity_of_pairs_whose_terms_tell_nothing_alone(spark):
    rng = random.Random(3)
    others = [f"w{a}{b}x" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop"]
    docs, labels = [], []
    for k in range(4000):
        one, two = rng.random() < 0.5, rng.random() < 0.5
        words = [rng.choice(others) for _ in range(12)] + ["zebra"] * one + ["quince"] * two
        rng.shuffle(words)
        docs.append((k, " ".join(words), None, None))
        labels.append((k, 0, int(one != two)))
    table, marks = docs_of(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    rows = toxicity.toxicity(table, marks).collect()
    assert held_out_accuracy(rows, {i: {"toxic": t} for i, _, t in labels}, "toxic") >= 0.95
    # Weights alone can't tell.
    text, ids = toxicity.term_ids([t for _, t, *_ in docs], 18)
    linear = toxicity.fit(np.array([t for *_, t in labels]), np.searchsorted(text, np.arange(4001)), ids.astype(np.int64), 18, passes=3)
    assert linear.v.shape[1] == 0 and np.mean((linear.score([t for _, t, *_ in docs]) >= 0.5) == np.array([t for *_, t in labels])) < 0.7


def test_toxicity_scores_equal_brute_force(spark):
    docs = [(k, t, None, None) for k, (_, t, *_) in enumerate(some_docs(60))]
    labels = [(k, 0, int("omega" in (t or ""))) for k, t, *_ in docs]
    table, marks = docs_of(spark, docs), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.train(table, marks, F.lit(True), 1000, 16)
    for r in toxicity.toxicity(table, marks, F.lit(False), bits=16).collect():
        words = re.findall(r"[^\W\d_]+", (dict((k, t) for k, t, *_ in docs)[r.doc_id] or "").lower())
        terms = {int(i) for w in words for i in toxicity.term_ids([w], 16)[1]}
        margin = model.bias + sum(float(model.w[i]) for i in terms)
        margin += sum(float(model.v[a] @ model.v[b]) for a in terms for b in terms if a < b)
        assert r.score == pytest.approx(1 / (1 + np.exp(-np.clip(model.scale * margin + model.shift, -30, 30))), abs=1e-4)


def test_dual_descent_finds_the_hinge_optimum():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(80, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 1]) + rng.normal(size=80) > 0, 1.0, -1.0)
    starts = np.arange(0, 401, 5)
    w = quality.dual_descent(starts, np.tile(np.arange(5), 80), x.ravel(), y, np.ones(80), 5, 400)
    loss = lambda v: v @ v / 2 + np.maximum(0, 1 - y * (x @ v)).sum()
    assert all(loss(w) <= loss(w + rng.normal(size=5) * s) + 1e-6 for s in (0.3, 0.1, 0.03) for _ in range(200))


@pytest.fixture(scope="module")
def vocabulary():
    return pieces.Vocabulary.load()


def test_pieces_without_dropout_are_the_models_own(vocabulary, spark, small):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=pieces.MODEL)
    texts = [r.text for r in spark.read.parquet(f"{small}/documents.parquet").limit(60).collect()] + ["", " ", "  a  b ", "x" * 200, "tab\tand\n\nlines", "日本 \U0001f600", "aaaa" * 30]
    assert [vocabulary.encode(t).tolist() for t in texts] == [sp.encode(t) for t in texts]


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_pieces_decode_to_the_text(vocabulary, dropout):
    texts = ["", " ", "▁ ▁▁x", "a▁b", "\x00\x01\x7f", "é日\U0001f600 z", " lead", "trail ", "\n\n", "word " * 5000, "y" * 3000, "<0x41> <s> </s> <unk>"]
    for seed in (1, 2):
        ids = vocabulary.encode_all(texts, list(range(len(texts))), dropout, seed)
        assert [vocabulary.decode(x.tolist()) for x in ids] == texts


def test_pieces_side_by_side_equal_one_by_one(vocabulary):
    rng = random.Random(4)
    units = [" " + "".join(rng.choice("aeinrstlodhéß.,") for _ in range(rng.randint(1, 40))) for _ in range(800)]
    for dropout in (0.0, 0.2, 0.8):
        keys = [rng.randint(0, 9) for _ in units]
        assert vocabulary.segment_all(units, dropout, keys) == [vocabulary.segment(u, dropout, k) for u, k in zip(units, keys, strict=True)]


def test_pieces_vary_with_the_seed_and_repeat_with_it(spark, vocabulary):
    docs = docs_of(spark, some_docs(30) + [(None, "no id", None, None), (5, "again " * 9, None, None)] * 2)
    one, two = ({(r.doc_id, tuple(r.ids or ())) for r in pieces.encode(d, vocabulary, 0.3, s).collect()} for d, s in ((docs, 1), (docs.repartition(7), 1)))
    other = {(r.doc_id, tuple(r.ids or ())) for r in pieces.encode(docs, vocabulary, 0.3, 2).collect()}
    assert one == two and one != other
    tokens = pieces.encode(docs, vocabulary, 0.3, 1)
    back = Counter((r.doc_id, r.text) for r in pieces.decode(tokens, vocabulary).collect())
    assert back == Counter((r.doc_id, r.text) for r in docs.collect())
    assert all(r.lossless for r in pieces.digests(docs, vocabulary).collect())
    assert pieces.digests(docs_of(spark, []), vocabulary).count() == 0


def test_pieces_draw_skips_for_every_occurrence(spark, vocabulary):
    word, n = " reasonable", 4000
    for dropout in (0.1, 0.5):
        ids = vocabulary.encode_all(["reasonable"] * n, list(range(n)), dropout, 1)
        assert len({x.tobytes() for x in ids}) > 4
        plain = vocabulary.segment(word)
        chains = [vocabulary.segment(word, dropout, k) for k in range(n)]
        share, want = (sum(x == plain for x in some) / n for some in ([i.tobytes() for i in ids], chains))
        assert abs(share - want) < 0.04
    places = vocabulary.encode("again reasonable" + " reasonable" * 300, 0.1, 1).tolist()
    assert vocabulary.decode(places) == "again reasonable" + " reasonable" * 300
    # Remembered runs give just what each key gives alone, unknown letters and long units among them.
    texts = ["the reasonable thing 日本語 é\U0001f600x " + "z" * 40 + " understanding\n\n  again"] * 300
    runs = []
    for longest in (24, 0):
        pieces.LONGEST, before = longest, pieces.LONGEST
        try:
            runs.append([x.tolist() for x in pickle.loads(pickle.dumps(vocabulary)).encode_all(texts, list(range(300)), 0.3, 5)])
        finally:
            pieces.LONGEST = before
    assert runs[0] == runs[1]


def test_pieces_of_two_vocabularies_in_one_process(vocabulary, monkeypatch):
    names = [pieces.MARK, "a", "b", "c", "ab", "bc", "abc", pieces.MARK + "a"]
    ids = [*range(len(names), len(names) + 256)]
    make = lambda scores: pieces.Vocabulary([*zip(names, scores, strict=True), *[(f"<0x{b:02X}>", 0.0) for b in range(256)]], ids, set())
    for _ in range(20):  # each freed at once, so that a new one may stand where the last one stood
        assert make([0, 0, 0, 0, -1, -2, -3, -4]).encode("abc abc").tolist() == [0, 6, 0, 6]
        assert make([0, 0, 0, 0, -2, -1, -9, -4]).encode("abc abc").tolist() == [7, 5, 7, 5]
    one = pickle.loads(pickle.dumps(vocabulary))
    monkeypatch.setattr(pieces, "REMEMBERED", 20_000)
    texts = [f"{k} words and numbers {k * 7919} in many {k * 31}a ways" for k in range(2000)]
    got = [one.encode_all(texts[k : k + 50], list(range(k, k + 50)), 0.2, 3) for k in range(0, 2000, 50)]
    assert one.runs.size < 200_000
    assert [x.tolist() for part in got for x in part] == [x.tolist() for x in vocabulary.encode_all(texts, list(range(2000)), 0.2, 3)]


def test_copies_of_a_document_are_segmented_each_in_its_way(spark, vocabulary):
    docs = docs_of(spark, [(7, "some reasonable understanding of several things " * 5, "en", "a")] * 2)
    assert len({tuple(r.ids) for r in pieces.encode(docs, vocabulary, 0.3, 1, vary_copies=True).collect()}) == 2
    assert len({tuple(r.ids) for r in pieces.encode(docs, vocabulary, 0.3, 1).collect()}) == 1


def truth_of(page):
    keep = html_extraction.targets(page) & np.array([bool(t) for t in page.truth])
    return page.text(keep)


def test_html_on_held_out_pages_and_layouts(spark, small):
    rows = [r.html for r in spark.read.parquet(f"{small.replace('0.001', '0.01')}/pages.parquet").collect()]
    model = html_extraction.fit(rows[:100])
    known = [p for p in map(html_extraction.as_is, rows[100:]) if p]
    plain = [s for s in rows[100:] if html_extraction.as_is(s)]
    got = html_extraction.main_texts(plain, model)
    assert sum(truth_of(p) == g for p, g in zip(known, got, strict=True)) >= 0.95 * len(known)
    rng, hit, extra, missed = random.Random(8), 0, 0, 0
    others = [p[2].strip() for page in known for p in page.pieces if page.truth[p[0]] and p[2].strip()]
    for page in known[:60]:
        source = html_extraction.relaid(page, rng, others)
        a, b = Counter(truth_of(html_extraction.Page(source)).split()), Counter(html_extraction.main_texts([source], model)[0].split())
        both = sum((a & b).values())
        hit, extra, missed = hit + both, extra + sum(b.values()) - both, missed + sum(a.values()) - both
    assert hit / (hit + extra) > 0.95 and hit / (hit + missed) > 0.95


def test_html_edges(spark):
    page = "<html><body><nav><a href=x>Home</a></nav><article><h1>A &amp; B</h1><p>One <b>bo</b>ld\n text,&nbsp;here.<p>Second <script>var t='</p>';</script>part.</article><footer>End</footer>"
    rows = [(1, "u", page), (2, None, None), (3, "u", ""), (4, "u", "<"), (5, "u", "<div" * 300), (6, "u", "<!-- never closed"), (7, "u", "<p title='x"), (1, "u", page)]
    got = html_extraction.extract(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))).collect()
    assert len(got) == 8 and all(r.n_chars == len(r.text) for r in got)
    assert [r.text for r in got if r.page_id == 1] == ["A & B One bold text, here. Second part."] * 2
    assert [r.text for r in got if r.page_id in (2, 3)] == ["", ""]
    assert html_extraction.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_decoding_has_no_contradictions():
    page = html_extraction.Page("<div><div><p>a</p></div><div><p>b</p><p>c</p></div></div>")
    rng = np.random.default_rng(0)
    for _ in range(50):
        score = rng.normal(size=len(page.parent))
        keep = page.decoded(score)
        assert all(keep[page.parent[i]] for i in range(1, len(keep)) if keep[i])
        best = max(sum(score[i] for i in s) for s in closed_sets(page.parent))
        assert score[keep].sum() == pytest.approx(best)


def closed_sets(parent):
    n = len(parent)
    for bits in range(1 << n):
        chosen = [i for i in range(n) if bits >> i & 1]
        if all(parent[i] in chosen for i in chosen if i):
            yield chosen


def test_attach_and_filter_keep_every_row(spark):
    rows = spark.createDataFrame([(k % 7 if k % 3 else 99, k) for k in range(3000)], "key long, v long")
    groups = rows.groupBy("key").agg(F.count("*").alias("n"), F.max("v").alias("top"))
    out = attach(rows, groups, "key", 3000)
    assert out.count() == 3000 and out.where("v > top").count() == 0
    some = spark.createDataFrame([(3,), (99,)], "key long")
    assert maybe_in(rows, "key", some).where("key in (3, 99)").count() == rows.where("key in (3, 99)").count()
    assert maybe_in(rows, "key", some).count() + maybe_in(rows, "key", some, inside=False).count() == 3000


def test_pipeline_stages_equal_brute_force(spark, small):
    import corpus_pipeline
    from wavelode.llm.common import stored

    docs = spark.read.parquet(f"{small}/documents.parquet")
    columns = docs.columns
    rows = lambda df: [(r.doc_id, r.text, r.lang, r.source) for r in df.collect()]
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["toxicity", "exact dedup", "simhash near-dedup", "mixing", "piece encoding"]
    kept = stored(stages["toxicity"](spark, docs, small), "t")
    assert kept.columns == columns and 0.8 * docs.count() <= kept.count() <= docs.count()
    single = stored(stages["exact dedup"](spark, kept, small), "t")
    want = brute_dedup(rows(kept))
    assert sorted(r.doc_id for r in single.collect()) == sorted(i for i, (_, _, k) in want.items() if k) and single.columns == columns
    apart = stored(stages["simhash near-dedup"](spark, single, small), "t")
    fp = {i: brute_fingerprint(t) for i, t, *_ in rows(single)}
    group = united(list(fp), [(a, b) for a in fp for b in fp if a < b and (fp[a] ^ fp[b]).bit_count() <= 4])
    assert sorted(r.doc_id for r in apart.collect()) == sorted(i for i in group if group[i] == i) and apart.columns == columns
    mixed = stored(stages["mixing"](spark, apart, small), "t")
    size, _, _, taken = brute_mix(rows(apart))
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: taken[i] // size[i] for i in size if size[i] and taken[i]}) and mixed.columns == columns
    tokens = stages["piece encoding"](spark, mixed, small)
    back = pieces.decode(tokens, pieces.Vocabulary.load())
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in mixed.collect())
    assert corpus_pipeline.run(spark, small).count() == mixed.count()
