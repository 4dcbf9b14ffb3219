"""Transducers against sorted lists, and the audit of sources against plain counting."""

import random
import re
from collections import Counter
from itertools import groupby

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from wavelode.llm import divergence as D
from wavelode.llm.transducer import Transducer


def looked_up(machine, words):
    offsets = np.cumsum([0, *map(len, words)]).astype(np.int64)
    return machine.ordinals(offsets, np.frombuffer(b"".join(words), np.uint8)).tolist()


@settings(max_examples=150, deadline=None)
@given(st.sets(st.binary(max_size=5), max_size=40), st.lists(st.binary(max_size=6), max_size=20))
def test_ordinals_are_places_in_the_sorted_list(kept, others):
    terms = sorted(kept)
    machine = Transducer.unpacked(Transducer.build(terms).packed())
    assert machine.size == len(terms)
    assert looked_up(machine, terms + others) == list(range(len(terms))) + [terms.index(o) if o in kept else -1 for o in others]


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("ab", max_size=5).map(str.encode), min_size=1, max_size=25))
def test_no_two_states_have_the_same_continuations(kept):
    machine = Transducer.build(sorted(kept))
    prefixes = {t[:k] for t in kept for k in range(len(t) + 1)}
    continuations = {frozenset(t[len(p) :] for t in kept if t.startswith(p)) for p in prefixes}
    assert len(machine.final) == len(continuations)


def test_a_very_long_word_leaves_the_automaton_at_once():
    machine = Transducer.build([b"a", b"ab", b"b"])
    assert looked_up(machine, [b"a" * 3_000_000, b"ab", b"", b"b" + b"\xff" * 100]) == [-1, 1, -1, -1]


def plain(rows, least, top):
    """(lang, source, part, item, value, rank) of (text, lang, source) rows."""
    docs = [(lang or "", source or "", [t.lower() if t.isascii() else "".join(c.lower() if c.isascii() else c for c in t) for t in re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", text or "")]) for text, lang, source in rows]
    out = []
    for lang in {d[0] for d in docs}:
        own = [d for d in docs if d[0] == lang]
        df = Counter(t for d in own for t in set(d[2]))
        kept = sorted((t for t, n in df.items() if n >= least), key=str.encode)
        sources = sorted({d[1] for d in own}, key=str.encode)
        count = {s: Counter(t for d in own if d[1] == s for t in d[2] if df[t] >= least) for s in sources}
        whole = sum(count.values(), Counter())
        p = lambda c, t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c.values()) + len(kept))  # noqa: B023, E731
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(h, sum(f(p(count[s], t), p(count[h], t)) for t in kept)) for h in sources if h != s]
            terms = [(t, f(p(count[s], t), p(whole, t))) for t in kept if count[s][t] > 0 and p(count[s], t) > p(whole, t)]
            for part, items, most in (("pair", pairs, len(pairs)), ("term", terms, top)):
                items = sorted(items, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, k + 1) for k, (item, value) in enumerate(items)]
    return sorted(out)


SCHEMA = "text string, lang string, source string"


def made(seed, n):
    rng = random.Random(seed)
    words = ["Haus", "haus", "hÄus", "häus", "maus", "a", "b", "Ab", "x1y", "ſ", "zug-zwang", "naïve", "日本", "😀"]
    return [(rng.choice([None, "", " ".join(rng.choices(words, k=rng.randrange(12)))]), rng.choice(["de", "en", None, "xx"]), rng.choice(["s1", "s2", "s10", None, "t", "é"])) for _ in range(n)]


def test_small_blocks_tiles_and_salts_against_plain_counting(spark, monkeypatch):
    for name, value in (("BLOCK", 3), ("TILE_TERMS", 2), ("TILE_SOURCES", 2), ("DOCS_A_SALT", 20), ("MOST_COUNTED", 5), ("MOST_TOKENS", 60)):
        monkeypatch.setattr(D, name, value)
    rows = made(1, 90) + [("einzig", "fr", "s1"), (None, "fr", "s2")]
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    assert sorted(map(tuple, D.audit(df, 3, 4).collect())) == plain(rows, 3, 4)


def test_usual_settings_other_columns_repeated_rows(spark):
    rows = made(2, 60) * 2
    df = spark.createDataFrame(rows, SCHEMA).withColumn("nth", F.lit("x")).withColumn("term", F.lit(1)).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(map(tuple, D.audit(df).collect())) == plain(rows, 3, 200)
    assert D.audit(df.limit(0)).count() == 0


def test_a_language_without_kept_terms_has_pairs_of_nothing(spark):
    got = D.audit(spark.createDataFrame([("a", "l", "b"), ("b", "l", "a"), ("c", "m", "a")], SCHEMA)).collect()
    assert sorted(map(tuple, got)) == [("l", "a", "pair", "b", 0, 1), ("l", "b", "pair", "a", 0, 1)]


def test_ordinals_follow_utf8_order(spark):
    terms = ["z", "é", "日", "😀", "a", "ab", "Z"]
    got = D.numbered(spark.createDataFrame([("l", t) for t in terms] + [("m", "q")], "lang string, term string")).orderBy("lang", "ordinal").collect()
    by = {lang: [r["term"] for r in rows] for lang, rows in groupby(got, key=lambda r: r["lang"])}
    assert by == {"l": sorted(terms, key=str.encode), "m": ["q"]}
    assert [r["ordinal"] for r in got] == [*range(7), 0]


def test_exact_arithmetic_beyond_longs(spark):
    df = spark.createDataFrame([(40_000_000_000_000, 90_000_000_000_000, 7)], "c long, n long, v long")
    assert df.select(D.probability(F.col("c"), F.col("n"), F.col("v"))).first()[0] == 1 + 1_000_000_000 * 40_000_000_000_001 // 90_000_000_000_007


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("aAzZ[@`{ 1-éſ日İ😀", max_size=8), max_size=8), st.integers(0, 2), st.integers(1, 12))
def test_terms_of_texts_side_by_side(texts, skipped, part):
    column = pa.array([t.encode() for t in texts], pa.binary())[skipped:]
    got = [[] for _ in column]
    with pytest.MonkeyPatch.context() as patch:
        patch.setattr(D, "PART", part)
        for k, some in D._parts(column) if len(column) else ():
            terms, at, text = D.terms_of(some)
            for a, t in zip(at.tolist(), text.tolist(), strict=True):
                got[k + t].append(terms[a].as_py())
    assert got == [[x.lower() for x in re.findall(rb"[A-Za-z\x80-\xff]+", t.as_py())] for t in column]


@pytest.mark.parametrize("counted", [1, 8, 1000])
def test_small_parts_merged_counts_and_cut_rows_against_plain_counting(spark, monkeypatch, counted):
    for name, value in (("BLOCK", 4), ("PART", 24), ("ROW_BYTES", 30), ("SIDE_BY_SIDE", 3), ("MOST_COUNTED", counted), ("DOCS_A_SALT", 40)):
        monkeypatch.setattr(D, name, value)
    rows = made(3, 100)
    df = spark.createDataFrame(rows, SCHEMA).repartition(2)
    assert sorted(map(tuple, D.audit(df, 3, 4).collect())) == plain(rows, 3, 4)


def shuffled(plan):
    """Rows that a plan's exchanges wrote, after it ran, largest first."""
    kind, children = plan.getClass().getSimpleName(), plan.children()
    below = [plan.executedPlan()] if kind == "AdaptiveSparkPlanExec" else [plan.plan()] if kind.endswith("QueryStageExec") else [children.apply(k) for k in range(children.size())]
    own = plan.metrics().get("shuffleRecordsWritten")
    return sorted([x for p in below for x in shuffled(p)] + ([own.get().value()] if own.isDefined() else []), reverse=True)


def test_counted_terms_are_shuffled_many_in_a_row(spark):
    """A row a term cost more than the time there is: its sort and its way into and out of Python."""
    words = [a + b + c for a in "abcdefghijkl" for b in "abcdefghijkl" for c in "abcdefghijkl"]
    docs = D.prepared(spark.createDataFrame([(" ".join(words), "l", s) for s in ("s", "s", "t")], SCHEMA).coalesce(1)).localCheckpoint()
    machines = D.transducers(D.numbered(D.document_frequencies(docs).where("df >= 3")))
    got = D.recounted(docs, machines, 1)
    assert sorted((r["source"], r["ordinal"], r["n"]) for r in got.collect()) == [(s, k, n) for s, n in (("s", 2), ("t", 1)) for k in range(len(words))]
    sums, *lines = shuffled(got._jdf.queryExecution().executedPlan())
    assert sums == 2 * len(words) and sum(lines) < 20  # 12 bytes and 3 letters each, in rows of 4096 bytes
