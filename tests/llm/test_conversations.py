"""Conversation repair against exhaustive search, a plain search from the end, and its edges."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions as F

from wavelode.llm import conversations as C

SOUND = re.compile(r"(s?(ua)+)?")
SCHEMA = "conv_id long, turn long, role string, text string"


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        body = text.rstrip(" \t\n\v\f\r")
        again = (role, text) in seen
        seen.add((role, text))
        out.append("blank" if not body else "duplicate" if again else "truncated" if body[-1] not in ".!?" else "")
    return out


def searched(rows):
    """Every way to edit, up to two insertions in a gap."""
    marks, best = faults(rows), None
    gaps = [(), ("u",), ("a",), ("u", "a"), ("a", "u"), ("u", "u"), ("a", "a")]
    steps = []
    for (_, role, _), mark in zip(rows, marks, strict=True):
        extra = mark == "truncated"
        steps.append([("D", 3, "")] if mark in ("blank", "duplicate") else [("D", 3, ""), ("K", extra, role[:1] or "-"), ("R", 2 + extra, "u"), ("R", 2 + extra, "a")])
    for way in itertools.product(*steps):
        for put in itertools.product(gaps, repeat=len(rows) + 1):
            said = "".join("".join(p) + e[2] for p, e in zip(put, (*way, ("", 0, "")), strict=True))
            if SOUND.fullmatch(said):
                cost = sum(e[1] for e in way) + 2 * sum(map(len, put))
                audit = "".join("I" * len(p) + e[0] for p, e in zip(put, (*way, ("", 0, "")), strict=True))
                best = min(best or (cost, audit), (cost, audit))
    return best


def from_the_end(rows):
    """(cost, audit) by state from the last row back, as tuples."""
    marks = faults(rows)
    add = lambda c, letter, v: (c + v[0], letter + v[1])
    at = {0: (0, ""), 3: (0, ""), 1: (4, "II"), 2: (2, "I")}
    for (_, role, _), mark in zip(reversed(rows), reversed(marks), strict=True):
        g = {}
        for s in range(4):
            ways = [add(3, "D", at[s])]
            if mark not in ("blank", "duplicate"):
                short = mark == "truncated"
                ways.append(add(2 + short, "R", at[C.NEXT[s]]))
                if (s, role[:1]) in C.KEPT:
                    ways.append(add(short, "K", at[C.KEPT[s, role[:1]]]))
            g[s] = min(ways)
        once = {s: min(g[s], add(2, "I", g[C.NEXT[s]])) for s in range(4)}
        at = {s: min(g[s], add(2, "I", once[C.NEXT[s]])) for s in range(4)}
    return at[0]


def applied(rows, audit):
    """The edited (role, text) rows that an audit stands for."""
    state, left, out = 0, iter(rows), []
    for letter in audit:
        if letter == "I":
            state = C.NEXT[state]
            out.append((C.ROLE[state], ""))
            continue
        _, role, text = next(left)
        if letter != "D":
            state = C.KEPT[state, role[:1]] if letter == "K" else C.NEXT[state]
            out.append((role if letter == "K" else C.ROLE[state], text))
    return out


def made(rng, n):
    return sorted((rng.choice([0, 1, 2, 3, 5]), rng.choice(["user", "assistant", "system", "tool", ""]), rng.choice(["Ja.", "ja", " ", "Oh!\n", "a"])) for _ in range(n))


def run(spark, rows):
    audits, texts = C.repair(spark.createDataFrame(rows, SCHEMA))
    said = {}
    for r in sorted(texts.collect(), key=lambda r: (r["part"], r["seq"])):
        said.setdefault(r["conv_id"], []).append((r["role"], r["text"]))
    return {r["conv_id"]: r for r in audits.collect()}, said


def test_cheapest_edits_against_every_way(spark):
    rng = random.Random(3)
    cases = {k: made(rng, rng.choice([1, 2, 3, 3])) for k in range(40)}
    audits, said = run(spark, [(k, *r) for k, rows in cases.items() for r in rows])
    for k, rows in cases.items():
        assert (audits[k]["cost"], audits[k]["audit"]) == searched(rows) == from_the_end(rows), rows
        assert said.get(k, []) == applied(rows, audits[k]["audit"])
        marks, pairs = faults(rows), ["".join(x[1][:1] for x in p) for p in zip(rows, rows[1:], strict=False)]
        assert [audits[k][c] for c in ("blank", "duplicate", "truncated")] == [marks.count(c) for c in ("blank", "duplicate", "truncated")]
        assert audits[k]["illegal"] == sum(p not in ("su", "ua", "au") for p in pairs)


def test_a_long_conversation_in_many_parts(spark):
    rng = random.Random(5)
    long = [(t, rng.choice(["user", "assistant", "system"]), rng.choice(["Yes.", "no", f"{t}.", f"{t}?", f"{t}"])) for t in range(0, 6000, 2)]
    alike = [(7, "user", "Same.")] * 500 + [(8, "assistant", "Same.")] * 3
    rows = [(1, *r) for r in long] + [(2, *r) for r in alike] + [(3, 0, "user", "a?"), (3, 1, "assistant", "b.")]
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # as if the parts were large
    try:
        audits, said = run(spark, rows)
        assert C.arranged(spark.createDataFrame(rows, SCHEMA)).where("conv_id = 1").select("part").distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert (audits[1]["cost"], audits[1]["audit"]) == from_the_end(long)
    assert said[1] == applied(long, audits[1]["audit"])
    assert audits[1]["gaps"] == 5999 - 3000
    assert (audits[2]["cost"], audits[2]["audit"]) == from_the_end(alike)
    assert (audits[2]["duplicate"], audits[2]["illegal"]) == (501, 501)
    assert (audits[3]["cost"], audits[3]["audit"], said[3]) == (0, "KK", [("user", "a?"), ("assistant", "b.")])


def test_composition_of_parts_is_the_whole():
    rng = random.Random(9)
    for _ in range(60):
        rows = made(rng, 9)
        codes = {"": C.SOUND, "truncated": C.TRUNCATED, "duplicate": C.DUPLICATE, "blank": C.BLANK}
        units = [(role[:1], codes[m], 1) for (_, role, _), m in zip(rows, faults(rows), strict=True)]
        cut = rng.randrange(1, 9)
        assert C.Parts.of(units[:cut]).then(C.Parts.of(units[cut:]))[0].least == C.Parts.of(units).least


def test_nulls_empty_tables_other_columns(spark):
    rows = [(None, None, None, None), (None, 0, "user", "Hm."), (4, None, "user", "x."), (4, None, "assistant", None), (5, 2, "assistant", "A.")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("place", F.lit("mine")).withColumn("part", F.lit(0)).withColumn("n", F.lit(None).cast("int"))
    audits = {r["conv_id"]: r for r in C.repair(df)[0].collect()}
    assert (audits[None]["blank"], audits[None]["cost"], audits[None]["audit"]) == (1, 5, "DKI")
    assert (audits[4]["audit"], audits[4]["gaps"], audits[5]["audit"]) == ("DKI", 0, "IK")
    assert C.audit_digests(df.limit(0), df.limit(0)).count() == 0
    gone = C.audit_digests(df.limit(0), df).collect()
    assert len(gone) == 3 and all(r["repaired_sha256"] == hashlib.sha256(b"").hexdigest() and r["audit"] == "" and r["cost"] == 0 for r in gone)


def test_ids_that_are_text(spark):
    df = spark.createDataFrame([("a", 1, "user", "x?"), ("a", 2, "assistant", "y.")], "conv_id string, turn int, role string, text string")
    assert [tuple(r) for r in C.audit_digests(df, df).select("conv_id", "audit").collect()] == [("a", "KK")]
    assert C.damaged(df).count() >= 0


@pytest.mark.parametrize("end", ["", "\n"])
def test_hash_of_the_repaired_text(spark, end):
    df = spark.createDataFrame([(1, 1, "user", "x?"), (1, 2, "assistant", f"y.{end}")], SCHEMA)
    got = C.audit_digests(df, df).first()["repaired_sha256"]
    assert got == hashlib.sha256(f"user:x?\nassistant:y.{end}".encode()).hexdigest()
