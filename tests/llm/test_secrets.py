"""Secrets against the patterns as they are stated and a comparison of all parts with all parts."""

import hashlib
import random
import re

from pyspark.sql import functions as F

from wavelode.llm import secrets as S

KEY, TOKEN = "AKIA" + "Q7" * 8, "wJalrXUtnFEMI/K7MDENGbPxRfiCYEX4MPLEKEY9"
STATED = {
    "assign": r"""((?:[Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
}


def stated(text):
    out = []
    for i, (kind, pattern) in enumerate(STATED.items()):
        for m in re.finditer(pattern, text):
            if {"assign": kind == "assign" and len(m[2]) >= 6, "access": len(m[0]) >= 20, "hex": len(m[0]) >= 24}[kind]:
                out.append((m.start(), i, m.end()))
    return sorted(out)


def every_pair(text, reach):
    """The weak parts that the rules report, from all parts of a text at once."""
    of = lambda kind: [(len(text.encode()[:a].decode()), len(text.encode()[:b].decode())) for a, b in S.matches(kind, text.encode())]
    base = {"assign": of("assign"), "access": of("access"), "hex": of("hex")}
    clear = lambda spans, taken: [(a, b) for a, b in spans if not any(x < b and y > a for x, y in taken)]
    found = dict(base)
    found["endpoint"] = of("endpoint")
    found["ident"] = clear(of("ident"), sum(base.values(), []))
    found["opaque"] = clear(of("opaque"), sum(found.values(), []))
    cuts = [m.start() for m in re.finditer(S.BREAK, text)]
    para = lambda a: sum(c < a for c in cuts)
    out = []
    for kind in ("ident", "opaque", "endpoint"):
        for a, b in found[kind]:
            near = lambda *ks: any(x <= b + reach and y >= a - reach and para(x) == para(a) for k in ks for x, y in found[k])  # noqa: B023, E731
            ok = {
                "opaque": near("access") or (near("ident") and near("endpoint")),
                "ident": near("assign", "hex") or (near("opaque") and near("endpoint")),
                "endpoint": near("access", "ident") and near("assign", "hex", "opaque"),
            }[kind]
            if ok:
                out.append((a, S.KINDS.index(kind), b))
    return out


def spans(spark, texts, **options):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r["doc_id"]: ([tuple(x) for x in r["base"]], sorted(tuple(x) for x in r["spans"])) for r in S.find(df, **options).collect()}


def test_random_texts_against_stated_patterns_and_all_pairs(spark):
    rng = random.Random(1)
    bits = [KEY, "AKIASHORT", TOKEN, "password=hunter22", "ſecret=abcdefgh", "Token: 'abc'", "API_KEY = \"0123456789abcdef01234567\"", "user_id=anna", "client-id: 77",
            "https://db.example.org/x?y", "host=db9.example", "a1" * 12, "\n\n", "\n \t\n", "ü" * 30, "und die", "wort " * 20, "pass", "secret=secret=abcdef", KEY + KEY]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(1, 40))) for _ in range(120)]
    for reach in (30, S.REACH):
        for i, (base, some) in spans(spark, texts, reach=reach).items():
            assert sorted(base) == stated(texts[i]), texts[i]
            assert some == sorted(base + every_pair(texts[i], reach)), texts[i]


def test_weak_parts_need_their_complement(spark):
    texts = [
        f"id {KEY} key {TOKEN}", f"key {TOKEN}", f"id {KEY}\n\nkey {TOKEN}", f"id {KEY} {'x ' * 150} key {TOKEN}",
        f"user_id: anna at https://a.example with {TOKEN}", f"user_id: anna with {TOKEN}", "https://a.example and user_id: anna", "user_id: anna, password: hunter22 ok",
    ]
    got = {i: [S.KINDS[k] for _, k, _ in some] for i, (_, some) in spans(spark, texts).items()}
    assert got == {0: ["access", "opaque"], 1: [], 2: ["access"], 3: ["access"], 4: ["ident", "endpoint", "opaque"], 5: [], 6: [], 7: ["ident", "assign"]}


def test_many_parts_in_one_text_make_no_pairs(spark):
    text = " ".join(f"{KEY} {TOKEN}" for _ in range(3000))
    (base, some) = spans(spark, [text])[0]
    assert len(base) == 3000 and len(some) == 6000


def test_nulls_repeats_other_columns_and_the_digest(spark):
    rows = [(1, None), (1, f"ü {KEY}"), (1, f"ü {KEY}"), (None, ""), (2, "ü" * 200_000 + " token = 'abcdefg'")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("row", F.lit(1)).withColumn("spans", F.lit("x"))
    got = sorted((r["doc_id"] or 0, r["n_assign"], r["n_access"], r["n_hex"], r["spans"], r["base_sha256"]) for r in S.digests(df).collect())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    one, far = "access:2:22", "assign:200001:200017"
    assert got == sorted([(1, 0, 0, 0, "", sha("")), (1, 0, 1, 0, one, sha(one)), (1, 0, 1, 0, one, sha(one)), (0, 0, 0, 0, "", sha("")), (2, 1, 0, 0, far, sha(far))])
    assert S.digests(df.limit(0)).count() == 0
