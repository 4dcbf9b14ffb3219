"""Near lines against brute force on small fixtures."""

import hashlib
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from wavelode.llm import line_dedup

SCHEMA = "doc_id long, text string"


def distance(a, b):
    a, b = a.encode(), b.encode()
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def edited(rng, text, times, letters):
    out = list(text)
    for _ in range(times):
        at = rng.randint(0, len(out))
        kind = rng.randrange(3)
        if kind == 0:
            out.insert(at, rng.choice(letters))
        elif at < len(out):
            out[at : at + 1] = [] if kind == 1 else [rng.choice(letters)]
    return "".join(out)


def brute(rows, most=2, least=20):
    n, first = defaultdict(int), {}
    for i, text in rows:
        for line in (text or "").split("\n"):
            if line := line.strip(" \t\r\f\v"):
                n[line] += 1
                first[line] = min([x for x in (first.get(line), i) if x is not None], default=None)
    names = list(n)
    long = [x for x in names if len(x.encode()) >= least]
    links = [(x, y) for k, x in enumerate(long) for y in long[:k] if abs(len(x.encode()) - len(y.encode())) <= most and distance(x, y) <= most]
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for x, y in links:
        root[find(x)] = find(y)
    groups, degree = defaultdict(list), defaultdict(int)
    for x in names:
        groups[find(x)].append(x)
    for x, y in links:
        degree[x] += 1
        degree[y] += 1
    md5 = lambda x: hashlib.md5(x.encode()).hexdigest()
    out = {}
    for group in groups.values():
        ids = [first[x] for x in group if first[x] is not None]
        for x in group:
            out[x] = (md5(x), n[x], first[x], degree[x], min(map(md5, group)), min(ids, default=None))
    return out


def fixture(seed=5):
    rng = random.Random(seed)
    letters = "abcdefgh é"
    seeds = ["".join(rng.choice(letters) for _ in range(rng.choice([3, 19, 20, 21, 25, 40, 90]))) for _ in range(40)]
    head = "the same long head of many lines "
    seeds += [head + "".join(rng.choice("abcdefghijklmnop") for _ in range(66)) for _ in range(60)]  # one segment in common
    lines = seeds + [edited(rng, rng.choice(seeds), rng.randint(0, 4), letters) for _ in range(260)]
    rng.shuffle(lines)
    rows = [(k, "\n".join(lines[k * 4 : k * 4 + 4])) for k in range(len(lines) // 4)]
    rows += [(500, None), (501, ""), (502, " \t\r\n\n"), (None, lines[0] + "\n" + "x" * 30), (503, lines[1]), (503, lines[1] + "\r\n" + lines[2])]
    long = "".join(rng.choice(letters) for _ in range(3000))
    return rows + [(600, long), (601, edited(rng, long, 2, letters)), (602, long[1500:] + long[:1500])]


@pytest.mark.parametrize("hot_rows", [64, 4])
def test_classes_equal_brute_force(spark, monkeypatch, hot_rows):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", hot_rows)
    rows = fixture()
    docs = spark.createDataFrame(rows, SCHEMA).withColumn("line", F.lit("x")).withColumn("id", F.lit(1)).withColumn("key", F.lit(2))
    got = {r[0]: tuple(r)[1:] for r in line_dedup.line_classes(docs).collect()}
    want = brute(rows)
    assert sum(x[3] for x in want.values()) > 100
    assert got == want


@pytest.mark.parametrize("letters", ["абвгдежзиклмнопрст", "abcdefghijklmnopqr"])
def test_families_have_few_candidates_in_any_script(spark, letters):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(2, 8)))
    words, counts = [word() for _ in range(60)], []
    for size in (200, 400):
        lines = set()
        while len(lines) < size:  # some words exchanged for others as long: same lengths, nearly the same letters
            line = list(words)
            for _ in range(3):
                at = rng.randrange(60)
                line[at] = "".join(rng.choice(letters) for _ in words[at])
            lines.add(" ".join(line))
        near = next(iter(lines))
        lines.add(near[:-1] + ("q" if near[-1] != "q" else "z"))
        rows = spark.createDataFrame(list(enumerate(sorted(lines))), "id long, line string")
        pairs = line_dedup.candidates(rows, 2).collect()
        names = sorted(lines)
        assert any({names[r.a], names[r.b]} == {near, near[:-1] + ("q" if near[-1] != "q" else "z")} for r in pairs)
        counts.append(len(pairs))
    assert counts[1] < 400  # of 79 800 pairs, nearly all of which share a segment


def test_sketches_bound_edits_in_any_script(spark):
    rng, pairs = random.Random(9), []
    for _ in range(400):
        letters = rng.choice(["abc ", "абв é", "日本語 a", "\U0001f600é\u07ffz"])
        text = "".join(rng.choice(letters) for _ in range(rng.randint(5, 40)))
        other = edited(rng, text, rng.randint(0, 2), letters)
        pairs.append((text, other, distance(text, other)))
    rows = spark.createDataFrame(pairs, "l string, r string, d int").select("d", line_dedup.sketches("l").alias("a"), line_dedup.sketches("r").alias("b"))
    apart = lambda n: F.bit_count(F.col(f"a.{n}").bitwiseXOR(F.col(f"b.{n}")))
    for d, one, two in rows.select("d", apart("one"), apart("two") + apart("three")).collect():
        assert one <= 2 * d and two <= 4 * d


def test_few_hot_keys_stay_exact(spark, monkeypatch):
    monkeypatch.setattr(line_dedup, "HOT_ROWS", 2)
    monkeypatch.setattr(line_dedup, "HOT_KEYS", 3)
    index = spark.createDataFrame([(k % 9 if k < 90 else 100 + k % 2,) for k in range(150)], "key long")
    assert {r.key for r in line_dedup.hot_keys(index).collect()} == {100, 101}


def test_edit_distance_equals_brute_force(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(900):
        letters = rng.choice(["ab", "abé", "abcdefgh "])
        text = "".join(rng.choice(letters) for _ in range(rng.choice([0, 1, 5, 20, 70])))
        pairs.append((text, edited(rng, text, rng.randint(0, 5), letters)))
    rows = spark.createDataFrame(pairs, "l string, r string").selectExpr("l", "r", "cast(l as binary) x", "cast(r as binary) y")
    for most in (1, 2, 3):
        for l, r, d in rows.select("l", "r", line_dedup.edit_distance("x", "y", most)).collect():
            true = distance(l, r)
            assert d == true if true <= most else d > most


def test_no_lines(spark):
    assert line_dedup.line_classes(spark.createDataFrame([], SCHEMA)).count() == 0
    assert line_dedup.line_classes(spark.createDataFrame([(1, None), (2, "\n \n")], SCHEMA)).count() == 0
    with pytest.raises(ValueError):
        line_dedup.line_classes(spark.createDataFrame([], SCHEMA), most=2, min_bytes=2)


def brute_kept(rows):
    """{(row, pos): class}, and of each class the (row, pos) that stays."""
    found = [(k, i, pos, x) for k, (i, text) in enumerate(rows) for pos, line in enumerate((text or "").split("\n")) if (x := line.strip(" \t\r\f\v"))]
    names = sorted({x for *_, x in found})
    root = {x: x for x in names}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(names):
        for y in names[:k]:
            short, long = sorted((len(x.encode()), len(y.encode())))
            if long - short <= 2 and distance(x, y) <= min(2, short // 10):
                root[find(x)] = find(y)
    groups, first = defaultdict(list), {}
    for x in names:
        groups[find(x)].append(hashlib.md5(x.encode()).hexdigest())
    for k, i, pos, x in sorted(found, key=lambda f: (f[1] is None, f[1] or 0, f[2])):
        first.setdefault(find(x), (k, pos))
    return {(k, pos): min(groups[find(x)]) for k, _, pos, x in found}, set(first.values())


def test_members_and_texts_equal_brute_force(spark):
    rows = [r for r in fixture() if r[0] not in (503, 600, 601, 602)]
    rows += [(700, "Accept cookies\n  own line of 700"), (701, "\nAccept cookies.\nno\n"), (702, "no\nnu\nAccept cookies"), (703, "12345678901234567890\n"), (704, "1234567890123456789")]
    classes, first = brute_kept(rows)
    docs = spark.createDataFrame(rows, SCHEMA)
    got = sorted(map(tuple, line_dedup.members(docs).select("doc_id", "pos", "class_id", "kept").collect()), key=repr)
    assert got == sorted(((rows[k][0], pos, c, (k, pos) in first) for (k, pos), c in classes.items()), key=repr)
    texts = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert len(texts) == len(rows)
    for k, (i, text) in enumerate(rows):
        stays = lambda pos: (k, pos) not in classes or (k, pos) in first  # noqa: B023, E731
        kept = None if text is None else "\n".join(x for pos, x in enumerate(text.split("\n")) if stays(pos))
        n = sum(r == k for r, _ in classes)
        assert (texts[i].text, texts[i].n_lines, texts[i].n_kept) == (kept, n, sum(r == k for r, _ in first))
    assert texts[701].text == "\nno\n" and texts[702].text == "nu" and texts[704].text == ""


def test_texts_of_repeated_rows_and_null_ids(spark):
    rows = [(4, "one\ntwo"), (4, "one\ntwo"), (None, "three\none"), (None, "three"), (9, ""), (None, None)]
    got = line_dedup.deduplicated(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.n_kept for r in got) == 3 and sum(r.n_lines for r in got) == 7
    assert sorted((r.text for r in got if r.doc_id == 4), key=len) == ["", "one\ntwo"]
    assert line_dedup.deduplicated(spark.createDataFrame([], SCHEMA)).count() == 0


def test_texts_of_rows_that_share_a_files_row_and_of_a_hot_line(spark, tmp_path):
    rows = [(i, f"the same line in every text\nan own line, {hashlib.md5(bytes([i])).hexdigest()}") for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(f"{tmp_path}/docs")
    docs = spark.read.parquet(f"{tmp_path}/docs")
    plain = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert plain[0].text == rows[0][1] and all(plain[i].text == rows[i][1].split("\n")[1] for i in range(1, 40))
    twice = line_dedup.deduplicated(docs.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))).collect()
    assert len(twice) == 80 and sum(r.n_lines for r in twice) == 160 and sum(r.n_kept for r in twice) == 41
    assert sorted(line for r in twice for line in r.text.split("\n") if line) == sorted({line for _, text in rows for line in text.split("\n")})
