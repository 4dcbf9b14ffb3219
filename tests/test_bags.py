"""Distances of word bags: every query with every series, blocks of queries in tasks, no pair in a shuffle."""

import random

from wavelode.functions import symbols


def test_distances_are_those_of_brute_force_for_any_blocks(spark):
    rng = random.Random(4)
    bags = {i: {rng.choice(["aa", "ab", "b", "cc", None]): rng.randint(1, 4) for _ in range(rng.randint(1, 4))} for i in range(40)}
    rows = spark.createDataFrame([(i, w, n) for i, b in bags.items() for w, n in b.items()], "series_id long, word string, n long")
    want = {(q, e): sum((n - (bags[e].get(w, 0) if w is not None else 0)) ** 2 for w, n in bags[q].items()) for q in bags if q % 3 == 0 for e in bags}
    for block in (16_384, 5):
        d = symbols.bag_distance(rows, rows.where("series_id % 3 = 0"), block=block)
        got = d.collect()
        assert len(got) == len(want) and {(r.query_id, r.example_id): r.d for r in got} == want
    plan = d._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # a join on words makes a row of every pair
    assert symbols.bag_distance(rows, rows.where("series_id < 0")).count() == 0
