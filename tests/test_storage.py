"""Tables on the way go, results stay."""

import os

from wavelode.sources import storage


def paths(df):
    return [name.removeprefix("file:").removeprefix("//") for name in df.inputFiles()]


def test_distilled_keeps_only_results(spark):
    seen = {}

    def inner():
        seen["a"] = storage.stored(spark.range(5), "a")
        return seen["a"].where("id > 1")

    def outer():
        seen["b"] = storage.distilled(inner, "b")
        seen["files"] = paths(seen["b"])
        assert all(map(os.path.exists, seen["files"])) and not any(map(os.path.exists, paths(seen["a"])))
        return seen["b"].where("id > 2")

    got = storage.distilled(outer, "c")
    assert sorted(r.id for r in got.collect()) == [3, 4]
    assert not any(map(os.path.exists, seen["files"]))
    kept = storage.stored(spark.range(3), "d")
    assert kept.count() == 3 and storage.WRITTEN.get() is None
