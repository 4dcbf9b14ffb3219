"""Clashing names, ids of other types, nulls, empty tables, repeated rows and very long texts."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from wavelode.llm import common, exact_dedup, language_id, line_dedup, mixing, pieces, quality, simhash, toxicity

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
#: Names that the operators use themselves, or did.
CLASHING = "of h _h salt _salt limit _limit base _base _copy copy copies taken row key n fp digest _digest _mark _kept kept id _id _bit _slot _mask rep locator norm size score predicted held_out component_id gone _gone label ids".split()


@pytest.fixture(scope="module")
def docs(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "omega", "rho", "tau"]
    rows = [(k, " ".join(rng.choice(words) for _ in range(rng.randint(5, 30))), "en", rng.choice(["a", "b", None])) for k in range(40)]
    rows += [(100 + k, rows[k][1].upper(), "en", "a") for k in range(6)] + [(7, rows[7][1], "en", "b")] * 2
    rows += [(200, None, None, None), (201, "", "en", "a"), (202, "w " * 200_000, "en", "a"), (None, "no id here at all", None, "b"), (None, None, None, None)]
    return spark.createDataFrame([(i, t, lang, s, len(t or "")) for i, t, lang, s in rows], SCHEMA)


def labels_of(spark, kind="long"):
    return spark.createDataFrame([(k, k % 2, k % 2) for k in range(40)], "doc_id long, quality int, toxic int").withColumn("doc_id", F.col("doc_id").cast(kind))


STAGES = {
    "toxicity": lambda d, labels: toxicity.without_toxic(d, labels),
    "exact": lambda d, labels: exact_dedup.deduplicated(d),
    "near": lambda d, labels: simhash.near_deduplicated(d),
    "mix": lambda d, labels: mixing.mixed(d),
}


@pytest.mark.parametrize("name", STAGES)
def test_clashing_columns_come_back_unchanged(spark, docs, name):
    wide = docs.select("*", *[F.concat(F.lit(f"{c}:"), F.coalesce(F.substring("text", 1, 30), F.lit("null"))).alias(c) for c in CLASHING])
    wide = wide.withColumn("a.dot", F.lit(1))
    out = STAGES[name](wide, labels_of(spark))
    assert out.columns == wide.columns and out.dtypes == wide.dtypes
    rows = out.collect()
    assert rows and all(r[c] == f"{c}:" + ((r.text or "")[:30] if r.text is not None else "null") for r in rows for c in CLASHING)
    plain = STAGES[name](docs, labels_of(spark))
    assert Counter((r.doc_id, r.text) for r in rows) == Counter((r.doc_id, r.text) for r in plain.collect())


@pytest.mark.parametrize("name", STAGES)
def test_stages_of_empty_tables(spark, docs, name):
    assert STAGES[name](docs.limit(0), labels_of(spark)).count() == 0
    assert STAGES[name](docs, labels_of(spark).limit(0)).columns == docs.columns


def test_ids_may_be_text(spark, docs):
    named = docs.withColumn("doc_id", F.concat(F.lit("doc-"), F.lpad(F.col("doc_id").cast("string"), 4, "0")))
    labels = labels_of(spark, "string").withColumn("doc_id", F.concat(F.lit("doc-"), F.lpad("doc_id", 4, "0")))
    n = docs.count()
    vocabulary = pieces.Vocabulary.load()
    same = lambda a, b, *columns: Counter(map(tuple, a.select(*columns).collect())) == Counter(map(tuple, b.select(*columns).collect()))
    assert same(simhash.near_dedup(named), simhash.near_dedup(docs), "fp", "kept")
    assert same(line_dedup.line_classes(named), line_dedup.line_classes(docs), "line_md5", "n", "n_links", "class_id")
    assert same(exact_dedup.exact_dedup(named), exact_dedup.exact_dedup(docs), "digest", "group_size", "kept")
    for out in (language_id.language_id(named), quality.quality(named, labels), toxicity.toxicity(named, labels), pieces.digests(named, vocabulary), mixing.mix(named)):
        assert out.count() == n and dict(out.dtypes)["doc_id"] == "string"
    back = pieces.decode(pieces.encode(named, vocabulary), vocabulary)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text) for r in named.collect())


def test_whole_pipeline_on_awkward_rows(spark, docs, tmp_path):
    import corpus_pipeline

    folder = str(tmp_path)
    docs.write.parquet(f"{folder}/documents.parquet")
    labels_of(spark).write.parquet(f"{folder}/labels.parquet")
    out = corpus_pipeline.run(spark, folder).collect()
    assert out and all(r.doc_id is None or r.ids is not None or r.doc_id == 200 for r in out)
    assert {r.doc_id for r in out} <= {r.doc_id for r in docs.collect()}
    empty = f"{folder}/empty"
    docs.limit(0).write.parquet(f"{empty}/documents.parquet")
    labels_of(spark).limit(0).write.parquet(f"{empty}/labels.parquet")
    assert corpus_pipeline.run(spark, empty).count() == 0


def test_samples_are_whole_where_hashes_repeat(spark):
    rows = spark.range(3000).select((F.when(F.col("id") < 2900, 7).otherwise(F.col("id"))).alias("v"))
    got = common.smallest(rows, F.xxhash64("v"), 500, "v")
    assert got.count() == 500 and common.smallest(rows, F.xxhash64("v"), 5000, "v").count() == 3000


def test_a_cluster_must_name_its_folder():
    class Cluster:
        master = "spark://host:7077"
        conf = type("Conf", (), {"get": staticmethod(lambda name, default=None: None)})()

        def getCheckpointDir(self):  # noqa: N802
            return None

    session = Cluster()
    session.sparkContext = session
    with pytest.raises(RuntimeError):
        common.shared_folder(session, "x")
