"""One row of every group of equal texts stays, whatever plan the rows come from."""

import pytest
from pyspark.sql import functions as F

from wavelode.llm import exact_dedup


def kinds(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet")
    few = docs.where("doc_id < 40")
    yield "bare", docs
    yield "explode", few.withColumn("k", F.explode(F.array(F.lit(1), F.lit(2))))
    yield "join", few.join(spark.createDataFrame([(i % 40, i) for i in range(60)], "doc_id long, other int"), "doc_id")
    yield "other texts of one row", few.select("doc_id", F.explode(F.array(F.lit("One"), F.lit("oNE"), F.col("text"))).alias("text"))
    yield "union", few.unionByName(few)


@pytest.mark.parametrize("constant", [False, True])
def test_exactly_one_row_of_each_group_is_kept(spark, small, constant):
    options = {"digest": lambda text: F.lit(b"same")} if constant else {}
    for name, docs in kinds(spark, small):
        if constant and name == "bare":
            continue
        low = F.lower(F.coalesce("text", F.lit("")))
        want = {r.t: (r.n, r.keep) for r in docs.groupBy(low.alias("t")).agg(F.count("*").alias("n"), F.max("doc_id").alias("keep")).collect()}
        rows = exact_dedup.exact_dedup(docs, **options)
        assert rows.count() == docs.count(), name
        assert rows.where("kept").count() == len(want), name
        assert sorted((r.group_size, r.keep_id) for r in rows.where("kept").collect()) == sorted(want.values()), name
        assert rows.where("kept and doc_id <> keep_id").count() == 0, name
