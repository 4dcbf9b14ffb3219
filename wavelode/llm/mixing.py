"""Mixing sources to target weights with hash-threshold histograms; DataFrame functions only.

Every document has a 60-bit hash of its id. A source takes all documents below a threshold, found
by histograms: words per source and hash bucket, the boundary bucket of each source, then only that
bucket again on finer buckets. Nothing is sorted but the at most 4096 buckets of a source, and a
smaller budget always takes a subset of what a larger one takes.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WORD, packed, stored

HASH_BITS, LEVEL_BITS, SALTS = 60, 12, 32


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def id_hash(doc_id: Column, seed: int) -> Column:
    """The first 60 bits of an MD5, which other SQL engines compute as well."""
    text = F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit(f":{seed}"))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: Sequence[int], share: float, repeats: int) -> DataFrame:
    """(source, source_size, target, base, need): base whole passes over a source, then need words.

    sizes has a row per source, so the two windows over everything hold as many rows as there are
    sources. Targets are share * all words by weight, none above repeats * its source: with sources
    ordered by cap / weight, the first that a common level per weight fits below sets that level.
    """
    place = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last()))
    weight = F.element_at(F.array(*map(F.lit, weights)), ((place - 1) % len(weights) + 1).cast("int"))
    caps = sizes.select("source", "source_size", weight.alias("weight"), place.alias("place")).withColumn(
        "cap", F.col("source_size") * repeats
    )
    line = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    before, everywhere = line.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = F.lit(float(share)) * F.sum("source_size").over(everywhere) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    open_weight = F.sum("weight").over(everywhere) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    levels = caps.withColumn("level", left / open_weight).withColumn("nth", F.row_number().over(line))
    fits = F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("nth"))
    level = F.coalesce(F.min_by("level", fits).over(everywhere), F.lit(float("inf")))
    target = F.least(F.col("cap").cast("double"), level * F.col("weight"))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    return (
        levels.withColumn("target", target)
        .withColumn("base", whole.cast("long"))
        .select("source", "source_size", "target", "base", (F.col("target") - F.col("base") * F.col("source_size")).alias("need"))
    )


def by_source(rows: DataFrame, table: DataFrame) -> DataFrame:
    """rows (with h) and their source's row of table. The salt splits a source with most rows;
    a table that is small when it is planned goes by broadcast on Spark's own size check."""
    salted = table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))).withColumnRenamed("source", "of")
    on = F.col("source").eqNullSafe(F.col("of")) & (F.col("salt") == F.pmod("h", F.lit(SALTS)).cast("int"))
    return rows.join(salted, on).drop("of", "salt")


def thresholds(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """targets with limit: documents with h < limit are taken once more than base times.

    rows: (source, size, h). Each round reads only the rows of each source's boundary bucket; it
    ends when every boundary bucket holds one hash value, after HASH_BITS / LEVEL_BITS rounds at
    most. Of that last value's documents, all or none are taken, whichever comes nearer to need.
    """
    state = targets.select("source", "need", F.lit(0).cast("long").alias("prefix"))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        inside = by_source(rows, state).where(F.shiftright("h", shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(
            F.sum("size").alias("words"), F.min("h").alias("lo"), F.max("h").alias("hi"), F.first("need").alias("need")
        )
        upto = F.sum("words").over(Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
        at = (
            buckets.withColumn("upto", upto)
            .where((F.col("upto") - F.col("words") <= F.col("need")) & (F.col("need") < F.col("upto")))
            .select("source", (F.col("need") - F.col("upto") + F.col("words")).alias("need"), F.col("bucket").alias("prefix"), "words", "lo", "hi")
        )
        state = stored(at, "mix-boundary")
        if state.where("lo < hi").isEmpty():
            break
    ends = state.select(
        F.col("source").alias("of"),
        F.col("lo").alias("edge"),
        F.when(F.col("need") * 2 >= F.col("words"), F.col("lo") + 1).otherwise(F.col("lo")).alias("limit"),
    )
    # No boundary: nothing is needed beyond base passes, or the whole source once more.
    return stored(
        targets.join(ends, F.col("source").eqNullSafe(F.col("of")), "left").select(
            "source", "source_size", "target", "base",
            F.coalesce("limit", F.when(F.col("need") > 0, F.lit(1 << HASH_BITS)).otherwise(0)).alias("limit"),
        ),
        "mix-limits",
    )


def mix_plan(docs: DataFrame, weights=(3, 1, 2), share: float = 1.5, repeats: int = 2, seed: int = 20) -> tuple[DataFrame, DataFrame]:
    """(sizes, limits): doc_id, source, size, h of each document; each source's threshold."""
    sizes = stored(
        docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), id_hash(F.col("doc_id"), seed).alias("h")), "mix-sizes"
    )
    totals = stored(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "mix-totals")
    targets = stored(source_targets(totals, weights, share, repeats), "mix-targets")
    return sizes, thresholds(sizes, targets)


def mix(docs: DataFrame, **options) -> DataFrame:
    """How much of each document the mix takes: doc_id, source, size, source_size, target, copies, taken.

    docs needs doc_id, source and text; other columns are ignored. Null and empty texts have size 0
    and take nothing. A null source is a source of its own, last in order. Documents are taken whole,
    so a source comes within half a document of its target (half of all rows that share one doc_id,
    which share one fate). A document is taken base or base + 1 times, never above `repeats`.
    An empty table gives an empty result.
    """
    sizes, limits = mix_plan(docs, **options)
    copies = F.col("base") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)
    return by_source(sizes, limits).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mixed(docs: DataFrame, seed: int = 20, **options) -> DataFrame:
    """docs as the mix takes them, all columns: each row as often as it has copies (0 times: gone).

    Copies are those of mix(): documents without words are taken as their threshold says, null ids and
    sources too, repeated rows share one fate, an empty table stays empty. Other columns may have any name.
    """
    _, limits = mix_plan(docs, seed=seed, **options)
    rows = packed(docs, "source").withColumn("h", id_hash(F.col("row.doc_id"), seed))
    taken = by_source(rows, limits.select("source", "base", "limit"))
    copies = (F.col("base") + F.when(F.col("h") < F.col("limit"), 1).otherwise(0)).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(1), copies))).select("row.*")
