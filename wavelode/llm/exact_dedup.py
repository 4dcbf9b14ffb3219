"""Exact deduplication as a stateful stream with keyed state on disk and full byte checks.

A stream of fingerprints meets a keyed state that never expires: of every digest it holds the largest
id, where that row's text lies (file and row) and how many rows had it. What came again is checked on
full bytes against the text at that place.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HOT, ascii_lower, attach, maybe_in, packed, shared_folder, stored

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def sha256(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def located(docs: DataFrame) -> DataFrame:
    """(doc_id, text, locator): locator is a hash of the Parquet file's name and the row in it.

    Rows that don't come straight from Parquet files are written first, so that each has a place, the
    same one however often and in whatever tasks the rows are read.
    """
    place = F.struct(F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")).alias("locator")
    rows = docs.select("doc_id", "text")
    if "_metadata" not in docs.columns:
        try:
            return docs.select("doc_id", "text", place)
        except AnalysisException:
            pass
    return stored(rows, "dedup-texts").select("doc_id", "text", place)


def fingerprints(texts: DataFrame) -> tuple[DataFrame, str]:
    """(doc_id, digest, locator) of texts, written, and where."""
    path = shared_folder(texts.sparkSession, "dedup-prints")
    prints = texts.select("doc_id", "digest", "locator")
    prints.write.parquet(path)
    return texts.sparkSession.read.schema(prints.schema).parquet(path), path


def stream_state(prints: DataFrame, path: str, files_per_batch: int) -> DataFrame:
    """What the keyed state holds after the stream has read all of path: a row per digest.

    The state store (RocksDB: on local disk, with its change log in the shared checkpoint folder, so
    a lost executor's state is restored elsewhere) keeps digest -> largest (doc_id, locator) and a
    count, with no expiry. Map-side partial aggregation shortens a hot digest before the shuffle.
    Each micro-batch writes the keys it changed; a batch that is run again overwrites its folder.
    """
    spark = prints.sparkSession
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", spark.conf.get("spark.sql.shuffle.partitions"))
    session.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled", "true")
    # With many small stores, files allocated ahead take more disk than the state.
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.allowFAllocate", "false")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.boundedMemoryUsage", "true")
    session.conf.set("spark.sql.streaming.stateStore.rocksdb.maxMemoryUsageMB", "96")
    reader = session.readStream.schema(prints.schema).option("maxFilesPerTrigger", files_per_batch)
    keyed = reader.parquet(path).groupBy("digest").agg(F.max(F.struct("doc_id", "locator")).alias("rep"), F.count("*").alias("n"))
    out = shared_folder(spark, "dedup-keys")
    batches: list[int] = []

    def write(rows: DataFrame, number: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/batch={number}")
        batches.append(number)

    keyed.writeStream.outputMode("update").option("checkpointLocation", shared_folder(spark, "dedup-state")).trigger(
        availableNow=True
    ).foreachBatch(write).start().awaitTermination()
    changed = spark.read.schema(keyed.schema).parquet(out)
    if len(set(batches)) == 1:
        return changed
    # The last state of a key is the one with its largest count.
    return changed.groupBy("digest").agg(F.max_by("rep", "n").alias("rep"), F.max("n").alias("n"))


def byte_check(texts: DataFrame, doubles: DataFrame, total: int) -> DataFrame:
    """The (doc_id, digest, norm) rows of doubled digests whose bytes differ from those at the state's locator.

    texts: (doc_id, digest, norm, locator) of all rows. A bitmap of the doubled digests, of bounded size,
    keeps rows without a double out of the shuffle. A kept text meets its copies by digest and salt:
    the few digests with over 1/HOT of all rows, HOT at most, have their copies dealt over salts.
    """
    near = maybe_in(texts, "digest", doubles)
    hot = doubles.where(F.col("n") > total / HOT).select("digest", F.ceil(F.col("n") * HOT / total).cast("int").alias("salts"))
    near = near.join(F.broadcast(hot), "digest", "left").withColumn("salts", F.coalesce("salts", F.lit(1)))
    near = near.withColumn("salt", F.pmod(F.xxhash64("locator"), F.col("salts")).cast("int"))
    keep = doubles.select("digest", F.col("rep.locator").alias("place"))
    salted_keep = keep.join(F.broadcast(hot), "digest", "left").select(
        "digest", "place", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    )
    met = near.join(salted_keep, ["digest", "salt"])
    kept = met.where(F.col("locator") == F.col("place")).select("digest", F.col("norm").alias("kept_norm"))
    kept = kept.join(F.broadcast(hot), "digest", "left").select(
        "digest", "kept_norm", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1)).alias("salt")
    )
    return met.join(kept, ["digest", "salt"]).where(F.col("norm") != F.col("kept_norm")).select("doc_id", "digest", "norm")


def exact_dedup(
    docs: DataFrame,
    digest: Callable[[Column], Column] = sha256,
    files_per_batch: int | None = None,
    batches: int = 4,
) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, digest (binary).

    Texts are equal when identical after lower-casing A-Z; a null text counts as empty, and empty
    texts are equal to each other. Of equal texts the row with the largest doc_id stays, a null id
    being the smallest; of rows repeated with that id, the one with the largest locator, so exactly
    one row of a group is kept, also where docs repeats rows of a file by a join or an explode. docs needs doc_id and text; other columns are ignored. An empty table
    gives an empty result.

    A fingerprint table (doc_id, digest, locator) is written once; the stream reads it in about
    `batches` micro-batches (or files_per_batch files each) against the keyed state. Digests that came
    again are then checked on full bytes against the text at the state's locator; where two different
    texts share a digest, their groups are formed on the bytes themselves.
    """
    spark = docs.sparkSession
    norm = ascii_lower(F.coalesce("text", F.lit("")))
    hashed = lambda rows: rows.withColumn("norm", norm).withColumn("digest", digest(F.col("norm"))).select("doc_id", "norm", "digest", "locator")
    texts = hashed(located(docs))
    prints, path = fingerprints(texts)
    if prints.select("locator").distinct().count() < prints.count():  # rows that share a file's row, as after a join or an explode
        texts = hashed(located(stored(docs.select("doc_id", "text"), "dedup-texts")))
        prints, path = fingerprints(texts)
    if len(prints.inputFiles()) < batches:  # a table of a few files
        path = shared_folder(spark, "dedup-prints")
        prints.repartition(batches).write.parquet(path)
        prints = spark.read.schema(prints.schema).parquet(path)
    total = prints.count()
    if not total:
        return prints.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "digest")
    groups = stored(stream_state(prints, path, files_per_batch or -(-len(prints.inputFiles()) // batches)).where("n > 1"), "dedup-doubles")

    clashing = stored(byte_check(texts, groups, total).select("digest").distinct(), "dedup-clashes")
    out = attach(prints, groups, "digest", total, "left").select(
        "doc_id",
        F.when(F.col("n").isNull(), F.col("doc_id")).otherwise(F.col("rep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).cast("long").alias("group_size"),
        (F.col("n").isNull() | (F.col("locator") == F.col("rep.locator"))).alias("kept"),
        "digest",
    )
    if clashing.isEmpty():
        return out
    exact = texts.join(clashing, "digest", "left_semi")
    sizes = exact.groupBy("digest", "norm").agg(F.max(F.struct("doc_id", "locator")).alias("rep"), F.count("*").alias("group_size"))
    split = exact.join(sizes, ["digest", "norm"]).withColumn("keep_id", F.col("rep.doc_id")).withColumn("kept", F.col("locator") == F.col("rep.locator"))
    return out.join(clashing, "digest", "left_anti").select(out.columns).unionByName(split.select(out.columns))


def deduplicated(docs: DataFrame, **options) -> DataFrame:
    """docs, all columns, with one row of each group of equal texts: the one exact_dedup() keeps.

    Null and empty texts are equal; of repeated rows one stays; an empty table stays empty; other columns
    may have any name. Only rows that may belong to a group with dropped rows are looked up; the others
    pass as they are.
    """
    marks = stored(exact_dedup(docs, **options).where("group_size > 1"), "dedup-marks")
    rows = packed(docs, "doc_id")
    near = maybe_in(rows, "doc_id", marks).withColumn("digest", sha256(ascii_lower(F.coalesce("row.text", F.lit("")))))
    stays = marks.groupBy(F.col("doc_id").alias("id"), F.col("digest").alias("of")).agg(F.max("kept").alias("kept"))
    found = near.join(stays, F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("digest") == F.col("of")), "left")
    alone = found.where(F.col("kept").isNull()).select("row")
    kept = found.where("kept").dropDuplicates(["doc_id", "digest"]).select("row")
    far = maybe_in(rows, "doc_id", marks, inside=False).select("row")
    return far.unionByName(alone).unionByName(kept).select("row.*")
