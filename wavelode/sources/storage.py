"""Results that are used more than once, written where all executors can read them."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable
from contextvars import ContextVar

from pyspark.sql import DataFrame, SparkSession

#: What stored() has written since distilled() began; None outside it.
WRITTEN: ContextVar[list[str] | None] = ContextVar("written", default=None)


def stored(df: DataFrame, label: str) -> DataFrame:
    """df as Parquet below spark.checkpoint.dir, read again: computed once, with its lineage cut.

    A local folder takes the setting's place only where it is absent and all tasks run in this process.
    """
    path = shared_folder(df.sparkSession, label)
    df.write.parquet(path)
    if (written := WRITTEN.get()) is not None:
        written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def shared_folder(spark: SparkSession, label: str) -> str:
    """A new path below spark.checkpoint.dir; an error on a cluster that doesn't name one."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="wavelode-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def distilled(make: Callable[[], DataFrame], label: str) -> DataFrame:
    """make()'s rows, stored; the tables that stored() wrote meanwhile are then deleted.

    Until the result is written whole they stay, so tasks of a lost executor can run again. Nothing
    that make() leaves behind but its rows may read them.
    """
    token = WRITTEN.set([])
    try:
        rows = make()
        between = list(WRITTEN.get())
        result = stored(rows, label)
        kept = WRITTEN.get()[len(between) :]
    finally:
        WRITTEN.reset(token)
    if (outer := WRITTEN.get()) is not None:
        outer.extend(kept)
    delete(result.sparkSession, between)
    return result


def delete(spark: SparkSession, paths: list[str]) -> None:
    """Removes folders of the shared file system, whatever kind it is."""
    for path in paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
