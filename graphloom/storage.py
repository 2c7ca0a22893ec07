"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: By application: the folder of a session on one machine that names none.
_OWN: dict[str, str | None] = {}


OPEN_FILES, MOST_OPEN = "spark.sql.maxConcurrentOutputFileWriters", "12"


def scratch_dir(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``.  Where it is unset a session on this machine alone gets a folder of its own; on a cluster that would lose data."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext._jsc.sc()
    if not shared and context.getCheckpointDir().isDefined():
        shared = context.getCheckpointDir().get()
    if not shared:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        shared = _OWN.setdefault(spark.sparkContext.applicationId, None) or tempfile.mkdtemp(prefix="graphloom-")
        _OWN[spark.sparkContext.applicationId] = shared
    return shared.rstrip("/")


def written(df: DataFrame, path: str, by: str | None = None, dense: bool = False) -> None:
    """``df`` as Parquet under a path.

    ``by``: a column of few values to part the files by.  ``dense``: by Zstandard, for long tables whose ids are mostly digits, which the
    default leaves as they are; tables of names would look so small that a join might broadcast them.
    """
    out = df.write.option("compression", "zstd") if dense else df.write
    if not by:
        out.parquet(path)
        return
    # A file stays open for each value, so that a task's rows needn't be sorted by it; tasks that meet more values sort the rest.
    spark = df.sparkSession
    before = spark.conf.get(OPEN_FILES, "0")
    spark.conf.set(OPEN_FILES, MOST_OPEN)
    try:
        out.partitionBy(by).parquet(path)
    finally:
        spark.conf.set(OPEN_FILES, before)


def stored(df: DataFrame, name: str, by: str | None = None, dense: bool = False) -> DataFrame:
    """``df`` written once as Parquet and read again: it cuts lineage and survives lost executors.  ``by``, ``dense``: as ``written`` takes them."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/{name}-{uuid.uuid4().hex}"
    written(df, path, by, dense)
    out = spark.read.schema(df.schema).parquet(path)
    # Reading puts the column that parts the files last.
    return out.select(*[f"`{c}`" for c in df.columns]) if by else out
