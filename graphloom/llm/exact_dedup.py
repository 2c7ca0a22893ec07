"""Exact deduplication with a heavy-hitter split.

A Misra-Gries sketch over each partition nominates digests that may be frequent.
Sketch rows are summed by digest, so a nominee's exact count is then taken with
map-side combining; at most ``COUNTERS`` verified winners are broadcast.  Rows of a
winner never shuffle: their survivor is known.  What is left has no group above
``2 * rows / COUNTERS`` and goes through an ordinary window by digest.

Defined results.  A null text counts as empty, so all of them form one group.  The
largest ``doc_id`` of a group stays; null ids rank below all others.  Of rows that
repeat both id and text exactly one stays: rows are told apart by a number given
to them when the digest table is written.  An empty table gives an empty result.
Other columns of the input are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import lowered, stored, table

#: Counters of a Misra-Gries sketch, and the most winners that are broadcast (under 100 bytes each).
COUNTERS = 4096


def sketch(batches: Iterator[pa.RecordBatch], counters: int = COUNTERS) -> Iterator[pa.RecordBatch]:
    """Misra-Gries over a partition's digests: every digest above ``rows / (counters + 1)`` is among those yielded."""
    held: dict[bytes, int] = {}
    for batch in batches:
        seen = batch.column(0).value_counts()
        for digest, n in zip(seen.field(0).to_pylist(), seen.field(1).to_pylist(), strict=True):
            held[digest] = held.get(digest, 0) + n
        if len(held) > counters:
            counts = np.fromiter(held.values(), dtype=np.int64, count=len(held))
            cut = int(np.partition(counts, len(counts) - counters - 1)[len(counts) - counters - 1])
            held = {d: n - cut for d, n in held.items() if n > cut}
    if held:
        yield pa.RecordBatch.from_pydict({"digest": pa.array(list(held), pa.binary()), "held": pa.array(list(held.values()), pa.int64())})


def digests(docs: DataFrame) -> DataFrame:
    """``doc_id``, the digest of the normalised text, and a row number; written once."""
    return stored(docs.select("doc_id", F.unhex(F.sha2(lowered(F.col("text")), 256)).alias("digest"), F.monotonically_increasing_id().alias("row")), "digests")


def winners(rows: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """At most ``counters`` digests above their share, with exact size and surviving row."""
    share = F.greatest(F.lit(2), F.floor(F.lit(rows.count()) / F.lit(counters)))
    nominees = (
        rows.select("digest").mapInArrow(lambda it: sketch(it, counters), "digest binary, held long")
        .groupBy("digest").agg(F.sum("held").alias("held"))
        .orderBy(F.desc("held"), "digest").limit(counters).select("digest")
    )
    return (
        rows.join(F.broadcast(nominees), "digest")
        .groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"), F.max(F.struct("doc_id", "row")).alias("keep"))
        .where(F.col("group_size") >= share)
    )


def exact_dedup(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """One row per document: ``doc_id, keep_id, group_size, kept, text_sha256``."""
    rows = digests(docs)
    heavy = stored(winners(rows, counters), "winners")
    split = rows.join(F.broadcast(heavy), "digest", "left")
    known = split.where(F.col("group_size").isNotNull())
    by = Window.partitionBy("digest")
    rest = (
        split.where(F.col("group_size").isNull()).select("doc_id", "digest", "row")
        .withColumn("group_size", F.count(F.lit(1)).over(by))
        .withColumn("keep", F.max(F.struct("doc_id", "row")).over(by))
    )
    return known.select("doc_id", "digest", "row", "group_size", "keep").unionByName(rest.select("doc_id", "digest", "row", "group_size", "keep")).select(
        "doc_id",
        F.col("keep.doc_id").alias("keep_id"),
        "group_size",
        (F.col("row") == F.col("keep.row")).alias("kept"),
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def drop_copies(docs: DataFrame, counters: int = COUNTERS) -> DataFrame:
    """The rows of ``docs`` that stay, with its columns.

    Winners' copies go on the map side.  For the rest a window limit drops copies before
    and after the one shuffle by digest.
    """
    heavy = stored(winners(digests(docs), counters).select("digest", F.col("keep.doc_id").alias("_keep")), "winners")
    columns = [F.col(f"_doc.`{c}`").alias(c) for c in docs.columns]
    marked = (
        docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"))
        .withColumn("_digest", F.unhex(F.sha2(lowered(F.col("_doc.text")), 256)))
    )
    split = marked.join(F.broadcast(heavy.withColumnRenamed("digest", "_digest").withColumn("_heavy", F.lit(True))), "_digest", "left")
    order = Window.partitionBy("_digest").orderBy(F.desc_nulls_last("_doc.doc_id"))
    light = split.where(F.col("_heavy").isNull()).select("_doc", "_digest").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_doc")
    # One row at most per winner passes the filter, but for rows that repeat its id too: the limit on the map side leaves one a task.
    first = split.where(F.col("_heavy") & F.col("_doc.doc_id").eqNullSafe(F.col("_keep"))).select("_doc", "_digest").withColumn("_n", F.row_number().over(order)).where("_n = 1").select("_doc")
    return light.unionByName(first).select(*columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(table(spark, sf_dir, "documents"))


SQL = """
WITH d AS (
  SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER w = 1 AS kept,
       sha256(t) AS text_sha256
FROM d WINDOW w AS (PARTITION BY t ORDER BY doc_id DESC NULLS LAST)
"""
