"""Session helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import stored

__all__ = ["crc_mod", "lowered", "sent", "small_batches", "stored", "table"]

#: Rows of the batches that Python workers get: what bounds their memory, and that of the buffers filled for them.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rows of a few numbers each that are broadcast at most, after they were counted.
SENT_ROWS = 500_000


def sent(rows: DataFrame) -> DataFrame:
    """A stored table that is broadcast if it has few rows; beyond it the join shuffles both sides."""
    return F.broadcast(rows) if rows.count() <= SENT_ROWS else rows


def lowered(text) -> F.Column:
    """Null-free text with A-Z lower-cased, and nothing else."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def crc_mod(column, modulus: int) -> F.Column:
    """``crc32`` of an id's decimal text, modulo; null ids count as the empty text."""
    return F.crc32(F.coalesce(column.cast("string"), F.lit("")).cast("binary")) % modulus
