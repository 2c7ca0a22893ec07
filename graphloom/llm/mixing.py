"""Mixing sources to target weights by hash-threshold histograms.

A document's size is its number of words.  Sources, in code-point order with null last, get the
weights 5, 2, 1 in turn and share 150 % of all words; a source's target stops at twice its own words,
and what is over is shared among the others by weight.  A source then takes every document
``floor(target / words)`` times, and once more those whose hash is below the source's
threshold.  Thresholds come from nested histograms: words are summed by source and by
the hash's leading bits, the one bucket in which the budget ends is refined by the next
bits, until it holds a single hash.  The hash is over id and text, so rows that share it are alike;
where the budget ends among them, the same histograms go on over their row numbers.
Documents are never sorted, and sources are a table like any other, however many there are.

Defined results.  Null texts have size 0, and long texts are counted whole.  The document at the boundary is taken if
that brings the source nearer to its target.  Repeated rows count each by itself.  A source without words has target 0.
An empty table gives an empty result.  Extra columns are ignored by the report and kept by the mix,
whatever their names.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import sent, stored, table

#: Share of all words that the mix takes, the weights in turn, and the most copies of a source.
SHARE, WEIGHTS, COPIES = 1.5, (5, 2, 1), 2
#: Bits of the hash, of row numbers, and those that one level of histograms resolves.
HASH_BITS, ROW_BITS, LEVEL_BITS = 60, 60, 12


def document_hash() -> F.Column:
    whole = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce(F.col("text"), F.lit("")))
    return F.conv(F.substring(F.md5(whole.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def document_size() -> F.Column:
    return F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def same(source: str = "source", other: str = "_s") -> F.Column:
    return F.col(source).eqNullSafe(F.col(other))


def ranked(sources: DataFrame) -> DataFrame:
    """``sources`` with each one's weight, which goes by its place in code-point order."""
    spark = sources.sparkSession
    dealt = stored(sources.repartitionByRange(F.col("source").asc_nulls_last()).withColumn("part", F.spark_partition_id()), "sources")
    # A row for each part, and so few.
    before, offsets = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():
        offsets.append((r["part"], before))
        before += r["count"]
    place = F.row_number().over(Window.partitionBy("part").orderBy(F.col("source").asc_nulls_last())) - 1 + F.col("before")
    weights = F.array(*[F.lit(w) for w in WEIGHTS])
    return dealt.join(F.broadcast(spark.createDataFrame(offsets, "part int, before long")), "part").select("source", "n", F.element_at(weights, (place % len(WEIGHTS)).cast("int") + 1).alias("w"))


def targets(sources: DataFrame) -> DataFrame:
    """``source, source_size, target`` from ``source, n``.

    Sources whose share passes twice their size get that; the rest is shared anew, until no share passes.
    """
    rows = stored(ranked(sources), "weights")
    twice = COPIES * F.col("n")
    level = None
    while True:
        full = F.lit(False) if level is None else twice <= F.col("w") * F.lit(level)
        all_, spent, weight, count = rows.agg(F.sum("n"), F.sum(F.when(full, twice)), F.sum(F.when(~full, F.col("w"))), F.count(F.when(full, 1))).first()
        if not weight:
            return rows.select("source", F.col("n").alias("source_size"), twice.cast("double").alias("target"))
        now = (SHARE * all_ - (spent or 0)) / weight
        if now == level:
            return rows.select("source", F.col("n").alias("source_size"), F.when(full, twice.cast("double")).otherwise(F.col("w") * F.lit(now)).alias("target"))
        level = now


def boundary(rows: DataFrame, column: str, bits: int, open_: DataFrame) -> DataFrame:
    """The value of ``column`` at which each source's budget ends: ``source, value, rows, before, at, rest``.

    ``rows`` has ``source, size`` and the column, ``open_`` has ``source, rest``: the words to take in the
    column's order.  ``before`` are the words below the value, ``at`` those at it.
    """
    now, shift, found = open_.select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("below")), bits, None
    while shift > 0 and not now.isEmpty():
        shift -= LEVEL_BITS
        bounds = sent(now.withColumnRenamed("source", "_s"))
        inside = rows.join(bounds, same()).where(F.shiftright(column, shift + LEVEL_BITS) == F.col("prefix"))
        buckets = inside.groupBy("source", "rest", "below", F.shiftright(column, shift).alias("bucket")).agg(F.sum("size").alias("at"), F.count(F.lit(1)).alias("rows"), F.min(column).alias("low"), F.max(column).alias("high"))
        upto = F.col("below") + F.sum("at").over(Window.partitionBy("source").orderBy("bucket"))
        ends = buckets.withColumn("before", upto - F.col("at")).where(F.col("before") + F.col("at") >= F.col("rest")).groupBy("source").agg(F.min(F.struct("bucket", "before", "at", "rows", "rest", "low", "high")).alias("e"))
        ends = stored(ends.select("source", "e.*"), "ends")
        done = (F.col("low") == F.col("high")) | F.lit(shift == 0)
        part = ends.where(done).select("source", F.col("low").alias("value"), "rows", "before", "at", "rest")
        found = part if found is None else found.unionByName(part)
        now = ends.where(~done).select("source", "rest", F.col("bucket").alias("prefix"), F.col("before").alias("below"))
    return found if found is not None else open_.limit(0).select("source", F.lit(0).cast("long").alias("value"), F.lit(0).cast("long").alias("rows"), F.lit(0).cast("long").alias("before"), F.lit(0).cast("long").alias("at"), "rest")


def _after(value: str) -> F.Column:
    """The threshold just above or at a single row's value, whichever brings the words nearer to the budget."""
    nearer = F.abs(F.col("before") + F.col("at") - F.col("rest")) < F.abs(F.col("before") - F.col("rest"))
    return F.when(nearer, F.col(value) + 1).otherwise(F.col(value))


def plan(sized: DataFrame) -> DataFrame:
    """Per source ``source, source_size, target, base, below, row_below``: whole copies, the hash below which a document is taken once more, and the row number below which one of that very hash is.

    ``sized``: source, size, h, row.
    """
    goal = targets(sized.groupBy("source").agg(F.sum("size").alias("n")))
    base = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("int")
    goal = stored(goal.withColumn("base", base), "targets")
    rest = F.col("target") - F.col("base") * F.col("source_size")
    ends = boundary(sized.select("source", "size", "h"), "h", HASH_BITS, goal.where("source_size > 0").select("source", rest.alias("rest")).where("rest > 0"))
    ends = stored(ends, "hashes")
    tied = ends.where("rows > 1")
    by_hash = ends.select(F.col("source").alias("_s"), F.when(F.col("rows") > 1, F.col("value")).otherwise(_after("value")).alias("below"))
    out = goal.join(sent(by_hash), same(), "left").drop("_s")
    if tied.isEmpty():
        return out.select("*", F.lit(0).cast("long").alias("row_below")).na.fill(0, ["below"])
    alike = sized.join(sent(tied.select(F.col("source").alias("_s"), F.col("value").alias("h"))), ["h"]).where(same()).drop("_s")
    by_row = boundary(alike.select("source", "size", "row"), "row", ROW_BITS, tied.select("source", (F.col("rest") - F.col("before")).alias("rest")))
    return out.join(sent(stored(by_row.select(F.col("source").alias("_s"), _after("value").alias("row_below")), "rows")), same(), "left").drop("_s").na.fill(0, ["below", "row_below"])


def copies() -> F.Column:
    more = (F.col("h") < F.col("below")) | (F.col("h") == F.col("below")) & (F.col("row") < F.col("row_below"))
    return F.col("base") + F.when(more, 1).otherwise(0)


def mixed(docs: DataFrame) -> DataFrame:
    """Per document ``doc_id, size, source_size, target, taken``."""
    sized = stored(docs.select("doc_id", "source", document_size().alias("size"), document_hash().alias("h"), F.monotonically_increasing_id().alias("row")), "sized")
    chosen = stored(plan(sized).withColumnRenamed("source", "_s"), "plan")
    return sized.join(sent(chosen), same()).select("doc_id", "size", "source_size", "target", (F.col("size") * copies()).alias("taken"))


def take(docs: DataFrame) -> DataFrame:
    """The mix: rows of ``docs``, with its columns, as often as they are taken."""
    whole = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc")
    rows = docs.select(whole, F.col("source"), document_size().alias("size"), document_hash().alias("h"), F.monotonically_increasing_id().alias("row"))
    chosen = stored(plan(stored(rows.drop("_doc"), "sized")), "plan")
    if not chosen.where("row_below > 0").isEmpty():
        # Rows that are alike in all that counts are told apart by number, so the numbers have to be those that the plan saw.
        rows = stored(rows, "numbered")
        chosen = stored(plan(rows.drop("_doc")), "plan")
    chosen = chosen.select(F.col("source").alias("_s"), "base", "below", "row_below")
    many = rows.join(sent(chosen), same()).select("_doc", copies().alias("_n")).where("_n > 0")
    return many.select("_doc", F.explode(F.sequence(F.lit(1), F.col("_n")))).select(*[F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(table(spark, sf_dir, "documents"))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 15) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS n, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM d GROUP BY source),
w AS (SELECT *, CASE i % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w FROM s),
f AS (
  SELECT *, (1.5::DOUBLE * sum(n) OVER () - coalesce(sum(2 * n) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level,
         row_number() OVER o AS k
  FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * n / w, source NULLS LAST)),
c AS (SELECT *, min(CASE WHEN 2 * n > w * level THEN k END) OVER () AS cut FROM f),
t AS (SELECT source, n, CASE WHEN cut IS NULL OR k < cut THEN 2.0::DOUBLE * n ELSE w * (max(CASE WHEN k = cut THEN level END) OVER ()) END AS target FROM c),
p AS (SELECT *, CASE WHEN n > 0 THEN CAST(floor(target / n) AS BIGINT) ELSE 0 END AS base FROM t),
r AS (SELECT d.doc_id, d.size, p.n, p.target, p.base, p.target - p.base * p.n AS rest, sum(size) OVER (PARTITION BY d.source ORDER BY h ROWS UNBOUNDED PRECEDING) AS after_
      FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source),
x AS (SELECT *, CASE WHEN rest <= 0 THEN 0 WHEN after_ < rest THEN 1 WHEN after_ - size < rest AND abs(after_ - rest) < abs(after_ - size - rest) THEN 1 ELSE 0 END AS more FROM r)
SELECT doc_id, size, n AS source_size, target, CAST(size * (base + more) AS BIGINT) AS taken FROM x
"""
