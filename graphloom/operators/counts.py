"""Counts, degrees, cohesion and churn."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph, repository_wide


def count_by(rows: DataFrame, key: str, limit: int = 50) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), key).limit(limit)


def architecture_summary(g: Graph, limit: int = 50) -> DataFrame:
    """Counts by node kind, edge kind, role and language, each cut at ``limit``; ``groups`` tells whether it was."""
    parts = [("node_kind", g.nodes, "kind"), ("edge_kind", g.edges, "kind"), ("role", g.classifications, "role"), ("language", g.nodes, "language")]
    out = None
    for section, rows, key in parts:
        grouped = rows.groupBy(F.col(key).alias("key")).agg(F.count(F.lit(1)).alias("n"))
        order = Window.orderBy(F.desc("n"), "key")
        part = grouped.select(F.lit(section).alias("section"), "key", "n", F.row_number().over(order).alias("k"), F.count(F.lit(1)).over(Window.partitionBy()).alias("groups")).where(F.col("k") <= limit).drop("k")
        out = part if out is None else out.unionByName(part)
    return out


def degree(edges: DataFrame) -> DataFrame:
    """Edge ends per node; a self loop counts twice."""
    return edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("degree"))


def separating(g: Graph) -> DataFrame:
    """Each node's boundaries but those that cover the whole repository: ``id, bs``."""
    narrow = g.boundaries.where(~repository_wide()).select(F.col("id").alias("boundary_id"))
    return g.memberships.join(narrow, "boundary_id").groupBy(F.col("node_id").alias("id")).agg(F.array_sort(F.collect_set("boundary_id")).alias("bs"))


def with_boundaries(g: Graph, edges: DataFrame) -> DataFrame:
    """Edges with the boundary arrays of both ends, null where an end has none."""
    b = separating(g)
    return edges.join(b.select(F.col("id").alias("source_id"), F.col("bs").alias("source_bs")), "source_id", "left").join(b.select(F.col("id").alias("target_id"), F.col("bs").alias("target_bs")), "target_id", "left")


def crosses() -> F.Column:
    """Both ends have boundaries and share none."""
    return F.coalesce(~F.arrays_overlap("source_bs", "target_bs"), F.lit(False))


def degrees(g: Graph, edges: DataFrame) -> DataFrame:
    """Per node ``in_degree, out_degree, cross_degree, inheritance_in``; every occurrence counts."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("into")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("into"))))
    return (
        with_boundaries(g, edges).select(ends.alias("e"), crosses().cast("int").alias("cross"), F.col("kind").isin(S.INHERITANCE_KINDS).cast("int").alias("inherits"))
        .groupBy(F.col("e.id").alias("id"))
        .agg(F.sum("e.into").alias("in_degree"), F.sum(1 - F.col("e.into")).alias("out_degree"), F.sum("cross").alias("cross_degree"), F.sum(F.col("e.into") * F.col("inherits")).alias("inheritance_in"))
    )


def cohesion(g: Graph, edges: DataFrame) -> DataFrame:
    """Per boundary, whole-repository ones too, the edges at it, counted once, and those within it."""
    b = g.memberships.groupBy(F.col("node_id").alias("id")).agg(F.collect_set("boundary_id").alias("bs"))
    ends = edges.join(b.select(F.col("id").alias("source_id"), F.col("bs").alias("source_bs")), "source_id", "left").join(b.select(F.col("id").alias("target_id"), F.col("bs").alias("target_bs")), "target_id", "left")
    pairs = ends.select(F.coalesce("source_bs", F.array().cast("array<string>")).alias("a"), F.coalesce("target_bs", F.array().cast("array<string>")).alias("b"))
    each = pairs.select("a", "b", F.explode(F.array_union("a", "b")).alias("boundary_id"))
    inside = F.expr("array_contains(a, boundary_id) AND array_contains(b, boundary_id)")
    return each.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("incident"), F.sum(inside.cast("int")).alias("internal"))


def member_counts(g: Graph) -> DataFrame:
    return g.boundaries.join(g.memberships.withColumnRenamed("boundary_id", "id"), "id", "left").groupBy("id", "name").agg(F.count("node_id").alias("member_count"))


def churn(commits: DataFrame, max_commits: int = 500) -> DataFrame:
    """Per path over the newest commits: ``commit_count``, sorted distinct authors, latest change.  ``commits``: commit_id, path, author, ts.

    A path counts once per commit.
    """
    S.between("max_commits", max_commits, 1, 5000)
    newest = commits.select("commit_id", "ts").distinct().orderBy(F.desc("ts"), F.desc("commit_id")).limit(max_commits).select("commit_id")
    once = commits.join(F.broadcast(newest), "commit_id", "left_semi").groupBy("commit_id", "path").agg(F.max("author").alias("author"), F.max("ts").alias("ts"))
    return once.groupBy("path").agg(F.count(F.lit(1)).alias("commit_count"), F.array_sort(F.collect_set("author")).alias("authors"), F.max("ts").alias("last_changed_at"))


def language_mix(g: Graph, top: int = 5) -> DataFrame:
    """One line: the languages with most components, and how many more there are."""
    ranked = g.nodes.groupBy("language").agg(F.count(F.lit(1)).alias("n")).withColumn("k", F.row_number().over(Window.orderBy(F.desc("n"), "language")))
    named = F.transform(F.array_sort(F.collect_list(F.when(F.col("k") <= top, F.struct("k", F.concat("language", F.lit(" "), F.col("n").cast("string")).alias("t"))))), lambda x: x["t"])
    line = F.array_join(named, ", ")
    more = F.count(F.lit(1)) - top
    return ranked.agg(F.when(more > 0, F.concat(line, F.lit(", +"), more.cast("string"), F.lit(" more"))).otherwise(line).alias("mix"))


def histogram(rows: DataFrame, key: str) -> DataFrame:
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("n"))


def confidence_histogram(rows: DataFrame) -> DataFrame:
    """Counts by confidence, zeros included."""
    spark = rows.sparkSession
    names = spark.createDataFrame([(c,) for c in S.CONFIDENCES], "confidence string")
    return names.join(rows.groupBy("confidence").agg(F.count(F.lit(1)).alias("n")), "confidence", "left").select("confidence", F.coalesce("n", F.lit(0)).alias("n"))


def public_surface_change(a: DataFrame, b: DataFrame) -> DataFrame:
    """Size of the symmetric difference of two snapshots' ids."""
    one = a.select("id", F.lit(1).alias("a")).join(b.select("id", F.lit(1).alias("b")), "id", "full_outer")
    return one.agg(F.count(F.when(F.col("a").isNull() | F.col("b").isNull(), 1)).alias("changed"))
