"""Where a new component belongs: boundaries ranked by words, members, roles and cohesion."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..graph import Graph
from . import counts

#: Weights: a token in the boundary's name, in a member's name, in a member's role; and shares of the parts.
NAME, MEMBER, ROLE, PART = 12, 4, 2, 10


def suggest(g: Graph, text: str, limit: int = 5) -> DataFrame:
    """``id, name, source, score, confidence``; a word matches a token that it starts with.  Cohesion is over all relationships."""
    if len(text.encode()) > 2000:
        raise ValueError("text is over 2000 bytes")
    asked = g.spark.createDataFrame([(text,)], "t string").select(F.explode(T.tokens(F.col("t"))).alias("token"))

    def hits(rows: DataFrame, name: str) -> DataFrame:
        """Tokens that each id's words start with."""
        each = rows.select("id", F.explode(F.array_distinct(T.words(F.col(name)))).alias("word"))
        return each.join(F.broadcast(asked), F.col("word").startswith(F.col("token"))).select("id", "token").distinct()

    by_name = hits(g.boundaries.select("id", "name"), "name").select(F.col("id").alias("boundary_id"), "token")
    member = g.memberships.select(F.col("node_id").alias("id"), "boundary_id")
    in_nodes = hits(g.nodes.join(member.select("id").distinct(), "id", "left_semi").select("id", F.concat_ws(" ", "canonical_name", "display_name").alias("names")), "names").join(member, "id")
    in_roles = hits(g.classifications.select(F.col("node_id").alias("id"), "role"), "role").join(member, "id")
    names = by_name.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("name_hits"))
    nodes = in_nodes.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("member_hits"))
    roles = in_roles.groupBy("boundary_id").agg(F.count(F.lit(1)).alias("role_hits"))
    matched = by_name.unionByName(in_nodes.select("boundary_id", "token")).unionByName(in_roles.select("boundary_id", "token")).groupBy("boundary_id").agg(F.countDistinct("token").alias("matched"))
    sizes = counts.member_counts(g).select(F.col("id").alias("boundary_id"), F.greatest(F.lit(1), "member_count").alias("n"))
    held = counts.cohesion(g, g.edges)
    rows = g.boundaries.withColumnRenamed("id", "boundary_id").join(sizes, "boundary_id")
    for part in (names, nodes, roles, matched, held):
        rows = rows.join(part, "boundary_id", "left")
    rows = rows.na.fill(0, ["name_hits", "member_hits", "role_hits", "matched", "incident", "internal"])
    part = lambda x: F.round(PART * x, 3)
    ratio = F.when(F.col("incident") > 0, F.col("internal") / F.col("incident")).otherwise(0.0)
    score = F.round(F.lit(1.0 * NAME) * F.col("name_hits") + part(MEMBER * F.col("member_hits") / F.col("n")) + part(ROLE * F.col("role_hits") / F.col("n")) + part(ratio), 3)
    sure = F.when(F.col("matched") >= 2, "probable").otherwise("possible")
    return rows.where("matched > 0").select(F.col("boundary_id").alias("id"), "name", "source", score.alias("score"), sure.alias("confidence")).orderBy(F.desc("score"), "source", "name", "id").limit(limit)


def semantic_rank(candidates: DataFrame, ranker: Callable[[DataFrame], DataFrame]) -> tuple[DataFrame, str]:
    """Candidates with a provider's scores added (20 at most each), and what happened.

    The provider gives ``id, similarity`` for every candidate exactly once, in 0 to 1; if it fails in
    any way the order stays as it is and the reason is told.
    """
    try:
        given = ranker(candidates)
        checked = candidates.select("id").join(given, "id", "full_outer").agg(
            F.count(F.lit(1)).alias("rows"), F.countDistinct("id").alias("ids"), F.count(F.when(F.col("similarity").isNull() | ~F.col("similarity").between(0, 1), 1)).alias("bad"),
        ).first()
        if checked["bad"] or checked["rows"] != checked["ids"] or checked["ids"] != candidates.count():
            return candidates, "fallback: incomplete or invalid scores"
    except Exception as e:  # a provider is foreign code: whatever it raises must not fail the query
        return candidates, f"fallback: {type(e).__name__}"
    return candidates.join(given, "id").withColumn("score", F.round(F.col("score") + F.round(20 * F.col("similarity"), 3), 3)).orderBy(F.desc("score"), "id"), "semantic"


def cosine(rows: DataFrame, vector: list[float]) -> DataFrame:
    """``id, similarity`` in 0 to 1 of ``embedding`` to a fixed vector."""
    fixed = F.array(*[F.lit(float(x)) for x in vector])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    size = F.sqrt(dot(F.col("embedding"), F.col("embedding"))) * F.lit(sum(x * x for x in vector) ** 0.5)
    return rows.select("id", F.when(size > 0, (1 + dot(F.col("embedding"), fixed) / size) / 2).otherwise(0.5).alias("similarity"))
