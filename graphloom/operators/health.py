"""Hubs, hotspots and dead-code candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph, is_external, is_script
from ..functions.text import owner_of
from ..storage import stored
from . import counts, scc
from .traverse import closure

CONVENTION_ROLES = S.CONVENTION_ROLES


def _marked(g: Graph) -> DataFrame:
    """Nodes with the reportability predicates as columns."""
    roles = g.classifications.groupBy(F.col("node_id").alias("id")).agg(F.max((F.col("role") == S.TEST_ROLE).cast("int")).alias("t"), F.max(F.col("role").isin(CONVENTION_ROLES).cast("int")).alias("c"), F.max((F.col("role").startswith("laravel.") | F.col("origin").startswith("framework_")).cast("int")).alias("f"))
    return g.nodes.join(roles, "id", "left").select(
        "id", "kind", "canonical_name", "display_name", g.nodes["origin"], is_external().alias("external"), (F.coalesce("t", F.lit(0)) == 1).alias("test"),
        (F.coalesce("c", F.lit(0)) == 1).alias("convention"), (F.coalesce("f", F.lit(0)) == 1).alias("framework"), is_script().alias("script"),
    )


def hubs(g: Graph, kinds: list[str] | None = None, min_confidence: str = "possible", limit: int = 20, include_external: bool = False, include_tests: bool = False) -> DataFrame:
    """Components by degree, then name."""
    d = counts.degrees(g, g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence))
    rows = _marked(g).join(d, "id").withColumn("score", F.col("in_degree") + F.col("out_degree")).where("score > 0")
    rows = rows if include_external else rows.where("not external")
    rows = rows if include_tests else rows.where("not test")
    return rows.select("id", "canonical_name", "in_degree", "out_degree", "cross_degree", "score").orderBy(F.desc("score"), "canonical_name", "id").limit(limit)


def hotspots(g: Graph, kinds: list[str] | None = None, min_confidence: str = "possible", limit: int = 20, include_external: bool = False, include_tests: bool = False) -> DataFrame:
    """Degree, twice the cross-boundary degree, and three for being in a cycle."""
    edges = g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence)
    cyclic = scc.components(edges).select("id", F.lit(3).alias("cycle"))
    rows = _marked(g).join(counts.degrees(g, edges), "id").join(cyclic, "id", "left")
    rows = rows.withColumn("score", F.col("in_degree") + F.col("out_degree") + 2 * F.col("cross_degree") + F.coalesce("cycle", F.lit(0))).where("in_degree + out_degree > 0")
    rows = rows if include_external else rows.where("not external")
    rows = rows if include_tests else rows.where("not test")
    return rows.select("id", "canonical_name", "cross_degree", F.col("cycle").isNotNull().alias("in_cycle"), "score").orderBy(F.desc("score"), "canonical_name", "id").limit(limit)


def excluded_before_ranking(g: Graph, kinds: list[str] | None = None) -> DataFrame:
    """How many components the hub list leaves out, external ones counted first."""
    d = counts.degrees(g, g.following(S.kinds_of(kinds, S.IMPACT_KINDS))).where("in_degree + out_degree > 0")
    return _marked(g).join(d, "id", "left_semi").agg(F.sum(F.col("external").cast("int")).alias("external"), F.sum((F.col("test") & ~F.col("external")).cast("int")).alias("tests"))


def suppressed(name: str, patterns: list[str]) -> F.Column:
    """Exact names, or a prefix where the pattern ends in ``*``."""
    out = F.lit(False)
    for p in patterns:
        out = out | (F.col(name).startswith(p[:-1]) if p.endswith("*") else F.col(name) == p)
    return out


def owners(g: Graph) -> DataFrame:
    """Each member's containing type by the ``contains`` relationship; of several the greatest edge counts."""
    return g.edges.where("kind = 'contains'").groupBy(F.col("target_id").alias("member")).agg(F.max_by("source_id", "id").alias("owner"))


def inherited_members(g: Graph, members: DataFrame, max_depth: int = 20) -> DataFrame:
    """Of ``members`` (``id, display_name, owner``) those whose owner has an ancestor: ``id, inherited`` (an internal ancestor has a member of that name) and ``external`` (the first external ancestor)."""
    up = closure(g.edges.where(F.col("kind").isin("implements", "extends", "returns")).select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")), max_depth, members.select(F.col("owner").alias("child")))
    mine = members.join(up.select(F.col("child").alias("owner"), "ancestor"), "owner").select(F.col("id").alias("member"), "display_name", "ancestor")
    kinds = g.nodes.select(F.col("id").alias("ancestor"), is_external().alias("ext"))
    theirs = contained_names(g, mine.select(F.col("ancestor").alias("id"))).select(F.col("id").alias("ancestor"), "display_name", F.lit(True).alias("has"))
    joined = mine.join(kinds, "ancestor", "left").join(theirs, ["ancestor", "display_name"], "left").withColumn("ext", F.coalesce("ext", F.lit(True)))
    return joined.groupBy(F.col("member").alias("id")).agg(F.max(F.coalesce("has", F.lit(False)) & ~F.col("ext")).alias("inherited"), F.min(F.when(F.col("ext"), F.col("ancestor"))).alias("external_ancestor"))


def contained_names(g: Graph, owners_: DataFrame) -> DataFrame:
    """Names of what the owners (``id``) contain: ``id, display_name``."""
    inside = g.edges.where("kind = 'contains'").join(owners_.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return inside.join(g.nodes.select(F.col("id").alias("target_id"), "display_name"), "target_id").select(F.col("source_id").alias("id"), "display_name").distinct()


#: Types and names of one owner are paired by chunks of about so many, and pairs of chunks are dealt over so many tasks at most.
CHUNK, MOST_TASKS = 4096, 10_000


def subtype_member_names(g: Graph) -> DataFrame:
    """Names that direct subtypes of a type have as members: ``id`` of the type, ``display_name``.

    A type whose subtypes with members are one alone has each of that subtype's names once, so its pairs are made from chunks of
    types and of names and aren't shuffled.  Where several subtypes may share a name the pairs are compared.  A task holds one chunk of names and
    the pairs of one type with it; how many tasks there are follows from the pairs of chunks, however few bytes these have.
    """
    names = stored(owners(g).join(g.nodes.select(F.col("id").alias("member"), "display_name"), "member").select("owner", "display_name").distinct(), "members")
    direct = g.edges.where(F.col("kind").isin(S.INHERITANCE_KINDS)).select(F.col("target_id").alias("id"), F.col("source_id").alias("owner")).distinct()
    direct = direct.join(names.select("owner").distinct(), "owner", "left_semi")
    counted = stored(direct.groupBy("id").agg(F.count(F.lit(1)).alias("n"), F.min("owner").alias("owner")), "subtypes")
    several = direct.join(counted.where("n > 1").select("id"), "id", "left_semi").join(names, "owner").select("id", "display_name").distinct()

    alone = counted.where("n = 1").select("owner", "id")
    parts = lambda rows, name: rows.groupBy("owner").agg(F.ceil(F.count(F.lit(1)) / CHUNK).alias(name))
    sizes = stored(parts(alone, "type_parts").join(parts(names, "name_parts"), "owner"), "sizes")
    tasks = max(1, min(3 * (sizes.agg(F.sum(F.col("type_parts") * F.col("name_parts"))).first()[0] or 0), MOST_TASKS))
    part = lambda item, of: F.expr(f"pmod(xxhash64({item}), {of})")
    every = lambda of: F.explode(F.sequence(F.lit(0).cast("long"), F.col(of) - 1))
    pair = ["owner", "type_part", "name_part"]
    types = alone.join(sizes, "owner").select("owner", part("id", "type_parts").alias("type_part"), every("name_parts").alias("name_part"), "id").repartition(tasks, *pair)
    chunks = names.join(sizes, "owner").groupBy("owner", "type_parts", part("display_name", "name_parts").alias("name_part")).agg(F.collect_list(F.struct("display_name")).alias("display_names"))
    chunks = chunks.select("owner", every("type_parts").alias("type_part"), "name_part", "display_names").repartition(tasks, *pair)
    return types.join(chunks.hint("shuffle_hash"), pair).select("id", F.explode("display_names").alias("name")).select("id", "name.display_name").unionByName(several)


def dead_code(g: Graph, kinds: list[str] | None = None, min_confidence: str = "possible", suppress: list[str] | None = None) -> DataFrame:
    """Components without incoming relationships, each with the first reason that clears it, or null for a candidate.

    Inheritance, contracts and the engine's own calls clear methods only.  Candidates come first, so that the walk up the
    types starts from their owners alone.  Columns ``id, canonical_name, reason, confidence``.
    """
    edges = g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence)
    d = stored(counts.degrees(g, edges).select("id", "in_degree", "inheritance_in"), "degrees")
    marked = _marked(g).join(d, "id", "left").withColumn("in_degree", F.coalesce("in_degree", F.lit(0)))
    base = stored(marked.where(F.col("in_degree") == 0).where(F.col("kind").isin(S.CANDIDATE_KINDS)).where("not external and not convention"), "unreferenced")
    marks = g.annotations.where("kind = 'false_positive'").select("canonical_name").distinct().withColumn("fp", F.lit(True))
    methods = stored(base.where("kind = 'method'").select("id", "display_name").join(owners(g).withColumnRenamed("member", "id"), "id"), "methods")
    used = d.select(F.col("id").alias("owner"), (F.col("in_degree") > F.coalesce("inheritance_in", F.lit(0))).alias("owner_used"))
    contract = subtype_member_names(g).select(F.col("id").alias("owner"), "display_name", F.lit(True).alias("in_contract"))
    context = methods.join(used, "owner", "left").join(contract, ["owner", "display_name"], "left").join(inherited_members(g, methods), "id", "left").drop("display_name", "owner")
    # The engine calls a constructor of a type that something refers to; the type is known by the method's own name.
    types = g.nodes.groupBy("canonical_name").agg(F.max("id").alias("type_id")).join(d.where("in_degree > 0").select(F.col("id").alias("type_id")), "type_id").select(F.col("canonical_name").alias("type_name"), F.lit(True).alias("type_referenced"))
    rows = base.withColumn("type_name", F.when(F.col("kind") == "method", owner_of(F.col("canonical_name")))).join(types, "type_name", "left").join(marks, "canonical_name", "left").join(context, "id", "left")
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    reason = (
        F.when(suppressed("canonical_name", suppress or []), "suppressed").when(yes("fp"), "annotated").when(yes("inherited"), "inherited")
        .when(yes("in_contract") & yes("owner_used"), "contract")
        .when(((F.col("display_name") == "constructor") | F.col("display_name").startswith("__")) & yes("type_referenced"), "engine_invoked")
        .when(F.col("script"), "executable_script")
    )
    sure = F.when((F.col("origin") != "ast") | F.col("framework") | F.col("external_ancestor").isNotNull(), "possible").otherwise("probable")
    return rows.select("id", "canonical_name", reason.alias("reason"), sure.alias("confidence"))
