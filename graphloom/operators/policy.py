"""Boundary policies."""

from __future__ import annotations

from collections.abc import Iterable
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph

UNASSIGNED = "@unassigned"


class Policy(NamedTuple):
    id: str
    from_boundary: str
    allow_targets: tuple[str, ...] = ()
    deny_targets: tuple[str, ...] = ()
    edge_kinds: tuple[str, ...] = ()


def resolve_boundary(g: Graph, name: str) -> str:
    """A boundary's id, by id or else by a name that only one has."""
    if name == UNASSIGNED:
        return name
    rows = [r["id"] for r in g.boundaries.where((F.col("id") == name) | (F.col("name") == name)).select("id").distinct().limit(3).collect()]
    if name in rows:
        return name
    if len(rows) != 1:
        raise ValueError(f"boundary {name!r} is {'ambiguous' if rows else 'unknown'}")
    return rows[0]


def policy_table(g: Graph, policies: Iterable[Policy]) -> DataFrame:
    """Policies as a table of 50 rows at most, with boundary ids."""
    rows = []
    for p in policies:
        kinds = S.kinds_of(list(p.edge_kinds), S.IMPACT_KINDS)
        if not p.allow_targets and not p.deny_targets:
            raise ValueError(f"policy {p.id!r} neither allows nor denies a target")
        rows.append((p.id, resolve_boundary(g, p.from_boundary), [resolve_boundary(g, t) for t in p.allow_targets], [resolve_boundary(g, t) for t in p.deny_targets], kinds))
    S.between("policies", len(rows), 1, 50)
    return g.spark.createDataFrame(rows, "policy_id string, from_boundary string, allow array<string>, deny array<string>, kinds array<string>")


def violations(g: Graph, policies: Iterable[Policy], min_confidence: str = "possible") -> DataFrame:
    """Every edge and policy that clash: ``policy_id, edge_id, kind, source_id, target_id, reasons``.

    Each edge meets each of the few policies once, in a broadcast join on the boundary it leaves.
    """
    table = policy_table(g, policies)
    wanted = sorted({k for p in policies for k in (p.edge_kinds or S.IMPACT_KINDS)})
    member = g.memberships.groupBy(F.col("node_id").alias("id")).agg(F.collect_set("boundary_id").alias("bs"))
    none = F.array(F.lit(UNASSIGNED))
    edges = (
        g.following(wanted, min_confidence)
        .join(member.select(F.col("id").alias("source_id"), F.col("bs").alias("sb")), "source_id", "left").join(member.select(F.col("id").alias("target_id"), F.col("bs").alias("tb")), "target_id", "left")
        .withColumn("sb", F.coalesce("sb", none)).withColumn("tb", F.coalesce("tb", none))
    )
    met = edges.select("*", F.explode("sb").alias("from_boundary")).join(F.broadcast(table), "from_boundary").where(F.array_contains("kinds", F.col("kind")))
    denied = F.arrays_overlap("tb", "deny")
    outside = (F.size("allow") > 0) & ~F.array_contains("tb", F.col("from_boundary")) & ~F.arrays_overlap("tb", "allow")
    reasons = F.array_join(F.filter(F.array(F.when(denied, "denied_target"), F.when(outside, "target_not_allowed")), lambda x: x.isNotNull()), ",")
    return met.withColumn("reasons", reasons).where("reasons <> ''").select("policy_id", F.col("id").alias("edge_id"), "kind", "source_id", "target_id", "reasons")
