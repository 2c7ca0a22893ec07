"""Differences between snapshots, quality metrics, gates and trends."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph, is_external, is_script
from ..storage import stored
from . import counts, policy, scc

#: Columns that name the scan and so never count as a change.
IGNORED = ("last_scan_id", "scan_id")


def diff(before: DataFrame, after: DataFrame, key: str = "id", few: DataFrame | None = None) -> DataFrame:
    """One row for each key that differs: ``key, operation`` (added, removed, changed, moved).

    A row whose only difference is ``file_id`` is moved and not changed; with other differences it is both.
    ``few``: that side, the one with few rows, is sent to the other instead of shuffling both; no key may be null or repeat.
    """
    columns = [c for c in before.columns if c != key and c not in IGNORED and c in after.columns]
    rest = [c for c in columns if c != "file_id"]
    pack = lambda df, name: df.select(key, F.struct(*[F.col(c) for c in rest] or [F.lit(1)]).alias(name), (F.col("file_id") if "file_id" in columns else F.lit(None).cast("string")).alias(f"{name}_file"), F.lit(True).alias(f"has_{name}"))
    a, b = pack(before, "a"), pack(after, "b")
    if few is None:
        both = a.join(b, key, "full_outer")
    else:
        # All rows of the larger side with what they meet, and those of the smaller that meet none.
        large, small = (b, a) if few is before else (a, b)
        met = F.broadcast(large.select(key).join(F.broadcast(small.select(key)), key, "left_semi"))
        both = large.join(F.broadcast(small), key, "left").unionByName(small.join(met, key, "left_anti"), allowMissingColumns=True)
    moved = F.col("has_a") & F.col("has_b") & ~F.col("a_file").eqNullSafe(F.col("b_file"))
    changed = F.col("has_a") & F.col("has_b") & ~F.col("a").eqNullSafe(F.col("b"))
    found = F.array(F.when(F.col("has_a").isNull(), "added"), F.when(F.col("has_b").isNull(), "removed"), F.when(changed, "changed"), F.when(moved, "moved"))
    return both.select(F.col(key).alias("key"), F.explode(F.filter(found, lambda x: x.isNotNull())).alias("operation"))


def snapshot_diff(before: dict[str, DataFrame], after: dict[str, DataFrame], max_changes: int = 25) -> DataFrame:
    """The differences of all tables, cut at a budget that runs over tables in order: ``section, operation, key``."""
    S.between("max_changes", max_changes, 1, 1000)
    order = {t: i for i, t in enumerate(S.SNAPSHOT_TABLES)}
    out = None
    for name in [t for t in S.SNAPSHOT_TABLES if t in before]:
        part = diff(before[name], after[name]).select(F.lit(name).alias("section"), F.lit(order[name]).alias("place"), "operation", "key")
        out = part if out is None else out.unionByName(part)
    # Only as many rows as the budget leave each task.
    return out.orderBy("place", "operation", "key").limit(max_changes).drop("place")


def diff_counts(before: DataFrame, after: DataFrame) -> DataFrame:
    return diff(before, after).groupBy("operation").agg(F.count(F.lit(1)).alias("n"))


def rename_candidates(before: DataFrame, after: DataFrame) -> DataFrame:
    """Removed rows that match exactly one added row by kind and display name: ``removed, added``; several may match the same one."""
    gone = before.join(after.select("id"), "id", "left_anti").select("kind", "display_name", F.col("id").alias("removed"))
    new = after.join(before.select("id"), "id", "left_anti").groupBy("kind", "display_name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("added")).where("n = 1")
    return gone.join(new, ["kind", "display_name"]).select("removed", "added")


def confidence_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    both = before.select("id", S.confidence_rank().alias("a")).join(after.select("id", S.confidence_rank().alias("b")), "id")
    return both.agg(F.coalesce(F.sum((F.col("b") > F.col("a")).cast("int")), F.lit(0)).alias("raised"), F.coalesce(F.sum((F.col("b") < F.col("a")).cast("int")), F.lit(0)).alias("lowered"))


#: Missing ends up to which they are sent to the edges.
FEW = 100_000


def _degrees(edges: DataFrame) -> DataFrame:
    """``id, in_degree, out_degree``; every occurrence counts."""
    ends = F.explode(F.array(F.struct(F.col("source_id").alias("id"), F.lit(0).alias("into")), F.struct(F.col("target_id").alias("id"), F.lit(1).alias("into"))))
    return edges.select(ends.alias("e")).groupBy(F.col("e.id").alias("id")).agg(F.sum("e.into").alias("in_degree"), F.sum(1 - F.col("e.into")).alias("out_degree"))


def _with_ends(edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, bool]:
    """The edges of which both ends are among the components, their degrees, and whether that is all of them.

    The ends are looked up once for each component and not for each edge.
    """
    known = edges.where("source_id IS NOT NULL AND target_id IS NOT NULL")
    d = stored(_degrees(edges), "degrees")
    missing = stored(d.join(ids, "id", "left_anti").select("id"), "missing")
    if not (n := missing.count()):
        return edges, d, True
    missing = F.broadcast(missing) if n <= FEW else missing
    for end in ("source_id", "target_id"):
        known = known.join(missing.select(F.col("id").alias(end)), end, "left_anti")
    return known, stored(_degrees(known), "degrees"), False


def quality_metrics(g: Graph, found: DataFrame | None = None) -> DataFrame:
    """One row: cycles, greatest degree of a reportable component, diagnostics, unreferenced components.

    All impact kinds count, whatever their confidence; edges with a missing end do not.  ``found``: the components on
    cycles of all edges, where they are known.
    """
    edges, d, whole = _with_ends(g.following(S.IMPACT_KINDS), g.nodes.select("id"))
    cycles = (found if whole and found is not None else scc.components(edges)).agg(F.countDistinct("component").alias("cycles"))
    roles = g.classifications.groupBy(F.col("node_id").alias("id")).agg(F.max((F.col("role") == S.TEST_ROLE).cast("int")).alias("test"), F.max(F.col("role").isin(S.CONVENTION_ROLES).cast("int")).alias("convention"))
    plain = g.nodes.where(~is_external()).join(roles, "id", "left").where(F.coalesce("test", F.lit(0)) == 0)
    reach = plain.join(d, "id", "left").select("kind", "display_name", "attributes_json", "convention", F.coalesce(F.col("in_degree") + F.col("out_degree"), F.lit(0)).alias("degree"), F.coalesce("in_degree", F.lit(0)).alias("in_degree"))
    made = (F.col("kind") == "method") & F.col("display_name").isin("__construct", "constructor")
    loose = (F.col("in_degree") == 0) & F.col("kind").isin(S.CANDIDATE_KINDS) & ~made & ~is_script() & (F.coalesce("convention", F.lit(0)) == 0)
    nodes = reach.agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.coalesce(F.sum(loose.cast("int")), F.lit(0)).alias("unreferenced_candidates"))
    told = g.diagnostics.agg(F.count(F.when(F.col("severity") == "error", 1)).alias("error_diagnostics"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warning_diagnostics"))
    one = lambda df: df.withColumn("one", F.lit(1))  # noqa: E731  each is a single row
    return one(cycles).join(one(nodes), "one").join(one(told), "one").drop("one")


def quality_by_scan(nodes: DataFrame, edges: DataFrame, classifications: DataFrame, diagnostics: DataFrame) -> DataFrame:
    """``quality_metrics`` of several snapshots at once: every table has a ``scan`` column more, and so has the result.

    Components of different scans have different names, so one search finds the cycles of all.
    """
    named = lambda c: F.concat_ws("|", F.col("scan"), F.col(c))
    edges = edges.where(F.col("kind").isin(S.IMPACT_KINDS)).select("scan", named("source_id").alias("source_id"), named("target_id").alias("target_id"))
    nodes = nodes.withColumn("id", named("id"))
    edges, d, _ = _with_ends(edges, nodes.select("id"))
    cycles = scc.components(edges).groupBy(F.substring_index("component", "|", 1).cast("long").alias("scan")).agg(F.countDistinct("component").alias("cycles"))
    roles = classifications.groupBy(named("node_id").alias("id")).agg(F.max((F.col("role") == S.TEST_ROLE).cast("int")).alias("test"), F.max(F.col("role").isin(S.CONVENTION_ROLES).cast("int")).alias("convention"))
    d = d.select("id", "in_degree", (F.col("in_degree") + F.col("out_degree")).alias("degree"))
    plain = nodes.where(~is_external()).join(roles, "id", "left").where(F.coalesce("test", F.lit(0)) == 0).join(d, "id", "left")
    made = (F.col("kind") == "method") & F.col("display_name").isin("__construct", "constructor")
    loose = (F.coalesce("in_degree", F.lit(0)) == 0) & F.col("kind").isin(S.CANDIDATE_KINDS) & ~made & ~is_script() & (F.coalesce("convention", F.lit(0)) == 0)
    by_node = plain.groupBy("scan").agg(F.coalesce(F.max("degree"), F.lit(0)).alias("max_degree"), F.sum(loose.cast("long")).alias("unreferenced_candidates"))
    told = diagnostics.groupBy("scan").agg(F.count(F.when(F.col("severity") == "error", 1)).alias("error_diagnostics"), F.count(F.when(F.col("severity") == "warning", 1)).alias("warning_diagnostics"))
    return by_node.join(cycles, "scan", "left").join(told, "scan", "left").na.fill(0)


def public_surface(g: Graph) -> DataFrame:
    """Ids of what others see: routes, commands, endpoints and exports, and what a role calls public or an entry point."""
    by_role = g.classifications.where(F.col("role").contains("entry_point") | F.col("role").contains("public")).select(F.col("node_id").alias("id"))
    return g.nodes.where(F.col("kind").isin("route", "command", "endpoint", "export")).select("id").unionByName(by_role).distinct()


#: The budgets of the gate.  Cycles and hubs count as growth over the baseline, the others as they are now.
BUDGETS = ("new_cycles", "boundary_violations", "error_diagnostics", "warning_diagnostics", "hub_degree_growth", "unreferenced_candidates", "public_surface_changes")


def quality_gate(before: Graph, after: Graph, budgets: dict[str, int], policies: Iterable[policy.Policy] = (), found: DataFrame | None = None, clash: DataFrame | None = None) -> DataFrame:
    """``name, actual, budget, passed`` for each budget, from the baseline's graph and the present one.  ``found``, ``clash``: the present one's components on cycles and policy violations, where they are known."""
    if not budgets or set(budgets) - set(BUDGETS):
        raise ValueError(f"budgets must be among {BUDGETS}")
    for name, limit in budgets.items():
        S.between(name, limit, 0, 100_000)
    policies = list(policies)
    if "boundary_violations" in budgets and not policies:
        raise ValueError("boundary_violations needs policies")
    a, b = quality_metrics(before).first(), quality_metrics(after, found).first()
    actual = {"error_diagnostics": b["error_diagnostics"], "warning_diagnostics": b["warning_diagnostics"], "unreferenced_candidates": b["unreferenced_candidates"]}
    actual |= {"new_cycles": max(0, b["cycles"] - a["cycles"]), "hub_degree_growth": max(0, b["max_degree"] - a["max_degree"])}
    if "public_surface_changes" in budgets:
        actual["public_surface_changes"] = counts.public_surface_change(public_surface(before), public_surface(after)).first()["changed"]
    if "boundary_violations" in budgets:
        actual["boundary_violations"] = (policy.violations(after, policies) if clash is None else clash).count()
    out = [(name, int(actual[name]), limit, actual[name] <= limit) for name, limit in budgets.items()]
    return after.spark.createDataFrame(out, "name string, actual long, budget long, passed boolean")


def trends(metrics: DataFrame, limit: int = 10) -> DataFrame:
    """The newest snapshots' metrics, oldest first, with changes.  ``metrics``: scan_id, sequence and numbers."""
    S.between("limit", limit, 2, 20)
    names = [c for c in metrics.columns if c not in ("scan_id", "sequence")]
    newest = metrics.orderBy(F.desc("sequence")).limit(limit)
    order = Window.orderBy("sequence")
    return newest.select("scan_id", "sequence", *names, *[(F.col(c) - F.lag(c).over(order)).alias(f"{c}_change") for c in names]).orderBy("sequence")


def newest(snapshots: DataFrame, keep: int) -> Column:
    return F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("captured_at"), F.desc("scan_id"))) <= keep
