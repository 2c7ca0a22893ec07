"""Change impact, test selection and review."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph
from ..storage import stored
from . import counts, policy, scc, snapshot, traverse


def change_impact(g: Graph, symbol: DataFrame, commits: DataFrame, max_depth: int = 4, max_commits: int = 500, kinds: list[str] | None = None) -> DataFrame:
    """Dependants and the symbol itself by churn and nearness: three per commit, one per author, and what is left of the depth."""
    near = traverse.impact(g, symbol, max_depth, kinds).select("id", "distance").unionByName(symbol.select("id", F.lit(0).alias("distance")))
    churn = counts.churn(commits, max_commits).select(F.col("path").alias("relative_path"), "commit_count", F.size("authors").alias("authors"))
    rows = near.join(g.nodes.select("id", "canonical_name", "file_id"), "id").join(g.files.select(F.col("id").alias("file_id"), "relative_path"), "file_id", "left").join(churn, "relative_path", "left")
    filled = rows.withColumn("commit_count", F.coalesce("commit_count", F.lit(0))).withColumn("authors", F.coalesce("authors", F.lit(0)))
    score = 3 * F.col("commit_count") + F.col("authors") + F.greatest(F.lit(0), max_depth + 1 - F.col("distance"))
    return filled.select("id", "canonical_name", "distance", "commit_count", "authors", score.alias("score")).orderBy(F.desc("score"), "distance", "canonical_name", "id")


def direct_nodes(g: Graph, paths: list[str]) -> DataFrame:
    """All components in the changed files."""
    S.between("files", len(paths), 1, 50)
    files = g.files.where(F.col("relative_path").isin(paths)).select(F.col("id").alias("file_id"))
    return g.nodes.join(files, "file_id", "left_semi").select("id")


def changed_files_impact(g: Graph, paths: list[str], max_depth: int = 4, limit: int = 100, kinds: list[str] | None = None) -> DataFrame:
    """Dependants of any changed component at their smallest distance: ``id, canonical_name, distance, seed``."""
    found = traverse.nearest_impact(g, direct_nodes(g, paths), max_depth, kinds)
    return found.join(g.nodes.select("id", "canonical_name"), "id").select("id", "canonical_name", "distance", "seed").orderBy("distance", "canonical_name", "id").limit(limit)


def test_impact(g: Graph, paths: list[str], max_depth: int = 4, kinds: list[str] | None = None) -> DataFrame:
    """Test files to run: least distance and the first three test names of each."""
    direct = direct_nodes(g, paths)
    # Seeds count at distance 0 anyway.
    reached = traverse.nearest_impact(g, direct, max_depth, kinds, labels=1).select("id", "distance").unionByName(direct.select("id", F.lit(0).alias("distance")))
    tests = g.classifications.where(F.col("role") == S.TEST_ROLE).select(F.col("node_id").alias("id"))
    named = reached.join(tests, "id", "left_semi").join(g.nodes.select("id", "display_name", "file_id"), "id").join(g.files.select(F.col("id").alias("file_id"), "relative_path"), "file_id")
    return named.groupBy("relative_path").agg(F.min("distance").alias("distance"), F.array_join(F.slice(F.array_sort(F.collect_set("display_name")), 1, 3), "|").alias("tests")).orderBy("distance", "relative_path")


def review(g: Graph, paths: list[str], policies: list[policy.Policy] | None = None, max_depth: int = 4, baseline: Graph | None = None, budgets: dict[str, int] | None = None) -> DataFrame:
    """What a change touches: ``section, key, detail`` over impact, policy violations, cycles and the quality gate.

    What can't be judged says why in a row of its own, with an empty key.
    """
    direct = stored(direct_nodes(g, paths), "direct")
    parts = [changed_files_impact(g, paths, max_depth).select(F.lit("impact").alias("section"), F.col("id").alias("key"), F.col("distance").cast("string").alias("detail"))]
    why = lambda section, reason: g.spark.createDataFrame([(section, "", f"not_evaluated: {reason}")], "section string, key string, detail string")
    clash = stored(policy.violations(g, policies), "violations") if policies else None
    if policies:
        touched = clash.join(direct.select(F.col("id").alias("source_id")), "source_id", "left_semi").unionByName(clash.join(direct.select(F.col("id").alias("target_id")), "target_id", "left_semi")).distinct()
        parts.append(touched.select(F.lit("policy").alias("section"), F.col("edge_id").alias("key"), F.concat_ws(":", "policy_id", "reasons").alias("detail")))
    else:
        parts.append(why("policy", "no policies"))
    found = stored(scc.components(g.following(S.IMPACT_KINDS)), "cycles")
    parts.append(found.join(direct, "id", "left_semi").select(F.lit("cycle").alias("section"), F.col("id").alias("key"), F.col("component").alias("detail")))
    if baseline is None:
        parts.append(why("gate", "no baseline"))
    else:
        limits = budgets or {"new_cycles": 0, "hub_degree_growth": 0} | ({"boundary_violations": 0} if policies else {})
        checked = snapshot.quality_gate(baseline, g, limits, policies or (), found, clash)
        parts.append(checked.select(F.lit("gate").alias("section"), F.col("name").alias("key"), F.concat_ws(":", F.when(F.col("passed"), "passed").otherwise("failed"), F.col("actual").cast("string"), F.col("budget").cast("string")).alias("detail")))
    return reduce(DataFrame.unionByName, parts)
