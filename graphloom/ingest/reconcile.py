"""From contributions to one graph: identity, resolution of references, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stable_id, tail
from ..storage import stored
from . import resolution
from .contributions import numbered


NODE_COLUMNS = ["id", "language", "kind", "canonical_name", "display_name", "origin", "confidence", "file", "start_line", "end_line", "attributes"]
EDGE_COLUMNS = ["id", "kind", "source_id", "target_id", "file", "start_line", "origin", "confidence"]


def explode_contributions(rows: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Node, edge and diagnostic facts with the file and order they came in.  ``rows``: the contribution schema and ``language``."""
    at = rows.withColumn("file", F.col("owner_key"))
    nodes = at.select("language", "file", F.posexplode("nodes").alias("place", "n")).select("language", "file", "place", "n.*")
    edges = at.select("language", "file", F.posexplode("edges").alias("place", "e")).select("language", "file", "place", "e.*")
    told = at.select("file", F.explode("diagnostics").alias("d")).select("file", "d.*")
    return nodes, edges, told


def reference(language: str, kind: str, name: str) -> Column:
    return F.concat_ws(":", F.col(language), F.col(kind), F.col(name))


def identified(nodes: DataFrame, project: str) -> DataFrame:
    return nodes.withColumn("id", stable_id("symbol", F.lit(project), F.col("language"), F.col("kind"), F.col("canonical_name"))).withColumn("ref", reference("language", "kind", "canonical_name"))


def ranked_nodes(nodes: DataFrame) -> DataFrame:
    """Declarations of each id in order of file and place (``k``), with the file of the first."""
    order = Window.partitionBy("id").orderBy("file", "place")
    return nodes.withColumn("k", F.row_number().over(order)).withColumn("first_file", F.first("file").over(order))


def duplicates(ranked: DataFrame) -> DataFrame:
    """Ids that another file declares again: ``id, name``."""
    again = ranked.where((F.col("k") > 1) & (F.col("file") != F.col("first_file")) & (F.col("kind") != "package") & ~F.col("kind").startswith("external_"))
    return again.groupBy("id").agg(F.min("canonical_name").alias("name"))


def duplicate_warnings(again: DataFrame) -> DataFrame:
    return again.select(F.lit("warning").alias("severity"), F.lit("duplicate_symbol_evidence").alias("code"), F.col("name").alias("message"))


def collect_nodes(nodes: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """The first declaration of each id, by file and place, and a warning for each id that another file declares again."""
    ranked = ranked_nodes(identified(nodes, project))
    return ranked.where("k = 1").drop("k", "first_file", "place"), duplicate_warnings(duplicates(ranked))


def local_conflicts(nodes: DataFrame) -> DataFrame:
    """Local ids of one file that name several symbols: an error of the scanner."""
    return nodes.groupBy("file", "local_id").agg(F.countDistinct("kind", "canonical_name").alias("n")).where("n > 1")


def resolve_targets(edges: DataFrame, nodes: DataFrame, max_depth: int = resolution.MAX_DEPTH) -> tuple[DataFrame, DataFrame]:
    """Edges with the id of what they point at, and warnings for references that aren't any; ``resolution`` says how."""
    refs, _ = resolution.resolve_references(edges, resolution.Known.of(edges, nodes), max_depth)
    return pointed(edges, stored(refs, "resolved"))


def pointed(edges: DataFrame, refs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges by the references' decisions, and a warning for each reference that isn't one."""
    return edges.join(refs.where("target_id IS NOT NULL").drop("status"), "target"), bad_references(refs)


def bad_references(refs: DataFrame) -> DataFrame:
    return refs.where("status = 'malformed'").select(F.lit("warning").alias("severity"), F.lit("unresolvable_reference").alias("code"), F.col("target").alias("message"))


def external_nodes(edges: DataFrame) -> DataFrame:
    """One node for each reference that no file declares."""
    return edges.where("external").select(F.col("target_id").alias("id"), F.col("t_lang").alias("language"), F.concat(F.lit("external_"), F.col("t_kind")).alias("kind"), F.col("t_name").alias("canonical_name"), tail(F.col("t_name")).alias("display_name"), F.lit("derived").alias("origin"), F.lit("possible").alias("confidence")).distinct()


def collapse_edges(edges: DataFrame, project: str) -> DataFrame:
    """Edges by id: the same evidence counts once, and the last fact wins; another line is another occurrence."""
    ids = edges.withColumn("id", stable_id("edge", F.lit(project), F.col("kind"), F.col("source_id"), F.col("target_id"), F.concat_ws(":", "file", "start_line")))
    order = Window.partitionBy("id").orderBy(F.desc("file"), F.desc("place"))
    return ids.withColumn("k", F.row_number().over(order)).where("k = 1").drop("k")


def missing(rows: DataFrame, key: str, known: DataFrame, known_key: str = "id") -> DataFrame:
    """Rows whose key is not known: what a scan is aborted for."""
    return rows.where(F.col(key).isNotNull()).join(known.select(F.col(known_key).alias(key)), key, "left_anti")


def assert_complete(rows: DataFrame, key: str, known: DataFrame, what: str, known_key: str = "id") -> None:
    if (bad := missing(rows, key, known, known_key).head(1)):
        raise ValueError(f"{what}: {bad[0][key]!r} is missing")


def reconcile(contributions: DataFrame, files: DataFrame, project: str, discovery: DataFrame | None = None) -> dict[str, DataFrame]:
    """``nodes, edges, diagnostics`` of a project from its contributions.  ``files``: relative_path; ``discovery``: diagnostics of the tree (severity, code, message)."""
    # Facts are read many times below; what made them runs once.
    nodes, edges, told = (stored(x, "facts") for x in explode_contributions(contributions))
    if not local_conflicts(nodes).isEmpty():
        raise ValueError("a local id names several symbols")
    assert_complete(nodes, "file", files, "evidence file", "relative_path")
    first, warnings = collect_nodes(nodes, project)
    first = stored(first, "declared")
    source = first.select(F.col("ref").alias("source"), F.col("id").alias("source_id"))
    with_source = edges.join(source, "source", "left")
    if (bad := with_source.where("source_id is null").head(1)):
        raise ValueError(f"edge source {bad[0]['source']!r} is missing")
    resolved, bad_refs = resolve_targets(stored(with_source, "edges"), first)
    kept = stored(collapse_edges(resolved, project), "edges")
    all_nodes = first.select(*NODE_COLUMNS).unionByName(external_nodes(kept), allowMissingColumns=True)
    owned = lambda df: df if "owner_key" in df.columns else df.withColumn("owner_key", F.lit(None).cast("string"))
    diagnostics = numbered({"scanner": told.withColumnRenamed("file", "owner_key"), "discovery": owned(discovery) if discovery is not None else owned(told.limit(0).drop("file")), "reconciler": owned(warnings.unionByName(bad_refs))})
    return {"nodes": all_nodes, "edges": kept.select(*EDGE_COLUMNS), "diagnostics": diagnostics}
