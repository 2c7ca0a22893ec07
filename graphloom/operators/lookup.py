"""Name resolution, ranked lookup, search, dossiers, usages and listings."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..graph import Graph
from ..storage import stored
from . import names

_ID = re.compile(r"(symbol|route)_[0-9a-f]{64}")


#: Named files up to which they are sent to the rows; components up to which Spark chooses how edges meet them; components whose names a task holds about.
FEW_FILES, FEW_NODES, HELD = 100_000, 100_000, 500_000


def with_ends(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges of which both ends are known, with ``source`` and ``target``, the ends' canonical names.

    A task holds the names of its share of the components and lets the edges pass: these are many more and longer, and sorting
    them would spill.
    """
    n = nodes.count()
    tasks = max(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // HELD))
    for end, name in (("source_id", "source"), ("target_id", "target")):
        names_ = nodes.select(F.col("id").alias(end), F.col("canonical_name").alias(name))
        if n > FEW_NODES:
            edges, names_ = edges.repartition(tasks, end), names_.repartition(tasks, end).hint("shuffle_hash")
        edges = edges.join(names_, end)
    return edges


def with_paths(rows: DataFrame, edges: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` made from ``edges`` with ``relative_path`` by ``file_id``, null where the file is unknown.

    Many edges may name one file, so where few files are named these are sent to the rows, however many files there are; otherwise
    all rows of a file would meet in one task.
    """
    named = stored(files.select(F.col("id").alias("file_id"), "relative_path").join(edges.select("file_id").distinct(), "file_id", "left_semi"), "paths")
    return rows.join(F.broadcast(named) if named.count() <= FEW_FILES else named, "file_id", "left")


def like(term: str) -> str:
    """A term as a LIKE pattern's literal part, with ``!`` as the escape."""
    return re.sub(r"([!%_])", r"!\1", term)


def ilike(column: str, pattern: str) -> Column:
    """Case-insensitive LIKE with ``!`` as the escape; it also folds letters beyond ASCII."""
    return F.expr(f"{column} ILIKE {_quoted(pattern)} ESCAPE '!'")


def _quoted(text: str) -> str:
    return "'" + text.replace("\\", "\\\\").replace("'", "\\'") + "'"


def contains(column: str, term: str) -> Column:
    return ilike(column, f"%{like(term)}%")


def starts(column: str, term: str) -> Column:
    return ilike(column, f"{like(term)}%")


def resolve(g: Graph, name: str, most: int = 20) -> DataFrame:
    """Candidates of the best tier: exact id, else exact name, else prefix.  One row means resolved."""
    if _ID.fullmatch(name):
        return g.nodes.where(F.col("id") == name).withColumn("tier", F.lit(0))
    tier = F.when((F.col("canonical_name") == name) | (F.col("display_name") == name), 1).when(starts("canonical_name", name) | starts("display_name", name), 2)
    found = g.nodes.withColumn("tier", tier).where("tier is not null")
    best = found.agg(F.min("tier").alias("best"))
    order = [(F.col("canonical_name") == name).desc(), F.col("canonical_name"), F.col("id")]
    return found.join(F.broadcast(best), F.col("tier") == F.col("best")).drop("best").orderBy(*order).limit(most + 1)


def find_component(g: Graph, name: str, limit: int = 20) -> DataFrame:
    """Components by relevance: exact names, then prefixes, then names that contain the term."""
    S.between("limit", limit, 1, 100)
    rank = (
        F.when(F.col("canonical_name") == name, 0).when(F.col("display_name") == name, 1)
        .when(starts("canonical_name", name), 2).when(starts("display_name", name), 3).otherwise(4)
    )
    return (
        names.narrowed(g, [name]).where(contains("canonical_name", name) | contains("display_name", name))
        .select("id", "kind", "canonical_name", "display_name", rank.alias("relevance"))
        .orderBy("relevance", "canonical_name", "id").limit(limit + 1)
    )


def search(g: Graph, query: str, kinds: list[str] | None = None, roles: list[str] | None = None, boundaries: list[str] | None = None, confidences: list[str] | None = None, limit: int = 20, offset: int = 0) -> DataFrame:
    """Every term must match a name, the raw attributes or a role; the structured filters must all hold."""
    terms = query.split()
    if len(terms) > 8:
        raise ValueError("at most 8 terms")
    rows = names.narrowed(g, terms)
    if kinds:
        rows = rows.where(F.col("kind").isin(kinds))
    if confidences:
        rows = rows.where(F.col("confidence").isin(confidences))
    for term in terms:
        by_role = g.classifications.where(contains("role", term)).select(F.col("node_id").alias("id")).distinct().withColumn("by_role", F.lit(True))
        rows = rows.join(by_role, "id", "left").where(contains("canonical_name", term) | contains("display_name", term) | contains("attributes_json", term) | F.coalesce("by_role", F.lit(False))).drop("by_role")
    if roles:
        rows = rows.join(g.classifications.where(F.col("role").isin(roles)), F.col("id") == F.col("node_id"), "left_semi")
    if boundaries:
        rows = rows.join(g.memberships.where(F.col("boundary_id").isin(boundaries)), F.col("id") == F.col("node_id"), "left_semi")
    rank = F.when(F.col("canonical_name") == query, 0).when(F.col("display_name") == query, 1).when(starts("canonical_name", query), 2).otherwise(3)
    return rows.select("id", "kind", "canonical_name", rank.alias("relevance")).orderBy("relevance", "canonical_name", "id").offset(offset).limit(limit + 1)


def identity(g: Graph, ids: DataFrame) -> DataFrame:
    """Nodes with their file and parent: ``id, ..., relative_path, parent_name``."""
    parent = g.nodes.select(F.col("id").alias("parent_id"), F.col("canonical_name").alias("parent_name"))
    files = g.files.select(F.col("id").alias("file_id"), "relative_path")
    return g.nodes.join(ids.select("id"), "id", "left_semi").join(files, "file_id", "left").join(parent, "parent_id", "left").select("id", "kind", "canonical_name", "display_name", "confidence", "relative_path", "start_line", "parent_name")


def children(g: Graph, ids: DataFrame, most: int = 25) -> DataFrame:
    """Contained components by the ``contains`` relationship, at most ``most`` each."""
    kids = g.edges.where("kind = 'contains'").join(ids.select(F.col("id").alias("source_id")), "source_id", "left_semi").select(F.col("source_id").alias("parent"), F.col("target_id").alias("id")).distinct()
    order = Window.partitionBy("parent").orderBy("canonical_name", "id")
    return kids.join(g.nodes.select("id", "kind", "canonical_name"), "id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= most).select("parent", "id", "kind", "canonical_name")


def relationships(g: Graph, ids: DataFrame, outgoing: bool = True, most: int = 25, min_confidence: str = "possible") -> DataFrame:
    """Edges at a component with the other end's name, best confidence first, at most ``most`` each."""
    here, other = ("source_id", "target_id") if outgoing else ("target_id", "source_id")
    names = g.nodes.select(F.col("id").alias("other"), F.col("canonical_name").alias("other_name"))
    order = Window.partitionBy("id").orderBy(F.desc("rank"), "kind", "other_name", "edge_id")
    return (
        g.edges.withColumn("rank", S.confidence_rank()).where(F.col("rank") >= S.least_rank(min_confidence))
        .select(F.col(here).alias("id"), F.col(other).alias("other"), "kind", "confidence", "rank", F.col("id").alias("edge_id"))
        .join(ids.select("id"), "id", "left_semi").join(names, "other")
        .withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
        .select("id", F.lit("out" if outgoing else "in").alias("direction"), "kind", "other", "other_name", "confidence")
    )


def list_usages(g: Graph, symbol: DataFrame, kinds: list[str] | None = None, min_confidence: str = "possible", limit: int = 100) -> DataFrame:
    """One row for each occurrence into the symbol, by path, line and edge."""
    S.between("limit", limit, 1, 500)
    files = g.files.select(F.col("id").alias("file_id"), "relative_path")
    users = g.nodes.select(F.col("id").alias("source_id"), F.col("canonical_name").alias("user"))
    hits = g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence).join(F.broadcast(symbol.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    return hits.join(users, "source_id").join(files, "file_id", "left").select(F.col("id").alias("edge_id"), "kind", "user", "relative_path", "start_line", "confidence").orderBy(F.asc_nulls_first("relative_path"), "start_line", "edge_id").limit(limit + 1)


def count_usages(g: Graph, symbol: DataFrame, kinds: list[str] | None = None, min_confidence: str = "possible") -> DataFrame:
    hits = g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence).join(F.broadcast(symbol.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    return hits.agg(F.count(F.lit(1)).alias("total"))


def file_metrics(g: Graph, path_contains: str | None = None, language: str | None = None, sort_by: str = "line_count", descending: bool = True, limit: int = 50, offset: int = 0) -> DataFrame:
    if sort_by not in ("line_count", "path"):
        raise ValueError("sort_by must be line_count or path")
    rows = g.files
    if path_contains:
        rows = rows.where(contains("relative_path", path_contains))
    if language:
        rows = rows.where(F.col("language") == language)
    key = F.col("relative_path" if sort_by == "path" else sort_by)
    return rows.select("relative_path", "language", "line_count", "size").orderBy(key.desc() if descending else key.asc(), "relative_path").offset(offset).limit(limit)


def list_boundaries(g: Graph, source: str | None = None, sample: int = 5, limit: int = 50, offset: int = 0) -> DataFrame:
    """Boundaries with their member count, empty ones too, and their first members by name."""
    rows = g.boundaries.where(F.col("source") == source) if source else g.boundaries
    counted = rows.join(g.memberships.withColumnRenamed("boundary_id", "id"), "id", "left").groupBy("id", "name", "source").agg(F.count("node_id").alias("member_count"))
    order = Window.partitionBy("boundary_id").orderBy("canonical_name", "node_id")
    first = (
        g.memberships.join(g.nodes.select(F.col("id").alias("node_id"), "canonical_name"), "node_id").withColumn("k", F.row_number().over(order)).where(F.col("k") <= sample)
        .groupBy("boundary_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "canonical_name"))), lambda x: x["canonical_name"]), "|").alias("members"))
    )
    return counted.join(first.withColumnRenamed("boundary_id", "id"), "id", "left").select("id", "name", "source", "member_count", F.coalesce("members", F.lit("")).alias("members")).orderBy("name", "id").offset(offset).limit(limit)


def list_projects(projects: DataFrame, scans: DataFrame, counts: dict[str, DataFrame]) -> DataFrame:
    """Projects with their active and latest scan, row counts, and the first freshness state that fits.

    ``projects``: id, name, active_scan_id, root_available; ``scans``: id, project_id, status, started_at;
    ``counts``: per name a table with project_id.
    """
    latest = scans.groupBy("project_id").agg(F.max(F.struct("started_at", "id", "status")).alias("latest"))
    out = projects.join(latest.withColumnRenamed("project_id", "id").select("id", F.col("latest.id").alias("latest_scan_id"), F.col("latest.status").alias("latest_status")), "id", "left")
    for name, rows in counts.items():
        out = out.join(rows.groupBy(F.col("project_id").alias("id")).agg(F.count(F.lit(1)).alias(name)), "id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    state = (
        F.when(F.col("active_scan_id").isNull(), "unscanned").when(F.col("latest_status") == "running", "scan_in_progress").when(F.col("latest_status") == "failed", "latest_scan_failed")
        .when(F.col("latest_status") == "cancelled", "latest_scan_cancelled").when(~F.col("root_available"), "root_unavailable").otherwise("ready")
    )
    return out.withColumn("freshness", state).drop("root_available")


def list_snapshots(scans: DataFrame, snapshots: DataFrame, active: str, limit: int = 20, offset: int = 0) -> DataFrame:
    """The active scan first, then archives from the newest.  ``snapshots``: scan_id, complete, fact_count, sequence."""
    rows = scans.join(snapshots.withColumnRenamed("scan_id", "id"), "id", "left").where((F.col("id") == active) | F.col("sequence").isNotNull())
    return rows.withColumn("active", F.col("id") == active).orderBy(F.desc("active"), F.desc_nulls_last("sequence"), "id").offset(offset).limit(limit)
