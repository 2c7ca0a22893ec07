"""One facade over all queries: typed arguments, rejected out of bounds, and an envelope as the answer."""

from __future__ import annotations

import hashlib
import inspect
import platform
import re
from collections.abc import Callable
from dataclasses import replace
from typing import Any

import pyspark
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import config, render
from . import schema as S
from .graph import Graph
from .ingest import classify, incremental, reconcile
from .ingest.maintain import Maintained
from .ingest.store import BucketStore
from .operators import change, counts, health, location, lookup, policy, scc, snapshot, traverse
from .render import Envelope, page
from .sources import bundle, declared, git, python_code, tree
from .storage import stored


def _keyed(df: DataFrame) -> DataFrame:
    """A table with an ``id``: its own, or all columns together."""
    return df if "id" in df.columns else df.withColumn("id", F.concat_ws("|", *df.columns))


#: The tables of a bundle.
_BUNDLED = {"files": S.FILES, "nodes": S.NODES, "edges": S.EDGES, "classifications": S.CLASSIFICATIONS, "boundaries": S.BOUNDARIES, "memberships": S.MEMBERSHIPS, "diagnostics": S.DIAGNOSTICS}
#: Changes when an extractor states other facts of the same file.
SCANNERS = "1"


class Engine:
    """Queries of one project's graph.  ``scans``, ``snapshots`` and ``commits`` are only needed by the tools that read them."""

    def __init__(self, graph: Graph, project_id: str = "project", snapshot_id: str = "active", store: incremental.SnapshotStore | None = None, commits: DataFrame | None = None):
        self.graph, self.project_id, self.snapshot_id, self.store, self.commits = graph, project_id, snapshot_id, store, commits
        #: What the scanned folder's configuration says; arguments of a call go before it.
        self.settings = config.ProjectConfig()

    # --- answers -------------------------------------------------------------------------------------------------------

    def _answer(self, name: str, df: DataFrame, limit: int, **more: Any) -> Envelope:
        rows, cut = page(df, limit)
        return Envelope(f"{len(rows)} {name}", {name: rows, **more}, self.project_id, self.snapshot_id, truncated=cut)

    def _symbol(self, name: str) -> tuple[DataFrame | None, Envelope | None]:
        rows, cut = page(lookup.resolve(self.graph, name).select("id", "kind", "canonical_name"), 20)
        if len(rows) == 1:
            return self.graph.spark.createDataFrame([(rows[0]["id"],)], "id string"), None
        return None, Envelope("ambiguous" if rows else "not found", {"candidates": rows}, self.project_id, self.snapshot_id, truncated=cut)

    def _on_symbol(self, name: str, f: Callable[[DataFrame], Envelope]) -> Envelope:
        symbol, other = self._symbol(name)
        return f(symbol) if symbol is not None else other

    # --- orientation ---------------------------------------------------------------------------------------------------

    def server_info(self) -> Envelope:
        return Envelope("graphloom", {"spark": pyspark.__version__, "python": platform.python_version(), "tools": self.tools()})

    def diagnose_runtime(self) -> Envelope:
        conf = self.graph.spark.conf
        return Envelope("runtime", {k: conf.get(k, None) for k in ("spark.sql.adaptive.enabled", "spark.sql.shuffle.partitions", "spark.checkpoint.dir", "spark.sql.session.timeZone")})

    @classmethod
    def tools(cls) -> list[str]:
        return sorted(n for n in vars(cls) if not n.startswith("_") and n not in ("tools", "call", "snapshot_graph", "archive"))

    def call(self, tool: str, *, max_chars: int | None = None, refresh: Callable[[], Graph] | None = None, listing: DataFrame | None = None, newer_attempt: bool = False, **arguments: Any) -> Envelope:
        """A tool by name: unknown and missing arguments are rejected, suggestions for what to ask next added, and the answer cut to ``max_chars``.

        ``refresh`` scans anew before the tool runs; if it fails, the answer says so and stands on the graph as it was.
        With ``listing`` (relative_path, content_hash) the answer tells how the graph stands to the files, and only a graph
        that isn't fresh is scanned anew.
        """
        if tool not in self.tools():
            raise ValueError(f"unknown tool {tool!r}")
        wanted = inspect.signature(getattr(self, tool)).parameters
        if extra := sorted(set(arguments) - set(wanted)):
            raise ValueError(f"{tool} has no arguments {extra}")
        if lacking := [n for n, p in wanted.items() if p.default is p.empty and n not in arguments]:
            raise ValueError(f"{tool} needs {lacking}")
        warnings: list[str] = []
        state = self._staleness(listing, newer_attempt) if listing is not None else None
        if refresh is not None and (state is None or state["state"] != "fresh"):
            try:
                self.graph = refresh()
            except Exception as e:  # the scan is foreign code to the question: the older graph still answers it
                warnings.append(f"refresh failed: {type(e).__name__}")
            else:
                state = self._staleness(listing, False) if listing is not None else None
        out = getattr(self, tool)(**arguments)
        if not isinstance(out, Envelope):
            return out
        out.warnings += warnings
        if state is not None:
            out.data["staleness"] = state
        out.next_steps = render.next_steps(tool, out)
        return out.within(max_chars) if max_chars is not None else out

    def _staleness(self, listing: DataFrame, newer_attempt: bool, most_files: int = 500) -> dict[str, Any]:
        """The state of the graph against a listing, and how many files differ in which way where that was looked at."""
        state = incremental.staleness(listing, self.graph.files, newer_attempt, most_files)
        if state == "unverified":
            return {"state": state, "guidance": "too many files to compare; scan_project makes it certain"}
        found = {r["change"]: r["count"] for r in incremental.drift(listing, self.graph.files).groupBy("change").count().collect()}
        told = {f"{k}_files_since": found.get(k, 0) for k in ("changed", "added", "deleted")}
        return {"state": state, **told} | ({"guidance": "scan_project brings the graph up to date"} if state == "stale" else {})

    def list_projects(self, projects: DataFrame, scans: DataFrame, counts_by: dict[str, DataFrame] | None = None, limit: int = 50) -> Envelope:
        return self._answer("projects", lookup.list_projects(projects, scans, counts_by or {}).orderBy("name", "id"), S.between("limit", limit, 1, 100))

    def list_snapshots(self, scans: DataFrame, snapshots: DataFrame, limit: int = 20, offset: int = 0) -> Envelope:
        return self._answer("snapshots", lookup.list_snapshots(scans, snapshots, self.snapshot_id, limit + 1, offset), limit)

    def architecture_summary(self, limit: int = 50) -> Envelope:
        rows = [r.asDict() for r in counts.architecture_summary(self.graph, S.between("limit", limit, 1, 100)).collect()]
        return Envelope("summary", {"counts": rows}, self.project_id, self.snapshot_id, truncated=any(r["groups"] > limit for r in rows))

    def list_boundaries(self, source: str | None = None, limit: int = 50, offset: int = 0) -> Envelope:
        return self._answer("boundaries", lookup.list_boundaries(self.graph, source, limit=limit + 1, offset=offset), limit)

    def export_agent_brief(self, max_chars: int = 4000) -> Envelope:
        return Envelope("brief", {"markdown": render.export_brief(self.graph, max_chars)}, self.project_id, self.snapshot_id)

    # --- lookup ----------------------------------------------------------------------------------------------------------

    def find_component(self, name: str, limit: int = 20) -> Envelope:
        out = self._answer("components", lookup.find_component(self.graph, name, limit), limit)
        out.data["ambiguous"] = len(out.data["components"]) > 1
        return out

    def search_architecture(self, query: str, kinds: list[str] | None = None, roles: list[str] | None = None, boundary_ids: list[str] | None = None, confidences: list[str] | None = None, limit: int = 20, offset: int = 0) -> Envelope:
        return self._answer("components", lookup.search(self.graph, query, kinds, roles, boundary_ids, confidences, S.between("limit", limit, 1, 100), offset), limit)

    def inspect_component(self, component: str, max_relationships: int = 25, max_children: int = 25, min_confidence: str = "possible") -> Envelope:
        def answer(s: DataFrame) -> Envelope:
            g = self.graph
            one = lookup.identity(g, s).first().asDict()
            return Envelope(one["canonical_name"], {
                "component": one,
                "roles": [r["role"] for r in g.classifications.join(s.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("role").distinct().orderBy("role").collect()],
                "boundaries": [r["boundary_id"] for r in g.memberships.join(s.withColumnRenamed("id", "node_id"), "node_id", "left_semi").select("boundary_id").orderBy("boundary_id").collect()],
                "annotations": [r.asDict() for r in g.annotations.where(F.col("canonical_name") == one["canonical_name"]).collect()] if g.annotations is not None else [],
                "children": [r.asDict() for r in lookup.children(g, s, max_children).collect()],
                "outgoing": [r.asDict() for r in lookup.relationships(g, s, True, max_relationships, min_confidence).collect()],
                "incoming": [r.asDict() for r in lookup.relationships(g, s, False, max_relationships, min_confidence).collect()],
            }, self.project_id, self.snapshot_id)

        return self._on_symbol(component, answer)

    def list_usages(self, symbol: str, edge_kinds: list[str] | None = None, min_confidence: str = "possible", limit: int = 100) -> Envelope:
        def answer(s: DataFrame) -> Envelope:
            out = self._answer("usages", lookup.list_usages(self.graph, s, edge_kinds, min_confidence, limit), limit)
            out.data["total"] = lookup.count_usages(self.graph, s, edge_kinds, min_confidence).first()["total"] if out.truncated else len(out.data["usages"])
            return out

        return self._on_symbol(symbol, answer)

    def file_metrics(self, path_contains: str | None = None, language: str | None = None, sort_by: str = "line_count", order: str = "desc", limit: int = 50, offset: int = 0) -> Envelope:
        return self._answer("files", lookup.file_metrics(self.graph, path_contains, language, sort_by, order == "desc", limit + 1, offset), limit)

    # --- traversal -------------------------------------------------------------------------------------------------------

    def impact_analysis(self, symbol: str, max_depth: int = 4, limit: int = 100, edge_kinds: list[str] | None = None, min_confidence: str = "possible", entry_roles: list[str] | None = None) -> Envelope:
        def answer(s: DataFrame) -> Envelope:
            found = traverse.impact(self.graph, s, max_depth, edge_kinds, min_confidence)
            named = found.join(self.graph.nodes.select("id", "canonical_name", "kind"), "id").select("id", "canonical_name", "kind", "distance", S.confidence_name(F.col("rank")).alias("path_confidence"), "via").orderBy("distance", "canonical_name", "id")
            entries = [r.asDict() for r in traverse.entry_points(self.graph, found, entry_roles or S.ENTRY_ROLES).select("id", "kind", "distance").orderBy("distance", "id").limit(limit).collect()]
            by = {r["distance"]: r["n"] for r in counts.histogram(found, "distance").collect()}
            return self._answer("dependants", named, S.between("limit", limit, 1, 500), entry_points=entries, by_distance=by)

        return self._on_symbol(symbol, answer)

    def explain_flow(self, source: str, target: str, max_depth: int = 6, max_paths: int = 5, edge_kinds: list[str] | None = None, min_confidence: str = "possible", max_states: int = 1_000_000) -> Envelope:
        return self._on_symbol(source, lambda a: self._on_symbol(target, lambda b: self._answer("paths", traverse.paths(self.graph, a, b, max_depth, max_paths + 1, edge_kinds, min_confidence, max_states), max_paths)))

    def dependency_cycles(self, edge_kinds: list[str] | None = None, min_confidence: str = "possible", limit: int = 20, include_self_loops: bool = False) -> Envelope:
        return self._answer("cycles", scc.dependency_cycles(self.graph, edge_kinds, min_confidence, limit + 1, include_self_loops), limit)

    def change_impact(self, symbol: str, max_depth: int = 4, max_commits: int = 500, edge_kinds: list[str] | None = None, limit: int = 100) -> Envelope:
        if self.commits is None:
            raise ValueError("no commits were given")
        return self._on_symbol(symbol, lambda s: self._answer("components", change.change_impact(self.graph, s, self.commits, max_depth, max_commits, edge_kinds), limit))

    def _changed(self, files: list[str] | None, working_tree: str | None, base: str) -> list[str]:
        """Paths as given, or those that differ in a working tree; a renamed file counts under both names."""
        if (files is None) == (working_tree is None):
            raise ValueError("give either files or a working tree")
        if files is None:
            rows = git.changes(self.graph.spark, working_tree, base, 50).collect()
            files = [p for r in rows for p in (r["path"], r["previous"]) if p]
        return sorted(set(files))

    def changed_files_impact(self, files: list[str] | None = None, max_depth: int = 4, limit: int = 100, edge_kinds: list[str] | None = None, min_confidence: str = "possible", entry_roles: list[str] | None = None, working_tree: str | None = None, base: str = "HEAD") -> Envelope:
        """What depends on components in changed files; which of the files hold none, the components themselves, and what starts something among the dependants."""
        g, files = self.graph, self._changed(files, working_tree, base)
        S.between("limit", limit, 1, 500)
        if not files:
            return Envelope("0 components", {"components": [], "changed_files": [], "unresolved_files": [], "direct_components": [], "entry_points": []}, self.project_id, self.snapshot_id)
        paths = g.files.select(F.col("id").alias("file_id"), "relative_path")
        direct = stored(g.nodes.join(change.direct_nodes(g, files), "id", "left_semi").join(paths, "file_id"), "direct")
        found = stored(traverse.nearest_impact(g, direct.select("id"), max_depth, edge_kinds, min_confidence), "impact")
        named = found.join(g.nodes.select("id", "canonical_name"), "id").select("id", "canonical_name", "distance", "seed").orderBy("distance", "canonical_name", "id")
        rows, more = page(direct.orderBy("relative_path", "canonical_name", "id").select("id", "kind", "canonical_name", "relative_path", "start_line", "end_line"), 1000)
        resolved = {r[0] for r in direct.select("relative_path").distinct().collect()}
        entries = traverse.entry_points(g, found, entry_roles or S.ENTRY_ROLES).select("id", "kind", "distance").orderBy("id")
        out = self._answer("components", named, limit, changed_files=files, unresolved_files=[f for f in files if f not in resolved], direct_components=rows, entry_points=page(entries, limit)[0])
        out.evidence = [{"component_id": r["id"], "path": r["relative_path"], "start_line": r["start_line"], "end_line": r["end_line"]} for r in rows[:100]]
        out.truncated |= more
        return out

    def test_impact(self, files: list[str] | None = None, max_depth: int = 4, limit: int = 100, working_tree: str | None = None, base: str = "HEAD") -> Envelope:
        return self._answer("tests", change.test_impact(self.graph, self._changed(files, working_tree, base), max_depth), limit)

    def review_diff(self, files: list[str] | None = None, policies: list[policy.Policy] | None = None, max_depth: int = 4, limit: int = 100, baseline: str | None = None, budgets: dict[str, int] | None = None, working_tree: str | None = None, base: str = "HEAD") -> Envelope:
        """Without a baseline the newest archived snapshot before the active one is it, if there is a store that has one."""
        if baseline is None and self.store is not None:
            row = self.store.snapshots().where("complete").where(F.col("scan_id") != self.snapshot_id).orderBy(F.desc("number")).first()
            baseline = row["scan_id"] if row else None
        before = self.snapshot_graph(baseline) if baseline is not None else None
        policies = list(self.settings.policies) if policies is None else policies
        return self._answer("findings", change.review(self.graph, self._changed(files, working_tree, base), policies, max_depth, before, budgets or self.settings.quality_budgets or None), limit, baseline=baseline)

    # --- health ----------------------------------------------------------------------------------------------------------

    def architecture_health(self, edge_kinds: list[str] | None = None, min_confidence: str = "possible", limit: int = 20, include_external: bool = False, include_tests: bool = False, suppress: list[str] | None = None) -> Envelope:
        g, a = self.graph, (edge_kinds, min_confidence)
        dead = health.dead_code(g, *a, list(self.settings.dead_code_suppressions) if suppress is None else suppress)
        reasons = {r["reason"]: r["count"] for r in dead.where("reason is not null").groupBy("reason").count().collect()}
        return self._answer("hubs", health.hubs(g, *a, limit + 1, include_external, include_tests), limit,
            hotspots=[r.asDict() for r in health.hotspots(g, *a, limit, include_external, include_tests).collect()],
            dead_code_candidates=[r.asDict() for r in dead.where("reason is null").drop("reason").orderBy("canonical_name", "id").limit(limit).collect()], excluded=reasons)

    def check_architecture(self, policies: list[policy.Policy] | None = None, min_confidence: str = "possible", limit: int = 100) -> Envelope:
        """Violations of the policies that are given, or else of those that the project's configuration holds."""
        if not (policies := list(self.settings.policies) if policies is None else policies):
            raise ValueError("no policies are given or configured")
        found = policy.violations(self.graph, policies, min_confidence)
        return self._answer("violations", found.orderBy("policy_id", "edge_id"), limit, total=found.count())

    def suggest_location(self, text: str, limit: int = 5, ranker: Callable[[DataFrame], DataFrame] | None = None) -> Envelope:
        found = location.suggest(self.graph, text, limit + 1)
        found, how = location.semantic_rank(found, ranker) if ranker else (found, "deterministic")
        return self._answer("locations", found, limit, ranking=how)

    def export_diagram(self, format: str = "mermaid", edge_kinds: list[str] | None = None, min_confidence: str = "possible", direction: str = "LR", max_nodes: int = 200, max_edges: int = 500, boundary: str | None = None) -> Envelope:
        return Envelope("diagram", {"text": render.export_diagram(self.graph, edge_kinds, min_confidence, max_nodes, max_edges, format, direction, boundary)}, self.project_id, self.snapshot_id)

    def architecture_context(self, task: str, files: list[str] | None = None, max_chars: int = 30_000) -> Envelope:
        lines = lambda e: [str(r) for rows in e.data.values() if isinstance(rows, list) for r in rows]
        parts = {"summary": lines(self.architecture_summary(20)), "locations": lines(self.suggest_location(task)), "impact": lines(self.changed_files_impact(files)) if files else [], "dossiers": self._dossiers(task, files or [])}
        return Envelope("context", {"text": render.architecture_context(self.graph, parts, max_chars)}, self.project_id, self.snapshot_id)

    def _dossiers(self, task: str, files: list[str], most: int = 3) -> list[str]:
        """What is known of the components that the task's words name, or else of those in its files."""
        words = [w for w in dict.fromkeys(re.findall(r"[\w.\\\\:]{3,}", task))][:8]
        named = self.graph.nodes.where(F.col("display_name").isin(words) | F.col("canonical_name").isin(words)).select("id", "canonical_name")
        if files:
            named = named.unionByName(change.direct_nodes(self.graph, files).join(self.graph.nodes.select("id", "canonical_name"), "id"))
        out = []
        for r in named.distinct().orderBy("canonical_name", "id").limit(most).collect():
            one = self.graph.spark.createDataFrame([(r["id"],)], "id string")
            ends = [f"{x['direction']} {x['kind']} {x['other_name']}" for side in (True, False) for x in lookup.relationships(self.graph, one, side, 5).collect()]
            out.append(f"{r['canonical_name']}: {'; '.join(ends)}")
        return out

    # --- snapshots and upkeep ----------------------------------------------------------------------------------------------

    def _tables(self, scan: str) -> dict[str, DataFrame]:
        if scan == "active":
            g = self.graph
            return {"files": g.files, "nodes": g.nodes, "edges": g.edges, "classifications": _keyed(g.classifications), "boundaries": g.boundaries, "boundary_memberships": _keyed(g.memberships)}
        there = self.store.tables(scan)
        return {n: _keyed(self.store.read(n, scan)) for n in S.SNAPSHOT_TABLES if n in there}

    def snapshot_graph(self, scan: str) -> Graph:
        """An archived snapshot as a graph; tables that it lacks are empty."""
        there = self.store.tables(scan)
        read = lambda n, schema: self.store.read(n, scan) if n in there else self.graph.spark.createDataFrame([], schema)
        return Graph(read("nodes", S.NODES), read("edges", S.EDGES), read("files", S.FILES), read("classifications", S.CLASSIFICATIONS), read("boundaries", S.BOUNDARIES), read("boundary_memberships", S.MEMBERSHIPS), read("diagnostics", S.DIAGNOSTICS), self.graph.annotations)

    def archive(self, scan_id: str) -> None:
        """Writes the graph as a snapshot of the store and publishes it."""
        g = self.graph
        tables = {"files": g.files, "nodes": g.nodes, "edges": g.edges, "classifications": g.classifications, "boundaries": g.boundaries, "boundary_memberships": g.memberships, "diagnostics": g.diagnostics}
        self.store.write(scan_id, {n: t for n, t in tables.items() if t is not None})

    def snapshot_diff(self, before: str, after: str = "active", max_changes: int = 25) -> Envelope:
        a, b = self._tables(before), self._tables(after)
        moved = {n: {r["operation"]: r["n"] for r in snapshot.diff_counts(a[n], b[n]).collect()} for n in a if n in b}
        a = {n: t for n, t in a.items() if n in b}
        return self._answer("changes", snapshot.snapshot_diff(a, b, max_changes), max_changes, counts=moved, renames=[r.asDict() for r in snapshot.rename_candidates(a["nodes"], b["nodes"]).limit(max_changes).collect()])

    def quality_gate(self, baseline: Graph | str, budgets: dict[str, int] | None = None, policies: list[policy.Policy] | None = None, sarif: bool = False, propose_baseline: bool = False) -> Envelope:
        before = self.snapshot_graph(baseline) if isinstance(baseline, str) else baseline
        budgets, policies = budgets or self.settings.quality_budgets, self.settings.policies if policies is None else policies
        checks = [r.asDict() for r in snapshot.quality_gate(before, self.graph, budgets, policies or ()).collect()]
        data: dict[str, Any] = {"checks": checks}
        if propose_baseline:
            data["proposed_baseline"] = {"budgets": {c["name"]: c["actual"] for c in checks}, "requires_review": True, "applied": False}
        if sarif:
            data["sarif"] = render.sarif(checks)
        return Envelope("passed" if all(c["passed"] for c in checks) else "failed", data, self.project_id, self.snapshot_id)

    def architecture_trends(self, metrics: DataFrame, limit: int = 10) -> Envelope:
        return self._answer("trends", snapshot.trends(metrics, limit), limit)

    def annotate_component(self, component: str, kind: str, value: str | None = None, remove: bool = False, execute: bool = False) -> Envelope:
        """A preview unless ``execute``; then the engine's annotations are the new ones, which the caller stores."""
        after = incremental.annotate(self.graph.annotations, component, kind, value, remove)
        known = not self.graph.nodes.where(F.col("canonical_name") == component).isEmpty()
        if execute:
            self.graph = replace(self.graph, annotations=after)
        return Envelope("executed" if execute else "preview", {"annotations": [r.asDict() for r in after.where(F.col("canonical_name") == component).collect()]}, warnings=[] if known else ["no component has this name"])

    def list_annotations(self, component: str | None = None, kind: str | None = None, limit: int = 100, offset: int = 0) -> Envelope:
        rows = self.graph.annotations
        rows = rows.where(F.col("canonical_name") == component) if component else rows
        rows = rows.where(F.col("kind") == kind) if kind else rows
        return self._answer("annotations", rows.orderBy("canonical_name", "kind").offset(offset), limit)

    def scan_project(self, root: str, patterns: list[str] | None = None, max_files: int | None = None, contributions: DataFrame | None = None, state: str | None = None, force: bool = False) -> Graph:
        """Scans a folder as its checked-in configuration and the arguments say, the latter first.

        Python is read through its syntax tree, PHP and TypeScript by declarations; ``contributions`` of other scanners come in beside them.
        With ``state``, a folder that keeps the graph, only files that changed since the last scan are read, and only what they can touch is
        decided again; nothing is written where nothing changed.  Another configuration, or ``force``, makes every file count as changed.
        """
        spark = self.graph.spark
        settings = config.load(spark, root).overlaid(ignores=tuple(patterns) if patterns is not None else None, max_files=max_files)
        self.settings = settings
        files, found = tree.discover(spark, root, list(settings.ignores), settings.max_files or 100_000, settings.max_file_bytes or 2_000_000)

        def facts(some: DataFrame) -> DataFrame:
            out = python_code.extract(some).withColumn("language", F.lit("python")).unionByName(declared.extract(some))
            if contributions is None:
                return out
            return out.unionByName(contributions.join(some.select(F.col("relative_path").alias("owner_key")), "owner_key", "left_semi"))

        if state is None:
            out = reconcile.reconcile(facts(files), files, self.project_id, found)
        else:
            kept, made = Maintained(BucketStore(spark, state), self.project_id), (SCANNERS, hashlib.sha256(repr(settings).encode()).hexdigest())
            work = kept.work(files, *made, force=force)
            self.last_scan = kept.scan(work, facts(work.changed), *made)
            out = kept.graph(discovery=found)
        nodes = out["nodes"].withColumn("relative_path", F.col("file")).withColumn("attributes_json", F.coalesce("attributes", F.lit("{}")))
        units = tree.manifest_units(files)
        bounds = classify.infer_boundaries(nodes, units).withColumn("id", F.concat_ws(":", "matcher_type", "matcher_value")).withColumn("source", F.lit("inferred"))
        if settings.boundaries:
            bounds = bounds.unionByName(classify.explicit_boundaries(spark, settings.boundaries))
        rules = classify.rules_for(settings.frameworks or tree.frameworks(units), tree.entry_points(units))
        listed = files.select(F.col("relative_path").alias("id"), "relative_path", "content_hash", "size", "language", "line_count")
        blank = lambda df, s: df.select(*[(F.col(c) if c in df.columns else F.lit(None)).cast(s[c].dataType).alias(c) for c in s.names])
        return Graph(
            nodes=blank(nodes.withColumn("file_id", F.col("file")), S.NODES), edges=blank(out["edges"].withColumn("file_id", F.col("file")), S.EDGES), files=listed, classifications=blank(classify.classify(nodes, rules), S.CLASSIFICATIONS),
            boundaries=blank(bounds, S.BOUNDARIES), memberships=classify.memberships(nodes, bounds), diagnostics=blank(out["diagnostics"], S.DIAGNOSTICS),
            annotations=spark.createDataFrame([], S.ANNOTATIONS),
        )

    def git_history(self, root: str, since_days: int = 90, max_commits: int = 500) -> DataFrame:
        self.commits, _ = git.history(self.graph.spark, root, since_days, max_commits)
        return self.commits

    def export_bundle(self, redaction: str = "none") -> bytes:
        tables = {n: df for n in _BUNDLED if (df := getattr(self.graph, n)) is not None}
        return bundle.encode(bundle.redact_all(tables, redaction))

    def import_bundle(self, data: bytes, name: str) -> Graph:
        """A checked bundle as the graph of another project: ids are made anew, and what doesn't hang together is refused."""
        spark, tables = self.graph.spark, bundle.decode(data)
        made = {k: spark.createDataFrame([tuple(r.get(c) for c in schema.names) for r in tables.get(k, [])], schema) for k, schema in _BUNDLED.items()}
        if not bundle.parent_cycles(made["nodes"]).isEmpty():
            raise ValueError("a chain of parents comes back to itself")
        nodes, edges = bundle.remap(made["nodes"], made["edges"], name)
        return Graph(**made | bundle.remap_rest(made, bundle.new_ids(made["nodes"], name)) | {"nodes": nodes, "edges": edges}, annotations=spark.createDataFrame([], S.ANNOTATIONS))

    def remove_project(self, execute: bool = False, state: str | None = None) -> Envelope:
        """How much there is; executed, the graph is emptied, and the folder that a scan kept it in is deleted."""
        sizes = {n: t.count() for n, t in (("nodes", self.graph.nodes), ("edges", self.graph.edges), ("files", self.graph.files))}
        if execute and state is not None:
            BucketStore(self.graph.spark, state).delete()
        if execute:
            self.graph = replace(self.graph, nodes=self.graph.nodes.limit(0), edges=self.graph.edges.limit(0), files=self.graph.files.limit(0), extras={})
        return Envelope("executed" if execute else "preview", sizes)

    def cleanup_stale_scans(self, scans: DataFrame, active: DataFrame, snapshots: DataFrame, now: str, older_than_hours: int = 24) -> Envelope:
        return self._answer("scans", incremental.stale_scans(scans, active, snapshots, now, older_than_hours), 1000)

    def maintain_database(self) -> Envelope:
        g = self.graph
        return self._answer("dangling", incremental.integrity({"edges": g.edges, "nodes": g.nodes, "files": g.files, "memberships": g.memberships, "boundaries": g.boundaries, "classifications": g.classifications}), 100)
