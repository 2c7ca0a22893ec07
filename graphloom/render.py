"""Diagrams, briefs, SARIF and the result envelope: small results turned to text on the driver."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import schema as S
from .graph import Graph, is_external
from .operators import counts, health, policy


@dataclass
class Envelope:
    """What every query of the facade returns."""

    summary: str
    data: dict[str, Any]
    project_id: str | None = None
    snapshot_id: str | None = None
    evidence: list[dict] = field(default_factory=list)
    warnings: list[str] = field(default_factory=list)
    truncated: bool = False
    next_steps: list[str] = field(default_factory=list)

    def json(self) -> str:
        return json.dumps(asdict(self), ensure_ascii=False, sort_keys=True, default=str)

    def within(self, max_chars: int) -> Envelope:
        """Drops from the tail of the longest list until the JSON fits."""
        S.between("max_chars", max_chars, 4000, 100_000)
        while len(self.json()) > max_chars:
            lists = [v for v in self.data.values() if isinstance(v, list) and v]
            if not lists:
                break
            longest = max(lists, key=len)
            del longest[-max(1, len(longest) // 10) :]
            self.truncated = True
        return self


def next_steps(tool: str, found: Envelope) -> list[str]:
    """Up to three tools that follow from an answer, with their arguments."""
    rows = found.data.get("components") or found.data.get("candidates") or found.data.get("hubs") or []
    name = next((r["canonical_name"] for r in rows if r.get("canonical_name")), None)
    if tool in ("find_component", "search_architecture"):
        steps = [f"inspect_component(component={name!r})", f"list_usages(symbol={name!r})"] if name else ["search_architecture with fewer terms"]
    elif tool == "inspect_component" and "component" in found.data:
        name = found.data["component"]["canonical_name"]
        steps = [f"impact_analysis(symbol={name!r})", f"list_usages(symbol={name!r})", f"change_impact(symbol={name!r})"]
    elif tool == "impact_analysis":
        steps = ["test_impact for the files of the dependants", "explain_flow from an entry point"] if found.data.get("dependants") else ["dependency_cycles()"]
    elif tool == "architecture_health":
        steps = [f"inspect_component(component={name!r})", "dependency_cycles()"] if name else ["architecture_summary()"]
    else:
        steps = [f"inspect_component(component={name!r})"] if found.summary == "ambiguous" and name else []
    return steps[:3]


def page(df: DataFrame, limit: int) -> tuple[list[dict], bool]:
    """Rows up to the limit and whether there are more, by asking for one more."""
    rows = [r.asDict(recursive=True) for r in df.limit(limit + 1).collect()]
    return rows[:limit], len(rows) > limit


def legend(rows: list[dict], key: str) -> tuple[list[dict], dict[str, dict]]:
    """Repeated nested objects replaced by their id, and the objects once each."""
    seen: dict[str, dict] = {}
    out = []
    for r in rows:
        if isinstance(r.get(key), dict):
            seen[r[key]["id"]] = r[key]
            r = r | {key: r[key]["id"]}
        out.append(r)
    return out, seen


def diagram_pool(g: Graph, edges: DataFrame, max_nodes: int = 200, boundary: str | None = None) -> DataFrame:
    """The candidates of a diagram: nodes by degree, those without edges last, and name; ``min(2000, 8 * max_nodes)`` at most.  ``boundary``: the id of the boundary that they belong to."""
    nodes = g.nodes if boundary is None else g.nodes.join(g.memberships.where(F.col("boundary_id") == boundary).select(F.col("node_id").alias("id")), "id", "left_semi")
    ranked = nodes.join(counts.degree(edges), "id", "left").select("id", "canonical_name", "display_name", "kind", F.coalesce("degree", F.lit(0)).alias("degree"))
    return ranked.orderBy(F.desc("degree"), "canonical_name", "id").limit(max(min(2000, 8 * max_nodes), max_nodes + 1))


def select_connected(order: list[str], edges: list[tuple[str, str]], most: int) -> list[str]:
    """Greedy: again and again the node with most edges to those chosen, ties in the given order."""
    if len(order) <= most:
        return order
    near: dict[str, list[str]] = {n: [] for n in order}
    for a, b in edges:
        if a in near and b in near and a != b:
            near[a].append(b)
            near[b].append(a)
    place = {n: i for i, n in enumerate(order)}
    pull = dict.fromkeys(order, 0)
    chosen: list[str] = []
    left = set(order)
    while left and len(chosen) < most:
        best = min(left, key=lambda n: (-pull[n], place[n]))
        left.discard(best)
        chosen.append(best)
        for other in near[best]:
            pull[other] += 1
    return chosen


def export_diagram(g: Graph, kinds: list[str] | None = None, min_confidence: str = "possible", max_nodes: int = 200, max_edges: int = 500, form: str = "mermaid", direction: str = "LR", boundary: str | None = None) -> str:
    """A bounded slice of the graph as text.  Only relationships among the pool's few nodes come to the driver, each once."""
    S.between("max_nodes", max_nodes, 1, 400)
    S.between("max_edges", max_edges, 1, 1000)
    if form not in ("mermaid", "plantuml") or direction not in ("LR", "TB"):
        raise ValueError("form is mermaid or plantuml, direction LR or TB")
    edges = g.following(S.kinds_of(kinds, S.IMPACT_KINDS), min_confidence)
    pool = diagram_pool(g, edges, max_nodes, policy.resolve_boundary(g, boundary) if boundary is not None else None).collect()
    ids = g.spark.createDataFrame([(r["id"],) for r in pool], "id string")
    inside = edges.join(F.broadcast(ids.select(F.col("id").alias("source_id"))), "source_id", "left_semi").join(F.broadcast(ids.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    links = [(r[0], r[1], r[2]) for r in inside.select("source_id", "target_id", "kind").distinct().orderBy("source_id", "target_id", "kind").collect()]
    chosen = select_connected([r["id"] for r in pool], [(a, b) for a, b, _ in links], max_nodes)
    alias = {n: f"n{i + 1}" for i, n in enumerate(chosen)}
    names = {r["id"]: r["display_name"] for r in pool}
    kept = [(a, b, k) for a, b, k in links if a in alias and b in alias][:max_edges]
    if form == "mermaid":
        clean = lambda s: s.replace("&", "&amp;").replace('"', "&quot;").replace("<", "&lt;").replace(">", "&gt;")
        lines = [f"flowchart {direction}", *(f'    {alias[n]}["{clean(names[n])}"]' for n in chosen), *(f"    {alias[a]} -->|{k}| {alias[b]}" for a, b, k in kept)]
    else:
        clean = lambda s: s.replace("\\", "\\\\").replace('"', "'")
        lines = ["@startuml", *(["left to right direction"] if direction == "LR" else []), *(f'component "{clean(names[n])}" as {alias[n]}' for n in chosen), *(f"{alias[a]} --> {alias[b]} : {k}" for a, b, k in kept), "@enduml"]
    return "\n".join(lines) + "\n"


def entry_points(g: Graph, most: int = 12) -> DataFrame:
    """Routes, commands and controllers, tests left out."""
    roles = g.classifications.where(F.col("role").contains("controller") | F.col("role").contains("command") | F.col("role").contains("route")).select(F.col("node_id").alias("id")).distinct().withColumn("r", F.lit(True))
    tests = g.classifications.where(F.col("role") == S.TEST_ROLE).select(F.col("node_id").alias("id"))
    return g.nodes.join(roles, "id", "left").where(F.col("r") | F.col("kind").isin(S.ENTRY_KINDS)).where(~is_external()).join(tests, "id", "left_anti").select("id", "kind", "canonical_name").orderBy("canonical_name", "id").limit(most)


def export_brief(g: Graph, max_chars: int = 4000) -> str:
    """A Markdown overview; sections that don't fit are left out whole."""
    S.between("max_chars", max_chars, 1000, 20_000)
    sections = [
        ("Languages", [counts.language_mix(g).first()["mix"]]),
        ("Boundaries", [f"- {r['name']}: {r['member_count']}" for r in counts.member_counts(g).orderBy(F.desc("member_count"), "name").limit(10).collect()]),
        ("Entry points", [f"- {r['canonical_name']} ({r['kind']})" for r in entry_points(g).collect()]),
        ("Hubs", [f"- {r['canonical_name']}: {r['score']}" for r in health.hubs(g, limit=5).collect()]),
    ]
    out, left = "# Architecture\n", []
    for title, lines in sections:
        part = f"\n## {title}\n" + "\n".join(lines) + "\n"
        if len(out) + len(part) <= max_chars - 60:
            out += part
        else:
            left.append(title)
    return out + (f"\nLeft out: {', '.join(left)}\n" if left else "")


def architecture_context(g: Graph, parts: dict[str, list[str]], max_chars: int = 30_000) -> str:
    """Sections with a share of the budget each; what one leaves unused goes to those that need more, in order."""
    shares = {"summary": 0.2, "locations": 0.2, "impact": 0.3, "dossiers": 0.3}
    text = {k: "\n".join(parts.get(k, [])) for k in shares}
    room = {k: int(max_chars * s) for k, s in shares.items()}
    spare = sum(max(0, room[k] - len(text[k])) for k in shares)
    out = []
    for k in shares:
        over = len(text[k]) - room[k]
        if over > 0 and over <= spare:
            spare -= over
        elif over > 0:
            out.append(f"## {k}\nomitted")
            continue
        out.append(f"## {k}\n{text[k]}")
    return "\n\n".join(out)


def sarif(checks: list[dict], most: int = 200) -> str:
    """Failed checks as SARIF 2.1.0."""
    failed = [c for c in checks if not c["passed"]][:most]
    results = [{"ruleId": c["name"], "level": "error", "message": {"text": f"{c['name']}: {c['actual']} over {c['budget']}"}} for c in failed]
    return json.dumps({"version": "2.1.0", "$schema": "https://json.schemastore.org/sarif-2.1.0.json", "runs": [{"tool": {"driver": {"name": "graphloom", "rules": [{"id": r} for r in sorted({c["name"] for c in failed})]}}, "results": results}]})
