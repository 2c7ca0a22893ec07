"""Small graphs with exact expected answers."""

import itertools
import random
import subprocess
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from graphloom import config, render
from graphloom.engine import Engine
from graphloom.graph import Graph, Later
from graphloom.operators import change, counts, health, lookup, policy, scc, snapshot, traverse
from graphloom.sources import bundle


def node(i, kind="class", name=None, origin="ast", **more):
    return {"id": i, "language": "php", "kind": kind, "canonical_name": name or f"App\\{i}", "display_name": (name or i), "origin": origin, "confidence": "certain", "attributes_json": "{}", **more}


def edge(i, a, kind, b, confidence="certain"):
    return {"id": i, "kind": kind, "source_id": a, "target_id": b, "file_id": "f", "start_line": 1, "origin": "ast", "confidence": confidence}


@pytest.fixture(scope="module")
def shop(spark):
    return Graph.of(
        spark,
        nodes=[node("Checkout"), node("Invoice"), node("Orphan"), node("Order"), node("route", "route"), node("Worker")],
        edges=[edge("1", "Checkout", "calls", "Invoice"), edge("2", "Invoice", "calls", "Checkout", "probable"), edge("3", "route", "routes_to", "Checkout"), edge("4", "Worker", "depends_on", "Worker")],
        files=[{"id": "f", "relative_path": "src/Checkout.php", "language": "php", "line_count": 40, "size": 900, "content_hash": "x"}],
        classifications=[{"node_id": "Checkout", "role": "application.controller", "origin": "derived", "confidence": "probable", "rule_id": "r"}],
        boundaries=[{"id": "b1", "name": "Backend", "matcher_type": "path_prefix", "matcher_value": "src", "source": "explicit"}, {"id": "b2", "name": "Billing", "matcher_type": "path_prefix", "matcher_value": "bill", "source": "explicit"}],
        memberships=[{"boundary_id": "b1", "node_id": "Checkout"}, {"boundary_id": "b2", "node_id": "Invoice"}],
    )


def ids(g, *names):
    return g.spark.createDataFrame([(n,) for n in names], "id string")


def test_impact_takes_levels_and_the_best_confidence(shop):
    rows = {r["id"]: (r["distance"], r["rank"]) for r in traverse.impact(shop, ids(shop, "Invoice")).collect()}
    assert rows == {"Checkout": (1, 3), "route": (2, 3)}
    assert traverse.impact(shop, ids(shop, "Invoice"), kinds=["imports"]).count() == 0
    entries = traverse.entry_points(shop, traverse.impact(shop, ids(shop, "Invoice")), ["application.controller"])
    assert {r["id"] for r in entries.collect()} == {"Checkout", "route"}
    with pytest.raises(ValueError):
        traverse.impact(shop, ids(shop, "Invoice"), max_depth=9)


def test_changed_files_keep_all_their_components(spark):
    many = [f"N{i:04}" for i in range(1100)]
    g = Graph.of(
        spark,
        nodes=[node(i, file_id="f") for i in many] + [node("Caller")],
        edges=[edge("1", "Caller", "calls", many[-1])],
        files=[{"id": "f", "relative_path": "src/Many.php", "language": "php", "line_count": 40, "size": 900, "content_hash": "x"}],
    )
    assert sorted(r["id"] for r in change.direct_nodes(g, ["src/Many.php"]).collect()) == many
    assert [(r["id"], r["distance"], r["seed"]) for r in change.changed_files_impact(g, ["src/Many.php"], 1).collect()] == [("Caller", 1, many[-1])]


def test_cycles_with_and_without_self_loops(shop):
    rows = scc.dependency_cycles(shop).collect()
    assert [(r["size"], r["min_confidence"]) for r in rows] == [(2, "probable")]
    assert [r["size"] for r in scc.dependency_cycles(shop, include_self_loops=True).collect()] == [2, 1]
    assert scc.dependency_cycles(shop, min_confidence="certain").count() == 0
    with pytest.raises(ValueError):
        scc.dependency_cycles(shop, ["contains"])


def test_hotspot_score_adds_degree_crossings_and_cycle(shop):
    top = health.hotspots(shop).first()
    assert top["id"] == "Checkout" and top["score"] == 3 + 2 * 2 + 3
    hubs = [r["id"] for r in health.hubs(shop).collect()]
    assert hubs[0] == "Checkout" and "Orphan" not in hubs


def test_dead_code_reasons(spark, shop):
    dead = {r["id"]: r["reason"] for r in health.dead_code(shop, suppress=["App\\Ord*"]).collect()}
    assert dead == {"Orphan": None, "Order": "suppressed"}
    g = Graph.of(spark, nodes=[node("Base"), node("Sub"), node("Base.run", "method", "run"), node("Sub.run", "method", "run"), node("Use")],
                 edges=[edge("1", "Sub", "extends", "Base"), edge("2", "Base", "contains", "Base.run"), edge("3", "Sub", "contains", "Sub.run"), edge("4", "Use", "calls", "Base")])
    reasons = {r["id"]: r["reason"] for r in health.dead_code(g).collect()}
    assert reasons["Sub.run"] == "inherited" and reasons["Base.run"] == "contract"


def test_policy_reasons(shop):
    rows = policy.violations(shop, [policy.Policy("p", "Backend", ("b1",), ("b2",))]).collect()
    assert [(r["edge_id"], r["reasons"]) for r in rows] == [("1", "denied_target,target_not_allowed")]
    with pytest.raises(ValueError):
        policy.violations(shop, [policy.Policy("p", "Nowhere", ("b1",))])


def test_flow_ranks_and_ends_at_the_target(spark):
    g = Graph.of(spark, nodes=[node(x, "function") for x in "abcd"], edges=[edge("1", "a", "calls", "b"), edge("2", "b", "calls", "d", "possible"), edge("3", "a", "dispatches", "c"), edge("4", "c", "handles", "d"), edge("5", "d", "calls", "a")])
    rows = [(r["signature"], r["hops"], r["rank"]) for r in traverse.paths(g, ids(g, "a"), ids(g, "d")).collect()]
    assert rows == [("a>c>d", 2, 3), ("a>b>d", 2, 1)]


def test_resolution_tiers(shop):
    assert [r["id"] for r in lookup.resolve(shop, "Orphan").collect()] == ["Orphan"]
    assert {r["id"] for r in lookup.resolve(shop, "app\\or").collect()} == {"Orphan", "Order"}


@pytest.mark.parametrize("seed", range(4))
def test_components_are_mutual_reachability(spark, seed):
    rnd = random.Random(seed)
    edges = {(f"n{rnd.randrange(14):02}", f"n{rnd.randrange(14):02}") for _ in range(22)}
    reach = set(edges)
    while more := {(a, d) for a, b in reach for c, d in edges if b == c} - reach:
        reach |= more
    want = {}
    for a, b in itertools.product({x for e in edges for x in e}, repeat=2):
        if a != b and (a, b) in reach and (b, a) in reach:
            want[a] = min(want.get(a, a), b)
    df = spark.createDataFrame(sorted(edges), "source_id string, target_id string")
    assert {r["id"]: r["component"] for r in scc.components(df).collect()} == want
    if seed < 2:
        assert {r["id"]: r["component"] for r in scc.coloured_components(df).collect()} == want


def test_diff_moved_and_changed(spark):
    a = spark.createDataFrame([("1", "x", "f"), ("2", "x", "f"), ("3", "x", "f"), ("4", None, None)], "id string, display_name string, file_id string")
    b = spark.createDataFrame([("1", "x", "g"), ("2", "y", "g"), ("5", "x", "f"), ("4", None, None)], "id string, display_name string, file_id string")
    assert {(r["key"], r["operation"]) for r in snapshot.diff(a, b).collect()} == {("1", "moved"), ("2", "changed"), ("2", "moved"), ("3", "removed"), ("5", "added")}


def test_metrics_look_ends_up_by_component(spark):
    """Edges with a missing end count for nothing, whether the components on cycles are known or not; the edges aren't sent for it."""
    names = [f"n{i:03}" for i in range(60)]
    ring = [edge(f"e{i}", names[i], "calls", names[(i + 1) % 30]) for i in range(30)]
    loose = [edge("x1", "n040", "calls", "gone"), edge("x2", "gone", "calls", "n040"), edge("x3", "n041", "calls", "n040"), edge("x4", None, "calls", "n040")]
    g = Graph.of(spark, nodes=[node(n) for n in names], edges=ring + loose)
    found = scc.components(g.following(["calls"]))
    assert found.count() == 32 and [tuple(r)[:3] for r in snapshot.quality_metrics(g, found).collect()] == [tuple(r)[:3] for r in snapshot.quality_metrics(g).collect()] == [(1, 2, 29)]
    whole = Graph.of(spark, nodes=[node(n) for n in names], edges=ring)
    edges, degrees, all_ = snapshot._with_ends(whole.following(["calls"]), whole.nodes.select("id"))
    assert all_ and "Join" not in edges._jdf.queryExecution().optimizedPlan().toString() and degrees.where("in_degree = 1 AND out_degree = 1").count() == 30


def test_what_hangs_on_nothing_is_peeled_off_in_one_sending(spark):
    """Two steps of a tree go at once; a relation that repeats counts once; what is on a ring stays."""
    pairs = [(f"a{i}", f"b{i % 7}") for i in range(50)] + [(f"b{i}", "r0") for i in range(7)] + [("r0", "r1"), ("r1", "r0"), ("r1", "r0"), ("r1", "z"), (None, "r0"), ("r0", None)]
    relations = spark.createDataFrame(pairs, "source_id string, target_id string")
    rounds = scc.Rounds()
    left = scc._peel(relations, "source_id", "target_id", rounds)
    assert rounds.n == 1 and sorted(map(tuple, left.collect())) == [("r0", "r1"), ("r1", "r0"), ("r1", "z")]
    assert sorted(map(tuple, scc._peel(left, "target_id", "source_id", rounds).collect())) == [("r0", "r1"), ("r1", "r0")]
    assert sorted(map(tuple, scc.components(relations, 1).collect())) == [("r0", "r0"), ("r1", "r0")]


def test_impact_is_the_same_for_small_and_large_frontiers(spark, monkeypatch):
    rnd = random.Random(5)
    g = Graph.of(spark, nodes=[node(f"n{i}") for i in range(40)], edges=[edge(str(i), f"n{rnd.randrange(40)}", rnd.choice(["calls", "imports"]), f"n{rnd.randrange(40)}", rnd.choice(["certain", "probable", "possible"])) for i in range(90)])
    seeds = spark.createDataFrame([("n1",), ("n2",)], "id string")
    both = lambda: [sorted(map(str, f(g, seeds, 6).collect())) for f in (traverse.impact, traverse.nearest_impact)]
    written = []
    monkeypatch.setattr(traverse, "hops", lambda *a, f=traverse.hops: written.append(1) or f(*a))
    small = both()
    assert not written
    monkeypatch.setattr(traverse, "FEW_FRONTIER", 0)
    assert both() == small and len(written) == 2


def test_paths_of_edges_take_only_the_files_they_name(spark, monkeypatch):
    monkeypatch.setattr(lookup, "FEW_FILES", 3)
    files = spark.range(5000).select(F.concat(F.lit("f"), F.col("id").cast("string")).alias("id"), F.concat(F.lit("src/"), F.col("id").cast("string")).alias("relative_path"))
    edges = spark.createDataFrame([(str(i), None if i == 3 else f"f{9000 if i == 5 else i % 2}") for i in range(40)], "id string, file_id string")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        few = lookup.with_paths(edges, edges, files)
        assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString()
        want = {(str(i), None if i in (3, 5) else f"src/{i % 2}") for i in range(40)}
        assert {(r["id"], r["relative_path"]) for r in few.collect()} == want and few.count() == 40
        monkeypatch.setattr(lookup, "FEW_FILES", 1)
        many = lookup.with_paths(edges, edges, files)
        assert "BroadcastHashJoin" not in many._jdf.queryExecution().executedPlan().toString() and {(r["id"], r["relative_path"]) for r in many.collect()} == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_edges_pass_names_without_being_sorted(spark, monkeypatch):
    monkeypatch.setattr(lookup, "HELD", 2)
    nodes = Graph.of(spark, nodes=[node(f"n{i}") for i in range(20)]).nodes
    edges = spark.createDataFrame([(str(i), f"n{i % 23}", f"n{i * 7 % 20}") for i in range(60)] + [("x", None, "n1"), ("y", "n1", None)], "id string, source_id string, target_id string")
    want = {(str(i), f"App\\n{i % 23}", f"App\\n{i * 7 % 20}") for i in range(60) if i % 23 < 20}
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for few in (0, 100):
            monkeypatch.setattr(lookup, "FEW_NODES", few)
            named = lookup.with_ends(edges, nodes)
            assert {(r["id"], r["source"], r["target"]) for r in named.collect()} == want
            plan = named._jdf.queryExecution().executedPlan().toString()
            assert ("Sort" in plan) == (few > 0) and named.rdd.getNumPartitions() >= (10 if not few else 1)
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_empty_graph(spark):
    g = Graph.of(spark)
    assert counts.degree(g.edges).count() == 0 and health.dead_code(g).count() == 0 and scc.dependency_cycles(g).count() == 0
    assert traverse.impact(g, ids(g, "x")).count() == 0


def test_engine_and_envelope(shop):
    e = Engine(shop)
    assert e.find_component("Checkout").data["ambiguous"] is False
    assert e.impact_analysis("Invoice").data["by_distance"] == {1: 1, 2: 1}
    assert e.inspect_component("Checkout").data["roles"] == ["application.controller"]
    assert len(e.tools()) >= 33
    with pytest.raises(ValueError):
        e.call("drop_everything")
    big = render.Envelope("x", {"rows": [{"n": "y" * 100} for _ in range(200)]}).within(4000)
    assert big.truncated and len(big.json()) <= 4000


def test_diagram_selection_is_greedy():
    assert render.select_connected(["a", "b", "c", "d"], [("a", "d"), ("c", "d")], 3) == ["a", "d", "c"]


def test_counts_are_exact(shop):
    assert {r["id"]: r["degree"] for r in counts.degree(shop.edges).collect()}["Worker"] == 2
    row = counts.cohesion(shop, shop.edges).where("boundary_id = 'b1'").first()
    assert (row["incident"], row["internal"]) == (3, 0)
    assert counts.count_by(shop.edges, "kind").first().asDict() == {"kind": "calls", "n": 2}
    assert shop.edges.where(F.col("kind") == "calls").count() == 2


def test_changed_files_answer_tells_all_that_was_looked_at(spark, tmp_path):
    g = Graph.of(
        spark, nodes=[node("A") | {"file_id": "f1"}, node("B") | {"file_id": "f2"}, node("route", "route") | {"file_id": "f3"}],
        edges=[edge("1", "B", "calls", "A", "possible"), edge("2", "route", "routes_to", "B")], files=[{"id": f"f{i}", "relative_path": f"src/{i}.php", "content_hash": str(i)} for i in (1, 2, 3)],
    )
    e = Engine(g)
    out = e.call("changed_files_impact", files=["src/1.php", "gone.php"])
    assert [r["id"] for r in out.data["components"]] == ["B", "route"] and out.data["unresolved_files"] == ["gone.php"]
    assert [(r["id"], r["relative_path"]) for r in out.data["direct_components"]] == [("A", "src/1.php")] and [r["id"] for r in out.data["entry_points"]] == ["route"]
    assert out.evidence[0]["component_id"] == "A"
    assert e.changed_files_impact(["src/1.php"], min_confidence="certain").data["components"] == []
    with pytest.raises(ValueError, match="either"):
        e.changed_files_impact()
    run = lambda *a: subprocess.run(["git", "-C", str(tmp_path), "-c", "user.name=a", "-c", "user.email=a@b", *a], check=True, capture_output=True)
    (tmp_path / "src").mkdir()
    (tmp_path / "src/1.php").write_text("<?php")
    run("init", "-q")
    run("add", ".")
    run("commit", "-qm", "x")
    assert e.changed_files_impact(working_tree=str(tmp_path)).data["changed_files"] == []
    (tmp_path / "src/1.php").write_text("<?php 1;")
    assert [r["id"] for r in e.changed_files_impact(working_tree=str(tmp_path)).data["components"]] == ["B", "route"]


def test_answers_tell_whether_the_graph_is_fresh(spark):
    g = Graph.of(spark, nodes=[node("A")], files=[{"id": "f", "relative_path": "a.php", "content_hash": "1"}])
    same = spark.createDataFrame([("a.php", "1")], "relative_path string, content_hash string")
    other = spark.createDataFrame([("a.php", "2"), ("b.php", "1")], same.schema)
    scans = []
    e = Engine(g)
    refresh = lambda: scans.append(1) or replace(g, files=other.select(F.col("relative_path").alias("id"), "relative_path", "content_hash"))
    assert e.call("find_component", name="A", listing=same, refresh=refresh).data["staleness"]["state"] == "fresh" and scans == []
    stale = e.call("find_component", name="A", listing=other).data["staleness"]
    assert (stale["state"], stale["changed_files_since"], stale["added_files_since"], stale["deleted_files_since"]) == ("stale", 1, 1, 0)
    assert e.call("find_component", name="A", listing=other, refresh=refresh).data["staleness"]["state"] == "fresh" and scans == [1]


def test_configured_policies_and_budgets_are_applied(spark, shop):
    e = Engine(shop)
    with pytest.raises(ValueError, match="configured"):
        e.check_architecture()
    e.settings = config.parse('{"version": 1, "policies": [{"id": "p", "from_boundary": "Backend", "deny_targets": ["Billing"]}], "quality_budgets": {"boundary_violations": 0}, "dead_code_suppressions": ["App*"]}')
    assert e.check_architecture().data["total"] == 1
    gate = e.quality_gate(shop)
    assert gate.summary == "failed" and gate.data["checks"][0]["actual"] == 1
    assert "App\\Orphan" not in {r["canonical_name"] for r in e.architecture_health().data["dead_code_candidates"]}
    assert "App\\Orphan" in {r["canonical_name"] for r in e.architecture_health(suppress=[]).data["dead_code_candidates"]}


def test_bundles_hold_all_tables_and_strict_ones_no_paths(spark, shop):
    g = replace(
        shop, files=spark.createDataFrame([("src/Secret.php", "src/Secret.php", "x", 1, "php", 1)], shop.files.schema), nodes=shop.nodes.withColumn("file_id", F.lit("src/Secret.php")),
        diagnostics=spark.createDataFrame([("src/Secret.php:1", "error", "E", "in src/Secret.php")], shop.diagnostics.schema),
    )
    e = Engine(g)
    back = e.import_bundle(e.export_bundle(), "other")
    names = back.nodes.select(F.col("id").alias("node_id"), "canonical_name")
    assert {(r["canonical_name"], r["role"]) for r in back.classifications.join(names, "node_id").collect()} == {("App\\Checkout", "application.controller")}
    assert {(r["canonical_name"], r["boundary_id"]) for r in back.memberships.join(names, "node_id").collect()} == {("App\\Checkout", "b1"), ("App\\Invoice", "b2")}
    assert back.boundaries.count() == 2 and back.diagnostics.first()["message"] == "in src/Secret.php"
    for level in ("paths", "strict"):
        tables = bundle.decode(e.export_bundle(level))
        text = bundle.canonical({k: v for k, v in tables.items() if level == "strict" or k != "diagnostics"}).decode()
        assert "Secret" not in text and {n["file_id"] for n in tables["nodes"]} == {f["id"] for f in tables["files"]}
    with pytest.raises(ValueError, match="unknown component"):
        Engine(replace(g, nodes=g.nodes.where("id <> 'Checkout'"), edges=g.edges.limit(0))).import_bundle(Engine(replace(g, nodes=g.nodes.where("id <> 'Checkout'"), edges=g.edges.limit(0))).export_bundle(), "x")


def test_parent_rings_are_told_from_long_chains(spark):
    up = [(f"c{i}", f"c{i + 1}") for i in range(200)] + [(f"r{i}", f"r{(i + 1) % 70}") for i in range(70)] + [("below", "r3"), ("own", "own"), ("top", None)]
    found = bundle.parent_cycles(spark.createDataFrame(up, "id string, parent_id string"))
    assert sorted(r["id"] for r in found.collect()) == sorted([f"r{i}" for i in range(70)] + ["below", "own"])


def test_subtypes_members_are_paired_without_a_shuffle_of_the_pairs(spark, monkeypatch):
    monkeypatch.setattr(health, "CHUNK", 2)
    members = [("a", f"m{i}") for i in range(7)] + [("b", "m0"), ("b", "n0")]
    nodes = [node(f"{o}.{m}", "method", m) for o, m in members] + [node(x) for x in ("a", "b", "T", "U", "V")]
    edges = [edge(f"{o}.{m}", o, "contains", f"{o}.{m}") for o, m in members] + [edge("1", "a", "extends", "T"), edge("2", "a", "implements", "T"), edge("3", "a", "extends", "U"), edge("4", "b", "extends", "U"), edge("5", "T", "extends", "V")]
    found = health.subtype_member_names(Graph.of(spark, nodes=nodes, edges=edges))
    mine = [f"m{i}" for i in range(7)]
    assert sorted((r["id"], r["display_name"]) for r in found.collect()) == sorted([("T", m) for m in mine] + [("U", m) for m in [*mine, "n0"]])
    # Two hundred types below one type with two hundred members: 40 000 pairs, of which none is shuffled.
    names = [f"k{i}" for i in range(200)]
    g = Graph.of(spark, nodes=[node(n) for n in [*names, "top"]], edges=[edge(f"c{n}", "top", "contains", n) for n in names] + [edge(f"x{n}", "top", "extends", n) for n in names])
    pairs = health.subtype_member_names(g)
    assert pairs.count() == 40_000 and pairs.distinct().count() == 40_000
    plan = pairs._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Generate explode(display_names") < plan.index("Repartition")


def test_pairs_of_types_and_names_are_dealt_over_tasks_by_their_number(spark, monkeypatch):
    """Few bytes may stand for many pairs: what is shuffled small isn't made by one task."""
    monkeypatch.setattr(health, "CHUNK", 8)
    names = [f"k{i}" for i in range(40)]
    g = Graph.of(spark, nodes=[node(n) for n in [*names, "top"]], edges=[edge(f"c{n}", "top", "contains", n) for n in names] + [edge(f"x{n}", "top", "extends", n) for n in names])
    pairs = health.subtype_member_names(g)
    assert {tuple(r) for r in pairs.collect()} == {(a, b) for a in names for b in names} and pairs.count() == 1600
    assert pairs.withColumn("task", F.spark_partition_id()).select("task").distinct().count() >= 8


def test_a_table_is_made_when_it_is_read_first(spark):
    from graphloom.views import TABLES_OF_GRAPH, graph

    made = []
    g = graph(spark, "/root/testdata/sf0.001")
    plain = Graph(**{n: Later(lambda n=n: made.append(n) or getattr(g, n)) for n in TABLES_OF_GRAPH})
    assert lookup.find_component(plain, "nation_1").count() > 0 and snapshot.public_surface(plain.with_edges(plain.nodes)).count() > 0
    assert sorted(made) == ["classifications", "nodes"]


def test_parts_bought_one_after_the_other_are_shuffled_once(spark, tmp_path):
    from graphloom.views import VIEWS, view

    rows = [(o, (o * 7 + n * n) % 11, n) for o in range(60) for n in (1, 2, 2, 4, 5, 7)] + [(99, 3, 1), (99, None, 2), (None, 4, 1)]
    spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int").write.parquet(f"{tmp_path}/lineitem.parquet")
    lines = spark.read.parquet(f"{tmp_path}/lineitem.parquet")
    lines.createOrReplaceTempView("lineitem")
    found = view(spark, str(tmp_path), "co")
    assert sorted(found.collect()) == sorted(spark.sql(VIEWS["co"]).collect()) and found.count() == 11
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 3
