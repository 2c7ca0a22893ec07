"""What is kept from scan to scan, and the searches that ask only for what is needed, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.graph import Graph
from graphloom.ingest import reconcile, resolution
from graphloom.ingest.incremental import SnapshotError
from graphloom.ingest.intervals import Intervals
from graphloom.ingest.maintain import Maintained
from graphloom.ingest.store import BucketStore, StoreError, upsert_into
from graphloom.operators import scc, snapshot, traverse
from graphloom.schema import CONTRIBUTION


# --- references ---------------------------------------------------------------------------------------------------------------


def plainly(target, declared, edges):
    """What a reference names, by one walk from it; ``edges`` in order of file and place."""
    sources, returns = {}, {}
    for kind in resolution.COMPOSITION:
        for k, s, t in edges:
            if k == kind and t not in sources.setdefault(s, []):
                sources[s].append(t)
    for k, s, t in edges:
        if k == "returns":
            returns.setdefault(s, t)

    def up(language, owner, probe):
        level = [x for kind in resolution.TYPE_KINDS for x in sources.get(f"{language}:{kind}:{owner}", [])]
        seen = set()
        for _ in range(20):
            below = []
            for ref in level:
                if ref in seen:
                    continue
                seen.add(ref)
                p = ref.split(":", 2)
                if len(p) != 3 or p[0] != language or not all(p):
                    continue
                if (hit := probe(p[2])) is not None:
                    return hit
                below += sources.get(ref, [])
            level = below
        return None

    parts = target.split(":", 2)
    deferred = ":method_of_return:" in target
    goal = target
    if deferred:
        call, _, member = parts[2].rpartition("::")
        owner, _, name = call.rpartition("::")
        told = returns.get(f"{parts[0]}:method:{call}")
        if told is None and owner and name:
            told = up(parts[0], owner, lambda t: returns.get(f"{parts[0]}:method:{t}::{name}"))
        if told is None or len(told.split(":", 2)) != 3:
            return "dropped", None
        goal = f"{parts[0]}:method:{told.split(':', 2)[2]}::{member}"
    elif ":namespaced_function:" in target:
        own = f"{parts[0]}:function:{parts[2]}"
        goal = own if own in declared else f"{parts[0]}:function:{parts[2].rsplit(chr(92), 1)[-1]}"
    if goal in declared:
        return "resolved", goal
    p = goal.split(":", 2)
    if len(p) == 3 and p[1] in resolution.TYPE_KINDS:
        for kind in resolution.TYPE_KINDS:
            if f"{p[0]}:{kind}:{p[2]}" in declared:
                return "resolved", f"{p[0]}:{kind}:{p[2]}"
    if len(p) == 3 and p[1] in resolution.MEMBER_KINDS and "::" in p[2]:
        owner, _, member = p[2].rpartition("::")
        hit = up(p[0], owner, lambda t: x if (x := f"{p[0]}:{p[1]}:{t}::{member}") in declared else None) if owner and member else None
        if hit:
            return "resolved", hit
    if deferred:
        return "dropped", None
    return ("external", goal) if len(p) == 3 and all(p) else ("malformed", None)


def world(rnd, types=9, calls=40):
    """Declared references, and relationships of every sort that a decision looks at; with rings, ties and another language."""
    kind = {f"T{i}": rnd.choice(resolution.TYPE_KINDS) for i in range(types)}
    declared = {f"php:{k}:{t}" for t, k in kind.items() if rnd.random() < 0.8}
    declared |= {f"php:{rnd.choice(['method', 'property'])}:T{rnd.randrange(types)}::{m}" for m in "abc" for _ in range(2)}
    declared |= {"php:function:f", "php:function:N\\g", "ts:method:T1::a"}
    edges = []
    for t in kind:
        for _ in range(rnd.choice([0, 1, 1, 2, 3])):
            other = f"T{rnd.randrange(types)}"
            language = "ts" if rnd.random() < 0.1 else "php"
            edges.append((rnd.choice(resolution.COMPOSITION), f"php:{kind[t]}:{t}", f"{language}:{kind[other]}:{other}"))
    for _ in range(6):
        edges.append(("returns", f"php:method:T{rnd.randrange(types)}::{rnd.choice('abc')}", rnd.choice([f"php:class:T{rnd.randrange(types)}", f"php:class:T{rnd.randrange(types)}", "none"])))
    targets = [f"php:{rnd.choice(['method', 'method', 'property'])}:T{rnd.randrange(types)}::{rnd.choice('abc')}" for _ in range(calls)]
    targets += [f"php:method_of_return:T{rnd.randrange(types)}::{rnd.choice('abc')}::{rnd.choice('abc')}" for _ in range(calls // 2)]
    targets += [f"php:{rnd.choice(resolution.TYPE_KINDS)}:T{rnd.randrange(types + 1)}" for _ in range(8)]
    targets += ["php:namespaced_function:N\\f", "php:namespaced_function:N\\g", "php:namespaced_function:N\\h", "none", "php:class:", "php:method:a", "php:method_of_return:x", "php:method:::a"]
    return declared, edges, targets


@pytest.mark.parametrize("seed", range(2))
def test_decisions_are_those_of_a_plain_walk(spark, seed):
    declared, edges, targets = world(random.Random(seed))
    rows = [(k, s, t, "f", i) for i, (k, s, t) in enumerate(edges + [("calls", "x", t) for t in targets])]
    facts = spark.createDataFrame(rows, "kind string, source string, target string, file string, place int")
    known = resolution.Known.of(facts, spark.createDataFrame([(r, r) for r in declared], "ref string, id string"))
    out, reads = resolution.resolve_references(facts.where("kind = 'calls'"), known)
    got = {r["target"]: r for r in out.collect()}
    assert set(got) == set(targets)
    for t in targets:
        status, goal = plainly(t, declared, edges)
        assert got[t]["status"] == status, t
        if status == "resolved":
            assert got[t]["target_id"] == goal
        elif status == "external":
            assert ":".join((got[t]["t_lang"], got[t]["t_kind"], got[t]["t_name"])) == goal
    # Whatever changes a decision is among what that decision read.
    read = {(r["target"], r["key"]) for r in reads.collect()}
    for t in targets:
        for gone in sorted(declared):
            if plainly(t, declared - {gone}, edges) != plainly(t, declared, edges):
                assert (t, f"n|{gone}") in read
        for i, (k, s, _) in enumerate(edges):
            if plainly(t, declared, edges[:i] + edges[i + 1 :]) != plainly(t, declared, edges):
                assert (t, f"{'r' if k == 'returns' else 'u'}|{s}") in read


def test_a_walk_asks_only_for_what_is_missing(spark):
    """Ten thousand types above one another, and one call that finds its member two above."""
    n = 10_000
    chain = spark.range(n).select(F.lit("extends").alias("kind"), F.concat(F.lit("php:class:T"), "id").alias("source"), F.concat(F.lit("php:class:T"), F.col("id") + 1).alias("target"), F.lit("f").alias("file"), F.col("id").alias("place"))
    links = resolution.links(chain)
    asked = spark.createDataFrame([("php", "T5", "method:a")], "lang string, type string, probe string")
    holders = spark.createDataFrame([("php", "T7", "method:a", "found")], "lang string, type string, probe string, value string")
    hits, visited = resolution.walk(asked, links, holders)
    assert [r["value"] for r in hits.collect()] == ["found"]
    assert sorted((r["ref"], r["depth"]) for r in visited.collect()) == [("php:class:T6", 1), ("php:class:T7", 2)]
    none = resolution.walk(asked.where("false"), links, holders)
    assert none[0].count() == 0 and none[1].count() == 0


# --- maintenance --------------------------------------------------------------------------------------------------------------


def facts_of(rnd, path, types):
    """A file's declarations and relationships, as a scanner states them."""
    nodes, edges = [("class", f"App{path}")], []
    for t in types:
        if rnd.random() < 0.35:
            nodes.append((rnd.choice(["class", "class", "trait", "interface"]), t))
            nodes += [("method", f"{t}::{m}") for m in "ab" if rnd.random() < 0.4]
    if rnd.random() < 0.5:
        nodes.append(("function", rnd.choice(["f", "N\\f"])))
    own = [f"php:{k}:{c}" for k, c in nodes if k in ("class", "trait", "interface")]
    for s in own:
        for k in rnd.sample(resolution.COMPOSITION, rnd.choice([0, 1, 2])):
            edges.append((k, s, f"php:{rnd.choice(['class', 'trait', 'interface'])}:{rnd.choice(types)}"))
    for k, c in nodes:
        if k == "method" and rnd.random() < 0.5:
            edges.append(("returns", f"php:method:{c}", f"php:class:{rnd.choice(types)}"))
    for _ in range(6):
        t = rnd.choice(types)
        edges.append(("calls", own[0], rnd.choice([f"php:method:{t}::{rnd.choice('ab')}", f"php:method_of_return:{t}::{rnd.choice('ab')}::{rnd.choice('ab')}", f"php:class:{t}", "php:namespaced_function:N\\f", "nothing"])))
    return nodes, edges


def contributions(spark, files):
    rows = []
    for path, (nodes, edges) in files.items():
        n = [(f"{k}:{c}", k, c, c.split("::")[-1], "ast", "certain", 1, 2, "{}") for k, c in nodes]
        e = [(k, s, t, "ast", "certain", 3 + i // 2) for i, (k, s, t) in enumerate(edges)]
        rows.append((path, n, e, [("info", "NOTE", path)]))
    return spark.createDataFrame(rows, CONTRIBUTION).withColumn("language", F.lit("php"))


def listing(spark, files):
    return spark.createDataFrame([(p, str(hash(str(v)))) for p, v in files.items()], "relative_path string, content_hash string")


def shown(graph):
    return {name: sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect()))) for name, df in graph.items()}


@pytest.mark.parametrize("seed", [1])
def test_maintained_equals_reconciled(spark, tmp_path, seed):
    rnd = random.Random(seed)
    types = [f"T{i}" for i in range(6)]
    kept = Maintained(BucketStore(spark, f"file://{tmp_path}/store", 1), "p")
    files = {f"{i}.php": facts_of(rnd, i, types) for i in range(6)}
    for version in range(2):
        if version:
            some = rnd.sample(sorted(files), 3)
            for path in some[:2]:
                files[path] = facts_of(rnd, path, types)
            del files[some[2]]
            files[f"new{version}.php"] = facts_of(rnd, f"new{version}", types)
        work = kept.work(listing(spark, files), "1", "c")
        changed = {r["relative_path"] for r in work.changed.collect()}
        done = kept.scan(work, contributions(spark, {p: v for p, v in files.items() if p in changed}), "1", "c")
        assert done.number == version + 1 and not work.nothing and len(changed) == (6 if version == 0 else 3)
        full = reconcile.reconcile(contributions(spark, files), listing(spark, files), "p")
        assert shown(kept.graph()) == shown(full)
    again = kept.work(listing(spark, files), "1", "c")
    assert again.nothing and kept.scan(again, contributions(spark, files), "1", "c").number == 2
    assert kept.work(listing(spark, files), "2", "c").changed.count() == len(files)


def test_a_body_that_changes_decides_nothing_again(spark, tmp_path):
    kept = Maintained(BucketStore(spark, f"file://{tmp_path}/store", 1), "p")
    files = {"a.php": ([("class", "A"), ("method", "A::go")], []), "b.php": ([("class", "B")], [("extends", "php:class:B", "php:class:A")]), "c.php": ([("class", "C")], [("calls", "php:class:C", "php:method:B::go")])}
    kept.scan(kept.work(listing(spark, files), "1", "c"), contributions(spark, files), "1", "c")

    def change(path, facts):
        files[path] = facts
        work = kept.work(listing(spark, files), "1", "c")
        return kept.scan(work, contributions(spark, {path: facts}), "1", "c")

    same = change("a.php", ([("class", "A"), ("method", "A::go"), ("method", "A::more")], []))
    assert (same.decided_again, same.files_linked_again) == (0, 1)
    # The member goes: the call that found it through B is decided again, in a file that didn't change.
    less = change("a.php", ([("class", "A")], []))
    assert (less.decided_again, less.files_linked_again) == (1, 2)
    with pytest.raises(ValueError, match="edge source"):
        change("c.php", ([], [("calls", "php:class:C", "php:method:B::go")]))
    assert kept.store.numbers() == [1, 2, 3]


def test_a_tree_is_scanned_again_only_where_it_changed(spark, tmp_path):
    root, state = tmp_path / "tree", f"file://{tmp_path}/state"
    root.mkdir()
    (root / "base.py").write_text("class Base:\n    def run(self):\n        pass\n")
    (root / "item.py").write_text("from base import Base\n\nclass Item(Base):\n    pass\n")
    (root / "main.py").write_text("from item import Item\n\ndef main():\n    i = Item()\n    i.run()\n")
    engine = Engine(Graph.of(spark))

    def both():
        kept, full = engine.scan_project(str(root), state=state), Engine(Graph.of(spark)).scan_project(str(root))
        for name in ("nodes", "edges", "memberships"):
            assert shown({name: getattr(kept, name)}) == shown({name: getattr(full, name)}), name
        return engine.last_scan

    first = both()
    assert (first.number, first.files) == (1, 3)
    (root / "base.py").write_text("class Base:\n    def walk(self):\n        pass\n")
    second = both()
    assert (second.number, second.files) == (2, 1) and second.decided_again < second.references
    third = engine.scan_project(str(root), state=state)
    assert engine.last_scan.number == 2 and engine.last_scan.files == 0 and third.nodes.count() > 0


# --- buckets ------------------------------------------------------------------------------------------------------------------


def test_only_touched_buckets_are_written(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/s", 2)
    rows = spark.range(1000).select(F.col("id").cast("string").alias("id"), F.lit("a").alias("v"), F.lit("1").alias("last_scan_id"))
    one = store.begin()
    upsert_into(one, "t", "id", rows)
    assert one.publish() == 1
    two = store.begin()
    new = rows.where("id <> '7'").withColumn("v", F.when(F.col("id") == "11", None).otherwise(F.col("v"))).withColumn("last_scan_id", F.lit("2")).unionByName(spark.createDataFrame([("new", "x", "2"), (None, "null", "2")], "id string, v string, last_scan_id string"))
    wrote = {r["id"]: r["write"] for r in upsert_into(two, "t", "id", new).collect()}
    assert wrote == {"7": "delete", "11": "update", "new": "insert", None: "insert"} and len(two.written["t"]) <= 4
    assert store.read("t").count() == 1000 and two.publish() == 2
    now = {r["id"]: (r["v"], r["last_scan_id"]) for r in store.read("t").collect()}
    assert len(now) == 1001 and now["11"] == (None, "2") and now["12"] == ("a", "1") and "7" not in now and now[None] == ("null", "2")
    assert {r["id"] for r in store.read("t", 1).collect()} == {str(i) for i in range(1000)}
    some = spark.createDataFrame([("12",), ("nobody",)], "id string")
    assert [r["id"] for r in store.read("t", of=some).collect()] == ["12"]
    same = store.begin()
    assert upsert_into(same, "t", "id", store.read("t")).where("id IS NOT NULL").count() == 0


def test_a_state_is_published_once(spark, tmp_path):
    store = BucketStore(spark, f"file://{tmp_path}/s", 1)
    row = spark.createDataFrame([("1", "x")], "id string, v string")
    a, b = store.begin(), store.begin()
    a.put("t", "id", row)
    b.put("t", "id", row.withColumn("v", F.lit("y")))
    assert a.publish() == 1
    with pytest.raises(StoreError, match="another writer"):
        b.publish()
    assert [r["v"] for r in store.read("t").collect()] == ["x"]
    with pytest.raises(StoreError):
        store.read("u")
    with pytest.raises(StoreError):
        store.read("t", 9)
    c = store.begin()
    c.put("t", "id", row.where("false"), row)
    c.publish()
    assert store.read("t").count() == 0 and store.read("t").columns == ["id", "v"]
    assert store.vacuum(1) >= 1 and store.numbers() == [2]


def test_snapshots_as_intervals(spark, tmp_path):
    kept = Intervals(spark, f"file://{tmp_path}/archive", 1)
    files = lambda rows: spark.createDataFrame(rows, "id string, content_hash string, last_scan_id string")
    roles = spark.createDataFrame([("n", "r", "x", "certain"), ("n", "r", "x", "certain"), ("m", "r", None, "certain")], "node_id string, role string, rule_id string, confidence string")
    states = [[("a", "1", "s1"), ("b", "1", "s1"), ("c", None, "s1")], [("a", "2", "s2"), ("b", "1", "s2"), ("d", "1", "s2")], [("a", "1", "s3"), ("b", "1", "s3"), ("c", "x", "s3")]]
    for i, rows in enumerate(states):
        assert kept.write({"files": files(rows), "classifications": roles}) == i + 1
    # Another scan of the same rows writes nothing of them.
    before = kept.store.manifest()["tables"]
    assert kept.write({"files": files(states[2]), "classifications": roles}) == 4 and kept.wrote == {"files": (0, 0), "classifications": (0, 0)} and kept.store.manifest()["tables"] == before
    for i, rows in enumerate(states):
        assert sorted(map(tuple, kept.as_of("files", i + 1).collect())) == sorted((k, h) for k, h, _ in rows)
    assert kept.as_of("files").count() == 3 and kept.as_of("classifications", 1).count() == 2
    for a in (1, 2, 3):
        for b in (1, 2, 3):
            want = {(r["key"], r["operation"]) for r in snapshot.diff(files(states[a - 1]), files(states[b - 1])).collect()}
            assert {(r["key"], r["operation"]) for r in kept.diff(a, b, ["files"]).collect()} == want
    assert kept.by_scan("files", [1, 2, 3]).groupBy("scan").count().where("count = 3").count() == 3
    with pytest.raises(SnapshotError):
        kept.as_of("files", 9)
    with pytest.raises(SnapshotError):
        kept.as_of("edges")


def shuffled_rows(spark):
    """Rows that all stages so far have sent."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    jvm, store = spark.sparkContext._jvm, spark.sparkContext._jsc.sc().statusStore()
    stages = store.stageList(jvm.java.util.ArrayList(), False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), jvm.java.util.ArrayList())
    return {(s.stageId(), s.attemptId()): s.shuffleWriteRecords() for s in map(stages.apply, range(stages.size()))}


def test_snapshots_send_rows_once_and_equal_ones_never(spark, tmp_path):
    kept, n = Intervals(spark, f"file://{tmp_path}/archive", 1), 4000
    rows = spark.range(n).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("kind"), F.lit(None).cast("string").alias("other"))

    def sent(df):
        before = shuffled_rows(spark)
        kept.write({"nodes": df})
        return sum(v for k, v in shuffled_rows(spark).items() if k not in before)

    few = n // 10
    assert n <= sent(rows) < n + few
    # The same rows in another order: only counts and sums go.
    assert sent(rows.orderBy(F.desc("id")).limit(n).repartition(3)) < 3 * n and kept.wrote == {"nodes": (0, 0)}
    assert sent(rows) < few and kept.wrote == {"nodes": (0, 0)}
    # A value that goes over to a column that was null is a change; a row given twice is none.
    moved = rows.select("id", F.when(F.col("id") != "7", F.col("kind")).alias("kind"), F.when(F.col("id") == "7", "x").alias("other"))
    assert sent(moved) < n and kept.wrote == {"nodes": (1, 1)}
    kept.write({"nodes": moved.unionByName(moved.where("id = '9'"))})
    assert kept.wrote == {"nodes": (0, 0)}
    assert n <= sent(rows.withColumn("kind", F.lit("y"))) < 2 * n + few and kept.wrote == {"nodes": (n, n)}
    assert [kept.as_of("nodes", i).where("kind = 'x'").count() for i in (1, 4, 5, 6)] == [n, n - 1, n - 1, 0]
    assert kept.store.vacuum(1) >= 1 and kept.rows("nodes").count() == 2 * n + 1


def test_metrics_of_several_snapshots_send_no_edges_for_their_ends(spark):
    names = [f"n{i:02}" for i in range(30)]
    g = graph_of(spark, [(names[i % 30], "calls", names[i * 7 % 29 if i % 30 else 1], "certain") for i in range(3000)])
    gone = g.with_tables(nodes=g.nodes.where("id <> 'n05'"))
    scans = lambda a, b: a.withColumn("scan", F.lit(1).cast("long")).unionByName(b.withColumn("scan", F.lit(2).cast("long")))
    tables = [scans(getattr(g, n), getattr(gone, n)) for n in ("nodes", "edges", "classifications", "diagnostics")]
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        before = shuffled_rows(spark)
        got = {r["scan"]: (r["cycles"], r["max_degree"], r["unreferenced_candidates"]) for r in snapshot.quality_by_scan(*tables).collect()}
        assert sum(v for k, v in shuffled_rows(spark).items() if k not in before) < 10_000
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert got == {i: tuple(snapshot.quality_metrics(x).first())[:3] for i, x in ((1, g), (2, gone))}


@pytest.mark.parametrize("few", [0, 100])
def test_differences_are_the_same_whichever_side_is_sent(spark, tmp_path, monkeypatch, few):
    from graphloom.ingest import intervals

    monkeypatch.setattr(intervals, "FEW", few)
    kept = Intervals(spark, f"file://{tmp_path}/archive", 1)
    states = [spark.createDataFrame(rows, "id string, kind string, file_id string") for rows in ([("a", "k", "f"), ("b", "k", "f"), ("c", "k", None), ("d", "k", "f")], [("a", "k", "g"), ("b", "l", "g"), ("c", "k", None), ("e", "k", "f"), ("f", "k", "f")])]
    for s in states:
        kept.write({"nodes": s})
    want = [("a", "moved"), ("b", "changed"), ("b", "moved")]
    assert sorted((r["key"], r["operation"]) for r in kept.diff(1, 2, ["nodes"]).collect()) == sorted([*want, ("d", "removed"), ("e", "added"), ("f", "added")])
    assert sorted((r["key"], r["operation"]) for r in kept.diff(2, 1, ["nodes"]).collect()) == sorted([*want, ("d", "added"), ("e", "removed"), ("f", "removed")])


# --- searches -----------------------------------------------------------------------------------------------------------------


def graph_of(spark, edges):
    ids = sorted({x for a, _, b, _ in edges for x in (a, b)})
    return Graph.of(
        spark, nodes=[{"id": x, "kind": "class", "canonical_name": x, "display_name": x, "origin": "ast", "confidence": "certain"} for x in ids],
        edges=[{"id": str(i), "source_id": a, "kind": k, "target_id": b, "origin": "ast", "confidence": c} for i, (a, k, b, c) in enumerate(edges)],
    )


@pytest.mark.parametrize("seed", range(3))
def test_one_search_from_all_seeds(spark, seed):
    """Seeds that reach each other, ties of distance and of seed, and parallel ways of different confidence."""
    rnd = random.Random(seed)
    g = graph_of(spark, [(f"n{rnd.randrange(16):02}", rnd.choice(["calls", "imports"]), f"n{rnd.randrange(16):02}", rnd.choice(["certain", "probable", "possible"])) for _ in range(45)])
    seeds = spark.createDataFrame([(f"n{i:02}",) for i in rnd.sample(range(16), 5)] + [("n00",), ("n00",)], "id string")
    want = {(r["id"], r["seed"], r["distance"], r["rank"], r["via"]) for r in traverse.nearest(traverse.impact(g, seeds.distinct(), 4)).collect()}
    assert {(r["id"], r["seed"], r["distance"], r["rank"], r["via"]) for r in traverse.nearest_impact(g, seeds, 4).collect()} == want
    alone = traverse.nearest_impact(g, seeds, 4, labels=1).join(seeds, "id", "left_anti").collect()
    assert {(r["id"], r["distance"]) for r in alone} == {(i, d) for i, _, d, _, _ in want if i not in {r["id"] for r in seeds.collect()}}


@pytest.mark.parametrize("seed", [0])
def test_best_paths_are_the_first_of_all_paths(spark, seed):
    rnd = random.Random(seed)
    rows = sorted({(f"n{rnd.randrange(9)}", rnd.choice(["calls", "dispatches"]), f"n{rnd.randrange(9)}", rnd.choice(["certain", "certain", "probable", "possible"])) for _ in range(26)})
    g = graph_of(spark, rows)
    best = {}
    for a, k, b, c in rows:
        step = ({"certain": 3, "probable": 2}.get(c, 1), int(k == "dispatches"))
        best[a, b] = max(best.get((a, b), step), step)
    every = []

    def go(path, rank, semantic):
        for (a, b), (r, s) in best.items():
            if a == path[-1] and len(path) <= 6:
                now = (min(rank, r), semantic + s)
                if b == "n8":
                    every.append((-now[0], len(path), -now[1], ">".join([*path, b])))
                elif b not in path:
                    go([*path, b], *now)

    go(["n0"], 3, 0)
    ids = lambda x: spark.createDataFrame([(x,)], "id string")
    for most, few in ((3, 0), (1000, 0), (3, 10**6)):
        followed = []
        got = [(-r["rank"], r["hops"], -r["semantic"], r["signature"]) for r in traverse.paths(g, ids("n0"), ids("n8"), 6, most, few_states=few, followed=followed).collect()]
        assert got == sorted(every)[:most] and (len(followed) == 1) == (few > 0)
    assert traverse.paths(g, ids("n0"), ids("nowhere"), 6).count() == 0


def strong(edges):
    found = scc.strong_components(iter(sorted(edges)))
    return {a: c for a, c in found.items() if sum(x == c for x in found.values()) > 1}


@pytest.mark.parametrize("seed", range(3))
def test_components_through_contracted_paths(spark, seed):
    """Rings on rings, chains between them, dead ends, and a node that only a path back to itself makes a component."""
    rnd = random.Random(seed)
    edges, n = set(), 0
    for _ in range(5):
        length = rnd.randrange(2, 9)
        ring = [f"n{n + i:03}" for i in range(length)]
        n += length
        edges |= set(zip(ring, ring[1:] + ring[:1]))
    for _ in range(6):
        a, b = f"n{rnd.randrange(n):03}", f"n{rnd.randrange(n):03}"
        way = [a, *(f"m{n + i:03}" for i in range(rnd.randrange(4))), b]
        n += len(way)
        edges |= set(zip(way, way[1:]))
    edges |= {("x0", "x1"), ("x1", "x2"), ("x2", "x0"), ("x0", "y1"), ("y1", "x0"), ("z0", "x0"), ("x1", "z1")}
    df = spark.createDataFrame(sorted(edges), "source_id string, target_id string")
    assert {r["id"]: r["component"] for r in scc.coloured_components(df).collect()} == strong({e for e in edges if e[0] != e[1]})


@pytest.mark.parametrize("closed", [True, False])
def test_long_rings_and_chains_take_few_rounds(spark, closed):
    n = 20_000
    next_ = (F.col("id") + 1) % n if closed else F.col("id") + 1
    name = lambda c: F.format_string("n%07d", c)
    rounds = scc.Rounds()
    found = scc.components(spark.range(n).select(name(F.col("id")).alias("source_id"), name(next_).alias("target_id")), 0, rounds)
    assert found.count() == (n if closed else 0) and rounds.n <= 40
    assert found.select("component").distinct().count() == (1 if closed else 0)


def test_shortened_paths_and_rings_equal_the_plain_search(spark, monkeypatch):
    monkeypatch.setattr(scc, "FEW_INNER", 3)
    edges = set()
    for r, n in enumerate((2, 3, 5, 40, 150)):
        edges |= {(f"r{r}_{i}", f"r{r}_{(i + 1) % n}") for i in range(n)}
    for r, n in enumerate((1, 4, 60)):
        way = ["hub", *[f"p{r}_{i}" for i in range(n)], "hub" if r else "r4_7"]
        edges |= set(zip(way, way[1:]))
    edges |= {("r3_5", "hub"), ("hub", "r3_9")} | {(f"t{i}", f"t{i + 1}") for i in range(50)}
    df = spark.createDataFrame(sorted(edges), "source_id string, target_id string")
    assert {r["id"]: r["component"] for r in scc.coloured_components(df).collect()} == strong(edges)


def test_shortening_takes_most_inner_nodes_out(spark):
    n, rounds = 20_000, scc.Rounds()
    name = lambda c: F.format_string("n%07d", c)
    ring = spark.range(n).select(name(F.col("id")).alias("id"), name((F.col("id") + 1) % n).alias("fore"), name((F.col("id") + n - 1) % n).alias("back"), name(F.col("id")).alias("least"))
    short = scc._shorten(ring, 0, rounds)
    # Each of the three rounds in the one table takes about a third, and no two neighbours.
    assert rounds.n == 1 and short.count() == n and short.where("gone IS NULL").count() < 0.4 * n
    first = short.where("gone = 0")
    assert first.join(first.select(F.col("id").alias("fore")), "fore", "left_semi").isEmpty()
