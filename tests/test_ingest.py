"""Sources, classification, reconciliation, incremental scans, streams."""

import pytest
from pyspark.sql import functions as F

from graphloom.engine import Engine
from graphloom.graph import Graph
from graphloom.ingest import classify, incremental, reconcile
from graphloom.schema import CONTRIBUTION
from graphloom.sources import bundle, git, python_code, tree
from graphloom.streaming import watch

SOURCE = {
    "app/models.py": "class Base:\n    def run(self):\n        pass\n\nclass Item(Base):\n    pass\n",
    "app/main.py": "from app.models import Item\n\ndef build():\n    return Item()\n",
    "tests/test_main.py": "from app.main import build\n\ndef test_build():\n    assert build()\n",
    "broken.py": "def (:\n",
}


def write_tree(root, files=SOURCE):
    for path, text in files.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)


def test_scan_of_a_tree(spark, tmp_path):
    write_tree(tmp_path)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/x.py").write_text("x = 1")
    g = Engine(Graph.of(spark)).scan_project(str(tmp_path))
    names = {r["canonical_name"]: r["kind"] for r in g.nodes.collect()}
    assert names["app.models.Item"] == "class" and names["app.main.build"] == "function" and "node_modules.x" not in names
    ends = g.nodes.select("id", "canonical_name")
    e = g.edges.join(ends.withColumnsRenamed({"id": "source_id", "canonical_name": "s"}), "source_id").join(ends.withColumnsRenamed({"id": "target_id", "canonical_name": "t"}), "target_id")
    assert ("app.main.build", "constructs", "app.models.Item") in {(r["s"], r["kind"], r["t"]) for r in e.collect()}
    assert "PYTHON_SYNTAX" in {r["code"] for r in g.diagnostics.collect()}
    assert {r["role"] for r in g.classifications.collect()} == {"quality.test_module"}


def test_incremental_facts_equal_a_full_scan(spark, tmp_path):
    write_tree(tmp_path)
    files, _ = tree.discover(spark, str(tmp_path))
    cache = files.select("relative_path", "content_hash", F.lit("1").alias("scanner_version"), F.lit("c").alias("configuration_hash"))
    cached = {r["owner_key"]: r for r in python_code.extract(files).collect()}
    (tmp_path / "app/main.py").write_text("def build():\n    return None\n")
    now, _ = tree.discover(spark, str(tmp_path))
    states = {r["relative_path"]: r["state"] for r in incremental.partition_cache(now, spark.createDataFrame(cache.collect(), cache.schema) if False else cache.where("relative_path <> 'app/main.py'").unionByName(spark.createDataFrame([("app/main.py", "old", "1", "c")], cache.schema)), "1", "c").collect()}
    assert states["app/main.py"] == "changed" and states["app/models.py"] == "hit"
    fresh = {r["owner_key"]: r for r in python_code.extract(now.where(F.col("relative_path").isin([p for p, x in states.items() if x != "hit"]))).collect()}
    full = {r["owner_key"]: r for r in python_code.extract(now).collect()}
    assert cached | fresh == full


def contribution(spark, owner, nodes=(), edges=()):
    n = [(f"{k}:{c}", k, c, c.split("::")[-1], "ast", "certain", 1, 2, "{}") for k, c in nodes]
    e = [(k, s, t, "ast", "certain", 3) for k, s, t in edges]
    return spark.createDataFrame([(owner, n, e, [])], CONTRIBUTION).withColumn("language", F.lit("php"))


def test_resolution_cascade(spark):
    rows = contribution(spark, "a.php", [("class", "A"), ("interface", "I"), ("class", "P"), ("method", "P::go")], [("extends", "php:class:A", "php:class:P"), ("implements", "php:class:A", "php:class:I"), ("calls", "php:class:A", "php:method:A::go"), ("calls", "php:class:A", "php:class:Nowhere"), ("calls", "php:class:A", "bad"), ("calls", "php:class:A", "php:method_of_return:X::y")])
    rows = rows.unionByName(contribution(spark, "b.php", [("class", "A")]))
    out = reconcile.reconcile(rows, spark.createDataFrame([("a.php",), ("b.php",)], "relative_path string"), "p")
    names = {r["id"]: r["canonical_name"] for r in out["nodes"].collect()}
    targets = {(r["kind"], names[r["target_id"]]) for r in out["edges"].collect()}
    assert targets == {("extends", "P"), ("implements", "I"), ("calls", "P::go"), ("calls", "Nowhere")}
    assert "external_class" in {r["kind"] for r in out["nodes"].collect()}
    assert {r["code"] for r in out["diagnostics"].collect()} == {"duplicate_symbol_evidence", "unresolvable_reference"}
    with pytest.raises(ValueError):
        reconcile.reconcile(rows, spark.createDataFrame([("a.php",)], "relative_path string"), "p")


def test_classification_rules(spark):
    model = '{"extends":"Illuminate\\\\Database\\\\Eloquent\\\\Model","nestjs_roles":["nestjs.module","other"],"php_attributes":["A\\\\AsCommand"]}'
    rows = [("1", "class", "App\\OrderController", "OrderController", "app/Http/Controllers/OrderController.php", model), ("2", "module", "m", "m", "tests/a.py", "{}"), ("3", "module", "m", "m", "src/tests/a.py", "{}"), ("4", "module", "m", "m", "web/vite.config.ts", "{}")]
    nodes = spark.createDataFrame(rows, "id string, kind string, canonical_name string, display_name string, relative_path string, attributes_json string").withColumn("language", F.lit("php"))
    got = {(r["node_id"], r["role"]) for r in classify.classify(nodes).collect()}
    assert got == {("1", "application.controller"), ("1", "nestjs.module"), ("2", "quality.test_module"), ("4", "tooling.config")}
    framework = {(r["role"], r["rule_id"]) for r in classify.classify(nodes, classify.LARAVEL + classify.SYMFONY).collect()}
    assert framework == {("laravel.model", "laravel_types"), ("laravel.controller", "laravel_paths"), ("laravel.controller", "laravel_suffix"), ("symfony.command", "symfony")}
    bounds = classify.infer_boundaries(nodes)
    assert [tuple(r) for r in bounds.collect()] == [("App", "namespace_prefix", "App\\")]
    members = classify.memberships(nodes, bounds.withColumn("id", F.col("name")))
    assert [r["node_id"] for r in members.collect()] == ["1"]


def test_ignore_patterns(spark):
    paths = spark.createDataFrame([("a/b.php",), ("a/keep.php",), ("vendor/x.php",), ("deep/tmp/x.php",), ("tmp.php",)], "p string")
    hidden = {r["p"] for r in paths.where(tree.ignored("p", ["a/*.php", "!a/keep.php", "**/tmp/**", "!vendor"])).collect()}
    assert hidden == {"a/b.php", "vendor/x.php", "deep/tmp/x.php"}


def test_jsonc():
    assert tree.load_jsonc('{"a": "x // y", /* c */ "b": [1, 2,], // d\n}') == {"a": "x // y", "b": [1, 2]}


def test_git_parsers():
    log = "\x1eabc\x1fAnn\x1f5\n\na.py\nb.py\na.py\n\x1edef\x1fBo\x1f4\n\na.py\n"
    assert git.parse_log(log) == [("abc", "a.py", "Ann", 5), ("abc", "b.py", "Ann", 5), ("def", "a.py", "Bo", 4)]
    assert git.parse_name_status("M\0a.py\0R100\0old.py\0new.py\0") == [("M", "a.py", None), ("R", "new.py", "old.py")]


def test_bundle_round_trip(spark):
    t = spark.createDataFrame([("1", "é"), ("2", None)], "id string, name string")
    data = bundle.encode({"nodes": t})
    assert bundle.decode(data)["nodes"] == [{"id": "1", "name": "é"}, {"id": "2", "name": None}]
    with pytest.raises((ValueError, OSError, EOFError)):
        bundle.decode(data[:-9])


def test_upsert_and_retention(spark):
    old = spark.createDataFrame([("1", "a", "s0"), ("2", None, "s0")], "id string, v string, last_scan_id string")
    new = spark.createDataFrame([("1", "b", "s1"), ("2", None, "s1"), ("3", "c", "s1")], "id string, v string, last_scan_id string")
    assert {r["id"]: r["write"] for r in incremental.upsert(old, new).collect()} == {"1": "update", "2": "keep", "3": "insert"}
    with pytest.raises(ValueError):
        incremental.retain(old, 21)


def test_snapshot_store(spark, tmp_path):
    store = incremental.SnapshotStore(spark, str(tmp_path / "s"))
    assert store.write("one", {"nodes": spark.range(3)}) and store.active() == "one"
    assert not store.write("two", {"nodes": spark.range(30)}, most_rows=10) and store.active() == "two"
    assert store.read("nodes", "one").count() == 3


def test_debounce_counts_from_the_first_change():
    d = watch.Debounce(5, most_pending=2)
    d.put("a", "added", 0)
    d.put("a", "changed", 4)
    assert not d.due(4.9) and d.due(5) and d.coalesced == 1
    assert d.take() == ({"a": "changed"}, False)
    for p in "abc":
        d.put(p, "added", 0)
    assert d.take() == ({}, True)
    assert [watch.backoff(n, 2) for n in (1, 2, 10)] == [2, 4, 30.0]


def test_stream_refresh(spark, tmp_path):
    src = tmp_path / "in"
    spark.createDataFrame([("a", "added", 1, 1), ("a", "deleted", 2, 2), ("b", "added", 1, 3)], "path string, change string, ts long, seq long").write.parquet(str(src))
    seen = []
    stream = spark.readStream.schema("path string, change string, ts long, seq long").parquet(str(src))
    q = watch.refresh(stream, lambda df, n: seen.extend((r["path"], r["change"]) for r in df.collect()), str(tmp_path / "ck"))
    q.awaitTermination(60)
    assert sorted(seen) == [("a", "deleted"), ("b", "added")]
