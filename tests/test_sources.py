"""Configuration, contributions, ignore patterns, and declarations of PHP and TypeScript."""

import json

import pytest
from pyspark.sql import functions as F

from graphloom import config
from graphloom.engine import Engine
from graphloom.graph import Graph
from graphloom.ingest import classify, contributions, incremental
from graphloom.sources import declared, python_code, tree
from graphloom.streaming import watch

PHP = """<?php
namespace App\\Http;

use App\\Models\\Order;
use Illuminate\\Support\\Facades\\Route;

// class Hidden {}
abstract class OrderController extends Controller implements HasName, Countable
{
    use Loggable;

    #[Route('/orders', methods: ['GET'])]
    public function index(int $id): OrderList
    {
        $this->check($id);
        $x = new Order($id);
        strlen($x);
        Order::find($id);
        return $this->make()->run();
    }

    private function make(): Runner
    {
        return new Runner();
    }
}

class Runner
{
    public function run() {}
}

function helper($a)
{
    return array_map('x', $a);
}
Route::get('/list', [OrderController::class, 'index']);
"""
TS = """import { Injectable, Get } from '@nestjs/common';
import Base, { helper as h } from '../lib/base';
export * from './other';

@Injectable()
export class UserService extends Base implements OnInit {
  @Get('users/:id')
  async find(id: string): Promise<User> {
    this.check(id);
    return new Local(id);
  }

  check(id) {
    if (id) {
      return h(id);
    }
  }
}

class Local {}
export const Button = (props) => {
  return useThing();
};
export default function useThing() {
  return helper2();
}
"""


def facts(spark, path, language, text):
    rows = spark.createDataFrame([(path, language, text)], "relative_path string, language string, text string")
    one = declared.extract(rows).first()
    return {(n["kind"], n["canonical_name"], n["start_line"]) for n in one["nodes"]}, {(e["kind"], e["source"].split(":", 2)[2], e["target"], e["start_line"]) for e in one["edges"]}, one


def test_php_declarations(spark):
    nodes, edges, one = facts(spark, "app/OrderController.php", "php", PHP)
    c = "App\\Http\\OrderController"
    assert nodes == {("module", "app/OrderController.php", 1), ("class", c, 8), ("method", f"{c}::index", 13), ("method", f"{c}::make", 22), ("class", "App\\Http\\Runner", 28), ("method", "App\\Http\\Runner::run", 30), ("function", "App\\Http\\helper", 33), ("route", "ANY /orders", 13), ("route", "GET /list", 37)}
    index = f"{c}::index"
    assert edges >= {
        ("extends", c, "php:class:App\\Http\\Controller", 8), ("implements", c, "php:interface:App\\Http\\HasName", 8), ("uses_trait", c, "php:trait:App\\Http\\Loggable", 10), ("contains", c, f"php:method:{index}", 13),
        ("returns", f"{c}::make", "php:class:App\\Http\\Runner", 22), ("calls", index, f"php:method:{c}::check", 15), ("constructs", index, "php:class:App\\Models\\Order", 16), ("calls", index, "php:namespaced_function:App\\Http\\strlen", 17),
        ("calls", index, "php:method:App\\Models\\Order::find", 18), ("calls", index, f"php:method_of_return:{c}::make::run", 19), ("calls", "App\\Http\\helper", "php:namespaced_function:App\\Http\\array_map", 35),
        ("routes_to", "GET /list", f"php:method:{index}", 37), ("routes_to", "ANY /orders", f"php:method:{index}", 13),
    }
    assert json.loads(next(n for n in one["nodes"] if n["kind"] == "class" and n["display_name"] == "OrderController")["attributes"])["implements"] == ["App\\Http\\HasName", "App\\Http\\Countable"]


def test_typescript_declarations(spark):
    nodes, edges, one = facts(spark, "src/users/user.service.tsx", "typescript", TS)
    m = "src/users/user.service"
    assert {(k, n) for k, n, _ in nodes} == {("module", m), ("class", f"{m}.UserService"), ("method", f"{m}.UserService::find"), ("method", f"{m}.UserService::check"), ("class", f"{m}.Local"), ("function", f"{m}.Button"), ("function", f"{m}.useThing"), ("route", "GET /users/:id")}
    assert {e[:3] for e in edges} >= {
        ("imports", m, "typescript:module:@nestjs/common"), ("imports", m, "typescript:module:src/lib/base"), ("re_exports", m, "typescript:module:src/users/other"), ("extends", f"{m}.UserService", "typescript:class:src/lib/base.default"),
        ("implements", f"{m}.UserService", f"typescript:interface:{m}.OnInit"), ("calls", f"{m}.UserService::find", f"typescript:method:{m}.UserService::check"), ("constructs", f"{m}.UserService::find", f"typescript:class:{m}.Local"),
        ("calls", f"{m}.UserService::check", "typescript:function:src/lib/base.helper"), ("calls", f"{m}.Button", f"typescript:function:{m}.useThing"), ("routes_to", "GET /users/:id", f"typescript:method:{m}.UserService::find"),
    }
    assert not any(e[2].endswith((".Injectable", "function:src/users/user.service.Local")) for e in edges)
    roles = {n["display_name"]: n["attributes"] for n in one["nodes"]}
    assert "nestjs.provider" in roles["UserService"] and "react.component" in roles["Button"] and "react.hook" in roles["useThing"]


def test_scan_of_several_languages(spark, tmp_path):
    for path, text in {
        "app/OrderController.php": PHP, "src/users/user.service.tsx": TS, "composer.json": '{"name": "shop", "require": {"laravel/framework": "^11", "php": "8.3"}}', "lib/run.py": "def main() -> None:\n    pass\n\nif __name__ == '__main__':\n    main()\n",
        "graphloom.jsonc": '{"version": 1, // checked in\n "ignores": ["skipped/**"], "boundaries": [{"name": "web", "path_prefix": "src/users"}]}', "skipped/x.py": "x = 1\n",
    }.items():
        (tmp_path / path).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / path).write_text(text)
    engine = Engine(Graph.of(spark))
    g = engine.scan_project(str(tmp_path))
    nodes = {r["canonical_name"]: r for r in g.nodes.collect()}
    assert "skipped.x" not in nodes and nodes["lib.run"]["attributes_json"] == '{"executable":true}' and nodes["strlen"]["kind"] == "external_function"
    names = {r["id"]: r["canonical_name"] for r in nodes.values()}
    edges = {(names[r["source_id"]], r["kind"], names[r["target_id"]]) for r in g.edges.collect()}
    # The call on what make() returns is settled by its return type.
    assert ("App\\Http\\OrderController::index", "calls", "App\\Http\\Runner::run") in edges
    roles = {(names[r["node_id"]], r["role"]) for r in g.classifications.collect()}
    assert ("App\\Http\\OrderController", "laravel.controller") in roles and ("src/users/user.service.UserService", "nestjs.provider") in roles
    assert "web" in {r["name"] for r in g.boundaries.where("source = 'explicit'").collect()} and g.memberships.where("boundary_id = 'explicit:web'").count() >= 8


def test_python_imports_and_receivers():
    assert python_code.imported("a.b", True, 1, "c") == "a.b.c" and python_code.imported("a.b.m", False, 1, "c") == "a.b.c"
    assert python_code.imported("a.b.m", False, 2, None) == "a" and python_code.imported("a.b.m", False, 4, "w") is None and python_code.imported("a", False, 0, "x.y") == "x.y"
    text = "from fastapi import APIRouter\nfrom .... import w\nrouter = APIRouter()\nclass A:\n    def go(self, other: 'int', x: A):\n        self.stay()\n        x.go()\n        def inner():\n            return A()\n    def stay(self) -> A: ...\n@router.get('/a')\ndef page(): ...\n@other.get('/b')\ndef not_a_route(): ...\n"
    one = python_code.facts("p/q.py", text)
    assert {n["canonical_name"] for n in one["nodes"]} == {"p.q", "p.q.A", "p.q.A::go", "p.q.A::stay", "p.q.A::go.inner", "p.q.page", "p.q.not_a_route", "GET /a"}
    edges = {(e["kind"], e["source"], e["target"]) for e in one["edges"]}
    assert {("calls", "python:method:p.q.A::go", "python:method:p.q.A::stay"), ("calls", "python:method:p.q.A::go", "python:method:p.q.A::go"), ("constructs", "python:function:p.q.A::go.inner", "python:class:p.q.A"), ("returns", "python:method:p.q.A::stay", "python:class:p.q.A"), ("routes_to", "python:route:GET /a", "python:function:p.q.page")} <= edges
    assert one["diagnostics"][0]["code"] == "PYTHON_RELATIVE_IMPORT"
    django = python_code.facts("s/urls.py", "from django.urls import path\nfrom . import views\nurlpatterns = [path('users/', views.users)]\n")
    assert ("routes_to", "python:route:ANY /users/", "python:function:s.views.users") in {(e["kind"], e["source"], e["target"]) for e in django["edges"]}


@pytest.mark.parametrize(("patterns", "hidden"), [
    (["docs/**"], {"docs", "docs/a.md"}), ([" *.py ", " !keep.py"], {"x.py", "src/x.py"}), (["src\\\\x.py".replace("\\\\", "\\")], {"src/x.py"}), (["[a-c]?.txt"], {"ab.txt", "src/c1.txt"}), (["[!a-z]b.txt"], set()), (["**/x.py"], {"x.py", "src/x.py"}), ([" / ", ""], set()), (["src/"], {"src/x.py", "src/c1.txt", "src/keep.py"}),
])
def test_ignore_patterns(spark, patterns, hidden):
    paths = ["docs", "docs/a.md", "x.py", "src/x.py", "keep.py", "src/keep.py", "ab.txt", "src/c1.txt"]
    rows = spark.createDataFrame([(p,) for p in paths], "p string").select("p", tree.ignored("p", patterns).alias("h")).collect()
    assert {r["p"] for r in rows if r["h"]} == hidden


def test_configuration_is_checked():
    c = config.parse('{"version": 1, "limits": {"max_files": 9}, "frameworks": ["laravel"], "policies": [{"id": "p", "from_boundary": "a", "deny_targets": ["b"]}], "quality_budgets": {"new_cycles": 0}}')
    assert (c.max_files, c.frameworks, c.quality_budgets, c.policies[0].deny_targets) == (9, ("laravel",), {"new_cycles": 0}, ("b",))
    assert c.overlaid(max_files=5).max_files == 5 and c.overlaid(max_files=None).max_files == 9
    for bad in ('{"version": 2}', '{"version": 1, "colour": 1}', '{"version": 1, "ignores": ["../x"]}', '{"version": 1, "boundaries": [{"name": "a"}]}', '{"version": 1, "boundaries": [{"name": "a", "path_prefix": "x", "namespace_prefix": "y"}]}', '{"version": 1, "frameworks": ["x"]}', '{"version": 1, "quality_budgets": {"new_cycles": -1}}', "[", '{"version": 1, "policies": [{"id": "p", "from_boundary": "a"}]}'):
        with pytest.raises(config.ConfigError):
            config.parse(bad)


def test_contributions_are_taken_whole_or_refused(spark, tmp_path):
    evidence = {"path": "a.php", "start_line": 1, "end_line": 2}
    node = {"local_id": "class:A", "kind": "class", "canonical_name": "A", "display_name": "A", "origin": "ast", "confidence": "certain", "evidence": evidence, "attributes": {"x": [1]}}
    edge = {"kind": "calls", "source": "php:class:A", "target": "php:class:B", "origin": "ast", "confidence": "certain", "evidence": evidence, "attributes": {}}
    good = {"owner_key": "a.php", "nodes": [node], "edges": [edge], "diagnostics": [{"severity": "error", "code": "X", "message": "m"}]}
    bad = {
        "keys": good | {"more": 1}, "owner_key": good | {"owner_key": ""}, "nodes": good | {"nodes": [node | {"origin": "guess"}]}, "edges": good | {"edges": [{k: v for k, v in edge.items() if k != "target"}]}, "diagnostics": good | {"diagnostics": [{"severity": "error"}]},
    }
    more = [("nodes", good | {"nodes": [node | {"evidence": evidence | {"path": "../a"}}]}), ("nodes", good | {"nodes": [node | {"evidence": evidence | {"start_line": "x"}}]}), ("nodes", good | {"nodes": [node | {"attributes": [1]}]}), ("nodes", good | {"nodes": [node | {"extra": 1}]})]
    cases = [("good", good), *bad.items(), *more]
    lines = spark.createDataFrame([("php", json.dumps(x)) for _, x in cases] + [("php", "no json")], "language string, line string")
    taken, refused = contributions.decode(lines)
    one = taken.collect()
    assert len(one) == 1 and one[0]["nodes"][0]["attributes"] == '{"x":[1]}' and one[0]["edges"][0]["start_line"] == 1 and one[0]["diagnostics"][0]["code"] == "X"
    assert sorted(r["reason"] for r in refused.collect()) == sorted([r for r, _ in cases[1:]] + ["not an object"])

    session = [{"id": 1, "result": {"protocol_version": 1, "manifest": {"id": "s", "version": "2", "language": "php"}}}, {"method": "scan/contribution", "params": good}, {"id": 2, "result": {"completed": True}}]
    (tmp_path / "one.ndjson").write_text("".join(json.dumps(x) + "\n" for x in session))
    got, none, manifests = contributions.read_session(spark, str(tmp_path / "one.ndjson"))
    assert got.count() == 1 and none.count() == 0 and len(contributions.scanner_set_hash(manifests).first()[0]) == 64
    (tmp_path / "two.ndjson").write_text("".join(json.dumps(x) + "\n" for x in session[:2]))
    with pytest.raises(ValueError, match="did not end"):
        contributions.read_session(spark, str(tmp_path / "two.ndjson"))


def test_nothing_changed_is_seen(spark):
    files = spark.createDataFrame([("a", "1"), ("b", "2")], "relative_path string, content_hash string")
    cache = files.withColumns({"scanner_version": F.lit("v"), "configuration_hash": F.lit("c")})
    assert incremental.unchanged(files, cache, "v", "c") and not incremental.unchanged(files, cache, "w", "c") and not incremental.unchanged(files.limit(1), cache, "v", "c") and not incremental.unchanged(files, cache, "v", "c", True)


def test_snapshots_of_any_size_are_archived(spark, tmp_path):
    store = incremental.SnapshotStore(spark, str(tmp_path / "s"))
    with pytest.raises(incremental.SnapshotError):
        store.active()
    assert store.write("one", {"nodes": spark.range(300_000).select(F.col("id").cast("string").alias("id"))}) and store.active() == "one" and store.read("nodes").count() == 300_000
    assert not store.write("two", {"nodes": spark.range(10)}, most_rows=5) and store.active() == "two"
    for scan, table in (("two", "nodes"), ("three", "nodes"), ("one", "edges")):
        with pytest.raises(incremental.SnapshotError):
            store.read(table, scan)
    assert [r["scan_id"] for r in store.snapshots().where("complete").collect()] == ["one"]


def test_a_failing_scan_is_tried_again(spark):
    log, waits, left = watch.Lifecycle(), [], [RuntimeError(), RuntimeError()]

    def scan():
        if left:
            raise left.pop()

    watch.attempt(scan, 1.0, log=log, sleep=waits.append)
    assert waits == [1.0, 2.0] and [e["event"] for e in log.events] == ["scan_started", "scan_failed"] * 2 + ["scan_started", "scan_completed"]
    with pytest.raises(watch.Terminal):
        watch.attempt(lambda: (_ for _ in ()).throw(watch.Terminal("no")), 1.0, sleep=waits.append)
    for _ in range(300):
        log.add("poll")
    assert len(log.events) == 200 and log.dropped == 106
    with watch.cancellable(spark, "group") as cancel:
        assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") == "group"
        cancel()
    assert spark.sparkContext.getLocalProperty("spark.jobGroup.id") is None


def test_tools_guard_their_arguments_and_tell_what_follows(spark):
    rows = [{"id": f"symbol_{i}", "language": "php", "kind": "class", "canonical_name": n, "display_name": n, "origin": "ast", "confidence": "certain", "attributes_json": "{}"} for i, n in enumerate(["Shop", "Cart"])]
    g = Graph.of(spark, nodes=rows, edges=[{"id": "e", "kind": "calls", "source_id": "symbol_0", "target_id": "symbol_1", "confidence": "certain"}])
    engine = Engine(g)
    assert engine.call("find_component", name="Shop").next_steps[0] == "inspect_component(component='Shop')"
    assert "Shop: out calls Cart" in engine.call("architecture_context", task="how does Shop work").data["text"]
    for bad in ({"tool": "find_component"}, {"tool": "find_component", "name": "x", "colour": 1}, {"tool": "no_such"}):
        with pytest.raises(ValueError):
            engine.call(**bad)
    failed = engine.call("architecture_summary", refresh=lambda: 1 / 0)
    assert failed.warnings == ["refresh failed: ZeroDivisionError"]
    back = engine.import_bundle(engine.export_bundle(), "other")
    assert {r["canonical_name"] for r in back.nodes.collect()} == {"Shop", "Cart"} and back.edges.count() == 1 and back.edges.first()["source_id"] != "symbol_0"


def test_explicit_boundaries(spark):
    rows = classify.explicit_boundaries(spark, [{"name": "a", "path_prefix": "/src/x/"}, {"name": "b", "namespace_prefix": "App\\Http"}]).collect()
    assert [(r["matcher_type"], r["matcher_value"], r["source"]) for r in rows] == [("path_prefix", "src/x/", "explicit"), ("namespace_prefix", "App\\Http\\", "explicit")]


def test_python_reads_nested_classes_branches_and_module_level():
    text = "import os\nclass A:\n    class Meta:\n        def run(self): ...\n    if os.name:\n        def late(self): self.run()\ntry:\n    class B(A): ...\nexcept ImportError:\n    def fallback(): ...\nstart()\nif os.name:\n    A()\ndef start():\n    class Local:\n        def go(self): ...\n"
    got = python_code.facts("m.py", text)
    assert {(n["kind"], n["canonical_name"]) for n in got["nodes"]} == {
        ("module", "m"), ("class", "m.A"), ("class", "m.A.Meta"), ("method", "m.A.Meta::run"), ("method", "m.A::late"), ("class", "m.B"), ("function", "m.fallback"), ("function", "m.start"), ("class", "m.start.Local"), ("method", "m.start.Local::go"),
    }
    edges = {(e["kind"], e["source"], e["target"]) for e in got["edges"]}
    assert {("calls", "python:module:m", "python:function:m.start"), ("constructs", "python:module:m", "python:class:m.A"), ("calls", "python:method:m.A::late", "python:method:m.A::run"), ("contains", "python:class:m.A", "python:class:m.A.Meta"), ("extends", "python:class:m.B", "python:class:m.A")} <= edges


FRAMEWORKS = {
    "app/Providers/AppServiceProvider.php": """<?php
namespace App\\Providers;

use App\\Contracts\\Gateway;
use App\\Services\\{Unused};
use App\\Services\\StripeGateway;
use App\\Models\\Order;

class AppServiceProvider
{
    protected $listen = [
        \\App\\Events\\OrderPaid::class => [
            \\App\\Listeners\\SendReceipt::class,
        ],
        \\App\\Events\\OrderLost::class => [\\App\\Listeners\\Tell::class],
    ];

    protected $policies = [
        Order::class => \\App\\Policies\\OrderPolicy::class,
    ];

    public function register(): void
    {
        $this->app->singleton(Gateway::class, StripeGateway::class);
        Order::observe(\\App\\Observers\\OrderObserver::class);
        SendMail::dispatch($order);
        Bus::dispatch(new Nothing());
        event(new \\App\\Events\\OrderPaid($order));
    }
}
""",
    "routes/web.php": """<?php
use App\\Http\\OrderController;

Route::get('/', [OrderController::class, 'home']);
Route::middleware('auth')->prefix('admin')->group(function () {
    Route::get('/orders', [OrderController::class, 'index']);
});
Route::post('orders', [OrderController::class, 'store']);
""",
    "src/Shop.php": """<?php
namespace App;

use Symfony\\Component\\Console\\Attribute\\AsCommand;

#[AsCommand(name: 'shop:open')]
#[AsAlias('shop.service')]
#[Route('/shop')]
class Shop
{
    public function __construct(
        #[Autowire(service: 'mailer.fast')] private Mailer $mailer,
    ) {
    }

    #[Route('/open/', name: 'open')]
    public function open(): void
    {
    }

    #[AsEventListener(event: Closed::class)]
    public function closed(): void
    {
    }

    #[AsMessageHandler]
    public function handle(Message\\Sold $sold): void
    {
    }

    public static function getSubscribedEvents(): array
    {
        return [
            'kernel.request' => 'open',
            KernelEvents::RESPONSE => 'open',
            Closed::class => 'closed',
        ];
    }
}
""",
}


def test_frameworks_of_php(spark):
    files = spark.createDataFrame([(p, t, "php") for p, t in FRAMEWORKS.items()], "relative_path string, text string, language string")
    rows = {r["owner_key"]: r for r in declared.php(files).collect()}
    edges = lambda p: {(e["kind"], e["source"].split(":", 1)[1], e["target"].split(":", 1)[1]) for e in rows[p]["edges"]}
    provider, register = "class:App\\Providers\\AppServiceProvider", "method:App\\Providers\\AppServiceProvider::register"
    assert {
        ("binds", register, "class:App\\Services\\StripeGateway"), ("observes", register, "class:App\\Observers\\OrderObserver"), ("dispatches", register, "class:App\\Providers\\SendMail"),
        ("dispatches", register, "class:App\\Events\\OrderPaid"), ("listens_to", provider, "class:App\\Events\\OrderPaid"), ("listens_to", provider, "class:App\\Events\\OrderLost"), ("handles", provider, "class:App\\Models\\Order"),
    } == {e for e in edges("app/Providers/AppServiceProvider.php") if e[0] in ("binds", "observes", "dispatches", "listens_to", "handles")}
    assert {n["canonical_name"] for n in rows["routes/web.php"]["nodes"] if n["kind"] == "route"} == {"GET /", "GET /admin/orders", "POST /orders"}
    shop = "class:App\\Shop"
    assert {
        ("handles", "command:shop:open", shop), ("binds", "service:shop.service", shop), ("injects", shop, "service:mailer.fast"), ("listens_to", "method:App\\Shop::closed", "class:App\\Closed"), ("handles_message", shop, "class:App\\Message\\Sold"),
        ("listens_to", shop, "event:kernel.request"), ("listens_to", shop, "event:App\\KernelEvents::RESPONSE"), ("listens_to", shop, "class:App\\Closed"), ("routes_to", "route:ANY /shop/open", "method:App\\Shop::open"),
    } == {e for e in edges("src/Shop.php") if e[0] in ("binds", "injects", "listens_to", "handles", "handles_message", "routes_to")}
