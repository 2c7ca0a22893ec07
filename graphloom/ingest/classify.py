"""Roles by rule tables, and boundaries by inference."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import TEST_ROLE, TOOL_ROLE

# Roles by name suffix, path fragment, base class, interface, attribute and scanner list.
SUFFIX_ROLES = {"Controller": "application.controller", "Service": "application.service", "Repository": "persistence.repository", "Middleware": "application.middleware", "Listener": "messaging.listener", "Event": "messaging.event", "Job": "messaging.job", "Command": "application.command"}
LARAVEL_SUFFIX_ROLES = {"Controller": "laravel.controller", "Command": "laravel.command", "Job": "laravel.job", "Event": "laravel.event", "Listener": "laravel.listener", "Middleware": "laravel.middleware", "Provider": "laravel.provider", "Policy": "laravel.policy", "Repository": "laravel.repository"}
PATH_ROLES = [("/Http/Controllers/", "laravel.controller"), ("/Http/Middleware/", "laravel.middleware"), ("/Console/Commands/", "laravel.command"), ("/Jobs/", "laravel.job"), ("/Events/", "laravel.event"), ("/Listeners/", "laravel.listener"), ("/Providers/", "laravel.provider"), ("/Policies/", "laravel.policy"), ("/Models/", "laravel.model"), ("/Repositories/", "laravel.repository")]
BASE_ROLES = {
    "Illuminate\\Routing\\Controller": "laravel.controller", "Illuminate\\Database\\Eloquent\\Model": "laravel.model", "Illuminate\\Foundation\\Console\\Command": "laravel.command", "Illuminate\\Console\\Command": "laravel.command",
    "Illuminate\\Support\\ServiceProvider": "laravel.provider", "Illuminate\\Foundation\\Support\\Providers\\EventServiceProvider": "laravel.provider", "Illuminate\\Foundation\\Http\\Middleware": "laravel.middleware",
}
INTERFACE_ROLES = {"Illuminate\\Contracts\\Queue\\ShouldQueue": "laravel.queued", "Illuminate\\Contracts\\Events\\Dispatcher": "laravel.event_dispatcher"}
SYMFONY_BASES = {"\\AbstractController": "symfony.controller"}
SYMFONY_INTERFACES = {"\\EventSubscriberInterface": "symfony.event_subscriber", "\\MessageHandlerInterface": "symfony.message_handler"}
SYMFONY_ATTRIBUTES = {"AsCommand": "symfony.command", "AsEventListener": "symfony.event_listener", "AsMessageHandler": "symfony.message_handler", "Route": "symfony.route_handler", "AsAlias": "symfony.service", "Autoconfigure": "symfony.service"}
LISTED_ROLES = {
    "nestjs_roles": ["nestjs.module", "nestjs.controller", "nestjs.provider"],
    "python_framework_roles": ["django.middleware", "django.model", "django.view", "fastapi.route_handler", "python.task"],
    "typescript_framework_roles": ["nextjs.layout", "nextjs.page", "nextjs.route_handler", "nextjs.server_action", "react.component", "react.hook", "state.store", "vue.component", "vue.composable"],
}
UNDER_ROOTS = ["src", "lib", "app", "source"]
TEST_SEGMENTS = ["tests", "test", "spec"]
TOOL_FILES = r"(?:^|/)(?:[^/]+\.(?:config|conf)|\.[^/.]+rc|gulpfile|gruntfile|conftest)\.(?:js|cjs|mjs|jsx|ts|mts|cts|tsx|py)$"

#: A rule takes nodes with ``relative_path`` and gives ``node_id, role, confidence, rule_id``.
Rule = Callable[[DataFrame], DataFrame]


def _given(rows: DataFrame, role: Column | str, confidence: str, rule: str) -> DataFrame:
    return rows.select(F.col("id").alias("node_id"), (role if isinstance(role, Column) else F.lit(role)).alias("role"), F.lit(confidence).alias("confidence"), F.lit(rule).alias("rule_id")).where("role is not null")


def by_suffix(nodes: DataFrame, table: dict[str, str] = SUFFIX_ROLES, rule: str = "name_suffix") -> DataFrame:
    """Classes by the end of their name; one may match several rows of the table."""
    found = F.filter(F.array(*[F.when(F.col("display_name").endswith(s), F.lit(r)) for s, r in table.items()]), lambda x: x.isNotNull())
    return _given(nodes.where("kind = 'class'").withColumn("role", F.explode(found)), F.col("role"), "possible", rule)


def by_laravel_suffix(nodes: DataFrame) -> DataFrame:
    return by_suffix(nodes, LARAVEL_SUFFIX_ROLES, "laravel_suffix")


def _listed(attribute: str) -> Column:
    return F.coalesce(F.from_json(F.get_json_object("attributes_json", f"$.{attribute}"), "array<string>"), F.array().cast("array<string>"))


def _matching(values: Column, test: Callable[[Column, str], Column], table: dict[str, str]) -> Column:
    """Roles of the table's rows that some value fits."""

    def some(key: str) -> Column:
        return F.exists(values, lambda v: test(v, key))

    return F.filter(F.array(*[F.when(some(k), F.lit(r)) for k, r in table.items()]), lambda x: x.isNotNull())


def by_base_class(nodes: DataFrame) -> DataFrame:
    """Equal base class or interface."""
    base = F.filter(F.array(F.get_json_object("attributes_json", "$.extends")), lambda x: x.isNotNull())
    same = lambda v, k: v == k
    roles = F.array_distinct(F.concat(_matching(base, same, BASE_ROLES), _matching(_listed("implements"), same, INTERFACE_ROLES)))
    return _given(nodes.where("kind = 'class'").withColumn("role", F.explode(roles)), F.col("role"), "certain", "laravel_types")


def by_symfony(nodes: DataFrame) -> DataFrame:
    """The end of the base class or of an interface, or an attribute's short name."""
    base = F.filter(F.array(F.get_json_object("attributes_json", "$.extends")), lambda x: x.isNotNull())
    ends = lambda v, k: v.endswith(k)
    short = F.transform(_listed("php_attributes"), lambda x: F.element_at(F.split(x, r"\\"), -1))
    roles = F.array_distinct(F.concat(_matching(base, ends, SYMFONY_BASES), _matching(_listed("implements"), ends, SYMFONY_INTERFACES), _matching(short, lambda v, k: v == k, SYMFONY_ATTRIBUTES)))
    return _given(nodes.where("kind IN ('class', 'method')").withColumn("role", F.explode(roles)), F.col("role"), "certain", "symfony")


def by_path(nodes: DataFrame) -> DataFrame:
    """The first fragment that the path contains."""
    role = F.lit(None).cast("string")
    for fragment, r in reversed(PATH_ROLES):
        role = F.when(F.concat(F.lit("/"), "relative_path").contains(fragment), r).otherwise(role)
    return _given(nodes.where("kind = 'class'"), role, "probable", "laravel_paths")


def by_attribute(nodes: DataFrame) -> DataFrame:
    """Allowed roles that the scanner listed."""
    roles = F.array_distinct(F.concat(*[F.array_intersect(_listed(a), F.array(*[F.lit(r) for r in allowed])) for a, allowed in LISTED_ROLES.items()]))
    return _given(nodes.withColumn("role", F.explode(roles)), F.col("role"), "certain", "framework_roles")


def is_test_path(path: Column) -> Column:
    """A test folder that isn't below a source root, ``__tests__`` anywhere, or a test-like file name."""
    parts = F.split(path, "/")
    folders = F.slice(parts, 1, F.size(parts) - 1)
    state = F.aggregate(
        folders, F.struct(F.lit(False).alias("under"), F.lit(False).alias("hit")),
        lambda s, p: F.struct((s["under"] | p.isin(UNDER_ROOTS)).alias("under"), (s["hit"] | p.isin("__tests__", "__test__") | (p.isin(TEST_SEGMENTS) & ~s["under"])).alias("hit")),
    )
    stem = F.regexp_replace(F.element_at(parts, -1), r"\.[^.]+$", "")
    return state["hit"] | stem.rlike(r"(?:\.test|\.spec|_test|[a-z0-9]Test)$|^test_")


def by_test_path(nodes: DataFrame) -> DataFrame:
    return _given(nodes.where(is_test_path(F.col("relative_path"))), TEST_ROLE, "probable", "test_modules")


def by_tool_config(nodes: DataFrame) -> DataFrame:
    return _given(nodes.where(F.col("relative_path").rlike(TOOL_FILES)), TOOL_ROLE, "certain", "tool_config")


def by_entry_point(paths: DataFrame) -> Rule:
    """``paths``: relative_path of the manifests' entry points."""
    return lambda nodes: _given(nodes.where("kind = 'module'").join(paths.select("relative_path").distinct(), "relative_path", "left_semi"), "application.entry_point", "certain", "manifest_entry")


def explicit(roles: dict[str, str]) -> Rule:
    def rule(nodes: DataFrame) -> DataFrame:
        given = nodes.sparkSession.createDataFrame(list(roles.items()), "canonical_name string, role string")
        return _given(nodes.join(given, "canonical_name"), F.col("role"), "certain", "user")

    return rule


#: The rules of every project, and those of the frameworks that it uses.
RULES: list[Rule] = [by_suffix, by_attribute, by_test_path, by_tool_config]
LARAVEL: list[Rule] = [by_base_class, by_path, by_laravel_suffix]
SYMFONY: list[Rule] = [by_symfony]


def rules_for(frameworks: list[str] | tuple[str, ...], entry_points: DataFrame | None = None) -> list[Rule]:
    """The rules of a project that uses these frameworks."""
    out = [*RULES, *(LARAVEL if "laravel" in frameworks else []), *(SYMFONY if "symfony" in frameworks else [])]
    return [*out, by_entry_point(entry_points)] if entry_points is not None else out


def explicit_boundaries(spark: SparkSession, rows: Iterable[dict[str, str]]) -> DataFrame:
    """Boundaries as the configuration names them: ``id, name, matcher_type, matcher_value, source``."""
    out = []
    for b in rows:
        kind = "path_prefix" if b.get("path_prefix") is not None else "namespace_prefix"
        value = b[kind].replace("\\", "/").strip("/") + "/" if kind == "path_prefix" else b[kind].strip("\\") + "\\"
        out.append((f"explicit:{b['name']}", b["name"], kind, value, "explicit"))
    return spark.createDataFrame(out, "id string, name string, matcher_type string, matcher_value string, source string")


def classify(nodes: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """All rules on all nodes; a node has a role by a rule once."""
    return reduce(DataFrame.unionByName, [r(nodes) for r in (rules or RULES)]).dropDuplicates(["node_id", "role", "rule_id"])


def infer_boundaries(nodes: DataFrame, manifests: DataFrame | None = None) -> DataFrame:
    """Boundaries of manifests' folders, top namespaces and top folders: ``name, matcher_type, matcher_value``.

    Equal matchers become one, named by the first in order, with how many others there are.
    """
    inner = nodes.where(~F.col("kind").isin("route", "endpoint") & ~F.col("kind").startswith("external_"))
    top = F.substring_index(F.ltrim(F.col("canonical_name"), F.lit("\\")), "\\", 1)
    php = inner.where("language = 'php'").where(F.col("canonical_name").contains("\\")).select(top.alias("name"), F.lit("namespace_prefix").alias("matcher_type"), F.concat(top, F.lit("\\")).alias("matcher_value"))
    folder = F.split_part("relative_path", F.lit("/"), F.lit(1))
    other = inner.where("language <> 'php'").where(F.col("relative_path").contains("/")).select(folder.alias("name"), F.lit("path_prefix").alias("matcher_type"), F.concat(folder, F.lit("/")).alias("matcher_value"))
    rows = php.unionByName(other)
    if manifests is not None:
        base = F.regexp_replace("relative_path", r"[^/]*$", "")
        rows = rows.unionByName(manifests.select(F.coalesce("name", base).alias("name"), F.lit("path_prefix").alias("matcher_type"), base.alias("matcher_value")))
    grouped = rows.distinct().groupBy("matcher_type", "matcher_value").agg(F.array_sort(F.collect_set("name")).alias("names"))
    more = F.size("names") - 1
    return grouped.select(F.when(more > 0, F.concat(F.col("names")[0], F.lit(" (+"), more.cast("string"), F.lit(")"))).otherwise(F.col("names")[0]).alias("name"), "matcher_type", "matcher_value")


def memberships(nodes: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Prefix membership as an equi-join: every prefix of a path or name that ends at a separator is looked up.

    Paths match at ``/``, names at ``\\``; marked external nodes have no path membership.
    """

    def prefixes(text: Column, sep: str) -> Column:
        parts = F.split(text, F.lit("\\" + sep if sep == "\\" else sep))
        return F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), sep))

    path = lambda c: F.rtrim(c, F.lit("/"))
    name = lambda c: F.trim(c, F.lit("\\"))
    external = F.coalesce(F.get_json_object("attributes_json", "$.external") == "true", F.lit(False))
    by_path = nodes.where(~external & F.col("relative_path").isNotNull()).select(F.col("id").alias("node_id"), F.explode(prefixes(F.col("relative_path"), "/")).alias("p")).join(boundaries.where("matcher_type = 'path_prefix'").select(F.col("id").alias("boundary_id"), path(F.col("matcher_value")).alias("p")), "p")
    by_name = nodes.select(F.col("id").alias("node_id"), F.explode(prefixes(name(F.col("canonical_name")), "\\")).alias("p")).join(boundaries.where("matcher_type = 'namespace_prefix'").select(F.col("id").alias("boundary_id"), name(F.col("matcher_value")).alias("p")), "p")
    return by_path.unionByName(by_name).select("boundary_id", "node_id").distinct()
