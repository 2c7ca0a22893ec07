"""Operators that the larger queries are made of, each as a query of its own, with SQL for an independent engine."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schema as S
from ..config import boundaries as checked_boundaries
from ..graph import Graph
from ..ingest import classify, contributions, incremental, reconcile
from ..operators import change, counts, health, lookup, policy, snapshot, traverse
from ..sources import bundle, tree
from ..views import view
from .catalog import DEGREES, IMPACT, N_EXTERNAL, PATHS, RANK, SCANS, SNAPS, SYMBOL, TERM, TESTS, _named_paths, bfs, ids, on_graph, query, quoted, scans

# --- filters ---------------------------------------------------------------------------------------------------------------


@on_graph("flt_02_confidence_list", "SELECT id FROM nodes WHERE confidence IN ('certain', 'possible') AND (canonical_name ILIKE '%crm%' OR display_name ILIKE '%crm%' OR attributes_json ILIKE '%crm%' OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = nodes.id AND role ILIKE '%crm%')) ORDER BY CASE WHEN canonical_name ILIKE 'crm%' THEN 2 ELSE 3 END, canonical_name, id LIMIT 101")
def _(g: Graph) -> DataFrame:
    return lookup.search(g, "crm", confidences=["certain", "possible"], limit=100).select("id")


@on_graph("flt_03_kind_set", f"SELECT id, kind FROM edges WHERE kind IN ({IMPACT}) AND {RANK} >= 3")
def _(g: Graph) -> DataFrame:
    return g.following(S.kinds_of(None, S.IMPACT_KINDS), "certain").select("id", "kind")


@query("flt_05_literal_path_part", "SELECT relative_path, language, line_count, size FROM files WHERE contains(lower(relative_path), '/en/1') ORDER BY relative_path LIMIT 30")
def _(s: SparkSession, d: str) -> DataFrame:
    g = Graph(*[view(s, d, "files")] * 6)
    return lookup.file_metrics(g, "/EN/1", sort_by="path", descending=False, limit=30)


@query("flt_05_escaped_wildcards", "SELECT event_id, contains(lower(props), '_') AS under, contains(lower(props), '%') AS percent FROM events")
def _(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/events.parquet").select("event_id", lookup.contains("props", "_").alias("under"), lookup.contains("props", "%").alias("percent"))


@on_graph("flt_07_optional_filters", """
SELECT id FROM nodes n WHERE kind = 'class' AND confidence IN ('certain') AND EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role IN ('application.service', 'crm.building')) AND EXISTS (SELECT 1 FROM memberships m WHERE m.node_id = n.id AND boundary_id IN ('b:2', 'b:Brand#13', 'b:Brand#22'))
ORDER BY canonical_name, id LIMIT 101""")
def _(g: Graph) -> DataFrame:
    return lookup.search(g, "", ["class"], ["application.service", "crm.building"], ["b:2", "b:Brand#13", "b:Brand#22"], ["certain"], limit=100).select("id")


# --- joins -----------------------------------------------------------------------------------------------------------------


@on_graph("jon_02_edges_of_a_node", f"SELECT e.id, e.kind, s.canonical_name AS source, t.canonical_name AS target, f.relative_path FROM edges e JOIN nodes s ON s.id = e.source_id JOIN nodes t ON t.id = e.target_id LEFT JOIN files f ON f.id = e.file_id WHERE e.source_id = '{SYMBOL}' OR e.target_id = '{SYMBOL}'")
def _(g: Graph) -> DataFrame:
    a, b = (g.nodes.select(F.col("id").alias(f"{x}_id"), F.col("canonical_name").alias(x)) for x in ("source", "target"))
    at = g.edges.where((F.col("source_id") == SYMBOL) | (F.col("target_id") == SYMBOL))
    return at.join(a, "source_id").join(b, "target_id").join(g.files.select(F.col("id").alias("file_id"), "relative_path"), "file_id", "left").select("id", "kind", "source", "target", "relative_path")


@on_graph("jon_04_other_end", f"""
SELECT other, other_name, direction, count(*) AS n FROM (SELECT e.target_id AS other, n.canonical_name AS other_name, 'out' AS direction FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.source_id = '{SYMBOL}'
  UNION ALL SELECT e.source_id, n.canonical_name, 'in' FROM edges e JOIN nodes n ON n.id = e.source_id WHERE e.target_id = '{SYMBOL}') x GROUP BY ALL""")
def _(g: Graph) -> DataFrame:
    both = lookup.relationships(g, ids(g, SYMBOL), True, 10**6).unionByName(lookup.relationships(g, ids(g, SYMBOL), False, 10**6))
    return both.groupBy("other", "other_name", "direction").agg(F.count(F.lit(1)).alias("n"))


@query("jon_07_latest_scan", f"""
WITH {SCANS}, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, id DESC) AS k FROM scans) q WHERE k = 1)
SELECT CAST(c_custkey AS STRING) AS id, l.id AS latest_scan_id, l.status AS latest_status FROM customer LEFT JOIN latest l ON l.project_id = CAST(c_custkey AS STRING)""")
def _(s: SparkSession, d: str) -> DataFrame:
    projects = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.lit("x").alias("active_scan_id"), F.lit(True).alias("root_available"))
    return lookup.list_projects(projects, scans(s, d), {}).select("id", "latest_scan_id", "latest_status")


@query("jon_08_counts_by_project", """
SELECT CAST(c_custkey AS STRING) AS id, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS orders, (SELECT count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey) AS lines FROM customer""")
def _(s: SparkSession, d: str) -> DataFrame:
    o = s.read.parquet(f"{d}/orders.parquet")
    lines = s.read.parquet(f"{d}/lineitem.parquet").join(o.select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
    owner = F.col("o_custkey").cast("string").alias("project_id")
    projects = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.lit("x").alias("active_scan_id"), F.lit(True).alias("root_available"))
    return lookup.list_projects(projects, scans(s, d), {"orders": o.select(owner), "lines": lines.select(owner)}).select("id", "orders", "lines")


@query("jon_09_scans_with_snapshots", f"WITH {SCANS}, {SNAPS} SELECT s.id, s.status, complete, fact_count FROM scans s LEFT JOIN snaps ON snaps.scan_id = s.id")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").where("event_id % 3 = 0")
    snaps = e.select(F.concat(F.lit("scan:"), F.col("event_id").cast("string")).alias("id"), (F.col("event_id") % 2 == 0).alias("complete"), (F.col("event_id") * 10).alias("fact_count"))
    return scans(s, d).join(snaps, "id", "left").select("id", "status", "complete", "fact_count")


@on_graph("jon_12_in_subquery", "SELECT count(*) AS n, kind FROM nodes WHERE id IN (SELECT source_id FROM edges WHERE kind = 'calls') GROUP BY kind")
def _(g: Graph) -> DataFrame:
    return counts.count_by(g.nodes.join(g.edges.where("kind = 'calls'").select(F.col("source_id").alias("id")), "id", "left_semi"), "kind")


@on_graph("jon_13_degree_of_every_node", "SELECT n.id, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) x GROUP BY id) d USING (id)")
def _(g: Graph) -> DataFrame:
    return g.nodes.select("id").join(counts.degree(g.edges), "id", "left").select("id", F.coalesce("degree", F.lit(0)).alias("degree"))


@on_graph("jon_15_members_with_files", "SELECT boundary_id, n.id, n.canonical_name, f.relative_path FROM memberships m JOIN nodes n ON n.id = m.node_id LEFT JOIN files f ON f.id = n.file_id")
def _(g: Graph) -> DataFrame:
    return g.memberships.withColumnRenamed("node_id", "id").join(g.nodes.select("id", "canonical_name", "file_id"), "id").join(g.files.select(F.col("id").alias("file_id"), "relative_path"), "file_id", "left").select("boundary_id", "id", "canonical_name", "relative_path")


@on_graph("jon_16_policies_and_edges", """
WITH m AS (SELECT node_id, boundary_id FROM memberships) SELECT s.boundary_id AS from_boundary, t.boundary_id AS to_boundary, e.kind, count(*) AS n FROM edges e JOIN m s ON s.node_id = e.source_id JOIN m t ON t.node_id = e.target_id WHERE s.boundary_id <> t.boundary_id GROUP BY ALL""")
def _(g: Graph) -> DataFrame:
    a, b = (g.memberships.select(F.col("node_id").alias(f"{x}_id"), F.col("boundary_id").alias(y)) for x, y in (("source", "from_boundary"), ("target", "to_boundary")))
    return g.edges.join(a, "source_id").join(b, "target_id").where("from_boundary <> to_boundary").groupBy("from_boundary", "to_boundary", "kind").agg(F.count(F.lit(1)).alias("n"))


@query("jon_17_snapshots_by_key", "SELECT count(*) AS n, a.id IS NOT NULL AS before, b.id IS NOT NULL AS after FROM snap_a a FULL JOIN snap_b b ON a.id = b.id GROUP BY ALL")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = (view(s, d, f"snap_{x}").select("id", F.lit(True).alias(y)) for x, y in (("a", "before"), ("b", "after")))
    return a.join(b, "id", "full_outer").groupBy(F.coalesce("before", F.lit(False)).alias("before"), F.coalesce("after", F.lit(False)).alias("after")).agg(F.count(F.lit(1)).alias("n"))


CHURN = "newest AS (SELECT commit_id FROM commits ORDER BY ts DESC, commit_id DESC LIMIT 300), churn AS (SELECT path, count(DISTINCT commit_id) AS commit_count FROM commits JOIN newest USING (commit_id) GROUP BY path)"


@query("jon_18_churn_by_path", f"WITH {CHURN} SELECT DISTINCT c.path, coalesce(commit_count, 0) AS commit_count FROM commits c LEFT JOIN churn USING (path)")
def _(s: SparkSession, d: str) -> DataFrame:
    c = view(s, d, "commits")
    return c.select("path").distinct().join(counts.churn(c, 300).select("path", "commit_count"), "path", "left").select("path", F.coalesce("commit_count", F.lit(0)).alias("commit_count"))


# --- aggregates, tops, sets --------------------------------------------------------------------------------------------------


@query("agg_09_git_churn", f"WITH {CHURN} SELECT * FROM churn")
def _(s: SparkSession, d: str) -> DataFrame:
    return counts.churn(view(s, d, "commits"), 300).select("path", "commit_count")


@on_graph("agg_10_tests_of_a_file", f"""
SELECT f.relative_path, array_to_string(list_slice(list_sort(list(DISTINCT n.display_name)), 1, 3), '|') AS tests FROM nodes n JOIN files f ON f.id = n.file_id WHERE {TESTS} AND f.relative_path IN ({quoted(PATHS)}) GROUP BY f.relative_path""")
def _(g: Graph) -> DataFrame:
    return change.test_impact(g.with_edges(g.edges.where("false")), PATHS, 1).select("relative_path", "tests")


@on_graph("agg_11_greatest_degree", f"WITH {DEGREES} SELECT max(in_degree + out_degree) AS max_degree FROM degrees d JOIN nodes n ON n.id = d.id WHERE NOT {N_EXTERNAL} AND NOT {TESTS}")
def _(g: Graph) -> DataFrame:
    return health.hubs(g, limit=1).select(F.col("score").alias("max_degree"))


@on_graph("agg_14_least_confidence", f"SELECT source_id AS id, CASE min({RANK}) WHEN 3 THEN 'certain' WHEN 2 THEN 'probable' ELSE 'possible' END AS least FROM edges GROUP BY source_id")
def _(g: Graph) -> DataFrame:
    return g.edges.groupBy(F.col("source_id").alias("id")).agg(S.confidence_name(F.min(S.confidence_rank())).alias("least"))


@on_graph("top_01_one_more_than_asked", "SELECT id, count(*) OVER () > 5 AS truncated FROM (SELECT id, canonical_name FROM nodes WHERE display_name ILIKE '%red%' ORDER BY canonical_name, id LIMIT 6) x ORDER BY canonical_name, id LIMIT 5")
def _(g: Graph) -> DataFrame:
    from ..render import page

    rows, cut = page(g.nodes.where(lookup.contains("display_name", "red")).orderBy("canonical_name", "id").select("id"), 5)
    return g.spark.createDataFrame([(r["id"], cut) for r in rows], "id string, truncated boolean")


@on_graph("top_02_paging", "SELECT id FROM nodes WHERE kind = 'class' AND (canonical_name ILIKE '%crm%' OR display_name ILIKE '%crm%' OR attributes_json ILIKE '%crm%' OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = nodes.id AND role ILIKE '%crm%')) ORDER BY CASE WHEN canonical_name ILIKE 'crm%' THEN 2 ELSE 3 END, canonical_name, id LIMIT 21 OFFSET 40")
def _(g: Graph) -> DataFrame:
    return lookup.search(g, "crm", ["class"], limit=20, offset=40).select("id")


@on_graph("top_03_lookup_rank", f"SELECT relevance, count(*) AS n FROM (SELECT CASE WHEN canonical_name = '{TERM}' THEN 0 WHEN display_name = '{TERM}' THEN 1 WHEN canonical_name ILIKE '{TERM}%' THEN 2 WHEN display_name ILIKE '{TERM}%' THEN 3 ELSE 4 END AS relevance, canonical_name, id FROM nodes WHERE canonical_name ILIKE '%{TERM}%' OR display_name ILIKE '%{TERM}%' ORDER BY relevance, canonical_name, id LIMIT 101) x GROUP BY relevance")
def _(g: Graph) -> DataFrame:
    return lookup.find_component(g, TERM, 100).groupBy("relevance").agg(F.count(F.lit(1)).alias("n"))


@on_graph("top_05_latest_in_group", "SELECT source_id, max_by(id, (start_line, id)) AS id FROM edges GROUP BY source_id")
def _(g: Graph) -> DataFrame:
    return g.edges.groupBy("source_id").agg(F.max_by("id", F.struct("start_line", "id")).alias("id"))


@on_graph("top_08_by_several_keys", f"WITH {DEGREES} SELECT n.id, cross_degree FROM nodes n JOIN degrees d USING (id) WHERE NOT {N_EXTERNAL} AND NOT {TESTS} ORDER BY in_degree + out_degree DESC, canonical_name, n.id LIMIT 7")
def _(g: Graph) -> DataFrame:
    return health.hubs(g, limit=7).select("id", "cross_degree")


@on_graph("set_01_union_of_ends", "SELECT source_id AS id, 'source' AS side FROM edges UNION ALL SELECT target_id, 'target' FROM edges")
def _(g: Graph) -> DataFrame:
    return g.edges.select(F.col("source_id").alias("id"), F.lit("source").alias("side")).unionByName(g.edges.select(F.col("target_id").alias("id"), F.lit("target").alias("side")))


@on_graph("set_04_arrays", "WITH a AS (SELECT source_id AS id, list(DISTINCT kind) AS ks FROM edges GROUP BY 1), b AS (SELECT target_id AS id, list(DISTINCT kind) AS ks FROM edges GROUP BY 1) SELECT a.id, len(list_intersect(a.ks, b.ks)) AS both, len(list_filter(a.ks, lambda k: NOT list_contains(b.ks, k))) AS only_out FROM a JOIN b USING (id)")
def _(g: Graph) -> DataFrame:
    out, into = (g.edges.groupBy(F.col(f"{x}_id").alias("id")).agg(F.collect_set("kind").alias(x)) for x in ("source", "target"))
    return out.join(into, "id").select("id", F.size(F.array_intersect("source", "target")).cast("long").alias("both"), F.size(F.array_except("source", "target")).cast("long").alias("only_out"))


@on_graph("imp_01_by_confidence", f"WITH {bfs(f'SELECT {SYMBOL!r} AS id', 2)} SELECT rank, count(*) AS n FROM reached GROUP BY rank")
def _(g: Graph) -> DataFrame:
    return counts.histogram(traverse.impact(g, ids(g, SYMBOL), 2), "rank")


@on_graph("pol_02_boundary_names", "SELECT 'ASIA' AS name, id FROM boundaries WHERE name = 'ASIA' UNION ALL SELECT 'b:0', 'b:0' UNION ALL SELECT '@unassigned', '@unassigned'")
def _(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(n, policy.resolve_boundary(g, n)) for n in ("ASIA", "b:0", "@unassigned")], "name string, id string")


@on_graph("snp_05_public_surface", "SELECT id FROM nodes WHERE kind IN ('route', 'command', 'endpoint', 'export') UNION SELECT node_id FROM classifications WHERE role LIKE '%public%' OR role LIKE '%entry_point%'")
def _(g: Graph) -> DataFrame:
    return snapshot.public_surface(g)


# --- reconciliation ----------------------------------------------------------------------------------------------------------


def _facts(s: SparkSession, rows: DataFrame) -> DataFrame:
    """Nodes of facts, with ids and references, from ``kind, canonical_name``."""
    full = rows.select(F.lit("php").alias("language"), F.lit("a.php").alias("file"), F.lit(1).alias("place"), F.lit("x").alias("local_id"), "kind", "canonical_name", F.col("canonical_name").alias("display_name"))
    return reconcile.collect_nodes(full, "test")[0]


def _resolved(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """``source, place`` of resolved edges with the kind and name of what they reach."""
    found, _ = reconcile.resolve_targets(edges, nodes)
    hit = nodes.select(F.col("id").alias("target_id"), F.col("kind").alias("hit_kind"), F.col("canonical_name").alias("hit_name"))
    return found.join(hit, "target_id", "left").select("source", "place", F.coalesce("hit_kind", F.concat(F.lit("external_"), "t_kind")).alias("kind"), F.coalesce("hit_name", "t_name").alias("name"))


def _edges(rows: DataFrame) -> DataFrame:
    """Edge facts from ``kind, source, target, place``."""
    return rows.select("kind", "source", "target", F.lit("a.php").alias("file"), "place")


@query("rec_02_resolution_cascade", """
WITH d AS (SELECT DISTINCT CASE WHEN p_partkey % 3 = 0 THEN 'interface' ELSE 'class' END AS kind, p_name AS name FROM part WHERE p_partkey % 4 <> 1)
SELECT concat('php:class:', p_name) AS source, p_partkey AS place, coalesce(c.kind, i.kind, 'external_class') AS kind, p_name AS name FROM part LEFT JOIN d c ON c.name = p_name AND c.kind = 'class' LEFT JOIN d i ON i.name = p_name AND i.kind = 'interface'""")
def _(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    nodes = _facts(s, p.where("p_partkey % 4 <> 1").select(F.when(F.col("p_partkey") % 3 == 0, "interface").otherwise("class").alias("kind"), F.col("p_name").alias("canonical_name")).distinct())
    ref = F.concat(F.lit("php:class:"), "p_name")
    return _resolved(_edges(p.select(F.lit("references").alias("kind"), ref.alias("source"), ref.alias("target"), F.col("p_partkey").alias("place"))), nodes)


@query("rec_02_inherited_members", """
SELECT concat('php:class:P', CAST(p_partkey AS STRING)) AS source, p_partkey AS place, CASE WHEN own THEN 'method' ELSE 'external_method' END AS kind, concat(holder, '::run') AS name FROM (
  SELECT p_partkey, true AS own, CASE WHEN p_size % 7 = 0 THEN concat('P', CAST(p_partkey AS STRING)) WHEN p_size <= 9 THEN concat('T', CAST(p_size AS STRING)) WHEN p_brand LIKE '%1' THEN concat('B', p_brand) WHEN p_type LIKE '%E%' THEN concat('I', p_type)
    WHEN p_size % 10 <= 2 THEN concat('U', CAST(p_size % 10 AS STRING)) WHEN p_brand LIKE '%2' THEN concat('N', right(p_brand, 1)) WHEN p_type LIKE 'S%' THEN concat('J', substr(p_type, 1, 2))
    WHEN p_brand LIKE '%3' THEN concat('Z', right(p_brand, 1)) END AS holder FROM part) q WHERE holder IS NOT NULL
UNION ALL SELECT concat('php:class:P', CAST(p_partkey AS STRING)), p_partkey, 'external_method', concat('P', CAST(p_partkey AS STRING), '::run') FROM part
WHERE p_size % 7 <> 0 AND p_size > 9 AND NOT p_brand LIKE '%1' AND NOT p_type LIKE '%E%' AND p_size % 10 > 2 AND NOT p_brand LIKE '%2' AND NOT p_type LIKE 'S%' AND NOT p_brand LIKE '%3'""")
def _(s: SparkSession, d: str) -> DataFrame:
    # A trait, a parent and an interface each; what those are composed of in turn; and one level above.  Of a level the trait's side comes first.
    p = s.read.parquet(f"{d}/part.parquet").select("p_partkey", "p_size", "p_brand", "p_type")
    last, first = F.substring("p_brand", -1, 1), F.substring("p_type", 1, 2)
    name = lambda letter, x: F.concat(F.lit(letter), x.cast("string"))
    part, trait, base, face = name("P", F.col("p_partkey")), name("T", F.col("p_size")), name("B", F.col("p_brand")), name("I", F.col("p_type"))
    mixed, parent, wide, top = name("U", F.col("p_size") % 10), name("N", last), name("J", first), name("Z", last)
    holds = [(part, "p_size % 7 = 0"), (trait, "p_size <= 9"), (base, "p_brand LIKE '%1'"), (face, "p_type LIKE '%E%'"), (mixed, "p_size % 10 <= 2"), (parent, "p_brand LIKE '%2'"), (wide, "p_type LIKE 'S%'"), (top, "p_brand LIKE '%3'")]
    members = reduce(DataFrame.unionByName, [p.where(where).select(F.lit("method").alias("kind"), F.concat(who, F.lit("::run")).alias("canonical_name")).distinct() for who, where in holds])
    up = [("uses_trait", "class", part, "trait", trait), ("extends", "class", part, "class", base), ("implements", "class", part, "interface", face), ("uses_trait", "trait", trait, "trait", mixed), ("extends", "class", base, "class", parent), ("extends", "interface", face, "interface", wide), ("extends", "class", parent, "class", top)]
    ref = lambda kind, who: F.concat(F.lit(f"php:{kind}:"), who)
    composed = reduce(DataFrame.unionByName, [p.select(F.lit(kind).alias("kind"), ref(a, who).alias("source"), ref(b, above).alias("target"), F.col("p_partkey").alias("place")) for kind, a, who, b, above in up])
    calls = p.select(F.lit("calls").alias("kind"), ref("class", part).alias("source"), F.concat(ref("method", part), F.lit("::run")).alias("target"), F.col("p_partkey").alias("place"))
    return _resolved(_edges(composed.unionByName(calls)), _facts(s, members)).where("endswith(name, '::run')")


@query("rec_03_method_of_return", """
WITH m AS (SELECT c_custkey AS c, CASE WHEN c_custkey % 3 = 0 THEN c_nationkey END AS own FROM customer),
up AS (SELECT a.c, coalesce(a.own, b.own, e.own) AS n FROM m a LEFT JOIN m b ON b.c = a.c + 1 LEFT JOIN m e ON e.c = a.c + 2)
SELECT concat('php:class:C', CAST(c AS STRING)) AS source, c AS place, 'method' AS kind, concat('N', CAST(n AS STRING), '::go') AS name FROM up WHERE n IS NOT NULL AND n % 2 = 0""")
def _(s: SparkSession, d: str) -> DataFrame:
    # Each third customer makes its nation; the others inherit from the next.  Every second nation can go.
    c = s.read.parquet(f"{d}/customer.parquet").select("c_custkey", "c_nationkey")
    name = lambda p, x: F.concat(F.lit(p), x.cast("string"))
    k, n = F.col("c_custkey"), F.col("c_nationkey")
    nodes = _facts(s, c.select(F.lit("class").alias("kind"), name("C", k).alias("canonical_name")).unionByName(c.where("c_nationkey % 2 = 0").select(F.lit("method").alias("kind"), F.concat(name("N", n), F.lit("::go")).alias("canonical_name")).distinct()))
    returns = c.where("c_custkey % 3 = 0").select(F.lit("returns").alias("kind"), F.concat(name("php:method:C", k), F.lit("::make")).alias("source"), name("php:class:N", n).alias("target"), k.alias("place"))
    extends = c.where("c_custkey % 3 <> 0").select(F.lit("extends").alias("kind"), name("php:class:C", k).alias("source"), name("php:class:C", k + 1).alias("target"), k.alias("place"))
    calls = c.select(F.lit("calls").alias("kind"), name("php:class:C", k).alias("source"), F.concat(name("php:method_of_return:C", k), F.lit("::make::go")).alias("target"), k.alias("place"))
    edges = _edges(returns.unionByName(extends).unionByName(calls))
    return _resolved(edges, nodes).where("kind = 'method' AND endswith(name, '::go')")


@query("rec_04_namespaced_function", """
WITH f AS (SELECT DISTINCT CASE WHEN s_suppkey % 2 = 0 THEN concat('App\\', s_name) ELSE s_name END AS name FROM supplier WHERE s_suppkey % 5 <> 0)
SELECT concat('php:class:', s_name) AS source, s_suppkey AS place, CASE WHEN a.name IS NOT NULL OR b.name IS NOT NULL THEN 'function' ELSE 'external_function' END AS kind, coalesce(a.name, s_name) AS name FROM supplier LEFT JOIN f a ON a.name = concat('App\\', s_name) LEFT JOIN f b ON b.name = s_name""")
def _(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/supplier.parquet")
    full = F.concat(F.lit("App\\"), "s_name")
    nodes = _facts(s, p.where("s_suppkey % 5 <> 0").select(F.lit("function").alias("kind"), F.when(F.col("s_suppkey") % 2 == 0, full).otherwise(F.col("s_name")).alias("canonical_name")))
    return _resolved(_edges(p.select(F.lit("calls").alias("kind"), F.concat(F.lit("php:class:"), "s_name").alias("source"), F.concat(F.lit("php:namespaced_function:"), full).alias("target"), F.col("s_suppkey").alias("place"))), nodes)


@query("rec_05_references_that_are_none", "SELECT DISTINCT p_type AS message FROM part UNION SELECT DISTINCT 'php:class:' FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    bad = p.select("p_type").distinct().select(F.lit("calls").alias("kind"), F.lit("php:class:A").alias("source"), F.col("p_type").alias("target"), F.lit(1).alias("place"))
    more = bad.limit(1).withColumn("target", F.lit("php:class:"))
    nodes = _facts(s, s.createDataFrame([("class", "A")], "kind string, canonical_name string"))
    return reconcile.resolve_targets(_edges(bad.unionByName(more)), nodes)[1].select("message")


@query("rec_09_numbered_diagnostics", """
WITH t AS (SELECT concat('u', CAST(user_id % 50 AS STRING)) AS owner_key, 0 AS place, event_type AS severity, 'E' AS code, CAST(event_id AS STRING) AS message FROM events UNION ALL SELECT concat('u', CAST(doc_id % 50 AS STRING)), 1, lang, 'D', CAST(doc_id AS STRING) FROM documents)
SELECT owner_key || ':' || CAST(row_number() OVER (PARTITION BY owner_key ORDER BY place, severity, code, message) AS STRING) AS id, message FROM t""")
def _(s: SparkSession, d: str) -> DataFrame:
    e, docs = s.read.parquet(f"{d}/events.parquet"), s.read.parquet(f"{d}/documents.parquet")
    a = e.select(F.concat(F.lit("u"), (F.col("user_id") % 50).cast("string")).alias("owner_key"), F.col("event_type").alias("severity"), F.lit("E").alias("code"), F.col("event_id").cast("string").alias("message"))
    b = docs.select(F.concat(F.lit("u"), (F.col("doc_id") % 50).cast("string")).alias("owner_key"), F.col("lang").alias("severity"), F.lit("D").alias("code"), F.col("doc_id").cast("string").alias("message"))
    return contributions.numbered({"scanner": a, "discovery": b}).select("id", "message")


@query("rec_14_nothing_changed", "SELECT 'same' AS case_, true AS unchanged UNION ALL SELECT 'one gone', false UNION ALL SELECT 'other version', false")
def _(s: SparkSession, d: str) -> DataFrame:
    files = view(s, d, "files").select("relative_path", "content_hash")
    cache = files.withColumns({"scanner_version": F.lit("1"), "configuration_hash": F.lit("c")})
    got = [("same", incremental.unchanged(files, cache, "1", "c")), ("one gone", incremental.unchanged(files.where("NOT relative_path LIKE '%/7.txt'"), cache, "1", "c")), ("other version", incremental.unchanged(files, cache, "2", "c"))]
    return s.createDataFrame(got, "case_ string, unchanged boolean")


# --- classification and boundaries -------------------------------------------------------------------------------------------


def _with(s: SparkSession, d: str, attributes: F.Column) -> DataFrame:
    return _named_paths(s, d).withColumn("attributes_json", attributes)


@query("cls_02_base_classes", """
SELECT CAST(doc_id AS STRING) AS node_id, CASE doc_id % 6 WHEN 0 THEN 'laravel.model' ELSE 'laravel.command' END AS role FROM documents WHERE doc_id % 2 = 0 AND doc_id % 6 IN (0, 2)
UNION ALL SELECT CAST(doc_id AS STRING), 'laravel.queued' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 = 0""")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    base = F.when(k % 6 == 0, "Illuminate\\Database\\Eloquent\\Model").when(k % 6 == 2, "Illuminate\\Console\\Command").otherwise("Other\\Model")
    face = F.when(k % 5 == 0, F.array(F.lit("Illuminate\\Contracts\\Queue\\ShouldQueue"))).otherwise(F.array(F.lit("Countable")))
    return classify.by_base_class(_with(s, d, F.to_json(F.struct(base.alias("extends"), face.alias("implements"))))).select("node_id", "role")


@query("cls_03_path_fragments", """
SELECT CAST(doc_id AS STRING) AS node_id, CASE doc_id % 3 WHEN 0 THEN 'laravel.controller' ELSE 'laravel.job' END AS role FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 < 2""")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    return classify.by_path(_named_paths(s, d).withColumn("relative_path", F.concat(F.when(k % 3 == 0, "app/Http/Controllers/Jobs/").when(k % 3 == 1, "Jobs/").otherwise("lib/"), "relative_path"))).select("node_id", "role")


@query("cls_04_laravel_suffixes", "SELECT CAST(doc_id AS STRING) AS node_id, 'laravel.controller' AS role FROM documents WHERE doc_id % 4 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return classify.by_laravel_suffix(_named_paths(s, d)).select("node_id", "role")


@query("cls_05_symfony", """
SELECT CAST(doc_id AS STRING) AS node_id, 'symfony.controller' AS role FROM documents WHERE doc_id % 2 = 0 AND doc_id % 3 = 0 UNION ALL SELECT CAST(doc_id AS STRING), 'symfony.command' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 5 = 0
UNION ALL SELECT CAST(doc_id AS STRING), 'symfony.event_subscriber' FROM documents WHERE doc_id % 2 = 0 AND doc_id % 7 = 0""")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    some = lambda m, x: F.when(k % m == 0, F.array(F.lit(x))).otherwise(F.array(F.lit("A\\Other")))
    base = F.when(k % 3 == 0, "Symfony\\Bundle\\AbstractController").otherwise("A\\Thing")
    return classify.by_symfony(_with(s, d, F.to_json(F.struct(base.alias("extends"), some(7, "S\\EventSubscriberInterface").alias("implements"), some(5, "Symfony\\AsCommand").alias("php_attributes"))))).select("node_id", "role")


@query("cls_06_listed_roles", "SELECT CAST(doc_id AS STRING) AS node_id, 'nestjs.module' AS role FROM documents WHERE doc_id % 3 = 0 UNION ALL SELECT CAST(doc_id AS STRING), 'fastapi.route_handler' FROM documents WHERE doc_id % 5 = 0")
def _(s: SparkSession, d: str) -> DataFrame:
    k = F.col("id").cast("long")
    lists = F.struct(F.when(k % 3 == 0, F.array(F.lit("nestjs.module"), F.lit("made.up"))).alias("nestjs_roles"), F.when(k % 5 == 0, F.array(F.lit("fastapi.route_handler"))).alias("python_framework_roles"))
    return classify.by_attribute(_with(s, d, F.to_json(lists))).select("node_id", "role")


@query("cls_08_tool_files", r"SELECT CAST(doc_id AS STRING) AS node_id FROM paths WHERE regexp_matches(replace(path, '.pyi', '.py'), '(^|/)[^/]+\.config\.(js|cjs|mjs|jsx|ts|mts|cts|tsx|py)$')")
def _(s: SparkSession, d: str) -> DataFrame:
    return classify.by_tool_config(_named_paths(s, d).withColumn("relative_path", F.replace("relative_path", F.lit(".pyi"), F.lit(".py")))).select("node_id")


@query("cls_09_entry_points", "SELECT CAST(doc_id AS STRING) AS node_id FROM paths WHERE doc_id % 2 = 1 AND path IN (SELECT path FROM paths WHERE doc_id % 3 = 0)")
def _(s: SparkSession, d: str) -> DataFrame:
    nodes = _named_paths(s, d)
    return classify.by_entry_point(nodes.where("CAST(id AS BIGINT) % 3 = 0").select("relative_path"))(nodes).select("node_id")


@query("cls_10_explicit_roles", "SELECT CAST(doc_id AS STRING) AS node_id, CASE doc_id % 50 WHEN 8 THEN 'a' ELSE 'b' END AS role FROM documents WHERE doc_id % 50 = 8 AND doc_id % 4 = 0 OR doc_id % 50 = 9 AND doc_id % 4 = 1")
def _(s: SparkSession, d: str) -> DataFrame:
    return classify.explicit({"D8Controller": "a", "D9Job": "b"})(_named_paths(s, d)).select("node_id", "role")


@query("bnd_02_explicit_boundaries", "SELECT * FROM (VALUES ('explicit:web', 'web', 'path_prefix', 'src1/en/'), ('explicit:core', 'core', 'namespace_prefix', 'App\\')) v(id, name, matcher_type, matcher_value)")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = checked_boundaries([{"name": "web", "path_prefix": "src1/en"}, {"name": "core", "namespace_prefix": "App\\"}])
    return classify.explicit_boundaries(s, rows).drop("source")


# --- sinks, sources, upkeep --------------------------------------------------------------------------------------------------


@query("snk_04_stamped", "SELECT id, 'scan:9' AS last_scan_id FROM snap_b WHERE id IN (SELECT id FROM snap_a)")
def _(s: SparkSession, d: str) -> DataFrame:
    return incremental.stamp(view(s, d, "snap_b").join(view(s, d, "snap_a").select("id"), "id", "left_semi"), "scan:9").select("id", "last_scan_id")


@on_graph("snk_08_remapped", "SELECT a.canonical_name AS source, b.canonical_name AS target, count(*) AS n FROM edges e JOIN nodes a ON a.id = e.source_id JOIN nodes b ON b.id = e.target_id WHERE e.kind = 'imports' GROUP BY ALL")
def _(g: Graph) -> DataFrame:
    used = g.edges.where("kind = 'imports'")
    nodes, edges = bundle.remap(g.nodes, used, "other")
    a, b = (nodes.select(F.col("id").alias(f"{x}_id"), F.col("canonical_name").alias(x)) for x in ("source", "target"))
    return edges.join(a, "source_id").join(b, "target_id").groupBy("source", "target").agg(F.count(F.lit(1)).alias("n"))


@on_graph("snk_08_parent_cycles", "SELECT id FROM nodes WHERE false")
def _(g: Graph) -> DataFrame:
    return bundle.parent_cycles(g.nodes.where("kind <> 'method'"))


@query("src_04_requirements", """
SELECT concat('m', CAST(doc_id AS STRING), '/requirements.txt') AS relative_path, package, constraint_ FROM (SELECT doc_id, unnest(['django', lower(lang)]) AS package, unnest(['>=' || CAST(doc_id % 5 AS STRING), '']) AS constraint_ FROM documents) x""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet")
    files = docs.select(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit("/requirements.txt")).alias("relative_path"), F.concat(F.lit("# needs\nDjango>="), (F.col("doc_id") % 5).cast("string"), F.lit("\n\n"), "lang").alias("text"))
    return tree.requirements(files).withColumnRenamed("constraint", "constraint_")


@query("stl_01_state", "SELECT * FROM (VALUES ('no graph', 'missing'), ('newer attempt', 'stale'), ('too many', 'unverified'), ('same', 'fresh'), ('changed', 'stale')) v(case_, state)")
def _(s: SparkSession, d: str) -> DataFrame:
    files = view(s, d, "files").select("relative_path", "content_hash")
    few = files.orderBy("relative_path").limit(100)
    got = [
        ("no graph", incremental.staleness(files, None)), ("newer attempt", incremental.staleness(few, few, True)), ("too many", incremental.staleness(files, files, most_files=50)),
        ("same", incremental.staleness(few, few)), ("changed", incremental.staleness(few.withColumn("content_hash", F.lit("x")), few)),
    ]
    return s.createDataFrame(got, "case_ string, state string")
