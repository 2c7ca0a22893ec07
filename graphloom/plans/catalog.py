"""Every operator as a query over the test tables' graph, with SQL for an independent engine where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schema as S
from ..functions import text as T
from ..graph import Graph, is_external, is_script, repository_wide
from ..ingest import classify, incremental, reconcile
from ..operators import change, counts, health, location, lookup, policy, scc, snapshot, traverse
from ..sources import bundle, tree
from ..streaming import watch
from ..views import WITH, graph, view
from .. import render

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

#: The component, names and files that the queries ask about.
SYMBOL, TERM, PATHS = "p:7", "red WIDGET", ["src0/en/3.txt", "src1/en/1.txt"]


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            SQL[name] = WITH + ",\n" + sql.strip()[5:] if sql.strip().startswith("WITH ") else f"{WITH}\n{sql.strip()}"
        return f

    return add


def on_graph(name: str, sql: str | None = None) -> Callable[[Callable[[Graph], DataFrame]], Callable]:
    def add(f: Callable[[Graph], DataFrame]) -> Callable:
        query(name, sql)(lambda s, d: f(graph(s, d)))
        return f

    return add


def ids(g: Graph, *names: str) -> DataFrame:
    return g.spark.createDataFrame([(n,) for n in names], "id string")


def quoted(names: list[str]) -> str:
    return ", ".join(f"'{n}'" for n in names)


IMPACT, FLOW = quoted(S.IMPACT_KINDS), quoted(S.FLOW_KINDS)
RANK = "CASE confidence WHEN 'certain' THEN 3 WHEN 'probable' THEN 2 ELSE 1 END"
EXTERNAL = "(starts_with(kind, 'external_') OR origin IN ('external', 'unresolved'))"

# --- sources -----------------------------------------------------------------------------------------------------------


@query("src_02_ignore_matcher", """
SELECT id, CASE WHEN regexp_matches(relative_path, '^src[3-9]/[^a-e][^/]/') THEN true WHEN relative_path LIKE '%/1_7.txt' THEN false WHEN relative_path LIKE '%7.txt' THEN true WHEN starts_with(relative_path, 'src1/en/') THEN false
  WHEN starts_with(relative_path, 'src1/') THEN true ELSE false END AS hidden FROM files""")
def _(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "files").select("id", tree.ignored("relative_path", ["src1/**", " !/src1/en", "*7.txt", "!1?7.txt", "", "src[3-9]\\[!a-e]?/"]).alias("hidden"))


@query("src_03_language", r"""
WITH e AS (SELECT doc_id, lower(regexp_extract(path, '\.([^./]+)$', 1)) AS ext, first_line FROM paths)
SELECT doc_id, CASE WHEN ext = 'php' THEN 'php' WHEN ext IN ('ts', 'tsx', 'js', 'jsx', 'mjs', 'cjs', 'mts', 'cts') THEN 'typescript' WHEN ext IN ('py', 'pyi') THEN 'python'
  WHEN ext = '' AND regexp_matches(first_line, '^#!.*\bnode') THEN 'typescript' WHEN ext = '' AND regexp_matches(first_line, '^#!.*\bpython') THEN 'python' END AS language FROM e""")
def _(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "paths").select("doc_id", tree.language("path", "first_line").alias("language"))


@query("src_06_fingerprint", """
SELECT doc_id, sha256(text) AS content_hash, CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS BIGINT) AS line_count FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.sha2("text", 256).alias("content_hash"), T.line_count(F.col("text")).alias("line_count"))


@query("src_07_input_hash", """
WITH g AS (SELECT substr(md5(relative_path), 1, 2) AS g, sha256(string_agg(relative_path || '=' || content_hash, chr(10) ORDER BY relative_path || '=' || content_hash)) AS h FROM files GROUP BY 1)
SELECT sha256(string_agg(g || '=' || h, chr(10) ORDER BY g)) AS input_hash FROM g""")
def _(s: SparkSession, d: str) -> DataFrame:
    return tree.input_hash(view(s, d, "files"))


@query("src_16_git_history", """
WITH newest AS (SELECT commit_id, ts FROM commits ORDER BY ts DESC, commit_id DESC LIMIT 400)
SELECT path, count(DISTINCT commit_id) AS commit_count, array_to_string(list_sort(list(DISTINCT author)), '|') AS authors, max(ts) AS last_changed_at
FROM commits JOIN newest USING (commit_id, ts) GROUP BY path""")
def _(s: SparkSession, d: str) -> DataFrame:
    return counts.churn(view(s, d, "commits"), 400).withColumn("authors", F.array_join("authors", "|"))


@query("src_22_excerpt", """
SELECT doc_id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS excerpt FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/documents.parquet").select("doc_id", T.excerpt(F.col("text"), 2, 4).alias("excerpt"))


# --- lookup and listings -------------------------------------------------------------------------------------------------


@on_graph("qry_01_architecture_summary", """
WITH a AS (SELECT 'node_kind' AS section, kind AS key, count(*) AS n FROM nodes GROUP BY kind UNION ALL SELECT 'edge_kind', kind, count(*) FROM edges GROUP BY kind
  UNION ALL SELECT 'role', role, count(*) FROM classifications GROUP BY role UNION ALL SELECT 'language', language, count(*) FROM nodes GROUP BY language),
b AS (SELECT *, row_number() OVER (PARTITION BY section ORDER BY n DESC, key) AS k, count(*) OVER (PARTITION BY section) AS groups FROM a)
SELECT section, key, n, groups FROM b WHERE k <= 4""")
def _(g: Graph) -> DataFrame:
    return counts.architecture_summary(g, 4)


@on_graph("qry_02_find_component", """
SELECT id, kind, canonical_name, display_name, CASE WHEN canonical_name = 'red WIDGET' THEN 0 WHEN display_name = 'red WIDGET' THEN 1 WHEN canonical_name ILIKE 'red WIDGET%' THEN 2 WHEN display_name ILIKE 'red WIDGET%' THEN 3 ELSE 4 END AS relevance
FROM nodes WHERE canonical_name ILIKE '%red WIDGET%' OR display_name ILIKE '%red WIDGET%' ORDER BY relevance, canonical_name, id LIMIT 21""")
def _(g: Graph) -> DataFrame:
    return lookup.find_component(g, TERM)


@on_graph("flt_06_name_resolution", """
WITH t AS (SELECT *, CASE WHEN canonical_name = 'nation_1' OR display_name = 'nation_1' THEN 1 WHEN canonical_name ILIKE 'nation!_1%' ESCAPE '!' OR display_name ILIKE 'nation!_1%' ESCAPE '!' THEN 2 END AS tier FROM nodes)
SELECT id, tier FROM t WHERE tier = (SELECT min(tier) FROM t)""")
def _(g: Graph) -> DataFrame:
    return lookup.resolve(g, "nation_1").select("id", "tier")


@on_graph("qry_03_search_architecture", """
WITH hits AS (SELECT * FROM nodes n WHERE kind IN ('class', 'function') AND (canonical_name ILIKE '%catalog%' OR display_name ILIKE '%catalog%' OR attributes_json ILIKE '%catalog%' OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role ILIKE '%catalog%'))
  AND (canonical_name ILIKE '%service%' OR display_name ILIKE '%service%' OR attributes_json ILIKE '%service%' OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role ILIKE '%service%')))
SELECT id, kind, canonical_name, CASE WHEN canonical_name ILIKE 'catalog service%' THEN 2 ELSE 3 END AS relevance FROM hits ORDER BY relevance, canonical_name, id LIMIT 21""")
def _(g: Graph) -> DataFrame:
    return lookup.search(g, "catalog service", kinds=["class", "function"])


@on_graph("jon_10_semi_joins", """
SELECT id FROM nodes n WHERE EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role IN ('quality.test_module', 'application.controller')) AND EXISTS (SELECT 1 FROM memberships m WHERE m.node_id = n.id AND boundary_id LIKE 'b:Brand#1%')""")
def _(g: Graph) -> DataFrame:
    rows = g.nodes.join(g.classifications.where(F.col("role").isin(S.TEST_ROLE, "application.controller")), F.col("id") == F.col("node_id"), "left_semi")
    return rows.join(g.memberships.where(F.col("boundary_id").startswith("b:Brand#1")), F.col("id") == F.col("node_id"), "left_semi").select("id")


@on_graph("jon_11_anti_join", "SELECT id FROM nodes n WHERE NOT EXISTS (SELECT 1 FROM edges e WHERE e.target_id = n.id)")
def _(g: Graph) -> DataFrame:
    return g.nodes.join(g.edges, F.col("target_id") == g.nodes["id"], "left_anti").select("id")


@on_graph("qry_04_inspect_component", f"""
WITH o AS (SELECT s.id, 'out' AS direction, e.kind, e.target_id AS other, n.canonical_name AS other_name, e.confidence, row_number() OVER (PARTITION BY s.id ORDER BY CASE e.confidence WHEN 'certain' THEN 3 WHEN 'probable' THEN 2 ELSE 1 END DESC, e.kind, n.canonical_name, e.id) AS k
  FROM edges e JOIN nodes s ON e.source_id = s.id JOIN nodes n ON e.target_id = n.id WHERE s.id IN ('{SYMBOL}', 'n:3')),
i AS (SELECT s.id, 'in' AS direction, e.kind, e.source_id AS other, n.canonical_name AS other_name, e.confidence, row_number() OVER (PARTITION BY s.id ORDER BY CASE e.confidence WHEN 'certain' THEN 3 WHEN 'probable' THEN 2 ELSE 1 END DESC, e.kind, n.canonical_name, e.id) AS k
  FROM edges e JOIN nodes s ON e.target_id = s.id JOIN nodes n ON e.source_id = n.id WHERE s.id IN ('{SYMBOL}', 'n:3'))
SELECT id, direction, kind, other, other_name, confidence FROM (SELECT * FROM o UNION ALL SELECT * FROM i) x WHERE k <= 25""")
def _(g: Graph) -> DataFrame:
    some = ids(g, SYMBOL, "n:3")
    return lookup.relationships(g, some).unionByName(lookup.relationships(g, some, outgoing=False))


@on_graph("jon_03_identity", """
SELECT n.id, n.kind, n.canonical_name, n.display_name, n.confidence, f.relative_path, n.start_line, p.canonical_name AS parent_name FROM nodes n LEFT JOIN files f ON n.file_id = f.id LEFT JOIN nodes p ON n.parent_id = p.id WHERE n.kind IN ('module', 'class')""")
def _(g: Graph) -> DataFrame:
    return lookup.identity(g, g.nodes.where(F.col("kind").isin("module", "class")))


@on_graph("top_06_first_children", """
WITH c AS (SELECT DISTINCT source_id AS parent, target_id AS id FROM edges WHERE kind = 'contains'),
r AS (SELECT parent, n.id, n.kind, n.canonical_name, row_number() OVER (PARTITION BY parent ORDER BY n.canonical_name, n.id) AS k FROM c JOIN nodes n ON c.id = n.id)
SELECT parent, id, kind, canonical_name FROM r WHERE k <= 5""")
def _(g: Graph) -> DataFrame:
    return lookup.children(g, g.nodes, 5)


@on_graph("qry_05_list_usages", f"""
SELECT e.id AS edge_id, e.kind, n.canonical_name AS user, f.relative_path, e.start_line, e.confidence FROM edges e JOIN nodes n ON e.source_id = n.id LEFT JOIN files f ON e.file_id = f.id
WHERE e.target_id = '{SYMBOL}' AND e.kind IN ({IMPACT}) ORDER BY f.relative_path NULLS FIRST, e.start_line, e.id LIMIT 101""")
def _(g: Graph) -> DataFrame:
    return lookup.list_usages(g, ids(g, SYMBOL))


@on_graph("agg_02_count_usages", f"SELECT count(*) AS total FROM edges WHERE target_id = '{SYMBOL}' AND kind IN ({IMPACT})")
def _(g: Graph) -> DataFrame:
    return lookup.count_usages(g, ids(g, SYMBOL))


@on_graph("qry_06_file_metrics", "SELECT relative_path, language, line_count, size FROM files WHERE relative_path ILIKE '%SRC1%' AND language = 'en' ORDER BY line_count DESC, relative_path LIMIT 20 OFFSET 5")
def _(g: Graph) -> DataFrame:
    return lookup.file_metrics(g, "SRC1", "en", limit=20, offset=5)


@on_graph("qry_07_list_boundaries", """
WITH c AS (SELECT b.id, b.name, b.source, count(m.node_id) AS member_count FROM boundaries b LEFT JOIN memberships m ON m.boundary_id = b.id GROUP BY b.id, b.name, b.source),
r AS (SELECT boundary_id, canonical_name, row_number() OVER (PARTITION BY boundary_id ORDER BY canonical_name, node_id) AS k FROM memberships JOIN nodes ON node_id = nodes.id),
f AS (SELECT boundary_id, string_agg(canonical_name, '|' ORDER BY k) AS members FROM r WHERE k <= 5 GROUP BY boundary_id)
SELECT c.*, coalesce(members, '') AS members FROM c LEFT JOIN f ON f.boundary_id = c.id ORDER BY name, id LIMIT 50""")
def _(g: Graph) -> DataFrame:
    return lookup.list_boundaries(g)


SCANS = """scans AS (SELECT concat('scan:', CAST(event_id AS STRING)) AS id, CAST(user_id AS STRING) AS project_id, CASE event_type WHEN 'click' THEN 'complete' WHEN 'view' THEN 'running' WHEN 'purchase' THEN 'failed' ELSE 'cancelled' END AS status, ts AS started_at FROM events)"""


def scans(s: SparkSession, d: str) -> DataFrame:
    return s.sql(f"WITH {SCANS.replace('FROM events', 'FROM {events}')} SELECT * FROM scans", events=s.read.parquet(f"{d}/events.parquet"))


@query("qry_08_list_projects", f"""
WITH {SCANS}, projects AS (SELECT CAST(c_custkey AS STRING) AS id, c_name AS name, CASE WHEN c_acctbal > 0 THEN 'x' END AS active_scan_id, c_acctbal < 8000 AS root_available FROM customer),
latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY started_at DESC, id DESC) AS k FROM scans) q WHERE k = 1)
SELECT p.id, p.name, p.active_scan_id, l.id AS latest_scan_id, l.status AS latest_status, (SELECT count(*) FROM orders o WHERE CAST(o.o_custkey AS STRING) = p.id) AS orders,
  CASE WHEN active_scan_id IS NULL THEN 'unscanned' WHEN l.status = 'running' THEN 'scan_in_progress' WHEN l.status = 'failed' THEN 'latest_scan_failed' WHEN l.status = 'cancelled' THEN 'latest_scan_cancelled' WHEN NOT root_available THEN 'root_unavailable' ELSE 'ready' END AS freshness
FROM projects p LEFT JOIN latest l ON l.project_id = p.id""")
def _(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    projects = c.select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), F.when(F.col("c_acctbal") > 0, "x").alias("active_scan_id"), (F.col("c_acctbal") < 8000).alias("root_available"))
    orders = s.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").cast("string").alias("project_id"))
    return lookup.list_projects(projects, scans(s, d), {"orders": orders})


SNAPS = "snaps AS (SELECT concat('scan:', CAST(event_id AS STRING)) AS scan_id, event_id % 2 = 0 AS complete, event_id * 10 AS fact_count, event_id AS sequence FROM events WHERE event_id % 3 = 0)"


@query("qry_09_list_snapshots", f"""
WITH {SCANS}, {SNAPS} SELECT s.id, s.project_id, s.status, s.started_at, coalesce(complete, false) AS complete, coalesce(fact_count, 0) AS fact_count, coalesce(sequence, -1) AS sequence, s.id = 'scan:4' AS active FROM scans s LEFT JOIN snaps ON snaps.scan_id = s.id WHERE s.id = 'scan:4' OR sequence IS NOT NULL
ORDER BY s.id = 'scan:4' DESC, snaps.sequence DESC NULLS LAST, s.id LIMIT 20""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").where("event_id % 3 = 0")
    snaps = e.select(F.concat(F.lit("scan:"), F.col("event_id").cast("string")).alias("scan_id"), (F.col("event_id") % 2 == 0).alias("complete"), (F.col("event_id") * 10).alias("fact_count"), F.col("event_id").alias("sequence"))
    return lookup.list_snapshots(scans(s, d), snaps, "scan:4").na.fill(False, ["complete"]).na.fill(0, ["fact_count"]).na.fill(-1, ["sequence"])


# --- predicates, aggregates, sets ----------------------------------------------------------------------------------------


@on_graph("flt_01_confidence_threshold", f"SELECT id FROM edges WHERE {RANK} >= 2 AND kind IN ('calls', 'references')")
def _(g: Graph) -> DataFrame:
    return g.following(["calls", "references"], "probable").select("id")


@on_graph("flt_04_like_escape", "SELECT id FROM nodes WHERE canonical_name ILIKE 'crm.%' AND canonical_name ILIKE '%er!#%' ESCAPE '!' OR display_name ILIKE '%r!#00000000%' ESCAPE '!'")
def _(g: Graph) -> DataFrame:
    return g.nodes.where((lookup.starts("canonical_name", "crm.") & lookup.contains("canonical_name", "er#")) | lookup.contains("display_name", "r#00000000")).select("id")


@on_graph("flt_08_repository_wide", "SELECT id, matcher_type = 'path_prefix' AND trim(coalesce(matcher_value, ''), '/') = '' AS wide FROM boundaries")
def _(g: Graph) -> DataFrame:
    return g.boundaries.select("id", repository_wide().alias("wide"))


@on_graph("flt_09_reportability", f"""
SELECT id, {EXTERNAL} AS external, coalesce(kind = 'module' AND json_extract_string(attributes_json, '$.executable') = 'true', false) AS script FROM nodes""")
def _(g: Graph) -> DataFrame:
    return g.nodes.select("id", is_external().alias("external"), is_script().alias("script"))


@on_graph("flt_10_suppression", "SELECT id, starts_with(canonical_name, 'crm.AUTO') OR canonical_name = 'geo.ASIA' AS hidden FROM nodes")
def _(g: Graph) -> DataFrame:
    return g.nodes.select("id", health.suppressed("canonical_name", ["crm.AUTO*", "geo.ASIA"]).alias("hidden"))


@on_graph("agg_01_count_per_kind", "SELECT kind, count(*) AS n FROM edges GROUP BY kind ORDER BY n DESC, kind LIMIT 5")
def _(g: Graph) -> DataFrame:
    return counts.count_by(g.edges, "kind", 5)


@on_graph("agg_03_member_counts", "SELECT b.id, b.name, count(m.node_id) AS member_count FROM boundaries b LEFT JOIN memberships m ON m.boundary_id = b.id GROUP BY b.id, b.name")
def _(g: Graph) -> DataFrame:
    return counts.member_counts(g)


@on_graph("agg_04_degree", "SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) x GROUP BY id")
def _(g: Graph) -> DataFrame:
    return counts.degree(g.edges)


SEPARATING = """narrow AS (SELECT * FROM boundaries WHERE NOT (matcher_type = 'path_prefix' AND trim(coalesce(matcher_value, ''), '/') = '')),
bs AS (SELECT node_id AS id, list_sort(list(DISTINCT boundary_id)) AS bs FROM memberships JOIN narrow ON narrow.id = boundary_id GROUP BY node_id)"""
DEGREES = SEPARATING + f""",
fe AS (SELECT * FROM edges WHERE kind IN ({IMPACT})),
ec AS (SELECT e.*, CASE WHEN a.bs IS NOT NULL AND b.bs IS NOT NULL AND NOT list_has_any(a.bs, b.bs) THEN 1 ELSE 0 END AS x FROM fe e LEFT JOIN bs a ON a.id = e.source_id LEFT JOIN bs b ON b.id = e.target_id),
degrees AS (SELECT id, CAST(sum(i) AS BIGINT) AS in_degree, CAST(sum(o) AS BIGINT) AS out_degree, CAST(sum(x) AS BIGINT) AS cross_degree, CAST(sum(h) AS BIGINT) AS inheritance_in FROM (
  SELECT source_id AS id, 0 AS i, 1 AS o, x, 0 AS h FROM ec UNION ALL SELECT target_id, 1, 0, x, CASE WHEN kind IN ('implements', 'extends') THEN 1 ELSE 0 END FROM ec) q GROUP BY id)"""


@on_graph("agg_05_in_out_cross_degree", f"WITH {DEGREES} SELECT * FROM degrees")
def _(g: Graph) -> DataFrame:
    return counts.degrees(g, g.following(S.IMPACT_KINDS))


@on_graph("agg_06_inheritance_in_degree", f"WITH {DEGREES} SELECT id, inheritance_in FROM degrees WHERE inheritance_in > 0")
def _(g: Graph) -> DataFrame:
    return counts.degrees(g, g.following(S.IMPACT_KINDS)).where("inheritance_in > 0").select("id", "inheritance_in")


COHESION = """every AS (SELECT node_id AS id, list(DISTINCT boundary_id) AS bs FROM memberships GROUP BY node_id),
pairs AS (SELECT coalesce(a.bs, CAST([] AS VARCHAR[])) AS a, coalesce(b.bs, CAST([] AS VARCHAR[])) AS b FROM edges LEFT JOIN every a ON a.id = source_id LEFT JOIN every b ON b.id = target_id),
each_ AS (SELECT a, b, unnest(list_distinct(list_concat(a, b))) AS boundary_id FROM pairs),
cohesion AS (SELECT boundary_id, count(*) AS incident, CAST(sum(CASE WHEN list_contains(a, boundary_id) AND list_contains(b, boundary_id) THEN 1 ELSE 0 END) AS BIGINT) AS internal FROM each_ GROUP BY boundary_id)"""


@on_graph("agg_07_boundary_cohesion", f"WITH {COHESION} SELECT * FROM cohesion")
def _(g: Graph) -> DataFrame:
    return counts.cohesion(g, g.edges)


@on_graph("agg_08_confidence_histogram", "SELECT c.confidence, count(e.id) AS n FROM (VALUES ('possible'), ('probable'), ('certain')) c(confidence) LEFT JOIN edges e ON e.confidence = c.confidence AND e.kind = 'constructs' GROUP BY c.confidence")
def _(g: Graph) -> DataFrame:
    return counts.confidence_histogram(g.edges.where("kind = 'constructs'"))


@query("agg_12_public_surface_change", "SELECT count(*) AS changed FROM snap_a a FULL JOIN snap_b b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL")
def _(s: SparkSession, d: str) -> DataFrame:
    return counts.public_surface_change(view(s, d, "snap_a"), view(s, d, "snap_b"))


R2 = "CASE {}.confidence WHEN 'certain' THEN 3 WHEN 'probable' THEN 2 ELSE 1 END"


@query("agg_13_confidence_changes", f"SELECT CAST(coalesce(sum(CASE WHEN {R2.format('b')} > {R2.format('a')} THEN 1 ELSE 0 END), 0) AS BIGINT) AS raised, CAST(coalesce(sum(CASE WHEN {R2.format('b')} < {R2.format('a')} THEN 1 ELSE 0 END), 0) AS BIGINT) AS lowered FROM snap_a a JOIN snap_b b ON a.id = b.id")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot.confidence_changes(view(s, d, "snap_a"), view(s, d, "snap_b"))


@on_graph("agg_15_language_mix", "WITH r AS (SELECT language, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, language) AS k FROM nodes GROUP BY language) SELECT string_agg(CASE WHEN k <= 2 THEN language || ' ' || n END, ', ' ORDER BY k) || CASE WHEN count(*) > 2 THEN ', +' || (count(*) - 2) || ' more' ELSE '' END AS mix FROM r")
def _(g: Graph) -> DataFrame:
    return counts.language_mix(g, 2)


@on_graph("top_07_neighbour_cap", f"""
WITH r AS (SELECT id, source_id, row_number() OVER (PARTITION BY target_id ORDER BY {RANK} DESC, kind, id) AS k FROM edges) SELECT id FROM r WHERE k <= 3""")
def _(g: Graph) -> DataFrame:
    order = Window.partitionBy("target_id").orderBy(S.confidence_rank().desc(), "kind", "id")
    return g.edges.withColumn("k", F.row_number().over(order)).where("k <= 3").select("id")


@on_graph("set_02_distinct_relations", "SELECT DISTINCT source_id, target_id, kind FROM edges")
def _(g: Graph) -> DataFrame:
    return g.edges.select("source_id", "target_id", "kind").distinct()


@query("set_03_keyed_difference", "SELECT id, 'removed' AS side FROM snap_a WHERE id NOT IN (SELECT id FROM snap_b) UNION ALL SELECT id, 'common' FROM snap_a WHERE id IN (SELECT id FROM snap_b)")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = view(s, d, "snap_a").select("id"), view(s, d, "snap_b").select("id")
    return a.join(b, "id", "left_anti").withColumn("side", F.lit("removed")).unionByName(a.join(b, "id", "left_semi").withColumn("side", F.lit("common")))


@on_graph("jon_14_induced_edges", """
WITH pool AS (SELECT id FROM (SELECT id, count(*) AS n FROM (SELECT source_id AS id FROM edges UNION ALL SELECT target_id FROM edges) x GROUP BY id) y ORDER BY n DESC, id LIMIT 100)
SELECT DISTINCT source_id, target_id, kind FROM edges WHERE source_id IN (SELECT id FROM pool) AND target_id IN (SELECT id FROM pool)""")
def _(g: Graph) -> DataFrame:
    pool = counts.degree(g.edges).orderBy(F.desc("degree"), "id").limit(100).select("id")
    inside = g.edges.join(F.broadcast(pool.select(F.col("id").alias("source_id"))), "source_id", "left_semi").join(F.broadcast(pool.select(F.col("id").alias("target_id"))), "target_id", "left_semi")
    return inside.select("source_id", "target_id", "kind").distinct()


@on_graph("jon_01_edges_with_ends", "SELECT e.id, e.kind, a.canonical_name AS source, b.canonical_name AS target, f.relative_path FROM edges e JOIN nodes a ON e.source_id = a.id JOIN nodes b ON e.target_id = b.id LEFT JOIN files f ON e.file_id = f.id WHERE e.kind <> 'contains'")
def _(g: Graph) -> DataFrame:
    edges = g.edges.where("kind <> 'contains'").select("id", "kind", "source_id", "target_id", "file_id")
    return lookup.with_paths(lookup.with_ends(edges, g.nodes), edges, g.files).select("id", "kind", "source", "target", "relative_path")


@on_graph("jon_06_boundaries_per_node", "SELECT node_id, string_agg(name, '|' ORDER BY name) AS names FROM memberships JOIN boundaries ON boundaries.id = boundary_id GROUP BY node_id")
def _(g: Graph) -> DataFrame:
    return g.memberships.join(g.boundaries.select(F.col("id").alias("boundary_id"), "name"), "boundary_id").groupBy("node_id").agg(F.array_join(F.array_sort(F.collect_list("name")), "|").alias("names"))


# --- traversal -----------------------------------------------------------------------------------------------------------

HOPS = f"hops AS (SELECT source_id, target_id, max({RANK}) AS rank FROM edges WHERE kind IN ({IMPACT}) GROUP BY source_id, target_id)"


def bfs(seeds: str, depth: int) -> str:
    """Levels as a chain of common table expressions: distance is the level, rank the best of least ranks."""
    out = [HOPS, f"l0 AS (SELECT id AS seed, id, 0 AS distance, 3 AS rank FROM ({seeds}) q)", "k0 AS (SELECT * FROM l0)"]
    for i in range(1, depth + 1):
        out.append(f"l{i} AS (SELECT l.seed, h.source_id AS id, {i} AS distance, max(least(l.rank, h.rank)) AS rank FROM l{i - 1} l JOIN hops h ON h.target_id = l.id WHERE NOT EXISTS (SELECT 1 FROM k{i - 1} k WHERE k.seed = l.seed AND k.id = h.source_id) GROUP BY l.seed, h.source_id)")
        out.append(f"k{i} AS (SELECT * FROM k{i - 1} UNION ALL SELECT * FROM l{i})")
    return ", ".join([*out, f"reached AS (SELECT * FROM k{depth} WHERE distance > 0)"])


@on_graph("imp_01_impact_analysis", f"""
WITH {bfs(f'SELECT {SYMBOL!r} AS id', 4)}, steps AS (SELECT r.id, r.distance, r.rank, k.id AS via, row_number() OVER (PARTITION BY r.id ORDER BY least(k.rank, h.rank) DESC, k.id) AS n FROM reached r JOIN hops h ON h.source_id = r.id JOIN k4 k ON k.id = h.target_id AND k.distance = r.distance - 1)
SELECT id, distance, rank, via FROM steps WHERE n = 1""")
def _(g: Graph) -> DataFrame:
    return traverse.impact(g, ids(g, SYMBOL)).select("id", "distance", "rank", "via")


@on_graph("imp_01_entry_points", f"WITH {bfs(f'SELECT {SYMBOL!r} AS id', 4)} SELECT r.id, r.distance, n.kind FROM reached r JOIN nodes n ON n.id = r.id WHERE n.kind IN ('route', 'command') OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role = 'application.controller')")
def _(g: Graph) -> DataFrame:
    return traverse.entry_points(g, traverse.impact(g, ids(g, SYMBOL)), ["application.controller"]).select("id", "distance", "kind")


@on_graph("agg_08_distance_histogram", f"WITH {bfs(f'SELECT {SYMBOL!r} AS id', 4)} SELECT distance, count(*) AS n FROM reached GROUP BY distance")
def _(g: Graph) -> DataFrame:
    return counts.histogram(traverse.impact(g, ids(g, SYMBOL)), "distance")


DIRECT = f"SELECT n.id FROM nodes n JOIN files f ON n.file_id = f.id WHERE f.relative_path IN ({quoted(PATHS)})"


@on_graph("jon_05_nodes_in_files", f"{DIRECT}")
def _(g: Graph) -> DataFrame:
    return change.direct_nodes(g, PATHS)


@on_graph("imp_02_changed_files_impact", f"""
WITH {bfs(DIRECT, 3)}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, seed) AS k FROM reached)
SELECT r.id, n.canonical_name, r.distance, r.seed FROM r JOIN nodes n ON n.id = r.id WHERE k = 1 ORDER BY distance, canonical_name, r.id LIMIT 100""")
def _(g: Graph) -> DataFrame:
    return change.changed_files_impact(g, PATHS, 3)


@on_graph("imp_03_test_impact", f"""
WITH {bfs(DIRECT, 3)}, a AS (SELECT id, distance FROM reached UNION ALL SELECT id, 0 FROM ({DIRECT}) q),
t AS (SELECT a.*, n.display_name, f.relative_path FROM a JOIN nodes n ON n.id = a.id JOIN files f ON f.id = n.file_id WHERE EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = a.id AND role = 'quality.test_module'))
SELECT relative_path, min(distance) AS distance, array_to_string(list_slice(list_sort(list(DISTINCT display_name)), 1, 3), '|') AS tests FROM t GROUP BY relative_path""")
def _(g: Graph) -> DataFrame:
    return change.test_impact(g, PATHS, 3)


CHURN_FILES = "concat(event_type, '/', CAST(user_id % 20 AS STRING))"


@query("imp_04_change_impact", f"""
WITH {bfs(f'SELECT {SYMBOL!r} AS id', 2)}, near AS (SELECT id, distance FROM reached UNION ALL SELECT '{SYMBOL}', 0),
newest AS (SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 500),
churn AS (SELECT f.relative_path, count(DISTINCT e.event_id) AS c, count(DISTINCT e.user_id) AS a FROM events e JOIN newest USING (event_id) JOIN files f ON f.id = concat('f:', CAST(e.event_id % 200 AS STRING)) GROUP BY f.relative_path)
SELECT near.id, n.canonical_name, distance, coalesce(c, 0) AS commit_count, CAST(coalesce(a, 0) AS INTEGER) AS authors, 3 * coalesce(c, 0) + coalesce(a, 0) + greatest(0, 3 - distance) AS score
FROM near JOIN nodes n ON n.id = near.id LEFT JOIN files f ON f.id = n.file_id LEFT JOIN churn ON churn.relative_path = f.relative_path""")
def _(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d)
    e = s.read.parquet(f"{d}/events.parquet").select("event_id", "user_id", "ts", F.concat(F.lit("f:"), (F.col("event_id") % 200).cast("string")).alias("file_id"))
    commits = e.join(g.files.select(F.col("id").alias("file_id"), "relative_path"), "file_id", "left").select(F.col("event_id").alias("commit_id"), F.coalesce("relative_path", F.lit("-")).alias("path"), F.col("user_id").cast("string").alias("author"), "ts")
    return change.change_impact(g, ids(g, SYMBOL), commits, 2)


@on_graph("flw_01_explain_flow", f"""
WITH fe AS (SELECT source_id, target_id, max({RANK} * 10 + CASE WHEN kind IN ({quoted(S.SEMANTIC_KINDS)}) THEN 1 ELSE 0 END) AS best FROM edges WHERE kind IN ({FLOW}) GROUP BY source_id, target_id),
walk AS (SELECT ['n:0'] AS path, 'n:0' AS tip, 3 AS rank, 0 AS semantic, 0 AS hops, false AS done
  UNION ALL SELECT list_append(path, target_id), target_id, least(rank, best // 10), semantic + best % 10, hops + 1, target_id = 'n:6' FROM walk JOIN fe ON source_id = tip WHERE hops < 5 AND NOT done AND (target_id = 'n:6' OR NOT list_contains(path, target_id)))
SELECT array_to_string(path, '>') AS signature, hops, rank, CAST(semantic AS INTEGER) AS semantic FROM walk WHERE done ORDER BY rank DESC, hops, semantic DESC, signature LIMIT 5""")
def _(g: Graph) -> DataFrame:
    return traverse.paths(g, ids(g, "n:0"), ids(g, "n:6"), 5)


@on_graph("ded_02_closure", """
WITH up AS (SELECT DISTINCT source_id AS child, target_id AS parent FROM edges WHERE kind IN ('implements', 'extends') AND source_id <> target_id),
walk AS (SELECT child, parent AS ancestor, 1 AS depth FROM up UNION SELECT w.child, up.parent, w.depth + 1 FROM walk w JOIN up ON up.child = w.ancestor WHERE w.depth < 20)
SELECT child, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM walk WHERE child <> ancestor GROUP BY child, ancestor""")
def _(g: Graph) -> DataFrame:
    return traverse.closure(g.edges.where(F.col("kind").isin(S.INHERITANCE_KINDS)).select(F.col("source_id").alias("child"), F.col("target_id").alias("parent")))


# --- cycles, health, policy ------------------------------------------------------------------------------------------------


def _co(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "co")


def reach(edges: str, p: str = "") -> str:
    """Components of more than one node as ``mutual`` (id, component), by what reaches each other."""
    return f"""{p}r AS (SELECT source_id AS a, target_id AS b FROM {edges} UNION SELECT r.a, e.target_id FROM {p}r r JOIN {edges} e ON e.source_id = r.b),
{p}mutual AS (SELECT x.a AS id, least(x.a, min(x.b)) AS component FROM {p}r x JOIN {p}r y ON x.a = y.b AND x.b = y.a WHERE x.a <> x.b GROUP BY x.a)"""



@query("cyc_01_components", f"WITH {reach('co')} SELECT id, component FROM mutual")
def _(s: SparkSession, d: str) -> DataFrame:
    return scc.components(_co(s, d))


@query("cyc_01_components_coloured", f"WITH {reach('trade')} SELECT id, component FROM mutual")
def _(s: SparkSession, d: str) -> DataFrame:
    return scc.coloured_components(view(s, d, "trade"))


@on_graph("cyc_01_dependency_cycles", f"""
WITH ie AS (SELECT *, {RANK} AS rank FROM edges WHERE kind = 'imports'), {reach('ie')}
SELECT m.component, CAST(count(DISTINCT m.id) AS BIGINT) AS size, CASE min(rank) WHEN 3 THEN 'certain' WHEN 2 THEN 'probable' ELSE 'possible' END AS min_confidence, count(DISTINCT e.id) AS internal_edges
FROM mutual m JOIN ie e ON e.source_id = m.id JOIN mutual t ON t.id = e.target_id AND t.component = m.component GROUP BY m.component""")
def _(g: Graph) -> DataFrame:
    return scc.dependency_cycles(g, ["imports"])


@on_graph("cyc_01_all_kinds", f"""
WITH ie AS (SELECT *, {RANK} AS rank FROM edges WHERE kind IN ({IMPACT})), core AS (SELECT source_id, target_id FROM ie WHERE starts_with(source_id, 'n:') OR starts_with(source_id, 'p:') AND starts_with(target_id, 'p:')), {reach('core')},
inner_ AS (SELECT m.component, e.rank, row_number() OVER (PARTITION BY m.component ORDER BY e.source_id, e.target_id, e.kind, e.id) AS k FROM mutual m JOIN ie e ON e.source_id = m.id JOIN mutual t ON t.id = e.target_id AND t.component = m.component)
SELECT s.component, s.size, CASE min(rank) WHEN 3 THEN 'certain' WHEN 2 THEN 'probable' ELSE 'possible' END AS min_confidence, count(*) AS internal_edges FROM inner_ JOIN (SELECT component, CAST(count(*) AS BIGINT) AS size FROM mutual GROUP BY component) s USING (component) WHERE k <= 200 GROUP BY ALL ORDER BY size DESC, component LIMIT 20""")
def _(g: Graph) -> DataFrame:
    return scc.dependency_cycles(g)


TESTS = "EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role = 'quality.test_module')"
N_EXTERNAL = EXTERNAL.replace("kind", "n.kind").replace("origin", "n.origin")


@on_graph("hlt_01_hubs", f"""
WITH {DEGREES} SELECT n.id, n.canonical_name, in_degree, out_degree, cross_degree, in_degree + out_degree AS score FROM nodes n JOIN degrees d ON d.id = n.id WHERE NOT {N_EXTERNAL} AND NOT {TESTS} AND in_degree + out_degree > 0 ORDER BY score DESC, canonical_name, n.id LIMIT 20""")
def _(g: Graph) -> DataFrame:
    return health.hubs(g)


@on_graph("hlt_01_left_out", f"WITH {DEGREES} SELECT CAST(sum(CASE WHEN {N_EXTERNAL} THEN 1 ELSE 0 END) AS BIGINT) AS external, CAST(sum(CASE WHEN NOT {N_EXTERNAL} AND {TESTS} THEN 1 ELSE 0 END) AS BIGINT) AS tests FROM nodes n JOIN degrees d ON d.id = n.id WHERE in_degree + out_degree > 0")
def _(g: Graph) -> DataFrame:
    return health.excluded_before_ranking(g)


@on_graph("hlt_02_hotspots", f"""
WITH {DEGREES}, core AS (SELECT source_id, target_id FROM fe WHERE starts_with(source_id, 'n:') OR starts_with(source_id, 'p:') AND starts_with(target_id, 'p:')), {reach('core')}
SELECT n.id, n.canonical_name, cross_degree, m.id IS NOT NULL AS in_cycle, in_degree + out_degree + 2 * cross_degree + CASE WHEN m.id IS NOT NULL THEN 3 ELSE 0 END AS score
FROM nodes n JOIN degrees d ON d.id = n.id LEFT JOIN mutual m ON m.id = n.id WHERE NOT {N_EXTERNAL} AND NOT {TESTS} ORDER BY score DESC, canonical_name, n.id LIMIT 20""")
def _(g: Graph) -> DataFrame:
    return health.hotspots(g)


CONVENTION = quoted(health.CONVENTION_ROLES)


@on_graph("ded_01_dead_code", f"""
WITH own AS (SELECT target_id AS member, max_by(source_id, id) AS owner FROM edges WHERE kind = 'contains' OR kind = 'constructs' GROUP BY target_id),
kids AS (SELECT DISTINCT e.source_id AS owner, n.display_name FROM edges e JOIN nodes n ON n.id = e.target_id WHERE e.kind = 'contains' OR e.kind = 'constructs'),
marks AS (SELECT DISTINCT canonical_name FROM annotations WHERE kind = 'false_positive'),
up AS (SELECT DISTINCT source_id AS child, target_id AS parent FROM edges WHERE kind IN ('implements', 'extends', 'returns') AND source_id <> target_id),
walk AS (SELECT child, parent AS ancestor FROM up UNION SELECT w.child, up.parent FROM walk w JOIN up ON up.child = w.ancestor),
quiet AS (SELECT id, CAST(count(*) AS BIGINT) AS in_degree, CAST(sum(CASE WHEN kind IN ('implements', 'extends') THEN 1 ELSE 0 END) AS BIGINT) AS inheritance_in FROM (SELECT target_id AS id, kind FROM edges WHERE kind IN ({IMPACT}) AND kind <> 'constructs') q GROUP BY id),
base AS (SELECT n.* FROM nodes n LEFT JOIN quiet d ON d.id = n.id WHERE coalesce(d.in_degree, 0) = 0 AND n.kind IN ({quoted(S.CANDIDATE_KINDS)}) AND NOT {N_EXTERNAL} AND NOT EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND role IN ({CONVENTION}))),
mem AS (SELECT b.id, b.display_name, o.owner FROM base b JOIN own o ON o.member = b.id WHERE b.kind = 'method'),
inh AS (SELECT m.id, bool_or(k.owner IS NOT NULL AND NOT {N_EXTERNAL}) AS inherited, min(CASE WHEN n.id IS NULL OR {N_EXTERNAL} THEN w.ancestor END) AS ext FROM mem m JOIN walk w ON w.child = m.owner LEFT JOIN nodes n ON n.id = w.ancestor LEFT JOIN kids k ON k.owner = w.ancestor AND k.display_name = m.display_name GROUP BY m.id),
sub AS (SELECT DISTINCT e.target_id AS owner, k.display_name FROM edges e JOIN kids k ON k.owner = e.source_id WHERE e.kind IN ('implements', 'extends')),
all_ AS (SELECT b.*, i.inherited, i.ext, coalesce(q.in_degree, 0) AS owner_in, coalesce(q.inheritance_in, 0) AS owner_inh, m.owner, EXISTS (SELECT 1 FROM nodes t JOIN quiet q2 ON q2.id = t.id WHERE b.kind = 'method' AND t.canonical_name || '::' || b.display_name = b.canonical_name) AS typed FROM base b LEFT JOIN mem m ON m.id = b.id LEFT JOIN quiet q ON q.id = m.owner LEFT JOIN inh i ON i.id = b.id)
SELECT b.id, b.canonical_name, CASE WHEN starts_with(b.canonical_name, 'crm.AUTO') THEN 'suppressed' WHEN b.canonical_name IN (SELECT canonical_name FROM marks) THEN 'annotated' WHEN inherited THEN 'inherited'
  WHEN EXISTS (SELECT 1 FROM sub WHERE sub.owner = b.owner AND sub.display_name = b.display_name) AND owner_in > owner_inh THEN 'contract' WHEN (display_name = 'constructor' OR starts_with(display_name, '__')) AND typed THEN 'engine_invoked'
  WHEN b.kind = 'module' AND json_extract_string(attributes_json, '$.executable') = 'true' THEN 'executable_script' END AS reason,
  CASE WHEN origin <> 'ast' OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = b.id AND (starts_with(role, 'laravel.') OR starts_with(c.origin, 'framework_'))) OR ext IS NOT NULL THEN 'possible' ELSE 'probable' END AS confidence FROM all_ b""")
def _(g: Graph) -> DataFrame:
    # Orders are what customers contain here, so that methods have owners and no caller.
    inside = g.edges.where("kind = 'constructs'").withColumn("kind", F.lit("contains"))
    return health.dead_code(g.with_edges(g.edges.where("kind <> 'constructs'").unionByName(inside)), suppress=["crm.AUTO*"])


@on_graph("ded_03_subtype_members", """
WITH own AS (SELECT target_id AS member, max_by(source_id, id) AS owner FROM edges WHERE kind = 'contains' GROUP BY target_id)
SELECT DISTINCT e.target_id AS id, n.display_name FROM edges e JOIN own o ON o.owner = e.source_id JOIN nodes n ON n.id = o.member WHERE e.kind IN ('implements', 'extends', 'contains')""")
def _(g: Graph) -> DataFrame:
    # The tables' types have no members of their own, so containment stands for inheritance here.
    wide = g.with_edges(g.edges.unionByName(g.edges.where("kind = 'contains'").withColumn("kind", F.lit("extends")).withColumn("id", F.concat(F.lit("x"), "id"))))
    return health.subtype_member_names(wide)


VIOLATIONS = """m AS (SELECT node_id, list(DISTINCT boundary_id) AS bs FROM memberships GROUP BY node_id),
e AS (SELECT e.*, coalesce(a.bs, ['@unassigned']) AS sb, coalesce(b.bs, ['@unassigned']) AS tb FROM edges e LEFT JOIN m a ON a.node_id = source_id LEFT JOIN m b ON b.node_id = target_id),
p AS (SELECT * FROM (VALUES ('asia', 'b:2', CAST(['b:2', 'b:3'] AS VARCHAR[]), CAST([] AS VARCHAR[]), ['imports']), ('europe', 'b:3', CAST([] AS VARCHAR[]), ['b:0', 'b:1'], ['imports', 'calls']), ('loose', '@unassigned', CAST([] AS VARCHAR[]), ['b:Brand#11'], ['calls', 'references', 'depends_on'])) v(policy_id, src, allow, deny, kinds)),
v AS (SELECT p.policy_id, e.id AS edge_id, e.kind, source_id, target_id, list_has_any(tb, deny) AS d, len(allow) > 0 AND NOT list_contains(tb, src) AND NOT list_has_any(tb, allow) AS o FROM e JOIN p ON list_contains(sb, src) AND list_contains(kinds, e.kind))"""


@on_graph("pol_01_check_architecture", f"""
WITH {VIOLATIONS}
SELECT policy_id, edge_id, kind, source_id, target_id, concat_ws(',', CASE WHEN d THEN 'denied_target' END, CASE WHEN o THEN 'target_not_allowed' END) AS reasons FROM v WHERE d OR o""")
def _(g: Graph) -> DataFrame:
    return policy.violations(g, POLICIES)


POLICIES = [policy.Policy("asia", "b:2", ("b:2", "b:3"), (), ("imports",)), policy.Policy("europe", "b:3", (), ("b:0", "b:1"), ("imports", "calls")), policy.Policy("loose", "@unassigned", (), ("b:Brand#11",), ("calls", "references", "depends_on"))]


# --- snapshots -------------------------------------------------------------------------------------------------------------

DIFF = """sides AS (SELECT coalesce(a.id, b.id) AS key, a.id IS NOT NULL AS ha, b.id IS NOT NULL AS hb, a.file_id IS DISTINCT FROM b.file_id AS f, (a.kind, a.display_name, a.confidence) IS DISTINCT FROM (b.kind, b.display_name, b.confidence) AS c FROM snap_a a FULL JOIN snap_b b ON a.id = b.id),
d AS (SELECT key, 'added' AS operation FROM sides WHERE NOT ha UNION ALL SELECT key, 'removed' FROM sides WHERE NOT hb UNION ALL SELECT key, 'changed' FROM sides WHERE ha AND hb AND c UNION ALL SELECT key, 'moved' FROM sides WHERE ha AND hb AND f)"""


def _snaps(s: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    return view(s, d, "snap_a"), view(s, d, "snap_b")


@query("snp_01_snapshot_diff", f"WITH {DIFF} SELECT key, operation FROM d")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot.diff(*_snaps(s, d))


@query("snp_01_diff_counts", f"WITH {DIFF} SELECT operation, count(*) AS n FROM d GROUP BY operation")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot.diff_counts(*_snaps(s, d))


@query("snp_01_change_budget", f"WITH {DIFF} SELECT 'nodes' AS section, operation, key FROM d ORDER BY operation, key LIMIT 25")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = _snaps(s, d)
    return snapshot.snapshot_diff({"nodes": a}, {"nodes": b})


@query("snp_02_rename_candidates", """
WITH old AS (SELECT concat('c:', CAST(c_custkey AS STRING)) AS id, c_mktsegment AS kind, concat('x', CAST(c_custkey % 400 AS STRING)) AS display_name FROM customer WHERE c_custkey % 3 <> 0),
fresh AS (SELECT concat('c:', CAST(c_custkey AS STRING)) AS id, c_mktsegment AS kind, concat('x', CAST(c_custkey % 400 AS STRING)) AS display_name FROM customer WHERE c_custkey % 3 <> 1),
new AS (SELECT kind, display_name, count(*) AS n, min(id) AS added FROM fresh WHERE id NOT IN (SELECT id FROM old) GROUP BY kind, display_name)
SELECT o.id AS removed, new.added FROM old o JOIN new USING (kind, display_name) WHERE n = 1 AND o.id NOT IN (SELECT id FROM fresh)""")
def _(s: SparkSession, d: str) -> DataFrame:
    c = s.read.parquet(f"{d}/customer.parquet")
    rows = c.select(F.concat(F.lit("c:"), F.col("c_custkey").cast("string")).alias("id"), F.col("c_mktsegment").alias("kind"), F.concat(F.lit("x"), (F.col("c_custkey") % 400).cast("string")).alias("display_name"), (F.col("c_custkey") % 3).alias("third"))
    return snapshot.rename_candidates(rows.where("third <> 0").drop("third"), rows.where("third <> 1").drop("third"))


def gate_metrics(prefix: str, nodes: str, edges: str) -> str:
    """The metrics of one snapshot in SQL, as common table expressions that end in ``<prefix>metrics``.  Only nations and parts have cycles among them."""
    p = prefix
    return f"""{p}n AS ({nodes}), {p}e AS (SELECT * FROM ({edges}) q WHERE kind IN ({IMPACT}) AND source_id IN (SELECT id FROM {p}n) AND target_id IN (SELECT id FROM {p}n)),
{p}cyc AS (SELECT source_id, target_id FROM {p}e WHERE starts_with(source_id, 'n:') OR starts_with(source_id, 'p:') AND starts_with(target_id, 'p:')), {reach(f'{p}cyc', p)},
{p}deg AS (SELECT id, count(*) AS degree, sum(i) AS i FROM (SELECT source_id AS id, 0 AS i FROM {p}e UNION ALL SELECT target_id, 1 FROM {p}e) q GROUP BY id),
{p}plain AS (SELECT n.*, coalesce(i, 0) AS i, coalesce(degree, 0) AS degree FROM {p}n n LEFT JOIN {p}deg d ON d.id = n.id WHERE NOT {N_EXTERNAL} AND NOT {TESTS}),
{p}metrics AS (SELECT (SELECT count(DISTINCT component) FROM {p}mutual) AS cycles, max(degree) AS max_degree,
  CAST(sum(CASE WHEN i = 0 AND kind IN ({quoted(S.CANDIDATE_KINDS)}) AND NOT (kind = 'method' AND display_name IN ('constructor', '__construct')) AND NOT (kind = 'module' AND coalesce(json_extract_string(attributes_json, '$.executable'), '') = 'true')
    AND NOT EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = x.id AND role IN ({CONVENTION})) THEN 1 ELSE 0 END) AS BIGINT) AS unreferenced_candidates,
  (SELECT count(*) FROM diagnostics WHERE severity = 'error') AS error_diagnostics, (SELECT count(*) FROM diagnostics WHERE severity = 'warning') AS warning_diagnostics FROM {p}plain x)"""


@on_graph("snp_04_quality_metrics", f"WITH {gate_metrics('a', 'SELECT * FROM nodes', 'SELECT * FROM edges')} SELECT * FROM ametrics")
def _(g: Graph) -> DataFrame:
    return snapshot.quality_metrics(g)


METRICS = "m AS (SELECT concat('s', CAST(user_id AS STRING)) AS scan_id, user_id AS sequence, count(*) AS cycles, CAST(sum(event_id % 7) AS BIGINT) AS max_degree FROM events GROUP BY user_id)"


def _metrics(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return e.groupBy(F.concat(F.lit("s"), F.col("user_id").cast("string")).alias("scan_id"), F.col("user_id").alias("sequence")).agg(F.count(F.lit(1)).alias("cycles"), F.sum(F.col("event_id") % 7).alias("max_degree"))


@query("snp_06_architecture_trends", f"""
WITH {METRICS}, n AS (SELECT * FROM m ORDER BY sequence DESC LIMIT 10)
SELECT scan_id, sequence, cycles, max_degree, coalesce(cycles - lag(cycles) OVER (ORDER BY sequence), 0) AS cycles_change, coalesce(max_degree - lag(max_degree) OVER (ORDER BY sequence), 0) AS max_degree_change FROM n""")
def _(s: SparkSession, d: str) -> DataFrame:
    return snapshot.trends(_metrics(s, d)).na.fill(0, ["cycles_change", "max_degree_change"])


OLD_NODES = "SELECT * FROM nodes WHERE NOT (kind = 'route' AND length(id) % 2 = 0)"
OLD_EDGES = "SELECT * FROM edges WHERE confidence = 'certain' AND NOT (kind = 'imports' AND ends_with(source_id, '1'))"
LIMITS = {"new_cycles": 0, "boundary_violations": 2000, "error_diagnostics": 3400, "warning_diagnostics": 3000, "hub_degree_growth": 10, "unreferenced_candidates": 100, "public_surface_changes": 1}


def _baseline(g: Graph) -> Graph:
    """An older state of the graph: some routes, uncertain edges and imports less."""
    old = g.nodes.where("NOT (kind = 'route' AND length(id) % 2 = 0)")
    return g.with_tables(nodes=old, edges=g.edges.where("confidence = 'certain' AND NOT (kind = 'imports' AND endswith(source_id, '1'))"), classifications=g.classifications.where("role <> 'application.public_api'"))


@on_graph("snp_05_quality_gate", f"""
WITH {gate_metrics('a', OLD_NODES.replace('ends_with', 'suffix'), OLD_EDGES.replace('ends_with', 'suffix'))}, {gate_metrics('b', 'SELECT * FROM nodes', 'SELECT * FROM edges')}, {{POLICY}},
surface_a AS (SELECT id FROM an WHERE kind IN ('route', 'command', 'endpoint', 'export')), surface_b AS (SELECT id FROM nodes WHERE kind IN ('route', 'command', 'endpoint', 'export') UNION SELECT node_id FROM classifications WHERE role LIKE '%public%' OR role LIKE '%entry_point%'),
actual AS (SELECT 'new_cycles' AS name, greatest(0, b.cycles - a.cycles) AS actual FROM ametrics a, bmetrics b UNION ALL SELECT 'hub_degree_growth', greatest(0, b.max_degree - a.max_degree) FROM ametrics a, bmetrics b
  UNION ALL SELECT 'error_diagnostics', error_diagnostics FROM bmetrics UNION ALL SELECT 'warning_diagnostics', warning_diagnostics FROM bmetrics UNION ALL SELECT 'unreferenced_candidates', unreferenced_candidates FROM bmetrics
  UNION ALL SELECT 'public_surface_changes', count(*) FROM surface_a FULL JOIN surface_b ON surface_a.id = surface_b.id WHERE surface_a.id IS NULL OR surface_b.id IS NULL UNION ALL SELECT 'boundary_violations', count(*) FROM v WHERE d OR o)
SELECT name, CAST(actual AS BIGINT) AS actual, budget, actual <= budget AS passed FROM actual JOIN (VALUES {', '.join(f"('{k}', CAST({v} AS BIGINT))" for k, v in LIMITS.items())}) l(name, budget) USING (name)""".replace("{POLICY}", VIOLATIONS))
def _(g: Graph) -> DataFrame:
    return snapshot.quality_gate(_baseline(g), g, LIMITS, POLICIES)


@on_graph("rev_01_review_diff", f"""
WITH {bfs(DIRECT, 2)}, direct AS ({DIRECT}), one AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY distance, seed) AS k FROM reached),
impact AS (SELECT one.id, distance FROM one JOIN nodes n ON n.id = one.id WHERE k = 1 ORDER BY distance, canonical_name, one.id LIMIT 100),
{VIOLATIONS}, {gate_metrics('a', OLD_NODES.replace('ends_with', 'suffix'), OLD_EDGES.replace('ends_with', 'suffix'))}, {gate_metrics('b', 'SELECT * FROM nodes', 'SELECT * FROM edges')},
checks AS (SELECT 'new_cycles' AS name, CAST(greatest(0, b.cycles - a.cycles) AS BIGINT) AS actual FROM ametrics a, bmetrics b UNION ALL SELECT 'hub_degree_growth', greatest(0, b.max_degree - a.max_degree) FROM ametrics a, bmetrics b UNION ALL SELECT 'boundary_violations', count(*) FROM v WHERE d OR o)
SELECT 'impact' AS section, id AS key, CAST(distance AS STRING) AS detail FROM impact
UNION ALL SELECT DISTINCT 'policy', edge_id, policy_id || ':' || concat_ws(',', CASE WHEN d THEN 'denied_target' END, CASE WHEN o THEN 'target_not_allowed' END) FROM v WHERE (d OR o) AND (source_id IN (SELECT id FROM direct) OR target_id IN (SELECT id FROM direct))
UNION ALL SELECT 'cycle', id, component FROM bmutual WHERE id IN (SELECT id FROM direct)
UNION ALL SELECT 'gate', name, CASE WHEN actual <= 0 THEN 'passed' ELSE 'failed' END || ':' || CAST(actual AS STRING) || ':0' FROM checks""")
def _(g: Graph) -> DataFrame:
    return change.review(g, PATHS, POLICIES, 2, _baseline(g))


# --- placement, rendering ---------------------------------------------------------------------------------------------------


@query("loc_01_tokens", rf"""
WITH w AS (SELECT item_id, list_distinct(string_split_regex(lower(text), '[^\p{{L}}\p{{N}}]+')) AS every FROM benchmark),
l AS (SELECT item_id, every, list_filter(every, lambda w: length(w) >= 3 AND w NOT IN ({quoted(T.STOP_WORDS)})) AS long FROM w)
SELECT item_id, unnest(CASE WHEN len(long) > 0 THEN long ELSE list_filter(every, lambda w: length(w) >= 2) END) AS token FROM l""")
def _(s: SparkSession, d: str) -> DataFrame:
    return s.read.parquet(f"{d}/benchmark.parquet").select("item_id", F.explode(T.tokens(F.col("text"))).alias("token"))


def identifier_words(text: str) -> str:
    return rf"string_split_regex(lower(regexp_replace(regexp_replace({text}, '([\p{{Ll}}\p{{N}}])(\p{{Lu}})', '\1 \2', 'g'), '(\p{{Lu}})(\p{{Lu}}\p{{Ll}})', '\1 \2', 'g')), '[^\p{{L}}\p{{N}}]+')"


def matches(text: str) -> str:
    return f"len(list_filter({identifier_words(text)}, lambda w: starts_with(w, t))) > 0"


@on_graph("loc_01_suggest_location", f"""
WITH tok AS (SELECT unnest(['controller', 'service', 'brand', 'asia', 'geo', 'module', 'india']) AS t), {COHESION},
by_name AS (SELECT b.id AS boundary_id, t FROM boundaries b, tok WHERE {matches('b.name')}),
node_hits AS (SELECT n.id, t FROM nodes n, tok WHERE n.id IN (SELECT node_id FROM memberships) AND {matches("n.canonical_name || ' ' || n.display_name")}), by_member AS (SELECT boundary_id, id, t FROM node_hits JOIN memberships ON node_id = id),
role_hits AS (SELECT DISTINCT node_id AS id, t FROM classifications, tok WHERE {matches('role')}), by_role AS (SELECT boundary_id, id, t FROM role_hits JOIN memberships ON node_id = id),
every_ AS (SELECT boundary_id, count(DISTINCT t) AS matched FROM (SELECT boundary_id, t FROM by_name UNION ALL SELECT boundary_id, t FROM by_member UNION ALL SELECT boundary_id, t FROM by_role) q GROUP BY boundary_id),
size_ AS (SELECT b.id, greatest(1, count(m.node_id)) AS n FROM boundaries b LEFT JOIN memberships m ON m.boundary_id = b.id GROUP BY b.id)
SELECT b.id, b.name, b.source, round(12.0 * (SELECT count(*) FROM by_name x WHERE x.boundary_id = b.id) + round(10 * (4.0 * (SELECT count(*) FROM by_member x WHERE x.boundary_id = b.id) / n), 3) + round(10 * (2.0 * (SELECT count(*) FROM by_role x WHERE x.boundary_id = b.id) / n), 3)
  + round(10 * coalesce(CAST(internal AS DOUBLE) / incident, 0.0), 3), 3) AS score, CASE WHEN matched >= 2 THEN 'probable' ELSE 'possible' END AS confidence
FROM boundaries b JOIN size_ USING (id) JOIN every_ v ON v.boundary_id = b.id LEFT JOIN cohesion c ON c.boundary_id = b.id ORDER BY score DESC, b.source, b.name, b.id LIMIT 5""")
def _(g: Graph) -> DataFrame:
    return location.suggest(g, "A controller service for brand 12 in Asia, geo module INDIA")


@query("loc_02_semantic_rank", """
SELECT vec_id AS id, round(20 * CASE WHEN list_inner_product(e, e) > 0 THEN (1 + list_inner_product(e, v) / (sqrt(list_inner_product(e, e)) * sqrt(list_inner_product(v, v)))) / 2 ELSE 0.5 END, 2) AS score
FROM (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e, list_transform(range(len(embedding)), lambda i: CAST(i % 5 AS DOUBLE) - 2.0) AS v FROM embeddings) q""")
def _(s: SparkSession, d: str) -> DataFrame:
    rows = s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    return location.cosine(rows, [i % 5 - 2.0 for i in range(64)]).select("id", F.round(20 * F.col("similarity"), 2).alias("score"))


@on_graph("dia_01_diagram_pool", """
WITH d AS (SELECT id, count(*) AS degree FROM (SELECT source_id AS id FROM edges WHERE kind = 'imports' UNION ALL SELECT target_id FROM edges WHERE kind = 'imports') x GROUP BY id)
SELECT n.id, canonical_name, display_name, kind, coalesce(degree, 0) AS degree FROM nodes n LEFT JOIN d ON d.id = n.id ORDER BY coalesce(degree, 0) DESC, canonical_name, n.id LIMIT 80""")
def _(g: Graph) -> DataFrame:
    return render.diagram_pool(g, g.following(["imports"]), 10)


@on_graph("dia_01_export_diagram")
def _(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(render.export_diagram(g, ["imports"], max_nodes=10),)], "diagram string")


@on_graph("brf_01_entry_points", f"""
SELECT n.id, n.kind, n.canonical_name FROM nodes n WHERE NOT {N_EXTERNAL} AND NOT {TESTS} AND (n.kind IN ('route', 'command') OR EXISTS (SELECT 1 FROM classifications c WHERE c.node_id = n.id AND (role LIKE '%controller%' OR role LIKE '%command%' OR role LIKE '%route%'))) ORDER BY canonical_name, n.id LIMIT 12""")
def _(g: Graph) -> DataFrame:
    return render.entry_points(g)


@on_graph("brf_01_agent_brief")
def _(g: Graph) -> DataFrame:
    return g.spark.createDataFrame([(render.export_brief(g),)], "brief string")


# --- reconciliation, classification, boundaries -----------------------------------------------------------------------------

LINKS = r"links AS (SELECT page_id, unnest(regexp_extract_all(html, 'href=\"([^\"]+)\"', 1)) AS href FROM pages)"


@query("rec_06_external_nodes", f"""
WITH {LINKS} SELECT DISTINCT href AS canonical_name, list_last(string_split_regex(href, '\\\\|::|\\.|#|/')) AS display_name FROM links l WHERE NOT EXISTS (SELECT 1 FROM pages p WHERE p.url = l.href)""")
def _(s: SparkSession, d: str) -> DataFrame:
    pages = s.read.parquet(f"{d}/pages.parquet")
    links = pages.select(F.explode(F.regexp_extract_all("html", F.lit('href="([^"]+)"'), F.lit(1))).alias("canonical_name"))
    return reconcile.missing(links, "canonical_name", pages, "url").distinct().select("canonical_name", T.tail(F.col("canonical_name")).alias("display_name"))


@query("rec_01_first_declaration", """
WITH r AS (SELECT p_name, p_partkey, p_brand, row_number() OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS k, first_value(p_brand) OVER (PARTITION BY p_name ORDER BY p_brand, p_partkey) AS f FROM part)
SELECT p_name AS name, min(p_brand) AS file, bool_or(k > 1 AND p_brand <> f) AS again FROM r GROUP BY p_name""")
def _(s: SparkSession, d: str) -> DataFrame:
    p = s.read.parquet(f"{d}/part.parquet")
    facts = p.select(F.lit("php").alias("language"), F.col("p_brand").alias("file"), F.col("p_partkey").alias("place"), F.lit("x").alias("local_id"), F.lit("class").alias("kind"), F.col("p_name").alias("canonical_name"), F.col("p_name").alias("display_name"))
    first, warnings = reconcile.collect_nodes(facts, "test")
    told = warnings.select(F.col("message").alias("name"), F.lit(True).alias("w"))
    return first.select(F.col("canonical_name").alias("name"), "file").join(told, "name", "left").select("name", "file", F.coalesce("w", F.lit(False)).alias("again"))


@query("rec_07_collapse_edges", """
SELECT l_returnflag AS kind, CAST(l_orderkey AS STRING) AS source_id, CAST(l_partkey AS STRING) AS target_id, CAST(l_suppkey AS STRING) AS file, l_linenumber AS start_line, max(l_quantity) AS place FROM lineitem GROUP BY ALL""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_returnflag").alias("kind"), F.col("l_orderkey").cast("string").alias("source_id"), F.col("l_partkey").cast("string").alias("target_id"), F.col("l_suppkey").cast("string").alias("file"), F.col("l_linenumber").alias("start_line"), F.col("l_quantity").alias("place"))
    return reconcile.collapse_edges(e, "test").drop("id")


@query("rec_08_referential_checks", "SELECT o_orderkey AS key FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def _(s: SparkSession, d: str) -> DataFrame:
    orders, lines = s.read.parquet(f"{d}/orders.parquet"), s.read.parquet(f"{d}/lineitem.parquet")
    return reconcile.missing(orders.select(F.col("o_orderkey").alias("key")), "key", lines, "l_orderkey")


@query("rec_11_cache_partition", """
SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN 'added' WHEN doc_id % 3 = 0 THEN 'changed' ELSE 'hit' END AS state FROM documents""")
def _(s: SparkSession, d: str) -> DataFrame:
    docs = s.read.parquet(f"{d}/documents.parquet").select("doc_id", F.col("doc_id").cast("string").alias("relative_path"), F.md5("text").alias("content_hash"))
    cache = docs.where("doc_id % 5 <> 0").select("relative_path", F.when(F.col("doc_id") % 3 == 0, "old").otherwise(F.col("content_hash")).alias("content_hash"), F.lit("1").alias("scanner_version"), F.lit("c").alias("configuration_hash"))
    return incremental.partition_cache(docs, cache, "1", "c").select("doc_id", "state")


@query("rec_12_contribution_audit", """
SELECT CASE WHEN CAST(p AS STRING) IS NULL THEN CAST(e AS STRING) ELSE CAST(p AS STRING) END AS owner_key, CASE WHEN n IS NULL THEN 'omitted' WHEN p IS NULL THEN 'misattributed' ELSE 'duplicated' END AS problem
FROM (SELECT page_id AS p FROM pages) a FULL JOIN (SELECT user_id AS e, count(*) AS n FROM events GROUP BY user_id) b ON p = e WHERE n IS NULL OR p IS NULL OR n > 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    asked = s.read.parquet(f"{d}/pages.parquet").select(F.col("page_id").cast("string").alias("relative_path"))
    got = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").cast("string").alias("owner_key"))
    return incremental.audit(asked, got)


@on_graph("cls_01_name_suffix", "SELECT id AS node_id, 'a' AS role FROM nodes WHERE kind = 'class' AND suffix(display_name, '7') UNION ALL SELECT id, 'b' FROM nodes WHERE kind = 'class' AND suffix(display_name, '17')")
def _(g: Graph) -> DataFrame:
    return classify.by_suffix(g.nodes, {"7": "a", "17": "b"}).select("node_id", "role")


IS_TEST = r"""(regexp_matches(path, '(^|/)(__tests__|__test__)/') OR regexp_matches(regexp_replace(path, '(^|/)(src|lib|app|source)/.*$', '/'), '(^|/)(tests|test|spec)/')
  OR regexp_matches(regexp_replace(regexp_extract(path, '([^/]*)$', 1), '\.[^.]+$', ''), '(\.test|\.spec|_test|[a-z0-9]Test)$|^test_'))"""


@query("cls_07_test_path", f"SELECT doc_id, {IS_TEST} AS test FROM paths")
def _(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "paths").select("doc_id", classify.is_test_path(F.col("path")).alias("test"))


@query("cls_00_engine", f"""
WITH a AS (SELECT CAST(doc_id AS STRING) AS node_id, path, concat('D', CAST(doc_id % 50 AS STRING), CASE doc_id % 4 WHEN 0 THEN 'Controller' WHEN 1 THEN 'Job' ELSE '' END) AS name, CASE WHEN doc_id % 2 = 0 THEN 'class' ELSE 'module' END AS kind FROM paths)
SELECT DISTINCT * FROM (SELECT node_id, 'owner' AS role, 'certain' AS confidence, 'user' AS rule_id FROM a WHERE name = 'D8Controller'
  UNION ALL SELECT node_id, 'application.controller', 'possible', 'name_suffix' FROM a WHERE kind = 'class' AND suffix(name, 'Controller') UNION ALL SELECT node_id, 'messaging.job', 'possible', 'name_suffix' FROM a WHERE kind = 'class' AND suffix(name, 'Job')
  UNION ALL SELECT node_id, 'quality.test_module', 'probable', 'test_modules' FROM a WHERE {IS_TEST}) x""")
def _(s: SparkSession, d: str) -> DataFrame:
    return classify.classify(_named_paths(s, d), [classify.explicit({"D8Controller": "owner"}), classify.by_suffix, classify.by_test_path])


def _named_paths(s: SparkSession, d: str) -> DataFrame:
    """The paths as components of two kinds, with names that end like roles."""
    end = F.when(F.col("doc_id") % 4 == 0, "Controller").when(F.col("doc_id") % 4 == 1, "Job").otherwise("")
    name = F.concat(F.lit("D"), (F.col("doc_id") % 50).cast("string"), end)
    return view(s, d, "paths").select(F.col("doc_id").cast("string").alias("id"), F.col("path").alias("relative_path"), name.alias("canonical_name"), name.alias("display_name"), F.when(F.col("doc_id") % 2 == 0, "class").otherwise("module").alias("kind"), F.lit("{}").alias("attributes_json"), F.lit("php").alias("language"))


@query("bnd_01_infer_boundaries", """
WITH f AS (SELECT DISTINCT split_part(relative_path, '/', 1) AS name FROM files) SELECT name, 'path_prefix' AS matcher_type, name || '/' AS matcher_value FROM f""")
def _(s: SparkSession, d: str) -> DataFrame:
    nodes = view(s, d, "files").select(F.lit("module").alias("kind"), "language", F.col("relative_path").alias("canonical_name"), "relative_path")
    return classify.infer_boundaries(nodes)


@query("bnd_03_prefix_membership", """
WITH b AS (SELECT DISTINCT split_part(relative_path, '/', 1) || '/' AS p FROM files UNION SELECT DISTINCT split_part(relative_path, '/', 1) || '/' || language || '/' FROM files UNION SELECT relative_path FROM files WHERE size % 7 = 0 UNION SELECT '')
SELECT b.p AS boundary_id, f.id AS node_id FROM files f JOIN b ON f.relative_path = b.p OR b.p = '' OR suffix(b.p, '/') AND starts_with(f.relative_path, b.p)""")
def _(s: SparkSession, d: str) -> DataFrame:
    files = view(s, d, "files")
    nodes = files.select("id", "relative_path", F.col("relative_path").alias("canonical_name"), F.lit("{}").alias("attributes_json"))
    top = F.concat(F.substring_index("relative_path", "/", 1), F.lit("/"))
    some = files.select(F.explode(F.array(top, F.concat(top, "language", F.lit("/")))).alias("id")).unionByName(files.where("size % 7 = 0").select(F.col("relative_path").alias("id"))).distinct()
    whole = s.createDataFrame([("", "path_prefix", "/")], "id string, matcher_type string, matcher_value string")
    return classify.memberships(nodes, some.select("id", F.lit("path_prefix").alias("matcher_type"), F.col("id").alias("matcher_value")).unionByName(whole))


# --- sinks, incremental, maintenance ------------------------------------------------------------------------------------------


@query("snk_01_upsert", """
SELECT b.id, CASE WHEN a.id IS NULL THEN 'insert' WHEN (a.kind, a.display_name, a.file_id, a.confidence) IS DISTINCT FROM (b.kind, b.display_name, b.file_id, b.confidence) THEN 'update' ELSE 'keep' END AS write FROM snap_b b LEFT JOIN snap_a a ON a.id = b.id""")
def _(s: SparkSession, d: str) -> DataFrame:
    return incremental.upsert(*_snaps(s, d)).select("id", "write")


@query("snk_02_distinct_memberships", "SELECT DISTINCT boundary_id, node_id FROM memberships")
def _(s: SparkSession, d: str) -> DataFrame:
    m = view(s, d, "memberships")
    return incremental.insert_or_ignore(m, m)


@query("snk_03_prune", "SELECT id FROM snap_a WHERE id NOT IN (SELECT id FROM snap_b)")
def _(s: SparkSession, d: str) -> DataFrame:
    return incremental.pruned(*_snaps(s, d))


@query("snk_06_retention", """
WITH r AS (SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, CAST(event_id AS STRING) DESC) AS k FROM events) SELECT CAST(event_id AS STRING) AS scan_id FROM r WHERE k <= 3""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("user_id").alias("project_id"), F.col("event_id").cast("string").alias("scan_id"), F.col("ts").alias("captured_at"))
    return incremental.retain(e, 3).select("scan_id")


@query("snk_07_redacted_bundle", "SELECT id, substr(sha256(relative_path), 1, 16) || '.txt' AS relative_path FROM files")
def _(s: SparkSession, d: str) -> DataFrame:
    files, _ = bundle.redact(view(s, d, "files"), view(s, d, "nodes"), "paths")
    return files.select("id", "relative_path")


@query("mnt_02_stale_scans", f"""
WITH {SCANS}, {SNAPS} SELECT id FROM scans WHERE status IN ('running', 'failed', 'cancelled') AND started_at < TIMESTAMP '2024-01-02 00:00:00' - INTERVAL 6 HOURS AND id NOT IN (SELECT scan_id FROM snaps) AND id <> 'scan:1' ORDER BY started_at, id LIMIT 1000""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet").where("event_id % 3 = 0")
    snaps = e.select(F.concat(F.lit("scan:"), F.col("event_id").cast("string")).alias("scan_id"))
    return incremental.stale_scans(scans(s, d), s.createDataFrame([("scan:1",)], "active_scan_id string"), snaps, "2024-01-02 00:00:00", 6)


@on_graph("mnt_03_integrity", """
SELECT 'edges.target_id' AS relation, target_id AS id FROM edges WHERE target_id NOT IN (SELECT id FROM nodes) UNION ALL SELECT 'edges.source_id', source_id FROM edges WHERE source_id NOT IN (SELECT id FROM nodes)
UNION ALL SELECT 'nodes.file_id', file_id FROM nodes WHERE file_id NOT IN (SELECT id FROM files)""")
def _(g: Graph) -> DataFrame:
    return incremental.integrity({"edges": g.edges, "nodes": g.nodes, "files": g.files})


@query("stl_01_drift", """
SELECT coalesce(a.id, b.id) AS relative_path, CASE WHEN a.id IS NULL THEN 'added' WHEN b.id IS NULL THEN 'deleted' ELSE 'changed' END AS change FROM snap_a a FULL JOIN snap_b b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.file_id <> b.file_id""")
def _(s: SparkSession, d: str) -> DataFrame:
    a, b = (t.select(F.col("id").alias("relative_path"), F.col("file_id").alias("content_hash")) for t in _snaps(s, d))
    return watch.poll_changes(a, b)


@query("ann_01_annotate", "SELECT canonical_name, kind, value FROM annotations WHERE NOT (canonical_name = 'geo.ASIA' AND kind = 'note') UNION ALL SELECT 'geo.ASIA', 'note', 'seen'")
def _(s: SparkSession, d: str) -> DataFrame:
    return incremental.annotate(view(s, d, "annotations"), "geo.ASIA", "note", "seen")


@query("ann_02_list_annotations", "SELECT canonical_name, kind, value FROM annotations WHERE kind = 'note' ORDER BY canonical_name, kind LIMIT 100")
def _(s: SparkSession, d: str) -> DataFrame:
    return view(s, d, "annotations").where("kind = 'note'").orderBy("canonical_name", "kind").limit(100)


@query("str_03_coalesce", f"""
SELECT {CHURN_FILES} AS path, max_by(event_type, (ts, event_id)) AS change, count(*) AS coalesced FROM events GROUP BY 1""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    return watch.coalesce(e.select(F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("event_type").alias("change"), "ts", F.col("event_id").alias("seq")))


@query("str_04_overflow", """
WITH b AS (SELECT date_trunc('day', ts) AS batch, event_type || '/' || CAST(user_id % 20 AS STRING) AS path, event_type AS change, ts, event_id FROM events),
c AS (SELECT batch, path, max_by(change, (ts, event_id)) AS change FROM b GROUP BY batch, path), n AS (SELECT batch, count(*) AS paths FROM c GROUP BY batch)
SELECT batch, NULL AS path, NULL AS change, true AS full_scan FROM n WHERE paths > 40 UNION ALL SELECT batch, path, change, false FROM c JOIN n USING (batch) WHERE paths <= 40""")
def _(s: SparkSession, d: str) -> DataFrame:
    e = s.read.parquet(f"{d}/events.parquet")
    changes = e.select(F.date_trunc("day", "ts").alias("batch"), F.concat("event_type", F.lit("/"), (F.col("user_id") % 20).cast("string")).alias("path"), F.col("event_type").alias("change"), "ts", F.col("event_id").alias("seq"))
    return watch.overflow(changes, 40)


@query("str_04_event_windows", "SELECT date_trunc('day', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def _(s: SparkSession, d: str) -> DataFrame:
    return watch.event_windows(s.read.parquet(f"{d}/events.parquet"))


from . import parts as parts, upkeep as upkeep  # noqa: E402  register their queries beside these
