"""A deterministic architecture graph over the star-schema test tables.

Regions, nations, customers, suppliers, parts and orders become components; line items,
containment, trade between nations and parts bought one after the other become
relationships; documents are files and events are commits.  The text of each view is valid in
Spark SQL and in the SQL engine of the oracles, so both sides start from the same graph.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .graph import Graph, Later
from .operators import names
from .storage import stored

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages", "benchmark")

VIEWS: dict[str, str] = {
    "files": """
SELECT concat('f:', CAST(doc_id AS STRING)) AS id, concat(source, '/', lang, '/', CAST(doc_id AS STRING), '.txt') AS relative_path,
       md5(text) AS content_hash, CAST(n_chars AS BIGINT) AS size, lang AS language,
       CAST(length(text) - length(replace(text, chr(10), '')) + CASE WHEN text = '' OR right(text, 1) = chr(10) THEN 0 ELSE 1 END AS BIGINT) AS line_count
FROM documents""",
    "nodes": """
SELECT concat('r:', CAST(r_regionkey AS STRING)) AS id, 'php' AS language, 'package' AS kind, concat('geo.', r_name) AS canonical_name, r_name AS display_name,
       CAST(NULL AS STRING) AS parent_id, concat('f:', CAST(r_regionkey AS STRING)) AS file_id, 1 AS start_line, 9 AS end_line, 'config' AS origin, 'certain' AS confidence, '{}' AS attributes_json FROM region
UNION ALL
SELECT concat('n:', CAST(n_nationkey AS STRING)), 'php', 'module', concat('geo.', r_name, '.', n_name), n_name, concat('r:', CAST(n_regionkey AS STRING)), concat('f:', CAST(n_nationkey AS STRING)), 1, 20, 'ast', 'certain', CASE WHEN n_nationkey % 4 = 0 THEN '{"executable":true}' ELSE '{}' END
FROM nation JOIN region ON n_regionkey = r_regionkey
UNION ALL
SELECT concat('c:', CAST(c_custkey AS STRING)), 'typescript', 'class', concat('crm.', c_mktsegment, '.', c_name), c_name, concat('n:', CAST(c_nationkey AS STRING)), concat('f:', CAST(c_custkey % 200 AS STRING)), 1, 30, 'ast',
       CASE WHEN c_acctbal < 0 THEN 'possible' WHEN c_acctbal < 3000 THEN 'probable' ELSE 'certain' END, concat('{"segment":"', c_mktsegment, '"}') FROM customer
UNION ALL
SELECT concat('s:', CAST(s_suppkey AS STRING)), 'php', 'interface', concat('supply.', s_name), s_name, concat('n:', CAST(s_nationkey AS STRING)), concat('f:', CAST(s_suppkey % 200 AS STRING)), 1, 40, 'ast', 'certain', '{}' FROM supplier
UNION ALL
SELECT concat('p:', CAST(p_partkey AS STRING)), CASE WHEN p_partkey % 3 = 0 THEN 'python' WHEN p_partkey % 3 = 1 THEN 'typescript' ELSE 'php' END,
       CASE WHEN p_size > 46 THEN 'external_symbol' WHEN p_size = 46 THEN 'route' WHEN p_partkey % 2 = 0 THEN 'class' ELSE 'function' END,
       concat('catalog.', p_brand, '.', p_name, '.', CAST(p_partkey AS STRING)), p_name, CAST(NULL AS STRING), concat('f:', CAST(p_partkey % 200 AS STRING)), 1, p_size,
       CASE WHEN p_size > 46 THEN 'derived' ELSE 'ast' END, CASE WHEN p_size > 46 THEN 'possible' ELSE 'certain' END,
       concat('{"type":"', p_type, '"}') FROM part
UNION ALL
SELECT concat('o:', CAST(o_orderkey AS STRING)), 'typescript', 'method', concat('shop.Order#', CAST(o_orderkey AS STRING)), concat('Order', CAST(o_orderkey AS STRING)), concat('c:', CAST(o_custkey AS STRING)), concat('f:', CAST(o_orderkey % 200 AS STRING)), 1, 5, 'ast',
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'certain' WHEN o_orderpriority = '5-LOW' THEN 'possible' ELSE 'probable' END, '{}' FROM orders""",
    "co": """
SELECT concat('p:', CAST(s AS STRING)) AS source_id, concat('p:', CAST(t AS STRING)) AS target_id FROM (
  SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS k FROM (
    SELECT a.l_partkey AS s, b.l_partkey AS t, count(*) AS n FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1
    WHERE a.l_partkey <> b.l_partkey GROUP BY a.l_partkey, b.l_partkey) x) y WHERE k = 1""",
    "trade": """
SELECT concat('n:', CAST(s AS STRING)) AS source_id, concat('n:', CAST(t AS STRING)) AS target_id FROM (
  SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS k FROM (
    SELECT c_nationkey AS s, s_nationkey AS t, count(*) AS n FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
    WHERE c_nationkey <> s_nationkey GROUP BY c_nationkey, s_nationkey) x) y WHERE k <= 2""",
    "edges": """
SELECT concat('l:', CAST(l_orderkey AS STRING), ':', CAST(l_linenumber AS STRING), ':', CAST(l_partkey AS STRING), ':', CAST(l_suppkey AS STRING), ':', CAST(CAST(round(l_extendedprice * 100) AS BIGINT) AS STRING), ':', CAST(CAST(l_quantity AS INT) AS STRING)) AS id,
       CASE l_returnflag WHEN 'A' THEN 'calls' WHEN 'N' THEN 'depends_on' ELSE 'references' END AS kind, concat('o:', CAST(l_orderkey AS STRING)) AS source_id, concat('p:', CAST(l_partkey AS STRING)) AS target_id,
       concat('f:', CAST(l_orderkey % 200 AS STRING)) AS file_id, l_linenumber AS start_line, 'ast' AS origin,
       CASE WHEN l_linestatus = 'F' THEN 'certain' WHEN l_tax < 0.04 THEN 'probable' ELSE 'possible' END AS confidence FROM lineitem
UNION ALL SELECT concat('rn:', CAST(n_nationkey AS STRING)), 'contains', concat('r:', CAST(n_regionkey AS STRING)), concat('n:', CAST(n_nationkey AS STRING)), 'f:0', 1, 'ast', 'certain' FROM nation
UNION ALL SELECT concat('nc:', CAST(c_custkey AS STRING)), 'contains', concat('n:', CAST(c_nationkey AS STRING)), concat('c:', CAST(c_custkey AS STRING)), 'f:1', 1, 'ast', 'certain' FROM customer
UNION ALL SELECT concat('ns:', CAST(s_suppkey AS STRING)), 'contains', concat('n:', CAST(s_nationkey AS STRING)), concat('s:', CAST(s_suppkey AS STRING)), 'f:2', 1, 'ast', 'certain' FROM supplier
UNION ALL SELECT concat('co:', CAST(o_orderkey AS STRING)), 'constructs', concat('c:', CAST(o_custkey AS STRING)), concat('o:', CAST(o_orderkey AS STRING)), 'f:3', 1, 'ast', CASE WHEN o_orderstatus = 'P' THEN 'possible' ELSE 'probable' END FROM orders
UNION ALL SELECT concat('pp:', source_id), 'calls', source_id, target_id, 'f:4', 1, 'ast', 'certain' FROM co
UNION ALL SELECT concat('nn:', source_id, ':', target_id), 'imports', source_id, target_id, 'f:5', 1, 'ast', 'certain' FROM trade
UNION ALL SELECT concat('ps:', CAST(l_partkey AS STRING)), 'implements', concat('p:', CAST(l_partkey AS STRING)), concat('s:', CAST(min(l_suppkey) AS STRING)), 'f:6', 1, 'ast', 'certain' FROM lineitem GROUP BY l_partkey
UNION ALL SELECT concat('ss:', CAST(s_suppkey AS STRING)), 'extends', concat('s:', CAST(s_suppkey AS STRING)), concat('s:', CAST(CAST(floor(s_suppkey / 3) AS BIGINT) AS STRING)), 'f:7', 1, 'ast', 'certain' FROM supplier WHERE s_suppkey >= 3""",
    "classifications": """
SELECT concat('p:', CAST(p_partkey AS STRING)) AS node_id, CASE WHEN p_size <= 5 THEN 'quality.test_module' WHEN p_size <= 8 THEN 'application.controller' WHEN p_size = 9 THEN 'application.public_api' WHEN p_size = 10 THEN 'laravel.model' ELSE 'application.service' END AS role, 'derived' AS origin, 'probable' AS confidence, 'size' AS rule_id FROM part WHERE p_size <= 20
UNION ALL SELECT concat('c:', CAST(c_custkey AS STRING)), concat('crm.', lower(c_mktsegment)), 'derived', 'certain', 'segment' FROM customer WHERE c_acctbal > 5000""",
    "boundaries": """
SELECT concat('b:', CAST(r_regionkey AS STRING)) AS id, r_name AS name, 'namespace_prefix' AS matcher_type, concat('geo.', r_name) AS matcher_value, 'inferred' AS source FROM region
UNION ALL SELECT DISTINCT concat('b:', p_brand), p_brand, 'path_prefix', concat('catalog/', p_brand), 'explicit' FROM part
UNION ALL SELECT 'b:all', 'everything', 'path_prefix', '/', 'inferred' FROM region WHERE r_regionkey = 0""",
    "memberships": """
SELECT concat('b:', CAST(n_regionkey AS STRING)) AS boundary_id, concat('n:', CAST(n_nationkey AS STRING)) AS node_id FROM nation
UNION ALL SELECT concat('b:', CAST(n_regionkey AS STRING)), concat('c:', CAST(c_custkey AS STRING)) FROM customer JOIN nation ON c_nationkey = n_nationkey
UNION ALL SELECT concat('b:', CAST(n_regionkey AS STRING)), concat('s:', CAST(s_suppkey AS STRING)) FROM supplier JOIN nation ON s_nationkey = n_nationkey
UNION ALL SELECT concat('b:', p_brand), concat('p:', CAST(p_partkey AS STRING)) FROM part
UNION ALL SELECT 'b:all', concat('n:', CAST(n_nationkey AS STRING)) FROM nation""",
    "diagnostics": """
SELECT concat('d:', CAST(event_id AS STRING)) AS id, CASE event_id % 3 WHEN 0 THEN 'error' WHEN 1 THEN 'warning' ELSE 'info' END AS severity, upper(event_type) AS code, props AS message FROM events""",
    "annotations": """
SELECT concat('catalog.', p_brand, '.', p_name, '.', CAST(p_partkey AS STRING)) AS canonical_name, CASE p_partkey % 4 WHEN 0 THEN 'false_positive' WHEN 1 THEN 'confirmed_dead' WHEN 2 THEN 'note' ELSE 'intended_boundary' END AS kind, concat('about ', p_name) AS value
FROM part WHERE p_size = 12""",
    "paths": """
SELECT doc_id, concat(source, CASE n_chars % 6 WHEN 0 THEN '/tests' WHEN 1 THEN '/src/tests' WHEN 2 THEN '/__tests__' WHEN 3 THEN '/lib/spec' ELSE '' END, '/', lang, CASE n_chars % 5 WHEN 0 THEN '/test_' ELSE '/d' END, CAST(doc_id AS STRING),
       CASE n_chars % 7 WHEN 0 THEN '.test' WHEN 1 THEN '_test' WHEN 2 THEN 'test' WHEN 3 THEN 'xTest' WHEN 4 THEN '.config' ELSE '' END,
       CASE lang WHEN 'en' THEN '.php' WHEN 'de' THEN '.TSX' WHEN 'fr' THEN '' ELSE '.pyi' END) AS path,
       CASE n_chars % 3 WHEN 0 THEN '#!/usr/bin/env node' WHEN 1 THEN '#!/usr/bin/python3' ELSE substr(text, 1, 20) END AS first_line FROM documents""",
    "commits": """
SELECT event_id AS commit_id, concat(event_type, '/', CAST(user_id % 20 AS STRING)) AS path, CAST(user_id AS STRING) AS author, ts FROM events""",
    "snap_a": """
SELECT concat('o:', CAST(o_orderkey AS STRING)) AS id, 'method' AS kind, concat('Order', CAST(o_orderkey % 400 AS STRING)) AS display_name, concat('f:', CAST(o_custkey % 50 AS STRING)) AS file_id,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'certain' WHEN o_orderpriority = '5-LOW' THEN 'possible' ELSE 'probable' END AS confidence FROM orders WHERE o_orderdate < TIMESTAMP '1999-01-01 00:00:00'""",
    "snap_b": """
SELECT concat('o:', CAST(o_orderkey AS STRING)) AS id, 'method' AS kind, concat('Order', CAST(o_orderkey % 400 AS STRING)) AS display_name,
       CASE WHEN o_orderkey % 11 = 0 THEN 'f:moved' ELSE concat('f:', CAST(o_custkey % 50 AS STRING)) END AS file_id,
       CASE WHEN o_orderkey % 7 = 0 THEN 'certain' WHEN o_orderkey % 13 = 0 THEN 'possible' WHEN o_orderpriority = '1-URGENT' THEN 'certain' WHEN o_orderpriority = '5-LOW' THEN 'possible' ELSE 'probable' END AS confidence
FROM orders WHERE o_orderdate >= TIMESTAMP '1996-01-01 00:00:00'""",
}

#: For the oracles: the views as common table expressions.
WITH = "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in VIEWS.items())


#: Views for Spark in words that shuffle less, with equal rows: an order's lines meet by the order alone, so both sides are one exchange, and pairs are counted where they are ranked.
SHUFFLED_ONCE: dict[str, str] = {
    "co": """
SELECT concat('p:', CAST(s AS STRING)) AS source_id, concat('p:', CAST(t AS STRING)) AS target_id FROM (
  SELECT s, t, row_number() OVER (PARTITION BY s ORDER BY n DESC, t) AS k FROM (
    SELECT s, t, count(*) AS n FROM (SELECT a.l_partkey AS s, b.l_partkey AS t
      FROM (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem DISTRIBUTE BY l_orderkey) a JOIN (SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem DISTRIBUTE BY l_orderkey) b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber - a.l_linenumber = 1
      WHERE a.l_partkey <> b.l_partkey DISTRIBUTE BY s) p GROUP BY s, t) x) y WHERE k = 1""",
}


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view; only the tables and views that it names are read."""
    text = SHUFFLED_ONCE.get(name, VIEWS[name]).replace("{", "{{").replace("}", "}}")
    used: dict[str, DataFrame] = {}
    for t in dict.fromkeys(re.findall(r"\b(?:FROM|JOIN) (\w+)", text)):
        if t in TABLES:
            used[t] = spark.read.parquet(f"{sf_dir}/{t}.parquet")
        elif t in VIEWS:
            used[t] = view(spark, sf_dir, t)
    return spark.sql(re.sub(r"\b(FROM|JOIN) (\w+)", lambda m: f"{m[1]} {{{m[2]}}}" if m[2] in used else m[0], text), **used)


#: What a graph is made of.
TABLES_OF_GRAPH = ("nodes", "edges", "files", "classifications", "boundaries", "memberships", "annotations", "diagnostics")
_WRITTEN: dict[tuple[str, str], Graph] = {}


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the test tables, each table written once for each session and folder when a query first reads it, edges by kind."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _WRITTEN:
        written = lambda name: stored(view(spark, sf_dir, name), name, by="kind" if name == "edges" else None, dense=name == "edges")
        _WRITTEN[key] = Graph(**{name: Later(lambda name=name: written(name)) for name in TABLES_OF_GRAPH})
    return _WRITTEN[key]


_INDEXED: dict[tuple[str, str], Graph] = {}


def indexed_graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The same graph with an index of its names, written once as well."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _INDEXED:
        _INDEXED[key] = names.indexed(graph(spark, sf_dir))
    return _INDEXED[key]
