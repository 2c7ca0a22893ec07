"""Queries over what is kept from one scan to the next: incremental maintenance, bucketed tables."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config
from .. import schema as S
from ..ingest import classify, incremental
from ..ingest.intervals import Intervals
from ..ingest.maintain import Maintained
from ..ingest.store import BucketStore, bucket_of, upsert_into
from ..operators import lookup, names, scc
from ..sources import bundle, merkle
from ..storage import scratch_dir
from ..views import graph, indexed_graph, view
from .catalog import SQL, TERM, gate_metrics, query


def own_store(s: SparkSession, name: str, digits: int = 2) -> BucketStore:
    """A store of this call alone, in the shared folder."""
    return BucketStore(s, f"{scratch_dir(s)}/{name}-{uuid.uuid4().hex}", digits)


# --- incremental maintenance -------------------------------------------------------------------------------------------------

#: What the second version of the customers' files changes, and which of them it no longer has.
CHANGED, GONE = "c_acctbal < -800", "c_acctbal > 9900"


def contributions_of(s: SparkSession, d: str, second: bool) -> DataFrame:
    """Each customer is a file with a class, some with a method and a parent; each customer's orders are a file of calls to the customer's method."""
    c, o = s.read.parquet(f"{d}/customer.parquet"), s.read.parquet(f"{d}/orders.parquet")
    key = F.col("c_custkey")
    goes, parent = F.col("c_nationkey") < 5, F.when(F.col("c_acctbal") < 4000, key + 1)
    if second:
        c = c.where(f"NOT ({GONE})")
        goes, parent = F.when(F.expr(CHANGED), F.col("c_nationkey").between(3, 7)).otherwise(goes), F.when(F.expr(CHANGED), key + 2).otherwise(parent)
    name = lambda x: F.concat(F.lit("C"), x.cast("string"))
    text = F.lit("certain")
    nothing = F.lit(None).cast("string")
    node = lambda kind, n: F.struct(n.alias("local_id"), F.lit(kind).alias("kind"), n.alias("canonical_name"), n.alias("display_name"), F.lit("ast").alias("origin"), text.alias("confidence"), F.lit(1).alias("start_line"), F.lit(9).alias("end_line"), nothing.alias("attributes"))
    edge = lambda kind, a, b, line: F.struct(F.lit(kind).alias("kind"), a.alias("source"), b.alias("target"), F.lit("ast").alias("origin"), text.alias("confidence"), line.cast("int").alias("start_line"))
    told = F.array().cast(S.CONTRIBUTION["diagnostics"].dataType).alias("diagnostics")
    cls = lambda x: F.concat(F.lit("php:class:"), x)
    go = F.concat(name(key), F.lit("::go"))
    nodes = F.concat(F.array(node("class", name(key))), F.when(goes, F.array(node("method", go))).otherwise(F.array().cast(S.CONTRIBUTION["nodes"].dataType)))
    edges = F.when(parent.isNotNull(), F.array(edge("extends", cls(name(key)), cls(name(parent)), F.lit(1)))).otherwise(F.array().cast(S.CONTRIBUTION["edges"].dataType))
    types = c.select(F.lit("php").alias("language"), F.concat(F.lit("c"), key.cast("string")).alias("owner_key"), nodes.alias("nodes"), edges.alias("edges"), told)
    caller, target = F.concat(F.lit("O"), F.col("o_custkey").cast("string")), F.concat(F.lit("php:method:C"), F.col("o_custkey").cast("string"), F.lit("::go"))
    # A file holds one customer's orders.
    calls = o.groupBy("o_custkey").agg(F.array_sort(F.collect_list(edge("calls", cls(caller), target, F.col("o_orderkey")))).alias("edges"))
    return types.unionByName(calls.select(F.lit("php").alias("language"), F.concat(F.lit("o"), F.col("o_custkey").cast("string")).alias("owner_key"), F.array(node("class", caller)).alias("nodes"), "edges", told))


def listing(contributions: DataFrame) -> DataFrame:
    return contributions.select(F.col("owner_key").alias("relative_path"), F.sha2(F.to_json(F.struct("nodes", "edges")), 256).alias("content_hash"))


@query("str_07_incremental_equals_full", f"""
WITH b AS (SELECT c_custkey AS k, CASE WHEN {CHANGED} THEN c_nationkey BETWEEN 3 AND 7 ELSE c_nationkey < 5 END AS go, CASE WHEN {CHANGED} THEN c_custkey + 2 WHEN c_acctbal < 4000 THEN c_custkey + 1 END AS parent FROM customer WHERE NOT ({GONE})),
up AS (SELECT k AS start, parent AS at_, 1 AS depth FROM b WHERE NOT go AND parent IS NOT NULL UNION ALL SELECT up.start, b.parent, depth + 1 FROM up JOIN b ON b.k = up.at_ WHERE NOT b.go AND b.parent IS NOT NULL AND depth < 20),
hit AS (SELECT k AS start, k AS holder FROM b WHERE go UNION ALL SELECT up.start, b.k FROM up JOIN b ON b.k = up.at_ AND b.go)
SELECT concat('o', CAST(o_custkey AS STRING)) AS file, CAST(o_orderkey AS INTEGER) AS line, CASE WHEN holder IS NULL THEN 'external_method' ELSE 'method' END AS kind, concat('C', CAST(coalesce(holder, o_custkey) AS STRING), '::go') AS name FROM orders LEFT JOIN hit ON hit.start = o_custkey
UNION ALL SELECT concat('c', CAST(b.k AS STRING)), 1, CASE WHEN t.k IS NULL THEN 'external_class' ELSE 'class' END, concat('C', CAST(b.parent AS STRING)) FROM b LEFT JOIN b t ON t.k = b.parent WHERE b.parent IS NOT NULL
UNION ALL SELECT 'of all references', 0, 'decided again', 'less than a quarter'""")
def _(s: SparkSession, d: str) -> DataFrame:
    kept = Maintained(own_store(s, "maintained", 1), "test")
    first, second = contributions_of(s, d, False), contributions_of(s, d, True)
    work = kept.work(listing(first), "1", "c")
    kept.scan(work, first, "1", "c")
    work = kept.work(listing(second), "1", "c")
    done = kept.scan(work, second.join(work.changed.select(F.col("relative_path").alias("owner_key")), "owner_key", "left_semi"), "1", "c")
    g = kept.graph()
    shown = g["edges"].join(g["nodes"].select(F.col("id").alias("target_id"), F.col("kind").alias("hit"), "canonical_name"), "target_id")
    share = "less than a quarter" if 4 * done.decided_again < done.references else f"{done.decided_again} of {done.references}"
    metric = s.createDataFrame([("of all references", 0, "decided again", share)], "file string, line int, kind string, name string")
    return shown.select("file", F.col("start_line").alias("line"), F.col("hit").alias("kind"), F.col("canonical_name").alias("name")).unionByName(metric)


# --- components of long rings and chains -----------------------------------------------------------------------------------------

#: Tables written one after the other, at most, however long a ring or chain is.
FEW_ROUNDS = 40


def _in_turn(s: SparkSession, d: str, closed: bool) -> DataFrame:
    """Each order of a customer leads to the customer's next; the last leads to the next customer's first, and the very last to the very first if ``closed``."""
    o = s.read.parquet(f"{d}/orders.parquet").select("o_custkey", "o_orderkey")
    order = Window.partitionBy("o_custkey").orderBy("o_orderkey")
    inner = o.select("o_custkey", F.col("o_orderkey").alias("a"), F.lead("o_orderkey").over(order).alias("b")).where("b IS NOT NULL").select("a", "b")
    ends = o.groupBy("o_custkey").agg(F.min("o_orderkey").alias("first"), F.max("o_orderkey").alias("last"))
    # Customers are dealt by ranges of their keys: where a range begins is a small table.
    ranked = ends.withColumn("range", F.floor(F.col("o_custkey") / 1000))
    within = ranked.withColumn("next", F.lead("first").over(Window.partitionBy("range").orderBy("o_custkey")))
    starts = ranked.groupBy("range").agg(F.min_by("first", "o_custkey").alias("start"))
    following = starts.select("range", F.lead("start", 1).over(Window.orderBy("range")).alias("start"))
    last = within.where("next IS NULL").join(following, "range").select(F.col("last").alias("a"), F.col("start").alias("b"))
    if closed:
        # The end of all leads to the beginning of all.
        last = last.withColumn("b", F.coalesce("b", F.lit(starts.agg(F.min_by("start", "range")).first()[0])))
    edges = inner.unionByName(within.where("next IS NOT NULL").select(F.col("last").alias("a"), F.col("next").alias("b"))).unionByName(last.where("b IS NOT NULL"))
    return edges.select(*(F.concat(F.lit("o:"), F.col(c).cast("string")).alias(n) for c, n in (("a", "source_id"), ("b", "target_id"))))


def _found(s: SparkSession, d: str, closed: bool) -> DataFrame:
    rounds = scc.Rounds()
    found = scc.components(_in_turn(s, d, closed), 0, rounds)
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size")).select("component", "size", F.lit(rounds.n <= FEW_ROUNDS).alias("few_rounds"))


@query("cyc_01_long_ring", "SELECT min(concat('o:', CAST(o_orderkey AS STRING))) AS component, count(*) AS size, true AS few_rounds FROM orders")
def _(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, True)


@query("cyc_01_long_chain", "SELECT CAST(NULL AS STRING) AS component, CAST(0 AS BIGINT) AS size, true AS few_rounds FROM region WHERE r_regionkey < 0")
def _(s: SparkSession, d: str) -> DataFrame:
    return _found(s, d, False)


# --- archived snapshots ----------------------------------------------------------------------------------------------------------

#: Older states of the graph's tables: conditions that rows met, and what other rows had in a column.
OLDER = {
    "files": ("language <> 'fr'", "content_hash", "size < 400", "'older'"),
    "nodes": ("NOT (kind = 'route' AND length(id) % 2 = 0)", "file_id", "kind = 'interface'", "'f:elsewhere'"),
    "edges": ("confidence = 'certain'", "start_line", "kind = 'imports'", "7"),
    "classifications": ("role <> 'application.public_api'", "confidence", "role = 'laravel.model'", "'possible'"),
    "boundaries": ("id <> 'b:all'", "name", "source = 'inferred'", "lower(name)"),
    "memberships": ("boundary_id <> 'b:all'", "node_id", "false", "node_id"),
}


def older_sql(name: str) -> str:
    where, column, when, value = OLDER[name]
    return f"SELECT * REPLACE (CASE WHEN {when} THEN {value} ELSE {column} END AS {column}) FROM {name} WHERE {where}"


def older(name: str, df: DataFrame) -> DataFrame:
    where, column, when, value = OLDER[name]
    return df.where(where).withColumn(column, F.when(F.expr(when), F.expr(value)).otherwise(F.col(column)))


def archived(s: SparkSession, d: str) -> Intervals:
    """Three snapshots of the graph: an older state, one in which only the components are new, and the present."""
    g = graph(s, d)
    now = {n: getattr(g, n) for n in OLDER} | {"diagnostics": g.diagnostics}
    name = lambda n: "boundary_memberships" if n == "memberships" else n
    kept = Intervals(s, f"{scratch_dir(s)}/archive-{uuid.uuid4().hex}")
    before = {n: older(n, df) if n in OLDER else df for n, df in now.items()}
    for tables in (before, before | {"nodes": now["nodes"]}, now):
        kept.write({name(n): df for n, df in tables.items()})
    return kept


def _diff_sql(name: str) -> str:
    key = {"classifications": "concat_ws('|', node_id, role, rule_id)", "memberships": "concat_ws('|', boundary_id, node_id)"}.get(name, "id")
    ha, hb = (f"SELECT {key} AS key, md5(CAST(t AS STRING)) AS whole FROM (SELECT * {'EXCLUDE (file_id)' if name in ('nodes', 'edges') else ''} FROM ({q}) x) t" for q in (older_sql(name), f"SELECT * FROM {name}"))
    files = (f"SELECT {key} AS key, file_id FROM ({q}) x" for q in (older_sql(name), f"SELECT * FROM {name}")) if name in ("nodes", "edges") else None
    section = "boundary_memberships" if name == "memberships" else name
    out = f"SELECT '{section}' AS section, coalesce(a.key, b.key) AS key, CASE WHEN a.key IS NULL THEN 'added' WHEN b.key IS NULL THEN 'removed' ELSE 'changed' END AS operation FROM (SELECT DISTINCT key, whole FROM ({ha})) a FULL JOIN (SELECT DISTINCT key, whole FROM ({hb})) b ON a.key = b.key WHERE a.whole IS DISTINCT FROM b.whole"
    if files:
        fa, fb = files
        out += f" UNION ALL SELECT '{section}', a.key, 'moved' FROM ({fa}) a JOIN ({fb}) b ON a.key = b.key WHERE a.file_id IS DISTINCT FROM b.file_id"
    return out


@query("snp_01_all_tables", " UNION ALL ".join(_diff_sql(n) for n in OLDER))
def _(s: SparkSession, d: str) -> DataFrame:
    return archived(s, d).diff(1, 3)


@query("snp_06_trends_of_archived", f"""
WITH {gate_metrics('x', older_sql('nodes'), older_sql('edges')).replace('classifications', 'older_roles')}, {gate_metrics('y', 'SELECT * FROM nodes', older_sql('edges')).replace('classifications', 'older_roles')}, {gate_metrics('z', 'SELECT * FROM nodes', 'SELECT * FROM edges')},
m AS (SELECT 's1' AS scan_id, CAST(1 AS BIGINT) AS sequence, * FROM xmetrics UNION ALL SELECT 's2', 2, * FROM ymetrics UNION ALL SELECT 's3', 3, * FROM zmetrics)
SELECT *, coalesce(CAST(cycles - lag(cycles) OVER (ORDER BY sequence) AS BIGINT), 0) AS cycles_change, coalesce(CAST(max_degree - lag(max_degree) OVER (ORDER BY sequence) AS BIGINT), 0) AS max_degree_change, coalesce(CAST(unreferenced_candidates - lag(unreferenced_candidates) OVER (ORDER BY sequence) AS BIGINT), 0) AS unreferenced_candidates_change,
  coalesce(error_diagnostics - lag(error_diagnostics) OVER (ORDER BY sequence), 0) AS error_diagnostics_change, coalesce(warning_diagnostics - lag(warning_diagnostics) OVER (ORDER BY sequence), 0) AS warning_diagnostics_change FROM m""".replace("WITH ", f"WITH older_roles AS ({older_sql('classifications')}), ", 1))
def _(s: SparkSession, d: str) -> DataFrame:
    return archived(s, d).trends(3).na.fill(0)


# --- upserts that write --------------------------------------------------------------------------------------------------------

TOUCHED = "c_acctbal > 9800 OR c_acctbal BETWEEN 4000 AND 4020 OR c_acctbal < -970"


@query("snk_01_written", f"""
WITH t AS (SELECT DISTINCT substr(md5(CAST(c_custkey AS STRING)), 1, 2) AS bucket FROM customer WHERE {TOUCHED})
SELECT CAST(c_custkey AS STRING) AS id, CASE WHEN c_acctbal > 9800 THEN upper(c_name) ELSE c_name END AS name, CASE WHEN c_acctbal > 9800 OR c_acctbal BETWEEN 4000 AND 4020 THEN 's2' ELSE 's1' END AS last_scan_id, substr(md5(CAST(c_custkey AS STRING)), 1, 2) AS bucket, t.bucket IS NOT NULL AS written
FROM customer LEFT JOIN t ON t.bucket = substr(md5(CAST(c_custkey AS STRING)), 1, 2) WHERE NOT c_acctbal < -970""")
def _(s: SparkSession, d: str) -> DataFrame:
    # The second scan renames rich customers, finds some that the first didn't know, and misses the most indebted.
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").cast("string").alias("id"), F.col("c_name").alias("name"), "c_acctbal")
    store = own_store(s, "upsert")
    one = store.begin()
    upsert_into(one, "customers", "id", c.where("NOT c_acctbal BETWEEN 4000 AND 4020").select("id", "name", F.lit("s1").alias("last_scan_id")))
    one.publish()
    two = store.begin()
    upsert_into(two, "customers", "id", c.where("NOT c_acctbal < -970").select("id", F.when(F.col("c_acctbal") > 9800, F.upper("name")).otherwise(F.col("name")).alias("name"), F.lit("s2").alias("last_scan_id")))
    two.publish()
    bucket = bucket_of("id", store.digits)
    return store.read("customers").select("id", "name", "last_scan_id", bucket.alias("bucket"), bucket.isin(two.written["customers"]).alias("written"))


# --- index of names --------------------------------------------------------------------------------------------------------------

TERMS = ["Supplier_7", "order100", "ÉCRU", "o1", "nation_1"]


@query("qry_02_indexed_names", " UNION ALL ".join(f"SELECT '{t}' AS term, id FROM nodes WHERE canonical_name ILIKE '%{t.replace('_', '!_')}%' ESCAPE '!' OR display_name ILIKE '%{t.replace('_', '!_')}%' ESCAPE '!'" for t in TERMS) + " UNION ALL SELECT 'read', 'less than a tenth of the components'")
def _(s: SparkSession, d: str) -> DataFrame:
    g = indexed_graph(s, d)
    parts = [names.narrowed(g, [t]).where(lookup.contains("canonical_name", t) | lookup.contains("display_name", t)).select(F.lit(t).alias("term"), "id") for t in TERMS]
    # What is read of the components for a term that some of them hold.
    some = names.candidates(g, TERMS[0])
    read = g.extras["names"].join(some.select("block").distinct(), "block", "left_semi").count(), names.narrowed(g, TERMS[:1]).count(), g.nodes.count()
    told = "less than a tenth of the components" if 10 * read[1] < read[2] else f"{read}"
    return reduce(DataFrame.unionByName, parts).unionByName(s.createDataFrame([("read", told)], "term string, id string"))


for _name, _lookup in (("qry_02_find_component", lambda g: lookup.find_component(g, TERM)), ("qry_03_search_architecture", lambda g: lookup.search(g, "catalog service", kinds=["class", "function"]))):
    # The same SQL, answered through the index.
    query(f"{_name}_indexed")(lambda s, d, ask=_lookup: ask(indexed_graph(s, d)))
    SQL[f"{_name}_indexed"] = SQL[_name]


# --- streams -------------------------------------------------------------------------------------------------------------------

DELAY_HOURS, MOST_PATHS = 6, 12


def _replayed(s: SparkSession, d: str, parts: int = 4) -> DataFrame:
    """Events as a stream in order of time, a part a trigger: event types are trees, users' numbers paths."""
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_type").alias("tree"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("path"), F.lower("event_type").alias("change"), "ts", F.col("event_id").alias("seq"))
    e = e.withColumn("change", F.when(F.col("seq") % 3 == 0, "deleted").otherwise("changed"))
    path, day = f"{scratch_dir(s)}/replay-{uuid.uuid4().hex}", F.dayofyear("ts")
    days = e.agg(F.min(day), F.max(day)).first()
    for i in range(parts):
        low, high = (days[0] + (days[1] + 1 - days[0]) * k // parts for k in (i, i + 1))
        # One after the other, as files are taken in order of their times.
        e.where((day >= low) & (day < high)).coalesce(1).write.mode("append").parquet(path)
    return s.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(s: SparkSession, stream: DataFrame) -> tuple[DataFrame, str]:
    """What a stream gives until its source is read: the rows and the id of the run."""
    from ..streaming import debounce

    out, checkpoint = (f"{scratch_dir(s)}/{n}-{uuid.uuid4().hex}" for n in ("stream", "progress"))
    with debounce.state_store(s):
        q = stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()
    return s.read.schema(stream.schema).parquet(out), str(q.runId)


@query("str_02_debounced", f"""
WITH e AS (SELECT event_type AS tree, concat('u', CAST(user_id % 20 AS STRING)) AS path, CASE WHEN event_id % 3 = 0 THEN 'deleted' ELSE 'changed' END AS change, ts, event_id AS seq FROM events),
w AS (SELECT tree, min(ts) AS since FROM e GROUP BY tree UNION ALL SELECT w.tree, min(e.ts) FROM w JOIN e ON e.tree = w.tree AND e.ts >= w.since + INTERVAL {DELAY_HOURS} HOURS GROUP BY w.tree),
held AS (SELECT w.tree, w.since, path, arg_max(change, (e.ts, seq)) AS change, count(*) AS n FROM w JOIN e ON e.tree = w.tree AND e.ts >= w.since AND e.ts < w.since + INTERVAL {DELAY_HOURS} HOURS
  WHERE w.since + INTERVAL {DELAY_HOURS} HOURS < (SELECT max(ts) FROM events) GROUP BY w.tree, w.since, path),
many AS (SELECT tree, since, count(*) > {MOST_PATHS} AS full_scan, CAST(sum(n) AS BIGINT) AS n FROM held GROUP BY tree, since)
SELECT h.tree, h.since, path, change, h.n AS coalesced, false AS full_scan FROM held h JOIN many m ON m.tree = h.tree AND m.since = h.since WHERE NOT m.full_scan UNION ALL SELECT tree, since, NULL, NULL, n, true FROM many WHERE full_scan""")
def _(s: SparkSession, d: str) -> DataFrame:
    # Not with the other imports: what keeps state needs a package that the rest doesn't.
    from ..streaming import debounce

    return _run(s, debounce.debounced(_replayed(s, d), DELAY_HOURS * 3_600_000, MOST_PATHS))[0].drop("due").withColumn("since", F.col("since").cast("timestamp_ntz"))


@query("str_06_lifecycle", "SELECT 'started' AS event, CAST(1 AS BIGINT) AS n, CAST(0 AS BIGINT) AS rows UNION ALL SELECT 'progressed', 4, count(*) FROM events UNION ALL SELECT 'ended', 1, 0")
def _(s: SparkSession, d: str) -> DataFrame:
    from ..streaming import debounce

    path = f"{scratch_dir(s)}/lifecycle-{uuid.uuid4().hex}"
    log = debounce.LifecycleLog(s, path)
    s.streams.addListener(log)
    try:
        _, run = _run(s, _replayed(s, d))
        log.wait(run)
    finally:
        s.streams.removeListener(log)
    rows = s.read.schema(log.SCHEMA).parquet(path).where((F.col("run_id") == run) & (F.col("event") != "idle"))
    return rows.groupBy("event").agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("rows"), F.lit(0)).alias("rows"))


# --- trees of hashes -----------------------------------------------------------------------------------------------------------


@query("src_07_hash_tree", """
WITH leaf AS (SELECT substr(md5(relative_path), 1, 2) AS node, sha256(string_agg(relative_path || '=' || content_hash, chr(10) ORDER BY relative_path || '=' || content_hash)) AS hash FROM files GROUP BY 1),
up AS (SELECT substr(node, 1, 1) AS node, sha256(string_agg(node || '=' || hash, chr(10) ORDER BY node || '=' || hash)) AS hash FROM leaf GROUP BY 1),
top AS (SELECT '' AS node, sha256(string_agg(node || '=' || hash, chr(10) ORDER BY node || '=' || hash)) AS hash FROM up)
SELECT 2 AS depth, node, hash FROM leaf UNION ALL SELECT 1, node, hash FROM up UNION ALL SELECT 0, node, hash FROM top""")
def _(s: SparkSession, d: str) -> DataFrame:
    return merkle.tree(view(s, d, "files"), 2)


@query("stl_01_drift_by_tree", """
SELECT relative_path, 'changed' AS change FROM files WHERE content_hash < '02' UNION ALL SELECT relative_path, 'added' FROM files WHERE content_hash LIKE 'ff%'
UNION ALL SELECT 'leaves joined', 'less than a quarter'""")
def _(s: SparkSession, d: str) -> DataFrame:
    now = view(s, d, "files").select("relative_path", "content_hash")
    then = now.where("NOT content_hash LIKE 'ff%'").withColumn("content_hash", F.when(F.col("content_hash") < "02", "older").otherwise(F.col("content_hash")))
    found, leaves = merkle.drift(now, then, 8)
    every = 16 ** merkle.depth_for(now.count(), 8)
    told = "less than a quarter" if 4 * leaves.count() < every else f"{leaves.count()} of {every}"
    return found.unionByName(s.createDataFrame([("leaves joined", told)], "relative_path string, change string"))


# --- tables that are broken on purpose -----------------------------------------------------------------------------------------


@query("mnt_03_dangling", """
WITH n AS (SELECT * FROM nodes WHERE NOT kind IN ('route', 'interface')), f AS (SELECT * FROM files WHERE language <> 'fr'), b AS (SELECT * FROM boundaries WHERE source = 'explicit')
SELECT 'edges.source_id' AS relation, source_id AS id FROM edges WHERE source_id NOT IN (SELECT id FROM n) UNION ALL SELECT 'edges.target_id', target_id FROM edges WHERE target_id NOT IN (SELECT id FROM n)
UNION ALL SELECT 'nodes.file_id', file_id FROM n WHERE file_id NOT IN (SELECT id FROM f) UNION ALL SELECT 'memberships.node_id', node_id FROM memberships WHERE node_id NOT IN (SELECT id FROM n)
UNION ALL SELECT 'memberships.boundary_id', boundary_id FROM memberships WHERE boundary_id NOT IN (SELECT id FROM b) UNION ALL SELECT 'classifications.node_id', node_id FROM classifications WHERE node_id NOT IN (SELECT id FROM n)""")
def _(s: SparkSession, d: str) -> DataFrame:
    g = graph(s, d)
    return incremental.integrity({
        "edges": g.edges, "nodes": g.nodes.where("NOT kind IN ('route', 'interface')"), "files": g.files.where("language <> 'fr'"), "memberships": g.memberships,
        "boundaries": g.boundaries.where("source = 'explicit'"), "classifications": g.classifications,
    })


@query("snk_02_memberships_of_two_scans", "SELECT boundary_id, node_id FROM memberships WHERE boundary_id <> 'b:all' UNION SELECT boundary_id, node_id FROM memberships WHERE boundary_id LIKE 'b:%1%' OR boundary_id = 'b:all'")
def _(s: SparkSession, d: str) -> DataFrame:
    m = graph(s, d).memberships
    return incremental.insert_or_ignore(m.where("boundary_id <> 'b:all'"), m.where("boundary_id LIKE 'b:%1%' OR boundary_id = 'b:all'"))


@query("snk_08_parent_rings", "SELECT concat('s:', CAST(s_suppkey AS STRING)) AS id FROM supplier WHERE s_nationkey < 5")
def _(s: SparkSession, d: str) -> DataFrame:
    # Each nation's suppliers stand below one another; in some nations the last stands above the first.
    p = s.read.parquet(f"{d}/supplier.parquet")
    order = Window.partitionBy("s_nationkey").orderBy("s_suppkey")
    first = F.min("s_suppkey").over(Window.partitionBy("s_nationkey"))
    parent = F.coalesce(F.lead("s_suppkey").over(order), F.when(F.col("s_nationkey") < 5, first))
    name = lambda c: F.concat(F.lit("s:"), c.cast("string"))
    return bundle.parent_cycles(p.select(name(F.col("s_suppkey")).alias("id"), name(parent).alias("parent_id")))


@query("bnd_02_boundaries_of_brands", "SELECT DISTINCT concat('explicit:', p_brand) AS id, p_brand AS name, 'path_prefix' AS matcher_type, concat('catalog/', p_brand, '/') AS matcher_value FROM part")
def _(s: SparkSession, d: str) -> DataFrame:
    # A configuration names fifty boundaries at most; there are half as many brands.
    brands = s.read.parquet(f"{d}/part.parquet").select("p_brand").distinct().orderBy("p_brand").limit(51).collect()
    return classify.explicit_boundaries(s, config.boundaries([{"name": r["p_brand"], "path_prefix": f"catalog/{r['p_brand']}"} for r in brands])).drop("source")
