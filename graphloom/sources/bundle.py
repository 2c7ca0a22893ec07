"""Portable graph bundles: redacted export and checked import."""

from __future__ import annotations

import gzip
import hashlib
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import stable_id
from ..storage import stored

FORMAT, VERSION = "architecture-graph", 1
#: Limits of a bundle: compressed bytes, raw bytes and facts.
MOST_PACKED, MOST_RAW, MOST_FACTS = 10_000_000, 8_000_000, 200_000


def redacted_path(path: Column) -> Column:
    """A hash in place of the path; the extension stays."""
    return F.concat(F.substring(F.sha2(path, 256), 1, 16), F.regexp_extract(path, r"(\.[A-Za-z0-9]+)$", 1))


def redact(files: DataFrame, nodes: DataFrame, level: str = "none") -> tuple[DataFrame, DataFrame]:
    """none, paths (paths hashed) or strict (attributes emptied as well)."""
    if level not in ("none", "paths", "strict"):
        raise ValueError("redaction is none, paths or strict")
    if level != "none":
        files = files.withColumn("relative_path", redacted_path(F.col("relative_path")))
    if level == "strict":
        nodes = nodes.withColumn("attributes_json", F.lit("{}"))
    return files, nodes


def redact_all(tables: dict[str, DataFrame], level: str = "none") -> dict[str, DataFrame]:
    """All tables of a graph: as ``redact``, and ids of files that are their paths hashed wherever they stand; strict masks what diagnostics say as well."""
    files, nodes = redact(tables["files"], tables["nodes"], level)
    out = tables | {"files": files, "nodes": nodes}
    if level == "none":
        return out
    named = tables["files"].where("id = relative_path").select(F.col("id").alias("file_id"), redacted_path(F.col("id")).alias("hashed"))
    out["files"] = tables["files"].join(named, F.col("id") == F.col("file_id"), "left").withColumn("id", F.coalesce("hashed", "id")).withColumn("relative_path", redacted_path(F.col("relative_path"))).select(*files.columns)
    for name in ("nodes", "edges"):
        out[name] = out[name].join(named, "file_id", "left").withColumn("file_id", F.coalesce("hashed", "file_id")).select(*tables[name].columns)
    if level == "strict" and "diagnostics" in out:
        # A message quotes the source, and an id may begin with the path that it is about.
        out["diagnostics"] = out["diagnostics"].withColumn("message", F.lit("redacted")).withColumn("id", F.concat(F.lit("redacted:"), F.substring(F.sha2("id", 256), 1, 24)))
    return out


def remap_rest(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Roles and memberships under the new ids of their components; one of an unknown component or boundary fails the import.  ``ids``: id, new_id."""
    out = {}
    for name in ("classifications", "memberships"):
        rows = tables[name]
        if not rows.join(ids.select(F.col("id").alias("node_id")), "node_id", "left_anti").isEmpty():
            raise ValueError(f"{name} of an unknown component")
        out[name] = rows.join(ids.select(F.col("id").alias("node_id"), "new_id"), "node_id").withColumn("node_id", F.col("new_id")).select(*rows.columns)
    if not tables["memberships"].join(tables["boundaries"].select(F.col("id").alias("boundary_id")), "boundary_id", "left_anti").isEmpty():
        raise ValueError("memberships of an unknown boundary")
    return out


def new_ids(nodes: DataFrame, project: str) -> DataFrame:
    return nodes.select("id", stable_id("symbol", F.lit(project), F.col("language"), F.col("kind"), F.col("canonical_name")).alias("new_id"))


def canonical(value: object) -> bytes:
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False).encode()


def encode(tables: dict[str, DataFrame]) -> bytes:
    """All tables, ``MOST_FACTS`` rows at most, as gzipped canonical JSON with a checksum."""
    body, facts = {}, 0
    for name, df in sorted(tables.items()):
        rows = [r.asDict(recursive=True) for r in df.limit(MOST_FACTS + 1).collect()]
        facts += len(rows)
        if facts > MOST_FACTS:
            raise ValueError("too many facts for a bundle")
        body[name] = sorted(rows, key=canonical)
    raw = canonical({"format": FORMAT, "version": VERSION, "checksum": hashlib.sha256(canonical(body)).hexdigest(), "tables": body})
    if len(raw) > MOST_RAW:
        raise ValueError("bundle is too large")
    return gzip.compress(raw, mtime=0)


def decode(data: bytes) -> dict[str, list[dict]]:
    if len(data) > MOST_PACKED:
        raise ValueError("bundle is too large")
    with gzip.open(__import__("io").BytesIO(data)) as f:
        raw = f.read(MOST_RAW + 1)
    if len(raw) > MOST_RAW:
        raise ValueError("bundle is too large")
    value = json.loads(raw)
    if value.get("format") != FORMAT or value.get("version") != VERSION:
        raise ValueError("not a bundle of this version")
    if hashlib.sha256(canonical(value["tables"])).hexdigest() != value["checksum"]:
        raise ValueError("checksum does not fit")
    if sum(map(len, value["tables"].values())) > MOST_FACTS:
        raise ValueError("too many facts")
    return value["tables"]


def remap(nodes: DataFrame, edges: DataFrame, project: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges under new ids of another project; an edge with a missing end fails the import."""
    ids = new_ids(nodes, project)
    ends = edges.select(F.explode(F.array("source_id", "target_id")).alias("id")).distinct()
    if not ends.join(ids, "id", "left_anti").isEmpty():
        raise ValueError("an edge has no node")
    parents = ids.select(F.col("id").alias("parent_id"), F.col("new_id").alias("new_parent"))
    out = nodes.join(ids, "id").join(parents, "parent_id", "left").drop("id", "parent_id").withColumnsRenamed({"new_id": "id", "new_parent": "parent_id"}).select(*nodes.columns)
    source, target = ids.select(F.col("id").alias("source_id"), F.col("new_id").alias("s")), ids.select(F.col("id").alias("target_id"), F.col("new_id").alias("t"))
    moved = edges.join(source, "source_id").join(target, "target_id").withColumn("source_id", F.col("s")).withColumn("target_id", F.col("t")).select(*edges.columns)
    return out, moved


def parent_cycles(nodes: DataFrame) -> DataFrame:
    """Nodes whose chain of parents comes back to itself, or runs into one that does; a chain may be of any depth."""
    now = stored(nodes.select(F.col("id").alias("start"), F.col("parent_id").alias("at")).where("at is not null").distinct(), "parents")
    n = now.select("start").distinct().count()
    while n:
        # Pointer jumping: the chain walked doubles each round, and what has ended is left out.
        jump = now.select(F.col("start").alias("at"), F.col("at").alias("next"))
        now = stored(now.join(jump, "at").select("start", F.col("next").alias("at")).distinct(), "parents")
        before, n = n, now.select("start").distinct().count()
        # A chain that ends later would have had a node that ended in this round.
        if n == before:
            break
    return now.select(F.col("start").alias("id")).distinct()
