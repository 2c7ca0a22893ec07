"""Contributions as scanners send them: checked field by field, in Spark, before anything enters a graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import CONFIDENCES, CONTRIBUTION

# Where a fact can come from, and what each part of a contribution may hold.
ORIGINS = ["ast", "composer", "config", "framework_convention", "derived"]
TOP = ["owner_key", "nodes", "edges", "diagnostics"]
NODE = ["local_id", "kind", "canonical_name", "display_name", "origin", "confidence", "evidence", "attributes"]
EDGE = ["kind", "source", "target", "origin", "confidence", "evidence", "attributes"]
DIAGNOSTIC = ["severity", "code", "message", "evidence"]
_EVIDENCE = "path string, start_line int, end_line int"
_MAPS = "array<map<string,string>>"


def _keys(json: Column, allowed: list[str], required: list[str]) -> Column:
    keys = F.map_keys(json) if not isinstance(json, str) else F.json_object_keys(json)
    named = F.array(*[F.lit(k) for k in allowed])
    return (F.size(F.array_except(keys, named)) == 0) & F.forall(F.array(*[F.lit(k) for k in required]), lambda k: F.array_contains(keys, k))


def _evidence(value: Column) -> Column:
    e = F.from_json(value, _EVIDENCE)
    relative = (e["path"] != "") & ~e["path"].startswith("/") & ~F.exists(F.split(e["path"], "/"), lambda s: s == "..")
    keys = F.json_object_keys(value)
    return F.coalesce(relative & (e["start_line"] >= 1) & (e["end_line"] >= 1) & (F.size(F.array_except(keys, F.array(F.lit("path"), F.lit("start_line"), F.lit("end_line")))) == 0), F.lit(False))


def _object(value: Column) -> Column:
    return F.coalesce(F.trim(value).startswith("{"), F.lit(False))


def _fact(m: Column, keys: list[str], names: list[str]) -> Column:
    """A node or edge: all keys and no others, names filled, origin and confidence from their lists."""
    filled = F.forall(F.array(*[F.lit(k) for k in names]), lambda k: F.coalesce(F.element_at(m, k), F.lit("")) != "")
    return F.coalesce(_keys(m, keys, keys) & filled & m["origin"].isin(ORIGINS) & m["confidence"].isin(CONFIDENCES) & _evidence(m["evidence"]) & _object(m["attributes"]), F.lit(False))


def decode(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Contributions from JSON lines (``language, line``), and those refused: ``line, reason``.

    A contribution is taken whole or not at all; the reason names the first part that doesn't fit.
    """
    raw = lines.withColumns({
        "owner_key": F.get_json_object("line", "$.owner_key"), "n": F.from_json(F.get_json_object("line", "$.nodes"), _MAPS), "e": F.from_json(F.get_json_object("line", "$.edges"), _MAPS),
        "d": F.from_json(F.get_json_object("line", "$.diagnostics"), _MAPS), "keys": F.json_object_keys("line"),
    })
    top = F.array(*[F.lit(k) for k in TOP])
    told = lambda m: _keys(m, DIAGNOSTIC, DIAGNOSTIC[:3]) & (m["severity"] != "") & (m["code"] != "") & (m["evidence"].isNull() | _evidence(m["evidence"]))
    reason = (
        F.when(F.col("keys").isNull(), "not an object").when((F.size(F.array_except("keys", top)) > 0) | (F.size(F.array_except(top, F.col("keys"))) > 0), "keys")
        .when(F.coalesce("owner_key", F.lit("")) == "", "owner_key").when(F.col("n").isNull() | ~F.forall("n", lambda m: _fact(m, NODE, NODE[:4])), "nodes")
        .when(F.col("e").isNull() | ~F.forall("e", lambda m: _fact(m, EDGE, EDGE[:3])), "edges").when(F.col("d").isNull() | ~F.forall("d", lambda m: F.coalesce(told(m), F.lit(False))), "diagnostics")
    )
    checked = raw.withColumn("reason", reason)
    line = lambda m, k: F.get_json_object(m["evidence"], f"$.{k}").cast("int")
    node = lambda m: F.struct(*[m[k].alias(k) for k in NODE[:6]], line(m, "start_line").alias("start_line"), line(m, "end_line").alias("end_line"), m["attributes"].alias("attributes"))
    edge = lambda m: F.struct(*[m[k].alias(k) for k in EDGE[:5]], line(m, "start_line").alias("start_line"))
    good = checked.where("reason is null").select("language", "owner_key", F.transform("n", node).alias("nodes"), F.transform("e", edge).alias("edges"), F.transform("d", lambda m: F.struct(*[m[k].alias(k) for k in DIAGNOSTIC[:3]])).alias("diagnostics"))
    return good.select("language", *[F.col(f.name).cast(f.dataType) for f in CONTRIBUTION.fields]), checked.where("reason is not null").select("line", "reason")


def read_session(spark: SparkSession, path: str, protocol: int = 1) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Recorded sessions of scanner processes, a message a line: contributions, refused lines, and the scanners' manifests.

    A scanner's manifest is its answer to ``initialize``; one of another protocol version fails the call, and so
    does a session without a final answer.  Contributions come as ``scan/contribution`` notifications.
    """
    lines = spark.read.text(path).where("value <> ''").select(F.input_file_name().alias("session"), F.col("value").alias("line"))
    manifest = F.get_json_object("line", "$.result.manifest")
    manifests = lines.where(manifest.isNotNull()).select("session", *[F.get_json_object("line", f"$.result.manifest.{k}").alias(k) for k in ("id", "version", "language")], F.get_json_object("line", "$.result.protocol_version").cast("int").alias("protocol"), manifest.alias("manifest"))
    if not (bad := manifests.where(~F.col("protocol").eqNullSafe(F.lit(protocol)) | F.col("id").isNull() | F.col("language").isNull())).isEmpty():
        raise ValueError(f"scanner {bad.first()['id']!r} speaks another protocol or has no manifest")
    ended = lines.where(F.get_json_object("line", "$.result.completed") == "true").select("session").distinct()
    if not (open_ := lines.select("session").distinct().join(ended, "session", "left_anti")).isEmpty():
        raise ValueError(f"session {open_.first()['session']!r} did not end")
    sent = lines.where(F.get_json_object("line", "$.method") == "scan/contribution").join(manifests.select("session", "language"), "session").select("language", F.get_json_object("line", "$.params").alias("line"))
    good, refused = decode(sent)
    return good, refused, manifests.drop("session", "protocol")


def scanner_set_hash(manifests: DataFrame) -> DataFrame:
    """One hash over the few scanners' manifests, by id."""
    each = F.struct("id", "version", "manifest")
    return manifests.agg(F.sha2(F.to_json(F.array_sort(F.collect_list(each))), 256).alias("scanner_set_hash"))


def numbered(origins: dict[str, DataFrame]) -> DataFrame:
    """Diagnostics of all origins (``owner_key, severity, code, message``), each with a number of its own within its owner: ``id, origin, ...``."""
    from functools import reduce

    from pyspark.sql import Window

    rows = reduce(DataFrame.unionByName, [df.select("owner_key", "severity", "code", "message", F.lit(i).alias("place"), F.lit(name).alias("origin")) for i, (name, df) in enumerate(origins.items())])
    order = Window.partitionBy("owner_key").orderBy("place", "severity", "code", "message")
    return rows.withColumn("number", F.row_number().over(order)).select(F.concat_ws(":", F.coalesce("owner_key", F.lit("")), "number").alias("id"), "origin", "owner_key", "severity", "code", "message", "number")
