"""Vocabularies, bounds and table schemas of the architecture graph.

The vocabularies are fixed values: query results depend on exactly these members.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Edge kinds that a flow follows, those that an impact follows besides, and those that break ties between paths.
FLOW_KINDS = ["routes_to", "calls", "dispatches", "handles", "listens_to", "constructs", "injects", "binds", "observes", "depends_on", "imports", "uses_middleware"]
IMPACT_KINDS = [*FLOW_KINDS, "references", "extends", "implements", "returns", "exports", "re_exports", "uses_trait"]
SEMANTIC_KINDS = ["routes_to", "dispatches", "handles", "listens_to", "binds", "observes", "uses_middleware"]
INHERITANCE_KINDS = ["implements", "extends"]
CONFIDENCES = ["possible", "probable", "certain"]
#: Kinds that can be dead-code candidates.
CANDIDATE_KINDS = ["class", "interface", "trait", "enum", "function", "method", "module"]
ENTRY_KINDS = ["route", "command"]
ENTRY_ROLES = ["application.controller", "application.command", "laravel.controller", "laravel.command", "laravel.job", "application.entry_point"]
TEST_ROLE = "quality.test_module"
TOOL_ROLE = "tooling.config"
# Roles whose components something outside the graph reaches.
CONVENTION_ROLES = ["application.controller", "application.command", "application.entry_point", "laravel.controller", "laravel.command", "laravel.job", "laravel.listener", TEST_ROLE, TOOL_ROLE]
SNAPSHOT_TABLES = ["files", "nodes", "edges", "classifications", "boundaries", "boundary_memberships"]

_S, _L, _I = T.StringType(), T.LongType(), T.IntegerType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


NODES = _struct(id=_S, language=_S, kind=_S, canonical_name=_S, display_name=_S, parent_id=_S, file_id=_S, start_line=_I, end_line=_I, origin=_S, confidence=_S, attributes_json=_S)
EDGES = _struct(id=_S, kind=_S, source_id=_S, target_id=_S, file_id=_S, start_line=_I, origin=_S, confidence=_S)
FILES = _struct(id=_S, relative_path=_S, content_hash=_S, size=_L, language=_S, line_count=_L)
CLASSIFICATIONS = _struct(node_id=_S, role=_S, origin=_S, confidence=_S, rule_id=_S)
BOUNDARIES = _struct(id=_S, name=_S, matcher_type=_S, matcher_value=_S, source=_S)
MEMBERSHIPS = _struct(boundary_id=_S, node_id=_S)
DIAGNOSTICS = _struct(id=_S, severity=_S, code=_S, message=_S)
ANNOTATIONS = _struct(canonical_name=_S, kind=_S, value=_S)
CHURN = _struct(path=_S, commit_count=_L, authors=T.ArrayType(_S), last_changed_at=_S)
CONTRIBUTION = T.StructType([
    T.StructField("owner_key", _S),
    T.StructField("nodes", T.ArrayType(_struct(local_id=_S, kind=_S, canonical_name=_S, display_name=_S, origin=_S, confidence=_S, start_line=_I, end_line=_I, attributes=_S))),
    T.StructField("edges", T.ArrayType(_struct(kind=_S, source=_S, target=_S, origin=_S, confidence=_S, start_line=_I))),
    T.StructField("diagnostics", T.ArrayType(_struct(severity=_S, code=_S, message=_S))),
])


def confidence_rank(column: str | Column = "confidence") -> Column:
    """3 for certain, 2 for probable, 1 for anything else."""
    c = F.col(column) if isinstance(column, str) else column
    return F.when(c == "certain", 3).when(c == "probable", 2).otherwise(1)


def confidence_name(rank: Column) -> Column:
    return F.when(rank >= 3, "certain").when(rank == 2, "probable").otherwise("possible")


def least_rank(confidence: str) -> int:
    if confidence not in CONFIDENCES:
        raise ValueError(f"unknown confidence {confidence!r}")
    return CONFIDENCES.index(confidence) + 1


def between(name: str, value: int, low: int, high: int) -> int:
    """Limits are rejected, never clamped."""
    if not low <= value <= high:
        raise ValueError(f"{name} must be from {low} to {high}")
    return value


def kinds_of(kinds: list[str] | None, allowed: list[str]) -> list[str]:
    """The edge kinds asked for: at most 20, all allowed; none given means all."""
    if not kinds:
        return allowed
    if len(kinds) > 20 or set(kinds) - set(allowed):
        raise ValueError(f"edge kinds must be among {allowed}")
    return kinds
