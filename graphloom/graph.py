"""A graph snapshot as DataFrames."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, fields

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import schema as S


class Later:
    """A table that is made when something first reads it."""

    def __init__(self, make: Callable[[], DataFrame]):
        self._make, self._made = make, None

    def get(self) -> DataFrame:
        if self._made is None:
            self._made = self._make()
        return self._made


@dataclass(frozen=True)
class Graph:
    """Tables of one project at one scan; every query is a function of these.  A table may be given as ``Later``."""

    nodes: DataFrame
    edges: DataFrame
    files: DataFrame
    classifications: DataFrame
    boundaries: DataFrame
    memberships: DataFrame
    diagnostics: DataFrame | None = None
    annotations: DataFrame | None = None
    extras: dict[str, DataFrame] = field(default_factory=dict)

    def __getattribute__(self, name: str):
        value = object.__getattribute__(self, name)
        return value.get() if isinstance(value, Later) else value

    @property
    def spark(self) -> SparkSession:
        return self.nodes.sparkSession

    def following(self, kinds: list[str], min_confidence: str = "possible") -> DataFrame:
        """Edges of these kinds at this confidence or above, with ``rank``; both filters reach the scan."""
        out = self.edges.where(F.col("kind").isin(kinds)).withColumn("rank", S.confidence_rank())
        low = S.least_rank(min_confidence)
        return out.where(F.col("rank") >= low) if low > 1 else out

    def with_tables(self, **tables) -> Graph:
        """The graph with other tables; those that stay aren't made for it."""
        return Graph(**{f.name: object.__getattribute__(self, f.name) for f in fields(self)} | tables)

    def with_edges(self, edges: DataFrame) -> Graph:
        return self.with_tables(edges=edges)

    @staticmethod
    def of(spark: SparkSession, **rows: list) -> Graph:
        """A small graph from rows, as tests use it."""
        kinds = {"nodes": S.NODES, "edges": S.EDGES, "files": S.FILES, "classifications": S.CLASSIFICATIONS, "boundaries": S.BOUNDARIES, "memberships": S.MEMBERSHIPS, "diagnostics": S.DIAGNOSTICS, "annotations": S.ANNOTATIONS}
        return Graph(**{k: spark.createDataFrame([tuple(r.get(c) for c in s.names) for r in rows.get(k, [])], s) for k, s in kinds.items()})


def is_external(kind: str = "kind", origin: str = "origin") -> F.Column:
    return F.col(kind).startswith("external_") | F.col(origin).isin("external", "unresolved")


def flag(attribute: str, column: str = "attributes_json") -> F.Column:
    """A boolean attribute; absent means false."""
    return F.coalesce(F.get_json_object(F.col(column), f"$.{attribute}") == "true", F.lit(False))


def is_script() -> F.Column:
    """A module whose body something outside runs."""
    return (F.col("kind") == "module") & flag("executable")


def repository_wide() -> F.Column:
    """A path boundary that is empty once slashes are trimmed covers everything, and so separates nothing."""
    return (F.col("matcher_type") == "path_prefix") & (F.trim(F.coalesce(F.col("matcher_value"), F.lit("")), F.lit("/")) == "")
