"""A graph that is kept up with its files: a scan reads changed files and decides again only what they can touch.

What a file states is stored as facts.  What was decided from facts is stored beside them: declarations by id, compositions and
return types by reference, the decision on each distinct reference with how many facts use it, and what that decision was
read from.  A change compares these for the files that changed, which gives the declarations that came or went and
the compositions and return types that differ.  References that were read from one of those are decided again, with
those that are new; relationships are made again in files that changed and in files with a reference whose decision
came out differently.  The result equals a reconciliation of all files.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..storage import stored
from . import reconcile, resolution
from .contributions import numbered
from .incremental import deleted, partition_cache
from .store import BucketStore, Change

CACHE = "relative_path string, content_hash string, scanner_version string, configuration_hash string"


@dataclass(frozen=True)
class Work:
    """What a scan has to do.  ``changed``: files that are new or differ; ``gone``: paths that are no more."""

    changed: DataFrame
    gone: DataFrame
    nothing: bool


@dataclass(frozen=True)
class Done:
    """What a scan did, in rows."""

    number: int
    files: int = 0
    references: int = 0
    decided_again: int = 0
    files_linked_again: int = 0


def _differences(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    return before.subtract(after).unionByName(after.subtract(before)).select(column).distinct()


class Maintained:
    """The graph of one project in a store."""

    def __init__(self, store: BucketStore, project: str):
        self.store, self.project = store, project

    def work(self, files: DataFrame, scanner_version: str, configuration: str, force: bool = False) -> Work:
        """What differs from the files that were scanned; ``files``: relative_path, content_hash and more."""
        cache = self.store.read("cache") if self.store.has("cache") else files.sparkSession.createDataFrame([], CACHE)
        changed = stored(partition_cache(files, cache, scanner_version, configuration, force).where("state <> 'hit'").drop("state"), "changed")
        gone = stored(deleted(files, cache), "gone")
        return Work(changed, gone, self.store.has("cache") and changed.isEmpty() and gone.isEmpty())

    def scan(self, work: Work, contributions: DataFrame, scanner_version: str, configuration: str) -> Done:
        """Brings in the facts of ``work.changed`` (``language`` and the contribution schema) and takes out what went; publishes all at once."""
        if work.nothing:
            return Done(self.store.manifest()["number"])
        change = self.store.begin()
        nodes, edges, told = reconcile.explode_contributions(contributions)
        nodes, edges, told = (stored(x, "facts") for x in (reconcile.identified(nodes, self.project), edges, told))
        changed = work.changed.select(F.col("relative_path").alias("file"))
        reconcile.assert_complete(nodes.select("file").unionByName(edges.select("file")), "file", changed, "evidence file", "file")
        if not reconcile.local_conflicts(nodes).isEmpty():
            raise ValueError("a local id names several symbols")
        touched = stored(changed.unionByName(work.gone.select(F.col("relative_path").alias("file"))).distinct(), "touched")
        old_nodes, old_edges = (stored(self._before(t, like, of=touched), "facts") for t, like in (("node_facts", nodes), ("edge_facts", edges)))
        change.put("node_facts", "file", nodes, touched)
        change.put("edge_facts", "file", edges, touched)
        change.put("told", "file", told, touched)

        keys = [self._declare(change, old_nodes, nodes), self._compose(change, old_edges, edges), self._return(change, old_edges, edges)]
        self._sources_exist(change, edges, keys[0])
        again, moved, counts = self._decide(change, old_edges, edges, reduce(DataFrame.unionByName, keys))
        linked = self._link(change, touched, moved)

        paths = work.changed.select("relative_path", "content_hash", F.lit(scanner_version).alias("scanner_version"), F.lit(configuration).alias("configuration_hash"))
        change.put("cache", "relative_path", paths, touched.withColumnRenamed("file", "relative_path"))
        return Done(change.publish(), touched.count(), counts, again, linked)

    def _before(self, name: str, like: DataFrame, of: DataFrame | None = None) -> DataFrame:
        """A table as it was, empty where there was none."""
        if self.store.has(name):
            return self.store.read(name, of=of).select(*like.columns)
        return like.where("false")

    def _declare(self, change: Change, old: DataFrame, new: DataFrame) -> DataFrame:
        """Declarations of the ids that changed files declare or declared; gives the references that exist now or no longer (``key``)."""
        ids = stored(old.select("id").unionByName(new.select("id")).distinct(), "ids")
        ranked = stored(reconcile.ranked_nodes(change.read("node_facts").join(ids, "id", "left_semi")), "ranked")
        first = ranked.where("k = 1").drop("k", "first_file", "place")
        before = self._before("declared", first, of=ids)
        change.put("declared", "id", first, ids)
        change.put("duplicates", "id", reconcile.duplicates(ranked), ids)
        return _differences(before.select("ref"), first.select("ref"), "ref").select(F.concat(F.lit("n|"), "ref").alias("key"))

    def _compose(self, change: Change, old: DataFrame, new: DataFrame) -> DataFrame:
        return self._by_source(change, "links", old, new, F.col("kind").isin(resolution.COMPOSITION), resolution.links, "u|")

    def _return(self, change: Change, old: DataFrame, new: DataFrame) -> DataFrame:
        return self._by_source(change, "returned", old, new, F.col("kind") == "returns", resolution.returned, "r|")

    def _by_source(self, change: Change, name: str, old: DataFrame, new: DataFrame, kinds, made, prefix: str) -> DataFrame:
        """A table made of the relationships of each source, anew for the sources that changed files have or had; gives the sources that differ."""
        refs = stored(old.where(kinds).select("source").unionByName(new.where(kinds).select("source")).distinct(), "refs")
        after = stored(made(change.read("edge_facts").where(kinds).join(refs, "source", "left_semi")), name)
        sources = refs.withColumnRenamed("source", "ref")
        before = self._before(name, after, of=sources)
        change.put(name, "ref", after, sources)
        return _differences(before, after, "ref").select(F.concat(F.lit(prefix), "ref").alias("key"))

    def _sources_exist(self, change: Change, new: DataFrame, differing: DataFrame) -> None:
        """A relationship starts at a declared component; looked at where files changed, and where a declaration went."""
        refs = change.read("declared").select(F.col("ref").alias("source"))
        reconcile.assert_complete(new.select("source").distinct(), "source", refs, "edge source", "source")
        went = differing.select(F.expr("substr(key, 3)").alias("source")).join(refs, "source", "left_anti")
        if bad := change.read("edge_facts").join(went, "source", "left_semi").head(1):
            raise ValueError(f"edge source: {bad[0]['source']!r} is missing")

    def _decide(self, change: Change, old: DataFrame, new: DataFrame, keys: DataFrame) -> tuple[int, DataFrame, int]:
        """Decisions on the references that are new or were read from ``keys``; gives how many, those that came out differently, and how many there are."""
        spark = keys.sparkSession
        uses = old.groupBy("target").agg((-F.count(F.lit(1))).alias("more")).unionByName(new.groupBy("target").agg(F.count(F.lit(1)).alias("more"))).groupBy("target").agg(F.sum("more").alias("more")).where("target IS NOT NULL")
        uses = stored(uses, "uses")
        empty = spark.createDataFrame([], resolution.REFERENCES + ", uses long")
        # A change may also touch references of files that stay.
        read = stored((self.store.read("reads").join(keys, "key", "left_semi").select("target").distinct()) if self.store.has("reads") else uses.select("target").limit(0), "touched")
        concerned = uses.select("target").unionByName(read).distinct()
        before = self._before("references", empty, of=concerned)
        now = concerned.join(before, "target", "left").join(uses, "target", "left").withColumn("uses", F.coalesce("uses", F.lit(0)) + F.coalesce("more", F.lit(0))).drop("more")
        now = stored(now.join(read.withColumn("read", F.lit(True)), "target", "left"), "now")
        concerned = now.select("target")
        asked = stored(now.where("uses > 0 AND (status IS NULL OR read)").select("target", "uses"), "asked")
        known = resolution.Known(change.read("declared").select("ref", "id"), change.read("links"), change.read("returned"))
        decided, reads = resolution.resolve_references(asked.select("target"), known)
        decided = stored(decided, "decided")
        stays = now.where("uses > 0 AND status IS NOT NULL AND read IS NULL").select(*empty.columns)
        change.put("references", "target", decided.join(asked, "target").select(*empty.columns).unionByName(stays), concerned)
        ended = now.where("uses <= 0").select("target")
        change.put("reads", "target", reads, asked.select("target").unionByName(ended))
        was, is_ = (F.struct(*[F.col(f"{a}.{c}") for c in ("target_id", "status")]) for a in ("b", "d"))
        moved = decided.alias("d").join(before.alias("b"), F.col("d.target") == F.col("b.target")).where(~was.eqNullSafe(is_)).select("d.target")
        return asked.count(), moved, change.read("references").count()

    def _link(self, change: Change, touched: DataFrame, moved: DataFrame) -> int:
        """Relationships of files that changed and of those with a reference that came out differently; gives how many files."""
        facts = change.read("edge_facts")
        files = stored(touched.unionByName(facts.join(moved, "target", "left_semi").select("file")).distinct(), "files")
        some = change.read("edge_facts", of=files)
        source = change.read("declared").select(F.col("ref").alias("source"), F.col("id").alias("source_id"))
        pointed, _ = reconcile.pointed(some.join(source, "source"), change.read("references").drop("uses"))
        change.put("edges", "file", reconcile.collapse_edges(pointed, self.project), files)
        return files.count()

    def graph(self, number: int | None = None, discovery: DataFrame | None = None) -> dict[str, DataFrame]:
        """``nodes, edges, diagnostics`` as ``reconcile`` gives them."""
        read = lambda name: self.store.read(name, number)
        refs = read("references")
        nodes = read("declared").select(*reconcile.NODE_COLUMNS).unionByName(reconcile.external_nodes(refs), allowMissingColumns=True)
        edges = read("edges").select(*reconcile.EDGE_COLUMNS)
        told = read("told")
        owned = lambda df: df if "owner_key" in df.columns else df.withColumn("owner_key", F.lit(None).cast("string"))
        warnings = reconcile.duplicate_warnings(read("duplicates")).unionByName(reconcile.bad_references(refs))
        origins = {"scanner": told.withColumnRenamed("file", "owner_key"), "discovery": owned(discovery if discovery is not None else told.where("false").drop("file")), "reconciler": owned(warnings)}
        return {"nodes": nodes, "edges": edges, "diagnostics": numbered(origins)}
