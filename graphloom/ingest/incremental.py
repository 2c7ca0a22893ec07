"""Incremental scans: cache hits, keyed upserts, pruning, snapshots and their retention."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def partition_cache(files: DataFrame, cache: DataFrame, scanner_version: str, configuration: str, force: bool = False) -> DataFrame:
    """Each file as hit, added or changed.  ``cache``: relative_path, content_hash, scanner_version, configuration_hash."""
    old = cache.select("relative_path", F.col("content_hash").alias("old_hash"), F.col("scanner_version").alias("old_version"), F.col("configuration_hash").alias("old_configuration"))
    same = (F.col("old_hash") == F.col("content_hash")) & (F.col("old_version") == scanner_version) & (F.col("old_configuration") == configuration) & F.lit(not force)
    return files.join(old, "relative_path", "left").withColumn("state", F.when(F.col("old_hash").isNull(), "added").when(same, "hit").otherwise("changed")).drop("old_hash", "old_version", "old_configuration")


def deleted(files: DataFrame, cache: DataFrame) -> DataFrame:
    return cache.join(files, "relative_path", "left_anti").select("relative_path")


def unchanged(files: DataFrame, cache: DataFrame, scanner_version: str, configuration: str, explicit_boundaries: bool = False) -> bool:
    """Whether a scan would find what is there: every file a hit, none gone, and no explicit boundaries to assign anew."""
    if explicit_boundaries:
        return False
    return partition_cache(files, cache, scanner_version, configuration).where("state <> 'hit'").isEmpty() and deleted(files, cache).isEmpty()


def audit(requested: DataFrame, received: DataFrame) -> DataFrame:
    """Owners omitted, misattributed or duplicated among contributions: ``owner_key, problem``."""
    asked = requested.select(F.col("relative_path").alias("owner_key")).distinct().withColumn("asked", F.lit(True))
    got = received.groupBy("owner_key").agg(F.count(F.lit(1)).alias("n"))
    both = asked.join(got, "owner_key", "full_outer")
    problem = F.when(F.col("n").isNull(), "omitted").when(F.col("asked").isNull(), "misattributed").when(F.col("n") > 1, "duplicated")
    return both.select("owner_key", problem.alias("problem")).where("problem is not null")


def upsert(old: DataFrame, new: DataFrame, key: str = "id", scan: str = "last_scan_id") -> DataFrame:
    """The new table with how each row came: written only where a column really differs; nulls compare as equal."""
    columns = [c for c in new.columns if c not in (key, scan)]
    before = old.select(key, F.struct(*columns).alias("before"))
    return new.withColumn("after", F.struct(*columns)).join(before, key, "left").withColumn("write", F.when(F.col("before").isNull(), "insert").when(~F.col("before").eqNullSafe(F.col("after")), "update").otherwise("keep")).drop("before", "after")


def insert_or_ignore(old: DataFrame, new: DataFrame) -> DataFrame:
    """Rows of both, each once: what is there stays as it is."""
    return old.unionByName(new).distinct()


def pruned(old: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """Keys to delete: there before, not after."""
    return old.join(new, key, "left_anti").select(key)


def stamp(rows: DataFrame, scan_id: str) -> DataFrame:
    return rows.withColumn("last_scan_id", F.lit(scan_id))


def within_retention(keep: int) -> Column:
    return F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("captured_at"), F.desc("scan_id"))) <= keep


def retain(snapshots: DataFrame, keep: int) -> DataFrame:
    """The newest ``keep`` snapshots of each project."""
    if not 0 <= keep <= 20:
        raise ValueError("retention must be from 0 to 20")
    return snapshots.withColumn("kept", within_retention(keep)).where("kept").drop("kept")


def removable_scans(scans: DataFrame, snapshots: DataFrame, active: DataFrame) -> DataFrame:
    """Complete scans that are neither active nor archived."""
    return scans.where("status = 'complete'").join(snapshots.select(F.col("scan_id").alias("id")), "id", "left_anti").join(active.select(F.col("active_scan_id").alias("id")), "id", "left_anti").select("id")


def stale_scans(scans: DataFrame, active: DataFrame, snapshots: DataFrame, now: str, older_than_hours: int = 24, most: int = 1000) -> DataFrame:
    """Old attempts that failed, were cancelled or never ended, and that nothing refers to."""
    if not 1 <= older_than_hours <= 8760:
        raise ValueError("older_than_hours must be from 1 to 8760")
    old = scans.where(F.col("status").isin("running", "failed", "cancelled")).where(F.col("started_at") < F.expr(f"timestamp '{now}' - INTERVAL {older_than_hours} HOURS"))
    return old.join(active.select(F.col("active_scan_id").alias("id")), "id", "left_anti").join(snapshots.select(F.col("scan_id").alias("id")), "id", "left_anti").orderBy("started_at", "id").limit(most).select("id")


def drift(listing: DataFrame, files: DataFrame) -> DataFrame:
    """Paths that differ between a listing and the scanned files: ``relative_path, change``."""
    now = listing.select("relative_path", F.col("content_hash").alias("now"))
    then = files.select("relative_path", F.col("content_hash").alias("then"))
    both = now.join(then, "relative_path", "full_outer")
    change = F.when(F.col("then").isNull(), "added").when(F.col("now").isNull(), "deleted").when(F.col("now") != F.col("then"), "changed")
    return both.select("relative_path", change.alias("change")).where("change is not null")


def staleness(listing: DataFrame | None, files: DataFrame | None, newer_attempt: bool = False, most_files: int = 500) -> str:
    """missing, stale, unverified or fresh."""
    if files is None:
        return "missing"
    if newer_attempt:
        return "stale"
    if listing is None or files.limit(most_files + 1).count() > most_files:
        return "unverified"
    return "fresh" if drift(listing, files).isEmpty() else "stale"


def integrity(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows that refer to nothing: ``relation, id``."""
    links = [("edges", "source_id", "nodes"), ("edges", "target_id", "nodes"), ("nodes", "file_id", "files"), ("memberships", "node_id", "nodes"), ("memberships", "boundary_id", "boundaries"), ("classifications", "node_id", "nodes")]
    out = None
    for table, key, target in links:
        if table in tables and target in tables:
            lost = tables[table].where(F.col(key).isNotNull()).join(tables[target].select(F.col("id").alias(key)), key, "left_anti").select(F.lit(f"{table}.{key}").alias("relation"), F.col(key).alias("id"))
            out = lost if out is None else out.unionByName(lost)
    return out


class SnapshotError(ValueError):
    """A snapshot that can't be read: unknown, or not archived completely."""


class SnapshotStore:
    """Snapshots as ``scan_id=`` partitions of Parquet tables.

    A scan is published by a pointer of its own, written last and never changed; the newest pointer tells what is
    active, so a reader always sees one.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def write(self, scan_id: str, tables: dict[str, DataFrame], most_rows: int | None = None) -> bool:
        """Archives a scan and publishes it.  Only if ``most_rows`` is given may a table have too many; then the pointer moves alone, and False is returned."""
        complete = most_rows is None or all(t.limit(most_rows + 1).count() <= most_rows for t in tables.values())
        if complete:
            for name, df in tables.items():
                df.write.mode("overwrite").parquet(f"{self.root}/{name}/scan_id={scan_id}")
        number = self._pointers().agg(F.max("number")).first()[0]
        row = [(scan_id, complete, 1 if number is None else number + 1, sorted(tables))]
        self.spark.createDataFrame(row, "scan_id string, complete boolean, number long, tables array<string>").coalesce(1).write.mode("append").parquet(f"{self.root}/_published")
        return complete

    def _pointers(self) -> DataFrame:
        schema = "scan_id string, complete boolean, number long, tables array<string>"
        hadoop = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.root}/_published")
        if not hadoop.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop):
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/_published")

    def snapshots(self) -> DataFrame:
        """``scan_id, complete, number``: each scan as it was published last."""
        return self._pointers().groupBy("scan_id").agg(F.max_by("complete", "number").alias("complete"), F.max("number").alias("number"))

    def active(self) -> str:
        row = self._pointers().orderBy(F.desc("number")).first()
        if row is None:
            raise SnapshotError("no snapshot is published")
        return row["scan_id"]

    def read(self, name: str, scan_id: str | None = None) -> DataFrame:
        """A table of a complete snapshot, the active one by default."""
        scan = scan_id or self.active()
        row = self._pointers().where(F.col("scan_id") == scan).orderBy(F.desc("number")).first()
        if row is None:
            raise SnapshotError(f"snapshot {scan!r} is unknown")
        if not row["complete"]:
            raise SnapshotError(f"snapshot {scan!r} is not archived completely")
        if name not in row["tables"]:
            raise SnapshotError(f"snapshot {scan!r} has no table {name!r}")
        return self.spark.read.parquet(f"{self.root}/{name}/scan_id={scan}")

    def tables(self, scan_id: str | None = None) -> list[str]:
        scan = scan_id or self.active()
        row = self._pointers().where(F.col("scan_id") == scan).orderBy(F.desc("number")).first()
        return row["tables"] if row else []


def annotate(annotations: DataFrame, canonical_name: str, kind: str, value: str | None, remove: bool = False) -> DataFrame:
    """Annotations with one put in, replaced or taken out; keyed by name and kind, so they outlive scans."""
    if kind not in ("intended_boundary", "confirmed_dead", "false_positive", "note"):
        raise ValueError("unknown annotation kind")
    rest = annotations.where(~((F.col("canonical_name") == canonical_name) & (F.col("kind") == kind)))
    if remove:
        return rest
    return rest.unionByName(annotations.sparkSession.createDataFrame([(canonical_name, kind, value)], "canonical_name string, kind string, value string"))
