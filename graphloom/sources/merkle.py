"""A hash tree over a listing of files: equal subtrees are equal listings, so two are compared from the root down.

A path's leaf is the first hex digits of its digest, as many as keep leaves near ``LEAF`` paths; a leaf's hash is over its sorted
``path=hash`` lines, and a node's over the hashes of its sixteen children at most.  No row but a leaf's lines grows with the listing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..storage import stored

#: Paths of a leaf, about.
LEAF = 256
SEPARATOR = "\n"


def depth_for(files: int, leaf: int = LEAF) -> int:
    """Digits of a leaf's name, one at least."""
    depth = 1
    while files > leaf * 16**depth:
        depth += 1
    return depth


def leaf_of(path: Column, depth: int) -> Column:
    return F.substring(F.md5(path.cast("binary")), 1, depth)


def _hash(lines: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(F.collect_list(lines)), SEPARATOR).cast("binary"), 256)


def tree(files: DataFrame, depth: int | None = None) -> DataFrame:
    """``depth, node, hash`` of every node; the root has depth 0 and the empty name.  ``files``: relative_path, content_hash.  An empty listing has no nodes."""
    depth = depth_for(files.count()) if depth is None else depth
    line = F.concat("relative_path", F.lit("="), "content_hash")
    level = stored(files.groupBy(leaf_of(F.col("relative_path"), depth).alias("node")).agg(_hash(line).alias("hash")).select(F.lit(depth).alias("depth"), "node", "hash"), "tree")
    out = level
    for d in range(depth - 1, -1, -1):
        child = F.concat("node", F.lit("="), "hash")
        level = stored(level.groupBy(F.substring("node", 1, d).alias("up")).agg(_hash(child).alias("hash")).select(F.lit(d).alias("depth"), F.col("up").alias("node"), "hash"), "tree")
        out = out.unionByName(level)
    return out


def root(nodes: DataFrame) -> DataFrame:
    return nodes.where("depth = 0").select(F.col("hash").alias("input_hash"))


def differing_leaves(before: DataFrame, after: DataFrame, depth: int) -> DataFrame:
    """``node`` of the leaves that differ between two trees of one depth; a level is looked at only below nodes that differ."""
    at = lambda t, d: t.where(F.col("depth") == d).select("node", "hash")
    open_ = None
    for d in range(depth + 1):
        a, b = at(before, d), at(after, d)
        if open_ is not None:
            below = F.substring("node", 1, d - 1)
            a, b = (t.join(open_, below == F.col("up"), "left_semi") for t in (a, b))
        both = a.withColumnRenamed("hash", "x").join(b.withColumnRenamed("hash", "y"), "node", "full_outer").where(~F.col("x").eqNullSafe(F.col("y")))
        level = stored(both.select("node"), "differing")
        if level.isEmpty():
            return level
        open_ = level.withColumnRenamed("node", "up")
    return level


def drift(listing: DataFrame, files: DataFrame, leaf: int = LEAF) -> tuple[DataFrame, DataFrame]:
    """Paths that differ (``relative_path, change``), and the leaves that were joined to find them; others aren't."""
    from ..ingest.incremental import drift as joined

    depth = depth_for(max(listing.count(), files.count()), leaf)
    leaves = differing_leaves(tree(files, depth), tree(listing, depth), depth)
    of = lambda df: df.withColumn("node", leaf_of(F.col("relative_path"), depth)).join(leaves, "node", "left_semi").drop("node")
    return joined(of(listing), of(files)), leaves
