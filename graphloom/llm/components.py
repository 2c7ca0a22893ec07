"""Connected components of an edge table, by alternating large-star and small-star steps.

No edge or label ever reaches the driver; each round is a pair of joins by node,
written to the shared folder.  Stars and chains of any size finish in a number of
rounds logarithmic in the component's size.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over each batch: the same connections in fewer edges, each towards the least node."""
    for batch in batches:
        up: dict[int, int] = {}

        def root(x: int, up: dict[int, int] = up) -> int:
            while (y := up.setdefault(x, x)) != x:
                up[x] = x = up[y] if y in up else y
            return x

        for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(a), root(b)
            if a != b:
                up[max(a, b)] = min(a, b)
        pairs = [(x, root(x)) for x in up]
        pairs = [(x, y) for x, y in pairs if x != y]
        yield pa.RecordBatch.from_pydict({"u": pa.array([x for x, _ in pairs], pa.int64()), "v": pa.array([y for _, y in pairs], pa.int64())})


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges ``u > v``.  Large: neighbours above a node go to its least neighbour; small: the node and those below."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        return both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    joined = edges.join(least, "u")
    return joined.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame, rounds: int = 64) -> DataFrame:
    """``node, component`` for every node of ``edges (u, v)``, both long; a component is named by its least node."""
    now = stored(edges.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).mapInArrow(forest, "u long, v long"), "edges")
    state = None
    for _ in range(rounds):
        now = stored(_star(_star(now, True), False), "edges")
        # Done when every node has one edge and no target has an edge of its own.
        mark = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(mark) == state:
            return now.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(now.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
        state = tuple(mark)
    raise RuntimeError("components did not settle")
