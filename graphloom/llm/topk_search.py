"""Exact top-k search by inner product over a bit-sliced index.

Components are quantised to integers.  The index keeps, for blocks of rows ordered by id,
one bitmap for each bit of each component (shifted to be non-negative).  A query's
score over a whole block is a sum of shifted slices: carry-save adders on bitmaps
reduce all slices of equal weight to one, so 64 rows are added by each word operation,
and negative coefficients take the complemented slice.  The result is itself bit-sliced.  Top
rows are selected from the most significant slice downward: rows with the bit stay while
they are enough, else they are in and the search goes on among the others.  What ties after the last
slice is the boundary, resolved exactly by the smaller id.  Each pair of a query block and an index block is
one unit of work; a block's top rows are merged by query.

Defined results.  Vectors that are null or hold a null or non-finite component take no part.
Vectors of different length are compared over the longer one, missing components counting 0.
Rows that share an id are all candidates of other queries, never of their own, and as a query
the least of them counts.  Ids that are null take no part.  Scores that could pass 62 bits raise an
error.  Empty tables give an empty result, and extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored, table

SCALE = 64.0
TOP = 20
#: Query rows: those whose id this divides.
EVERY = 20
#: Rows of an index block and queries of a query block.
ROWS, QUERIES = 32768, 256

_UNIT = pa.schema([("kind", pa.int32()), ("ids", pa.binary()), ("width", pa.int32()), ("low", pa.int64()), ("bits", pa.int32()), ("data", pa.binary())])
_UNIT_DDL = "kind int, ids binary, width int, low long, bits int, data binary"


def quantised(rows: DataFrame, scale: float = SCALE) -> DataFrame:
    """``vec_id`` and the integer components ``q``, without vectors that take no part."""
    q = F.transform("embedding", lambda x: F.floor(x.cast("double") * scale))
    ok = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()).where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), q.alias("q"))


def _matrix(batches: list[pa.RecordBatch]) -> tuple[np.ndarray, np.ndarray]:
    """Ids and components, ordered by id."""
    ids = np.concatenate([b.column("vec_id").to_numpy() for b in batches])
    vectors = [v for b in batches for v in b.column("q").to_pylist()]
    out = np.zeros((len(ids), max(map(len, vectors), default=0)), dtype=np.int64)
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    order = np.argsort(ids, kind="stable")
    return ids[order], out[order]


def slices(x: np.ndarray) -> tuple[int, int, np.ndarray]:
    """The shift, the number of bits, and bitmaps ``[component, bit, word]``."""
    low = int(x.min()) if x.size else 0
    bits = max(1, int(x.max() - low).bit_length()) if x.size else 1
    words = -(-len(x) // 64)
    out = np.zeros((x.shape[1], bits, words * 8), dtype=np.uint8)
    shifted = (x - low).T
    for b in range(bits):
        packed = np.packbits((shifted >> b & 1).astype(np.uint8), axis=1, bitorder="little")
        out[:, b, : packed.shape[1]] = packed
    return low, bits, out.view(np.uint64)


def index_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, n = [], 0

    def block() -> pa.RecordBatch:
        ids, x = _matrix(held)
        low, bits, maps = slices(x)
        return pa.RecordBatch.from_pylist([{"kind": 0, "ids": ids.tobytes(), "width": x.shape[1], "low": low, "bits": bits, "data": maps.tobytes()}], schema=_UNIT)

    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n >= ROWS:
            yield block()
            held, n = [], 0
    if n:
        yield block()


def query_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for a in range(0, batch.num_rows, QUERIES):
            ids, x = _matrix([batch.slice(a, QUERIES)])
            yield pa.RecordBatch.from_pylist([{"kind": 1, "ids": ids.tobytes(), "width": x.shape[1], "low": 0, "bits": 0, "data": x.tobytes()}], schema=_UNIT)


def add_slices(columns: list[list[np.ndarray]]) -> list[np.ndarray]:
    """Sum of weighted bitmaps as one bitmap per weight: ``columns[w]`` holds those of weight 2**w."""
    out, w = [], 0
    while w < len(columns):
        now = columns[w]
        if w + 1 == len(columns) and len(now) > 1:
            columns.append([])
        while len(now) > 2:
            a, b, c = now.pop(), now.pop(), now.pop()
            x = a ^ b
            columns[w + 1].append((a & b) | (x & c))
            x ^= c
            now.insert(0, x)
        if len(now) == 2:
            a, b = now
            columns[w + 1].append(a & b)
            now = [a ^ b]
        out.append(now[0] if now else None)
        w += 1
    return out


def select_top(total: list[np.ndarray], among: np.ndarray, k: int) -> np.ndarray:
    """Row numbers of the k greatest sums, ties to the lower row."""
    inside, need = np.zeros_like(among), k
    if int(np.bitwise_count(among).sum()) <= k:
        return np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little"))
    for s in reversed(total):
        if s is None:
            continue
        with_bit = among & s
        n = int(np.bitwise_count(with_bit).sum())
        if n >= need:
            among = with_bit
        else:
            inside |= with_bit
            need -= n
            among = among & ~s
    sure = np.flatnonzero(np.unpackbits(inside.view(np.uint8), bitorder="little"))
    edge = np.flatnonzero(np.unpackbits(among.view(np.uint8), bitorder="little"))[:need]
    return np.concatenate([sure, edge])


class Block:
    def __init__(self, row: dict):
        self.ids = np.frombuffer(row["ids"], dtype=np.int64)
        self.low, self.bits, self.width = row["low"], row["bits"], row["width"]
        words = -(-len(self.ids) // 64)
        self.maps = np.frombuffer(row["data"], dtype=np.uint64).reshape(self.width, self.bits, words)
        self.rest = ~self.maps
        self.all = np.zeros(words * 8, dtype=np.uint8)
        full = np.packbits(np.ones(len(self.ids), dtype=np.uint8), bitorder="little")
        self.all[: len(full)] = full
        self.all = self.all.view(np.uint64)

    def search(self, own: int, q: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        q = q[: self.width]
        top = (1 << self.bits) - 1
        reach = int(np.abs(q).sum()) * max(abs(self.low), abs(self.low + top))
        if reach >= 1 << 62:
            raise ValueError("scores would not fit a long")
        columns: list[list[np.ndarray]] = [[] for _ in range(int(np.abs(q).max(initial=0)).bit_length() + self.bits)]
        shift = 0
        for d in np.flatnonzero(q):
            v = int(q[d])
            maps = self.maps[d] if v > 0 else self.rest[d]
            # v * x = |v| * (x - low) + v * low, and for v < 0 the complement stands for top - (x - low).
            shift += v * self.low if v > 0 else v * (self.low + top)
            for i in range(abs(v).bit_length()):
                if abs(v) >> i & 1:
                    for j in range(self.bits):
                        columns[i + j].append(maps[j])
        total = add_slices(columns)
        a, b = np.searchsorted(self.ids, [own, own + 1])
        among = self.all
        if a < b:
            mine = np.zeros(len(among) * 64, dtype=np.uint8)
            mine[a:b] = 1
            among = among & ~np.packbits(mine, bitorder="little").view(np.uint64)
        rows = select_top(total, among, k)
        score = np.full(len(rows), shift, dtype=np.int64)
        word, bit = rows >> 6, (rows & 63).astype(np.uint64)
        for w, s in enumerate(total):
            if s is not None:
                score += (s[word] >> bit & np.uint64(1)).astype(np.int64) << w
        return self.ids[rows], score


def search_blocks(batches: Iterator[pa.RecordBatch], k: int = TOP) -> Iterator[pa.RecordBatch]:
    """Units come ordered: each index block, then the query blocks that meet it."""
    block = None
    for batch in batches:
        for row in batch.select(_UNIT.names).to_pylist():
            if row["kind"] == 0:
                block = Block(row)
                continue
            ids = np.frombuffer(row["ids"], dtype=np.int64)
            x = np.frombuffer(row["data"], dtype=np.int64).reshape(len(ids), row["width"])
            query, vec, score = [], [], []
            for own, q in zip(ids, x, strict=True):
                v, s = block.search(int(own), q, k)
                query.append(np.full(len(v), own))
                vec.append(v)
                score.append(s)
            if query:
                yield pa.RecordBatch.from_pydict({"query_id": np.concatenate(query), "vec_id": np.concatenate(vec), "score": np.concatenate(score)})


def top_k(rows: DataFrame, queries: DataFrame, k: int = TOP, scale: float = SCALE) -> DataFrame:
    """``query_id, rank, vec_id, score`` for each of ``queries`` against all of ``rows`` (both ``vec_id, embedding``)."""
    spark = rows.sparkSession
    data = quantised(rows, scale)
    asked = quantised(queries, scale).groupBy("vec_id").agg(F.min("q").alias("q"))
    blocks = max(1, -(-rows.count() // ROWS))
    index = stored(data.repartition(blocks).mapInArrow(index_blocks, _UNIT_DDL).withColumn("block", F.monotonically_increasing_id()), "slices")
    numbers = [r["block"] for r in index.select("block").collect()]
    if not numbers:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    # Each index block meets the queries in so many groups that all cores have work.
    groups = max(1, -(-4 * spark.sparkContext.defaultParallelism // len(numbers)))
    met = asked.repartition(groups).mapInArrow(query_blocks, _UNIT_DDL).withColumn("grp", (F.monotonically_increasing_id() + F.spark_partition_id()) % groups)
    units = index.withColumn("grp", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select("block", F.col("grp").cast("long").alias("grp"), *_UNIT.names).unionByName(
        met.withColumn("block", F.explode(F.array(*[F.lit(n) for n in numbers]))).select("block", "grp", *_UNIT.names)
    )
    found = units.repartition(len(numbers) * groups, "block", "grp").sortWithinPartitions("block", "grp", "kind").mapInArrow(lambda it: search_blocks(it, k), "query_id long, vec_id long, score long")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return top_k(rows, rows.where(F.col("vec_id") % EVERY == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(CAST(x AS DOUBLE)))) = 0),
s AS (
  SELECT a.vec_id AS query_id, b.vec_id, CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 20 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""
