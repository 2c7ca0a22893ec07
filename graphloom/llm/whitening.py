"""Embedding whitening by a tiled covariance.

Components become integers; their number n and their exact sums S by dimension come first.  Rows,
stored once, are dealt into row-blocks of a batch each, and a row-block into column blocks of
``TILE`` dimensions, centred.  A tile key is a pair of column blocks: column blocks are shuffled by
row-block and joined to the pairs of the upper triangle, each pair is multiplied, products are summed per
tile within a task and then, dealt by tile, over all tasks.  The driver sees the assembled covariance alone
(dimensions squared, whatever the number of rows) and takes its eigenvectors.

Whitened components are the centred row projected on an eigenvector and divided by the root of its
eigenvalue.  What the whitened rows' covariance lacks of the identity is measured over all rows, not derived.

Exactness.  Sums, and the distance of a row from the mean, are integers throughout.  A row minus the mean is taken
as an integer minus a fraction below one, so a large common offset costs no digits.

Defined results.  Vectors that are null, empty, or hold a null or non-finite entry take no part; nor do those whose length isn't
that of most (of equally frequent ones the longest), as they have other dimensions.  Null ids stay.  Repeated rows
count each time.  Directions in which nothing varies (an eigenvalue of zero up to rounding) give no
component, so equal rows, a single row and an empty table give no rows.  Eigenvalues that tie come in any order, signs are free.
Scaled entries of 2^52 or more raise an error.  Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored, table

SCALE, SHIFT = 64.0, 1_000_000
COMPONENTS = 32
#: Dimensions of a column block.
TILE = 32
#: Bytes of tile sums that a task holds before it hands them on.
HELD = 64 << 20
#: Tasks that merge what others summed, before the last step.
MERGERS = 64


@dataclass
class Whitening:
    """What a fit learned: ``n`` rows, their sums, unit eigenvectors as columns, eigenvalues and their shares of the trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    explained: np.ndarray
    identity_error: float = float("nan")

    def centred(self, x: np.ndarray) -> np.ndarray:
        """``x - S/n`` in doubles, from the integer part of the mean and the rest."""
        whole, rest = self.mean()
        return (x - whole) - rest / float(self.n)

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        """``S`` divided by ``n``: quotient and remainder by dimension."""
        return np.array([s // self.n for s in self.sums], dtype=np.int64), np.array([s % self.n for s in self.sums], dtype=np.int64)

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ self.vectors / np.sqrt(self.values)

    def deviation(self, x: np.ndarray) -> list[int]:
        """The sum over dimensions of ``(n x - S)^2``, exact."""
        whole, rest = self.mean()
        y, n = x - whole, self.n
        reach = int(np.abs(y).max(initial=0))
        if len(rest) * reach * max(reach, n) >= 1 << 63:
            y, rest = y.astype(object), rest.astype(object)
        squares, mixed, constant = (y * y).sum(axis=1), (y * rest).sum(axis=1), sum(int(r) ** 2 for r in rest)
        return [n * n * int(a) - 2 * n * int(b) + constant for a, b in zip(squares, mixed, strict=True)]


def quantised(rows: DataFrame, scale: float = SCALE, shift: int = SHIFT) -> DataFrame:
    """``vec_id`` and the integer components ``x`` of the vectors that take part."""
    ok = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < float("inf")))
    # A vector left out is never scaled: null fails the test as well.
    usable = rows.select("vec_id", F.when(ok & (F.size("embedding") > 0), F.col("embedding")).alias("embedding")).where("embedding IS NOT NULL")

    def entry(c):
        v = c.cast("double") * scale
        return F.when(F.abs(v) < float(1 << 52), F.floor(v) + F.lit(shift)).otherwise(F.raise_error(F.lit("a scaled component is 2^52 or more")).cast("long"))

    usable = usable.select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", entry).alias("x"))
    lengths = usable.groupBy(F.size("x").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).limit(1).collect()
    return usable.where(F.size("x") == (lengths[0]["d"] if lengths else 0))


def _matrix(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)


def _task() -> int:
    context = TaskContext.get()
    return context.partitionId() if context else 0


def totals(rows: DataFrame) -> tuple[int, list[int]]:
    """The number of rows and the exact sums by dimension."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                # Entries are below 2^53 and a batch has a thousand rows at most.
                one = _matrix(batch).sum(axis=0).astype(object)
                n, sums = n + batch.num_rows, one if sums is None else sums + one
        if sums is not None:
            kind = pa.decimal128(38, 0)
            yield pa.RecordBatch.from_pydict({"n": pa.array([n], pa.int64()), "s": pa.array([[Decimal(int(v)) for v in sums]], pa.list_(kind))})

    parts = rows.select("x").mapInArrow(add, "n long, s array<decimal(38,0)>")
    by_dimension = parts.select("n", F.posexplode("s").alias("at", "s")).groupBy("at").agg(F.sum("n").alias("n"), F.sum("s").alias("s")).orderBy("at").collect()
    return (by_dimension[0]["n"], [int(r["s"]) for r in by_dimension]) if by_dimension else (0, [])


def column_blocks(rows: DataFrame, centre: Whitening, tile: int = TILE) -> DataFrame:
    """``row_block, part, n, body``: the centred doubles of a row-block in the dimensions of a part."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = _task() << 32
        for batch in batches:
            if not batch.num_rows:
                continue
            z = centre.centred(_matrix(batch))
            parts = range(-(-z.shape[1] // tile))
            bodies = [np.ascontiguousarray(z[:, p * tile : (p + 1) * tile]).tobytes() for p in parts]
            yield pa.RecordBatch.from_pydict({
                "row_block": pa.array([block] * len(parts), pa.int64()), "part": pa.array(parts, pa.int32()), "n": pa.array([batch.num_rows] * len(parts), pa.int32()), "body": pa.array(bodies, pa.binary()),
            })
            block += 1

    return rows.select("x").mapInArrow(cut, "row_block long, part int, n int, body binary")


def tile_products(blocks: DataFrame) -> DataFrame:
    """``i, j, task, body``: sums of the products of column blocks i and j, one or more for each task."""
    left = blocks.select("row_block", F.col("part").alias("i"), "n", F.col("body").alias("left"))
    right = blocks.select("row_block", F.col("part").alias("j"), F.col("body").alias("right"))

    def rows_of(sums: dict[tuple[int, int], np.ndarray]) -> pa.RecordBatch:
        keys = sorted(sums)
        return pa.RecordBatch.from_pydict({
            "i": pa.array([i for i, _ in keys], pa.int32()), "j": pa.array([j for _, j in keys], pa.int32()), "task": pa.array([_task()] * len(keys), pa.int32()),
            "body": pa.array([sums[k].tobytes() for k in keys], pa.binary()),
        })

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[int, int], np.ndarray] = {}
        held = 0
        for batch in batches:
            for i, j, n, a, b in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "n", "left", "right")), strict=True):
                product = np.frombuffer(a).reshape(n, -1).T @ np.frombuffer(b).reshape(n, -1)
                if (i, j) in sums:
                    sums[i, j] += product
                else:
                    sums[i, j] = product
                    held += product.nbytes
                    if held > HELD:
                        yield rows_of(sums)
                        sums, held = {}, 0
        if sums:
            yield rows_of(sums)

    pairs = left.join(right, "row_block").where("i <= j").select("i", "j", "n", "left", "right")
    return pairs.mapInArrow(multiply, "i int, j int, task int, body binary")


def tile_sums(products: DataFrame) -> DataFrame:
    """``i, j, body``: one row for each tile.  Dealt by tile and task first, then by tile; added in order of the tasks, one tile at a time in memory."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def row(key: tuple[int, int], task: int, total: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"i": pa.array([key[0]], pa.int32()), "j": pa.array([key[1]], pa.int32()), "task": pa.array([task], pa.int32()), "body": pa.array([total.tobytes()], pa.binary())})

        key, first, total = None, 0, None
        for batch in batches:
            for i, j, task, body in zip(*(batch.column(c).to_pylist() for c in ("i", "j", "task", "body")), strict=True):
                one = np.frombuffer(body)
                if key == (i, j):
                    total += one
                else:
                    if key is not None:
                        yield row(key, first, total)
                    key, first, total = (i, j), task, one.copy()
        if key is not None:
            yield row(key, first, total)

    for dealt in (["i", "j", F.pmod("task", F.lit(MERGERS))], ["i", "j"]):
        products = products.repartition(*dealt).sortWithinPartitions("i", "j", "task").mapInArrow(add, "i int, j int, task int, body binary")
    return products.select("i", "j", "body")


def covariance(rows: DataFrame, centre: Whitening, tile: int = TILE) -> np.ndarray:
    d = len(centre.sums)
    out = np.zeros((d, d))
    for i, j, body in tile_sums(tile_products(column_blocks(rows, centre, tile))).collect():
        wide = min(tile, d - j * tile)
        one = np.frombuffer(body).reshape(-1, wide) / centre.n
        out[i * tile : i * tile + len(one), j * tile : j * tile + wide] = one
        out[j * tile : j * tile + wide, i * tile : i * tile + len(one)] = one.T
    return out


def _merged(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> tuple[int, np.ndarray, np.ndarray]:
    """Count, mean and centred second moments of parts that were each centred on their own."""
    n, mean, moments = parts[0]
    for m, other, more in parts[1:]:
        away = other - mean
        moments = moments + more + np.outer(away, away) * (n * m / (n + m))
        mean, n = mean + away * (m / (n + m)), n + m
    return n, mean, moments


def identity_error(rows: DataFrame, fitted: Whitening) -> float:
    """The largest absolute entry of the whitened rows' covariance minus the identity, over all rows."""
    k = len(fitted.values)
    schema = "task int, n long, mean binary, moments binary"

    def out(n: int, mean: np.ndarray, moments: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"task": pa.array([_task()], pa.int32()), "n": pa.array([n], pa.int64()), "mean": pa.array([mean.tobytes()], pa.binary()), "moments": pa.array([moments.tobytes()], pa.binary())})

    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                w = fitted.whitened(_matrix(batch))
                mean = w.mean(axis=0)
                one = len(w), mean, (w - mean).T @ (w - mean)
                total = one if total is None else _merged([total, one])
        if total is not None:
            yield out(*total)

    def read(batch) -> list[tuple[int, np.ndarray, np.ndarray]]:
        return [(n, np.frombuffer(m), np.frombuffer(c).reshape(k, k)) for n, m, c in batch]

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                parts = read(zip(*(batch.column(c).to_pylist() for c in ("n", "mean", "moments")), strict=True))
                total = _merged(parts if total is None else [total, *parts])
        if total is not None:
            yield out(*total)

    dealt = rows.select("x").mapInArrow(summed, schema).repartition(MERGERS, "task").sortWithinPartitions("task")
    last = dealt.mapInArrow(merge, schema).orderBy("task").select("n", "mean", "moments").collect()
    n, _, moments = _merged(read(last))
    return float(np.abs(moments / n - np.eye(k)).max())


def fit(rows: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> Whitening | None:
    """The whitening of ``vec_id, x`` rows that are read several times; None where nothing varies."""
    n, sums = totals(rows)
    if n == 0:
        return None
    centre = Whitening(n, sums, np.zeros((len(sums), 0)), np.zeros(0), np.zeros(0))
    v = covariance(rows, centre, tile)
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    some = values[:components]
    some = some[some > max(values[0], 0.0) * len(values) * np.finfo(float).eps]
    if not len(some):
        return None
    out = Whitening(n, sums, np.ascontiguousarray(vectors[:, : len(some)]), some.copy(), some / np.trace(v))
    out.identity_error = identity_error(rows, out)
    return out


def transform(rows: DataFrame, fitted: Whitening) -> DataFrame:
    """``vec_id, deviation decimal(38,0), whitened array<double>`` of ``vec_id, x`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch)
                w = fitted.whitened(x)
                yield pa.RecordBatch.from_pydict({
                    "vec_id": batch.column("vec_id"), "deviation": pa.array(list(map(Decimal, fitted.deviation(x))), pa.decimal128(38, 0)),
                    "whitened": pa.ListArray.from_arrays(pa.array(np.arange(len(w) + 1) * w.shape[1], pa.int32()), pa.array(w.ravel())),
                })

    return rows.select("vec_id", "x").mapInArrow(run, "vec_id long, deviation decimal(38,0), whitened array<double>")


def whiten(embeddings: DataFrame, components: int = COMPONENTS, tile: int = TILE) -> tuple[DataFrame, Whitening | None]:
    """Fit on all usable rows and transform them."""
    rows = stored(quantised(embeddings), "quantised")
    fitted = fit(rows, components, tile)
    if fitted is None:
        return rows.where("false").select("vec_id", F.lit(None).cast("decimal(38,0)").alias("deviation"), F.lit(None).cast("array<double>").alias("whitened")), None
    return transform(rows, fitted), fitted


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, fitted = whiten(table(spark, sf_dir, "embeddings"))
    shares = F.lit([float(e) for e in fitted.explained]) if fitted else F.lit(None).cast("array<double>")
    return rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened")).select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n if fitted else 0).cast("long").alias("n"), F.col("deviation").cast("long").alias("deviation"), "whitened",
        F.get(shares, F.col("at")).alias("explained"), F.lit(fitted.identity_error if fitted else None).cast("double").alias("identity_error"),
    )
