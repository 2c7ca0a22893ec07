"""Whitening against a plain covariance over all rows, and on awkward tables."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from graphloom.llm import whitening

SCHEMA = "vec_id long, embedding array<float>, x string, n string, task int, row_block long"


def rows_of(spark, vectors, parts=3):
    return spark.createDataFrame([(i, v, "x", "x", 1, 1) for i, v in vectors], SCHEMA).repartition(parts)


def plainly(vectors):
    """Integers, exact deviations, and the eigenvalues and vectors of the covariance, from all rows at once."""
    x = [[math.floor(64.0 * float(np.float32(c))) + 1_000_000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x, strict=True)]
    deviation = [sum((n * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in x]
    z = np.array([[(n * a - s) / n for a, s in zip(row, sums, strict=True)] for row in x])
    v = sum(np.outer(r, r) for r in z) / n
    values, vectors = np.linalg.eigh(v)
    return deviation, z, values[::-1], vectors[:, ::-1], float(np.trace(v))


def made(n, d, seed=0, rank=None):
    rng = np.random.default_rng(seed)
    mixed = rng.normal(size=(n, rank or d)) @ rng.normal(size=(rank or d, d)) + rng.normal(size=d) * 5
    return [[float(np.float32(c)) for c in row] for row in mixed]


@pytest.mark.parametrize(("n", "d", "tile"), [(700, 10, 32), (2500, 40, 16), (300, 37, 8), (60, 3, 1), (20, 50, 32)])
def test_all_rows_and_components(spark, n, d, tile):
    vectors = made(n, d)
    got, fitted = whitening.whiten(rows_of(spark, list(enumerate(vectors))), tile=tile)
    deviation, z, values, own, trace = plainly(vectors)
    rows = sorted(got.collect(), key=lambda r: r["vec_id"])
    assert [int(r["deviation"]) for r in rows] == deviation and fitted.n == n
    k = min(32, d, n - 1)
    w = np.array([r["whitened"] for r in rows])
    assert w.shape == (n, k)
    assert np.allclose(fitted.values, values[:k], rtol=1e-9) and np.allclose(fitted.explained, values[:k] / trace, rtol=1e-9)
    assert np.allclose(np.abs(fitted.vectors.T @ own[:, :k]), np.eye(k), atol=1e-6)
    assert np.allclose(w, z @ fitted.vectors / np.sqrt(values[:k]), atol=1e-6)
    assert fitted.identity_error < 1e-8 and np.abs(np.cov(w.T, bias=True) - np.eye(k)).max() < 1e-8


def test_rows_that_take_no_part(spark):
    good = made(40, 4)
    odd = [None, [], [1.0, None, 2.0, 3.0], [float("nan"), 0.0, 0.0, 0.0], [float("inf"), 0.0, 0.0, 0.0], [1.0, -float("inf"), 2.0, 3.0], [1.0, 2.0], [1.0] * 6]
    rows = [*enumerate(good), *((100 + i, v) for i, v in enumerate(odd)), (7, good[7]), (None, good[0]), (None, None)]
    got, fitted = whitening.whiten(rows_of(spark, rows))
    deviation, *_ = plainly([*good, good[7], good[0]])
    found = got.select("vec_id", "deviation").collect()
    assert fitted.n == 42 and sorted(int(r["deviation"]) for r in found) == sorted(deviation)
    assert sorted((r["vec_id"] for r in found), key=lambda i: (i is not None, i)) == [None, 0, 1, 2, 3, 4, 5, 6, 7, 7, *range(8, 40)]


def test_directions_in_which_nothing_varies(spark):
    vectors = made(300, 12, rank=5)
    # Whole numbers stay whole when scaled, so the rank survives.
    whole = [[float(round(c)) for c in v[:5]] for v in vectors]
    doubled = [v + [3.0] + [2 * c for c in v] for v in whole]
    got, fitted = whitening.whiten(rows_of(spark, list(enumerate(doubled))))
    assert len(fitted.values) == 5 and fitted.identity_error < 1e-8 and got.count() == 300


def test_tables_without_components(spark):
    for rows in ([], [(1, None)], [(1, [1.0, 2.0])], [(i, [1.0, 2.0]) for i in range(9)]):
        got, fitted = whitening.whiten(rows_of(spark, rows))
        assert fitted is None and got.count() == 0 and got.columns == ["vec_id", "deviation", "whitened"]


def test_a_common_offset_costs_no_digits(spark):
    vectors = [[c + 30_000.0 for c in v] for v in made(500, 6)]
    _, fitted = whitening.whiten(rows_of(spark, list(enumerate(vectors))))
    assert np.allclose(fitted.values, plainly(vectors)[2], rtol=1e-10)


def test_large_deviations_stay_exact():
    fitted = whitening.Whitening(10**12 + 39, [7 * 10**17 + 11, 3 * 10**18 + 5], np.zeros((2, 0)), np.zeros(0), np.zeros(0))
    x = np.array([[700_000, 3_000_123], [1, 2**40]], dtype=np.int64)
    assert fitted.deviation(x) == [sum((fitted.n * int(a) - s) ** 2 for a, s in zip(row, fitted.sums, strict=True)) for row in x]


def test_a_component_out_of_range_is_told(spark):
    with pytest.raises(Exception, match="2\\^52 or more"):
        whitening.whiten(rows_of(spark, [(1, [1e30, 0.0]), (2, [1.0, 0.0])]))


def test_query(spark, tmp_path):
    vectors = made(400, 40)
    spark.createDataFrame([(i, v, 0) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    rows = whitening.query(spark, str(tmp_path)).orderBy("vec_id", "component").collect()
    deviation, z, values, _, trace = plainly(vectors)
    assert len(rows) == 400 * 32 and [r["component"] for r in rows[:32]] == list(range(1, 33))
    w = np.array([r["whitened"] for r in rows]).reshape(400, 32)
    assert np.abs(np.cov(w.T, bias=True) - np.eye(32)).max() < 1e-8
    assert [r["deviation"] for r in rows[::32]] == deviation and {r["n"] for r in rows} == {400}
    assert np.allclose([r["explained"] for r in rows[:32]], values[:32] / trace, rtol=1e-9)
    assert len({r["identity_error"] for r in rows}) == 1 and 0 <= rows[0]["identity_error"] < 1e-8


def test_empty_query(spark, tmp_path):
    spark.createDataFrame([], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    out = whitening.query(spark, str(tmp_path))
    assert out.count() == 0
    kinds = dict(out.dtypes)
    assert kinds == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}


def test_no_row_is_carried_whole_to_the_driver(spark):
    rows = whitening.stored(whitening.quantised(rows_of(spark, list(enumerate(made(2500, 40))))), "quantised")
    n, sums = whitening.totals(rows)
    centre = whitening.Whitening(n, sums, np.zeros((40, 0)), np.zeros(0), np.zeros(0))
    blocks = whitening.column_blocks(rows, centre, 16)
    assert blocks.groupBy("part").agg(F.sum("n")).collect() == [(p, 2500) for p in [r[0] for r in blocks.groupBy("part").agg(F.sum("n")).collect()]]
    assert whitening.tile_sums(whitening.tile_products(blocks)).count() == 6
