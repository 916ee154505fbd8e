import numpy as np
import pytest
from pyspark.ml.functions import array_to_vector
from pyspark.ml.linalg import SparseVector, VectorUDT
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from framelens.operators import models as md
from framelens.operators import wide

SCHEMA = StructType([StructField("idx", LongType()), StructField("x", VectorUDT()), StructField("y", ArrayType(DoubleType()))])


def sparse_rows(spark, n, d, per_row, seed=0, parts=3):
    rng = np.random.default_rng(seed)
    dense, rows = np.zeros((n, d)), []
    for i in range(n):
        at = np.sort(rng.choice(d, per_row, replace=False))
        dense[i, at] = rng.normal(size=per_row) * (1 + 9 * (at < 2))
        rows.append((i, SparseVector(d, at.tolist(), dense[i, at].tolist())))
    y = dense[:, :40] @ rng.normal(size=(40, 3)) + rng.normal(size=(n, 3)) + 2
    table = spark.createDataFrame([(i, v, y[i].tolist()) for i, v in rows], SCHEMA).repartition(parts)
    return dense, y, table


@pytest.mark.parametrize("alpha", [0.0, 1.0])
def test_ridge_equals_the_closed_form(spark, alpha):
    x, y, table = sparse_rows(spark, 500, 120, 30)
    weights, constant = wide.ridge(table, "x", "y", 3, alpha)
    xc, yc = x - x.mean(0), y - y.mean(0)
    want = np.linalg.solve(xc.T @ xc + alpha * np.eye(120), xc.T @ yc)
    assert np.abs(weights - want).max() < 1e-6 and np.abs(constant - (y.mean(0) - x.mean(0) @ want)).max() < 1e-6


def test_ridge_takes_many_partitions_and_dense_rows(spark):
    x, y, table = sparse_rows(spark, 200, 40, 10)
    dense = spark.createDataFrame([(i, x[i].tolist(), y[i].tolist()) for i in range(200)], "idx long, x array<double>, y array<double>")
    dense = dense.select("idx", array_to_vector("x").alias("x"), "y").repartition(50)
    first, second = wide.ridge(table, "x", "y", 3, 1.0), wide.ridge(dense, "x", "y", 3, 1.0)
    assert np.allclose(first[0], second[0], atol=1e-8) and np.allclose(first[1], second[1], atol=1e-8)


def test_axes_equal_the_exact_plane(spark):
    x, _, table = sparse_rows(spark, 400, 300, 60)
    axes, variances, mean = wide.principal_axes(table, "x", 2)
    values, vectors = np.linalg.eigh(np.cov(x.T))
    assert np.allclose(variances, values[::-1][:2], rtol=1e-6) and np.allclose(mean, x.mean(0))
    assert np.abs(np.abs((axes * vectors[:, ::-1][:, :2]).sum(0)) - 1).max() < 1e-6


def test_wide_models_have_no_square_matrix(spark):
    """50,000 positions: their Gram matrix would take 20 GB."""
    x, y, table = sparse_rows(spark, 300, 50_000, 20)
    axes, variances, _ = wide.principal_axes(table, "x", 2, rounds=5)
    assert axes.shape == (50_000, 2) and variances[0] >= variances[1] > 0
    weights, constant = md.ridge_weights(table, "x", "y", 1.0)
    predicted = md.linear_predictions(table, "x", weights, constant, "p").orderBy("idx").collect()
    assert weights.shape == (50_000, 3)
    assert np.allclose([r.p for r in predicted], x @ weights + constant)


def test_wide_plane_of_the_scatter_table(spark, monkeypatch):
    x, _, _ = sparse_rows(spark, 120, 50, 10)
    arrays = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "idx long, x array<double>")
    exact = md.principal_plane(arrays, "x", None, "idx", None, None, 0).orderBy("idx").collect()
    monkeypatch.setattr(md, "GRAM_LIMIT", 8)
    found = md.principal_plane(arrays, "x", None, "idx", None, None, 0).orderBy("idx").collect()
    assert np.allclose([(r.x, r.y) for r in found], [(r.x, r.y) for r in exact], atol=1e-4)
