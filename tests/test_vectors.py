"""Column expressions against the NumPy kernels, and the kernels against plain loops."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from nearfield.functions import vectors


@pytest.mark.parametrize("name", [*vectors.METRICS, "minkowski"])
def test_columns_equal_kernels(name, spark):
    rng = np.random.default_rng(1)
    a, b = rng.random((6, 5)), rng.random((6, 5))
    a[0] = 0
    b[1] = 0
    kind = "double"
    if name == "hamming":
        a, b = (rng.integers(-(1 << 62), 1 << 62, (6, 2)) for _ in range(2))
        kind = "bigint"
    df = spark.createDataFrame([(i, x.tolist(), y.tolist()) for i, (x, y) in enumerate(zip(a, b))], f"i int, a array<{kind}>, b array<{kind}>")
    got = [r.d for r in df.select("i", vectors.distance(F.col("a"), F.col("b"), name, 3).alias("d")).orderBy("i").collect()]
    want = np.diag(vectors.metric(name, 3).block(a, b))
    assert np.allclose(got, want, atol=1e-12)


def test_kl_and_chi_square_skip_undefined_terms():
    block = vectors.METRICS["kl"].block
    assert block(np.array([[0.0, 1.0]]), np.array([[1.0, 0.0]]))[0, 0] == 0
    assert math.isclose(vectors.METRICS["chi_square"].block(np.array([[0.0, 1.0]]), np.array([[0.0, 3.0]]))[0, 0], 1.0)


def test_registered_functions(spark):
    vectors.register(spark)
    assert spark.sql("SELECT vec_l2(array(1D, 2D), array(3D, 5D))").first()[0] == 13.0
    assert spark.sql("SELECT vec_max(array(1D, 2D), array(3D, 5D))").first()[0] == 3.0


def test_normalize_leaves_zero(spark):
    df = spark.createDataFrame([([0.0, 0.0],), ([3.0, 4.0],)], "v array<double>")
    assert [r.v for r in df.select(vectors.normalize(F.col("v")).alias("v")).collect()] == [[0.0, 0.0], [0.6, 0.8]]
