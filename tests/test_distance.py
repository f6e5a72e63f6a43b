import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from nearfield.functions.distance import block_distances, distance, exact_distances, register_sql

# Pairs with known distances.
KNOWN = [
    ("l2", [1, 2, 3, 4], [1, 2, 3, 5], 1),
    ("l2", [1, 0, 0], [0, 1, 0], 2),
    ("l2", [0.1] * 768, [0] * 768, 7.68),
    ("l2", [3], [7], 16),
    ("cosine", [0, 0, 0, 0], [1, 2, 3, 4], 1),
    ("cosine", [1, 0, 0], [0, 1, 0], 1),
    ("cosine", [1, 0, 0], [-1, 0, 0], 2),
    ("cosine", [1, 2, 3], [2, 4, 6], 0),
    ("ip", [1, 2, 3], [4, 5, 6], -32),
    ("ip", [0, 0], [1, 1], 0),
]


@pytest.mark.parametrize("metric,a,b,expected", KNOWN)
def test_known_pairs_in_both_kernels(metric, a, b, expected):
    x, y = np.array([a], np.float32), np.array([b], np.float32)
    assert exact_distances(x[0], y, metric)[0] == pytest.approx(expected, abs=1e-4)
    assert block_distances(x, y, metric)[0, 0] == pytest.approx(expected, abs=1e-4)


def test_known_pairs_as_columns_and_sql(spark):
    rows = spark.createDataFrame([(i, m, [float(v) for v in a], [float(v) for v in b], float(e)) for i, (m, a, b, e) in enumerate(KNOWN)], "i int, metric string, a array<float>, b array<float>, e double")
    register_sql(spark)
    for metric, name in (("l2", "l2_sq"), ("cosine", "cosine_distance"), ("ip", "inner_product")):
        own = rows.where(F.col("metric") == metric)
        sql = F.expr(f"{name}(cast(a as array<double>), cast(b as array<double>))")
        for row in own.select("e", distance(F.col("a"), F.col("b"), metric).alias("d"), sql.alias("s")).collect():
            assert row.d == pytest.approx(row.e, abs=1e-4) and row.s == pytest.approx(row.e, abs=1e-4)


def test_zero_inner_product_has_no_sign(spark):
    row = spark.range(1).select(distance(F.array(F.lit(0.0)), [0.0], "ip").cast("string").alias("d")).first()
    assert row.d == "0.0"


def test_unequal_lengths_and_nulls_are_null(spark):
    rows = spark.createDataFrame([([1.0],), ([1.0, None],), (None,)], "v array<float>")
    for metric in ("l2", "cosine", "ip"):
        assert [r[0] for r in rows.select(distance(F.col("v"), [1.0, 2.0], metric)).collect()] == [None] * 3


vectors = st.lists(st.floats(-100, 100, width=32), min_size=4, max_size=4)


@settings(max_examples=50, deadline=None)
@given(vectors, vectors)
def test_symmetry_and_ranges(a, b):
    x, y = np.array([a], np.float32), np.array([b], np.float32)
    for metric in ("l2", "cosine", "ip"):
        assert exact_distances(x[0], y, metric)[0] == pytest.approx(exact_distances(y[0], x, metric)[0], abs=1e-6)
    assert exact_distances(x[0], y, "l2")[0] >= 0
    assert -1e-9 <= exact_distances(x[0], y, "cosine")[0] <= 2 + 1e-9
