"""Vector distances as columns, SQL functions and numpy kernels.

Elements are cast to double before arithmetic.  All three distances are smaller for nearer vectors: squared L2; one less
the cosine, which is exactly 1 if a vector is zero; and the negated inner product, never -0.0.  Vectors of unequal
lengths and null vectors or elements give null.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..config import Metric


def as_vector(query: Column | Sequence[float]) -> Column:
    """One literal array of doubles, or the column as it is."""
    return query if isinstance(query, Column) else F.lit(np.asarray(query, np.float64))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def squared_norm(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def l2(a: Column, b: Column) -> Column:
    difference = F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))
    return F.aggregate(difference, F.lit(0.0), lambda s, d: s + d * d)


def cosine(a: Column, b: Column, norm_a: Column | None = None, norm_b: Column | None = None) -> Column:
    """``norm_a`` and ``norm_b``: squared norms, if they are known."""
    na, nb = squared_norm(a) if norm_a is None else norm_a, squared_norm(b) if norm_b is None else norm_b
    product = dot(a, b)
    return F.when(product.isNull(), None).when((na == 0) | (nb == 0), 1.0).otherwise(1.0 - product / (F.sqrt(na) * F.sqrt(nb)))


def inner_product(a: Column, b: Column) -> Column:
    return -dot(a, b) + 0.0


def distance(a: Column, b: Column | Sequence[float], metric: Metric | str = Metric.L2, norm_a: Column | None = None) -> Column:
    """The metric's distance.  A literal query's norm is computed once, here."""
    metric = Metric(metric)
    vector = as_vector(b)
    if metric is Metric.L2:
        return l2(a, vector)
    if metric is Metric.IP:
        return inner_product(a, vector)
    norm_b = None if isinstance(b, Column) else F.lit(float(np.square(np.asarray(b, float)).sum()))
    return cosine(a, vector, norm_a, norm_b)


SQL_FUNCTIONS = {
    "l2_sq": "aggregate(zip_with(a, b, (x, y) -> x - y), 0D, (s, d) -> s + d * d)",
    "inner_product": "-aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, d) -> s + d) + 0D",
    "cosine_distance": (
        "CASE WHEN aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, d) -> s + d) IS NULL THEN NULL "
        "WHEN aggregate(a, 0D, (s, x) -> s + x * x) = 0 OR aggregate(b, 0D, (s, x) -> s + x * x) = 0 THEN 1D "
        "ELSE 1D - aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, d) -> s + d) "
        "/ (sqrt(aggregate(a, 0D, (s, x) -> s + x * x)) * sqrt(aggregate(b, 0D, (s, x) -> s + x * x))) END"
    ),
}


def register_sql(spark: SparkSession) -> None:
    """Temporary SQL functions of two array<double>; Catalyst inlines them, so no Python runs."""
    for name, body in SQL_FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(a ARRAY<DOUBLE>, b ARRAY<DOUBLE>) RETURNS DOUBLE RETURN {body}")


def block_distances(queries: np.ndarray, base: np.ndarray, metric: Metric | str) -> np.ndarray:
    """(queries, base) distances by one matrix product, in the precision of the vectors."""
    metric = Metric(metric)
    product = queries @ base.T
    if metric is Metric.IP:
        return np.negative(product, out=product)
    nq, nb = np.square(queries).sum(1)[:, None], np.square(base).sum(1)[None, :]
    if metric is Metric.L2:
        product *= -2
        product += nq
        product += nb
        return product
    scale = np.sqrt(nq) * np.sqrt(nb)
    return np.where(scale == 0, 1, 1 - product / np.where(scale == 0, 1, scale))


def pair_distances(queries: np.ndarray, rows: np.ndarray, metric: Metric | str) -> np.ndarray:
    """Distances of each query to the row beside it, in double and without the cancellation of ``block_distances``."""
    metric = Metric(metric)
    queries, rows = queries.astype(float), rows.astype(float)
    if metric is Metric.L2:
        return np.square(rows - queries).sum(1)
    product = (rows * queries).sum(1)
    if metric is Metric.IP:
        return -product + 0.0
    scale = np.sqrt(np.square(rows).sum(1)) * np.sqrt(np.square(queries).sum(1))
    return np.where(scale == 0, 1.0, 1.0 - product / np.where(scale == 0, 1.0, scale))


def exact_distances(query: np.ndarray, rows: np.ndarray, metric: Metric | str) -> np.ndarray:
    """Distances of one query to some rows, without the cancellation of ``block_distances``."""
    metric = Metric(metric)
    query, rows = query.astype(float), rows.astype(float)
    if metric is Metric.L2:
        return np.square(rows - query).sum(1)
    product = rows @ query
    if metric is Metric.IP:
        return -product + 0.0
    scale = np.sqrt(np.square(rows).sum(1)) * np.sqrt(np.square(query).sum())
    return np.where(scale == 0, 1.0, 1.0 - product / np.where(scale == 0, 1.0, scale))
