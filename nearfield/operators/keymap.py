"""An ordered map of long keys to long values, as a two-column DataFrame (key, value).

Stored maps are Parquet sorted by key, so point and range look-ups skip row groups by their statistics.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import NotFound

SCHEMA = "key long, value long"


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)


def upsert(base: DataFrame, updates: DataFrame, order: str | None = None) -> DataFrame:
    """``base`` with the updates' values; a key given twice takes its last by ``order``, else its greatest value."""
    last = updates.groupBy("key").agg((F.max_by("value", order) if order else F.max("value")).alias("value"))
    return base.join(last.select("key"), "key", "left_anti").unionByName(last)


def find(base: DataFrame, key: int) -> DataFrame:
    """One row or none; the comparison is pushed down to the scan."""
    return base.where(F.col("key") == F.lit(key))


def value_of(base: DataFrame, key: int) -> int:
    row = find(base, key).first()
    if row is None:
        raise NotFound(f"key {key}")
    return row.value


def remove(base: DataFrame, keys: DataFrame, strict: bool = False) -> DataFrame:
    """``base`` without the keys; strictly, a key that isn't there is an error."""
    if strict:
        missing = keys.select("key").join(base.select("key"), "key", "left_anti").first()
        if missing is not None:
            raise NotFound(f"key {missing.key}")
    return base.join(keys.select("key"), "key", "left_anti")


def contains(base: DataFrame, key: int) -> bool:
    return not find(base, key).isEmpty()


def summary(base: DataFrame) -> DataFrame:
    """One row: the number of pairs, the least and the greatest key."""
    return base.agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("least"), F.max("key").alias("greatest"))


def count(base: DataFrame) -> int:
    return summary(base).first().n


def range_query(base: DataFrame, low: int, high: int) -> DataFrame:
    """Keys from low to high, both included, in order; none if low > high."""
    return base.where(F.col("key").between(low, high)).orderBy("key")


def save(base: DataFrame, path: str) -> None:
    base.sort("key").write.mode("overwrite").parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(SCHEMA).parquet(path)
    except AnalysisException as e:
        raise NotFound(path) from e
