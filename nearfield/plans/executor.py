"""From a query to a plan: exact or by the index, with or without a filter."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import Config
from ..errors import InvalidArgument
from ..operators import hnsw
from ..operators.knn import _top, checked_k, nearest_batch, nearest_rows, ranked
from .filters import filter_column

#: How many times k a filtered index search fetches before the filter.
OVERFETCH = 4


@dataclass(frozen=True)
class KnnQuery:
    """A vector, the number of results, the effort (0: the collection's) and a filter."""

    vector: tuple[float, ...]
    k: int
    ef: int = 0
    filter: str | None = None


@dataclass(frozen=True)
class Source:
    """Live rows (id, vector, metadata, norm), and where there is an index its shards and the live rows outside it."""

    config: Config
    rows: DataFrame
    shards: DataFrame | None = None
    delta: DataFrame | None = None
    promoted: Mapping[str, tuple[Column, str]] = field(default_factory=dict)


def execute(query: KnnQuery, source: Source) -> DataFrame:
    """(rank, id, distance).

    Without an index the filter comes first and the search is exact.  With one, the index's and the delta's candidates are
    filtered, and where fewer than k remain although rows may be left, the exact search answers.  To know that, the search
    by index runs here; its at most k rows are the result.
    """
    checked_k(query.k)
    if len(query.vector) != source.config.dimension:
        raise InvalidArgument(f"a query needs {source.config.dimension} elements")
    where = filter_column(query.filter, F.col("metadata"), source.promoted)
    exact = nearest_rows(source.rows, query.vector, query.k, source.config.metric, where=where)
    if source.shards is None or not query.k:
        return exact
    spark = source.rows.sparkSession
    fetch = query.k if where is None else query.k * OVERFETCH
    one = spark.createDataFrame([(0, list(query.vector))], "query_id long, vector array<double>")
    found = hnsw.search(source.shards, one, fetch, source.config, query.ef).select("id", "distance")
    if source.delta is not None:
        found = found.unionByName(nearest_rows(source.delta, query.vector, fetch, source.config.metric, where=where).select("id", "distance"))
    if where is not None:
        found = found.join(source.rows.where(where).select("id"), "id", "left_semi")
    best = ranked(found.dropDuplicates(["id"]).orderBy("distance", "id").limit(query.k))
    rows = best.collect()
    return exact if len(rows) < query.k else spark.createDataFrame(rows, best.schema)


def execute_batch(queries: DataFrame, k: int, ef: int, source: Source, query_id: str = "query_id", query_vector: str = "vector", filter: str | None = None, exact: bool = False) -> DataFrame:  # noqa: A002
    """(query_id, rank, id, distance).

    With a filter the search is exact over the rows that it keeps; without one, and with an index, it is the index's.
    ``exact``: what the index's walks miss is added.
    """
    where = filter_column(filter, F.col("metadata"), source.promoted)
    named = {"query_id": query_id, "query_vector": query_vector}
    if source.shards is None or where is not None:
        return nearest_batch(source.rows, queries, k, source.config.metric, where=where, **named)
    found = hnsw.search(source.shards, queries, k, source.config, ef, **named, exact=exact)
    if source.delta is None:
        return found
    more = nearest_batch(source.delta, queries, k, source.config.metric, **named)
    return _top(found.drop("rank").unionByName(more.drop("rank")), k)
