"""Exact k-nearest-neighbour search, for one query and for many.

Order is (distance, id): ties go to the smaller id, both at the cut and in the result.  Rows whose distance is null (a
null vector, another length) or NaN are never results.  k beyond the table gives all rows, k = 0 none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401  pa.compute
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..config import Metric
from ..errors import InvalidArgument
from ..functions.distance import block_distances, distance, pair_distances
from ..sources.store import added, new_folder

#: Query vectors that one pass over the base sends to each task, at most.
QUERY_BLOCK_BYTES, BLOCK_QUERIES = 16 << 20, 4096
#: Candidates that a task holds for the queries of a block, at most.
BLOCK_RESULTS = 4_000_000
#: So many queries are read at once, whatever the size of their partitions.
FEW_QUERIES = 1024
#: A tile of distances, or of rows, that a task holds.
TILE_BYTES = 32 << 20


def checked_k(k: int) -> int:
    if isinstance(k, bool) or not isinstance(k, int) or k < 0:
        raise InvalidArgument("k must be an integer of at least 0")
    return k


def ranked(df: DataFrame, by: str = "distance", id_: str = "id") -> DataFrame:
    """Rows of an already small result with their rank first."""
    order = Window.orderBy(F.col(by).asc_nulls_last(), F.col(id_))
    return df.select(F.row_number().over(order).alias("rank"), *df.columns)


def nearest(df: DataFrame, query: Column | Sequence[float], k: int, metric: Metric | str = Metric.L2, id_: str = "id", vector: str = "vector", where: Column | None = None, norm: str | None = None) -> DataFrame:
    """(rank, id, distance) of the k rows nearest to ``query`` among those that ``where`` keeps.

    Each task keeps its own k best, so k rows a task reach the driver's merge.
    """
    rows = df if where is None else df.where(where)
    found = rows.select(F.col(id_).alias("id"), distance(F.col(vector), query, metric, F.col(norm) if norm else None).alias("distance"))
    # nulls and NaN come last, so they are left out after the cut, and each distance is computed once
    best = found.orderBy(F.col("distance").asc_nulls_last(), "id").limit(checked_k(k))
    return ranked(best.where(F.col("distance").isNotNull() & ~F.isnan("distance")))


def _top(found: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.col("distance").asc_nulls_last(), "id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= checked_k(k))
    return best.where(F.col("distance").isNotNull() & ~F.isnan("distance")).select("query_id", "rank", "id", "distance")


def nearest_batch(base: DataFrame, queries: DataFrame, k: int, metric: Metric | str = Metric.L2, id_: str = "id", vector: str = "vector", query_id: str = "query_id", query_vector: str = "vector", where: Column | None = None, block_bytes: int = QUERY_BLOCK_BYTES) -> DataFrame:
    """(query_id, rank, id, distance) of the k rows nearest to each query among those that ``where`` keeps.

    A pass over the base sends queries of bounded size to each task, where they meet the rows, block by block, as matrix
    products: ``block_bytes`` bounds a product's queries, and a pass has as many blocks as ``QUERY_BLOCK_BYTES`` hold, one at
    least, so small blocks cost no jobs.  A row's exact distance is computed, in double, only where rounding leaves it a
    chance, and each task gives k candidates a query to the merge.
    Elements are used as they are stored, floats or doubles; ids may be of any ordered type.  Base rows with a null or NaN distance are
    never results: those of another length than the query, and those with null, NaN or infinite elements.  A query whose
    vector is null, empty or has such elements has no results.  Rows with one query id count as one query, as their results are
    ranked together.  Queries are read pass by pass: with several, each one's results are written to one table in the shared
    folder before the next is read, so the driver and the tasks hold one pass's queries.
    """
    checked_k(k)
    spark = base.sparkSession
    rows = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).alias("v"))
    kind = _element(queries, query_vector)
    source = _source(base, id_, vector, where)
    schema = T.StructType([T.StructField("query_id", rows.schema["query_id"].dataType), T.StructField("id", source.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    most = max(1, min(BLOCK_QUERIES, BLOCK_RESULTS // max(k, 1)))
    passes = _query_blocks(rows.where("v is not null").withColumn("v", F.col("v").cast(f"array<{kind}>")), np.dtype("f4" if kind == "float" else "f8"), max(block_bytes, QUERY_BLOCK_BYTES), most)
    return _top(by_passes(spark, passes, lambda block: _block(source, block, k, Metric(metric).value, schema, block_bytes), schema), k)


def by_passes(spark: SparkSession, passes: Iterator[tuple[list, np.ndarray]], run: Callable[[tuple[list, np.ndarray]], tuple[DataFrame, Broadcast]], schema: T.StructType) -> DataFrame:
    """The rows that ``run`` finds for the queries of all passes.

    Those of a single pass are found when they are read.  Of several, each one's are added to one table before the next
    pass is read, so the plan doesn't grow with their number.
    """
    folder = None
    ahead = next(passes, None)
    if ahead is None:
        return spark.createDataFrame([], schema)
    while ahead is not None:
        block, ahead = ahead, next(passes, None)
        part, sent = run(block)
        if folder is None and ahead is None:
            return part
        folder = folder or new_folder(spark, "neighbours")
        added(part, folder)
        sent.destroy()
    return spark.read.schema(schema).parquet(folder)


def nearest_rows(base: DataFrame, query: Sequence[float], k: int, metric: Metric | str = Metric.L2, id_: str = "id", vector: str = "vector", where: Column | None = None) -> DataFrame:
    """(rank, id, distance) like ``nearest``, by ``nearest_batch``'s way: faster on long vectors, with Python workers."""
    source = _source(base, id_, vector, where)
    vector_ = np.asarray(query, np.float64)[None, :]
    schema = T.StructType([T.StructField("query_id", T.IntegerType()), T.StructField("id", source.schema["id"].dataType), T.StructField("distance", T.DoubleType())])
    if not vector_.size or not np.isfinite(vector_).all():
        return ranked(base.sparkSession.createDataFrame([], schema).drop("query_id"))
    found, _ = _block(source, ([0], vector_), checked_k(k), Metric(metric).value, schema)
    best = found.select("id", "distance").orderBy("distance", "id").limit(k)
    return ranked(best.where(~F.isnan("distance")))


def _element(df: DataFrame, vector: str) -> str:
    """float or double."""
    kind = df.select(F.col(vector)).schema[0].dataType.elementType.simpleString()
    return "float" if kind == "float" else "double"


def _source(base: DataFrame, id_: str, vector: str, where: Column | None) -> DataFrame:
    rows = base if where is None else base.where(where)
    return rows.select(F.col(id_).alias("id"), F.col(vector).cast(f"array<{_element(base, vector)}>").alias("v"))


def _query_blocks(rows: DataFrame, kind: np.dtype, block_bytes: int, most: int, length: int | None = None) -> Iterator[tuple[list, np.ndarray]]:
    """(ids, matrix) of usable queries of one length, of at most about ``block_bytes`` and ``most`` of them.

    With a ``length`` a query of another one, or without a vector, is an error.
    """
    held: dict[int, tuple[list, list]] = {}
    held_bytes = 0
    # a few queries come in one job; more come partition by partition
    head = rows.limit(FEW_QUERIES + 1).collect()
    for row in head if len(head) <= FEW_QUERIES else rows.toLocalIterator(prefetchPartitions=True):
        if length is not None and (row.v is None or len(row.v) != length):
            raise InvalidArgument(f"a query needs {length} elements")
        vector = np.array(row.v, kind) if None not in row.v else np.zeros(0)
        if not len(vector) or not np.isfinite(vector).all():
            continue
        ids, vectors = held.setdefault(len(vector), ([], []))
        ids.append(row.query_id)
        vectors.append(vector)
        held_bytes += vector.nbytes
        if len(ids) >= most or held_bytes >= block_bytes:
            if held_bytes < block_bytes:  # the one length is full
                held_bytes -= sum(v.nbytes for v in vectors)
                yield ids, np.stack(vectors)
                del held[len(vector)]
            else:
                yield from ((i, np.stack(v)) for i, v in held.values())
                held.clear()
                held_bytes = 0
    yield from ((i, np.stack(v)) for i, v in held.values())


def _wide(norms: np.ndarray) -> bool:
    return not bool(((norms == 0) | ((norms > 1e-30) & (norms < 1e30))).all())


class _Best:
    """The k nearest rows so far of each query of a block: distances and ids, by (distance, id)."""

    def __init__(self, queries: np.ndarray, k: int, metric: str, id_type: pa.DataType):
        self.queries, self.k, self.metric = queries, k, metric
        self.single = queries.astype(np.float32)
        self.norms = np.square(queries, dtype=float).sum(1)
        self.wide = _wide(self.norms)
        self.owner, self.far = np.zeros(0, np.int64), np.zeros(0)
        self.ids = pa.array([], id_type)
        self.limit = np.full(len(queries), np.inf)  # the distance of a query's k-th row

    def start(self, owner: np.ndarray, far: np.ndarray, ids: pa.Array) -> _Best:
        """Begin with rows found before: at most k a query, by (query, distance, id)."""
        self.owner, self.far, self.ids = owner, far, ids
        self._limits()
        return self

    def take(self, ids: pa.Array, rows: np.ndarray, known: np.ndarray | None = None) -> None:
        """Rows of a tile; what rounding could bring among the k best is computed again without cancellation.

        ``known``: (queries, rows) pairs that are left out, as those found before.
        """
        n = len(rows)
        norms = np.einsum("ij,ij->i", rows, rows)
        largest = float(norms.max())
        if rows.dtype == np.float64 or self.wide or _wide(norms):  # squares that single precision would lose
            rough = block_distances(self.queries.astype(float), rows.astype(float), self.metric)
        else:
            rough = block_distances(self.single, rows, self.metric)
        scale = self.norms + largest if self.metric != "cosine" else np.full(len(self.norms), 2.0)
        slack = scale * (rows.shape[1] + 16) * 4 * np.finfo(rough.dtype).eps
        if known is not None:
            rough[known] = np.inf
        limit = self.limit
        if self.k < n and np.isinf(limit).any():  # until a query has k rows, the tile's own k-th is its limit
            limit = np.minimum(limit, np.partition(rough, self.k - 1, axis=1)[:, self.k - 1] + slack)
        near = ~(rough > (limit + slack)[:, None])  # so also where the product overflows
        if known is not None:
            near &= ~known
        owner, at = np.nonzero(near)
        del rough, near
        far = np.empty(len(owner))
        step = max(1, TILE_BYTES // (16 * rows.shape[1]))
        for s in range(0, len(owner), step):
            far[s : s + step] = pair_distances(self.queries[owner[s : s + step]], rows[at[s : s + step]], self.metric)
        owner, far = np.concatenate((self.owner, owner)), np.concatenate((self.far, far))
        ids = pa.concat_arrays([self.ids, ids.take(pa.array(at))])
        place = np.empty(len(ids), np.int64)
        place[pa.compute.array_sort_indices(ids, null_placement="at_start").to_numpy()] = np.arange(len(ids))
        order = np.lexsort((place, far, owner))
        rank = np.arange(len(order)) - np.searchsorted(owner[order], owner[order])
        keep = order[rank < self.k]
        self.owner, self.far, self.ids = owner[keep], far[keep], ids.take(pa.array(keep))
        self._limits()

    def _limits(self) -> None:
        full = np.bincount(self.owner, minlength=len(self.queries)) == self.k
        last = np.cumsum(np.bincount(self.owner, minlength=len(self.queries))) - 1
        self.limit[full] = self.far[last[full]]


def _block(source: DataFrame, block: tuple[list, np.ndarray], k: int, metric: str, schema: T.StructType, block_bytes: int = QUERY_BLOCK_BYTES) -> tuple[DataFrame, Broadcast]:
    sent = source.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = sent.value
        names = to_arrow_schema(schema)
        own = max(1, block_bytes // queries[0].nbytes)
        bests = [_Best(queries[at : at + own], k, metric, names.field("id").type) for at in range(0, len(queries), own)]
        tile = max(16, TILE_BYTES // (8 * max(min(own, len(queries)), queries.shape[1])))
        for batch in batches:
            ids, rows = vectors_of(batch, queries.shape[1])
            for at in range(0, len(ids), tile):
                for best in bests if k else ():
                    best.take(ids.slice(at, tile), rows[at : at + tile])
        all_ids = pa.array(query_ids, names.field("query_id").type)
        for i, best in enumerate(bests):
            yield pa.RecordBatch.from_arrays([all_ids.take(pa.array(best.owner + i * own)), best.ids, pa.array(best.far)], schema=names)

    return source.mapInArrow(run, schema), sent


def vectors_of(batch: pa.RecordBatch, dim: int, id_: str = "id", vector: str = "v") -> tuple[pa.Array, np.ndarray]:
    """Ids and the (n, dim) matrix of the batch's whole, finite vectors, floats or doubles as they come."""
    column, ids = batch.column(vector), batch.column(id_)
    column, ids = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (column, ids))
    keep = pa.compute.fill_null(pa.compute.equal(pa.compute.list_value_length(column), dim), False)
    if not pa.compute.all(keep).as_py():
        column, ids = column.filter(keep), ids.filter(keep)
    flat = column.flatten()
    matrix = np.asarray(pa.compute.fill_null(flat, float("nan")) if flat.null_count else flat).reshape(-1, dim)
    # a sum with any such element is not finite; one that overflows is looked at again
    good = np.isfinite(matrix.sum(1))
    if not good.all():
        good = np.isfinite(matrix).all(1)
    return (ids, matrix) if good.all() else (ids.filter(pa.array(good)), matrix[good])
