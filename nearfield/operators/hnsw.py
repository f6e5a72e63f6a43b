"""Approximate search over shard-local HNSW graphs.

Rows are dealt to shards by a hash of their id; each shard is one graph, held as one row of packed arrays, so a search reads
the shards where they lie and shuffles nothing but results.  A shard has about ``shard_rows`` vectors and at most
``SHARD_BYTES`` of them, however large the table is, which bounds a task's memory.

A node's level is drawn from a hash of its id, so builds are repeatable.  A node is linked on each of its levels to the
nearest ``m`` nodes that came before it, and they to it; a node keeps the nearest of its links, 2 m on the lowest level and
m above.  As the nearest of a set do not depend on the order in which it was gathered, a shard is built, and grows, with
matrix products: the result is that of inserting its nodes one by one with a search that misses none, so
``ef_construction`` sets a floor that is always met.  A search takes the nearest nodes of an upper level and walks the lowest
level from them with a beam, in step for many queries; deleted nodes are walked through and never returned.  A walk may miss
nodes, so results are nearly those of brute force; an exact search lets a check follow, which compares each query with the
shard's other nodes by matrix products, under the limit that the walk found, and adds what it missed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import Config
from ..functions.distance import block_distances, pair_distances
from .knn import QUERY_BLOCK_BYTES, _Best, _query_blocks, _top, by_passes, checked_k, vectors_of

#: A shard in a row: ids, levels, vectors (float32), each level's nodes and their links (-1: none), and deletion marks.
SHARDS = "shard int, shards int, ids binary, levels binary, vectors binary, links array<binary>, deleted binary"
SHARD_BYTES = 64 << 20
_TILE = 1024
#: Queries that walk a graph in step, and nodes that each walks on from in a step.
_STEP_QUERIES, _AT_ONCE = 256, 4
#: Nodes of an upper level that are compared with each query, at most, and how many of them the walk begins with.
_SCANNED, _STARTS = 1 << 15, 16


def _hash64(ids: np.ndarray) -> np.ndarray:
    x = ids.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15)
    for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
    return x ^ (x >> np.uint64(31))


def levels_of(ids: np.ndarray, m: int) -> np.ndarray:
    """floor(-ln(u) / ln(m)) with u in [1e-9, 1) from the id."""
    u = np.maximum((_hash64(ids) >> np.uint64(11)).astype(float) / 2.0**53, 1e-9)
    return np.floor(-np.log(u) / math.log(m)).astype(np.int32)


def _linked(vectors: np.ndarray, m: int, cap: int, metric: str, before: np.ndarray) -> np.ndarray:
    """(n, cap) links of a level's nodes, in order of insertion; -1 where there is none.

    ``before``: the links of the first nodes among themselves, to which the others are added.
    """
    n, have = len(vectors), len(before)
    source, place = np.nonzero(before >= 0)
    target = before[source, place]
    far = [np.zeros(0, np.float32)]
    for at in range(0, len(source), 64 * _TILE):
        part = slice(at, at + 64 * _TILE)
        far.append(pair_distances(vectors[source[part]], vectors[target[part]], metric).astype(np.float32))
    sources, targets = [source.astype(np.int32)], [target.astype(np.int32)]
    for at in range(have, n, _TILE):
        own = vectors[at : at + _TILE]
        near = np.full((len(own), m), np.inf, np.float32)
        who = np.full((len(own), m), -1, np.int32)
        for left in range(0, at + len(own), 16 * _TILE):
            right = min(left + 16 * _TILE, at + len(own))
            d = block_distances(own, vectors[left:right], metric)
            if right > at:  # only those that came before
                d[np.arange(left, right)[None, :] >= np.arange(at, at + len(own))[:, None]] = np.inf
            take = min(m, right - left)
            pick = np.argpartition(d, take - 1, axis=1)[:, :take] if take < right - left else np.broadcast_to(np.arange(right - left), d.shape)
            near = np.concatenate((near, np.take_along_axis(d, pick, 1)), 1)
            who = np.concatenate((who, (pick + left).astype(np.int32)), 1)
            best = np.argsort(near, axis=1, kind="stable")[:, :m]
            near, who = np.take_along_axis(near, best, 1), np.take_along_axis(who, best, 1)
        real = np.isfinite(near)
        new, old, d = np.repeat(np.arange(at, at + len(own), dtype=np.int32), real.sum(1)), who[real], near[real]
        sources += [new, old]
        targets += [old, new]
        far += [d, d]
    a, b, d = np.concatenate(sources), np.concatenate(targets), np.concatenate(far)
    order = np.lexsort((b, d, a))
    a, b = a[order], b[order]
    rank = np.arange(len(a)) - np.searchsorted(a, a)
    out = np.full((n, cap), -1, np.int32)
    out[a[rank < cap], rank[rank < cap]] = b[rank < cap]
    return out


class Graph:
    """One shard.  ``links[level]`` has a row of ordinals for each node of the level; nodes are in order of insertion."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, config: Config, deleted: np.ndarray | None = None, levels: np.ndarray | None = None, links: list[np.ndarray] | None = None):
        self.ids, self.vectors, self.config = ids, vectors.astype(np.float32, copy=False), config
        self.levels = levels_of(ids, config.m) if levels is None else levels
        self.deleted = np.zeros(len(ids), bool) if deleted is None else deleted
        top = int(self.levels.max()) if len(ids) else -1
        #: the nodes of each level; the entry is the first of the tallest
        self.members = [np.flatnonzero(self.levels >= at).astype(np.int32) for at in range(top + 1)]
        self.links = links or []

    def build(self) -> Graph:
        """Link all nodes."""
        return self._link([np.zeros((0, 0), np.int32)] * len(self.members))

    def grown(self, ids: np.ndarray, vectors: np.ndarray) -> Graph:
        """The graph with more nodes, inserted after its own."""
        out = Graph(np.concatenate((self.ids, ids)), np.concatenate((self.vectors, vectors.astype(np.float32))), self.config, np.concatenate((self.deleted, np.zeros(len(ids), bool))), np.concatenate((self.levels, levels_of(ids, self.config.m))))
        return out._link(self.links + [np.zeros((0, 0), np.int32)] * (len(out.members) - len(self.links)))

    def _link(self, before: list[np.ndarray]) -> Graph:
        self.links = []
        for at, own in enumerate(self.members):
            cap = self.config.m * (1 if at else 2)
            old = before[at] if len(before[at]) else np.zeros((0, cap), np.int32)
            old = np.where(old >= 0, np.searchsorted(own, old), -1).astype(np.int32)
            links = _linked(self.vectors[own], self.config.m, cap, self.config.metric.value, old)
            self.links.append(np.where(links >= 0, own[links], -1).astype(np.int32) if len(own) else links)
        return self

    def _far(self, queries: np.ndarray, nodes: np.ndarray) -> np.ndarray:
        """Distances of each query to its row of nodes; infinite for -1."""
        rows = self.vectors[nodes]
        product = np.matmul(rows, queries[:, :, None])[:, :, 0]
        metric = self.config.metric.value
        if metric == "ip":
            far = -product
        elif metric == "l2":
            far = self._norms[nodes] - 2 * product
        else:
            scale = np.sqrt(self._norms[nodes]) * np.sqrt(np.square(queries).sum(1))[:, None]
            far = np.where(scale == 0, np.float32(1), 1 - product / np.where(scale == 0, 1, scale))
        return np.where(nodes >= 0, far, np.float32(np.inf))

    def _beams(self, queries: np.ndarray, starts: np.ndarray, width: int, level: int) -> tuple[np.ndarray, np.ndarray]:
        """(distances, nodes), in no order: the ``width`` nearest that a best-first walk of each query finds."""
        n = len(queries)
        place = np.full(len(self.ids), -1, np.int32)
        place[self.members[level]] = np.arange(len(self.members[level]), dtype=np.int32)
        near, nodes = np.full((n, width), np.inf, np.float32), np.full((n, width), -1, np.int32)
        first = starts[:, :width]
        near[:, : first.shape[1]], nodes[:, : first.shape[1]] = self._far(queries, first), first
        todo = nodes >= 0  # not walked from yet
        seen = np.zeros((n, len(self.ids) + 1), bool)  # the last stands for -1
        seen[np.arange(n)[:, None], first] = seen[:, -1] = True
        active = np.arange(n)
        at_once = min(_AT_ONCE, width)
        while len(active):
            # the nearest few that are still to do, each one's new neighbours, and then the best of all
            waiting = np.where(todo[active], near[active], np.inf)
            pick = np.argpartition(waiting, at_once - 1, axis=1)[:, :at_once] if at_once < width else np.broadcast_to(np.arange(width), waiting.shape)
            real = np.isfinite(np.take_along_axis(waiting, pick, 1))
            new = []
            for i in range(at_once):
                todo[active, pick[:, i]] = False
                own = np.where(real[:, i], nodes[active, pick[:, i]], self.members[level][0])
                next_ = self.links[level][place[own]]
                next_ = np.where(seen[active[:, None], next_] | ~real[:, i, None], -1, next_)
                seen[active[:, None], next_] = True
                new.append(next_)
            next_ = np.concatenate(new, 1)
            used = int((next_ >= 0).sum(1).max())
            if used:
                if used < next_.shape[1]:  # the new ones first, so that fewer columns are computed
                    next_ = np.take_along_axis(next_, np.argsort(next_ < 0, axis=1, kind="stable")[:, :used], 1)
                far = self._far(queries[active], next_)
                all_far = np.concatenate((near[active], far), 1)
                order = np.argpartition(all_far, width - 1, axis=1)[:, :width]
                near[active] = np.take_along_axis(all_far, order, 1)
                nodes[active] = np.take_along_axis(np.concatenate((nodes[active], next_), 1), order, 1)
                todo[active] = np.take_along_axis(np.concatenate((todo[active], next_ >= 0), 1), order, 1)
            active = active[todo[active].any(1)]
        return near, nodes

    def _starts(self, queries: np.ndarray) -> np.ndarray:
        """(queries, at most _STARTS) nodes to walk the lowest level from: near ones of the level above.

        The lowest upper level that is small enough is searched by a matrix product, which costs less than a walk from the
        top and ends in no false valley; levels between, if any, are walked with a beam.  Where all levels are too large
        the walk begins with the first of the tallest.
        """
        small = [at for at in range(1, len(self.members)) if len(self.members[at]) <= _SCANNED]
        if small:
            own = self.members[small[0]]
            take = min(_STARTS, len(own))
            far = block_distances(queries, self.vectors[own], self.config.metric.value)
            starts = own[np.argpartition(far, take - 1, axis=1)[:, :take]]
        else:
            starts = np.full((len(queries), 1), self.members[-1][0], np.int32)
        for level in range((small[0] if small else len(self.members)) - 1, 0, -1):
            starts = self._beams(queries, starts, _STARTS, level)[1]
        return starts

    def search_many(self, queries: np.ndarray, k: int, ef: int, exact: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of at most k live nodes each, by (distance, id); distances are exact.

        ``exact``: so is the set, as nodes that the walk missed are added.
        """
        live = int((~self.deleted).sum())
        empty = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        if not live or not k or not len(queries):
            return empty
        # deleted nodes take places of the beam, so it is wider by their share
        width = min(len(self.ids), -(-max(ef, k) * len(self.ids) // live))
        self._norms = np.square(self.vectors).sum(1)
        out = []
        for at in range(0, len(queries), step := max(1, min(_STEP_QUERIES, (256 << 20) // (len(self.ids) + 1)))):
            own = queries[at : at + step].astype(np.float32)
            _, nodes = self._beams(own, self._starts(own), width, 0)
            q, c = np.nonzero((nodes >= 0) & ~self.deleted[nodes])
            node = nodes[q, c].astype(np.int64)
            far = pair_distances(own[q], self.vectors[node], self.config.metric)
            order = np.lexsort((self.ids[node], far, q))
            rank = np.arange(len(order)) - np.searchsorted(q[order], q[order])
            keep = order[rank < k]
            q, node, far = q[keep], node[keep], far[keep]
            if exact:
                q, node, far = self._completed(own, k, q, node, far)
            out.append((q + at, node, far))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def _completed(self, queries: np.ndarray, k: int, q: np.ndarray, node: np.ndarray, far: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, node, distance) of the k nearest live nodes, from what a walk found and what it missed."""
        best = _Best(queries, k, self.config.metric.value, pa.int64()).start(q, far, pa.array(self.ids[node]))
        known = np.broadcast_to(self.deleted, (len(queries), len(self.ids))).copy()
        known[q, node] = True
        for at in range(0, len(self.ids), 16 * _TILE):
            part = slice(at, at + 16 * _TILE)
            best.take(pa.array(self.ids[part]), self.vectors[part], known[:, part])
        order = np.argsort(self.ids)
        return best.owner, order[np.searchsorted(self.ids, best.ids.to_numpy(), sorter=order)], best.far

    def search(self, query: np.ndarray, k: int, ef: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, distances) of at most k live nodes, by (distance, id)."""
        _, node, far = self.search_many(np.asarray(query, np.float32)[None, :], k, ef)
        return self.ids[node], far

    def packed(self, shard: int, shards: int) -> dict:
        """The row of ``SHARDS``."""
        arrays = (self.ids.astype("<i8"), self.levels.astype("<i4"), self.vectors.astype("<f4"))
        ids, levels, vectors = (x.tobytes() for x in arrays)
        return {"shard": shard, "shards": shards, "ids": ids, "levels": levels, "vectors": vectors, "links": [x.astype("<i4").tobytes() for x in self.links], "deleted": self.deleted.tobytes()}

    @classmethod
    def unpacked(cls, row: dict, config: Config) -> Graph:
        ids, levels = np.frombuffer(row["ids"], "<i8"), np.frombuffer(row["levels"], "<i4")
        vectors = np.frombuffer(row["vectors"], "<f4").reshape(len(ids), -1) if len(ids) else np.zeros((0, config.dimension), np.float32)
        links = [np.frombuffer(x, "<i4").reshape(-1, config.m * (1 if at else 2)) for at, x in enumerate(row["links"])]
        return cls(ids, vectors, config, np.frombuffer(row["deleted"], bool), levels, links)


def shard_of(id_: str, shards: Column) -> Column:
    return F.pmod(F.xxhash64(F.col(id_).cast("long")), shards).cast("int")


def shard_limit(config: Config) -> int:
    """Vectors of a shard, at most about."""
    return max(1, min(config.shard_rows, SHARD_BYTES // (4 * config.dimension)))


def build(df: DataFrame, config: Config, id_: str = "id", vector: str = "vector", shards: int | None = None) -> DataFrame:
    """The table (``SHARDS``) of ``df``'s graphs.  Ids must be distinct."""
    if shards is None:
        shards = max(1, -(-df.count() // shard_limit(config)))
    rows = df.select(shard_of(id_, F.lit(shards)).alias("shard"), F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by("id").combine_chunks()
        ids, vectors = vectors_of(table, config.dimension)
        graph = Graph(ids.to_numpy(zero_copy_only=False).astype(np.int64), vectors, config).build()
        return _table(graph.packed(table["shard"][0].as_py(), shards))

    return rows.groupBy("shard").applyInArrow(run, SHARDS)


def _table(row: dict) -> pa.Table:
    kinds = {"shard": pa.int32(), "shards": pa.int32(), "links": pa.list_(pa.binary())}
    return pa.table({c: pa.array([row[c]], kinds.get(c, pa.binary())) for c in ("shard", "shards", "ids", "levels", "vectors", "links", "deleted")})


def insert(shards: DataFrame, df: DataFrame, config: Config, id_: str = "id", vector: str = "vector") -> DataFrame:
    """The table with ``df``'s rows inserted into their shards.  Ids must be new; a shard without new rows stays as it is."""
    n = shards.agg(F.max("shards")).scalar()
    rows = df.select(shard_of(id_, n).alias("shard"), F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("v"), n.alias("shards"))

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0] if left.num_rows else None
        empty = Graph(np.zeros(0, np.int64), np.zeros((0, config.dimension), np.float32), config)
        graph = Graph.unpacked(row, config) if row else empty.build()
        if right.num_rows:
            right = right.sort_by("id").combine_chunks()
            ids, vectors = vectors_of(right, config.dimension)
            graph = graph.grown(ids.to_numpy(zero_copy_only=False).astype(np.int64), vectors)
            row = row or right.slice(0, 1).to_pylist()[0]
        return _table(graph.packed(row["shard"], row["shards"]))

    return shards.groupBy("shard").cogroup(rows.groupBy("shard")).applyInArrow(run, SHARDS)


def search(shards: DataFrame, queries: DataFrame, k: int, config: Config, ef: int = 0, query_id: str = "query_id", query_vector: str = "vector", exact: bool = False) -> DataFrame:
    """(query_id, rank, id, distance): the merged best of all shards, which are searched where they lie.

    Queries go out in blocks of bounded size; with several blocks, each one's results are added to a table before the next is read.
    A query of another length than the collection's is an error; one with null or infinite elements has no results.
    ``exact``: nodes that the walks miss are added, at the cost of a scan of the shards.
    """
    checked_k(k)
    effort = config.ef(k, ef)
    spark = shards.sparkSession
    rows = queries.select(F.col(query_id).alias("query_id"), F.col(query_vector).cast("array<float>").alias("v"))
    schema = T.StructType([T.StructField("query_id", rows.schema["query_id"].dataType), T.StructField("id", T.LongType()), T.StructField("distance", T.DoubleType())])
    blocks = _query_blocks(rows, np.dtype("f4"), QUERY_BLOCK_BYTES, 1 << 20, config.dimension)

    def part(block: tuple[list, np.ndarray]) -> tuple[DataFrame, Broadcast]:
        sent = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark.sql.pandas.types import to_arrow_schema

            ids, vectors = sent.value
            names = to_arrow_schema(schema)
            own_ids = pa.array(ids, names.field("query_id").type)
            for batch in batches:
                for at in range(batch.num_rows):
                    graph = Graph.unpacked(batch.slice(at, 1).to_pylist()[0], config)
                    q, node, far = graph.search_many(vectors, k, effort, exact)
                    yield pa.RecordBatch.from_arrays([own_ids.take(pa.array(q)), pa.array(graph.ids[node]), pa.array(far)], schema=names)

        return shards.mapInArrow(run, schema), sent

    return _top(by_passes(spark, blocks, part, schema), k)


def remove(shards: DataFrame, ids: DataFrame) -> DataFrame:
    """The table with the ids' nodes marked as deleted; they still lead searches on.

    Ids are gathered by shard; the shards themselves are not shuffled where Spark finds the ids few enough to broadcast.
    """
    gone = ids.select(F.col("id").cast("long").alias("id")).distinct()
    gone = gone.groupBy(shard_of("id", shards.agg(F.max("shards")).scalar()).alias("__shard")).agg(F.collect_list("id").alias("__gone"))
    schema = T._parse_datatype_string(SHARDS)
    at = schema.names.index("deleted")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1)
                own = np.frombuffer(row.column("ids")[0].as_py(), "<i8")
                marks = np.frombuffer(row.column("deleted")[0].as_py(), bool) | np.isin(own, np.array(row.column("__gone")[0].as_py() or [], np.int64))
                columns = [row.column(c) for c in schema.names]
                columns[at] = pa.array([marks.tobytes()], pa.binary())
                yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return shards.join(gone, F.col("shard") == F.col("__shard"), "left").select(*schema.names, "__gone").mapInArrow(run, schema)


def nodes(shards: DataFrame, config: Config) -> DataFrame:
    """(shard, node, id, level, deleted, vec, neighbors): the graphs node by node, neighbors by level as ordinals."""
    names = "shard int, node int, id long, level int, deleted boolean, vec array<float>, neighbors array<array<int>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                graph = Graph.unpacked(row, config)
                places = [np.searchsorted(own, np.arange(len(graph.ids))) for own in graph.members]
                for at in range(0, len(graph.ids), 4096):
                    own = range(at, min(at + 4096, len(graph.ids)))
                    links = [[[x for x in graph.links[v][places[v][o]].tolist() if x >= 0] for v in range(int(graph.levels[o]) + 1)] for o in own]
                    cut = slice(own.start, own.stop)
                    columns = [pa.array([row["shard"]] * len(own), pa.int32()), pa.array(own, pa.int32()), pa.array(graph.ids[cut]), pa.array(graph.levels[cut]), pa.array(graph.deleted[cut]), pa.array(list(graph.vectors[cut]), pa.list_(pa.float32())), pa.array(links, pa.list_(pa.list_(pa.int32())))]
                    yield pa.RecordBatch.from_arrays(columns, names=["shard", "node", "id", "level", "deleted", "vec", "neighbors"])

    return shards.mapInArrow(run, names)


def count(shards: DataFrame) -> int:
    """Live nodes."""
    deleted = F.length(F.translate(F.hex("deleted"), "0", ""))
    return shards.agg(F.coalesce(F.sum(F.octet_length("deleted") - deleted), F.lit(0))).first()[0]


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row: the share of exact results that were found, over all queries."""
    hits = exact.select("query_id", "id").join(found.select("query_id", "id").withColumn("hit", F.lit(1)), ["query_id", "id"], "left")
    return hits.agg((F.coalesce(F.sum("hit"), F.lit(0)) / F.greatest(F.count(F.lit(1)), F.lit(1))).alias("recall"))
