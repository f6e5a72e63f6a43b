"""Collections: vectors with JSON metadata as versioned Parquet, searched as DataFrames.

A collection is a directory: a manifest, data segments, tombstones and an index.  An insert appends a segment, a delete
appends tombstones, and both carry a growing sequence number: a row is live if no tombstone of its id has a greater one.
Compaction rewrites the live rows sorted by id and builds the index.  One writer at a time.
"""

from __future__ import annotations

import json
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __version__
from ..config import Config, Index, OpenMode
from ..errors import AlreadyExists, InvalidArgument, NotFound
from ..functions.distance import squared_norm
from ..operators import hnsw
from ..plans.executor import KnnQuery, Source, execute, execute_batch
from .store import Store

def _is_json(text: str) -> bool:
    """Whether ``try_parse_json`` would take it (no doubled keys, no NaN or infinity) and nothing follows the value."""

    def once(pairs: list[tuple[str, object]]) -> dict:
        if len({k for k, _ in pairs}) < len(pairs):
            raise ValueError("a key is doubled")
        return dict(pairs)

    def refused(name: str) -> None:
        raise ValueError(name)

    try:
        json.loads(text, object_pairs_hook=once, parse_constant=refused)
    except (ValueError, RecursionError):
        return False
    return True


COLUMNS = "id long, vector array<float>, metadata string, norm double, seq long"


class Collection:
    """An open collection.  ``open`` makes one; it is a context manager."""

    def __init__(self, spark: SparkSession, store: Store, state: dict, mode: OpenMode):
        self.spark, self.store, self.mode = spark, store, mode
        self._state = state
        self._closed = False

    # life

    @classmethod
    def open(cls, spark: SparkSession, path: str, mode: OpenMode = OpenMode.READWRITE | OpenMode.CREATE, config: Config | None = None, promote: Sequence[tuple[str, str]] = ()) -> Collection:
        """Open or create.  A config that contradicts the stored one is an error; without one the stored one holds.

        ``promote``: (metadata field, SQL type) pairs kept as typed columns beside the metadata, so that filters on them
        reach the scan; for a new collection only.
        """
        if not path:
            raise InvalidArgument("no path")
        store = Store(spark, path)
        if mode & OpenMode.TRUNCATE:
            if not mode & OpenMode.READWRITE:
                raise InvalidArgument("read-only collections can't be truncated")
            store.delete()
        try:
            state = store.read()
        except NotFound:
            if not mode & OpenMode.CREATE:
                raise
            if config is None:
                raise InvalidArgument("a new collection needs a config") from None
            state = {"version": 1, "config": config.to_dict(), "seq": 0, "segments": [], "tombstones": [], "index": None, "promoted": [list(p) for p in promote]}
            store.write(state)
        else:
            stored = Config(**state["config"])
            if config is not None and (config.dimension, config.metric) != (stored.dimension, stored.metric):
                raise InvalidArgument(f"the collection has {stored.dimension} dimensions and metric {stored.metric.value}")
        return cls(spark, store, state, mode)

    def close(self) -> None:
        self._closed = True

    def __enter__(self) -> Collection:
        return self

    def __exit__(self, *_: object) -> None:
        self.close()

    @property
    def config(self) -> Config:
        return Config(**self._state["config"])

    def _writable(self) -> None:
        self._usable()
        if not self.mode & OpenMode.READWRITE:
            raise InvalidArgument("opened read-only")

    def _usable(self) -> None:
        if self._closed:
            raise InvalidArgument("closed")

    def _commit(self, **changes: object) -> None:
        state = self._state | changes | {"version": self._state["version"] + 1}
        self.store.write(state)
        self._state = state

    # rows

    def _promoted(self) -> dict[str, tuple[Column, str]]:
        return {f: (F.col(f"`p_{f}`"), t.lower()) for f, t in self._state["promoted"]}

    def _schema(self) -> str:
        return ", ".join([COLUMNS, *(f"`p_{f}` {t}" for f, t in self._state["promoted"])])

    def _read(self, names: list[str], schema: str) -> DataFrame:
        if not names:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.store.path}/{n}" for n in names])

    def _live(self, after: int = 0) -> DataFrame:
        """Live rows, of segments later than ``after`` alone."""
        rows = self._read([s["name"] for s in self._state["segments"] if s["seq"] > after], self._schema())
        gone = self._tombstones()
        return rows if gone is None else rows.join(gone, (F.col("id") == F.col("dead_id")) & (F.col("seq") < F.col("dead_seq")), "left_anti")

    def _tombstones(self) -> DataFrame | None:
        if not self._state["tombstones"]:
            return None
        dead = self._read([t["name"] for t in self._state["tombstones"]], "id long, seq long")
        return dead.groupBy(F.col("id").alias("dead_id")).agg(F.max("seq").alias("dead_seq"))

    def rows(self, seq: bool = False) -> DataFrame:
        """(id, vector, metadata) of the live rows, and the number of the change that brought each if asked for."""
        self._usable()
        return self._live().select("id", "vector", "metadata", *(["seq"] if seq else []))

    def conflicts(self, df: DataFrame, id_: str = "id") -> DataFrame:
        """The ids of ``df`` that are live already, which ``insert`` would refuse."""
        self._usable()
        return df.select(F.col(id_).cast("long").alias("id")).join(self._live().select("id"), "id", "left_semi")

    # changes

    def insert(self, df: DataFrame, id_: str = "id", vector: str = "vector", metadata: str | None = "metadata") -> None:
        """Append all rows or none.  Ids are positive and new; vectors are whole and finite; metadata is JSON or null."""
        self._writable()
        meta = F.col(metadata).cast("string") if metadata and metadata in df.columns else F.lit(None).cast("string")
        name, segments = self._stage(df.select(F.col(id_).cast("long").alias("id"), F.col(vector).cast("array<float>").alias("vector"), F.nullif(meta, F.lit("")).alias("metadata")))
        try:
            self._check(self._read([name], self._schema()))
        except Exception:
            self.store.delete(name)
            raise
        self._commit(**segments)

    def _stage(self, rows: DataFrame) -> tuple[str, dict]:
        """A new segment of rows (id, vector, metadata): its name, and what a commit changes to bring it in."""
        seq = self._state["seq"] + 1
        rows = rows.withColumn("norm", squared_norm(F.col("vector"))).withColumn("seq", F.lit(seq).cast("long"))
        for field, kind in self._state["promoted"]:
            rows = rows.withColumn(f"p_{field}", F.get_json_object("metadata", "$." + field).try_cast(kind))
        name = self.store.new_name("segment")
        rows.write.parquet(f"{self.store.path}/{name}")
        return name, {"seq": seq, "segments": [*self._state["segments"], {"name": name, "seq": seq}]}

    def _check(self, new: DataFrame) -> None:
        """Rules of a staged segment: one pass, a group by id, and a join with the live ids."""
        # the norm of a null vector or element is null; that of NaN or infinity is not finite, and no sum of floats overflows
        bad_vector = F.col("norm").isNull() | F.isnan("norm") | (F.col("norm") == float("inf")) | (F.size("vector") != self.config.dimension)
        bad_meta = F.col("metadata").isNotNull() & F.try_parse_json("metadata").isNull()
        flag = lambda c: F.coalesce(F.max(c.cast("int")), F.lit(0))
        found = new.agg(flag(F.col("id").isNull() | (F.col("id") < 1)).alias("id"), flag(bad_vector).alias("vector"), flag(bad_meta).alias("metadata")).first()
        for what in ("id", "vector", "metadata"):
            if found[what]:
                raise InvalidArgument(f"a row's {what}")
        twice = new.groupBy("id").count().where("count > 1").first()
        if twice is not None:
            raise AlreadyExists(f"id {twice.id} is given twice")
        if self._state["segments"]:
            there = self.conflicts(new).first()
            if there is not None:
                raise AlreadyExists(f"id {there.id}")

    def insert_one(self, id_: int, vector: Sequence[float], metadata: str | None = None) -> None:
        """``insert`` of one row, which is checked here and not by jobs."""
        self._writable()
        row = np.asarray(vector, np.float32)
        if row.shape != (self.config.dimension,) or not np.isfinite(row).all():
            raise InvalidArgument(f"a vector needs {self.config.dimension} finite elements")
        if not 1 <= id_ < 1 << 63:
            raise InvalidArgument("a row's id")
        if metadata and not _is_json(metadata):
            raise InvalidArgument("a row's metadata")
        if self.exists(id_):
            raise AlreadyExists(f"id {id_}")
        made = self.spark.createDataFrame([(id_, row.tolist(), metadata or None)], "id long, vector array<float>, metadata string")
        self._commit(**self._stage(made.coalesce(1))[1])

    def delete(self, ids: int | Sequence[int] | DataFrame, missing_ok: bool = True) -> None:
        """Tombstones for the live ones of ``ids``.  Strictly, one that isn't live is an error, and nothing changes."""
        self._writable()
        if not isinstance(ids, DataFrame):
            ids = self.spark.createDataFrame([(int(i),) for i in ([ids] if isinstance(ids, int) else ids)], "id long")
        ids = ids.select(F.col("id").cast("long").alias("id")).distinct()
        live = self._live().select("id")
        if not missing_ok:
            missing = ids.join(live, "id", "left_anti").first()
            if missing is not None:
                raise NotFound(f"id {missing.id}")
        seq = self._state["seq"] + 1
        name = self.store.new_name("tombstones")
        live.join(ids, "id", "left_semi").select("id", F.lit(seq).cast("long").alias("seq")).write.parquet(f"{self.store.path}/{name}")
        self._commit(seq=seq, tombstones=[*self._state["tombstones"], {"name": name, "seq": seq}])

    def compact(self) -> None:
        """Live rows alone, sorted by id, and a new index over them; the former files go after the new state stands."""
        self._writable()
        old = [x["name"] for x in (*self._state["segments"], *self._state["tombstones"])] + ([self._state["index"]["name"]] if self._state["index"] else [])
        seq = self._state["seq"] + 1
        name = self.store.new_name("segment")
        self._live().withColumn("seq", F.lit(seq).cast("long")).sort("id").write.parquet(f"{self.store.path}/{name}")
        segments = [{"name": name, "seq": seq}]
        index = self._build_index(self._read([name], self._schema()), seq) if self.config.index is Index.HNSW else None
        self._commit(seq=seq, segments=segments, tombstones=[], index=index)
        for x in old:
            self.store.delete(x)
        self.store.prune()

    def _build_index(self, rows: DataFrame, seq: int) -> dict:
        name = self.store.new_name("index")
        hnsw.build(rows, self.config).write.partitionBy("shard").parquet(f"{self.store.path}/{name}")
        return {"name": name, "seq": seq}

    def build_index(self) -> None:
        """Index the live rows as they stand; later inserts are searched exactly beside it."""
        self._writable()
        old = self._state["index"]
        self._commit(index=self._build_index(self._live(), self._state["seq"]))
        if old:
            self.store.delete(old["name"])

    def update_index(self) -> None:
        """Insert the rows that came after the index into its graphs; deleted ones are marked.

        Where the collection has outgrown its shards twofold, or there is no index, it is built anew.
        """
        self._writable()
        old = self._state["index"]
        most = 2 * hnsw.shard_limit(self.config)
        source = self.source()
        if old is not None and source.delta is None and not any(t["seq"] > old["seq"] for t in self._state["tombstones"]):
            return
        delta = source.rows.limit(0) if source.delta is None else source.delta
        if old is None or source.shards.agg(F.coalesce(F.max(F.octet_length("ids") / 8), F.lit(0))).first()[0] + delta.count() / source.shards.count() > most:
            self.build_index()
            return
        seq, name = self._state["seq"], self.store.new_name("index")
        hnsw.insert(source.shards, delta, self.config).write.partitionBy("shard").parquet(f"{self.store.path}/{name}")
        self._commit(index={"name": name, "seq": seq})
        self.store.delete(old["name"])

    def sync(self) -> None:
        """Every change has been written when its call returns."""
        self._usable()

    # reading

    def search(self, query: Sequence[float], k: int, filter: str | None = None, ef: int = 0) -> DataFrame:  # noqa: A002
        """(rank, id, distance) of the k nearest live rows that the filter keeps."""
        self._usable()
        return execute(KnnQuery(tuple(map(float, query)), k, ef, filter), self.source())

    def search_batch(self, queries: DataFrame, k: int, ef: int = 0, query_id: str = "query_id", query_vector: str = "vector", filter: str | None = None, exact: bool = False) -> DataFrame:  # noqa: A002
        """(query_id, rank, id, distance) for each row of ``queries``, among the live rows that the filter keeps.

        An index may miss a few of the nearest; ``exact`` adds them.
        """
        self._usable()
        return execute_batch(queries, k, ef, self.source(), query_id, query_vector, filter, exact)

    def source(self) -> Source:
        """What the planner reads from."""
        index = self._state["index"]
        shards = None
        if index is not None:
            names = [f.name for f in T._parse_datatype_string(hnsw.SHARDS)]
            shards = self.spark.read.schema(hnsw.SHARDS).parquet(f"{self.store.path}/{index['name']}").select(names)
            if any(t["seq"] > index["seq"] for t in self._state["tombstones"]):
                later = self._tombstones().where(F.col("dead_seq") > index["seq"]).select(F.col("dead_id").alias("id"))
                shards = hnsw.remove(shards, later)
        later = index is not None and any(x["seq"] > index["seq"] for x in self._state["segments"])
        return Source(self.config, self._live(), shards, self._live(index["seq"]) if later else None, self._promoted())

    def get(self, id_: int) -> Row | None:
        """(id, vector, metadata), or None."""
        return self.rows().where(F.col("id") == F.lit(id_)).first()

    def get_strict(self, id_: int) -> Row:
        row = self.get(id_)
        if row is None:
            raise NotFound(f"id {id_}")
        return row

    def exists(self, id_: int) -> bool:
        return not self._live().where(F.col("id") == F.lit(id_)).isEmpty()

    def count(self) -> int:
        self._usable()
        return self._live().count()

    def range(self, low: int, high: int) -> DataFrame:
        """Live rows with ids from low to high, in order."""
        return self.rows().where(F.col("id").between(low, high)).orderBy("id")

    def dump(self) -> DataFrame:
        return self.rows().orderBy("id")

    def info(self) -> DataFrame:
        """One row: version, dimension, metric, index, count and bytes."""
        names = [x["name"] for x in (*self._state["segments"], *self._state["tombstones"])] + ([self._state["index"]["name"]] if self._state["index"] else [])
        major, minor, _ = map(int, __version__.split("."))
        row = (major, minor, self.config.dimension, self.config.metric.value, self.config.index.value, self.count(), self.store.bytes(names))
        return self.spark.createDataFrame([row], "version_major int, version_minor int, dimension int, metric string, index_type string, count long, bytes long")

    def manifest(self) -> str:
        return json.dumps(self._state, sort_keys=True)
