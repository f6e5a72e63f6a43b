"""Streaming ingest: each micro-batch is one insert or one change set of a collection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..errors import InvalidArgument
from ..sources.collection import Collection


def ingest(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Insert the rows (id, vector, metadata) of a stream.

    A row whose id is live already is skipped, so a batch that runs again after a failure changes nothing; of rows with
    one id in a batch the least by vector and metadata is taken.
    """

    def apply(batch: DataFrame, _: int) -> None:
        rest = F.struct(*(F.col(f"`{c}`") for c in batch.columns if c != "id"))
        rows = batch.groupBy("id").agg(F.min(rest).alias("rest")).select("id", "rest.*")
        rows = rows.join(collection.rows().select("id"), "id", "left_anti")
        if not rows.isEmpty():
            collection.insert(rows)

    return _started(stream, apply, checkpoint, available_now)


def apply_changes(stream: DataFrame, collection: Collection, checkpoint: str, available_now: bool = True, order: str = "order") -> StreamingQuery:
    """Rows (op, id, vector, metadata[, order]): ``delete`` removes an id, anything else replaces its row.

    Of several changes of an id in a micro-batch the last by ``order`` holds.  Without that column an id may change once in
    a micro-batch; more are an error, as their order would be anyone's guess.
    """

    def apply(batch: DataFrame, _: int) -> None:
        batch = batch.persist()
        try:
            if order in batch.columns:
                whole = F.struct(*(F.col(f"`{c}`") for c in batch.columns))
                last = batch.groupBy("id").agg(F.max_by(whole, order).alias("last")).select("last.*")
            else:
                twice = batch.groupBy("id").count().where("count > 1").first()
                if twice is not None:
                    raise InvalidArgument(f"id {twice.id} changes twice and there is no column {order}")
                last = batch
            collection.delete(last.select("id"))
            rows = last.where(F.coalesce(F.lower("op") != "delete", F.lit(True)))
            if not rows.isEmpty():
                collection.insert(rows)
        finally:
            batch.unpersist()

    return _started(stream, apply, checkpoint, available_now)


def _started(stream: DataFrame, apply, checkpoint: str, available_now: bool) -> StreamingQuery:
    writer = stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
