"""Keeping the lifecycle table up with a stream of deployment records."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import state


def follow(records: DataFrame, store: state.Store, checkpoint: str) -> StreamingQuery:
    """records: a stream of (object_fqn, object_type, file_path, status, deployed_at); runs over what there is, then ends."""

    def merge(batch: DataFrame, _: int) -> None:
        done = state.latest(batch.where("status = 'SUCCESS'"), "object_fqn", F.col("deployed_at"), F.col("file_path"))
        store.replace("object_lifecycle", state.upsert(store.read("object_lifecycle"), done, F.current_timestamp()))

    return records.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
