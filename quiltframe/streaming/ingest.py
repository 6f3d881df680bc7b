"""Streaming appends to a store's table. Not a parity claim: an addition that reuses the same commit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from quiltframe.sources.store import Store


def append(stream: DataFrame, store: Store, table: str, checkpoint: str, key: str = "uid") -> StreamingQuery:
    """Commits each micro-batch's rows of new keys, so a batch that is run again adds nothing twice."""

    def commit(batch: DataFrame, _: int) -> None:
        rows = batch.dropDuplicates([key]).join(store.read(table).select(key), key, "left_anti")
        if not rows.isEmpty():
            store.append(table, rows)

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
