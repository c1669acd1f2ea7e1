"""Extension: Structured Streaming as a way into the store, one commit for each micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from keyloom.sources.store import DEFAULT, open_store


def ingest(stream: DataFrame, root: str, checkpoint: str, cf: str = DEFAULT, source: str = "stream", **trigger) -> StreamingQuery:
    """Write a stream of (key, op, value) rows; a batch that was committed before a failure isn't committed again."""

    def commit(batch: DataFrame, batch_id: int) -> None:
        store = open_store(batch.sparkSession, root)
        if (source, batch_id) not in store.batches:
            store.apply({cf: batch}, extra=[{"batch": {"source": source, "id": batch_id}}])

    return stream.writeStream.foreachBatch(commit).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
