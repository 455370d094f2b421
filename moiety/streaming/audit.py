"""A change feed that keeps an index in step: a stream of (compound, kind) settled per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame

from moiety.sources.index import IndexStore, collapse, event_changes


def feed(store: IndexStore, index: str, events: DataFrame, checkpoint: str, table=None, sync_each: bool = True):
    """Start the query. ``table()`` gives the source table as it is when a batch is settled.

    A batch's events are collapsed per compound before they are queued; a batch that is replayed
    queues the same changes again, which settles to the same index.
    """

    def settle(batch: DataFrame, _: int) -> None:
        store.enqueue(index, collapse(event_changes(batch, store.ids(index))))
        if sync_each:
            store.sync_data(index, table=table() if table else None)

    return events.writeStream.foreachBatch(settle).option("checkpointLocation", checkpoint).start()
