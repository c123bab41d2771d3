"""An extension: the latest-arrival upsert as a stream of landed files.

No watermark: late rows are always admitted per key, which a watermark would drop.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tidemark.sources.merge import merge_into
from tidemark.sources.store import Store


def upsert_stream(arrivals: DataFrame, store: Store, table: str, keys: list[str], received: str, checkpoint: str) -> StreamingQuery:
    """Fold each micro-batch into a store table. Replaying a batch changes nothing, since only later arrivals win."""

    def fold(batch: DataFrame, _: int) -> None:
        merge_into(store, table, batch, keys, received)

    return arrivals.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
