"""Streams of mutations into a table. A micro-batch that is delivered twice is committed once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from ..operators.resolve import latest
from ..plans.table import KVTable


def apply_batch(table: KVTable, batch: DataFrame, query: str, batch_id: int) -> bool:
    """Appends a micro-batch of key, value, deleted, seq; False if the table has it already.

    seq must come from the source (an offset or an event id), so that late rows lose to newer ones."""
    table.refresh()  # reads commits since the last batch alone
    if batch_id <= table.state.batches.get(query, -1):  # a stream's batches come in order
        return False
    table.append(latest(batch), query=query, batch=batch_id)
    table.compact_all()
    return True


def upsert_stream(stream: DataFrame, table: KVTable, query: str, checkpoint: str) -> DataStreamWriter:
    """The writer that applies the stream; start it with a trigger. Sources bound batches by maxFilesPerTrigger and the like."""
    return stream.writeStream.queryName(query).option("checkpointLocation", checkpoint).foreachBatch(lambda batch, id_: apply_batch(table, batch, query, id_))
