"""Feeding a table from a stream (an extension): each micro-batch is one checked, atomic insert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lodestone.engine import Engine


def insert_stream(engine: Engine, table: str, stream: DataFrame, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream to a table; a batch that breaks a rule ends the query and leaves the table as it was."""
    writer = stream.writeStream.foreachBatch(lambda batch, _: engine.insert_df(table, batch)).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
