"""Streams into managed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from lithic.operators.table import Table


def append_stream(stream: DataFrame, table: Table, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch is one insert; a batch that is replayed after a failure is recognised and skipped."""

    def write(batch: DataFrame, number: int) -> None:
        now = Table.open(batch.sparkSession, table.path)
        done = lambda state: state.get("stream", {})
        if done(now.state).get(checkpoint, -1) < number:
            # Progress is part of the commit, and follows commits of other writers like the rows do.
            now.insert(batch, lambda state: {"stream": done(state) | {checkpoint: number}})

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()
