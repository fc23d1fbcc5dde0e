"""Continuous ingestion: each micro-batch of a stream is one upsert."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from quern.engine import Engine


def upsert_stream(engine: Engine, name: str, stream: DataFrame, checkpoint: str, *, position: str | None = None, available_now: bool = False, interval: str = "1 minute") -> StreamingQuery:
    """Starts a query that writes ``stream``, which has the table's columns, to table ``name``.

    ``position``: a long column that orders rows of one key within a micro-batch.  A batch that is replayed after a
    failure is not written again: the manifest knows the last batch of each checkpoint that is in the table.
    """
    engine.get_schema(name)

    def one(batch: DataFrame, number: int) -> None:
        engine.write(name, batch, position=F.col(position) if position else None, fence=(checkpoint, number))

    writer = stream.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime=interval)).start()
