"""Continuous loading: text files that arrive in a folder are appended to a stored table, each exactly once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from tessera.sources.tables import Stored, from_lines


def lines(stored: Stored, folder: str) -> DataFrame:
    """A stream of the table's rows from the folder's text files."""
    return from_lines(stored.spark.readStream.text(folder), stored.table.schema)


def ingest(stored: Stored, folder: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append what has arrived (or goes on arriving).

    Each batch is one run of the table, written as any append is (in ranges of the key for a clustered table). The version
    that adds it also records the stream's id and the batch's number, so a batch that is repeated after a failure is not
    added again.
    """

    def store(batch: DataFrame, epoch: int) -> None:
        stream = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        stored.append(batch, (stream, epoch))

    writer = lines(stored, folder).writeStream.foreachBatch(store).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()
