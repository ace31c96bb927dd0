"""Incremental appends to the relation store."""

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def append_edges(stream: DataFrame, path: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Append a stream of edges to the store's table, partitioned by site.

    Each micro-batch goes into a folder of its query and batch, so a batch that is run again after a
    failure replaces itself, and a new checkpoint, which counts from 0 again, replaces nothing. Contradictions are derived when the store is read (`store.append_relations`),
    never by rewriting old rows.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        query = batch.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId")
        batch.write.mode("overwrite").partitionBy("site_id").parquet(f"{path}/query={query}/batch={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start() if available_now else writer.start()
