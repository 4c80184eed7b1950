"""Running live queries."""

from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame

SECONDS_BETWEEN_READS = 2  # fixed value

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
NO_DATA = "spark.sql.streaming.noDataMicroBatches.enabled"


def use_rocksdb(spark) -> None:
    """The stateful operators need the RocksDB state store."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKSDB)


@contextmanager
def _ending(spark):
    """Operators with timers ask for batches without data for ever; a run that is to end does without them."""
    before = spark.conf.get(NO_DATA)
    spark.conf.set(NO_DATA, "false")
    try:
        yield
    finally:
        spark.conf.set(NO_DATA, before)


def _run(stream, writer, live):
    if live:
        return writer.trigger(processingTime=f"{SECONDS_BETWEEN_READS} seconds").start()
    timed = "TransformWithState" in stream._jdf.queryExecution().analyzed().toString()
    with _ending(stream.sparkSession) if timed else nullcontext():
        query = writer.trigger(availableNow=True).start()
        query.awaitTermination()
    return query


def run_to_table(stream: DataFrame, path: str, checkpoint: str, live=False, partition_by=()):
    """Append a stream to a parquet table; without ``live`` all there is, then stop.

    The checkpoint holds the offset read so far, so the next run goes on there.
    Timers that are due go off in the next batch; only ``live`` runs have
    batches without data.
    """
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    return _run(stream, writer, live)


def for_each_batch(stream: DataFrame, hook, checkpoint: str, live=False, mode="append"):
    """Call ``hook(batch, batch_id)`` with every micro-batch."""
    use_rocksdb(stream.sparkSession)
    writer = stream.writeStream.foreachBatch(hook).option("checkpointLocation", checkpoint).outputMode(mode)
    return _run(stream, writer, live)
