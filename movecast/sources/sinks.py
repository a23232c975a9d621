"""Writers of forecasts and accuracy rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..schema import ACCURACY
from .points import stored_table


def write_forecasts(forecasts: DataFrame, path: str) -> None:
    """Append forecasts, one folder per variant and horizon, so the evaluation reads only what it scores."""
    forecasts.write.mode("append").partitionBy("variant", "horizon").parquet(path)


def append_bucketed(rows: DataFrame, name: str, path: str, kind: str, buckets: int) -> None:
    """Append forecasts or actuals to a bucketed table (``stored_table``). Rows go to their bucket's task first, so that an append
    writes one file per bucket and folder, whatever the number of tasks before."""
    table = stored_table(rows.sparkSession, name, path, kind, buckets)
    rows.select(*table.columns).repartition(buckets, "id", "timestamp").write.insertInto(name)


def write_accuracy(
    scored: DataFrame, path: str | None = None, *, jdbc_url: str | None = None, table: str = "accuracy_metrics",
    options: dict[str, str] | None = None,
) -> None:
    """Append accuracy rows to parquet or to a database table."""
    if (path is None) == (jdbc_url is None):
        raise ValueError("give either path or jdbc_url")
    rows = scored.select(*ACCURACY.fieldNames())
    if path is not None:
        rows.write.mode("append").parquet(path)
    else:
        rows.write.mode("append").format("jdbc").options(url=jdbc_url, dbtable=table, **(options or {})).save()


def stream_forecasts_to(
    forecasts: DataFrame, path: str, checkpoint: str, trigger: str | None = "1 second"
) -> StreamingQuery:
    """Start appending a forecast stream to parquet. ``trigger=None`` drains what is there and stops.

    One folder per variant: each task writes one file per micro-batch, not one per horizon.
    """
    writer = (
        forecasts.writeStream.outputMode("append")
        .format("parquet")
        .option("path", path)
        .option("checkpointLocation", checkpoint)
        .partitionBy("variant")
    )
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()


def stream_batches_to(
    forecasts: DataFrame, path: str, checkpoint: str, trigger: str | None = "1 second", files: int = 8, file_rows: int = 1 << 20
) -> StreamingQuery:
    """Start storing a forecast stream one folder per micro-batch (``batch=0``, ...), of at most ``files`` files per variant, or of
    as many as there are ``file_rows`` rows in it, so that no task grows with the micro-batch.

    A micro-batch that is run again, after a failure, overwrites its own folder, so its rows are there once; one without rows
    leaves none. ``read_forecasts`` reads all folders. ``trigger=None`` drains what is there and stops.
    """

    def store(batch: DataFrame, number: int) -> None:
        rows = batch.persist()
        try:
            if n := rows.count():
                rows.repartition(max(files, -(-n // file_rows)), "id").write.mode("overwrite").partitionBy("variant").parquet(f"{path}/batch={number}")
        finally:
            rows.unpersist()

    writer = forecasts.writeStream.outputMode("append").foreachBatch(store).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if trigger is None else writer.trigger(processingTime=trigger)
    return writer.start()
