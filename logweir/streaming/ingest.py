"""Push files as a stream into a store."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from pyspark.sql import functions as F

from logweir.sources.push import flatten, in_retention, parsed, refusal, to_lines, within_limits
from logweir.sources.store import LogStore
from logweir.streaming.metrics import Metrics

REJECTS = "body string, code string"


def start_ingest(store: LogStore, source: str, checkpoint: str, tenant: int, now_ns: int | None = None, trigger: str | None = None, files_per_batch: int = 1000, bytes_per_batch: int | None = None, metrics: Metrics | None = None) -> StreamingQuery:
    """Follows a folder of files with a push body on each line; each micro-batch adds its new streams and its allowed lines.

    now_ns: the clock for the days that are kept, fixed for tests and replays; None takes the time of each batch.
    trigger: an interval such as "500 milliseconds"; None takes what is there and ends. files_per_batch and bytes_per_batch
    bound a batch; the rest waits. A malformed body is refused as a whole: none of its lines is taken, it goes
    to the store's rejects with the code of the refusal, and ingest_refused counts it; the others go on. Each batch is
    taken once, however often it is tried.
    """
    import time

    spark = store.spark
    reader = spark.readStream.option("maxFilesPerTrigger", files_per_batch) if bytes_per_batch is None else spark.readStream.option("maxBytesPerTrigger", bytes_per_batch)
    bodies = reader.text(source).select(F.col("value").alias("body")).where("btrim(body) <> ''")

    def write(batch: DataFrame, number: int) -> None:
        checked = batch.withColumn("code", refusal(F.col("body"))).persist()
        try:
            good = checked.where("code IS NULL").select(parsed(F.col("body")))
            lines = to_lines(flatten(good), tenant).where(within_limits() & in_retention(now_ns or time.time_ns()))
            bad = checked.where("code IS NOT NULL")
            if not bad.isEmpty():
                bad.write.mode("overwrite").json(f"{store.path}/rejects/batch={number}")
            if store.append(lines, f"batch-{number}") and metrics is not None:
                for row in checked.groupBy("code").agg(F.count("*").alias("n")).collect():
                    metrics.add("ingest_refused" if row["code"] else "ingest_bodies", row["n"], **({"code": row["code"]} if row["code"] else {}))
        finally:
            checked.unpersist()

    stream = bodies.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (stream.trigger(processingTime=trigger) if trigger else stream.trigger(availableNow=True)).start()


def rejects(store: LogStore) -> DataFrame:
    """batch, body and code of the bodies that were refused."""
    path = f"{store.path}/rejects"
    if not store._fs().exists(store._path(path)):
        return store.spark.createDataFrame([], REJECTS + ", batch int")
    return store.spark.read.schema(REJECTS + ", batch int").json(path)
