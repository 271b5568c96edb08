"""The dimension of streams, and what is kept about lines beside them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

KEYS = ["tenant_id", "day", "stream_id"]


def stream_dimension(lines: DataFrame) -> DataFrame:
    """Each stream once a day and tenant, with its tags; from lines that still have them."""
    return lines.select(*KEYS, "tags").dropDuplicates(KEYS)


def new_streams(batch: DataFrame, known: DataFrame) -> DataFrame:
    """Streams of a batch that aren't known yet on their day."""
    return stream_dimension(batch).join(known.select(*KEYS), KEYS, "left_anti")


def stream_ids(streams: DataFrame, tenant: int, first_day: str, last_day: str) -> DataFrame:
    """Distinct streams of a tenant over whole days."""
    return streams.where((F.col("tenant_id") == tenant) & F.col("day").between(F.lit(first_day).cast("date"), F.lit(last_day).cast("date"))).select("stream_id").distinct()


def tag_postings(streams: DataFrame) -> DataFrame:
    """For each tenant, tag key and value its streams, one row each; a common tag's streams stay in many tasks."""
    return streams.select("tenant_id", "stream_id", F.explode("tags").alias("key", "value")).distinct()


def table_stats(lines: DataFrame) -> DataFrame:
    """Rows and first and last time of each day and tenant."""
    return lines.groupBy("tenant_id", "day").agg(F.count("*").alias("n_lines"), F.min("ts_ns").alias("min_ts_ns"), F.max("ts_ns").alias("max_ts_ns"))
