"""The events table as log lines, so that queries can be compared with SQL over its columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.columns import day_of, stream_id, time_of, without_empty


def event_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """tenant user_id % 3; tags app and type; fields the tags, id, user_id, value, k (but for every fourth event) and an empty note on every fifth."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    ts_ns = F.unix_micros("ts") * 1000
    tags = F.create_map(F.lit("app"), F.lit("events"), F.lit("type"), F.col("event_type"))
    text = lambda c: F.col(c).cast("string")
    k = F.when(F.col("event_id") % 4 != 0, F.get_json_object("props", "$.k"))
    note = F.when(F.col("event_id") % 5 == 0, F.lit("")).otherwise(F.lit("n"))
    fields = F.create_map(F.lit("app"), F.lit("events"), F.lit("type"), F.col("event_type"), F.lit("id"), text("event_id"), F.lit("user_id"), text("user_id"), F.lit("value"), text("value"), F.lit("k"), F.coalesce(k, F.lit("")), F.lit("note"), note)
    lines = e.select((F.col("user_id") % 3).alias("tenant_id"), ts_ns.alias("ts_ns"), F.concat("event_type", F.lit(" user="), text("user_id")).alias("msg"), without_empty(fields).alias("fields"), tags.alias("tags"))
    return lines.select("tenant_id", day_of(F.col("ts_ns")).alias("day"), stream_id(F.col("tags")).alias("stream_id"), "ts_ns", time_of(F.col("ts_ns")).alias("ts"), "msg", "fields", "tags")
