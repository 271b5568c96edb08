"""Shapes of results: rendered lines, keys, values, levels, counts and completions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.columns import normal_level, render_time, without_empty


def line_json() -> Column:
    """A line as a JSON object: _time, _msg and its non-empty fields, in key order."""
    head = F.create_map(F.lit("_time"), render_time(F.col("ts_ns")))
    message = F.when(F.length("msg") > 0, F.create_map(F.lit("_msg"), F.col("msg"))).otherwise(F.create_map().cast("map<string,string>"))
    merged = F.concat(F.map_entries(head), F.map_entries(message), F.sort_array(F.map_entries(without_empty(F.col("fields")))))
    return F.to_json(F.map_from_entries(merged))


def json_bytes() -> Column:
    """Bytes of a line as line_json gives it."""
    return F.octet_length(line_json())


def response(lines: DataFrame) -> str:
    """The body of a query's answer; lines are those of a query, so at most its limit."""
    return '{"lines":[' + ",".join(r[0] for r in lines.select(line_json()).collect()) + "]}"


def entry_count(lines: DataFrame) -> DataFrame:
    return lines.agg(F.count("*").alias("entries"))


def field_keys(lines: DataFrame) -> DataFrame:
    return lines.select(F.explode(F.map_keys("fields")).alias("key")).distinct()


def field_values(lines: DataFrame) -> DataFrame:
    """key and value pairs; distinct before anything is gathered, so a key with many values stays in many tasks."""
    return lines.select(F.explode("fields").alias("key", "value")).distinct()


def levels(lines: DataFrame) -> DataFrame:
    return lines.groupBy(normal_level(F.col("fields")).alias("level")).agg(F.count("*").alias("n"))


def complete(lines: DataFrame, prefix: str, most: int = 5) -> DataFrame:
    """Up to five keys that start with a prefix, whatever the case, in order."""
    return field_keys(lines).where(F.startswith(F.lower("key"), F.lit(prefix.lower()))).orderBy("key").limit(most)


def histogram(lines: DataFrame, key: str, low: float, high: float, bins: int) -> DataFrame:
    """Lines by bin of a numeric field; bin 0 is below low, bins + 1 at high or above."""
    number = F.col("fields")[key].try_cast("double")
    return lines.where(number.isNotNull()).groupBy(F.width_bucket(number, F.lit(low), F.lit(high), F.lit(bins)).alias("bin")).agg(F.count("*").alias("n"))
