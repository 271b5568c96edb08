"""Push bodies to lines: ``{"streams": [{"stream": {tag: value}, "values": [[ns, message, {field: value}?], ...]}]}``."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.columns import DAY_NS, day_of, renamed_reserved, sorted_map, stream_id, time_of, without_empty
from logweir.lang.errors import InvalidPush

# Limits of a line.
MOST_FIELDS, MOST_KEY, MOST_VALUE, MOST_LINE = 512, 128, 16_384, 32_767
PUSH_SCHEMA = "streams array<struct<stream:map<string,string>,values:array<array<string>>>>"
CONTENT_TYPES = (None, "", "application/json")
#: Days that a line may lie in the past and in the future.
PAST_DAYS, FUTURE_DAYS = 30, 1


def check_push(body: str, content_type: str | None = None) -> dict:
    """The parsed body of one request; InvalidPush if any part has the wrong shape, so that none of it is taken."""
    if content_type is not None and content_type.split(";")[0].strip() not in CONTENT_TYPES:
        error = InvalidPush("UNSUPPORTED_CONTENT_TYPE", content_type)
        error.status = 415
        raise error
    try:
        data = json.loads(body)
    except ValueError as e:
        raise InvalidPush("INVALID_JSON", str(e)) from None
    if not isinstance(data, dict) or not isinstance(data.get("streams"), list):
        raise InvalidPush("INVALID_STREAMS", "streams must be an array")
    for s in data["streams"]:
        tags, values = (s.get("stream"), s.get("values")) if isinstance(s, dict) else (None, None)
        if not isinstance(tags, dict) or not all(isinstance(v, str) for v in tags.values()):
            raise InvalidPush("INVALID_STREAM", "stream must be an object of strings")
        if not isinstance(values, list):
            raise InvalidPush("INVALID_VALUES", "values must be an array")
        for v in values:
            if not isinstance(v, list) or len(v) not in (2, 3) or not isinstance(v[1], str):
                raise InvalidPush("INVALID_VALUES", "a value is a time, a message and maybe fields")
            if not isinstance(v[0], str) or not (v[0].isascii() and v[0].isdigit() and int(v[0]) < 1 << 63):
                raise InvalidPush("INVALID_TIMESTAMP", str(v[0]))
            if len(v) == 3 and not (isinstance(v[2], dict) and all(isinstance(x, str) for x in v[2].values())):
                raise InvalidPush("INVALID_METADATA", "fields must be an object of strings")
    return data


def refusal(body: Column) -> Column:
    """The code for which check_push refuses a body, else null; expressions only, for bodies that come in files."""
    kind = F.schema_of_variant
    text = lambda v: F.coalesce(kind(v) == "STRING", F.lit(False))
    texts = lambda m: F.coalesce(F.forall(F.map_values(m), text), F.lit(False))
    parsed = F.try_parse_json(body)
    streams = F.try_variant_get(parsed, "$.streams", "array<variant>")
    tags = lambda s: texts(F.try_variant_get(s, "$.stream", "map<string,variant>"))
    values = lambda s: F.try_variant_get(s, "$.values", "array<variant>")

    def of_value(v: Column) -> Column:
        parts = F.try_variant_get(v, "$", "array<variant>")
        ts = F.when(text(parts[0]), F.try_variant_get(parts[0], "$", "string"))
        digits = F.coalesce(ts.rlike("^[0-9]+$") & ts.try_cast("bigint").isNotNull(), F.lit(False))
        shape = parts.isNull() | ~F.size(parts).isin(2, 3) | ~text(F.get(parts, F.lit(1)))
        meta = (F.size(parts) == 3) & ~texts(F.try_variant_get(F.get(parts, F.lit(2)), "$", "map<string,variant>"))
        return F.when(shape, "INVALID_VALUES").when(~digits, "INVALID_TIMESTAMP").when(meta, "INVALID_METADATA")

    def of_stream(s: Column) -> Column:
        first = F.get(F.filter(F.transform(values(s), of_value), lambda c: c.isNotNull()), F.lit(0))
        return F.when(~tags(s), "INVALID_STREAM").when(values(s).isNull(), "INVALID_VALUES").otherwise(first)

    first = F.get(F.filter(F.transform(streams, of_stream), lambda c: c.isNotNull()), F.lit(0))
    return F.when(parsed.isNull(), "INVALID_JSON").when(streams.isNull(), "INVALID_STREAMS").otherwise(first)


def merged(tags: Column, more: Column) -> Column:
    """Two maps as one; where both have a key the second counts."""
    more = F.coalesce(more, F.create_map().cast("map<string,string>"))
    return F.map_concat(F.map_filter(tags, lambda k, _: ~F.map_contains_key(more, k)), more)


def flatten(pushes: DataFrame) -> DataFrame:
    """A row for each value of push bodies that were read with PUSH_SCHEMA: tags, stream_id, ts (text), msg, meta, and other columns."""
    rest = [c for c in pushes.columns if c != "streams"]
    streams = pushes.select(*rest, F.explode("streams").alias("s"))
    # A stream's tags and number are made once, not for each of its values.
    streams = streams.select(*rest, sorted_map(F.coalesce("s.stream", F.create_map().cast("map<string,string>"))).alias("tags"), F.col("s.values").alias("values"))
    streams = streams.withColumn("stream_id", stream_id(F.col("tags")))
    values = streams.select(*rest, "tags", "stream_id", F.explode("values").alias("v"))
    return values.select(*rest, "tags", "stream_id", F.get("v", F.lit(0)).alias("ts_text"), F.get("v", F.lit(1)).alias("msg"), F.from_json(F.get("v", F.lit(2)), "map<string,string>").alias("meta"))


def to_lines(flat: DataFrame, tenant: Column | int) -> DataFrame:
    """Lines with their tags. Tags are fields too, metadata goes before them, empty fields go; times must be digits."""
    ts = F.col("ts_text").try_cast("bigint")
    good = F.col("ts_text").rlike("^[0-9]+$") & ts.isNotNull()
    ts = F.when(good, ts).otherwise(F.raise_error(F.concat(F.lit("INVALID_TIMESTAMP: "), F.coalesce("ts_text", F.lit("null")))).cast("bigint"))
    if "stream_id" not in flat.columns:
        flat = flat.withColumn("tags", sorted_map(F.coalesce("tags", F.create_map().cast("map<string,string>")))).withColumn("stream_id", stream_id(F.col("tags")))
    flat = flat.select((F.lit(tenant) if isinstance(tenant, int) else tenant).cast("bigint").alias("tenant_id"), ts.alias("ts_ns"), F.coalesce("msg", F.lit("")).alias("msg"), "tags", "stream_id", sorted_map(without_empty(merged(F.col("tags"), renamed_reserved(F.coalesce("meta", F.create_map().cast("map<string,string>")))))).alias("fields"))
    return flat.select("tenant_id", day_of(F.col("ts_ns")).alias("day"), "stream_id", "ts_ns", time_of(F.col("ts_ns")).alias("ts"), "msg", "fields", "tags")


def parsed(body: Column) -> Column:
    """streams of push bodies that were checked; null for a malformed one, as a plan may read bodies before it leaves out the refused."""
    return F.from_json(body, PUSH_SCHEMA)["streams"].alias("streams")


def as_bodies(lines: DataFrame) -> DataFrame:
    """tenant and body: lines with their tags as push bodies, one for each."""
    start = F.to_json(F.array(F.col("ts_ns").cast("string"), "msg"))
    value = F.concat(F.substring(start, 1, F.length(start) - 1), F.lit(","), F.to_json("fields"), F.lit("]"))
    body = F.concat(F.lit('{"streams":[{"stream":'), F.to_json("tags"), F.lit(',"values":['), value, F.lit("]}]}"))
    return lines.select(F.col("tenant_id").alias("tenant"), body.alias("body"))


def within_limits() -> Column:
    """A line's fields, keys, values and total size are allowed; the message is a field with an empty key."""
    size = lambda a: F.aggregate(a, F.lit(0), lambda n, x: n + F.octet_length(x))

    def allowed(fields: Column) -> Column:
        keys, values = F.map_keys(fields), F.map_values(fields)
        small = F.forall(keys, lambda k: F.octet_length(k) <= MOST_KEY) & F.forall(values, lambda v: F.octet_length(v) <= MOST_VALUE)
        return (F.size(fields) + 1 <= MOST_FIELDS) & small & (size(keys) + size(values) + F.octet_length("msg") <= MOST_LINE)

    # Fields are named once: a filter may move below the expression that makes them, which would then be there for each use.
    return (F.octet_length("msg") <= MOST_VALUE) & F.forall(F.array("fields"), allowed)


def in_retention(now_ns: int, past_days: int = PAST_DAYS, future_days: int = FUTURE_DAYS) -> Column:
    """The line's day is within the days that are kept around now; other lines are dropped, however late they come."""
    today = now_ns // DAY_NS
    return F.col("day").between(F.date_from_unix_date(F.lit(int(today - past_days))), F.date_from_unix_date(F.lit(int(today + future_days))))


def read_push_files(spark: SparkSession, path: str, tenant: int) -> DataFrame:
    """Lines of files with a push body on each line; a malformed one fails the job."""
    return to_lines(flatten(spark.read.schema(PUSH_SCHEMA).option("mode", "FAILFAST").json(path)), tenant)


def decoded(body: bytes, encoding: str | None) -> bytes:
    """A request body without its content coding: none, or snappy where the library for it is installed."""
    if encoding in (None, "", "identity"):
        return body
    if encoding == "snappy":
        import pyarrow as pa

        size, shift, at = 0, 0, 0
        while True:  # the raw format starts with its length
            size |= (body[at] & 127) << shift
            at, shift = at + 1, shift + 7
            if body[at - 1] < 128:
                break
        return pa.decompress(body, size, "snappy", asbytes=True)
    raise InvalidPush("UNSUPPORTED_ENCODING", encoding)
