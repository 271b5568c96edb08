"""Named queries over the test tables, one for each operator, with SQL that gives the same rows."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.api import LogEngine
from logweir.functions import columns as fn
from logweir.lang.parser import from_json, parse
from logweir.operators import results, streams
from logweir.plans.compiler import MOST_LINES, matching_lines
from logweir.sources import collectors, push
from logweir.sources.store import LogStore, shared_dir
from logweir.sources.testdata import event_lines

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

MONTH = "[2024-01-01T00:00:00Z,2024-02-01T00:00:00Z]"
#: For relative ranges.
NOW = 1_705_276_800_000_000_000  # 2024-01-15T00:00:00Z

#: The mapping of events to lines, as SQL.
_L = """l AS (SELECT event_id AS id, user_id % 3 AS tenant_id, epoch_us(ts) * 1000 AS ts_ns, CAST(ts AS DATE) AS day, event_type AS type, user_id, CAST(value AS VARCHAR) AS value, value AS num,
  CASE WHEN event_id % 4 <> 0 THEN json_extract_string(props, '$.k') END AS k, CASE WHEN event_id % 5 <> 0 THEN 'n' END AS note, event_type || ' user=' || user_id AS msg,
  md5('3:app6:events4:type' || strlen(event_type) || ':' || event_type) AS stream_id FROM events)"""
_MONTH_NS = "ts_ns BETWEEN 1704067200000000000 AND 1706745600000000000"


def _add(name: str, sql: str | None = None):
    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return put


def _stored(spark: SparkSession, sf_dir: str, lines: DataFrame | None = None, **options) -> LogStore:
    """A new store of the events, or of some of them."""
    store = LogStore(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", **options)
    store.append(event_lines(spark, sf_dir) if lines is None else lines)
    return store


_stores: dict[tuple, LogStore] = {}


def event_store(spark: SparkSession, sf_dir: str) -> LogStore:
    """The store of the events, written once for an application; user_id has a column of its own."""
    key = spark.sparkContext.applicationId, sf_dir, shared_dir(spark)
    if key not in _stores or not _stores[key]._files(_stores[key].lines_path):
        _stores[key] = _stored(spark, sf_dir, promoted=("user_id",))
    return _stores[key]


def _query(spark: SparkSession, sf_dir: str, query, tenant: int) -> DataFrame:
    return LogEngine(event_store(spark, sf_dir)).run(query, tenant)


def _shown(lines: DataFrame) -> DataFrame:
    return lines.select(F.col("fields")["id"].cast("bigint").alias("id"), "ts_ns", "msg")


# Queries by text: tenant, text, the condition in SQL.
_TEXTS = {
    "tag_and_field": (0, MONTH + " {app=events AND type=error} user_id=12", "type = 'error' AND user_id = 12"),
    "tag_eq": (0, MONTH + " {type=error}", "type = 'error'"),
    "tag_ne": (1, MONTH + " {type!=error}", "type <> 'error'"),
    "tag_and": (2, MONTH + " {app=events AND type=click}", "type = 'click'"),
    "tag_or": (0, MONTH + " {type=click OR type=error}", "type IN ('click', 'error')"),
    "tag_missing": (0, MONTH + " {nothing!=x OR nothing=x OR type=error}", "type = 'error'"),
    "field_eq": (0, MONTH + " user_id=12", "user_id = 12"),
    "field_ne": (0, MONTH + " k!=5", "k <> '5'"),
    "field_missing": (1, MONTH + " {app=events} absent!=5 OR absent=5 OR absent<9 OR k!=3", "k <> '3'"),
    "msg_eq": (0, MONTH + " _msg='error user=12'", "msg = 'error user=12'"),
    "and_pred": (0, MONTH + " type=click AND k!=3", "type = 'click' AND k <> '3'"),
    "or_pred": (1, MONTH + " k=3 OR type=error", "(k = '3' OR type = 'error')"),
    "implicit_and": (0, MONTH + " type=click k!=3 note=n", "type = 'click' AND k <> '3' AND note = 'n'"),
    "and_before_or": (0, MONTH + " type=error OR type=click AND k=3", "(type = 'error' OR type = 'click' AND k = '3')"),
    "grouping_precedence": (0, MONTH + " (type=error OR type=click) AND k=3", "(type = 'error' OR type = 'click') AND k = '3'"),
    "tag_as_field": (2, MONTH + " type=click", "type = 'click'"),
    "empty_value": (0, MONTH + " note='' OR k=''  OR k=4", "k = '4'"),
    "no_tags_scan": (1, MONTH + " note=n", "note = 'n'"),
    "tenant_isolation": (2, MONTH + " type=error", "type = 'error'"),
    "top_2000": (0, MONTH + " {app=events}", "true"),
    "field_regex": (0, MONTH + " msg!=x OR value~'^1.*5$'", "regexp_matches(value, '^1.*5$')"),
    "field_not_regex": (0, MONTH + " k!~'^[1-4]'", "NOT regexp_matches(k, '^[1-4]')"),
    "field_cmp": (0, MONTH + " value>=100", "num >= 100"),
    "field_cmp_range": (2, MONTH + " value>10 value<=20.5", "num > 10 AND num <= 20.5"),
    "field_wildcard": (0, MONTH + " type=*r* AND user_id=1?", "type LIKE '%r%' AND CAST(user_id AS VARCHAR) LIKE '1_'"),
    "msg_contains": (0, MONTH + " =*user*12", "msg LIKE '%user%12'"),
    "any_field": (1, MONTH + " *=7", "(k = '7' OR CAST(user_id AS VARCHAR) = '7' OR value = '7' OR CAST(id AS VARCHAR) = '7')"),
    "field_len": (0, MONTH + " len(k) > 1", "length(k) > 1"),
    "msg_len": (0, MONTH + " len() > 14", "length(msg) > 14"),
}


def _text_query(tenant: int, text: str):
    return lambda spark, sf_dir: _shown(_query(spark, sf_dir, parse(text, NOW), tenant))


for _name, (_tenant, _text, _where) in _TEXTS.items():
    QUERIES[_name] = _text_query(_tenant, _text)
    ORACLES[_name] = f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE tenant_id = {_tenant} AND {_MONTH_NS} AND ({_where}) ORDER BY ts_ns DESC LIMIT {MOST_LINES}"

# Ranges: text and bounds.
for _name, _text, _lo, _hi in (
    ("time_range_inclusive", "[2024-01-10T00:00:00Z,2024-01-10T11:59:59.999999999Z] {app=events}", 1704844800 * 10**9, 1704887999999999999),
    ("absolute_range", "[2024-01-10T08:00:00+08:00,20240111] {app=events}", 1704844800 * 10**9, 1704931200 * 10**9),
    ("relative_range", "[-2d,now] {app=events}", NOW - 2 * 86400 * 10**9, NOW),
    ("omitted_bound", "[-36h,] {app=events}", NOW - 36 * 3600 * 10**9, NOW),
):
    QUERIES[_name] = _text_query(0, _text)
    ORACLES[_name] = f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE tenant_id = 0 AND ts_ns BETWEEN {_lo} AND {_hi} ORDER BY ts_ns DESC LIMIT {MOST_LINES}"

_STREAM_CLICK = "md5('3:app6:events4:type5:click')"


@_add("by_stream_ids", f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE tenant_id = 0 AND {_MONTH_NS} AND stream_id = {_STREAM_CLICK} ORDER BY ts_ns DESC LIMIT {MOST_LINES}")
def by_stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    import hashlib

    name = hashlib.md5(b"3:app6:events4:type5:click").hexdigest()
    body = {"start": 1704067200000000000, "end": 1706745600000000000, "streamIDs": [name, name, "0"]}
    return _shown(_query(spark, sf_dir, from_json(body), 0))


@_add("json_query", f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE tenant_id = 0 AND {_MONTH_NS} AND type = 'click' AND (k = '3' OR note <> 'x') ORDER BY ts_ns DESC LIMIT {MOST_LINES}")
def json_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaf = lambda k, op, v: {"predicate": {"key": k, "op": op, "value": v}}
    body = {"start": 1704067200000000000, "end": 1706745600000000000, "tagsExpr": leaf("type", "equal", "click"), "fieldsExpr": {"orOp": {"left": leaf("k", "equal", "3"), "right": leaf("note", "notEqual", "x")}}}
    return _shown(_query(spark, sf_dir, from_json(body), 0))


@_add("latest_first", f"WITH {_L}, t AS (SELECT id, ts_ns FROM l WHERE tenant_id = 0 AND {_MONTH_NS} AND type = 'error' ORDER BY ts_ns DESC LIMIT {MOST_LINES}) SELECT id, ts_ns, CAST(row_number() OVER (ORDER BY ts_ns DESC) AS BIGINT) AS place FROM t")
def latest_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The order itself, as places; at most 2000 rows are numbered."""
    from pyspark.sql import Window

    found = _shown(_query(spark, sf_dir, parse(MONTH + " {type=error}"), 0))
    return found.select("id", "ts_ns", F.row_number().over(Window.orderBy(F.col("ts_ns").desc())).cast("bigint").alias("place"))


_LINE = """'{"_time":"' || strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%gZ') || '","_msg":"' || msg || '","app":"events","id":"' || id || '"' ||
  coalesce(',"k":"' || k || '"', '') || coalesce(',"note":"' || note || '"', '') || ',"type":"' || type || '","user_id":"' || user_id || '","value":"' || value || '"}'"""
_ERRORS = f"tenant_id = 0 AND type = 'error' AND {_MONTH_NS} ORDER BY ts_ns DESC LIMIT {MOST_LINES}"


@_add("line_json", f"WITH {_L} SELECT {_LINE} AS line FROM l WHERE {_ERRORS}")
def line_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, parse(MONTH + " {type=error}"), 0).select(results.line_json().alias("line"))


@_add("pipe_json", f"WITH {_L} SELECT {_LINE} AS line FROM l WHERE {_ERRORS}")
def pipe_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, parse(MONTH + " {type=error} | json"), 0)


@_add("line_json_size", f"WITH {_L} SELECT id, CAST(strlen({_LINE}) AS INT) AS n_bytes FROM l")
def line_json_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(F.col("fields")["id"].cast("bigint").alias("id"), results.json_bytes().alias("n_bytes"))


@_add("time_render", f"WITH {_L} SELECT id, strftime(make_timestamp(ts_ns // 1000), '%Y-%m-%dT%H:%M:%S.%gZ') AS _time FROM l")
def time_render(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(F.col("fields")["id"].cast("bigint").alias("id"), fn.render_time(F.col("ts_ns")).alias("_time"))


@_add("drop_empty_fields", f"WITH {_L} SELECT id, CAST(5 + (k IS NOT NULL)::INT + (note IS NOT NULL)::INT AS INT) AS n_fields FROM l")
def drop_empty_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(F.col("fields")["id"].cast("bigint").alias("id"), F.size("fields").alias("n_fields"))


@_add("ingest_fields", f"WITH {_L} SELECT id, concat_ws(',', 'app=events', 'id=' || id, 'k=' || k, 'note=' || note, 'type=' || type, 'user_id=' || user_id, 'value=' || value) AS fields FROM l")
def ingest_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields in key order."""
    entries = F.map_entries(fn.sorted_map(F.col("fields")))
    return event_lines(spark, sf_dir).select(F.col("fields")["id"].cast("bigint").alias("id"), F.array_join(F.transform(entries, lambda e: F.concat(e["key"], F.lit("="), e["value"])), ",").alias("fields"))


@_add("stream_dim", f"WITH {_L} SELECT DISTINCT tenant_id, day, stream_id, type FROM l")
def stream_dim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_dimension(event_lines(spark, sf_dir)).select("tenant_id", "day", "stream_id", F.col("tags")["type"].alias("type"))


@_add("new_streams_anti", f"WITH {_L} SELECT DISTINCT tenant_id, day, stream_id FROM l a WHERE NOT EXISTS (SELECT 1 FROM l b WHERE b.type IN ('click', 'error') AND b.day < DATE '2024-01-15' AND b.tenant_id = a.tenant_id AND b.day = a.day AND b.stream_id = a.stream_id)")
def new_streams_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = event_lines(spark, sf_dir)
    known = streams.stream_dimension(lines.where(F.col("tags")["type"].isin("click", "error") & (F.col("day") < F.lit("2024-01-15").cast("date"))))
    return streams.new_streams(lines, known).select("tenant_id", "day", "stream_id")


@_add("stream_ids", f"WITH {_L} SELECT DISTINCT stream_id FROM l WHERE tenant_id = 1 AND day BETWEEN DATE '2024-01-05' AND DATE '2024-01-06'")
def stream_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.stream_ids(streams.stream_dimension(event_lines(spark, sf_dir)), 1, "2024-01-05", "2024-01-06")


@_add("tag_postings", f"WITH {_L} SELECT DISTINCT tenant_id, 'app' AS key, 'events' AS value, stream_id FROM l UNION SELECT DISTINCT tenant_id, 'type', type, stream_id FROM l")
def tag_postings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.tag_postings(streams.stream_dimension(event_lines(spark, sf_dir))).select("tenant_id", "key", "value", "stream_id")


@_add("table_stats", f"WITH {_L} SELECT tenant_id, day, count(*) AS n_lines, min(ts_ns) AS min_ts_ns, max(ts_ns) AS max_ts_ns FROM l GROUP BY ALL")
def table_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return streams.table_stats(event_lines(spark, sf_dir))


@_add("lines_per_day", f"WITH {_L} SELECT day, count(*) AS n FROM l GROUP BY day")
def lines_per_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """By the folders that the writer chose."""
    return event_store(spark, sf_dir).lines().groupBy("day").agg(F.count("*").alias("n"))


@_add("day_key", f"WITH {_L} SELECT strftime(day, '%d%m%Y') AS day_key, count(*) AS n FROM l GROUP BY 1")
def day_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).groupBy(fn.day_key(F.col("day")).alias("day_key")).agg(F.count("*").alias("n"))


@_add("late_data_bounds", f"WITH {_L} SELECT id FROM l WHERE day BETWEEN DATE '2024-01-12' AND DATE '2024-01-16'")
def late_data_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).where(push.in_retention(NOW, past_days=3)).select(F.col("fields")["id"].cast("bigint").alias("id"))


def _event_pushes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flat values, as a push body has them, of conversations: a stream for each role."""
    c = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    meta = F.create_map(F.lit("conv"), F.col("conv_id").cast("string"), F.lit("turn"), F.col("turn").cast("string"))
    return c.select(F.create_map(F.lit("role"), "role").alias("tags"), F.concat((F.lit(1_704_067_200) + F.col("conv_id")).cast("string"), F.lpad(F.col("turn").cast("string"), 9, "0")).alias("ts_text"), F.col("text").alias("msg"), meta.alias("meta"))


@_add("ingest_lines", "SELECT CAST(conv_id AS BIGINT) AS conv, CAST(turn AS BIGINT) AS turn, (1704067200 + conv_id) * 1000000000 + turn AS ts_ns, role, coalesce(text, '') AS msg FROM conversations")
def ingest_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = push.to_lines(_event_pushes(spark, sf_dir), 0)
    f = F.col("fields")
    return lines.select(f["conv"].cast("bigint").alias("conv"), f["turn"].cast("bigint").alias("turn"), "ts_ns", f["role"].alias("role"), "msg")


_LONG_MSG = "repeat(coalesce(text, '') || '.', 1 + CAST(turn % 4 AS INT) * 40)"


@_add("validate_lines", f"WITH c AS (SELECT *, octet_length(encode({_LONG_MSG})) AS n, CASE WHEN conv_id % 5 = 0 THEN 200 ELSE 3 END AS key_size, CASE WHEN conv_id % 3 = 0 THEN 12000 ELSE 1 END AS pad FROM conversations) SELECT conv_id AS conv, turn FROM c WHERE n <= 16384 AND key_size <= 128 AND n + pad + 2 * key_size + strlen(role) + strlen(CAST(conv_id AS VARCHAR)) + strlen(CAST(turn AS VARCHAR)) + 15 <= 32767")
def validate_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages, keys and whole lines on both sides of their limits."""
    more = F.create_map(F.lit("pad"), F.repeat(F.lit("p"), F.when(F.expr("CAST(element_at(meta, 'conv') AS INT) % 3 = 0"), 12000).otherwise(1)))
    key = F.repeat(F.lit("k"), F.when(F.expr("CAST(element_at(meta, 'conv') AS INT) % 5 = 0"), 200).otherwise(3))
    flat = _event_pushes(spark, sf_dir).withColumn("meta", F.map_concat("meta", more, F.create_map(key, key)))
    flat = flat.withColumn("msg", F.repeat(F.concat(F.coalesce("msg", F.lit("")), F.lit(".")), 1 + F.expr("CAST(element_at(meta, 'turn') AS INT) % 4") * 40))
    lines = push.to_lines(flat, 0).where(push.within_limits())
    return lines.select(F.col("fields")["conv"].cast("bigint").alias("conv"), F.col("fields")["turn"].cast("bigint").alias("turn"))


#: Bodies with one fault each, around an event's own values, and what they are refused for.
_FAULTS = (
    ("%s", None), ("x%s", "INVALID_JSON"), ('{"streams":{}}', "INVALID_STREAMS"), ('{"streams":[{"stream":{"a":1},"values":[]}]}', "INVALID_STREAM"), ('{"streams":[{"stream":{}}]}', "INVALID_VALUES"),
    ('{"streams":[{"stream":{},"values":[["1"]]}]}', "INVALID_VALUES"), ('{"streams":[{"stream":{},"values":[["-1","m"]]}]}', "INVALID_TIMESTAMP"), ('{"streams":[{"stream":{},"values":[["99999999999999999999","m"]]}]}', "INVALID_TIMESTAMP"),
    ('{"streams":[{"stream":{},"values":[["1","m",{"a":1}]]}]}', "INVALID_METADATA"), ('{"streams":[{"stream":{"t":"v"},"values":[["12","m",{"a":"1"}],["x","m"]]}]}', "INVALID_TIMESTAMP"),
)


@_add("ingest_bad_ts", "SELECT event_id, CASE event_id % 10 " + " ".join(f"WHEN {i} THEN '{code}'" for i, (_, code) in enumerate(_FAULTS) if code) + " END AS code FROM events")
def ingest_bad_ts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What push bodies are refused for, one of them in ten not at all."""
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    good = F.to_json(F.struct(F.array(F.struct(F.create_map(F.lit("type"), F.col("event_type")).alias("stream"), F.array(F.array(F.col("event_id").cast("string"), F.col("event_type"))).alias("values"))).alias("streams")))
    body = F.lit(None).cast("string")
    for i, (text, _) in reversed(list(enumerate(_FAULTS))):
        body = F.when(F.col("event_id") % 10 == i, F.concat(F.lit(text[:-2]), good) if text.endswith("%s") else F.lit(text)).otherwise(body)
    return e.select("event_id", push.refusal(body).alias("code"))


@_add("ingest_push_flatten", f"WITH {_L} SELECT id, ts_ns, msg FROM l")
def ingest_push_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Push bodies as JSON text, one for each event, read and flattened."""
    e = event_lines(spark, sf_dir)
    body = F.to_json(F.struct(F.array(F.struct(F.col("tags").alias("stream"), F.array(F.array(F.col("ts_ns").cast("string"), F.col("msg"), F.to_json(F.map_filter("fields", lambda k, _: k == "id")))).alias("values"))).alias("streams")))
    parsed = e.select(F.from_json(body, push.PUSH_SCHEMA).alias("p")).select("p.*")
    lines = push.to_lines(push.flatten(parsed), 0)
    return _shown(lines)


@_add("scan_all", f"WITH {_L} SELECT id, ts_ns, msg FROM l")
def scan_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(event_lines(spark, sf_dir))


@_add("union_mem_disk", f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE {_ERRORS}")
def union_mem_disk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thirds of the lines are on disk, the tenant's errors among the others wait in an engine as a table of pushed bodies; streams of some days only wait."""
    lines = event_lines(spark, sf_dir)
    waits = (F.col("fields")["id"].cast("bigint") % 3 == 0) | (F.col("day") == F.lit("2024-01-14").cast("date"))
    engine = LogEngine(_stored(spark, sf_dir, lines.where(~waits)))
    found = lines.where((F.col("tenant_id") == 0) & (F.col("tags")["type"] == "error") & waits)
    engine.ingest_table(push.as_bodies(found))
    return _shown(engine.run(parse(MONTH + " {type=error}"), 0, waiting=True, now_ns=NOW + 15 * 86_400 * 10**9))


@_add("sorted_write_roundtrip", f"WITH {_L} SELECT id, ts_ns, msg FROM l")
def sorted_write_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_stored(spark, sf_dir).lines())


@_add("compaction_invariant", f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE day = DATE '2024-01-10'")
def compaction_invariant(spark: SparkSession, sf_dir: str) -> DataFrame:
    store = _stored(spark, sf_dir)
    store.compact("2024-01-10")
    return _shown(store.lines().where(F.col("day") == F.lit("2024-01-10").cast("date")))


@_add("promoted_field", f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE tenant_id = 0 AND {_MONTH_NS} AND user_id = 12 ORDER BY ts_ns DESC LIMIT {MOST_LINES}")
def promoted_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_query(spark, sf_dir, parse(MONTH + " user_id=12"), 0))


def _matched(spark: SparkSession, sf_dir: str, text: str, tenant: int) -> DataFrame:
    store = event_store(spark, sf_dir)
    return matching_lines(store.lines(), store.streams(), tenant, parse(text))


@_add("entry_count", f"WITH {_L} SELECT count(*) AS entries FROM l WHERE tenant_id = 0 AND type = 'error' AND {_MONTH_NS}")
def entry_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.entry_count(_matched(spark, sf_dir, MONTH + " {type=error}", 0))


_KEYS = "SELECT 'app' AS key, 'events' AS value FROM l UNION SELECT 'id', CAST(id AS VARCHAR) FROM l UNION SELECT 'k', k FROM l WHERE k IS NOT NULL UNION SELECT 'note', note FROM l WHERE note IS NOT NULL UNION SELECT 'type', type FROM l UNION SELECT 'user_id', CAST(user_id AS VARCHAR) FROM l UNION SELECT 'value', value FROM l"


@_add("field_keys", f"WITH {_L}, v AS ({_KEYS}) SELECT DISTINCT key FROM v")
def field_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.field_keys(event_lines(spark, sf_dir))


@_add("field_values", f"WITH {_L}, v AS ({_KEYS}) SELECT key, value FROM v")
def field_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.field_values(event_lines(spark, sf_dir))


@_add("level_norm", "SELECT CASE WHEN o_orderpriority LIKE '1%' THEN 'critical' WHEN o_orderpriority LIKE '2%' THEN 'error' WHEN o_orderpriority LIKE '3%' THEN 'warn' ELSE 'unknown' END AS level, count(*) AS n FROM orders GROUP BY 1")
def level_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders' priorities as levels under different keys and spellings."""
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    first = F.substring("o_orderpriority", 1, 1)
    fields = F.when(first == "1", F.create_map(F.lit("level"), F.lit("odd"), F.lit("lvl"), F.lit("FATAL"))).when(first == "2", F.create_map(F.lit("@l"), F.lit("Err"))).when(first == "3", F.create_map(F.lit("l"), F.lit("warning"))).otherwise(F.create_map(F.lit("x"), F.lit("info")))
    return results.levels(o.select(fields.alias("fields")))


@_add("complete_key", f"WITH {_L}, v AS ({_KEYS}) SELECT DISTINCT key FROM v WHERE starts_with(key, 'v') ORDER BY key LIMIT 5")
def complete_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.complete(event_lines(spark, sf_dir), "V")


@_add("value_histogram", f"WITH {_L} SELECT CAST(CASE WHEN num < 0 THEN 0 WHEN num >= 500 THEN 11 ELSE floor(num / 50) + 1 END AS BIGINT) AS bin, count(*) AS n FROM l GROUP BY 1")
def value_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return results.histogram(event_lines(spark, sf_dir), "value", 0, 500, 10)


@_add("msg_tokens", f"WITH {_L} SELECT id, token FROM (SELECT id, unnest(list_distinct(regexp_extract_all(msg, '[A-Za-z0-9_]+'))) AS token FROM l)")
def msg_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return event_lines(spark, sf_dir).select(F.col("fields")["id"].cast("bigint").alias("id"), F.explode(fn.word_tokens(F.col("msg"))).alias("token"))


@_add("ipv4_to_long", "SELECT event_id, (event_id % 256) * 16777216 + (user_id % 256) * 65536 + 7 * 256 + 1 AS n FROM events")
def ipv4_to_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    text = F.concat_ws(".", (F.col("event_id") % 256).cast("string"), (F.col("user_id") % 256).cast("string"), F.lit("7"), F.lit("1"))
    return e.select("event_id", fn.ipv4_to_long(fn.long_to_ipv4(fn.ipv4_to_long(text))).alias("n"))


@_add("type_inference", "SELECT * FROM (VALUES ('app', 'dict'), ('id', (SELECT CASE WHEN max(event_id) < 65536 THEN 'uint16' ELSE 'uint32' END FROM events)), ('type', 'dict'), ('value', 'float64')) t(key, type)")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = event_lines(spark, sf_dir).select(F.explode("fields").alias("key", "value")).where(F.col("key").isin("app", "id", "type", "value"))
    return v.groupBy("key").agg(fn.inferred_type(F.col("value")).alias("type"))


@_add("pipe_fields", f"WITH {_L} SELECT 'k=' || coalesce(k, '') || ',type=' || type AS kept, ts_ns FROM l WHERE tenant_id = 0 AND {_MONTH_NS} AND type = 'click' ORDER BY ts_ns DESC LIMIT {MOST_LINES}")
def pipe_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _query(spark, sf_dir, parse(MONTH + " {type=click} | fields(k, type)"), 0)
    return out.select(F.concat(F.lit("k="), F.coalesce(F.col("fields")["k"], F.lit("")), F.lit(",type="), F.col("fields")["type"]).alias("kept"), "ts_ns")


@_add("pipe_order_limit", f"WITH {_L} SELECT id, ts_ns, msg FROM l WHERE tenant_id = 0 AND {_MONTH_NS} ORDER BY ts_ns LIMIT 50")
def pipe_order_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _shown(_query(spark, sf_dir, parse(MONTH + " {app=events} | order(time) | limit(50)"), 0))


@_add("pipe_count", f"WITH {_L} SELECT type, count(*) AS hits FROM l WHERE tenant_id = 1 AND {_MONTH_NS} GROUP BY type")
def pipe_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _query(spark, sf_dir, parse(MONTH + " {app=events} | count(type) @hits"), 1)


@_add("pipe_concat", f"WITH {_L} SELECT id, type || ':' || user_id AS label FROM l WHERE tenant_id = 1 AND {_MONTH_NS} ORDER BY ts_ns DESC LIMIT {MOST_LINES}")
def pipe_concat(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = _query(spark, sf_dir, parse(MONTH + " {app=events} | concat(type, ':', user_id) @label"), 1)
    return out.select(F.col("fields")["id"].cast("bigint").alias("id"), F.col("fields")["label"].alias("label"))


@_add("parse_logfmt", "SELECT o_orderkey, o_orderpriority AS msg, lower(o_orderstatus) AS lvl, CAST(o_custkey AS VARCHAR) AS cust FROM orders")
def parse_logfmt(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = spark.read.parquet(f"{sf_dir}/orders.parquet")
    line = F.concat(F.lit("level="), F.lower("o_orderstatus"), F.lit(' msg="'), F.col("o_orderpriority"), F.lit('" cust='), F.col("o_custkey").cast("string"))
    return o.select("o_orderkey", collectors.from_logfmt(line).alias("p")).select("o_orderkey", "p.msg", "p.lvl", F.col("p.fields")["cust"].alias("cust"))


@_add("parse_json_line", "SELECT event_id, event_type AS msg, CAST(user_id AS VARCHAR) AS user FROM events")
def parse_json_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.to_json(F.struct(F.col("event_type").alias("msg"), F.col("user_id").alias("user")))
    return e.select("event_id", collectors.from_json_line(line).alias("p")).select("event_id", "p.msg", F.col("p.fields")["user"].alias("user"))


@_add("parse_nginx", "SELECT event_id, 'GET /' || event_type || ' HTTP/1.1' AS msg, '200' AS status, '10.0.0.' || (user_id % 256) AS remote_addr FROM events")
def parse_nginx(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    line = F.concat(F.lit("10.0.0."), (F.col("user_id") % 256).cast("string"), F.lit(' - - [10/Jan/2024:00:00:00 +0000] "GET /'), F.col("event_type"), F.lit(' HTTP/1.1" 200 17 "-" "agent"'))
    return e.select("event_id", collectors.from_nginx(line).alias("p")).select("event_id", "p.msg", F.col("p.fields")["status"].alias("status"), F.col("p.fields")["remote_addr"].alias("remote_addr"))

