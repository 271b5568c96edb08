"""What log collectors make of raw lines before they push them: a message, a level and fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_PAIR = r'([A-Za-z0-9_.@-]+)=("(?:[^"\\]|\\.)*"|[^ ]*)'
_NGINX = r'^(\S+) \S+ (\S+) \[([^\]]+)\] "([^"]*)" (\d{3}) (\d+|-)(?: "([^"]*)" "([^"]*)")?'


def parse_logfmt(line: Column) -> Column:
    """A map of key=value pairs, quotes removed; of equal keys the last counts."""
    keys, values = (F.regexp_extract_all(line, F.lit(_PAIR), F.lit(i)) for i in (1, 2))
    values = F.transform(values, lambda v: F.when(F.startswith(v, F.lit('"')), F.regexp_replace(F.substring(v, F.lit(2), F.length(v) - 2), r"\\(.)", "$1")).otherwise(v))
    last = F.filter(F.transform(keys, lambda k, i: F.struct(k.alias("key"), F.get(values, i).alias("value"), i.alias("i"))), lambda e: F.size(F.filter(F.slice(keys, e["i"] + 2, F.size(keys)), lambda k: k == e["key"])) == 0)
    return F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))


def from_logfmt(line: Column) -> Column:
    """msg, level and the other fields of a logfmt line; a line without msg is its own message."""
    pairs = parse_logfmt(line)
    level = F.coalesce(pairs["level"], pairs["lvl"])
    return F.struct(F.coalesce(pairs["msg"], line).alias("msg"), level.alias("lvl"), F.map_filter(pairs, lambda k, _: ~k.isin("msg", "level", "lvl", "ts", "time")).alias("fields"))


def from_json_line(line: Column) -> Column:
    """msg and the other members of a JSON object as strings; anything else is its own message."""
    members = F.from_json(line, "map<string,string>")
    return F.struct(F.coalesce(members["msg"], line).alias("msg"), F.coalesce(F.map_filter(members, lambda k, v: (k != "msg") & v.isNotNull()), F.create_map().cast("map<string,string>")).alias("fields"))


def from_nginx(line: Column) -> Column:
    """The request of a combined access line as message, level info, the rest as fields; null for other lines."""
    part = lambda i: F.regexp_extract(line, _NGINX, i)
    names = {"remote_addr": 1, "remote_user": 2, "time_local": 3, "status": 5, "body_bytes_sent": 6, "http_referer": 7, "http_user_agent": 8}
    fields = F.map_filter(F.create_map(*[x for k, i in names.items() for x in (F.lit(k), part(i))]), lambda _, v: ~v.isin("", "-"))
    return F.when(line.rlike(_NGINX), F.struct(part(4).alias("msg"), F.lit("info").alias("lvl"), fields.alias("fields")))
