"""Column functions on times, tags, fields and values; built-in expressions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_NS = 86_400_000_000_000
# Keys that may hold a line's level, in the order in which they are looked for, and the levels' spellings.
LEVEL_KEYS = ("level", "lvl", "l", "@l")
LEVELS = {"trace": "trace", "debug": "debug", "info": "info", "warn": "warn", "warning": "warn", "error": "error", "err": "error", "fatal": "critical", "crit": "critical", "critical": "critical"}


def div(value: Column, by: int) -> Column:
    """Whole-number division; plain division is in floating point."""
    return F.call_function("div", value, F.lit(by))


def day_of(ts_ns: Column) -> Column:
    """The UTC day of nanoseconds since the epoch."""
    return F.date_from_unix_date(div(ts_ns, DAY_NS).cast("int"))


def time_of(ts_ns: Column) -> Column:
    return F.timestamp_micros(div(ts_ns, 1000))


def render_time(ts_ns: Column) -> Column:
    """RFC 3339 with milliseconds, cut off rather than rounded, in UTC whatever the session's zone."""
    ms = div(ts_ns, 1_000_000) % F.lit(DAY_NS // 1_000_000)
    part = lambda by, size, width: F.lpad((div(ms, by) % F.lit(size)).cast("string"), width, "0")
    return F.concat(day_of(ts_ns).cast("string"), F.lit("T"), part(3_600_000, 24, 2), F.lit(":"), part(60_000, 60, 2), F.lit(":"), part(1000, 60, 2), F.lit("."), part(1, 1000, 3), F.lit("Z"))


def day_key(day: Column) -> Column:
    return F.date_format(day, "ddMMyyyy")


def sorted_map(m: Column) -> Column:
    """The map with its entries in key order."""
    return F.map_from_entries(F.sort_array(F.map_entries(m)))


def stream_id(tags: Column) -> Column:
    """128 bits of a stream's tags, as hex: a digest of its sorted, length-prefixed entries, computed in the JVM."""
    piece = lambda s: F.concat(F.octet_length(s).cast("string"), F.lit(":"), s)
    entries = F.transform(F.sort_array(F.map_entries(tags)), lambda e: F.concat(piece(e["key"]), piece(e["value"])))
    return F.md5(F.array_join(entries, "").cast("binary"))


def without_empty(fields: Column) -> Column:
    return F.map_filter(fields, lambda _, v: F.length(v) > 0)


def renamed_reserved(fields: Column) -> Column:
    """Field keys that output uses for itself get an underscore; the empty key is the message's."""
    return F.transform_keys(fields, lambda k, _: F.when(k.isin("_msg", "_time"), F.concat(k, F.lit("_"))).otherwise(k))


def normal_level(fields: Column) -> Column:
    """The level under the first key that has a known one, in one spelling; else unknown."""
    spelled = F.create_map(*[F.lit(x) for pair in LEVELS.items() for x in pair])
    return F.coalesce(*[spelled[F.lower(fields[k])] for k in LEVEL_KEYS], F.lit("unknown"))


def word_tokens(text: Column) -> Column:
    """Distinct runs of ASCII letters, digits and underscores."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit("[A-Za-z0-9_]+"), F.lit(0)))


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"


def ipv4_to_long(text: Column) -> Column:
    """The address as a number; null for anything else."""
    parts = F.split(text, r"\.")
    number = sum((F.try_element_at(parts, F.lit(i + 1)).try_cast("bigint") * F.lit(256 ** (3 - i)) for i in range(4)), F.lit(0).cast("bigint"))
    return F.when(text.rlike(rf"^{_OCTET}(\.{_OCTET}){{3}}$"), number)


def long_to_ipv4(number: Column) -> Column:
    return F.concat_ws(".", *[F.shiftright(number, 24 - 8 * i).bitwiseAND(255).cast("string") for i in range(4)])


def inferred_type(values: Column) -> Column:
    """An aggregate: the physical type that fits all values of a column, tried from the narrowest."""
    ok = lambda c: F.coalesce(F.bool_and(F.coalesce(c, F.lit(False))), F.lit(False))
    whole, number = values.try_cast("decimal(20,0)"), values.try_cast("double")
    unsigned = ok(values.rlike("^[0-9]{1,20}$") & (whole <= F.lit("18446744073709551615").cast("decimal(20,0)")))
    most = F.max(whole)
    width = F.when(most < 256, "uint8").when(most < 65536, "uint16").when(most < 4294967296, "uint32").otherwise("uint64")
    iso = values.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]{1,9})?(Z|[+-][0-9]{2}:[0-9]{2})?$")
    return (
        F.when(F.count_distinct(values) <= 8, "dict").when(unsigned, width).when(ok(values.rlike("^[+-]?[0-9]{1,19}$") & values.try_cast("bigint").isNotNull()), "int64")
        .when(ok(values.rlike("^[+-]?[0-9]*[.]?[0-9]+([eE][+-]?[0-9]+)?$") & number.isNotNull()), "float64").when(ok(ipv4_to_long(values).isNotNull()), "ipv4").when(ok(iso & F.try_to_timestamp(values).isNotNull()), "timestampIso8601").otherwise("string")
    )
