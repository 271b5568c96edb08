"""A LogQuery as a DataFrame over lines and streams.

Every plan filters by tenant, by day (derived from the time range, so partitions are pruned) and by time. Tags are
decided on the small streams table, whose matching streams semi-join the lines; fields become column conditions, on
promoted columns where a table has them so that they reach the Parquet scan. Newest lines first, through a top-k.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.columns import day_of
from logweir.lang.errors import ExpectedLiteral, UnexpectedTagExpression
from logweir.lang.tree import ANY, MESSAGE, TAG_OPS, Both, Expression, LogQuery, Predicate

#: Lines that a query returns at most, newest first.
MOST_LINES = 2000
PROMOTED = "f_"
_LONG_MAX = (1 << 63) - 1


def _like(value: str) -> str:
    """A pattern with * and ? as one for LIKE."""
    return re.sub(r"[\\%_]", lambda m: "\\" + m.group(), value).replace("*", "%").replace("?", "_")


def _matches(value: Column, p: Predicate) -> Column:
    """The predicate on a value; a missing value gives null, which filters take as false, as no operator negates."""
    if p.function == "len":
        value = F.length(value)
    if p.op in ("=", "!="):
        if p.function:
            hit = value == F.lit(_number(p.value))
        else:
            hit = value.like(_like(p.value)) if p.wild else value == F.lit(p.value)
        return hit if p.op == "=" else ~hit
    if p.op in ("~", "!~"):
        hit = value.rlike(p.value)
        return hit if p.op == "~" else ~hit
    number, bound = value if p.function else value.try_cast("double"), F.lit(_number(p.value))
    return {"<": number < bound, "<=": number <= bound, ">": number > bound, ">=": number >= bound}[p.op]


def _number(text: str) -> float:
    try:
        return float(text)
    except ValueError:
        raise ExpectedLiteral(f"{text} is no number") from None


def condition(e: Expression, columns: set[str], values: str = "fields") -> Column:
    """The condition of an expression on the rows of a table with these columns."""
    if not isinstance(e, Predicate):
        left, right = condition(e.left, columns, values), condition(e.right, columns, values)
        return left & right if isinstance(e, Both) else left | right
    if values == "tags":
        if e.op not in TAG_OPS or e.wild or e.function:
            raise UnexpectedTagExpression(str(e))
        return _matches(F.col("tags")[e.key], e)
    if e.key == ANY:
        return F.exists(F.map_values("fields"), lambda v: F.coalesce(_matches(v, e), F.lit(False))) | F.coalesce(_matches(F.col("msg"), e), F.lit(False))
    if e.key == MESSAGE:
        return _matches(F.when(F.length("msg") > 0, F.col("msg")) if e.function or e.op != "=" else F.col("msg"), e)
    if PROMOTED + e.key in columns:
        return _matches(F.col(f"`{PROMOTED}{e.key}`"), e)
    return _matches(F.col("fields")[e.key], e)


def in_range(query: LogQuery) -> Column:
    """Both bounds inclusive, with the days that they span."""
    lo, hi = F.lit(min(query.start, _LONG_MAX)), F.lit(min(query.end, _LONG_MAX))
    return F.col("day").between(day_of(lo), day_of(hi)) & F.col("ts_ns").between(lo, hi)


def matching_streams(streams: DataFrame, tenant: int, query: LogQuery) -> DataFrame:
    """day and stream_id of the streams that the tags ask for."""
    lo, hi = F.lit(min(query.start, _LONG_MAX)), F.lit(min(query.end, _LONG_MAX))
    found = streams.where((F.col("tenant_id") == tenant) & F.col("day").between(day_of(lo), day_of(hi)))
    return found.where(condition(query.tags, set(), "tags")).select("day", "stream_id").distinct()


def matching_lines(lines: DataFrame, streams: DataFrame, tenant: int, query: LogQuery, most_pushed: int = 0) -> DataFrame:
    """All lines of one tenant that a query matches, in no order.

    most_pushed: if the tags ask for so many streams at most, they are looked up first and named to the scan, whose files are
    sorted by stream; a stream's number stands for its tags, so no join is needed then.
    """
    out = lines.where((F.col("tenant_id") == tenant) & in_range(query))
    if query.stream_ids is not None:
        out = out.where(F.col("stream_id").isin(*query.stream_ids)) if query.stream_ids else out.where(F.lit(False))
    if query.tags is not None:
        wanted = matching_streams(streams, tenant, query)
        names = [r[0] for r in wanted.select("stream_id").distinct().limit(most_pushed + 1).collect()] if most_pushed else []
        if most_pushed and len(names) <= most_pushed:
            out = out.where(F.col("stream_id").isin(*sorted(names)) if names else F.lit(False))
        else:
            out = out.join(wanted, ["day", "stream_id"], "left_semi")
    if query.fields is not None:
        out = out.where(condition(query.fields, set(lines.columns)))
    return out


def newest(lines: DataFrame, limit: int | None = MOST_LINES) -> DataFrame:
    """Newest first; equal times by stream and message, so that results are the same each time."""
    out = lines.orderBy(F.col("ts_ns").desc(), "stream_id", "msg", F.to_json("fields"))
    return out if limit is None else out.limit(limit)


def to_df(lines: DataFrame, streams: DataFrame, tenant: int, query: LogQuery, limit: int | None = MOST_LINES, most_pushed: int = 0) -> DataFrame:
    """The query's lines, newest first and cut, then its pipes in turn."""
    from logweir.operators.pipes import apply

    found = matching_lines(lines, streams, tenant, query, most_pushed)
    return apply(found, query.pipes, limit) if query.pipes else newest(found, limit)

