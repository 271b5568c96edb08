"""Steps after the filter, which are designed for the language but not part of what it runs elsewhere."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.lang.errors import ExpectedLiteral, QueryError
from logweir.lang.tree import MESSAGE, Pipe


def value_of(name: str, columns: list[str]) -> Column:
    """An argument: a quoted literal, a column of a counted result, the message, the time or a field."""
    if name[:1] in "'\"":
        return F.lit(name[1:-1])
    if name in columns and name not in ("fields",):
        return F.col(f"`{name}`").cast("string")
    if name == MESSAGE:
        return F.col("msg")
    if name in ("time", "_time"):
        return F.col("ts_ns")
    return F.col("fields")[name]


def _chosen(keys: tuple[str, ...], inside: bool) -> Column:
    """The fields with these keys, or all others."""
    return F.map_filter("fields", lambda k, _: k.isin(*keys) if inside else ~k.isin(*keys))


def apply(lines: DataFrame, pipes: tuple[Pipe, ...], limit: int | None) -> DataFrame:
    """The pipes in turn. Lines that no pipe orders, cuts or counts come newest first and cut to limit."""
    from logweir.plans.compiler import newest

    shaped = any(p.name in ("order", "limit", "count") for p in pipes)
    out = lines if shaped else newest(lines, limit)
    for i, p in enumerate(pipes):
        columns = out.columns
        if p.name == "fields":
            out = out.withColumn("fields", _chosen(p.args, True))
        elif p.name == "order":
            by, _, direction = (p.args[0] if p.args else "time").partition(" ")
            direction = direction or (p.args[1] if len(p.args) > 1 else "asc")
            column = F.col(f"`{by}`") if by in columns and by != "fields" else value_of(by, columns)
            ties = [F.col(c) for c in ("ts_ns", "stream_id", "msg") if c in columns] or [F.col(f"`{c}`") for c in columns]
            out = out.orderBy(column.desc() if direction == "desc" else column.asc(), *ties)
        elif p.name == "limit":
            n = int(p.args[0]) if p.args and p.args[0].isdigit() else None
            if n is None:
                raise ExpectedLiteral("limit takes a number")
            if not any(x.name == "order" for x in pipes[:i]) and "ts_ns" in columns:
                out = newest(out, None)
            out = out.limit(n)
        elif p.name == "count":
            keys = [value_of(a, columns).alias(a) for a in p.args if a != "hits"]
            name = p.into or "count"
            out = out.groupBy(*keys).agg(F.count("*").alias(name)) if keys else out.agg(F.count("*").alias(name))
        elif p.name == "concat":
            name = p.into or "concat"
            made = F.concat(*[F.coalesce(value_of(a, columns), F.lit("")) for a in p.args])
            out = out.withColumn("fields", F.map_concat(_chosen((name,), False), F.create_map(F.lit(name), made))) if "fields" in columns else out.withColumn(name, made)
        elif p.name == "json":
            from logweir.operators.results import line_json

            out = out.select(line_json().alias("line")) if "fields" in columns else out.select(F.to_json(F.struct("*")).alias("line"))
        else:
            raise QueryError(f"{p.name} is no function")
    return out
