"""The engine's interface: queries by text, structure or stream ids, stream ids, pushes and flushes."""

from __future__ import annotations

import json
import time
import uuid
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.lang import times
from logweir.lang.errors import InvalidPush
from logweir.lang.parser import from_json, parse
from logweir.lang.tree import LogQuery
from logweir.operators.results import response
from logweir.operators.streams import stream_dimension
from logweir.operators.streams import stream_ids as streams_of
from logweir.plans.compiler import MOST_LINES, to_df
from logweir.sources.push import check_push, decoded, flatten, in_retention, parsed, refusal, to_lines, within_limits
from logweir.sources.store import LogStore

MOST_BODY = 4 << 20
#: Streams that a query names to the scan itself, so that it skips the parts of files without them; with more they are joined.
MOST_PUSHED = 200


def tenant_of(header: str | None) -> int:
    """The tenant that a request names: 0 without one; ValueError unless it is a number."""
    if header is None or header == "":
        return 0
    if not header.isascii() or not header.isdigit():
        raise ValueError(f"{header} is no tenant")
    return int(header)


class LogEngine:
    """One store. Pushed lines wait in memory until flush, or until enough have come; queries see what was flushed.

    Bodies that come one by one wait in the driver, tables of them stay with the executors.
    """

    def __init__(self, store: LogStore, flush_bytes: int = MOST_BODY) -> None:
        self.store, self.flush_bytes = store, flush_bytes
        self.waiting: list[tuple[int, str]] = []
        self.waiting_size = 0  # counted as bodies come, as going through all of them for each would take the square of their number
        self.waiting_tables: list[DataFrame] = []
        self.flushing: tuple[str, list[tuple[int, str]], list[DataFrame]] | None = None

    def ingest_push(self, body: str | bytes, tenant: int = 0, content_type: str | None = None, encoding: str | None = None, now_ns: int | None = None) -> int:
        """Takes a push body; InvalidPush if it is malformed. The number of values in it."""
        raw = decoded(body, encoding) if isinstance(body, bytes) else body.encode()
        if len(raw) > MOST_BODY:
            error = InvalidPush("BODY_TOO_LARGE", f"{len(raw)} bytes")
            error.status = 413
            raise error
        text = raw.decode()
        data = check_push(text, content_type)
        self.waiting.append((tenant, json.dumps(data)))
        self.waiting_size += len(self.waiting[-1][1])
        if self.waiting_size >= self.flush_bytes:
            self.flush(now_ns)
        return sum(len(s["values"]) for s in data["streams"])

    def ingest_table(self, bodies: DataFrame) -> None:
        """Takes a table of push bodies (tenant, body), as a micro-batch has them; InvalidPush if any is malformed, and none is taken.

        The table waits as it is, until flush: it has to give the same rows whenever it is read, and its size is not counted.
        """
        refused = lambda b: F.when(F.octet_length(b) > MOST_BODY, "BODY_TOO_LARGE").otherwise(refusal(b))
        # The body is named once, as a filter that moves below what makes it would have that there for each use.
        bad = bodies.where(F.exists(F.array("body"), lambda b: refused(b).isNotNull())).select(refused(F.col("body")).alias("code"), F.substring("body", 1, 200).alias("start")).first()
        if bad:
            error = InvalidPush(bad["code"], str(bad["start"]))
            error.status = 413 if bad["code"] == "BODY_TOO_LARGE" else error.status
            raise error
        self.waiting_tables.append(bodies.select(F.col("tenant").cast("bigint").alias("tenant"), "body"))

    def _lines(self, bodies: list[tuple[int, str]], tables: list[DataFrame], now_ns: int | None) -> DataFrame:
        """The lines of bodies, without those beyond limits or the days that are kept."""
        listed = [self.store.spark.createDataFrame(bodies, "tenant bigint, body string")] if bodies else []
        pushes = reduce(DataFrame.unionByName, [*listed, *tables]).select("tenant", parsed(F.col("body")))
        return to_lines(flatten(pushes), F.col("tenant")).where(within_limits() & in_retention(now_ns or time.time_ns()))

    def flush(self, now_ns: int | None = None) -> None:
        """Writes what is waiting, of all tenants at once. What fails is tried again by the next flush, and written once."""
        while self.flushing or self.waiting or self.waiting_tables:
            if not self.flushing:
                self.flushing = f"flush-{uuid.uuid4().hex}", self.waiting, self.waiting_tables
                self.waiting, self.waiting_size, self.waiting_tables = [], 0, []
            name, bodies, tables = self.flushing
            self.store.append(self._lines(bodies, tables, now_ns), name)
            self.flushing = None

    def ready(self) -> bool:
        return self.store.ready()

    def query(self, text: str, tenant: int = 0, now_ns: int | None = None, limit: int | None = MOST_LINES) -> DataFrame:
        return self.run(parse(text, now_ns), tenant, limit)

    def query_json(self, body: dict, tenant: int = 0, limit: int | None = MOST_LINES) -> DataFrame:
        return self.run(from_json(body), tenant, limit)

    def run(self, query: LogQuery, tenant: int = 0, limit: int | None = MOST_LINES, waiting: bool = False, now_ns: int | None = None) -> DataFrame:
        """The query's lines; waiting: with what has been pushed but not flushed."""
        lines, streams = self.store.lines(), self.store.streams()
        _, bodies, tables = self.flushing or ("", [], [])
        bodies, tables = [*bodies, *self.waiting], [*tables, *self.waiting_tables]
        if waiting and (bodies or tables):
            more = self._lines(bodies, tables, now_ns)
            lines, streams = lines.unionByName(more.drop("tags"), allowMissingColumns=True), streams.unionByName(stream_dimension(more))
        return to_df(lines, streams, tenant, query, limit, MOST_PUSHED)

    def query_response(self, text: str, tenant: int = 0, now_ns: int | None = None) -> str:
        """The JSON that a client gets."""
        return response(self.query(text, tenant, now_ns))

    def stream_ids(self, tenant: int = 0, now_ns: int | None = None, **bounds) -> DataFrame:
        """Streams over the days that a range touches; bounds as for stream_range."""
        lo, hi = times.stream_range(now_ns or time.time_ns(), **bounds)
        return streams_of(self.store.streams(), tenant, times.day_of(lo).isoformat(), times.day_of(hi).isoformat())
