"""What can be wrong with a query; only the first four carry the code of a malformed query to a client."""

from __future__ import annotations

from dataclasses import dataclass

#: Syntax errors that are kept of one query.
MOST_LOCATIONS = 4


@dataclass(frozen=True)
class Location:
    line: int
    col: int
    msg: str


class QueryError(ValueError):
    """Any query that can't be run."""

    code = "QUERY_FAILED"
    status = 500


class QuerySyntaxError(QueryError):
    code = "QUERY_SYNTAX"
    status = 400

    def __init__(self, *locations: Location) -> None:
        self.locations = locations[:MOST_LOCATIONS]
        super().__init__("; ".join(f"{x.line}:{x.col} {x.msg}" for x in self.locations))

    def response(self) -> dict:
        return {"code": self.code, "meta": {"locs": [vars(x) for x in self.locations]}}


class InvalidDuration(QuerySyntaxError):
    def __init__(self) -> None:
        super().__init__(Location(1, 1, "Invalid relative time range duration."))


class OverflowDuration(QuerySyntaxError):
    def __init__(self) -> None:
        super().__init__(Location(1, 1, "Relative time range ends after the maximum timestamp."))


class DurationBeforeUnixEpoch(QuerySyntaxError):
    def __init__(self) -> None:
        super().__init__(Location(1, 1, "Relative time range starts before the Unix epoch."))


class InvalidTimestamp(QueryError):
    pass


class InvalidRange(QueryError):
    pass


class ExpectedLiteral(QueryError):
    pass


class UnexpectedTagExpression(QueryError):
    pass


class EmptyQuery(QueryError):
    pass


class QueryTooLong(QueryError):
    status = 413


class InvalidPush(ValueError):
    """A push body that is refused as a whole."""

    status = 400

    def __init__(self, code: str, message: str) -> None:
        self.code = code
        super().__init__(message)
