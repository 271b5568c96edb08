"""Nanosecond times and durations."""

from __future__ import annotations

import re
from datetime import date, datetime, timedelta, timezone

from .errors import DurationBeforeUnixEpoch, InvalidDuration, InvalidRange, InvalidTimestamp, OverflowDuration

SECOND = 1_000_000_000
DAY = 86_400 * SECOND
MOST = (1 << 64) - 1
UNITS = {"s": SECOND, "m": 60 * SECOND, "h": 3600 * SECOND, "d": DAY}
_STAMP = re.compile(r"(\d{4})-?(\d{2})-?(\d{2})(?:[T ](\d{2})(?::?(\d{2})(?::?(\d{2})(?:[.,](\d{1,18}))?)?)?)? ?(Z|[+-]\d{2}(?::?\d{2})?)?")


def duration_ns(text: str) -> int:
    """5m as nanoseconds; units s, m, h and d."""
    m = re.fullmatch(r"\+?(\d+)([smhd])", text, re.A)
    if not m or (value := int(m[1]) * UNITS[m[2]]) > MOST:
        raise InvalidDuration
    return value


def timestamp_ns(text: str, zero: bool = True) -> int:
    """ISO 8601 as nanoseconds since the epoch; without an offset UTC. zero: whether the epoch itself is allowed."""
    m = _STAMP.fullmatch(text)
    if not m:
        raise InvalidTimestamp(text)
    year, month, day, hour, minute, second = (int(x or 0) for x in m.groups()[:6])
    try:
        moment = datetime(year, month, day, hour, minute, second, tzinfo=timezone.utc)
    except ValueError:
        raise InvalidTimestamp(text) from None
    zone = m[8]
    if zone and zone != "Z":
        shift = timedelta(hours=int(zone[1:3]), minutes=int(zone[3:].lstrip(":") or 0))
        moment -= -shift if zone[0] == "-" else shift
    whole = (moment - datetime(1970, 1, 1, tzinfo=timezone.utc)) // timedelta(seconds=1)
    ns = whole * SECOND + int((m[7] or "0")[:9].ljust(9, "0"))
    if ns < 0 or ns == 0 and not zero or ns > MOST:
        raise InvalidTimestamp(text)
    return ns


def resolve(text: str | None, now: int) -> int:
    """A bound of a range: now (also if left out), a duration from now, or a timestamp."""
    if text is None or text == "now":
        return now
    if text == "":
        raise InvalidTimestamp(text)
    if text[-1] not in UNITS:
        return timestamp_ns(text)
    if text[0] == "-":
        at = now - duration_ns(text[1:])
        if at < 0:
            raise DurationBeforeUnixEpoch
        return at
    at = now + duration_ns(text)
    if at > MOST:
        raise OverflowDuration
    return at


def stream_range(now: int, since: str | None = None, from_ns: int | None = None, to_ns: int | None = None, start: str | None = None, end: str | None = None) -> tuple[int, int]:
    """The range of a stream-id request: since comes first, then nanoseconds, then timestamps."""
    if since is not None:
        return max(0, now - duration_ns(since)), now
    if from_ns is not None and to_ns is not None:
        lo, hi = from_ns, to_ns
    elif start is not None and end is not None:
        lo, hi = timestamp_ns(start, zero=False), timestamp_ns(end, zero=False)
    else:
        raise InvalidRange("since, both nanosecond bounds or both timestamps are needed")
    if lo > hi:
        raise InvalidRange(f"{lo} > {hi}")
    return lo, hi


def day_of(ns: int) -> date:
    return date(1970, 1, 1) + timedelta(days=ns // DAY)


def day_key(day: date) -> str:
    """DDMMYYYY."""
    return day.strftime("%d%m%Y")


def parse_day_key(key: str) -> date:
    return datetime.strptime(key, "%d%m%Y").date()


#: Ranges that a user interface offers, as start bounds.
PRESETS = {"5m": "-5m", "15m": "-15m", "30m": "-30m", "1h": "-1h", "3h": "-3h", "6h": "-6h", "12h": "-12h", "1d": "-1d", "7d": "-7d", "30d": "-30d", "all": "1970-01-01T00:00:00Z"}
