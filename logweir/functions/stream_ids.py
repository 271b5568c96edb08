"""The 128-bit number that clients of the wire format know a stream by, for a few streams at the edge."""

from __future__ import annotations

import xxhash


def _length(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def wire_stream_id(tags: dict[str, str]) -> int:
    """Two 64-bit hashes of the sorted tags, each length-prefixed; the second has a fixed suffix."""
    entries = sorted((k.encode(), v.encode()) for k, v in tags.items())
    data = _length(len(entries)) + b"".join(_length(len(x)) + x for e in entries for x in e)
    return xxhash.xxh64_intdigest(data) << 64 | xxhash.xxh64_intdigest(data + b"xxhash")
