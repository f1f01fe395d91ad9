"""Scalar functions on keys, times to live and stored sizes, as columns and for literals."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest encoded key in bytes.
MAX_ENCODED_KEY = 65_535
GROUP = 8


def prefix_successor(prefix: bytes | str) -> bytes | str | None:
    """The smallest key above all keys with the prefix; None where there is no bound."""
    raw = prefix.encode() if isinstance(prefix, str) else prefix
    kept = raw.rstrip(b"\xff")
    if not kept:
        return None
    out = kept[:-1] + bytes([kept[-1] + 1])
    if isinstance(prefix, str):
        # a string bound must be text: step to the next code point instead of the next byte
        for i in range(len(prefix) - 1, -1, -1):
            point = ord(prefix[i]) + 1
            point = 0xE000 if 0xD800 <= point < 0xE000 else point
            if point <= 0x10FFFF:
                return prefix[:i] + chr(point)
        return None
    return out


def encode_key(key: bytes) -> bytes:
    """An order-preserving form: groups of eight bytes, each followed by 255 less its padding."""
    out = bytearray()
    for at in range(0, len(key) + 1, GROUP):
        part = key[at : at + GROUP]
        out += part.ljust(GROUP, b"\0")
        out.append(255 - (GROUP - len(part)))
    return bytes(out)


def decode_key(data: bytes) -> bytes | None:
    """The key of an encoded form, or None if it is malformed."""
    if not data or len(data) % (GROUP + 1):
        return None
    out = bytearray()
    for at in range(0, len(data), GROUP + 1):
        pad = 255 - data[at + GROUP]
        last = at + GROUP + 1 == len(data)
        if pad > GROUP or (pad == 0) == last or any(data[at + GROUP - pad : at + GROUP]):
            return None
        out += data[at : at + GROUP - pad]
    return bytes(out)


def encode_version(key: bytes, ts: int) -> bytes:
    """Versions of a key sort newest first: its encoded form, then the complement of the timestamp."""
    return encode_key(key) + (2**64 - 1 - ts).to_bytes(8, "big")


def version_ts(data: bytes) -> int:
    return 2**64 - 1 - int.from_bytes(data[-8:], "big")


def encoded_length(key: Column | str) -> Column:
    return ((F.floor(F.octet_length(key) / GROUP) + 1) * (GROUP + 1) + 8).cast("long")


def key_fits(key: Column | str) -> Column:
    return encoded_length(key) <= MAX_ENCODED_KEY


def bloom_hash(key: Column | str) -> Column:
    return F.crc32(F.col(key).cast("binary") if isinstance(key, str) else key.cast("binary"))


def bloom_bits_per_key(rate: float) -> int:
    return math.ceil(-math.log(rate) / math.log(2) ** 2)


def expire_at(now: int, ttl_seconds: float) -> int:
    """Absolute second of expiry: parts of a second round up, and the largest long is the end of time."""
    return min(now + math.ceil(ttl_seconds), 2**63 - 1)


def expiry(now: Column | str, ttl_seconds: Column | str) -> Column:
    """expire_at() of columns: seconds of the clock and of the time to live."""
    now, ttl = (F.col(x) if isinstance(x, str) else x for x in (now, ttl_seconds))
    last = F.lit(2**63 - 1)
    return F.when(F.ceil(ttl) > last - now, last).otherwise(now + F.ceil(ttl)).cast("bigint")


def value_entry_size(key: Column | str, value: Column | str) -> Column:
    """Bytes of a separated value's record: header, key and value, padded to eight."""
    return (F.ceil((24 + F.octet_length(key) + F.octet_length(value)) / 8) * 8).cast("long")


def splitmix64(x: int) -> int:
    x = (x + 0x9E3779B97F4A7C15) % 2**64
    x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 % 2**64
    x = (x ^ (x >> 27)) * 0x94D049BB133111EB % 2**64
    return x ^ (x >> 31)


def zipf_cdf(n: int, exponent: float = 0.99) -> list[float]:
    weights = [1 / (i + 1) ** exponent for i in range(n)]
    total, out, sums = sum(weights), [], 0.0
    for w in weights:
        sums += w
        out.append(sums / total)
    return out


def steady_key(number: Column | str, width: int = 20) -> Column:
    """A big-endian id padded with '0' to a width."""
    hexed = F.lpad(F.hex(number), 16, "0")
    return F.concat(F.unhex(hexed), F.lit(b"0" * (width - 8)))
