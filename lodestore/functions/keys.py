"""Column functions for composite keys, versions, tokens and page tokens, with their driver-side twins."""

from __future__ import annotations

import base64
import math
import struct
import threading
import time
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestore.schema import TOKEN_BYTES, InvalidArgument, check_version


def composite_key(record_id: Column, item_key: Column) -> Column:
    """record_id, a zero byte, item_key: sorts like (record_id, item_key), as no record id has a zero byte."""
    return F.concat(record_id.cast("binary"), F.lit(b"\0"), item_key.cast("binary"))


def split_composite_key(key: Column) -> tuple[Column, Column]:
    """(record_id, item_key); the first zero byte parts them."""
    # Latin-1 keeps one character for each byte, so that positions in it are byte positions.
    at = F.instr(F.decode(key, "ISO-8859-1"), "\0")
    record = F.decode(F.substring(key, F.lit(1), at - 1), "UTF-8")
    return record, F.substring(key, at + 1, F.octet_length(key) - at)


def entry_bytes(item_key: Column, value: Column, metadata: Column) -> Column:
    """Bytes of an entry; with a composite key as ``item_key``, what it counts for in a page's budget."""
    return F.octet_length(item_key) + F.coalesce(F.octet_length(value), F.lit(0)) + F.coalesce(F.octet_length(metadata), F.lit(0))


def big_endian(value: Column, size: int) -> Column:
    return F.unhex(F.lpad(F.hex(value.cast("long")), 2 * size, "0"))


def ordered_key(timestamp_ms: Column, node_id: Column, sequence: Column) -> Column:
    """Twelve bytes that sort like (timestamp_ms, node_id, sequence)."""
    return F.concat(big_endian(timestamp_ms, 8), big_endian(node_id, 2), big_endian(sequence, 2))


def split_ordered_key(key: Column) -> Column:
    part = lambda a, n: F.conv(F.hex(F.substring(key, a, n)), 16, 10).cast("long")
    return F.struct(part(1, 8).alias("timestamp_ms"), part(9, 2).cast("int").alias("node_id"), part(11, 2).cast("int").alias("sequence"))


def token_bytes(generation_time: Column, nonce: Column) -> Column:
    """Twenty-four bytes: the time, big-endian, and the nonce."""
    return F.concat(big_endian(generation_time, 8), nonce)


def derived_token(token: Column, index: Column) -> Column:
    """The token of the item at ``index`` of a batch: the index, little-endian, xor-ed into bytes 8 to 11 (from 0)."""
    byte = lambda k: F.conv(F.hex(F.substring(token, 9 + k, 1)), 16, 10).cast("long")
    part = lambda k: F.unhex(F.lpad(F.hex(byte(k).bitwiseXOR(F.shiftrightunsigned(index.cast("long"), 8 * k).bitwiseAND(F.lit(255)))), 2, "0"))
    mixed = F.concat(F.substring(token, 1, 8), *[part(k) for k in range(4)], F.substring(token, 13, 1 << 20))
    return F.when(is_none_token(token), token).otherwise(mixed)


def is_none_token(token: Column) -> Column:
    """Null, empty or all zero: no token."""
    return token.isNull() | (F.hex(token).rlike("^0*$"))


def within_drift(generation_time: Column, now: Column, most: int) -> Column:
    return F.abs(generation_time - now) <= F.lit(most)


def bits_per_key(false_positives: Column) -> Column:
    """Bloom filter bits a key for a rate of false positives."""
    return F.ceil(-F.log(false_positives) / F.pow(F.log(F.lit(2.0)), F.lit(2.0))).cast("long")


def bloom_hashes(bits: Column) -> Column:
    return F.greatest(F.lit(1), F.round(bits * F.lit(math.log(2)))).cast("long")


def false_positive_rate(hashes: Column, keys: Column, bits: Column) -> Column:
    return F.pow(F.lit(1.0) - F.exp(-hashes * keys / bits), hashes)


@dataclass(frozen=True)
class PageToken:
    """Where a page ended."""

    last_key: bytes
    seq: int
    average: int | None = None

    def encode(self) -> bytes:
        tail = b"\0" if self.average is None else b"\1" + struct.pack("<I", self.average)
        return struct.pack("<I", len(self.last_key)) + self.last_key + struct.pack("<Q", self.seq) + tail

    @classmethod
    def decode(cls, raw: bytes) -> PageToken:
        try:
            (n,) = struct.unpack_from("<I", raw)
            if len(raw) < 4 + n + 9:
                raise InvalidArgument("the page token is too short")
            (seq,) = struct.unpack_from("<Q", raw, 4 + n)
            average = struct.unpack_from("<I", raw, 13 + n)[0] if raw[12 + n] else None
        except struct.error as e:
            raise InvalidArgument("the page token is too short") from e
        return cls(bytes(raw[4 : 4 + n]), seq, average)

    def text(self) -> str:
        return base64.b64encode(self.encode()).decode()

    @classmethod
    def from_text(cls, text: str) -> PageToken:
        try:
            return cls.decode(base64.b64decode(text, validate=True))
        except ValueError as e:
            raise InvalidArgument("the page token is not base64") from e


class VersionClock:
    """Versions (ms, node, seq) of one node: each greater than the one before; seq starts anew each millisecond."""

    def __init__(self, node_id: int = 0, now_ms=None):
        check_version(node_id, 0)
        self.node_id, self._now = node_id, now_ms or (lambda: int(time.time() * 1000))
        self._last, self._seq, self._lock = -1, 0, threading.Lock()

    def next(self) -> tuple[int, int, int]:
        with self._lock:
            now = max(self._now(), self._last)
            if now == self._last:
                self._seq += 1
                if self._seq > 65535:  # this millisecond is used up
                    while now <= self._last:
                        now = max(self._now(), self._last) if self._now() > self._last else self._last + 1
                    self._seq = 0
            else:
                self._seq = 0
            self._last = now
            return now, self.node_id, self._seq


def random_token(generation_time: int, nonce: bytes) -> bytes:
    if len(nonce) != TOKEN_BYTES:
        raise InvalidArgument(f"a token has {TOKEN_BYTES} bytes")
    return struct.pack(">Q", generation_time) + nonce
