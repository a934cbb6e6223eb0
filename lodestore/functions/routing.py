"""Which partition a record belongs to, as Column expressions; the number of partitions is a power of two."""

from __future__ import annotations

import re
import zlib
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.schema import InvalidArgument

# Low halves of the 64-bit FNV-1a offset and prime; the low 32 bits of a hash depend on nothing else.
FNV_OFFSET, FNV_PRIME, FNV_END = 0x84222325, 435, 0xFF


def _masked(h: Column, partitions: int) -> Column:
    if partitions < 1 or partitions & (partitions - 1):
        raise InvalidArgument("the number of partitions is a power of two")
    return h.bitwiseAND(F.lit(partitions - 1).cast("long")).cast("int")


def simple(record_id: Column, partitions: int) -> Column:
    return _masked(F.crc32(record_id.cast("binary")), partitions)


def composite(record_id: Column, partitions: int, delimiter: str, fields: Sequence[int]) -> Column:
    """By some of the id's fields; an id of too few fields is refused when the row is computed."""
    if not fields or not delimiter:
        raise InvalidArgument("composite routing needs a delimiter and a field")
    parts = F.split(record_id, re.escape(delimiter))
    joined = F.array_join(F.array(*[F.get(parts, F.lit(k)) for k in fields]), delimiter)
    enough = F.size(parts) > max(fields)
    key = F.when(enough, joined).otherwise(F.raise_error(F.concat(F.lit("record id has too few fields: "), record_id)).cast("string"))
    return _masked(F.crc32(key.cast("binary")), partitions)


def prefix(record_id: Column, partitions: int, length: int) -> Column:
    """By the first ``length`` bytes."""
    if length < 1:
        raise InvalidArgument("the prefix has at least one byte")
    return _masked(F.crc32(F.substring(record_id.cast("binary"), 1, length)), partitions)


def fnv(record_id: Column, partitions: int) -> Column:
    """By the low 32 bits of 64-bit FNV-1a over the bytes and a closing 0xFF, folded in BIGINT without overflow."""
    digits = F.hex(record_id.cast("binary"))
    at = F.sequence(F.lit(0), F.octet_length(record_id.cast("binary")))  # one more, for the closing byte
    byte = lambda k: F.when(k * 2 < F.length(digits), F.conv(F.substr(digits, k * 2 + 1, F.lit(2)), 16, 10).cast("long")).otherwise(F.lit(FNV_END).cast("long"))
    step = lambda h, k: F.pmod(h.bitwiseXOR(byte(k)) * F.lit(FNV_PRIME).cast("long"), F.lit(1 << 32).cast("long"))
    return _masked(F.aggregate(at, F.lit(FNV_OFFSET).cast("long"), step), partitions)


def route(record_id: Column, partitions: int, strategy: dict | None = None) -> Column:
    """By a namespace's strategy: {"kind": simple | composite | prefix | crc32 | fnv, ...}."""
    strategy = strategy or {"kind": "simple"}
    kind = strategy["kind"]
    if kind in ("simple", "crc32"):
        return simple(record_id, partitions)
    if kind == "composite":
        return composite(record_id, partitions, strategy["delimiter"], strategy["fields"])
    if kind == "prefix":
        return prefix(record_id, partitions, strategy["length"])
    if kind == "fnv":
        return fnv(record_id, partitions)
    raise InvalidArgument(f"no routing strategy {kind}")


def partition_histogram(items: DataFrame, partitions: int, strategy: dict | None = None) -> DataFrame:
    """(partition_id, n_records, n_items). Items are counted by record first, so that no distinct set is kept."""
    by_record = items.groupBy("record_id").agg(F.count("*").alias("n"))
    routed = by_record.withColumn("partition_id", route(F.col("record_id"), partitions, strategy))
    return routed.groupBy("partition_id").agg(F.count("*").alias("n_records"), F.sum("n").alias("n_items"))


def route_one(record_id: str, partitions: int, strategy: dict | None = None) -> int:
    """``route`` for one id, without a job."""
    strategy = strategy or {"kind": "simple"}
    kind, raw = strategy["kind"], record_id.encode()
    if partitions < 1 or partitions & (partitions - 1):
        raise InvalidArgument("the number of partitions is a power of two")
    if kind == "fnv":
        h = FNV_OFFSET
        for b in (*raw, FNV_END):
            h = (h ^ b) * FNV_PRIME & 0xFFFFFFFF
        return h & (partitions - 1)
    if kind == "composite":
        parts = record_id.split(strategy["delimiter"])
        if len(parts) <= max(strategy["fields"]):
            raise InvalidArgument(f"record id has too few fields: {record_id}")
        raw = strategy["delimiter"].join(parts[k] for k in strategy["fields"]).encode()
    elif kind == "prefix":
        raw = raw[: strategy["length"]]
    elif kind not in ("simple", "crc32"):
        raise InvalidArgument(f"no routing strategy {kind}")
    return zlib.crc32(raw) & (partitions - 1)
