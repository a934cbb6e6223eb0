"""The three ways to say which items of a record are meant."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.schema import InvalidArgument, check_item_key


def check_bounds(start: bytes | None, end: bytes | None) -> tuple[bytes, bytes]:
    """Both bounds, empty where open; equal ones are allowed."""
    start, end = check_item_key(start or b""), check_item_key(end or b"")
    if start and end and start > end:
        raise InvalidArgument("the range ends before it starts")
    return start, end


def range_condition(key: Column, start: bytes | None, end: bytes | None, start_inclusive: bool = False, end_inclusive: bool = False) -> Column:
    """A byte range; an empty or missing bound is open, whatever its flag."""
    start, end = check_bounds(start, end)
    out = F.lit(True)
    if start:
        out = out & (key >= F.lit(start) if start_inclusive else key > F.lit(start))
    if end:
        out = out & (key <= F.lit(end) if end_inclusive else key < F.lit(end))
    return out


def delete_bounds(start: bytes | None, end: bytes | None, start_inclusive: bool, end_inclusive: bool) -> tuple[bytes, bytes | None]:
    """The same range as [start, end): a bound moves to its next key, which is itself and a zero byte."""
    start, end = check_bounds(start, end)
    if start and not start_inclusive:
        start += b"\0"
    if end and end_inclusive:
        end += b"\0"
    return check_item_key(start), check_item_key(end) or None


def match_range(items: DataFrame, start=None, end=None, start_inclusive: bool = False, end_inclusive: bool = False) -> DataFrame:
    return items.where(range_condition(F.col("item_key"), start, end, start_inclusive, end_inclusive))


def match_prefix(items: DataFrame, prefix: bytes) -> DataFrame:
    """The usual way to say a prefix: [prefix, prefix FF)."""
    return match_range(items, prefix, prefix + b"\xff", start_inclusive=True)


def match_all(items: DataFrame) -> DataFrame:
    return items


def match_keys(items: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted`` has record_id, keys (an array); its items in the order asked, repeated as asked, misses left out.

    Adds ``pos``, the place in the request.
    """
    asked = wanted.select("record_id", F.posexplode("keys").alias("pos", "item_key"))
    return asked.join(items, ["record_id", "item_key"])


def keys_condition(keys: Sequence[bytes]) -> Column:
    if not keys:
        raise InvalidArgument("at least one key is asked for")
    return F.col("item_key").isin(*[F.lit(check_item_key(k)) for k in dict.fromkeys(keys)])
