"""Schemas, limits and errors of the record store."""

from __future__ import annotations

from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

PUT, DELETE, RANGE_DELETE = "PUT", "DELETE", "RANGE_DELETE"

#: One row for each change. For RANGE_DELETE item_key is the range's start (empty: open) and range_end its end (null or empty: open).
MUTATION_LOG = StructType(
    [
        StructField("namespace", StringType(), False),
        StructField("partition_id", IntegerType(), False),
        StructField("record_id", StringType(), False),
        StructField("item_key", BinaryType(), False),
        StructField("op", StringType(), False),
        StructField("range_end", BinaryType()),
        StructField("value", BinaryType()),
        StructField("metadata", BinaryType()),
        StructField("token", BinaryType()),
        StructField("seq", LongType(), False),
        StructField("created_at_ms", LongType()),
    ]
)
#: What a read gives back; chunk is always 0.
VISIBLE_ITEM = StructType(
    [
        StructField("namespace", StringType(), False),
        StructField("record_id", StringType(), False),
        StructField("item_key", BinaryType(), False),
        StructField("value", BinaryType()),
        StructField("metadata", BinaryType()),
        StructField("chunk", IntegerType(), False),
        StructField("seq", LongType(), False),
    ]
)

# Limits and defaults that decide which requests are valid and how large pages are.
MAX_RECORD_ID_BYTES = 256
MAX_ITEM_KEY_BYTES = 4096
TOKEN_BYTES = 16
MAX_VERSION_PART = 65535
DEFAULT_PAGE_BYTES = 2 * 1024 * 1024
MAX_PAGE_BYTES = 8 * 1024 * 1024
DEFAULT_ITEMS_PER_PAGE = 1024
L0_COMPACTION_FILES = 4
L1_BYTES = 256 * 1024 * 1024
L2_BYTES = 2560 * 1024 * 1024
L0_SLOW_FILES, L0_STOP_FILES = 8, 12
FRAGMENT_BYTES = 64 * 1024 * 1024
FRAGMENT_ROWS = 128 * 1024
BOTTOM_LEVEL = 3
FREEZE_BYTES, FREEZE_SECONDS, MAX_FROZEN = 64 * 1024 * 1024, 300, 3
MANIFESTS_KEPT = 100


class StoreError(Exception):
    """Any refusal of the store."""


class InvalidArgument(StoreError):
    pass


class NotFound(StoreError):
    pass


class AlreadyExists(StoreError):
    pass


class Conflict(StoreError):
    """Another writer committed first."""


class Fenced(Conflict):
    """A newer writer or compactor has begun; trying again does not help."""


class Unavailable(StoreError):
    """The namespace does not take this kind of request in its state."""


def check_namespace(name: str) -> str:
    if not name or "/" in name or "\0" in name:
        raise InvalidArgument("a namespace's name is not empty and has neither / nor NUL")
    return name


def check_record_id(record_id: str) -> str:
    raw = (record_id or "").encode()
    if not raw or b"\0" in raw or len(raw) > MAX_RECORD_ID_BYTES:
        raise InvalidArgument(f"a record id has 1 to {MAX_RECORD_ID_BYTES} bytes and no NUL")
    return record_id


def check_item_key(key: bytes) -> bytes:
    if key is None or len(key) > MAX_ITEM_KEY_BYTES:
        raise InvalidArgument(f"an item key has at most {MAX_ITEM_KEY_BYTES} bytes")
    return bytes(key)


def check_token(token: bytes | None) -> bytes | None:
    """None for an absent or all-zero token."""
    if token is None or not any(token):
        if token is not None and len(token) not in (0, TOKEN_BYTES):
            raise InvalidArgument(f"a token has {TOKEN_BYTES} bytes")
        return None
    if len(token) != TOKEN_BYTES:
        raise InvalidArgument(f"a token has {TOKEN_BYTES} bytes")
    return bytes(token)


def check_version(node_id: int, sequence: int) -> None:
    if not (0 <= node_id <= MAX_VERSION_PART and 0 <= sequence <= MAX_VERSION_PART):
        raise InvalidArgument(f"node and sequence are at most {MAX_VERSION_PART}")


def page_bytes(asked: int | None, default: int = DEFAULT_PAGE_BYTES, most: int = MAX_PAGE_BYTES) -> int:
    return min(asked or default, most)
