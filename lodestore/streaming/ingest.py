"""Structured Streaming into the store, retry dedup on a stream, and a live view of items."""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from lodestore.schema import PUT, RANGE_DELETE
from lodestore.sources.store import Namespace


def table_stream(spark: SparkSession, sf_dir: str, table: str, files_per_trigger: int | None = None) -> DataFrame:
    """A test table as a stream; its schema is read from the files."""
    reader = spark.readStream.schema(spark.read.parquet(f"{sf_dir}/{table}.parquet").schema).option("pathGlobFilter", "*.parquet")
    if files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    return reader.parquet(f"{sf_dir}/{table}.parquet*")


def ingest(changes: DataFrame, into: Namespace, name: str, checkpoint: str, unique_ord: bool = False, tokens: bool = True):
    """Append a stream of changes (see Namespace.append) until what is there is read; returns the query.

    A batch that is run again after a failure is recognised by its number, so each is committed once.
    """
    return changes.writeStream.foreachBatch(lambda df, batch: into.append(df, stream=(name, batch), unique_ord=unique_ord, tokens=tokens) and None).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_by_token(changes: DataFrame, time_col: str, keys: list[str], retention: str) -> DataFrame:
    """One row for each key within ``retention`` of event time: state older than that is let go."""
    return changes.withWatermark(time_col, retention).dropDuplicatesWithinWatermark(keys)


#: Rows of live_items.
VIEW = "record_id string, item_key binary, value binary, seq long, visible boolean"


def _update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    """Fold changes of one record into its items and range deletes; put out the items that changed."""
    items, ranges = pickle.loads(state.get[0]) if state.exists else ({}, [])
    touched = set()
    for f in frames:
        for op, k, end, value, seq in zip(f["op"], f["item_key"], f["range_end"], f["value"], f["seq"]):
            k = bytes(k)
            if op == RANGE_DELETE:
                end = bytes(end) if end is not None and len(end) else None
                ranges.append((k, end, seq))
                touched.update(x for x in items if k <= x and (end is None or x < end))
            elif k not in items or items[k][1] < seq:
                items[k] = (bytes(value) if op == PUT else None, seq)
                touched.add(k)
    state.update((pickle.dumps((items, ranges)),))
    rows = []
    for k in sorted(touched):
        value, seq = items[k]
        hidden = value is None or any(a <= k and (b is None or k < b) and at > seq for a, b, at in ranges)
        rows.append((key[0], k, value or b"", seq, not hidden))
    yield pd.DataFrame(rows, columns=["record_id", "item_key", "value", "seq", "visible"])


def live_items(changes: DataFrame) -> DataFrame:
    """A stream of items' present state: rows of VIEW, of which the last of a key holds.

    State is one record's items and range deletes: as large as the record. Late changes count by
    their sequence, as in the store.
    """
    return changes.select("record_id", "op", "item_key", "range_end", "value", "seq").groupBy("record_id").applyInPandasWithState(_update, VIEW, "state binary", "update", GroupStateTimeout.NoTimeout)


def latest_view(rows: DataFrame) -> DataFrame:
    """The visible items of rows that ``live_items`` put out in turn (batch says when)."""
    last = rows.groupBy("record_id", "item_key").agg(F.max_by(F.struct("value", "seq", "visible"), F.struct("batch", "seq")).alias("x"))
    return last.where("x.visible").select("record_id", "item_key", "x.value", "x.seq")


def changes_of(log: DataFrame) -> DataFrame:
    """A mutation log as changes that a store can append: order of arrival by sequence."""
    return log.select("record_id", "item_key", "op", "range_end", "value", "metadata", F.lit(None).cast("binary").alias("token"), F.col("seq").alias("ord"))



