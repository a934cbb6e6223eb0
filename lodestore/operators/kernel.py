"""From a mutation log to its visible items: latest wins, then tombstones.

All functions are lazy, DataFrame in and out, over any number of records at once. The order
matters: the winner of a key is found among puts and deletes by sequence, then winners that a
newer range delete covers go, then winners that are deletes. Testing only winners is enough:
a range delete that hides the winner is newer than all that the winner beat.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestore.schema import DELETE, PUT, RANGE_DELETE

KEY = ["namespace", "partition_id", "record_id", "item_key"]
PAYLOAD = ["seq", "op", "value", "metadata", "token", "created_at_ms"]


def merge(*layers: DataFrame) -> DataFrame:
    """The rows of all layers (recent and stored); sequences, not layers, decide what wins."""
    return reduce(DataFrame.unionByName, layers)


def as_of(log: DataFrame, seq: int) -> DataFrame:
    """The log as it stood after ``seq``."""
    return log.where(F.col("seq") <= seq)


def latest_per_key(log: DataFrame) -> DataFrame:
    """The put or delete of greatest sequence of each key.

    A top-1 by key: map-side partial aggregates mean that a hot key sends one row a task.
    """
    points = log.where(F.col("op") != RANGE_DELETE)
    best = F.max_by(F.struct(*PAYLOAD), F.col("seq")).alias("w")
    return points.groupBy(*KEY).agg(best).select(*KEY, *[F.col("w")[c].alias(c) for c in PAYLOAD])


def range_tombstones(log: DataFrame) -> DataFrame:
    """(namespace, partition_id, record_id, start, stop, at): an open start is empty, an open stop null."""
    rows = log.where(F.col("op") == RANGE_DELETE)
    stop = F.when(F.octet_length("range_end") > 0, F.col("range_end"))
    return rows.select("namespace", "partition_id", "record_id", F.col("item_key").alias("start"), stop.alias("stop"), F.col("seq").alias("at"))


def whole_record_deletes(tombstones: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Deletes of whole records, as one (record, greatest sequence) each, and the rest.

    Any number of such deletes of a record are one row afterwards, so that a record that is
    wiped again and again adds nothing to the join by ranges.
    """
    whole = (F.octet_length("start") == 0) & F.col("stop").isNull()
    top = tombstones.where(whole).groupBy("namespace", "partition_id", "record_id").agg(F.max("at").alias("at"))
    return top, tombstones.where(~whole)


def covered(key: Column, seq: Column, start: Column, stop: Column, at: Column) -> Column:
    """Whether a range delete hides an entry: start <= key < stop, and strictly newer."""
    return (start <= key) & (stop.isNull() | (key < stop)) & (at > seq)


def apply_range_tombstones(winners: DataFrame, tombstones: DataFrame) -> DataFrame:
    """``winners`` that no range delete of their record covers.

    Anti joins on the record, so that Spark broadcasts a small side by its own measured size and
    splits hot records of a large one.
    """
    wiped, ranges = whole_record_deletes(tombstones)
    record = ["namespace", "partition_id", "record_id"]
    w, t, r = winners.alias("w"), wiped.alias("t"), ranges.alias("r")
    same = lambda other: reduce(Column.__and__, [F.col(f"w.{c}") == F.col(f"{other}.{c}") for c in record])
    left = w.join(t, same("t") & (F.col("t.at") > F.col("w.seq")), "left_anti").alias("w")
    hit = covered(F.col("w.item_key"), F.col("w.seq"), F.col("r.start"), F.col("r.stop"), F.col("r.at"))
    return left.join(r, same("r") & hit, "left_anti")


def live_puts(winners: DataFrame) -> DataFrame:
    """Winners that are not deletes; only ever after the winners are known."""
    return winners.where(F.col("op") != DELETE)


def as_items(rows: DataFrame) -> DataFrame:
    """The item projection: chunk is always 0, absent metadata is empty."""
    return rows.select("namespace", "record_id", "item_key", "value", F.coalesce("metadata", F.lit(b"")).alias("metadata"), F.lit(0).alias("chunk"), "seq")


def visible_items(log: DataFrame) -> DataFrame:
    return as_items(live_puts(apply_range_tombstones(latest_per_key(log), range_tombstones(log))))


def point_read(log: DataFrame, record_id: str, key: bytes) -> DataFrame:
    """One item. The record and key reach the scan; range deletes of the record are read by the record alone."""
    own = log.where(F.col("record_id") == record_id)
    points = own.where((F.col("item_key") == F.lit(key)) & (F.col("op") != RANGE_DELETE))
    return as_items(live_puts(apply_range_tombstones(latest_per_key(points), range_tombstones(own))))


def compact(log: DataFrame, full: bool, drop_before_ms: int | None = None) -> DataFrame:
    """The log's shortest equivalent.

    Reads of it give what reads of ``log`` give. Tombstones stay unless the log is all there is
    (``full``), so that nothing older can come back, and, with ``drop_before_ms``, unless they
    are younger. Tokens are dropped with what the merge drops.
    """
    kept = apply_range_tombstones(latest_per_key(log), range_tombstones(log))
    puts = kept.where(F.col("op") == PUT).withColumn("range_end", F.lit(None).cast("binary"))
    tombs = kept.where(F.col("op") == DELETE).withColumn("range_end", F.lit(None).cast("binary"))
    wide = log.where(F.col("op") == RANGE_DELETE).select(*tombs.columns)
    tombs = tombs.unionByName(wide)
    if full:
        if drop_before_ms is None:
            return puts.select(*log.columns)
        tombs = tombs.where(F.coalesce(F.col("created_at_ms") >= drop_before_ms, F.lit(False)))
    return puts.unionByName(tombs).select(*log.columns)
