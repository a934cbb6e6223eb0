"""Retry safety: a write whose token was seen before is skipped."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions.keys import is_none_token
from lodestore.schema import AlreadyExists

SCOPE = ["namespace", "partition_id", "token"]


def first_write_wins(log: DataFrame) -> DataFrame:
    """Of rows that share a token in a partition, the first by sequence; rows without one all stay.

    The least sequence of a token is found by a partial aggregate and joined back; a window would
    bring a hot token's rows, or all rows without one, to one task.
    """
    plain = is_none_token(F.col("token"))
    first = log.where(~plain).groupBy(*SCOPE).agg(F.min("seq").alias("seq"))
    tokened = log.where(~plain).join(first, [*SCOPE, "seq"], "left_semi")
    return log.where(plain).unionByName(tokened)


def new_rows(batch: DataFrame, seen: DataFrame) -> DataFrame:
    """Rows of ``batch`` whose token is not in ``seen`` (the scope's columns), duplicates inside the batch dropped too."""
    return first_write_wins(batch.join(seen.select(*SCOPE), SCOPE, "left_anti"))


def refuse_repeated(batch: DataFrame, seen: DataFrame) -> None:
    """The strict form: raises if any token was seen, or stands twice in ``batch``."""
    tokens = batch.where(~is_none_token(F.col("token")))
    if not tokens.join(seen.select(*SCOPE), SCOPE, "left_semi").isEmpty() or not tokens.groupBy(*SCOPE).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        raise AlreadyExists("a token was used before")


def versions(log: DataFrame) -> DataFrame:
    """``log`` with a version (timestamp_ms, node_id, sequence): numbered from 0 inside each millisecond, by sequence."""
    w = Window.partitionBy("namespace", "partition_id", "created_at_ms").orderBy("seq")
    return log.withColumn("version_sequence", (F.row_number().over(w) - 1).cast("int"))
