"""Structure that a client keeps in item values; the store itself never looks inside."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def typed_values(items: DataFrame, schema: StructType | str) -> DataFrame:
    """``items`` with JSON values parsed by a given schema; what does not fit is null."""
    return items.withColumn("parsed", F.from_json(F.decode("value", "UTF-8"), schema))


def increments(log: DataFrame, field: str) -> DataFrame:
    """(namespace, record_id, total): a counter as a sum over puts that each add JSON ``field``."""
    puts = log.where("op = 'PUT'")
    amount = F.from_json(F.decode("value", "UTF-8"), f"{field} long")[field]
    return puts.groupBy("namespace", "record_id").agg(F.sum(amount).alias("total"))
