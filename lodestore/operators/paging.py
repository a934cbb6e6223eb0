"""Pages of a record's items by byte budget and item limit."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType, StructField, StructType

from lodestore.functions.keys import entry_bytes
from lodestore.schema import DEFAULT_ITEMS_PER_PAGE

RECORD = ["namespace", "record_id"]


def item_bytes() -> Column:
    """The composite key, its separator included, the value and the metadata."""
    return F.octet_length("record_id") + F.lit(1) + entry_bytes(F.col("item_key"), F.col("value"), F.col("metadata"))


def first_page(items: DataFrame, budget: int | None = None, limit: int | None = None) -> DataFrame:
    """The first page of every record: items are added until the page has ``budget`` bytes or more, so that the
    item that crosses is in it, or ``limit`` items. Values count in full even if they are blanked later."""
    w = Window.partitionBy(*RECORD).orderBy("item_key")
    out = items
    if budget is not None:
        before = F.sum(item_bytes()).over(w.rowsBetween(Window.unboundedPreceding, -1))
        out = out.withColumn("_before", before).where(F.col("_before").isNull() | (F.col("_before") < budget)).drop("_before")
    if limit is not None and limit > 0:
        out = out.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= limit).drop("_n")
    return out


def one_page(items: DataFrame, budget: int, limit: int | None, record_bytes: int) -> tuple[list, bool]:
    """The first page of one record's ``items``, in order, and whether an item is left: one job.

    No page has more items than its budget has record ids, so only a top-k of that many is sorted,
    however long the record is.
    """
    most = min(limit or budget, -(-budget // (record_bytes + 1)))
    top = items.orderBy("item_key").limit(most + 1)
    w = Window.orderBy("item_key").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(item_bytes()).over(w), F.lit(0))
    n = F.count(F.lit(1)).over(w)
    numbered = top.withColumn("_in", (before < budget) & (n < most)).withColumn("_again", F.coalesce(F.lag("_in").over(Window.orderBy("item_key")), F.lit(True)))
    rows = numbered.where("_again").drop("_again").collect()
    names = items.columns
    page = [Row(*names)(*(r[c] for c in names)) for r in rows if r["_in"]]
    return page, len(page) < len(rows)


def resume(items: DataFrame, last_keys: DataFrame, budget: int | None = None, limit: int | None = None) -> DataFrame:
    """The page after ``last_keys`` (record_id, last_key); records without one start anew."""
    later = items.join(last_keys, "record_id", "left").where(F.col("last_key").isNull() | (F.col("item_key") > F.col("last_key"))).drop("last_key")
    return first_page(later, budget, limit)


def page_numbers(items: DataFrame, budget: int) -> DataFrame:
    """``items`` with ``page``, from 0: which page of its record an item is on when a client follows the tokens.

    Where a page starts depends on where the one before it ended, so a record's items are passed in
    order. They are sorted once, spilling as needed, and streamed through in Arrow batches; only the
    record, its page and how full that is are carried from batch to batch, so that memory does not
    grow with a record. Inside a batch, running sums are searched for the next page's end.
    """
    rows = items.withColumn("_n", item_bytes().cast("long")).repartition(*RECORD).sortWithinPartitions(*RECORD, "item_key")
    names = items.columns
    kind = StructType([*items.schema.fields, StructField("page", IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, page, filled = None, 0, 0
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            record = [batch.column(c).to_pylist() for c in RECORD]
            sizes = batch.column("_n").to_numpy()
            total = np.concatenate([[0], np.cumsum(sizes)])
            out = np.empty(n, dtype=np.int32)
            starts = [0, *(i for i in range(1, n) if record[1][i] != record[1][i - 1] or record[0][i] != record[0][i - 1]), n]
            for a, b in zip(starts, starts[1:]):
                if (record[0][a], record[1][a]) != last:
                    last, page, filled = (record[0][a], record[1][a]), 0, 0
                while a < b:  # this page ends with the item that fills it
                    end = int(np.searchsorted(total[a + 1 : b + 1], total[a] + budget - filled)) + a + 1
                    out[a : min(end, b)] = page
                    if end > b:
                        filled += int(total[b] - total[a])
                        break
                    page, filled, a = page + 1, 0, end
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(out)], [*names, "page"])

    return rows.mapInArrow(run, kind)


def exclude_values(page: DataFrame) -> DataFrame:
    """Keys and metadata stay; comes after paging."""
    return page.withColumn("value", F.lit(b""))


def average_item_bytes(items: DataFrame, page_budget: int) -> DataFrame:
    """By record: the running average's last value, and how many items a page should hold."""
    out = items.groupBy(*RECORD).agg(F.count("*").alias("n"), F.sum(item_bytes().cast("long")).alias("total"))
    average = F.expr("total div n")
    per_page = F.when(average > 0, F.greatest(F.lit(1).cast("long"), F.expr(f"{page_budget}L div (total div n)"))).otherwise(F.lit(DEFAULT_ITEMS_PER_PAGE).cast("long"))
    return out.select(*RECORD, "n", "total", average.alias("average"), per_page.alias("items_per_page"))
