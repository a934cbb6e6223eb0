"""Shared plumbing: reading tables, bounded Arrow slices, scratch tables in the shared folder."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from lodestore.sources.shared import clear_scratch, let_go, scratch, shared_dir, step  # noqa: F401

#: Bytes of text that one numpy pass handles at a time; bounds a worker's memory.
SLICE_BYTES = 1 << 20


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def map_arrow(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str) -> DataFrame:
    """``mapInArrow`` with ``fn`` applied to slices of at most about ``SLICE_BYTES`` of data each (or one row).

    If ``df`` has a column ``row`` (see ``id_text``), ``fn`` keeps number and order of the
    rows, and ``row`` is passed on beside what ``fn`` returns.
    """
    carried = "row" in df.columns
    kind = StructType.fromDDL(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                out = fn(part)
                if out is not None and out.num_rows:
                    if carried:
                        out = pa.RecordBatch.from_arrays([*out.columns, part.column("row")], [*out.schema.names, "row"])
                    yield out

    return df.mapInArrow(run, kind.add(df.schema["row"]) if carried else kind)


def slices(batch: pa.RecordBatch, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut ``batch`` where the running size of its strings and binaries passes ``limit``."""
    n = batch.num_rows
    size = np.full(n, 16, dtype=np.int64)
    for column in batch.columns:
        if pa.types.is_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_string(column.type):
            size += string_parts(column)[2]
    group = np.cumsum(size) // limit
    cuts = [0, *(np.flatnonzero(np.diff(group)) + 1).tolist(), n]
    for a, b in zip(cuts, cuts[1:]):
        if b > a:
            yield batch.slice(a, b - a)


def string_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, start of each value in them and its length (0 for null), without copying."""
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(0, np.int64), np.zeros(0, np.int64)
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    kind = np.int64 if wide else np.int32
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, dtype=kind)[column.offset : column.offset + n + 1].astype(np.int64)
    raw = np.frombuffer(data, dtype=np.uint8) if data is not None else np.zeros(0, np.uint8)
    length = np.diff(off)
    if column.null_count:
        length = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, length)
    return raw, off[:-1], length


def texts(column: pa.Array) -> list[str]:
    """Python strings; null is empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def batch_of(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) if not isinstance(c, pa.Array) else c for c, f in zip(columns, schema)], schema=schema)


def id_text(docs: DataFrame, id_col: str, text_col: str, carry: bool = False) -> DataFrame:
    """Only the two columns, under fixed names, so that no other column of ``docs`` can clash.

    With ``carry``, all columns go along in a struct ``row``, for callers that want
    whole rows back without a join.
    """
    whole = [F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")] if carry else []
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"), *whole)
