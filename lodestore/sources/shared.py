"""The folder that the driver and all executors share, and tables written there to cut lineage."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Only a local master may leave it unset, and gets a temporary folder."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        named = tempfile.mkdtemp(prefix="lodestore-")
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


#: Scratch tables of this process that are still there.
_written: set[str] = set()
_steps = threading.local()


def scratch(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/scratch-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    _written.add(path)
    for made in getattr(_steps, "made", [])[-1:]:
        made.append(out)
    out._scratch_path = path
    return out


def _delete(spark: SparkSession, path: str) -> None:
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    there.getFileSystem(spark._jsc.hadoopConfiguration()).delete(there, True)


def let_go(*tables: DataFrame) -> None:
    """Delete scratch tables that nothing will read again: all that came of them has been written."""
    for t in tables:
        path = getattr(t, "_scratch_path", None)
        if path in _written:
            _written.discard(path)
            _delete(t.sparkSession, path)


@contextmanager
def step() -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Scratch tables written in a step go when it ends; the function it gives keeps one, for the step around it.

    What a step returns is to be read from kept tables alone.
    """
    stack = _steps.__dict__.setdefault("made", [])
    stack.append([])
    kept: list[DataFrame] = []

    def keep(table: DataFrame) -> DataFrame:
        kept.append(table)
        return table

    try:
        yield keep
    finally:
        made = stack.pop()
        let_go(*[t for t in made if not any(t is k for k in kept)])
        if stack:
            stack[-1].extend(kept)


def clear_scratch(spark: SparkSession) -> None:
    """Delete the scratch tables of this process, once their results have been written."""
    while _written:
        _delete(spark, _written.pop())
