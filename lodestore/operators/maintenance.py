"""Decisions about stored files, as functions of a table of file metadata.

FILE_META: id, level, size_bytes, entry_count, min_key, max_key, seq_min, seq_max, record_id_count,
created_at_ms, path. The table has a row a file, so it is small beside the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestore.functions.keys import composite_key, entry_bytes
from lodestore.schema import BOTTOM_LEVEL, FRAGMENT_BYTES, FREEZE_BYTES, FREEZE_SECONDS, L0_COMPACTION_FILES, L0_SLOW_FILES, L0_STOP_FILES, L1_BYTES, L2_BYTES, MAX_FROZEN, DELETE, PUT, RANGE_DELETE


def file_stats(rows: DataFrame, by: list[str]) -> DataFrame:
    """What a flush records about each file of ``rows``. Records are counted from one row a record."""
    size = entry_bytes(composite_key(F.col("record_id"), F.col("item_key")), F.col("value"), F.col("metadata")).cast("long")
    key = composite_key(F.col("record_id"), F.col("item_key"))
    count = lambda op: F.sum((F.col("op") == op).cast("long"))
    first = rows.groupBy(*by, "record_id").agg(
        F.count("*").alias("n"), F.sum(size).alias("b"), F.min("seq").alias("s0"), F.max("seq").alias("s1"), F.min(key).alias("k0"), F.max(key).alias("k1"), count(PUT).alias("puts"), count(DELETE).alias("deletes"), count(RANGE_DELETE).alias("range_deletes")
    )
    return first.groupBy(*by).agg(
        F.sum("n").alias("entry_count"), F.sum("b").alias("size_bytes"), F.count("*").alias("record_id_count"), F.min("s0").alias("seq_min"), F.max("s1").alias("seq_max"), F.min("k0").alias("min_key"), F.max("k1").alias("max_key"),
        F.sum("puts").alias("puts"), F.sum("deletes").alias("deletes"), F.sum("range_deletes").alias("range_deletes"),
    )


def level_sizes(files: DataFrame) -> DataFrame:
    return files.groupBy("level").agg(F.count("*").alias("files"), F.sum("size_bytes").alias("size_bytes"), F.min("min_key").alias("min_key"), F.max("max_key").alias("max_key"))


def overlapping(files: DataFrame, ranges: DataFrame) -> DataFrame:
    """Files of the level after a range's (level, low, high) whose keys meet it."""
    f, r = files.alias("f"), ranges.alias("r")
    return f.join(r, (F.col("f.level") == F.col("r.level") + 1) & (F.col("f.min_key") <= F.col("r.high")) & (F.col("f.max_key") >= F.col("r.low")), "left_semi")


def compaction_inputs(files: DataFrame, l0_files: int = L0_COMPACTION_FILES, l1_bytes: int = L1_BYTES, l2_bytes: int = L2_BYTES) -> DataFrame:
    """(level, id, role): what each due compaction reads.

    Level 0 is due with more than ``l0_files`` files, and takes all of them; levels 1 and 2 are due
    beyond their size, and take their oldest file; each takes what overlaps in the next level. The
    bottom level is never due.
    """
    due0 = files.where("level = 0").groupBy("level").agg(F.count("*").alias("n")).where(F.col("n") > l0_files).select("level")
    sizes = files.where("level IN (1, 2)").groupBy("level").agg(F.sum("size_bytes").alias("b"))
    due = sizes.where(F.when(F.col("level") == 1, F.col("b") > l1_bytes).otherwise(F.col("b") > l2_bytes)).select("level")
    first = files.join(due0, "level", "left_semi")
    oldest = files.join(due, "level", "left_semi").withColumn("_r", F.row_number().over(Window.partitionBy("level").orderBy("created_at_ms", "id"))).where("_r = 1").drop("_r")
    source = first.unionByName(oldest)
    ranges = source.groupBy("level").agg(F.min("min_key").alias("low"), F.max("max_key").alias("high"))
    target = overlapping(files, ranges)
    return source.select("level", "id", F.lit("source").alias("role")).unionByName(target.select((F.col("level") - 1).alias("level"), "id", F.lit("target").alias("role")))


def trivial_moves(inputs: DataFrame) -> DataFrame:
    """Levels whose compaction moves one file that nothing overlaps: only its label changes."""
    n = inputs.groupBy("level").agg(F.sum((F.col("role") == "source").cast("int")).alias("s"), F.sum((F.col("role") == "target").cast("int")).alias("t"))
    return n.where("s = 1 AND t = 0 AND level > 0").select("level")


def fragments(size_bytes: Column, fragment_bytes: int = FRAGMENT_BYTES) -> Column:
    return F.greatest(F.lit(1), F.ceil(size_bytes / fragment_bytes)).cast("int")


def drops_tombstones(target_level: Column) -> Column:
    return target_level >= BOTTOM_LEVEL


def stall(l0_files: Column) -> Column:
    """reject, slow or none, as level 0 grows."""
    return F.when(l0_files >= L0_STOP_FILES, "reject").when(l0_files > L0_SLOW_FILES, "slow").otherwise("none")


def stall_ms(l0_files: Column) -> Column:
    return F.when((l0_files > L0_SLOW_FILES) & (l0_files < L0_STOP_FILES), l0_files - L0_SLOW_FILES).otherwise(F.lit(0)).cast("int")


def freeze_due(size_bytes: Column, age_seconds: Column, frozen: Column) -> Column:
    """A memory table is closed at its size or age, if not too many closed ones wait."""
    return ((size_bytes >= FREEZE_BYTES) | (age_seconds >= FREEZE_SECONDS)) & (frozen < MAX_FROZEN)


def apply_manifest(files: DataFrame, removed: DataFrame, added: DataFrame) -> DataFrame:
    """Remove, then add."""
    return files.join(removed.select("id"), "id", "left_anti").unionByName(added)


def prunable(snapshots: DataFrame, kept: int) -> DataFrame:
    """Snapshots older than the ``kept`` newest."""
    newest = snapshots.orderBy(F.desc("id")).limit(kept)
    return snapshots.join(newest, "id", "left_anti")


def oldest_file(files: DataFrame) -> DataFrame:
    """The oldest file of each level."""
    return files.groupBy("level").agg(F.min(F.struct("created_at_ms", "id")).alias("m")).select("level", "m.id", "m.created_at_ms")


def latency_quantiles(samples: DataFrame, by: str, value: str, accuracy: int = 100_000) -> DataFrame:
    """p50, p95, p99, the largest and the number of samples of each kind. Sketches merge, so nothing is sorted as a whole."""
    p = F.percentile_approx(value, [0.5, 0.95, 0.99], accuracy)
    return samples.groupBy(by).agg(p.alias("p"), F.max(value).alias("max"), F.count("*").alias("n")).select(by, F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), F.col("p")[2].alias("p99"), "max", "n")
