"""The record store: namespaces of snapshots over Parquet files of the mutation log.

A namespace is a folder: versions of its configuration, snapshots numbered upwards, and data folders. A
snapshot lists the files that make up the log at that point, each with its level and its range of keys,
with the sequence numbers given out so far. A commit is the exclusive creation of the next
number's file: of two writers one succeeds, and the other tries again on top. Files are dealt and sorted
by partition, record and key, so that one record's read takes the few files whose range holds it, and of those
the row groups that do.

Before a writer writes data it claims the folder. Vacuum leaves claimed folders alone until the claim is older than
the grace period; then it takes the claim and commits, so that the late writer's own commit fails.

Tokens are remembered by themselves: compaction writes those of what it merges into token files, which only
the retention period ends.

Single requests (get, put, delete) and bulk ones (DataFrames of many records) share the same kernel.
"""

from __future__ import annotations

import json
import os
import time
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore import schema as s
from lodestore.functions.keys import PageToken, VersionClock, big_endian, derived_token, random_token
from lodestore.functions.routing import route, route_one
from lodestore.operators import dedup, kernel, maintenance, paging, predicates
from lodestore.sources.files import Files
from lodestore.sources.shared import let_go, scratch

ACTIVE, FROZEN, DRAINING, STOPPED = "active", "frozen", "draining", "stopped"
#: States of a namespace that allow reads and writes.
_READS, _WRITES = {ACTIVE, FROZEN}, {ACTIVE}
_NEXT_STATE = {ACTIVE: {FROZEN, DRAINING}, FROZEN: {ACTIVE, DRAINING}, DRAINING: {STOPPED}, STOPPED: set()}
_CODECS = {"none": "uncompressed", "snappy": "snappy", "zstd": "zstd"}


@dataclass(frozen=True)
class Config:
    """A namespace's settings; name, partitions and routing never change."""

    name: str
    partitions: int = 8
    routing: dict = field(default_factory=lambda: {"kind": "simple"})
    default_page_bytes: int = s.DEFAULT_PAGE_BYTES
    max_page_bytes: int = s.MAX_PAGE_BYTES
    compression: str = "zstd"
    bloom_false_positives: float = 0.01
    target_slo_ms: int = 10
    max_slo_ms: int = 100
    fsync: str = "batch_sync"
    batch_interval_ms: int = 10
    #: Tokens older than this are forgotten; None keeps all.
    token_retention_ms: int | None = None
    #: Deletes are kept this long by a compaction that could drop them.
    tombstone_ttl_ms: int = 0
    #: Data files are cut at about this size, or at this many rows: few bytes of a file can be many of a task's memory.
    file_bytes: int = s.FRAGMENT_BYTES
    file_rows: int = s.FRAGMENT_ROWS
    #: Level 0 is compacted beyond so many commits, levels 1 and 2 beyond these sizes.
    l0_commits: int = s.L0_COMPACTION_FILES
    l1_bytes: int = s.L1_BYTES
    l2_bytes: int = s.L2_BYTES
    #: Data that a writer claimed and has not committed is left alone this long.
    grace_ms: int = 24 * 3600 * 1000

    def __post_init__(self):
        s.check_namespace(self.name)
        bad = None
        if self.partitions < 1 or self.partitions & (self.partitions - 1):
            bad = "the number of partitions is a power of two"
        elif not 0 < self.bloom_false_positives < 1:
            bad = "a rate of false positives lies between 0 and 1"
        elif self.default_page_bytes > self.max_page_bytes:
            bad = "the default page is not larger than the largest"
        elif self.target_slo_ms > self.max_slo_ms:
            bad = "the target latency is not above the largest"
        elif self.fsync not in ("sync", "batch_sync"):
            bad = "fsync is sync or batch_sync"
        elif self.batch_interval_ms <= 0:
            bad = "the batch interval is positive"
        elif min(self.file_bytes, self.file_rows, self.l1_bytes, self.l2_bytes, self.l0_commits) <= 0 or self.grace_ms < 0:
            bad = "sizes and limits of levels are positive"
        elif self.compression not in _CODECS:
            bad = f"compression is one of {', '.join(_CODECS)}"
        elif self.routing["kind"] == "composite" and not self.routing.get("fields"):
            bad = "composite routing needs a field"
        elif self.routing["kind"] == "prefix" and self.routing.get("length", 0) <= 0:
            bad = "the prefix has at least one byte"
        if bad:
            raise s.InvalidArgument(bad)

    @classmethod
    def from_env(cls, name: str, env=None) -> Config:
        """Settings from LODESTORE_* variables, or from the JSON file that LODESTORE_CONFIG names."""
        env = os.environ if env is None else env
        values = {}
        if "LODESTORE_CONFIG" in env:
            with open(env["LODESTORE_CONFIG"]) as f:
                values = json.load(f)
        for key, kind in (("partitions", int), ("default_page_bytes", int), ("max_page_bytes", int), ("compression", str), ("token_retention_ms", int), ("tombstone_ttl_ms", int)):
            if f"LODESTORE_{key.upper()}" in env:
                values[key] = kind(env[f"LODESTORE_{key.upper()}"])
        return cls(name=name, **values)


@dataclass(frozen=True)
class Selection:
    """How much of a result one page brings."""

    page_size_bytes: int = 0
    item_limit: int = 0
    exclude_values: bool = False
    page_token: bytes | None = None


@dataclass(frozen=True)
class Page:
    items: list
    next_token: bytes | None


class Store:
    """Namespaces under one root folder."""

    def __init__(self, spark: SparkSession, root: str, node_id: int = 0):
        self.spark, self.files = spark, Files(spark, root)
        self.clock = VersionClock(node_id)

    # Namespaces

    def _config(self, name: str) -> tuple[int, dict | None]:
        """The newest version of a namespace's configuration; None if it is not there, or no more."""
        n, value = self.files.newest(f"{s.check_namespace(name)}/config")
        return n, None if value is None or value.get("deleted") else value

    def create_namespace(self, config: Config) -> Namespace:
        n, old = self._config(config.name)
        if old is not None:
            raise s.AlreadyExists(config.name)
        try:
            self.files.advance(f"{config.name}/config", n, asdict(config))
        except s.Conflict as e:
            raise s.AlreadyExists(config.name) from e
        return Namespace(self, config.name)

    def namespace(self, name: str) -> Namespace:
        if not self.namespace_exists(name):
            raise s.NotFound(name)
        return Namespace(self, name)

    def namespace_exists(self, name: str) -> bool:
        return self._config(name)[1] is not None

    def list_namespaces(self) -> list[str]:
        return [n for n in self.files.list("") if self.namespace_exists(n)]

    def update_namespace(self, config: Config) -> None:
        """Replaces the configuration; a reader sees the old one or the new one. Conflict if another writer was first."""
        n, old = self._config(config.name)
        if old is None:
            raise s.NotFound(config.name)
        if (old["partitions"], old["routing"]) != (config.partitions, config.routing):
            raise s.InvalidArgument("partitions and routing never change")
        self.files.advance(f"{config.name}/config", n, asdict(config), keep=2)

    def delete_namespace(self, name: str) -> None:
        """Takes the name away; data stays until it is vacuumed."""
        n, old = self._config(name)
        if old is None:
            raise s.NotFound(name)
        self.files.advance(f"{name}/config", n, {"deleted": True}, keep=2)


def _sort_key(partition: Column, record: Column, key: Column) -> Column:
    """What files are dealt and sorted by, as one key: the partition in four bytes, the record, a zero byte, the item key."""
    return F.concat(big_endian(partition, 4), record.cast("binary"), F.lit(b"\0"), key)


def _run(part: dict) -> str:
    """What is compacted together: a commit at level 0, else files that make up about ``file_bytes``."""
    return part["path"].partition("/")[0] if part["level"] == 0 else part.get("run", part["id"])


class Namespace:
    def __init__(self, store: Store, name: str):
        self.store, self.name, self.spark, self.files = store, name, store.spark, store.files

    @property
    def config(self) -> Config:
        """Read anew each time, so that a change holds at once."""
        _, value = self.store._config(self.name)
        if value is None:
            raise s.NotFound(self.name)
        return Config(**value)

    # Life cycle

    @property
    def state(self) -> str:
        _, value = self.files.newest(f"{self.name}/state")
        return value["state"] if value else ACTIVE

    def set_state(self, state: str) -> None:
        n, value = self.files.newest(f"{self.name}/state")
        now = value["state"] if value else ACTIVE
        if state not in _NEXT_STATE.get(now, ()):
            raise s.Unavailable(f"{now} does not become {state}")
        self.files.advance(f"{self.name}/state", n, {"state": state}, keep=2)

    def _allow(self, states: set[str]) -> None:
        if self.state not in states:
            raise s.Unavailable(f"{self.name} is {self.state}")

    # Snapshots

    def snapshot_ids(self) -> list[int]:
        return self.files.versions(f"{self.name}/snapshots")

    def snapshot(self, number: int | None = None) -> dict:
        if number is None:
            number, newest = self.files.newest(f"{self.name}/snapshots")
            if newest is not None:
                return newest
        if number == 0:
            return {"id": 0, "parts": [], "tokens": [], "next_seq": 1, "streams": {}, "epoch": 0, "compactor": 0}
        if number not in self.snapshot_ids():
            raise s.NotFound(f"snapshot {number}")
        return self.files.get_json(f"{self.name}/snapshots/{number:020d}.json")

    def _commit(self, base: dict, **changes) -> dict:
        """The next snapshot, or Conflict if another writer made it."""
        new = base | changes | {"id": base["id"] + 1, "committed_ms": int(time.time() * 1000)}
        self.files.advance(f"{self.name}/snapshots", base["id"], new)
        return new

    def _fence(self, base: dict, kind: str, epoch: int | None) -> None:
        # The commit is on top of this very snapshot, so nobody can have begun in between.
        if epoch is not None and base.get(kind, 0) > epoch:
            raise s.Fenced(f"a newer {'writer' if kind == 'epoch' else kind} has begun")

    def begin_epoch(self) -> int:
        """A new writer's number; commits of older writers are refused from here on."""
        return self._commit(base := self.snapshot(), epoch=base.get("epoch", 0) + 1)["epoch"]

    def begin_compactor(self) -> int:
        """The same for compactors."""
        return self._commit(base := self.snapshot(), compactor=base.get("compactor", 0) + 1)["compactor"]

    # The log

    def _open(self, parts: list[dict]) -> DataFrame:
        if not parts:
            return self.spark.createDataFrame([], s.MUTATION_LOG)
        return self.spark.read.schema(s.MUTATION_LOG).parquet(*[self.files.url(f"{self.name}/data/{p['path']}") for p in parts])

    def log(self, snapshot: int | None = None, as_of: int | None = None, record: tuple[int, str] | None = None) -> DataFrame:
        """The mutation log of a snapshot (the latest); ``record`` (partition, id) leaves out files whose range does not hold it."""
        parts = self.snapshot(snapshot)["parts"]
        if record is not None:
            low = (record[0].to_bytes(4, "big") + record[1].encode() + b"\0").hex()
            parts = [p for p in parts if p["min_key"][: len(low)] <= low <= p["max_key"]]
        out = self._open(parts)
        if record is not None:
            out = out.where((F.col("partition_id") == record[0]) & (F.col("record_id") == record[1]))
        return kernel.as_of(out, as_of) if as_of is not None else out

    def items(self, snapshot: int | None = None, as_of: int | None = None) -> DataFrame:
        """The visible items of all records."""
        self._allow(_READS)
        return kernel.visible_items(self.log(snapshot, as_of))

    def _write_files(self, rows: DataFrame, folder: str, files: int | None, small: bool) -> None:
        """Rows by ranges of partition, record and key, sorted; a record with a third of all rows is cut inside.

        Only a ``small`` batch is coalesced: that would have one task run all that ``rows`` come of.
        """
        config, by = self.config, ["partition_id", "record_id", "item_key"]
        # Without a number Spark joins small ranges at run time.
        dealt = rows.coalesce(1) if small else rows.repartitionByRange(files, *by) if files else rows.repartitionByRange(*by)
        writer = dealt.sortWithinPartitions(*by, F.desc("seq")).write.option("compression", _CODECS[config.compression])
        # Splits of a scan are measured in bytes and files, so that a task's rows are bounded only if a file's are.
        writer = writer.option("maxRecordsPerFile", config.file_rows)
        # As large as a file's own keys need; by default each filter has a megabyte.
        writer = writer.option("parquet.bloom.filter.adaptive.enabled", "true")
        for c in ("record_id", "token") if files != 1 else ():
            writer = writer.option(f"parquet.bloom.filter.enabled#{c}", "true").option(f"parquet.bloom.filter.fpp#{c}", str(config.bloom_false_positives))
        writer.parquet(self.files.url(f"{self.name}/data/{folder}"))

    def _claim(self) -> str:
        """A new data folder's name. Vacuum leaves it alone while it is claimed."""
        folder = uuid.uuid4().hex
        self.files.create(f"{self.name}/pending/{folder}", json.dumps({"since_ms": int(time.time() * 1000)}).encode())
        return folder

    def _end_claims(self, folders: list[str], delete: bool = False) -> None:
        for folder in folders:
            if delete:
                self.files.delete(f"{self.name}/data/{folder}")
            self.files.delete(f"{self.name}/pending/{folder}")

    def _write_parts(self, rows: DataFrame, level: int, folder: str, merged: list[dict] | None = None, small: bool = False) -> list[dict]:
        """Rows become files of a claimed folder; returns their entries for a snapshot.

        ``merged`` are the files that the rows come of, if they are known: their bytes say how many runs of files are
        written, and their rows how many files a run is cut into.

        The entries come from the files' keys and sequences, read back: values are not read again. A range
        delete counts for all keys that it covers, so that files it could touch meet its own.
        """
        config, runs, files = self.config, None, 1 if small else None
        if merged:
            runs = -(-sum(p["size_bytes"] for p in merged) // config.file_bytes)
            files = max(runs, -(-sum(p["entry_count"] for p in merged) // config.file_rows))
        self._write_files(rows.select(s.MUTATION_LOG.names), folder, files, small)
        key = _sort_key(F.col("partition_id"), F.col("record_id"), F.col("item_key"))
        beyond = F.concat(big_endian(F.col("partition_id"), 4), F.col("record_id").cast("binary"), F.lit(b"\1"))
        end = F.when(F.octet_length("range_end") > 0, _sort_key(F.col("partition_id"), F.col("record_id"), F.col("range_end"))).otherwise(beyond)
        last = F.when(F.col("op") == s.RANGE_DELETE, F.greatest(key, end)).otherwise(key)
        written = self.spark.read.schema(s.MUTATION_LOG).parquet(self.files.url(f"{self.name}/data/{folder}"))
        stats = written.groupBy(F.col("_metadata.file_name").alias("file"), F.col("_metadata.file_size").alias("size")).agg(
            F.count("*").alias("n"), F.count("token").alias("tokens"), F.min("seq").alias("seq_min"), F.max("seq").alias("seq_max"), F.hex(F.min(key)).alias("min_key"), F.hex(F.max(last)).alias("max_key")
        )
        now, found = int(time.time() * 1000), sorted(stats.collect(), key=lambda r: r["file"])
        # Files in turn make up a run, which its first one names. Without a number of runs, each file is one.
        heads, runs = {}, min(runs or len(found), len(found))
        return [
            {"id": f"{folder}/{r['file']}", "run": f"{folder}/{heads.setdefault(k * runs // len(found), r['file'])}", "path": f"{folder}/{r['file']}", "level": level, "entry_count": r["n"], "tokens": r["tokens"], "size_bytes": r["size"], "seq_min": r["seq_min"], "seq_max": r["seq_max"], "min_key": r["min_key"].lower(), "max_key": r["max_key"].lower(), "created_at_ms": now}
            for k, r in enumerate(found)
        ]

    def file_meta(self, snapshot: int | None = None) -> DataFrame:
        """FILE_META of a snapshot, for the functions in operators.maintenance. It has a row for the files that are compacted together, see _run."""
        return self._meta(self.snapshot(snapshot)["parts"])

    def _meta(self, parts: list[dict]) -> DataFrame:
        kind = "id string, level int, entry_count long, size_bytes long, seq_min long, seq_max long, min_key string, max_key string, created_at_ms long"
        names, runs = [c.split()[0] for c in kind.split(", ")], {}
        for p in parts:
            runs.setdefault(_run(p), []).append(p)
        fold = {"level": max, "entry_count": sum, "size_bytes": sum, "seq_min": min, "seq_max": max, "min_key": min, "max_key": max, "created_at_ms": min}
        return self.spark.createDataFrame([(i, *(fold[n](p[n] for p in run) for n in names[1:])) for i, run in runs.items()], kind)
    # Writing

    def append(self, changes: DataFrame, stream: tuple[str, int] | None = None, epoch: int | None = None, unique_ord: bool = False, tokens: bool = True, retries: int = 5, small: bool = False) -> dict:
        """Append changes of many records as one commit.

        ``changes`` has record_id, item_key, op, range_end, value, metadata, token (24 bytes or null), ord (long): the
        order of arrival. Sequences go on where the snapshot's stopped, by ord. With ``unique_ord`` no two
        rows of a key share an ord, and sequences are ord moved up: no sort, however large the batch. Rows whose token
        was seen are skipped, unless ``tokens`` says that there are none. ``stream`` (name, batch) makes a repeated
        batch a no-op. ``small`` says that the batch is one file.
        """
        self._allow(_WRITES)
        config = self.config
        for attempt in range(retries):
            base = self.snapshot()
            self._fence(base, "epoch", epoch)
            if stream and base["streams"].get(stream[0], -1) >= stream[1]:
                return base
            if maintenance_status(len({p["path"].partition("/")[0] for p in base["parts"] if p["level"] == 0})) == "reject":
                self.compact_level(0)
                base = self.snapshot()
            folder = self._claim()
            rows, staged = self._numbered(changes, base, unique_ord, small)
            if tokens:
                rows = dedup.new_rows(rows, self._seen(base, config, changes if small else None))
            parts = self._write_parts(rows, 0, folder, small=small)
            let_go(*staged)
            streams = base["streams"] | ({stream[0]: stream[1]} if stream else {})
            try:
                new = self._commit(base, parts=base["parts"] + parts, next_seq=max([base["next_seq"], *(p["seq_max"] + 1 for p in parts)]), streams=streams)
                self._end_claims([folder])
                return new
            except s.Conflict:
                self._end_claims([folder], delete=True)
                if attempt + 1 == retries:
                    raise
        raise AssertionError

    def _numbered(self, changes: DataFrame, base: dict, unique_ord: bool, small: bool = False) -> tuple[DataFrame, list[DataFrame]]:
        """``changes`` as rows of the log, and the tables to let go once they are written."""
        config, staged = self.config, []
        if unique_ord:
            first = 0 if small else changes.agg(F.min("ord")).first()[0] or 0
            rows = changes.withColumn("seq", F.col("ord") + F.lit(base["next_seq"] - first))
        else:
            # In order of arrival over all tasks, ties anywhere; then each task goes on where the one before it
            # stopped. One number a task comes to the driver, and no partition is numbered in one task.
            n = F.monotonically_increasing_id()
            by = ["ord", "record_id", "item_key", "_n"]
            staged = [scratch(changes.withColumn("_n", n).repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_n", n))]
            task, place = F.shiftright("_n", 33), F.col("_n").bitwiseAND(F.lit((1 << 33) - 1))
            sizes, at, begin = staged[0].groupBy(task.alias("t")).agg(F.count("*").alias("c")).orderBy("t").collect(), base["next_seq"], []
            for r in sizes:
                begin.append((r["t"], at))
                at += r["c"]
            offsets = self.spark.createDataFrame(begin, "_t long, _begin long")
            rows = staged[0].join(offsets, task == F.col("_t")).withColumn("seq", F.col("_begin") + place)
        now = int(time.time() * 1000)
        partition = route(F.col("record_id"), config.partitions, config.routing).alias("partition_id")
        kept = rows.select(F.lit(self.name).alias("namespace"), partition, "record_id", "item_key", "op", "range_end", "value", F.coalesce("metadata", F.lit(b"")).alias("metadata"), "token", F.col("seq").cast("long").alias("seq"), F.lit(now).cast("long").alias("created_at_ms"))
        return kept, staged

    def _seen(self, base: dict, config: Config, asked: DataFrame | None = None) -> DataFrame:
        """(namespace, partition_id, token) of the writes that are remembered.

        Only the token column of files that were not compacted is read, and the token files of those that were. With
        ``asked``, a small batch, its few tokens go to the scan, whose files and row groups have bloom filters.
        """
        fresh = self._open([p for p in base["parts"] if p["level"] == 0 and p["tokens"]])
        old = self._open(base.get("tokens", []))
        seen = kernel.merge(*[x.select("namespace", "partition_id", "token", "created_at_ms") for x in (fresh, old)]).where(F.col("token").isNotNull())
        if config.token_retention_ms is not None:
            seen = seen.where(F.col("created_at_ms") >= int(time.time() * 1000) - config.token_retention_ms)
        if asked is not None:
            tokens = [r["token"] for r in asked.select("token").where("token IS NOT NULL").collect()]
            seen = seen.where(F.col("token").isin([bytes(t) for t in tokens]))
        return seen

    def put(self, record_id: str, items: Sequence[tuple], token: bytes | None = None, generation_time: int = 0, strict: bool = False) -> tuple[int, int, int]:
        """Insert or update ``items`` (key, value[, metadata]) of one record; of a repeated key the last wins.

        The same ``token`` again changes nothing and succeeds; if ``strict``, it is refused with AlreadyExists.
        Returns the write's version.
        """
        s.check_record_id(record_id)
        if not items:
            raise s.InvalidArgument("a put has at least one item")
        token = s.check_token(token)
        rows = [(k, s.check_item_key(i[0]), bytes(i[1]), bytes(i[2]) if len(i) > 2 else b"") for k, i in enumerate(items)]
        df = self.spark.createDataFrame(rows, "ord long, item_key binary, value binary, metadata binary")
        own = F.lit(None).cast("binary") if token is None else derived_token(F.lit(random_token(generation_time, token)), F.col("ord"))
        changes = df.select(F.lit(record_id).alias("record_id"), "item_key", F.lit(s.PUT).alias("op"), F.lit(None).cast("binary").alias("range_end"), "value", "metadata", own.alias("token"), "ord")
        if strict and token is not None:
            base = self.snapshot()
            dedup.refuse_repeated(self._numbered(changes, base, True, True)[0], self._seen(base, self.config, changes))
        self.append(changes, unique_ord=True, tokens=token is not None, small=True)
        return self.store.clock.next()

    def put_many(self, rows: DataFrame) -> tuple[int, int, int]:
        """Bulk put: record_id, item_key, value, and optionally metadata, token, ord (else any order)."""
        have = set(rows.columns)
        option = lambda c, v: F.col(c) if c in have else v
        self.append(rows.select("record_id", "item_key", F.lit(s.PUT).alias("op"), F.lit(None).cast("binary").alias("range_end"), "value", option("metadata", F.lit(b"")).alias("metadata"), option("token", F.lit(None).cast("binary")).alias("token"), option("ord", F.lit(0)).cast("long").alias("ord")), tokens="token" in have)
        return self.store.clock.next()

    def _deletes(self, record_id: str, rows: list[tuple[str, bytes, bytes | None]]) -> tuple[int, int, int]:
        s.check_record_id(record_id)
        df = self.spark.createDataFrame([(k, op, a, b) for k, (op, a, b) in enumerate(rows)], "ord long, op string, item_key binary, range_end binary")
        none = F.lit(None).cast("binary")
        self.append(df.select(F.lit(record_id).alias("record_id"), "item_key", "op", "range_end", F.lit(b"").alias("value"), F.lit(b"").alias("metadata"), none.alias("token"), "ord"), unique_ord=True, tokens=False, small=True)
        return self.store.clock.next()

    def delete_keys(self, record_id: str, keys: Sequence[bytes]) -> tuple[int, int, int]:
        if not keys:
            raise s.InvalidArgument("at least one key is deleted")
        return self._deletes(record_id, [(s.DELETE, s.check_item_key(k), None) for k in keys])

    def delete_range(self, record_id: str, start=None, end=None, start_inclusive: bool = False, end_inclusive: bool = False) -> tuple[int, int, int]:
        return self._deletes(record_id, [(s.RANGE_DELETE, *predicates.delete_bounds(start, end, start_inclusive, end_inclusive))])

    def delete_all(self, record_id: str) -> tuple[int, int, int]:
        return self._deletes(record_id, [(s.RANGE_DELETE, b"", None)])

    # Reading

    def _record(self, record_id: str, snapshot: int | None = None) -> DataFrame:
        self._allow(_READS)
        s.check_record_id(record_id)
        config = self.config
        return self.log(snapshot, record=(route_one(record_id, config.partitions, config.routing), record_id))

    def get_keys(self, record_id: str, keys: Sequence[bytes], exclude_values: bool = False, snapshot: int | None = None) -> list:
        """Items in the order asked; repeated as asked, misses left out; never paged."""
        predicates.keys_condition(keys)
        own = self._record(record_id, snapshot)
        points = own.where((F.col("op") == s.RANGE_DELETE) | predicates.keys_condition(keys))
        asked = self.spark.createDataFrame([(record_id, [bytes(k) for k in keys])], "record_id string, keys array<binary>")
        found = predicates.match_keys(kernel.visible_items(points), asked)
        if exclude_values:
            found = paging.exclude_values(found)
        return found.orderBy("pos").drop("pos").collect()

    def get_range(self, record_id: str, start=None, end=None, start_inclusive: bool = False, end_inclusive: bool = False, selection: Selection = Selection(), snapshot: int | None = None) -> Page:
        """One page of the items in the range. There is a next token only if a visible item is left."""
        items = predicates.match_range(kernel.visible_items(self._record(record_id, snapshot)), start, end, start_inclusive, end_inclusive)
        if selection.page_token:
            items = items.where(F.col("item_key") > F.lit(PageToken.decode(selection.page_token).last_key))
        config = self.config
        budget = s.page_bytes(selection.page_size_bytes, config.default_page_bytes, config.max_page_bytes)
        page, more = paging.one_page(items, budget, selection.item_limit or None, len(record_id.encode()))
        token = PageToken(bytes(page[-1]["item_key"]), page[-1]["seq"], None).encode() if more else None
        if selection.exclude_values:
            page = [type(r)(**(r.asDict() | {"value": b""})) for r in page]
        return Page(page, token)

    def get_all(self, record_id: str, selection: Selection = Selection(), snapshot: int | None = None) -> Page:
        return self.get_range(record_id, selection=selection, snapshot=snapshot)

    def scan(self, record_id: str, start=None, end=None, start_inclusive: bool = False, end_inclusive: bool = False) -> Iterator[list]:
        """Batches of items of one snapshot to the end of the range, each of the namespace's default page size."""
        items = predicates.match_range(kernel.visible_items(self._record(record_id, self.snapshot()["id"])), start, end, start_inclusive, end_inclusive)
        budget, batch, filled = self.config.default_page_bytes, [], 0
        for r in items.orderBy("item_key").toLocalIterator(prefetchPartitions=True):
            batch.append(r)
            filled += len(record_id.encode()) + 1 + len(r["item_key"]) + len(r["value"] or b"") + len(r["metadata"] or b"")
            if filled >= budget:
                yield batch
                batch, filled = [], 0
        if batch:
            yield batch

    def scan_keys(self, record_id: str, keys: Sequence[bytes]) -> Iterator[list]:
        """One batch, and none if nothing was found."""
        found = self.get_keys(record_id, keys)
        if found:
            yield found

    # Many records at once

    def get_many(self, wanted: DataFrame, snapshot: int | None = None) -> DataFrame:
        """Multi-get: ``wanted`` has record_id and keys (an array). Items with ``pos``, their place in the request.

        The log is cut down to the records asked for before anything is aggregated; a small request is
        broadcast by its size and leaves the log's rows where they are.
        """
        self._allow(_READS)
        asked = wanted.select("record_id").distinct()
        own = self.log(snapshot).join(asked, "record_id", "left_semi")
        return predicates.match_keys(kernel.visible_items(own), wanted)

    def scan_many(self, start=None, end=None, start_inclusive: bool = False, end_inclusive: bool = False, records: DataFrame | None = None, snapshot: int | None = None) -> DataFrame:
        """The range of every record, or of ``records`` (record_id). Puts and deletes outside of the range are not read on."""
        self._allow(_READS)
        log = self.log(snapshot)
        if records is not None:
            log = log.join(records.select("record_id").distinct(), "record_id", "left_semi")
        inside = predicates.range_condition(F.col("item_key"), start, end, start_inclusive, end_inclusive)
        return kernel.visible_items(log.where((F.col("op") == s.RANGE_DELETE) | inside))

    def delete_many(self, rows: DataFrame) -> tuple[int, int, int]:
        """Bulk delete: record_id, item_key (null: the whole record)."""
        none = F.lit(None).cast("binary")
        op = F.when(F.col("item_key").isNull(), s.RANGE_DELETE).otherwise(s.DELETE)
        key = F.coalesce("item_key", F.lit(b""))
        self.append(rows.select("record_id", key.alias("item_key"), op.alias("op"), none.alias("range_end"), F.lit(b"").alias("value"), F.lit(b"").alias("metadata"), none.alias("token"), F.lit(0).cast("long").alias("ord")), unique_ord=True, tokens=False)
        return self.store.clock.next()

    # Maintenance

    def compact(self, full: bool = True, compactor: int | None = None, retries: int = 5) -> dict:
        """Rewrite the whole log as its shortest equivalent at the bottom level; if not ``full``, what is due at level 0.

        A full one drops the deletes that are old enough, see kernel.compact.
        """
        if not full:
            return self.compact_level(0, compactor, retries)
        return self._compact(lambda parts: (parts, s.BOTTOM_LEVEL), compactor, retries)

    def compact_level(self, level: int, compactor: int | None = None, retries: int = 5, inputs: set[str] | None = None) -> dict:
        """Merge a level's sources (all of level 0, else its oldest file) with what they overlap in the next level.

        One source that overlaps nothing only changes its label. ``inputs`` are ids that were chosen already; they
        are chosen anew if one of them is gone.
        """

        def choose(parts: list[dict]) -> tuple[list[dict], int]:
            ids = inputs
            if ids is None or not ids <= {_run(p) for p in parts}:
                limits = [-1 if k == level else 1 << 62 for k in range(3)]
                ids = {r["id"] for r in maintenance.compaction_inputs(self._meta(parts), *limits).collect()}
            return [p for p in parts if _run(p) in ids], level + 1

        return self._compact(choose, compactor, retries)

    def _compact(self, choose, compactor: int | None, retries: int) -> dict:
        config = self.config
        for attempt in range(retries):
            base = self.snapshot()
            self._fence(base, "compactor", compactor)
            chosen, target = choose(base["parts"]) if base["parts"] else ([], 0)
            if not chosen:
                return base
            gone, claims, tokens = {p["id"] for p in chosen}, [], base.get("tokens", [])
            rest = [p for p in base["parts"] if p["id"] not in gone]
            fresh = [p for p in chosen if p["level"] == 0 and p["tokens"]]
            if len({_run(p) for p in chosen}) == 1 and 0 < chosen[0]["level"] < target < s.BOTTOM_LEVEL:  # maintenance.trivial_moves
                parts = [p | {"level": target} for p in chosen]
            else:
                rows = self._open(chosen)
                # Deletes go only where no other file holds what they could cover.
                low, high = min(p["min_key"] for p in chosen), max(p["max_key"] for p in chosen)
                alone = target >= s.BOTTOM_LEVEL and not any(p["min_key"] <= high and p["max_key"] >= low for p in rest)
                before = int(time.time() * 1000) - config.tombstone_ttl_ms if config.tombstone_ttl_ms else None
                claims.append(self._claim())
                parts = self._write_parts(kernel.compact(rows, full=alone, drop_before_ms=before), target, claims[-1], chosen)
            if fresh:
                claims.append(self._claim())
                tokens = self._merged_tokens(fresh, tokens, config, claims[-1])
            try:
                new = self._commit(base, parts=rest + parts, tokens=tokens)
                self._end_claims(claims)
                return new
            except s.Conflict:
                self._end_claims(claims, delete=True)
                if attempt + 1 == retries:
                    raise
        raise AssertionError

    def _merged_tokens(self, fresh: list[dict], tokens: list[dict], config: Config, folder: str) -> list[dict]:
        """Token files with those of ``fresh`` added; what the retention has ended goes. Files that have grown are left as they are."""
        oldest = int(time.time() * 1000) - config.token_retention_ms if config.token_retention_ms is not None else None
        live = [p for p in tokens if oldest is None or p["newest_ms"] >= oldest]
        small = [p for p in live if p["size_bytes"] < config.file_bytes // 2 and p["entry_count"] < config.file_rows // 2]
        rows = self._open(fresh + small).where(F.col("token").isNotNull())
        if oldest is not None:
            rows = rows.where(F.col("created_at_ms") >= oldest)
        key = ["namespace", "partition_id", "record_id", "token"]
        once = rows.groupBy(*key).agg(F.min("seq").alias("seq"), F.max("created_at_ms").alias("created_at_ms"))
        none = F.lit(None).cast("binary")
        once = once.select("namespace", "partition_id", "record_id", F.lit(b"").alias("item_key"), F.lit(s.PUT).alias("op"), none.alias("range_end"), none.alias("value"), none.alias("metadata"), "token", "seq", "created_at_ms")
        written = self._write_parts(once, 0, folder, fresh + small)
        now = int(time.time() * 1000)
        return [p for p in live if p not in small] + [p | {"newest_ms": now} for p in written]

    def maintain(self, compactor: int | None = None) -> list[str]:
        """One turn of upkeep: each level that is due gives what is due to the next; returns what was done."""
        done, config = [], self.config
        due: dict[int, set[str]] = {}
        for r in maintenance.compaction_inputs(self.file_meta(), config.l0_commits, config.l1_bytes, config.l2_bytes).collect():
            due.setdefault(r["level"], set()).add(r["id"])
        for level in sorted(due):
            self.compact_level(level, compactor, inputs=due[level])
            done.append(f"compact {level}")
        if len(self.snapshot_ids()) > s.MANIFESTS_KEPT:
            done += [f"vacuum {n}" for n in self.vacuum(s.MANIFESTS_KEPT)]
        return done

    def vacuum(self, keep: int = 2) -> list[str]:
        """Delete all but the newest ``keep`` snapshots, and data that none of those lists and no writer has claimed.

        Claims older than the grace period are taken first, and a commit then makes the late writer's own fail: its
        data can go. Folders are listed before claims, and claims before snapshots, so that a folder
        that is claimed, written and committed meanwhile is seen by one of them.
        """
        keep = max(1, keep)
        pending = f"{self.name}/pending"
        late = [c for c in self.files.list(pending) if self.files.get_json(f"{pending}/{c}")["since_ms"] <= int(time.time() * 1000) - self.config.grace_ms]
        for c in late:
            self.files.delete(f"{pending}/{c}")
        while late:
            try:
                self._commit(self.snapshot())
                break
            except s.Conflict:
                continue
        folders, claimed = self.files.list(f"{self.name}/data"), set(self.files.list(pending))
        ids = sorted(self.snapshot_ids())
        used = {p["path"].partition("/")[0] for n in ids[-keep:] for k in ("parts", "tokens") for p in self.snapshot(n).get(k, [])}
        for n in ids[: max(0, len(ids) - keep)]:
            self.files.delete(f"{self.name}/snapshots/{n:020d}.json")
        gone = [d for d in folders if d not in used and d not in claimed]
        for d in gone:
            self.files.delete(f"{self.name}/data/{d}")
        return gone


def maintenance_status(l0_parts: int) -> str:
    return "reject" if l0_parts >= s.L0_STOP_FILES else "slow" if l0_parts > s.L0_SLOW_FILES else "none"


def with_config(config: Config, **changes) -> Config:
    return replace(config, **changes)
