"""Queries that go through a store on disk and through streams; what they read back must equal the plain kernel's."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.plans.queries import LOG, POINTS, QUERIES, SQL, VISIBLE, query, shown
from lodestore.sources import workload
from lodestore.sources.shared import shared_dir
from lodestore.schema import AlreadyExists
from lodestore.sources.store import Config, Namespace, Selection, Store
from lodestore.streaming import ingest

_OWN_SEQ = "record_id, item_key, value"
VISIBLE_ONLY = SQL["scan_all"].replace("SELECT record_id, item_key, value, seq FROM v", f"SELECT {_OWN_SEQ} FROM v")


def _fresh(spark: SparkSession, **settings) -> tuple[Namespace, str]:
    root = f"{shared_dir(spark)}/store-{uuid.uuid4().hex}"
    return Store(spark, root).create_namespace(Config("events", partitions=workload.PARTITIONS, **settings)), root


def _read(namespace: Namespace) -> DataFrame:
    return shown(namespace.items()).drop("seq")


@query(VISIBLE_ONLY)
def store_append_compact(spark, sf_dir):
    """Three appends, a partial and a full compaction, and a fourth append on top."""
    namespace, _ = _fresh(spark)
    changes = ingest.changes_of(workload.mutation_log(spark, sf_dir))
    step = workload.read(spark, sf_dir, "events").count() // 4 + 1
    for k in range(4):
        if k == 2:
            namespace.compact(full=False)
        if k == 3:
            namespace.compact(full=True)
        namespace.append(changes.where((F.col("ord") > k * step) & (F.col("ord") <= (k + 1) * step)), unique_ord=True, tokens=False)
    return _read(namespace)


@query(VISIBLE_ONLY)
def stream_ingest(spark, sf_dir):
    namespace, root = _fresh(spark)
    changes = ingest.changes_of(workload.mutation_rows(ingest.table_stream(spark, sf_dir, "events")))
    ingest.ingest(changes, namespace, "events", f"{root}-checkpoint", unique_ord=True, tokens=False).awaitTermination()
    return _read(namespace)


@query(f"WITH {LOG} SELECT DISTINCT token FROM log")
def stream_token_dedup(spark, sf_dir):
    """Of repeated tokens one row goes on; the retention spans the table."""
    path = f"{shared_dir(spark)}/dedup-{uuid.uuid4().hex}"
    rows = ingest.table_stream(spark, sf_dir, "events")
    log = workload.mutation_rows(rows).select(F.decode("token", "UTF-8").alias("token"), F.timestamp_millis("created_at_ms").alias("at"))
    once = ingest.first_by_token(log, "at", ["token"], "3650 days").select("token")
    once.writeStream.format("parquet").option("path", path).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema("token string").parquet(path)


@query(SQL["scan_all"])
def stream_live_view(spark, sf_dir):
    """Items kept up to date by a stateful operator."""
    path = f"{shared_dir(spark)}/live-{uuid.uuid4().hex}"
    view = ingest.live_items(workload.mutation_rows(ingest.table_stream(spark, sf_dir, "events")))
    write = lambda df, batch: df.withColumn("batch", F.lit(batch)).write.mode("append").parquet(path)
    view.writeStream.outputMode("update").foreachBatch(write).option("checkpointLocation", f"{path}-checkpoint").trigger(availableNow=True).start().awaitTermination()
    return shown(ingest.latest_view(spark.read.schema(f"{ingest.VIEW}, batch long").parquet(path)))


def _loaded(spark: SparkSession, sf_dir: str, **settings) -> Namespace:
    namespace, _ = _fresh(spark, **settings)
    namespace.append(ingest.changes_of(workload.mutation_log(spark, sf_dir)), unique_ord=True, tokens=False)
    return namespace


_FIRST = VISIBLE.replace(LOG, LOG.replace("log AS (", "every AS (") + ", log AS (SELECT * FROM every QUALIFY row_number() OVER (PARTITION BY token ORDER BY seq) = 1)")


@query(f"WITH {_FIRST} SELECT {_OWN_SEQ} FROM v")
def token_retry_after_compaction(spark, sf_dir):
    """All changes with their tokens, compactions of both kinds, and all changes again: nothing is written twice."""
    namespace, _ = _fresh(spark, l0_commits=1)
    log = workload.mutation_log(spark, sf_dir)
    changes = log.select("record_id", "item_key", "op", "range_end", "value", "metadata", "token", F.col("seq").alias("ord"))
    namespace.append(changes, unique_ord=True)
    namespace.compact(full=False)
    namespace.append(changes, unique_ord=True)
    namespace.compact(full=True)
    namespace.append(changes.withColumn("ord", -F.col("ord")))
    return _read(namespace)


@query(VISIBLE_ONLY)
def vacuum_keeps_pending(spark, sf_dir):
    """A vacuum between a writer's data and its commit; what nobody claims goes."""
    namespace, _ = _fresh(spark)
    changes = ingest.changes_of(workload.mutation_log(spark, sf_dir))
    half = workload.read(spark, sf_dir, "events").count() // 2
    namespace.append(changes.where(F.col("ord") <= half), unique_ord=True, tokens=False)
    namespace.compact()
    commit = namespace._commit

    def late(base, **new):
        namespace._commit = commit
        if not namespace.vacuum(1):
            raise AssertionError("the compacted data should have gone")
        return commit(base, **new)

    namespace._commit = late
    namespace.append(changes.where(F.col("ord") > half), unique_ord=True, tokens=False)
    return _read(namespace)


@query(VISIBLE_ONLY)
def store_levels(spark, sf_dir):
    """Five appends with upkeep after each, under limits so low that data goes through all levels."""
    namespace, _ = _fresh(spark, l0_commits=1, l1_bytes=100_000, l2_bytes=200_000, file_bytes=100_000)
    changes = ingest.changes_of(workload.mutation_log(spark, sf_dir))
    step = workload.read(spark, sf_dir, "events").count() // 5 + 1
    for k in range(5):
        namespace.append(changes.where((F.col("ord") > k * step) & (F.col("ord") <= (k + 1) * step)), unique_ord=True, tokens=False)
        namespace.maintain()
    return _read(namespace)


def _asked(keys) -> str:
    return ", ".join(f"({k}, '{x}')" for k, x in enumerate(keys))


@query(f"WITH {VISIBLE} SELECT CAST(q.pos AS INTEGER) AS pos, v.record_id, v.item_key, v.value FROM v JOIN (VALUES {_asked(POINTS + POINTS[:3])}) AS q(pos, item_key) USING (item_key) WHERE record_id = 'user:000001'")
def store_get_keys(spark, sf_dir):
    """One record's keys as asked, three of them twice."""
    asked = POINTS + POINTS[:3]
    found = _loaded(spark, sf_dir).get_keys("user:000001", [k.encode() for k in asked])
    places = {k: [i for i, x in enumerate(asked) if x == k] for k in asked}
    rows, seen = [], {}
    for r in found:  # in the order asked: the n-th time a key comes is the n-th place it was asked at
        key = bytes(r.item_key).decode()
        n = seen[key] = seen.get(key, -1) + 1
        rows.append((places[key][n], r.record_id, key, bytes(r.value).decode()))
    return spark.createDataFrame(rows, "pos int, record_id string, item_key string, value string")


@query(f"WITH {VISIBLE} SELECT CAST((row_number() OVER (ORDER BY item_key) - 1) // 7 AS INTEGER) AS page, record_id, item_key, value FROM v WHERE record_id = 'user:000001' AND item_key >= 'click:010' AND item_key < 'view:080'")
def store_get_range_pages(spark, sf_dir):
    """Pages of seven items, each asked for with the token of the one before."""
    namespace, rows, token, page = _loaded(spark, sf_dir), [], None, 0
    while page == 0 or token:
        got = namespace.get_range("user:000001", b"click:010", b"view:080", True, False, Selection(item_limit=7, page_token=token))
        rows += [(page, r.record_id, bytes(r.item_key).decode(), bytes(r.value).decode()) for r in got.items]
        token, page = got.next_token, page + 1
    return spark.createDataFrame(rows, "page int, record_id string, item_key string, value string")


_SCANNED = f"""
WITH RECURSIVE {VISIBLE},
p AS (SELECT *, octet_length(encode(record_id)) + 1 + octet_length(encode(item_key)) + octet_length(encode(value)) AS n, row_number() OVER (ORDER BY item_key) AS i FROM v WHERE record_id = 'user:000001' AND item_key >= 'click:'),
f AS (
  SELECT item_key, i, n AS filled, 0 AS batch FROM p WHERE i = 1
  UNION ALL
  SELECT p.item_key, p.i, CASE WHEN f.filled >= 300 THEN p.n ELSE f.filled + p.n END, CASE WHEN f.filled >= 300 THEN f.batch + 1 ELSE f.batch END FROM f JOIN p ON p.i = f.i + 1)
SELECT CAST(batch AS INTEGER) AS batch, item_key FROM f"""


@query(_SCANNED)
def store_scan(spark, sf_dir):
    """Batches of at least 300 bytes of one record's items."""
    namespace = _loaded(spark, sf_dir, default_page_bytes=300)
    rows = [(k, bytes(r.item_key).decode()) for k, batch in enumerate(namespace.scan("user:000001", b"click:", None, True)) for r in batch]
    return spark.createDataFrame(rows, "batch int, item_key string")


@query("SELECT 'region:' || CAST(r_regionkey AS VARCHAR) AS record_id, r_name AS value, true AS refused FROM region")
def store_strict_tokens(spark, sf_dir):
    """Each region is put with a token, compacted, and put again with it: refused, and the first value stays."""
    namespace, rows = _fresh(spark)[0], []
    regions = workload.read(spark, sf_dir, "region").select("r_regionkey", "r_name").collect()  # a dimension of a few rows
    put = lambda r, value: namespace.put(f"region:{r.r_regionkey}", [(b"name", value)], b"token-%010d" % r.r_regionkey, strict=True)
    for r in regions:
        put(r, r.r_name.encode())
    namespace.compact()
    for r in regions:
        try:
            put(r, b"changed")
            refused = False
        except AlreadyExists:
            refused = True
        (item,) = namespace.get_keys(f"region:{r.r_regionkey}", [b"name"])
        rows.append((item.record_id, bytes(item.value).decode(), refused))
    return spark.createDataFrame(rows, "record_id string, value string, refused boolean")


__all__ = ["QUERIES", "SQL"]
