"""The store's queries over the test tables, each with the SQL that an independent engine should agree with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.functions import keys, routing
from lodestore.operators import dedup, kernel, maintenance, paging, predicates, values
from lodestore.sources import workload

BUDGET = 120
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

#: The mutation log and what follows from it, in SQL.
LOG = """
k AS (SELECT *, lpad(regexp_extract(props, '"k": *([0-9]+)', 1), 3, '0') AS k FROM events),
log AS (
  SELECT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS record_id,
    CASE event_type WHEN 'error' THEN 'DELETE' WHEN 'signup' THEN 'RANGE_DELETE' ELSE 'PUT' END AS op,
    CASE event_type WHEN 'error' THEN 'click:' || k WHEN 'signup' THEN 'view:' || k ELSE event_type || ':' || k END AS item_key,
    CASE event_type WHEN 'signup' THEN 'view:' || lpad(CAST(CAST(k AS INTEGER) + 20 AS VARCHAR), 3, '0') END AS range_end,
    CASE WHEN event_type IN ('error', 'signup') THEN '' ELSE props END AS value,
    CAST(user_id AS VARCHAR) || ':' || k AS token, CAST(event_id + 1 AS BIGINT) AS seq, epoch_us(ts) // 1000 AS created_at_ms
  FROM k)"""
WINNERS = LOG + """,
w AS (SELECT * FROM log WHERE op <> 'RANGE_DELETE' QUALIFY row_number() OVER (PARTITION BY record_id, item_key ORDER BY seq DESC) = 1)"""
VISIBLE = WINNERS + """,
t AS (SELECT * FROM log WHERE op = 'RANGE_DELETE'),
u AS (SELECT * FROM w WHERE NOT EXISTS (
  SELECT 1 FROM t WHERE t.record_id = w.record_id AND t.item_key <= w.item_key AND (t.range_end IS NULL OR w.item_key < t.range_end) AND t.seq > w.seq)),
v AS (SELECT record_id, item_key, value, seq FROM u WHERE op = 'PUT')"""
PAGED = VISIBLE + f""",
b AS (SELECT *, octet_length(encode(record_id)) + 1 + octet_length(encode(item_key)) + octet_length(encode(value)) AS n FROM v),
p AS (SELECT *, sum(n) OVER (PARTITION BY record_id ORDER BY item_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before,
  row_number() OVER (PARTITION BY record_id ORDER BY item_key) AS i FROM b),
page1 AS (SELECT * FROM p WHERE before IS NULL OR before < {BUDGET})"""


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def text(name: str) -> Column:
    return F.decode(name, "UTF-8").alias(name)


def shown(df: DataFrame, *more) -> DataFrame:
    return df.select("record_id", text("item_key"), text("value"), "seq", *more)


def visible(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kernel.visible_items(workload.mutation_log(spark, sf_dir))


# --- latest wins, tombstones -------------------------------------------------------------------


@query(f"WITH {WINNERS} SELECT record_id, item_key, op, value, seq FROM w")
def latest_per_key(spark, sf_dir):
    w = kernel.latest_per_key(workload.mutation_log(spark, sf_dir))
    return w.select("record_id", text("item_key"), "op", text("value"), "seq")


@query(f"WITH {LOG} SELECT record_id, item_key, value, seq FROM log WHERE op = 'PUT' QUALIFY row_number() OVER (PARTITION BY record_id, item_key ORDER BY seq DESC) = 1")
def put_latest_wins(spark, sf_dir):
    """Puts alone: the last of a key stays."""
    log = workload.mutation_log(spark, sf_dir).where("op = 'PUT'")
    return shown(kernel.latest_per_key(log))


@query(f"WITH {WINNERS} SELECT record_id, item_key, value, seq FROM w WHERE op = 'PUT'")
def point_tombstone(spark, sf_dir):
    return shown(kernel.live_puts(kernel.latest_per_key(workload.mutation_log(spark, sf_dir))))


@query(f"WITH {VISIBLE} SELECT record_id, item_key, op, seq FROM u")
def range_tombstone(spark, sf_dir):
    """Winners, deletes among them, that no range delete covers."""
    log = workload.mutation_log(spark, sf_dir)
    u = kernel.apply_range_tombstones(kernel.latest_per_key(log), kernel.range_tombstones(log))
    return u.select("record_id", text("item_key"), "op", "seq")


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v")
def scan_all(spark, sf_dir):
    return shown(visible(spark, sf_dir))


def _with(log: DataFrame, record: str, op: str, start: str, end: str | None = None) -> DataFrame:
    """``log`` and one more change of ``record`` after all others."""
    extra = log.sparkSession.range(1).select(
        F.lit("events").alias("namespace"), routing.simple(F.lit(record), workload.PARTITIONS).alias("partition_id"), F.lit(record).alias("record_id"), F.lit(start).cast("binary").alias("item_key"), F.lit(op).alias("op"),
        F.lit(end).cast("binary").alias("range_end"), F.lit("").cast("binary").alias("value"), F.lit(b"").alias("metadata"), F.lit(None).cast("binary").alias("token"), F.lit(1 << 40).cast("long").alias("seq"), F.lit(0).cast("long").alias("created_at_ms"),
    )
    return kernel.merge(log, extra)


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE NOT (record_id = 'user:000001' AND item_key >= 'purchase:000' AND item_key < 'purchase:050')")
def delete_range(spark, sf_dir):
    log = _with(workload.mutation_log(spark, sf_dir), "user:000001", "RANGE_DELETE", "purchase:000", "purchase:050")
    return shown(kernel.visible_items(log))


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE record_id <> 'user:000001'")
def delete_all(spark, sf_dir):
    log = _with(workload.mutation_log(spark, sf_dir), "user:000001", "RANGE_DELETE", "")
    return shown(kernel.visible_items(log))


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE NOT (record_id = 'user:000001' AND item_key IN ('click:001', 'view:002', 'none:000'))")
def delete_keys(spark, sf_dir):
    """One tombstone a key; a key that is not there does no harm."""
    log = workload.mutation_log(spark, sf_dir)
    for key in ("click:001", "view:002", "none:000"):
        log = _with(log, "user:000001", "DELETE", key)
    return shown(kernel.visible_items(log))


# --- predicates --------------------------------------------------------------------------------


@query(f"WITH {VISIBLE} SELECT CAST(q.pos AS INTEGER) AS pos, v.record_id, v.item_key, v.value FROM v JOIN (VALUES (0, 'view:005'), (1, 'click:001'), (2, 'none:000'), (3, 'view:005'), (4, 'purchase:010')) AS q(pos, item_key) ON q.item_key = v.item_key")
def get_match_keys(spark, sf_dir):
    """The same five keys of every record, one twice, one never there."""
    items = visible(spark, sf_dir)
    asked = F.array(*[F.lit(k).cast("binary") for k in ("view:005", "click:001", "none:000", "view:005", "purchase:010")])
    wanted = workload.mutation_log(spark, sf_dir).select("record_id").distinct().select("record_id", asked.alias("keys"))
    return predicates.match_keys(items, wanted).select("pos", "record_id", text("item_key"), text("value"))


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE item_key >= 'click:010' AND item_key < 'purchase:030'")
def get_match_range(spark, sf_dir):
    return shown(predicates.match_range(visible(spark, sf_dir), b"click:010", b"purchase:030", start_inclusive=True))


@query(
    f"WITH {VISIBLE} "
    + " UNION ALL ".join(f"SELECT '{name}' AS bounds, record_id, item_key FROM v WHERE item_key {a} 'view:010' AND item_key {b} 'view:030'" for name, a, b in (("[]", ">=", "<="), ("[)", ">=", "<"), ("(]", ">", "<="), ("()", ">", "<")))
)
def range_incl_excl(spark, sf_dir):
    items = visible(spark, sf_dir)
    out = [predicates.match_range(items, b"view:010", b"view:030", a, b).select(F.lit(name).alias("bounds"), "record_id", text("item_key")) for name, a, b in (("[]", True, True), ("[)", True, False), ("(]", False, True), ("()", False, False))]
    return kernel.merge(*out)


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE record_id = 'user:000001'")
def get_match_all(spark, sf_dir):
    log = workload.mutation_log(spark, sf_dir).where("record_id = 'user:000001'")
    return shown(predicates.match_all(kernel.visible_items(log)))


#: Of one record: keys that are there, deleted, covered by a range delete, and never written.
POINTS = ("click:003", "click:004", "click:007", "click:024", "click:031", "purchase:094", "view:035", "view:099", "none:000")


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE record_id = 'user:000001' AND item_key IN {POINTS}")
def point_read(spark, sf_dir):
    """Each key by a read of its own."""
    log = workload.mutation_log(spark, sf_dir)
    return shown(kernel.merge(*[kernel.point_read(log, "user:000001", k.encode()) for k in POINTS]))


@query(f"WITH {VISIBLE} SELECT record_id, item_key, value, seq FROM v WHERE item_key >= 'view:' AND item_key < 'view:' || chr(255)")
def scan_prefix(spark, sf_dir):
    return shown(predicates.match_prefix(visible(spark, sf_dir), b"view:"))


@query(f"WITH {VISIBLE}, c AS (SELECT record_id, item_key, value, 0 AS chunk FROM v) SELECT record_id, item_key, value, CAST(chunk AS INTEGER) AS chunk, '' AS metadata FROM c")
def item_projection(spark, sf_dir):
    return visible(spark, sf_dir).select("record_id", text("item_key"), text("value"), "chunk", text("metadata"))


# --- paging ------------------------------------------------------------------------------------


@query(f"WITH {PAGED} SELECT record_id, item_key, value, seq FROM page1")
def page_first(spark, sf_dir):
    return shown(paging.first_page(visible(spark, sf_dir), BUDGET))


@query(f"WITH {PAGED}, l AS (SELECT record_id, max(item_key) AS k FROM page1 GROUP BY record_id), r AS (SELECT b.* FROM b JOIN l USING (record_id) WHERE item_key > k), q AS (SELECT *, sum(n) OVER (PARTITION BY record_id ORDER BY item_key ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM r) SELECT record_id, item_key, value, seq FROM q WHERE before IS NULL OR before < {BUDGET}")
def page_resume(spark, sf_dir):
    """The second page of every record."""
    items = visible(spark, sf_dir)
    last = paging.first_page(items, BUDGET).groupBy("record_id").agg(F.max("item_key").alias("last_key"))
    return shown(paging.resume(items, last, BUDGET))


@query(f"WITH {PAGED} SELECT record_id, item_key, value, seq FROM p WHERE i <= 5")
def item_limit(spark, sf_dir):
    return shown(paging.first_page(visible(spark, sf_dir), limit=5))


@query(f"WITH {PAGED} SELECT record_id, item_key, '' AS value, seq FROM page1")
def exclude_values(spark, sf_dir):
    return shown(paging.exclude_values(paging.first_page(visible(spark, sf_dir), BUDGET)))


_FOLD = """
WITH RECURSIVE {base},
f AS (
  SELECT record_id, item_key, i, n AS filled, 0 AS page FROM p WHERE i = 1
  UNION ALL
  SELECT p.record_id, p.item_key, p.i, CASE WHEN f.filled >= {budget} THEN p.n ELSE f.filled + p.n END, CASE WHEN f.filled >= {budget} THEN f.page + 1 ELSE f.page END
  FROM f JOIN p ON p.record_id = f.record_id AND p.i = f.i + 1)
SELECT record_id, item_key, CAST(page AS INTEGER) AS page FROM f"""


@query(_FOLD.format(base=PAGED, budget=BUDGET))
def page_numbers(spark, sf_dir):
    return paging.page_numbers(visible(spark, sf_dir), BUDGET).select("record_id", text("item_key"), "page")


_ITEMS = """
o AS (SELECT 'order:' || lpad(CAST(l_orderkey AS VARCHAR), 10, '0') AS record_id, 'line:' || lpad(CAST(l_linenumber AS VARCHAR), 2, '0') || ':' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS item_key,
  max(concat_ws('|', l_returnflag, l_linestatus)) AS value FROM lineitem GROUP BY 1, 2)"""


@query(f"WITH {_ITEMS} SELECT record_id, item_key, value FROM o QUALIFY row_number() OVER (PARTITION BY record_id ORDER BY item_key) <= 3")
def order_lines_page(spark, sf_dir):
    """Sorted events: the first three lines of every order."""
    return paging.first_page(workload.order_items(spark, sf_dir), limit=3).select("record_id", text("item_key"), text("value"))


@query("SELECT 'region:' || CAST(n_regionkey AS VARCHAR) AS record_id, 'nation:' || lpad(CAST(n_nationkey AS VARCHAR), 3, '0') AS item_key, n_name AS value FROM nation")
def adjacency_scan(spark, sf_dir):
    return workload.adjacency_items(spark, sf_dir).select("record_id", text("item_key"), text("value"))


@query("SELECT 'customer:' || CAST(c_custkey AS VARCHAR) AS record_id, '' AS item_key, c_name AS value FROM customer")
def simple_kv_scan(spark, sf_dir):
    """Simple key-value: an empty item key is a key like any other."""
    return predicates.match_range(workload.customer_items(spark, sf_dir)).select("record_id", text("item_key"), text("value"))


@query("WITH i AS (SELECT 'doc:' || lpad(CAST(doc_id AS VARCHAR), 10, '0') AS record_id, unnest(['lang', 'text']) AS item_key, unnest([lang, text]) AS value FROM documents), b AS (SELECT *, octet_length(encode(record_id)) + 1 + octet_length(encode(item_key)) + coalesce(octet_length(encode(value)), 0) AS n FROM i) SELECT record_id, count(*) AS n_items, CAST(sum(n) AS BIGINT) AS n_bytes FROM b GROUP BY record_id")
def document_bytes(spark, sf_dir):
    """Bytes, not characters, count for a budget."""
    d = workload.document_items(spark, sf_dir)
    return d.groupBy("record_id").agg(F.count("*").alias("n_items"), F.sum(paging.item_bytes().cast("long")).alias("n_bytes"))


@query("SELECT 'conv:' || CAST(conv_id AS VARCHAR) AS record_id, 'turn:' || lpad(CAST(turn AS VARCHAR), 6, '0') AS item_key, text AS value FROM conversations WHERE turn BETWEEN 1 AND 3")
def turns_range(spark, sf_dir):
    items = workload.turn_items(spark, sf_dir)
    return predicates.match_range(items, b"turn:000001", b"turn:000003", True, True).select("record_id", text("item_key"), text("value"))


# --- idempotency -------------------------------------------------------------------------------


@query(f"WITH {LOG} SELECT record_id, item_key, op, token, seq FROM log QUALIFY row_number() OVER (PARTITION BY token ORDER BY seq) = 1")
def idempotent_first_write(spark, sf_dir):
    """Tokens are the user's, and a user is in one partition."""
    return dedup.first_write_wins(workload.mutation_log(spark, sf_dir)).select("record_id", text("item_key"), "op", text("token"), "seq")


_LITTLE = " || ".join(f"lpad(hex((x >> {8 * k}) & 255), 2, '0')" for k in range(8))


@query(f"SELECT event_id, lower(lpad(hex(event_id), 16, '0') || {_LITTLE} || '000000000000000A') AS token FROM (SELECT event_id, xor(user_id, event_id % 7) AS x FROM events)")
def token_derivation(spark, sf_dir):
    """The index goes into bytes 8 to 11, its lowest byte first; so does the user's id, of eight bytes."""
    e = workload.read(spark, sf_dir, "events")
    user = F.lpad(F.hex(F.col("user_id")), 16, "0")
    nonce = F.unhex(F.concat(*[F.substring(user, 15 - 2 * k, 2) for k in range(8)], F.lit("000000000000000A")))
    made = keys.derived_token(keys.token_bytes(F.col("event_id"), nonce), F.pmod("event_id", F.lit(7)))
    return e.select("event_id", F.lower(F.hex(made)).alias("token"))


@query("SELECT event_id, abs(epoch_us(ts) // 1000 - 1704067200000) <= 5000000000 AS ok FROM events")
def token_drift(spark, sf_dir):
    log = workload.mutation_log(spark, sf_dir)
    return log.select((F.col("seq") - 1).alias("event_id"), keys.within_drift(F.col("created_at_ms"), F.lit(1704067200000), 5000000000).alias("ok"))


# --- routing -----------------------------------------------------------------------------------


def _crc(expr: str) -> str:
    """CRC-32 of the bytes of a hex string, bit by bit."""
    byte = f"list_transform(range(0, length({expr}) // 2), lambda i: CAST(('0x' || substr({expr}, 2 * i + 1, 2)) AS BIGINT))"
    eight = "list_reduce(list_prepend(xor(a, x), [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)"
    return f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {byte}), lambda a, x: {eight}), 4294967295)"


_USERS = "u AS (SELECT DISTINCT 'user:' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS record_id FROM events), h AS (SELECT record_id, hex(encode({part})) AS h FROM u)"


def _users(spark, sf_dir) -> DataFrame:
    return workload.read(spark, sf_dir, "events").select("user_id").distinct().select(F.concat(F.lit("user:"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("record_id"))


@query(f"WITH {_USERS.format(part='record_id')} SELECT record_id, CAST({_crc('h')} & 15 AS INTEGER) AS partition_id FROM h")
def route_crc32(spark, sf_dir):
    return _users(spark, sf_dir).select("record_id", routing.simple(F.col("record_id"), 16).alias("partition_id"))


@query(f"WITH {_USERS.format(part='substr(record_id, 1, 9)')} SELECT record_id, CAST({_crc('h')} & 15 AS INTEGER) AS partition_id FROM h")
def route_prefix(spark, sf_dir):
    return _users(spark, sf_dir).select("record_id", routing.prefix(F.col("record_id"), 16, 9).alias("partition_id"))


@query(f"WITH u AS (SELECT DISTINCT 'tenant' || CAST(user_id % 5 AS VARCHAR) || ':region' || CAST(user_id % 3 AS VARCHAR) || ':id' || CAST(user_id AS VARCHAR) AS record_id FROM events), h AS (SELECT record_id, hex(encode(split_part(record_id, ':', 1) || ':' || split_part(record_id, ':', 2))) AS h FROM u) SELECT record_id, CAST({_crc('h')} & 15 AS INTEGER) AS partition_id FROM h")
def route_composite(spark, sf_dir):
    u = workload.read(spark, sf_dir, "events").select("user_id").distinct()
    record = F.concat(F.lit("tenant"), (F.col("user_id") % 5).cast("string"), F.lit(":region"), (F.col("user_id") % 3).cast("string"), F.lit(":id"), F.col("user_id").cast("string"))
    return u.select(record.alias("record_id")).select("record_id", routing.composite(F.col("record_id"), 16, ":", [0, 1]).alias("partition_id"))


@query(
    "WITH " + _USERS.format(part="record_id") + ", x AS (SELECT record_id, list_append(list_transform(range(0, length(h) // 2), lambda i: CAST(('0x' || substr(h, 2 * i + 1, 2)) AS BIGINT)), 255) AS bytes FROM h) "
    "SELECT record_id, CAST(list_reduce(list_prepend(CAST(2216829733 AS BIGINT), bytes), lambda a, b: (xor(a, b) * 435) % 4294967296) & 15 AS INTEGER) AS partition_id FROM x"
)
def route_fnv(spark, sf_dir):
    return _users(spark, sf_dir).select("record_id", routing.fnv(F.col("record_id"), 16).alias("partition_id"))


@query(f"WITH {VISIBLE}, h AS (SELECT record_id, hex(encode(record_id)) AS h, count(*) AS n FROM v GROUP BY record_id), r AS (SELECT CAST({_crc('h')} & 15 AS INTEGER) AS partition_id, n FROM h) SELECT partition_id, count(*) AS n_records, CAST(sum(n) AS BIGINT) AS n_items FROM r GROUP BY partition_id")
def partition_histogram(spark, sf_dir):
    return routing.partition_histogram(visible(spark, sf_dir), 16)


# --- keys, versions, sizes ---------------------------------------------------------------------


@query(f"WITH {LOG} SELECT seq, created_at_ms, CAST(row_number() OVER (PARTITION BY record_id, created_at_ms ORDER BY seq) - 1 AS INTEGER) AS version_sequence FROM log")
def version_order(spark, sf_dir):
    """Versions number the writes of a millisecond; here each record is a node of its own."""
    log = workload.mutation_log(spark, sf_dir).withColumn("namespace", F.col("record_id"))
    return dedup.versions(log).select("seq", "created_at_ms", "version_sequence")


@query("SELECT event_id, lower(lpad(hex(event_id), 16, '0') || lpad(hex(user_id % 65536), 4, '0') || lpad(hex(event_id % 65536), 4, '0')) AS key, event_id AS timestamp_ms, CAST(user_id % 65536 AS INTEGER) AS node_id, CAST(event_id % 65536 AS INTEGER) AS sequence FROM events")
def ordered_key_bytes(spark, sf_dir):
    e = workload.read(spark, sf_dir, "events")
    key = keys.ordered_key(F.col("event_id"), F.col("user_id") % 65536, F.col("event_id") % 65536)
    return e.select("event_id", key.alias("k")).select("event_id", F.lower(F.hex("k")).alias("key"), keys.split_ordered_key(F.col("k")).alias("s")).select("event_id", "key", "s.*")


@query(f"WITH {LOG} SELECT seq, lower(hex(encode(record_id)) || '00' || hex(encode(item_key))) AS composite, record_id, item_key FROM log")
def composite_key_roundtrip(spark, sf_dir):
    log = workload.mutation_log(spark, sf_dir).select("seq", keys.composite_key(F.col("record_id"), F.col("item_key")).alias("c"))
    record, item = keys.split_composite_key(F.col("c"))
    return log.select("seq", F.lower(F.hex("c")).alias("composite"), record.alias("record_id"), F.decode(item, "UTF-8").alias("item_key"))


@query("SELECT p_partkey, CAST(ceil(-ln(fp) / pow(ln(2), 2)) AS BIGINT) AS bits, round(pow(1 - exp(-7.0 * p_size / (10.0 * p_size)), 7.0), 6) AS rate FROM (SELECT p_partkey, p_size, 1.0 / (p_size + 1.5) AS fp FROM part)")
def bloom_sizing(spark, sf_dir):
    p = workload.read(spark, sf_dir, "part")
    bits = keys.bits_per_key(F.lit(1.0) / (F.col("p_size") + F.lit(1.5)))
    rate = keys.false_positive_rate(F.lit(7.0), F.col("p_size"), F.lit(10.0) * F.col("p_size"))
    return p.select("p_partkey", bits.alias("bits"), F.round(rate, 6).alias("rate"))


@query(f"WITH {PAGED} SELECT record_id, count(*) AS n, CAST(sum(n) AS BIGINT) AS total, CAST(sum(n) // count(*) AS BIGINT) AS average, CAST(CASE WHEN sum(n) // count(*) > 0 THEN greatest(1, {BUDGET} // (sum(n) // count(*))) ELSE 1024 END AS BIGINT) AS items_per_page FROM b GROUP BY record_id")
def avg_item_size(spark, sf_dir):
    return paging.average_item_bytes(visible(spark, sf_dir), BUDGET).drop("namespace")


# --- files and maintenance ---------------------------------------------------------------------

FILES = LOG + """,
e AS (SELECT *, created_at_ms // 86400000 AS day, octet_length(encode(record_id)) + 1 + octet_length(encode(item_key)) + octet_length(encode(value)) AS n, record_id || chr(1) || item_key AS ck FROM log),
s AS (SELECT day, count(*) AS entry_count, CAST(sum(n) AS BIGINT) AS size_bytes, count(DISTINCT record_id) AS record_id_count, min(seq) AS seq_min, max(seq) AS seq_max, min(ck) AS min_key, max(ck) AS max_key,
  count(*) FILTER (op = 'PUT') AS puts, count(*) FILTER (op = 'DELETE') AS deletes, count(*) FILTER (op = 'RANGE_DELETE') AS range_deletes FROM e GROUP BY day)"""


def _day(log: DataFrame) -> DataFrame:
    return log.withColumn("day", F.expr("created_at_ms div 86400000"))


def _key(name: str) -> Column:
    """A composite key as text, its zero byte shown as chr(1)."""
    return F.translate(F.decode(name, "UTF-8"), "\0", "\1").alias(name)


@query(f"WITH {FILES} SELECT * FROM s")
def flush_stats(spark, sf_dir):
    """A day's log is a file."""
    s = maintenance.file_stats(_day(workload.mutation_log(spark, sf_dir)), ["day"])
    return s.withColumns({"min_key": _key("min_key"), "max_key": _key("max_key")})


_META = FILES + """,
m AS (SELECT CAST(day AS VARCHAR) AS id, CASE WHEN day % 7 = 0 THEN 0 ELSE day % 3 + 1 END AS level, size_bytes, entry_count, min_key, max_key, seq_min, seq_max, day * 86400000 AS created_at_ms FROM s)"""


def _meta(spark, sf_dir) -> DataFrame:
    s = maintenance.file_stats(_day(workload.mutation_log(spark, sf_dir)), ["day"])
    level = F.when(F.pmod("day", F.lit(7)) == 0, 0).otherwise(F.pmod("day", F.lit(3)) + 1).cast("int")
    return s.select(F.col("day").cast("string").alias("id"), level.alias("level"), "size_bytes", "entry_count", "min_key", "max_key", "seq_min", "seq_max", (F.col("day") * 86400000).alias("created_at_ms"))


@query(f"WITH {_META} SELECT CAST(level AS INTEGER) AS level, count(*) AS files, CAST(sum(size_bytes) AS BIGINT) AS size_bytes, min(min_key) AS min_key, max(max_key) AS max_key FROM m GROUP BY level")
def level_sizes(spark, sf_dir):
    return maintenance.level_sizes(_meta(spark, sf_dir)).withColumns({"min_key": _key("min_key"), "max_key": _key("max_key")})


@query(
    f"""WITH {_META},
due AS (
  SELECT level FROM m GROUP BY level HAVING (level = 0 AND count(*) > 2) OR (level = 1 AND sum(size_bytes) > 1000) OR (level = 2 AND sum(size_bytes) > 2000)),
src AS (SELECT * FROM m WHERE level IN (SELECT level FROM due) QUALIFY level = 0 OR row_number() OVER (PARTITION BY level ORDER BY created_at_ms, id) = 1),
r AS (SELECT level, min(min_key) AS low, max(max_key) AS high FROM src GROUP BY level)
SELECT CAST(level AS INTEGER) AS level, id, 'source' AS role FROM src
UNION ALL
SELECT CAST(m.level - 1 AS INTEGER), m.id, 'target' FROM m JOIN r ON m.level = r.level + 1 AND m.min_key <= r.high AND m.max_key >= r.low"""
)
def compaction_candidates(spark, sf_dir):
    return maintenance.compaction_inputs(_meta(spark, sf_dir), l0_files=2, l1_bytes=1000, l2_bytes=2000)


@query("SELECT p_size AS l0_files, count(*) AS n, min(CASE WHEN p_size >= 12 THEN 'reject' WHEN p_size > 8 THEN 'slow' ELSE 'none' END) AS status, CAST(min(CASE WHEN p_size > 8 AND p_size < 12 THEN p_size - 8 ELSE 0 END) AS INTEGER) AS wait_ms FROM part GROUP BY p_size")
def write_stall_status(spark, sf_dir):
    n = workload.read(spark, sf_dir, "part").groupBy(F.col("p_size").alias("l0_files")).agg(F.count("*").alias("n"))
    return n.select("l0_files", "n", maintenance.stall(F.col("l0_files")).alias("status"), maintenance.stall_ms(F.col("l0_files")).alias("wait_ms"))


@query(f"WITH {LOG.replace('FROM k)', 'FROM k WHERE event_id < (SELECT count(*) // 2 FROM events))')}" + VISIBLE[len(LOG) :] + " SELECT record_id, item_key, value, seq FROM v")
def as_of_seq(spark, sf_dir):
    """The store as it stood after half of the log."""
    half = workload.read(spark, sf_dir, "events").count() // 2
    return shown(kernel.visible_items(kernel.as_of(workload.mutation_log(spark, sf_dir), half)))


@query(SQL["scan_all"])
def compact_equals_latest(spark, sf_dir):
    """The first half compacted in part, the rest on top: reads must not change."""
    log = workload.mutation_log(spark, sf_dir)
    half = workload.read(spark, sf_dir, "events").count() // 2
    old = kernel.compact(kernel.as_of(log, half), full=False)
    return shown(kernel.visible_items(kernel.merge(old, log.where(F.col("seq") > half))))


@query(f"WITH {VISIBLE} SELECT split_part(item_key, ':', 1) AS prefix, count(*) AS n, count(DISTINCT record_id) AS records FROM v GROUP BY 1")
def prefix_rollup(spark, sf_dir):
    """An extension: items by key prefix, over all records. Counted by record first, so that no distinct set is kept."""
    by = visible(spark, sf_dir).groupBy(F.split_part(F.decode("item_key", "UTF-8"), F.lit(":"), F.lit(1)).alias("prefix"), "record_id").agg(F.count("*").alias("n"))
    return by.groupBy("prefix").agg(F.sum("n").alias("n"), F.count("*").alias("records"))


# --- smaller functions -------------------------------------------------------------------------

_SIZES = "f AS (SELECT p_partkey AS id, CAST(p_size AS BIGINT) * 2097152 AS size_bytes, CAST(p_partkey % 400 AS INTEGER) AS age, CAST(p_partkey % 5 AS INTEGER) AS frozen FROM part)"


@query(f"WITH {_SIZES} SELECT id, (size_bytes >= 67108864 OR age >= 300) AND frozen < 3 AS freeze, CAST(greatest(1, ceil(size_bytes / 67108864)) AS INTEGER) AS fragments, frozen >= 3 AS drops_tombstones FROM f")
def flush_decisions(spark, sf_dir):
    """When a memory table closes, how many files a compaction writes, and whether it may drop deletes."""
    f = workload.read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), (F.col("p_size").cast("long") * 2097152).alias("size_bytes"), (F.col("p_partkey") % 400).cast("int").alias("age"), (F.col("p_partkey") % 5).cast("int").alias("frozen"))
    return f.select("id", maintenance.freeze_due(F.col("size_bytes"), F.col("age"), F.col("frozen")).alias("freeze"), maintenance.fragments(F.col("size_bytes")).alias("fragments"), maintenance.drops_tombstones(F.col("frozen")).alias("drops_tombstones"))


@query(f"WITH {_META}, o AS (SELECT level, min(created_at_ms) AS created_at_ms FROM m GROUP BY level) SELECT CAST(o.level AS INTEGER) AS level, min(m.id) AS id, o.created_at_ms FROM o JOIN m ON m.level = o.level AND m.created_at_ms = o.created_at_ms GROUP BY o.level, o.created_at_ms")
def oldest_file(spark, sf_dir):
    return maintenance.oldest_file(_meta(spark, sf_dir))


@query(f"WITH {_META} SELECT id, CAST(level AS INTEGER) AS level, entry_count FROM m WHERE level <> 0 UNION ALL SELECT 'merged', 1, CAST(sum(entry_count) AS BIGINT) FROM m WHERE level = 0 HAVING count(*) > 0")
def manifest_apply(spark, sf_dir):
    """Level 0 goes, one merged file comes."""
    files = _meta(spark, sf_dir).select("id", "level", "entry_count")
    gone = files.where("level = 0")
    added = gone.agg(F.sum("entry_count").alias("entry_count")).where("entry_count IS NOT NULL").select(F.lit("merged").alias("id"), F.lit(1).alias("level"), "entry_count")
    return maintenance.apply_manifest(files, gone, added)


@query(f"WITH {_META} SELECT id FROM m QUALIFY row_number() OVER (ORDER BY id DESC) > 10")
def prunable_snapshots(spark, sf_dir):
    return maintenance.prunable(_meta(spark, sf_dir).select("id"), 10)


@query("SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, max(value) AS max, count(*) AS n FROM events GROUP BY event_type")
def latency_quantiles(spark, sf_dir):
    return maintenance.latency_quantiles(workload.read(spark, sf_dir, "events"), "event_type", "value")


@query(f"WITH {VISIBLE} SELECT record_id, item_key, CAST(regexp_extract(value, '\"k\": *([0-9]+)', 1) AS INTEGER) AS k FROM v")
def typed_values(spark, sf_dir):
    return values.typed_values(visible(spark, sf_dir), "k int").select("record_id", text("item_key"), F.col("parsed.k").alias("k"))


@query(f"WITH {LOG} SELECT record_id, CAST(sum(CAST(regexp_extract(value, '\"k\": *([0-9]+)', 1) AS INTEGER)) AS BIGINT) AS total FROM log WHERE op = 'PUT' GROUP BY record_id")
def counters(spark, sf_dir):
    return values.increments(workload.mutation_log(spark, sf_dir), "k").select("record_id", "total")
