"""The store's requests, snapshots, upkeep and streams."""

import pytest
from pyspark.sql import functions as F

from lodestore.functions.keys import PageToken, VersionClock
from lodestore.schema import AlreadyExists, Conflict, InvalidArgument, NotFound, Unavailable
from lodestore.sources import workload
from lodestore.sources.store import DRAINING, FROZEN, Config, Selection, Store
from lodestore.streaming import ingest


@pytest.fixture()
def store(spark, tmp_path):
    return Store(spark, str(tmp_path / "store"))


@pytest.fixture()
def ns(store):
    return store.create_namespace(Config("n", partitions=2))


def keys(items):
    return [bytes(r.item_key) for r in items]


def test_put_get_delete(ns):
    v1 = ns.put("rec1", [(b"key1", b"v1"), (b"key1", b"v2"), (b"key2", b"v3", b"meta")])
    page = ns.get_all("rec1")
    assert [(bytes(r.item_key), bytes(r.value), bytes(r.metadata), r.chunk) for r in page.items] == [(b"key1", b"v2", b"", 0), (b"key2", b"v3", b"meta", 0)]
    assert page.next_token is None
    assert [bytes(r.value) for r in ns.get_keys("rec1", [b"key2", b"none", b"key1", b"key2"])] == [b"v3", b"v2", b"v3"]
    assert [bytes(r.value) for r in ns.get_keys("rec1", [b"key2"], exclude_values=True)] == [b""]
    v2 = ns.delete_keys("rec1", [b"key1", b"none"])
    assert keys(ns.get_all("rec1").items) == [b"key2"] and v2 > v1
    ns.delete_all("rec1")
    assert ns.get_all("rec1").items == [] and ns.get_all("other").items == []
    ns.put("rec1", [(b"key9", b"")])
    assert [(bytes(r.item_key), bytes(r.value)) for r in ns.get_all("rec1").items] == [(b"key9", b"")]


def test_deleted_ranges_stay_deleted_through_upkeep(ns):
    ns.put("r", [(b"k-%03d" % i, b"v") for i in range(5)] + [(b"\xffx", b"ff")])
    ns.delete_range("r", b"k-001", b"k-003", True, False)
    want = [b"k-000", b"k-003", b"k-004", b"\xffx"]
    assert keys(ns.get_all("r").items) == want
    ns.compact(full=False)
    assert keys(ns.get_all("r").items) == want
    ns.compact(full=True)
    assert keys(ns.get_all("r").items) == want
    assert [p["level"] for p in ns.snapshot()["parts"]] == [3]
    assert keys(Store(ns.spark, ns.store.files.root).namespace("n").get_all("r").items) == want


def test_tokens(ns):
    token = b"0123456789abcdef"
    ns.put("r", [(b"k1", b"first"), (b"k2", b"x")], token)
    ns.put("r", [(b"k1", b"second")], token)
    assert bytes(ns.get_keys("r", [b"k1"])[0].value) == b"first"
    ns.put("r", [(b"k1", b"third")], b"fedcba9876543210")
    assert bytes(ns.get_keys("r", [b"k1"])[0].value) == b"third"
    with pytest.raises(InvalidArgument):
        ns.put("r", [(b"k", b"v")], b"abc")
    with pytest.raises(AlreadyExists):
        ns.put("r", [(b"k1", b"fourth")], token, strict=True)
    ns.put("r", [(b"k1", b"fifth")], b"0000000000000000", strict=True)
    assert bytes(ns.get_keys("r", [b"k1"])[0].value) == b"fifth"


def test_paging_to_the_end(ns):
    ns.put("r", [(b"%03d" % i, b"x" * 10) for i in range(20)])
    for selection, least in ((Selection(item_limit=5), 4), (Selection(page_size_bytes=30), 9), (Selection(item_limit=1), 20)):
        seen, token, n = [], None, 0
        while n == 0 or token:
            page = ns.get_all("r", Selection(selection.page_size_bytes, selection.item_limit, True, token))
            assert all(bytes(r.value) == b"" for r in page.items)
            seen, token, n = seen + keys(page.items), page.next_token, n + 1
            if n > 3 and selection.item_limit == 1:
                break
        assert seen == [b"%03d" % i for i in range(len(seen))] and (n >= least or selection.item_limit == 1)
    assert [keys(b) for b in ns.scan("r", b"018", None, True)] == [[b"018", b"019"]]
    assert list(ns.scan_keys("r", [b"none"])) == []


@pytest.mark.parametrize(
    "call",
    [
        lambda n: n.put("", [(b"k", b"v")]),
        lambda n: n.put("a\0b", [(b"k", b"v")]),
        lambda n: n.put("x" * 257, [(b"k", b"v")]),
        lambda n: n.put("r", []),
        lambda n: n.put("r", [(b"k" * 4097, b"v")]),
        lambda n: n.get_keys("r", []),
        lambda n: n.delete_keys("r", []),
        lambda n: n.get_range("r", b"b", b"a"),
        lambda n: n.get_all("r", Selection(page_token=b"abc")),
        lambda n: n.store.create_namespace(Config("a/b")),
        lambda n: Config("a", partitions=3),
        lambda n: Config("a", bloom_false_positives=1.0),
        lambda n: Config("a", default_page_bytes=9 << 20),
        lambda n: Config("a", fsync="never"),
        lambda n: Config("a", routing={"kind": "composite", "delimiter": ":"}),
        lambda n: Config("a", routing={"kind": "prefix"}),
        lambda n: n.store.update_namespace(Config("n", partitions=4)),
    ],
)
def test_refusals(ns, call):
    with pytest.raises(InvalidArgument):
        call(ns)


def test_namespaces(store, ns):
    with pytest.raises(AlreadyExists):
        store.create_namespace(Config("n"))
    with pytest.raises(NotFound):
        store.namespace("none")
    other = store.create_namespace(Config("a"))
    ns.put("r", [(b"k", b"1")])
    assert other.get_all("r").items == [] and store.list_namespaces() == ["a", "n"]
    store.update_namespace(Config("n", partitions=2, tombstone_ttl_ms=5))
    assert ns.config.tombstone_ttl_ms == 5
    store.delete_namespace("a")
    assert not store.namespace_exists("a") and store.list_namespaces() == ["n"]
    ns.set_state(FROZEN)
    assert keys(ns.get_all("r").items) == [b"k"]
    with pytest.raises(Unavailable):
        ns.put("r", [(b"k", b"2")])
    ns.set_state(DRAINING)
    with pytest.raises(Unavailable):
        ns.get_all("r")


def test_snapshots(ns):
    ns.put("r", [(b"k", b"1")])
    first = ns.snapshot()["id"]
    ns.put("r", [(b"k", b"2")])
    assert bytes(ns.get_keys("r", [b"k"], snapshot=first)[0].value) == b"1"
    base = ns.snapshot()
    ns._commit(base)
    with pytest.raises(Conflict):
        ns._commit(base)
    epoch = ns.begin_epoch()
    ns.begin_epoch()
    with pytest.raises(Conflict):
        ns.append(ingest.changes_of(ns.log()), epoch=epoch)
    with pytest.raises(NotFound):
        ns.snapshot(999)
    ns.compact()
    assert len(ns.vacuum(1)) == 2 and len(ns.snapshot_ids()) == 1
    assert bytes(ns.get_keys("r", [b"k"])[0].value) == b"2"
    assert ns.file_meta().count() == 1 and ns.maintain() == []


def test_bulk_and_streams(spark, ns, sf_dir, tmp_path):
    n = 50
    rows = workload.products(spark, n)
    ns.put_many(rows)
    got = ns.items()
    assert got.select("record_id").distinct().count() == n
    last = rows.groupBy("record_id", "item_key").agg(F.max_by("value", "ord").alias("value"))
    assert sorted(map(tuple, got.select("record_id", "item_key", "value").collect())) == sorted(map(tuple, last.collect()))
    changes = ingest.changes_of(workload.mutation_rows(ingest.table_stream(spark, sf_dir, "events")))
    ingest.ingest(changes, ns, "s", str(tmp_path / "c")).awaitTermination()
    one = ns.snapshot()
    ns.append(rows.select("record_id", "item_key", F.lit("PUT").alias("op"), F.lit(None).cast("binary").alias("range_end"), "value", F.lit(b"").alias("metadata"), F.lit(None).cast("binary").alias("token"), "ord"), stream=("s", 0))
    assert ns.snapshot()["id"] == one["id"]  # the batch was there already


def test_many_records(spark, ns):
    n = 30
    rows = workload.products(spark, n)
    ns.put_many(rows)
    some = spark.createDataFrame([(f"product:{i:06d}", [b"price", b"info", b"none"]) for i in (3, 5, 99)], "record_id string, keys array<binary>")
    got = ns.get_many(some).orderBy("record_id", "pos").collect()
    assert [(r.record_id[-2:], bytes(r.item_key), r.pos) for r in got] == [("03", b"price", 0), ("03", b"info", 1), ("05", b"price", 0), ("05", b"info", 1)]
    variants = ns.scan_many(b"variant:", b"variant:\xff", True)
    assert variants.count() == rows.where("decode(item_key, 'UTF-8') LIKE 'variant:%'").select("record_id", "item_key").distinct().count()
    ns.delete_many(spark.createDataFrame([("product:000003", None), ("product:000005", b"price")], "record_id string, item_key binary"))
    got = ns.get_many(some).orderBy("record_id", "pos").collect()
    assert [(r.record_id[-2:], bytes(r.item_key)) for r in got] == [("05", b"info")]
    assert ns.scan_many(b"price", b"price", True, True, some).count() == 0
    assert ns.items().select("record_id").distinct().count() == n - 1


def test_clock_and_tokens():
    clock = VersionClock(3, now_ms=lambda: 7)
    seen = [clock.next() for _ in range(70000)]
    assert seen == sorted(set(seen)) and seen[0] == (7, 3, 0) and seen[65536] == (8, 3, 0)
    for t in (PageToken(b"", 0), PageToken(b"key\0", 1 << 60, 77)):
        assert PageToken.decode(t.encode()) == t and PageToken.from_text(t.text()) == t
    with pytest.raises(InvalidArgument):
        PageToken.from_text("%%")


def test_tokens_outlive_compaction(ns):
    a, b = b"a" * 16, b"b" * 16
    ns.put("r", [(b"k", b"A")], a)
    ns.put("r", [(b"k", b"B")], b)
    ns.compact()
    ns.put("r", [(b"k", b"A")], a)
    assert bytes(ns.get_keys("r", [b"k"])[0].value) == b"B"
    ns.compact()
    assert [p["level"] for p in ns.snapshot()["parts"]] == [3] and len(ns.snapshot()["tokens"]) == 1
    assert ns.log().where("token IS NOT NULL").count() <= 1  # the log does not carry them
    ns.vacuum(1)
    with pytest.raises(AlreadyExists):
        ns.put("r", [(b"k", b"A")], a, strict=True)
    ns.store.update_namespace(Config("n", partitions=2, token_retention_ms=0))
    ns.put("r", [(b"k", b"again")], a)
    assert bytes(ns.get_keys("r", [b"k"])[0].value) == b"again"


def during_commit(ns, act):
    """``act`` between a writer's data and its commit."""
    commit = ns._commit

    def late(base, **changes):
        ns._commit = commit
        act()
        return commit(base, **changes)

    ns._commit = late


def test_vacuum_leaves_claimed_data(ns):
    ns.put("r", [(b"k", b"1")])
    during_commit(ns, lambda: ns.vacuum(1))
    ns.put("r", [(b"k", b"2")])
    assert bytes(ns.get_keys("r", [b"k"])[0].value) == b"2" and ns.files.list("n/pending") == []


def test_commit_of_a_writer_past_its_grace_fails_and_is_written_again(ns):
    ns.put("r", [(b"k", b"1")])
    ns.store.update_namespace(Config("n", partitions=2, grace_ms=0))
    gone = []
    during_commit(ns, lambda: gone.extend(ns.vacuum(1)))
    ns.put("r", [(b"k", b"2")])
    assert len(gone) == 1 and bytes(ns.get_keys("r", [b"k"])[0].value) == b"2"
    assert ns.items().count() == 1
    ns.files.create("n/pending/dead", b'{"since_ms": 0}')
    ns.spark.range(1).write.parquet(ns.files.url("n/data/dead"))
    assert "dead" in ns.vacuum(1) and ns.files.list("n/pending") == []


def test_older_compactors_are_refused(ns):
    ns.put("r", [(b"k", b"1")])
    first, second = ns.begin_compactor(), ns.begin_compactor()
    for call in (ns.compact, lambda compactor: ns.compact_level(0, compactor)):
        with pytest.raises(Conflict):
            call(compactor=first)
    ns.compact(compactor=second)
    assert [p["level"] for p in ns.snapshot()["parts"]] == [3]


def test_levels(spark, store):
    """Files go down a level at a time, one at a time, and reads never change."""
    ns = store.create_namespace(Config("l", partitions=2, l0_commits=1, l1_bytes=7000, l2_bytes=8000, file_bytes=7000))
    want, seen, written = {}, set(), []
    for k in range(5):
        rows = {b"%04d" % ((k * 37 + i * 11) % 500): b"%d-%d" % (k, i) for i in range(120)}
        ns.append(spark.createDataFrame([("r%d" % (int(key) % 3), key, "PUT", None, value, b"", None, i) for i, (key, value) in enumerate(rows.items())], "record_id string, item_key binary, op string, range_end binary, value binary, metadata binary, token binary, ord long"), unique_ord=True, tokens=False)
        want.update(rows)
        if k == 3:
            ns.delete_range("r1", b"0100", b"0200", True)
            want = {a: b for a, b in want.items() if not (int(a) % 3 == 1 and b"0100" <= a < b"0200")}
        before = {p["path"] for p in ns.snapshot()["parts"]}
        ns.maintain()
        parts = ns.snapshot()["parts"]
        written.append(len({p["path"] for p in parts} & before))
        seen |= {p["level"] for p in parts}
        for level in (1, 2, 3) if k < 3 else ():  # no two files of a level overlap, but for what a range delete covers
            ranges = sorted((p["min_key"], p["max_key"]) for p in parts if p["level"] == level)
            assert all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
        assert {bytes(r.item_key): bytes(r.value) for r in ns.items().collect()} == want
    assert seen >= {1, 2, 3} and any(written)  # some upkeep left files as they were


def thousand(spark):
    return spark.range(1000).selectExpr("concat('r', id % 7) AS record_id", "cast(cast(id AS string) AS binary) AS item_key", "cast(cast(id AS string) AS binary) AS value", "cast(lpad(id, 24, '0') AS binary) AS token", "id AS ord")


def test_no_compaction_is_coalesced_into_one_task(spark, ns, monkeypatch):
    """Files of few bytes can have many rows: their merge is dealt to tasks, though it is written as one file."""
    ns.put_many(thousand(spark))
    ns.put_many(thousand(spark))
    monkeypatch.setattr(type(ns.log()), "coalesce", lambda self, n: pytest.fail("all that the rows come of would run in one task"))
    ns.compact(full=False)
    ns.compact(full=True)
    assert len(ns.snapshot()["parts"]) == 1 and ns.items().count() == 1000


def test_files_are_cut_by_rows_and_go_down_together(spark, store):
    ns = store.create_namespace(Config("c", partitions=2, file_rows=90, l0_commits=1, l1_bytes=1))
    ns.append(spark.createDataFrame([(f"r{i % 3}", b"%04d" % i, "PUT", None, b"%d" % i, b"", None, i) for i in range(1000)], "record_id string, item_key binary, op string, range_end binary, value binary, metadata binary, token binary, ord long"), unique_ord=True, tokens=False)
    assert all(p["entry_count"] <= 90 for p in ns.snapshot()["parts"])
    ns.compact(full=False)
    parts = ns.snapshot()["parts"]
    assert {p["level"] for p in parts} == {1} and len(parts) >= 12 and all(p["entry_count"] <= 90 for p in parts)
    assert ns.file_meta().count() == 1  # one run: its files are far from file_bytes
    ns.maintain()
    moved = ns.snapshot()["parts"]
    assert {p["level"] for p in moved} == {2} and [p["path"] for p in moved] == [p["path"] for p in parts]
    assert {bytes(r.item_key) for r in ns.items().collect()} == {b"%04d" % i for i in range(1000)}


def test_vacuum_leaves_claimed_data_that_rows_cut(spark, store):
    ns = store.create_namespace(Config("v", partitions=2, file_rows=90))
    ns.put_many(thousand(spark).where("id < 500").drop("token"))
    ns.compact()
    gone = []
    during_commit(ns, lambda: gone.extend(ns.vacuum(1)))
    ns.put_many(thousand(spark).where("id >= 500").drop("token"))
    parts = ns.snapshot()["parts"]
    assert len(gone) == 1 and len(parts) >= 12 and all(p["entry_count"] <= 90 for p in parts)
    assert {bytes(r.item_key) for r in ns.items().collect()} == {b"%d" % i for i in range(1000)}


def test_token_files_are_cut_by_rows_and_left_when_full(spark, store):
    ns = store.create_namespace(Config("t", partitions=2, file_rows=90))
    ns.put_many(thousand(spark))
    ns.compact()
    full = {p["path"] for p in ns.snapshot()["tokens"] if p["entry_count"] >= 45}
    assert all(p["entry_count"] <= 90 for p in ns.snapshot()["tokens"]) and len(full) >= 6
    again = thousand(spark).withColumn("value", F.lit(b"again"))
    ns.put_many(again.unionByName(again.limit(5).withColumn("token", F.concat(F.lit(b"new"), F.col("token")))))
    ns.compact()
    assert full <= {p["path"] for p in ns.snapshot()["tokens"]} and sum(p["entry_count"] for p in ns.snapshot()["tokens"]) == 1005
    ns.put_many(again)
    assert ns.items().count() == 1000 and ns.items().where(F.col("value") == F.lit(b"again")).count() == 5


def test_one_record_is_read_from_its_own_files(spark, store):
    ns = store.create_namespace(Config("p", partitions=1, file_bytes=2000))
    ns.put_many(workload.products(spark, 60))
    ns.compact()
    parts = ns.snapshot()["parts"]
    frame = ns._record("product:000007")
    assert len(parts) > 2 and len(frame.inputFiles()) < len(parts)
    assert sorted(keys(ns.get_all("product:000007").items)) == sorted(bytes(r.item_key) for r in ns.items().where("record_id = 'product:000007'").collect())


def test_bulk_order_of_arrival(spark, ns):
    """Of a key that comes many times the greatest ord wins, whatever task it is in; without ord, one of them."""
    rows = spark.range(2000).selectExpr("concat('r', id % 3) AS record_id", "cast(cast(id % 7 AS string) AS binary) AS item_key", "cast(cast(id AS string) AS binary) AS value", "2000 - id AS ord")
    ns.put_many(rows.repartition(5))
    want = {(f"r{i % 3}", b"%d" % (i % 7)): b"%d" % i for i in reversed(range(2000))}
    assert {(r.record_id, bytes(r.item_key)): bytes(r.value) for r in ns.items().collect()} == want
    log = ns.log()
    assert log.select("seq").distinct().count() == log.count() == 2000 and ns.snapshot()["next_seq"] == 2001
    ns.put_many(rows.drop("ord"))
    assert ns.items().count() == 21 and ns.snapshot()["next_seq"] == 4001


def test_configuration_is_never_away(ns):
    """A crash between two versions leaves the old one; a repeated update from one version is refused."""
    files = ns.files
    n, value = files.newest("n/config")
    files.advance("n/config", n, value | {"tombstone_ttl_ms": 9}, keep=2)
    with pytest.raises(Conflict):
        files.advance("n/config", n, value)
    assert ns.config.tombstone_ttl_ms == 9
    ns.store.delete_namespace("n")
    with pytest.raises(NotFound):
        ns.config
    assert ns.store.create_namespace(Config("n", partitions=4)).config.partitions == 4


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from types import SimpleNamespace

    from lodestore.sources.shared import shared_dir

    session = lambda master: SimpleNamespace(conf=SimpleNamespace(get=lambda *a: None), sparkContext=SimpleNamespace(master=master))
    with pytest.raises(ValueError):
        shared_dir(session("spark://host:7077"))


def test_scratch_tables_go_with_their_step(spark):
    import os

    from lodestore.sources.shared import scratch, step

    there = lambda t: os.path.exists(t._scratch_path.removeprefix("file:"))
    with step() as keep:
        a = scratch(spark.range(3))
        with step() as inner:
            b, c = scratch(a), inner(scratch(a))
        assert there(a) and not there(b) and there(c)
        d = keep(scratch(c))
    assert not there(a) and not there(c) and there(d) and d.count() == 3
