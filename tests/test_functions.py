"""Routing, keys and upkeep decisions."""

import pytest
from pyspark.sql import functions as F

from lodestore.functions import keys, routing
from lodestore.operators import maintenance
from lodestore.schema import InvalidArgument

IDS = ["a", "product:000042", "tenant:region:id1", "tenant:region:other", "é:ü:x", "日本:語:1", "a" * 256, "x::y"]


@pytest.mark.parametrize("strategy", [{"kind": "simple"}, {"kind": "crc32"}, {"kind": "fnv"}, {"kind": "prefix", "length": 4}, {"kind": "composite", "delimiter": ":", "fields": [0, 1]}])
@pytest.mark.parametrize("n", [1, 16, 1024])
def test_routing(spark, strategy, n):
    ids = [i for i in IDS if strategy["kind"] != "composite" or i.count(":") >= 1]
    got = spark.createDataFrame([(i,) for i in ids], "r string").select("r", routing.route(F.col("r"), n, strategy).alias("p")).collect()
    assert {r.r: r.p for r in got} == {i: routing.route_one(i, n, strategy) for i in ids}
    if strategy["kind"] == "composite":
        assert routing.route_one(IDS[2], n, strategy) == routing.route_one(IDS[3], n, strategy)


def test_known_hashes(spark):
    assert routing.route_one("product:000042", 1 << 30) == 148276008 & ((1 << 30) - 1)
    assert routing.route_one("product:000042", 1 << 30, {"kind": "fnv"}) == 71713885


def test_routing_refusals(spark):
    df = spark.createDataFrame([("plain",)], "r string")
    with pytest.raises(InvalidArgument):
        routing.simple(F.col("r"), 3)
    with pytest.raises(InvalidArgument):
        routing.route_one("plain", 4, {"kind": "composite", "delimiter": ":", "fields": [1]})
    with pytest.raises(Exception, match="too few fields"):
        df.select(routing.composite(F.col("r"), 4, ":", [1])).collect()


def test_ids_spread_evenly(spark):
    df = spark.range(10000).select(F.concat(F.lit("record-"), "id").alias("record_id"), F.lit(b"").alias("item_key"))
    got = routing.partition_histogram(df, 16).collect()
    assert len(got) == 16 and all(r.n_records >= 100 for r in got) and sum(r.n_items for r in got) == 10000


def test_composite_keys_sort_like_their_parts(spark):
    rows = [("a", b""), ("a", b"\x00"), ("a", b"\xff"), ("a!", b""), ("b", b"a\x00b")]
    df = spark.createDataFrame(rows, "r string, k binary").withColumn("c", keys.composite_key(F.col("r"), F.col("k")))
    record, item = keys.split_composite_key(F.col("c"))
    got = df.orderBy("c").select("r", "k", record.alias("r2"), item.alias("k2")).collect()
    assert [(r.r, bytes(r.k)) for r in got] == sorted(rows)
    assert all((r.r, bytes(r.k)) == (r.r2, bytes(r.k2)) for r in got)


def test_tokens(spark):
    t = keys.random_token(5, bytes(range(16)))
    df = spark.createDataFrame([(t, i) for i in (0, 1, 255, 256, 70000)] + [(None, 1), (bytes(24), 3)], "t binary, i long")
    got = [r[0] for r in df.select(keys.derived_token(F.col("t"), F.col("i"))).collect()]
    for out, i in zip(got[:5], (0, 1, 255, 256, 70000)):
        want = bytearray(t)
        for k, b in enumerate(i.to_bytes(4, "little")):
            want[8 + k] ^= b
        assert bytes(out) == bytes(want)
    assert got[5] is None and not any(got[6])


META = "id string, level int, size_bytes long, min_key string, max_key string, created_at_ms long"


@pytest.mark.parametrize(
    "files, want",
    [
        ([(f"f{i}", 0, 1, "a", "c", i) for i in range(4)], []),
        ([(f"f{i}", 0, 1, "a", "c", i) for i in range(5)] + [("x", 1, 1, "b", "d", 0), ("y", 1, 1, "d", "e", 0)], [(0, f"f{i}", "source") for i in range(5)] + [(0, "x", "target")]),
        ([("p", 1, 300 << 20, "a", "c", 2), ("q", 1, 1, "k", "m", 1), ("z", 2, 1, "l", "n", 0), ("w", 2, 1, "a", "b", 0)], [(1, "q", "source"), (1, "z", "target")]),
        ([("b", 3, 1 << 50, "a", "z", 0)], []),
    ],
)
def test_what_is_compacted(spark, files, want):
    got = maintenance.compaction_inputs(spark.createDataFrame(files, META)).collect()
    assert sorted(map(tuple, got)) == sorted(want)


def test_moves_and_stalls(spark):
    inputs = spark.createDataFrame([(1, "a", "source"), (2, "b", "source"), (2, "c", "target")], "level int, id string, role string")
    assert [r.level for r in maintenance.trivial_moves(inputs).collect()] == [1]
    n = spark.createDataFrame([(i,) for i in (0, 8, 9, 11, 12, 30)], "n int")
    got = n.select(maintenance.stall(F.col("n")), maintenance.stall_ms(F.col("n"))).collect()
    assert [tuple(r) for r in got] == [("none", 0), ("none", 0), ("slow", 1), ("slow", 3), ("reject", 0), ("reject", 0)]
