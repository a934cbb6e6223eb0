"""Latest wins and tombstones, on small logs with known answers and against a plain model."""

import random

import pytest
from pyspark.sql import functions as F

from lodestore.operators import dedup, kernel, paging, predicates
from lodestore.schema import DELETE, MUTATION_LOG, PUT, RANGE_DELETE, InvalidArgument


def log_of(spark, rows):
    """rows: (record, key, op, end, value, seq[, token])."""
    full = [("n", 0, r[0], r[1], r[2], r[3], r[4], b"", r[6] if len(r) > 6 else None, r[5], r[5]) for r in rows]
    return spark.createDataFrame(full, MUTATION_LOG)


def model(rows):
    best = {}
    for r in rows:
        if r[2] != RANGE_DELETE and (r[:2] not in best or best[r[:2]][5] < r[5]):
            best[r[:2]] = r
    ranges = [r for r in rows if r[2] == RANGE_DELETE]
    hidden = lambda b: any(t[0] == b[0] and t[1] <= b[1] and (not t[3] or b[1] < t[3]) and t[5] > b[5] for t in ranges)
    return sorted((b[0], b[1], b[4], b[5]) for b in best.values() if b[2] == PUT and not hidden(b))


def visible(log):
    return sorted((r.record_id, bytes(r.item_key), bytes(r.value), r.seq) for r in kernel.visible_items(log).collect())


def test_last_write_of_a_batch_wins(spark):
    rows = [("r", b"key1", PUT, None, b"v1", 1), ("r", b"key1", PUT, None, b"v2", 2), ("r", b"key2", PUT, None, b"v3", 3)]
    assert visible(log_of(spark, rows)) == [("r", b"key1", b"v2", 2), ("r", b"key2", b"v3", 3)]


@pytest.mark.parametrize(
    "start, end, at, entries, seen",
    [
        (b"a", b"d", 10, [(b"a", 5), (b"b", 5), (b"d", 5), (b"e", 5)], [b"d", b"e"]),
        (b"a", b"d", 5, [(b"b", 10), (b"c", 5)], [b"b", b"c"]),
        (b"m", None, 10, [(b"m", 5), (b"z", 5), (b"zzzzz", 5), (b"a", 5)], [b"a"]),
        (b"m", b"", 10, [(b"m", 5), (b"a", 5)], [b"a"]),
        (b"", b"m", 10, [(b"", 5), (b"a", 5), (b"l", 5), (b"m", 5), (b"z", 5)], [b"m", b"z"]),
        (b"", None, 10, [(b"\xff\xff", 5), (b"x", 11)], [b"x"]),
    ],
)
def test_range_deletes(spark, start, end, at, entries, seen):
    rows = [("r", k, PUT, None, b"v", s) for k, s in entries] + [("r", start, RANGE_DELETE, end, b"", at)]
    assert [k for _, k, _, _ in visible(log_of(spark, rows))] == seen


def test_deletes_beat_older_puts_and_stay_after_compaction(spark):
    old = log_of(spark, [("r", b"k", PUT, None, b"v", 1)])
    new = log_of(spark, [("r", b"k", DELETE, None, b"", 2)])
    assert visible(kernel.merge(new, old)) == []
    part = kernel.compact(new, full=False)
    assert part.count() == 1 and visible(kernel.merge(part, old)) == []
    assert kernel.compact(kernel.merge(new, old), full=True).count() == 0
    kept = kernel.compact(kernel.merge(new, old), full=True, drop_before_ms=2)
    assert [r.op for r in kept.collect()] == [DELETE]


def test_records_do_not_meet(spark):
    rows = [("a", b"k", PUT, None, b"1", 1), ("b", b"k", PUT, None, b"2", 2), ("a", b"", RANGE_DELETE, None, b"", 3)]
    assert visible(log_of(spark, rows)) == [("b", b"k", b"2", 2)]


def test_keys_in_byte_order(spark):
    keys = [b"", b"\x01", b"a", b"a\x00", b"\xc3\xa9", b"\xff", b"\xff\x00"]
    rows = [("r", k, PUT, None, b"v", i + 1) for i, k in enumerate(reversed(keys))]
    got = [bytes(r.item_key) for r in kernel.visible_items(log_of(spark, rows)).orderBy("item_key").collect()]
    assert got == keys


@pytest.mark.parametrize("seed", range(4))
def test_random_logs_against_the_model(spark, seed):
    rng = random.Random(seed)
    key = lambda: bytes(rng.choice(b"ab\xff\x00") for _ in range(rng.randrange(3)))
    rows = []
    for seq in range(1, 250):
        op = rng.choices([PUT, DELETE, RANGE_DELETE], [6, 2, 1])[0]
        rows.append((rng.choice("rst"), key(), op, (key() or None) if op == RANGE_DELETE else None, b"%d" % seq if op == PUT else b"", seq))
    log = log_of(spark, rows)
    assert visible(log) == model(rows)
    assert visible(kernel.as_of(log, 100)) == model(rows[:100])
    first, rest = log.where("seq <= 120"), log.where("seq > 120")
    assert visible(kernel.merge(kernel.compact(first, full=False), rest)) == model(rows)
    assert visible(kernel.merge(kernel.compact(first, full=True), rest)) == model(rows)
    record, k = "r", b"a"
    want = [m for m in model(rows) if m[:2] == (record, k)]
    assert sorted((r.record_id, bytes(r.item_key), bytes(r.value), r.seq) for r in kernel.point_read(log, record, k).collect()) == want


@pytest.mark.parametrize("a, b, want", [(True, True, "2345"), (False, True, "345"), (True, False, "234"), (False, False, "34")])
def test_range_bounds(spark, a, b, want):
    items = kernel.visible_items(log_of(spark, [("r", b"k-%03d" % i, PUT, None, b"v", i + 1) for i in range(10)]))
    got = predicates.match_range(items, b"k-002", b"k-005", a, b).orderBy("item_key").collect()
    assert "".join(bytes(r.item_key)[-1:].decode() for r in got) == want


def test_odd_ranges(spark):
    items = kernel.visible_items(log_of(spark, [("r", k, PUT, None, b"v", i + 1) for i, k in enumerate((b"aaa", b"zzz"))]))
    assert predicates.match_range(items, b"mmm", b"nnn", True, True).count() == 0
    assert predicates.match_range(items, None, b"aaa", False, True).count() == 1
    assert predicates.match_range(items, b"aaa", b"aaa", True, True).count() == 1
    assert predicates.match_range(items).count() == 2
    with pytest.raises(InvalidArgument):
        predicates.match_range(items, b"b", b"a")
    assert predicates.delete_bounds(b"a", b"c", False, True) == (b"a\0", b"c\0")
    assert predicates.delete_bounds(None, b"", False, True) == (b"", None)


def test_prefix_leaves_out_keys_that_go_on_with_ff(spark):
    items = kernel.visible_items(log_of(spark, [("r", k, PUT, None, b"v", i + 1) for i, k in enumerate((b"v:", b"v:a", b"v:\xff", b"w"))]))
    assert sorted(bytes(r.item_key) for r in predicates.match_prefix(items, b"v:").collect()) == [b"v:", b"v:a"]


def pages(sizes, budget):
    out, filled, page = [], 0, 0
    for n in sizes:
        out.append(page)
        filled += n
        if filled >= budget:
            filled, page = 0, page + 1
    return out


@pytest.mark.parametrize("budget", [1, 10, 37, 100, 10**6])
def test_pages(spark, budget):
    rng = random.Random(budget)
    values = [bytes(rng.randrange(40)) for _ in range(60)]
    rows = [("r", b"%02d" % i, PUT, None, v, i + 1) for i, v in enumerate(values)]
    items = kernel.visible_items(log_of(spark, rows))
    want = pages([4 + len(v) for v in values], budget)
    assert [r.page for r in paging.page_numbers(items, budget).orderBy("item_key").collect()] == want
    assert paging.first_page(items, budget).count() == want.count(0)
    last = items.sparkSession.createDataFrame([("r", b"%02d" % (want.count(0) - 1))], "record_id string, last_key binary")
    assert paging.resume(items, last, budget).count() == want.count(1)
    assert paging.first_page(items, budget, 3).count() == min(3, want.count(0))
    assert {bytes(r.value) for r in paging.exclude_values(paging.first_page(items, budget)).collect()} == {b""}


def test_match_keys_in_order_with_repeats(spark):
    items = kernel.visible_items(log_of(spark, [("r", k, PUT, None, k.upper(), i + 1) for i, k in enumerate((b"a", b"b", b"c"))]))
    asked = spark.createDataFrame([("r", [b"c", b"x", b"a", b"c"])], "record_id string, keys array<binary>")
    got = predicates.match_keys(items, asked).orderBy("pos").collect()
    assert [(r.pos, bytes(r.value)) for r in got] == [(0, b"C"), (2, b"A"), (3, b"C")]


def test_first_write_of_a_token_wins(spark):
    t = lambda k: bytes([0] * 8 + [k] * 16)
    rows = [("r", b"k1", PUT, None, b"first", 1, t(1)), ("r", b"k1", PUT, None, b"second", 2, t(1)), ("r", b"k2", PUT, None, b"x", 3, None), ("r", b"k2", PUT, None, b"y", 4, bytes(24)), ("r", b"k1", PUT, None, b"third", 5, t(2))]
    kept = dedup.first_write_wins(log_of(spark, rows))
    assert sorted(r.seq for r in kept.collect()) == [1, 3, 4, 5]
    assert visible(kept) == [("r", b"k1", b"third", 5), ("r", b"k2", b"y", 4)]
    assert kernel.visible_items(log_of(spark, [])).where(F.lit(True)).count() == 0
