import random
import re

import pytest
from pyspark.sql import functions as F

from lodestore.llm.minhash_dedup import near_duplicates, op2_minhash_dedup


def shingle_set(text, width):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    return {tuple(words[i : i + width]) for i in range(max(1, len(words) - width + 1))} if words else set()


def brute(rows, width):
    sets = [(i, shingle_set(t, width)) for i, t in rows]
    where = {}
    for k, (_, s) in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(k)
    root = list(range(len(sets)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for k, (_, s) in enumerate(sets):
        count = {}
        for x in s:
            for j in where[x]:
                if j < k:
                    count[j] = count.get(j, 0) + 1
        for j, n in count.items():
            if 100 * n >= 80 * (len(s) + len(sets[j][1]) - n):
                root[find(k)] = find(j)
    least = {}
    for k, (i, _) in enumerate(sets):
        least[find(k)] = min(i, least.get(find(k), i))
    return sorted((i, len(s), least[find(k)], i == least[find(k)]) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("size", ["sf0.001", "sf0.01"])
def test_query_equals_brute_force(spark, size):
    d = f"/root/testdata/{size}"
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{d}/documents.parquet").select("doc_id", "text").collect()]
    got = sorted(tuple(r) for r in op2_minhash_dedup(spark, d).collect())
    assert got == brute(rows, 2)


def test_links_that_no_hub_has(spark):
    """A chain: neighbours are alike, ends are not; the smallest id is not linked to all."""
    base = [f"w{i}" for i in range(400)]
    rows = []
    for k in range(12):
        words = list(base)
        for j in range(k * 25, k * 25 + 25):
            words[j] = f"x{k}_{j}"
        for j in range(0, k * 25):
            words[j] = f"y{j}"
        rows.append((100 - k, " ".join(words)))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == brute(rows, 2)


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (3, " \n "), (4, "one"), (5, "ONE"), (6, "a b c"), (6, "a b c"), (None, "a b c"), (7, "É b"), (8, "é b"), (9, "x " * 60000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sig", F.lit(1)).withColumn("component_id", F.lit("z")).withColumn("rep", F.lit(None))
    got = sorted((tuple(r) for r in near_duplicates(docs, width=2).collect()), key=str)
    want = [(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (6, 2, 6, True), (6, 2, 6, True), (7, 1, 7, True), (8, 1, 8, True), (9, 1, 9, True), (None, 2, None, True)]
    assert got == sorted(want, key=str)
    assert near_duplicates(docs.limit(0)).collect() == []


def test_lists_of_many_blocks(spark, monkeypatch):
    """Small blocks: every list is cut into several, and the result stays."""
    from lodestore.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "BLOCK", 3)
    rng = random.Random(5)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for k in range(120):
        words = list(base)
        for _ in range(rng.randrange(4, 22)):
            words[rng.randrange(150)] = f"x{rng.randrange(60)}"
        rows.append((k, " ".join(words)))
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    want = brute(rows, 2)
    assert got == want and 3 < len({r[2] for r in want}) < 110


def test_one_id_with_different_texts(spark):
    """Rows of one id and different texts are documents of their own: no link runs through the id."""
    a, b = " ".join(f"a{i}" for i in range(60)), " ".join(f"b{i}" for i in range(60))
    rows = [(5, a), (5, b), (2, a + " z"), (9, b), (9, a), (7, b + " y")]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == brute(rows, 2)
    assert {(i, c) for i, _, c, _ in got} == {(5, 2), (5, 5), (2, 2), (9, 5), (9, 2), (7, 5)}


def test_hot_classes_and_blocks_by_bytes(spark, monkeypatch):
    from lodestore.llm import minhash_dedup

    monkeypatch.setattr(minhash_dedup, "HOT_ROWS", 3)
    monkeypatch.setattr(minhash_dedup, "BLOCK_BYTES", 2000)
    rng = random.Random(8)
    base = [f"w{i}" for i in range(100)]
    texts = [" ".join(base[:-3] + [f"x{rng.randrange(30)}" for _ in range(rng.randrange(8))]) for _ in range(25)]
    rows = [(k, texts[min(rng.randrange(60), 24)]) for k in range(90)] + [(1000 + k, None) for k in range(20)]
    got = sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string"), width=2).collect())
    assert got == brute(rows, 2)


def test_scratch_tables_do_not_stay(spark):
    from lodestore.sources import shared

    before = set(shared._written)
    near_duplicates(spark.createDataFrame([(1, "a b c"), (2, "a b c"), (3, "d")], "doc_id long, text string"), width=2).collect()
    assert len(shared._written - before) == 2  # what the result is read from
