import re

import pytest
from pyspark.sql import functions as F

from lodestore.llm import decontaminate as m


def grams(text, width):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]+", lambda x: x[0].lower(), text or ""))
    return w, {tuple(w[i : i + width]) for i in range(len(w) - width + 1)}


def brute(docs, items):
    out = []
    for i, text in docs:
        hits = []
        for item, t in items:
            w, _ = grams(t, 5)
            if w:
                wide = min(5, len(w))
                mine = grams(t, wide)[1]
                if 100 * len(mine & grams(text, wide)[1]) >= 80 * len(mine):
                    hits.append(item)
        out.append((i, sorted(set(hits)), not hits))
    return sorted(out, key=str)


def run(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id long, text string").withColumn("item_id", F.lit(1)).withColumn("kept", F.lit(1))
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    return sorted([(r.doc_id, list(r.item_ids), r.kept) for r in m.decontaminate(d, b).collect()], key=str)


def test_query_equals_brute_force(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = sorted([(r.doc_id, [int(x) for x in r.item_ids.split(",") if x], r.kept) for r in m.op6_decontaminate(spark, sf_dir).collect()], key=str)
    assert got == brute(docs, items)
    assert any(x[1] for x in got)


@pytest.mark.parametrize("block", [m.BLOCK_BYTES, 60])
def test_all_sizes_and_rates(spark, monkeypatch, block):
    monkeypatch.setattr(m, "BLOCK_BYTES", block)
    words = [f"w{i}" for i in range(80)]
    items = [(n, " ".join(words[:n])) for n in (1, 2, 3, 4, 5, 6, 9, 14, 24, 60, 80)]
    docs = [(k, "pre " * 3 + " ".join(words[:k]) + " post" * 2000) for k in range(0, 81, 4)]
    assert run(spark, docs, items) == brute(docs, items)


def test_partitions_bound_signatures_and_thresholds():
    """A document without any k of an item's shingles, k up to what it may lack, still reaches the threshold; fewer values are needed of no item than one."""
    import numpy as np

    rng = np.random.default_rng(4)
    for n in (1, 2, 5, 7, 8, 31, 32, 100, 255, 256, 1000):
        sets = [np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64)) for _ in range(3)]
        part = m.Partition(list(enumerate(sets)), 80)
        assert (part.threshold >= 1).all() and part.bound >= n - int(part.need[0])
        assert len(part.value) == sum(min(len(x), 2 * part.bound + m.MORE) for x in sets)
        for k, x in enumerate(sets):
            lacking = int(rng.integers(0, len(x) - part.need[k] + 1))
            left = np.sort(rng.permutation(x)[lacking:])
            worst = x[lacking:]  # without the whole begin of its signature
            for own in (left, worst):
                grams = np.concatenate([own, rng.integers(0, 1 << 63, 500).astype(np.uint64), own[:1]])
                assert (0, k) in part.probe(grams, np.zeros(len(grams), np.int64))
                assert m._held(np.sort(grams), x) == len(own)
        few = sets[0][: max(0, int(part.threshold[0]) - 1)]
        assert (0, 0) not in part.probe(few, np.zeros(len(few), np.int64))


def test_odd_rows(spark):
    items = [(1, "A b c d e f"), (1, "a B c d e f"), (2, None), (3, ""), (4, "é one")]
    docs = [(1, None), (2, ""), (None, "a b c d e f"), (3, "É ONE"), (4, "é ONE x"), (4, "é ONE x"), (5, "a b c d e " * 50000 + "f")]
    assert run(spark, docs, items) == brute(docs, items)
    assert run(spark, docs, []) == brute(docs, [])
    assert run(spark, [], items) == []
