import re

from pyspark.sql import functions as F

from lodestore.llm.quality_rules import MEASURES, apply_rules, op8_quality_rules


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    seen, lines = set(), 0
    for x in text.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", x):
            lines += x in seen
            seen.add(x)
    places = {}
    for i in range(len(words) - 4):
        places.setdefault(tuple(words[i : i + 5]), []).append(i)
    hit = {i + k for p in places.values() if len(p) > 1 for i in p for k in range(5)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), lines, len(hit)


def test_query_equals_brute_force(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = op8_quality_rules(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        want = brute(docs[r.doc_id])
        assert tuple(r[m] for m in MEASURES) == want
        assert r.base_failed == (want[0] < 10 or 100 * want[4] > 20 * want[0])
        assert r.kept == (not r.base_failed and not r.host_failed)


def test_hosts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, "bad one" if i % 10 else good, "spam") for i in range(100)]
    rows += [(100 + 20 * h + i, "bad" if i == 0 else good, f"fine{h}") for h in range(20) for i in range(20)]
    rows += [(900, "bad", "tiny"), (901, good, "tiny"), (902, good, None)]
    got = {r.doc_id: r for r in apply_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert not got[0].base_failed and got[0].host_failed and not got[0].kept  # a good document of a bad host
    assert all(got[i].kept == (i % 20 != 0) for i in range(100, 500))
    assert got[901].kept and got[902].kept and got[902].host_rate is None  # one bad row of two proves little: it is shrunk
    assert 0.05 < got[901].host_rate < 0.5


def test_odd_rows(spark):
    rows = [(1, None, "a"), (2, "", "a"), (None, "x " * 12, None), (3, "é" * 100000, "a"), (3, "é" * 100000, "a")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("host", F.lit("h")).withColumn("n_words", F.lit(1))
    got = sorted((tuple(r[:6]) for r in apply_rules(docs).collect()), key=str)
    want = [(i, *brute(t)) for i, t, _ in rows]
    assert got == sorted(want, key=str)
    assert apply_rules(docs.limit(0)).collect() == []
