import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from lodestore.llm import secret_scan
from tests.llm.test_decontaminate import brute as contaminated
from tests.llm.test_minhash_dedup import brute as groups
from tests.llm.test_secret_scan import brute as base_secrets

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_equal_brute_force(spark, sf_dir):
    """Each stage is held against a plain version of itself, over what the one before it kept."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    seen = {}
    for name, stage in pipeline.STAGES:
        before = docs.collect()
        docs = pipeline.common.scratch(stage(spark, docs, sf_dir))
        seen[name] = (before, docs.collect())
        if name != "sentencepiece":
            assert docs.columns == COLUMNS and docs.dtypes == [("doc_id", "bigint"), ("text", "string"), ("lang", "string"), ("source", "string"), ("n_chars", "bigint")]
            assert len(seen[name][1]) > 50
    ids = lambda rows: sorted(r.doc_id for r in rows)

    before, after = seen["quality classifier"]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    kept = set(ids(after))
    assert np.mean([(r.doc_id in kept) == bool(labels[r.doc_id]) for r in before if r.doc_id in labels]) > 0.95

    before, after = seen["near duplicates"]
    assert ids(after) == sorted(i for i, _, _, keep in groups([(r.doc_id, r.text) for r in before], 5) if keep)

    before, after = seen["benchmark decontamination"]
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    assert ids(after) == sorted(i for i, _, keep in contaminated([(r.doc_id, r.text) for r in before], items) if keep)

    before, after = seen["secret scan"]
    texts = {r.doc_id: r for r in after}
    assert ids(before) == ids(after)
    for r in before:
        for _, a, b in base_secrets(r.text):
            assert r.text[a:b] not in texts[r.doc_id].text
        if not secret_scan.find_secrets(r.text):
            assert tuple(r) == tuple(texts[r.doc_id])
        assert texts[r.doc_id].n_chars == len(texts[r.doc_id].text)

    before, after = seen["sentencepiece"]
    assert ids(before) == ids(after) and all(r.decoded for r in after)
    assert sorted(map(str, pipeline.run(spark, sf_dir).collect())) == sorted(map(str, after))


def test_odd_rows(spark, sf_dir):
    good = "The house of the king is in the north and it was built by the people who live there with their friends."
    rows = [(i, good + " " + " ".join(f"word{i}x{j}" for j in range(30)) + " of the house.", "en", "s", 1) for i in range(40)]
    rows += [(50, None, None, None, None), (51, "", "en", "s", 0), (None, rows[0][1], "en", None, 5), rows[1], rows[1], (52, "it is that of the " * 20000, "en", "s", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("kept", F.lit("k")).withColumn("row", F.lit(1)).withColumn("component_id", F.lit(1))
    for name, stage in pipeline.STAGES:
        empty = stage(spark, docs.limit(0), sf_dir)
        assert empty.collect() == []
        docs = pipeline.common.scratch(stage(spark, docs, sf_dir))
        if name == "near duplicates":
            assert docs.columns == [*COLUMNS, "kept", "row", "component_id"]
            assert sorted(r.doc_id for r in docs.collect() if r.doc_id is not None and r.doc_id < 50) == list(range(40))
    assert docs.count() >= 40
