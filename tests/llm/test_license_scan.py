import re

from pyspark.sql import functions as F

from lodestore.llm.license_scan import PHRASES, TEMPLATES, op9_license_scan, scan_licenses


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]+", lambda m: m[0].lower(), text or ""))
    hits = [(i, label) for p, label in PHRASES.items() for i in range(len(words)) if words[i : i + len(p.split())] == p.split()]
    starts = [i for i, _ in hits]
    return len(words), len(hits), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in hits}))


def test_query_equals_brute_force(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = op9_license_scan(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    for r in got:
        assert tuple(r[1:6]) == brute(docs[r.doc_id])
        assert set(r.base_labels.split(",")) <= set(r.labels.split(",")) or not r.base_labels
        assert 0 <= r.score <= 1


def scan(spark, texts):
    filler = [f"thing{i} other{i} the of and to in a any this is" for i in range(40)]
    docs = spark.createDataFrame(list(enumerate([*texts, *filler])), "doc_id long, text string")
    got = {r.doc_id: r for r in scan_licenses(docs).collect()}
    return [got[i] for i in range(len(texts))]


def test_templates_are_found_by_method(spark):
    texts = ["word " * 300 + body + " word" * 300 for _, body, _ in TEMPLATES]
    for (label, _, _), r in zip(TEMPLATES, scan(spark, texts)):
        assert label in r.labels.split(","), label
        assert r.labels.split(",") == sorted({label, *filter(None, r.base_labels.split(","))}), r


def test_edited_reordered_and_partial(spark):
    isc = next(body for label, body, _ in TEMPLATES if label == "isc")
    words = isc.split()
    edited = " ".join(w for k, w in enumerate(words) if k not in (3, 30))
    shuffled = " ".join(sorted(words))
    without_key = isc.replace("fee", "charge")
    a, b, c, d = scan(spark, [edited, shuffled, without_key, "permission to use this software"])
    assert a.labels == "isc" and 0.5 <= a.score <= 1
    assert (b.labels, c.labels, d.labels) == ("", "", "") and d.score == 0


def test_every_notice_of_a_file_is_found(spark):
    """Notices do not take each other's places, and neither do stray licence words of a long file."""
    bodies = {label: body for label, body, _ in TEMPLATES}
    pairs = [(a, b) for a in bodies for b in bodies if a < b]
    stray = " ".join(sorted(set(" ".join(b for x, b in bodies.items() if x != "mpl").split())))
    texts = [" ".join(bodies.values()), f"{stray} {'word ' * 300} {bodies['mpl']}", *(f"{bodies[a]} and {bodies[b]}" for a, b in pairs)]
    every, mpl, *two = scan(spark, texts)
    assert set(every.labels.split(",")) == set(bodies)
    assert "mpl" in mpl.labels.split(",")
    for pair, r in zip(pairs, two):
        assert set(pair) <= set(r.labels.split(",")), (pair, r)


def test_sql_follows_the_method(spark):
    """Whole notices, edited ones and phrases: the SQL agrees with the operator on each."""
    import duckdb

    from lodestore.llm.license_scan import SQL

    bodies = [body for _, body, _ in TEMPLATES]
    texts = [*bodies, *("x " * 7 + b.replace(" the ", " ") for b in bodies), *(" ".join(b.split()[k::2]) for b in bodies for k in (0, 1)), *(" ".join(b.split()[9:]) for b in bodies), " ".join(bodies), "mit license apache license cc by", "", None]
    texts += [a + " and " + b for a in bodies for b in bodies] + [f"thing{i} of the and to" for i in range(50)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    con = duckdb.connect()
    con.register("documents", docs.toPandas())
    cols = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
    want = sorted(con.execute(f"SELECT {', '.join(cols)} FROM ({SQL['op9_license_scan']})").fetchall())
    got = sorted(tuple(r[c] for c in cols) for r in scan_licenses(docs).collect())
    for a, b in zip(got, want):
        assert a[:7] == b[:7] and abs(a[7] - b[7]) < 1e-9, (a, b)
    assert sum(bool(r[6]) for r in got) > 60


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "MIT License"), (3, "the cc-by, CC BY"), (3, "the cc-by, CC BY"), (4, "mit é " * 100000 + "mit license"), (5, "mitlicense licensé mit-license")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_words", F.lit(1)).withColumn("labels", F.lit("q"))
    got = sorted((tuple(r[:6]) for r in scan_licenses(docs).collect()), key=str)
    assert got == sorted([(i, *brute(t)) for i, t in rows], key=str)
    assert scan_licenses(docs.limit(0)).collect() == []


def test_whole_licence_texts_as_templates(spark):
    """Templates of thousands of words, all in one file, between stray words of each other."""
    from pathlib import Path

    from lodestore.llm.license_scan import Index

    folder = Path("/usr/share/common-licenses")
    titles = {"GPL-3": "gnu general public license", "LGPL-2.1": "gnu lesser general public license", "Apache-2.0": "apache license", "MPL-2.0": "mozilla public license"}
    have = {n: (folder / n).read_text() for n in titles if (folder / n).exists()}
    have |= {f"made-{k}": " ".join(f"clause{i * 7 % 900}x{k} {'of the and this'.split()[i % 4]}" for i in range(900)) for k in range(3)}
    index = Index([(n, t, [titles.get(n, f"clause0x{n[-1]} of")]) for n, t in have.items()])
    docs = spark.createDataFrame([(0, "\n".join(have.values())), *((k + 1, f"before {t} after") for k, t in enumerate(have.values())), (99, "the of and this clause")], "doc_id long, text string")
    got = {r.doc_id: set(r.labels.split(",")) for r in scan_licenses(docs, index=index).collect()}
    assert set(have) <= got[0] and not set(have) & got[99]
    assert all(n in got[k + 1] for k, n in enumerate(have))
