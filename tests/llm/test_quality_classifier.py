import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from lodestore.llm import quality_classifier as q
from lodestore.llm import wordkit


def test_agrees_with_labels(spark):
    """No label trains the classifier; but its labellers and threshold were chosen while looking at such tables."""
    d = "/root/testdata/sf0.01"
    got = {r.doc_id: r for r in q.op4_quality_classifier(spark, d).collect()}
    labels = spark.read.parquet(f"{d}/labels.parquet").collect()
    assert len(got) == 1000
    right = [got[r.doc_id].kept == bool(r.quality) for r in labels]
    clean = [got[r.doc_id].kept for r in labels if r.quality]
    assert np.mean(right) > 0.97 and np.mean(clean) > 0.98


def test_repetition_is_judged_alike_at_every_length():
    passage = " ".join(f"word{i}" for i in range(100))
    prose = " ".join(f"word{i * i % 99991}" for i in range(30000))
    votes = q.votes(pa.array([*(" ".join([passage] * k) for k in (19, 20, 21, 40, 300)), prose]))[:, q.LABELLERS.index("repetition")]
    assert votes.tolist() == [q.BAD] * 5 + [q.GOOD]


def test_label_model_recovers_accuracies():
    rng = np.random.default_rng(1)
    truth = rng.random(20000) < 0.7
    want = [0.95, 0.9, 0.85, 0.8, 0.75, 0.7, 0.65, 0.6]
    votes = np.stack([np.where(rng.random(20000) < a, truth, ~truth) for a in want], axis=1).astype(np.int64)
    votes[rng.random(votes.shape) < 0.2] = q.NONE
    patterns, counts = np.unique(votes, axis=0, return_counts=True)
    model = q.LabelModel(patterns, counts.astype(float))
    assert abs(model.prior - 0.7) < 0.03
    assert np.allclose(list(model.accuracies().values()), want, atol=0.03)
    assert ((model.posterior(votes) > 0.5) == truth).mean() > 0.95


def plain_votes(text):
    """The labellers, one text at a time."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lower = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    n, raw = len(words), text.encode()
    if not n:
        return [q.BAD] * 8
    letters = sum(65 <= b < 91 or 97 <= b < 123 or b in (0xC3, 0xC4) for b in raw)
    starts = [*range(0, n - q.SPAN, q.SPAN), max(n - q.SPAN, 0)]
    distinct = sum(len(set(lower[a : a + q.SPAN])) for a in starts) / len(starts) / min(n, q.SPAN)
    known = set(q.FUNCTION_WORDS)
    rules = [
        (sum(c in "#*$%&|<>{}[]~^_=+\\@!" for c in text) / n, lambda v: v < 0.1, lambda v: v > 0.5),
        (sum("A" <= c <= "Z" for c in text) / max(letters, 1), lambda v: v < 0.2, lambda v: v > 0.5),
        (distinct, lambda v: v > 0.3, lambda v: v < 0.15 and n > 20),
        (sum(c in "|\t;" for c in text) / n, lambda v: v < 0.02, lambda v: v > 0.2),
        (sum(w in known for w in lower) / n, lambda v: v > 0.15, lambda v: v < 0.02 and n > 40),
        (sum(c in ".!?" for c in text) / n, lambda v: 0.02 < v < 0.5, lambda v: v < 0.003 and n > 40),
        (sum(len(w) for w in words) / n, lambda v: 3 < v < 10, lambda v: v < 2 or v > 20),
        (sum(a == b for a, b in zip(lower, lower[1:])) / n, lambda v: v < 0.05 and n > 1, lambda v: v > 0.15 and n > 4),
    ]
    return [q.BAD if bad(v) else q.GOOD if good(v) else q.NONE for v, good, bad in rules]


def plain_em(rows, rounds=100):
    """Expectation-maximisation over single rows; returns the posterior of each."""
    post = [min(max((r.count(q.GOOD) + 0.5) / (r.count(q.GOOD) + r.count(q.BAD) + 1), 0.05), 0.95) for r in rows]
    for _ in range(rounds):
        prior = min(max(sum(post) / len(rows), 1e-3), 1 - 1e-3)
        rate = {}
        for c in (0, 1):
            for k in range(8):
                n = [1.0, 1.0]
                for r, p in zip(rows, post):
                    if r[k] != q.NONE:
                        n[r[k]] += p if c else 1 - p
                rate[c, k] = [x / sum(n) for x in n]
        new = []
        for r in rows:
            odds = math.log(prior / (1 - prior)) + sum(math.log(rate[1, k][v] / rate[0, k][v]) for k, v in enumerate(r) if v != q.NONE)
            new.append(1 / (1 + math.exp(-odds)))
        if max(abs(a - b) for a, b in zip(new, post)) < 1e-9:
            return new
        post = new
    return post


def plain_features(text):
    words, out, before = re.findall(r"[^\x20\x09-\x0D]+", text), Counter(), None
    half = q.DIM // 2
    one = lambda b: int(wordkit.hash_spans(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]) >> 40
    for w in words:
        raw = w.encode()
        low = bytes(b + 32 if 65 <= b < 91 else b for b in raw)
        shape = bytes(97 if b >= 0x80 or 97 <= b < 123 else 65 if 65 <= b < 91 else 48 if 48 <= b < 58 else b for b in raw)
        out[half - 1 if low == before else one(low) % (half - 1)] += 1
        out[half + one(shape) % half] += 1
        before = low
    return {k: math.sqrt(v / len(words)) for k, v in out.items()}


def test_query_equals_brute_force(spark):
    """Votes, posteriors, features and scores by plain loops; weights by Newton's method agree in verdicts."""
    d = "/root/testdata/sf0.001"
    table = spark.read.parquet(f"{d}/documents.parquet")
    rows = table.select("doc_id", "text", F.xxhash64("text").alias("pick")).collect()
    got = {r.doc_id: r for r in q.op4_quality_classifier(spark, d).collect()}
    votes = [plain_votes(r.text or "") for r in rows]
    post = plain_em(votes)
    x = np.zeros((len(rows), q.DIM))
    for k, r in enumerate(rows):
        for j, v in plain_features(r.text or "").items():
            x[k, j] = v
    first = {}
    for k, r in sorted(enumerate(rows), key=lambda y: y[1].pick):
        if (r.text or "").split():
            first.setdefault(r.pick, k)
    train = list(first.values())[: q.SAMPLE]
    w = q.fit_scorer(x[train].astype(np.float16), np.array([post[k] for k in train]))
    for k, r in enumerate(rows):
        assert got[r.doc_id].votes == "".join(map(str, votes[k]))
        assert abs(got[r.doc_id].posterior - post[k]) < 1e-5
        score = 1 / (1 + math.exp(-(x[k] @ w[:-1] + w[-1]))) if (r.text or "").split() else 0.0
        assert abs(got[r.doc_id].score - score) < 1e-3 and (abs(score - q.THRESHOLD) < 1e-3 or got[r.doc_id].kept == (score >= q.THRESHOLD))


def test_scorer_equals_newton():
    rng = np.random.default_rng(2)
    x = rng.random((300, 6))
    y = 1 / (1 + np.exp(-(x @ np.array([3.0, -2, 0, 1, 0, -1]) + 0.3)))
    full, w = np.concatenate([x, np.ones((300, 1))], axis=1), np.zeros(7)
    for _ in range(50):
        p = 1 / (1 + np.exp(-full @ w))
        grad = full.T @ (p - y) / 300 + 0.05 * w
        w -= np.linalg.solve((full * (p * (1 - p))[:, None]).T @ full / 300 + 0.05 * np.eye(7), grad)
    assert np.allclose(q.fit_scorer(x, y, steps=3000, l2=0.05), w, atol=1e-3)


def test_sample_is_bounded_and_runs_agree(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    a = q.classify(docs, sample=50).orderBy("doc_id").collect()
    b = q.classify(docs.repartition(7), sample=50).orderBy("doc_id").collect()
    assert [r.kept for r in a] == [r.kept for r in b]
    assert np.allclose([r.score for r in a], [r.score for r in b], atol=1e-6)


def test_odd_rows(spark):
    good = "The house of the king is in the north and it was built by the people. They live there with their friends to this day."
    rows = [(i, good + f" Number {i} is here.") for i in range(20)] + [(30, None), (31, ""), (32, "\n"), (None, good), (33, good), (33, good), (34, "BUY NOW!!! $$$ " * 20000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit(1)).withColumn("votes", F.lit(1))
    got = q.classify(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got}
    assert all(not by[i].kept and by[i].score == 0 for i in (30, 31, 32)) and not by[34].kept
    assert by[33].kept and by[None].kept and sum(r.doc_id == 33 for r in got) == 2
    assert q.classify(docs.limit(0)).collect() == []
