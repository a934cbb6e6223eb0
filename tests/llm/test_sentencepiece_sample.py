import math
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestore.llm import sentencepiece_sample as s


@pytest.fixture(scope="module")
def vocabulary():
    return s.Vocabulary.load()


def tiny():
    """A small vocabulary: letters, some pieces, and the 256 bytes."""
    pieces = ["▁", "a", "b", "ab", "aba", "▁a", "▁ab", "ba", "abab"] + [f"<0x{b:02X}>" for b in range(256)]
    weights = np.log(np.array([3, 2, 2, 5, 1, 4, 2, 3, 1] + [0.1] * 256))
    usable = np.array([True] * 9 + [False] * 256)
    return s.Vocabulary(pieces, weights, usable, np.arange(9, 265))


def all_segmentations(text, v):
    """(ids, probability) of each segmentation, by plain recursion; pieces do not cross a word's begin."""
    chars = " " + text
    begins = {0} | {i for i in range(1, len(chars)) if chars[i] == " " and chars[i - 1] != " " or chars[i] == "\n" or chars[i - 1] == "\n"}
    by_text = {p.replace("▁", " "): i for i, p in enumerate(v.pieces) if v.usable[i]}

    def go(i):
        if i == len(chars):
            return [((), 0.0)]
        out = []
        for j in range(i + 1, len(chars) + 1):
            if any(i < b < j for b in begins):
                break
            part = chars[i:j]
            if part in by_text:
                out += [((by_text[part], *ids), v.weights[by_text[part]] + w) for ids, w in go(j)]
            elif j == i + 1:
                ids0 = tuple(int(v.byte_ids[b]) for b in part.encode())
                out += [((*ids0, *ids), len(ids0) * v.weights[v.byte_ids[0]] + w) for ids, w in go(j)]
        return out

    every = go(0)
    total = sum(math.exp(w) for _, w in every)
    return {ids: math.exp(w) / total for ids, w in every}


@pytest.mark.parametrize("text", ["ababa", "ab ba", "éa\nb", "a", "  ab", "a▁b"])
def test_sampling_without_replacement(text):
    """Distinct samples with their own probabilities, drawn in the order and at the rates that brute force gives."""
    v, n, k = tiny(), 6000, 3
    p = all_segmentations(text, v)
    found = s.sample_slice([text] * n, s.row_seeds(list(range(n)), 5), v, k)
    first, pairs, score = Counter(), Counter(), Counter()
    for rows in found:
        ids = [tuple(r[0].tolist()) for r in rows]
        assert len(rows) == min(k, len(p)) == len(set(ids))
        for i, (_, log_p, log_in) in zip(ids, rows):
            assert abs(log_p - math.log(p[i])) < 1e-4 and log_in <= 0
            score[i] += p[i] / math.exp(log_p) / math.exp(log_in) if len(p) > k else 1
        first[ids[0]] += 1
        if len(ids) > 1:
            pairs[tuple(ids[:2])] += 1
        assert all(v.decode(r[0]) == text for r in rows)
    near = lambda got, want: abs(got / n - want) < 5 * math.sqrt(max(want, 2 / n) * (1 - want) / n) + 1e-9
    assert all(near(first[i], q) for i, q in p.items())
    for i, q in p.items():
        for j, r in p.items():
            if i != j:
                assert near(pairs[i, j], q * r / (1 - q))
    if len(p) > k:  # inclusion scores: weighted by them, each segmentation counts once
        assert all(abs(score[i] / n - 1) < 0.35 for i, q in p.items() if q > 0.1)


def test_best_equals_brute_force(vocabulary):
    v = tiny()
    for text in ("ababab ab", "bbab", "xé ab\n\nba", " "):
        p = all_segmentations(text, v)
        assert p[tuple(s.encode_slice([text], v)[0].tolist())] >= max(p.values()) - 1e-9
        assert len({v.decode(np.array(i)) for i in p}) == 1


def test_results_do_not_depend_on_the_slice(vocabulary):
    texts = ["hello world", "", "The quick brown fox\njumps", "x" * 300, "hello world"]
    seeds = s.row_seeds([1, 2, 3, 4, 1], 0)
    whole = s.sample_slice(texts, seeds, vocabulary)
    for k, t in enumerate(texts):
        alone = s.sample_slice([t], seeds[k : k + 1], vocabulary)[0]
        assert [(a.tolist(), round(b, 4)) for a, b, _ in alone] == [(a.tolist(), round(b, 4)) for a, b, _ in whole[k]]
    assert [a.tolist() for a, _, _ in whole[0]] == [a.tolist() for a, _, _ in whole[4]]


def test_round_trip_of_odd_texts(vocabulary):
    texts = ["", " ", "  two  spaces ", "▁▁mark ▁", "tab\tand\r\n", "\U0001f600 中文", "a\u0000b", "long" * 3000, "éé", "\n\n\n"]
    for t, ids, rows in zip(texts, s.encode_slice(texts, vocabulary), s.sample_slice(texts, s.row_seeds(list(range(10)), 1), vocabulary, 2)):
        assert vocabulary.decode(ids) == t
        assert all(vocabulary.decode(r[0]) == t for r in rows)


def test_mass_in_logs_equals_linear(vocabulary, monkeypatch):
    texts = ["internationalisation " * 3 + "x" * 60]
    a = s.Lattice(texts, vocabulary)
    a.weigh()
    monkeypatch.setattr(s, "_LONG", 3)
    b = s.Lattice(texts, vocabulary)
    b.weigh()
    assert np.allclose(a.p, b.p, atol=1e-6)


def ways(text, v):
    """In how many ways a text can be cut into pieces."""
    lat = s.Lattice([text], v)
    n = [0] * len(lat.chars) + [1] + [0] * lat.width
    for i in reversed(range(len(lat.chars))):
        n[i] = sum(n[i + k + 1] for k in range(lat.width) if lat.w[lat.state[i], k] > -np.inf)
    return n[0]


def test_unspaced_and_unknown_characters(vocabulary):
    """Rare characters do not leave the range of doubles, and do not spoil the ordinary texts of their slice."""
    chinese, thai = "中国人民共和国的一个大学生在北京和上海", "สวัสดีชาวโลกทุกคนที่อยู่ที่นี่"
    odd = [(c * 30)[:n] for c in (chinese, thai) for n in (70, 99, 101, 300)] + ["\U0001faa9" * 20, "9f" * 60]
    texts = [x for t in odd for x in (t, "The quick brown fox jumps over the dog")]
    lat = s.Lattice(texts, vocabulary)
    lat.weigh()
    assert np.isfinite(lat.p).all() and np.allclose(lat.p.sum(axis=1), 1, atol=1e-5)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(s, "_LONG", 0)
        logs = s.Lattice(texts, vocabulary)
        logs.weigh()
    assert np.allclose(lat.p, logs.p, atol=1e-6)
    seeds = s.row_seeds(list(range(len(texts))), 3)
    for k, (t, rows) in enumerate(zip(texts, s.sample_slice(texts, seeds, vocabulary))):
        assert all(vocabulary.decode(ids) == t and np.isfinite([p, q]).all() for ids, p, q in rows)
        assert len({tuple(ids.tolist()) for ids, _, _ in rows}) == len(rows) == min(ways(t, vocabulary), s.SAMPLES)
        alone = s.sample_slice([t], seeds[k : k + 1], vocabulary)[0]
        assert [(a.tolist(), b, c) for a, b, c in alone] == [(a.tolist(), b, c) for a, b, c in rows]


def log_mass(text, v):
    """The log of the summed weights of all segmentations, by a plain recursion over places."""
    chars = " " + text
    by_text = {p.replace("▁", " "): i for i, p in enumerate(v.pieces) if v.usable[i]}
    begins = {i for i in range(1, len(chars)) if chars[i] == " " and chars[i - 1] != " " or chars[i] == "\n" or chars[i - 1] == "\n"}
    mass = [0.0] * (len(chars) + 1)
    for i in reversed(range(len(chars))):
        logs = []
        for j in range(i + 1, min(len(chars), i + v.longest) + 1):
            if j - 1 in begins and j - 1 > i:
                break
            if chars[i:j] in by_text:
                logs.append(v.weights[by_text[chars[i:j]]] + mass[j])
            elif j == i + 1:
                logs.append(len(chars[i].encode()) * v.weights[v.byte_ids[0]] + mass[j])
        top = max(logs)
        mass[i] = top + math.log(math.fsum(math.exp(x - top) for x in logs))
    return mass[0]


def weight(ids, v):
    return math.fsum(v.weights[i] if v.usable[i] else v.weights[v.byte_ids[0]] for i in ids.tolist())


@pytest.mark.parametrize("n", [1, 2, 15, 25, 63, 64, 99, 100, 101, 250, 500])
def test_words_of_bytes_alone_equal_brute_force(vocabulary, n):
    """Characters without pieces, alone and among pieces, before and behind ordinary texts of the slice."""
    texts = ["hello there", "\U0001faa9" * n, "\u9f98" * n, "a\U0001faa9b" * n, ("\u9f98\u9750the" * n)[:n], "hello there"]
    seeds = s.row_seeds([1, 2, 3, 4, 5, 1], 0)
    found = s.sample_slice(texts, seeds, vocabulary)
    for k, (t, rows) in enumerate(zip(texts, found)):
        want = log_mass(t, vocabulary)
        assert rows and all(np.isfinite([p, q]).all() and q <= 0 for _, p, q in rows)
        assert all(abs(p - (weight(ids, vocabulary) - want)) < 1e-3 * (1 + len(t)) ** 0.5 for ids, p, _ in rows), t
        alone = s.sample_slice([t], seeds[k : k + 1], vocabulary)[0]
        assert [(a.tolist(), b, c) for a, b, c in alone] == [(a.tolist(), b, c) for a, b, c in rows]
    assert [a.tolist() for a, _, _ in found[0]] == [a.tolist() for a, _, _ in found[5]]


def test_texts_without_spaces_take_about_as_long(vocabulary):
    from time import perf_counter

    rng = np.random.default_rng(5)
    unspaced = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FA5, 32000))
    spaced = " ".join(unspaced[k : k + 5] for k in range(0, len(unspaced), 5))

    def seconds(t):
        best = 1e9
        for _ in range(3):
            start = perf_counter()
            s.sample_slice([t], s.row_seeds([1], 0), vocabulary)
            best = min(best, perf_counter() - start)
        return best

    assert seconds(unspaced) < 5 * seconds(spaced)


def test_a_null_id_has_its_own_seed():
    seeds = s.row_seeds([None, -1, 0, 1, None], 7)
    assert seeds[0] == seeds[4] and len(set(seeds.tolist())) == 4


def test_query_round_trips(spark, sf_dir):
    rows = s.op3_sentencepiece(spark, sf_dir).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert sorted(r.doc_id for r in rows) == sorted(texts)
    assert all(r.decoded and len(set(r.ids_sha256)) == r.n_samples and 1 <= r.n_samples <= s.SAMPLES for r in rows)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r.doc_id: r.text for r in s.decode(s.encode(docs)).collect()} == texts


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "hello there"), (3, "hello there"), (3, "hello there"), (4, "word " * 60000), (5, "q" * 100000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("samples", F.lit(1)).withColumn("ids", F.lit(2))
    got = s.sample(docs).collect()
    assert len(got) == len(rows) and all(r.decoded for r in got)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append([bytes(x.ids) for x in r.samples])
    assert by[1] == by[2] == [[b""]]
    assert by[3][0] == by[3][1] and len(set(by[3][0])) == 3
    assert len(set(by[4][0])) == len(set(by[5][0])) == 3
    assert s.sample(docs.limit(0)).collect() == []
