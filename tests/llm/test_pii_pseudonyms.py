import datetime

import pytest
from pyspark.sql import functions as F

from lodestore.llm import pii_pseudonyms as p

CIPHER = p.Cipher("k")


def one(text, key="k"):
    return p.find_pii(text, p.Cipher(key))


@pytest.mark.parametrize("n", [2, 3, 10, 97, 1000])
def test_permutation_of_every_size(n):
    image = [CIPHER.permute("x", i, n) for i in range(n)]
    assert sorted(image) == list(range(n))
    assert [CIPHER.invert("x", y, n) for y in image] == list(range(n))
    assert n < 97 or [CIPHER.permute("y", i, n) for i in range(n)] != image


@pytest.mark.parametrize(
    "text, kind",
    [
        ("4111 1111 1111 1111", "card"),
        ("4111111111111111", "card"),
        ("GB82 WEST 1234 5698 7654 32", "iban"),
        ("123-45-6789", "ssn"),
        ("+1 (743) 555-3824", "phone"),
        ("+44 20 7946 0958", "phone"),
        ("152.143.123.131", "ipv4"),
        ("1984-02-29", "date"),
        ("29/02/1984", "date"),
        ("ea.19@mail5.example.com", "email"),
        ("ouaié_ß.7@mail3.example.com", "email"),
        ("王小@x.example", "email"),
        ("Anna.MUELLER-19@x.example", "email"),
        ("03/25/1980", "date"),
        ("1850-01-01", "date"),
        ("12.12.2150", "date"),
        ("2001:0DB8:85A3:0000:0000:8A2E:0370:7334", "ipv6"),
        ("2001:0db8:85a3:0000:0000:8a2e:0370:7334", "ipv6"),
    ],
)
def test_each_kind_keeps_its_format(text, kind):
    [(got, a, b, new)] = one(f"x {text}, y")
    assert (got, a, b) == (kind, 2, 2 + len(text))
    assert new != text
    [(again, _, _, _)] = one(f"x {new}, y")
    assert again == kind
    if kind not in ("ipv4",):
        shape = lambda s: "".join("0" if c.isdigit() else "x" if kind == "email" and c.isalpha() and c.islower() else "X" if kind == "email" and c.isalpha() else c for c in s)
        assert kind == "ipv6" or shape(new.partition("@")[0]) == shape(text.partition("@")[0])
        assert kind != "ipv6" or (len(new), new.isupper()) == (len(text), text.isupper())
    assert getattr(p, kind)(new, p.Inverse("k")) == text
    assert one(f"other {text}")[0][3] == new  # linked across documents
    assert one(f"x {text}", "another key")[0][3] != new


def test_checks():
    luhn = lambda s: p.luhn_digit(s[:-1]) == s[-1]
    assert luhn("4111111111111111") and luhn(p.card("4111111111111111", CIPHER)) and p.card("4111111111111112", CIPHER) is None
    assert one("1984-02-30") == one("13/32/1980") == one("256.1.1.1") == one("000-12-3456") == []
    assert one("12345678901234567890123") == one("GB83 WEST 1234 5698 7654 32") == one("a@b") == one("@x.com") == one("v1.2.3.4.5") == one("1234567890123456") == one("(123) 555-1234") == []
    days = {p.date((datetime.date(1990, 1, 1) + datetime.timedelta(k)).isoformat(), CIPHER) for k in range(500)}
    assert len(days) == 500


@pytest.mark.parametrize(
    "text, values",
    [
        ("card 4111 1111 1111 1111 123", ["4111 1111 1111 1111"]),
        ("4111111111111111 2 items", ["4111111111111111"]),
        ("12 4111111111111111", ["4111111111111111"]),
        ("1234 4111 1111 1111 1111 1234", ["4111 1111 1111 1111"]),
        ("4111-1111-1111-1111-123", ["4111-1111-1111-1111"]),
        ("4111 1111 1111 1111 5500 0000 0000 0004", ["4111 1111 1111 1111", "5500 0000 0000 0004"]),
        ("IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", ["DE89 3704 0044 0532 0130 00"]),
        ("DE89370400440532013000 EUR 500", ["DE89370400440532013000"]),
        ("DE89370400440532013000 2 Tage", ["DE89370400440532013000"]),
        ("NR12 DE89 3704 0044 0532 0130 00 GB82 WEST 1234 5698 7654 32", ["DE89 3704 0044 0532 0130 00", "GB82 WEST 1234 5698 7654 32"]),
    ],
)
def test_numbers_beside_other_numbers(text, values):
    assert [text[a:b] for _, a, b, _ in one(text)] == values


def test_case_links_and_long_local_parts_go_whole():
    lower, upper = p.email("anna.b@x.de", CIPHER), p.email("Anna.B@x.de", CIPHER)
    assert lower == upper.lower() and upper[0].isupper() and upper[5].isupper()
    long = "".join("abc.def9"[k % 8] for k in range(300)) + "@x.de"
    [(kind, a, b, new)] = one(f"to {long}.")
    assert (kind, a, b) == ("email", 3, 3 + len(long)) and p.email(new, p.Inverse("k")) == long
    assert sum(x != y for x, y in zip(new[:64], long)) > 30 and sum(x != y for x, y in zip(new[-70:], long[-70:])) > 30
    assert one("time 12:30:45 std::move a::b ::1 aa:bb:cc:dd:ee:ff") == []


def brute(text):
    """Every (start, end) that may be a card, IBAN, social security number, address or date: by plain loops over all spans of tokens."""
    tokens, at = [], 0
    for t in text.split(" "):
        tokens.append((at, at + len(t)))
        at += len(t) + 1
    spans = set()
    for i in range(len(tokens)):
        for j in range(i, min(i + 10, len(tokens))):
            a, b = tokens[i][0], tokens[j][1]
            part = text[a:b]
            solid = part.replace(" ", "")
            digits = [int(c) for c in solid if c.isdigit()]
            if solid.isdigit() and 13 <= len(solid) <= 19 and "  " not in part:
                total = sum(d if k % 2 == 0 else d * 2 - 9 * (d > 4) for k, d in enumerate(reversed(digits)))
                if total % 10 == 0:
                    spans.add((a, b))
            if 15 <= len(solid) <= 34 and solid.isalnum() and solid.isascii() and solid.upper() == solid and solid[:2].isalpha() and solid[2:4].isdigit():
                value = "".join(str("0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZ".index(c)) for c in solid[4:] + solid[:4])
                if int(value) % 97 == 1 and any(c.isdigit() for c in solid[4:]):
                    spans.add((a, b))
            if i == j:
                parts = part.split("-")
                if [len(x) for x in parts] == [3, 2, 4] and all(x.isdigit() for x in parts) and parts[0] not in ("000", "666") and parts[0] < "900" and parts[1] != "00" and parts[2] != "0000":
                    spans.add((a, b))
                parts = part.split(".")
                if len(parts) == 4 and all(x.isdigit() and str(int(x)) == x and int(x) < 256 for x in parts):
                    spans.add((a, b))
                for sep in "-/.":
                    parts = part.split(sep)
                    if all(x.isdigit() and x.isascii() for x in parts) and [len(x) for x in parts] in ([4, 2, 2], [2, 2, 4]):
                        y, *rest = parts if len(parts[0]) == 4 else reversed(parts)
                        for m, d in [rest] if len(parts[0]) == 4 else [rest, rest[::-1]]:
                            if int(y) and 1 <= int(m) <= 12 and 1 <= int(d) <= [31, 29 if int(y) % 4 == 0 and (int(y) % 100 or int(y) % 400 == 0) else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31][int(m) - 1]:
                                spans.add((a, b))
    return spans


def test_nothing_that_a_plain_search_finds_stays_in_clear(spark):
    """Values beside numbers and words of all kinds; and all documents. What is found overlaps what was replaced."""
    import random

    rng = random.Random(3)
    values = ["4111 1111 1111 1111", "5500000000000004", "3782 822463 10005", "DE89 3704 0044 0532 0130 00", "GB82WEST12345698765432", "FR14 2004 1010 0505 0001 3M02 606", "123-45-6789", "10.1.2.3", "1984-02-29", "29/02/1984", "03/25/1980", "12.11.1899"]
    beside = ["123", "AND", "5", "EUR", "word", "2024", "A1", "99 88", "x,", "(no", "CH", "0000", "7 8 9", "éa"]
    texts = [" ".join(rng.choice(values if k % 3 == 1 else beside) for k in range(rng.randrange(2, 9))) for _ in range(3000)]
    texts += [r.text or "" for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()]
    total = 0
    for text in texts:
        spans = p.find_pii(text, CIPHER)
        covered = bytearray(len(text))
        for _, a, b, _ in spans:
            covered[a:b] = b"\1" * (b - a)
        for a, b in brute(text):
            total += 1
            assert any(covered[a:b]), (text[a:b], text[max(0, a - 40) : b + 40])
    assert total > 3000


def test_query_equals_slow_replacement(spark):
    d = "/root/testdata/sf0.01"
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{d}/documents.parquet").collect()}
    got = p.op7_pii_pseudonyms(spark, d).collect()
    assert sorted(r.doc_id for r in got) == sorted(docs)
    cipher, total = p.Cipher(p.DEMO_KEY), 0
    for r in got:
        text, spans = docs[r.doc_id], [s.split(":") for s in r.spans.split(",") if s]
        for kind, a, b in reversed(spans):
            value = text[int(a) : int(b)]
            text = text[: int(a)] + getattr(p, kind)(value, cipher) + text[int(b) :]
            assert value not in r.text
        assert text == r.text
        total += len(spans)
    assert total > 40


def test_a_key_is_required(spark):
    with pytest.raises(TypeError):
        p.pseudonymise(spark.range(1))


def test_odd_rows(spark):
    rows = [(1, None), (2, ""), (None, "x 123-45-6789"), (3, "x 123-45-6789"), (3, "x 123-45-6789"), (4, "é@" * 100000 + " 1984-02-29"), (5, "a" * 200000 + "@b.com")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("spans", F.lit(1))
    got = p.pseudonymise(docs, key="k").collect()
    assert len(got) == len(rows)
    by = {}
    for r in got:
        by.setdefault(r.doc_id, []).append((len(r.spans), r.text))
    assert by[1] == by[2] == [(0, "")]
    assert by[3][0] == by[3][1] == by[None][0] and by[3][0][0] == 1
    assert by[4][0][0] == 1
    assert p.pseudonymise(docs.limit(0), key="k").collect() == []
