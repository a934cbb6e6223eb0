"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Cards, IBANs, social security and phone numbers, IPv4 and IPv6 addresses, dates and e-mail addresses.

What looks like personal data is validated (check digits, ranges), and its value
is permuted within its own format by a keyed Feistel network: equal values get
equal pseudonyms in every document, different values stay different, and a
pseudonym is valid in the same format. With the key, ``Cipher(key).invert``
brings a value back. Separators stay where they were.
"""

from __future__ import annotations

import datetime
import hashlib
import ipaddress
import re
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm.common import batch_of, id_text, map_arrow, read, texts

#: The key of the query alone, which must give the same rows each time; it is published, so it hides nothing.
DEMO_KEY = "lodestore-demo-key"
ROUNDS = 10

# Formats of numbers and dates. A candidate is not part of a longer run of letters or digits.
_EDGE_L, _EDGE_R = r"(?<![0-9A-Za-z])(?<![0-9][.\-/])", r"(?![0-9A-Za-z])(?![.\-/][0-9])"
#: Digits and separators in a row, of any length: readings of them may be cards.
CARD = re.compile(_EDGE_L + r"[0-9](?:[ -]?[0-9]){12,}" + _EDGE_R)
IBAN = re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]){11,30}(?![0-9A-Za-z])")
#: Cards as they are written: one number, or groups by one separator.
_CARD_FORM = re.compile(r"[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{4}(?:\1[0-9]{3})?|[0-9]{4}([ -])[0-9]{6}\2[0-9]{4,5}|[0-9]{4}([ -])[0-9]{3}\3[0-9]{3}\3[0-9]{3}")
SSN = re.compile(_EDGE_L + r"([0-9]{3})-([0-9]{2})-([0-9]{4})" + _EDGE_R)
PHONE = re.compile(r"(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9A-Za-z])|(?<![0-9A-Za-z+])\+[1-9][0-9](?:[ .()-]{0,2}[0-9]){7,12}(?![0-9A-Za-z])")
IPV4 = re.compile(_EDGE_L + r"(?:[0-9]{1,3}\.){3}[0-9]{1,3}" + _EDGE_R)
ISO_DATE = re.compile(_EDGE_L + r"([0-9]{4})([-/.])([0-9]{2})\2([0-9]{2})" + _EDGE_R)
DMY_DATE = re.compile(_EDGE_L + r"([0-9]{2})([-/.])([0-9]{2})\2([0-9]{4})" + _EDGE_R)
IPV6 = re.compile(r"(?<![0-9A-Za-z:.])(?=[0-9A-Fa-f]{0,4}:)[0-9A-Fa-f:]{2,39}(?![0-9A-Za-z:])(?!\.[0-9])")
DOMAIN = re.compile(r"@((?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24})")
_LOCAL_CHAR = re.compile(r"[\w.%+-]")
#: Alphabets whose letters are permuted among themselves in an address; letters of no alphabet stay.
_cased = lambda low, high: "".join(c for c in map(chr, range(low, high)) if c.islower() and len(c.upper()) == 1 and c.upper().lower() == c)
_ALPHABETS = ("0123456789", "abcdefghijklmnopqrstuvwxyz", _cased(0xDF, 0x250), _cased(0x430, 0x450), _cased(0x3B1, 0x3CA), "".join(map(chr, range(0x4E00, 0x9FA6))))
_PLACE = {c: (k, i) for k, alphabet in enumerate(_ALPHABETS) for i, c in enumerate(alphabet)}
#: Dates of these years are permuted among themselves, all others among all days of four digits.
_NEAR = (datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal())
_LAST_DAY = datetime.date.max.toordinal()
KINDS = ("email", "iban", "card", "ssn", "phone", "ipv6", "ipv4", "date")
_DIGITS = re.compile(r"[0-9]")
_GROUP = re.compile(r"[0-9]+")
_DOUBLED = bytes(sum(divmod((c - 48) * 2, 10)) if 48 <= c < 58 else 0 for c in range(256))


class Cipher:
    """A keyed permutation of range(n) for any n, different for each label."""

    back = False

    def __init__(self, key: str):
        self.key = hashlib.blake2b(key.encode(), digest_size=32).digest()
        self._memo: dict = {}

    def _round(self, label: str, k: int, half: int, size: int) -> int:
        data = f"{label}\0{k}\0{half}".encode()
        return int.from_bytes(hashlib.blake2b(data, digest_size=32, key=self.key).digest(), "big") % size

    def _walk(self, label: str, x: int, n: int, valid: Callable[[int], bool] | None, back: bool) -> int:
        bits = max(2, (n - 1).bit_length())
        low = bits // 2
        a, b = 1 << (bits - low), 1 << low  # sizes of the halves
        while True:  # cycle walking: stays inside range(n) and the valid values
            u, v = divmod(x, b)
            for k in reversed(range(ROUNDS)) if back else range(ROUNDS):
                sign = -1 if back else 1
                if k % 2 == 0:
                    u = (u + sign * self._round(label, k, v, a)) % a
                else:
                    v = (v + sign * self._round(label, k, u, b)) % b
            x = u * b + v
            if x < n and (valid is None or valid(x)):
                return x

    def permute(self, label: str, x: int, n: int, valid: Callable[[int], bool] | None = None) -> int:
        memo = (label, x, n)
        if memo not in self._memo:
            if len(self._memo) > 50_000:
                self._memo.clear()
            self._memo[memo] = self._walk(label, x, n, valid, self.back)
        return self._memo[memo]

    def invert(self, label: str, x: int, n: int, valid: Callable[[int], bool] | None = None) -> int:
        return self._walk(label, x, n, valid, not self.back)


class Inverse(Cipher):
    """In a Cipher's place, brings the values of pseudonyms back: card(card(text, Cipher(key)), Inverse(key)) is text."""

    back = True


def _fill(shape: str, digits: str) -> str:
    """``shape`` with its digits replaced, in order."""
    it = iter(digits)
    return _DIGITS.sub(lambda _: next(it), shape)


def luhn_digit(body: str) -> str:
    total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 == 0 else int(c) for k, c in enumerate(reversed(body)))
    return str(-total % 10)


def _iban_checks(body: str, country: str) -> str:
    number = int("".join(str(int(c, 36)) for c in body + country + "00"))
    return f"{98 - number % 97:02d}"


def card(text: str, cipher: Cipher) -> str | None:
    d = "".join(_DIGITS.findall(text))
    if not 13 <= len(d) <= 19 or luhn_digit(d[:-1]) != d[-1]:
        return None
    body = f"{cipher.permute(f'card{len(d)}', int(d[:-1]), 10 ** (len(d) - 1)):0{len(d) - 1}d}"
    return _fill(text, body + luhn_digit(body))


def iban(text: str, cipher: Cipher) -> str | None:
    s = text.replace(" ", "")
    country, body = s[:2], s[4:]
    if not 15 <= len(s) <= 34 or _iban_checks(body, country) != s[2:4]:
        return None
    digits = "".join(_DIGITS.findall(body))
    if not digits:
        return None
    new = _fill(body, f"{cipher.permute(f'iban{country}{len(digits)}', int(digits), 10 ** len(digits)):0{len(digits)}d}")
    it = iter(country + _iban_checks(new, country) + new)
    return "".join(c if c == " " else next(it) for c in text)


def _ssn_ok(x: int) -> bool:
    area, group, serial = x // 10**6, x // 10**4 % 100, x % 10**4
    return area not in (0, 666) and area < 900 and group > 0 and serial > 0


def ssn(text: str, cipher: Cipher) -> str | None:
    x = int(text.replace("-", ""))
    return _fill(text, f"{cipher.permute('ssn', x, 10**9, _ssn_ok):09d}") if _ssn_ok(x) else None


def _phone_ok(x: int) -> bool:
    return x // 10**9 >= 2 and x // 10**6 % 10 >= 2


def phone(text: str, cipher: Cipher) -> str | None:
    d = "".join(_DIGITS.findall(text))
    national = not text.startswith("+") or text.startswith("+1") and len(d) == 11
    if national:
        head, rest = d[:-10], d[-10:]
        if len(d) not in (10, 11) or head not in ("", "1"):
            return None
        x = int(rest)
        return _fill(text, head + f"{cipher.permute('phone', x, 10**10, _phone_ok):010d}") if _phone_ok(x) else None
    if not 9 <= len(d) <= 15:
        return None
    head, rest = d[:2], d[2:]
    return _fill(text, head + f"{cipher.permute(f'phone{head}{len(rest)}', int(rest), 10 ** len(rest)):0{len(rest)}d}")


def ipv4(text: str, cipher: Cipher) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    x = cipher.permute("ipv4", int.from_bytes(bytes(parts), "big"), 1 << 32)
    return str(ipaddress.IPv4Address(x))


def ipv6(text: str, cipher: Cipher) -> str | None:
    """An address in full or shortened form becomes one in full form, of lower or upper case as it was."""
    try:
        x = int(ipaddress.IPv6Address(text))
    except ValueError:
        return None
    if len([g for g in text.split(":") if g]) < 3:  # loopback, and names like a::b in code
        return None
    new = ipaddress.IPv6Address(cipher.permute("ipv6", x, 1 << 128)).exploded
    return new.upper() if text.upper() == text and text.lower() != text else new


def _day(year: str, month: str, day: str) -> int | None:
    try:
        return datetime.date(int(year), int(month), int(day)).toordinal()
    except ValueError:
        return None


def _other_day(at: int, label: str, cipher: Cipher, valid: Callable[[int], bool] | None = None) -> datetime.date:
    low, high = _NEAR
    if low <= at < high:
        new = low + cipher.permute(label, at - low, high - low, valid and (lambda x: valid(low + x)))
    else:  # of any other year: days outside of the near ones, in order
        far = lambda x: x + 1 if x + 1 < low else x + 1 + high - low
        x = at - 1 if at < low else at - 1 - (high - low)
        new = far(cipher.permute(f"{label}-far", x, _LAST_DAY - (high - low), valid and (lambda y: valid(far(y)))))
    return datetime.date.fromordinal(new)


def date(text: str, cipher: Cipher) -> str | None:
    """Year first, day first, or month first where the day cannot be a month; the order stays what it was.

    A date that can only be month-first becomes one of its kind: its pseudonym's day is above 12 too.
    """
    m = ISO_DATE.fullmatch(text)
    if m:
        at = _day(m[1], m[3], m[4])
        if at is None:
            return None
        new = _other_day(at, "date", cipher)
        return f"{new.year:04d}{m[2]}{new.month:02d}{m[2]}{new.day:02d}"
    m = DMY_DATE.fullmatch(text)
    at = _day(m[4], m[3], m[1])
    if at is not None:
        new = _other_day(at, "date", cipher)
        return f"{new.day:02d}{m[2]}{new.month:02d}{m[2]}{new.year:04d}"
    at = _day(m[4], m[1], m[3])
    if at is None:
        return None
    new = _other_day(at, "date-month-first", cipher, lambda x: datetime.date.fromordinal(x).day > 12)
    return f"{new.month:02d}{m[2]}{new.day:02d}{m[2]}{new.year:04d}"


#: Letters and digits that one permutation takes; longer local parts are permuted a block at a time, each under the ones before it.
_BLOCK = 64


def email(text: str, cipher: Cipher) -> str | None:
    """The local part's letters and digits are permuted among strings of its shape: case and signs stay in place."""
    local, _, domain = text.rpartition("@")
    lower = "".join(c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in local)
    kept = [_PLACE[c] for c in lower if c in _PLACE]
    if not kept:
        return None
    out: list[str] = []
    before = ""  # of the pseudonym so far
    for a in range(0, len(kept), _BLOCK):
        block, x, n = kept[a : a + _BLOCK], 0, 1
        for k, i in block:
            x, n = x * len(_ALPHABETS[k]) + i, n * len(_ALPHABETS[k])
        x, new = cipher.permute(f"email{before}{''.join(str(k) for k, _ in block)}", x, n), []
        for k, _ in reversed(block):
            x, i = divmod(x, len(_ALPHABETS[k]))
            new.append(_ALPHABETS[k][i])
        out += reversed(new)
        shown = "".join(_ALPHABETS[k][i] for k, i in block) if cipher.back else "".join(reversed(new))
        before = hashlib.blake2b((before + shown).encode(), digest_size=8).hexdigest()
    it = iter(out)
    return "".join((y.upper() if c != old and len(y.upper()) == 1 else y) if (y := next(it) if c in _PLACE else c) else "" for c, old in zip(lower, local)) + "@" + domain


def emails(text: str, cipher: Cipher) -> list[tuple[int, int, str]]:
    """All of the local part, however long, is replaced."""
    out, at, done = [], text.find("@"), 0
    while at >= 0:
        m = DOMAIN.match(text, at)
        if m:
            low = at
            while low > done and _LOCAL_CHAR.match(text, low - 1):
                low -= 1
            while low < at and not text[low].isalnum():
                low += 1
            new = email(text[low : m.end()], cipher) if low < at else None
            if new is not None:
                out.append((low, m.end(), new))
                done = m.end()
            else:
                done = at + 1
        at = text.find("@", at + 1)
    return out


def _luhn_holds(digits: bytes) -> bool:
    other = digits[-2::-2]
    return (sum(digits[-1::-2]) - 48 * (len(digits) - len(other)) + sum(other.translate(_DOUBLED))) % 10 == 0


def cards(text: str, cipher: Cipher) -> list[tuple[int, int, str]]:
    """Valid readings of whole groups of digits; those in the form of cards first, then the first and longest."""
    out = []
    for m in CARD.finditer(text):
        at, groups = m.start(), [g.span() for g in _GROUP.finditer(m[0])]
        digits = "".join(_GROUP.findall(m[0])).encode()
        found, first = [], 0
        for i, (a, b) in enumerate(groups):
            last = first
            for x, y in groups[i : i + 19]:
                last += y - x
                if last - first > 19:
                    break
                if last - first >= 13 and _luhn_holds(digits[first:last]):
                    found.append((not _CARD_FORM.fullmatch(text, at + a, at + y), a, -y))
            first += b - a
        taken = bytearray(len(m[0]))
        for _, a, b in sorted(found):
            if not any(taken[a:-b]):
                taken[a:-b] = b"\1" * (-b - a)
                out.append((at + a, at - b, card(text[at + a : at - b], cipher)))
    return out


def ibans(text: str, cipher: Cipher) -> list[tuple[int, int, str]]:
    """At each word that may begin one, the longest valid reading that ends with a word."""
    out, at = [], 0
    while m := IBAN.search(text, at):
        a, b = m.span()
        at = a + 1
        while b > a:
            new = iban(text[a:b], cipher)
            if new is not None:
                out.append((a, b, new))
                at = b
                break
            b = text.rfind(" ", a, b)
    return out


def _each(pattern: re.Pattern, make: Callable[[str, Cipher], str | None]) -> Callable[[str, Cipher], list[tuple[int, int, str]]]:
    return lambda text, cipher: [(*m.span(), new) for m in pattern.finditer(text) if (new := make(m[0], cipher)) is not None]


_NUMBERS = (("iban", ibans), ("card", cards), ("ssn", _each(SSN, ssn)), ("phone", _each(PHONE, phone)), ("ipv6", _each(IPV6, ipv6)), ("ipv4", _each(IPV4, ipv4)), ("date", _each(ISO_DATE, date)), ("date", _each(DMY_DATE, date)))
_ANY_DIGIT = re.compile(r"[0-9]|::")


def find_pii(text: str, cipher: Cipher) -> list[tuple[str, int, int, str]]:
    """(kind, start, end, pseudonym) by start; no two overlap."""
    found = [("email", *x) for x in emails(text, cipher)]
    if _ANY_DIGIT.search(text):
        for kind, find in _NUMBERS:
            found += [(kind, *x) for x in find(text, cipher)]
    out, end = [], 0
    for k in sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), -x[2])):
        if k[1] >= end:
            out.append(k)
            end = k[2]
    return out


def replaced(text: str, spans: list[tuple[str, int, int, str]]) -> str:
    out, at = [], 0
    for _, a, b, new in spans:
        out += [text[at:a], new]
        at = b
    return "".join(out) + text[at:]


def pseudonymise(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", *, key: str) -> DataFrame:
    """(doc_id, spans, text): one row for each row of ``docs``, repeated rows included.

    ``key`` is secret: who has it can bring the values back.

    ``spans`` is an array of (kind, start, end, pseudonym) in code points of the old
    text, end exclusive, none overlapping; of two that overlap the one that starts
    first stays, and of one start the kind listed first. A null or empty text has no
    spans and an empty ``text``; a null id stays null; an empty table gives no rows.
    Other columns are not looked at.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("pseudonym", pa.string())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("text", pa.string())])
    cache: dict[str, Cipher] = {}

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        cipher = cache.setdefault(key, Cipher(key))
        all_texts = texts(batch.column(1))
        found = [find_pii(t, cipher) for t in all_texts]
        rows = [[dict(zip(("kind", "start", "end", "pseudonym"), s)) for s in x] for x in found]
        return batch_of(schema, batch.column(0), rows, [replaced(t, s) if s else t for t, s in zip(all_texts, found)])

    return map_arrow(id_text(docs, id_col, text_col), one, "doc_id long, spans array<struct<kind string, start long, end long, pseudonym string>>, text string")


def op7_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by kind, the spans and the new text."""
    out = pseudonymise(read(spark, sf_dir, "documents"), key=DEMO_KEY)
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    shown = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",").alias("spans")
    return out.select("doc_id", *[count(k) for k in KINDS], shown, "text")


QUERIES = {"op7_pii_pseudonyms": op7_pii_pseudonyms}
SQL: dict[str, str] = {}
