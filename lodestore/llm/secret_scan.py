"""Secret scans: sure patterns, and weak candidates that multipart linking makes sure.

A credential often has parts: an identifier (key id, user, account), a secret and
an endpoint. The sure patterns (``BASE``) are always reported. Beside them, weak
candidates of the three kinds are gathered, widened by ``REACH`` code points to
either side, and interval-joined inside scopes (paragraphs, which blank lines
part). A weak secret is reported if its interval meets an identifier's, a weak
identifier or endpoint if its interval meets a secret's of a credential that has
an identifier: parts alone say nothing and are left out.

A scope never reaches past its row, so the join is a sorted sweep inside the row:
no shuffle, memory in proportion to one text.
"""

from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_right
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lodestore.llm.common import batch_of, id_text, map_arrow, read, texts

# The sure patterns, in the order in which spans of one start are listed.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
_ASSIGN_WORDS = ("passw", "secret", "token", "apikey", "api_key")

#: Code points that a part's interval is widened by.
REACH = 200
# Names that identifiers and endpoints are given under.
ID_NAMES = "client_?id|access_?key_?id|key_?id|account(?:_?id)?|user(?:_?name)?|login|app_?id"
END_NAMES = "host|endpoint|server|base_?url|bucket"
IDENTIFIER = re.compile(rf"""(?:{ID_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9@._+-]{{3,}}""", re.I | re.A)
ENDPOINT = re.compile(rf"""(?:[a-z][a-z0-9+]{{1,15}}://[^\s"'<>]+)|(?:(?:{END_NAMES})["']?\x20*[:=]\x20*["']?[A-Za-z0-9._:/-]{{4,}})""", re.I | re.A)
SECRET = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}(?![A-Za-z0-9+/_-])")
SCOPE = re.compile(r"\n[\x20\t\r]*\n")
_IDENTIFIER_WORDS = ("client", "key", "account", "user", "login", "app_id", "appid")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the sure patterns, by start and then kind."""
    low = text.lower()
    found = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", m.start(), m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(found, key=_order)


def _order(span: tuple[str, int, int]):
    return span[1], KINDS.index(span[0]), span[2]


def _random(token: str) -> bool:
    """Letters and digits together, and 3 bits or more a character: unlike a word or a number."""
    if not (any(c.isdigit() for c in token) and any(c.isalpha() for c in token)):
        return False
    n = len(token)
    return -sum(k / n * math.log2(k / n) for k in Counter(token).values()) >= 3.0


def _meets(spans: list[tuple[int, int]], others: list[tuple[int, int]], reach: int) -> list[bool]:
    """For each span, whether one of ``others`` is at most ``reach`` away. A join of intervals by sorted ends."""
    others = sorted(others)
    starts = [a for a, _ in others]
    furthest = []  # the largest end so far
    for _, b in others:
        furthest.append(max(b, furthest[-1]) if furthest else b)
    out = []
    for a, b in spans:
        k = bisect_right(starts, b + reach)
        out.append(bool(k) and furthest[k - 1] >= a - reach)
    return out


def _inside(spans: list[tuple[int, int]], covers: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Those of ``spans`` that touch none of ``covers``."""
    return [s for s, hit in zip(spans, _meets(spans, [(a, b - 1) for a, b in covers], 0)) if not hit] if covers else spans


def linked_spans(text: str, base: list[tuple[str, int, int]], reach: int = REACH) -> list[tuple[str, int, int]]:
    """Weak candidates whose complementary parts co-occur within ``reach`` in one scope."""
    low = text.lower()
    if not ("akia" in low or any(w in low for w in _IDENTIFIER_WORDS)):
        return []
    taken = [(a, b) for _, a, b in base]
    weak_id = _inside([m.span() for m in IDENTIFIER.finditer(text)], taken)
    sure_id = [(a, b) for k, a, b in base if k == "access"]
    if not (weak_id or sure_id):
        return []
    ends = [m.span() for m in ENDPOINT.finditer(text)]
    weak_secret = [m.span() for m in SECRET.finditer(text) if _random(m[0])]
    weak_secret = _inside(_inside(weak_secret, taken), weak_id + ends)
    ends = _inside(_inside(ends, taken), weak_id)
    sure_secret = [(a, b) for k, a, b in base if k != "access"]

    cuts = [m.start() for m in SCOPE.finditer(text)]
    scopes: dict[int, tuple[list, list, list, list, list]] = {}
    for k, spans in enumerate((weak_id, sure_id, weak_secret, sure_secret, ends)):
        for s in spans:
            scopes.setdefault(bisect_right(cuts, s[0]), ([], [], [], [], []))[k].append(s)
    found = []
    for ids, sure_ids, secrets, sure_secrets, points in scopes.values():
        linked = [s for s, hit in zip(secrets, _meets(secrets, ids + sure_ids, reach)) if hit]
        sure = [s for s, hit in zip(sure_secrets, _meets(sure_secrets, ids + sure_ids, reach)) if hit]
        found += [("secret", *s) for s in linked]
        found += [("identifier", *s) for s, hit in zip(ids, _meets(ids, linked + sure, reach)) if hit]
        found += [("endpoint", *s) for s, hit in zip(points, _meets(points, linked + sure, reach)) if hit]
    return found


def find_secrets(text: str, reach: int = REACH) -> list[tuple[str, int, int]]:
    base = base_spans(text)
    return sorted(base + linked_spans(text, base, reach), key=_order)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redact(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with every stretch that spans cover replaced by the kind of its first span."""
    out, at = [], 0
    for kind, a, b in spans:
        if a >= at:
            out += [text[at:a], f"[{kind}]"]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = REACH, carry: bool = False) -> DataFrame:
    """(doc_id, spans, redacted): one row for each row of ``docs``, repeated rows included.

    ``spans`` is an array of (kind, start, end) in code points, end exclusive.
    A null or empty text has no spans and an empty ``redacted``; a null id stays null.
    An empty table gives no rows. Other columns are not looked at; with ``carry``, the
    whole row comes along as ``row``.
    """
    span = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    schema = pa.schema([("doc_id", pa.int64()), ("spans", pa.list_(span)), ("redacted", pa.string())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_texts = texts(batch.column(1))
        found = [find_secrets(t, reach) for t in all_texts]
        rows = [[{"kind": k, "start": a, "end": b} for k, a, b in s] for s in found]
        return batch_of(schema, batch.column(0), rows, [redact(t, s) if s else t for t, s in zip(all_texts, found)])

    return map_arrow(id_text(docs, id_col, text_col, carry), one, "doc_id long, spans array<struct<kind string, start long, end long>>, redacted string")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string()), ("n_linked", pa.int64())])

    def digest(batch: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for spans in batch.column(1).to_pylist():
            s = [(x["kind"], x["start"], x["end"]) for x in spans]
            base = [x for x in s if x[0] in KINDS[:3]]
            n = Counter(k for k, _, _ in s)
            rows.append((n["assign"], n["access"], n["hex"], hashlib.sha256(joined(base).encode()).hexdigest(), joined(s), len(s) - len(base)))
        return batch_of(schema, batch.column(0), *zip(*rows))

    found = scan_secrets(read(spark, sf_dir, "documents")).select("doc_id", "spans")
    return map_arrow(found, digest, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_linked long")


def _sql() -> str:
    """The same in SQL. A pattern's spans are found from its matches and from what stands between them."""
    either = lambda names: re.sub("[a-z]", lambda m: f"[{m[0].upper()}{m[0]}]", names)  # noqa: E731  letters of ASCII alone, in either case
    assign_names = either("password|passwd|secret|token|api_?key")
    patterns = {
        "assign": rf"""(?:{assign_names})["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9+/_.=-]+""",
        "access": "AKIA[A-Z0-9]+",
        "hex": "[0-9a-f]{24,}",
        "identifier": rf"""(?:{either(ID_NAMES)})["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9@._+-]{{3,}}""",
        "secret": "[A-Za-z0-9+/_-]{16,}",
        "endpoint": rf"""(?:[A-Za-z][A-Za-z0-9+]{{1,15}}://[^\t\n\x0B\f\r "\'<>]+)|(?:(?:{either(END_NAMES)})["\']?\x20*[:=]\x20*["\']?[A-Za-z0-9._:/-]{{4,}})""",
        "scope": r"\n[\x20\t\r]*\n",
    }
    quoted = lambda p: p.replace("\\'", "''")
    raw = " UNION ALL ".join(
        f"SELECT doc_id, '{kind}' AS kind, m[k] AS m, CAST(list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS a "
        f"FROM (SELECT doc_id, regexp_extract_all(t, '{quoted(p)}') AS m, string_split_regex(t, '{quoted(p)}') AS g FROM d), unnest(range(1, len(m) + 1)) AS u(k)"
        for kind, p in patterns.items()
    )
    touching = lambda other: f"NOT EXISTS (SELECT 1 FROM {other} AS o WHERE o.doc_id = s.doc_id AND o.a <= s.b AND o.b > s.a)"
    meets = lambda other: f"EXISTS (SELECT 1 FROM {other} AS o WHERE o.doc_id = s.doc_id AND o.scope = s.scope AND o.a <= s.b + {REACH} AND o.b >= s.a - {REACH})"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
raw AS MATERIALIZED (SELECT *, a + length(m) AS b FROM ({raw})),
base AS (
  SELECT doc_id, kind, a, b FROM raw
  WHERE kind = 'assign' AND length(regexp_extract(m, '[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) >= 6 OR kind = 'access' AND length(m) >= 20 OR kind = 'hex'),
ids0 AS (SELECT * FROM raw AS s WHERE kind = 'identifier' AND {touching('base')}),
ends0 AS (SELECT * FROM raw WHERE kind = 'endpoint'),
random AS (
  SELECT doc_id, m, a, b FROM (SELECT *, unnest(string_split(m, '')) AS c FROM raw WHERE kind = 'secret' AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]'))
  GROUP BY doc_id, m, a, b HAVING round(entropy(c), 9) >= 3),
placed AS (
  SELECT s.*, (SELECT count(*) FROM raw AS r WHERE r.doc_id = s.doc_id AND r.kind = 'scope' AND r.a <= s.a) AS scope
  FROM (
    SELECT doc_id, 'identifier' AS kind, a, b FROM ids0
    UNION ALL SELECT doc_id, 'sure id', a, b FROM base WHERE kind = 'access'
    UNION ALL SELECT doc_id, 'sure secret', a, b FROM base WHERE kind <> 'access'
    UNION ALL SELECT doc_id, 'secret', a, b FROM random AS s WHERE {touching('base')} AND {touching('ids0')} AND {touching('ends0')}
    UNION ALL SELECT doc_id, 'endpoint', a, b FROM ends0 AS s WHERE {touching('base')} AND {touching('ids0')}) AS s),
anyid AS (SELECT * FROM placed WHERE kind IN ('identifier', 'sure id')),
linked AS (SELECT * FROM placed AS s WHERE kind IN ('secret', 'sure secret') AND {meets('anyid')}),
more AS (
  SELECT doc_id, kind, a, b FROM linked WHERE kind = 'secret'
  UNION ALL SELECT doc_id, kind, a, b FROM placed AS s WHERE kind IN ('identifier', 'endpoint') AND {meets('linked')}),
every AS (
  SELECT *, list_position(['assign', 'access', 'hex', 'identifier', 'secret', 'endpoint'], kind) AS r, kind || ':' || CAST(a AS VARCHAR) || ':' || CAST(b AS VARCHAR) AS s
  FROM (SELECT * FROM base UNION ALL SELECT * FROM more)),
n AS (
  SELECT doc_id, count(*) FILTER (r = 1) AS n_assign, count(*) FILTER (r = 2) AS n_access, count(*) FILTER (r = 3) AS n_hex, count(*) FILTER (r > 3) AS n_linked,
    string_agg(s, ',' ORDER BY a, r, b) FILTER (r <= 3) AS base, string_agg(s, ',' ORDER BY a, r, b) AS spans
  FROM every GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_linked, 0) AS n_linked
FROM d LEFT JOIN n USING (doc_id)
"""


QUERIES = {"op1_secret_scan": op1_secret_scan}
SQL = {"op1_secret_scan": _sql()}
