"""Quality rules on documents and, by shrunken failure rates, on their hosts.

Each text is measured and held against the rules on its own. Failures are then
counted by host (``source``); the hosts' rates are shrunk towards the overall one
with a beta prior whose two numbers come from all hosts' counts (method of
moments). A host whose shrunken rate passes ``HOST_LIMIT`` fails as a whole, and
that verdict is joined back to its documents.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import wordkit
from lodestore.llm.common import batch_of, map_arrow, read, scratch, texts

WINDOW = 5
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
#: A host fails if more than this share of its documents is expected to fail.
HOST_LIMIT = 0.5
_SYMBOL = np.zeros(256, dtype=np.int64)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = 1
_POINT = np.ones(256, dtype=np.int64)  # 1 for the first byte of a code point that is in a word
_POINT[0x80:0xC0] = 0
_POINT[wordkit.SPACES] = 0
MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[at[1:]] - total[at[:-1]]


def repeated_words(h: np.ndarray, width: int = WINDOW) -> int:
    """Words inside a ``width``-word window that the text holds twice or more, the first place included."""
    if len(h) < width + 1:
        return 0
    win = wordkit.shingles(h, width)
    _, inverse, count = np.unique(win, return_inverse=True, return_counts=True)
    hit = np.flatnonzero(count[inverse] > 1)
    if not len(hit):
        return 0
    step = np.zeros(len(h) + 1, dtype=np.int64)
    np.add.at(step, hit, 1)
    np.add.at(step, hit + width, -1)
    return int((np.cumsum(step)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    lines = [x for x in text.split("\n") if x.strip(" \t\v\f\r")]
    return len(lines) - len(set(lines))


def measure(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """(doc_id, host, the five MEASURES): one row for each row of ``docs``; a null text has no words."""
    schema = pa.schema([("doc_id", pa.int64()), ("host", pa.string()), *[(m, pa.int64()) for m in MEASURES]])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        words = wordkit.split(batch.column(2), lower=False)
        data, at = wordkit.flat(batch.column(2), lower=False)
        h = words.hashes()
        spans = list(zip(words.first, words.first[1:]))
        return batch_of(
            schema, batch.column(0), batch.column(1), np.diff(words.first), _sums(_POINT[data], at), _sums(_SYMBOL[data], at),
            [repeated_lines(t) for t in texts(batch.column(2))], [repeated_words(h[a:b]) for a, b in spans],
        )

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).cast("string").alias("host"), F.col(text_col).cast("string").alias("text"))
    return map_arrow(rows, one, "doc_id long, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def host_verdicts(measured: DataFrame, limit: float = HOST_LIMIT) -> DataFrame:
    """(host, n_docs, n_failed, host_rate, host_failed). Only three sums reach the driver."""
    hosts = measured.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed"))
    n, k, hosts_n = hosts.agg(F.sum("n_docs"), F.sum("n_failed"), F.count("*")).first()
    mean = (k or 0) / n if n else 0.0
    alpha, beta = 1.0, 1.0
    if n and 0 < mean < 1 and hosts_n > 1:
        spread = hosts.agg(F.sum(F.col("n_docs") * (F.col("n_failed") / F.col("n_docs") - mean) ** 2), F.sum(F.col("n_docs") * F.col("n_docs"))).first()
        chance = mean * (1 - mean)
        # E[spread] = chance * ((hosts - 1) * (1 - rho) + rho * (n - sum n^2 / n)) with rho = 1 / (alpha + beta + 1)
        free = n - spread[1] / n - (hosts_n - 1)
        rho = (spread[0] / chance - (hosts_n - 1)) / free if free > 0 else 0.0
        strength = 1 / min(max(rho, 1e-6), 0.5) - 1
        alpha, beta = mean * strength, (1 - mean) * strength
    rate = (F.col("n_failed") + F.lit(alpha)) / (F.col("n_docs") + F.lit(alpha + beta))
    return hosts.withColumn("host_rate", rate).withColumn("host_failed", rate > limit)


def apply_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", limit: float = HOST_LIMIT) -> DataFrame:
    """(doc_id, MEASURES, base_failed, host_rate, host_failed, kept): one row for each row of ``docs``.

    A null host is no host: such rows have a null rate and are judged alone. A null
    or empty text has no words and fails. Repeated rows count as often as they
    stand. A host whose rate equals the limit stays. An empty table gives no rows.
    """
    measured = scratch(measure(docs, id_col, text_col, host_col).withColumn("base_failed", base_failed()))
    verdicts = host_verdicts(measured, limit).select("host", "host_rate", "host_failed")
    joined = measured.join(verdicts, "host", "left")
    failed = F.coalesce("host_failed", F.lit(False))
    return joined.select("doc_id", *MEASURES, "base_failed", "host_rate", failed.alias("host_failed"), (~F.col("base_failed") & ~failed).alias("kept"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply_rules(read(spark, sf_dir, "documents"))
    return out.select("doc_id", *MEASURES, "base_failed", "kept", "host_failed")


QUERIES = {"op8_quality_rules": op8_quality_rules}
SQL = {
    "op8_quality_rules": r"""
WITH words AS (
  SELECT doc_id, source, text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
win AS (
  SELECT doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') AS g
  FROM words, unnest(range(1, len(w) - 3)) AS t(i)),
hit AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM hit, unnest(range(0, 5)) AS t(k) GROUP BY doc_id),
line AS (
  SELECT doc_id, count(*) - count(DISTINCT x) AS n
  FROM words, unnest(string_split(coalesce(text, ''), chr(10))) AS t(x)
  WHERE regexp_matches(x, '[^\x20\x09-\x0D]') GROUP BY doc_id),
m AS (
  SELECT doc_id, source, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(coalesce(text, ''), '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(line.n, 0) AS BIGINT) AS n_dup_lines, CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words
  FROM words LEFT JOIN line USING (doc_id) LEFT JOIN rep USING (doc_id)),
b AS (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*) AS n, count(*) FILTER (base_failed) AS k FROM b WHERE source IS NOT NULL GROUP BY source),
t AS (SELECT sum(n) AS n, sum(k) AS k, count(*) AS hosts, sum(k) / sum(n) AS mean FROM h),
s AS (SELECT sum(h.n * (h.k / h.n - t.mean) ** 2) AS spread, sum(h.n * h.n) AS squares FROM h, t),
r AS (
  SELECT mean, mean > 0 AND mean < 1 AND hosts > 1 AS usable,
    1 / least(greatest((spread / (mean * (1 - mean)) - (hosts - 1)) / (n - squares / n - (hosts - 1)), 1e-6), 0.5) - 1 AS strength
  FROM t, s),
v AS (
  SELECT source, CASE WHEN usable THEN (k + mean * strength) / (n + strength) ELSE (k + 1.0) / (n + 2.0) END > 0.5 AS host_failed FROM h, r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT coalesce(host_failed, FALSE) AS kept, coalesce(host_failed, FALSE) AS host_failed
FROM b LEFT JOIN v USING (source)
"""
}
