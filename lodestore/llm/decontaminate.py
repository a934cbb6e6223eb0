"""Benchmark decontamination by size-partitioned MinHash containment search.

A test item of n shingles stands in a document if the document holds at least
``percent`` of them. Items are partitioned by size, in powers of two, and a partition's largest
size gives its bound: the most shingles that an item of it may lack. That bound sets the length of
the partition's signatures, bottom-k MinHashes of its items, twice the bound and ``MORE``; and each item's
threshold, the number of signature values that a document must hold whatever it lacks, which is
above the bound. Documents are classed by their size too: they are held only against partitions with
an item that they are long enough for. Every shingle of a document, however long, is held against a
partition's signatures at once, and pairs that reach their threshold are verified by counting exactly
which of the item's shingles the document has. No item that it contains is missed.

Only the benchmark is broadcast, in blocks of at most ``BLOCK_BYTES`` of text; a
larger one takes more steps over each row, ``CHAIN`` blocks a job. No document is
shuffled.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import wordkit
from lodestore.llm.common import batch_of, id_text, map_arrow, read, scratch

WIDTH = 5
PERCENT = 80
#: Bytes of benchmark text in one broadcast block.
BLOCK_BYTES = 8 << 20
#: Blocks that one job takes; more are taken in turn.
CHAIN = 4


#: Signature values beyond what a partition's bound needs.
MORE = 4


class Partition:
    """Items of 2^p to 2^(p+1) - 1 shingles: signatures to probe, thresholds, and sets to verify with."""

    def __init__(self, items: list[tuple[int | None, np.ndarray]], percent: int):
        self.ids = [i for i, _ in items]
        self.sets = [s for _, s in items]
        most = (1 << len(self.sets[0]).bit_length()) - 1
        self.bound = most * (100 - percent) // 100  # shingles that an item may lack
        length = 2 * self.bound + MORE
        size = np.array([len(s) for s in self.sets])
        self.need = -(-size * percent // 100)
        self.least = int(self.need.min())  # shorter documents hold none of them
        self.threshold = np.minimum(size, length) - (size - self.need)
        self.value = np.concatenate([s[:length] for s in self.sets])  # sets are sorted: the least hashes come first
        self.owner = np.repeat(np.arange(len(items)), np.minimum(size, length))
        order = np.argsort(self.value, kind="stable")
        self.value, self.owner = self.value[order], self.owner[order]
        self.bits = np.zeros(1 << 16, dtype=bool)  # a first, cheap filter on 16 bits of the hash
        self.bits[(self.value >> np.uint64(20)).astype(np.int64) & 0xFFFF] = True

    def probe(self, h: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(document, item) pairs whose shared signature values reach the item's threshold."""
        maybe = np.flatnonzero(self.bits[(h >> np.uint64(20)).astype(np.int64) & 0xFFFF])
        low, high = np.searchsorted(self.value, h[maybe], "left"), np.searchsorted(self.value, h[maybe], "right")
        n = high - low
        if not n.any():
            return []
        k = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        at = np.repeat(doc[maybe], n) * len(self.value) + k
        at = np.unique(at)  # a value that a document repeats counts once
        pair, count = np.unique(at // len(self.value) * len(self.ids) + self.owner[at % len(self.value)], return_counts=True)
        d, item = pair // len(self.ids), pair % len(self.ids)
        hit = count >= self.threshold[item]
        return list(zip(d[hit].tolist(), item[hit].tolist()))


def _held(own: np.ndarray, wanted: np.ndarray) -> int:
    """How many of ``wanted`` are in ``own``, which is sorted."""
    k = np.searchsorted(own, wanted)
    k[k == len(own)] = 0
    return int((own[k] == wanted).sum())


def item_sets(rows: list[tuple[int | None, str | None]], width: int) -> dict[int, list[tuple[int, np.ndarray]]]:
    """By shingle width: items and their sorted distinct shingle hashes. Items of fewer words use their own length."""
    out = defaultdict(list)
    w = wordkit.split(pa.array([t or "" for _, t in rows], pa.string()))
    h = w.hashes()
    for (item, _), a, b in zip(rows, w.first, w.first[1:]):
        if b > a:
            out[min(width, int(b - a))].append((item, np.unique(wordkit.shingles(h[a:b], width))))
    return out


def partitions(items: list[tuple[int, np.ndarray]], percent: int) -> list[Partition]:
    by_size = defaultdict(list)
    for item in items:
        by_size[len(item[1]).bit_length()].append(item)
    return [Partition(x, percent) for _, x in sorted(by_size.items())]


def _windows(h: np.ndarray, first: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all runs of ``width`` words inside one text, and their texts."""
    if len(h) < width:
        return h[:0], np.zeros(0, np.int64)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    whole = doc[: len(h) - width + 1] == doc[width - 1 :]
    return wordkit.shingles(h, width)[whole], doc[: len(h) - width + 1][whole]


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list[tuple[int, str]], bool]]:
    """The benchmark's rows in blocks of bounded size, and whether a block is the last; at most two are on the driver."""
    before, block, size = None, [], 0
    for r in benchmark.withColumn("size", F.coalesce(F.octet_length("text"), F.lit(0))).toLocalIterator():
        block.append((r["item_id"], r["text"]))
        size += r["size"]
        if size >= BLOCK_BYTES:
            if before is not None:
                yield before, False
            before, block, size = block, [], 0
    if before is not None:
        yield before, not block
    if block or before is None:
        yield block, True


def find_items(docs: DataFrame, block: list[tuple[int, str]], width: int, percent: int, last: bool) -> DataFrame:
    """``docs`` (doc_id, text, item_ids, containments) with the items of one block added; after the last without text."""
    parts = {w: partitions(items, percent) for w, items in item_sets(block, width).items()}
    kinds = [("doc_id", pa.int64()), ("text", pa.string()), ("item_ids", pa.list_(pa.int64())), ("containments", pa.list_(pa.float64()))]
    schema = pa.schema([k for k in kinds if not (last and k[0] == "text")])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        w = wordkit.split(batch.column(1))
        h = w.hashes()
        found = [dict(zip(a, b)) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
        n_words = np.diff(w.first)
        for wide, many in parts.items():
            grams, doc = _windows(h, w.first, wide)
            own: dict[int, np.ndarray] = {}  # the sorted shingles of documents with a candidate
            for part in many:
                long = n_words - wide + 1 >= part.least
                some = slice(None) if long.all() else long[doc]
                for d, k in part.probe(grams[some], doc[some]):
                    if d not in own:
                        a, b = np.searchsorted(doc, [d, d + 1])
                        own[d] = np.sort(grams[a:b])
                    n = _held(own[d], part.sets[k])
                    if n >= part.need[k]:
                        found[d][part.ids[k]] = max(found[d].get(part.ids[k], 0.0), n / len(part.sets[k]))
        found = [sorted(x.items(), key=lambda y: (y[0] is None, y[0])) for x in found]
        return batch_of(schema, batch.column(0), *([] if last else [batch.column(1)]), [[i for i, _ in x] for x in found], [[c for _, c in x] for x in found])

    return map_arrow(docs, one, ", ".join(["doc_id long"] + ["text string"] * (not last) + ["item_ids array<long>", "containments array<double>"]))


def decontaminate(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, percent: int = PERCENT, carry: bool = False) -> DataFrame:
    """(doc_id, item_ids, containments, kept): one row for each row of ``docs``.

    ``benchmark`` has item_id and text. ``item_ids`` are the items of whose distinct ``width``-word shingles the
    document holds ``percent`` in a hundred or more, in order, each id once, with its greatest share in
    ``containments`` (of an id with several rows each is an item); a document with any is not kept. Items of
    fewer words are one shingle, to be found anywhere. Items without words, null or
    empty, are in no document; null texts hold nothing. Null ids are passed on.
    Empty tables give no rows, or nothing found. Other columns are not looked at; with
    ``carry``, the whole row comes along as ``row``.
    """
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    docs = id_text(docs, id_col, text_col, carry)
    rest = ["row"] if carry else []
    out = docs.select("doc_id", "text", F.array().cast("array<long>").alias("item_ids"), F.array().cast("array<double>").alias("containments"), *rest)
    for k, (block, last) in enumerate(_blocks(items)):
        out = find_items(out, block, width, percent, last)
        if not last and k % CHAIN == CHAIN - 1:
            out = scratch(out)  # lets the blocks so far go
    return out.withColumn("kept", F.size("item_ids") == 0)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return out.select("doc_id", F.size("item_ids").cast("long").alias("n_items"), F.array_join(F.col("item_ids").cast("array<string>"), ",").alias("item_ids"), F.coalesce(F.round(F.array_max("containments"), 6), F.lit(0.0)).alias("max_containment"), "kept")


QUERIES = {"op6_decontaminate": op6_decontaminate}
SQL = {
    "op6_decontaminate": r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
b AS (
  SELECT item_id, w, least(5, len(w)) AS wide
  FROM (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM benchmark)
  WHERE len(w) > 0),
bs AS (SELECT DISTINCT item_id, wide, array_to_string(list_slice(w, i, i + wide - 1), ' ') AS g FROM b, unnest(range(1, len(w) - wide + 2)) AS t(i)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id),
ds AS (
  SELECT DISTINCT doc_id, wide, array_to_string(list_slice(w, i, i + wide - 1), ' ') AS g
  FROM d, (SELECT DISTINCT wide FROM b) AS x, unnest(range(1, len(w) - wide + 2)) AS t(i)),
hit AS (SELECT doc_id, item_id, count(*) AS k FROM ds JOIN bs USING (wide, g) GROUP BY doc_id, item_id),
ok AS (SELECT doc_id, item_id, k / n AS c FROM hit JOIN bn USING (item_id) WHERE 100 * k >= 80 * n),
agg AS (SELECT doc_id, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS ids, max(c) AS c FROM ok GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0) AS n_items, coalesce(ids, '') AS item_ids, round(coalesce(c, 0.0), 6) AS max_containment, n IS NULL AS kept
FROM d LEFT JOIN agg USING (doc_id)
"""
}
