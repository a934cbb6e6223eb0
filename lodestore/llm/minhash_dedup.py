"""Near-duplicate groups by an inverted join over MinHash signature coordinates.

Each distinct shingle set gets ``COORDS`` MinHash values. Two sets of the wanted
similarity agree in at least ``MATCHES`` of them but for a chance below 1e-8, so
they share one of the ``COORDS - MATCHES + 1`` coordinate-value pairs that come
first in any common order of pairs. Pairs are ordered from rare to frequent, as
counted over all documents; only that prefix is posted, and the frequent rest is
skipped while merging and only looked up when a candidate's matches are counted.

Posting lists are not expanded into all pairs. Each member is first joined to the
list's smallest member; confirmed links make components; then, in blocks, members
outside a list's largest component are compared with those of other components.
No link between components can be lost by this, a group of n copies costs about n
links, and no step puts out a row for each pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import wordkit
from lodestore.llm.common import batch_of, id_text, map_arrow, read, scratch, step, string_parts
from lodestore.llm.components import connected_components

COORDS = 64
#: Six standard deviations below the 51 matches expected at similarity 0.8.
MATCHES = 32
#: Members of a posting list that one task compares at a time, with at most four times as many outsiders, and
#: about how many bytes the sets of either may have.
BLOCK = 1024
BLOCK_BYTES = 32 << 20
#: Classes of more than this share of all rows, and of so many rows, are joined by themselves: there are at most 1 / HOT_SHARE.
HOT_SHARE, HOT_ROWS = 0.001, 10_000
#: What a row is in its block. In a list of one block, a row is both.
OUTSIDER, MEMBER, BOTH = 1, 2, 3

_rng = np.random.default_rng(20240229)
_MUL = (_rng.integers(0, 1 << 32, COORDS, dtype=np.uint64) | np.uint64(1)).astype(np.uint32)
_XOR = _rng.integers(0, 1 << 32, COORDS, dtype=np.uint64).astype(np.uint32)


def shingle_sets(column: pa.Array, width: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    words = wordkit.split(column)
    h = words.hashes()
    return [np.unique(wordkit.shingles(h[a:b], width)) for a, b in zip(words.first, words.first[1:])]


def signature(hashes: np.ndarray) -> np.ndarray:
    """For each coordinate's permutation 32 bits of the shingle that comes first.

    The bits are the shingle's own, not the permutation's smallest values: those crowd
    near zero, and texts of many shingles would agree by chance.
    """
    high, own = (hashes >> np.uint64(32)).astype(np.uint32), hashes.astype(np.uint32)
    best, out = np.full(COORDS, 0xFFFFFFFF, dtype=np.uint32), np.zeros(COORDS, dtype=np.uint32)
    for k in range(0, len(high), 2048):
        v = (high[None, k : k + 2048] ^ _XOR[:, None]) * _MUL[:, None]
        v ^= v >> np.uint32(15)
        at = v.argmin(axis=1)
        low = v[np.arange(COORDS), at]
        better = (low < best) | (k == 0)
        best[better], out[better] = low[better], own[k + at][better]
    return out


def set_key(hashes: np.ndarray) -> bytes | None:
    """Names a shingle set; None for the empty one."""
    return hashlib.blake2b(hashes.tobytes(), digest_size=16).digest() if len(hashes) else None


def _signed(docs: DataFrame, width: int) -> DataFrame:
    schema = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("set_key", pa.binary()), ("sig", pa.binary())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(1), width)
        return batch_of(schema, batch.column(0), [len(s) for s in sets], [set_key(s) for s in sets], [signature(s).tobytes() if len(s) else None for s in sets])

    return map_arrow(docs, one, "doc_id long, n_shingles long, set_key binary, sig binary")


def _matrix(column: pa.Array) -> np.ndarray:
    raw, off, _ = string_parts(column)
    return raw[off[0] : off[0] + 4 * COORDS * len(column)].view(np.uint32).reshape(-1, COORDS)


def _postings(reps: DataFrame) -> DataFrame:
    """(key, rep) for the rarest coordinate-value pairs of each set, as far as another set has them too.

    A pair's frequency is counted over all sets. Pairs of one set are rarest of all
    and come first in each prefix, but post nothing; they only use up its places.
    """
    schema = pa.schema([("key", pa.int64()), ("rep", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        pair = (np.arange(COORDS, dtype=np.uint64) << np.uint64(32)) | _matrix(batch.column(1))
        return batch_of(schema, pair.ravel().astype(np.int64), np.repeat(batch.column(0).to_numpy(), COORDS))

    with step() as keep:
        pairs = map_arrow(reps.select("rep", "sig"), one, "key long, rep long")
        shared = pairs.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
        many = scratch(pairs.join(shared, "key"))
        ranked = many.selectExpr("key", "rep", "row_number() OVER (PARTITION BY rep ORDER BY n, key) AS place", "count(*) OVER (PARTITION BY rep) AS shared")
        return keep(scratch(ranked.where(F.col("place") + COORDS - F.col("shared") <= COORDS - MATCHES + 1).select("key", "rep")))


def _may_link(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of ``n`` and ``m`` shingles can be similar enough at all: no intersection is larger than the smaller set."""
    return 100 * np.minimum(n, m) >= percent * np.maximum(n, m)


def _agreeing(pairs: DataFrame, reps: DataFrame, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose sizes allow a link and whose signatures agree in ``MATCHES`` coordinates or more."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        hit = (_matrix(batch.column(2)) == _matrix(batch.column(3))).sum(axis=1) >= MATCHES
        hit &= _may_link(batch.column(4).to_numpy(), batch.column(5).to_numpy(), percent)
        return batch_of(schema, batch.column(0).filter(pa.array(hit)), batch.column(1).filter(pa.array(hit)))

    left = reps.select(F.col("rep").alias("a"), F.col("sig").alias("sig_a"), F.col("n_shingles").alias("n_a"))
    right = reps.select(F.col("rep").alias("b"), F.col("sig").alias("sig_b"), F.col("n_shingles").alias("n_b"))
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "sig_a", "sig_b", "n_a", "n_b"), one, "a long, b long").distinct()


def _sets(docs: DataFrame, classes: DataFrame, nodes: DataFrame, width: int) -> DataFrame:
    """(node, items) with the whole shingle sets of the classes ``nodes`` (rep).

    Texts are taken by id alone, as one id may stand in many classes; of rows of one id with other texts the sets
    have other names. What is wanted is written first: with its size known before a join starts, Spark shuffles
    neither texts nor sets to a side that it can broadcast. Sets are brought together by class only if rows repeat.
    """
    schema = pa.schema([("set_key", pa.binary()), ("items", pa.binary())])

    def as_set(batch: pa.RecordBatch) -> pa.RecordBatch:
        sets = shingle_sets(batch.column(0), width)
        once = {set_key(s): s.tobytes() for s in sets}
        return batch_of(schema, list(once), list(once.values()))

    wanted = scratch(classes.join(nodes, "rep").select(F.col("least").alias("doc_id"), F.col("rep").alias("node"), "set_key"))
    sets = map_arrow(docs.join(wanted, "doc_id", "left_semi").select("text"), as_set, "set_key binary, items binary")
    sets = scratch(sets.join(wanted.select("node", "set_key"), "set_key").select("node", "items"))
    if sets.groupBy("node").count().where("count > 1").isEmpty():
        return sets
    return scratch(sets.dropDuplicates(["node"]))


def _confirmed(pairs: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Those of ``pairs`` (a, b) whose whole shingle sets are similar enough."""
    schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        keep = []
        for x, y in zip(batch.column(2), batch.column(3)):
            p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
            both = len(np.intersect1d(p, q, assume_unique=True))
            keep.append(100 * both >= percent * (len(p) + len(q) - both))
        return batch_of(schema, batch.column(0).filter(pa.array(keep)), batch.column(1).filter(pa.array(keep)))

    sets = _sets(docs, classes, pairs.select(F.explode(F.array("a", "b")).alias("rep")).distinct(), width)
    left, right = sets.toDF("a", "items_a"), sets.toDF("b", "items_b")
    return map_arrow(pairs.join(left, "a").join(right, "b").select("a", "b", "items_a", "items_b"), one, "a long, b long")


def _blocks(members: DataFrame) -> DataFrame:
    """Rows of ``members`` dealt to (hub, lb, rb): outsiders of a group's largest component meet its every member once.

    Of the members, about ``BLOCK`` fall into one task together with about ``4 * BLOCK``
    outsiders at most, and fewer of long texts (``BLOCK_BYTES``), however large the group is.
    """
    sizes = members.groupBy("hub", "component").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("w"))
    groups = sizes.groupBy("hub").agg(F.max_by(F.struct("component", "w"), F.struct("n", "component")).alias("major"), F.sum("n").alias("n"), F.max("n").alias("top"), F.count("*").alias("parts"), F.sum("w").alias("w")).where("parts > 1")
    blocks = lambda n, most, w: f"cast(greatest(ceil(({n}) / {most}), ceil(8 * ({w}) / {BLOCK_BYTES})) AS int)"
    groups = groups.selectExpr("hub", "major.component AS major", f"{blocks('n', BLOCK, 'w')} AS nb", f"{blocks('n - top', 4 * BLOCK, 'w - major.w')} AS mb")
    # Written first: joined to an aggregate, a hub with a third of all members could not be split.
    dealt = members.join(scratch(groups), "hub")
    rest = ["major", *(c for c in members.columns if c != "hub")]
    own = lambda n: f"cast(pmod(xxhash64(rep), {n}) AS int)"
    place = lambda lb, rb, part: f"named_struct('lb', {lb}, 'rb', {rb}, 'part', {part})"
    left = f"transform(IF(component <> major, sequence(0, nb - 1), array()), k -> {place(own('mb'), 'k', OUTSIDER)})"
    right = f"transform(sequence(0, mb - 1), k -> {place('k', own('nb'), MEMBER)})"
    places = f"explode(IF(nb = 1 AND mb = 1, array({place('0', '0', BOTH)}), concat({left}, {right}))) AS at"
    placed = dealt.selectExpr("hub", places, *rest).selectExpr("hub", "at.*", *rest)
    # Dealt anew: rows that are dealt by hub would keep all blocks of a hub in one task.
    return placed.repartition("hub", "lb", "rb")


def _outer_pairs(t: pa.Table, percent: int):
    """For each outsider of a block: its row, and the rows of other components that may be linked to it by size and signature, best first."""
    sig = _matrix(t.column("sig").combine_chunks())
    rep, part, hub, n = (t.column(c).to_numpy() for c in ("rep", "component", "hub", "n_shingles"))
    role, minor = t.column("part").to_numpy(), part != t.column("major").to_numpy()
    members = np.flatnonzero((role != OUTSIDER) & (rep != hub))
    for u in np.flatnonzero((role != MEMBER) & minor & (rep != hub)):
        v = members[(part[members] != part[u]) & (~minor[members] | (rep[members] > rep[u]))]
        agree = (sig[v] == sig[u]).sum(axis=1)
        near = (agree >= MATCHES) & _may_link(n[v], n[u], percent)
        if near.any():
            yield u, v[near][np.argsort(-agree[near], kind="stable")]


def _missed(posted: DataFrame, lists: DataFrame, found: DataFrame, reps: DataFrame, docs: DataFrame, classes: DataFrame, width: int, percent: int) -> DataFrame:
    """Confirmed links (a, b) between components whose members share a list, one for each member and component.

    Lists are taken together by their hub, so that a member comes once. Inside a
    block outsiders and members are compared by signature, and only those that
    agree with some member of another component fetch their shingle sets.
    """
    groups = posted.join(lists, "key").groupBy("hub", "rep").agg(F.max("n").alias("n"))
    members = groups.join(found, F.col("rep") == F.col("node"), "left").select("hub", "rep", F.coalesce("component", "rep").alias("component"))
    members = scratch(members.join(reps, "rep"))
    near_schema = pa.schema([("hub", pa.int64()), ("rep", pa.int64())])
    link_schema = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def near(t: pa.Table) -> pa.Table:
        rows = {int(k) for u, v in _outer_pairs(t, percent) for k in (u, *v)}
        rep = t.column("rep").to_numpy()
        reps_of = np.unique(rep[sorted(rows)]) if rows else np.zeros(0, np.int64)
        return pa.Table.from_arrays([pa.array(np.full(len(reps_of), t.column("hub")[0].as_py())), pa.array(reps_of)], schema=near_schema)

    def links(t: pa.Table) -> pa.Table:
        rep, part = t.column("rep").to_numpy(), t.column("component").to_numpy()
        sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in t.column("items").combine_chunks()]
        out = []
        for u, v in _outer_pairs(t, percent):
            mine, k = sets[u], 0
            while len(v):
                if k and k % 8 == 0 or k == len(v):  # leave what is linked already
                    v, k = v[k:], 0
                    continue
                other = sets[v[k]]
                both = len(np.intersect1d(mine, other, assume_unique=True))
                if 100 * both >= percent * (len(mine) + len(other) - both):
                    out.append((int(rep[u]), int(rep[v[k]])))
                    v, k = v[k + 1 :][part[v[k + 1 :]] != part[v[k]]], 0
                else:
                    k += 1
        return pa.Table.from_arrays([pa.array([x[j] for x in out], pa.int64()) for j in (0, 1)], schema=link_schema)

    wanted = scratch(_blocks(members).groupBy("hub", "lb", "rb").applyInArrow(near, "hub long, rep long").distinct())
    sets = _sets(docs, classes, wanted.select("rep").distinct(), width).toDF("rep", "items")
    full = members.join(wanted, ["hub", "rep"]).join(sets, "rep").select("hub", "rep", "component", "n_shingles", "sig", "items")
    return _blocks(scratch(full)).groupBy("hub", "lb", "rb").applyInArrow(links, "a long, b long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept): one row for each row of ``docs``.

    ``component_id`` is the smallest id that can be reached over links of Jaccard
    similarity ``percent`` / 100 or more between sets of ``width``-word shingles.
    Texts without words (null, empty, white space) link to nothing. Rows that
    repeat an id and a text are one group, and all say ``kept``; rows with one id
    and different texts are treated as documents of their own. A null id takes no
    part and has a null component, kept. An empty table gives no rows.
    """
    docs = id_text(docs, id_col, text_col)
    with step() as keep:
        signed = keep(scratch(_signed(docs, width)))
        linked = signed.where("set_key IS NOT NULL AND doc_id IS NOT NULL")
        # Classes are numbered by themselves: an id may stand in several. Written, the numbers stay what they are. They follow
        # the ids, as texts that others were made from tend to come first, and then more members are linked to their hub.
        one = linked.groupBy("set_key").agg(F.min(F.struct("doc_id", "n_shingles", "sig")).alias("m"), F.count("*").alias("rows"))
        one = one.select("set_key", "rows", F.col("m.doc_id").alias("least"), F.col("m.n_shingles").alias("n_shingles"), F.col("m.sig").alias("sig"))
        one = one.repartitionByRange("least", "set_key").sortWithinPartitions("least", "set_key")
        classes = scratch(one.withColumn("rep", F.monotonically_increasing_id()))
        reps = classes.select("rep", "n_shingles", "sig")
        names = classes.select("rep", "set_key", "least")
        posted = _postings(reps)
        lists = scratch(posted.groupBy("key").agg(F.min("rep").alias("hub"), F.count("*").alias("n")).where("n > 1"))
        with step() as hold:
            star = posted.join(lists, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
            edges = hold(scratch(_confirmed(scratch(_agreeing(star, reps, percent)), docs, names, width, percent)))
        found = connected_components(edges)
        with step() as hold:
            more = hold(scratch(_missed(posted, lists, found, reps, docs, names, width, percent)))
        if not more.isEmpty():
            found = connected_components(edges.union(more))

        in_group = found.join(classes.select("rep", "least"), F.col("node") == F.col("rep")).select("rep", "least", "component")
        smallest = in_group.groupBy("component").agg(F.min("least").alias("component_id"))
        of_rep = in_group.join(smallest, "component").select("rep", "component_id")
        labelled = classes.select("rep", "set_key", "rows", "least").join(of_rep, "rep", "left")
        label = keep(scratch(labelled.select("set_key", "rows", F.coalesce("component_id", "least").alias("component_id"))))

    # Rows without a set go round the join, and rows of the few hottest classes take their label by a broadcast.
    hot = max(HOT_ROWS, int(signed.count() * HOT_SHARE))
    few = F.broadcast(label.where(F.col("rows") > hot).select("set_key", "component_id"))
    rows = linked.select("doc_id", "n_shingles", "set_key")
    parts = [
        signed.where("set_key IS NULL OR doc_id IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")),
        rows.join(few, "set_key").select("doc_id", "n_shingles", "component_id"),
        rows.join(few.select("set_key"), "set_key", "left_anti").join(label.where(F.col("rows") <= hot), "set_key").select("doc_id", "n_shingles", "component_id"),
    ]
    out = parts[0].unionByName(parts[1]).unionByName(parts[2])
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op2_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"), width=2)


QUERIES = {"op2_minhash_dedup": op2_minhash_dedup}
SQL = {
    "op2_minhash_dedup": r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS g
  FROM d, unnest(range(1, greatest(len(w), 2))) AS t(i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s AS a JOIN s AS b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM c JOIN n AS x ON x.doc_id = a JOIN n AS y ON y.doc_id = b WHERE 100 * k >= 80 * (x.n + y.n - k)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
reach AS (SELECT doc_id, doc_id AS other FROM d UNION SELECT reach.doc_id, both_ways.b FROM reach JOIN both_ways ON reach.other = both_ways.a),
least_id AS (SELECT doc_id, min(other) AS component_id FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n, 0) AS n_shingles, component_id, doc_id = component_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN least_id USING (doc_id)
"""
}
