"""Quality classifier: a weak-label model over heuristic labellers, and a hashed linear scorer.

Overlapping labellers vote good, bad or nothing on each document. How the votes
combine is counted over all documents: there are at most 3 ** 8 combinations, so
the expectation-maximisation that estimates each labeller's accuracy and the share
of good documents needs one small table, whatever the corpus. Its posterior
labels of a bounded sample (``SAMPLE`` documents) train logistic regression on
hashed word and word-shape features; that scorer judges every whole text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import wordkit
from lodestore.llm.common import batch_of, id_text, map_arrow, read, scratch, step

#: Texts that the scorer is fitted on, at most; those of the smallest hashes.
SAMPLE = 2000
#: Hashed features, half for words and half for word shapes.
DIM = 2048
#: Words of a window in which repetition is measured, so that it does not change with the length of a text.
SPAN = 2000
#: Below a half: what little text a short document has should not cost it its place.
THRESHOLD = 0.35
#: Words from which on a labeller may vote bad: of fewer, a share says little.
FEW, SHORT, MEDIUM = 4, 20, 40
LABELLERS = ("symbols", "capitals", "repetition", "separators", "function_words", "sentences", "word_length", "stutter")
GOOD, BAD, NONE = 1, 0, 2

# Frequent function words of four languages.
FUNCTION_WORDS = (
    "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which one you were "
    "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer "
    "de la le et les des en un du une que est pour qui dans par plus pas au sur ne se ce il sont avec "
    "el los las que por con una su para al lo como más pero sus este entre cuando sin sobre también me hasta hay donde"
).split()
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[0x61:0x7B] = ord("a")
_CLASS[0x41:0x5B] = ord("A")
_CLASS[0x30:0x3A] = ord("0")
_CLASS[0x80:] = ord("a")


def _is(chars: bytes) -> np.ndarray:
    out = np.zeros(256, dtype=np.int64)
    out[list(chars)] = 1
    return out


_SYMBOL = _is(b"#*$%&|<>{}[]~^_=+\\@!")
_UPPER = _is(bytes(range(0x41, 0x5B)))
_LETTER = _is(bytes(range(0x41, 0x5B)) + bytes(range(0x61, 0x7B)) + bytes(range(0xC3, 0xC5)))
_STOP = _is(b".!?")
_BAR = _is(b"|\t;")
_POINT = np.ones(256, dtype=np.int64)
_POINT[0x80:0xC0] = 0
_POINT[wordkit.SPACES] = 0


def _sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return (total[at[1:]] - total[at[:-1]]).astype(np.float64)


def _function_hashes() -> np.ndarray:
    return np.unique(wordkit.split(pa.array([" ".join(FUNCTION_WORDS)])).hashes())


def _again(words: wordkit.Words, h: np.ndarray) -> np.ndarray:
    """1 for each word that is the same as the word before it in its text."""
    out = np.zeros(len(h), dtype=np.int64)
    out[1:] = (h[1:] == h[:-1]) & (words.doc[1:] == words.doc[:-1])
    return out


def _distinct(h: np.ndarray) -> float:
    """The share of distinct words in windows of SPAN words, the last of which ends with the text."""
    starts = [*range(0, len(h) - SPAN, SPAN), max(len(h) - SPAN, 0)]
    return sum(len(np.unique(h[a : a + SPAN])) for a in starts) / len(starts) / max(min(len(h), SPAN), 1)


def votes(column: pa.Array) -> np.ndarray:
    """A row of votes for each text, in the order of LABELLERS."""
    raw, at = wordkit.flat(column, lower=False)
    words = wordkit.split(column)
    h = words.hashes()
    n = np.diff(words.first).astype(np.float64)
    some = np.maximum(n, 1)
    known = _function_hashes()
    k = np.searchsorted(known, h)
    k[k == len(known)] = 0
    function = _sums((known[k] == h).astype(np.int64), words.first) / some if len(h) else np.zeros(len(n))
    distinct = np.array([_distinct(h[a:b]) for a, b in zip(words.first, words.first[1:])], dtype=np.float64)
    letters = np.maximum(_sums(_LETTER[raw], at), 1)
    points = _sums(_POINT[raw], at)
    ends = _sums(_STOP[raw], at)
    bars = _sums(_BAR[raw], at)

    def vote(value, good, bad):
        return np.where(bad(value) | (n == 0), BAD, np.where(good(value), GOOD, NONE))

    return np.stack(
        [
            vote(_sums(_SYMBOL[raw], at) / some, lambda v: v < 0.1, lambda v: v > 0.5),
            vote(_sums(_UPPER[raw], at) / letters, lambda v: v < 0.2, lambda v: v > 0.5),
            vote(distinct, lambda v: v > 0.3, lambda v: (v < 0.15) & (n > SHORT)),
            vote(bars / some, lambda v: v < 0.02, lambda v: v > 0.2),
            vote(function, lambda v: v > 0.15, lambda v: (v < 0.02) & (n > MEDIUM)),
            vote(ends / some, lambda v: (v > 0.02) & (v < 0.5), lambda v: (v < 0.003) & (n > MEDIUM)),
            vote(points / some, lambda v: (v > 3) & (v < 10), lambda v: (v < 2) | (v > 20)),
            vote(_sums(_again(words, h), words.first) / some, lambda v: (v < 0.05) & (n > 1), lambda v: (v > 0.15) & (n > FEW)),
        ],
        axis=1,
    )


class LabelModel:
    """Class-conditional vote rates of each labeller, by expectation-maximisation."""

    def __init__(self, patterns: np.ndarray, counts: np.ndarray, rounds: int = 100):
        m = patterns.shape[1] if len(patterns) else len(LABELLERS)
        self.prior = 0.5
        self.rate = np.ones((2, m, 3))  # an abstention says nothing: its rate is 1 for either class
        self.rate[:, :, :2] = 0.5
        if not len(patterns):
            return
        one_hot = np.eye(3)[patterns]  # pattern, labeller, vote
        good, bad = (patterns == GOOD).sum(axis=1), (patterns == BAD).sum(axis=1)
        post = np.clip((good + 0.5) / (good + bad + 1), 0.05, 0.95)  # the first guess: votes of equal weight
        total = counts.sum()
        for _ in range(rounds):
            weight = np.stack([(1 - post) * counts, post * counts])
            self.prior = float(np.clip(weight[1].sum() / total, 1e-3, 1 - 1e-3))
            rate = np.einsum("cp,pmv->cmv", weight, one_hot)[:, :, :2] + 1.0
            self.rate[:, :, :2] = rate / rate.sum(axis=2, keepdims=True)
            new = self.posterior(patterns)
            if np.abs(new - post).max() < 1e-9:
                break
            post = new

    def posterior(self, patterns: np.ndarray) -> np.ndarray:
        m = np.arange(patterns.shape[1])
        logs = np.log(self.rate[:, m, patterns]).sum(axis=2) + np.log([[1 - self.prior], [self.prior]])
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -500, 500)))

    def accuracies(self) -> dict[str, float]:
        """Of the documents that a labeller votes on, the share that it is right about."""
        right = self.prior * self.rate[1, :, GOOD] + (1 - self.prior) * self.rate[0, :, BAD]
        return dict(zip(LABELLERS, right.tolist()))


def features(column: pa.Array) -> np.ndarray:
    """Shares of hashed words, of words said twice over and of hashed word shapes of each text."""
    words = wordkit.split(column)
    raw, _ = wordkit.flat(column, lower=False)
    half = DIM // 2
    out = np.zeros((len(column), DIM), dtype=np.float32)
    if not len(words.start):
        return out
    h = words.hashes()
    bucket = (h >> np.uint64(40)).astype(np.int64) % (half - 1)
    bucket[_again(words, h) > 0] = half - 1  # a stutter is a feature of its own
    shape = half + (wordkit.hash_spans(_CLASS[raw], words.start, words.end) >> np.uint64(40)).astype(np.int64) % half
    row = words.doc * DIM
    flat = np.bincount(np.concatenate([row + bucket, row + shape]), minlength=len(column) * DIM).reshape(-1, DIM)
    # Square roots of shares: rare features still count, and every text has the same length.
    np.sqrt(flat / np.maximum(np.diff(words.first), 1)[:, None], out=out, casting="unsafe")
    return out


def fit_scorer(x: np.ndarray, y: np.ndarray, steps: int = 300, l2: float = 1e-4) -> np.ndarray:
    """Logistic regression on soft labels by accelerated gradient descent; the last weight is the bias."""
    x = np.concatenate([x.astype(np.float64), np.ones((len(x), 1))], axis=1)
    w = np.zeros(x.shape[1])
    if not len(x):
        return w
    step = 4.0 / (np.square(x).sum(axis=1).max() + 4 * l2)
    look, momentum = w.copy(), 1.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ look, -50, 50)))
        new = look - step * (x.T @ (p - y) / len(x) + l2 * look)
        following = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        look = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w


def classify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, threshold: float = THRESHOLD, carry: bool = False) -> DataFrame:
    """(doc_id, votes, posterior, score, kept): one row for each row of ``docs``, repeated rows included.

    ``votes`` has a digit for each of LABELLERS: 1 good, 0 bad, 2 none. ``posterior``
    is the label model's, ``score`` the linear scorer's; a document is kept if
    ``score`` reaches ``threshold``. With ``carry``, the whole row comes along as ``row``. A text without words, null or empty, has only
    bad votes and score 0. A null id stays null. Other columns are not looked at. An
    empty table gives no rows.
    """
    wide = id_text(docs, id_col, text_col, carry)
    docs = wide.select("text").withColumn("pick", F.xxhash64("text"))
    n_votes = len(LABELLERS)
    schema = pa.schema([("pick", pa.int64()), ("pattern", pa.int32())])
    powers = 3 ** np.arange(n_votes)

    def vote(batch: pa.RecordBatch) -> pa.RecordBatch:
        empty = np.diff(wordkit.split(batch.column(0)).first) == 0
        return batch_of(schema, pa.array(batch.column(1).to_numpy(), mask=empty), (votes(batch.column(0)) @ powers).astype(np.int32))

    with step():
        voted = scratch(map_arrow(docs, vote, "pick long, pattern int"))
        counted = voted.groupBy("pattern").agg(F.count("*").alias("n")).orderBy("pattern").collect()  # 3 ** 8 rows at most
        # Texts of the smallest hashes; copies share one and count once.
        picked = [r["pick"] for r in voted.where("pick IS NOT NULL").select("pick").distinct().orderBy("pick").limit(sample).collect()]
    digits = lambda code: code[:, None] // powers % 3
    code = np.array([r["pattern"] for r in counted], dtype=np.int64)
    model = LabelModel(digits(code), np.array([r["n"] for r in counted], dtype=np.float64))

    train_schema = pa.schema([("pick", pa.int64()), ("pattern", pa.int32()), ("x", pa.binary())])

    def train(batch: pa.RecordBatch) -> pa.RecordBatch:
        x = features(batch.column(0)).astype(np.float16)
        return batch_of(train_schema, batch.column(1), (votes(batch.column(0)) @ powers).astype(np.int32), [r.tobytes() for r in x])

    # A bound on the hash leaves the other texts at the scan: nothing is joined, and few texts are looked at again.
    chosen = docs.where(F.col("pick") <= F.lit(picked[-1] if picked else None).cast("long")).where(F.length("text") > 0)
    rows = map_arrow(chosen, train, "pick long, pattern int, x binary")
    rows = rows.groupBy("pick").agg(F.min(F.struct("pattern", "x")).alias("m")).select("pick", "m.pattern", "m.x").orderBy("pick").limit(sample).toArrow()
    x = np.frombuffer(b"".join(rows.column("x").to_pylist()), np.float16).reshape(-1, DIM)
    w = fit_scorer(x, model.posterior(digits(rows.column("pattern").to_numpy().astype(np.int64))))

    out_schema = pa.schema([("doc_id", pa.int64()), ("votes", pa.string()), ("posterior", pa.float64()), ("score", pa.float64())])

    def score(batch: pa.RecordBatch) -> pa.RecordBatch:
        v = votes(batch.column(1))
        s = 1 / (1 + np.exp(-np.clip(features(batch.column(1)) @ w[:-1] + w[-1], -50, 50)))
        s[np.diff(wordkit.split(batch.column(1)).first) == 0] = 0
        return batch_of(out_schema, batch.column(0), ["".join(map(str, r)) for r in v.tolist()], model.posterior(v), s)

    return map_arrow(wide, score, "doc_id long, votes string, posterior double, score double").withColumn("kept", F.col("score") >= threshold)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = classify(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "votes", F.round("posterior", 6).alias("posterior"), F.round("score", 6).alias("score"), "kept")


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
SQL: dict[str, str] = {}
