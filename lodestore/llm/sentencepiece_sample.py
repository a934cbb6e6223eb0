"""SentencePiece encoding, decoding and sampling without replacement.

A text is a chain of words, each with a lattice of vocabulary pieces; characters
that no piece covers fall back to byte pieces, so that every text can be decoded
exactly. Pieces get unigram log weights, and a segmentation's probability is in
proportion to the product of its pieces'.

``sample`` draws the Gumbel top-k: k distinct segmentations without replacement. An
A* search walks the lattice from the left. The perturbed score of a prefix is the
greatest perturbed score of the segmentations that begin with it; since the mass
behind every lattice state is known exactly (backward sums), a prefix's score can
be drawn before its segmentations are: the best child inherits its parent's, and
the rest of the children, taken together, get a Gumbel truncated at it. The search
pops the best open group, splits off the child that attains its score and walks
on to a leaf; popped leaves come in order. Open groups whose upper bound cannot reach
the frontier are never drawn. Inclusion scores use the (k+1)-th score as threshold.

All random numbers are hashes of the row's key, the draw and the place in the text:
results do not depend on how rows are dealt. The lattices of the distinct words
of a slice are built with numpy, and all words are walked at once.
"""

from __future__ import annotations

import heapq
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestore.llm import wordkit
from lodestore.llm.common import batch_of, id_text, map_arrow, read, texts

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Segmentations for each text.
SAMPLES = 3
SPACE, MARK, NEWLINE = 0x20, 0x2581, 0x0A
#: A group whose log mass lies further below zero is not drawn unless the frontier sinks that low; no draw of 32 bits lifts a group by more than LIFT.
CUT, LIFT = -32.0, 23.0
#: Log mass of a character, near enough, and the length up to which a word's mass is summed in units of it.
_UNIT, _LONG, _LEAST = 2.0, 100, 1e-250
_U = np.uint64
_BASE = _U(0x100000001B3)
_SLOTS = 19


@dataclass
class Vocabulary:
    """Pieces by id with log weights; ``byte_ids`` are the pieces of the 256 bytes, or empty."""

    pieces: list[str]
    weights: np.ndarray
    usable: np.ndarray
    byte_ids: np.ndarray

    @classmethod
    def load(cls, path: str = MODEL, temperature: float = 1.0) -> Vocabulary:
        """A merge-ranked model has ranks for scores: weights are Zipf's, 1 / (rank + 2), over all pieces."""
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        plain = np.array([not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i)) for i in range(n)])
        byte = {int(sp.id_to_piece(i)[1:-1], 16): i for i in range(n) if sp.is_byte(i)}
        score = np.array([sp.get_score(i) for i in range(n)])
        rank = np.where(plain, -score, n)
        weight = -np.log(rank + 2.0)
        weight = (weight - np.log(np.exp(weight[plain]).sum())) / temperature
        return cls([sp.id_to_piece(i) for i in range(n)], weight, plain, np.array([byte[b] for b in range(256)]))

    def __post_init__(self):
        """Every prefix of a piece, by hash: a place in a word is extended no further than some piece goes."""
        ids = [i for i in np.flatnonzero(self.usable).tolist() if self.pieces[i] and chr(MARK) not in self.pieces[i].lstrip(chr(MARK))]
        node: dict[int, int] = {}
        for i in ids:
            x = 0
            for c in self.pieces[i].replace(chr(MARK), " "):
                x = (x * int(_BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
                node.setdefault(x, -1)
            node[x] = i
        self.longest = max((len(self.pieces[i]) for i in ids), default=1)
        self.keys, self.ids = np.array(list(node), dtype=np.uint64), np.array(list(node.values()), dtype=np.int32)
        slot = self._slot(self.keys)
        self.table = np.full(1 << _SLOTS, -1, dtype=np.int32)
        self.table[slot] = np.arange(len(slot))
        late = np.flatnonzero(self.table[slot] != np.arange(len(slot)))  # share a slot with another
        self.late = late[np.argsort(self.keys[late])].astype(np.int32)
        self.late_keys = self.keys[self.late]
        self.weights32 = np.append(np.where(self.usable, self.weights, -np.inf), -np.inf).astype(np.float32)
        self.data = [p.replace(chr(MARK), " ").encode() for p in self.pieces]
        for i in np.flatnonzero(~self.usable).tolist():
            self.data[i] = b""
        for b, i in enumerate(self.byte_ids.tolist()):
            self.data[i] = bytes([b])
        size = np.array([len(x) for x in self.data])
        self.flat, self.flat_size, self.flat_at = np.frombuffer(b"".join(self.data), np.uint8), size, np.cumsum(size) - size

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h * _U(0x9E3779B97F4A7C15)) >> _U(64 - _SLOTS)).astype(np.int64)

    def look_up(self, h: np.ndarray) -> np.ndarray:
        """Index among the prefixes, or -1."""
        at = self.table[self._slot(h)]
        hit = np.flatnonzero(at >= 0)
        wrong = hit[self.keys[at[hit]] != h[hit]]
        at[wrong] = -1
        if len(self.late) and len(wrong):
            k = np.searchsorted(self.late_keys, h[wrong])
            k[k == len(self.late_keys)] = 0
            same = self.late_keys[k] == h[wrong]
            at[wrong[same]] = self.late[k[same]]
        return at

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """The bytes of many ids, one after another."""
        size = self.flat_size[ids]
        ends = np.cumsum(size)
        return self.flat[np.repeat(self.flat_at[ids] - ends + size, size) + np.arange(ends[-1] if len(ends) else 0)]

    def decode(self, ids: np.ndarray) -> str:
        """The text that ``ids`` were made from: one leading space is the encoder's."""
        raw = self.spell(ids).tobytes().decode("utf-8", "replace")
        return raw[1:] if raw.startswith(" ") else raw


class Lattice:
    """The lattices of the distinct words of some texts. A state is a place in a distinct word."""

    def __init__(self, all_texts: list[str], vocabulary: Vocabulary):
        self.v = vocabulary
        # One leading space for each text, as the encoder adds it; an empty text has no words.
        raw = "".join(" " + t if t else "" for t in all_texts).encode("utf-32-le", "surrogatepass")
        self.chars = np.frombuffer(raw, dtype="<u4")
        n = len(self.chars)
        self.doc_at = np.concatenate([[0], np.cumsum([len(t) + 1 if t else 0 for t in all_texts])]).astype(np.int64)
        space, line = self.chars == SPACE, self.chars == NEWLINE
        begin = np.zeros(n, dtype=bool)
        if n:
            begin[1:] = (space[1:] & ~space[:-1]) | line[1:] | line[:-1]
            begin[self.doc_at[:-1][np.diff(self.doc_at) > 0]] = True
        self.word_at = np.flatnonzero(begin)
        self.word_end = np.concatenate([self.word_at[1:], [n]]).astype(np.int64) if n else self.word_at
        size = self.word_end - self.word_at
        h = wordkit.hash_spans(np.frombuffer(raw, dtype=np.uint8), self.word_at * 4, self.word_end * 4)
        _, first, kind = np.unique(h, return_index=True, return_inverse=True)
        kind_size = size[first]
        kind_at = np.cumsum(kind_size) - kind_size
        place = np.arange(int(kind_size.sum())) - np.repeat(kind_at, kind_size)
        self.cp = self.chars[np.repeat(self.word_at[first], kind_size) + place]
        self.left = (np.repeat(kind_size, kind_size) - place).astype(np.int32)  # characters to the word's end
        hits = self._edges()
        self._cut(hits)
        # States are numbered from words' ends to their beginnings, so that those of one distance lie together.
        key = self.left.astype(np.uint16) if len(self.left) and self.left.max() < 1 << 16 else self.left
        self.order = np.argsort(key, kind="stable")
        self.rank = np.empty(len(self.order), dtype=np.int32)
        self.rank[self.order] = np.arange(len(self.order), dtype=np.int32)
        sorted_left = self.left[self.order]
        cuts = np.searchsorted(sorted_left, np.arange(1, (int(sorted_left[-1]) if len(sorted_left) else 0) + 2))
        self.by_left = [(r + 1, int(a), int(b)) for r, (a, b) in enumerate(zip(cuts, cuts[1:])) if b > a]
        at = np.arange(n, dtype=np.int32) + np.repeat((kind_at[kind] - self.word_at).astype(np.int32), size)
        self.state = self.rank[at]  # of each character
        if n:  # from here on a word is what lies between two cuts
            self.word_end = np.flatnonzero(self.left[at] == 1) + 1
            self.word_at = np.concatenate([[0], self.word_end[:-1]])
        self._weigh_edges(hits)

    def _cut(self, hits: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Words are cut where no piece goes over: what lies behind a cut weighs alike for all that comes before it.

        ``left`` then counts to the next cut, so that texts without spaces are not gone through character by character.
        """
        n = len(self.cp)
        over = np.zeros(n + 2, dtype=np.int32)  # pieces that begin before a place and end behind it
        for k, (states, ids) in enumerate(hits):
            if k:
                at = states[ids >= 0]
                over += np.bincount(at + 1, minlength=n + 2) - np.bincount(at + k + 1, minlength=n + 2)
        free = np.cumsum(over)[1 : n + 1] == 0  # whether the word may be cut behind each place
        ends = np.flatnonzero(free)
        self.left = (ends[np.searchsorted(ends, np.arange(n))] + 1 - np.arange(n)).astype(np.int32) if n else self.left

    def _edges(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """Pieces by length: the places where they begin, and their ids, or -1 where one of that length only goes on."""
        v, n = self.v, len(self.cp)
        states, h, hits = np.arange(n, dtype=np.int32), np.zeros(n, dtype=np.uint64), []
        while len(states):
            k = len(hits)
            h = h * _BASE + (self.cp[states + k].astype(np.uint64) + _U(1))
            at = v.look_up(h)
            go = np.flatnonzero(at >= 0)
            states, h, ids = states[go], h[go], v.ids[at[go]]
            hits.append((states, ids))
            go = np.flatnonzero(self.left[states] > k + 1)
            states, h = states[go], h[go]
        return hits

    def _weigh_edges(self, hits: list[tuple[np.ndarray, np.ndarray]]) -> None:
        """Pieces that begin at each state, by length, and their log weights."""
        v, n = self.v, len(self.cp)
        self.width = max([1, *(k + 1 for k, (_, ids) in enumerate(hits) if (ids >= 0).any())])
        self.ids = np.full((n, self.width), -1, dtype=np.int32)
        for k, (states, ids) in enumerate(hits[: self.width]):
            self.ids[self.rank[states], k] = ids
        self.w = v.weights32[self.ids]  # id -1 has no weight
        lone = np.flatnonzero(self.ids[:, 0] < 0)  # bytes stand in; the id stays -1
        if len(lone):
            if not len(v.byte_ids):
                raise ValueError("a character has no piece, and the vocabulary has no bytes")
            self.w[lone, 0] = utf8_size(self.cp[self.order[lone]]) * v.weights[v.byte_ids].min()

    def weigh(self) -> None:
        """The chance of each edge, given its state: from the mass behind the states, words' ends first.

        Mass is summed in the linear domain, in units of e ** (-_UNIT) a character; in logs past
        _LONG characters before a word's end, and wherever the sum is below _LEAST: rare characters
        leave the range of doubles sooner. What a state above _LEAST loses by that is far below its rounding.
        """
        n = len(self.cp)
        length = np.arange(1, self.width + 1)
        scaled = np.exp(self.w + np.float32(_UNIT) * length.astype(np.float32))
        mass = np.ones(n + self.width + 1)
        logs = np.zeros(n + self.width + 1)
        self.p = np.zeros((n, self.width), dtype=np.float32)
        for r, a, b in self.by_left:
            k = min(r, self.width)
            place = self.order[a:b]
            if r <= _LONG:
                x = scaled[a:b, :k] * self._behind(mass, place, r, k, 1.0)
                total = x.sum(axis=1)
                mass[place] = total
                small = np.flatnonzero(total < _LEAST)
                if len(small):
                    x[small], total[small], logs[place[small]] = self._in_logs(logs, a + small, place[small], r, k)
                    large = np.flatnonzero(mass[place] >= _LEAST)
                    logs[place[large]] = np.log(total[large]) - _UNIT * r
                else:
                    logs[place] = np.log(total) - _UNIT * r
            else:
                x, total, logs[place] = self._in_logs(logs, np.arange(a, b), place, r, k)
            np.divide(x, total[:, None], out=self.p[a:b, :k], casting="unsafe")
        # Most draws fall on a state's likeliest edge; those never look at the others.
        top = self.p.argmax(axis=1)
        flat = np.arange(n) * self.width + top
        self.top, self.top_p, self.top_id = (top + 1).astype(np.int16), self.p.ravel()[flat], self.ids.ravel()[flat]
        self.p.ravel()[flat] = 0
        self.rest = self.p.sum(axis=1)
        self.p.ravel()[flat] = self.top_p
        self.share = self.top_p / (self.top_p + self.rest)  # 1 where there is no other edge

    def _in_logs(self, logs: np.ndarray, rows: np.ndarray, place: np.ndarray, r: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Each edge's mass in units of the state's largest, their sum, and the log of the state's mass."""
        x = self.w[rows, :k] + self._behind(logs, place, r, k, 0.0)
        top = x.max(axis=1)
        x = np.exp(x - top[:, None])
        total = x.sum(axis=1)
        return x, total, top + np.log(total)

    def draw_edges(self, state: np.ndarray, u: np.ndarray) -> np.ndarray:
        """The edge's length at each state, for ``u`` uniform in (0, 1)."""
        out = self.top[state].astype(np.int64)
        late = np.flatnonzero(u > self.share[state])
        if len(late):
            s = state[late]
            p, rest = self.top_p[s].astype(np.float64), self.rest[s].astype(np.float64)
            rows = self.p[s]
            rows[np.arange(len(s)), out[late] - 1] = 0
            sums = np.cumsum(rows, axis=1, dtype=np.float64)
            x = (u[late] * (p + rest) - p) / rest * sums[:, -1]
            x = np.minimum(x, sums[:, -1] * (1 - 1e-12))
            out[late] = (sums <= np.maximum(x, 0)[:, None]).sum(axis=1) + 1
        return out

    def chances(self, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        out = self.top_p[state]
        other = np.flatnonzero(self.top[state] != length)
        out[other] = self.p.ravel()[state[other] * self.width + length[other] - 1]
        return out

    def others(self, state: np.ndarray, length: np.ndarray) -> np.ndarray:
        """The chance of all edges of each state but one."""
        out = self.rest[state]
        other = np.flatnonzero(self.top[state] != length)
        rows = self.p[state[other]]
        rows[np.arange(len(other)), length[other] - 1] = 0
        out[other] = rows.sum(axis=1)
        return out

    @staticmethod
    def _behind(values: np.ndarray, place: np.ndarray, r: int, k: int, at_end: float) -> np.ndarray:
        """Values 1 to k characters on, by place; ``at_end`` where the word ends."""
        x = values[place[:, None] + np.arange(1, k + 1)]
        if k == r:
            x[:, k - 1] = at_end
        return x

    def best(self) -> np.ndarray:
        """Lengths of the pieces of the likeliest segmentation, at the characters where they begin."""
        score, length = np.zeros(len(self.cp) + self.width + 1), np.ones(len(self.cp), dtype=np.int64)
        for r, a, b in self.by_left:
            k = min(r, self.width)
            x = self.w[a:b, :k] + self._behind(score, self.order[a:b], r, k, 0.0)
            length[a:b] = x.argmax(axis=1) + 1
            score[self.order[a:b]] = x.max(axis=1)
        out = np.zeros(len(self.chars), dtype=np.int32)
        at, end = self.word_at, self.word_end
        while len(at):
            step = length[self.state[at]]
            out[at] = step
            go = at + step < end
            at, end = (at + step)[go], end[go]
        return out

    def token_ids(self, at: np.ndarray, state: np.ndarray, length: np.ndarray, fully: bool = False) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces, and how many each has: bytes are several."""
        ids = self.ids.ravel()[state * self.width + length - 1] if fully else self.top_id[state]
        if not fully:
            other = np.flatnonzero(self.top[state] != length)
            ids[other] = self.ids.ravel()[state[other] * self.width + length[other] - 1]
        lone = np.flatnonzero(ids < 0)
        many = np.ones(len(ids), dtype=np.int64)
        if not len(lone):
            return ids, many
        cp = self.chars[at[lone]]
        many[lone] = utf8_size(cp)
        out = np.repeat(ids, many)
        begin = (np.cumsum(many) - many)[lone]
        for k, b in enumerate(utf8_bytes(cp)):
            some = many[lone] > k
            out[begin[some] + k] = self.v.byte_ids[b[some]]
        return out, many


def utf8_size(cp: np.ndarray) -> np.ndarray:
    return 1 + (cp > 0x7F) + (cp > 0x7FF).astype(np.int64) + (cp > 0xFFFF)


def utf8_bytes(cp: np.ndarray) -> list[np.ndarray]:
    cp, size = cp.astype(np.int64), utf8_size(cp)
    lead = np.array([0, 0, 0xC0, 0xE0, 0xF0])[size]
    out = [lead | (cp >> (6 * (size - 1)))]
    for k in range(1, 4):
        out.append(0x80 | (cp >> np.maximum(6 * (size - 1 - k), 0)) & 0x3F)
    return out


def _uniform(seed: np.ndarray, draw: int, at: np.ndarray, use: int) -> np.ndarray:
    """In (0, 1), from the row's seed, the draw, the place in the text and what it is used for."""
    h = wordkit.mix(seed + _U((draw * 8 + use) * 0x632BE59BD9B4E019 & 0xFFFFFFFFFFFFFFFF) + at.astype(np.uint64) * _U(0x9E3779B97F4A7C15))
    return ((h >> _U(32)).astype(np.float64) + 0.5) * 2.0**-32


def _truncated(phi: np.ndarray, bound: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A Gumbel variable of location ``phi``, given that it is at most ``bound``."""
    return phi - np.logaddexp(phi - bound, np.log(-np.log(u)))


def sample_slice(all_texts: list[str], seeds: np.ndarray, vocabulary: Vocabulary, k: int = SAMPLES) -> list[list[tuple[np.ndarray, float, float]]]:
    """For each text up to ``k`` (ids, log probability, log inclusion score), best perturbed score first."""
    lat = Lattice(all_texts, vocabulary)
    lat.weigh()
    n_docs, n = len(all_texts), len(lat.chars)
    out: list[list] = [[] if t else [(np.zeros(0, np.int32), 0.0, 0.0)] for t in all_texts]
    doc_of_word = np.searchsorted(lat.doc_at, lat.word_at, "right") - 1
    paths: list[np.ndarray] = []
    score = np.full((k + 1, n_docs), -np.inf)  # perturbed scores in order; the last is the threshold
    heaps: list[list] = [[] for _ in all_texts]
    live = np.flatnonzero(np.diff(lat.doc_at))  # texts walked in this draw, ...
    begin, cum = lat.doc_at[live], np.zeros(len(live))  # ... from which character on, and the log probability so far
    score[0, live] = -np.log(-np.log(_uniform(seeds[live], 0, np.zeros(len(live)), 0)))
    parent, branch = {}, {}
    found: list[list] = [[] for _ in range(k)]
    for draw in range(k):
        if not len(live):
            break
        path = np.zeros(n, dtype=np.int8 if lat.width < 128 else np.int32)
        for d, (at, length) in branch.items():
            path[lat.doc_at[d] : at] = paths[parent[d]][lat.doc_at[d] : at]
            path[at] = length
        _walk(lat, path, live, begin, seeds, draw, doc_of_word)
        paths.append(path)

        tokens = np.flatnonzero(path)
        ends = np.searchsorted(tokens, lat.doc_at)
        length = path[tokens].astype(np.int64)
        state = lat.state[tokens].astype(np.int64)
        run, whole = np.append(np.log(lat.chances(state, length)).astype(np.float64), 0.0), {}
        for d in live.tolist():  # the log probability before each token, text by text
            a, b = ends[d], ends[d + 1]
            sums = np.cumsum(run[a:b])
            run[a], run[a + 1 : b], whole[d] = 0, sums[:-1], float(sums[-1])
        ids, many = lat.token_ids(tokens, state, length)
        id_at = np.concatenate([[0], np.cumsum(many)])
        for d in live.tolist():
            a, b = ends[d], ends[d + 1]
            found[draw].append((d, ids[id_at[a] : id_at[b]], min(whole[d], 0.0)))
        _open(lat, heaps, live, np.searchsorted(tokens, begin), ends[live + 1], cum, run, tokens, state, length, score[draw], seeds, draw, k - draw)

        # Pop the best group of each text: its score is the next one's, and it tells where to branch.
        parent, branch, starts, cums = {}, {}, [], []
        for d in live.tolist():
            if not heaps[d]:
                continue
            score[draw + 1, d] = g = -heaps[d][0][0]
            if draw + 1 == k:
                continue
            _, at, p, gone, before = heapq.heappop(heaps[d])
            rest = lat.p[lat.state[at]].astype(np.float64)
            rest[[x - 1 for x in gone]] = 0
            one, place = seeds[d : d + 1], np.array([at - lat.doc_at[d]])
            sums = np.cumsum(rest)
            pick = min(int(np.searchsorted(sums, _uniform(one, draw + 1, place, 2)[0] * sums[-1], "right")), int(np.flatnonzero(rest)[-1]))
            chosen = rest[pick]
            rest[pick] = 0
            if rest.any():
                again = _truncated(np.array([before + np.log(rest.sum())]), np.array([g]), _uniform(one, draw + 1, place, 3))
                heapq.heappush(heaps[d], (-float(again[0]), at, p, (*gone, pick + 1), before))
            parent[d], branch[d] = p, (at, pick + 1)
            starts.append(at + pick + 1)
            cums.append(before + np.log(chosen))
        live, begin, cum = np.array(list(branch), dtype=np.int64), np.array(starts, dtype=np.int64), np.array(cums)

    threshold = {d: score[draw + 1, d] for draw in range(k) for d, _, _ in found[draw]}  # of the last draw of each text
    for draw in range(k):
        for d, ids, log_p in found[draw]:
            q = _log_inclusion(log_p - threshold[d])
            if not np.isfinite(log_p + q):
                raise FloatingPointError(f"text {d} of the slice has a score of {log_p}, {q}")
            out[d].append((ids, log_p, q))
    return out


def spelled(found: list, all_texts: list[str], v: Vocabulary) -> list[bool]:
    """Whether every sample of a text decodes to it; those of a slice are decoded at once."""
    every = [ids for x in found for ids, _, _ in x]
    ids = np.concatenate(every) if every else np.zeros(0, np.int32)
    data = v.spell(ids).tobytes()
    at = np.concatenate([[0], np.cumsum(v.flat_size[ids])])[np.concatenate([[0], np.cumsum([len(x) for x in every])]).astype(np.int64)].tolist()
    out, k = [], 0
    for x, t in zip(found, all_texts):
        want = (" " + t).encode() if t else b""
        out.append(all(data[at[j] : at[j + 1]] == want for j in range(k, k + len(x))))
        k += len(x)
    return out


def _log_inclusion(x: float) -> float:
    """log(1 - exp(-exp(x))): the chance that a score of location log_p passes the threshold."""
    return 0.0 if x > 3.6 else float(np.log(-np.expm1(-np.exp(x)))) if x > -30 else float(x)


def _walk(lat: Lattice, path: np.ndarray, live: np.ndarray, begin: np.ndarray, seeds: np.ndarray, draw: int, doc_of_word: np.ndarray) -> None:
    """Extend ``path`` from ``begin`` to the end of each text by drawing edges; all words step together."""
    start = np.full(len(seeds), len(lat.chars))
    start[live] = begin
    word = np.flatnonzero(lat.word_end > start[doc_of_word])
    doc = doc_of_word[word]
    at, end = np.maximum(lat.word_at[word], start[doc]), lat.word_end[word]
    offset, seed = lat.doc_at[doc], seeds[doc]
    while len(at):
        step = lat.draw_edges(lat.state[at], _uniform(seed, draw, at - offset, 1))
        path[at] = step
        at = at + step
        go = np.flatnonzero(at < end)
        at, end, offset, seed = at[go], end[go], offset[go], seed[go]


def _open(lat, heaps, live, first, last, cum, run, tokens, state, length, bound, seeds, draw, want) -> None:
    """Draw the scores of the sibling groups along the new part of each path; the ``want`` best of a text join its heap."""
    todo, best = np.arange(len(live)), {}
    for cut in (CUT, -np.inf):
        # Log probabilities fall along a path: a text's tokens above the cut are a prefix.
        a, b = first[todo], last[todo]
        stop = b if cut == -np.inf else np.array([x + np.searchsorted(-run[x:y], c - cut - run[x], "right") for x, y, c in zip(a, b, cum[todo])], dtype=np.int64)
        n = stop - a
        own = np.repeat(np.arange(len(todo)), n)
        t = np.repeat(a - np.cumsum(n) + n, n) + np.arange(n.sum())
        rest = lat.others(state[t], length[t])
        some = np.flatnonzero(rest > 0)
        own, t, rest = own[some], t[some], rest[some]
        before = run[t] - run[a[own]] + cum[todo[own]]
        d = live[todo[own]]
        g = _truncated(before + np.log(rest), bound[d], _uniform(seeds[d], draw, tokens[t] - lat.doc_at[d], 4))
        ends = np.searchsorted(own, np.arange(len(todo) + 1))
        again = []
        for k, (x, y) in enumerate(zip(ends, ends[1:])):
            j = x + np.argsort(-g[x:y], kind="stable")[:want]
            if stop[k] < b[k] and not (len(j) == want and g[j[-1]] > cut + LIFT):
                again.append(k)  # what lies below the cut may count
                continue
            best[int(todo[k])] = [(-float(g[i]), int(tokens[t[i]]), draw, (int(length[t[i]]),), float(before[i])) for i in j]
        todo = todo[again]
        if not len(todo):
            break
    for k, groups in best.items():
        for group in groups:
            heapq.heappush(heaps[int(live[k])], group)


def row_seeds(ids: list, seed: int) -> np.ndarray:
    keys = np.array([i if i is not None else 0 for i in ids], dtype=np.int64).astype(np.uint64)
    out = wordkit.mix(wordkit.mix(keys + _U(0x9E3779B97F4A7C15)) ^ _U(seed & 0xFFFFFFFFFFFFFFFF))
    return np.where([i is None for i in ids], ~wordkit.mix(out), out) if None in ids else out


def encode_slice(all_texts: list[str], vocabulary: Vocabulary) -> list[np.ndarray]:
    """Ids of the likeliest segmentation of each text."""
    lat = Lattice(all_texts, vocabulary)
    path = lat.best()
    tokens = np.flatnonzero(path)
    ids, many = lat.token_ids(tokens, lat.state[tokens].astype(np.int64), path[tokens].astype(np.int64), fully=True)
    at = np.concatenate([[0], np.cumsum(many)])[np.searchsorted(tokens, lat.doc_at)]
    return [ids[a:b] for a, b in zip(at, at[1:])]


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """(doc_id, ids): the likeliest segmentation of each row's text, as packed little-endian 32-bit ids; ties go to the shorter first piece.

    One row for each row of ``docs``, repeated rows included and alike. A null or empty text has empty ids; a null
    id stays null; an empty table gives no rows. Other columns are not looked at.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.binary())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(schema, batch.column(0), [x.astype("<i4").tobytes() for x in encode_slice(texts(batch.column(1)), shared.value)])

    return map_arrow(id_text(docs, id_col, text_col), one, "doc_id long, ids binary")


def decode(encoded: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) from packed ids: one row for each row of ``encoded``, repeated rows included and alike.

    Null or empty ids are an empty text; a null id of a row stays null; an empty table gives no rows. Other
    columns are not looked at.
    """
    shared = encoded.sparkSession.sparkContext.broadcast(Vocabulary.load(model))
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        return batch_of(schema, batch.column(0), [shared.value.decode(np.frombuffer(x or b"", "<i4")) for x in batch.column(1).to_pylist()])

    return map_arrow(encoded.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).alias("ids")), one, "doc_id long, text string")


def sample(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES, model: str = MODEL, temperature: float = 1.0, seed: int = 0) -> DataFrame:
    """(doc_id, samples, decoded): one row for each row of ``docs``.

    ``samples`` has up to ``k`` distinct segmentations, fewer only where the text has
    no more: ids (packed little-endian 32-bit), log_prob, log_inclusion. ``decoded``
    says that every one of them decodes to the text. A null or empty text has one
    sample without ids. Rows that repeat an id and a text get the same samples; a null
    id is a key of its own. An empty table gives no rows. Other columns are not
    looked at. The vocabulary is broadcast: its size does not depend on the data.
    """
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary.load(model, temperature))
    kind = pa.struct([("ids", pa.binary()), ("log_prob", pa.float64()), ("log_inclusion", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("samples", pa.list_(kind)), ("decoded", pa.bool_())])

    def one(batch: pa.RecordBatch) -> pa.RecordBatch:
        all_texts, v = texts(batch.column(1)), shared.value
        found = sample_slice(all_texts, row_seeds(batch.column(0).to_pylist(), seed), v, k)
        rows = [[{"ids": ids.astype("<i4").tobytes(), "log_prob": p, "log_inclusion": q} for ids, p, q in x] for x in found]
        right = spelled(found, all_texts, v)
        return batch_of(schema, batch.column(0), rows, right)

    return map_arrow(id_text(docs, id_col, text_col), one, "doc_id long, samples array<struct<ids binary, log_prob double, log_inclusion double>>, decoded boolean")


def digest(sampled: DataFrame) -> DataFrame:
    """Token counts, hashes of the ids and rounded scores of each text's samples."""
    each = lambda f: F.transform("samples", f)
    return sampled.select(
        "doc_id",
        F.size("samples").cast("long").alias("n_samples"),
        each(lambda s: (F.octet_length(s["ids"]) / 4).cast("long")).alias("n_tokens"),
        each(lambda s: F.sha2(s["ids"], 256)).alias("ids_sha256"),
        each(lambda s: F.round(s["log_prob"], 3)).alias("log_prob"),
        each(lambda s: F.round(s["log_inclusion"], 3)).alias("log_inclusion"),
        "decoded",
    )


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(sample(read(spark, sf_dir, "documents")))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
SQL: dict[str, str] = {}
