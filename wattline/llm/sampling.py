"""Sampled segmentations of texts into the pieces of a SentencePiece model,
without replacement, and their decoding.

A text is cut before runs of blanks and after line breaks into words, so a run
of blanks belongs to the word after it; no piece crosses words.  Blanks become
U+2581 and one is put in front, as the model does.  The lattice of a word has an
edge for each piece that fits; a character without a piece of its own (and a
U+2581 of the text itself) takes its byte pieces, so every text has a
segmentation and decodes to itself.  A piece's probability falls with its rank
in the model, p ~ 1 / (rank + 1), so a segmentation's log probability is the
sum over its pieces less that of the whole lattice.

Gumbel top-k: giving every segmentation its log probability plus Gumbel noise
and taking the k largest samples k distinct ones without replacement.  A set of
segmentations of total probability m has a largest perturbed value that is
Gumbel distributed around log m, below that of any set it is part of; where it
is largest is drawn in proportion to probability.  A-star search keeps a
frontier of such sets, each with its largest value as an exact bound.  It takes
the set with the largest bound, follows the lattice to the segmentation that
has it, and splits the rest of the set in two: what leaves the new path later
than the set's own path, and what is left of the set.  k complete paths are the
sample; the best bound left in the frontier, kappa, gives the inclusion scores
1 - exp(-exp(log p - kappa)).

All documents of a chunk walk their lattices at once, one piece per step; noise
is a hash of seed, row key, path and place, so a row's samples depend on
nothing else.

Defined results: null counts as empty; an empty text has one segmentation, the
single blank; a text with fewer than k segmentations gives all of them, with
inclusion score 1; rows with equal key and text give equal samples, a null key
is a key like others; long texts are cut into words and sampled whole; an empty
table gives an empty result.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import SpanHash, Texts, U64, chunks, lean, mix, within

SAMPLES = 3
SEED = 20
_BLANK = "▁"
_GOLD = U64(0x9E3779B97F4A7C15)
#: A surrogate, which no text has, for a U+2581 of the text itself.
OWN = "\ud800"
#: Words whose lattices a task keeps.
LATTICES = 300_000
#: Bytes of text whose lattices are walked together.
WALK_BYTES = 1 << 19
#: Pieces written out together in decoding.
PUT = 1 << 18


class Pieces:
    """Vocabulary of a SentencePiece model: normal pieces, byte pieces and log
    probabilities by rank."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        self.ids: dict[str, int] = {}
        self.byte = np.full(256, -1)
        put: list[bytes] = [b""] * n
        for i in range(n):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                put[i] = bytes([int(piece[1:-1], 16)])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                if _BLANK in piece.lstrip(_BLANK) or "\n" in piece[:-1]:
                    raise ValueError(f"piece {i} crosses words")
                self.ids[piece] = i
                put[i] = piece.replace(_BLANK, " ").encode()
        self._bytes = np.frombuffer(b"".join(put), np.uint8)
        self._size = np.array([len(b) for b in put])
        self._first = np.cumsum(self._size) - self._size
        if (self.byte < 0).any():
            raise ValueError("a model with byte pieces is needed")
        rank = np.arange(1, n + 1)
        self.log_p = -np.log(rank) - np.log((1 / rank).sum())
        order = sorted(self.ids.values(), key=lambda i: -model.get_score(i))
        place = np.full(n, n - 1)
        place[order] = np.arange(len(order))
        self.log_p = self.log_p[place]  # byte pieces come last
        # a table by hash of all beginnings of pieces, and the piece that is one, or -1
        self.longest = max(map(len, self.ids))
        begin = sorted({w[:n] for w in self.ids for n in range(1, len(w) + 1)})
        self._table = _Table(_string_hash(*_flat(begin)), np.array([self.ids.get(w, -1) for w in begin], np.int32))

    def find(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self._table.find(hashes)

    def texts(self, ids: list[np.ndarray]) -> list[np.ndarray]:
        """The texts, as bytes of UTF-8, whose segmentations ``ids`` are."""
        flat = np.concatenate([np.zeros(0, np.int32), *ids])
        size = self._size[flat]
        parts = [np.zeros(0, np.uint8)]
        for lo in range(0, len(flat), PUT):
            n = size[lo:lo + PUT]
            end = np.cumsum(n)
            at = np.arange(end[-1])
            at += np.repeat(self._first[flat[lo:lo + PUT]] - end + n, n)
            parts.append(self._bytes[at])
        data = np.concatenate(parts)
        cut = np.append(0, np.cumsum(size))[np.cumsum([0, *map(len, ids)])]
        return [data[a + 1:b] for a, b in zip(cut[:-1], cut[1:])]

    def decode(self, ids: np.ndarray) -> bytes:
        """The text, in UTF-8, whose segmentation ``ids`` is."""
        return self.texts([np.asarray(ids, np.int64)])[0].tobytes()


class _Table:
    """Numbers by 64-bit hash, in open addressing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self._mask = U64((1 << (4 * len(keys)).bit_length()) - 1)
        self._keys = np.zeros(int(self._mask) + 1, U64)
        self._values = np.zeros(int(self._mask) + 1, np.int32)
        at = keys & self._mask
        while len(keys):
            free = np.flatnonzero(self._keys[at] == 0)
            _, first = np.unique(at[free], return_index=True)
            put = free[first]
            self._keys[at[put]], self._values[at[put]] = keys[put], values[put]
            left = np.delete(np.arange(len(keys)), put)
            keys, values, at = keys[left], values[left], (at[left] + U64(1)) & self._mask

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which keys are there, and their values."""
        at = keys & self._mask
        there = self._keys[at]
        out = self._values[at]
        hit = there == keys
        todo = np.flatnonzero(~hit & (there != 0))
        while len(todo):
            at[todo] = (at[todo] + U64(1)) & self._mask
            there = self._keys[at[todo]]
            same = there == keys[todo]
            hit[todo[same]] = True
            out[todo[same]] = self._values[at[todo[same]]]
            todo = todo[~same & (there != 0)]
        return hit, out


_vocabularies: dict[str, Pieces] = {}


def pieces(path: str) -> Pieces:
    if path not in _vocabularies:
        _vocabularies[path] = Pieces(path)
    return _vocabularies[path]


def _flat(strings: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points end to end, and where each string begins (one more entry)."""
    codes = np.frombuffer("".join(strings).encode("utf-32-le", "surrogatepass"), np.uint32)
    return codes, np.append(0, np.cumsum([len(s) for s in strings])).astype(np.int64)


def _roll(h: np.ndarray, c: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        return mix(h * _GOLD + c.astype(U64))


def _string_hash(codes: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A hash of each string, code point after code point."""
    size = np.diff(at)
    h = np.ones(len(size), U64)
    for k in range(int(size.max(initial=0))):
        more = np.flatnonzero(size > k)
        h[more] = _roll(h[more], codes[at[more] + k])
    return h


_known: dict[str, "Lattices"] = {}


def lattices(path: str) -> "Lattices":
    """The lattices of a Python worker, begun anew when there are too many."""
    if path not in _known or len(_known[path].number) > LATTICES:
        _known[path] = Lattices(pieces(path))
    return _known[path]


class _Rows:
    """Arrays that grow together by appending."""

    def __init__(self, **kinds: type):
        self._data = {c: np.zeros(1024, t) for c, t in kinds.items()}
        self.n = 0

    def append(self, **cols: np.ndarray) -> None:
        more = len(next(iter(cols.values())))
        for c, x in cols.items():
            if self.n + more > len(self._data[c]):
                self._data[c] = np.concatenate([self._data[c][:self.n], np.zeros(self.n + more, self._data[c].dtype)])
            self._data[c][self.n:self.n + more] = x
        self.n += more

    def __getitem__(self, c: str) -> np.ndarray:
        return self._data[c][:self.n]


class Lattices:
    """Lattices of distinct words, which grow as new words come.

    A node is a place in a word; ``first`` is each word's first node, and
    ``info`` has where a node's edges begin and in the last 16 bits how many
    they are (none at a word's end).  An edge leads from ``node`` by a ``piece``
    (or -1 - a code point that takes its bytes); ``q`` is its log probability
    given that its node is reached, and ``step`` has the node it leads to and in
    the last 32 bits that probability, so that a step looks up two numbers.
    """

    def __init__(self, v: Pieces):
        self.v, self.number = v, {}
        self._words = _Rows(first=np.int32)
        self._nodes = _Rows(info=np.int64)
        self._edges = _Rows(node=np.int32, piece=np.int32, q=float, step=np.int64)

    def numbers(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The number of each word data[start:end]; new ones get their lattice."""
        h = SpanHash(data).of(start, end)
        order = np.argsort(h)
        ascending = h[order]
        new = np.ones(len(h), bool)
        new[1:] = ascending[1:] != ascending[:-1]
        where = np.empty(len(h), np.int64)
        where[order] = np.cumsum(new) - 1
        at = order[new]
        names = h[at].tolist()
        out = list(map(self.number.get, names))
        missing = [i for i, x in enumerate(out) if x is None]
        if missing:
            first = len(self.number)
            self._add(*_spelled(data, start[at[missing]], end[at[missing]]))
            for k, i in enumerate(missing):
                self.number[names[i]] = out[i] = first + k
        self.first, self.info = self._words["first"], self._nodes["info"]
        self.node, self.piece, self.q, self.step = (self._edges[c] for c in ("node", "piece", "q", "step"))
        return np.array(out, np.int64)[where]

    def _add(self, codes: np.ndarray, at: np.ndarray) -> None:
        """Lattices of the words codes[at[i]:at[i + 1]]."""
        v = self.v
        size = np.diff(at)
        first = at[:-1] + np.arange(len(size))
        nodes = len(codes) + len(size)
        word, k = within(size)
        start = first[word] + k  # the node of each character
        left = size[word] - k
        by_length = []
        h = np.ones(len(codes), U64)
        live = np.arange(len(codes))
        alone = np.ones(len(codes), bool)  # no piece for this character
        for n in range(1, v.longest + 1):
            more = left[live] >= n
            live, h = live[more], h[more]
            if not len(live):
                break
            h = _roll(h, codes[live + n - 1])
            begins, found = v.find(h)
            live, h, found = live[begins], h[begins], found[begins]
            hit = found >= 0
            by_length.append((n, start[live[hit]], found[hit]))
            if n == 1:
                alone[live[hit]] = False
        lone = np.flatnonzero(alone)
        by_length.insert(0, (1, start[lone], -1 - codes[lone].astype(np.int64)))
        count = np.zeros(nodes, np.int64)
        for _, at_node, _ in by_length:
            count[at_node] += 1
        head = np.append(0, np.cumsum(count))
        frm = np.repeat(np.arange(nodes), count)
        to, piece = np.empty(len(frm), np.int64), np.empty(len(frm), np.int64)
        put = head[:-1].copy()
        for n, at_node, found in reversed(by_length):  # long pieces first, which are mostly the likely ones
            place = put[at_node]
            to[place], piece[place] = at_node + n, found
            put[at_node] += 1
        log_p = np.where(piece >= 0, v.log_p[np.maximum(piece, 0)], 0.0)
        for p in np.unique(piece[piece < 0]):
            log_p[piece == p] = v.log_p[v.byte[_bytes(-1 - int(p))]].sum()
        # log mass to the end, for the nodes one, two, ... characters before it
        rest = np.zeros(nodes)
        end = np.append(first[1:], nodes) - 1
        for d in range(1, int(size.max(initial=0)) + 1):
            end, size = end[size >= d], size[size >= d]
            now = end - d
            of, j = within(count[now])
            e = head[now][of] + j
            s = log_p[e] + rest[to[e]]
            cut = np.searchsorted(of, np.arange(len(now)))
            top = np.maximum.reduceat(s, cut)
            rest[now] = top + np.log(np.add.reduceat(np.exp(s - top[of]), cut))
        edges = self._edges.n
        q = log_p + rest[to] - rest[frm]
        self._words.append(first=first + self._nodes.n)
        self._edges.append(node=frm + self._nodes.n, piece=piece, q=q,
                           step=(to + self._nodes.n << 32) | np.exp(q).astype(np.float32).view(np.uint32))
        self._nodes.append(info=(head[:-1] + edges << 16) | count)


def split(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of all texts, a blank before each; where their words begin and
    end, and how many words each text has.  A word begins at the first of a run
    of blanks and after a line break."""
    data = np.frombuffer(b"".join([b" " + t for t in texts]), np.uint8)
    size = np.array([len(t) + 1 for t in texts], np.int64)
    begin = np.cumsum(size) - size
    first = data == 32
    first[1:] &= data[:-1] != 32
    first[1:] |= data[:-1] == 10
    first[begin] = True
    start = np.flatnonzero(first)
    return data, start, np.append(start[1:], len(data)), np.diff(np.append(np.searchsorted(start, begin), len(start)))


def _spelled(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The words data[start:end] as the vocabulary has them, blanks as U+2581 and
    their own U+2581 as OWN: code points end to end, and where each word begins
    (one more entry)."""
    of, k = within(end - start)
    raw = data[start[of] + k]
    codes = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32).copy()
    codes[codes == ord(_BLANK)] = ord(OWN)
    codes[codes == 32] = ord(_BLANK)
    size = np.bincount(of[(raw & 0xC0) != 0x80], minlength=len(start))
    return codes, np.append(0, np.cumsum(size))


def spelled(word: bytes) -> str:
    """One word as the vocabulary has it."""
    codes, _ = _spelled(np.frombuffer(word, np.uint8), np.zeros(1, np.int64), np.array([len(word)]))
    return "".join(map(chr, codes))


def _bytes(code: int) -> list[int]:
    return list((_BLANK if code == ord(OWN) else chr(code)).encode())


def _uniform(key: np.ndarray, place: np.ndarray | int) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = mix(key + np.asarray(place).astype(U64) * _GOLD)
    return ((h >> U64(11)).astype(float) + 0.5) * 2.0 ** -53


def _walk(lat: Lattices, token: np.ndarray, node: np.ndarray, step: np.ndarray, key: np.ndarray) -> tuple:
    """Walk from ``node`` to the end of each token's word, each edge taken with
    its probability; the (token, step, edge) taken, in order."""
    rows: list[tuple] = []
    steps = np.zeros(len(token), np.int64)
    info = lat.info[node]
    at = np.flatnonzero(info & 0xFFFF)
    info, now = info[at], step[at]
    while len(at):
        e, left = info >> 16, (info & 0xFFFF) - 1
        u = _uniform(key[at], now).astype(np.float32)
        edge = lat.step[e]
        p = edge.astype(np.uint32).view(np.float32)
        more = np.flatnonzero((u >= p) & (left > 0))
        while len(more):  # not this edge: the next one, if there is one
            u[more] -= p[more]
            e[more] += 1
            left[more] -= 1
            edge[more] = lat.step[e[more]]
            p[more] = edge[more].astype(np.uint32).view(np.float32)
            more = more[(u[more] >= p[more]) & (left[more] > 0)]
        rows.append((at, e))
        steps[at] += 1
        info = lat.info[edge >> 32]
        go = np.flatnonzero(info & 0xFFFF)
        info, at, now = info[go], at[go], now[go] + 1
    begin = np.cumsum(steps) - steps
    taken = np.empty(int(steps.sum()), np.int64)
    for k, (at, e) in enumerate(rows):
        taken[begin[at] + k] = e
    return np.repeat(token, steps), np.arange(len(taken)) - np.repeat(begin - step, steps), taken


#: Sets of probability below exp(-NEGLIGIBLE) times the largest don't change a sum of doubles.
NEGLIGIBLE = 60.0


class _Path:
    """A path with its value, from its step ``own`` on other than its parent's;
    and the log probabilities of leaving it at each step."""

    def __init__(self, lat: Lattices, token: np.ndarray, step: np.ndarray, edge: np.ndarray, own: int, value: float):
        self.token, self.step, self.edge, self.own, self.value = token, step, edge, own, value
        q = lat.q[edge]
        self.log_p = float(q.sum())
        n = len(q)
        run = np.cumsum(q)
        start = run[own - 1] if own else 0.0
        # leaving it so late that it can't matter is left out
        end = int(np.searchsorted(-run[own:], NEGLIGIBLE - start)) + 1 + own
        end = min(max(end, own + 64), n)
        with np.errstate(divide="ignore"):
            self.leave = np.append(start, run[own:end - 1])[:end - own] + np.log(-np.expm1(q[own:end]))
        self.gone: dict[int, list[int]] = {}  # edges at a step that other paths took

    def mass(self) -> float:
        """Log probability of what leaves the path and isn't taken yet."""
        if not len(self.leave):
            return -np.inf
        top = self.leave.max()
        return float(top + np.log(np.exp(self.leave - top).sum())) if top > -np.inf else -np.inf

    def branch(self, lat: Lattices, u: float) -> tuple[int, int]:
        """Step and edge at which a sample of these leaves the path; they are
        taken from now on."""
        w = np.cumsum(np.exp(self.leave - self.leave.max()))
        x = u * w[-1]
        k = min(int(np.searchsorted(w, x, side="right")), len(w) - 1)
        at = self.own + k
        edge = int(self.edge[at])
        node = lat.node[edge]
        head, count = int(lat.info[node]) >> 16, int(lat.info[node]) & 0xFFFF
        taken = self.gone.setdefault(at, [edge])
        left = np.ones(count, bool)
        left[np.array(taken) - head] = False
        free = head + np.flatnonzero(left)
        c = np.cumsum(np.exp(lat.q[free]))
        low = w[k - 1] if k else 0.0
        y = (x - low) / (w[k] - low) if w[k] > low else 0.0
        pick = int(free[min(int(np.searchsorted(c, y * c[-1], side="right")), len(free) - 1)])
        taken.append(pick)
        rest = np.exp(lat.q[free[free != pick]]).sum()
        prefix = self.leave[k] - np.log(c[-1])
        self.leave[k] = prefix + np.log(rest) if rest > 0 else -np.inf
        return at, pick


def _below(mass: float, bound: float, u: float) -> float:
    """A Gumbel variable around ``mass`` that is below ``bound``."""
    if mass == -np.inf:
        return -np.inf
    return float(mass - np.logaddexp(mass - bound, np.log(-np.log(u))))


def _ids(lat: Lattices, paths: list[np.ndarray]) -> list[np.ndarray]:
    """The ids along paths of edges."""
    p = lat.piece[np.concatenate([np.zeros(0, np.int64), *paths])]
    cut = np.cumsum([0, *map(len, paths)])
    odd = np.flatnonzero(p < 0)
    if len(odd):
        codes, which = np.unique(-1 - p[odd], return_inverse=True)
        put = [lat.v.byte[_bytes(int(c))] for c in codes]
        size = np.ones(len(p), np.int64)
        size[odd] = np.array([len(x) for x in put])[which]
        cut = np.append(0, np.cumsum(size))[cut]
        own = np.repeat(p < 0, size)
        p = np.repeat(p, size)
        p[own] = np.concatenate([put[i] for i in which.tolist()])
    return [p[a:b] for a, b in zip(cut[:-1], cut[1:])]


def sample(texts: list[bytes], keys: np.ndarray, lat: Lattices, k: int = SAMPLES, seed: int = SEED) -> list[list[tuple]]:
    """For each text (in UTF-8) up to ``k`` distinct segmentations as (ids, log
    probability, perturbed log probability, inclusion score), best first."""
    n = len(texts)
    data, word_start, word_end, size = split(texts)
    occurrence = lat.numbers(data, word_start, word_end)
    doc, place = within(size)
    begin = np.cumsum(size) - size
    with np.errstate(over="ignore"):
        root = mix(keys.astype(U64) + U64(seed) * _GOLD)
        noise = mix(root[doc] ^ mix(place + 1))  # the noise key of each token
    draw = [_uniform(root, 1000 + i) for i in range(4 * k + 2)]
    top = -np.log(-np.log(draw[0]))
    token = np.arange(len(doc))
    t, s, e = _walk(lat, token, lat.first[occurrence], np.zeros(len(token), np.int64), noise)
    cut = np.searchsorted(doc[t], np.arange(n + 1))
    paths = [[_Path(lat, t[a:b], s[a:b], e[a:b], 0, top[d])] for d, (a, b) in enumerate(zip(cut[:-1], cut[1:]))]
    # the frontier: (bound, path), the set being what leaves the path and isn't taken
    front = [[(_below(p[0].mass(), top[d], draw[1][d]), 0)] for d, p in enumerate(paths)]
    kappa = np.full(n, -np.inf)
    for r in range(1, k + 1):
        left: list[tuple] = []
        for d in range(n):
            bound, j = max(front[d])
            if r == k or bound == -np.inf:
                kappa[d] = bound
                continue
            front[d].remove((bound, j))
            at, edge = paths[d][j].branch(lat, draw[4 * r][d])
            front[d].append((_below(paths[d][j].mass(), bound, draw[4 * r + 1][d]), j))
            left.append((d, j, at, edge, bound))
        if not left:
            break
        # the new paths go on from the branch to the end of the document
        docs = np.array([x[0] for x in left])
        branch_token = np.array([paths[d][j].token[at] for d, j, at, _, _ in left])
        branch_step = np.array([paths[d][j].step[at] for d, j, at, _, _ in left])
        edges = np.array([x[3] for x in left])
        of, i = within(begin[docs] + size[docs] - branch_token)
        token = branch_token[of] + i
        node, step = lat.first[occurrence[token]], np.zeros(len(token), np.int64)
        node[i == 0], step[i == 0] = lat.step[edges] >> 32, branch_step + 1
        with np.errstate(over="ignore"):
            fresh = noise[token] + U64(r) * U64(0xA0761D6478BD642F)
        t, s, e = _walk(lat, token, node, step, fresh)
        cut = np.searchsorted(doc[t], np.arange(n + 1))
        for x, (d, j, at, edge, bound) in enumerate(left):
            old, a, b = paths[d][j], cut[d], cut[d + 1]
            new = _Path(lat, np.concatenate([old.token[:at], branch_token[x:x + 1], t[a:b]]),
                        np.concatenate([old.step[:at], branch_step[x:x + 1], s[a:b]]),
                        np.concatenate([old.edge[:at], edges[x:x + 1], e[a:b]]), at + 1, bound)
            paths[d].append(new)
            front[d].append((_below(new.mass(), bound, draw[4 * r + 2][d]), len(paths[d]) - 1))
    ids = iter(_ids(lat, [p.edge for found in paths for p in found]))
    return [[(next(ids), p.log_p, float(p.value),
              1.0 if kappa[d] == -np.inf else -float(np.expm1(-np.exp(min(p.log_p - kappa[d], 50.0)))))
             for p in paths[d]] for d in range(n)]


def sample_segmentations(df: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text", k: int = SAMPLES,
                         seed: int = SEED, carry: list[str] | None = None, with_ids: bool = True) -> DataFrame:
    """The sampled segmentations of each text, best first: row, sample,
    n_pieces, log_prob, perturbed, inclusion, ids_crc32 (unsigned, of
    little-endian 32-bit ids), decoded_crc32 (of the text they decode to), and
    the ids ``with_ids``."""
    carry = carry or [id_col]
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"),
                    F.xxhash64(F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit(""))).alias("key"),
                    F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([
        src.schema["row"], T.StructField("sample", T.IntegerType()), T.StructField("n_pieces", T.LongType()),
        T.StructField("log_prob", T.DoubleType()), T.StructField("perturbed", T.DoubleType()),
        T.StructField("inclusion", T.DoubleType()), T.StructField("ids_crc32", T.LongType()),
        T.StructField("decoded_crc32", T.LongType())] + [T.StructField("ids", T.ArrayType(T.IntegerType()))] * with_ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lat = lattices(model)
        for batch in batches:
            key = batch.column("key").to_numpy(zero_copy_only=False).view(U64)
            for t in chunks(batch, "text", WALK_BYTES):
                lat = lattices(model)
                found = sample([t.of(i) for i in range(len(t))], key[t.rows], lat, k, seed)
                at = [t.rows.start + i for i, f in enumerate(found) for _ in f]
                flat = [x for f in found for x in f]
                ids = [x[0].astype("<i4") for x in flat]
                cols = [batch.column("row").take(pa.array(at)),
                        pa.array([j for f in found for j in range(len(f))], pa.int32()),
                        pa.array([len(x) for x in ids], pa.int64()),
                        *(pa.array([x[c] for x in flat], pa.float64()) for c in (1, 2, 3)),
                        pa.array([zlib.crc32(x.tobytes()) for x in ids], pa.int64()),
                        pa.array([zlib.crc32(x) for x in lat.v.texts(ids)], pa.int64())]
                if with_ids:
                    head = np.append(0, np.cumsum([len(x) for x in ids])).astype(np.int32)
                    cols.append(pa.ListArray.from_arrays(head, np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays(cols, [f.name for f in schema])

    return src.mapInArrow(lean(run), schema)


def decode(df: DataFrame, model: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``df`` with the text that ``ids_col`` decodes to; null stays null."""
    schema = T.StructType([*df.schema.fields, T.StructField(out_col, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = pieces(model)
        for batch in batches:
            texts = [None if x is None else v.decode(x).decode() for x in batch.column(ids_col).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [f.name for f in schema])

    return df.mapInArrow(lean(run), schema)
