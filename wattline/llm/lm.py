"""A word n-gram language model in Elias-Fano tries, trained and applied by Spark.

The model interpolates absolute-discounted n-grams of orders 2 to ``order``
with add-one unigrams:

    pn(w | h) = max(c(h w) - D, 0) / c(h)  +  D * T(h) / c(h) * pm(w | h')
    p1(w)     = (c(w) + 1) / (N + V + 1)

h' is h without its first word and m = n - 1.  T(h) counts the distinct words
after h; a context without counts gives pm.  A document's tokens are its words
and one end; the first word's context is the end, and contexts don't go beyond
it, so a document's first words have shorter ones.  The first part, quantised to
16 bits of its logarithm, is what the tries keep; p1 and T(h) are exact.

Spark deals the vocabulary and the n-grams to shards by hash, and nothing that
grows with the corpus reaches the driver but one row of totals per shard.
Documents are first turned into *blocks* of some million tokens with a sorted
vocabulary of their own.  A block sends its distinct words with their counts to
the shards and gets global counts and ids back; then its distinct n-grams of
all orders in one round, each to the shard of its context, as ids of words.  A
shard adds up the counts of all blocks, builds for each order the trie of its
contexts and words, and answers the blocks' n-grams by successor search in it.
No ids or counts of contexts travel, as a shard holds all that follows a
context; only one with more than its share of the tokens is spread over several
shards by the next word, and a block adds up what they tell of it.  Each block
scores its documents at last.

Defined results: a null text is empty and has the end alone; rows of one id are
scored each for itself; with no training documents every score is the base
score; a null id trains or not as ``train`` says; long texts are scored whole (a
block holds whole documents); an empty table gives an empty result.
"""

from __future__ import annotations

import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import U64, WHITE, chunks, lean, mix, partitions, saved, within, words
from wattline.llm.elias_fano import Trie
from wattline.llm.repeats import bucket_of
from wattline.operators.balance import bucketed

#: Longest n-grams of the registered query.
ORDER = 3
DISCOUNT = 0.75
#: Tokens and documents of a block.
BLOCK_TOKENS = 7 << 17
BLOCK_DOCS = 1 << 16
#: Steps of a quantised logarithm (base 10) from 0 down; the last code is "not there".
STEP = 2.0 ** -12
ABSENT = 0xFFFF
#: What each code stands for.
VALUES = np.append(10.0 ** (-STEP * np.arange(ABSENT)), 0.0)
#: A context's share of the training tokens, in shards' sizes, before it is spread.
SPREAD = 0.25
#: Word ids from here on stand for no word; there are fewer distinct words than that.
NO_WORD = 1 << 31
_END = mix(np.array([0x454E44], U64))[0]


def planes(x: np.ndarray) -> bytes:
    """Numbers below 2^32 as four planes of bytes, which compress well."""
    x = np.ascontiguousarray(x, np.uint32)
    return struct.pack("<q", len(x)) + b"".join((x >> np.uint32(k)).astype(np.uint8).tobytes() for k in (0, 8, 16, 24))


def unplaned(buffer: bytes, at: int) -> tuple[np.ndarray, int]:
    n, = struct.unpack_from("<q", buffer, at)
    b = np.frombuffer(buffer, np.uint8, 4 * n, at + 8).reshape(4, n)
    return np.ascontiguousarray(b.T).view("<u4").ravel(), at + 8 + 4 * n


def ascending(x: np.ndarray) -> bytes:
    """Ascending 64-bit numbers as planes of the bytes of their steps."""
    step = np.diff(x.astype(U64), prepend=U64(0))
    return struct.pack("<q", len(x)) + np.ascontiguousarray(step, "<u8").view(np.uint8).reshape(-1, 8).T.tobytes()


def ascended(buffer: bytes, at: int) -> tuple[np.ndarray, int]:
    n, = struct.unpack_from("<q", buffer, at)
    b = np.frombuffer(buffer, np.uint8, 8 * n, at + 8).reshape(8, n)
    return np.cumsum(np.ascontiguousarray(b.T).view("<u8").ravel(), dtype=U64), at + 8 + 8 * n


def stepped(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Numbers below 2^32 as steps from the one before, but for those where ``new``."""
    return np.where(new, x, np.diff(x, prepend=0)) & 0xFFFFFFFF


def unstepped(x: np.ndarray, new: np.ndarray) -> np.ndarray:
    x = x.astype(np.int64)
    total, at = np.cumsum(x), np.flatnonzero(new)
    return (total - np.repeat((total - x)[at], np.diff(np.append(at, len(x))))) & 0xFFFFFFFF


def _longs(buffer: bytes, at: int) -> tuple[np.ndarray, int]:
    n, = struct.unpack_from("<q", buffer, at)
    return np.frombuffer(buffer, "<u8", n, at + 8), at + 8 + 8 * n


class Block:
    """Documents as token numbers: ``vocabulary`` (sorted hashes), ``tokens``
    (indexes in it, each document's end included), ``size`` of each document,
    whether it is one to train on, and its id."""

    def __init__(self, buffer: bytes):
        self.vocabulary, at = ascended(buffer, 0)
        self.tokens, at = unplaned(buffer, at)
        self.size, at = unplaned(buffer, at)
        self.train, at = unplaned(buffer, at)
        ids, at = _longs(buffer, at)
        self.ids = ids.view(np.int64)
        self.null, at = unplaned(buffer, at)

    @staticmethod
    def pack(hashes: np.ndarray, size: np.ndarray, train: np.ndarray, ids: pa.Array) -> bytes:
        vocabulary, tokens = np.unique(hashes, return_inverse=True)
        null = np.asarray(ids.is_null())
        doc = ids.fill_null(0).to_numpy(zero_copy_only=False).astype("<i8")
        return b"".join([ascending(vocabulary), planes(tokens), planes(size), planes(train), struct.pack("<q", len(doc)),
                         doc.tobytes(), planes(null)])

    def counts(self) -> np.ndarray:
        """Training count of each word of the vocabulary."""
        return np.bincount(self.tokens, np.repeat(self.train, self.size), len(self.vocabulary)).astype(np.int64)

    def told(self, replies: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
        """Count and id of each word of the vocabulary, which is put in the order of ids."""
        count, ids = word_facts(replies, shards)
        order = np.argsort(ids)
        rank = np.empty(len(ids), np.int64)
        rank[order] = np.arange(len(ids))
        self.vocabulary, self.tokens = self.vocabulary[order], rank[self.tokens]
        return count[order], ids[order]

    def contexts(self) -> np.ndarray:
        """The token before each token; the end before a document's first."""
        end = np.flatnonzero(self.vocabulary == _END)[0]
        before = np.empty(len(self.tokens), self.tokens.dtype)
        before[1:] = self.tokens[:-1]  # a document's last token is the end
        before[:1] = end
        return before


def as_blocks(docs: DataFrame, limit: int = BLOCK_TOKENS, end: bool = True, breaks: np.ndarray = WHITE) -> DataFrame:
    """``docs`` has id, train, text; returns block, data.  Blocks have about
    ``limit`` tokens; documents have an ``end`` or not."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        hashes, sizes, train, ids = [], [], [], []
        tokens = docs_held = 0

        def block() -> pa.RecordBatch:
            data = Block.pack(np.concatenate(hashes), np.concatenate(sizes), np.concatenate(train), pa.concat_arrays(ids))
            return pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([data], pa.large_binary())
                                               .cast(pa.binary())], ["block", "data"])

        for batch in batches:
            for t in chunks(batch, "text"):
                w = words(t, lower=True, breaks=breaks)
                size = np.diff(w.first)
                of, k = within(size + end)
                h = np.full(len(of), _END)
                inside = k < size[of]
                h[inside] = w.hash
                hashes.append(h)
                sizes.append(size + end)
                train.append(batch.column("train")[t.rows].to_numpy(zero_copy_only=False))
                ids.append(batch.column("id")[t.rows])
                tokens += len(h)
                docs_held += len(t)
                if tokens >= limit or docs_held >= BLOCK_DOCS:
                    yield block()
                    number += 1
                    hashes, sizes, train, ids = [], [], [], []
                    tokens = docs_held = 0
        if docs_held:
            yield block()

    return docs.select("id", "train", "text").mapInArrow(lean(run), "block long, data binary")


def _rows(rows: list[tuple[int, int, bytes]], names: tuple[str, str]) -> Iterator[pa.RecordBatch]:
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int32()),
                                          pa.array([r[2] for r in rows], pa.binary())], [*names, "data"])


def _cuts(sorted_: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(sorted_, np.arange(n + 1))


def word_counts(blocks: DataFrame, shards: int, count: Callable[[Block], np.ndarray] = Block.counts) -> DataFrame:
    """block, shard, data: the block's words of the shard and their counts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column("block").to_pylist(), batch.column("data")):
                b = Block(data.as_buffer())
                cut = _cuts(bucket_of(b.vocabulary, shards), shards)  # ascending, as the hashes are
                n = count(b)
                yield from _rows([(number, k, ascending(b.vocabulary[lo:hi]) + planes(n[lo:hi])) for k, (lo, hi) in enumerate(zip(cut[:-1], cut[1:])) if lo < hi],
                                 ("block", "shard"))

    return blocks.mapInArrow(lean(run), "block long, shard int, data binary")


def word_replies(counts: DataFrame, shards: int, frequent_first: bool = False) -> DataFrame:
    """block, shard, data: global count and place in the shard (in order of hashes, or of
    counts from the largest down) of each word that was sent; and a row of block -1 with the shard's tokens, distinct training words and distinct words."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sent = [(n, s, d) for batch in batches for n, s, d in zip(
            batch.column("block").to_pylist(), batch.column("shard").to_pylist(), batch.column("data").to_pylist())]
        if not sent:
            return
        parts = [ascended(d, 0) for _, _, d in sent]
        sums = [unplaned(d, at)[0] for (_, at), (_, _, d) in zip(parts, sent)]
        names, where = np.unique(np.concatenate([p for p, _ in parts]), return_inverse=True)
        total = np.bincount(where, np.concatenate(sums)).astype(np.int64)
        place = np.arange(len(names))
        if frequent_first:  # ids that are often sent are small
            place[np.argsort(-total, kind="stable")] = np.arange(len(names))
        shard = sent[0][1]
        facts = struct.pack("<qqq", int(total.sum()), int((total > 0).sum()), len(names))
        yield from _rows([(-1, shard, facts)], ("block", "shard"))
        at = 0
        for (number, _, _), (p, _) in zip(sent, parts):
            mine = where[at:at + len(p)]
            at += len(p)
            yield from _rows([(number, shard, planes(total[mine] & 0xFFFFFFFF) + planes(total[mine] >> 32) + planes(place[mine]))], ("block", "shard"))

    return counts.repartitionById(shards, F.col("shard")).mapInArrow(lean(run), "block long, shard int, data binary")


def by_block(replies: DataFrame, name: str) -> DataFrame:
    return replies.where("block >= 0").groupBy("block").agg(
        F.sort_array(F.collect_list(F.struct("shard", "data"))).alias(name))


def word_facts(replies: list[dict], shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Count and id of each word of a block's vocabulary."""
    n, i = [], []
    for r in replies or []:
        low, at = unplaned(r["data"], 0)
        high, at = unplaned(r["data"], at)
        n.append(low + (high.astype(np.int64) << 32))
        i.append(unplaned(r["data"], at)[0].astype(np.int64) * shards + r["shard"])  # an id of its own
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(n).astype(np.int64), np.concatenate(i).astype(np.int64)


def orders(b: Block, order: int) -> Iterator[tuple[list[np.ndarray], np.ndarray]]:
    """For each order from 2 on the words before each token, the nearest one
    first, and whether they all lie in the token's document."""
    first = np.append(0, np.cumsum(b.size.astype(np.int64)))[:-1]
    columns, inside = [b.contexts()], np.ones(len(b.tokens), bool)
    for n in range(2, order + 1):
        yield columns, inside
        if n < order:
            columns = [*columns, np.append(columns[-1][:1], columns[-1][:-1])]
            inside = np.append(False, inside[:-1])
            inside[first] = False


def context_hash(b: Block, columns: list[np.ndarray], at: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = b.vocabulary[columns[0][at]] + U64(len(columns))
        for c in columns[1:]:
            h = mix(h * U64(0x9E3779B97F4A7C15) + b.vocabulary[c[at]])
        return mix(h)


def _ranked(columns: list[np.ndarray], bits: int) -> np.ndarray:
    """One number below 2^64 for each row of ``columns``, in their order, with
    the last column's value, below 2^bits, as its last bits."""
    key, used = columns[0].astype(U64), bits
    for c in columns[1:]:
        if used + bits > 64:
            key = np.unique(key, return_inverse=True)[1].astype(U64)
            used = len(key).bit_length()
        key, used = (key << U64(bits)) | c.astype(U64), used + bits
    return key


def crowded_contexts(blocks: DataFrame, order: int, total: int, shards: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, ascending, of the contexts with more than ``SPREAD`` of a shard's share of the
    training tokens, and into how many parts each is spread.

    A block names those that hold such a share of its own tokens; a context with twice
    the share in all of them is never missed.  There are fewer than shards / SPREAD of an order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data"):
                b = Block(data.as_buffer())
                trained = np.repeat(b.train, b.size) > 0
                least = SPREAD / shards * trained.sum()
                for columns, inside in orders(b, order):
                    at = np.flatnonzero(inside & trained)
                    for c in columns:  # a context is no more frequent than its words
                        at = at[np.bincount(c[at], minlength=len(b.vocabulary))[c[at]] > least]
                    h, n = np.unique(context_hash(b, columns, at), return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(h[n > least].view(np.int64)), pa.array(n[n > least])], ["h", "n"])

    share = max(SPREAD * total / shards, 1)
    rows = blocks.mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") > share).collect()
    h, n = (np.array([r[c] for r in rows], np.int64) for c in ("h", "n"))
    order_ = np.argsort(h.view(U64))
    return h.view(U64)[order_], np.minimum(np.ceil(n[order_] / share), shards).astype(np.int64)


class Grams:
    """The distinct n-grams of a block in one order, by shard, context and word:
    those of the tokens whose context has no word without a training count.
    When they are to be ``sent`` they have a ``count`` each; afterwards ``of`` is
    the n-gram of each of the ``known`` tokens.  A crowded context is spread over
    several shards by the next word and asked for in each of them, by a word
    that there is not where there is no other, so that all parts of its count
    and of T(h) come back."""

    def __init__(self, b: Block, columns: list[np.ndarray], inside: np.ndarray, count: np.ndarray, ids: np.ndarray,
                 crowded: tuple[np.ndarray, np.ndarray], shards: int, sent: bool):
        for c in columns:
            inside = inside & (count[c] > 0)
        known = np.flatnonzero(inside)
        bits = max(len(b.vocabulary).bit_length(), 1)
        word = np.where(count[b.tokens[known]] > 0, b.tokens[known], len(b.vocabulary))
        key = _ranked([*(c[known] for c in columns), word], bits)
        by_key = np.argsort(key)
        first, times = _context_runs(key[by_key])
        n, token = len(first), by_key[first]  # one that has it
        begin = first
        first, size = _context_runs(key[token] >> U64(bits))
        local = np.repeat(np.arange(len(first)), size)
        at = known[token[first]]
        self.context = [ids[c[at]] for c in columns]
        h = context_hash(b, columns, at)
        parts = np.ones(len(h), np.int64)
        if len(crowded[0]):
            k = np.minimum(np.searchsorted(crowded[0], h), len(crowded[0]) - 1)
            parts = np.where(crowded[0][k] == h, crowded[1][k], 1)
        self.word = np.append(ids, NO_WORD)[word[token]]
        shard = self._shard(h, np.arange(len(h)), np.zeros(len(h)), shards)[local]
        wide = np.flatnonzero(parts > 1)
        of, k = within(parts[wide])
        spread = np.flatnonzero(parts[local] > 1)
        part = mix(self.word[spread]) % parts[local[spread]].astype(U64)
        shard[spread] = self._shard(h, local[spread], part, shards)
        more = np.setdiff1d(wide[of] * shards + self._shard(h, wide[of], k, shards), local[spread] * shards + shard[spread])
        shard = np.append(shard, more % shards)
        order = np.argsort(shard.astype(np.uint16 if shards < 1 << 16 else np.int64), kind="stable")
        self.local = np.append(local, more // shards)[order]
        self.word = np.append(self.word, np.full(len(more), NO_WORD))[order]
        self.cut = _cuts(shard[order], shards)
        if sent:
            trained = np.repeat(b.train, b.size)[known[by_key]].astype(np.int64)
            count = np.add.reduceat(trained, begin) if n else trained
            self.count = np.append(count, np.zeros(len(more), np.int64))[order]
        else:
            rank = np.empty(len(order), np.int64)
            rank[order] = np.arange(len(order))
            self.known, self.of = known, np.empty(len(known), np.int64)
            self.of[by_key] = np.repeat(rank[:n], times)

    @staticmethod
    def _shard(h: np.ndarray, local: np.ndarray, part: np.ndarray, shards: int) -> np.ndarray:
        with np.errstate(over="ignore"):
            return bucket_of(mix(h[local] + part.astype(U64) * U64(0xD6E8FEB86659FD93)), shards)

    def message(self, shard: int) -> bytes:
        """Contexts, how many n-grams each has, their words and counts; a word as a step
        from the one before where all that is nearer is the same."""
        lo, hi = self.cut[shard], self.cut[shard + 1]
        first, n = _context_runs(self.local[lo:hi])
        out, new = [], np.arange(len(first)) == 0
        for c in self.context:
            c = c[self.local[lo:hi][first]]
            out.append(stepped(c, new))
            new = new | np.append(True, c[1:] != c[:-1])[:len(c)]
        new = np.zeros(hi - lo, bool)
        new[first] = True
        return b"".join(planes(x) for x in (*out, n, stepped(self.word[lo:hi], new), self.count[lo:hi]))

    def told(self, replies: dict[int, list], lower: np.ndarray) -> np.ndarray:
        """Probability of each token, given that of the order below; reads its
        part of each shard's [data, place]."""
        seen = np.zeros(len(self.word))
        types, total = np.zeros(len(self.context[0])), np.zeros(len(self.context[0]))
        for shard, reply in replies.items():
            lo, hi = self.cut[shard], self.cut[shard + 1]
            below, at = unplaned(*reply)
            times, at = unplaned(reply[0], at)
            again, reply[1] = unplaned(reply[0], at)
            first, n = _context_runs(self.local[lo:hi])
            context = self.local[lo:hi][first]  # each once in a shard
            types[context] += times - again.astype(float)
            total[context] += times
            code = np.where(below < ABSENT, np.repeat(_once(times), n) - below, ABSENT)
            seen[lo:hi] = VALUES[code] * np.repeat(times, n)
        context = self.local[self.of]
        t, c, below = types[context], np.maximum(total[context], 1), lower[self.known]
        p = lower.copy()
        p[self.known] = np.where(t > 0, (seen[self.of] + DISCOUNT * t * below) / c, below)
        return p


def _context_runs(context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    new = np.ones(len(context), bool)
    new[1:] = context[1:] != context[:-1]
    first = np.flatnonzero(new)
    return first, np.diff(np.append(first, len(context)))


def _code(count: np.ndarray, times: np.ndarray) -> np.ndarray:
    code = np.rint(-np.log10((count - DISCOUNT) / np.maximum(times, 1)) / STEP)
    return np.clip(code, 0, ABSENT - 1).astype(np.int64)


def _once(times: np.ndarray) -> np.ndarray:
    """The code of an n-gram seen once, whose context is seen so many times."""
    return _code(np.ones(len(times)), times)


def squeezed(data: bytes) -> bytes:
    return struct.pack("<q", len(data)) + pa.compress(data, "zstd", asbytes=True)


def unsqueezed(data: bytes) -> bytes:
    return pa.decompress(data[8:], struct.unpack_from("<q", data)[0], "zstd", asbytes=True)


def _gram_counts(told: DataFrame, order: int, shards: int, crowded: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """block, shard, data: the block's n-grams of all orders from 2 on."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data, words in zip(batch.column("block").to_pylist(), batch.column("data"), batch.column("words").to_pylist()):
                b = Block(data.as_buffer())
                count, ids = b.told(words, shards)
                grams = [Grams(b, *x, count, ids, crowded, shards, True) for x in orders(b, order)]
                yield from _rows([(number, k, squeezed(b"".join(g.message(k) for g in grams))) for k in range(shards)
                                  if any(g.cut[k] < g.cut[k + 1] for g in grams)], ("block", "shard"))

    return told.mapInArrow(lean(run), "block long, shard int, data binary")


def _answers(sent: list[list], words: int) -> list[bytes]:
    """Answers to the n-grams of one order, after ``words`` words: how far each n-gram's code
    is below that of one seen once, and for each context how many words this shard has
    after it and how many of them are repeats."""
    parts = []
    for message in sent:
        x = []
        for _ in range(words + 3):
            part, message[1] = unplaned(*message)
            x.append(part)
        new = np.arange(len(x[0])) == 0
        for k in range(words):
            x[k] = unstepped(x[k], new)
            new = new | np.append(True, x[k][1:] != x[k][:-1])[:len(new)]
        new = np.zeros(len(x[words + 1]), bool)
        new[np.cumsum(x[words]) - x[words]] = True
        x[words + 1] = unstepped(x[words + 1], new)
        parts.append(x)
    joined = lambda k: np.concatenate([p[k] for p in parts])
    names, run = np.unique(_ranked([joined(k) for k in range(words)], 32), return_inverse=True)
    size = joined(words)
    key, where = np.unique((np.repeat(run, size).astype(U64) << U64(32)) | joined(words + 1).astype(U64), return_inverse=True)
    count = np.bincount(where, joined(words + 2), len(key)).astype(np.int64)
    context, word = (key >> U64(32)).astype(np.int64), (key & U64(0xFFFFFFFF)).astype(np.int64)
    there = count > 0
    times = np.bincount(context, count, len(names)).astype(np.int64)
    after = np.bincount(context[there], minlength=len(names))
    trie = Trie(Trie.pack(context[there], word[there], _code(count[there], times[context[there]])))
    at = trie.find(context, word)  # each distinct n-gram once
    answer = np.full(len(key), ABSENT)
    answer[at >= 0] = _once(times)[context[at >= 0]] - trie.codes[at[at >= 0]]
    answer, again, times = answer[where], (times - after)[run], times[run]
    runs = np.append(0, np.cumsum([len(p[0]) for p in parts]))
    grams = np.append(0, np.cumsum([len(p[words + 1]) for p in parts]))
    return [planes(answer[a:b]) + planes(times[c:d]) + planes(again[c:d])
            for a, b, c, d in zip(grams[:-1], grams[1:], runs[:-1], runs[1:])]


def _gram_replies(counts: DataFrame, shards: int, order: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, sent = [], []
        for batch in batches:
            names += zip(batch.column("block").to_pylist(), batch.column("shard").to_pylist())
            sent += [[unsqueezed(d), 0] for d in batch.column("data").to_pylist()]
        if not sent:
            return
        answers = [_answers(sent, words) for words in range(1, order)]
        for (number, shard), *data in zip(names, *answers):
            yield from _rows([(number, shard, squeezed(b"".join(data)))], ("block", "shard"))

    return counts.repartitionById(shards, F.col("shard")).mapInArrow(lean(run), "block long, shard int, data binary")


def _scored(told: DataFrame, order: int, total: int, distinct: int, shards: int,
            crowded: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data, words, grams in zip(batch.column("data"), batch.column("words").to_pylist(), batch.column("grams").to_pylist()):
                b = Block(data.as_buffer())
                count, ids = b.told(words, shards)
                base = (count + 1) / (total + distinct + 1)
                p = base[b.tokens]
                replies = {r["shard"]: [unsqueezed(r["data"]), 0] for r in grams or []}
                for x in orders(b, order):
                    p = Grams(b, *x, count, ids, crowded, shards, False).told(replies, p)
                at = np.append(0, np.cumsum(b.size.astype(np.int64)))
                add = lambda x: np.add.reduceat(x, at[:-1]) if len(b.size) else x[:0]
                yield pa.RecordBatch.from_arrays([
                    pa.array(b.ids, pa.int64(), mask=b.null.astype(bool)), pa.array(b.train == 0),
                    pa.array(b.size.astype(np.int64)), pa.array(add((count[b.tokens] > 0).astype(np.int64))),
                    pa.array(np.full(len(b.size), total)), pa.array(add(np.log10(base)[b.tokens])),
                    pa.array(add(np.log10(p)))],
                    ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    return told.mapInArrow(lean(run), "id long, held_out boolean, n_tokens long, n_known long, train_tokens long, "
                                "base_score double, score double")


def check_ids(most: int, shards: int) -> None:
    """Word ids (place in the shard x shards + shard) have 31 bits."""
    if most * shards >= NO_WORD:
        raise ValueError(f"{most} distinct words in one of {shards} shards: word ids would pass {NO_WORD}")


def score(df: DataFrame, train: str, id_col: str = "doc_id", text_col: str = "text",
          order: int = 2) -> DataFrame:
    """Learn n-grams of up to ``order`` words from the rows where the SQL
    condition ``train`` holds and score all rows: id, held_out, n_tokens, n_known (tokens with a training count),
    train_tokens, base_score (add-one unigrams) and score, both log10."""
    shards = 2 * partitions(df.sparkSession)
    docs = df.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.expr(train).cast("int").alias("train"),
                     F.col(f"`{text_col}`").alias("text"))
    # by block, so that no join moves the documents
    blocks = bucketed(as_blocks(docs), ["block"], "lm")
    replies = saved(word_replies(word_counts(blocks, shards), shards, True))
    sums = [struct.unpack("<qqq", r["data"]) for r in replies.where("block < 0").select("data").collect()]
    total, distinct = sum(s[0] for s in sums), sum(s[1] for s in sums)
    check_ids(max((s[2] for s in sums), default=0), shards)
    told = blocks.join(by_block(replies, "words").hint("shuffle_hash"), "block")
    crowded = crowded_contexts(blocks, order, total, shards) if order > 1 else (np.zeros(0, U64), np.zeros(0, np.int64))
    if order > 1:
        answers = _gram_replies(_gram_counts(told, order, shards, crowded), shards, order)
        told = told.join(by_block(answers, "grams").hint("shuffle_hash"), "block", "left")
    else:
        told = told.withColumn("grams", F.lit(None).cast("array<struct<shard: int, data: binary>>"))
    return _scored(told, order, total, distinct, shards, crowded)
