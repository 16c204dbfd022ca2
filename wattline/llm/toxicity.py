"""Toxicity: misspelled terms of a learned lexicon, weighed by their context.

1. **Lexicon.** Words that labelled toxic documents hold far more often than
   clean ones (log odds, and the likelihood ratio).  A term's documents count by
   how much the words before it differ, and those after it, so words that come
   with a copied document or passage are no terms.
2. **Matching.** The terms lie in a trie.  Every distinct word of a chunk is a
   Levenshtein automaton (bit parallel, one mask for each number of edits); the
   trie is walked level by level with the automata of all words at once, and a
   pair of word and node goes on as long as some state lives.  Terms of five
   letters and more allow one edit, of nine and more two; shorter ones none.
3. **Context.** A hit is quoted if it lies between two quotation marks of its
   line, or if a word of reporting stands within ``WINDOW`` words and no word of
   address does.
4. **Score.** Sums of term weights over plain and quoted, exact and misspelled
   hits, and over hits next to words of address, go through a logistic model.
   It is fitted with a prior that trusts plain hits more than quoted ones, so
   quotation counts less even where the labels hold no example of it.

The model is learned from at most ``SAMPLE`` labelled rows (those of smallest hash
of id and text, taken after documents and labels have met); their statistics
are added up by Spark.  The lexicon's size is bounded by its support: a term lies
in at least ``SHARE`` of the toxic rows.

Null and empty texts have no hits and score like any text without one.  Very
long texts are read whole, in chunks of rows; a longer row is its own chunk.
Ties and repeated rows score alike; rows that share an id and a text count once
in the sample, and a null id has no label.  An id with several labels counts as
toxic if one says so.  Without labelled documents of both kinds the lexicon is
empty and all texts score alike.  An empty table gives an empty result.  Other
columns travel in ``row``, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import PUNCTUATION, Texts, Words, chunks, labelled_sample, lean, words

FOLDS = 5
SAMPLE = 20_000
THRESHOLD = 0.5
#: A term's least share of the toxic rows, number of rows, log odds and likelihood ratio (G squared).
SHARE, LEAST, ODDS, SURE = 0.01, 3, 2.0, 20.0
#: Least number of letters of a term, and letters from which one and two edits are allowed.
LETTERS, ONE_EDIT, TWO_EDITS = 3, 5, 9
#: Longest term; the automaton's states fit one 64-bit mask.
LONGEST = 48
WINDOW = 4

# --- fixed values: words that report speech, and words that address someone ----
REPORTING = """said says saying wrote writes called calls quoted quotes quote term word phrase according reported
sagte sagt schrieb nannte zitiert zitat wort begriff laut dit disait écrit appelé cité citation mot terme selon
dijo dice escribió llamó citó cita palabra término según""".split()
ADDRESS = """you your yours yourself u du dich dir dein deine ihr euch tu toi te ton ta vous votre tú ti usted ustedes
eres""".split()
# --- end fixed values ----------------------------------------------------------

FEATURES = ["plain", "plain_near", "quoted", "quoted_near", "addressed"]
#: Prior weights (the constant last) and how firmly they hold.
PRIOR = np.array([2.5, 1.0, 0.4, 0.2, 0.8, -3.0])
HOLD = np.array([0.5, 2.0, 2.0, 4.0, 2.0, 0.05])

#: Bytes between words; an asterisk stands for any symbol inside a word.
BREAKS = PUNCTUATION.copy()
BREAKS[ord("*")] = False
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "*@$!"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(97, 123), *range(128, 256)]] = True


def lowered(col: pa.Array) -> pa.Array:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return pc.utf8_lower(col.cast(pa.large_string()))


def spelled(t: Texts) -> tuple[Texts, np.ndarray]:
    """The chunk with punctuation of several bytes blanked and symbols inside
    words as asterisks, and where quotation marks lie."""
    d = t.data.copy()
    quote = d == ord('"')
    n = len(d)
    e2 = np.flatnonzero(d[:-2] == 0xE2) if n > 2 else np.zeros(0, np.int64)
    e2 = e2[d[e2 + 1] == 0x80]
    quote[e2[np.isin(d[e2 + 2], [0x9C, 0x9D, 0x9E, 0x9F])]] = True
    c2 = np.flatnonzero(d[:-1] == 0xC2) if n > 1 else np.zeros(0, np.int64)
    quote[c2[np.isin(d[c2 + 1], [0xAB, 0xBB])]] = True
    for at, width in ((e2, 3), (c2, 2)):
        for k in range(width):
            d[at + k] = 0x20
    symbol = np.flatnonzero(_SYMBOL[d])
    inner = symbol[(symbol > 0) & (symbol < n - 1)]
    inner = inner[_LETTER[d[inner - 1]] & _LETTER[d[np.minimum(inner + 1, n - 1)]]]
    d[symbol] = 0x20
    d[inner] = ord("*")
    return Texts(d, t.offsets, t.rows), quote


class Trie:
    """Terms as a trie in arrays: children of node i are ``child[first[i]:first[i + 1]]``."""

    def __init__(self, terms: list[str]):
        nodes: list[dict[str, int]] = [{}]
        self.term_at = {}
        for k, term in enumerate(terms):
            at = 0
            for c in term:
                if c not in nodes[at]:
                    nodes[at][c] = len(nodes)
                    nodes.append({})
                at = nodes[at][c]
            self.term_at[at] = k
        self.first = np.cumsum([0, *[len(x) for x in nodes]])
        self.child = np.array([c for x in nodes for c in x.values()], np.int64)
        self.letter = np.array([ord(c) for x in nodes for c in x], np.int64)
        self.term = np.array([self.term_at.get(i, -1) for i in range(len(nodes))])


def edits_allowed(n: np.ndarray) -> np.ndarray:
    return np.where(n >= TWO_EDITS, 2, np.where(n >= ONE_EDIT, 1, 0))


def match(trie: Trie, lengths: np.ndarray, found: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """For each word the nearest term (the first of equals; -1: none) within the
    edits that the term's length allows, and the number of edits.

    State bit i of mask e: the walked path equals the first i letters of the
    word but for e edits.  ``lengths`` are the terms' numbers of letters.
    """
    n = len(found)
    term, edits = np.full(n, -1), np.full(n, 99)
    if not n or not len(trie.child):
        return term, edits
    size = np.array([len(w) for w in found], np.int64)
    width = int(size.max())
    letters = np.frombuffer("".join(w.ljust(width, "\0") for w in found).encode("utf-32-le"), np.uint32).reshape(n, width)
    alphabet = np.unique(trie.letter)
    bit = np.uint64(1) << np.arange(width, dtype=np.uint64)
    places = np.stack([((letters == c) * bit).sum(1, dtype=np.uint64) for c in alphabet])  # of each letter in each word
    code = np.searchsorted(alphabet, trie.letter)
    most = int(edits_allowed(lengths).max()) if len(lengths) else 0
    end = np.uint64(1) << size.astype(np.uint64)
    word, node = np.arange(n), np.zeros(n, np.int64)
    state = [np.full(n, (1 << (e + 1)) - 1, np.uint64) for e in range(most + 1)]
    one = np.uint64(1)
    while len(word):
        kids = trie.first[node + 1] - trie.first[node]
        pick = np.repeat(np.arange(len(word)), kids)
        edge = np.arange(len(pick)) - np.repeat(np.cumsum(kids) - kids, kids) + trie.first[node][pick]
        word, node = word[pick], trie.child[edge]
        here = places[code[edge], word]
        old = [s[pick] for s in state]
        state = [(old[0] & here) << one]
        for e in range(1, most + 1):
            state.append(((old[e] & here) << one) | old[e - 1] | (old[e - 1] << one) | (state[e - 1] << one))
        reach = (end[word] << one) - one  # states past the word's end mean nothing
        state = [s & reach for s in state]
        t = trie.term[node]
        for e in range(most + 1):
            hit = np.flatnonzero((t >= 0) & ((state[e] & end[word]) != 0))
            hit = hit[edits_allowed(lengths[t[hit]]) >= e]
            # nearest first, then the smaller term
            better = (edits[word[hit]] > e) | ((edits[word[hit]] == e) & (t[hit] < term[word[hit]]))
            for i in hit[better]:
                w = word[i]
                if e < edits[w] or (e == edits[w] and t[i] < term[w]):
                    term[w], edits[w] = t[i], e
        live = state[most] != 0  # the widest mask holds all states of the others
        word, node, state = word[live], node[live], [s[live] for s in state]
    return term, edits


@dataclass
class Lexicon:
    """Terms in order, their weights (0 to 1) and the trie."""

    terms: list[str] = field(default_factory=list)
    weights: list[float] = field(default_factory=list)

    def __post_init__(self):
        self.trie = Trie(self.terms)
        self.lengths = np.array([len(t) for t in self.terms], np.int64)
        self.weight = np.array([*self.weights, 0.0])


def word_texts(t: Texts, w: Words, at: np.ndarray) -> list[str]:
    return [t.data[a:b].tobytes().decode("utf-8", "replace") for a, b in zip(w.start[at].tolist(), w.end[at].tolist())]


def _listed(lists: list[str]) -> np.ndarray:
    """Hashes of the given words, as ``words`` makes them."""
    raw = [x.encode() for x in lists]
    offs = np.cumsum([0, *[len(x) for x in raw]])
    t = Texts(np.frombuffer(b"".join(raw), np.uint8), offs, slice(0, len(raw)))
    return np.unique(words(t, breaks=BREAKS).hash)


def _near(flag: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    total = np.append(0, np.cumsum(flag))
    return total[hi] > total[lo]


@dataclass
class Hits:
    """Matched words of a chunk: document, term, edits, and the context's verdicts."""

    doc: np.ndarray
    term: np.ndarray
    edits: np.ndarray
    quoted: np.ndarray
    addressed: np.ndarray


def hits(t: Texts, lexicon: Lexicon) -> Hits:
    """All hits of a chunk of lower-case texts."""
    t, quote = spelled(t)
    w = words(t, breaks=BREAKS)
    none = np.zeros(0, np.int64)
    if not len(w.start) or not lexicon.terms:
        return Hits(none, none, none, none.astype(bool), none.astype(bool))
    size = w.end - w.start
    least = int((lexicon.lengths - edits_allowed(lexicon.lengths)).min())
    most = int((lexicon.lengths + edits_allowed(lexicon.lengths)).max())
    fits = np.flatnonzero((size >= least) & (size <= 4 * most))
    _, first, back = np.unique(w.hash[fits], return_index=True, return_inverse=True)
    texts = word_texts(t, w, fits[first])
    term, edits = np.full(len(texts), -1), np.full(len(texts), 99)
    short = np.array([i for i, x in enumerate(texts) if least <= len(x) <= most], np.int64)
    if len(short):
        term[short], edits[short] = match(lexicon.trie, lexicon.lengths, [texts[i] for i in short])
    at = np.flatnonzero(term[back] >= 0)
    word, term, edits = fits[at], term[back][at], edits[back][at]
    doc = np.searchsorted(w.first, word, side="right") - 1
    lo, hi = np.maximum(word - WINDOW, w.first[doc]), np.minimum(word + WINDOW + 1, w.first[doc + 1])
    reported = _near(np.isin(w.hash, _listed(REPORTING)), lo, hi)
    addressed = _near(np.isin(w.hash, _listed(ADDRESS)), lo, hi)
    # quotation marks before and after the hit in its line
    n = len(t.data)
    edge = np.zeros(n + 1, bool)
    edge[t.offsets] = True
    edge[np.flatnonzero(t.data == 10)] = True
    edges = np.flatnonzero(edge)
    marks = np.append(0, np.cumsum(quote))
    line = np.searchsorted(edges, w.start[word], side="right") - 1
    left, right = edges[line], edges[np.minimum(line + 1, len(edges) - 1)]
    inside = ((marks[w.start[word]] - marks[left]) % 2 == 1) & (marks[right] > marks[w.end[word]])
    return Hits(doc, term, edits, inside | (reported & ~addressed), addressed & ~inside)


def features(t: Texts, lexicon: Lexicon) -> np.ndarray:
    """The features of each document of a chunk of lower-case texts."""
    h = hits(t, lexicon)
    weight = lexicon.weight[h.term]
    exact = h.edits == 0
    add = lambda pick: np.log1p(np.bincount(h.doc[pick], weight[pick], minlength=len(t)))
    return np.stack([add(exact & ~h.quoted), add(~exact & ~h.quoted), add(exact & h.quoted), add(~exact & h.quoted),
                     add(h.addressed)], axis=1)


@dataclass
class Model:
    lexicon: Lexicon
    weights: np.ndarray

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500)))


def fit(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Logistic weights (the constant last) with the prior, by Newton's method."""
    z = np.hstack([x, np.ones((len(x), 1))])
    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(z @ w, -500, 500)))
        slope = z.T @ (p - y) + HOLD * (w - PRIOR)
        step = np.linalg.solve(z.T @ (z * (p * (1 - p))[:, None]) + np.diag(HOLD), slope)
        w = w - step * min(1.0, 4.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return w


def _word_counts(sample: DataFrame) -> DataFrame:
    """word, toxic and clean: numbers of the sample's documents that hold it."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label = batch.column("label").to_numpy(zero_copy_only=False)
            low = pa.RecordBatch.from_arrays([lowered(batch.column("text"))], ["text"])
            for t in chunks(low, "text"):
                s, _ = spelled(t)
                w = words(s, breaks=BREAKS)
                fits = np.flatnonzero((w.end - w.start >= LETTERS) & (w.end - w.start <= 4 * LONGEST))
                doc = np.searchsorted(w.first, fits, side="right") - 1
                # once for each document, then added up over the chunk
                _, first = np.unique(np.stack([w.hash[fits], doc.astype(np.uint64)]), axis=1, return_index=True)
                fits, doc = fits[first], doc[first]
                _, one, back = np.unique(w.hash[fits], return_index=True, return_inverse=True)
                y = label[t.rows][doc]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word_texts(s, w, fits[one]), pa.string()),
                     pa.array(np.bincount(back, y == 1, minlength=len(one)).astype(np.int64)),
                     pa.array(np.bincount(back, y == 0, minlength=len(one)).astype(np.int64))], ["word", "toxic", "clean"])

    return (sample.select("text", "label").mapInArrow(lean(run), "word string, toxic long, clean long")
            .groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")))


def _contexts(sample: DataFrame, terms: list[str]) -> dict[str, float]:
    """For each term, the share of different ones among the words before its
    places in toxic documents, or among those after, whichever is less."""
    wanted = _listed(terms)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = pa.RecordBatch.from_arrays([lowered(batch.column("text"))], ["text"])
            for t in chunks(low, "text"):
                s, _ = spelled(t)
                w = words(s, breaks=BREAKS)
                at = np.flatnonzero(np.isin(w.hash, wanted))
                doc = np.searchsorted(w.first, at, side="right") - 1
                before = np.where(at > w.first[doc], w.hash[np.maximum(at - 1, 0)], np.uint64(0))
                after = np.where(at + 1 < w.first[doc + 1], w.hash[np.minimum(at + 1, len(w.hash) - 1)], np.uint64(1)) \
                    if len(w.hash) else before
                yield pa.RecordBatch.from_arrays(
                    [pa.array(word_texts(s, w, at), pa.string()), pa.array(before.astype(np.int64)),
                     pa.array(after.astype(np.int64))], ["word", "before", "after"])

    places = sample.where("label = 1").select("text").mapInArrow(lean(run), "word string, before long, after long")
    rows = places.groupBy("word", "before", "after").count().groupBy("word").agg(
        (F.least(F.count_distinct("before"), F.count_distinct("after")) / F.sum("count")).alias("share"))
    return {r["word"]: r["share"] for r in rows.collect()} if terms else {}


def learn_lexicon(sample: DataFrame) -> Lexicon:
    """Terms from labelled rows (text, label)."""
    totals = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    bad, good = totals.get(1, 0), totals.get(0, 0)
    if not bad or not good:
        return Lexicon()
    t, c = F.col("toxic"), F.col("clean")
    odds = F.log((t + 0.5) / (bad - t + 0.5)) - F.log((c + 0.5) / (good - c + 0.5))
    both = bad + good
    part = lambda seen, row, col: F.when(seen > 0, seen * F.log(seen * both / (row * col))).otherwise(0.0)
    ratio = 2 * (part(t, t + c, F.lit(bad)) + part(c, t + c, F.lit(good)) + part(bad - t, both - t - c, F.lit(bad))
                 + part(good - c, both - t - c, F.lit(good)))
    rows = (_word_counts(sample).withColumn("odds", odds)
            .where((t >= max(LEAST, SHARE * bad)) & (F.col("odds") >= ODDS) & (ratio >= SURE)
                   & (F.length("word") >= LETTERS) & (F.length("word") <= LONGEST)).collect())
    share = _contexts(sample, [r["word"] for r in rows])
    kept = sorted((r["word"], r["odds"]) for r in rows
                  if share.get(r["word"], 0) * r["toxic"] >= max(LEAST, SHARE * bad))
    top = max((o for _, o in kept), default=1.0)
    return Lexicon([w for w, _ in kept], [o / top for _, o in kept])


def _features_of(df: DataFrame, lexicon: Lexicon, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the features ``x`` of the column text."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = pa.RecordBatch.from_arrays([lowered(batch.column("text"))], ["text"])
            for t in chunks(low, "text"):
                x = features(t, lexicon)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * x.shape[1], pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*[batch.column(c)[t.rows] for c in keep], lists], [*keep, "x"])

    src = df.select(*keep, "text")
    schema = T.StructType([*[src.schema[c] for c in keep], T.StructField("x", T.ArrayType(T.DoubleType()))])
    return src.mapInArrow(lean(run), schema)


def train(docs: DataFrame, labels: DataFrame, label_col: str = "toxic", id_col: str = "doc_id", text_col: str = "text",
          folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """Lexicon and weights from the labelled documents outside fold 0."""
    rows = labelled_sample(docs, labels, label_col, id_col, text_col, folds, sample)
    lexicon = learn_lexicon(rows)
    # a histogram of the features: few distinct ones, however many rows
    seen = (_features_of(rows, lexicon, ["label"]).groupBy("x", "label").agg(F.count(F.lit(1)).alias("n"))
            .orderBy("x", "label").collect())
    x = np.array([r["x"] for r in seen for _ in range(r["n"])], float).reshape(-1, len(FEATURES))
    y = np.array([r["label"] for r in seen for _ in range(r["n"])], float)
    return Model(lexicon, fit(x, y))


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """``row`` (the columns in ``carry``), ``score`` and ``predicted`` of every document."""
    carry = carry or docs.columns
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([src.schema["row"], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            low = pa.RecordBatch.from_arrays([lowered(batch.column("text"))], ["text"])
            for t in chunks(low, "text"):
                s = model.score(features(t, model.lexicon))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[t.rows], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["row", "score", "predicted"])

    return src.mapInArrow(lean(run), schema)
