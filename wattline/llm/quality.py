"""Quality classifier: a generalised additive model with pairwise interactions.

Every feature is cut into bins.  Boosting goes round the features in turn; each
step fits a tree of at most ``LEAVES`` leaves on one binned feature to the
current gradients and adds its leaf values, shrunken, to that feature's lookup
table.  Then the pairs of features with the largest gain get two-dimensional
tables in the same way.  A score is a sum of table entries.

The model is fitted on the driver from at most ``sample`` labelled feature rows
(a documented bound); features and scores are computed in Spark over all whole
texts.  Only the text is read: labels, language, source and ids are no inputs.

Defined results: null and empty texts have the features of an empty text and
get a score; an id with several labels has the largest, and rows of equal id and
text count once (the sample is taken after labels and documents have met, so
labels without a document and null ids take no place); without any usable label
every score is 0.5; long texts are read whole; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattline.llm.common import CHUNK_BYTES, Texts, chunks, labelled_sample, lean, words

FEATURES = ["log_bytes", "log_words", "word_bytes", "upper", "digit", "space", "newline", "bar", "symbol",
            "stop", "non_ascii", "same_word", "distinct", "same_pair", "top_word", "cased", "odd_end"]
SAMPLE = 20_000
BINS = 32
LEAVES = 4
ROUNDS = 120
PAIRS = 6
PAIR_ROUNDS = 30
RATE = 0.15
FOLDS = 5
THRESHOLD = 0.3

_CLASS = np.zeros(256, np.uint8)  # 1 upper, 2 lower, 3 digit, 4 space, 5 newline, 6 bar, 7 stop, 8 symbol, 9 other
_CLASS[65:91], _CLASS[97:123], _CLASS[48:58] = 1, 2, 3
_CLASS[[32, 9, 11, 12, 13]], _CLASS[10], _CLASS[124] = 4, 5, 6
_CLASS[[ord(c) for c in ".,;:!?'\"()-"]] = 7
_CLASS[[ord(c) for c in "#$%&*+/<=>@[\\]^_`{}~"]] = 8
_CLASS[128:] = 9


def _sums(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    c = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=c[1:])
    return (c[offsets[1:]] - c[offsets[:-1]]).astype(float)


def features(t: Texts) -> np.ndarray:
    """One row of FEATURES for each text of a chunk."""
    n = len(t)
    size = np.diff(t.offsets).astype(float)
    per = np.maximum(size, 1)
    kind = _CLASS[t.data]
    share = {k: _sums(kind == k, t.offsets) / per for k in (1, 3, 4, 5, 6, 7, 8, 9)}
    w = words(t)
    count = np.diff(w.first).astype(float)
    of = np.repeat(np.arange(n), np.diff(w.first))
    many = np.maximum(count, 1)
    length = np.bincount(of, (w.end - w.start).astype(float), n)
    h = w.hash
    near = np.zeros(len(h), bool)
    near[1:] = (h[1:] == h[:-1]) & (of[1:] == of[:-1])
    two = np.zeros(len(h), bool)
    two[2:] = (h[2:] == h[:-2]) & (of[2:] == of[:-2])
    # distinct words and the commonest word, from words sorted by document and hash
    order = np.lexsort((h, of))
    hs, os_ = h[order], of[order]
    new = np.ones(len(h), bool)
    new[1:] = (hs[1:] != hs[:-1]) | (os_[1:] != os_[:-1])
    at = np.flatnonzero(new)
    runs = np.diff(np.append(at, len(h)))
    top = np.zeros(n)
    np.maximum.at(top, os_[at], runs)
    initial = t.data[w.start] if len(h) else np.zeros(0, np.uint8)
    final = kind[w.end - 1] if len(h) else np.zeros(0, np.uint8)
    by_word = lambda f: np.bincount(of, f.astype(float), n) / many
    return np.column_stack([
        np.log1p(size), np.log1p(count), length / many, share[1], share[3], share[4], share[5], share[6], share[8],
        share[7], share[9], by_word(near), np.bincount(os_[at], minlength=n) / many, by_word(two), top / many,
        by_word((initial >= 65) & (initial <= 90)), by_word(final >= 7)])


@dataclass
class Model:
    """Bin edges of each feature, the lookup tables, and the intercept."""

    edges: list[np.ndarray]
    tables: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    base: float

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)])

    def margin(self, b: np.ndarray) -> np.ndarray:
        z = np.full(len(b), self.base)
        for j, t in enumerate(self.tables):
            z += t[b[:, j]]
        for j, k, t in self.pairs:
            z += t[b[:, j], b[:, k]]
        return z

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(self.bins(x)), -30, 30)))


def _gain(g: np.ndarray, h: np.ndarray) -> np.ndarray:
    return g * g / (h + 1.0)


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """Leaf value of each bin: best-first splits of a histogram of gradients
    ``g`` and curvatures ``h``."""
    cuts = [0, len(g)]
    G, H = np.append(0, np.cumsum(g)), np.append(0, np.cumsum(h))
    while len(cuts) <= leaves:
        best = (1e-6, 0)
        for lo, hi in zip(cuts, cuts[1:]):
            m = np.arange(lo + 1, hi)
            if len(m):
                gain = (_gain(G[m] - G[lo], H[m] - H[lo]) + _gain(G[hi] - G[m], H[hi] - H[m])
                        - _gain(G[hi] - G[lo], H[hi] - H[lo]))
                ok = (H[m] - H[lo] > 1e-3) & (H[hi] - H[m] > 1e-3)
                k = int(np.argmax(np.where(ok, gain, -1)))
                if ok[k] and gain[k] > best[0]:
                    best = (gain[k], int(m[k]))
        if not best[1]:
            break
        cuts = sorted([*cuts, best[1]])
    out = np.zeros(len(g))
    for lo, hi in zip(cuts, cuts[1:]):
        out[lo:hi] = (G[hi] - G[lo]) / (H[hi] - H[lo] + 1.0)
    return out


def _pair_tree(g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, float]:
    """Four leaves of a two-dimensional histogram: one cut on each axis."""
    G, H = g.cumsum(0).cumsum(1), h.cumsum(0).cumsum(1)
    a, b = G[:-1, :-1], H[:-1, :-1]
    right, low = G[:-1, -1:], G[-1:, :-1]
    hr, hl = H[:-1, -1:], H[-1:, :-1]
    q = [(a, b), (right - a, hr - b), (low - a, hl - b), (G[-1, -1] - right - low + a, H[-1, -1] - hr - hl + b)]
    gain = sum(_gain(x, y) for x, y in q)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [x[i, j] / (y[i, j] + 1.0) for x, y in q]
    out = np.empty(g.shape)
    out[:i + 1, :j + 1], out[:i + 1, j + 1:], out[i + 1:, :j + 1], out[i + 1:, j + 1:] = v
    return out, float(gain[i, j] - _gain(G[-1, -1], H[-1, -1]))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost the tables on feature rows ``x`` and labels ``y`` (0 or 1)."""
    d = x.shape[1]
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0)
             for j in range(d)]
    m = Model(edges, [np.zeros(len(e) + 1) for e in edges], [], 0.0)
    if len(y) == 0:
        return m
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    m.base = float(np.log(p / (1 - p)))
    b = m.bins(x)
    z = np.full(len(y), m.base)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        s = 1 / (1 + np.exp(-z))
        return y - s, np.maximum(s * (1 - s), 1e-6)

    for _ in range(ROUNDS):
        for j in range(d):
            g, h = slopes()
            n = len(m.tables[j])
            step = RATE * _tree(np.bincount(b[:, j], g, n), np.bincount(b[:, j], h, n))
            m.tables[j] += step
            z += step[b[:, j]]

    def histograms(j: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        g, h = slopes()
        shape = (len(m.tables[j]), len(m.tables[k]))
        cell = b[:, j] * shape[1] + b[:, k]
        return tuple(np.bincount(cell, v, shape[0] * shape[1]).reshape(shape) for v in (g, h))

    two = [j for j in range(d) if len(m.tables[j]) > 1]
    ranked = sorted(((_pair_tree(*histograms(j, k))[1], j, k) for j in two for k in two if j < k), reverse=True)
    chosen = [(j, k, np.zeros((len(m.tables[j]), len(m.tables[k])))) for _, j, k in ranked[:PAIRS]]
    for _ in range(PAIR_ROUNDS):
        for j, k, t in chosen:
            step = RATE * _pair_tree(*histograms(j, k))[0]
            t += step
            z += step[b[:, j], b[:, k]]
    m.pairs = chosen
    return m


def _feature_rows(df: DataFrame, keep: str, text_col: str) -> DataFrame:
    """The column ``keep`` and the features of ``text_col`` as an array."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch, "text", CHUNK_BYTES):
                x = features(t)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("label")[t.rows], pa.array(list(x), pa.list_(pa.float64()))], ["label", "x"])

    return (df.select(F.col(keep).cast("int").alias("label"), F.col(f"`{text_col}`").alias("text"))
            .mapInArrow(lean(run), "label int, x array<double>"))


def train(docs: DataFrame, labels: DataFrame, label_col: str = "quality", id_col: str = "doc_id",
          text_col: str = "text", folds: int = FOLDS, sample: int = SAMPLE) -> Model:
    """Fit on labelled documents outside fold 0: those with the smallest hash
    of their id and text, at most ``sample`` of them."""
    both = labelled_sample(docs, labels, label_col, id_col, text_col, folds, sample)
    rows = _feature_rows(both, "label", "text").toPandas()
    order = np.lexsort([*np.array(rows["x"].tolist()).T, rows["label"]]) if len(rows) else []
    rows = rows.iloc[order]
    x = np.array(rows["x"].tolist(), float).reshape(len(rows), len(FEATURES))
    return fit(x, rows["label"].to_numpy(float))


def score(docs: DataFrame, model: Model, text_col: str = "text", carry: list[str] | None = None,
          threshold: float = THRESHOLD) -> DataFrame:
    """The columns in ``carry`` as they are, as a struct ``row``, and for each
    document ``score`` and ``predicted``."""
    carry = carry or docs.columns
    src = docs.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for t in chunks(batch, "text", CHUNK_BYTES):
                s = model.score(features(t))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("row")[t.rows], pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                    ["row", "score", "predicted"])

    from pyspark.sql import types as T
    schema = T.StructType([src.schema["row"], T.StructField("score", T.DoubleType()),
                           T.StructField("predicted", T.IntegerType())])
    return src.mapInArrow(lean(run), schema)
