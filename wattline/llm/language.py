"""Language identification by rank-order profiles.

A profile is the list of the most frequent character n-grams (one to three
letters, words padded by a blank) of a language or a document, by rank.  A
document goes to the language whose profile has the smallest out-of-place
distance: the sum over the document's n-grams of how far their ranks differ,
with a fixed penalty for n-grams that the language's profile lacks.

Spark counts the n-grams of all training texts by language, pre-aggregated in
the tasks; the profiles that reach the driver are ``TOP`` rows per language.

Defined results: a text that is null or without a letter is ``und`` with score
0; without any profile every text is ``und``; equal counts rank by n-gram,
equal distances by language name.  Long texts are read whole; repeated rows and
rows of one or no id are predicted each for itself, and all count in training; an
empty table gives an empty result.  Letters beyond U+FFFF count by their code's
remainder in that range.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import CHUNK_BYTES, Texts, chunks, fold, lean

TOP = 300
ORDERS = 3
FOLDS = 5
UND = "und"
#: Distinct n-grams a task gathers before it hands them on.
GATHER = 1 << 20

# letters of the first 2^16 code points; letters beyond take private code points
_LETTER = np.array([chr(c).isalpha() if not 0xD800 <= c < 0xE000 else False for c in range(1 << 16)])
_PRIVATE, _PRIVATE_SIZE = 0xE000, 0x1900
#: An n-gram is up to three 16-bit codes in one number; the rest is for a text's index.
_GRAM_BITS = np.uint64(48)
_GRAM = np.uint64((1 << 48) - 1)


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case code points, all but letters as blanks, one blank around each
    text; and the text of each."""
    low = [t.lower() for t in texts]
    size = np.array([len(t) + 1 for t in low], np.int64)
    code = np.frombuffer((" " + " ".join(low) + " ").encode("utf-32-le", "surrogatepass"), np.uint32)
    of = np.repeat(np.arange(len(low)), size)
    of = np.append(of, max(len(low) - 1, 0)) if len(low) else np.zeros(len(code), np.int64)
    high = code > 0xFFFF
    if high.any():
        beyond = [chr(c).isalpha() for c in code[high]]
        code = code.copy()
        code[high] = np.where(beyond, _PRIVATE + code[high] % _PRIVATE_SIZE, 32)
        letter = _LETTER[code] | ((code >= _PRIVATE) & (code < _PRIVATE + _PRIVATE_SIZE) & high)
    else:
        letter = _LETTER[code]
    code = np.where(letter, code, 32).astype(np.uint64)
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 32) | (code[:-1] != 32) | (of[1:] != of[:-1])
    return code[keep], of[keep]


def ngrams(texts: list[str]) -> np.ndarray:
    """text << 48 | n-gram for every n-gram of one to ORDERS letters that has
    a letter and doesn't span two words or texts."""
    c, of = _codes(texts)
    if not len(c):
        return np.zeros(0, np.uint64)
    blank = c == 32
    owner = of.astype(np.uint64) << _GRAM_BITS
    two = (c[:-1] << np.uint64(16)) | c[1:]
    three = (two[:-1] << np.uint64(16)) | c[2:]
    same = of[1:] == of[:-1]
    return np.concatenate([
        (owner | c)[~blank],
        (owner[:-1] | two)[~(blank[:-1] & blank[1:]) & same],
        (owner[:-2] | three)[~blank[1:-1] & same[:-1] & same[1:]]])


def _counted(g: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (owner, n-gram) in order, and their counts."""
    g = np.sort(g)
    new = np.ones(len(g), bool)
    new[1:] = g[1:] != g[:-1]
    at = np.flatnonzero(new)
    return (g[at] >> _GRAM_BITS).astype(np.int64), g[at] & _GRAM, np.diff(np.append(at, len(g)))


def _strings(t: Texts) -> list[str]:
    return [t.of(i).decode("utf-8", "replace") for i in range(len(t))]


def train(df: DataFrame, lang_col: str = "lang", text_col: str = "text", top: int = TOP) -> dict[str, np.ndarray]:
    """Profiles (n-grams by rank) by language, from the rows of ``df`` that
    have a language and a text."""
    src = df.select(F.col(f"`{lang_col}`").alias("lang"), F.col(f"`{text_col}`").alias("text")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
        held = 0

        def merged() -> Iterator[pa.RecordBatch]:
            for lang, parts in sums.items():
                g, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
                n = np.bincount(where, np.concatenate([p[1] for p in parts])).astype(np.int64)
                sums[lang] = [(g, n)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(g)), pa.array(g.view(np.int64)), pa.array(n)],
                                                 ["lang", "gram", "n"])

        for batch in batches:
            langs = np.array(batch.column("lang").to_pylist(), object)
            for t in chunks(batch, "text", CHUNK_BYTES):
                names, where = np.unique(langs[t.rows].astype(str), return_inverse=True)
                g = ngrams(_strings(t))
                owner = where.astype(np.uint64)[(g >> _GRAM_BITS).astype(np.int64)]
                of, g, n = _counted((owner << _GRAM_BITS) | (g & _GRAM))
                for k, name in enumerate(names):
                    mine = of == k
                    sums.setdefault(name, []).append((g[mine], n[mine]))
                held += len(g)
            if held > GATHER:
                yield from merged()
                sums, held = {}, 0
        yield from merged()

    counts = src.mapInArrow(lean(run), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= top).collect()
    out: dict[str, list] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], r["rank"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {k: np.array(v, np.int64).view(np.uint64) for k, v in out.items()}


class Classifier:
    """Distances of documents to the profiles."""

    def __init__(self, profiles: dict[str, np.ndarray], top: int = TOP):
        self.names, self.top = sorted(profiles), top
        self._sorted = []
        for n in self.names:
            order = np.argsort(profiles[n], kind="stable")
            self._sorted.append((profiles[n][order], order))

    def predict(self, texts: list[str]) -> tuple[list[str], np.ndarray]:
        """Language and score of each text; the score is one less the mean
        distance of an n-gram as a share of the largest possible."""
        n = len(texts)
        of, g, c = _counted(ngrams(texts))
        order = np.argsort((of << 32) - c, kind="stable")
        of, g = of[order], g[order]
        first = np.searchsorted(of, np.arange(n + 1))
        rank = np.arange(len(g)) - first[of]
        keep = rank < self.top
        of, g, rank = of[keep], g[keep], rank[keep]
        if not self.names:
            return [UND] * n, np.zeros(n)
        used = np.bincount(of, minlength=n)
        dist = np.empty((len(self.names), n))
        for k, (grams, ranks) in enumerate(self._sorted):
            at = np.minimum(np.searchsorted(grams, g), len(grams) - 1)
            far = np.where(grams[at] == g, np.abs(ranks[at] - rank), self.top)
            dist[k] = np.bincount(of, np.minimum(far, self.top).astype(float), n)
        best = dist.argmin(0)
        share = dist[best, np.arange(n)] / (np.maximum(used, 1) * self.top)
        return ([self.names[b] if u else UND for b, u in zip(best, used)], np.where(used > 0, 1 - share, 0.0))


def predict(df: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text",
            carry: list[str] | None = None) -> DataFrame:
    """The columns in ``carry`` as a struct ``row``, ``lang_pred`` and ``score``."""
    carry = carry or df.columns
    src = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{text_col}`").alias("text"))
    schema = T.StructType([src.schema["row"], T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = Classifier(profiles)
        for batch in batches:
            for t in chunks(batch, "text", CHUNK_BYTES):
                names, s = judge.predict(_strings(t))
                yield pa.RecordBatch.from_arrays([batch.column("row")[t.rows], pa.array(names, pa.string()), pa.array(s)],
                                                 ["row", "lang_pred", "score"])

    return src.mapInArrow(lean(run), schema)
