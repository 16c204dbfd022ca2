"""Sum-of-squares online packing of tokenised documents into sequences.

Each Spark partition packs its own documents as they come, without a shuffle.
A document is cut into whole windows of ``size`` tokens; what remains goes to
the fill level for which the sum of the squared counts of partially filled
windows becomes smallest.  The counts lie in one array indexed by level.  A
window's pieces are given out when it is full, so a task holds the open
windows only.  At the end of a partition, or when the open windows hold more
than ``OPEN_TOKENS`` tokens, the fullest open windows are filled up with cuts
from the emptiest ones; the last one is cut into lengths that are powers of
two, which need no padding.

Defined results: a null or empty text is the end token alone; repeated rows
and ids are packed each for itself; an empty table gives no pieces.
"""

from __future__ import annotations

import unicodedata
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.llm.common import lean

SIZE = 4096
END_ID = 2
#: Tokens in open windows before they are closed.
OPEN_TOKENS = 8 << 20
#: Words whose ids a Python worker keeps.
CACHE_WORDS = 800_000
#: A sequence id is partition * SEQUENCES + a number in the partition.
SEQUENCES = 1 << 36


class WordEncoder:
    """Ids of texts by a byte-level BPE tokenizer with word ends that lowers
    its input and never joins across space or newline.  The ids of each new
    word between them are computed once and kept.  A word of letters is one
    unit for the BPE model and goes to it directly; so does a final stop after
    letters; all other words take the tokenizer's whole way."""

    def __init__(self, path: str):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self._tokenizer = Tokenizer.from_file(path)
        self._model = self._tokenizer.model
        self._known: dict[str, bytes] = {}
        # the byte-level alphabet: printable bytes stand for themselves, the others follow 255 in order
        same = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(same)]
        self._letters = {b: chr(b) for b in same} | {b: chr(256 + k) for k, b in enumerate(rest)}
        if set(self._letters.values()) != set(pre_tokenizers.ByteLevel.alphabet()):
            raise ValueError("not the byte-level alphabet")

    def _whole(self, text: str) -> bytes:
        return np.array(self._tokenizer.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()

    def _letters_only(self, word: str) -> bytes:
        """Ids of a word of letters."""
        low = word if word.isascii() else unicodedata.normalize("NFC", word)
        low = low.lower()
        if not low.isalpha():
            return self._whole(word)
        found = self._known.get(low)
        if found is None:
            text = low if low.isascii() else low.encode().decode("latin-1").translate(self._letters)
            found = array("I", [t.id for t in self._model.tokenize(text)]).tobytes()
            self._known[low] = found
        return found

    def _learn(self, new: set[str]) -> None:
        known = self._known
        stop = {c: self._whole(c) for c in ".,"}
        for w in new:
            if w.isalpha() and "\u03a3" not in w:  # a final capital sigma is lowered otherwise
                known[w] = self._letters_only(w)
            elif w[-1:] in stop and w[:-1].isalpha() and "\u03a3" not in w:
                known[w] = self._letters_only(w[:-1]) + stop[w[-1]]
            else:
                known[w] = self._whole(w)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        out = []
        for text in texts:
            parts = text.replace("\n", " ").split(" ")
            ids = list(map(self._known.get, parts))
            if None in ids:
                new = {w for w, i in zip(parts, ids) if i is None}
                if len(self._known) + 2 * len(new) > CACHE_WORDS:
                    self._known.clear()
                    new = set(parts)
                self._learn(new)
                ids = map(self._known.__getitem__, parts)
            out.append(np.frombuffer(b"".join(ids), np.uint32))
        return out


_encoders: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]


class Packer:
    """Online packing into windows; ``out`` gathers finished pieces as
    (document, start, length, ids, document tokens, sequence, offset)."""

    def __init__(self, size: int, first_sequence: int = 0):
        self.size, self.next = size, first_sequence
        self.count = np.zeros(size + 1, np.int64)  # open windows by fill level
        self.open: list[list[list]] = [[] for _ in range(size + 1)]  # their pieces
        self.held = 0
        self.out: list[tuple] = []

    def add(self, doc, ids: np.ndarray) -> None:
        n, whole = len(ids), len(ids) - len(ids) % self.size
        for lo in range(0, whole, self.size):
            self._close([(doc, lo, ids[lo:lo + self.size], n)])
        if whole < n:
            self._place((doc, whole, ids[whole:], n))
        if self.held > OPEN_TOKENS:
            self.finish()

    def level(self, n: int) -> int:
        """The fill level to add ``n`` tokens to (0: a new window).

        Taking a window from level h changes the sum of squares by 1 - 2N(h);
        putting it at level h + n changes it by 2N(h + n) + 1, or not at all
        when it is full.  Of equal changes the highest level wins.
        """
        c = self.count
        top = self.size - n
        rise = 2 * c[n:self.size + 1] + 1
        rise[top] = 0
        fall = np.where(c[:top + 1] > 0, 2 * c[:top + 1] - 1, -(1 << 40))
        fall[0] = 0
        change = rise - fall
        return top - int(np.argmin(change[::-1]))

    def _place(self, piece: tuple) -> None:
        n = len(piece[2])
        h = self.level(n)
        pieces = self.open[h].pop() if h else []
        if h:
            self.count[h] -= 1
            self.held -= h
        pieces.append(piece)
        if h + n == self.size:
            self._close(pieces)
        else:
            self.open[h + n].append(pieces)
            self.count[h + n] += 1
            self.held += h + n

    def _close(self, pieces: list[tuple]) -> None:
        at = 0
        for doc, start, ids, total in pieces:
            self.out.append((doc, start, len(ids), ids, total, self.next, at))
            at += len(ids)
        self.next += 1

    def finish(self) -> None:
        """Close the open windows: fill the fullest from the emptiest."""
        windows = [(h, p) for h in range(self.size - 1, 0, -1) for p in self.open[h]]
        loose: list[tuple] = []  # pieces of emptied windows
        lo, hi = 0, len(windows) - 1
        while lo <= hi:
            h, pieces = windows[lo]
            lo += 1
            gap = self.size - h
            while gap and (loose or lo <= hi):
                if not loose:
                    loose = list(windows[hi][1])
                    hi -= 1
                head, loose[-1:] = _cut(loose[-1], gap)
                pieces = [*pieces, head]
                gap -= len(head[2])
            if gap:
                loose = list(pieces)
            else:
                self._close(pieces)
        left = sum(len(p[2]) for p in loose)
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            pieces = []
            while room:
                head, loose[-1:] = _cut(loose[-1], room)
                pieces.append(head)
                room -= len(head[2])
            self._close(pieces)
        self.count[:] = 0
        self.open = [[] for _ in range(self.size + 1)]
        self.held = 0


def _cut(piece: tuple, room: int) -> tuple[tuple, list[tuple]]:
    """The first ``room`` ids of a piece, and what is left of it."""
    doc, start, ids, total = piece
    if len(ids) <= room:
        return piece, []
    return (doc, start, ids[:room], total), [(doc, start + room, ids[room:], total)]


def pack(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text",
         size: int = SIZE, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents: id, start, length, ids_crc32, doc_tokens,
    sequence_id, offset, and the ids themselves ``with_ids``."""
    kind = df.schema[id_col].dataType
    schema = T.StructType([
        T.StructField(id_col, kind), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()),
        T.StructField("ids_crc32", T.LongType()), T.StructField("doc_tokens", T.LongType()),
        T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType()),
    ] + [T.StructField("ids", T.ArrayType(T.LongType()))] * with_ids)
    from pyspark.sql.pandas.types import to_arrow_type

    id_type = to_arrow_type(kind)

    def batch_of(pieces: list[tuple]) -> pa.RecordBatch:
        ids = [p[3].astype("<u4") for p in pieces]
        cols = [pa.array([p[0] for p in pieces], id_type)]
        cols += [pa.array(v, pa.int64()) for v in (
            [p[1] for p in pieces], [p[2] for p in pieces], [zlib.crc32(x.tobytes()) for x in ids],
            [p[4] for p in pieces], [p[5] for p in pieces], [p[6] for p in pieces])]
        if with_ids:
            cols.append(pa.array([x.astype(np.int64) for x in ids], pa.list_(pa.int64())))
        return pa.RecordBatch.from_arrays(cols, names=[f.name for f in schema])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)
        packer = Packer(size, TaskContext.get().partitionId() * SEQUENCES)
        end = np.array([end_id], np.uint32)
        for b in batches:
            docs, texts = b.column(0).to_pylist(), b.column(1).to_pylist()
            for doc, ids in zip(docs, enc.encode([t or "" for t in texts])):
                packer.add(doc, np.concatenate([ids, end]))
            if packer.out:
                yield batch_of(packer.out)
                packer.out = []
        packer.finish()
        if packer.out:
            yield batch_of(packer.out)

    return df.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`")).mapInArrow(lean(run), schema)
