import math
import zlib
from collections import Counter

import numpy as np
import public_tokenizers

from tests.llm.conftest import NASTY
from wattline.llm import sampling as op

PATH = public_tokenizers.path("piece_bpe_32k.model")


def every_segmentation(text, v):
    out = {}

    def go(words, ids, log_p):
        if not words:
            out[tuple(ids)] = log_p
            return

        def inner(i, ids, log_p):
            if i == len(words[0]):
                go(words[1:], ids, log_p)
            for j in range(i + 1, len(words[0]) + 1):
                if (p := v.ids.get(words[0][i:j])) is not None:
                    inner(j, [*ids, p], log_p + v.log_p[p])
        inner(0, ids, log_p)

    data, start, end, _ = op.split([text.encode()])
    go([op.spelled(data[a:b].tobytes()) for a, b in zip(start, end)], [], 0.0)
    total = np.logaddexp.reduce(list(out.values()))
    return {k: math.exp(x - total) for k, x in out.items()}


def test_distribution_without_replacement():
    v = op.pieces(PATH)
    text, n, k = "so in", 6000, 3
    p = every_segmentation(text, v)
    found = op.sample([text.encode()] * n, np.arange(n, dtype=np.uint64) * np.uint64(1_000_003), op.Lattices(v), k)
    first = Counter(tuple(f[0][0].tolist()) for f in found)
    second = Counter(tuple(f[1][0].tolist()) for f in found)
    for s, q in p.items():
        q2 = sum(r * q / (1 - r) for t, r in p.items() if t != s)
        assert abs(first[s] / n - q) < 5 * (q * (1 - q) / n) ** 0.5 + 1e-4
        assert abs(second[s] / n - q2) < 5 * (q2 * (1 - q2) / n) ** 0.5 + 1e-4
    for f in found[:300]:
        assert len({tuple(x[0].tolist()) for x in f}) == k
        assert all(abs(x[1] - math.log(p[tuple(x[0].tolist())])) < 1e-9 for x in f)
        assert all(a[2] >= b[2] for a, b in zip(f, f[1:])) and all(0 < x[3] <= 1 for x in f)
    # weights 1 / inclusion make the sample's total probability an unbiased estimate of 1
    assert abs(np.mean([sum(math.exp(x[1]) / x[3] for x in f) for f in found]) - 1) < 0.02


def test_runs_of_blanks_take_all_pieces_of_the_model():
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    normal = {model.id_to_piece(i): i for i in range(model.get_piece_size())
              if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))}
    v = op.pieces(PATH)
    assert v.ids == normal and sum("▁" in p[1:] for p in normal) == 14
    for text in ["a   b", "  a", "a    ", "a\n  b"]:
        spelled = "▁" + text.replace(" ", "▁")
        full = {}

        def go(i, ids, log_p):
            if i == len(spelled):
                full[tuple(ids)] = log_p
            elif spelled[i] == "\n":
                go(i + 1, [*ids, int(v.byte[10])], log_p + v.log_p[v.byte[10]])
            for j in range(i + 1, len(spelled) + 1):
                if (p := normal.get(spelled[i:j])) is not None:
                    go(j, [*ids, p], log_p + v.log_p[p])
        go(0, [], 0.0)
        total = np.logaddexp.reduce(list(full.values()))
        found = op.sample([text.encode()], np.array([7], np.uint64), op.Lattices(v), len(full) + 1)[0]
        got = {tuple(x[0].tolist()): x[1] for x in found}
        assert got.keys() == full.keys() and all(abs(got[k] - (full[k] - total)) < 1e-9 for k in full)
        assert all(v.decode(k) == text.encode() for k in full)
    for text in ["a  b", "a   b", "  x", "a  ", "def f():\n        return 1", "x" + " " * 40 + "y", "é   你  好"]:
        assert v.decode(model.encode(text)) == text.encode()


def test_fewer_segmentations_than_samples():
    v = op.pieces(PATH)
    found = op.sample([b"", b"a"], np.array([1, 2], np.uint64), op.Lattices(v), 6)
    assert len(found[0]) == 1 and found[0][0][3] == 1.0 and v.decode(found[0][0][0]) == b""
    assert len(found[1]) == len(every_segmentation("a", v)) and all(x[3] == 1.0 for x in found[1])


def test_round_trip_of_odd_texts(docs_of):
    rows = NASTY + [(20, " ▁lead ▁▁ and\n▁ after"), (21, "\x00b"), (22, "tab\tand\r\n line\n\n")]
    out = op.sample_segmentations(docs_of(rows), PATH, k=2)
    back = op.decode(out, PATH).collect()
    texts = Counter((d, t or "") for d, t in rows)
    assert Counter((r.row.doc_id, r.decoded) for r in back if r.sample == 0) == texts
    for r in back:
        assert r.decoded_crc32 == zlib.crc32(r.decoded.encode()) and r.n_pieces == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())


def test_samples_depend_on_row_and_seed_only(docs_of):
    rows = [(i, "the same text in every row of them") for i in range(40)]
    key = lambda df: sorted((r.row.doc_id, r.sample, tuple(r.ids)) for r in df.collect())
    a = key(op.sample_segmentations(docs_of(rows), PATH))
    assert a == key(op.sample_segmentations(docs_of(rows[::-1]).repartition(5), PATH))
    assert a != key(op.sample_segmentations(docs_of(rows), PATH, seed=7))
    assert len({x[2] for x in a if x[1] == 0}) > 1
    assert op.sample_segmentations(docs_of([]), PATH).count() == 0
