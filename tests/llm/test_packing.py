import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest

from tests.llm.conftest import NASTY
from wattline.llm import packing as op

PATH = public_tokenizers.path("word_bpe_49k.json")


def ids_of(text):
    enc = op.encoder(PATH)
    return [*enc._tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_encoder_equals_tokenizer():
    texts = [t or "" for _, t in NASTY] + ["don't WE'LL, 12ab. .. ,.", "ΑΣ ΑΣ. İx", "<|endoftext|> a\tb"]
    for text, ids in zip(texts, op.encoder(PATH).encode(texts)):
        assert [*ids.tolist(), 2] == ids_of(text)


def test_pieces_cover_each_id_once(docs_of):
    rows = [r for r in NASTY if r[0] is not None and r[0] != 4] + [(100 + i, "word " * (i * 37 % 900)) for i in range(200)]
    out = op.pack(docs_of(rows), PATH, with_ids=True).collect()
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in out:
        by_doc[r.doc_id].append(r)
        by_seq[r.sequence_id].append(r)
        assert r.length == len(r.ids) > 0
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
    assert set(by_doc) == {d for d, _ in rows}
    for d, text in rows:
        pieces = sorted(by_doc[d], key=lambda r: r.start)
        whole = ids_of(text)
        assert [i for r in pieces for i in r.ids] == whole
        assert all(r.doc_tokens == len(whole) for r in pieces)
        assert [r.start for r in pieces] == list(np.cumsum([0] + [r.length for r in pieces])[:-1])
    padding = 0
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r.offset)
        ends = np.cumsum([r.length for r in pieces])
        assert [r.offset for r in pieces] == [0, *ends[:-1]]
        assert ends[-1] <= op.SIZE
        padding += 0 if ends[-1] & (ends[-1] - 1) == 0 else op.SIZE - ends[-1]
    assert padding == 0


def test_repeated_rows_null_ids_and_empty_table(docs_of):
    assert op.pack(docs_of([]), PATH).count() == 0
    out = op.pack(docs_of(NASTY), PATH).collect()
    assert sum(r.length for r in out if r.doc_id is None) == len(ids_of("null id and text")) + 1
    assert sum(r.length for r in out if r.doc_id == 4) == 2 * len(ids_of("a"))


def test_level_minimises_the_sum_of_squares():
    rng = np.random.default_rng(5)
    p = op.Packer(16)
    for _ in range(500):
        n = int(rng.integers(1, 16))
        options = {}
        for h in range(0, 17 - n):
            if h and not p.count[h]:
                continue
            c = p.count.copy()
            if h:
                c[h] -= 1
            if h + n < 16:
                c[h + n] += 1
            options[h] = int((c[1:16] ** 2).sum())
        best = min(options.values())
        assert p.level(n) == max(h for h, v in options.items() if v == best)
        p._place((0, 0, np.zeros(n, np.uint32), n))


def test_open_windows_are_bounded(monkeypatch):
    monkeypatch.setattr(op, "OPEN_TOKENS", 1000)
    p = op.Packer(64)
    for i in range(300):
        p.add(i, np.zeros(40, np.uint32))  # two never fit together
        assert p.held <= 1000
    p.finish()
    assert sum(x[2] for x in p.out) == 300 * 40


@pytest.mark.parametrize("n", [0, 1, 4096, 4097, 12_288])
def test_lengths_around_a_window(n):
    p = op.Packer(4096)
    p.add("d", np.arange(n + 1, dtype=np.uint32))
    p.finish()
    assert sorted((x[1], x[2]) for x in p.out)[0][0] == 0
    assert sum(x[2] for x in p.out) == n + 1
