import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from tests.llm.conftest import NASTY
from wattline.llm import lm as op
from wattline.llm.elias_fano import EliasFano, Trie

TRAIN = "crc32(coalesce(cast(doc_id AS string), '')) % 7 != 2"


def tokens(text):
    low = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return [*low.split(), None]


def brute(rows):
    held = {i: zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for i, (d, _) in enumerate(rows)}
    words, pairs, after = Counter(), Counter(), defaultdict(set)
    for i, (_, t) in enumerate(rows):
        if not held[i]:
            k = tokens(t)
            words.update(k)
            for v, w in zip([None, *k], k):
                pairs[v, w] += 1
                after[v].add(w)
    n, v_ = sum(words.values()), len(words)
    out = []
    for i, (d, t) in enumerate(rows):
        k = tokens(t)
        base = score = 0.0
        for v, w in zip([None, *k], k):
            p = (words[w] + 1) / (n + v_ + 1)
            base += math.log10(p)
            if words[v]:
                p = max(pairs[v, w] - op.DISCOUNT, 0) / words[v] + op.DISCOUNT * len(after[v]) / words[v] * p
            score += math.log10(p)
        out.append((d, held[i], len(k), sum(words[w] > 0 for w in k), n, base, score))
    return out


@pytest.mark.parametrize("block,spread", [(1 << 19, 0.25), (40, 0.25), (40, 1e-6)])
def test_brute_force(docs_of, monkeypatch, block, spread):
    monkeypatch.setattr(op, "SPREAD", spread)
    rng = random.Random(8)
    vocabulary = ["the", "The", "of", "x\ty", "é", *(f"w{i}" for i in range(40))]
    rows = NASTY + [(100 + i, " ".join(rng.choice(vocabulary[:rng.randint(2, 45)]) for _ in range(rng.randint(0, 30))))
                    for i in range(150)]
    monkeypatch.setattr(op.as_blocks, "__defaults__", (block, *op.as_blocks.__defaults__[1:]))
    out = op.score(docs_of(rows), TRAIN).collect()
    key = lambda r: (r[0] is None, r[0] or 0, r[2], r[5])
    want = sorted(brute(rows), key=key)
    got = sorted((tuple(r) for r in out), key=key)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    for g, w in zip(got, want):
        assert g[5] == pytest.approx(w[5], rel=1e-12)
        assert g[6] == pytest.approx(w[6], abs=op.STEP * w[2])  # a token's error is half a step at most


def brute_of_order(rows, order):
    """(doc, tokens, score) of each row, by counts of all contexts that lie in a document."""
    held = [zlib.crc32(("" if d is None else str(d)).encode()) % 7 == 2 for d, _ in rows]
    texts = [[None, *tokens(t)] for _, t in rows]
    words, grams, context, after = Counter(), Counter(), Counter(), defaultdict(set)
    for k, out in zip(texts, held):
        if not out:
            words.update(k[1:])
            for i in range(1, len(k)):
                for m in range(1, min(i, order - 1) + 1):
                    h = tuple(k[i - m:i])
                    grams[h, k[i]] += 1
                    context[h] += 1
                    after[h].add(k[i])
    scores = []
    for (d, _), k in zip(rows, texts):
        score = 0.0
        for i in range(1, len(k)):
            p = (words[k[i]] + 1) / (sum(words.values()) + len(words) + 1)
            for m in range(1, min(i, order - 1) + 1):
                h = tuple(k[i - m:i])
                if context[h]:
                    p = max(grams[h, k[i]] - op.DISCOUNT, 0) / context[h] + op.DISCOUNT * len(after[h]) / context[h] * p
            score += math.log10(p)
        scores.append((d, len(k) - 1, score))
    return scores


@pytest.mark.parametrize("order,block,spread", [(1, 40, 0.25), (3, 1 << 19, 0.25), (3, 40, 1e-6), (4, 40, 0.25)])
def test_longer_orders(docs_of, monkeypatch, order, block, spread):
    monkeypatch.setattr(op, "SPREAD", spread)
    rng = random.Random(9)
    rows = NASTY + [(100 + i, " ".join(f"w{rng.randint(0, rng.randint(1, 12))}" for _ in range(rng.randint(0, 30))))
                    for i in range(150)]
    monkeypatch.setattr(op.as_blocks, "__defaults__", (block, *op.as_blocks.__defaults__[1:]))
    key = lambda r: (r[0] is None, r[0] or 0, r[1], r[2])
    got = sorted(((r.id, r.n_tokens, r.score) for r in op.score(docs_of(rows), TRAIN, order=order).collect()), key=key)
    want = sorted(brute_of_order(rows, order), key=key)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    for g, w in zip(got, want):
        assert g[2] == pytest.approx(w[2], abs=op.STEP * w[1])


def test_empty_table_and_no_training_rows(docs_of):
    assert op.score(docs_of([]), TRAIN).count() == 0
    for r in op.score(docs_of([(1, "a b"), (2, None)]), "false").collect():
        assert r.train_tokens == 0 and r.n_known == 0 and r.score == r.base_score == 0.0


def test_elias_fano():
    rng = np.random.default_rng(1)
    for _ in range(120):
        n, top = int(rng.integers(0, 300)), int(10 ** rng.integers(1, 10))
        v = np.sort(rng.integers(0, top, n))
        e = EliasFano(EliasFano.pack(v))
        assert (e.access(np.arange(n)) == v).all()
        x = np.concatenate([rng.integers(0, top + 5, 100), v, v + 1, np.maximum(v - 1, 0)])
        assert (e.successor(x) == np.searchsorted(v, x)).all()


def test_trie_in_a_memory_map(tmp_path):
    rng = np.random.default_rng(2)
    key = np.unique(rng.integers(0, 40, 900) << 20 | rng.integers(0, 60, 900))
    (tmp_path / "trie").write_bytes(Trie.pack(key >> 20, key & 0xFFFFF, np.arange(len(key))))
    trie = Trie(np.memmap(tmp_path / "trie", np.uint8, "r"))
    c, w = rng.integers(0, 42, 2000), rng.integers(0, 62, 2000)
    at = np.minimum(np.searchsorted(key, c << 20 | w), len(key) - 1)
    assert (trie.find(c, w) == np.where(key[at] == (c << 20 | w), at, -1)).all()
    assert (trie.codes == np.arange(len(key))).all()
    assert (Trie(Trie.pack(*[np.zeros(0, int)] * 3)).find(c, w) == -1).all()


def test_too_many_words_fail():
    op.check_ids((1 << 31) // 64 - 1, 64)
    with pytest.raises(ValueError):
        op.check_ids((1 << 31) // 64, 64)
