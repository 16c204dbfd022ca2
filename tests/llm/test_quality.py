import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa

from tests.llm.conftest import NASTY
from wattline.llm import quality as op
from wattline.llm.common import chunks


def table(texts):
    return pa.table({"text": pa.array(texts, pa.string())})


def test_features_do_not_depend_on_the_chunk():
    texts = [t for _, t in NASTY] + ["Some Words, some words.", "A|b|c", "x%%% y$$$ z&&&"]
    whole = np.vstack([op.features(t) for t in chunks(table(texts), "text")])
    single = np.vstack([op.features(t) for x in texts for t in chunks(table([x]), "text")])
    assert whole.shape == (len(texts), len(op.FEATURES)) and np.isfinite(whole).all()
    assert np.allclose(whole, single)
    named = dict(zip(op.FEATURES, single[-2]))
    assert named["bar"] == 2 / 5 and named["distinct"] == 1


def test_additive_model_learns_main_effects_and_an_interaction():
    rng = np.random.default_rng(1)
    x = rng.random((4000, 4))
    z = 3 * (x[:, 0] > 0.6) - 2 * (x[:, 1] < 0.2) + 4 * ((x[:, 2] > 0.5) == (x[:, 3] > 0.5)) - 2.5
    y = (rng.random(4000) < 1 / (1 + np.exp(-z))).astype(float)
    m = op.fit(x[:3000], y[:3000])
    assert {2, 3} in [{j, k} for j, k, _ in m.pairs[:1]]
    s = m.score(x[3000:])
    better = np.mean((s[:, None] > s[None, :])[(y[3000:, None] > y[None, 3000:])])
    assert better > 0.8  # the area under the curve


def test_tree_is_the_best_single_split():
    rng = np.random.default_rng(3)
    g, h = rng.normal(size=12), rng.random(12) + 0.1
    gain = lambda a, b: a * a / (b + 1)
    best = max(range(1, 12), key=lambda k: gain(g[:k].sum(), h[:k].sum()) + gain(g[k:].sum(), h[k:].sum()))
    out = op._tree(g, h, 2)
    assert len(set(out)) == 2 and out[best - 1] != out[best]
    assert np.isclose(out[0], g[:best].sum() / (h[:best].sum() + 1))


def test_train_and_score_in_spark(docs_of, spark):
    rows = [(i, "Good words make a fine text here. " * (1 + i % 3) if i % 2 else "BUY!! NOW!! " * 9) for i in range(60)]
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(60)] + [(None, 1, 0), (3, None, 0), (999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    model = op.train(docs_of(rows), labels)
    out = {r.row.doc_id: r for r in op.score(docs_of(rows), model, carry=["doc_id"]).collect()}
    assert all(out[i].predicted == i % 2 for i in range(60)) and all(0 <= r.score <= 1 for r in out.values())
    again = op.train(docs_of(rows), labels.repartition(7))
    assert all(np.array_equal(a, b) for a, b in zip(model.tables, again.tables))
    assert op.score(docs_of(NASTY), model).count() == len(NASTY) and op.score(docs_of([]), model).count() == 0
    empty = op.train(docs_of(rows), labels.where("doc_id < 0"))
    assert {r.score for r in op.score(docs_of(NASTY), empty).collect()} == {0.5}


def plain_features(text):
    """The features of one text, byte by byte and word by word."""
    raw = (text or "").encode()
    found = re.findall(rb"[^\x20\x09-\x0D]+", raw)
    of = lambda chars: sum(c in chars for c in raw) / max(len(raw), 1)
    share = lambda n: n / max(len(found), 1)
    count = Counter(found)
    symbols = b"#$%&*+/<=>@[\\]^_`{}~"
    odd = set(symbols) | set(b".,;:!?'\"()-") | set(range(128, 256))
    return [np.log1p(len(raw)), np.log1p(len(found)), share(sum(map(len, found))), of(bytes(range(65, 91))),
            of(b"0123456789"), of(b" \t\x0b\x0c\r"), of(b"\n"), of(b"|"), of(symbols), of(b".,;:!?'\"()-"),
            of(bytes(range(128, 256))), share(sum(a == b for a, b in zip(found, found[1:]))), share(len(count)),
            share(sum(a == b for a, b in zip(found, found[2:]))), share(max(count.values(), default=0)),
            share(sum(65 <= w[0] <= 90 for w in found)), share(sum(w[-1] in odd for w in found))]


def test_features_equal_a_plain_count():
    texts = [t for _, t in NASTY] + ["Some Words, some words.", "a a a b a b", "x%%% y$$$ | 12 3.5\r\n\tÉcole (so)", "Z"]
    got = np.vstack([op.features(t) for t in chunks(table(texts), "text")])
    assert np.allclose(got, [plain_features(t) for t in texts], rtol=1e-12, atol=0)


def plain_fit(x, y):
    """The model of small data by loops over rows: (edges, tables, pairs, base)."""
    n, d = x.shape
    edges = [sorted(set(np.quantile(x[:, j], [i / op.BINS for i in range(1, op.BINS)]).tolist())) for j in range(d)]
    place = [[sum(e <= v for e in edges[j]) for j, v in enumerate(row)] for row in x]
    size = [len(e) + 1 for e in edges]
    p = min(max(sum(y) / n, 1e-3), 1 - 1e-3)
    base = math.log(p / (1 - p))
    z = [base] * n
    tables = [[0.0] * s for s in size]
    gain = lambda g, h: g * g / (h + 1)

    def slopes():
        s = [1 / (1 + math.exp(-v)) for v in z]
        return [a - b for a, b in zip(y, s)], [max(a * (1 - a), 1e-6) for a in s]

    def line(j):
        """Leaf values along feature j."""
        g, h = slopes()
        G, H = [0.0] * size[j], [0.0] * size[j]
        for i in range(n):
            G[place[i][j]] += g[i]
            H[place[i][j]] += h[i]
        leaves = [(0, size[j])]
        while len(leaves) < op.LEAVES:
            best = None
            for lo, hi in leaves:
                for m in range(lo + 1, hi):
                    a, b, c, e = sum(G[lo:m]), sum(H[lo:m]), sum(G[m:hi]), sum(H[m:hi])
                    v = gain(a, b) + gain(c, e) - gain(a + c, b + e)
                    if b > 1e-3 and e > 1e-3 and v > 1e-6 and (best is None or v > best[0] + 1e-12):
                        best = (v, lo, m, hi)
            if best is None:
                break
            _, lo, m, hi = best
            leaves = sorted([*(x for x in leaves if x != (lo, hi)), (lo, m), (m, hi)])
        out = [0.0] * size[j]
        for lo, hi in leaves:
            out[lo:hi] = [sum(G[lo:hi]) / (sum(H[lo:hi]) + 1)] * (hi - lo)
        return out

    def plane(j, k):
        """Leaf values over features j and k, and the gain."""
        g, h = slopes()
        best = None
        for u in range(1, size[j]):
            for v in range(1, size[k]):
                cell = [[0.0, 0.0] for _ in range(4)]
                for i in range(n):
                    c = cell[2 * (place[i][j] >= u) + (place[i][k] >= v)]
                    c[0] += g[i]
                    c[1] += h[i]
                worth = sum(gain(*c) for c in cell)
                if best is None or worth > best[0] + 1e-12:
                    best = (worth, u, v, [a / (b + 1) for a, b in cell])
        worth, u, v, leaf = best
        out = [[leaf[2 * (a >= u) + (b >= v)] for b in range(size[k])] for a in range(size[j])]
        return out, worth - gain(sum(g), sum(h))

    for _ in range(op.ROUNDS):
        for j in range(d):
            step = line(j)
            for i in range(n):
                z[i] += op.RATE * step[place[i][j]]
            tables[j] = [a + op.RATE * b for a, b in zip(tables[j], step)]
    ranked = sorted(((plane(j, k)[1], j, k) for j in range(d) for k in range(j + 1, d)
                     if size[j] > 1 and size[k] > 1), reverse=True)[:op.PAIRS]
    pairs = {(j, k): np.zeros((size[j], size[k])) for _, j, k in ranked}
    for _ in range(op.PAIR_ROUNDS):
        for (j, k), t in pairs.items():
            step = op.RATE * np.array(plane(j, k)[0])
            t += step
            for i in range(n):
                z[i] += step[place[i][j]][place[i][k]]
    return edges, tables, pairs, base, z


def test_fit_equals_boosting_by_loops(monkeypatch):
    for name, value in (("BINS", 6), ("ROUNDS", 8), ("PAIRS", 2), ("PAIR_ROUNDS", 3), ("LEAVES", 3)):
        monkeypatch.setattr(op, name, value)
    monkeypatch.setattr(op._tree, "__defaults__", (3,))
    rng = np.random.default_rng(5)
    x = np.column_stack([rng.random(90), rng.random(90), rng.integers(0, 3, 90), np.ones(90)])
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.4)).astype(float)
    y[::9] = 1 - y[::9]
    m = op.fit(x, y)
    edges, tables, pairs, base, z = plain_fit(x, y)
    assert all(np.allclose(a, b) for a, b in zip(m.edges, edges)) and np.isclose(m.base, base)
    assert all(np.allclose(a, b, atol=1e-9) for a, b in zip(m.tables, tables))
    assert {(j, k) for j, k, _ in m.pairs} == set(pairs)
    assert all(np.allclose(t, pairs[j, k], atol=1e-9) for j, k, t in m.pairs)
    assert np.allclose(m.margin(m.bins(x)), z, atol=1e-9)  # a sum of table entries
