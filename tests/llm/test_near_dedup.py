import random
from collections import Counter

import numpy as np
import pytest

from tests.llm.conftest import NASTY
from wattline.llm import near_dedup as op
from wattline.llm.common import mix
from wattline.llm.components import components


def weighted(text):
    w = (text or "").encode().split()
    return Counter(tuple(w[i:i + 5]) for i in range(max(len(w) - 4, 1 if w else 0)))


def jaccard(a, b):
    both = sum((a & b).values())
    return both / max(sum(a.values()) + sum(b.values()) - both, 1)


def brute(rows):
    """id -> smallest id of its class, for distinct non-null ids."""
    rows = sorted(rows)
    root = {d: d for d, _ in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    sets = {d: weighted(t) for d, t in rows}
    for i, (a, _) in enumerate(rows):
        for b, _ in rows[:i]:
            if sets[a] and sets[b] and jaccard(sets[a], sets[b]) >= 0.8:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {d: find(d) for d in root}


def family(seed, groups, per, words=120):
    """Copies of a text with some words changed, and unrelated texts."""
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    rows, d = [], 0
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(words)]
        for _ in range(per):
            t = list(base)
            for _ in range(rng.choice([0, 1, 1, 2, 4, 9])):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            rows.append((d, " ".join(t)))
            d += 1
    return rows


@pytest.mark.parametrize("crowd", [2048, 3])
def test_classes_equal_brute_force(docs_of, crowd, monkeypatch):
    monkeypatch.setattr(op, "CROWD", crowd)
    rows = family(5, 12, 9) + [(5000 + i, t) for i, (_, t) in enumerate(NASTY) if t]
    want = brute(rows)
    got = {r.doc_id: r.class_id for r in op.near_dedup(docs_of(rows)).collect()}
    assert got.keys() == want.keys()
    assert got == want


def star(copies, seed=3, words=400, changed=6, original=100_000):
    """A text with the largest id, and copies near to it that aren't near one another."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    rows = [(original, " ".join(base))]
    for d in range(copies):
        t = list(base)
        for k in rng.sample(range(0, words // 6), changed):
            t[6 * k + 3] = f"c{d}x{k}"
        rows.append((d, " ".join(t)))
    return rows


@pytest.mark.parametrize("rows", [family(5, 12, 9), family(6, 3, 40), star(60)])
def test_crowds_are_compared_in_full(docs_of, rows, monkeypatch):
    monkeypatch.setattr(op, "CROWD", 3)
    assert {r.doc_id: r.class_id for r in op.near_dedup(docs_of(rows)).collect()} == brute(rows)


@pytest.mark.parametrize("groups", [1, 7])
def test_links_between_parts(groups):
    rng = np.random.default_rng(4)
    base = np.unique(rng.integers(0, 5000, 80).astype(np.uint32))
    names = []
    for _ in range(40):
        k = int(rng.integers(0, 14))
        names.append(np.union1d(np.setdiff1d(base, rng.choice(base, k)), rng.integers(0, 5000, k).astype(np.uint32)))
    group = [(int(g), 0) for g in rng.integers(0, groups, 40)]
    root = {g: g for g in group}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, x in enumerate(names[:25]):
        for j, y in enumerate(names[25:]):
            both = len(np.intersect1d(x, y))
            if both / (len(x) + len(y) - both) >= 0.8:
                root[find(group[i])] = find(group[25 + j])
    links = op.crossed(names[:25], names[25:], group[:25], group[25:], 0.8)
    assert len(links) == len(set(group)) - len({find(g) for g in group})
    for i, j in links:
        assert find(group[i]) == find(group[25 + j])


def test_sizes_and_who_stays(docs_of):
    text = " ".join(f"x{i}" for i in range(60))
    out = op.near_dedup(docs_of([(3, text), (1, text), (2, text + " more"), (9, ""), (8, None), (None, text)])).collect()
    got = {r.doc_id: (r.class_id, r.class_size, r.kept) for r in out}
    assert got[9] == (9, 1, True) and got[8] == (8, 1, True)
    assert got[None] == (None, 4, True) and got[1] == (None, 4, False) and got[2] == (None, 4, False)


def test_nasty_rows_empty_table_and_names(docs_of, spark):
    assert op.near_dedup(docs_of([])).count() == 0
    assert op.near_dedup(docs_of(NASTY)).count() == len(NASTY)
    odd = spark.createDataFrame([(1, "a b c", 1, "x"), (2, "a b c", 2, "y")], "doc_id long, text string, ver int, bands string")
    assert [r.asDict() for r in op.drop_near(odd).collect()] == [{"doc_id": 1, "text": "a b c", "ver": 1, "bands": "x"}]


@pytest.mark.parametrize("similarity,weight", [(0.5, 1), (0.8, 1), (0.8, 3)])
def test_signatures_agree_as_often_as_the_sets_are_similar(similarity, weight):
    rng = np.random.default_rng(0)
    both = 600
    own = round(both * (1 - similarity) / (2 * similarity))
    shared, a, b = (rng.integers(0, 1 << 62, n).astype(np.uint64) for n in (both, own, own))
    hits = []
    for k in range(40):
        h = mix(np.concatenate([shared, a, shared, b]) + np.uint64(k * 7919 + 1))
        doc = np.repeat([0, 1], both + own)
        s = op.signatures(doc, h, np.full(len(h), weight), 2)
        assert (s != op._NONE).all()
        hits.append((s[0] == s[1]).mean())
    assert abs(np.mean(hits) - similarity) < 4 * (similarity * (1 - similarity) / op.HASHES / 40) ** 0.5


def test_links_of_a_bucket(monkeypatch):
    rng = np.random.default_rng(2)
    for trial in range(30):
        base = [np.unique(rng.integers(0, 5000, 80).astype(np.uint32)) for _ in range(4)]
        names = []
        for _ in range(int(rng.integers(2, 50))):
            b, k = base[rng.integers(4)], int(rng.integers(0, 14))
            names.append(np.union1d(np.setdiff1d(b, rng.choice(b, k)), rng.integers(0, 5000, k).astype(np.uint32)))
        monkeypatch.setattr(op, "CROWD", int(rng.choice([5, 2048])))
        monkeypatch.setattr(op, "TILE", 64)
        links, first = op.linked(names, 0.8)
        root = list(range(len(names)))

        def find(x):
            while root[x] != x:
                x = root[x]
            return x
        for i, x in enumerate(names):
            for j, y in enumerate(names[:i]):
                both = len(np.intersect1d(x, y))
                if both / (len(x) + len(y) - both) >= 0.8:
                    p, q = find(i), find(j)
                    root[max(p, q)] = min(p, q)
        assert first.tolist() == [find(i) for i in range(len(names))]
        assert len(links) == len(names) - len(set(first))


def test_components(spark):
    rng = random.Random(1)
    links = [(i, i + 1) for i in range(40)] + [(rng.randint(100, 160), rng.randint(100, 160)) for _ in range(45)] + [(200, 200)]
    df = spark.createDataFrame(links + links[:5], "a long, b long")
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r.v: r.root for r in components(df).collect()}
    assert got == {v: find(v) for a, b in links if a != b for v in (a, b)}
    assert components(df.where("a < 0")).count() == 0
