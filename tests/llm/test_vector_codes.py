import hashlib
import math
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattline.llm import vector_codes as op

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, entries, parts, rounds):
    """The codes by comparing all parts with all entries, in Python's whole numbers."""
    ok = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    ok.sort(key=lambda r: (r[0] is None, r[0] or 0, [math.floor(1024 * float(np.float32(x))) for x in r[1]]))
    dim = len(ok[0][1])
    ok = [r for r in ok if len(r[1]) == dim]
    d = -(-dim // parts)
    cut = []
    for r in ok:
        v = [math.floor(1024 * float(np.float32(x))) for x in r[1]] + [0] * (d * parts - dim)
        cut.append([v[p * d:(p + 1) * d] for p in range(parts)])
    books = [[cut[i][p] for i in range(min(entries, len(cut)))] for p in range(parts)]

    def near(v, book):
        return min((sum((a - b) ** 2 for a, b in zip(v, e)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = defaultdict(list)
            for c in cut:
                groups[near(c[p], books[p])[1]].append(c[p])
            for k, g in groups.items():
                books[p][k] = [sum(x) // len(g) for x in zip(*g)]
    out = []
    for r, c in zip(ok, cut):
        found = [near(c[p], books[p]) for p in range(parts)]
        out.append((r[0], r[2], tuple(k for _, k in found), sum(e for e, _ in found)))
    return out, books


def vectors(seed, n, dim, kinds=5):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(kinds, dim))
    rows = [(int(i) * 3 - 50, [float(np.float32(x)) for x in centres[i % kinds] + 0.2 * rng.normal(size=dim)], int(i) % 4 or None)
            for i in range(n)]
    return rows


@pytest.mark.parametrize("dim,entries,parts", [(16, 8, 4), (10, 5, 4), (12, 70, 2), (3, 200, 1)])
def test_equals_all_pairs(spark, dim, entries, parts):
    rows = vectors(dim, 120, dim)
    rows += [(r[0], r[1], r[2]) for r in rows[:20]]  # repeated rows
    rows += [(900, None, 1), (901, [], 1), (902, [float("nan")] * dim, 1), (903, [float("inf")] * dim, 2), (None, [0.5] * dim, None),
             (904, [0.1] * (dim - 1) + [None], 1), (905, [0.25] * (dim + 1), 1), (906, [0.0] * dim, 7), (907, [0.0] * dim, 7)]
    df = spark.createDataFrame(rows, SCHEMA)
    books = op.train(df, entries=entries, parts=parts, rounds=3)
    want, plain_books = plain(rows, entries, parts, 3)
    assert [b.tolist() for b in books.books] == plain_books
    flat = ",".join(str(x) for b in plain_books for e in b for x in e)
    assert books.digest() == hashlib.sha256(flat.encode()).hexdigest()
    out = op.with_label_error(op.encode(df, books)).collect()
    key = lambda r: repr(r)
    assert sorted([(r.row.vec_id, r.row.label, tuple(r.codes), r.error) for r in out], key=key) == sorted(want, key=key)
    per = defaultdict(int)
    for _, label, _, e in want:
        per[label] += e
    assert all(r.label_error == per[r.row.label] for r in out)


def test_nearest_with_ties_and_far_queries():
    rng = np.random.default_rng(1)
    book = rng.integers(-5, 6, (256, 4))
    book[100:120] = book[:20]  # equal entries: the lower index counts
    q = np.vstack([rng.integers(-6, 7, (500, 4)), rng.integers(-4000, 4000, (50, 4)), np.full((1, 4), op.LIMIT)])
    far = ((q[:, None, :] - book[None]) ** 2).sum(2)
    code, dist = op.Codebook(book).nearest(q)
    assert (dist == far.min(1)).all() and (code == far.argmin(1)).all()
    live = op.Codebook(book).candidates(q[:50], np.full(50, 2))
    bits = np.unpackbits(live.view(np.uint8).reshape(50, -1), axis=1, bitorder="little").astype(bool)
    assert (bits == (abs(q[:50, None, :] - book[None]) <= 2).all(2)).all()


def test_light_and_heavy_labels(spark):
    rows = [(i, [float(i % 7), 1.0, 2.0, 0.5 * (i % 3)], i if i % 3 else 1) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = op.with_label_error(op.encode(df, op.train(df, entries=4, rounds=1)))
    sums = out.groupBy("row.label").agg(F.sum("error").alias("s"), F.min("label_error").alias("a"), F.max("label_error").alias("b"))
    assert sums.where("s <> a OR s <> b").count() == 0 and out.count() == 3000


def test_decode_empty_and_clashing_names(spark):
    df = spark.createDataFrame(vectors(3, 40, 8), SCHEMA).withColumns({n: F.lit(1) for n in ("v", "codes", "error", "row", "_l", "_k", "_n")})
    books = op.train(df, entries=64)
    coded = op.encode(df, books)
    assert {c for c in coded.select("row.*").columns} == set(df.columns) - {"embedding"}
    assert op.with_label_error(coded).count() == 40
    back = op.decode(coded, books).collect()
    src = {r.vec_id: r.embedding for r in df.collect()}
    assert all(max(abs(a - b) for a, b in zip(r.vector, src[r.row.vec_id])) < 2 / 1024 for r in back)
    none = spark.createDataFrame([], SCHEMA)
    assert op.train(none) is None and op.with_label_error(op.encode(none, None)).collect() == []
    empty = spark.createDataFrame([(1, None, 1)], SCHEMA)
    assert op.train(empty) is None
