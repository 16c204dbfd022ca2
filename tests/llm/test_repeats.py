import hashlib
import random

import numpy as np
import pytest

from tests.llm.conftest import NASTY
from wattline.llm import repeats, substring_dedup, suffix_dedup


def order(d):
    return repeats.NULL_ID if d is None else d


def brute_words(rows, width):
    seen = {}
    for d, t in rows:
        w = (t or "").encode().split()
        for i in range(len(w) - width + 1):
            k = tuple(w[i:i + width])
            seen[k] = min(seen.get(k, order(d)), order(d))
    out = []
    for d, t in rows:
        w = (t or "").encode().split()
        gone = np.zeros(len(w), bool)
        for i in range(len(w) - width + 1):
            if seen[tuple(w[i:i + width])] < order(d):
                gone[i:i + width] = True
        kept = b" ".join(x for x, g in zip(w, gone) if not g)
        out.append((d, len(w), int(gone.sum()), kept.decode()))
    return sorted(out, key=str)


def brute_bytes(rows, width):
    seen = {}
    for d, t in rows:
        b = (t or "").encode()
        for i in range(len(b) - width + 1):
            k = b[i:i + width]
            seen[k] = min(seen.get(k, (order(d), i)), (order(d), i))
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            if seen[b[i:i + width]] < (order(d), i):
                gone[i:i + width] = True
        runs = int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum())
        out.append((d, len(b), int(gone.sum()), runs, np.frombuffer(b, np.uint8)[~gone].tobytes()))
    return sorted(out, key=str)


def corpus(seed, n, vocabulary):
    """Documents with passages, copies, edits and periodic parts."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abc") for _ in range(rng.randint(1, 4))) for _ in range(vocabulary)]
    passages = [[rng.choice(words) for _ in range(rng.randint(40, 130))] for _ in range(6)]
    rows = []
    for i in range(n):
        parts = []
        for _ in range(rng.randint(0, 4)):
            kind = rng.random()
            if kind < 0.4:
                p = list(rng.choice(passages))
                if rng.random() < 0.5:
                    p[rng.randrange(len(p))] = "edit"
                parts += p[rng.randint(0, 20):]
            elif kind < 0.55:
                parts += rng.sample(words, 2) * rng.randint(5, 60)
            elif kind < 0.65:
                parts += [rng.choice(words)] * rng.randint(5, 120)
            else:
                parts += [rng.choice(words) for _ in range(rng.randint(0, 90))]
        rows.append((rng.randint(0, 3 * n), rng.choice([" ", "\n", "  "]).join(parts)))
    return rows


def unique_ids(rows):
    return list({d: (d, t) for d, t in rows}.values())


@pytest.mark.parametrize("seed", [1, 2])
def test_words_brute_force(docs_of, seed):
    rows = corpus(seed, 60, 40) + [r for r in NASTY if r[0] != 4]
    out = substring_dedup.substring_dedup(docs_of(rows)).collect()
    got = sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_words) for r in out), key=str)
    assert got == brute_words(rows, 50)
    assert all(sum(n for _, n in r.spans) == r.n_removed for r in out)


@pytest.mark.parametrize("seed,crowd", [(3, 1024), (4, 2)])
def test_bytes_brute_force(docs_of, seed, crowd, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "CROWD", crowd)
    rows = unique_ids(corpus(seed, 50, 30) + [r for r in NASTY if r[0] is not None])
    out = suffix_dedup.suffix_dedup(docs_of(rows)).collect()
    got = sorted(((r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out), key=str)
    assert got == brute_bytes(rows, 100)


def test_settled_in_small_steps(docs_of, monkeypatch):
    monkeypatch.setattr(repeats, "GATHER", 50)
    rows = unique_ids(corpus(7, 40, 30))
    out = substring_dedup.substring_dedup(docs_of(rows)).collect()
    assert sorted(((r.row.doc_id, r.n_words, r.n_removed, r.kept_words) for r in out), key=str) == brute_words(rows, 50)
    out = suffix_dedup.suffix_dedup(docs_of(rows)).collect()
    assert sorted(((r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in out),
                  key=str) == brute_bytes(rows, 100)


def test_segments_of_a_long_text(monkeypatch):
    from wattline.llm.common import Texts

    rng = random.Random(9)
    b = "".join(rng.choice("abcdefgh ") for _ in range(9000)).encode()
    t = Texts(np.frombuffer(b, np.uint8), np.array([0, len(b)]), slice(0, 1))
    whole = suffix_dedup.anchors(t)
    monkeypatch.setattr(suffix_dedup, "SEGMENT", 1000)
    parts = suffix_dedup.anchors(t)
    of = lambda c: {int(s) + k: (int(key), int(s) + int(r)) for key, s, n, r in zip(c["key"], c["start"], c["n"], c["rel"])
                    for k in range(int(n))}
    assert of(whole) == of(parts)


def test_rows_of_one_id_and_empty_table(docs_of):
    text = " ".join(f"w{i}" for i in range(70))
    rows = [(1, text), (1, text), (1, text + " more"), (2, "other " + text)]
    out = substring_dedup.substring_dedup(docs_of(rows)).collect()
    assert sorted((r.row.doc_id, r.n_removed) for r in out) == [(1, 0), (1, 0), (1, 0), (2, 70)]
    assert substring_dedup.substring_dedup(docs_of([])).count() == 0
    assert suffix_dedup.suffix_dedup(docs_of([])).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(1, "x y", "a", 2)], "doc_id long, text string, spans string, ver int")
    r = substring_dedup.substring_dedup(df, carry=["doc_id", "spans", "ver"]).collect()[0]
    assert r.row.asDict() == {"doc_id": 1, "spans": "a", "ver": 2} and r.text == "x y"
    r = suffix_dedup.suffix_dedup(df, carry=["spans"]).collect()[0]
    assert r.row.spans == "a" and hashlib.sha256(r.kept).hexdigest() == hashlib.sha256(b"x y").hexdigest()


@pytest.mark.parametrize("alphabet", ["ab", "abcdefg"])
def test_suffix_array(alphabet):
    rng = random.Random(1)
    for trial in range(60):
        parts = [bytes(rng.choice(alphabet.encode()) for _ in range(rng.randint(1, 40))) for _ in range(rng.randint(1, 7))]
        if trial % 3 == 0:
            parts.append(parts[0])
        s = np.frombuffer(b"".join(p + b"\0" for p in parts), np.uint8)
        want, at = [], 0
        for p in parts:
            want += [(p[i:] + b"\0", at + i) for i in range(len(p) + 1)]
            at += len(p) + 1
        assert suffix_dedup.suffix_array(s, 50).tolist() == [i for _, i in sorted(want)]


def test_common_prefix():
    rng = np.random.default_rng(2)
    s = rng.integers(1, 3, 500).astype(np.uint8)
    a, b = rng.integers(0, 400, 300), rng.integers(0, 400, 300)
    for limit in (5, 8, 17, 100):
        want = [next((k for k in range(limit) if s[x + k] != s[y + k]), limit) for x, y in zip(a, b)]
        assert suffix_dedup.common_prefix(s, a, b, limit).tolist() == want


def test_lowest():
    rng = np.random.default_rng(3)
    x = rng.integers(0, 50, 1000).astype(np.uint64)
    lo = rng.integers(0, 900, 500)
    hi = lo + rng.integers(1, 40, 500)
    assert substring_dedup.lowest(x, lo, hi).tolist() == [a + int(np.argmin(x[a:b])) for a, b in zip(lo, hi)]


def equal_hashes(spark, make, n=400_000):
    """Two different texts with the same 32-bit hash."""
    from pyspark.sql import functions as F
    texts = spark.range(n).select(make(F.col("id")).alias("t"))
    row = (texts.groupBy(F.hash("t").alias("h")).agg(F.min("t").alias("a"), F.max("t").alias("b")).where("a < b")
           .orderBy("h").first())
    return row.a, row.b


@pytest.mark.parametrize("doc_id", [None, 7])
def test_rows_of_one_id_with_equal_32_bit_hashes(spark, docs_of, doc_id):
    from pyspark.sql import functions as F
    from wattline.llm import near_dedup
    a, b = equal_hashes(spark, lambda i: F.concat_ws(" ", *[F.conv(F.xxhash64(i, F.lit(k)).cast("string"), 10, 36)
                                                            for k in range(80)]))
    assert a != b
    rows = [(doc_id, a), (doc_id, b), (-9, b[:400] + " and another end"), (900, a)]
    got = [(r.row.doc_id, r.n_bytes, r.n_removed, len(r.spans), r.kept)
           for r in suffix_dedup.suffix_dedup(docs_of(rows)).collect()]
    assert sorted([(d, n, m, k, bytes(t)) for d, n, m, k, t in got], key=str) == brute_bytes(rows, suffix_dedup.WIDTH)
    got = [(r.row.doc_id, r.n_words, r.n_removed, r.kept_words) for r in substring_dedup.substring_dedup(docs_of(rows)).collect()]
    assert sorted(got, key=str) == brute_words(rows, substring_dedup.WIDTH)
    near = near_dedup.near_dedup(docs_of(rows)).collect()
    assert sorted(r.class_size for r in near) == [1, 1, 2, 2]


def test_runs_keep_every_window():
    """Spans of a document that meet or overlap become one; others stay apart."""
    rng = np.random.default_rng(3)
    n = 400
    c = {"doc": rng.integers(-2, 3, n), "ver": rng.integers(0, 2, n), "alt": np.zeros(n, np.int64),
         "start": rng.integers(0, 300, n), "n": rng.integers(1, 9, n)}
    windows = lambda c: {(d, v, a, x) for d, v, a, s, m in zip(*[c[k].tolist() for k in c]) for x in range(s, s + m)}
    r = repeats.runs(c)
    assert windows(r) == windows(c) and len(r["doc"]) < n
    empty = {k: np.zeros(0, np.int64) for k in c}
    assert not len(repeats.runs(empty)["doc"])


def test_rows_told_of_documents_do_not_grow_with_buckets(spark):
    """Copies meet under many keys; what is found goes on by buckets of documents, not as a row for each document and bucket."""
    rng = random.Random(8)
    text = " ".join(f"w{rng.randrange(10**6)}" for _ in range(1500))
    docs = spark.createDataFrame([(i, text) for i in range(300)], "doc_id long, text string").repartition(40)
    keyed = repeats.keyed_documents(docs, "doc_id", "text", None)
    told = repeats.settle_entries(repeats.anchor_entries(keyed, suffix_dedup.anchors, False), False).where("kind = 1").cache()
    buckets = repeats.partitions(spark)
    assert told.count() <= buckets * (buckets + 40)
    rows = repeats.of_documents(told, repeats.SPANS, "spans").collect()
    assert sorted(r.doc for r in rows) == list(range(1, 300))
    size = len(text.encode()) - suffix_dedup.WIDTH + 1
    for r in rows:
        c = repeats.unpacked(r.spans, repeats.SPANS)
        assert c["start"].tolist() == [0] and c["n"].tolist() == [size]
    told.unpersist()
