import hashlib
import random
import re

from tests.llm.conftest import NASTY
from wattline.llm import exact_dedup as op


def brute(rows):
    """(id, text) -> sorted (id, keep_id, group_size, kept count, sha) rows."""
    groups = {}
    for d, t in rows:
        groups.setdefault(re.sub("[\x20\x09-\x0d]", "", t or ""), []).append((-len(t or ""), d is None, d or 0, d))
    out = []
    for t, members in groups.items():
        members.sort()
        for k, m in enumerate(members):
            out.append((m[3], members[0][3], len(members), k == 0, hashlib.sha256(t.encode()).hexdigest()))
    return sorted(out, key=str)


def found(df):
    return sorted(((r["id"], r["keep_id"], r["group_size"], r["kept"], r["text_sha256"])
                   for r in op.exact_dedup(df).collect()), key=str)


def test_brute_force(docs_of):
    rng = random.Random(3)
    rows = NASTY + [(100 + i, "".join(rng.choice("ab \n") for _ in range(rng.randint(0, 4)))) for i in range(400)]
    assert found(docs_of(rows)) == brute(rows)


def test_hot_text_is_spread(docs_of, monkeypatch):
    monkeypatch.setattr(op, "HOT_ROWS", 10)
    monkeypatch.setattr(op, "HOT_SHARES", 20)
    rows = [(i, "copy  of" if i % 3 else f"copy of{' ' * (i % 7)}") for i in range(300)] + [(1000 + i, f"t{i}") for i in range(50)]
    assert found(docs_of(rows)) == brute(rows)


def test_hot_text_of_one_id_is_spread(docs_of, monkeypatch):
    monkeypatch.setattr(op, "HOT_ROWS", 10)
    monkeypatch.setattr(op, "HOT_SHARES", 20)
    rows = [(7, "one text")] * 150 + [(None, "one  text")] * 150 + [(k, f"t{k}") for k in range(40)]
    assert found(docs_of(rows).repartition(12)) == brute(rows)


def test_empty_table_and_names(docs_of, spark):
    assert op.exact_dedup(docs_of([])).count() == 0
    odd = spark.createDataFrame([(1, "x", 5, 6), (2, "x ", 7, 8)], "doc_id long, text string, key int, `sal.t` int")
    kept = op.drop_exact(odd).collect()
    assert [r.asDict() for r in kept] == [{"doc_id": 2, "text": "x ", "key": 7, "sal.t": 8}]
