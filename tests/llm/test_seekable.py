import hashlib
import re

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import NASTY
from wattline.llm import seekable as op

UNIT = re.compile("[A-Za-z]+|[^A-Za-z]", re.S)
ODD = [(20, "ab<P>c"), (21, "<S>"), (22, "x <M"), (23, "<<P"), (24, "word " * 3000 + "Ünï☃" * 500), (25, "Z" * 5000),
       (26, "a1b2 \n\r\x00c" * 700)] + [(100 + i, "One two<S " * (i % 9) + "é<P3 end") for i in range(300)]


def expected(doc_id, text):
    text = text or ""
    u = UNIT.findall(text)
    s = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(s[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (len(u) + 1), h[1] % (len(u) + 1)))
    pre, mid, suf = "".join(u[:a]), "".join(u[a:b]), "".join(u[b:])
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        return len(u), "plain", None, None, text
    if h[3] % 100 < 20:
        return len(u), "spm", len(pre), len(mid), f"<S>{suf}<P>{pre}<M>{mid}"
    return len(u), "psm", len(pre), len(mid), f"<P>{pre}<S>{suf}<M>{mid}"


@pytest.mark.parametrize("frame_bytes", [1, 7, 64, op.FRAME_BYTES])
def test_equals_plain_version(docs_of, frame_bytes):
    rows = NASTY + ODD if frame_bytes > 7 else [r for r in NASTY + ODD if len(r[1] or "") < 600]
    docs = docs_of(rows)
    out = op.fill_in_middle(op.store(docs, carry=["doc_id"], frame_bytes=frame_bytes), with_output=True).collect()
    got = sorted(((r.row.doc_id is None, r.row.doc_id or 0, r.output, r.n, r.form, r.prefix_chars, r.middle_chars,
                   r.output_sha256, r.restored_sha256) for r in out), key=repr)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    want = []
    for i, t in rows:
        n, form, p, m, output = expected(i, t)
        want.append((i is None, i or 0, output, n, form, p, m, sha(output), sha(t or "")))
    assert got == sorted(want, key=repr)
    assert {w[4] for w in want} == {"plain", "psm", "spm"}


def test_units_and_texts(docs_of):
    rows = [(i, t) for i, t in ODD if len(t) < 20_000]
    st = op.store(docs_of(rows), frame_bytes=50)
    assert {r.row.doc_id: r.text for r in op.texts(st).collect()} == dict(rows)
    part = op.units(st, F.lit(3), F.col("n_units") - 1).collect()
    assert {r.row.doc_id: r.text for r in part} == {i: "".join(UNIT.findall(t)[3:max(len(UNIT.findall(t)) - 1, 3)])
                                                   if len(UNIT.findall(t)) > 3 else "" for i, t in rows}


def test_clashing_names_and_empty_table(spark, docs_of):
    names = ["frames", "n_units", "n_chars", "n_bytes", "marked", "a", "b", "form", "row"]
    df = docs_of([(1, "some text here")]).select("doc_id", "text", *[F.lit(k).alias(n) for k, n in enumerate(names)])
    r = op.fill_in_middle(op.store(df)).collect()[0]
    assert r.n == 5 and r.row.form == names.index("form") and r.restored_sha256 == hashlib.sha256(b"some text here").hexdigest()
    assert op.fill_in_middle(op.store(docs_of([]), carry=["doc_id"])).collect() == []
