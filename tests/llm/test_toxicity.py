import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import NASTY
from wattline.llm import toxicity as op
from wattline.llm.common import fold

TERMS = ["blorgface", "idiot", "scum", "dümmling"]


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, old = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(old[j] + 1, row[-1] + 1, old[j - 1] + (x != y)))
    return row[-1]


def test_automata_equal_edit_distances():
    rng = random.Random(4)
    terms = sorted({"".join(rng.choice("abcé") for _ in range(rng.randint(3, 11))) for _ in range(60)})
    found = ["".join(rng.choice("abcéx") for _ in range(rng.randint(1, 13))) for _ in range(800)] + terms
    lengths = np.array([len(t) for t in terms])
    term, edits = op.match(op.Trie(terms), lengths, found)
    allowed = op.edits_allowed(lengths)
    for w, t, e in zip(found, term, edits):
        near = [(distance(w, x), k) for k, x in enumerate(terms) if distance(w, x) <= allowed[k]]
        assert (e, t) == min(near) if near else t == -1


def chunk(texts):
    import pyarrow as pa
    from wattline.llm.common import chunks
    batch = pa.RecordBatch.from_arrays([op.lowered(pa.array(texts))], ["text"])
    return next(chunks(batch, "text"))


def test_hits_and_contexts():
    lexicon = op.Lexicon(sorted(TERMS), [1.0] * 4)
    texts = ["You are an IDIOT.", 'The paper had "an idiot" in it.', "she wrote idiot on the wall", "an idi0t, an id*iot, sc*m",
             "blorgfaze blorgfacce", "“idiot” and « scum »", 'an open " mark idiot', "Dümmling dummling", "he said you idiot", "",
             'one "line\nidiot" here']
    h = op.hits(chunk(texts), lexicon)
    rows = [(int(d), lexicon.terms[t], int(e), bool(q), bool(a)) for d, t, e, q, a in zip(h.doc, h.term, h.edits, h.quoted, h.addressed)]
    assert rows == [
        (0, "idiot", 0, False, True), (1, "idiot", 0, True, False), (2, "idiot", 0, True, False), (3, "idiot", 1, False, False),
        (3, "idiot", 1, False, False), (4, "blorgface", 1, False, False), (4, "blorgface", 1, False, False),
        (5, "idiot", 0, True, False), (5, "scum", 0, True, False), (6, "idiot", 0, False, False), (7, "dümmling", 0, False, False),
        (7, "dümmling", 1, False, False), (8, "idiot", 0, False, True), (10, "idiot", 0, False, False)]


@pytest.fixture(scope="module")
def corpus(docs_of):
    rng = random.Random(7)
    vocab = ["".join(rng.choice("bdgklmnprst") + rng.choice("aeiou") for _ in range(rng.randint(1, 4))) for _ in range(600)]
    rows, labels = [], []
    copied = ["zuvarex", "pilomun", "hetravo", "quibbas"]
    for i in range(600):
        words = [rng.choice(vocab) for _ in range(40)]
        toxic = i % 5 == 0
        if toxic:
            for _ in range(3):
                words.insert(rng.randrange(40), rng.choice(TERMS))
        if i % 25 == 0:  # toxic copies of one passage
            words += copied
        rows.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs_of(rows), labels


def test_learns_terms_not_copies(spark, corpus):
    docs, labels = corpus
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = op.train(docs, lab)
    assert set(TERMS) <= set(m.lexicon.terms) and not {"zuvarex", "pilomun"} & set(m.lexicon.terms)
    assert m.lexicon.terms == sorted(TERMS)
    out = op.score(docs, m, carry=["doc_id"]).select("row.doc_id", "score", "predicted", (fold("row.doc_id", 5) == 0).alias("out")).collect()
    truth = dict(labels)
    assert all(r.predicted == truth[r.doc_id] for r in out) and any(r.out for r in out)
    assert op.train(docs.repartition(5), lab.repartition(3)).weights.tolist() == m.weights.tolist()
    # misspelled abuse counts, quotation less than abuse
    probe = docs.sparkSession.createDataFrame([(1, "you idiott, you blorgfase, you stay", ""), (2, 'the word "idiot"', ""),
                                               (3, "idiot you scum", ""), (4, "nothing here", "")], "doc_id long, text string, score string")
    s = {r.row.doc_id: r.score for r in op.score(probe, m).collect()}
    assert s[3] > s[1] > s[4] and s[3] > s[2] and s[2] < 0.5 <= s[3]


def test_edge_cases(spark, docs_of, corpus):
    docs, labels = corpus
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    m = op.train(docs, lab)
    out = op.score(docs_of(NASTY).withColumns({n: F.lit(9) for n in ("row", "x", "label", "predicted")}), m).collect()
    assert len(out) == len(NASTY) and len({r.score for r in out}) == 1 and all(r.row.label == 9 for r in out)
    none = spark.createDataFrame([], "doc_id long, toxic int")
    flat = op.train(docs_of(NASTY), none)
    assert flat.lexicon.terms == [] and op.score(docs_of([]), flat).collect() == []
    odd = spark.createDataFrame([(None, 1), (4, 1), (4, 0), (999, 1), (1, None), (2, 0)], "doc_id long, toxic int")
    assert op.score(docs_of(NASTY), op.train(docs_of(NASTY), odd)).count() == len(NASTY)


def test_sample_is_taken_after_the_join(spark, docs_of):
    from wattline.llm.common import labelled_sample
    docs = docs_of([(i, f"t{i}") for i in range(50)] + [(7, "t7")] * 30 + [(8, f"other {k}") for k in range(10)])
    lab = spark.createDataFrame([(i, i % 2) for i in range(-500, 50)] + [(8, 1)], "doc_id long, toxic int")
    rows = labelled_sample(docs, lab, "toxic", "doc_id", "text", 5, 1000).collect()
    assert len(rows) == len({r.text for r in rows}) and sum(r.text == "t7" for r in rows) <= 1
    assert all(r.label == 1 for r in rows if r.text.startswith("other"))
    assert len(labelled_sample(docs, lab, "toxic", "doc_id", "text", 5, 12).collect()) == 12
