import math
import os
import random
import re
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from tokenizers import Tokenizer

from tests.llm.test_near_dedup import brute
from tests.llm.test_quality import plain_features
from tests.llm.test_repeats import brute_words
from wattline.llm import quality, registry

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables")
def test_stages_on_a_small_table(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, last = docs.columns, docs.count()
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality classifier", "exact dedup", "near dedup", "substring dedup", "packing"]
    from wattline.llm.common import saved
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = saved(stage(spark, docs, SF))
        assert docs.columns == columns
        n = docs.count()
        assert 0 < n <= last and docs.select("doc_id").distinct().count() == n
        last = n
    tokens = stage_tokens(spark, docs)
    out = corpus_pipeline.run(spark, SF)
    rows = out.collect()
    assert {r.doc_id for r in rows} == {r.doc_id for r in docs.select("doc_id").collect()}
    assert sum(r.length for r in rows) == tokens


def stage_tokens(spark, docs):
    from wattline.llm.packing import encoder
    enc = encoder(registry.tokenizer_path("word_bpe_49k.json"))
    return sum(len(x) + 1 for x in enc.encode([r.text or "" for r in docs.select("text").collect()]))


def test_every_stage_takes_odd_rows_and_an_empty_table(spark, docs_of, tmp_path):
    from tests.llm.conftest import NASTY
    labels = spark.createDataFrame([(d, i % 2, 0) for i, (d, _) in enumerate(NASTY)], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    for rows in (NASTY, []):
        for _, stage in corpus_pipeline.STAGES:
            stage(spark, docs_of(rows), str(tmp_path)).collect()


@pytest.mark.skipif(not os.path.exists(SF), reason="test tables")
def test_queries_are_registered_for_each_operator():
    found = [n for n in registry.QUERIES if n.startswith("op")]
    assert sorted(int(n[2:].split("_")[0]) for n in found) == list(range(1, 14))
    assert set(registry.ORACLES) <= set(registry.QUERIES)


def plain_pipeline(rows, model):
    """id -> text of the documents that the four filtering stages keep."""
    def good(text):
        x = np.array([plain_features(text)])
        z = model.base
        place = [sum(e <= v for e in edges) for edges, v in zip(model.edges, x[0])]
        z += sum(t[p] for t, p in zip(model.tables, place)) + sum(t[place[j], place[k]] for j, k, t in model.pairs)
        return 1 / (1 + math.exp(-z)) >= 0.3

    kept = {d: t or "" for d, t in rows if good(t)}
    equal = defaultdict(list)
    for d, t in kept.items():
        equal[re.sub(r"[\x20\x09-\x0D]", "", t)].append(d)
    kept = {d: kept[d] for d in (min(ids, key=lambda d: (-len(kept[d]), d)) for ids in equal.values())}
    lead = brute(kept.items())
    kept = {d: t for d, t in kept.items() if lead[d] == d}
    out = {}
    for d, n, gone, text in brute_words(sorted(kept.items()), 50):
        if gone == 0 or gone < n:
            out[d] = text if gone else kept[d]
    return out


def small_corpus(seed=11):
    """Good and poor texts with exact and near copies and shared passages."""
    rng = random.Random(seed)
    words = [rng.choice("BCDFG") + "".join(rng.choice("aeiourst") for _ in range(rng.randint(2, 7))) for _ in range(900)]
    prose = lambda n: " ".join(rng.choice(words) + rng.choice(["", "", ","]) for _ in range(n)) + "."
    passage = prose(70)
    texts = [prose(rng.randint(80, 160)) for _ in range(30)]
    texts += [" ".join([prose(20), passage, prose(25)]) for _ in range(6)] + [passage]
    texts += [texts[0].replace(" ", "  "), texts[1] + "\n", texts[2], texts[2]]  # copies up to blanks
    for k in (3, 3, 4):
        w = texts[k].split()
        w[rng.randrange(len(w))] = "Changed"
        texts.append(" ".join(w))  # near copies
    texts += ["$$$ ||| ### " * rng.randint(5, 40) for _ in range(12)] + ["", None]
    rng.shuffle(texts)
    return list(enumerate(texts))


def test_run_equals_a_plain_version(spark, docs_of, tmp_path):
    rows = small_corpus()
    docs_of(rows).write.parquet(f"{tmp_path}/documents.parquet")
    poor = lambda t: not t or "$$$" in t
    labels = spark.createDataFrame([(d, int(not poor(t)), 0) for d, t in rows if d % 4], "doc_id long, quality int, toxic int")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    model = quality.train(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    want = plain_pipeline(rows, model)
    assert 30 <= len(want) <= 45 and not any("$$$" in t for t in want.values())
    pieces = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in pieces} == set(want)
    enc = Tokenizer.from_file(registry.tokenizer_path("word_bpe_49k.json"))
    ids = {d: np.array([*enc.encode(t, add_special_tokens=False).ids, 2], "<u4") for d, t in want.items()}
    for d, x in ids.items():
        mine = sorted((r for r in pieces if r.doc_id == d), key=lambda r: r.start)
        assert [r.start for r in mine] == [0, *np.cumsum([r.length for r in mine])[:-1]]
        assert sum(r.length for r in mine) == len(x) and {r.doc_tokens for r in mine} == {len(x)}
        assert all(zlib.crc32(x[r.start:r.start + r.length].tobytes()) == r.ids_crc32 for r in mine)
    sequences = defaultdict(list)
    for r in pieces:
        sequences[r.sequence_id].append((r.offset, r.length))
    for held in sequences.values():
        held = sorted(held)
        assert [o for o, _ in held] == [0, *np.cumsum([n for _, n in held])[:-1]] and sum(n for _, n in held) <= 4096
