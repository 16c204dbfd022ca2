"""Tables with further columns whose names the operators use themselves."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from wattline.llm import language, lm, packing, quality, sampling, search

NAMES = ["row", "label", "score", "id", "train", "data", "block", "x", "h", "h1", "query_id", "words", "tokens", "label_id", "doc",
         "ver", "alt", "count", "n_tokens", "size", "key", "ids", "shard"]


@pytest.fixture
def docs(docs_of):
    rows = [(i, f"some words of document {i % 7} and {'more ' * (i % 5)}", "en" if i % 2 else "de") for i in range(40)]
    return docs_of([*rows, (None, None), (41, ""), (41, "")])


def both(docs, run):
    """The result with and without the further columns."""
    return [sorted(map(str, run(d).collect())) for d in (docs, docs.withColumns({n: F.lit(1) for n in NAMES}))]


def test_search(docs):
    a, b = both(docs, lambda d: search.search(d, "doc_id % 20 = 0"))
    assert a == b and a


def test_language(docs):
    a, b = both(docs, lambda d: language.predict(d, language.train(d), carry=["doc_id"]))
    assert a == b and len(a) == docs.count()


def test_sampling(docs):
    path = public_tokenizers.path("piece_bpe_32k.model")
    def run(d):
        out = sampling.sample_segmentations(d, path, with_ids=False)
        return out.select("row.doc_id", *out.columns[1:])

    a, b = both(docs.where("doc_id < 12"), run)
    assert a == b and len(a)


def test_quality(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 3) for i in range(40)], "doc_id long, quality int, label int")
    a, b = both(docs, lambda d: quality.score(d, quality.train(d, labels), carry=["doc_id"]))
    assert a == b and len(a) == docs.count()


def test_packing(docs):
    path = public_tokenizers.path("word_bpe_49k.json")
    a, b = both(docs.coalesce(1), lambda d: packing.pack(d, path))
    assert a == b and a


def test_model(docs):
    a, b = both(docs, lambda d: lm.score(d, "crc32(cast(doc_id as string)) % 7 != 2", order=3))
    assert a == b and len(a) == docs.count()
