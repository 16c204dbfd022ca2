"""The corpus pipeline: stages applied one after the other to ``documents``.

Each stage reads what its predecessor kept.  All but the last return the
columns of documents: documents of low quality go, then copies, then near
copies, then repeated passages (and documents that consist of nothing else);
the rest is packed into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattline.llm import quality
from wattline.llm.common import prepare, saved
from wattline.llm.exact_dedup import drop_exact
from wattline.llm.near_dedup import drop_near
from wattline.llm.packing import pack
from wattline.llm.registry import tokenizer_path
from wattline.llm.substring_dedup import substring_dedup


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts (operator 4), learned
    from the labels of these documents."""
    prepare(spark)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs, model).where(F.col("predicted") == 1).select("row.*")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts stays (operator 8)."""
    return drop_exact(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The smallest document of each class of near duplicates stays (operator 7)."""
    prepare(spark)
    return drop_near(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the words that a passage of an earlier document has
    (operator 10).  Untouched texts stay as they are; of the others the kept
    words are joined by one blank, ``n_chars`` follows, and a document of which
    nothing is left goes."""
    prepare(spark)
    out = substring_dedup(docs, carry=[c for c in docs.columns if c != "text"])
    out = out.where((F.col("n_removed") == 0) | (F.col("n_removed") < F.col("n_words")))
    cut = F.col("n_removed") > 0
    value = {c: F.col("row").getField(c) for c in docs.columns if c != "text"} | {"text": F.col("text")}
    if "n_chars" in value:
        value["n_chars"] = F.when(cut, F.length("text").cast("long")).otherwise(value["n_chars"])
    return out.select(*[value[c].alias(c) for c in docs.columns])


def packed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents' pieces in sequences of at most 4096 tokens (operator 5)."""
    prepare(spark)
    return pack(docs, tokenizer_path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", good_quality),
    ("exact dedup", exact),
    ("near dedup", near),
    ("substring dedup", passages),
    ("packing", packed),
]

#: No SQL: the classifier, the signatures and the tokenizer are none of SQL's.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages; each but the last is written to the shared folder
    and read again as the next one's input."""
    prepare(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = saved(docs)
    return docs
