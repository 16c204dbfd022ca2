"""The queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from pyspark.sql import functions as F

from wattline.llm import language, lm, packing, quality, sampling, search, seekable, toxicity, vector_codes
from wattline.llm.common import fold, prepare
from wattline.llm.exact_dedup import exact_dedup
from wattline.llm.near_dedup import near_dedup
from wattline.llm.substring_dedup import substring_dedup
from wattline.llm.suffix_dedup import suffix_dedup

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    prepare(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tokenizer_path(name: str) -> str:
    """Where a public tokenizer's file lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bm25_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best of all documents for every twentieth document as query."""
    out = search.search(_documents(spark, sf_dir), "doc_id % 20 = 0")
    return out.withColumnRenamed("id", "doc_id")


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document, learned outside fold 0 of five."""
    docs = _documents(spark, sf_dir)
    profiles = language.train(docs.where(fold("doc_id", language.FOLDS) != 0))
    out = language.predict(docs, profiles, carry=["doc_id"])
    return out.select("row.doc_id", (fold("row.doc_id", language.FOLDS) == 0).alias("held_out"), "lang_pred", "score")


def op3_gumbel_segmentation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distinct sampled segmentations of every document, with their decoding."""
    out = sampling.sample_segmentations(_documents(spark, sf_dir), tokenizer_path("piece_bpe_32k.model"), with_ids=False)
    return out.select("row.doc_id", *out.columns[1:])


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document, learned outside fold 0 of five."""
    docs = _documents(spark, sf_dir)
    model = quality.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = quality.score(docs, model, carry=["doc_id"])
    return out.select("row.doc_id", (fold("row.doc_id", quality.FOLDS) == 0).alias("held_out"), "score", "predicted")


def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of at most 4096 tokens."""
    return packing.pack(_documents(spark, sf_dir), tokenizer_path("word_bpe_49k.json"))


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of all documents in 100-byte strings that also start earlier."""
    out = suffix_dedup(_documents(spark, sf_dir))
    return out.select("row.doc_id", "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
                      F.sha2("kept", 256).alias("kept_sha256"))


def op7_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of near duplicates of all documents."""
    return near_dedup(_documents(spark, sf_dir))


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact duplicates of all documents, one row per document."""
    out = exact_dedup(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.select(out.id.alias("doc_id"), "keep_id", "group_size", "kept", "text_sha256")


def op9_elias_fano_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language model scores of all documents, learned outside fold 2 of seven."""
    out = lm.score(_documents(spark, sf_dir), "crc32(coalesce(cast(doc_id AS string), '')) % 7 != 2",
                   order=lm.ORDER)
    return out.withColumnRenamed("id", "doc_id")


def op10_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents in 50-word windows that an earlier one has."""
    out = substring_dedup(_documents(spark, sf_dir))
    return out.select("row.doc_id", "n_words", "n_removed", F.sha2("kept_words", 256).alias("kept_sha256"))


def op11_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document, learned outside fold 0 of five."""
    docs = _documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = toxicity.score(docs, model, carry=["doc_id"])
    return out.select("row.doc_id", (fold("row.doc_id", toxicity.FOLDS) == 0).alias("held_out"), "score", "predicted")


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents cut and arranged for filling in the middle, with digests."""
    out = seekable.fill_in_middle(seekable.store(_documents(spark, sf_dir), carry=["doc_id"]))
    return out.select("row.doc_id", *out.columns[1:])


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Codes of all vectors, their errors, and the codebooks' digest."""
    prepare(spark)
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    books = vector_codes.train(vectors)
    out = vector_codes.with_label_error(vector_codes.encode(vectors, books, carry=["vec_id", "label"]))
    code = F.concat_ws("", F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0"))))
    return out.select("row.vec_id", code.alias("code"), "error", "label_error",
                      F.lit(books.digest() if books else None).alias("codebooks_sha256"))


OP8_SQL = r"""
WITH n AS (SELECT doc_id, length(coalesce(text, '')) AS len,
                  regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS t FROM documents)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
       row_number() OVER best = 1 AS kept, sha256(t) AS text_sha256
FROM n WINDOW best AS (PARTITION BY t ORDER BY len DESC, doc_id)
"""

OP12_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS s,
             regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS u FROM documents),
h AS (SELECT *, CAST(len(u) AS BIGINT) AS n, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2,
        CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM t),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN n = 0 OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= 90
             THEN 'plain' WHEN h4 % 100 < 20 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, array_to_string(u[1:a], '') AS pre, array_to_string(u[a + 1:b], '') AS mid,
        array_to_string(u[b + 1:n], '') AS suf FROM c)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(pre) END AS prefix_chars,
       CASE WHEN form <> 'plain' THEN length(mid) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid
                   ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""


def _op13_sql(rounds: int = vector_codes.ROUNDS) -> str:
    """Assignment and means of each round as common table expressions."""
    parts = ["""
kept AS (SELECT vec_id, label, [CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT) for x in embedding] AS v
         FROM embeddings WHERE embedding IS NOT NULL AND len(embedding) > 0
           AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
w AS MATERIALIZED (SELECT vec_id, label, CAST(len(v) // 4 AS BIGINT) AS d, v FROM kept),
q AS MATERIALIZED (SELECT vec_id, p, v[p * d + 1:(p + 1) * d] AS x FROM w, (SELECT unnest([0, 1, 2, 3]) AS p)),
b0 AS MATERIALIZED (SELECT p, row_number() OVER (PARTITION BY p ORDER BY vec_id) - 1 AS e, x FROM q
       QUALIFY row_number() OVER (PARTITION BY p ORDER BY vec_id) <= 256)"""]
    for k in range(rounds + 1):
        parts.append(f"""
f{k} AS MATERIALIZED (SELECT q.vec_id, q.p, min(struct_pack(
        far := CAST(list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(q.x, b.x)]) AS BIGINT), e := b.e)) AS best
      FROM q JOIN b{k} b ON b.p = q.p GROUP BY q.vec_id, q.p)""")
        if k < rounds:
            parts.append(f"""
s{k} AS (SELECT f.p, f.best.e AS e, i, sum(q.x[i]) AS s, count(*) AS n
       FROM f{k} f JOIN q ON q.vec_id = f.vec_id AND q.p = f.p, unnest(range(1, len(q.x) + 1)) AS g(i) GROUP BY f.p, f.best.e, i),
m{k} AS (SELECT p, e, list(CAST(CASE WHEN s < 0 AND s % n <> 0 THEN s // n - 1 ELSE s // n END AS BIGINT) ORDER BY i) AS x
       FROM s{k} GROUP BY p, e),
b{k + 1} AS MATERIALIZED (SELECT b.p, b.e, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON m.p = b.p AND m.e = b.e)""")
    return "WITH " + ",".join(parts) + f""",
sha AS (SELECT sha256(string_agg(array_to_string(x, ','), ',' ORDER BY p, e)) AS digest FROM b{rounds}),
r AS (SELECT vec_id, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY p) AS code, CAST(sum(best.far) AS BIGINT) AS error
      FROM f{rounds} GROUP BY vec_id)
SELECT r.vec_id, code, error, CAST(sum(error) OVER (PARTITION BY w.label) AS BIGINT) AS label_error,
       (SELECT digest FROM sha) AS codebooks_sha256
FROM r JOIN w ON w.vec_id = r.vec_id
"""


QUERIES: dict[str, Query] = {
    "op1_bm25_search": op1_bm25_search,
    "op2_language": op2_language,
    "op3_gumbel_segmentation": op3_gumbel_segmentation,
    "op4_quality": op4_quality,
    "op5_packing": op5_packing,
    "op6_suffix_array": op6_suffix_array,
    "op7_dart_minhash": op7_dart_minhash,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_elias_fano_lm": op9_elias_fano_lm,
    "op10_recompression": op10_recompression,
    "op11_toxicity": op11_toxicity,
    "op12_fill_in_middle": op12_fill_in_middle,
    "op13_vector_codes": op13_vector_codes,
}

ORACLES: dict[str, str] = {
    "op8_exact_dedup": OP8_SQL,
    "op12_fill_in_middle": OP12_SQL,
    "op13_vector_codes": _op13_sql(),
}
