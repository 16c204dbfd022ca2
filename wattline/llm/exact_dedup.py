"""Exact duplicates by content sort, in DataFrame operations only.

Rows are range-partitioned by their normalised text: Spark samples the
splitters, which hold the first PREFIX characters and, for texts that begin
alike, a hash of the whole, so that the sample stays small.  The partitions are
sorted externally, and neighbours are compared in full by the window over the
sorted runs.  A text with many copies
would fill one partition, so texts that hold more than 1/2048 of the rows are
found first by a pre-aggregated count; only their key is extended by a salt
from the id and the input partition (rows may share an id, or have none), which
cuts them into runs.  The runs' heads, at most a few
thousand rows, are compared in full once more and give the group's survivor.

Defined results: a null text is the empty text; a null id sorts last; among
equal rows (same length, same id) one is kept; an empty table gives no rows;
columns of any name are carried unchanged when ``carry`` names them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattline.llm.common import saved

#: Runs of one text hold about 1/HOT_SHARES of the rows at most.
HOT_SHARES = 2048
HOT_ROWS = 1024
#: Characters of a text in the splitters.
PREFIX = 32
#: White space that the comparison ignores.
IGNORED = " \t\n\x0b\f\r"


def normalised(text: Column) -> Column:
    """``text`` without the characters of IGNORED; null is empty."""
    out = F.coalesce(text, F.lit(""))
    for c in IGNORED:
        out = F.replace(out, F.lit(c), F.lit(""))
    return out


def exact_dedup(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
                carry: list[str] | None = None) -> DataFrame:
    """Group rows of equal normalised text; the row with the longest original
    text (code points), then the smallest id, stays.

    Returns one row per input row: ``id`` and ``row`` (a struct of the columns
    in ``carry``), ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.
    """
    carry = carry or [id_col]
    text = F.col(f"`{text_col}`")
    base = df.select(F.struct(*[F.col(f"`{c}`") for c in carry]).alias("row"), F.col(f"`{id_col}`").alias("id"),
                     normalised(text).alias("key"), F.length(F.coalesce(text, F.lit(""))).alias("len"))
    base = base.withColumn("h", F.xxhash64("key"))
    rows = df.count()
    limit = max(HOT_ROWS, rows // HOT_SHARES)
    # at most HOT_SHARES rows: each stands for more than rows / HOT_SHARES rows
    hot = base.groupBy("h").count().where(F.col("count") > limit).select(
        F.col("h").alias("hot_h"), F.ceil(F.col("count") / F.lit(limit)).alias("runs"))
    dealt = (base.join(F.broadcast(hot), F.col("h") == F.col("hot_h"), "left")
             .withColumn("salt", F.when(F.col("runs").isNotNull(),
                                        F.pmod(F.xxhash64("id", F.spark_partition_id()), F.col("runs"))).otherwise(F.lit(0).cast("long")))
             .withColumn("hot", F.col("runs").isNotNull()).drop("hot_h", "runs")
             .withColumn("prefix", F.substring("key", 1, PREFIX))
             .repartitionByRange("prefix", "h", "salt"))
    run = Window.partitionBy("prefix", "h", "salt", "key")
    best = run.orderBy(F.col("len").desc(), F.col("id").asc_nulls_last())
    told = (dealt
            .withColumn("place", F.row_number().over(best))
            .withColumn("run_keep", F.first("id").over(best))
            .withColumn("run_len", F.first("len").over(best))
            .withColumn("run_size", F.count(F.lit(1)).over(run))
            .withColumn("sha", F.sha2("key", 256))
            .withColumn("head", F.when(F.col("hot") & (F.col("place") == 1), F.col("key")))
            .drop("key", "len", "h", "prefix"))
    told = saved(told)
    whole = Window.partitionBy("head")
    first = whole.orderBy(F.col("run_len").desc(), F.col("run_keep").asc_nulls_last())
    heads = (told.where(F.col("head").isNotNull())
             .select(F.col("sha").alias("head_sha"), F.col("salt").alias("head_salt"),
                     F.first("run_keep").over(first).alias("group_keep"),
                     (F.row_number().over(first) == 1).alias("group_head"),
                     F.sum("run_size").over(whole).alias("group_rows")))
    out = told.join(F.broadcast(heads), (F.col("sha") == F.col("head_sha")) & (F.col("salt") == F.col("head_salt"))
                    & F.col("hot"), "left")
    return out.select(
        "id", "row",
        F.when(F.col("hot"), F.col("group_keep")).otherwise(F.col("run_keep")).alias("keep_id"),
        F.when(F.col("hot"), F.col("group_rows")).otherwise(F.col("run_size")).cast("long").alias("group_size"),
        ((F.col("place") == 1) & F.coalesce(F.col("group_head"), F.lit(True))).alias("kept"),
        F.col("sha").alias("text_sha256"))


def drop_exact(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of ``df``."""
    return exact_dedup(df, id_col, text_col, carry=df.columns).where("kept").select("row.*")
