"""Sinks (S6-S10): tables, JSON records, key/value metrics, text summaries, previews.

All writers are DataFrame writers (distributed, one file per task); paths
should be on the shared file system of the cluster.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_table(df: DataFrame, path: str, fmt: str = "parquet", partition_by: Sequence[str] | None = None,
                header: bool = True) -> None:
    """Sweep / ranked / dispatch / batch / trade-off tables as Parquet or CSV."""
    w = df.write.mode("overwrite")
    if partition_by:
        # a task has a file open for each partition (``prepare_session``), so each holds back little
        w = w.partitionBy(*partition_by).option("parquet.block.size", 16 << 20)
    if fmt == "csv":
        w = w.option("header", header)
    w.format(fmt).save(path)


def write_records(df: DataFrame, path: str) -> None:
    """Nested rows (recommendation, validation record) as JSON lines."""
    df.write.mode("overwrite").json(path)


def write_key_values(metrics_long: DataFrame, path: str) -> None:
    """(keys, metric, value) rows as CSV."""
    write_table(metrics_long, path, "csv")


def write_text(df: DataFrame, column: str, path: str) -> None:
    """One text line (or block) per row."""
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def preview(df: DataFrame, order_by: Sequence[str], n: int = 20) -> DataFrame:
    """The first ``n`` rows in a stated order (a limit is the feature here)."""
    return df.orderBy(*order_by).limit(n)
