"""Cleaning and quality predicates for interval tables."""

from __future__ import annotations

from functools import reduce
from operator import and_
from typing import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPTIONAL = ["wind_mw", "solar_mw", "natgas_mw"]
REQUIRED = ["load_mw", "price"]


def to_number(c: Column) -> Column:
    """P5: text or number -> double, bad values -> null (never fails the job)."""
    return c.try_cast("double")


def require_columns(df: DataFrame, columns: Sequence[str] = ("ts", *REQUIRED)) -> DataFrame:
    """The table itself, or an error that names the missing columns."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"interval table lacks the columns {', '.join(missing)}")
    return df


def typed_intervals(raw: DataFrame) -> DataFrame:
    """Times and numbers, null where a value doesn't parse;
    missing generation columns are null."""
    d = require_columns(raw).withColumns({c: F.lit(None).cast("double") for c in OPTIONAL if c not in raw.columns})
    ts = F.try_to_timestamp("ts") if dict(d.dtypes)["ts"] == "string" else F.col("ts")
    return d.withColumns({"ts": ts.cast("timestamp_ntz"), **{c: to_number(F.col(c)) for c in OPTIONAL + REQUIRED}})


def clean_intervals(df: DataFrame, sources: dict[str, bool] | None = None) -> DataFrame:
    """Typed, zero-filled, clipped interval rows.

    * timestamps that do not parse are dropped (count them with ``interval_quality``);
    * missing optional generation columns become 0 (P2);
    * generation and load are coerced to numbers, null -> 0, clipped at 0;
      price is coerced, null -> 0, never clipped (P5, P7);
    * ``sources`` switches (P8) zero a generation column when False.
    """
    d = typed_intervals(df).where(F.col("ts").isNotNull())
    sw = sources or {}
    cols = {}
    for c in OPTIONAL + ["load_mw"]:
        v = F.greatest(F.lit(0.0), F.coalesce(F.col(c), F.lit(0.0)))
        if c in sw and not sw[c]:
            v = F.lit(0.0)
        cols[c] = v
    cols["price"] = F.coalesce(F.col("price"), F.lit(0.0))
    return d.withColumns(cols).select("site_id", "ts", *OPTIONAL, *REQUIRED)


def date_window(df: DataFrame, start: str, end: str) -> DataFrame:
    """Rows with start <= ts < end + 1 day (the end day is included whole).

    A plain range predicate on ``ts``; applied to a scan it is pushed down.
    """
    lo = F.lit(start).cast("timestamp_ntz")
    hi = F.date_add(F.lit(end).cast("date"), 1).cast("timestamp_ntz")
    return df.where((F.col("ts") >= lo) & (F.col("ts") < hi))


def interval_quality(raw: DataFrame, keys: Sequence[str] = ("site_id",)) -> DataFrame:
    """One quality row per site.

    ``raw`` is the interval table before cleaning: text, nulls and bad times
    are counted.  ``n_repeated_ts`` are rows beyond the first of a time, which
    no dispatch should get.
    """
    c = F.col
    raw = typed_intervals(raw)
    aggs = [
        F.count(F.lit(1)).alias("n_rows"),
        F.count_if(c("ts").isNull()).alias("n_bad_ts"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        *[F.count_if(c(x).isNull()).alias(f"n_null_{x}") for x in OPTIONAL + REQUIRED],
        *[(F.count(x) > 0).alias(f"has_{x}") for x in OPTIONAL],
        F.lit(0).cast("long").alias("n_repeated_ts"),
        (F.max("price") < 10).alias("price_unit_warning"),
        (F.sum(F.abs(F.coalesce(c("load_mw"), F.lit(0.0)))) < 1e-9).alias("load_all_zero"),
        F.round(F.avg(F.coalesce(c("load_mw"), F.lit(0.0))), 6).alias("avg_load_mw"),
        F.max("price").alias("peak_price"),
    ]
    facts = raw.groupBy(*keys).agg(*aggs)
    # counted apart: with the other facts beside them, a task's distinct times would fill its memory and spill
    times = raw.where(c("ts").isNotNull()).groupBy(*keys, "ts").agg((F.count(F.lit(1)) - 1).alias("_n"))
    repeated = times.groupBy(*[c(k).alias(f"_k_{k}") for k in keys]).agg(F.sum("_n").alias("_repeated"))
    return facts.join(repeated, reduce(and_, [c(k).eqNullSafe(c(f"_k_{k}")) for k in keys]), "left").withColumn(
        "n_repeated_ts", F.coalesce("_repeated", F.lit(0).cast("long"))).select(*facts.columns)


def in_daytime(ts: Column, first_hour: int = 7, last_hour: int = 22) -> Column:
    """hour of day within [first_hour, last_hour]."""
    return F.hour(ts).between(first_hour, last_hour)


def month_label(ts: Column) -> Column:
    """'yyyy-MM'."""
    return F.date_format(ts, "yyyy-MM")


def month_days(ts: Column) -> Column:
    """days in the month."""
    return F.dayofmonth(F.last_day(ts))


def year_span(first: Column, last: Column) -> Column:
    """'2024', or '2023-2024' over several years."""
    a, b = F.year(first).cast("string"), F.year(last).cast("string")
    return F.when(a == b, a).otherwise(F.concat(a, F.lit("-"), b))


def with_gas_availability(df: DataFrame, column: str = "gas_avail_mw") -> DataFrame:
    """The gas availability column falls back to the gas column when absent (or null)."""
    if column in df.columns:
        return df.withColumn(column, F.coalesce(F.col(column).try_cast("double"), F.col("natgas_mw")))
    return df.withColumn(column, F.col("natgas_mw"))


def tidy_columns(df: DataFrame, keep: Sequence[str] = ("site_id", "ts")) -> DataFrame:
    """P20: drop all-null and ``Unnamed*`` columns, coerce the rest to numbers.

    One aggregation job counts the non-null values of every column (partial
    counts per task, one row to the driver); ``keep`` columns are left as is.
    Duplicate names cannot occur in a DataFrame built by this library.
    """
    import re

    cand = [c for c in df.columns if c not in keep and not re.match(r"^Unnamed", c)]
    if not cand:
        return df.select(*[c for c in df.columns if c in keep])
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(f"c{i}") for i, c in enumerate(cand)]).first()
    alive = [c for i, c in enumerate(cand) if counts[f"c{i}"] > 0]
    return df.select(*[c for c in df.columns if c in keep],
                     *[F.col(f"`{c}`").try_cast("double").alias(c) for c in alive])
