"""Interval series sources.

``intervals`` schema (one row per site and time step)::

    site_id bigint, ts timestamp_ntz, wind_mw, solar_mw, natgas_mw, load_mw, price double
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.operators.balance import shuffle_partitions
from wattline.sources.csv_source import HeadedCsv

INTERVAL_COLUMNS = ["site_id", "ts", "wind_mw", "solar_mw", "natgas_mw", "load_mw", "price"]
INTERVAL_SCHEMA = T.StructType([
    T.StructField("site_id", T.LongType(), False),
    T.StructField("ts", T.TimestampNTZType(), False),
    T.StructField("wind_mw", T.DoubleType()),
    T.StructField("solar_mw", T.DoubleType()),
    T.StructField("natgas_mw", T.DoubleType()),
    T.StructField("load_mw", T.DoubleType()),
    T.StructField("price", T.DoubleType()),
])

# --- fixed values: column headers of an interval CSV file -------------------
CSV_HEADERS = {
    "ts": "Datetime",
    "wind_mw": "Wind (MW)",
    "solar_mw": "Solar (MW)",
    "natgas_mw": "NatGas (MW)",
    "load_mw": "Load (MW)",
    "price": "Market Price ($/MWh)",
}
# --- end fixed values --------------------------------------------------------


def hour_floor(ts: Column) -> Column:
    """Truncate a timestamp_ntz to the hour without any time-zone step."""
    return F.make_timestamp_ntz(F.year(ts), F.month(ts), F.dayofmonth(ts), F.hour(ts),
                                F.lit(0), F.lit(0))


def read_interval_csv(spark: SparkSession, path: str, site_id: int | Column | None = None,
                      headers: dict[str, str] | None = None, range_bytes: int | None = None,
                      quoted_breaks: bool = True) -> DataFrame:
    """Scan interval CSV files (``sources.csv_source``), every column as text.

    Columns are typed afterwards (``functions.clean``), so a bad cell never
    fails the scan.  Columns absent from the file come back null and are
    zero-filled by the cleaning step.  ``site_id`` is a literal or a column, or
    (default) a hash of the file's path.  ``headers`` maps the wanted columns to
    the files' headers; ``quoted_breaks`` false says that no field holds a line break.
    """
    headers = headers or CSV_HEADERS
    spark.dataSource.register(HeadedCsv)
    reader = spark.read.format("headed_csv").options(headers=json.dumps(headers), quotedBreaks=str(quoted_breaks).lower())
    if range_bytes:
        reader = reader.option("rangeBytes", range_bytes)
    rows = reader.load(path)
    sid = (F.lit(site_id) if isinstance(site_id, int) else site_id) if site_id is not None else F.abs(F.xxhash64("_file"))
    return rows.select(sid.cast("bigint").alias("site_id"), F.element_at(F.split("_file", "/"), -1).alias("file_name"), *headers)


def intervals_from_events(spark: SparkSession, sf_dir: str, window: tuple[str, str] | None = None) -> DataFrame:
    """Stand-in interval series built from the driver's ``events`` table.

    One site per ``user_id``; one row per site and hour between the site's
    first and last event hour.  Event values are summed per hour into the
    generation / load columns by event type (as decimals, so the sums are
    exact), and the hourly mean value is the price (35.0 for hours without
    events).  This only shapes the input; all dispatch work happens later.
    With a ``window`` (first and last day) only its hours are made: the wide
    scan is filtered by ``ts``, the sites' spans come from one of two columns.

    Only hours with events are dealt out: each also makes the empty hours up to
    the site's next one, in as many tasks as the session has shuffle partitions.
    """
    ev = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "ts", "event_type", "value")
    all_ts = ev.select(F.col("user_id").alias("site_id"), hour_floor(F.col("ts")).alias("ts"))
    hour = F.expr("INTERVAL 1 HOUR")
    if window:
        lo, hi = F.lit(window[0]).cast("timestamp_ntz"), F.date_add(F.lit(window[1]).cast("date"), 1).cast("timestamp_ntz")
        ev = ev.where((F.col("ts") >= lo) & (F.col("ts") < hi))
    v = F.col("value").cast("decimal(18,2)")
    zero = F.lit(0).cast("decimal(18,2)")
    et = F.col("event_type")
    values = {"wind": F.sum(F.when(et == "view", v).otherwise(zero)),
              "solar": F.sum(F.when((et == "click") & F.hour("ts").between(6, 18), v).otherwise(zero)),
              "natgas": F.sum(F.when(et == "signup", v).otherwise(zero)),
              "loadd": F.sum(F.when(et.isin("purchase", "error"), v).otherwise(zero)),
              "price_raw": F.sum(v).cast("double") / F.count(F.lit(1))}
    met = (ev.where(F.col("ts").isNotNull()).groupBy(F.col("user_id").alias("site_id"), hour_floor(F.col("ts")).alias("ts"))
           .agg(F.lit(1).alias("_met"), *[x.cast("double").alias(n) for n, x in values.items()]))
    if window:
        # a site's span may begin before its first event in the window and end after the last
        span = all_ts.groupBy("site_id").agg(F.min("ts").alias("lo"), F.max("ts").alias("hi"))
        span = span.select("site_id", F.greatest("lo", lo).alias("lo"), F.least("hi", hi - hour).alias("hi")).where("lo <= hi")
        ends = span.select("site_id", F.explode(F.array(F.col("lo"), F.col("hi") + hour)).alias("ts"))
        met = met.unionByName(ends, allowMissingColumns=True)
    # of two rows of an hour (a span's begin, and its events) the second makes the hours
    after = F.lead("ts").over(Window.partitionBy("site_id").orderBy("ts", F.col("_met").asc_nulls_first()))
    d = met.repartition(shuffle_partitions(ev), "site_id").withColumn(
        "_next", after if window else F.coalesce(after, F.col("ts") + hour))
    d = d.where(F.col("_next") > F.col("ts")).select(
        "*", F.posexplode(F.sequence("ts", F.col("_next") - hour, hour)).alias("_k", "_hour"))
    given = lambda c, none: F.coalesce(F.when((F.col("_k") == 0) & F.col("site_id").isNotNull(), F.col(c)), F.lit(none))
    return d.select(
        F.col("site_id").cast("bigint").alias("site_id"),
        F.col("_hour").cast("timestamp_ntz").alias("ts"),
        given("wind", 0.0).alias("wind_mw"),
        given("solar", 0.0).alias("solar_mw"),
        given("natgas", 0.0).alias("natgas_mw"),
        given("loadd", 0.0).alias("load_mw"),
        F.round(given("price_raw", 35.0), 4).alias("price"),
    )


# DuckDB text of the same derivation, shared by every oracle query.
INTERVALS_SQL = """
ev AS (SELECT user_id AS site_id, date_trunc('hour', ts) AS ts, event_type, hour(ts) AS hr,
              CAST(value AS DECIMAL(18,2)) AS v FROM events),
agg AS (SELECT site_id, ts,
   sum(CASE WHEN event_type = 'view' THEN v ELSE 0 END) AS wind,
   sum(CASE WHEN event_type = 'click' AND hr BETWEEN 6 AND 18 THEN v ELSE 0 END) AS solar,
   sum(CASE WHEN event_type = 'signup' THEN v ELSE 0 END) AS natgas,
   sum(CASE WHEN event_type IN ('purchase', 'error') THEN v ELSE 0 END) AS loadd,
   CAST(sum(v) AS DOUBLE) / count(*) AS price_raw
   FROM ev GROUP BY site_id, ts),
span AS (SELECT site_id, min(ts) AS lo, max(ts) AS hi FROM agg GROUP BY site_id),
spine AS (SELECT site_id, unnest(generate_series(lo, hi, INTERVAL 1 HOUR)) AS ts FROM span),
intervals AS (SELECT s.site_id, CAST(s.ts AS TIMESTAMP) AS ts,
   coalesce(CAST(a.wind AS DOUBLE), 0.0) AS wind_mw, coalesce(CAST(a.solar AS DOUBLE), 0.0) AS solar_mw,
   coalesce(CAST(a.natgas AS DOUBLE), 0.0) AS natgas_mw, coalesce(CAST(a.loadd AS DOUBLE), 0.0) AS load_mw,
   round(coalesce(a.price_raw, 35.0), 4) AS price
   FROM spine s LEFT JOIN agg a ON a.site_id = s.site_id AND a.ts = s.ts)
"""
