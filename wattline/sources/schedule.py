"""Charge / discharge schedules: months x hours grid of 'C', 'D' or blank.

S4 read a wide schedule CSV, S5 the default template, P21 unpivot to long
form, J3 align the long schedule with an interval series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

HOURS = list(range(24))

# --- fixed values: default schedule template --------------------------------
# winter months (Jan, Feb, Nov, Dec): discharge 7-8, charge 11-15, discharge 17-19
# other months (Mar-Oct):            charge 9-13, discharge 16-20
WINTER_MONTHS = (1, 2, 11, 12)
WINTER_CHARGE_HOURS = (11, 12, 13, 14, 15)
WINTER_DISCHARGE_HOURS = (7, 8, 17, 18, 19)
SUMMER_CHARGE_HOURS = (9, 10, 11, 12, 13)
SUMMER_DISCHARGE_HOURS = (16, 17, 18, 19, 20)
# --- end fixed values --------------------------------------------------------

WIDE_SCHEMA = T.StructType([T.StructField("month", T.IntegerType(), False)]
                           + [T.StructField(f"h{h}", T.StringType()) for h in HOURS])
LONG_SCHEMA = "month int, hour int, action string"


def _template_action(month: int, hour: int) -> str:
    if month in WINTER_MONTHS:
        return "C" if hour in WINTER_CHARGE_HOURS else ("D" if hour in WINTER_DISCHARGE_HOURS else "")
    return "C" if hour in SUMMER_CHARGE_HOURS else ("D" if hour in SUMMER_DISCHARGE_HOURS else "")


def default_schedule_wide(spark: SparkSession) -> DataFrame:
    """The 12 x 24 template as a wide table (month, h0..h23)."""
    rows = [(m, *[_template_action(m, h) for h in HOURS]) for m in range(1, 13)]
    return spark.createDataFrame(rows, WIDE_SCHEMA)


def read_schedule_csv(spark: SparkSession, path: str) -> DataFrame:
    """Wide schedule CSV (first column month, then one column per hour 0..23)."""
    schema = T.StructType([T.StructField("month", T.StringType())]
                          + [T.StructField(str(h), T.StringType()) for h in HOURS])
    raw = spark.read.option("header", True).schema(schema).csv(path)
    return raw.select(F.expr("try_cast(month AS INT)").alias("month"),
                      *[F.col(f"`{h}`").alias(f"h{h}") for h in HOURS])


def schedule_long(wide: DataFrame) -> DataFrame:
    """Unpivot to (month, hour, action); action = upper(trim(x)), null -> ''.

    At most one row per (month, hour) with month 1..12 and hour 0..23, so the
    result has at most 288 rows whatever the input (safe to broadcast).
    """
    lng = wide.unpivot(["month"], [f"h{h}" for h in HOURS], "hcol", "action")
    lng = lng.select(F.col("month").cast("int").alias("month"),
                     F.regexp_extract("hcol", r"^h(\d+)$", 1).cast("int").alias("hour"),
                     F.upper(F.trim(F.coalesce(F.col("action"), F.lit("")))).alias("action"))
    lng = lng.where(F.col("month").between(1, 12) & F.col("hour").between(0, 23))
    return lng.groupBy("month", "hour").agg(F.first("action").alias("action"))


def schedule_wide(lng: DataFrame) -> DataFrame:
    """Long (month, hour, action) back to the wide template form (pivot)."""
    return (lng.groupBy("month").pivot("hour", HOURS).agg(F.first("action"))
            .select("month", *[F.coalesce(F.col(str(h)), F.lit("")).alias(f"h{h}") for h in HOURS]))


def align_schedule(df: DataFrame, lng: DataFrame) -> DataFrame:
    """Attach the schedule action to each interval (exact hour stamps only; others idle)."""
    on_hour = (F.minute("ts") == 0) & (F.second("ts") == 0)
    d = df.withColumns({"_m": F.when(on_hour, F.month("ts")), "_h": F.hour("ts")})
    s = F.broadcast(lng.select(F.col("month").alias("_m"), F.col("hour").alias("_h"), "action"))
    j = d.join(s, ["_m", "_h"], "left")
    return j.withColumn("action", F.coalesce(F.col("action"), F.lit(""))).drop("_m", "_h")
