"""Scenario bundles (S2, S3, F14): configuration + economics + sweep ranges + target.

A bundle is one nested row.  ``write_scenarios`` stores bundles as JSON
(one object per line, one folder per call); ``read_scenarios`` reads them
back with an explicit nested schema and orders them by file name.  The
flat <-> nested range conversions are plain struct / inline operations.
"""

from __future__ import annotations

import json
from typing import Any, Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from wattline.config import CONFIG_FIELDS, CONFIG_SCHEMA, FILE_KEYS, full_config
from wattline.functions.econ import DEFAULT_ECON, ECON_FIELDS, RESOURCES
from wattline.plans.sweep import RANGE_NAMES, RANGE_TYPE

ECON_STRUCT = T.StructType([T.StructField(r, T.StructType([T.StructField(f, T.DoubleType()) for f in ECON_FIELDS]))
                            for r in RESOURCES] + [T.StructField("carbon_price_usd_per_ton", T.DoubleType())])
BUNDLE_SCHEMA = T.StructType([
    T.StructField("name", T.StringType()),
    T.StructField("description", T.StringType()),
    T.StructField("run_config", CONFIG_SCHEMA),
    T.StructField("econ", ECON_STRUCT),
    T.StructField("screening_ranges", T.StructType([T.StructField(n, RANGE_TYPE) for n in RANGE_NAMES])),
    T.StructField("reliability_target_pct", T.DoubleType()),
    T.StructField("grid_allowed", T.BooleanType()),
])

# --- fixed values: the commercial screening scenario ------------------------
COMMERCIAL = {
    "name": "Commercial C&I",
    "description": "Small commercial facility. Lower VOLL (some load is deferrable). Renewables + BESS focus.",
    "run_config": dict(start_date="2015-05-01", end_date="2015-05-31", base_load_mw=50.0, load_std=15.0,
                       load_type="16-7", battery_power_mw=20.0, battery_duration_h=4.0, rte=0.86,
                       poi_limit_mw=50.0, voll_usd_per_mwh=2000.0, bess_deg_cost_usd_per_mwh=3.0),
    "econ": None,
    "screening_ranges": {
        "solar": dict(mode="absolute", values=[20.0, 50.0, 80.0], reference_mw=100.0),
        "wind": dict(mode="pinned", values=[0.0], reference_mw=148.0),
        "bess_power": dict(mode="absolute", values=[10.0, 20.0, 40.0], reference_mw=None),
        "bess_duration": dict(mode="absolute", values=[2.0, 4.0], reference_mw=None),
        "gas": dict(mode="absolute", values=[0.0, 10.0, 25.0], reference_mw=None),
    },
    "reliability_target_pct": 95.0,
    "grid_allowed": False,
}
# --- end fixed values --------------------------------------------------------


def bundle_dict(b: Mapping[str, Any]) -> dict:
    """A bundle as a plain nested dict with every default filled in."""
    econ = b.get("econ") or {}
    e = {r: dict(zip(ECON_FIELDS, (econ.get(r) or DEFAULT_ECON[r]))) for r in RESOURCES}
    e["carbon_price_usd_per_ton"] = float(econ.get("carbon_price_usd_per_ton", 0.0) or 0.0)
    rng = {n: {"name": n, "mode": r["mode"], "values": [float(v) for v in r["values"]],
               "reference_mw": r.get("reference_mw")} for n, r in b["screening_ranges"].items()}
    return {"name": b.get("name", "unnamed"), "description": b.get("description", ""),
            "run_config": full_config(b["run_config"]), "econ": e, "screening_ranges": rng,
            "reliability_target_pct": float(b.get("reliability_target_pct", 99.0)),
            "grid_allowed": bool(b.get("grid_allowed", False))}


def scenarios_df(spark: SparkSession, bundles: list[Mapping[str, Any]]) -> DataFrame:
    """Bundles as a DataFrame with the nested schema (JSON round trip keeps the driver out of typing)."""
    rows = [(json.dumps(bundle_dict(b)),) for b in bundles]
    raw = spark.createDataFrame(rows, "value string")
    return raw.select(F.from_json("value", BUNDLE_SCHEMA).alias("b")).select("b.*")


_FILE_CONFIG = T.StructType([T.StructField(FILE_KEYS.get(f.name, f.name), f.dataType) for f in CONFIG_SCHEMA])
FILE_SCHEMA = T.StructType([T.StructField("run_config", _FILE_CONFIG) if f.name == "run_config" else f
                            for f in BUNDLE_SCHEMA])


def _config(to: T.StructType, names: Mapping[str, str]) -> "F.Column":
    return F.struct(*[F.col(f"run_config.{names.get(f.name, f.name)}").alias(f.name) for f in to])


def write_scenarios(df: DataFrame, path: str) -> None:
    """S3: bundles as JSON files (one object per line), with the field names of scenario files."""
    back = {v: k for k, v in FILE_KEYS.items()}
    df.withColumn("run_config", _config(_FILE_CONFIG, back)).write.mode("overwrite").json(path)


def read_scenarios(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """JSON bundles with an explicit nested schema, with the file's name.

    ``multi_line``: a file holds one indented bundle (or a list of them); else
    one bundle a line.  Fields that a file leaves out get the defaults; a file
    without a bundle's name fails, since it holds something else.
    """
    df = spark.read.schema(FILE_SCHEMA).option("multiLine", multi_line).json(path)
    df = df.withColumn("file_name", F.col("_metadata.file_name")).where(F.assert_true(
        F.col("name").isNotNull(), F.concat(F.lit("no scenario in "), F.col("_metadata.file_name"))).isNull())
    default = {n: v for n, _, v in CONFIG_FIELDS}
    config = F.struct(*[F.coalesce(F.col(f"run_config.{FILE_KEYS.get(f.name, f.name)}"), F.lit(default[f.name]).cast(f.dataType))
                        .alias(f.name) for f in CONFIG_SCHEMA])
    econ = F.struct(*[F.struct(*[F.coalesce(F.col(f"econ.{r}.{f}"), F.lit(v)).alias(f) for f, v in zip(
        ECON_FIELDS, DEFAULT_ECON[r])]).alias(r) for r in RESOURCES],
        F.coalesce(F.col("econ.carbon_price_usd_per_ton"), F.lit(0.0)).alias("carbon_price_usd_per_ton"))
    # Q5: the economics' carbon price is the run's
    config = config.withField("carbon_price_usd_per_ton", F.greatest(
        F.coalesce(F.col("run_config.carbon_price_usd_per_ton"), F.lit(0.0)),
        F.coalesce(F.col("econ.carbon_price_usd_per_ton"), F.lit(0.0))))
    return df.withColumns({"run_config": config, "econ": econ,
                           "reliability_target_pct": F.coalesce("reliability_target_pct", F.lit(99.0)),
                           "grid_allowed": F.coalesce("grid_allowed", F.lit(False))})


def ranges_flat(bundles: DataFrame) -> DataFrame:
    """F14 nested -> flat ranges: (scenario, resource, mode, values, reference_mw)."""
    arr = F.array(*[F.col(f"screening_ranges.{n}") for n in RANGE_NAMES])
    keep = [c for c in bundles.columns if c not in ("name", "screening_ranges")]
    return bundles.select(F.col("name").alias("scenario"), *keep, F.inline(arr)).withColumnRenamed("name", "resource")


def ranges_nested(flat: DataFrame) -> DataFrame:
    """F14 flat -> nested: one ``screening_ranges`` struct per scenario."""
    agg = flat.groupBy("scenario").agg(F.map_from_entries(F.collect_list(F.struct(
        "resource", F.struct(F.col("resource").alias("name"), "mode", "values", "reference_mw")))).alias("m"))
    return agg.select("scenario", F.struct(*[F.col("m")[n].alias(n) for n in RANGE_NAMES]).alias("screening_ranges"))
