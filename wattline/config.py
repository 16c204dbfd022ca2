"""Run configuration as table columns.

A run configuration is one row of parameters.  Every operator reads its
parameters as *columns*, so the same plan serves a single run (parameters
are literals, folded by Catalyst) and a sweep (parameters come from a joined
candidate table, one row per candidate).
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: field defaults of a run configuration -------------------
# (name, Spark type, default).  None means "required, no default".
CONFIG_FIELDS: list[tuple[str, T.DataType, Any]] = [
    ("start_date", T.StringType(), "2015-01-01"),
    ("end_date", T.StringType(), "2015-02-01"),
    ("base_load_mw", T.DoubleType(), None),   # average load of synthetic profiles
    ("load_std", T.DoubleType(), 15.0),
    ("load_type", T.StringType(), None),
    ("battery_power_mw", T.DoubleType(), None),
    ("battery_duration_h", T.DoubleType(), None),
    ("battery_count", T.IntegerType(), 1),
    ("rte", T.DoubleType(), None),
    ("battery2_power_mw", T.DoubleType(), 0.0),
    ("battery2_duration_h", T.DoubleType(), 0.0),
    ("battery2_rte", T.DoubleType(), 0.86),
    ("poi_limit_mw", T.DoubleType(), None),
    ("value_per_mwh", T.DoubleType(), 100.0),
    ("capex_power_usd_per_kw", T.DoubleType(), 200.0),
    ("capex_energy_usd_per_kwh", T.DoubleType(), 150.0),
    ("discount_years", T.IntegerType(), 20),
    ("gas_enabled", T.BooleanType(), False),
    ("gas_dispatchable", T.BooleanType(), False),
    ("gas_cost_mode", T.StringType(), "simple"),
    ("gas_use_profile_as_cap", T.BooleanType(), False),
    ("gas_pmax_mw", T.DoubleType(), 0.0),
    ("gas_pmin_mw", T.DoubleType(), 0.0),
    ("gas_ramp_up_mw_per_h", T.DoubleType(), 1_000_000.0),
    ("gas_ramp_down_mw_per_h", T.DoubleType(), 1_000_000.0),
    ("gas_min_up_h", T.IntegerType(), 0),
    ("gas_min_down_h", T.IntegerType(), 0),
    ("gas_startup_cost_usd", T.DoubleType(), 0.0),
    ("gas_var_cost_usd_per_mwh", T.DoubleType(), 0.0),
    ("gas_heat_rate_mmbtu_per_mwh", T.DoubleType(), 7.5),
    ("gas_fuel_price_usd_per_mmbtu", T.DoubleType(), 3.5),
    ("gas_vom_usd_per_mwh", T.DoubleType(), 0.0),
    ("voll_usd_per_mwh", T.DoubleType(), 5000.0),
    ("gas_no_load_cost_usd_per_h", T.DoubleType(), 0.0),
    ("bess_deg_cost_usd_per_mwh", T.DoubleType(), 0.0),
    ("gas_co2_tons_per_mmbtu", T.DoubleType(), 0.05306),
    ("carbon_price_usd_per_ton", T.DoubleType(), 0.0),
    ("dt_hours", T.DoubleType(), 1.0),
]
LOAD_TYPES = ("24-7", "16-7", "random", "random_16-7")
GAS_COST_MODES = ("simple", "advanced")
# --- end fixed values -------------------------------------------------------

#: Names that scenario files use for fields that are called otherwise here.
FILE_KEYS = {"base_load_mw": "load_mw"}
FIELD_TYPES = {n: t for n, t, _ in CONFIG_FIELDS}
CONFIG_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t, _ in CONFIG_FIELDS])


def full_config(cfg: Mapping[str, Any]) -> dict[str, Any]:
    """Fill defaults; raise for missing required fields or unknown names."""
    unknown = set(cfg) - set(FIELD_TYPES)
    if unknown:
        raise ValueError(f"unknown configuration fields: {sorted(unknown)}")
    out: dict[str, Any] = {}
    for name, _, default in CONFIG_FIELDS:
        if name in cfg and cfg[name] is not None:
            out[name] = cfg[name]
        elif default is None:
            raise ValueError(f"configuration field {name!r} is required")
        else:
            out[name] = default
    return out



def with_config(df: DataFrame, cfg: Mapping[str, Any], skip_existing: bool = False) -> DataFrame:
    """Attach one configuration as literal columns (no join, no shuffle).

    With ``skip_existing`` columns already present keep their values (used
    when some parameters vary per row, e.g. candidate sizes in a sweep).
    """
    full = full_config({k: v for k, v in cfg.items() if not k.startswith("_")})
    have = set(df.columns) if skip_existing else set()
    return df.withColumns({n: F.lit(full[n]).cast(FIELD_TYPES[n]) for n, _, _ in CONFIG_FIELDS if n not in have})



# ---------------------------------------------------------------------------
# Derived configuration values, as column expressions
# ---------------------------------------------------------------------------

def battery_energy_mwh(c: str = "") -> Column:
    return F.col(f"{c}battery_power_mw") * F.col(f"{c}battery_duration_h")


def battery2_energy_mwh(c: str = "") -> Column:
    return F.col(f"{c}battery2_power_mw") * F.col(f"{c}battery2_duration_h")


def gas_variable_cost(c: str = "") -> Column:
    """$/MWh of gas energy: heat rate x fuel + O&M (advanced) or flat (simple); 0 if gas off."""
    col = lambda n: F.col(f"{c}{n}")
    return (F.when(~col("gas_enabled"), F.lit(0.0))
            .when(col("gas_cost_mode") == "advanced",
                  col("gas_heat_rate_mmbtu_per_mwh") * col("gas_fuel_price_usd_per_mmbtu")
                  + col("gas_vom_usd_per_mwh"))
            .otherwise(col("gas_var_cost_usd_per_mwh")))


def gas_no_load_cost(c: str = "") -> Column:
    return F.when(F.col(f"{c}gas_enabled"), F.col(f"{c}gas_no_load_cost_usd_per_h")).otherwise(0.0)


def suggested_no_load_cost(c: str = "") -> Column:
    """Screening default: 10 % of full-load fuel cost (advanced) or of the flat cost."""
    col = lambda n: F.col(f"{c}{n}")
    return (F.when(~col("gas_enabled"), F.lit(0.0))
            .when(col("gas_cost_mode") == "advanced",
                  F.lit(0.10) * (col("gas_heat_rate_mmbtu_per_mwh") * col("gas_fuel_price_usd_per_mmbtu")))
            .otherwise(F.lit(0.10) * col("gas_var_cost_usd_per_mwh")))


def gas_co2_tons_per_mwh(c: str = "") -> Column:
    return F.when(F.col(f"{c}gas_enabled"),
                  F.col(f"{c}gas_heat_rate_mmbtu_per_mwh") * F.col(f"{c}gas_co2_tons_per_mmbtu")).otherwise(0.0)


def derived_config(cfgs: DataFrame) -> DataFrame:
    """Add the derived values to a configuration table."""
    return cfgs.withColumns({
        "battery_energy_mwh": battery_energy_mwh(),
        "battery2_energy_mwh": battery2_energy_mwh(),
        "gas_variable_cost_usd_per_mwh": gas_variable_cost(),
        "effective_no_load_cost_usd_per_h": gas_no_load_cost(),
        "suggested_no_load_cost_usd_per_h": suggested_no_load_cost(),
        "gas_co2_tons_per_mwh": gas_co2_tons_per_mwh(),
    })


def config_problems(cfgs: DataFrame) -> DataFrame:
    """One array of violated rules per configuration row (empty = valid)."""
    rules = [
        (~((F.col("rte") > 0) & (F.col("rte") < 1)), "rte must be in (0, 1)"),
        (~F.col("load_type").isin(*LOAD_TYPES), "unknown load_type"),
        (~F.col("gas_cost_mode").isin(*GAS_COST_MODES), "unknown gas_cost_mode"),
        (~(F.col("dt_hours") > 0), "dt_hours must be positive"),
    ]
    return cfgs.withColumn(
        "problems", F.filter(F.array(*[F.when(c, F.lit(m)) for c, m in rules]), lambda x: x.isNotNull()))


def split_valid(cfgs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The valid configurations, and the others with their problems."""
    p = config_problems(cfgs)
    return p.where(F.size("problems") == 0).drop("problems"), p.where(F.size("problems") > 0)
