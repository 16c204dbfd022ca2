"""Economics (F1-F4): capital recovery, annualised capex / O&M, opex per year, LCOE.

All functions are column expressions over a candidate table that carries
the candidate sizes and the per-resource economics (one joined row per
scenario, J5).
"""

from __future__ import annotations

from typing import Any, Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: default economics per resource ---------------------------
# resource: capex $/kW, capex $/kWh, fixed O&M $/kW-yr, life years, discount rate
DEFAULT_ECON = {
    "solar": (1000.0, 0.0, 15.0, 30.0, 0.07),
    "wind": (1500.0, 0.0, 35.0, 25.0, 0.07),
    "bess": (300.0, 200.0, 10.0, 15.0, 0.07),
    "gas": (800.0, 0.0, 20.0, 25.0, 0.07),
}
HOURS_PER_YEAR = 8760.0
# --- end fixed values --------------------------------------------------------

RESOURCES = ["solar", "wind", "bess", "gas"]
ECON_FIELDS = ["capex_usd_per_kw", "capex_usd_per_kwh", "fixed_om_usd_per_kw_yr", "life_years", "discount_rate"]
ECON_SCHEMA = T.StructType([T.StructField("scenario_id", T.LongType(), False),
                            T.StructField("resource", T.StringType(), False),
                            *[T.StructField(f, T.DoubleType()) for f in ECON_FIELDS]])


def econ_columns(struct: str) -> list[Column]:
    """The wide economics columns from a nested one (a scenario's)."""
    return [F.col(f"{struct}.{r}.{f}").alias(f"{r}_{f}") for r in RESOURCES for f in ECON_FIELDS]




def with_econ(df: DataFrame, econ: Mapping[str, Any] | None = None) -> DataFrame:
    """J5 for one scenario: the wide economics columns as literals (folded by Catalyst).

    For a table of scenarios use ``econ_columns`` on the joined scenario row.
    """
    cols = {}
    for r in RESOURCES:
        vals = (econ or {}).get(r) or DEFAULT_ECON[r]
        for f, v in zip(ECON_FIELDS, vals):
            cols[f"{r}_{f}"] = F.lit(float(v))
    return df.withColumns(cols)


def crf(rate: Column, life: Column) -> Column:
    """capital recovery factor r / (1 - (1 + r)^-N); 1/N when r ~ 0; 0 when N <= 0."""
    return (F.when(life <= 0, F.lit(0.0))
            .when(F.abs(rate) < 1e-9, F.lit(1.0) / life)
            .otherwise(rate / (F.lit(1.0) - F.pow(F.lit(1.0) + rate, -life))))


def _r2(x: Column) -> Column:
    return F.round(x.cast("decimal(38,6)"), 2).cast("double")


def annualized_cost(df: DataFrame) -> DataFrame:
    """annualised capex and fixed O&M per resource for each candidate row.

    Needs ``solar_mw wind_mw bess_power_mw bess_energy_mwh gas_mw`` and the
    wide economics columns.  Values are rounded to cents like the reference
    report; the total is the rounded sum of the unrounded parts.
    """
    c = F.col
    k = {r: crf(c(f"{r}_discount_rate"), c(f"{r}_life_years")) for r in RESOURCES}
    parts = {
        "annualized_solar_usd": k["solar"] * c("solar_capex_usd_per_kw") * c("solar_mw") * 1000.0,
        "annualized_wind_usd": k["wind"] * c("wind_capex_usd_per_kw") * c("wind_mw") * 1000.0,
        "annualized_bess_power_usd": k["bess"] * c("bess_capex_usd_per_kw") * c("bess_power_mw") * 1000.0,
        "annualized_bess_energy_usd": k["bess"] * c("bess_capex_usd_per_kwh") * c("bess_energy_mwh") * 1000.0,
        "annualized_gas_usd": k["gas"] * c("gas_capex_usd_per_kw") * c("gas_mw") * 1000.0,
    }
    fom = {
        "fixed_om_solar_usd_yr": c("solar_fixed_om_usd_per_kw_yr") * c("solar_mw") * 1000.0,
        "fixed_om_wind_usd_yr": c("wind_fixed_om_usd_per_kw_yr") * c("wind_mw") * 1000.0,
        "fixed_om_bess_usd_yr": c("bess_fixed_om_usd_per_kw_yr") * c("bess_power_mw") * 1000.0,
        "fixed_om_gas_usd_yr": c("gas_fixed_om_usd_per_kw_yr") * c("gas_mw") * 1000.0,
    }
    total = None
    for v in list(parts.values()) + list(fom.values()):
        total = v if total is None else total + v
    out = df.withColumns({**{n: _r2(v) for n, v in parts.items()}, **{n: _r2(v) for n, v in fom.items()},
                          "annualized_total_usd_yr": _r2(total)})
    return out.withColumn("fixed_om_total_usd_yr", c("fixed_om_solar_usd_yr") + c("fixed_om_wind_usd_yr")
                          + c("fixed_om_bess_usd_yr") + c("fixed_om_gas_usd_yr"))


def annual_figures(df: DataFrame) -> DataFrame:
    """F3 + F4: opex per year, total annual cost, levelised cost (null when nothing served)."""
    c = F.col
    h = c("horizon_hours")
    opex = F.when(h > 0, c("total_op_cost_usd_horizon") / h * HOURS_PER_YEAR).otherwise(F.lit(0.0))
    served_year = F.when(h > 0, c("total_served_mwh") / h * HOURS_PER_YEAR).otherwise(F.lit(0.0))
    total = c("annualized_total_usd_yr") + opex
    return df.withColumns({
        "opex_usd_yr": _r2(opex),
        "total_annual_cost_usd": _r2(total),
        "lcoe_usd_per_mwh": F.when(served_year > 0, _r2(total / served_year)),
    })
