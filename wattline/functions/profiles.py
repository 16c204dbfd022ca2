"""synthetic load profiles.

* ``24-7``        constant ``load_mw``
* ``16-7``        ``load_mw`` for hours 7..22, else 0
* ``random``      normal(load_mw, load_std) clipped at 0
* ``random_16-7`` normal(load_mw, load_std) for hours 7..22, else 0 (not clipped)

The normal draw is Box-Muller over two uniforms made by rounds of modular
squaring of (interval index, site), so it is reproducible on any engine
(and in SQL) without a random-number service.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from wattline.functions.clean import in_daytime
from wattline.operators.dispatch import seconds_of

MOD = 2147483647   # 2^31 - 1
SEED = 20240101
#: Added in each round of x -> x * x + c (mod MOD).
ROUNDS = (1013904223, 662607015, 1380649, 299792458)


def uniforms(hour_index: Column, site: Column, seed: int = SEED) -> tuple[Column, Column]:
    """Two uniforms of an interval and site: squaring rounds modulo a prime
    break up the arithmetic progression of consecutive hours."""
    x = (hour_index * F.lit(7919) + site * F.lit(104729) + F.lit(seed)) % F.lit(MOD)
    for c in ROUNDS[:2]:
        x = (x * x + F.lit(c)) % F.lit(MOD)
    y = x
    for c in ROUNDS[2:]:
        y = (y * y + F.lit(c)) % F.lit(MOD)
    return (x + F.lit(1.0)) / F.lit(2147483648.0), (y + F.lit(1.0)) / F.lit(2147483648.0)


def std_normal(hour_index: Column, site: Column, seed: int = SEED) -> Column:
    u1, u2 = uniforms(hour_index, site, seed)
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def hour_index(ts: Column) -> Column:
    return F.floor(seconds_of(ts) / F.lit(3600)).cast("long")


def synthetic_load(ts: Column, site: Column, load_type: Column, load_mw: Column, load_std: Column) -> Column:
    day = in_daytime(ts)
    z = load_mw + load_std * std_normal(hour_index(ts), site)
    return (F.when(load_type == "24-7", load_mw)
            .when(load_type == "16-7", F.when(day, load_mw).otherwise(F.lit(0.0)))
            .when(load_type == "random", F.greatest(F.lit(0.0), z))
            .when(load_type == "random_16-7", F.when(day, z).otherwise(F.lit(0.0))))


def fill_synthetic_load(df, keys=("site_id",)):
    """Where a site's load is absent or all zero, use the configured synthetic load.

    The per-site test is an aggregate joined back (no per-site window).
    """
    flag = df.groupBy(*keys).agg((F.sum(F.abs(F.coalesce(F.col("load_mw"), F.lit(0.0)))) < 1e-9)
                                 .alias("_synth"))
    d = df.join(flag, list(keys), "left")
    syn = synthetic_load(F.col("ts"), F.col("site_id"), F.col("load_type"), F.col("base_load_mw"),
                         F.col("load_std"))
    return d.withColumn("load_mw", F.when(F.col("_synth"), syn).otherwise(F.col("load_mw"))).drop("_synth")
