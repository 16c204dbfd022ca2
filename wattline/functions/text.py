"""String functions (F7-F9) as column expressions."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def action_code(x: Column) -> Column:
    """schedule action: trim + upper; null -> '' (anything but C / D is idle downstream)."""
    return F.upper(F.trim(F.coalesce(x.cast("string"), F.lit(""))))


def parse_values(text: Column, default: Sequence[float]) -> Column:
    """a value list from free text: ';' and spaces act as commas, bad items are skipped,
    an empty result falls back to ``default``."""
    parts = F.split(F.regexp_replace(F.coalesce(text, F.lit("")), "[; ]", ","), ",")
    vals = F.filter(F.transform(parts, lambda p: F.trim(p).try_cast("double")), lambda v: v.isNotNull())
    dflt = F.array(*[F.lit(float(v)) for v in default]).cast("array<double>")
    return F.when(F.size(vals) > 0, vals).otherwise(dflt)


def money_text(x: Column) -> Column:
    """F8: whole dollars with thousands separators (rounded half-up first)."""
    return F.format_number(F.round(x.cast("decimal(38,6)"), 0).cast("double"), 0)
