"""Shared SQL fragments for the DuckDB oracle statements.

They mirror the Spark helpers in ``operators.metrics``: sums are taken over
doubles, and values are rounded once, half-up, through their DECIMAL(38,6)
form.
"""

from __future__ import annotations


def d(x: float) -> str:
    return f"CAST({float(x)!r} AS DOUBLE)"


def isum(x: str) -> str:
    """Sum of a double column."""
    return f"sum({x})"


def asdbl(s: str) -> str:
    return f"({s})"


def iround(s: str, n: int) -> str:
    """Half-up rounding of a sum to n decimals."""
    return dr(s, n)


def dr(x: str, n: int) -> str:
    """Half-up rounding of a double through its DECIMAL(38,6) form."""
    return f"CAST(round(CAST({x} AS DECIMAL(38,6)), {n}) AS DOUBLE)"
