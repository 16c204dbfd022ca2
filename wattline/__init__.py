"""wattline: energy interval analytics expressed as Spark DataFrame plans.

Interval tables (load, wind, solar, gas, price per site and time step) are
cleaned, dispatched through a bounded running balance (battery state of
charge), aggregated into run metrics, costed, ranked and audited, all with
Spark SQL / DataFrame operators.  See README.md for the module map.
"""

__version__ = "0.1.0"


def _ship_by_value() -> None:
    """Pickle this package's functions by value so executors need not install it."""
    import sys

    try:
        from pyspark import cloudpickle
        cloudpickle.register_pickle_by_value(sys.modules[__name__])
    except Exception:  # pragma: no cover - older cloudpickle: fall back to addPyFile
        pass


_ship_by_value()
