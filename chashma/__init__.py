"""chashma: a PySpark-native engine for auditing, normalising, sampling and labelling large text corpora."""

from __future__ import annotations

__version__ = "0.1.0"


def ship_by_value() -> None:
    """Let Python workers receive this package's functions by value, so executors need no copy of it."""
    import sys

    from pyspark import cloudpickle

    cloudpickle.register_pickle_by_value(sys.modules[__name__])


ship_by_value()
