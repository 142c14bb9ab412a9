"""A multidimensional analytics engine on Spark DataFrames."""

from importlib import import_module
from typing import Any

#: Name -> module: imported on first use, so that Spark's Python workers load only what their task needs.
_HOMES = {"Hypercube": ".cube", "Metric": ".plans.specs", "DerivedMetric": ".plans.specs"}
__all__ = sorted(_HOMES)


def __getattr__(name: str) -> Any:
    if name not in _HOMES:
        raise AttributeError(f"module {__name__!r} has no attribute {name!r}")
    return getattr(import_module(_HOMES[name], __name__), name)
