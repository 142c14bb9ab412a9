"""Names that expressions may use with @: functions, modules and values; those that can be imported again are kept."""

from __future__ import annotations

import importlib
from collections.abc import Iterator, Mapping, MutableMapping
from types import ModuleType
from typing import Any

import numpy as np
import pandas as pd


class FunctionRegistry(MutableMapping):
    """name -> object; `np` and `pd` are there from the start."""

    def __init__(self, items: Mapping[str, Any] | None = None) -> None:
        self._items: dict[str, Any] = {"np": np, "pd": pd, **(items or {})}

    def __getitem__(self, name: str) -> Any:
        return self._items[name]

    def __setitem__(self, name: str, value: Any) -> None:
        if not name.isidentifier():
            raise ValueError(f"{name!r} isn't a name")
        self._items[name] = value

    def __delitem__(self, name: str) -> None:
        del self._items[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._items)

    def __len__(self) -> int:
        return len(self._items)

    def find(self, dotted: str) -> Any:
        """The object of a name, also with attributes (`np.nanmean`); None if there is none."""
        first, *rest = dotted.split(".")
        found = self._items.get(first)
        for part in rest:
            found = getattr(found, part, None)
        return found

    def specs(self) -> dict[str, str]:
        """How to import each object again: `module:name` or `obj:module:qualname`. Others, lambdas too, are left out."""
        out = {}
        for name, x in self._items.items():
            if isinstance(x, ModuleType):
                out[name] = f"module:{x.__name__}"
                continue
            module, qualname = getattr(x, "__module__", None), getattr(x, "__qualname__", None)
            if module and qualname and load(f"obj:{module}:{qualname}") is x:
                out[name] = f"obj:{module}:{qualname}"
        return out

    @classmethod
    def from_specs(cls, specs: Mapping[str, str]) -> FunctionRegistry:
        """The registry of specs; what can't be imported any more is left out."""
        found = {name: load(spec) for name, spec in specs.items()}
        return cls({name: x for name, x in found.items() if x is not None})


def load(spec: str) -> Any:
    kind, module, *rest = spec.split(":")
    try:
        found = importlib.import_module(module)
    except ImportError:
        return None
    if kind == "module":
        return found
    for part in rest[0].split("."):
        found = getattr(found, part, None)
    return found


def as_registry(value: Any) -> FunctionRegistry:
    return value if isinstance(value, FunctionRegistry) else FunctionRegistry(value)
