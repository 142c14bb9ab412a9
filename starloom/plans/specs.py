"""What users define: metrics, derived metrics and queries."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from graphlib import CycleError, TopologicalSorter
from typing import Any

from ..functions.expressions import columns_in
from .state import Criteria, as_criteria


@dataclass
class Nested:
    """An inner aggregation over more dimensions, whose results the metric's own aggregation takes; compose formats an
    inner row (a template with {dimension} and {value}, or a function of the row)."""

    dimensions: list[str]
    aggregation: Any = "sum"
    compose: str | Callable | None = None

    @classmethod
    def of(cls, spec: dict[str, Any] | Nested | None) -> Nested | None:
        if spec is None or isinstance(spec, Nested):
            return spec
        if not isinstance(spec, dict):
            raise TypeError("nested must be a dict with 'dimensions' and, if wanted, 'aggregation' and 'compose'")
        extra, dims = set(spec) - {"dimensions", "aggregation", "compose"}, spec.get("dimensions")
        if extra or "dimensions" not in spec:
            raise ValueError(f"nested takes 'dimensions', 'aggregation' and 'compose'; got {sorted(spec)}")
        dims = [dims] if isinstance(dims, str) else dims
        if not isinstance(dims, list) or not all(isinstance(d, str) for d in dims):
            raise TypeError("nested dimensions must be a name or a list of names")
        if not dims:
            raise ValueError("nested dimensions must not be empty")
        compose = spec.get("compose")
        if compose is not None and not isinstance(compose, str) and not callable(compose):
            raise TypeError("nested compose must be a template or a function")
        return cls(list(dims), spec.get("aggregation") or "sum", compose)


@dataclass
class Metric:
    """expression: over rows' columns; aggregation: over the dimensions of a query; the rest changes which rows and
    dimensions count."""

    name: str | None = None
    expression: str | None = None
    aggregation: Any = None
    metric_filters: Criteria | None = None
    row_condition_expression: str | None = None
    context_state_name: str = "Default"
    ignore_dimensions: bool | list[str] = False
    ignore_context_filters: bool | list[str] = False
    fillna: Any = None
    nested: Nested | None = None

    def __post_init__(self) -> None:
        self.metric_filters = as_criteria(self.metric_filters) or None
        self.nested = Nested.of(self.nested)
        if not isinstance(self.ignore_dimensions, (bool, list)):
            raise ValueError(f"ignore_dimensions must be True, False or a list, not {self.ignore_dimensions!r}")

    @property
    def columns(self) -> list[str]:
        return columns_in(self.expression, self.row_condition_expression)

    @property
    def nested_dimensions(self) -> list[str]:
        return list(self.nested.dimensions) if self.nested else []

    def dimensions_of(self, dimensions: list[str]) -> list[str]:
        """The query's dimensions that this metric is grouped by."""
        if isinstance(self.ignore_dimensions, list):
            return [d for d in dimensions if d not in self.ignore_dimensions]
        return [] if self.ignore_dimensions else list(dimensions)

    def spec(self) -> dict[str, Any]:
        out = {k: v for k, v in vars(self).items() if k != "name"}
        out["nested"] = vars(self.nested).copy() if self.nested else None
        return out


@dataclass
class DerivedMetric:
    name: str
    expression: str
    fillna: Any = None

    def __post_init__(self) -> None:
        if not self.name or not self.expression:
            raise ValueError("A derived metric needs a name and an expression")

    @property
    def columns(self) -> list[str]:
        return columns_in(self.expression)

    def spec(self) -> dict[str, Any]:
        return {"expression": self.expression, "fillna": self.fillna}


@dataclass
class QuerySpec:
    dimensions: list[str] = field(default_factory=list)
    metrics: list[str] = field(default_factory=list)
    derived_metrics: list[str] = field(default_factory=list)
    having: str | None = None
    sort: list[tuple[str, str]] = field(default_factory=list)
    drop_null_dimensions: bool = False
    drop_null_metric_results: bool = False

    def __post_init__(self) -> None:
        self.dimensions, self.metrics, self.derived_metrics = list(self.dimensions or []), list(self.metrics or []), list(self.derived_metrics or [])
        self.sort = [parse_sort(s) for s in self.sort or []]
        if not self.dimensions and not self.metrics and not self.derived_metrics:
            raise ValueError("A query needs a dimension or a metric")

    def spec(self) -> dict[str, Any]:
        return vars(self) | {"sort": [list(s) for s in self.sort]}


def parse_sort(item: Any) -> tuple[str, str]:
    """(column, direction) of a pair, of {column, direction} or of "column direction"."""
    if isinstance(item, dict):
        return item["column"], str(item.get("direction", "asc")).lower()
    if isinstance(item, str):
        name, _, direction = item.rpartition(" ")
        return (name, direction.lower()) if name and direction.lower() in ("asc", "desc") else (item, "asc")
    name, direction = (*item, "asc")[:2]
    return name, str(direction).lower()


@dataclass
class Needs:
    """What a query computes: base metrics and derived metrics in order, those asked for and those they depend on."""

    metrics: list[str]
    derived: list[str]
    missing: list[str]


def resolve_needs(query: QuerySpec, metrics: dict[str, Metric], derived: dict[str, DerivedMetric], dimensions: set[str], extra: set[str] = frozenset()) -> Needs:
    """extra: names that transformers add, which `having` may use."""
    base, graph, missing = list(dict.fromkeys(query.metrics)), {}, []
    todo = [*query.derived_metrics, *(c for c in [*columns_in(query.having), *(s[0] for s in query.sort)] if c in derived or c in metrics)]
    todo += [c for c in columns_in(query.having) if c not in derived and c not in metrics and c not in query.dimensions and c not in extra]
    while todo:
        name = todo.pop()
        if name in derived:
            if name not in graph:
                graph[name] = [c for c in derived[name].columns if c in derived]
                todo += derived[name].columns
        elif name in metrics:
            if name not in base:
                base.append(name)
        elif name not in query.dimensions and name not in extra and name not in missing:
            missing.append(name)
    missing += [m for m in query.metrics if m not in metrics and m not in missing]
    try:
        order = list(TopologicalSorter({k: sorted(v) for k, v in sorted(graph.items())}).static_order())
    except CycleError as e:
        raise ValueError(f"Cyclic derived metrics: {' -> '.join(e.args[1])}") from e
    return Needs(base, order, missing)
