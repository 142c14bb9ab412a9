"""Queries to DataFrame plans: metrics of one grain in one aggregation, their results side by side, then derived ones.

A metric's rows are at the grain of the tables that its columns span, however the joins fan out: rows are made
distinct by those tables' row ids and the dimensions. Where the keys on the way to the dimensions are unique that
changes nothing, and is left out.
"""

from __future__ import annotations

import string
from collections.abc import Callable
from functools import reduce
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.aggregates import Aggregate, reduced, resolve
from ..functions.expressions import Compiler, ExpressionError, Typed, kind_of
from ..functions.registry import FunctionRegistry
from .keyspace import KeySpace, col
from .model import is_hub
from .specs import DerivedMetric, Metric, Nested, QuerySpec

Predicates = list[tuple[str, list]]


class MetricEvaluationError(ValueError):
    """A metric's expression can't be evaluated."""


class Evaluator:
    """Builds plans over a key space. predicates_of gives the filters that hold for a metric (None: for dimensions)."""

    def __init__(self, space: KeySpace, registry: FunctionRegistry, predicates_of: Callable[[Metric | None], Predicates]) -> None:
        self.space, self.model, self.registry, self.predicates_of = space, space.model, registry, predicates_of

    # --- dimensions --------------------------------------------------------------------------------------------

    def members(self, dimensions: list[str], predicates: Predicates, drop_nulls: bool = False) -> DataFrame:
        """Distinct combinations of dimensions, NULL members included."""
        out = self.space.frame(set(dimensions), set(), predicates).select(*(col(d) for d in dimensions)).distinct()
        return out.dropna(subset=[f"`{d}`" for d in dimensions]) if drop_nulls else out

    # --- metrics -----------------------------------------------------------------------------------------------

    def trajectory(self, metric: Metric) -> tuple[set[str], set[str]]:
        """(tables whose rows are the metric's grain, shared columns that it reads)."""
        owners = {c: self._owner(c, metric) for c in metric.columns}
        nodes = self.model.subtree(set(owners.values()))
        return {n for n in nodes if not is_hub(n)}, {c for c, n in owners.items() if is_hub(n)}

    def _owner(self, column: str, metric: Metric) -> str:
        if column not in self.model.owner:
            raise MetricEvaluationError(f"Metric {metric.name!r}: unknown column [{column}] in {metric.expression!r}")
        return self.model.owner[column]

    def _compile(self, metric: Metric) -> tuple[Typed, Column | None]:
        columns = {c: (col(c), self.space.type_of(c)) for c in metric.columns}
        try:
            compiler = Compiler(columns, self.registry, fillna=metric.fillna)
            return compiler.compile(str(metric.expression)), compiler.condition(metric.row_condition_expression) if metric.row_condition_expression else None
        except ExpressionError as e:
            raise MetricEvaluationError(f"Metric {metric.name!r}: {e}") from e

    def metrics(self, metrics: list[Metric], dimensions: list[str], drop_nulls: bool, drop_null_results: bool) -> DataFrame:
        """One row a combination of dimensions that any metric has: the dimensions and all metrics."""
        groups: dict[tuple, list[Metric]] = {}
        for m in metrics:
            tables, hubs = self.trajectory(m)
            aggregate = resolve(m.aggregation, self.registry)
            grain = (tuple(m.dimensions_of(dimensions)), tuple(m.nested_dimensions), frozenset(tables), frozenset(hubs))
            alone = m.name if aggregate.python or m.nested else None
            groups.setdefault((repr(self.predicates_of(m)), grain, alone), []).append(m)
        parts = [self._group(ms, dimensions, drop_nulls) for ms in groups.values()]
        names = [m.name for m in metrics]
        out = self._side_by_side(parts, dimensions, names)
        if drop_nulls and dimensions:
            out = out.dropna(subset=[f"`{d}`" for d in dimensions])
        if drop_null_results:
            out = out.where(reduce(Column.__or__, (col(n).isNotNull() for n in names)))
        return out.select(*(col(c) for c in [*dimensions, *names]))

    @staticmethod
    def _side_by_side(parts: list[DataFrame], dimensions: list[str], names: list[str]) -> DataFrame:
        """A full join on the dimensions, NULL equal to NULL: each part has a combination once, so a union and one
        aggregation do."""
        if len(parts) == 1:
            return parts[0]
        union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        return union.groupBy(*(col(d) for d in dimensions)).agg(*(F.first(col(n), ignorenulls=True).alias(n) for n in names))

    def _group(self, metrics: list[Metric], dimensions: list[str], drop_nulls: bool) -> DataFrame:
        """Metrics of one state, grain and grouping in one aggregation."""
        first = metrics[0]
        predicates = self.predicates_of(first)
        by = first.dimensions_of(dimensions)
        rows = self._rows(metrics, by, predicates)
        if first.nested:
            grouped = self._nested(rows, first, by, drop_nulls)
        else:
            grouped = self._aggregate(rows, metrics, by, drop_nulls)
        if by == list(dimensions):
            return grouped
        members = self.members(dimensions, predicates)
        if not by:
            return members.crossJoin(F.broadcast(grouped))  # one row
        renamed = grouped.withColumnsRenamed({d: f"_by_{i}" for i, d in enumerate(by)})
        same = reduce(Column.__and__, (col(d).eqNullSafe(F.col(f"_by_{i}")) for i, d in enumerate(by)))
        return members.join(renamed, same, "left").drop(*(f"_by_{i}" for i in range(len(by))))

    def _rows(self, metrics: list[Metric], by: list[str], predicates: Predicates) -> DataFrame:
        """The rows that metrics of one grain aggregate."""
        tables, hubs = self.trajectory(metrics[0])
        keys = set(by) | set(metrics[0].nested_dimensions)
        columns = keys | {c for m in metrics for c in m.columns}
        aggregates = [resolve(m.aggregation, self.registry) for m in metrics]
        ordered = any(a.ordered for a in aggregates)
        if self._rows_stay_distinct(metrics, aggregates, keys | hubs, tables, predicates):
            return self._at_tables(columns, tables, tables if ordered else set(), predicates)
        rows = self._at_tables(columns, tables, tables, predicates)
        # the other columns depend on the rows' ids
        ids = [*sorted(keys | hubs), *(f"_index_{t}" for t in sorted(tables))]
        if not ids:
            return rows.limit(1)  # no dimension and no column: one row stands for all
        return rows.dropDuplicates(ids) if len(ids) < len(rows.columns) else rows.distinct()

    def _at_tables(self, columns: set[str], tables: set[str], index: set[str], predicates: Predicates) -> DataFrame:
        if columns or index:
            return self.space.frame(columns, index, predicates)
        return self.space.frame(set(), set(self.model.tables[:1]), predicates)

    def _rows_stay_distinct(self, metrics: list[Metric], aggregates: list[Aggregate], keys: set[str], tables: set[str], predicates: Predicates) -> bool:
        """Whether making rows distinct can be left out: none of these tables' rows comes twice, and rows without
        these tables, which may, have a NULL value that no aggregate sees."""
        if not tables or self.space.core is not None or self._reads_hubs(metrics):
            return False
        for m, a in zip(metrics, aggregates):
            if not a.ignores_nulls or m.fillna is not None or not self._compile(m)[0].strict or not m.columns or m.nested and m.nested.aggregation == "size":
                return False
        wanted = {self.model.owner[c] for c in keys | {c for c, _ in predicates} | {c for m in metrics for c in m.columns}} | tables
        return not self.space.fans_out(tables, self.model.subtree(wanted), keys)

    def _reads_hubs(self, metrics: list[Metric]) -> bool:
        return any(is_hub(self.model.owner[c]) for m in metrics for c in m.columns)

    def _order(self, rows: DataFrame) -> Column:
        ids = [c for c in rows.columns if c.startswith("_index_")]
        return F.struct(*(col(c) for c in ids)) if ids else F.lit(0)

    def _aggregate(self, rows: DataFrame, metrics: list[Metric], by: list[str], drop_nulls: bool) -> DataFrame:
        """A group without a row that meets a metric's condition isn't a result of that metric."""
        order, columns, present = self._order(rows), [], []
        compiled = [self._compile(m) for m in metrics]
        if all(c is not None for _, c in compiled):  # only rows that some metric wants
            rows = rows.where(reduce(Column.__or__, (c for _, c in compiled)))
        if drop_nulls and by:
            rows = rows.dropna(subset=[f"`{d}`" for d in by])
        if len(metrics) == 1 and (aggregate := resolve(metrics[0].aggregation, self.registry)).weighted:
            value = compiled[0][0]
            return reduced(rows, [col(d) for d in by], aggregate, value.col, value.kind, order, metrics[0].name)
        for m, (value, condition) in zip(metrics, compiled):
            aggregate = resolve(m.aggregation, self.registry)
            expression = value.col
            if condition is None or len(metrics) == 1:
                out = aggregate.column(expression, value.kind, order)
                present.append(None)
            else:
                holds = F.coalesce(condition, F.lit(False))
                out = aggregate.column(F.when(holds, expression), value.kind, order) if aggregate.ignores_nulls else F.count_if(holds)
                found = F.count_if(holds) > 0
                out = F.when(found, out) if by else out
                present.append(found)
            columns.append(out.alias(m.name))
        grouped = rows.groupBy(*(col(d) for d in by))
        if by and all(p is not None for p in present):
            kept = reduce(Column.__or__, present).alias("_present")
            return grouped.agg(*columns, kept).where("_present").drop("_present")
        return grouped.agg(*columns)

    # --- nested ------------------------------------------------------------------------------------------------

    def _nested(self, rows: DataFrame, metric: Metric, by: list[str], drop_nulls: bool) -> DataFrame:
        nested = metric.nested
        inner_by = [*by, *(d for d in nested.dimensions if d not in by)]
        value, condition = self._compile(metric)
        if condition is not None:
            rows = rows.where(condition)
        if drop_nulls:
            rows = rows.dropna(subset=[f"`{d}`" for d in inner_by])
        inner = resolve(nested.aggregation, self.registry)
        grouped = reduced(rows, [col(d) for d in inner_by], inner, value.col, value.kind, self._order(rows), "_value")
        kind = kind_of(grouped.schema["_value"].dataType)
        if nested.compose is not None:
            grouped, kind = composed(grouped, inner_by, nested, metric.name), "string"
        outer = resolve(metric.aggregation, self.registry)
        order = F.struct(*(col(d) for d in inner_by))
        return reduced(grouped, [col(d) for d in by], outer, F.col("_value"), kind, order, metric.name)

    # --- results -----------------------------------------------------------------------------------------------

    def derived(self, df: DataFrame, derived: list[DerivedMetric], dimensions: list[str]) -> DataFrame:
        for d in derived:
            compiler, wholes = self._result_compiler(df, dimensions, d.fillna)
            try:
                made = compiler.compile(d.expression)
                value = made.col if d.fillna is None else compiler.filled(made)
            except ExpressionError as e:
                raise MetricEvaluationError(f"Derived metric {d.name!r}: {e}") from e
            if wholes:
                df = df.crossJoin(F.broadcast(df.agg(*(a.alias(n) for n, a in wholes.items()))))
            df = df.withColumn(d.name, value).drop(*wholes)
        return df

    def _result_compiler(self, df: DataFrame, dimensions: list[str], fillna: Any = None) -> tuple[Compiler, dict[str, Column]]:
        wholes: dict[str, Column] = {}
        order = [col(d).asc_nulls_last() for d in dimensions] or [F.lit(0)]
        columns = {f.name: (col(f.name), f.dataType) for f in df.schema.fields}
        return Compiler(columns, self.registry, order=order, wholes=wholes, fillna=fillna), wholes

    def having(self, df: DataFrame, having: str, dimensions: list[str]) -> DataFrame:
        compiler, wholes = self._result_compiler(df, dimensions)
        condition = compiler.condition(having)
        if wholes:
            df = df.crossJoin(F.broadcast(df.agg(*(a.alias(n) for n, a in wholes.items()))))
        return df.where(condition).drop(*wholes)

    @staticmethod
    def sort(df: DataFrame, sort: list[tuple[str, str]]) -> DataFrame:
        """NULLs last in both directions; columns that aren't there are passed over."""
        keys = [col(c).asc_nulls_last() if d == "asc" else col(c).desc_nulls_last() for c, d in sort if c in df.columns]
        return df.orderBy(*keys) if keys else df


def composed(df: DataFrame, keys: list[str], nested: Nested, name: str) -> DataFrame:
    """df's _value replaced by a text made of its row; a function finds the value under the metric's name too."""
    if isinstance(nested.compose, str):
        fields = list(string.Formatter().parse(nested.compose))
        plain = all(field is None or not spec and not conversion and field in [*keys, "value"] for _, field, spec, conversion in fields)
        if plain:
            parts = []
            for text, field, _, _ in fields:
                parts += [F.lit(text)] if text else []
                parts += [(F.col("_value") if field == "value" else col(field)).cast("string")] if field is not None else []
            return df.withColumn("_value", F.concat(*(F.coalesce(p, F.lit("None")) for p in parts)))

    compose = nested.compose

    def run(rows: pd.DataFrame) -> pd.Series:
        rows = rows.set_axis([*keys, "value"], axis=1)
        rows = rows if name in rows.columns else rows.assign(**{name: rows["value"]})
        made = (compose.format(**r) if isinstance(compose, str) else compose(r) for r in rows.to_dict("records"))
        return pd.Series([str(x) for x in made], index=rows.index)

    run.__annotations__ = {"rows": pd.DataFrame, "return": pd.Series}
    packed = F.struct(*(col(k).alias(f"k{i}") for i, k in enumerate(keys)), F.col("_value").alias("value"))
    return df.withColumn("_value", F.pandas_udf(run, T.StringType())(packed))


def run_query(evaluator: Evaluator, query: QuerySpec, metrics: list[Metric], derived: list[DerivedMetric], transformers: list[Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """The whole of a query: metrics, derived metrics, transformers, having, sort, projection."""
    if metrics:
        df = evaluator.metrics(metrics, query.dimensions, query.drop_null_dimensions, query.drop_null_metric_results)
    else:
        df = evaluator.members(query.dimensions, evaluator.predicates_of(None), query.drop_null_dimensions)
    df = evaluator.derived(df, derived, query.dimensions)
    before = set(df.columns)
    for transform in transformers:
        df = transform(df)
    added = [c for c in df.columns if c not in before]
    if query.having:
        df = evaluator.having(df, query.having, query.dimensions)
    df = evaluator.sort(df, query.sort)
    return df.select(*(col(c) for c in dict.fromkeys([*query.dimensions, *query.metrics, *query.derived_metrics, *added])))
