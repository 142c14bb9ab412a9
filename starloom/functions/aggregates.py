"""Aggregations by name, with the results that a data frame's group-by gives: sums of nothing are 0, and so on."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .expressions import ExpressionError
from .registry import FunctionRegistry

#: Other names of aggregations: fixed values.
ALIASES = {"avg": "mean", "average": "mean", "count_distinct": "nunique", "distinct_count": "nunique", "countdistinct": "nunique", "stddev": "std", "variance": "var", "product": "prod"}


@dataclass
class Aggregate:
    """column: (value, kind, row order) -> aggregate. ordered: needs the rows' order. ignores_nulls: rows whose value
    is NULL don't change the result. python: a grouped pandas UDF, which takes a whole group into one task. weighted:
    takes a column of a group's distinct values and one of how often each occurs, in place of the values."""

    column: Callable[[Column, str, Column], Column]
    kind: str = "number"
    ordered: bool = False
    ignores_nulls: bool = True
    python: bool = False
    weighted: bool = False


def _number(c: Column, kind: str) -> Column:
    return c.cast("long") if kind == "bool" else c


def _sum(c: Column, kind: str, order: Column) -> Column:
    if kind == "string":
        return F.coalesce(F.listagg(c, ""), F.lit(""))
    return F.coalesce(F.sum(_number(c, kind)), F.lit(0))


def _truth(c: Column, kind: str) -> Column:
    return c if kind == "bool" else c != "" if kind == "string" else c != 0


def _concat(c: Column, kind: str, order: Column) -> Column:
    texts = F.collect_list(F.when(c.isNotNull(), F.struct(order.alias("o"), c.cast("string").alias("x"))))
    return F.array_join(F.transform(F.array_sort(texts), lambda s: s["x"]), ", ")


def _skew(c: Column) -> Column:
    n = F.count(c).cast("double")
    return F.when(F.count(c) > 2, F.skewness(c) * F.sqrt(n * (n - 1)) / (n - 2))


AGGREGATES: dict[str, Aggregate] = {
    "sum": Aggregate(_sum),
    "mean": Aggregate(lambda c, k, o: F.avg(_number(c, k))),
    "min": Aggregate(lambda c, k, o: F.min(c), kind="same"),
    "max": Aggregate(lambda c, k, o: F.max(c), kind="same"),
    "median": Aggregate(lambda c, k, o: F.median(_number(c, k))),
    "std": Aggregate(lambda c, k, o: F.stddev_samp(_number(c, k))),
    "var": Aggregate(lambda c, k, o: F.var_samp(_number(c, k))),
    "sem": Aggregate(lambda c, k, o: F.stddev_samp(c) / F.sqrt(F.count(c).cast("double"))),
    "skew": Aggregate(lambda c, k, o: _skew(c)),
    "quantile": Aggregate(lambda c, k, o: F.median(_number(c, k))),
    "count": Aggregate(lambda c, k, o: F.count(c)),
    "size": Aggregate(lambda c, k, o: F.count(F.lit(1)), ignores_nulls=False),
    "first": Aggregate(lambda c, k, o: F.min_by(c, F.when(c.isNotNull(), o)), kind="same", ordered=True),
    "last": Aggregate(lambda c, k, o: F.max_by(c, F.when(c.isNotNull(), o)), kind="same", ordered=True),
    "prod": Aggregate(lambda c, k, o: F.coalesce(F.product(_number(c, k)), F.lit(1.0))),
    "any": Aggregate(lambda c, k, o: F.coalesce(F.bool_or(_truth(c, k)), F.lit(False)), kind="bool"),
    "all": Aggregate(lambda c, k, o: F.coalesce(F.bool_and(_truth(c, k)), F.lit(True)), kind="bool"),
    "nunique": Aggregate(lambda c, k, o: F.count_distinct(c)),
    "approx_nunique": Aggregate(lambda c, k, o: F.approx_count_distinct(c)),
    "concat": Aggregate(_concat, kind="string", ordered=True),
}


def resolve(aggregation: Any, registry: FunctionRegistry) -> Aggregate:
    """The aggregate of a name, a registered name (also dotted), or a function of a pandas Series."""
    if isinstance(aggregation, (list, tuple, dict)):
        raise ExpressionError("A metric has one aggregation, not several")
    if callable(aggregation):
        return _python(aggregation)
    if not isinstance(aggregation, str):
        raise ExpressionError(f"{aggregation!r} isn't an aggregation")
    name = aggregation.strip().lower().replace(" ", "_").replace("-", "_")
    name = ALIASES.get(name, name)
    if name in AGGREGATES:
        return AGGREGATES[name]
    found = registry.find(aggregation.strip()) or registry.find(name)
    if callable(found):
        return _python(found)
    raise ExpressionError(f"Unknown aggregation {aggregation!r}")


def reduced(df: DataFrame, by: list[Column], aggregate: Aggregate, value: Column, kind: str, order: Column, name: str) -> DataFrame:
    """df grouped by some columns to these and one aggregate. A weighted one takes no more of a group into a task than
    its distinct values."""
    if not aggregate.weighted:
        return df.groupBy(*by).agg(aggregate.column(value, kind, order).alias(name))
    at, here = [f"_by_{i}" for i in range(len(by))], df.select(*by).columns
    counted = df.select(*(c.alias(a) for c, a in zip(by, at)), value.alias("_value")).groupBy(*at, "_value").agg(F.count(F.lit(1)).alias("_count"))
    out = counted.groupBy(*at).agg(aggregate.column(F.struct("_value", "_count"), kind, order).alias("_out"))
    return out.select(*(F.col(a).alias(c) for a, c in zip(at, here)), F.col("_out").alias(name))


def _python(f: Callable) -> Aggregate:
    """A grouped pandas UDF. Its type: f.return_type, an annotation, or what it makes of two made-up values. With
    f.weighted it takes the values of a group that aren't NULL, each once, and how often they occur."""
    weighted = bool(getattr(f, "weighted", False))
    returns = getattr(f, "return_type", None) or {float: "double", int: "long", str: "string", bool: "boolean"}.get(getattr(f, "__annotations__", {}).get("return"))
    samples = {"number": [1.5, 2.5], "bool": [True, False], "date": [pd.Timestamp("2020-01-01")] * 2}

    def column(c: Column, kind: str, order: Column) -> Column:
        made = returns
        if made is None:
            sample = pd.Series(samples.get(kind, ["a", "b"]))
            out = f(sample, pd.Series([1, 1])) if weighted else f(sample)
            made = "boolean" if pd.api.types.is_bool(out) else "long" if pd.api.types.is_integer(out) else "double" if pd.api.types.is_number(out) else "string"

        def run(s: pd.Series, counts: pd.Series | None = None) -> Any:
            out = f(s[s.notna()], counts[s.notna()]) if weighted else f(s)
            return None if out is None or (pd.api.types.is_scalar(out) and pd.isna(out)) else str(out) if made == "string" else out

        result = {"double": float, "long": int, "string": str, "boolean": bool}.get(made, str)
        if weighted:
            both = lambda s, n: run(s, n)
            both.__annotations__ = {"s": pd.Series, "n": pd.Series, "return": result}
            return F.pandas_udf(both, made)(_number(c["_value"], kind), c["_count"])
        one = lambda s: run(s)
        one.__annotations__ = {"s": pd.Series, "return": result}
        return F.pandas_udf(one, made)(_number(c, kind))

    return Aggregate(column, kind="string" if returns == "string" else "number", ignores_nulls=weighted, python=True, weighted=weighted)
