"""Transformers: add columns to a query's result. Built-in ones are window expressions.

Without `by`, a transformer looks at the whole result, which a window puts into one task. Results are aggregates and
mostly small; for large ones give distributed=True, which deals rows to ranges of the order and writes them once.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Callable
from typing import Any

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.keyspace import col
from . import ordered


class Transformer(ABC):
    """df -> df with more columns. Rows and columns that are there stay as they are."""

    @abstractmethod
    def transform(self, df: DataFrame, **params: Any) -> DataFrame: ...


def _names(value: Any) -> list[str]:
    return [value] if isinstance(value, str) else list(value or [])


def _on(params: dict[str, Any], name: str) -> str:
    if not params.get("on"):
        raise ValueError(f"{name}: 'on' is required")
    return params["on"]


def _order(df: DataFrame, params: dict[str, Any]) -> list[Column]:
    """The order of sort_by, or else of the columns before `on` (a query's dimensions)."""
    by = _names(params.get("by"))
    sort = _names(params.get("sort_by")) or [c for c in df.columns[: df.columns.index(params["on"])] if c not in by] or [params["on"]]
    return [col(c).asc_nulls_last() for c in sort]


def _ordered(df: DataFrame, params: dict[str, Any]):
    return Window.partitionBy(*(col(c) for c in _names(params.get("by")))).orderBy(*_order(df, params))


def _spread(params: dict[str, Any]) -> bool:
    return bool(params.get("distributed")) and not params.get("by")


class MovingAverage(Transformer):
    """on, window=3, by, sort_by, min_periods (the window), center=False, new_column ("<on>_ma_<window>")."""

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        on, n = _on(params, "moving_average"), int(params.get("window", 3))
        least = n if params.get("min_periods") is None else int(params["min_periods"])
        first, last = (-(n // 2), (n - 1) // 2) if params.get("center") else (1 - n, 0)
        new = params.get("new_column") or f"{on}_ma_{n}"
        if _spread(params):
            return ordered.rolling_mean(df, col(on), _order(df, params), first, last, least, new)
        frame = _ordered(df, params).rowsBetween(first, last)
        mean = F.when(F.count(col(on)).over(frame) >= max(least, 1), F.avg(col(on)).over(frame))
        return df.withColumn(new, mean)


class ZScore(Transformer):
    """on, by, ddof=1, new_column ("<on>_z"); NULL where the deviation is 0."""

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        on, by = _on(params, "zscore"), _names(params.get("by"))
        ddof = 1 if params.get("ddof") is None else int(params["ddof"])
        new = params.get("new_column") or f"{on}_z"
        n, x = F.count(col(on)).cast("double"), col(on)
        spread: Column = F.stddev_samp(x) if ddof == 1 else F.when(n > ddof, F.sqrt(F.var_pop(x) * n / (n - ddof)))
        if not by:  # one row of totals, instead of all rows in one task
            totals = df.agg(F.avg(x).alias("_mean"), spread.alias("_spread"))
            return df.crossJoin(F.broadcast(totals)).withColumn(new, (x - F.col("_mean")) / F.nullif(F.col("_spread"), F.lit(0.0))).drop("_mean", "_spread")
        w = Window.partitionBy(*(col(c) for c in by))
        spread = F.stddev_samp(x).over(w) if ddof == 1 else F.when(F.count(x).over(w) > ddof, F.sqrt(F.var_pop(x).over(w) * F.count(x).over(w) / (F.count(x).over(w) - ddof)))
        return df.withColumn(new, (x - F.avg(x).over(w)) / F.nullif(spread, F.lit(0.0)))


class Cumulative(Transformer):
    """on, by, sort_by, new_column ("<on>_cum"): the running sum."""

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        on = _on(params, "cumulative")
        new = params.get("new_column") or f"{on}_cum"
        if _spread(params):
            return ordered.running_sum(df, col(on), _order(df, params), new)
        frame = _ordered(df, params).rowsBetween(Window.unboundedPreceding, Window.currentRow)
        return df.withColumn(new, F.when(col(on).isNotNull(), F.sum(col(on)).over(frame)))


class Rank(Transformer):
    """on, by, ascending=False, method (dense, min or first), new_column ("<on>_rank")."""

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        on, by, method = _on(params, "rank"), _names(params.get("by")), params.get("method", "dense")
        ranks = {"dense": F.dense_rank, "min": F.rank, "first": F.row_number}
        if method not in ranks:
            raise ValueError(f"rank: method must be one of {sorted(ranks)}")
        new = params.get("new_column") or f"{on}_rank"
        if _spread(params):
            return ordered.ranked(df, col(on), bool(params.get("ascending", False)), method, new)
        key = col(on).asc_nulls_last() if params.get("ascending", False) else col(on).desc_nulls_last()
        w = Window.partitionBy(*(col(c) for c in by)).orderBy(key)
        return df.withColumn(new, F.when(col(on).isNotNull(), ranks[method]().over(w)))


class Pareto(Transformer):
    """on, by, new_column ("<on>_share"): the share of the total that this and all larger values have."""

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        on, by = _on(params, "pareto"), _names(params.get("by"))
        new, parts = params.get("new_column") or f"{on}_share", [col(c) for c in by]
        if _spread(params):
            return ordered.running_share(df, col(on), new)
        upto = Window.partitionBy(*parts).orderBy(col(on).desc_nulls_last()).rangeBetween(Window.unboundedPreceding, Window.currentRow)
        share = F.try_divide(F.sum(col(on)).over(upto).cast("double"), F.sum(col(on)).over(Window.partitionBy(*parts)).cast("double"))
        return df.withColumn(new, share)


class GroupedPandas(Transformer):
    """A function of a pandas frame, run for each group of `by` (whole groups in a task) with applyInPandas.

    added: the new columns and their Spark types. Without `by` the whole result is one group.
    """

    def __init__(self, function: Callable[..., pd.DataFrame], by: list[str], added: dict[str, str]) -> None:
        self.function, self.by, self.added = function, by, added

    def transform(self, df: DataFrame, **params: Any) -> DataFrame:
        function, names = self.function, [*df.columns, *self.added]

        def run(rows: pd.DataFrame) -> pd.DataFrame:
            return function(rows, **params)[names]

        schema = df.withColumns({c: F.lit(None).cast(t) for c, t in self.added.items()}).schema
        return df.groupBy(*(col(c) for c in self.by)).applyInPandas(run, schema)


def built_in() -> dict[str, Transformer | Callable]:
    return {"moving_average": MovingAverage(), "zscore": ZScore(), "cumulative": Cumulative(), "rank": Rank(), "pareto": Pareto()}


def apply(df: DataFrame, transformer: Transformer | Callable, params: dict[str, Any], overwrite: bool = False) -> DataFrame:
    """df with the columns that the transformer adds; its changes to other columns count only if overwrite is set."""
    call = transformer.transform if isinstance(transformer, Transformer) else transformer
    if overwrite:
        return call(df, **params)
    kept = {f"_kept_{i}": col(c) for i, c in enumerate(df.columns)}
    out = call(df.withColumns(kept), **params)
    lost = [k for k in kept if k not in out.columns]
    if lost:
        raise ValueError("A transformer must leave the columns that it got")
    added = [c for c in out.columns if c not in df.columns and c not in kept]
    return out.select(*(F.col(k).alias(c) for k, c in zip(kept, df.columns)), *(col(c) for c in added))
