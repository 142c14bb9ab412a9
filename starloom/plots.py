"""Plots: configurations, suggestions, the data of each plot type as Spark plans, and renderers on the driver.

Data preparation stays lazy; a renderer fetches at most its row limit.
"""

from __future__ import annotations

import html
import numbers
from abc import ABC, abstractmethod
from typing import Any

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .plans.keyspace import col

#: Plot types by (dimensions, metrics): fixed values. More metrics on one dimension: bar, line. Otherwise: table.
SUGGESTIONS = {(1, 1): ["bar", "line", "area", "pie"], (2, 1): ["bar", "line", "area"], (1, 2): ["combo", "bar", "line"]}
DESCRIPTIONS = {"bar": "Compare values", "line": "Follow values in order", "area": "Follow volumes in order", "pie": "Shares of a total", "combo": "Bars and a line", "table": "Tabular data"}
#: What a plot configuration may hold besides its query and name, with defaults.
DEFAULTS: dict[str, Any] = {
    "plot_type": None, "dimensions": None, "metrics": None, "color_by": None, "title": None, "stacked": False, "figsize": None,
    "orientation": "vertical", "palette": None, "sort_values": False, "sort_ascending": True, "sort_by": None, "pivot": None,
    "limit": None, "formatter": None, "legend_position": None, "annotations": None, "custom_options": None, "hide_index": False,
    "row_color_condition": None, "row_colors": None,
}


class PlotConfigResolver(ABC):
    @abstractmethod
    def suggest(self, dims_count: int, metrics_count: int) -> list[dict[str, Any]]: ...

    @abstractmethod
    def resolve(self, config: dict[str, Any], query: dict[str, Any] | None = None) -> dict[str, Any]: ...


class DefaultPlotConfigResolver(PlotConfigResolver):
    def __init__(self, fallback: str = "table") -> None:
        self.fallback = fallback

    def suggest(self, dims_count: int, metrics_count: int) -> list[dict[str, Any]]:
        types = SUGGESTIONS.get((dims_count, metrics_count)) or (["bar", "line"] if dims_count == 1 and metrics_count > 2 else [self.fallback])
        return [{"plot_type": t, "description": DESCRIPTIONS.get(t, t), "options": {}} for t in types]

    def resolve(self, config: dict[str, Any], query: dict[str, Any] | None = None) -> dict[str, Any]:
        if config.get("plot_type"):
            return dict(config)
        query = query or {}
        dims = config.get("dimensions") or query.get("dimensions") or []
        mets = config.get("metrics") or [*(query.get("metrics") or []), *(query.get("derived_metrics") or [])]
        return {**config, "plot_type": self.suggest(len(dims), len(mets))[0]["plot_type"]}


# --- data ------------------------------------------------------------------------------------------------------------


def sort_keys(config: dict[str, Any], columns: list[str]) -> list[tuple[str, bool]]:
    """sort_by, or the only metric if sort_values, as far as these are columns, each with whether it ascends: a
    direction each, the last one repeated."""
    by = config.get("sort_by")
    by = [by] if isinstance(by, str) else list(by or [])
    if not by and config.get("sort_values") and len(config["metrics"]) == 1:
        by = list(config["metrics"])
    ways = config.get("sort_ascending", True)
    ways = list(ways) if isinstance(ways, (list, tuple)) else [ways]
    ways = ways or [True]
    keys = [c for c in by if c in columns]
    return list(zip(keys, ways + [ways[-1]] * len(keys)))


def _arranged(df: DataFrame, keys: list[tuple[str, bool]], limit: Any) -> DataFrame:
    if keys:
        df = df.orderBy(*(col(c).asc_nulls_last() if up else col(c).desc_nulls_last() for c, up in keys))
    return df.limit(int(limit)) if limit else df


def sorted_and_limited(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    return _arranged(df, sort_keys(config, df.columns), config.get("limit"))


def pivoted(df: DataFrame, index: list[str], by: str, metric: str, how: str = "sum", values: list | None = None) -> DataFrame:
    """A row a member of index, a column a member of `by` (name the values to spare a job): sums, 0 where there are
    none, or first values."""
    grouped = df.groupBy(*(col(c) for c in index)).pivot(by, values)
    if how == "sum":
        out = grouped.agg(F.sum(col(metric)))
        return out.na.fill(0, [c for c in out.columns if c not in index])
    return grouped.agg(F.min(col(metric)))  # a query's result has one value a cell; of several the least


def sorted_pivot(df: DataFrame, index: list[str], by: str, metric: str, config: dict[str, Any]) -> DataFrame:
    """A pivot of one value a cell in its own order, then the limit. Sort columns that the pivot doesn't have are taken
    from df, the least value of an index member, and dropped after sorting."""
    out = pivoted(df, index, by, metric, "first")
    keys = sort_keys(config, [*out.columns, *df.columns])
    extra = [c for c, _ in keys if c not in out.columns]
    if extra:
        names = {c: f"_sort_{i}" for i, c in enumerate(extra)}
        least = df.groupBy(*(col(c).alias(f"_at_{i}") for i, c in enumerate(index))).agg(*(F.min(col(c)).alias(n) for c, n in names.items()))
        same = [col(c).eqNullSafe(F.col(f"_at_{i}")) for i, c in enumerate(index)]
        out = out.join(least, same, "left") if same else out.crossJoin(F.broadcast(least))  # without an index: one row each
        keys = [(names.get(c, c), up) for c, up in keys]
        return _arranged(out, keys, config.get("limit")).drop(*names.values(), *(f"_at_{i}" for i in range(len(index))))
    return _arranged(out, keys, config.get("limit"))


def melted(df: DataFrame, dimensions: list[str], metrics: list[str]) -> DataFrame:
    """A row a metric: the dimensions, series and value."""
    return df.select(*(col(d) for d in dimensions), *(col(m).cast("double").alias(m) for m in metrics)).unpivot([f"`{d}`" for d in dimensions], [f"`{m}`" for m in metrics], "series", "value")


def shares(df: DataFrame, dimension: str, metric: str) -> DataFrame:
    """A member's sum and its share of the total in percent; 0 if the total is 0."""
    sums = df.groupBy(col(dimension)).agg(F.sum(col(metric)).alias(metric))
    total = sums.agg(F.sum(col(metric)).alias("_total"))
    share = F.coalesce(F.try_divide(col(metric).cast("double") * 100, F.col("_total").cast("double")), F.lit(0.0))
    return sums.crossJoin(F.broadcast(total)).withColumn("share", share).drop("_total")


def labelled(df: DataFrame, dimensions: list[str], name: str = "label") -> DataFrame:
    """df with its dimensions joined to one label."""
    return df.withColumn(name, F.concat_ws(" | ", *(col(d).cast("string") for d in dimensions)))


def cleaned_number(column: str):
    """A number out of text such as "$1,200" or "12 %"; NULL if it is none."""
    return F.regexp_replace(col(column).cast("string"), r"[$,%\s]", "").try_cast("double")


def ranked_share(df: DataFrame, metric: str, by: list[str]) -> DataFrame:
    """Each row's share of its group's total."""
    return df.withColumn("share", F.try_divide(col(metric).cast("double"), F.sum(col(metric)).over(Window.partitionBy(*(col(b) for b in by))).cast("double")))


def plot_data(df: DataFrame, config: dict[str, Any]) -> DataFrame:
    """What a plot of this type draws, from its query's result."""
    dims, mets, kind = config["dimensions"], config["metrics"], config["plot_type"]
    if kind == "pivot":
        by = config.get("pivot") or dims[-1]
        by = by[0] if isinstance(by, list) else by
        return sorted_pivot(df, [d for d in dims if d != by], by, mets[0], config)
    df = sorted_and_limited(df.select(*(col(c) for c in [*dims, *mets])), config)
    if kind == "pie":
        return shares(df, dims[0], mets[0])
    if kind == "kpi":
        return df.limit(1)
    if kind in ("bar", "line", "area", "heatmap") and len(dims) == 2 and len(mets) == 1:
        return pivoted(df, [dims[0]], dims[1], mets[0], "first" if kind == "heatmap" else "sum")
    return df


def format_value(value: Any, pattern: str | None = None) -> str:
    """A cell's text: by a format pattern ("{:.1%}" or ".1%"), or numbers with thousands marks and up to two decimals."""
    if value is None or value != value:
        return ""
    if pattern:
        return pattern.format(value) if "{" in pattern else format(value, pattern)
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return str(value)
    return f"{value:,}" if isinstance(value, int) else f"{value:,.2f}"


def row_colour(row: Any, config: dict[str, Any]) -> str | None:
    """The colour of row_colors for a row's value of the column row_color_condition. Where the colours are for True and
    False, a number counts as whether it is above 0."""
    colours, column = config.get("row_colors") or {}, config.get("row_color_condition")
    if column not in row:
        return None
    value = row[column]
    if {"True", "False"} & set(colours) and isinstance(value, numbers.Real):
        value = bool(value > 0)
    return colours.get(str(value))


# --- renderers -------------------------------------------------------------------------------------------------------


class PlotRenderer(ABC):
    @abstractmethod
    def render(self, data: DataFrame, config: dict[str, Any], **options: Any) -> Any: ...


class TableRenderer(PlotRenderer):
    """The plot's data as a pandas frame of at most `rows` rows."""

    def __init__(self, rows: int = 10_000) -> None:
        self.rows = rows

    def render(self, data: DataFrame, config: dict[str, Any], **options: Any) -> Any:
        return plot_data(data, config).limit(self.rows).toPandas()


class TextRenderer(PlotRenderer):
    """Plots as text: a line of # a row and metric, or a table. Handlers can be registered by plot type."""

    def __init__(self, rows: int = 1_000, width: int = 40) -> None:
        self.rows, self.width, self.handlers = rows, width, {}

    def register_plot(self, plot_type: str, handler) -> None:
        self.handlers[plot_type] = handler

    def unregister_plot(self, plot_type: str) -> None:
        self.handlers.pop(plot_type, None)

    def get_plot_handlers(self) -> dict:
        return dict(self.handlers)

    def render(self, data: DataFrame, config: dict[str, Any], **options: Any) -> str:
        rows = plot_data(data, config).limit(self.rows).toPandas()
        if config["plot_type"] in self.handlers:
            return self.handlers[config["plot_type"]](rows, config, **options)
        formats = config.get("formatter") or {}
        numbers = [c for c in rows.columns if c not in config["dimensions"]]
        lines = [config.get("title") or ""]
        if config["plot_type"] in ("bar", "line", "area", "pie", "combo"):
            top = max((abs(float(x)) for c in numbers for x in rows[c] if x is not None and x == x), default=0) or 1
            for _, row in rows.iterrows():
                label = " | ".join(str(row[d]) for d in rows.columns if d in config["dimensions"])
                lines += [f"{label:<24} {c}: {'#' * round(abs(float(row[c])) / top * self.width)} {format_value(row[c], formats.get(c))}" for c in numbers if row[c] is not None and row[c] == row[c]]
        else:
            lines.append("\t".join(map(str, rows.columns)))
            lines += ["\t".join(format_value(v, formats.get(c)) for c, v in row.items()) for _, row in rows.iterrows()]
        return "\n".join(lines)


class HtmlRenderer(PlotRenderer):
    """The plot's data as an HTML table: formatted cells, rows coloured by row_color_condition and row_colors (a column
    of the plot's data), annotations below, row numbers unless hide_index."""

    def __init__(self, rows: int = 1_000) -> None:
        self.rows = rows

    def render(self, data: DataFrame, config: dict[str, Any], **options: Any) -> str:
        rows = plot_data(data, config).limit(self.rows).toPandas()
        formats, numbered = config.get("formatter") or {}, not config.get("hide_index")
        cells = lambda tag, values: "".join(f"<{tag}>{html.escape(str(v))}</{tag}>" for v in values)
        out = [f"<caption>{html.escape(str(config['title']))}</caption>"] if config.get("title") else []
        out.append(f"<tr>{cells('th', [*([''] if numbered else []), *rows.columns])}</tr>")
        for i, (_, row) in enumerate(rows.iterrows()):
            colour = row_colour(row, config)
            style = f' style="background-color: {html.escape(colour)}"' if colour else ""
            out.append(f"<tr{style}>{cells('td', [*([i] if numbered else []), *(format_value(v, formats.get(c)) for c, v in row.items())])}</tr>")
        notes = config.get("annotations") or []
        notes = [notes] if isinstance(notes, (str, dict)) else notes
        below = "".join(f"<p>{html.escape(str(n.get('text', n) if isinstance(n, dict) else n))}</p>" for n in notes)
        return f"<table>{''.join(out)}</table>{below}"


class MatplotlibRenderer(PlotRenderer):
    """Figures with pandas' plotting, where matplotlib is installed."""

    KINDS = {"bar": "bar", "line": "line", "area": "area", "pie": "pie", "combo": "bar", "scatter": "scatter"}

    def __init__(self, rows: int = 10_000) -> None:
        try:
            import matplotlib  # noqa: F401
        except ImportError as e:
            raise ImportError("MatplotlibRenderer needs matplotlib; TextRenderer and TableRenderer don't") from e
        self.rows = rows

    def render(self, data: DataFrame, config: dict[str, Any], **options: Any) -> Any:
        rows = plot_data(data, config).limit(self.rows).toPandas()
        kind = self.KINDS.get(config["plot_type"])
        if kind is None:
            return rows
        index = [c for c in rows.columns if c in config["dimensions"]]
        return rows.set_index(index).plot(kind=kind, stacked=config["stacked"], figsize=config["figsize"], title=config["title"], **({"y": config["metrics"][0]} if kind == "pie" else {}))
