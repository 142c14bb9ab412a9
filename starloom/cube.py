"""The cube: tables linked by the columns they share, filtered in named states, queried by named metrics.

Everything that `query`, `dimensions` and the like return is a lazy Spark DataFrame. Planning may look up facts about
keys, see `Hypercube`.
"""

from __future__ import annotations

import json
import logging
from collections.abc import Callable, Iterable
from functools import reduce
from pathlib import Path
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import plots
from .functions.expressions import columns_in
from .functions.registry import FunctionRegistry, as_registry
from .operators import transformers
from .plans.evaluate import Evaluator, run_query
from .plans.keyspace import KeySpace, col
from .plans.model import LinkModel, is_hub
from .plans.specs import DerivedMetric, Metric, QuerySpec, resolve_needs
from .plans.state import ContextState, as_criteria
from .sources.catalog import Catalog, InMemoryRepository, ModelYAMLSource, Source

DEFAULT, UNFILTERED = "Default", "Unfiltered"
KINDS = ("metrics", "derived_metrics", "queries", "plots", "transformers")


class Hypercube:
    """Tables, filter states and definitions.

    tables: name -> Spark or pandas DataFrame. Columns of one name link tables; two or more of them link through a
    composite bridge. rename_original_shared_columns: keep each table's copy of a shared column as `col <table>`.
    normalized_core: join all tables once and keep the result as a table in the shared folder; the answers are the
    same. statistics: "auto" looks facts about keys up by a job a shared column, when a plan first needs them (or all at
    once in `analyze`); they hold for the data as it then was: after a change call `load_data` or `forget_facts`.
    "declared" uses only what declare_keys and declare_matched say, and runs no job.
    """

    def __init__(
        self, tables: dict[str, DataFrame | pd.DataFrame] | None = None, rename_original_shared_columns: bool = True, normalized_core: bool = False, *,
        apply_composite: bool = True, validate: bool = True, logger: bool | logging.Logger | None = None, function_registry: Any = None,
        spark: SparkSession | None = None, statistics: str = "auto",
    ) -> None:
        self._spark, self.statistics = spark, statistics
        self.set_logger(logger)
        self._functions = as_registry(function_registry)
        self._plot_renderer: plots.PlotRenderer = plots.TextRenderer()
        self._resolver: plots.PlotConfigResolver = plots.DefaultPlotConfigResolver()
        self._catalog: Catalog | None = None
        self._yaml_path: Path | None = None
        self.reset_specs()
        self._functions = as_registry(function_registry)
        self.context_states: dict[str, ContextState] = {}
        if tables is not None:
            self.load_data(tables, rename_original_shared_columns, apply_composite, validate, normalized_core=normalized_core)

    # --- data --------------------------------------------------------------------------------------------------

    @property
    def spark(self) -> SparkSession:
        return self._spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()

    def load_data(self, tables: dict[str, DataFrame | pd.DataFrame], rename_original_shared_columns: bool = True, apply_composite: bool = True, validate: bool = True, reset_specs: bool = False, *, normalized_core: bool = False) -> None:
        """Link these tables in place of those before. Filter states start anew; definitions stay unless reset_specs."""
        frames = {t: df if isinstance(df, DataFrame) else self.spark.createDataFrame(df) for t, df in tables.items()}
        if not frames:
            raise ValueError("A cube needs a table")
        model = LinkModel({t: df.columns for t, df in frames.items()}, rename_shared=rename_original_shared_columns, apply_composite=apply_composite, validate=validate)
        if reset_specs:
            self.reset_specs()
        self.tables, self.model, self.normalized_core = frames, model, normalized_core
        self._options = {"rename_original_shared_columns": rename_original_shared_columns, "apply_composite": apply_composite, "validate": validate}
        self.context_states = {UNFILTERED: ContextState(), DEFAULT: ContextState()}
        self.space = None if model.cyclic else KeySpace(self.spark, model, frames, statistics=self.statistics, stored=normalized_core)
        self.log().info("Loaded %d tables, %d shared columns", len(frames), len(model.hubs))

    def declare_keys(self, table: str, columns: list[str] | str) -> None:
        """Say that these columns are a key of the table: no NULL, none twice."""
        self._ready().declare_keys(table, columns)

    def declare_matched(self, table: str, other: str, column: str) -> None:
        """Say that each row of table has its value of this shared column in other (referential integrity)."""
        self._ready().declare_matched(table, other, column)

    def analyze(self) -> None:
        """Look up all facts about keys now, in one job."""
        self._ready().analyze()

    def forget_facts(self) -> None:
        """Forget what was looked up or declared about keys: to be called when the tables' data changed."""
        self._ready().forget()

    def _ready(self) -> KeySpace:
        if self.space is None:
            raise ValueError("Cyclic relationships: the tables can't be queried")
        return self.space

    @property
    def composite_tables(self) -> dict[str, DataFrame]:
        """The composite bridges: the shared columns and an integer key of their own."""
        types = {t: df.schema for t, df in self.tables.items()}
        out = {}
        for name, c in self.model.composites.items():
            parts = [self.tables[t].select(*(col(x).cast(types[c.participants[0]][x].dataType).alias(x) for x in c.columns)) for t in c.participants]
            rows = reduce(DataFrame.unionByName, parts).distinct()
            out[name] = rows.withColumn(c.key, F.xxhash64(*(col(x) for x in c.columns)))
        return out

    @property
    def link_tables(self) -> dict[str, DataFrame]:
        """The shared columns' values over all tables."""
        return {f"_link_table_{h}": self.dimensions([h], UNFILTERED) for h in self.model.hubs if h in self.model.owner and not h.startswith("_composite_key_")}

    # --- logging -----------------------------------------------------------------------------------------------

    def set_logger(self, logger: bool | logging.Logger | None) -> None:
        if isinstance(logger, logging.Logger):
            self._log = logger
            return
        self._log = logging.getLogger(__name__)
        if logger is True:
            self._log.setLevel(logging.INFO)
            if not self._log.handlers:
                self._log.addHandler(logging.StreamHandler())
        elif logger is False:
            self._log = logging.getLogger(f"{__name__}.off")
            self._log.disabled = True

    def log(self) -> logging.Logger:
        return self._log

    # --- filters -----------------------------------------------------------------------------------------------

    def _state(self, name: str, change: bool = False) -> ContextState:
        if change and name == UNFILTERED:
            raise ValueError(f"The state {UNFILTERED!r} can't be changed; name another")
        if name not in self.context_states:
            raise KeyError(f"Unknown context state {name!r}")
        return self.context_states[name]

    def set_context_state(self, context_state_name: str, base_context_state_name: str = UNFILTERED) -> None:
        """A new state that starts with what holds in the base state and an empty log."""
        if context_state_name == UNFILTERED:
            raise ValueError(f"The state {UNFILTERED!r} can't be changed; name another")
        self.context_states[context_state_name] = self._state(base_context_state_name).copy()

    def filter(self, criteria: dict[str, Any], context_state_name: str = DEFAULT, is_reset: bool = False, save_state: bool = True) -> bool:
        """Narrow a state to rows whose columns have these values (None stands for NULL)."""
        state, wanted = self._state(context_state_name, change=True), as_criteria(criteria)
        unknown = sorted(c for c in wanted if c not in self.model.owner)
        if unknown:
            raise KeyError(f"Unknown columns: {unknown}")
        state.add(wanted, logged=save_state and not is_reset)
        return True

    def remove_filter(self, dimensions: list[str] | str, context_state_name: str = DEFAULT, is_reset: bool = False) -> bool:
        state = self._state(context_state_name, change=True)
        state.remove([dimensions] if isinstance(dimensions, str) else list(dimensions))
        return True

    def reset_filters(self, direction: str = "backward", context_state_name: str = DEFAULT) -> bool:
        """Undo (backward), redo (forward) or clear (all). False if there is nothing to undo or redo."""
        state = self._state(context_state_name, change=True)
        ways = {"backward": state.undo, "forward": state.redo, "all": state.clear}
        if direction not in ways:
            raise ValueError(f"direction must be one of {sorted(ways)}")
        return ways[direction]()

    def get_filters(self, off_set: int = 0, context_state_name: str = DEFAULT) -> dict[str, list]:
        return self._state(context_state_name).active(off_set)

    def get_filtered_dimensions(self, off_set: int = 0, context_state_name: str = DEFAULT) -> list[str]:
        return list(self.get_filters(off_set, context_state_name))

    def _predicates(self, metric: Metric | None, state: str = DEFAULT, filters: dict[str, Any] | None = None) -> list[tuple[str, list]]:
        if metric is None:
            return [*self._state(state).all_predicates, *as_criteria(filters).items()]
        own = metric.metric_filters or {}
        if metric.ignore_context_filters is True:
            return list(own.items())
        if metric.ignore_context_filters:
            kept = {c: v for c, v in self.get_filters(0, metric.context_state_name).items() if c not in metric.ignore_context_filters}
            return list((kept | own).items())
        return [*self._state(metric.context_state_name).all_predicates, *own.items()]

    # --- dimensions --------------------------------------------------------------------------------------------

    def dimensions(self, dimensions: list[str], context_state_name: str = DEFAULT, query_filters: dict[str, Any] | None = None) -> DataFrame:
        """The distinct combinations that a state has, NULL members included."""
        evaluator = Evaluator(self._ready(), self._functions, self._predicates)
        return evaluator.members(list(dimensions), self._predicates(None, context_state_name, query_filters))

    def dimension(self, dimension: str, context_state_name: str = DEFAULT, query_filters: dict[str, Any] | None = None) -> DataFrame:
        return self.dimensions([dimension], context_state_name, query_filters)

    def get_dimensions(self) -> list[str]:
        return self.model.dimensions()

    # --- definitions -------------------------------------------------------------------------------------------

    def reset_specs(self) -> None:
        self.metrics: dict[str, Metric] = {}
        self.derived_metrics: dict[str, DerivedMetric] = {}
        self.queries: dict[str, QuerySpec] = {}
        self.transformations: dict[str, dict[str, dict[str, Any]]] = {}
        self.transformers = transformers.built_in()
        self.plot_configs: dict[str, dict[str, dict[str, Any]]] = {}
        self.default_plots: dict[str, str] = {}
        self._functions = FunctionRegistry()

    @property
    def function_registry(self) -> FunctionRegistry:
        return self._functions

    @function_registry.setter
    def function_registry(self, value: Any) -> None:
        self._functions = as_registry(value)

    def add_functions(self, **functions: Any) -> None:
        """Functions, modules and values for @name in expressions."""
        self._functions.update(functions)

    def define_metric(
        self, name: str | None = None, expression: str | None = None, aggregation: Any = None, metric_filters: dict[str, Any] | None = None,
        row_condition_expression: str | None = None, context_state_name: str = DEFAULT, ignore_dimensions: bool | list[str] = False,
        ignore_context_filters: bool | list[str] = False, fillna: Any = None, nested: dict[str, Any] | None = None,
    ) -> None:
        if not name or not expression:
            raise ValueError("A metric needs a name and an expression")
        metric = Metric(name, expression, aggregation, metric_filters, row_condition_expression, context_state_name, ignore_dimensions, ignore_context_filters, fillna, nested)
        unknown = [c for c in metric.columns if self.context_states and c not in self.model.owner]
        if unknown:
            self.log().warning("Metric %s: columns %s are in no table", name, unknown)
        self.metrics[name] = metric

    def define_derived_metric(self, name: str, expression: str, fillna: Any = None) -> None:
        self.derived_metrics[name] = DerivedMetric(name, expression, fillna)

    def define_query(self, name: str, dimensions: Iterable[str] = (), metrics: list[str] = (), derived_metrics: list[str] = (), having: str | None = None, sort: list = (), drop_null_dimensions: bool = False, drop_null_metric_results: bool = False) -> None:
        if not name:
            raise ValueError("A query needs a name")
        query = QuerySpec(list(dimensions), list(metrics), list(derived_metrics), having, list(sort), drop_null_dimensions, drop_null_metric_results)
        self._needs(query, name)
        self.queries[name] = query

    def _needs(self, query: QuerySpec, name: str | None):
        """What the query depends on, by the definitions as they are now; those may also come later."""
        extra = {p["new_column"] for p in self.transformations.get(name or "", {}).values() if p.get("new_column")}
        return resolve_needs(query, self.metrics, self.derived_metrics, {*query.dimensions}, extra)

    def get_metrics(self) -> dict[str, dict[str, Any]]:
        return {n: m.spec() for n, m in self.metrics.items()}

    def get_metric(self, metric: str) -> dict[str, Any] | None:
        return self.get_metrics().get(metric)

    def get_derived_metrics(self) -> dict[str, dict[str, Any]]:
        return {n: m.spec() for n, m in self.derived_metrics.items()}

    def get_derived_metric(self, derived_metric: str) -> dict[str, Any] | None:
        return self.get_derived_metrics().get(derived_metric)

    def get_queries(self) -> dict[str, dict[str, Any]]:
        return {n: q.spec() for n, q in self.queries.items()}

    def get_query(self, query: str) -> dict[str, Any] | None:
        return self.get_queries().get(query)

    def delete_query(self, name: str) -> None:
        for held in (self.queries, self.transformations, self.plot_configs, self.default_plots):
            held.pop(name, None)

    def delete_metric(self, name: str) -> None:
        self.metrics.pop(name, None)

    def delete_derived_metric(self, name: str) -> None:
        self.derived_metrics.pop(name, None)

    def debug_dependencies(self) -> dict[str, Any]:
        """By query: the base metrics and derived metrics it computes, and its plots."""
        out = {}
        for name, query in self.queries.items():
            needs = self._needs(query, name)
            out[name] = {"metrics": needs.metrics, "derived_metrics": needs.derived, "plots": self.list_plots(name)}
        return out

    def debug_missing_dependencies(self) -> dict[str, list[str]]:
        missing = {name: self._needs(query, name).missing for name, query in self.queries.items()}
        return {name: m for name, m in missing.items() if m}

    # --- queries -----------------------------------------------------------------------------------------------

    def query(self, query_name: str | None = None, options: dict[str, Any] | None = None) -> DataFrame:
        """A defined query's result, with options in place of parts of its definition; without a name, options are the
        whole definition. Nothing is stored."""
        if options is None:
            if query_name not in self.queries:
                raise ValueError(f"Unknown query {query_name!r}")
            query = self.queries[query_name]
        else:
            base = self.queries[query_name].spec() if query_name in self.queries else {}
            query = QuerySpec(**(base | {k: v for k, v in options.items() if v is not None}))
        needs = self._needs(query, query_name)
        if needs.missing:
            raise ValueError(f"Unknown metrics or columns: {needs.missing}")
        evaluator = Evaluator(self._ready(), self._functions, self._predicates)
        steps = [self._step(t, p) for t, p in self.transformations.get(query_name or "", {}).items()]
        return run_query(evaluator, query, [self.metrics[m] for m in needs.metrics], [self.derived_metrics[d] for d in needs.derived], steps)

    def _step(self, name: str, params: dict[str, Any]) -> Callable[[DataFrame], DataFrame]:
        """A transformer that fails while the plan is made is passed over with a warning."""

        def step(df: DataFrame) -> DataFrame:
            try:
                return self.transform(df, name, params)
            except Exception as e:
                self.log().warning("Transformer %s left out: %s", name, e)
                return df

        return step

    # --- transformers ------------------------------------------------------------------------------------------

    def register_transformer(self, name: str, transformer: transformers.Transformer | Callable) -> None:
        if not isinstance(transformer, transformers.Transformer) and not callable(transformer):
            raise TypeError("A transformer is a Transformer or a function of a DataFrame")
        self.transformers[name] = transformer

    def define_transformation(self, query_name: str, transformer: str, params: dict[str, Any] | None = None) -> None:
        if query_name not in self.queries:
            raise ValueError(f"Unknown query {query_name!r}")
        if transformer not in self.transformers:
            raise ValueError(f"Unknown transformer {transformer!r}: use register_transformer")
        self.transformations.setdefault(query_name, {})[transformer] = dict(params or {})

    def list_transformations(self, query_name: str) -> list[str]:
        return list(self.transformations.get(query_name, {}))

    def get_transformation_config(self, query_name: str, transformer: str | None = None) -> dict[str, Any]:
        found = self.transformations.get(query_name, {})
        return dict(found) if transformer is None else dict(found.get(transformer, {}))

    def delete_transformation(self, query_name: str, transformer: str) -> None:
        self.transformations.get(query_name, {}).pop(transformer, None)

    def transform(self, df: DataFrame, transformer: str | None = None, params: dict[str, Any] | None = None, *, overwrite: bool = False, **overrides: Any) -> DataFrame:
        if not transformer:
            raise ValueError("'transformer' is required")
        if transformer not in self.transformers:
            raise ValueError(f"Unknown transformer {transformer!r}: use register_transformer")
        return transformers.apply(df, self.transformers[transformer], {**(params or {}), **overrides}, overwrite)

    # --- the model ---------------------------------------------------------------------------------------------

    def get_relationship_matrix(self, context_state_name: str = UNFILTERED, core: bool = False) -> DataFrame:
        """The distinct combinations of all shared columns; core: the row ids of all tables, joined."""
        space, predicates = self._ready(), self._predicates(None, context_state_name)
        if core:
            return space.frame(set(), set(self.model.tables), predicates)
        shared = {h for h in self.model.hubs if not h.startswith("_composite_key_")} | {c for b in self.model.composites.values() for c in b.columns}
        return self.dimensions(sorted(shared), context_state_name)

    def get_cardinalities(self, context_state_name: str = UNFILTERED, include_inverse: bool = False) -> DataFrame:
        """By shared column and pair of tables: how many rows a common key has at most on each side, and what that
        makes the relationship. Counts are over the state's rows; NULL keys are left out."""
        parts = []
        for h, hub in self.model.hubs.items():
            tables = [t for t in hub.source]
            for i, a in enumerate(tables):
                parts += [self._cardinality(h, a, b, context_state_name) for b in tables[i + 1 :]]
        if not parts:
            return self.spark.createDataFrame([], "table1 string, table2 string, shared_column string, cardinality string, keys_in_t1 long, keys_in_t2 long, keys_in_both long, max_rows_per_key_t1 long, max_rows_per_key_t2 long")
        out = reduce(DataFrame.unionByName, parts)
        if not include_inverse:
            return out
        swap = {"table1": "table2", "keys_in_t1": "keys_in_t2", "max_rows_per_key_t1": "max_rows_per_key_t2"}
        swap |= {b: a for a, b in swap.items()}
        other = F.when(col("cardinality") == "one-to-many", "many-to-one").when(col("cardinality") == "many-to-one", "one-to-many").otherwise(col("cardinality"))
        return out.unionByName(out.withColumn("cardinality", other).select(*(col(c).alias(swap.get(c, c)) for c in out.columns)))

    def _key_counts(self, hub: str, table: str, state: str) -> DataFrame:
        space, predicates = self._ready(), self._predicates(None, state)
        source = self.model.hubs[hub].source[table]
        if predicates and hub in self.model.owner and not hub.startswith("_composite_key_"):
            rows = space.frame({hub}, {table}, predicates).where(col(f"_index_{table}").isNotNull() & col(hub).isNotNull()).distinct()
            return rows.groupBy(F.struct(col(hub)).alias("k")).agg(F.count(F.lit(1)).alias("n"))
        rows = space.rows(table).where(reduce(lambda x, y: x & y, (col(c).isNotNull() for c in source)))
        return rows.groupBy(space.key(table, hub).alias("k")).agg(F.count(F.lit(1)).alias("n"))

    def _cardinality(self, hub: str, a: str, b: str, state: str) -> DataFrame:
        both = self._key_counts(hub, a, state).withColumnRenamed("n", "n1").join(self._key_counts(hub, b, state).withColumnRenamed("n", "n2"), "k", "full")
        common = F.col("n1").isNotNull() & F.col("n2").isNotNull()
        most = lambda c: F.coalesce(F.max(F.when(common, F.col(c))), F.lit(0)).alias(f"max_rows_per_key_t{c[1]}")
        found = both.agg(F.count("n1").alias("keys_in_t1"), F.count("n2").alias("keys_in_t2"), F.count_if(common).alias("keys_in_both"), most("n1"), most("n2"))
        m1, m2 = F.col("max_rows_per_key_t1"), F.col("max_rows_per_key_t2")
        kind = F.when(F.col("keys_in_both") == 0, "no relationship").when((m1 == 1) & (m2 == 1), "one-to-one").when(m1 == 1, "one-to-many").when(m2 == 1, "many-to-one").otherwise("many-to-many")
        shown = lambda t: F.lit("Composite Table" if t in self.model.composites else t)
        return found.select(shown(a).alias("table1"), shown(b).alias("table2"), F.lit(hub).alias("shared_column"), kind.alias("cardinality"), "keys_in_t1", "keys_in_t2", "keys_in_both", "max_rows_per_key_t1", "max_rows_per_key_t2")

    def visualize_graph(self, format: str = "mermaid") -> str:
        """The link graph as Mermaid or DOT text."""
        ids = {n: f"n{i}" for i, n in enumerate([*self.model.tables, *self.model.hubs])}
        edges = [(ids[t], ids[h.name]) for h in self.model.hubs.values() for t in h.source]
        if format == "dot":
            nodes = [f'  {i} [label="{n}", shape={"ellipse" if n in self.model.hubs else "box"}];' for n, i in ids.items()]
            return "\n".join(["graph cube {", *nodes, *(f"  {a} -- {b};" for a, b in edges), "}"])
        nodes = [f'  {i}(("{n}"))' if n in self.model.hubs else f'  {i}["{n}"]' for n, i in ids.items()]
        return "\n".join(["graph LR", *nodes, *(f"  {a} --- {b}" for a, b in edges)])

    def tables_of(self, columns: list[str]) -> list[str]:
        """The tables on the way between these columns' tables."""
        return sorted(n for n in self.model.subtree({self.model.owner[c] for c in columns}) if not is_hub(n))

    # --- plots -------------------------------------------------------------------------------------------------

    def define_plot(self, query_name: str, plot_name: str | None = None, set_as_default: bool = True, **config: Any) -> None:
        if query_name not in self.queries:
            raise ValueError(f"Unknown query {query_name!r}")
        unknown = set(config) - set(plots.DEFAULTS)
        if unknown:
            raise TypeError(f"Unknown plot options: {sorted(unknown)}")
        chosen = config.get("plot_type") or self._resolver.resolve(config, self.queries[query_name].spec())["plot_type"]
        name = plot_name or f"{chosen} plot"
        held = self.plot_configs.setdefault(query_name, {})
        held[name] = plots.DEFAULTS | config | {"plot_type": chosen}
        if set_as_default or len(held) == 1:
            self.default_plots[query_name] = name

    def get_plots(self, query_name: str) -> dict[str, dict[str, Any]]:
        return {n: self.get_plot_config(query_name, n) for n in self.plot_configs.get(query_name, {})}

    def get_plot_config(self, query_name: str, plot_name: str | None = None) -> dict[str, Any]:
        """A plot's configuration; dimensions and metrics that it doesn't name are its query's, as that is now."""
        name = plot_name or self.default_plots.get(query_name)
        if name not in self.plot_configs.get(query_name, {}):
            raise ValueError(f"Query {query_name!r} has no plot {name!r}")
        config, query = self.plot_configs[query_name][name], self.queries[query_name]
        return config | {"dimensions": config["dimensions"] or query.dimensions, "metrics": config["metrics"] or [*query.metrics, *query.derived_metrics], "title": config["title"] or query_name}

    def set_default_plot(self, query_name: str, plot_name: str) -> None:
        if plot_name not in self.plot_configs.get(query_name, {}):
            raise ValueError(f"Query {query_name!r} has no plot {plot_name!r}")
        self.default_plots[query_name] = plot_name

    def get_default_plot(self, query_name: str) -> str | None:
        return self.default_plots.get(query_name)

    def list_plots(self, query_name: str) -> list[str]:
        return list(self.plot_configs.get(query_name, {}))

    def delete_plot(self, query_name: str, plot_name: str) -> None:
        held = self.plot_configs.get(query_name, {})
        held.pop(plot_name, None)
        if self.default_plots.get(query_name) == plot_name:
            self.default_plots.pop(query_name)
            if held:
                self.default_plots[query_name] = next(iter(held))

    def suggest_plot_types(self, query_name: str) -> list[dict[str, Any]]:
        query = self.queries[query_name]
        return self._resolver.suggest(len(query.dimensions), len(query.metrics) + len(query.derived_metrics))

    def set_plot_renderer(self, renderer: plots.PlotRenderer) -> None:
        self._plot_renderer = renderer

    def set_config_resolver(self, resolver: plots.PlotConfigResolver) -> None:
        self._resolver = resolver

    def plot(self, query_name: str | None = None, query_options: dict[str, Any] | None = None, plot_name: str | list[str] | None = None, plot_type: str | None = None, renderer: plots.PlotRenderer | None = None, **overrides: Any) -> Any:
        """Render one plot of a query, or several from one result; a query without plots gets the first suggestion."""
        data, chosen = self.query(query_name, query_options), renderer or self._plot_renderer
        if isinstance(plot_name, list):
            data = data.persist()
            try:
                return [chosen.render(data, self._plot_config(query_name, query_options, n, plot_type, overrides)) for n in plot_name]
            finally:
                data.unpersist()
        return chosen.render(data, self._plot_config(query_name, query_options, plot_name, plot_type, overrides))

    def _plot_config(self, query_name: str | None, options: dict[str, Any] | None, plot_name: str | None, plot_type: str | None, overrides: dict[str, Any]) -> dict[str, Any]:
        if options is None and (plot_name or self.default_plots.get(query_name or "")):
            config = self.get_plot_config(query_name, plot_name)
        else:
            query = QuerySpec(**((self.queries[query_name].spec() if query_name in self.queries else {}) | (options or {})))
            config = plots.DEFAULTS | {"dimensions": query.dimensions, "metrics": [*query.metrics, *query.derived_metrics], "title": query_name}
        config = config | overrides | ({"plot_type": plot_type} if plot_type else {})
        return self._resolver.resolve(config)

    # --- catalogs ----------------------------------------------------------------------------------------------

    def set_yaml_model_catalog(self, path: str | Path | None = None, use_current_directory: bool = True, create_if_missing: bool = True, default_yaml_name: str | None = None, prefer_nested_plots: bool = True, prefer_nested_transformers: bool = True) -> Path:
        found = Path(path) if path else Path.cwd() / (default_yaml_name or "model_catalog.yml") if use_current_directory else None
        if found is None:
            raise ValueError("Name a path, or let the current directory be used")
        if not found.exists():
            if not create_if_missing:
                raise FileNotFoundError(found)
            found.parent.mkdir(parents=True, exist_ok=True)
            found.write_text("", encoding="utf-8")
        self._yaml_path = found
        self.set_model_catalog([ModelYAMLSource(found, prefer_nested_plots, prefer_nested_transformers)])
        return found

    def get_yaml_path_model_catalog(self) -> Path | None:
        return self._yaml_path

    def set_model_catalog(self, sources: Iterable[Source], repo: InMemoryRepository | None = None) -> None:
        self._catalog = Catalog(sources, repo)

    @property
    def model_catalog(self) -> Catalog:
        if self._catalog is None:
            raise ValueError("No model catalog: use set_yaml_model_catalog or set_model_catalog")
        return self._catalog

    def load_from_model_catalog(self, kinds: Iterable[str] | None = None, reset_specs: bool = False, clear_repo: bool = False, reload_sources: bool = True) -> None:
        """Define what the catalog holds: metrics, derived metrics, queries, plots, transformers, in this order."""
        wanted = list(kinds) if kinds is not None else None
        self.model_catalog.refresh(wanted, clear_repo, reload_sources)
        if reset_specs:
            self.reset_specs()
        self.apply_specs({k: self.model_catalog.repo.get_all().get(k, {}) for k in KINDS if wanted is None or k in wanted})

    def save_to_model_catalog(self) -> Path | None:
        """Save all definitions to the catalog's sources; functions without a name, such as lambdas, are left out."""
        self.model_catalog.save(self.specs())
        return self._yaml_path

    def specs(self) -> dict[str, dict[str, dict[str, Any]]]:
        """All definitions as plain data. Callables can't be written and are left out."""
        out: dict[str, dict[str, dict[str, Any]]] = {k: {} for k in KINDS}
        for name, m in self.metrics.items():
            spec = {k: v for k, v in m.spec().items() if v is not None and v is not False and not callable(v) and not (k == "context_state_name" and v == DEFAULT)}
            if "nested" in spec:
                spec["nested"] = {k: v for k, v in spec["nested"].items() if v is not None and not callable(v)}
            out["metrics"][name] = spec
        for name, d in self.derived_metrics.items():
            out["derived_metrics"][name] = {k: v for k, v in d.spec().items() if v is not None}
        for name, q in self.queries.items():
            out["queries"][name] = {k: v for k, v in q.spec().items() if v}
            for plot, config in self.plot_configs.get(name, {}).items():
                changed = {k: v for k, v in config.items() if v != plots.DEFAULTS[k] and not callable(v)}
                out["plots"][f"{name}:{plot}"] = {**changed, "query": name, "name": plot, "default": self.default_plots.get(name) == plot}
            for transformer, params in self.transformations.get(name, {}).items():
                out["transformers"][f"{name}:{transformer}"] = {"params": params, "query": name, "name": transformer}
        return out

    def apply_specs(self, specs: dict[str, dict[str, dict[str, Any]]]) -> None:
        plain = lambda spec, *less: {k: v for k, v in spec.items() if k not in ("kind", "name", *less)}
        for name, spec in specs.get("metrics", {}).items():
            self.define_metric(name, **plain(spec))
        for name, spec in specs.get("derived_metrics", {}).items():
            self.define_derived_metric(name, **plain(spec))
        for name, spec in specs.get("queries", {}).items():
            self.define_query(name, **plain(spec))
        for key, spec in specs.get("plots", {}).items():
            if not spec.get("query"):
                raise ValueError(f"Plot {key!r} names no query")
            config = plain(spec, "query", "default")
            config["plot_type"] = config.pop("type", None) or config.get("plot_type")
            self.define_plot(spec["query"], spec.get("name", key), set_as_default=spec.get("default", False), **config)
        for key, spec in specs.get("transformers", {}).items():
            if not spec.get("query"):
                raise ValueError(f"Transformer {key!r} names no query")
            self.define_transformation(spec["query"], spec.get("name", key), spec.get("params"))

    # --- snapshots ---------------------------------------------------------------------------------------------

    def save(self, path: str) -> None:
        """Write tables (Parquet) and definitions (one JSON line of text) under path, any folder that Spark can write.

        Functions are kept by what imports them; lambdas and the like are left out. Filter states are kept with their
        logs; filter values must be plain data, dates or timestamps.
        """
        for name, df in self.tables.items():
            df.write.mode("overwrite").parquet(f"{path}/tables/{name}")
        about = {"tables": list(self.tables), "options": self._options, "normalized_core": self.normalized_core, "specs": self.specs(), "functions": self._functions.specs()}
        about["states"] = {n: s.spec() for n, s in self.context_states.items()}
        self.spark.createDataFrame([(json.dumps(about, default=str),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/cube")

    @classmethod
    def load(cls, path: str, spark: SparkSession | None = None) -> Hypercube:
        """The cube that save wrote."""
        session = spark or SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()
        about = json.loads(session.read.text(f"{path}/cube").first()["value"])
        tables = {t: session.read.parquet(f"{path}/tables/{t}") for t in about["tables"]}
        cube = cls(spark=session, function_registry=FunctionRegistry.from_specs(about["functions"]))
        cube.load_data(tables, **about["options"], normalized_core=about["normalized_core"])
        cube.apply_specs(about["specs"])
        cube.context_states |= {n: ContextState.from_spec(s) for n, s in about.get("states", {}).items()}
        return cube

    def columns_of(self, *expressions: str) -> list[str]:
        """The columns that expressions name."""
        return columns_in(*expressions)
