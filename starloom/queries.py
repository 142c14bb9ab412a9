"""Named queries over the benchmark tables, one or more of each operator family, and the same in SQL.

The tables are renamed on load so that columns to be linked share a name. Floating results are rounded, as engines add
in different orders.
"""

from __future__ import annotations

import math
import os
from collections.abc import Callable, Iterable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import plots
from .cube import Hypercube
from .sources.readers import with_names

#: Old name -> shared name, by table: fixed values.
LINKS = {
    "region": {"r_regionkey": "regionkey"},
    "nation": {"n_nationkey": "nationkey", "n_regionkey": "regionkey"},
    "customer": {"c_custkey": "custkey", "c_nationkey": "nationkey"},
    "orders": {"o_orderkey": "orderkey", "o_custkey": "custkey"},
    "lineitem": {"l_orderkey": "orderkey", "l_partkey": "partkey", "l_suppkey": "suppkey"},
    "part": {"p_partkey": "partkey"},
    "supplier": {"s_suppkey": "suppkey"},
    "events": {"user_id": "custkey"},
    "documents": {},
    "labels": {},
}
SALES = ["region", "nation", "customer", "orders", "lineitem", "part", "supplier"]
KINDS = {"sales": SALES, "events": ["region", "nation", "customer", "orders", "events"], "stock": ["part", "supplier", "lineitem"], "docs": ["documents", "labels"]}
REVENUE = "[l_extendedprice] * (1 - [l_discount])"

_cubes: dict[tuple, Hypercube] = {}


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return with_names(spark.read.parquet(f"{sf_dir}/{name}.parquet"), LINKS[name])


def forget_cubes() -> None:
    """Let the next queries make their cubes, and look up facts about keys, anew."""
    _cubes.clear()


def _listing(spark: SparkSession, sf_dir: str, tables: Iterable[str]) -> tuple:
    """What tells one state of the tables' files from another: their names and, where they are local, sizes and times."""
    out = []
    for path in (f"{sf_dir}/{table}.parquet".removeprefix("file://") for table in tables):
        if os.path.exists(path):
            files = [path] if os.path.isfile(path) else sorted(os.path.join(at, f) for at, _, names in os.walk(path) for f in names)
            out += [(f, os.stat(f).st_size, os.stat(f).st_mtime_ns) for f in files]
        else:
            out += sorted(spark.read.parquet(path).inputFiles())
    return tuple(out)


def cube_of(spark: SparkSession, sf_dir: str, kind: str = "sales") -> Hypercube:
    """The cube of a kind. It holds no data but what it found out about keys, and is kept per application as long as
    its tables have the same files."""
    at = (spark.sparkContext.applicationId, sf_dir, kind, _listing(spark, sf_dir, KINDS[kind]))
    if at not in _cubes:
        read = lambda *names: {n: _table(spark, sf_dir, n) for n in names}
        if kind == "sales":
            tables = read(*KINDS[kind])
        elif kind == "events":
            tables = read(*KINDS[kind])
        elif kind == "stock":
            lines = _table(spark, sf_dir, "lineitem")
            stock = lines.where("l_linenumber <= 3").groupBy("partkey", "suppkey").agg(F.count(F.lit(1)).alias("avail"))
            tables = read("part", "supplier") | {"lineitem": lines.select("partkey", "suppkey", "l_returnflag", "l_quantity"), "stock": stock}
        else:
            tables = {"documents": _table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars"), "labels": _table(spark, sf_dir, "labels")}
        cube = _cubes[at] = Hypercube(tables, spark=spark)
        _define(cube, kind)
        cube.analyze()
    return _cubes[at]


def percentile_90(values: pd.Series, counts: pd.Series) -> float:
    """As values.quantile(0.9), each value as often as its count."""
    if not len(values):
        return float("nan")
    by = np.argsort(values.to_numpy(), kind="stable")
    upto, at = np.cumsum(counts.to_numpy()[by]), 0.9 * (int(counts.sum()) - 1)
    low, high = (float(values.iloc[by[np.searchsorted(upto, place, side="right")]]) for place in (math.floor(at), math.ceil(at)))
    return low + (high - low) * (at - math.floor(at))


percentile_90.weighted = True


def doubled(values: pd.Series) -> pd.Series:
    return values * 2


doubled.return_type = "double"


def nearly_all(values: pd.Series, least: float) -> pd.Series:
    return values >= least


nearly_all.return_type = "boolean"


def in_brackets(row: dict) -> str:
    return f"[{row['n_name']}={row['value']}]"


def _define(cube: Hypercube, kind: str) -> None:
    cube.add_functions(doubled=doubled, p90=percentile_90, nearly_all=nearly_all)
    if kind == "sales":
        cube.define_metric("revenue", REVENUE, "sum")
        cube.define_metric("quantity", "[l_quantity]", "sum")
        cube.define_metric("lines", "[l_linenumber]", "count")
        cube.define_metric("order_total", "[o_totalprice]", "sum")
        cube.define_metric("orders", "[o_totalprice]", "count")
        cube.define_metric("customers", "[c_name]", "nunique")
        for how in ("mean", "min", "max", "median", "std", "var", "sem", "skew"):
            cube.define_metric(f"quantity_{how}", "[l_quantity]", how)
        cube.define_metric("large_lines", "[l_quantity]", "count", row_condition_expression="[l_quantity] > 45 and [l_returnflag] != 'N'")
        cube.define_metric("urgent_total", "[o_totalprice]", "sum", metric_filters={"o_orderpriority": ["1-URGENT"]})
        cube.define_metric("revenue_all", REVENUE, "sum", ignore_dimensions=True)
        cube.define_metric("revenue_region", REVENUE, "sum", ignore_dimensions=["c_mktsegment"])
        cube.define_metric("quantity_everywhere", "[l_quantity]", "sum", context_state_name="building", ignore_context_filters=True)
        cube.define_metric("quantity_building", "[l_quantity]", "sum", context_state_name="building")
        cube.define_metric("quantity_other", "[l_quantity]", "sum", context_state_name="automobile")
        cube.define_metric("quantity_segments", "[l_quantity]", "sum", context_state_name="building_asia", ignore_context_filters=["c_mktsegment"])
        cube.define_metric("mean_customer_total", "[o_totalprice]", "mean", nested={"dimensions": ["c_name"], "aggregation": "sum"})
        cube.define_metric("nations", "[c_acctbal]", "concat", nested={"dimensions": ["n_name"], "aggregation": "count", "compose": "{n_name}: {value}"})
        cube.define_metric("filled", "[l_quantity]", "mean", fillna=0)
        cube.define_metric("doubled_quantity", "@doubled([l_quantity])", "sum")
        cube.define_metric("p90_quantity", "[l_quantity]", "p90")
        cube.define_metric("last_year", "[o_orderdate].dt.year", "max")
        cube.define_metric("long_names", "[p_name].str.len() > 20", "sum")
        cube.define_metric("brands", "[p_brand].str.upper()", "nunique")
        cube.define_metric("discounted", "@np.where([l_discount] >= 0.05, [l_quantity], 0)", "sum")
        cube.define_metric("any_returned", "[l_returnflag] == 'R'", "any")
        cube.define_metric("all_small", "[l_quantity] <= 50", "all")
        cube.define_metric("unit_price", "[l_extendedprice] / [l_quantity]", "mean")
        cube.define_metric("rows", "[l_quantity]", "size")
        cube.define_metric("first_line", "[l_linenumber]", "first", nested={"dimensions": ["l_linenumber"], "aggregation": "min"})
        cube.define_metric("last_line", "[l_linenumber]", "last", nested={"dimensions": ["l_linenumber"], "aggregation": "min"})
        cube.define_metric("name_product", "[r_name].str.len()", "prod")
        cube.define_metric("bracketed", "[c_acctbal]", "concat", nested={"dimensions": ["n_name"], "aggregation": "count", "compose": in_brackets})
        cube.define_metric("unknown_segments", "[l_quantity]", "sum", metric_filters={"c_mktsegment": ["BUILDING", None]})
        cube.define_derived_metric("urgent_share", "[urgent_total] / [order_total]", fillna=0)
        cube.define_derived_metric("place", "[quantity].rank(ascending=False, method='min')")
        cube.define_derived_metric("upto", "[quantity].cumsum()")
        cube.define_derived_metric("change", "[quantity].diff()")
        cube.define_derived_metric("before", "[quantity].shift(1)")
        cube.define_derived_metric("mean_line", "[revenue] / [lines]")
        cube.define_derived_metric("share", "[revenue] / [revenue_all] * 100")
        cube.define_derived_metric("of_total", "[quantity] / [quantity].sum() * 100")
        for name, dims, metrics in (("ma_by_brand", ["p_brand"], ["quantity"]), ("z_by_brand", ["p_brand"], ["quantity"]), ("rank_by_type", ["p_type"], ["quantity"]), ("cumulative_by_size", ["p_size"], ["quantity"])):
            cube.define_query(name, dims, metrics, drop_null_dimensions=True)
        cube.define_transformation("ma_by_brand", "moving_average", {"on": "quantity", "window": 3, "sort_by": ["p_brand"], "new_column": "ma", "min_periods": 1})
        cube.define_transformation("z_by_brand", "zscore", {"on": "quantity", "new_column": "z"})
        cube.define_transformation("rank_by_type", "rank", {"on": "quantity", "new_column": "place"})
        cube.define_transformation("cumulative_by_size", "cumulative", {"on": "quantity", "sort_by": ["p_size"], "new_column": "upto"})
        for state, filters in (("building", {"c_mktsegment": ["BUILDING"]}), ("automobile", {"c_mktsegment": ["AUTOMOBILE"]}), ("building_asia", {"c_mktsegment": ["BUILDING"], "r_name": ["ASIA"]})):
            cube.set_context_state(state)
            cube.filter(filters, state)
        cube.set_context_state("undone")
        cube.filter({"c_mktsegment": ["BUILDING"]}, "undone")
        cube.filter({"r_name": ["ASIA", "EUROPE"]}, "undone")
        cube.reset_filters("backward", "undone")
        cube.reset_filters("forward", "undone")
        cube.remove_filter(["c_mktsegment"], "undone")
        cube.define_metric("undone_quantity", "[l_quantity]", "sum", context_state_name="undone")
    elif kind == "events":
        cube.define_metric("order_total", "[o_totalprice]", "sum")
        cube.define_metric("event_value", "[value]", "sum")
        cube.define_metric("buyers", "[custkey]", "count")
    elif kind == "stock":
        cube.define_metric("available", "[avail]", "sum")
        cube.define_metric("sold", "[l_quantity]", "sum")
    else:
        cube.define_metric("docs", "[n_chars]", "count")
        cube.define_metric("chars", "[n_chars]", "sum")
        cube.define_metric("languages", "[lang]", "concat", nested={"dimensions": ["lang"], "aggregation": "max"})


def rounded(df: DataFrame, digits: int = 2, **others: int) -> DataFrame:
    """others: columns with digits of their own."""
    return df.select(*(F.round(f.name, others.get(f.name, digits)).alias(f.name) if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in df.schema.fields))


def _query(kind: str = "sales", name: str | None = None, digits: int = 2, others: dict[str, int] | None = None, **options) -> Callable[[SparkSession, str], DataFrame]:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return rounded(cube_of(spark, sf_dir, kind).query(name, options or None), digits, **(others or {}))

    return run


def _brand_returns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pivoted plot data: brands by return flags."""
    result = cube_of(spark, sf_dir).query(options={"dimensions": ["p_brand", "l_returnflag"], "metrics": ["quantity"], "drop_null_dimensions": True})
    return plots.pivoted(result, ["p_brand"], "l_returnflag", "quantity", values=["A", "N", "R"])


def _segment_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = cube_of(spark, sf_dir).query(options={"dimensions": ["c_mktsegment"], "metrics": ["quantity"], "drop_null_dimensions": True})
    return rounded(plots.shares(result, "c_mktsegment", "quantity"), 4)


def _top_customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = cube_of(spark, sf_dir).query(options={"dimensions": ["c_name"], "metrics": ["order_total"], "drop_null_dimensions": True})
    config = plots.DEFAULTS | {"plot_type": "table", "dimensions": ["c_name"], "metrics": ["order_total"], "sort_values": True, "sort_ascending": False, "limit": 10}
    return rounded(plots.plot_data(result, config))


def _melted(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = cube_of(spark, sf_dir).query(options={"dimensions": ["r_name"], "metrics": ["quantity", "lines"]})
    return rounded(plots.melted(result, ["r_name"], ["quantity", "lines"]))


def _first_pivot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last ten brands, the last one first, by return flags."""
    result = cube_of(spark, sf_dir).query(options={"dimensions": ["p_brand", "l_returnflag"], "metrics": ["lines"], "drop_null_dimensions": True})
    config = plots.DEFAULTS | {"plot_type": "pivot", "dimensions": ["p_brand"], "metrics": ["lines"], "pivot": "l_returnflag", "sort_by": ["p_brand"], "sort_ascending": False, "limit": 10}
    return plots.plot_data(result, config)


def _kpi(spark: SparkSession, sf_dir: str) -> DataFrame:
    result = cube_of(spark, sf_dir).query(options={"metrics": ["revenue"]})
    return rounded(plots.plot_data(result, plots.DEFAULTS | {"plot_type": "kpi", "dimensions": [], "metrics": ["revenue"]}))


def _matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_of(spark, sf_dir, "events").get_relationship_matrix()


def _cardinalities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cube_of(spark, sf_dir).get_cardinalities(include_inverse=True)


def _members(*dims: str, kind: str = "sales", state: str = "Default") -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: cube_of(spark, sf_dir, kind).dimensions(list(dims), state)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "revenue_by_region": _query(dimensions=["r_name"], metrics=["revenue", "lines"]),
    "revenue_by_brand_null_group": _query(dimensions=["p_brand"], metrics=["revenue", "lines"]),
    "filtered_segment": _query(dimensions=["r_name"], metrics=["quantity_building"]),
    "dims_only": _members("r_name", "c_mktsegment"),
    "dims_filtered_state": _members("n_name", state="building_asia"),
    "shared_dimension": _members("custkey", "c_mktsegment", kind="events"),
    "grand_total": _query(metrics=["revenue", "quantity", "lines"]),
    "multi_metric": _query(dimensions=["l_returnflag"], metrics=["quantity", "lines", "quantity_mean", "quantity_min", "quantity_max", "brands"]),
    "two_facts": _query(dimensions=["o_orderpriority"], metrics=["order_total", "quantity", "customers"]),
    "median_std_var": _query(digits=4, dimensions=["l_returnflag"], metrics=["quantity_median", "quantity_std", "quantity_var", "quantity_sem", "quantity_skew"]),
    "row_condition": _query(dimensions=["p_brand"], metrics=["large_lines"]),
    "metric_filters": _query(dimensions=["o_orderpriority"], metrics=["order_total", "urgent_total"]),
    "two_context_states": _query(dimensions=["r_name"], metrics=["quantity_building", "quantity_other"]),
    "undo_redo_remove": _query(dimensions=["r_name"], metrics=["undone_quantity"]),
    "ignore_dims_all": _query(digits=3, dimensions=["r_name", "c_mktsegment"], metrics=["revenue"], derived_metrics=["share"]),
    "ignore_dims_some": _query(dimensions=["r_name", "c_mktsegment"], metrics=["quantity", "revenue_region"]),
    "ignore_ctx_filters": _query(dimensions=["r_name"], metrics=["quantity_building", "quantity_everywhere", "quantity_segments"]),
    "nested_avg_of_sums": _query(dimensions=["r_name"], metrics=["mean_customer_total"]),
    "nested_compose": _query(dimensions=["r_name"], metrics=["nations"], drop_null_dimensions=True),
    "derived_having_sort": _query(dimensions=["p_brand"], metrics=["revenue"], derived_metrics=["mean_line"], having="[lines] > 0 and [mean_line] > 1000", sort=[("revenue", "desc")]),
    "derived_of_total": _query(digits=4, dimensions=["p_brand"], metrics=["quantity"], derived_metrics=["of_total"], drop_null_dimensions=True),
    "fillna_metric": _query(digits=4, dimensions=["p_brand"], metrics=["filled"]),
    "moving_average": _query(name="ma_by_brand"),
    "zscore": _query(name="z_by_brand", digits=4),
    "rank": _query(name="rank_by_type"),
    "cumulative": _query(name="cumulative_by_size"),
    "shared_column_count": _query("events", dimensions=["c_mktsegment"], metrics=["buyers"]),
    "fanout_dedup": _query("events", dimensions=["event_type"], metrics=["order_total", "event_value"]),
    "composite_bridge": _query("stock", dimensions=["l_returnflag"], metrics=["available", "sold"]),
    "dangling_documents": _query("docs", dimensions=["quality"], metrics=["docs", "chars", "languages"]),
    "cardinalities": _cardinalities,
    "pivot_sum": _brand_returns,
    "pie_share": _segment_shares,
    "topk": _top_customers,
    "melt": _melted,
    "udf_expression": _query(dimensions=["l_returnflag"], metrics=["doubled_quantity"]),
    "udaf_p90": _query(dimensions=["l_returnflag"], metrics=["p90_quantity"], drop_null_dimensions=True),
    "null_results_dropped": _query(dimensions=["o_orderpriority"], metrics=["urgent_total"], drop_null_metric_results=True),
    "derived_fillna": _query(digits=4, others={"order_total": 2}, dimensions=["o_orderpriority"], metrics=["order_total"], derived_metrics=["urgent_share"]),
    "size": _query(dimensions=["p_brand"], metrics=["rows"]),
    "first_last": _query(dimensions=["l_returnflag"], metrics=["first_line", "last_line"], drop_null_dimensions=True),
    "product": _query(dimensions=["r_name"], metrics=["name_product"]),
    "ranks_in_expressions": _query(dimensions=["p_brand"], metrics=["quantity"], derived_metrics=["place", "upto", "change", "before"], drop_null_dimensions=True),
    "having_function": _query(dimensions=["p_brand"], metrics=["quantity"], having="@nearly_all([quantity], 1000)"),
    "compose_function": _query(dimensions=["r_name"], metrics=["bracketed"], drop_null_dimensions=True),
    "null_among_filter_values": _query(dimensions=["c_mktsegment"], metrics=["unknown_segments"]),
    "relationship_matrix": _matrix,
    "pivot_sorted": _first_pivot,
    "kpi": _kpi,
    "expressions": _query(digits=3, dimensions=["l_returnflag"], metrics=["last_year", "long_names", "discounted", "any_returned", "all_small", "unit_price"], drop_null_dimensions=True),
}

CORE = """core AS (
  SELECT * FROM lineitem FULL JOIN orders ON l_orderkey = o_orderkey FULL JOIN customer ON o_custkey = c_custkey
  FULL JOIN nation ON c_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey
  FULL JOIN part ON l_partkey = p_partkey FULL JOIN supplier ON l_suppkey = s_suppkey
)"""
REV = "round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 2)"
QTY = "coalesce(sum(l_quantity), 0)"
#: An order (or event) once for each group, however many lines it has.
ORDERS = "ord AS (SELECT DISTINCT {by}, o_orderkey, o_totalprice, o_custkey, c_name FROM core)"


def _links(one: str, k1: str, two: str, k2: str, shared: str) -> str:
    """SQL of a row of cardinalities, both ways."""
    return f"""SELECT * FROM (
  WITH a AS (SELECT {k1} AS k, count(*) AS n FROM {one} WHERE {k1} IS NOT NULL GROUP BY 1), b AS (SELECT {k2} AS k, count(*) AS n FROM {two} WHERE {k2} IS NOT NULL GROUP BY 1),
  c AS (SELECT (SELECT count(*) FROM a) AS n1, (SELECT count(*) FROM b) AS n2, count(*) AS both_, coalesce(max(a.n), 0) AS m1, coalesce(max(b.n), 0) AS m2 FROM a JOIN b USING (k))
  SELECT '{one}' AS table1, '{two}' AS table2, '{shared}' AS shared_column, CASE WHEN both_ = 0 THEN 'no relationship' WHEN m1 = 1 AND m2 = 1 THEN 'one-to-one' WHEN m1 = 1 THEN 'one-to-many' WHEN m2 = 1 THEN 'many-to-one' ELSE 'many-to-many' END AS cardinality, n1 AS keys_in_t1, n2 AS keys_in_t2, both_ AS keys_in_both, m1 AS max_rows_per_key_t1, m2 AS max_rows_per_key_t2 FROM c
  UNION ALL
  SELECT '{two}', '{one}', '{shared}', CASE WHEN both_ = 0 THEN 'no relationship' WHEN m1 = 1 AND m2 = 1 THEN 'one-to-one' WHEN m1 = 1 THEN 'many-to-one' WHEN m2 = 1 THEN 'one-to-many' ELSE 'many-to-many' END, n2, n1, both_, m2, m1 FROM c)"""


ORACLES: dict[str, str] = {
    "revenue_by_region": f"WITH {CORE} SELECT r_name, {REV} AS revenue, count(l_linenumber) AS lines FROM core GROUP BY 1",
    "revenue_by_brand_null_group": f"WITH {CORE} SELECT p_brand, {REV} AS revenue, count(l_linenumber) AS lines FROM core GROUP BY 1",
    "filtered_segment": f"WITH {CORE} SELECT r_name, {QTY} AS quantity_building FROM core WHERE c_mktsegment = 'BUILDING' GROUP BY 1",
    "dims_only": f"WITH {CORE} SELECT DISTINCT r_name, c_mktsegment FROM core",
    "dims_filtered_state": f"WITH {CORE} SELECT DISTINCT n_name FROM core WHERE c_mktsegment = 'BUILDING' AND r_name = 'ASIA'",
    "shared_dimension": "WITH hub AS (SELECT c_custkey AS custkey FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events) SELECT DISTINCT custkey, c_mktsegment FROM hub FULL JOIN customer ON custkey = c_custkey FULL JOIN nation ON c_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey",
    "grand_total": f"WITH {CORE} SELECT {REV} AS revenue, {QTY} AS quantity, count(l_linenumber) AS lines FROM core",
    "multi_metric": f"WITH {CORE} SELECT l_returnflag, {QTY} AS quantity, count(l_linenumber) AS lines, round(avg(l_quantity), 2) AS quantity_mean, min(l_quantity) AS quantity_min, max(l_quantity) AS quantity_max, count(DISTINCT upper(p_brand)) AS brands FROM core GROUP BY 1",
    "two_facts": f"WITH {CORE}, {ORDERS.format(by='o_orderpriority')}, a AS (SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS order_total FROM ord GROUP BY 1), b AS (SELECT o_orderpriority, {QTY} AS quantity, count(DISTINCT c_name) AS customers FROM core GROUP BY 1) SELECT a.o_orderpriority, order_total, quantity, customers FROM a JOIN b ON a.o_orderpriority IS NOT DISTINCT FROM b.o_orderpriority",
    "median_std_var": f"WITH {CORE} SELECT l_returnflag, median(l_quantity) AS quantity_median, round(stddev_samp(l_quantity), 4) AS quantity_std, round(var_samp(l_quantity), 4) AS quantity_var, round(stddev_samp(l_quantity) / sqrt(count(l_quantity)), 4) AS quantity_sem, round(skewness(l_quantity), 4) AS quantity_skew FROM core GROUP BY 1",
    "row_condition": f"WITH {CORE} SELECT p_brand, count(l_quantity) AS large_lines FROM core WHERE l_quantity > 45 AND l_returnflag <> 'N' GROUP BY 1",
    "metric_filters": f"WITH {CORE}, {ORDERS.format(by='o_orderpriority')} SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS order_total, CASE WHEN o_orderpriority = '1-URGENT' THEN round(sum(o_totalprice), 2) END AS urgent_total FROM ord GROUP BY 1",
    "two_context_states": f"WITH {CORE}, a AS (SELECT r_name, {QTY} AS quantity_building FROM core WHERE c_mktsegment = 'BUILDING' GROUP BY 1), b AS (SELECT r_name, {QTY} AS quantity_other FROM core WHERE c_mktsegment = 'AUTOMOBILE' GROUP BY 1) SELECT coalesce(a.r_name, b.r_name) AS r_name, quantity_building, quantity_other FROM a FULL JOIN b ON a.r_name IS NOT DISTINCT FROM b.r_name",
    "undo_redo_remove": f"WITH {CORE} SELECT r_name, {QTY} AS undone_quantity FROM core WHERE r_name IN ('ASIA', 'EUROPE') GROUP BY 1",
    "ignore_dims_all": f"WITH {CORE} SELECT r_name, c_mktsegment, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0), 3) AS revenue, round(coalesce(sum(l_extendedprice * (1 - l_discount)), 0) / (SELECT sum(l_extendedprice * (1 - l_discount)) FROM lineitem) * 100, 3) AS share FROM core GROUP BY 1, 2",
    "ignore_dims_some": f"WITH {CORE}, r AS (SELECT r_name, {REV} AS revenue_region FROM core GROUP BY 1), g AS (SELECT r_name, c_mktsegment, {QTY} AS quantity FROM core GROUP BY 1, 2) SELECT g.r_name, c_mktsegment, quantity, revenue_region FROM g JOIN r ON g.r_name IS NOT DISTINCT FROM r.r_name",
    "ignore_ctx_filters": f"WITH {CORE}, a AS (SELECT r_name, {QTY} AS q FROM core WHERE c_mktsegment = 'BUILDING' GROUP BY 1), b AS (SELECT r_name, {QTY} AS q FROM core GROUP BY 1), c AS (SELECT r_name, {QTY} AS q FROM core WHERE r_name = 'ASIA' GROUP BY 1) SELECT b.r_name, a.q AS quantity_building, b.q AS quantity_everywhere, c.q AS quantity_segments FROM b LEFT JOIN a ON a.r_name IS NOT DISTINCT FROM b.r_name LEFT JOIN c ON c.r_name IS NOT DISTINCT FROM b.r_name",
    "nested_avg_of_sums": f"WITH {CORE}, {ORDERS.format(by='r_name')}, c AS (SELECT r_name, c_name, coalesce(sum(o_totalprice), 0) AS total FROM ord GROUP BY 1, 2) SELECT r_name, round(avg(total), 2) AS mean_customer_total FROM c GROUP BY 1",
    "nested_compose": f"WITH {CORE}, c AS (SELECT r_name, n_name, count(DISTINCT c_custkey) AS n FROM core WHERE r_name IS NOT NULL AND n_name IS NOT NULL GROUP BY 1, 2) SELECT r_name, string_agg(n_name || ': ' || n, ', ' ORDER BY n_name) AS nations FROM c GROUP BY 1",
    "derived_having_sort": f"WITH {CORE}, g AS (SELECT p_brand, sum(l_extendedprice * (1 - l_discount)) AS revenue, count(l_linenumber) AS lines FROM core GROUP BY 1) SELECT p_brand, round(revenue, 2) AS revenue, round(revenue / lines, 2) AS mean_line FROM g WHERE lines > 0 AND revenue / lines > 1000",
    "derived_of_total": f"WITH {CORE} SELECT p_brand, {QTY} AS quantity, round({QTY} / (SELECT sum(l_quantity) FROM core WHERE p_brand IS NOT NULL) * 100, 4) AS of_total FROM core WHERE p_brand IS NOT NULL GROUP BY 1",
    "fillna_metric": f"WITH {CORE}, d AS (SELECT DISTINCT p_brand, CASE WHEN l_orderkey IS NULL THEN NULL ELSE rn END AS rn, l_quantity FROM (SELECT *, row_number() OVER () AS rn FROM core)) SELECT p_brand, round(avg(coalesce(l_quantity, 0)), 4) AS filled FROM d GROUP BY 1",
    "moving_average": f"WITH {CORE}, g AS (SELECT p_brand, {QTY} AS quantity FROM core WHERE p_brand IS NOT NULL GROUP BY 1) SELECT p_brand, quantity, round(avg(quantity) OVER (ORDER BY p_brand ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS ma FROM g",
    "zscore": f"WITH {CORE}, g AS (SELECT p_brand, {QTY} AS quantity FROM core WHERE p_brand IS NOT NULL GROUP BY 1) SELECT p_brand, quantity, round((quantity - avg(quantity) OVER ()) / stddev_samp(quantity) OVER (), 4) AS z FROM g",
    "rank": f"WITH {CORE}, g AS (SELECT p_type, {QTY} AS quantity FROM core WHERE p_type IS NOT NULL GROUP BY 1) SELECT p_type, quantity, CAST(dense_rank() OVER (ORDER BY quantity DESC) AS INT) AS place FROM g",
    "cumulative": f"WITH {CORE}, g AS (SELECT p_size, {QTY} AS quantity FROM core WHERE p_size IS NOT NULL GROUP BY 1) SELECT p_size, quantity, sum(quantity) OVER (ORDER BY p_size) AS upto FROM g",
    "shared_column_count": "WITH hub AS (SELECT c_custkey AS custkey FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events), core AS (SELECT * FROM hub FULL JOIN customer ON custkey = c_custkey FULL JOIN nation ON c_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey) SELECT c_mktsegment, count(DISTINCT custkey) AS buyers FROM core GROUP BY 1",
    "fanout_dedup": "WITH hub AS (SELECT c_custkey AS k FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events), core AS (SELECT * FROM hub LEFT JOIN orders ON k = o_custkey LEFT JOIN events ON k = user_id), o AS (SELECT event_type, coalesce(sum(o_totalprice), 0) AS order_total FROM (SELECT DISTINCT event_type, o_orderkey, o_totalprice FROM core) GROUP BY 1), e AS (SELECT event_type, coalesce(sum(value), 0) AS event_value FROM (SELECT DISTINCT event_type, event_id, value FROM core) GROUP BY 1) SELECT o.event_type, round(order_total, 2) AS order_total, round(event_value, 2) AS event_value FROM o JOIN e ON o.event_type IS NOT DISTINCT FROM e.event_type",
    "composite_bridge": "WITH stock AS (SELECT l_partkey AS p, l_suppkey AS s, count(*) AS avail FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1, 2), core AS (SELECT * FROM lineitem FULL JOIN stock ON l_partkey = p AND l_suppkey = s FULL JOIN part ON coalesce(l_partkey, p) = p_partkey FULL JOIN supplier ON coalesce(l_suppkey, s) = s_suppkey), a AS (SELECT l_returnflag, CAST(coalesce(sum(avail), 0) AS BIGINT) AS available FROM (SELECT DISTINCT l_returnflag, p, s, avail FROM core) GROUP BY 1), b AS (SELECT l_returnflag, coalesce(sum(l_quantity), 0) AS sold FROM core GROUP BY 1) SELECT a.l_returnflag, available, sold FROM a JOIN b ON a.l_returnflag IS NOT DISTINCT FROM b.l_returnflag",
    "dangling_documents": "WITH core AS (SELECT d.*, l.quality FROM documents d FULL JOIN labels l ON d.doc_id = l.doc_id) SELECT quality, count(n_chars) AS docs, CAST(coalesce(sum(n_chars), 0) AS BIGINT) AS chars, string_agg(DISTINCT lang, ', ' ORDER BY lang) AS languages FROM core GROUP BY 1",
    "cardinalities": "\nUNION ALL\n".join(_links(*x) for x in (("region", "r_regionkey", "nation", "n_regionkey", "regionkey"), ("nation", "n_nationkey", "customer", "c_nationkey", "nationkey"), ("customer", "c_custkey", "orders", "o_custkey", "custkey"), ("orders", "o_orderkey", "lineitem", "l_orderkey", "orderkey"), ("lineitem", "l_partkey", "part", "p_partkey", "partkey"), ("lineitem", "l_suppkey", "supplier", "s_suppkey", "suppkey"))),
    "pivot_sum": f"WITH {CORE} SELECT p_brand, coalesce(sum(l_quantity) FILTER (l_returnflag = 'A'), 0) AS \"A\", coalesce(sum(l_quantity) FILTER (l_returnflag = 'N'), 0) AS \"N\", coalesce(sum(l_quantity) FILTER (l_returnflag = 'R'), 0) AS \"R\" FROM core WHERE p_brand IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1",
    "pie_share": f"WITH {CORE} SELECT c_mktsegment, {QTY} AS quantity, round({QTY} * 100 / (SELECT sum(l_quantity) FROM core WHERE c_mktsegment IS NOT NULL), 4) AS share FROM core WHERE c_mktsegment IS NOT NULL GROUP BY 1",
    "topk": "SELECT c_name, round(sum(o_totalprice), 2) AS order_total FROM customer JOIN orders ON c_custkey = o_custkey GROUP BY 1 ORDER BY 2 DESC LIMIT 10",
    "null_results_dropped": "SELECT o_orderpriority, round(sum(o_totalprice), 2) AS urgent_total FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1",
    "derived_fillna": f"WITH {CORE}, {ORDERS.format(by='o_orderpriority')} SELECT o_orderpriority, round(coalesce(sum(o_totalprice), 0), 2) AS order_total, CASE WHEN o_orderpriority = '1-URGENT' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS urgent_share FROM ord GROUP BY 1",
    "size": f"WITH {CORE}, d AS (SELECT DISTINCT p_brand, CASE WHEN l_orderkey IS NOT NULL THEN rn END AS rn FROM (SELECT *, row_number() OVER () AS rn FROM core)) SELECT p_brand, count(*) AS rows FROM d GROUP BY 1",
    "first_last": "SELECT l_returnflag, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line FROM lineitem WHERE l_returnflag IS NOT NULL GROUP BY 1",
    "product": f"WITH {CORE}, d AS (SELECT DISTINCT r_name, r_regionkey FROM core) SELECT r_name, coalesce(product(length(r_name)), 1) AS name_product FROM d GROUP BY 1",
    "ranks_in_expressions": f"WITH {CORE}, g AS (SELECT p_brand, {QTY} AS quantity FROM core WHERE p_brand IS NOT NULL GROUP BY 1) SELECT p_brand, quantity, CAST(rank() OVER (ORDER BY quantity DESC) AS DOUBLE) AS place, sum(quantity) OVER (ORDER BY p_brand) AS upto, quantity - lag(quantity) OVER (ORDER BY p_brand) AS change, lag(quantity) OVER (ORDER BY p_brand) AS before FROM g",
    "having_function": f"WITH {CORE}, g AS (SELECT p_brand, {QTY} AS quantity FROM core GROUP BY 1) SELECT * FROM g WHERE quantity >= 1000",
    "compose_function": f"WITH {CORE}, c AS (SELECT r_name, n_name, count(DISTINCT c_custkey) AS n FROM core WHERE r_name IS NOT NULL AND n_name IS NOT NULL GROUP BY 1, 2) SELECT r_name, string_agg('[' || n_name || '=' || n || ']', ', ' ORDER BY n_name) AS bracketed FROM c GROUP BY 1",
    "null_among_filter_values": f"WITH {CORE} SELECT c_mktsegment, {QTY} AS unknown_segments FROM core WHERE c_mktsegment = 'BUILDING' OR c_mktsegment IS NULL GROUP BY 1",
    "relationship_matrix": "WITH hub AS (SELECT c_custkey AS custkey FROM customer UNION SELECT o_custkey FROM orders UNION SELECT user_id FROM events) SELECT DISTINCT custkey, coalesce(c_nationkey, n_nationkey) AS nationkey, coalesce(n_regionkey, r_regionkey) AS regionkey FROM hub FULL JOIN customer ON custkey = c_custkey FULL JOIN nation ON c_nationkey = n_nationkey FULL JOIN region ON n_regionkey = r_regionkey",
    "pivot_sorted": "SELECT p_brand, count(*) FILTER (l_returnflag = 'A') AS \"A\", count(*) FILTER (l_returnflag = 'N') AS \"N\", count(*) FILTER (l_returnflag = 'R') AS \"R\" FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand IS NOT NULL AND l_returnflag IS NOT NULL GROUP BY 1 ORDER BY 1 DESC LIMIT 10",
    "kpi": "SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem",
    "melt": f"WITH {CORE}, g AS (SELECT r_name, {QTY} AS q, CAST(count(l_linenumber) AS DOUBLE) AS n FROM core GROUP BY 1) SELECT r_name, 'quantity' AS series, q AS value FROM g UNION ALL SELECT r_name, 'lines', n FROM g",
    "udf_expression": f"WITH {CORE} SELECT l_returnflag, coalesce(sum(l_quantity * 2), 0) AS doubled_quantity FROM core GROUP BY 1",
    "udaf_p90": f"WITH {CORE} SELECT l_returnflag, round(quantile_cont(l_quantity, 0.9), 2) AS p90_quantity FROM core WHERE l_returnflag IS NOT NULL GROUP BY 1",
    "expressions": f"WITH {CORE} SELECT l_returnflag, CAST(max(year(o_orderdate)) AS INT) AS last_year, count(*) FILTER (length(p_name) > 20) AS long_names, sum(CASE WHEN l_discount >= 0.05 THEN l_quantity ELSE 0 END) AS discounted, bool_or(l_returnflag = 'R') AS any_returned, bool_and(l_quantity <= 50) AS all_small, round(avg(l_extendedprice / l_quantity), 3) AS unit_price FROM core WHERE l_returnflag IS NOT NULL GROUP BY 1",
}
