"""Definitions, transformers, catalogs, plots and snapshots."""

import datetime
import math

import pandas as pd
import pytest
import yaml
from pyspark.sql import functions as F
from test_cube import GOLDEN, rows

from starloom import Hypercube, plots
from starloom.operators.transformers import GroupedPandas
from starloom.sources.catalog import Catalog, InMemoryRepository, ModelYAMLSource
from starloom.sources.readers import read_tables


def test_derived_metrics_and_dependencies(cube):
    cube.define_derived_metric("b", "[a] * 2")
    cube.define_derived_metric("a", "[Revenue] / [Units]")
    cube.define_query("q", ["region"], [], ["b"])
    found = cube.debug_dependencies()["q"]
    assert sorted(found["metrics"]) == ["Revenue", "Units"] and found["derived_metrics"] == ["a", "b"]
    assert rows(cube.query("q")) == {("North", 2 * 2225 / 13), ("West", 1000), ("South", 1600)}
    cube.define_derived_metric("a", "[b] + 1")
    with pytest.raises(ValueError, match="Cyclic"):
        cube.query("q")
    cube.define_derived_metric("a", "[Missing]")
    assert cube.debug_missing_dependencies() == {"q": ["Missing"]}
    with pytest.raises(ValueError, match="Missing"):
        cube.query("q")
    cube.delete_derived_metric("b")
    with pytest.raises(ValueError):
        cube.query("nothing")
    for bad in ({}, {"dimensions": []}):
        with pytest.raises(ValueError):
            cube.query(options=bad)


def test_transformers(cube):
    cube.define_query("q", ["category"], ["Revenue"])
    cube.define_transformation("q", "rank", {"on": "Revenue"})
    cube.define_transformation("q", "zscore", {"on": "Revenue"})
    cube.register_transformer("shout", lambda df, **p: df.withColumn("loud", F.upper("category")).withColumn("Revenue", F.lit(0.0)))
    cube.define_transformation("q", "shout")
    cube.register_transformer("broken", lambda df, **p: df.select("nowhere"))
    cube.define_transformation("q", "broken")
    out = {r["category"]: r for r in cube.query("q").collect()}
    assert [out[c]["Revenue_rank"] for c in ("Electronics", "Other", "Home")] == [1, 2, 3] and out["Home"]["loud"] == "HOME" and out["Home"]["Revenue"] == 225
    values = pd.Series([2500.0, 225, 2400])
    assert out["Electronics"]["Revenue_z"] == pytest.approx((2500 - values.mean()) / values.std())
    assert cube.list_transformations("q") == ["rank", "zscore", "shout", "broken"] and cube.get_transformation_config("q", "rank") == {"on": "Revenue"}
    cube.delete_transformation("q", "rank")
    assert "Revenue_rank" not in cube.query("q").columns
    with pytest.raises(ValueError):
        cube.define_transformation("q", "nothing")


@pytest.mark.parametrize("window,center,least", [(3, False, None), (3, True, 1), (4, True, 2), (2, False, 1)])
def test_moving_average_like_pandas(cube, spark, window, center, least):
    values = [1.0, None, 3.0, 4.0, None, 6.0, 7.0]
    df = spark.createDataFrame([(i, g, v) for g in "ab" for i, v in enumerate(values)], "i int, g string, v double")
    out = cube.transform(df, "moving_average", {"on": "v", "by": ["g"], "sort_by": ["i"], "window": window, "center": center, "min_periods": least, "new_column": "m"})
    want = pd.Series(values).rolling(window, min_periods=least, center=center).mean()
    for r in out.collect():
        assert (r["m"] is None) if math.isnan(want[r["i"]]) else r["m"] == pytest.approx(want[r["i"]])


def test_more_transformers(cube, spark):
    df = spark.createDataFrame([(1, "a", 5.0), (2, "a", 3.0), (3, "b", 2.0)], "i int, g string, v double")
    assert [r["v_cum"] for r in cube.transform(df, "cumulative", {"on": "v", "sort_by": "i"}).orderBy("i").collect()] == [5, 8, 10]
    assert [r["v_share"] for r in cube.transform(df, "pareto", {"on": "v"}).orderBy("i").collect()] == [0.5, 0.8, 1.0]
    assert [r["v_z"] for r in cube.transform(df, "zscore", {"on": "v", "by": ["g"], "ddof": 0}).orderBy("i").collect()] == [1, -1, None]
    cube.register_transformer("demean", GroupedPandas(lambda p: p.assign(d=p["v"] - p["v"].mean()), ["g"], {"d": "double"}))
    assert [r["d"] for r in cube.transform(df, "demean").orderBy("i").collect()] == [1, -1, 0]
    with pytest.raises(ValueError):
        cube.transform(df, "zscore")


@pytest.mark.parametrize("name,params", [("cumulative", {"sort_by": ["i"]}), ("pareto", {}), ("rank", {"method": "dense"}), ("rank", {"method": "min", "ascending": True}), ("moving_average", {"sort_by": ["i"], "window": 5, "min_periods": 2}), ("moving_average", {"sort_by": ["i"], "window": 4, "center": True})])
def test_spread_over_tasks_gives_the_same(cube, spark, monkeypatch, name, params):
    from starloom.operators import ordered

    monkeypatch.setattr(ordered.rolling_mean, "__defaults__", (7,))
    df = spark.createDataFrame([(i, float(i * 7 % 23) if i % 6 else None) for i in range(90)], "i int, v double").repartition(3)
    one, two = (sorted(map(tuple, cube.transform(df, name, {"on": "v", "new_column": "x", **params, "distributed": d}).collect())) for d in (False, True))
    assert [r[:2] for r in one] == [r[:2] for r in two] and len(one) == 90
    assert [None if r[2] is None else round(r[2], 9) for r in one] == [None if r[2] is None else round(r[2], 9) for r in two]


def test_derived_fillna_fills_results_too(cube):
    cube.define_metric("North", "[qty]", "sum", metric_filters={"region": ["North"]})
    cube.define_metric("Nothing", "[qty] * 0", "sum")
    cube.define_derived_metric("Filled share", "[North] / [Nothing]", fillna=0)
    cube.define_derived_metric("Share", "[North] / [Nothing]")
    cube.define_derived_metric("Other kind", "[North] == 13", fillna=0)
    rows = cube.query(options={"dimensions": ["region"], "metrics": ["Nothing"], "derived_metrics": ["Filled share", "Share", "Other kind"]}).collect()
    assert [(r["Filled share"], r["Share"]) for r in rows] == [(0.0, None)] * 3 and sum(r["Other kind"] for r in rows) == 1


def define_all(cube):
    cube.define_metric("Filled", "[qty]", "mean", fillna=0, metric_filters={"region": ["North"]})
    cube.define_derived_metric("Price", "[Revenue] / [Units]")
    cube.define_query("sales", ["region", "category"], ["Revenue"], ["Price"], having="[Units] > 1", sort=[("Revenue", "desc")])
    cube.define_transformation("sales", "rank", {"on": "Revenue"})
    cube.define_query("other", ["region"], ["Filled"])
    cube.define_transformation("other", "rank", {"on": "Filled", "ascending": True})
    cube.define_plot("sales", "bars", plot_type="bar", limit=2)
    cube.define_plot("other", "bars", plot_type="line")


@pytest.mark.parametrize("nested", [True, False])
def test_catalog_round_trip(cube, tmp_path, nested):
    define_all(cube)
    before, path = cube.specs(), tmp_path / "model.yml"
    assert cube.set_yaml_model_catalog(path, prefer_nested_plots=nested, prefer_nested_transformers=nested) == path
    cube.save_to_model_catalog()
    text = yaml.safe_load(path.read_text())
    assert ("plots" in text["queries"]["sales"]) == nested and ("transformers" in text) != nested
    cube.load_from_model_catalog(reset_specs=True)
    after = cube.specs()
    for kind in before:
        assert list(after[kind].values()) == list(before[kind].values()), kind
    assert cube.get_yaml_path_model_catalog() == path


def test_yaml_shapes(tmp_path):
    path = tmp_path / "m.yml"
    path.write_text(yaml.safe_dump({"queries": {"q1": {"dimensions": ["a"], "transformers": {"n": {"params": {"alpha": 1}}}}}, "plots": {"p1": {"type": "bar", "query": "q1"}, "p2": {"type": "line"}}, "transformers": {"t1": {"a": 1, "query": "q1"}, "t2": {"params": {"beta": 2}}}}))
    source = ModelYAMLSource(path)
    data = source.load()
    assert data["transformers"]["n"]["params"] == {"alpha": 1} and data["transformers"]["n"]["query"] == "q1" and data["transformers"]["t2"]["params"] == {"beta": 2}
    source.save(data)
    out = yaml.safe_load(path.read_text())
    assert out["queries"]["q1"] == {"dimensions": ["a"], "plots": {"p1": {"type": "bar"}}, "transformers": {"t1": {"a": 1}, "n": {"alpha": 1}}}
    assert out["plots"] == {"p2": {"type": "line"}} and out["transformers"] == {"t2": {"beta": 2}}


def test_catalog_and_repository(tmp_path):
    for i, name in enumerate(("a.yml", "b.yml")):
        (tmp_path / name).write_text(yaml.safe_dump({"metrics": {"m": {"expression": f"[{i}x]"}}}))
    catalog = Catalog([ModelYAMLSource(tmp_path / "a.yml"), ModelYAMLSource(tmp_path / "b.yml"), ModelYAMLSource(tmp_path / "none.yml")], InMemoryRepository())
    catalog.refresh()
    assert catalog.get("metrics", "m")["expression"] == "[1x]" and catalog.list_kinds() == ["metrics"]
    catalog.add("metrics", "n", {"expression": "[y]"})
    catalog.update("metrics", "n", {"aggregation": "sum"})
    catalog.delete("metrics", "m")
    assert catalog.list("metrics") == ["n"]
    catalog.save()
    assert yaml.safe_load((tmp_path / "none.yml").read_text()) == {"metrics": {"n": {"expression": "[y]", "aggregation": "sum"}}}
    with pytest.raises(KeyError):
        catalog.update("metrics", "zzz", {})


def test_snapshot(cube, spark, tmp_path):
    cube.add_functions(sqrt=math.sqrt, lost=lambda s: s)
    cube.define_query("sales", ["region", "category", "promo_type"], ["Revenue", "Units", "Margin", "Number of Sales"])
    cube.define_plot("sales")
    cube.save(str(tmp_path / "snap"))
    again = Hypercube.load(str(tmp_path / "snap"), spark)
    assert rows(again.query("sales")) == GOLDEN
    assert again.function_registry["sqrt"] is math.sqrt and "lost" not in again.function_registry
    cube.filter({"region": ["North", None]})
    cube.set_context_state("other")
    cube.filter({"month": [datetime.date(2024, 1, 1)], "promo_type": ["Launch"]}, "other")
    cube.reset_filters("backward", "other")
    cube.save(str(tmp_path / "states"))
    kept = Hypercube.load(str(tmp_path / "states"), spark)
    assert kept.context_states == cube.context_states and rows(kept.query("sales")) == rows(cube.query("sales")) != GOLDEN
    assert kept.reset_filters("forward", "other") and kept.get_filters(0, "other") == {"month": [datetime.date(2024, 1, 1)], "promo_type": ["Launch"]}
    assert again.list_plots("sales") == ["table plot"] and again.normalized_core == cube.normalized_core


def test_plots(cube):
    cube.define_query("q", ["region", "category"], ["Revenue"])
    assert [s["plot_type"] for s in cube.suggest_plot_types("q")] == ["bar", "line", "area"]
    cube.define_plot("q")
    cube.define_plot("q", "pie", plot_type="pie", dimensions=["region"], set_as_default=False)
    cube.define_plot("q", "top", plot_type="table", sort_values=True, sort_ascending=False, limit=1, set_as_default=False)
    assert cube.list_plots("q") == ["bar plot", "pie", "top"] and cube.get_default_plot("q") == "bar plot"
    table = plots.TableRenderer()
    bars, top = cube.plot("q", plot_name=["bar plot", "top"], renderer=table)
    assert bars.set_index("region").loc["North", "Home"] == 225 and bars.set_index("region").loc["West", "Home"] == 0
    assert top.values.tolist() == [["South", "Other", 2400.0]]
    pie = cube.plot("q", plot_name="pie", renderer=table)
    assert pie["share"].sum() == pytest.approx(100)
    assert "Revenue" in cube.plot("q", plot_name="top") and "#" in cube.plot(query_options={"dimensions": ["region"], "metrics": ["Units"]})
    heat = cube.plot("q", plot_type="heatmap", renderer=table)
    assert heat.set_index("region")["Home"].isna().sum() == 2
    cube.set_default_plot("q", "pie")
    cube.delete_plot("q", "pie")
    assert cube.get_default_plot("q") == "bar plot"
    cube.delete_query("q")
    assert cube.list_plots("q") == []
    with pytest.raises(ValueError):
        cube.define_plot("q")


def test_plot_data(spark):
    df = spark.createDataFrame([("a", "x", 1, 2.0), ("b", "y", 3, None)], "d string, e string, m int, n double")
    assert rows(plots.melted(df, ["d"], ["m", "n"])) == {("a", "m", 1), ("a", "n", 2), ("b", "m", 3), ("b", "n", None)}
    assert rows(plots.labelled(df, ["d", "e"]).select("label")) == {("a | x",), ("b | y",)}
    assert rows(spark.createDataFrame([("$1,200",), ("12 %",), ("no",)], "s string").select(plots.cleaned_number("s"))) == {(1200,), (12,), (None,)}
    assert [plots.format_value(v) for v in (1234, 1.5, None, "s", True)] == ["1,234", "1.50", "", "s", "True"] and plots.format_value(0.5, ".0%") == "50%"


def test_pivot_in_an_order_of_its_own(spark):
    df = spark.createDataFrame([("a", "x", 1, 9), ("a", "y", 2, 8), ("b", "x", 3, 1), ("b", "y", 4, 1), (None, "x", 5, 5)], "d string, e string, m int, o int")
    config = plots.DEFAULTS | {"plot_type": "pivot", "dimensions": ["d"], "metrics": ["m"], "pivot": "e"}
    by_other = plots.plot_data(df, config | {"sort_by": "o"})
    assert by_other.columns == ["d", "x", "y"] and [tuple(r) for r in by_other.collect()] == [("b", 3, 4), (None, 5, None), ("a", 1, 2)]
    assert [r.d for r in plots.plot_data(df, config | {"sort_by": ["x"], "sort_ascending": [False], "limit": 2}).collect()] == [None, "b"]
    assert plots.plot_data(df.limit(0), config | {"sort_by": "o"}).count() == 0


def test_coloured_table(spark):
    df = spark.createDataFrame([("a<", 1), ("b", -1), (None, None)], "d string, m int")
    config = plots.DEFAULTS | {"plot_type": "table", "dimensions": ["d"], "metrics": ["m"], "row_color_condition": "m", "row_colors": {"True": "#0f0", "False": "red"}, "annotations": ["a note"], "hide_index": True}
    shown = plots.HtmlRenderer().render(df, config)
    assert '<tr style="background-color: #0f0"><td>a&lt;</td>' in shown and '<tr style="background-color: red"><td>b</td>' in shown and shown.endswith("<p>a note</p>")
    assert plots.row_colour({"d": "b"}, {"row_color_condition": "d", "row_colors": {"b": "blue"}}) == "blue" and plots.row_colour({}, config) is None


def test_graph_matrix_and_readers(cube, spark, tmp_path):
    assert 'n0["Product"]' in cube.visualize_graph() and "graph cube" in cube.visualize_graph("dot")
    assert "region" in cube.get_dimensions() and "customer_id" in cube.get_dimensions() and not [d for d in cube.get_dimensions() if "<" in d]
    assert cube.get_relationship_matrix().columns == ["customer_id", "date", "product_id", "promo_code", "region_id"] and cube.get_relationship_matrix().count() == 6
    assert cube.tables_of(["region", "category"]) == ["Customer", "Product", "Region", "Sales"]
    pd.DataFrame({"k": [1, 2], "v": ["a", None]}).to_csv(tmp_path / "t.csv", index=False)
    assert rows(read_tables(spark, {"t": str(tmp_path / "t.csv")}, "csv")["t"]) == {(1, "a"), (2, None)}


def test_definitions_are_checked(cube):
    for bad in (dict(name="", expression="[qty]"), dict(name="m", expression="")):
        with pytest.raises(ValueError):
            cube.define_metric(**bad)
    with pytest.raises(ValueError):
        cube.define_derived_metric("", "[x]")
    cube.define_metric("odd", "[nowhere]", "sum")
    with pytest.raises(ValueError):
        cube.query(options={"metrics": ["odd"]})
    cube.delete_metric("odd")
    assert "odd" not in cube.get_metrics() and cube.get_metric("Units")["aggregation"] == "sum" and cube.get_query("sales")["dimensions"][0] == "region"
