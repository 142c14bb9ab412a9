"""The cube end to end: golden results of the star, filters, states and the ways metrics are scoped."""

import pandas as pd
import pytest

from starloom import Hypercube


def rows(df):
    """A result as a set of tuples; NULL is None."""
    return {tuple(None if x is None or x != x else x for x in r) for r in df.collect()}


GOLDEN = {("North", "Electronics", "Launch", 2000, 4, 800, 2), ("North", "Home", "Discount", 225, 9, 90, 2), ("South", "Other", "No Promo", 2400, 3, 900, 1), ("West", "Electronics", "No Promo", 500, 1, 200, 1)}


def test_golden(cube):
    assert rows(cube.query("sales")) == GOLDEN


def test_golden_filtered_and_undone(cube):
    cube.filter({"customer_name": ["Initech"]})
    assert rows(cube.query("sales")) == {("North", "Electronics", "Launch", 1000, 2, 400, 1), ("North", "Home", "Discount", 100, 4, 40, 1)}
    assert cube.get_filters() == {"customer_name": ["Initech"]} and cube.get_filtered_dimensions() == ["customer_name"]
    assert cube.reset_filters("backward") and rows(cube.query("sales")) == GOLDEN
    assert cube.reset_filters("forward") and len(rows(cube.query("sales"))) == 2
    assert not cube.reset_filters("forward")
    assert cube.reset_filters("all") and rows(cube.query("sales")) == GOLDEN
    assert cube.reset_filters("backward") and len(rows(cube.query("sales"))) == 2
    with pytest.raises(ValueError):
        cube.reset_filters("sideways")


def test_live_filters_narrow_and_the_log_overwrites(cube):
    cube.filter({"region": ["North"]})
    cube.filter({"region": ["West"]})
    assert rows(cube.query("sales")) == set()
    cube.remove_filter(["segment"])
    assert {r[0] for r in rows(cube.query("sales"))} == {"West"}
    for _ in range(3):
        assert cube.reset_filters("backward")
    assert not cube.reset_filters("backward") and rows(cube.query("sales")) == GOLDEN


def test_unfiltered_cannot_change(cube):
    with pytest.raises(ValueError):
        cube.filter({"region": ["North"]}, context_state_name="Unfiltered")
    with pytest.raises(KeyError):
        cube.filter({"nowhere": [1]})


def test_context_states(cube):
    cube.set_context_state("other")
    cube.filter({"region": ["North"]})
    cube.filter({"region": ["West"]}, "other")
    cube.define_metric("Other", "[qty] * [price]", "sum", context_state_name="other")
    out = rows(cube.query(options={"dimensions": ["region"], "metrics": ["Revenue", "Other"]}))
    assert out == {("North", 2225, None), ("West", None, 500)}
    cube.define_metric("All", "[qty] * [price]", "sum", ignore_context_filters=True)
    assert ("South", None, 2400) in rows(cube.query(options={"dimensions": ["region"], "metrics": ["Revenue", "All"]}))


def test_ignore_some_filters(cube):
    cube.filter({"region": ["North"], "category": ["Home"]})
    cube.define_metric("Any category", "[qty] * [price]", "sum", ignore_context_filters=["category"])
    assert rows(cube.query(options={"dimensions": ["region"], "metrics": ["Revenue", "Any category"]})) == {("North", 225, 2225)}


def test_dimensions_and_query_filters(cube):
    assert rows(cube.dimensions(["region"])) == {("North",), ("West",), ("South",)}
    assert rows(cube.dimension("category", query_filters={"region": ["North"]})) == {("Electronics",), ("Home",)}
    assert rows(cube.dimensions(["customer_id"])) == {(100,), (101,), (102,), (103,)}


def test_ignore_dimensions(cube):
    cube.define_metric("Total", "[qty] * [price]", "sum", ignore_dimensions=True)
    cube.define_metric("By region", "[qty] * [price]", "sum", ignore_dimensions=["category"])
    cube.define_derived_metric("Share", "[Revenue] / [Total] * 100")
    out = rows(cube.query(options={"dimensions": ["region", "category"], "metrics": ["Revenue", "Total", "By region"], "derived_metrics": ["Share"]}))
    assert {r[:5]: round(r[5], 6) for r in out}["North", "Electronics", 2000, 5125, 2225] == round(2000 / 51.25, 6) and len(out) == 4


def test_grand_total_having_sort(cube):
    assert rows(cube.query(options={"metrics": ["Revenue", "Units"]})) == {(5125, 17)}
    df = cube.query(options={"dimensions": ["region"], "metrics": ["Revenue"], "having": "[Units] > 1 and [Revenue] >= 2225", "sort": [("Revenue", "desc")]})
    assert [tuple(r) for r in df.collect()] == [("South", 2400), ("North", 2225)]
    assert df.columns == ["region", "Revenue"]


def test_row_condition(cube):
    cube.define_metric("Big", "[qty]", "sum", row_condition_expression="[price] >= 500")
    cube.define_metric("Small", "[qty]", "sum", row_condition_expression="[price] < 100")
    assert rows(cube.query(options={"dimensions": ["category"], "metrics": ["Small"]})) == {("Home", 9)}
    assert rows(cube.query(options={"dimensions": ["category"], "metrics": ["Big", "Small"]})) == {("Electronics", 5, None), ("Other", 3, None), ("Home", None, 9)}
    assert rows(cube.query(options={"dimensions": ["category"], "metrics": ["Units", "Small"]})) == {("Electronics", 5, None), ("Other", 3, None), ("Home", 9, 9)}


def test_metric_filters(cube):
    cube.define_metric("North only", "[qty]", "sum", metric_filters={"region": ["North"]})
    assert rows(cube.query(options={"dimensions": ["category"], "metrics": ["Units", "North only"]})) == {("Electronics", 5, 4), ("Other", 3, None), ("Home", 9, 9)}


def test_nested(cube):
    cube.define_metric("Mean of customers", "[qty] * [price]", "mean", nested={"dimensions": ["customer_name"]})
    assert rows(cube.query(options={"dimensions": ["region"], "metrics": ["Mean of customers"]})) == {("North", 1112.5), ("West", 500), ("South", 2400)}
    cube.define_metric("List", "[qty]", "concat", nested={"dimensions": "customer_name", "compose": "{customer_name}: {value}"})
    assert ("North", "Acme Co: 7, Initech: 6") in rows(cube.query(options={"dimensions": ["region"], "metrics": ["List"]}))
    cube.define_metric("Calls", "[qty]", "concat", nested={"dimensions": "customer_name", "compose": lambda r: f"{r['customer_name']}={r['Calls']}"})
    assert ("West", "Globex=1") in rows(cube.query(options={"dimensions": ["region"], "metrics": ["Calls"]}))
    with pytest.raises(ValueError):
        cube.define_metric("x", "[qty]", "sum", nested={"dimensions": [], "more": 1})


def test_dangling_both_ways(spark):
    orders = pd.DataFrame({"order_id": [1, 2, 3, 4], "customer_id": [10, 10, 20, 30], "amount": [100.0, 200, 150, 50]})
    customers = pd.DataFrame({"customer_id": [10, 20, 40], "segment": ["A", "B", "C"]})
    cube = Hypercube({"Orders": orders, "Customers": customers}, spark=spark)
    cube.define_metric("Amount", "[amount]", "sum")
    cube.define_metric("Rows", "[amount]", "size")
    q = {"dimensions": ["segment"], "metrics": ["Amount", "Rows"]}
    assert rows(cube.query(options=q)) == {("A", 300, 2), ("B", 150, 1), ("C", 0, 1), (None, 50, 1)}
    assert rows(cube.query(options=q | {"drop_null_dimensions": True})) == {("A", 300, 2), ("B", 150, 1), ("C", 0, 1)}
    assert rows(cube.dimensions(["customer_id", "segment"])) == {(10, "A"), (20, "B"), (30, None), (40, "C")}
    cube.filter({"segment": [None, "C"]})
    assert rows(cube.query(options=q)) == {("C", 0, 1), (None, 50, 1)}
    matrix = {tuple(r) for r in cube.get_cardinalities().collect()}
    assert matrix == {("Orders", "Customers", "customer_id", "many-to-one", 3, 3, 2, 2, 1)}
    assert cube.get_cardinalities(include_inverse=True).count() == 2


def test_hub_metric_counts_values(spark):
    orders = pd.DataFrame({"customer_id": [10, 10, 20, 30], "amount": [1.0, 2, 3, 4]})
    customers = pd.DataFrame({"customer_id": [10, 20, 40], "segment": ["A", "B", "B"]})
    cube = Hypercube({"Orders": orders, "Customers": customers}, spark=spark)
    cube.define_metric("Customers", "[customer_id]", "count")
    cube.define_metric("Ordering", "[customer_id <Orders>]", "count")
    assert rows(cube.query(options={"metrics": ["Customers", "Ordering"]})) == {(4, 4)}
    assert rows(cube.query(options={"dimensions": ["segment"], "metrics": ["Customers", "Ordering"]})) == {("A", 1, 2), ("B", 2, 1), (None, 1, 1)}


def test_fan_out_does_not_inflate(spark):
    """Two facts on one hub: totals of one aren't multiplied by rows of the other."""
    orders = pd.DataFrame({"user": [1, 1, 2], "total": [10.0, 20, 5]})
    events = pd.DataFrame({"user": [1, 1, 1, 2, 3], "kind": ["a", "a", "b", "a", "b"]})
    cube = Hypercube({"orders": orders, "events": events}, spark=spark)
    cube.define_metric("Total", "[total]", "sum")
    assert rows(cube.query(options={"dimensions": ["kind"], "metrics": ["Total"]})) == {("a", 35), ("b", 30)}
    assert rows(cube.query(options={"metrics": ["Total"]})) == {(35,)}


def test_null_keys_meet_and_fillers_do_not(spark):
    a = spark.createDataFrame([(0, 0), (1, 1)], "i int, x int")
    b = spark.createDataFrame([(0, 0)], "i int, j int")
    c = spark.createDataFrame([(0, 0), (None, 1)], "j int, z int")
    cube = Hypercube({"A": a, "B": b, "C": c}, spark=spark)
    assert rows(cube.dimensions(["x", "i", "z"])) == {(0, 0, 0), (1, 1, None), (None, None, 1)}
    d = spark.createDataFrame([(None, 5)], "j int, w int")
    cube = Hypercube({"C": c, "D": d}, spark=spark)
    assert rows(cube.dimensions(["z", "w"])) == {(0, None), (1, 5)}


def test_composite_bridge(spark):
    t1 = pd.DataFrame({"A": [1, 2], "B": [10, 20], "v1": [100, 200]})
    t2 = pd.DataFrame({"A": [1, 3], "B": [10, 30], "v2": [300, 400]})
    t3 = pd.DataFrame({"A": [99], "C": [999]})
    cube = Hypercube({"t1": t1, "t2": t2, "t3": t3}, spark=spark)
    name = "_composite_t1_t2__by__A_B"
    assert list(cube.composite_tables) == [name]
    found = cube.composite_tables[name]
    assert set(found.columns) == {"A", "B", "_composite_key_A_B"}
    assert {(r["A"], r["B"]) for r in found.collect()} == {(1, 10), (2, 20), (3, 30)}
    assert rows(cube.dimensions(["A", "B", "v1", "v2"])) == {(1, 10, 100, 300), (2, 20, 200, None), (3, 30, None, 400), (99, None, None, None)}
    cube.define_metric("both", "[v1] + [v2]", "sum")
    assert rows(cube.query(options={"dimensions": ["A"], "metrics": ["both"]})) == {(1, 400), (2, 0), (3, 0), (99, 0)}
    assert rows(cube.dimensions(["C", "v1"])) == {(None, 100), (None, 200), (None, None), (999, None)}


def test_models_that_are_refused(spark):
    one, two, three = pd.DataFrame({"a": [1], "b": [1]}), pd.DataFrame({"b": [1], "c": [1]}), pd.DataFrame({"c": [1], "a": [1]})
    with pytest.raises(ValueError, match="Cyclic relationships"):
        Hypercube({"x": one, "y": two, "z": three}, spark=spark)
    with pytest.raises(ValueError, match="connected"):
        Hypercube({"x": one, "y": pd.DataFrame({"q": [1]})}, spark=spark)
    for bad in ({"_composite_x": one}, {"x": one.rename(columns={"a": "_key_a"})}, {"x": one.rename(columns={"a": "a <b>"})}):
        with pytest.raises(ValueError):
            Hypercube(bad, spark=spark)
    cyclic = Hypercube({"x": one, "y": two, "z": three}, spark=spark, validate=False)
    with pytest.raises(ValueError):
        cyclic.dimensions(["a"])


def test_six_tables_with_many_composites(spark):
    shape = {"orders": ["customer_id", "store_id", "order_date", "amount"], "visits": ["customer_id", "store_id", "visit_date"], "returns": ["customer_id", "store_id", "reason"], "shipments": ["store_id", "order_date", "product_id"], "inventory": ["store_id", "product_id", "on_hand"], "stores": ["store_id", "store_name"]}
    tables = {t: pd.DataFrame({c: ["x"] for c in cols}) for t, cols in shape.items()}
    cube = Hypercube(tables, validate=False, spark=spark)
    assert set(cube.composite_tables) == {"_composite_orders_returns_visits__by__customer_id_store_id", "_composite_orders_shipments__by__order_date_store_id", "_composite_inventory_shipments__by__product_id_store_id"}


def test_single_table_and_reload(spark):
    cube = Hypercube({"Sales": pd.DataFrame({"order_id": [1, 2, 3], "amount": [1.0, float("nan"), 3]})}, spark=spark)
    for how in ("sum", "count", "size"):
        cube.define_metric(how, "[amount]", how)
    assert rows(cube.query(options={"metrics": ["sum", "count", "size"]})) == {(4, 2, 3)}
    cube.load_data({"Sales": pd.DataFrame({"order_id": [1], "amount": [7.0]})})
    assert rows(cube.query(options={"metrics": ["sum"]})) == {(7,)}
    assert cube.get_relationship_matrix(core=True).count() == 1


def test_distinct_is_left_out_where_keys_are_unique(cube):
    plan = cube.query(options={"dimensions": ["region"], "metrics": ["Revenue", "Units"]})._jdf.queryExecution().optimizedPlan().toString()
    if cube.space.core is None:
        assert plan.count("Aggregate") == 1 and "monotonically" not in plan


def test_filters_reach_the_scan(spark, tmp_path, star):
    paths = {}
    for name, frame in star.items():
        paths[name] = str(tmp_path / name)
        spark.createDataFrame(frame).write.parquet(paths[name])
    from starloom.sources.readers import read_tables

    cube = Hypercube(read_tables(spark, paths), spark=spark)
    cube.define_metric("Revenue", "[qty] * [price]", "sum")
    cube.filter({"segment": ["SMB"]})
    plan = cube.query(options={"dimensions": ["region"], "metrics": ["Revenue"]})._jdf.queryExecution().executedPlan().toString()
    assert "IsNotNull(segment)" in plan or "EqualTo(segment,SMB)" in plan or "In(segment" in plan
    assert "category" not in plan
