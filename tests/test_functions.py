"""The expression language and the aggregations, against pandas."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from starloom.functions.aggregates import resolve
from starloom.functions.expressions import Compiler, ExpressionError, columns_in
from starloom.functions.registry import FunctionRegistry

NULL = None


@pytest.fixture(scope="module")
def table(spark):
    rows = [(1, -7, 2.5, "Abc", True, "2024-03-05 10:30:00"), (2, 7, NULL, "xyz", False, "2023-12-31 23:59:59"), (3, 0, -1.5, NULL, NULL, NULL), (4, 3, 0.0, " a b ", True, "2024-01-01 00:00:00")]
    return spark.createDataFrame(rows, "id int, n int, x double, s string, b boolean, t string").withColumn("t", F.col("t").cast("timestamp_ntz")).cache()


def run(table, text, registry=None, **more):
    compiler = Compiler({f.name: (F.col(f.name), f.dataType) for f in table.schema.fields}, registry or FunctionRegistry(), **more)
    return [r[0] for r in table.select(compiler.value(text).alias("v"), "id").orderBy("id").collect()]


CASES = [
    ("[n] + 1", [-6, 8, 1, 4]), ("[n] / 2", [-3.5, 3.5, 0.0, 1.5]), ("[n] / [x]", [-2.8, NULL, -0.0, NULL]),
    ("[n] // 2", [-4, 3, 0, 1]), ("[n] % 3", [2, 1, 0, 0]), ("[n] ** 2", [49, 49, 0, 9]), ("-[n]", [7, -7, 0, -3]),
    ("[x] > 0", [True, False, False, False]), ("[x] != 0", [True, True, True, False]), ("not ([x] > 0)", [False, True, True, True]),
    ("~([x] > 0)", [False, True, True, True]), ("0 < [n] <= 7", [False, True, False, True]), ("([n] > 0) & ([x] == 0)", [False, False, False, True]),
    ("[n] > 0 or [b]", [True, True, False, True]), ("[s] in ('xyz', 'q')", [False, True, False, False]), ("[s] in ['xyz', None]", [False, True, True, False]),
    ("[s] not in ['xyz']", [True, False, True, True]), ("[n].isin((3, 7))", [False, True, False, True]), ("[x].fillna(9)", [2.5, 9.0, -1.5, 0.0]),
    ("[x].isna()", [False, True, False, False]), ("@pd.notnull([x])", [True, False, True, True]), ("[n].abs()", [7, 7, 0, 3]),
    ("[n].clip(-1, 5)", [-1, 5, 0, 3]), ("[x].round(0)", [2.0, NULL, -2.0, 0.0]), ("[n].between(0, 5)", [False, False, True, True]),
    ("@np.where([n] > 0, [n], 0)", [0, 7, 0, 3]), ("@np.sqrt([n])", [NULL, math.sqrt(7), 0.0, math.sqrt(3)]), ("@np.maximum([n], [x])", [2.5, NULL, 0.0, 3.0]),
    ("[s].str.upper()", ["ABC", "XYZ", NULL, " A B "]), ("[s].str.len()", [3, 3, NULL, 5]), ("[s].str.strip()", ["Abc", "xyz", NULL, "a b"]),
    ("[s].str.contains('b')", [True, False, False, True]), ("[s].str.startswith('x')", [False, True, False, False]), ("[s].str.replace('b', '-')", ["A-c", "xyz", NULL, " a - "]),
    ("[s].str.slice(1, 3)", ["bc", "yz", NULL, "a "]), ("[s].str.zfill(6)", ["000Abc", "000xyz", NULL, "0 a b "]), ("[s] + '!'", ["Abc!", "xyz!", NULL, " a b !"]),
    ("[t].dt.year", [2024, 2023, NULL, 2024]), ("[t].dt.dayofweek", [1, 6, NULL, 0]), ("[t].dt.strftime('%Y-%m')", ["2024-03", "2023-12", NULL, "2024-01"]),
    ("[t] >= '2024-01-01'", [True, False, False, True]), ("[n].astype(str)", ["-7", "7", "0", "3"]), ("[n].where([n] > 0)", [NULL, 7, NULL, 3]),
    ("[b] + 1", [2, 1, NULL, 2]), ("@twice([n])", [-14, 14, 0, 6]), ("[n] * @factor", [-70, 70, 0, 30]), ("@np.hypot([n], [n])", [math.hypot(7, 7), math.hypot(7, 7), 0.0, math.hypot(3, 3)]),
]


@pytest.mark.parametrize("text,want", CASES, ids=[c[0] for c in CASES])
def test_expressions(table, text, want):
    got = run(table, text, FunctionRegistry({"twice": lambda s: s * 2, "factor": 10}))
    assert [g if not isinstance(g, float) else pytest.approx(g) for g in got] == want


def test_fillna_and_errors(table):
    assert run(table, "[x] + 1", fillna=0) == [3.5, 1.0, -0.5, 1.0]
    for bad in ("[nope] + 1", "[n] +", "@nope([n])", "[n].frobnicate()", "[s] in [t]", "lambda: 1", "__import__('os')", "[n].__class__"):
        with pytest.raises(ExpressionError):
            run(table, bad)
    assert columns_in("[a b] in ['x', 'y'] and '[no]' == [c]", None) == ["a b", "c"]


def test_whole_result_functions(table):
    order = [F.col("id")]
    assert run(table, "[n].cumsum()", order=order) == [-7, 0, 0, 3]
    assert run(table, "[n].shift(1)", order=order) == [NULL, -7, 7, 0]
    assert run(table, "[n].diff()", order=order) == [NULL, 14, -7, 3]
    assert run(table, "@pd.Series([x]).rank(ascending=False, method='dense')", order=order) == [1, NULL, 3, 2]
    with pytest.raises(ExpressionError):
        run(table, "[n].cumsum()")


VALUES = {"a": [1.0, 2.0, 2.0, None, 9.0], "b": [None, None], "c": [4.0]}
NAMES = ["sum", "mean", "avg", "min", "max", "median", "std", "var", "count", "size", "first", "last", "prod", "nunique", "count distinct", "skew", "sem", "quantile"]


@pytest.mark.parametrize("how", NAMES)
def test_aggregates_like_pandas(spark, how):
    data = [(i, g, v) for i, (g, v) in enumerate((g, v) for g, vs in VALUES.items() for v in vs)]
    df = spark.createDataFrame(data, "i int, g string, v double")
    got = {r[0]: r[1] for r in df.groupBy("g").agg(resolve(how, FunctionRegistry()).column(F.col("v"), "number", F.col("i"))).collect()}
    pandas_name = {"avg": "mean", "count distinct": "nunique"}.get(how, how)
    want = pd.DataFrame(data, columns=["i", "g", "v"]).groupby("g")["v"].agg(pandas_name)
    for g in VALUES:
        if pd.isna(want[g]):
            assert got[g] is None
        else:
            assert got[g] == pytest.approx(want[g])


def test_other_aggregates(spark):
    df = spark.createDataFrame([(1, "x", True), (2, None, None), (3, "y", False)], "i int, s string, b boolean")
    one = lambda how, c, kind: df.agg(resolve(how, FunctionRegistry({"spread": lambda s: s.max() - s.min()})).column(F.col(c), kind, F.col("i"))).first()[0]
    assert one("concat", "s", "string") == "x, y"
    assert one("any", "b", "bool") is True and one("all", "b", "bool") is False
    assert one("sum", "b", "bool") == 1
    assert one("spread", "i", "number") == 2 and one("np.nanmean", "i", "number") == 2
    assert one(lambda s: float(np.sum(s)), "i", "number") == 6
    for bad in ("frobnicate", ["sum", "min"], 3):
        with pytest.raises(ExpressionError):
            resolve(bad, FunctionRegistry())


def test_registry_specs():
    registry = FunctionRegistry({"dumps": math.sqrt, "lost": lambda x: x})
    specs = registry.specs()
    assert specs["np"] == "module:numpy" and "lost" not in specs
    again = FunctionRegistry.from_specs(specs | {"gone": "obj:no_such_module:f"})
    assert again["np"] is np and "gone" not in again


def test_weighted_python_aggregates_take_distinct_values(spark):
    from starloom.functions.aggregates import reduced
    from starloom.queries import percentile_90

    rng = np.random.default_rng(1)
    data = [(g, float(v) if v else None) for g, n in (("a", 500), ("b", 7), ("c", 1)) for v in rng.integers(0, 9, n)] + [("d", None), (None, 2.0), (None, 4.0)]
    df = spark.createDataFrame(data, "g string, v double")
    aggregate = resolve("p90", FunctionRegistry({"p90": percentile_90}))
    got = dict(map(tuple, reduced(df, [F.col("g")], aggregate, F.col("v"), "number", F.lit(0), "x").collect()))
    want = pd.DataFrame(data, columns=["g", "v"]).groupby("g", dropna=False)["v"].quantile(0.9)
    assert len(got) == 5 and got["d"] is None and got[None] == pytest.approx(3.8)
    assert all(got[g] == (None if pd.isna(want[g]) else pytest.approx(want[g])) for g in "abc")

    def seen(values, counts):
        return len(values)

    seen.weighted = True
    most = dict(map(tuple, reduced(df, [F.col("g")], resolve(seen, FunctionRegistry()), F.col("v"), "number", F.lit(0), "x").collect()))
    assert most["a"] == 8 and most["d"] == 0
