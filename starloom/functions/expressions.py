"""The bracket expression language, compiled to Spark columns.

`[name]` is a column, `@name` a registered function, module or value; the rest is Python's expression syntax as it
would act on whole columns: arithmetic, comparisons, and/or/not, in, methods such as .fillna, .str.upper, .dt.year, and
numpy functions. A comparison with NULL is False (!= is True). Division by zero is NULL. What has no built-in Spark
equal runs as a vectorised pandas UDF.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from dataclasses import dataclass
from typing import Any

import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .registry import FunctionRegistry

TOKEN = re.compile(r"""('(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|\[([^\[\]]*)\]|@""")


class ExpressionError(ValueError):
    """An expression that can't be compiled, or names what isn't there."""


@dataclass
class Typed:
    """A compiled expression. kind: number, string, bool, date, list or other; raw: a condition that may be NULL where
    it is not true; strict: NULL whenever a column it reads is NULL; value: a constant."""

    col: Column
    kind: str
    raw: Column | None = None
    strict: bool = True
    value: Any = None
    constant: bool = False

    @property
    def condition(self) -> Column:
        return self.raw if self.raw is not None else F.coalesce(self.col.cast("boolean"), F.lit(False))


def kind_of(t: T.DataType) -> str:
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.StringType, T.VarcharType, T.CharType)):
        return "string"
    return "date" if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) else "other"


def columns_in(*expressions: str | None) -> list[str]:
    """The names in brackets, in order, each once. Lists of constants aren't names."""
    out: dict[str, None] = {}
    for text in expressions:
        for quoted, name in (m.groups() for m in TOKEN.finditer(text or "")):
            if not quoted and name is not None and not is_list(name):
                out[name] = None
    return list(out)


def is_list(inside: str) -> bool:
    """Whether what stands in brackets is a list of constants."""
    try:
        return isinstance(ast.literal_eval(f"[{inside}]"), list)
    except (ValueError, SyntaxError):
        return False


def parse(text: str) -> tuple[ast.expr, list[str]]:
    """The syntax tree, with names for columns (_c0, ..) and registered names (_f_ before them)."""
    names = columns_in(text)

    def swap(m: re.Match) -> str:
        quoted, name = m.groups()
        if quoted:
            return quoted
        if name is None:
            return "_f_"
        return f"[{name}]" if is_list(name) else f"_c{names.index(name)}"

    try:
        return ast.parse(TOKEN.sub(swap, text.strip()), mode="eval").body, names
    except SyntaxError as e:
        raise ExpressionError(f"{text!r} isn't an expression: {e.msg}") from e


STR_METHODS: dict[str, Callable[..., tuple[Column, str]]] = {
    "upper": lambda c: (F.upper(c), "string"),
    "lower": lambda c: (F.lower(c), "string"),
    "len": lambda c: (F.length(c), "number"),
    "strip": lambda c: (F.regexp_replace(c, r"^\s+|\s+$", ""), "string"),
    "title": lambda c: (F.initcap(c), "string"),
    "startswith": lambda c, x: (F.startswith(c, F.lit(x)), "bool"),
    "endswith": lambda c, x: (F.endswith(c, F.lit(x)), "bool"),
    "contains": lambda c, x, regex=True: (F.rlike(c, F.lit(x)) if regex else F.contains(c, F.lit(x)), "bool"),
    "replace": lambda c, a, b, regex=False: (F.regexp_replace(c, a, b) if regex else F.replace(c, F.lit(a), F.lit(b)), "string"),
}
DT_FIELDS: dict[str, Callable[[Column], Column]] = {
    "year": F.year, "month": F.month, "day": F.dayofmonth, "quarter": F.quarter, "hour": F.hour, "minute": F.minute,
    "second": F.second, "dayofweek": F.weekday, "weekday": F.weekday, "dayofyear": F.dayofyear,
}
#: strftime's codes and Spark's patterns: fixed values.
DATE_CODES = {"%Y": "yyyy", "%m": "MM", "%d": "dd", "%H": "HH", "%M": "mm", "%S": "ss", "%y": "yy", "%b": "MMM", "%B": "MMMM", "%j": "DDD", "%a": "EEE"}
FLOORS = {"D": "day", "h": "hour", "H": "hour", "min": "minute", "T": "minute", "s": "second", "S": "second"}
MATH: dict[str, Callable[..., Column]] = {
    "abs": F.abs, "absolute": F.abs, "exp": F.exp, "sign": F.signum, "sin": F.sin, "cos": F.cos, "tan": F.tan,
    "floor": lambda c: F.floor(c).cast("double"), "ceil": lambda c: F.ceil(c).cast("double"),
    "sqrt": lambda c: F.when(c >= 0, F.sqrt(c)), "log": lambda c: F.when(c > 0, F.ln(c)),
    "log10": lambda c: F.when(c > 0, F.log10(c)), "log2": lambda c: F.when(c > 0, F.log2(c)),
    "log1p": lambda c: F.when(c > -1, F.log1p(c)), "round": lambda c, n=0: F.bround(c, n), "around": lambda c, n=0: F.bround(c, n),
}
CASTS = {"int": "long", "int64": "long", "int32": "int", "float": "double", "float64": "double", "str": "string", "string": "string", "bool": "boolean"}
CAST_KINDS = {"long": "number", "int": "number", "double": "number", "string": "string", "boolean": "bool"}
WINDOWED = {"rank", "cumsum", "cummax", "cummin", "shift", "diff", "pct_change"}
WHOLE = {"sum": F.sum, "mean": F.avg, "min": F.min, "max": F.max, "std": F.stddev_samp, "var": F.var_samp, "count": F.count, "median": F.median}


class Compiler:
    """Compiles expressions over columns of known types.

    columns: name -> (Column, type). order: the columns that give rows of a result an order, for .cumsum and the
    like; None where rows have none. wholes: receives (alias, aggregate) for .sum() and the like, which need a row of
    totals joined to the frame; None where they make no sense.
    """

    def __init__(self, columns: dict[str, tuple[Column, T.DataType]], registry: FunctionRegistry, *, order: list[Column] | None = None, wholes: dict[str, Column] | None = None, fillna: Any = None) -> None:
        self.columns, self.registry, self.order, self.wholes, self.fillna = columns, registry, order, wholes, fillna

    def compile(self, text: str) -> Typed:
        tree, self.names = parse(text)
        self.text = text
        return self.visit(tree)

    def value(self, text: str) -> Column:
        return self.compile(text).col

    def condition(self, text: str) -> Column:
        return self.compile(text).condition

    def filled(self, made: Typed) -> Column:
        """A result with fillna where it is missing, too, as in 0 / 0; a fill of another kind is for the columns only."""
        fill = self._literal(self.fillna)
        return F.coalesce(made.col, fill.col) if fill.kind == made.kind else made.col

    def fail(self, what: str) -> ExpressionError:
        return ExpressionError(f"{what} in {self.text!r}")

    def visit(self, node: ast.expr) -> Typed:
        method = getattr(self, "_" + type(node).__name__.lower(), None)
        if method is None:
            raise self.fail(f"{type(node).__name__} isn't supported")
        return method(node)

    # --- leaves ------------------------------------------------------------------------------------------------

    def _constant(self, node: ast.Constant) -> Typed:
        return self._literal(node.value)

    def _literal(self, v: Any) -> Typed:
        kind = "bool" if isinstance(v, bool) else "number" if isinstance(v, (int, float)) else "string" if isinstance(v, str) else "other"
        if kind == "other" and v is not None and not hasattr(v, "year"):
            raise self.fail(f"{type(v).__name__} values aren't supported")
        return Typed(F.lit(v), kind, value=v, constant=True)

    def _name(self, node: ast.Name) -> Typed:
        if m := re.fullmatch(r"_c(\d+)", node.id):
            name = self.names[int(m[1])]
            if name not in self.columns:
                raise self.fail(f"Unknown column [{name}]")
            c, t = self.columns[name]
            if self.fillna is not None:
                return Typed(F.coalesce(c, F.lit(self.fillna)), kind_of(t), strict=False)
            return Typed(c, kind_of(t))
        found = self._object(node)
        if callable(found):
            raise self.fail("A function must be called")
        return self._literal(found)

    def _object(self, node: ast.expr) -> Any:
        """The registered object that a dotted name stands for; None if the node isn't one."""
        parts = []
        while isinstance(node, ast.Attribute):
            parts.append(node.attr)
            node = node.value
        if not isinstance(node, ast.Name) or node.id.startswith("_c") and node.id[2:].isdigit():
            return None
        name = node.id.removeprefix("_f_")
        found = self.registry.find(".".join([name, *reversed(parts)]))
        if found is None:
            raise self.fail(f"Unknown name {'.'.join([name, *reversed(parts)])}")
        return found

    def _tuple(self, node: ast.Tuple | ast.List) -> Typed:
        items = [self.visit(x) for x in node.elts]
        if not all(x.constant for x in items):
            raise self.fail("Lists may hold constants only")
        return Typed(F.lit(None), "list", value=[x.value for x in items], constant=True)

    _list = _set = _tuple

    # --- operators ---------------------------------------------------------------------------------------------

    @staticmethod
    def _number(x: Typed) -> Column:
        return x.col.cast("long") if x.kind == "bool" else x.col

    def _binop(self, node: ast.BinOp) -> Typed:
        a, b, op = self.visit(node.left), self.visit(node.right), type(node.op)
        strict = a.strict and b.strict
        if op in (ast.BitAnd, ast.BitOr):
            if a.kind == b.kind == "bool":
                return self._truth(a.condition & b.condition if op is ast.BitAnd else a.condition | b.condition)
            x, y = self._number(a), self._number(b)
            return Typed(x.bitwiseAND(y) if op is ast.BitAnd else x.bitwiseOR(y), "number", strict=strict)
        if op is ast.Add and "string" in (a.kind, b.kind):
            return Typed(F.concat(a.col.cast("string"), b.col.cast("string")), "string", strict=strict)
        x, y = self._number(a), self._number(b)
        if op is ast.Add:
            out = x + y
        elif op is ast.Sub:
            out = x - y
        elif op is ast.Mult:
            out = x * y
        elif op is ast.Div:
            out = F.try_divide(x.cast("double"), y.cast("double"))
        elif op is ast.FloorDiv:
            out = F.floor(F.try_divide(x.cast("double"), y.cast("double")))
        elif op is ast.Mod:  # the sign is the divisor's
            out = F.when(y != 0, x - y * F.floor(F.try_divide(x.cast("double"), y.cast("double"))))
        elif op is ast.Pow:
            out = F.pow(x, y)
        else:
            raise self.fail(f"{op.__name__} isn't supported")
        return Typed(out, a.kind if a.kind == "date" else "number", strict=strict)

    def _unaryop(self, node: ast.UnaryOp) -> Typed:
        x = self.visit(node.operand)
        if isinstance(node.op, (ast.Not, ast.Invert)):
            return self._truth(~F.coalesce(x.condition, F.lit(False)))
        if x.constant and isinstance(node.op, ast.USub):
            return self._literal(-x.value)
        return Typed(-self._number(x), "number", strict=x.strict) if isinstance(node.op, ast.USub) else x

    def _truth(self, raw: Column) -> Typed:
        return Typed(F.coalesce(raw, F.lit(False)), "bool", raw=raw, strict=False)

    def _boolop(self, node: ast.BoolOp) -> Typed:
        out = self.visit(node.values[0]).condition
        for x in node.values[1:]:
            out = out & self.visit(x).condition if isinstance(node.op, ast.And) else out | self.visit(x).condition
        return self._truth(out)

    def _compare(self, node: ast.Compare) -> Typed:
        raw, left = None, self.visit(node.left)
        for op, right_node in zip(node.ops, node.comparators):
            right = self.visit(right_node)
            one = self._compared(type(op), left, right)
            raw, left = one if raw is None else raw & one, right
        return self._truth(raw)

    def _compared(self, op: type, a: Typed, b: Typed) -> Column:
        if op in (ast.In, ast.NotIn) or b.kind == "list":
            if b.kind != "list":
                raise self.fail("`in` needs a list of constants")
            found = self._isin(a.col, b.value)
            return ~F.coalesce(found, F.lit(False)) if op in (ast.NotIn, ast.NotEq) else found
        if op is ast.NotEq:
            return F.coalesce(a.col != b.col, F.lit(True))
        compare = {ast.Eq: Column.__eq__, ast.Lt: Column.__lt__, ast.LtE: Column.__le__, ast.Gt: Column.__gt__, ast.GtE: Column.__ge__}
        if op not in compare:
            raise self.fail(f"{op.__name__} isn't supported")
        return compare[op](a.col, b.col)

    @staticmethod
    def _isin(c: Column, values: list) -> Column:
        real = [v for v in values if v is not None and v == v]
        return c.isin(real) | c.isNull() if len(real) < len(values) else c.isin(real)

    # --- attributes and calls ----------------------------------------------------------------------------------

    def _attribute(self, node: ast.Attribute) -> Typed:
        if isinstance(node.value, ast.Attribute) and node.value.attr == "dt":
            x = self.visit(node.value.value)
            if node.attr == "date":
                return Typed(F.to_date(x.col), "date", strict=x.strict)
            if node.attr in DT_FIELDS:
                return Typed(DT_FIELDS[node.attr](x.col), "number", strict=x.strict)
            return self._pandas(lambda s: getattr(s.dt, node.attr), [x])
        found = self._object(node)
        if found is None or callable(found):
            raise self.fail(f".{node.attr} isn't supported")
        return self._literal(found)

    def _call(self, node: ast.Call) -> Typed:
        args = [self.visit(x) if not self._type_name(x) else Typed(F.lit(None), "type", value=x.id, constant=True) for x in node.args]
        kwargs = {k.arg: self.visit(k.value) for k in node.keywords}
        if isinstance(node.func, ast.Name):
            return self._function(node.func.id, self._object(node.func), args, kwargs)
        if not isinstance(node.func, ast.Attribute):
            raise self.fail("Only names and methods can be called")
        inner = node.func.value
        base = inner
        while isinstance(base, ast.Attribute):
            base = base.value
        if isinstance(base, ast.Name) and not (base.id.startswith("_c") and base.id[2:].isdigit()):
            dotted = ast.unparse(node.func)
            return self._function(dotted, self._object(node.func), args, kwargs)
        if isinstance(inner, ast.Attribute) and inner.attr in ("str", "dt"):
            return self._accessor(inner.attr, node.func.attr, self.visit(inner.value), args, kwargs)
        return self._method(node.func.attr, self.visit(inner), args, kwargs)

    @staticmethod
    def _type_name(node: ast.expr) -> bool:
        return isinstance(node, ast.Name) and node.id in ("int", "float", "str", "bool")

    def _constants(self, args: list[Typed], kwargs: dict[str, Typed]) -> tuple[list, dict]:
        if not all(x.constant for x in [*args, *kwargs.values()]):
            raise self.fail("Arguments must be constants")
        return [x.value for x in args], {k: x.value for k, x in kwargs.items()}

    def _accessor(self, which: str, name: str, x: Typed, args: list[Typed], kwargs: dict[str, Typed]) -> Typed:
        given, named = self._constants(args, kwargs)
        if which == "str" and name == "slice":
            start, stop = (*given, None, None)[:2]
            if (start or 0) >= 0 and (stop is None or stop >= 0) and not named:
                length = F.length(x.col) if stop is None else F.lit(max(0, stop - (start or 0)))
                return Typed(F.substring(x.col, F.lit((start or 0) + 1), length), "string", strict=x.strict)
        if which == "str" and name in STR_METHODS:
            try:
                c, kind = STR_METHODS[name](x.col, *given, **named)
                return self._truth(c) if kind == "bool" else Typed(c, kind, strict=x.strict)
            except TypeError:
                pass  # other arguments: pandas
        if which == "dt" and name == "strftime" and not set(re.findall("%.", given[0])) - set(DATE_CODES):
            pattern = "".join(DATE_CODES[p] if p in DATE_CODES else re.sub(r"[A-Za-z]+", r"'\g<0>'", p) for p in re.split("(%.)", given[0]))
            return Typed(F.date_format(x.col, pattern), "string", strict=x.strict)
        if which == "dt" and name == "floor" and given and given[0] in FLOORS:
            return Typed(F.date_trunc(FLOORS[given[0]], x.col), "date", strict=x.strict)
        return self._pandas(lambda s: getattr(getattr(s, which), name)(*given, **named), [x])

    def _method(self, name: str, x: Typed, args: list[Typed], kwargs: dict[str, Typed]) -> Typed:
        if name == "isin":
            return self._truth(self._isin(x.col, args[0].value))
        if name in ("isna", "isnull"):
            return self._truth(x.col.isNull())
        if name in ("notna", "notnull"):
            return self._truth(x.col.isNotNull())
        if name == "fillna":
            return Typed(F.coalesce(x.col, args[0].col), x.kind, strict=False)
        if name == "abs":
            return Typed(F.abs(x.col), "number", strict=x.strict)
        if name == "round":
            return Typed(F.bround(x.col, self._constants(args, kwargs)[0][0] if args else 0), "number", strict=x.strict)
        if name == "clip":
            low, high = [*args, None, None][:2]
            low, high = low or kwargs.get("lower"), high or kwargs.get("upper")
            out = x.col
            for bound, pick in ((low, F.greatest), (high, F.least)):
                if bound is not None and not (bound.constant and bound.value is None):
                    out = F.when(x.col.isNotNull(), pick(out, bound.col))
            return Typed(out, x.kind, strict=x.strict)
        if name == "between":
            return self._truth((x.col >= args[0].col) & (x.col <= args[1].col))
        if name == "astype":
            to = CASTS.get(str(args[0].value))
            if to is None:
                raise self.fail(f"astype({args[0].value}) isn't supported")
            return Typed(x.col.cast(to), CAST_KINDS[to], strict=x.strict)
        if name in ("where", "mask"):
            other = args[1].col if len(args) > 1 else F.lit(None)
            holds = F.coalesce(args[0].condition, F.lit(False))
            return Typed(F.when(holds if name == "where" else ~holds, x.col).otherwise(other), x.kind, strict=False)
        if name in WINDOWED:
            return self._windowed(name, x, args, kwargs)
        if name in WHOLE and not args and not kwargs:
            if self.wholes is None:
                raise self.fail(f".{name}() needs an aggregated result")
            alias = f"_whole_{len(self.wholes)}"
            self.wholes[alias] = WHOLE[name](self._number(x))
            return Typed(F.col(alias), "number", strict=False)
        given, named = self._constants(args, kwargs)
        if name in ("add", "sub", "mul", "div", "truediv", "pow", "mod", "eq", "ne", "lt", "le", "gt", "ge", "map"):
            return self._pandas(lambda s: getattr(s, name)(*given, **named), [x])
        raise self.fail(f".{name}() isn't supported")

    def _windowed(self, name: str, x: Typed, args: list[Typed], kwargs: dict[str, Typed]) -> Typed:
        """Functions over the whole result, in the order of its dimensions."""
        if self.order is None:
            raise self.fail(f".{name}() needs an aggregated result")
        given, named = self._constants(args, kwargs)
        if name == "rank":
            ascending, method = named.get("ascending", True), named.get("method", "average")
            w = Window.orderBy(x.col.asc_nulls_last() if ascending else x.col.desc_nulls_last())
            ties = F.count(x.col).over(Window.partitionBy(x.col))
            ranks = {"dense": F.dense_rank().over(w), "min": F.rank().over(w), "max": F.rank().over(w) + ties - 1, "average": F.rank().over(w) + (ties - 1) / 2, "first": F.row_number().over(w.orderBy(x.col.asc_nulls_last() if ascending else x.col.desc_nulls_last(), *self.order))}
            if method not in ranks:
                raise self.fail(f"rank method {method!r} isn't supported")
            return Typed(F.when(x.col.isNotNull(), ranks[method].cast("double")), "number", strict=False)
        w = Window.orderBy(*self.order)
        upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
        n = given[0] if given else named.get("periods", 1)
        before = F.lag(x.col, n).over(w) if n >= 0 else F.lead(x.col, -n).over(w)
        out = {
            "cumsum": lambda: F.when(x.col.isNotNull(), F.sum(x.col).over(upto)),
            "cummax": lambda: F.when(x.col.isNotNull(), F.max(x.col).over(upto)),
            "cummin": lambda: F.when(x.col.isNotNull(), F.min(x.col).over(upto)),
            "shift": lambda: before,
            "diff": lambda: x.col - before,
            "pct_change": lambda: F.try_divide(x.col.cast("double"), before.cast("double")) - 1,
        }[name]()
        return Typed(out, x.kind, strict=False)

    def _function(self, dotted: str, f: Any, args: list[Typed], kwargs: dict[str, Typed]) -> Typed:
        module, _, name = dotted.removeprefix("_f_").rpartition(".")
        strict = all(x.strict for x in args)
        if module in ("np", "numpy"):
            if name in MATH and not kwargs:
                more, _ = self._constants(args[1:], {})
                return Typed(MATH[name](self._number(args[0]), *more), "number", strict=strict)
            if name == "where" and len(args) == 3:
                return Typed(F.when(F.coalesce(args[0].condition, F.lit(False)), args[1].col).otherwise(args[2].col), args[1].kind, strict=False)
            if name in ("minimum", "maximum"):
                both = args[0].col.isNotNull() & args[1].col.isNotNull()
                return Typed(F.when(both, (F.least if name == "minimum" else F.greatest)(args[0].col, args[1].col)), "number", strict=strict)
            if name == "power":
                return Typed(F.pow(args[0].col, args[1].col), "number", strict=strict)
            if name in ("isnan", "isnull"):
                return self._truth(args[0].col.isNull())
        if module in ("pd", "pandas"):
            if name in ("isnull", "isna"):
                return self._truth(args[0].col.isNull())
            if name in ("notnull", "notna"):
                return self._truth(args[0].col.isNotNull())
            if name == "to_datetime" and len(args) == 1 and not kwargs:
                return Typed(args[0].col.cast("timestamp_ntz"), "date", strict=strict)
            if name == "to_numeric":
                return Typed(args[0].col.try_cast("double"), "number", strict=strict)
            if name == "Series" and len(args) == 1:
                return args[0]
        if not callable(f):
            raise self.fail(f"{dotted.removeprefix('_f_')} can't be called")
        _, named = self._constants([], kwargs)
        return self._pandas(lambda *s: f(*s, **named), args, getattr(f, "return_type", None), f)

    def _pandas(self, f: Callable, args: list[Typed], return_type: str | None = None, original: Any = None) -> Typed:
        """A pandas UDF over the columns among the arguments; its type is found by a trial on one made-up row."""
        given = [x for x in args if not x.constant]
        if not given:
            raise self.fail("A function needs a column")
        fixed = [(x.constant, x.value) for x in args]

        def call(*series: pd.Series):
            rest = iter(series)
            out = f(*(v if constant else next(rest) for constant, v in fixed))
            return out if isinstance(out, pd.Series) else pd.Series(out, index=series[0].index)

        returns = return_type or annotated_type(original) or trial_type(call, given)
        kind = kind_of(T._parse_datatype_string(returns))
        udf = F.pandas_udf(lambda *s: call(*s), returns)
        out = udf(*(x.col for x in given))
        return self._truth(out) if kind == "bool" else Typed(out, kind, strict=False)


SAMPLES = {"number": 1.5, "string": "a", "bool": True, "date": pd.Timestamp("2020-01-01"), "other": "a", "list": "a"}


def annotated_type(f: Any) -> str | None:
    """The Spark type of a function's return annotation: float, int, str or bool."""
    return {float: "double", int: "long", str: "string", bool: "boolean"}.get(getattr(f, "__annotations__", {}).get("return"))


def trial_type(call: Callable, args: list[Typed]) -> str:
    """The Spark type of what a function makes of one row of made-up values; double if it fails on them."""
    try:
        out = call(*(pd.Series([SAMPLES[x.kind]]) for x in args))
    except Exception as e:
        raise ExpressionError(f"can't find a function's type ({e}): annotate what it returns, or set its return_type") from e
    if pd.api.types.is_bool_dtype(out):
        return "boolean"
    if pd.api.types.is_integer_dtype(out) and not any(x.kind == "number" for x in args):
        return "long"
    if pd.api.types.is_numeric_dtype(out):
        return "double"
    if pd.api.types.is_datetime64_any_dtype(out):
        return "timestamp_ntz"
    return "string"
