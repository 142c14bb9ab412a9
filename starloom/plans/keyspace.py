"""The key space: the full outer join of all tables along the link tree, planned over the part a query needs.

A query's tables span a subtree; only that is joined. Where something outside the subtree matches nothing inside, the
full join has one more, all-NULL row in the query's columns. Facts about keys (unique, free of NULLs, always matched)
weaken full joins to left, right or inner ones, which Catalyst can reorder and broadcast. They are declared, or found
by one aggregation over a shared column's keys in all its tables when a plan first needs them; with declared facts
only, planning runs no job and what isn't known is left to the plan.
"""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import LinkModel, hub_node, is_hub

#: Other tables, at most, of a shared column for which all sets of them are looked up at once.
SUBSETS = 4

_fallback: dict[str, str] = {}


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def col(name: str) -> Column:
    return F.col(quoted(name))


def write_and_read(df: DataFrame, label: str) -> DataFrame:
    """df as a Parquet table in the shared folder named by spark.checkpoint.dir (a temporary one on a local master)."""
    spark = df.sparkSession
    top = spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        top = _fallback.setdefault("dir", tempfile.mkdtemp(prefix="starloom-"))
    path = f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def common_type(types: list[T.DataType]) -> T.DataType:
    """One type in which keys of these types compare."""
    if all(t == types[0] for t in types):
        return types[0]
    if all(isinstance(t, T.IntegralType) for t in types):
        return T.LongType()
    if all(isinstance(t, T.NumericType) for t in types):
        return T.DoubleType()
    if all(isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)) for t in types):
        return T.TimestampNTZType()
    return T.StringType()


def membership(name: str, values: list) -> Column:
    """The filter `name` in values; a NULL or NaN among the values lets NULL pass."""
    real = [v for v in values if v is not None and v == v]
    found = col(name).isin(real)
    return found | col(name).isNull() if len(real) < len(values) else found


def admits_null(values: list) -> bool:
    return any(v is None or v != v for v in values)


class KeySpace:
    """Joined frames over a link model's tables, and what is known about their keys."""

    def __init__(self, spark: SparkSession, model: LinkModel, tables: dict[str, DataFrame], *, statistics: str = "auto", stored: bool = False) -> None:
        if statistics not in ("auto", "declared"):
            raise ValueError("statistics must be 'auto' or 'declared'")
        self.spark, self.model, self.statistics = spark, model, statistics
        self.tables = {t: self._clean(df) for t, df in tables.items()}
        self.key_types: dict[str, list[T.DataType]] = {}
        for h, hub in model.hubs.items():
            per_place = zip(*([self._type(t, c) for c in cols] for t, cols in hub.source.items()))
            self.key_types[h] = [common_type(list(x)) for x in per_place]
        self._unique: dict[tuple[str, str], bool] = {}
        self._nulls: dict[tuple[str, str], bool] = {}
        self._dangling: dict[tuple, bool] = {}
        self.core: DataFrame | None = None
        if stored:
            visible = {c for c, node in model.owner.items()}
            self.core = write_and_read(self.frame(visible, set(model.tables), []), "core")

    @staticmethod
    def _clean(df: DataFrame) -> DataFrame:
        """NaN counts as NULL."""
        floats = {f.name: F.nanvl(col(f.name), F.lit(None)) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        return df.withColumns(floats) if floats else df

    def _type(self, table: str, column: str) -> T.DataType:
        source = self.model.composites[table].participants[0] if table in self.model.composites else table
        return self.tables[source].schema[column].dataType

    def type_of(self, name: str) -> T.DataType:
        """The type of a visible column."""
        node = self.model.owner[name]
        if is_hub(node):
            types = self.key_types[name]
            return types[0] if len(types) == 1 else T.StringType()
        return self._type(node, self.model.physical[node][name])

    # --- tables and keys ---------------------------------------------------------------------------------------

    def rows(self, table: str) -> DataFrame:
        """A table's rows; those of a composite bridge are the distinct combinations of its participants."""
        if table not in self.model.composites:
            return self.tables[table]
        bridge = self.model.composites[table]
        types = {c: common_type([self.tables[t].schema[c].dataType for t in bridge.participants]) for c in bridge.columns}
        parts = [self.tables[t].select(*(col(c).cast(types[c]).alias(c) for c in bridge.columns)) for t in bridge.participants]
        return reduce(DataFrame.unionByName, parts).distinct()

    def key(self, table: str, hub: str, plain: bool = False) -> Column:
        """A table's key for a hub: never NULL, so that NULL values match as values do; plain: the bare column."""
        cols = [col(c).cast(t) for c, t in zip(self.model.hubs[hub].source[table], self.key_types[hub])]
        return cols[0] if plain else F.struct(*(c.alias(f"k{i}") for i, c in enumerate(cols)))

    def declare_keys(self, table: str, columns: list[str] | str) -> None:
        """The user's word that these columns hold no NULL and no repeated combination in this table."""
        names = tuple([columns] if isinstance(columns, str) else columns)
        for h, hub in self.model.hubs.items():
            if set(hub.source.get(table, ())) == set(names):
                self._unique[table, h], self._nulls[table, h] = True, False

    def declare_matched(self, table: str, other: str, column: str) -> None:
        """The user's word that every row of table has its key of this shared column in other."""
        self._dangling[table, column, frozenset([other])] = False

    def forget(self) -> None:
        """Forget all facts, declared ones too."""
        for memory in (self._unique, self._nulls, self._dangling):
            memory.clear()

    def unique(self, table: str, hub: str) -> bool:
        """Whether no key of the hub is in two rows of the table; taken as false where it may not be looked up."""
        if table in self.model.composites and set(self.model.hubs[hub].source[table]) == set(self.model.composites[table].columns):
            return True
        if (table, hub) not in self._unique:
            if self.statistics == "declared":
                return False
            self._learn([hub])
        return self._unique[table, hub]

    def has_nulls(self, table: str, hub: str) -> bool:
        if (table, hub) not in self._nulls:
            if self.statistics == "declared":
                return True
            self._learn([hub])
        return self._nulls[table, hub]

    def plain_key(self, hub: str, tables: list[str]) -> bool:
        """Whether a single-column key may be compared as it is: NULLs of one table alone meet nothing."""
        return len(self.key_types[hub]) == 1 and sum(self.has_nulls(t, hub) for t in tables) <= 1

    def dangling(self, table: str, hub: str, others: list[str]) -> bool:
        """Whether some row of table has a key that none of the others has; taken as true where it may not be looked
        up."""
        if any(o in self.model.composites and table in self.model.composites[o].participants for o in others):
            return False
        case = (table, hub, frozenset(others))
        if case not in self._dangling and self.statistics == "declared":
            return True
        if case not in self._dangling:
            self._learn([hub])
        if case not in self._dangling:  # a set of tables that _learn leaves out
            self._dangling[case] = not self._unmatched(table, hub, others).isEmpty()
        return self._dangling[case]

    def _unmatched(self, table: str, hub: str, others: list[str]) -> DataFrame:
        """The keys of table's rows that none of the others has."""
        keys = reduce(DataFrame.union, (self.rows(o).select(self.key(o, hub).alias("k")) for o in others))
        return self.rows(table).select(self.key(table, hub).alias("k")).join(keys, "k", "left_anti")

    def _learn(self, hubs: list[str]) -> None:
        """All facts about the keys of these shared columns, in one job with one shuffle of counted keys a column.
        What is declared stays as declared."""
        found, facts = [], {}
        for h in hubs:
            tables = list(self.model.hubs[h].source)
            tagged = reduce(DataFrame.union, (self.rows(t).select(F.lit(i).alias("t"), self.key(t, h).alias("k")) for i, t in enumerate(tables)))
            counts = tagged.groupBy("k").agg(*(F.count_if(F.col("t") == i).alias(f"n{i}") for i in range(len(tables))))
            null = reduce(Column.__or__, (F.col("k").getField(f"k{i}").isNull() for i in range(len(self.key_types[h]))))
            has = [F.col(f"n{i}") > 0 for i in range(len(tables))]
            facts[h] = [(self._unique, (t, h), F.max(f"n{i}") <= 1) for i, t in enumerate(tables)]
            facts[h] += [(self._nulls, (t, h), F.bool_or(null & has[i])) for i, t in enumerate(tables)]
            for i, t in enumerate(tables):
                rest = [o for o in range(len(tables)) if o != i]
                for n in range(1, len(rest) + 1) if len(rest) <= SUBSETS else (1,):
                    for some in combinations(rest, n):
                        alone = F.bool_or(has[i] & ~reduce(Column.__or__, (has[o] for o in some)))
                        facts[h].append((self._dangling, (t, h, frozenset(tables[o] for o in some)), alone))
            found.append(counts.agg(F.array(*(F.coalesce(f, F.lit(m is self._unique)) for m, _, f in facts[h])).alias("found")).select(F.lit(h).alias("hub"), "found"))
        for row in reduce(DataFrame.union, found).collect() if found else []:  # a row a shared column
            for (memory, case, _), value in zip(facts[row["hub"]], row["found"]):
                memory.setdefault(case, value)

    def analyze(self) -> None:
        """Find all facts about keys in one job; the plans are the same as if each were found when it is needed."""
        self._learn([h for h, hub in self.model.hubs.items() if len(hub.source) > 1])

    # --- joined frames -----------------------------------------------------------------------------------------

    def frame(self, columns: set[str], index: set[str], predicates: list[tuple[str, list]]) -> DataFrame:
        """The key space's rows that satisfy the predicates, with these columns and the row ids of these tables."""
        wanted = sorted(columns) + [f"_index_{t}" for t in sorted(index)]
        condition = reduce(Column.__and__, (membership(c, v) for c, v in predicates)) if predicates else None
        if self.core is not None:
            out = self.core.where(condition) if condition is not None else self.core
            return out.select(*(col(c) for c in wanted))
        needed = columns | {c for c, _ in predicates}
        unknown = sorted(c for c in needed if c not in self.model.owner)
        if unknown:
            raise KeyError(f"Unknown columns: {unknown}")
        nodes = self.model.subtree({self.model.owner[c] for c in needed} | index)
        selected = {c for c in needed if is_hub(self.model.owner[c])}
        root = min(index & nodes or {n for n in nodes if not is_hub(n)} or nodes, key=self._rank)
        plan = _Subtree(self, nodes, needed, index, selected, [p for p in predicates if not admits_null(p[1])])
        out = plan.build(root, None)[0]
        if all(admits_null(v) for _, v in predicates):
            loose = self._loose_edges(nodes, selected)
            empty = self.spark.range(1)
            if loose and self.statistics == "declared":  # the plan finds out
                rows = reduce(DataFrame.union, (self._unmatched(*edge).select(F.lit(1)).limit(1) for edge in loose))
                empty = empty.join(rows, how="left_semi")
            if loose:
                out = out.unionByName(empty.select(*(F.lit(None).cast(f.dataType).alias(f.name) for f in out.schema.fields)))
        if condition is not None:
            out = out.where(condition)
        return out.select(*(col(c) for c in wanted))

    def _rank(self, table: str) -> tuple:
        """The joins' root is the least: the table on the many side of most of its links."""
        hubs = [] if is_hub(table) else [n[1:] for n in self.model.neighbours(table)]
        keyed = sum(self.unique(table, h) for h in hubs if len(self.model.hubs[h].source) > 1)
        return keyed, -len(hubs), table

    def _loose_edges(self, nodes: set[str], selected: set[str]) -> list[tuple[str, str, list[str]]]:
        """(table, shared column, tables): edges over which a row of the full join over all tables may be NULL in
        everything of this subtree, as a key of the table is in none of the others. The first one found will do."""
        seen, todo, loose = set(nodes), [(n, None) for n in nodes], []
        while todo:
            node, towards = todo.pop()
            for n in self.model.neighbours(node):
                if n in seen:
                    continue
                seen.add(n)
                if not is_hub(node):
                    todo.append((n, node))
                    continue
                # n is a table beyond a hub: on the way to the subtree lie the hub's tables inside it, or one table
                todo.append((n, None))
                hub = node[1:]
                inside = [t for t in self.model.hubs[hub].source if t in nodes] if node in nodes else [towards]
                if not (node in nodes and hub in selected) and self.dangling(n, hub, inside):
                    loose.append((n, hub, inside))
                    if self.statistics != "declared":
                        return loose
        return loose

    def fans_out(self, trajectory: set[str], nodes: set[str], selected: set[str]) -> bool:
        """Whether joining the subtree may repeat a row of the trajectory's tables: some step away from them is not to
        a unique key."""
        seen, todo = set(trajectory), list(trajectory)
        while todo:
            node = todo.pop()
            for n in self.model.neighbours(node):
                if n in nodes and n not in seen:
                    seen.add(n)
                    todo.append(n)
                    if is_hub(node) and not self.unique(n, node[1:]):
                        return True
        return False


class _Subtree:
    """One frame's joins: from the leaves to the root, so that the root is joined last."""

    def __init__(self, space: KeySpace, nodes: set[str], columns: set[str], index: set[str], selected: set[str], predicates: list[tuple[str, list]]) -> None:
        self.space, self.model = space, space.model
        self.nodes, self.columns, self.index, self.selected = nodes, columns, index, selected
        self.predicates = predicates
        self.plain = {h: space.plain_key(h, [t for t in hub.source if t in nodes or h in selected]) for h, hub in self.model.hubs.items() if hub_node(h) in nodes}

    def _hubs(self, node: str, parent: str | None) -> list[str]:
        return [n for n in self.model.neighbours(node) if n in self.nodes and n != parent]

    def _table(self, table: str) -> DataFrame:
        """A table's needed columns, keys and row id; filters on its own columns come first, to reach the scan."""
        out = self.space.rows(table)
        names = self.model.physical[table]
        for c, values in self.predicates:
            if self.model.owner[c] == table:
                out = out.where(membership(names[c], values))
        own = [col(p).alias(c) for c, p in names.items() if c in self.columns]
        keys = [self.space.key(table, n[1:], self.plain[n[1:]]).alias("_key_" + n[1:]) for n in self.model.neighbours(table) if n in self.nodes]
        bridge = self.model.composites.get(table)
        row_id = F.struct(*(col(c) for c in bridge.columns)) if bridge else F.monotonically_increasing_id()
        ids = [row_id.alias(f"_index_{table}")] if table in self.index else []
        return out.select(*own, *keys, *ids)

    def _value(self, hub: str, key: Column) -> Column:
        return key if self.plain[hub] else key.getField("k0")

    def build(self, node: str, parent: str | None) -> tuple[DataFrame, bool]:
        """(frame, whether it has rows without a row of this node)."""
        return self._hub(node, parent) if is_hub(node) else self._from_table(node, parent)

    def _from_table(self, table: str, parent: str | None) -> tuple[DataFrame, bool]:
        out, partial = self._table(table), False
        for node in self._hubs(table, parent):
            hub, key = node[1:], "_key_" + node[1:]
            found = self._hub(node, table)
            if found[0] is None:  # nothing beyond: the hub's value is the table's own
                if hub in self.selected:
                    out = out.withColumn(hub, self._value(hub, col(key)))
                out = out.drop(key)
                continue
            other, other_partial = found
            beyond = [n for n in self.model.neighbours(node) if n in self.nodes and n != table]
            simple = len(beyond) == 1 and hub not in self.selected
            right = other_partial or not simple or self.space.dangling(beyond[0], hub, [table])
            left = partial or not simple or self.space.dangling(table, hub, beyond)
            how = "full" if left and right else "left" if left else "right" if right else "inner"
            other = other.withColumnRenamed(key, "_other_key")
            out = out.join(other, col(key) == col("_other_key"), how)
            if hub in self.selected:
                out = out.withColumn(hub, self._value(hub, F.coalesce(col(key), col("_other_key"))))
            out = out.drop(key, "_other_key")
            partial = partial or right
        return out, partial

    def _hub(self, node: str, parent: str | None) -> tuple[DataFrame | None, bool]:
        """What lies beyond a hub, with its key: the tables there and, if its value is asked for, all other keys."""
        hub, key = node[1:], "_key_" + node[1:]
        out, partial = None, False
        for table in self._hubs(node, parent):
            other, other_partial = self._from_table(table, node)
            out, partial = self._merge(out, other, key), partial or other_partial
        outside = [t for t in self.model.hubs[hub].source if t not in self.nodes]
        if hub in self.selected and outside:
            keys = [self.space.rows(t).select(self.space.key(t, hub, self.plain[hub]).alias(key)) for t in outside]
            out = self._merge(out, reduce(DataFrame.union, keys).distinct(), key)
            partial = True
        if parent is None and out is not None:
            out = out.withColumn(hub, self._value(hub, col(key))).drop(key)
        return out, partial

    @staticmethod
    def _merge(left: DataFrame | None, right: DataFrame, key: str) -> DataFrame:
        if left is None:
            return right
        right = right.withColumnRenamed(key, "_other_key")
        out = left.join(right, col(key) == col("_other_key"), "full")
        return out.withColumn(key, F.coalesce(col(key), col("_other_key"))).drop("_other_key")
