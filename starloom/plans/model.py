"""The link graph of a cube, from column names alone: hubs, composite bridges, cycle and connection checks.

Nodes are tables (base tables and composite bridges) and hubs (one a shared column); edges join a table to the hubs of
its shared columns. The graph must be one tree. No Spark job runs here.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field
from itertools import combinations

#: Prefixes that table and column names of the user must not have.
RESERVED_TABLES = ("_link_table_", "_composite_")
RESERVED_COLUMNS = ("_key_", "_index_", "_composite_key_")


@dataclass(frozen=True)
class Composite:
    """A bridge over the tables that share `columns`: its rows are their distinct combinations."""

    name: str
    columns: tuple[str, ...]
    participants: tuple[str, ...]  # the tables whose combinations it holds

    @property
    def key(self) -> str:
        return "_composite_key_" + "_".join(self.columns)


@dataclass(frozen=True)
class Hub:
    """A shared column; `source` gives, of each participant, the physical columns that make up its key."""

    name: str
    source: dict[str, tuple[str, ...]] = field(hash=False)

    @property
    def participants(self) -> tuple[str, ...]:
        return tuple(self.source)


class LinkModel:
    """Tables' columns to hubs, composites and the owners of column names."""

    def __init__(self, columns: dict[str, list[str]], *, rename_shared: bool = True, apply_composite: bool = True, validate: bool = True) -> None:
        if validate:
            check_names(columns)
        self.input_columns = {t: list(c) for t, c in columns.items()}
        self.composites: dict[str, Composite] = {}
        visible = {t: list(c) for t, c in columns.items()}
        self.composite_of: dict[str, list[Composite]] = {t: [] for t in columns}
        if apply_composite:
            self._bridge(visible)
        self.physical: dict[str, dict[str, str]] = {}  # table -> output name -> column of the user's table
        self.hubs: dict[str, Hub] = {}
        self._link(visible, rename_shared)
        self.edges = {(t, h.name) for h in self.hubs.values() for t in h.source}
        self.cyclic = self._is_cyclic()
        if self.cyclic and validate:
            raise ValueError("Cyclic relationships detected: rename or drop a shared column so that the tables form a tree")
        self.parts = self._parts()
        if validate and not self.cyclic and len(self.parts) > 1:
            raise ValueError(f"Tables aren't connected by shared columns: {sorted(map(sorted, self.parts))}")

    @property
    def tables(self) -> list[str]:
        return [*self.input_columns, *self.composites]

    def _bridge(self, visible: dict[str, list[str]]) -> None:
        """Composite bridges for column sets that two tables share. Sets are taken in sorted order: the first that a
        table holds takes its columns, so that a later, overlapping one no longer applies to it."""
        sets = {tuple(sorted(set(visible[a]) & set(visible[b]))) for a, b in combinations(visible, 2)}
        for combo in sorted(s for s in sets if len(s) >= 2):
            members = tuple(t for t, c in self.input_columns.items() if set(combo) <= set(c))
            name = unique_name("_composite_" + "_".join(sorted(members)) + "__by__" + "_".join(combo), self.composites)
            self.composites[name] = composite = Composite(name, combo, members)
            for t in members:
                if set(combo) <= set(visible[t]):
                    visible[t] = [c for c in visible[t] if c not in combo]
                    self.composite_of[t].append(composite)

    def _link(self, visible: dict[str, list[str]], rename_shared: bool) -> None:
        shown = visible | {n: list(c.columns) for n, c in self.composites.items()}
        holders: dict[str, list[str]] = {}
        for t, cols in shown.items():
            for c in cols:
                holders.setdefault(c, []).append(t)
        for c, tables in holders.items():
            if len(tables) > 1:
                self.hubs[c] = Hub(c, {t: (c,) for t in tables})
        for composite in self.composites.values():
            keyed = [t for t in visible if composite in self.composite_of[t]]
            self.hubs[composite.key] = Hub(composite.key, {t: composite.columns for t in [*keyed, composite.name]})
        self.owner: dict[str, str] = {}
        for t, cols in self.input_columns.items():
            taken = {c for composite in self.composite_of[t] for c in composite.columns}
            names = {}
            for c in cols:
                if c not in taken and c not in self.hubs:
                    names[c] = c
                elif rename_shared:
                    names[f"{c} <{t}>"] = c
            self.physical[t] = names
            self.owner.update(dict.fromkeys(names, t))
        for name, composite in self.composites.items():
            own = {c: c for c in composite.columns if c not in self.hubs}
            self.physical[name] = own
            self.owner.update(dict.fromkeys(own, name))
        self.owner.update({h: hub_node(h) for h in self.hubs})

    def neighbours(self, node: str) -> list[str]:
        if is_hub(node):
            return list(self.hubs[node[1:]].source)
        return [hub_node(h.name) for h in self.hubs.values() if node in h.source]

    def _parts(self) -> list[set[str]]:
        left, out = set(self.tables), []
        while left:
            seen, todo = set(), [min(left)]
            while todo:
                node = todo.pop()
                if node not in seen:
                    seen.add(node)
                    todo += self.neighbours(node)
            out.append({n for n in seen if not is_hub(n)})
            left -= seen
        return out

    def _is_cyclic(self) -> bool:
        """A graph is a forest if it has as many edges as nodes less parts."""
        return len(self.edges) > len(self.tables) + len(self.hubs) - len(self._parts())

    def subtree(self, wanted: set[str]) -> set[str]:
        """The nodes of the least subtree that holds all wanted nodes."""
        if not wanted:
            return set()
        start = min(wanted)
        seen, todo = {start}, [start]
        while todo:
            for n in self.neighbours(todo.pop()):
                if n not in seen:
                    seen.add(n)
                    todo.append(n)
        if wanted - seen:
            raise ValueError(f"No path between {start} and {sorted(wanted - seen)}")
        nodes = seen
        while leaves := [n for n in nodes if n not in wanted and sum(m in nodes for m in self.neighbours(n)) <= 1]:
            nodes = nodes - set(leaves)
        return nodes

    def dimensions(self) -> list[str]:
        """The visible columns: what tables own and shared columns, without keys and renamed copies."""
        return sorted(c for c in self.owner if not c.startswith(RESERVED_COLUMNS) and not re.search(r"<.*>", c))


def hub_node(name: str) -> str:
    return "\0" + name


def is_hub(node: str) -> bool:
    return node.startswith("\0")


def unique_name(name: str, taken) -> str:
    n, out = 1, name
    while out in taken:
        n += 1
        out = f"{name}__{n}"
    return out


def check_names(columns: dict[str, list[str]]) -> None:
    for t, cols in columns.items():
        if t.startswith(RESERVED_TABLES):
            raise ValueError(f"Table name {t!r} begins with a reserved prefix {RESERVED_TABLES}")
        for c in cols:
            if c.startswith(RESERVED_COLUMNS):
                raise ValueError(f"Column {c!r} of table {t!r} begins with a reserved prefix {RESERVED_COLUMNS}")
            if re.search(r"<.*>", c):
                raise ValueError(f"Column {c!r} of table {t!r}: names with <...> are reserved")
        if len(set(cols)) != len(cols):
            raise ValueError(f"Table {t!r} has repeated column names")
