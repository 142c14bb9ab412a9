"""Context states: named filter states with a log that can be undone and redone. No data is held."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import date, datetime
from decimal import Decimal
from typing import Any

#: A filter: column -> allowed values. A state's predicates are a list of them, all of which must hold.
Criteria = dict[str, list]


def as_values(values: Any) -> list:
    """A filter's values as a list; a single value is a list of one."""
    return list(values) if isinstance(values, (list, tuple, set, frozenset)) else [values]


def as_criteria(criteria: dict[str, Any] | None) -> Criteria:
    return {c: as_values(v) for c, v in (criteria or {}).items()}


def _tagged(value: Any) -> Any:
    """What JSON has no form for, as JSON: dates and times by their names, numbers of other libraries as numbers."""
    if isinstance(value, datetime):
        return {"datetime": value.isoformat()}
    if isinstance(value, date):
        return {"date": value.isoformat()}
    if isinstance(value, Decimal):
        return {"decimal": str(value)}
    if hasattr(value, "item"):
        return value.item()
    raise TypeError(f"A filter on {value!r} can't be kept")


def _plain(value: Any) -> Any:
    """What _tagged was made from."""
    forms = {"datetime": datetime.fromisoformat, "date": date.fromisoformat, "decimal": Decimal}
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        tag = next(iter(value)) if len(value) == 1 else None
        return forms[tag](value[tag]) if tag in forms and isinstance(value[tag], str) else {k: _plain(v) for k, v in value.items()}
    return value


@dataclass
class ContextState:
    """The predicates that hold now, and the log of what led to them.

    Successive filters on one column narrow the state (both hold). The log folds differently: the last filter on a
    column stands, and that is what undo, redo and removal rebuild from.
    """

    base: list[tuple[str, list]] = field(default_factory=list)
    predicates: list[tuple[str, list]] = field(default_factory=list)
    log: list[tuple[str, Any]] = field(default_factory=list)  # ("add", criteria) or ("remove", columns)
    pointer: int = 0

    def copy(self) -> ContextState:
        """A new state with these predicates and an empty log."""
        now = [*self.base, *self.predicates]
        return ContextState(base=now)

    def active(self, offset: int = 0) -> Criteria:
        """The filters that the log stands for, up to the pointer plus offset (0 or less)."""
        out: Criteria = {}
        for op, what in self.log[: max(0, self.pointer + offset)]:
            for c in what:
                out.pop(c, None)
            if op == "add":
                out.update(what)
        return out

    def _append(self, op: str, what: Any) -> None:
        self.log = [*self.log[: self.pointer], (op, what)]
        self.pointer += 1

    def rebuild(self) -> None:
        self.predicates = list(self.active().items())

    def add(self, criteria: Criteria, logged: bool = True) -> None:
        self.predicates = [*self.predicates, *criteria.items()]
        if logged:
            self._append("add", criteria)

    def remove(self, columns: list[str]) -> None:
        self._append("remove", columns)
        self.rebuild()

    def undo(self) -> bool:
        if self.pointer == 0:
            return False
        self.pointer -= 1
        self.rebuild()
        return True

    def redo(self) -> bool:
        if self.pointer == len(self.log):
            return False
        self.pointer += 1
        self.rebuild()
        return True

    def clear(self) -> bool:
        """Log the removal of every active filter, so that clearing can be undone."""
        active = list(self.active())
        if active or self.predicates:
            self.remove(active)
        return True

    def spec(self) -> dict[str, Any]:
        """The state as plain data."""
        return json.loads(json.dumps(asdict(self), default=_tagged))

    @classmethod
    def from_spec(cls, spec: dict[str, Any]) -> ContextState:
        pairs = lambda rows: [(first, _plain(second)) for first, second in rows]
        return cls(pairs(spec["base"]), pairs(spec["predicates"]), pairs(spec["log"]), spec["pointer"])

    @property
    def all_predicates(self) -> list[tuple[str, list]]:
        return [*self.base, *self.predicates]
