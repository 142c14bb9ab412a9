"""Model catalogs: definitions by kind and name, in YAML files or in memory."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterable, Iterator
from copy import deepcopy
from pathlib import Path
from typing import Any

import yaml

Spec = dict[str, Any]
Kinds = dict[str, dict[str, Spec]]
#: Sections that may stand inside a query: fixed values.
NESTED = ("plots", "transformers")


class Source(ABC):
    """Where definitions come from and are saved to."""

    @abstractmethod
    def load(self) -> Kinds: ...

    @abstractmethod
    def save(self, data: Kinds) -> None: ...

    def kinds(self) -> list[str]:
        return list(self.load())

    def iter_definitions(self, kind: str) -> Iterator[tuple[str, Spec]]:
        yield from self.load().get(kind, {}).items()

    def get(self, kind: str, name: str) -> Spec | None:
        return self.load().get(kind, {}).get(name)


class YAMLSource(Source):
    """One YAML file: kind -> name -> definition. A missing file is empty. Loaded definitions carry kind and name."""

    def __init__(self, path: str | Path) -> None:
        self.path, self._data = Path(path), None

    def reload(self) -> None:
        self._data = None

    def load(self) -> Kinds:
        if self._data is None:
            raw = yaml.safe_load(self.path.read_text(encoding="utf-8")) if self.path.exists() else None
            self._data = self.after_load(raw or {})
        return deepcopy(self._data)

    def save(self, data: Kinds) -> None:
        out = {k: v for k, v in self.before_save(deepcopy(data)).items() if v}
        self.path.parent.mkdir(parents=True, exist_ok=True)
        self.path.write_text(yaml.safe_dump(out, sort_keys=False, allow_unicode=True), encoding="utf-8")
        self.reload()

    def after_load(self, raw: Kinds) -> Kinds:
        return {kind: {name: {**(spec or {}), "kind": kind, "name": name} for name, spec in (specs or {}).items()} for kind, specs in raw.items()}

    def before_save(self, data: Kinds) -> Kinds:
        return {kind: {_plain_name(name, spec): {k: v for k, v in spec.items() if k not in ("kind", "name")} for name, spec in specs.items()} for kind, specs in data.items()}


class ModelYAMLSource(YAMLSource):
    """A model's YAML file: plots and transformers may stand at the top, with the query they belong to, or inside it.

    Loading lifts them out; saving puts those of known queries back inside, for the sections that are to be nested.
    Two queries may use one name: lifted entries are then kept apart by the query's name.
    """

    def __init__(self, path: str | Path, prefer_nested_plots: bool = True, prefer_nested_transformers: bool = True) -> None:
        super().__init__(path)
        self.nest = {"plots": prefer_nested_plots, "transformers": prefer_nested_transformers}

    def after_load(self, raw: Kinds) -> Kinds:
        out = {kind: {name: dict(spec or {}) for name, spec in (specs or {}).items()} for kind, specs in raw.items()}
        for section in NESTED:
            found = {}
            for key, spec in out.get(section, {}).items():
                found[key] = {**_with_params(section, spec), "name": key.removeprefix(f"{spec.get('query')}:")}
            for query, spec in out.get("queries", {}).items():
                for name, inner in (spec.pop(section, None) or {}).items():
                    key = name if name not in found else f"{query}:{name}"
                    found[key] = {**_with_params(section, inner or {}), "query": query, "name": name}
            if found:
                out[section] = found
        return {kind: {key: {"kind": kind, "name": key, **spec} for key, spec in specs.items()} for kind, specs in out.items()}

    def before_save(self, data: Kinds) -> Kinds:
        out = {kind: {} for kind in data}
        for kind, specs in data.items():
            for key, spec in specs.items():
                plain = {k: v for k, v in spec.items() if k not in ("kind", "name")}
                name, query = spec.get("name", key), plain.get("query")
                if kind in NESTED and self.nest[kind] and query in data.get("queries", {}):
                    plain.pop("query")
                    inner = out.setdefault("queries", {}).setdefault(query, {})
                    inner.setdefault(kind, {})[name] = plain.get("params", plain) if kind == "transformers" else plain
                elif kind == "transformers":
                    params = plain.get("params", {k: v for k, v in plain.items() if k != "query"})
                    out[kind][key] = {**params, **({"query": query} if query else {})}
                else:
                    out[kind][key] = {**out[kind].get(key, {}), **plain} if kind == "queries" else plain
        return out


def _plain_name(key: str, spec: Spec) -> str:
    return spec.get("name", key)


def _with_params(section: str, spec: Spec) -> Spec:
    """A transformer's definition as {params, query}; plots stay."""
    if section == "plots":
        return dict(spec)
    params = spec["params"] if isinstance(spec.get("params"), dict) else {k: v for k, v in spec.items() if k not in ("query", "kind", "name")}
    return {"params": dict(params), **({"query": spec["query"]} if spec.get("query") else {})}


class Repository(ABC):
    @abstractmethod
    def put(self, kind: str, name: str, spec: Spec) -> None: ...

    @abstractmethod
    def get(self, kind: str, name: str) -> Spec | None: ...

    @abstractmethod
    def list(self, kind: str) -> list[str]: ...

    @abstractmethod
    def delete(self, kind: str, name: str) -> None: ...


class InMemoryRepository(Repository):
    def __init__(self) -> None:
        self._data: Kinds = {}

    def add_kind(self, kind: str) -> None:
        self._data.setdefault(kind, {})

    def put(self, kind: str, name: str, spec: Spec) -> None:
        self._data.setdefault(kind, {})[name] = dict(spec)

    def update(self, kind: str, name: str, changes: Spec) -> None:
        if name not in self._data.get(kind, {}):
            raise KeyError(f"{kind} has no {name!r}")
        self._data[kind][name].update(changes)

    def get(self, kind: str, name: str) -> Spec | None:
        return deepcopy(self._data.get(kind, {}).get(name))

    def list(self, kind: str) -> list[str]:
        return list(self._data.get(kind, {}))

    def delete(self, kind: str, name: str) -> None:
        self._data.get(kind, {}).pop(name, None)

    def get_all(self) -> Kinds:
        return deepcopy(self._data)

    def clear(self) -> None:
        self._data = {}


class Catalog:
    """Sources merged into a repository, the last one winning; saving goes to all sources."""

    def __init__(self, sources: Iterable[Source], repo: InMemoryRepository | None = None) -> None:
        self.sources, self.repo = list(sources), repo or InMemoryRepository()

    def refresh(self, kinds: Iterable[str] | None = None, clear: bool = False, reload: bool = True) -> None:
        if clear:
            self.repo.clear()
        for source in self.sources:
            if reload and isinstance(source, YAMLSource):
                source.reload()
            for kind, specs in source.load().items():
                if kinds is None or kind in kinds:
                    self.repo.add_kind(kind)
                    for name, spec in specs.items():
                        self.repo.put(kind, name, spec)

    def get(self, kind: str, name: str) -> Spec | None:
        return self.repo.get(kind, name)

    def list_kinds(self) -> list[str]:
        return list(self.repo.get_all())

    def list(self, kind: str) -> list[str]:
        return self.repo.list(kind)

    def add_kind(self, kind: str) -> None:
        self.repo.add_kind(kind)

    def add(self, kind: str, name: str, spec: Spec) -> None:
        self.repo.put(kind, name, spec)

    def update(self, kind: str, name: str, changes: Spec) -> None:
        self.repo.update(kind, name, changes)

    def delete(self, kind: str, name: str) -> None:
        self.repo.delete(kind, name)

    def save(self, data: Kinds | None = None) -> None:
        for source in self.sources:
            source.save(self.repo.get_all() if data is None else data)
