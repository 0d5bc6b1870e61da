"""Parameters: one nested, unchangeable map from several JSON files, read by dotted names and known by its hash."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Mapping
from dataclasses import dataclass
from types import MappingProxyType
from typing import Any


def _frozen(x: Any) -> Any:
    if isinstance(x, Mapping):
        return MappingProxyType({str(k): _frozen(v) for k, v in x.items()})
    return tuple(map(_frozen, x)) if isinstance(x, (list, tuple)) else x


def _plain(x: Any) -> Any:
    return {k: _plain(v) for k, v in x.items()} if isinstance(x, Mapping) else [_plain(v) for v in x] if isinstance(x, tuple) else x


@dataclass(frozen=True)
class Params:
    values: Mapping[str, Any]

    @classmethod
    def of(cls, *parts: Mapping[str, Any]) -> Params:
        """Parts side by side; a top name in two of them is refused."""
        out: dict[str, Any] = {}
        for part in parts:
            if twice := set(out) & set(part):
                raise ValueError(f"in two parts: {sorted(twice)}")
            out |= part
        return cls(_frozen(out))

    @classmethod
    def load(cls, *texts: str) -> Params:
        """From JSON texts, as read from the parameter files."""
        return cls.of(*map(json.loads, texts))

    def get(self, name: str, default: Any = None) -> Any:
        at: Any = self.values
        for part in name.split("."):
            if not isinstance(at, Mapping) or part not in at:
                return default
            at = at[part]
        return at

    def require(self, name: str) -> Any:
        """The value; a missing name or a null is refused."""
        value = self.get(name)
        if value is None:
            raise KeyError(name)
        return value

    def override(self, name: str, value: Any) -> Params:
        """These parameters with one value exchanged; a name that is not there is refused."""
        if self.get(name, self) is self:
            raise KeyError(name)
        whole = _plain(self.values)
        *path, last = name.split(".")
        at = whole
        for part in path:
            at = at[part]
        at[last] = value
        return Params(_frozen(whole))

    def first(self, cell: Mapping[str, Any], name: str, param: str) -> Any:
        """A cell's own value, else the parameters', else None."""
        own = cell.get(name)
        return self.get(param) if own is None else own

    @property
    def sha256(self) -> str:
        return hashlib.sha256(json.dumps(_plain(self.values), sort_keys=True, separators=(",", ":")).encode()).hexdigest()
