"""The configuration of a project: canonical fields, rules, sources, keys, limits, output and targets.

Every section refuses keys that it doesn't know. A file that still holds PROPOSED markers isn't accepted.
"""

from __future__ import annotations

import re
from dataclasses import MISSING, dataclass, field, fields
from datetime import date, datetime
from pathlib import Path
from typing import Any

from quern.functions.coerce import TYPES

OPERATORS = ("==", "!=", "<", "<=", ">", ">=")
STRATEGIES = ("newest_file", "priority_list", "manual")
SEVERITIES = ("error", "warning")
RESERVED = ("_row", "_source_file", "_ord", "_v")
PROPOSED = re.compile(r"#\s*PROPOSED\b")


class ConfigError(RuntimeError):
    """The configuration can't be used; the message says where and why."""


def _need(ok: bool, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def parse_bound(bound: float | str, kind: str) -> float | date | datetime:
    """A rule's bound in the field's type: a number, or an ISO date or datetime."""
    try:
        if kind in ("integer", "float"):
            return float(bound)
        if kind == "date":
            return date.fromisoformat(str(bound))
        if kind == "datetime":
            return datetime.fromisoformat(str(bound))
    except ValueError as exc:
        raise ConfigError(f"bound {bound!r} doesn't read as {kind}") from exc
    raise ConfigError(f"a range needs a numeric or date field, not {kind}")


@dataclass(frozen=True)
class Rule:
    """range (min, max), regex (pattern) or allowed_values (values)."""

    rule: str
    severity: str = "error"
    min: float | str | None = None
    max: float | str | None = None
    pattern: str | None = None
    values: tuple[Any, ...] = ()

    def check(self, spec: Field) -> None:
        where = f"rule on '{spec.name}'"
        _need(self.severity in SEVERITIES, f"{where}: severity must be error or warning")
        if self.rule == "range":
            _need(self.min is not None or self.max is not None, f"{where}: a range needs min or max")
            for b in (self.min, self.max):
                if b is not None:
                    parse_bound(b, spec.type)
        elif self.rule == "regex":
            _need(spec.type == "string", f"{where}: a pattern needs a string field, not {spec.type}")
            _need(bool(self.pattern), f"{where}: no pattern")
            try:
                re.compile(self.pattern or "")
            except re.error as exc:
                raise ConfigError(f"{where}: invalid pattern: {exc}") from exc
        elif self.rule == "allowed_values":
            _need(bool(self.values), f"{where}: no values")
            _need(spec.type != "boolean", f"{where}: allowed values make no sense for a boolean")
        else:
            raise ConfigError(f"{where}: unknown rule '{self.rule}'")


@dataclass(frozen=True)
class Field:
    name: str
    type: str
    required: bool = False
    synonyms: tuple[str, ...] = ()
    rules: tuple[Rule, ...] = ()

    def check(self) -> None:
        _need(bool(self.name) and self.name not in RESERVED, f"field name '{self.name}' is reserved or empty")
        _need(self.type in TYPES, f"field '{self.name}': unknown type '{self.type}'")
        for r in self.rules:
            r.check(self)


@dataclass(frozen=True)
class CrossField:
    field: str
    operator: str
    other: str
    severity: str = "error"


@dataclass(frozen=True)
class Survivorship:
    strategy: str
    priority: tuple[str, ...] = ()


@dataclass(frozen=True)
class Validation:
    keys: tuple[str, ...] = ()
    cross_field: tuple[CrossField, ...] = ()
    survivorship: Survivorship | None = None


@dataclass(frozen=True)
class Limits:
    max_file_size_mb: int = 100
    chunk_rows: int = 100_000


@dataclass(frozen=True)
class Output:
    directory: str = "output"
    dataset_name: str = "consolidated"


@dataclass(frozen=True)
class Matching:
    fuzzy_threshold: float = 90.0


@dataclass(frozen=True)
class Config:
    fields: tuple[Field, ...]
    sources: tuple[str, ...] = ("**/*.csv", "**/*.xlsx")
    matching: Matching = field(default_factory=Matching)
    validation: Validation = field(default_factory=Validation)
    limits: Limits = field(default_factory=Limits)
    assist: dict[str, Any] = field(default_factory=dict)
    output: Output = field(default_factory=Output)
    targets: dict[str, dict[str, Any]] = field(default_factory=dict)

    def spec(self, name: str) -> Field:
        return next(f for f in self.fields if f.name == name)

    def check(self) -> Config:
        names = [f.name for f in self.fields]
        _need(bool(names), "no fields")
        _need(len(set(names)) == len(names), "field names must be unique")
        for f in self.fields:
            f.check()
        for k in self.validation.keys:
            _need(k in names, f"key column '{k}' is not a declared field")
        for c in self.validation.cross_field:
            _need(c.operator in OPERATORS, f"unknown operator '{c.operator}'")
            _need(c.severity in SEVERITIES, "severity must be error or warning")
            _need(c.field in names and c.other in names, f"cross-field rule names an undeclared field: {c.field}, {c.other}")
            kinds = {self.spec(c.field).type, self.spec(c.other).type}
            _need(len(kinds) == 1 or kinds <= {"integer", "float"}, f"'{c.field}' and '{c.other}' can't be compared")
        s = self.validation.survivorship
        if s:
            _need(s.strategy in STRATEGIES, f"unknown strategy '{s.strategy}'")
            _need((s.strategy == "priority_list") == bool(s.priority), "a priority list belongs to the strategy priority_list, and to it only")
        return self


def _build(cls: type, raw: Any, where: str) -> Any:
    """An instance of a section from what the file says, nested sections included."""
    _need(isinstance(raw, dict), f"{where} must be a mapping")
    known = {f.name: f for f in fields(cls)}
    unknown = set(raw) - set(known)
    _need(not unknown, f"{where}: unknown key(s) {', '.join(map(repr, sorted(map(str, unknown))))}")
    missing = [n for n, f in known.items() if n not in raw and f.default is MISSING and f.default_factory is MISSING]
    _need(not missing, f"{where}: missing {', '.join(missing)}")
    parts = {(Config, "fields"): Field, (Field, "rules"): Rule, (Validation, "cross_field"): CrossField}
    whole = {(Config, "matching"): Matching, (Config, "validation"): Validation, (Config, "limits"): Limits, (Config, "output"): Output, (Validation, "survivorship"): Survivorship}
    out = {}
    for k, v in raw.items():
        if (cls, k) in parts:
            out[k] = tuple(_build(parts[cls, k], x, f"{where}.{k}[{i}]") for i, x in enumerate(v or []))
        elif (cls, k) in whole:
            out[k] = _build(whole[cls, k], v, f"{where}.{k}") if v is not None else known[k].default
        else:
            out[k] = tuple(v) if isinstance(v, list) else v
    return cls(**out)


def config_from(raw: dict[str, Any]) -> Config:
    return _build(Config, raw, "config").check()


def load_config(path: Path) -> Config:
    """The project's configuration; refused while it holds PROPOSED markers."""
    import yaml

    _need(path.is_file(), f"configuration file not found: {path}")
    text = path.read_text(encoding="utf-8")
    _need(not PROPOSED.search(text), f"{path} still contains PROPOSED markers; review each and delete it, or confirm them all")
    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as exc:
        raise ConfigError(f"could not parse {path}: {exc}") from exc
    _need(isinstance(raw, dict), f"{path} must contain a mapping")
    return config_from(raw)
