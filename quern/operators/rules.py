"""Validation in one pass: every row gets the array of what is wrong with it; held rows and records follow from that array."""

from __future__ import annotations

import operator
from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.config import Config, Field, Rule, parse_bound
from quern.functions.coerce import TYPES, coerce, failed
from quern.functions.pytext import py_text
from quern.functions.text import clean, pinned

RECORD = T.StructType([T.StructField("file", T.StringType()), T.StructField("row", T.LongType()), *(T.StructField(c, T.StringType()) for c in ("column", "value", "kind", "severity", "reason"))])
_VIOLATION = "struct<column:string,value:string,kind:string,severity:string,reason:string>"
_COMPARE = {"==": operator.eq, "!=": operator.ne, "<": operator.lt, "<=": operator.le, ">": operator.gt, ">=": operator.ge}


def violation(mask: Column, column: str, value: Column, kind: str, severity: str, reason: str) -> Column:
    """The record's struct where ``mask`` is true, else null."""
    record = F.struct(F.lit(column).alias("column"), value.cast("string").alias("value"), F.lit(kind).alias("kind"), F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
    return F.when(F.coalesce(mask, F.lit(False)), record)


def _literal(value: float | date | datetime, kind: str) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz") if kind == "datetime" and isinstance(value, datetime) else F.lit(value)


def _broken(spec: Field, rule: Rule) -> tuple[Column, str, str]:
    """Mask, kind and reason of one rule. Nulls break none."""
    c = F.col(f"`{spec.name}`")
    if rule.rule == "range":
        tests = [op(c, _literal(parse_bound(b, spec.type), spec.type)) for b, op in ((rule.min, operator.lt), (rule.max, operator.gt)) if b is not None]
        limits = [f"{n} {b}" for n, b in (("min", rule.min), ("max", rule.max)) if b is not None]
        return reduce(operator.or_, tests), "rule_range", f"out of range for field '{spec.name}' ({', '.join(limits)})"
    if rule.rule == "regex":
        return ~c.rlike(rf"(?Ud)\A(?:{rule.pattern})\z"), "rule_regex", f"value does not match pattern for field '{spec.name}'"
    allowed = [F.lit(str(v)).cast(TYPES[spec.type]) if spec.type in ("date", "datetime") else F.lit(v).cast(TYPES[spec.type]) for v in rule.values]
    return ~c.isin(allowed), "rule_allowed_values", f"value not in allowed values for field '{spec.name}'"


def violations(config: Config) -> Column:
    """Array of what each rule finds wrong with a row of typed fields, in the order of the configuration."""
    found = []
    for spec in config.fields:
        c = F.col(f"`{spec.name}`")
        text = py_text(c, spec.type)
        if spec.required:
            found.append(violation(c.isNull(), spec.name, F.lit(None), "rule_required", "error", f"required field '{spec.name}' is empty"))
        for rule in spec.rules:
            mask, kind, reason = _broken(spec, rule)
            found.append(violation(c.isNotNull() & mask, spec.name, text, kind, rule.severity, reason))
    for x in config.validation.cross_field:
        a, b = F.col(f"`{x.field}`"), F.col(f"`{x.other}`")
        pair = F.concat(F.lit(f"{x.field}="), py_text(a, config.spec(x.field).type), F.lit(f", {x.other}="), py_text(b, config.spec(x.other).type))
        found.append(violation(a.isNotNull() & b.isNotNull() & ~_COMPARE[x.operator](a, b), x.field, pair, "rule_cross_field", x.severity, f"'{x.field}' must be {x.operator} '{x.other}'"))
    return F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{_VIOLATION}>")


def coerced(config: Config, headings: dict[str, str], pin: bool = True) -> tuple[list[Column], Column]:
    """Typed columns of a raw frame, and the array of its cells that don't read. ``headings``: source column by field.

    ``pin``: keep the planner from pushing filters through them (see text.pinned); streams allow no such columns.
    """
    columns, found = [], []
    for spec in config.fields:
        source = headings.get(spec.name)
        if source is None:
            columns.append(F.lit(None).cast(TYPES[spec.type]).alias(spec.name))
            continue
        c = F.col(f"`{source}`")
        columns.append(coerce(c, spec.type).alias(spec.name))
        if spec.type != "string":
            found.append(violation(failed(c, spec.type), source, c, "coercion", "error", f"cannot coerce to {spec.type} for field '{spec.name}'"))
    array = F.array_compact(F.array(*found)) if found else F.array().cast(f"array<{_VIOLATION}>")
    return columns, pinned(array) if pin else array


def typed(frame: DataFrame, config: Config, headings: dict[str, str], keep: list[str]) -> DataFrame:
    """``keep``, the typed fields, and _v: the cells that don't read. As coerced, with each cell cleaned and read once, in stages.

    ``headings``: source column by field; a field without one is null throughout.
    """
    have = [(i, f, headings[f.name]) for i, f in enumerate(config.fields) if headings.get(f.name) is not None]
    raw = [F.col(f"`{c}`").cast("string") for _, _, c in have]
    cells = frame.select(*keep, *[r.alias(f"_raw{i}") for r, (i, _, _) in zip(raw, have, strict=True)], *[pinned(clean(r)).alias(f"_cell{i}") for r, (i, _, _) in zip(raw, have, strict=True)])
    read = {f.name: pinned(coerce(F.col(f"_cell{i}"), f.type, cleaned=True)) if f.type != "string" else F.col(f"_cell{i}") for i, f, _ in have}
    fields = [read.get(f.name, F.lit(None).cast(TYPES[f.type])).alias(f.name) for f in config.fields]
    staged = cells.select(*keep, *fields, *[c for i, _, _ in have for c in (f"_raw{i}", f"_cell{i}")])
    bad = [
        violation(F.col(f"_cell{i}").isNotNull() & F.col(f"`{f.name}`").isNull(), source, F.col(f"_raw{i}"), "coercion", "error", f"cannot coerce to {f.type} for field '{f.name}'")
        for i, f, source in have if f.type != "string"
    ]
    array = F.array_compact(F.array(*bad)) if bad else F.array().cast(f"array<{_VIOLATION}>")
    return staged.select(*keep, *[F.col(f"`{f.name}`") for f in config.fields], pinned(array).alias("_v"))


def blocked(array: Column) -> Column:
    """Whether a row's array holds an error."""
    return F.exists(array, lambda v: v["severity"] == "error")


def validate(frame: DataFrame, config: Config, pin: bool = True) -> DataFrame:
    """``frame`` with _v: what is wrong with each row. Rows whose _v already holds an error aren't validated again."""
    rules = violations(config)
    if "_v" in frame.columns:
        rules = F.when(blocked(F.col("_v")), F.col("_v")).otherwise(F.concat("_v", rules))
    return frame.withColumn("_v", pinned(rules) if pin else rules)


def records(frame: DataFrame, array: str = "_v") -> DataFrame:
    """One exception record for each element of the rows' arrays."""
    return frame.where(F.size(array) > 0).select(F.col("_source_file").alias("file"), F.col("_row").alias("row"), F.inline(array))


def clean_rows(frame: DataFrame, array: str = "_v") -> DataFrame:
    """The rows that no error holds, without the array."""
    return frame.where(~blocked(F.col(array))).drop(array)


def held_rows(exceptions: DataFrame) -> DataFrame:
    """file, row of each row that an error holds."""
    return exceptions.where("severity = 'error' and row is not null").select("file", "row").distinct()


def drop_held(frame: DataFrame, exceptions: DataFrame) -> DataFrame:
    """``frame`` without the rows that ``exceptions`` hold: an anti join, for records that come from elsewhere."""
    held = held_rows(exceptions).withColumnsRenamed({"file": "_file", "row": "_held"})
    return frame.join(held, (F.col("_source_file") == F.col("_file")) & (F.col("_row") == F.col("_held")), "left_anti")
