"""Strict coercion of text to the six declared types, as Column expressions.

A blank cell (null, empty, white space only) becomes null and is no failure; any other cell either reads in full or is a
failure. No expression depends on session settings: every parse is gated by a pattern and done with a ``try_`` function, and a
datetime is ``timestamp_ntz``, so a local time that a zone skips is kept.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import clean, let

TYPES: dict[str, T.DataType] = {
    "string": T.StringType(),
    "integer": T.LongType(),
    "float": T.DoubleType(),
    "boolean": T.BooleanType(),
    "date": T.DateType(),
    "datetime": T.TimestampNTZType(),
}

# Words and formats that must equal those of the documented behaviour.
TRUE_WORDS = ["true", "t", "yes", "y", "1"]
FALSE_WORDS = ["false", "f", "no", "n", "0"]
THOUSANDS = r"^[+-]?\d{1,3}(?:,\d{3})+(?:\.\d+)?$"
NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"
INTEGER = r"^[+-]?\d+$"

#: Anchored date forms in the order in which they are tried, each with its rewriting to year-month-day.
DATE_FORMS = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})$", "$1-$2-$3"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$2-$1"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4})$", "$3-$1-$2"),
    (r"^(\d{1,2})-(\d{1,2})-(\d{4})$", "$3-$2-$1"),
    (r"^(\d{4})/(\d{1,2})/(\d{1,2})$", "$1-$2-$3"),
]
DATETIME_FORMS = [
    (r"^(\d{4})-(\d{1,2})-(\d{1,2})[T ](\d{1,2}):(\d{1,2}):(\d{1,2}(?:\.\d{1,6})?)\d*$", "$1-$2-$3 $4:$5:$6"),
    (r"^(\d{1,2})/(\d{1,2})/(\d{4}) (\d{1,2}):(\d{1,2})$", "$3-$2-$1 $4:$5:00"),
]
MONTHS = ["january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december"]
_MONTH_NAMES = "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS)
MONTH_NAME_FORM = rf"(?i)^(\d{{1,2}})\s+({_MONTH_NAMES})\s+(\d{{4}})$"


def month_number(name: Column) -> Column:
    """1 to 12 of a month's name or its first three letters; null for anything else."""
    pairs = [x for i, m in enumerate(MONTHS, 1) for x in (F.lit(m[:3]), F.lit(str(i)))]
    return F.try_element_at(F.create_map(*pairs), F.lower(F.substring(name, 1, 3)))


def _ungrouped(x: Column) -> Column:
    return F.when(x.rlike(THOUSANDS), F.regexp_replace(x, ",", "")).otherwise(x)


def _integer(x: Column) -> Column:
    x = _ungrouped(x)
    return F.when(x.rlike(INTEGER), x.try_cast("bigint"))


def _float(x: Column) -> Column:
    x = _ungrouped(x)
    return F.when(x.rlike(NUMBER), x.try_cast("double"))


def _boolean(x: Column) -> Column:
    x = F.lower(x)
    return F.when(x.isin(TRUE_WORDS), F.lit(True)).when(x.isin(FALSE_WORDS), F.lit(False))


def _reading(x: Column, form: tuple[str, str], kind: str) -> Column:
    return F.when(x.rlike(form[0]), F.regexp_replace(x, form[0], form[1]).try_cast(kind))


def _month_name(x: Column) -> Column:
    part = lambda i: F.regexp_extract(x, MONTH_NAME_FORM, i)
    return F.when(x.rlike(MONTH_NAME_FORM), F.concat_ws("-", part(3), month_number(part(2)), part(1)).try_cast("date"))


def _moment(x: Column, kind: str) -> Column:
    """The reading by the first form that fits. Forms are picked by what tells them apart, so that a cell meets two of them at most."""
    day = lambda *at: F.coalesce(*[_reading(x, DATE_FORMS[i], "date") for i in at]).cast(kind)
    time = lambda i: _reading(x, DATETIME_FORMS[i], "timestamp_ntz").cast(kind)
    timed = x.contains(":")
    return (
        F.when(x.rlike(r"^\d{4}[-/]"), F.when(timed, time(0)).otherwise(day(0, 4)))
        .when(x.contains("/"), F.when(timed, time(1)).otherwise(day(1, 2)))
        .when(x.contains("-"), day(3))
        .otherwise(_month_name(x).cast(kind))
    )


def _date(x: Column) -> Column:
    return _moment(x, "date")


def _datetime(x: Column) -> Column:
    return _moment(x, "timestamp_ntz")


_READERS = {"string": lambda x: x, "integer": _integer, "float": _float, "boolean": _boolean, "date": _date, "datetime": _datetime}


def coerce(c: Column, kind: str, cleaned: bool = False) -> Column:
    """The cell as ``kind``, one of TYPES; null where it is blank or doesn't read. ``cleaned``: it is stripped, and null if blank."""
    if kind not in _READERS:
        raise ValueError(f"unknown field type '{kind}'")
    return _READERS[kind](c if cleaned else clean(c))


def failed(c: Column, kind: str) -> Column:
    """True for a cell that holds something that doesn't read as ``kind``."""
    return clean(c).isNotNull() & coerce(c, kind).isNull()


# Classes of a cell, for type inference. Boolean words here leave out 1 and 0.
CLASS_BOOLEAN = ["true", "false", "yes", "no", "y", "n", "t", "f"]


def cell_class(c: Column) -> Column:
    """integer, float, thousands, boolean, date:<form>, or text; null for a blank cell."""
    return let(clean(c), _class_of)


def _class_of(x: Column) -> Column:
    day_names = ["%Y-%m-%d", "%d/%m/%Y", "%m/%d/%Y", "%d-%m-%Y", "%Y/%m/%d"]
    month = F.regexp_extract(x, MONTH_NAME_FORM, 2)
    whens = [
        (x.rlike(INTEGER), "integer"),
        (x.rlike(r"^[+-]?\d+\.\d+$"), "float"),
        (x.rlike(THOUSANDS), "thousands"),
        (F.lower(x).isin(CLASS_BOOLEAN), "boolean"),
        *((_reading(x, f, "date").isNotNull(), f"date:{n}") for f, n in zip(DATE_FORMS, day_names, strict=True)),
        (_month_name(x).isNotNull() & (F.length(month) == 3), "date:%d %b %Y"),
        (_month_name(x).isNotNull(), "date:%d %B %Y"),
        (x.rlike("^[^.T]*T[^.]*$") & _reading(x, DATETIME_FORMS[0], "timestamp_ntz").isNotNull(), "date:%Y-%m-%dT%H:%M:%S"),
        (x.contains("T") & _reading(x, DATETIME_FORMS[0], "timestamp_ntz").isNotNull(), "date:%Y-%m-%dT%H:%M:%S.%f"),
        (~x.contains(".") & _reading(x, DATETIME_FORMS[0], "timestamp_ntz").isNotNull(), "date:%Y-%m-%d %H:%M:%S"),
        (_reading(x, DATETIME_FORMS[0], "timestamp_ntz").isNotNull(), "date:%Y-%m-%d %H:%M:%S.%f"),
        (_reading(x, DATETIME_FORMS[1], "timestamp_ntz").isNotNull(), "date:%d/%m/%Y %H:%M"),
        (x.isNotNull(), "text"),
    ]
    return reduce(lambda acc, w: F.when(w[0], F.lit(w[1])) if acc is None else acc.when(w[0], F.lit(w[1])), whens, None)
