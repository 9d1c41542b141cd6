"""Text helpers as Column expressions, all evaluated inside the JVM."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The characters with the Unicode property White_Space.
WHITE_SPACE = (
    "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def strip(c: Column) -> Column:
    """Without white space at either end; null stays null."""
    return F.btrim(c, F.lit(WHITE_SPACE))


def clean(c: Column) -> Column:
    """Stripped text; null, empty and white-space-only text give null."""
    return F.nullif(strip(c), F.lit(""))


def is_blank(c: Column) -> Column:
    return clean(c).isNull()


def normalise_heading(c: Column) -> Column:
    """Lower case, each run of other characters than a-z and 0-9 as one space, stripped."""
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", " "))


def compact_heading(c: Column) -> Column:
    """Lower-case letters and digits only; a heading without any keeps its own lower-case text."""
    letters = F.regexp_replace(F.lower(c), "[^\\p{L}\\p{N}]+", "")
    return F.when(letters == "", F.lower(strip(c))).otherwise(letters)


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is evaluated once, however often ``body`` names it.

    Columns made by ``withColumn`` don't serve for this: a filter above them is pushed down with each of their expressions
    written out in full wherever it is named.
    """
    return F.get(F.transform(F.array(value), body), F.lit(0))


def pinned(value: Column) -> Column:
    """``value``, in a projection that the planner neither merges with others nor pushes filters through.

    For columns that are costly and named often above: a filter pushed below them would hold their expressions once more for each
    mention, and these those of the columns below, until the plan no longer compiles.
    """
    return F.when(F.monotonically_increasing_id() >= 0, value)
