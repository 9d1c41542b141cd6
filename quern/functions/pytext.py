"""A value's text as Python's str() writes it, as a Column expression: fingerprints are made of it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quern.functions.text import let


def _float_text(x: Column) -> Column:
    """Shortest digits, without an exponent from 1e-4 up to 1e16."""
    java = x.cast("string")

    def spread(s: Column) -> Column:
        part = lambda i: F.regexp_extract(s, r"^(-?)(\d)\.(\d+)E(-?\d+)$", i)
        sign, lead, tail, e = part(1), part(2), part(3), part(4).try_cast("int")
        digits = F.concat(lead, F.when(tail == "0", "").otherwise(tail))
        after = F.length(digits) - 1
        big = F.when(after <= e, F.concat(F.rpad(digits, e + 1, "0"), F.lit(".0"))).otherwise(F.concat(F.substring(digits, F.lit(1), e + 1), F.lit("."), F.substring(digits, e + 2, F.lit(40))))
        small = F.concat(F.lit("0."), F.repeat(F.lit("0"), -e - 1), digits)
        power = F.concat(F.when(e < 0, "e-").otherwise("e+"), F.lpad(F.abs(e).cast("string"), F.greatest(F.lit(2), F.length(F.abs(e).cast("string"))), F.lit("0")))
        far = F.concat(lead, F.when(tail == "0", "").otherwise(F.concat(F.lit("."), tail)), power)
        return F.concat(sign, F.when((e >= 0) & (e < 16), big).when((e < 0) & (e >= -4), small).otherwise(far))

    plain = F.when(F.isnan(x), "nan").when(java == "Infinity", "inf").when(java == "-Infinity", "-inf")
    return plain.otherwise(let(java, lambda s: F.when(s.contains("E"), spread(s)).otherwise(s)))


def py_text(c: Column, kind: str) -> Column:
    """``kind``: one of the six declared types. Null stays null."""
    if kind == "float":
        return F.when(c.isNotNull(), _float_text(c))
    if kind == "boolean":
        return F.when(c, "True").when(~c, "False")
    if kind == "datetime":
        s = c.cast("string")
        return F.when(s.contains("."), F.rpad(s, 26, "0")).otherwise(s)
    return c.cast("string")
