"""Quality profile of every column of every load of a table, and how loads depart from the others.

Counts, ranges and power sums come from one aggregation that combines before the shuffle; distinct cells are counted by grouping
them; medians are exact (see quantile.py). No load, however large, is gathered in one task.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.coerce import cell_class, coerce
from quern.functions.text import clean
from quern.operators.quantile import exact_median

#: Decimal digits after the point that the exact power sums keep of a number.
POWER_DIGITS = 2
#: The default pattern of an e-mail address, matched in full.
EMAIL = r"[^@\s]+@[^@\s]+\.[^@\s]+"


@dataclass(frozen=True)
class ColumnSpec:
    """What is measured of a column. kind: a type of coerce.TYPES; pattern: valid text matches it in full (strings only)."""

    name: str
    kind: str = "string"
    pattern: str | None = None
    checked: bool = False  # whether validity is reported
    distinct: bool = True  # whether distinct cells are counted

    def valid(self, cell: Column) -> Column:
        """True for a valid cell, false for an invalid one; ``cell`` is stripped, blank cells are null."""
        if self.pattern is not None:
            return cell.rlike(rf"(?Ud)\A(?:{self.pattern})\z")
        return coerce(cell, self.kind).isNotNull() if self.kind != "string" else F.lit(True)


def _power(number: Column, p: int) -> Column:
    """The p-th power in units of 10**-POWER_DIGITS, exact; null if the number has more decimals or leaves 19 digits, or the power 38."""
    k = F.when(F.round(number, POWER_DIGITS) == number, F.round(number * 10**POWER_DIGITS).try_cast("decimal(19,0)")).cast("decimal(38,0)")
    return reduce(F.try_multiply, [k] * p).cast("decimal(38,0)")


def profile_columns(df: DataFrame, load: str, columns: list[ColumnSpec], types: bool = True, distinct: bool = True, moments: bool = False) -> DataFrame:
    """One row for each load and column.

    load, column_name, rows, non_empty, valid, completeness_pct, validity_pct (null where validity isn't checked), trues (booleans),
    min_number, max_number, s1 to s4 (exact power sums of the valid numbers in units of 10**-POWER_DIGITS; null where a column has no
    numbers, or the sum or any number's power leaves 38 digits, or a number has more decimals than POWER_DIGITS, so that none stands for a
    part of the numbers or for rounded ones), numbers; with
    ``moments`` mean, variance and skewness of the numbers as doubles; with ``distinct`` distinct_values, min_text and max_text; with
    ``types`` inferred_type. A load of which every cell of a column is blank still has a row for it; an empty table gives none. A null load
    is a load of its own.
    """
    cells = df.select(F.col(load).alias("_load"), *[clean(F.col(c.name)).alias(f"c{i}") for i, c in enumerate(columns)])
    # Each reading of a cell is a column of its own, so that the aggregates share it and their code stays small.
    readings: dict[str, Column] = {}
    wide: list[Column] = [F.count(F.lit(1)).alias("rows")]
    for i, c in enumerate(columns):
        x = F.col(f"c{i}")
        wide.append(F.count(x).alias(f"n{i}"))
        if c.kind in ("integer", "float", "boolean"):
            readings[f"x{i}"] = coerce(x, "float" if c.kind != "boolean" else "boolean")
        if c.checked:
            readings[f"ok{i}"] = F.col(f"x{i}").isNotNull() if c.kind in ("float", "boolean") else c.valid(x)
            wide.append(F.count_if(F.col(f"ok{i}")).alias(f"v{i}"))
        if c.kind == "boolean":
            wide.append(F.count_if(F.col(f"x{i}")).alias(f"t{i}"))
        if c.kind in ("integer", "float"):
            number = F.col(f"x{i}")
            wide += [F.min(number).alias(f"nlo{i}"), F.max(number).alias(f"nhi{i}"), F.count(number).alias(f"nn{i}"), F.count(_power(number, 1)).alias(f"ne{i}")]
            wide += [F.try_sum(_power(number, p)).alias(f"s{p}_{i}") for p in (1, 2, 3, 4)]
            if moments:
                wide += [F.avg(number).alias(f"mean{i}"), F.var_pop(number).alias(f"var{i}"), F.skewness(number).alias(f"skew{i}")]
        if types:
            readings[f"k{i}"] = F.substring(cell_class(x), 1, 2)
            wide += [F.count_if(F.col(f"k{i}") == k).alias(f"{k}{i}") for k in ("in", "fl", "th", "bo", "da")]
    first = {k: v for k, v in readings.items() if not k.startswith("ok")}
    cells = cells.withColumns(first).withColumns({k: v for k, v in readings.items() if k not in first})
    agg = cells.groupBy("_load").agg(*wide)

    def one(i: int, c: ColumnSpec) -> Column:
        null = lambda t: F.lit(None).cast(t)
        n = F.col(f"n{i}")
        number = c.kind in ("integer", "float")
        # try_sum leaves out powers that are null. All numbers have a first power if their count says so; higher ones grow with the size of a
        # number, so all are there if those of both ends are.
        whole = lambda p: (F.col(f"ne{i}") == F.col(f"nn{i}")) & _power(F.col(f"nlo{i}"), p).isNotNull() & _power(F.col(f"nhi{i}"), p).isNotNull()
        fields = [
            F.lit(c.name).alias("column_name"),
            n.alias("non_empty"),
            (F.col(f"v{i}") if c.checked else null("bigint")).alias("valid"),
            (F.col(f"t{i}") if c.kind == "boolean" else null("bigint")).alias("trues"),
            (F.col(f"nlo{i}") if number else null("double")).alias("min_number"),
            (F.col(f"nhi{i}") if number else null("double")).alias("max_number"),
            (F.col(f"nn{i}") if number else null("bigint")).alias("numbers"),
            *[(F.when(whole(p), F.col(f"s{p}_{i}")) if number else null("decimal(38,0)")).alias(f"s{p}") for p in (1, 2, 3, 4)],
        ]
        if moments:
            fields += [(F.col(f"{short}{i}") if number else null("double")).alias(long) for short, long in (("mean", "mean"), ("var", "variance"), ("skew", "skewness"))]
        if types:
            ints, floats, groups, words, dates = (F.col(f"{k}{i}") for k in ("in", "fl", "th", "bo", "da"))
            fields.append(
                F.when(n == 0, "string").when(ints == n, "integer").when(ints + floats + groups == n, "float").when(words == n, "boolean").when(dates == n, "date").otherwise("string").alias("inferred_type")
            )
        return F.struct(*fields)

    long = agg.select(F.col("_load"), "rows", F.explode(F.array(*[one(i, c) for i, c in enumerate(columns)])).alias("p")).select(F.col("_load").alias(load), "rows", "p.*")
    long = long.withColumn("completeness_pct", F.col("non_empty") * 100.0 / F.col("rows"))
    long = long.withColumn("validity_pct", F.when(F.col("non_empty") > 0, F.col("valid") * 100.0 / F.col("non_empty")))
    if distinct:
        long = long.join(distinct_cells(df, load, [c.name for c in columns if c.distinct]).drop("cells").withColumnsRenamed({load: "_l", "column_name": "_c"}), F.col(load).eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")), "left").drop("_l", "_c")
    return long


def distinct_cells(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """load, column_name, cells (not blank), distinct_values (different ones once stripped; exact), min_text, max_text."""
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), clean(F.col(c)).alias("cell"))
    cells = df.select(load, F.explode(F.array(*[pair(c) for c in columns])).alias("p")).where("p.cell is not null").groupBy(load, "p.column_name", "p.cell").agg(F.count(F.lit(1)).alias("_n"))
    return cells.groupBy(load, "column_name").agg(F.sum("_n").alias("cells"), F.count(F.lit(1)).alias("distinct_values"), F.min("cell").alias("min_text"), F.max("cell").alias("max_text"))


def standardised_shifts(profile: DataFrame, load: str, table: str | None = None) -> DataFrame:
    """How far each load's numbers lie from those of all other loads together: a row for each load and column with numbers.

    From ``profile_columns``: the power sums of the other loads are those of all less the load's own, which is exact as the sums
    are. Loads whose sums leave 38 digits count by their moments in doubles (of a profile without ``moments``: they and, where they
    are among the others, the others' figures are null); the others' moments are then merged, never subtracted. shift = (mean - mean
    of the others) / root of the mean of both variances; spread = ratio of the standard deviations; skew = the load's third
    standardised moment. Null where a side has no numbers or no variance, or leaves the range of doubles.
    """
    from pyspark.sql import Window

    keys = ([table] if table else []) + ["column_name"]
    p = profile.where("numbers > 0")
    if "mean" not in p.columns:
        p = p.withColumns({c: F.lit(None).cast("double") for c in ("mean", "variance", "skewness")})
    exact = F.col("s2").isNotNull()  # s1 is then too
    total = p.groupBy(*keys).agg(
        *[F.try_sum(c).alias(f"a_{c}") for c in ("s1", "s2")], F.sum("numbers").alias("a_n"),
        F.count_if(~exact).alias("a_wide"), F.percentile_approx("mean", 0.5, 10_000).alias("a_mid"),
    )
    j = p.join(total, keys)
    # The other loads' moments about a middle load's mean: sums over the loads before and after, as subtraction would lose all digits.
    d = F.col("mean") - F.col("a_mid")
    n = F.col("numbers")
    j = j.withColumns({"w0": F.when(d.isNotNull(), n), "w1": n * d, "w2": n * (F.col("variance") + d * d)})
    before, after = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in (F.col(load).asc_nulls_first(), F.col(load).desc_nulls_last()))
    side = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0)) + F.coalesce(F.sum(c).over(after), F.lit(0))
    j = j.withColumns({f"o{i}": side(f"w{i}") for i in range(3)})
    unit = float(10**POWER_DIGITS)
    m = F.col("a_n") - n
    mean = lambda s, k: F.when(k > 0, s.cast("double") / k / unit)
    # The variance in exact decimals up to the last division: n * s2 - s1 ** 2.
    var = lambda s1, s2, k: F.when(k > 0, F.greatest(F.lit(0.0), s2.cast("double") / k - F.pow(s1.cast("double") / k, F.lit(2.0))) / unit**2)
    # a_s1 and a_s2 are sums over the loads whose sums are exact: those are all the others of a load that is the only one that isn't.
    own_part = lambda c: F.when(exact, F.col(c)).otherwise(F.lit(0).cast("decimal(38,0)"))
    others_exact = (F.col("a_wide") - F.when(exact, 0).otherwise(1) == 0) & F.col("a_s1").isNotNull() & F.col("a_s2").isNotNull()
    rest = lambda c: F.col(f"a_{c}") - own_part(c)
    merged = (m > 0) & (F.col("o0") == m)
    shift1 = F.col("o1") / m
    finite = lambda x: F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x)
    j = j.withColumns({
        "m1": F.when(exact, mean(F.col("s1"), n)).otherwise(finite(F.col("mean"))),
        "v1": F.when(exact, var(F.col("s1"), F.col("s2"), n)).otherwise(finite(F.col("variance"))),
        "r1": F.when(others_exact, mean(rest("s1"), m)).when(merged, finite(F.col("a_mid") + shift1)),
        "v2": F.when(others_exact, var(rest("s1"), rest("s2"), m)).when(merged, finite(F.greatest(F.lit(0.0), F.col("o2") / m - shift1 * shift1))),
    })
    m1, v1, r1, v2 = (F.col(c) for c in ("m1", "v1", "r1", "v2"))
    pooled = F.sqrt(v1 / 2 + v2 / 2)
    third = F.col("s3").cast("double") / n / unit**3 - 3 * m1 * F.col("s2").cast("double") / n / unit**2 + 2 * F.pow(m1, F.lit(3.0))
    skew = F.when(F.col("s3").isNotNull(), F.when(v1 > 0, third / F.pow(v1, F.lit(1.5)))).when(v1 > 0, finite(F.col("skewness")))
    return j.select(
        *([table] if table else []), load, "column_name", "numbers", m1.alias("mean"), r1.alias("mean_of_others"),
        F.when(pooled > 0, (m1 - r1) / pooled).alias("shift"), F.when(v2 > 0, F.sqrt(v1) / F.sqrt(v2)).alias("spread"), skew.alias("skew"),
    )


def number_medians(df: DataFrame, load: str, columns: list[str]) -> DataFrame:
    """load, column_name, median: exact median of each load's valid numbers."""
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), coerce(F.col(c), "float").alias("number"))
    numbers = df.select(load, F.explode(F.array(*[pair(c) for c in columns])).alias("p")).select(load, "p.*").where("number is not null")
    return exact_median(numbers, [load, "column_name"], "number")


@dataclass(frozen=True)
class Bound:
    """When a measure departs from its median: by more than ``apart``, above ``times`` it, or below ``part`` of it."""

    apart: float | None = None
    times: float | None = None
    part: float | None = None

    def departs(self, x: Column, median: Column) -> Column:
        tests = []
        if self.apart is not None:
            tests.append(F.abs(x - median) > self.apart)
        if self.times is not None:
            tests.append(x > median * self.times)
        if self.part is not None:
            tests.append(x < median * self.part)
        return reduce(lambda a, b: a | b, tests)


def departures(measures: DataFrame, table: str, load: str, bounds: dict[str, Bound]) -> DataFrame:
    """The measures that depart from the median over all loads of the same table.

    ``measures``: table, load, column_name, measure, x; a null x has no part in it. Columns out: those and median.
    """
    m = measures.where("x is not null")
    keys = [table, "column_name", "measure"]
    j = m.join(exact_median(m, keys, "x", "median"), keys)
    return j.where(reduce(lambda a, b: a | b, [(F.col("measure") == k) & b.departs(F.col("x"), F.col("median")) for k, b in bounds.items()]))


def recorded_differences(profile: DataFrame, load: str, recorded: DataFrame) -> DataFrame:
    """load, column_name, non_empty, recorded for each column whose latest recorded non_empty isn't the number found.

    ``recorded``: load, column_name, non_empty, profiled_at. A record without a time is the oldest; of equal times the largest
    figure counts; a null figure is no record.
    """
    latest = recorded.where("non_empty is not null").groupBy(F.col(load).alias("_l"), F.col("column_name").alias("_c")).agg(F.max_by("non_empty", F.struct(F.coalesce("profiled_at", F.lit("0001-01-01").cast("timestamp_ntz")), "non_empty")).alias("recorded"))
    same = F.col(load).eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")) & (F.col("non_empty") != F.col("recorded"))
    return profile.join(latest, same).select(load, "column_name", "non_empty", "recorded")
