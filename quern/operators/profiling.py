"""What a file's columns look like, for proposing a configuration: types and issues of the first cells of each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions.coerce import cell_class
from quern.functions.text import clean

#: Non-blank cells, from the first row on, that a column's type is inferred from.
SAMPLE = 1000


def class_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, class, n over every non-blank cell."""
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), cell_class(F.col(f"`{c}`").cast("string")).alias("class"))
    return df.select(F.explode(F.array(*[pair(c) for c in columns])).alias("p")).where("p.class is not null").groupBy("p.column_name", "p.class").agg(F.count(F.lit(1)).alias("n"))


def inferred_types(counts: DataFrame) -> DataFrame:
    """column_name, non_empty, inferred_type from class_counts: whole numbers, numbers, words, dates, or string."""
    of = lambda *k: F.coalesce(F.sum(F.when(F.col("class").isin(list(k)), F.col("n"))), F.lit(0))
    dates = F.coalesce(F.sum(F.when(F.col("class").startswith("date:"), F.col("n"))), F.lit(0))
    a = counts.groupBy("column_name").agg(F.sum("n").alias("non_empty"), of("integer").alias("i"), of("integer", "float", "thousands").alias("f"), of("boolean").alias("b"), dates.alias("d"))
    n = F.col("non_empty")
    kind = F.when(F.col("i") == n, "integer").when(F.col("f") == n, "float").when(F.col("b") == n, "boolean").when(F.col("d") == n, "date").otherwise("string")
    return a.select("column_name", "non_empty", kind.alias("inferred_type"))


def case_variants(df: DataFrame, columns: list[str]) -> DataFrame:
    """column_name, value (in lower case), variants: values that stand in more than one way of writing capitals."""
    pair = lambda c: F.struct(F.lit(c).alias("column_name"), clean(F.col(f"`{c}`").cast("string")).alias("v"))
    cells = df.select(F.explode(F.array(*[pair(c) for c in columns])).alias("p")).where("p.v is not null").select("p.*").distinct()
    return cells.groupBy("column_name", F.lower("v").alias("value")).agg(F.count(F.lit(1)).alias("variants")).where("variants > 1")


def profile_table(df: DataFrame, columns: list[str], order: str = "_row", sample: int = SAMPLE) -> list[dict]:
    """For each column: name, inferred_type, non_empty (all cells), issues (of the first ``sample`` non-blank cells)."""
    out = []
    counts = df.agg(*[F.count(clean(F.col(f"`{c}`"))).alias(f"n{i}") for i, c in enumerate(columns)]).first() if columns else []
    for i, c in enumerate(columns):
        if not counts[i]:
            out.append({"name": c, "inferred_type": "string", "non_empty": 0, "issues": ["no values"]})
            continue
        first = df.where(clean(F.col(f"`{c}`")).isNotNull()).orderBy(order).select(F.col(f"`{c}`").alias("v")).limit(sample)
        classes = {r["class"]: r.n for r in class_counts(first, ["v"]).collect()}
        kind = inferred_types(class_counts(first, ["v"])).first().inferred_type
        issues = []
        forms = sorted(k[5:] for k in classes if k.startswith("date:"))
        if len(forms) > 1:
            issues.append("mixed date formats: " + ", ".join(forms))
        if classes.get("thousands"):
            issues.append(f"thousands separators in {classes['thousands']} value(s)")
        if kind in ("string", "boolean"):
            cased = case_variants(first, ["v"]).orderBy("value").collect()
            if cased:
                example = sorted(r.v for r in first.select(clean(F.col("v")).alias("v")).where(F.lower("v") == cased[0]["value"]).distinct().collect())
                issues.append(f"case variants of {len(cased)} value(s), e.g. " + " / ".join(example))
        out.append({"name": c, "inferred_type": kind, "non_empty": counts[i], "issues": issues})
    return out
