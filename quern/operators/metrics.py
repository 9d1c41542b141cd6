"""Figures of a run: exceptions by kind and severity, completeness and validity of fields, scores of sources."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def severity_counts(exceptions: DataFrame) -> DataFrame:
    """One row with error and warning, both 0 where there are none."""
    return exceptions.agg(F.count_if(F.col("severity") == "error").alias("error"), F.count_if(F.col("severity") == "warning").alias("warning"))


def by_kind(exceptions: DataFrame) -> DataFrame:
    """kind, errors, warnings; the most frequent kind first, then by name."""
    counts = exceptions.groupBy("kind").agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    return counts.orderBy((F.col("errors") + F.col("warnings")).desc(), "kind")


def completeness(published: DataFrame, fields: list[str]) -> DataFrame:
    """field, rows, filled: one aggregation over all fields, turned into rows. Percentages are filled * 100 / rows."""
    agg = published.agg(F.count(F.lit(1)).alias("_rows"), *[F.count(F.col(f"`{f}`")).alias(f"n{i}") for i, f in enumerate(fields)])
    return agg.select("_rows", F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f"n{i}").alias("filled")) for i, f in enumerate(fields)])).alias("p")).select("p.field", F.col("_rows").alias("rows"), "p.filled")


def violating_rows(exceptions: DataFrame, mapping: DataFrame | None = None) -> DataFrame:
    """field, rows: different (file, row) pairs with a coercion or rule record for the field.

    ``mapping``: file, source, target; coercion records name the source heading, which it leads back to the field.
    """
    own = exceptions.where("row is not null and column is not null and (kind = 'coercion' or kind like 'rule_%')")
    if mapping is not None:
        m = mapping.where("target is not null").select(F.col("file").alias("_f"), F.col("source").alias("_s"), "target").distinct()
        own = own.join(m, (F.col("file") == F.col("_f")) & (F.col("column") == F.col("_s")), "left").withColumn("column", F.coalesce("target", "column"))
    return own.select(F.col("column").alias("field"), "file", "row").distinct().groupBy("field").agg(F.count(F.lit(1)).alias("rows"))


def source_scores(file_rows: DataFrame, exceptions: DataFrame) -> DataFrame:
    """file, rows, error_rows, warnings, score for each file of ``file_rows`` (file, rows).

    score: 100 less the share of rows with errors and a quarter of the warnings, half to even, not below 0; 0 where an error concerns
    the whole file; without rows 0 or 100. A row counts once however many errors it has.
    """
    by_row = exceptions.groupBy("file", "row").agg(F.count_if(F.col("severity") == "error").alias("e"), F.count_if(F.col("severity") == "warning").alias("w"))
    sums = by_row.groupBy("file").agg(F.count_if((F.col("e") > 0) & F.col("row").isNotNull()).alias("error_rows"), F.sum("w").alias("warnings"), F.max((F.col("e") > 0) & F.col("row").isNull()).alias("_whole"))
    j = file_rows.join(sums.withColumnRenamed("file", "_f"), F.col("file") == F.col("_f"), "left")
    errors, warnings = F.coalesce("error_rows", F.lit(0)), F.coalesce("warnings", F.lit(0))
    part = F.bround(100.0 * (1.0 - (errors + 0.25 * warnings) / F.col("rows"))).cast("bigint")
    score = F.when(F.coalesce("_whole", F.lit(False)), 0).when(F.col("rows") == 0, F.when(errors + warnings > 0, 0).otherwise(100)).otherwise(F.greatest(F.lit(0).cast("bigint"), part))
    return j.select("file", "rows", errors.alias("error_rows"), warnings.alias("warnings"), score.cast("bigint").alias("score"))


def trends(runs: DataFrame, limit: int = 30) -> DataFrame:
    """The last ``limit`` runs by run_id, oldest first, with quality (published as a share of rows in, unrounded)."""
    last = runs.orderBy(F.col("run_id").desc()).limit(limit)
    return last.withColumn("quality", F.when(F.col("rows_in") > 0, F.col("rows_published") * 100.0 / F.col("rows_in"))).orderBy("run_id")


def broken_links(manifests: DataFrame) -> DataFrame:
    """run_id of each manifest whose previous_sha256 isn't the sha256 of the one before it by run_id."""
    from pyspark.sql import Window

    before = F.lag("sha256").over(Window.orderBy("run_id"))  # one row a run: a list of metadata
    return manifests.withColumn("_before", before).where(~F.col("previous_sha256").eqNullSafe(F.col("_before"))).select("run_id")
