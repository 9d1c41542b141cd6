"""Records with the same key become one: merged where they agree, one kept by a stated strategy, or all held for review.

Two aggregations do it, first by key and file, then by key. Each keeps only smallest and largest values and first rows, so a key that
holds a third of all rows costs no task more than a few rows for each file.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.config import Config, Survivorship
from quern.functions.pytext import py_text


@dataclass(frozen=True)
class Reconciled:
    """frame: the surviving rows, with _ord, _rows (how many became the row) and _grouped; exceptions: missing_key, duplicate_key and conflict records; counters: one row of sums."""

    frame: DataFrame
    exceptions: DataFrame
    counters: DataFrame


def _rank(s: Survivorship, mtimes: dict[str, float]) -> Column:
    """What decides between files: the smaller, the better."""
    if s.strategy == "newest_file":
        known = F.create_map(*[F.lit(x) for k, v in mtimes.items() for x in (k, float(v))]) if mtimes else None
        at = F.coalesce(F.try_element_at(known, F.col("_source_file")), F.lit(0.0)) if known is not None else F.lit(0.0)
        return -at
    rank = F.lit(float(len(s.priority)))
    base = F.substring_index("_source_file", "/", -1)
    for i, entry in reversed(list(enumerate(s.priority))):
        rank = F.when((F.col("_source_file") == entry) | (base == entry), F.lit(float(i))).otherwise(rank)
    return rank


def reconcile(frame: DataFrame, config: Config, mtimes: dict[str, float] | None = None) -> Reconciled:
    """Reconciles on the configured keys. ``frame``: _source_file, _row, _ord (order of rows over all files) and the fields.

    A row with a null key is held (missing_key). Rows of one key that don't disagree merge into one: the first value of each field in
    order, the files joined (duplicate_key). Rows that disagree leave one survivor as it is, if the strategy can tell (conflict
    warnings), or are all held (conflict errors). Without keys every row passes. Counters: rows_held, rows_superseded, conflicts_held.
    """
    spark = frame.sparkSession
    keys = list(config.validation.keys)
    from quern.operators.rules import RECORD

    if not keys:
        zero = spark.range(1).select(*[F.lit(0).cast("bigint").alias(c) for c in ("rows_held", "rows_superseded", "conflicts_held")])
        return Reconciled(frame, spark.createDataFrame([], RECORD), zero)
    names = [f.name for f in config.fields]
    types = {f.name: f.type for f in config.fields}
    s = config.validation.survivorship
    null_key = None
    first_null = F.coalesce(*[F.when(F.col(f"`{k}`").isNull(), k) for k in keys])
    for k in keys:
        null_key = F.col(f"`{k}`").isNull() if null_key is None else null_key | F.col(f"`{k}`").isNull()
    keyless = frame.where(null_key)
    text = lambda c: F.lit(None).cast("string").alias(c)
    missing = keyless.select(F.col("_source_file").alias("file"), F.col("_row").alias("row"), first_null.alias("column"), text("value"), F.lit("missing_key").alias("kind"), F.lit("error").alias("severity"), F.concat(F.lit("empty key column '"), first_null, F.lit("'; row held")).alias("reason"))

    rank = _rank(s, mtimes or {}) if s and s.strategy != "manual" else F.lit(0.0)
    q = lambda n: F.col(f"`{n}`")
    key_cols = [q(k).alias(f"_k{i}") for i, k in enumerate(keys)]
    ks = [f"_k{i}" for i in range(len(keys))]
    row = F.struct("_ord", "_source_file", "_row", *[q(n).alias(f"f{i}") for i, n in enumerate(names)])
    keyed = frame.where(~null_key)
    # Most keys stand alone as a rule. They are told apart by a count, so that only rows of repeated keys are packed and compared; the
    # list of repeated keys then meets the rows in a join that needs no exchange of them while it is small.
    repeated = keyed.groupBy(*key_cols).agg(F.count(F.lit(1)).alias("_many")).where("_many > 1").drop("_many").withColumnsRenamed({k: f"_again{k}" for k in ks})
    meets = None
    for k, name in zip(ks, keys, strict=True):
        meets = q(name) == F.col(f"_again{k}") if meets is None else meets & (q(name) == F.col(f"_again{k}"))
    alone_rows = keyed.join(repeated, meets, "left_anti")
    rows = keyed.join(repeated, meets, "left_semi").select(*key_cols, "_source_file", rank.alias("_rank"), "_ord", row.alias("_r"), *[q(n).alias(f"f{i}") for i, n in enumerate(names)])
    firsts = [F.min(F.when(F.col(f"f{i}").isNotNull(), F.struct("_ord", F.col(f"f{i}").alias("v")))).alias(f"v{i}") for i in range(len(names))]
    ends = [a for i in range(len(names)) for a in (F.min(f"f{i}").alias(f"lo{i}"), F.max(f"f{i}").alias(f"hi{i}"))]
    by_file = rows.groupBy(*ks, "_source_file", "_rank").agg(F.count(F.lit(1)).alias("n"), F.min("_r").alias("r"), *firsts, *ends)
    best = F.struct("_rank", "n", "r")
    total = by_file.groupBy(*ks).agg(
        F.sum("n").alias("n"),
        F.array_sort(F.collect_list(F.struct(F.col("r._ord").alias("o"), F.col("_source_file").alias("f")))).alias("files"),
        F.min("r").alias("r"),
        F.min(F.struct("_rank", F.col("r._ord").alias("o"))).alias("top"),
        F.min_by(best, F.struct("_rank", F.col("r._ord"))).alias("best"),
        F.collect_list("_rank").alias("ranks"),
        *[F.min(f"v{i}").alias(f"v{i}") for i in range(len(names))],
        *[a for i in range(len(names)) for a in (F.min(f"lo{i}").alias(f"lo{i}"), F.max(f"hi{i}").alias(f"hi{i}"))],
    )
    clash = [F.coalesce(F.col(f"lo{i}") != F.col(f"hi{i}"), F.lit(False)) for i in range(len(names))]
    any_clash = clash[0]
    for c in clash[1:]:
        any_clash = any_clash | c
    alone = F.size(F.filter("ranks", lambda r: r == F.col("best._rank"))) == 1
    decided = alone & (F.col("best.n") == 1)
    one_file = F.size("files") == 1
    kept = F.col("best.r._source_file")
    if s is None:
        survives, note = F.lit(False), F.lit("no survivorship strategy configured; rows held for review")
    elif s.strategy == "manual":
        survives, note = F.lit(False), F.lit("survivorship strategy is manual; rows held for review")
    elif s.strategy == "newest_file":
        survives = ~one_file & decided
        note = F.when(one_file, "conflicting rows come from one file; newest_file cannot decide").when(~decided, "sources share a modification time; newest_file cannot decide").otherwise(F.concat(F.lit("resolved by newest_file: kept "), kept))
    else:
        listed = F.col("best._rank") < len(s.priority)
        survives = listed & decided
        note = F.when(~listed, "no conflicting source appears in the priority list").when(~decided, F.concat(F.lit("priority list cannot decide between rows of "), kept)).otherwise(F.concat(F.lit("resolved by priority_list: kept "), kept))
    key_text = F.concat_ws("/", *[py_text(F.col(f"_k{i}"), types[k]) for i, k in enumerate(keys)])
    groups = total.withColumn("clash", any_clash).withColumn("survives", survives).withColumn("note", note).withColumn("key_text", key_text)

    def field(i: int) -> Column:
        value = F.when(F.col("clash"), F.col(f"best.r.f{i}")).otherwise(F.col(f"v{i}.v"))
        return value.alias(names[i])

    source = F.when(F.col("clash"), kept).otherwise(F.array_join(F.transform("files", lambda f: f["f"]), "; "))
    number = F.when(F.col("clash"), F.col("best.r._row")).otherwise(F.col("r._row"))
    order = F.col("r._ord")
    decided_rows = groups.where("not clash or survives").select(source.alias("_source_file"), number.alias("_row"), *[field(i) for i in range(len(names))], order.alias("_ord"), F.col("n").alias("_rows"))
    frame_out = alone_rows.select("_source_file", "_row", *[q(n) for n in names], "_ord", F.lit(1).cast("bigint").alias("_rows")).unionByName(decided_rows).withColumn("_grouped", F.col("_rows") > 1)
    shown = F.array_join(F.transform("files", lambda f: f["f"]), ", ")
    merged = groups.where("not clash").select(
        shown.alias("file"), F.lit(None).cast("bigint").alias("row"), F.lit(", ".join(keys)).alias("column"), F.col("key_text").alias("value"), F.lit("duplicate_key").alias("kind"), F.lit("warning").alias("severity"),
        F.concat(F.lit("key '"), F.col("key_text"), F.lit("' appears in "), F.col("n").cast("string"), F.lit(" rows with no disagreement; merged into one")).alias("reason"),
    )
    # The listing of a conflict holds each of its rows by definition; only conflicting keys meet their rows again.
    wrong = groups.where("clash").select(*[F.col(k).alias(f"_x{k}") for k in ks], shown.alias("file"), "survives", "note", "key_text", F.array(*clash).alias("which"))
    same = None
    for k in ks:
        same = F.col(k) == F.col(f"_x{k}") if same is None else same & (F.col(k) == F.col(f"_x{k}"))
    line = lambda i: F.concat(F.col("_r._source_file"), F.lit(" row "), F.col("_r._row").cast("string"), F.lit(": "), F.coalesce(py_text(F.col(f"f{i}"), types[names[i]]), F.lit("(empty)")))
    texts = F.explode(F.array_compact(F.array(*[F.when(F.get("which", F.lit(i)), F.struct(F.lit(i).alias("i"), F.lit(names[i]).alias("column"), line(i).alias("line"))) for i in range(len(names))])))
    listed_rows = rows.join(wrong, same).select(*ks, "file", "survives", "note", "key_text", "_ord", texts.alias("t"))
    listing = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_ord", F.col("t.line").alias("line")))), lambda x: x["line"]), " | ")
    conflicts = listed_rows.groupBy(*ks, "file", "survives", "note", "key_text", F.col("t.column").alias("column")).agg(listing.alias("value")).select(
        "file", F.lit(None).cast("bigint").alias("row"), "column", "value", F.lit("conflict").alias("kind"), F.when(F.col("survives"), "warning").otherwise("error").alias("severity"),
        F.concat(F.lit("conflicting values for key '"), F.col("key_text"), F.lit("'; "), F.col("note")).alias("reason"),
    )
    lost = F.col("clash") & ~F.col("survives")
    zero = lambda c: F.coalesce(c, F.lit(0)).cast("bigint")
    sums = groups.agg(zero(F.sum(F.when(lost, F.col("n")))).alias("h"), zero(F.sum(F.when(~lost, F.col("n") - 1))).alias("s"), zero(F.count_if(lost)).alias("c"))
    keyless_count = keyless.agg(F.count(F.lit(1)).alias("k"))
    counters = sums.crossJoin(keyless_count).select((F.col("h") + F.col("k")).alias("rows_held"), F.col("s").alias("rows_superseded"), F.col("c").alias("conflicts_held"))
    return Reconciled(frame_out, missing.unionByName(merged).unionByName(conflicts), counters)


def in_order(frame: DataFrame) -> DataFrame:
    """Reconciled rows in the order of publication: unique ones first, then groups, each by first appearance."""
    return frame.orderBy("_grouped", "_ord").drop("_grouped", "_ord", "_rows")


