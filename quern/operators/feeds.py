"""What a feed's headings mean, and the rows that don't read."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.coerce import INTEGER, coerce
from quern.functions.text import clean, compact_heading, let
from quern.sources.records import parse_files, parse_records

#: Field to the headings that mean it, each in any writing of capitals, spaces and signs; other headings mean themselves.
Aliases = dict[str, list[str]]


def alias_table(fields: DataFrame, name: str, synonyms: str, own: Aliases | None = None, most_rows: int = 10_000) -> Aliases:
    """The alias table from one of fields, ``synonyms`` being separated by semicolons, and what ``own`` adds to it. A list of bounded size, or an
    error; blank names and synonyms stand for nothing, and a synonym of several fields means the first."""
    rows = fields.where(F.col(name).isNotNull()).select(name, synonyms).limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"an alias table of more than {most_rows} fields")
    out: Aliases = {}
    for field, also in sorted((r[0], r[1] or "") for r in rows if r[0].strip()):
        out[field] = [*out.get(field, [field]), *also.split(";")]
    for field, more in (own or {}).items():
        out[field] = [*out.get(field, [field]), *more]
    return out


def _compact(heading: str) -> str:
    return "".join(c for c in heading.lower() if c.isalnum())


def meaning(heading: Column, aliases: Aliases) -> Column:
    """The field a heading means by the alias table, or its own letters and digits in lower case."""
    by_name: dict[str, str] = {}
    for field, names in aliases.items():
        for n in names:
            if _compact(n):
                by_name.setdefault(_compact(n), field)
    if not by_name:
        return compact_heading(heading)
    pairs = [F.lit(x) for pair in by_name.items() for x in pair]
    return let(compact_heading(heading), lambda h: F.coalesce(F.try_element_at(F.create_map(*pairs), h), h))


def _is_date(cell: Column) -> Column:
    return coerce(cell, "datetime").isNotNull()


def valid_cell(cell: Column, kind: str) -> Column:
    """Whether a cell reads as number, digits, date or boolean. Every date form is a datetime form too. Blank cells are valid."""
    x = clean(cell)
    good = {"number": lambda: coerce(cell, "float").isNotNull(), "digits": lambda: x.rlike(r"^[0-9]+$"), "date": lambda: _is_date(cell), "boolean": lambda: coerce(cell, "boolean").isNotNull()}[kind]()
    return x.isNull() | good


def rejected_cells(records: DataFrame, aliases: Aliases, kinds: dict[str, str]) -> DataFrame:
    """``records`` (of parse_files) with reasons: array of why a record can't be loaded, empty where it can.

    A structural reason stands alone; otherwise number, date and boolean stand at most once each, in this order, however many
    cells of the kind are invalid. ``kinds``: number, digits (0 to 9 only), date or boolean, by the field whose cells must be one.
    """
    by_field = F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair])
    typed = records.withColumn("_kinds", F.transform("headings", lambda h: F.try_element_at(by_field, meaning(h, aliases))))

    def wrong(kind: str) -> Column:
        """Whether any cell of the kind is invalid. Only the kind's cells are read."""
        picked = F.filter(F.arrays_zip("cells", "_kinds"), lambda z: z["_kinds"] == kind)
        return F.exists(picked, lambda z: ~valid_cell(z["cells"], kind))

    reasons = F.array_compact(F.array(F.when(wrong("number") | wrong("digits"), "number"), F.when(wrong("date"), "date"), F.when(wrong("boolean"), "boolean")))
    empty = F.array().cast("array<string>")
    return typed.withColumn("reasons", F.when(F.col("reason").isNotNull(), F.array("reason")).when(F.col("headings").isNull(), empty).otherwise(reasons)).drop("_kinds")


def reported_lines(lines: DataFrame, aliases: Aliases, kinds: dict[str, str]) -> DataFrame:
    """file_name, line_no, reason of each line of ``lines`` that can't be loaded, also for want of headings.

    The reasons are those of rejected_cells and ``headings``, for each line of a file whose line 1 is missing, blank or of broken
    quoting, and for that line itself. Blank lines below line 1 are no records.
    """
    records = rejected_cells(parse_files(lines), aliases, kinds)
    reasons = F.concat("reasons", F.when(F.col("headings").isNull(), F.array(F.lit("headings"))).otherwise(F.array().cast("array<string>")))
    below = records.select("file_name", "line_no", F.explode(reasons).alias("reason"))
    first = lines.where("line_no = 1").groupBy("file_name", "line_no").agg(F.min("raw_line").alias("_heading"))
    return below.unionByName(parse_records(first, "_heading").where("cells is null").select("file_name", "line_no", F.lit("headings").alias("reason")))


def _field_names(aliases: Aliases) -> Column:
    """Meaning of each of ``headings``; the second and later ones of a meaning are numbered as in column_catalogue."""

    def numbered(fields: Column) -> Column:
        again = lambda f, i: F.size(F.filter(F.slice(fields, F.lit(1), i + 1), lambda x: x == f))
        return F.transform(fields, lambda f, i: F.when(again(f, i) > 1, F.concat_ws("#", f, again(f, i))).otherwise(f))

    return let(F.transform("headings", lambda h: meaning(h, aliases)), numbered)


def _others(fields: dict[str, str]) -> Column:
    """Map from meaning to text of every cell that isn't read as one of ``fields``; of _fields (of _field_names) and cells."""
    rest = F.filter(F.arrays_zip("_fields", "cells"), lambda z: ~z["_fields"].isin(list(fields)))
    return F.map_from_entries(F.transform(rest, lambda z: F.struct(z["_fields"].alias("k"), z["cells"].alias("v"))))


def loaded_rows(records: DataFrame, fields: dict[str, str], aliases: Aliases) -> DataFrame:
    """The records without reasons as typed rows: the columns of ``records`` but cells, then ``fields`` (name to type of coerce).

    A field that a file doesn't have is null; of two columns with one meaning the first counts. The cells of all other columns, the
    second with a meaning among them, go into ``others``, a map from field to text, as in unified_table.
    """
    ok = records.where(F.size("reasons") == 0).withColumn("_fields", _field_names(aliases))
    at = lambda f: F.get("cells", (F.array_position("_fields", f) - 1).cast("int"))
    cell = lambda f: F.when(F.array_position("_fields", f) > 0, at(f))
    own = [c for c in records.columns if c not in ("cells", "headings", "reason", "reasons")]
    return ok.select(*own, *[coerce(cell(f), k).alias(f) for f, k in fields.items()], _others(fields).alias("others"))


#: A cell's type for drift; the order decides between types that are as frequent.
DRIFT_TYPES = ["integer", "float", "boolean", "date", "datetime", "string"]


def drift_type(cell: Column) -> Column:
    """integer (digits, also 0 and 1), float, boolean, date, datetime or string; null for a blank cell."""

    def of(x: Column) -> Column:
        dated = let(coerce(x, "datetime"), lambda t: F.when(t.isNull(), "string").when(x.contains(":"), "datetime").otherwise("date"))
        # Every number and date begins with a digit, a sign or a point, so most text is told by its first letter.
        numeric = F.when(x.rlike(r"^[+-]?\d+$"), "integer").when(coerce(x, "float").isNotNull(), "float").otherwise(dated)
        return F.when(x.isNull(), None).when(x.rlike(r"^[0-9+.-]"), numeric).when(coerce(x, "boolean").isNotNull(), "boolean").otherwise("string")

    return let(clean(cell), of)


def column_catalogue(lines: DataFrame, files: DataFrame, aliases: Aliases) -> DataFrame:
    """One row for each column of each file: feed, seq, file_name, position, heading, field, type.

    ``lines``: file_name, line_no, raw_line; ``files``: file_name, feed_code, file_month. seq numbers a feed's files by month (ties by
    name) from 1. type: the most frequent type of the non-blank cells in records whose structure is whole; null if there are none.
    Cells are classed and counted before the shuffle, so what is exchanged is a few rows for each column of a file. Of two columns of
    a file with one meaning the second is a field of its own.
    """
    from pyspark.sql import Window

    records = parse_files(lines)
    zipped = F.posexplode(F.arrays_zip("headings", "cells"))
    cells = records.where("reason is null and headings is not null").select("file_name", zipped.alias("position", "z"))
    counts = cells.select("file_name", "position", drift_type(F.col("z.cells")).alias("type")).where("type is not null").groupBy("file_name", "position", "type").agg(F.count(F.lit(1)).alias("n"))
    rank = reduce(lambda acc, t: acc.when(F.col("type") == t[1], t[0]), enumerate(DRIFT_TYPES), F.when(F.lit(False), 0))
    types = counts.groupBy("file_name", "position").agg(F.max_by("type", F.struct("n", -rank)).alias("type"))
    # Headings come from the file's first record, so that a file without any record below it has columns too.
    first = lines.where("line_no = 1").groupBy("file_name").agg(F.min("raw_line").alias("_heading"))
    heads = parse_records(first, "_heading").where("cells is not null").select("file_name", F.posexplode("cells").alias("position", "heading"))
    order = Window.partitionBy("feed_code").orderBy(F.col("file_month").asc_nulls_first(), "file_name")
    feeds = files.select("file_name", "feed_code", "file_month").dropDuplicates(["file_name"]).withColumn("seq", F.row_number().over(order))
    again = Window.partitionBy("file_name", "field").orderBy("position")
    columns = heads.join(types, ["file_name", "position"], "left").withColumn("field", meaning(F.col("heading"), aliases)).withColumn("_again", F.row_number().over(again))
    field = F.when(F.col("_again") > 1, F.concat_ws("#", "field", "_again")).otherwise(F.col("field"))
    return columns.withColumn("field", field).drop("_again").join(feeds, "file_name").drop("file_month")


def column_changes(catalogue: DataFrame) -> DataFrame:
    """feed_code, file_name, change, heading: what differs between each file and its feed's file before it.

    The files in which a feed has a field fall into islands of consecutive numbers. An island that starts after the feed's first file
    is ``added`` there; one that ends before its last is ``removed`` in the file after, under its last heading. Inside an island a
    heading that differs from the one before is ``renamed``, a type that differs ``type_changed``, unless either is unknown.
    """
    from pyspark.sql import Window

    w = Window.partitionBy("feed_code", "field").orderBy("seq")
    c = catalogue.withColumn("_seq", F.lag("seq").over(w)).withColumn("_heading", F.lag("heading").over(w)).withColumn("_type", F.lag("type").over(w)).withColumn("_next", F.lead("seq").over(w))
    inside = F.col("_seq") == F.col("seq") - 1
    ends = F.coalesce(F.col("_next") != F.col("seq") + 1, F.lit(True))
    change = lambda when, name, at=F.col("seq"): F.when(when, F.struct(at.alias("seq"), F.lit(name).alias("change"), F.col("heading").alias("heading")))
    events = F.array_compact(F.array(
        change((F.col("seq") > 1) & ~F.coalesce(inside, F.lit(False)), "added"),
        change(ends, "removed", F.col("seq") + 1),
        change(inside & (F.col("heading") != F.col("_heading")), "renamed"),
        change(inside & (F.col("type") != F.col("_type")), "type_changed"),
    ))
    rows = c.select("feed_code", F.explode(events).alias("e")).select("feed_code", "e.*")
    names = catalogue.select("feed_code", "seq", "file_name").distinct()
    return rows.join(names, ["feed_code", "seq"]).select("feed_code", "file_name", "change", "heading")


def unified_table(lines: DataFrame, files: DataFrame, fields: dict[str, str], aliases: Aliases) -> DataFrame:
    """All files as one table: file_name, line_no and ``fields`` cast by the alias table; cells that don't read are null.

    Every other column goes into ``others``, a map from field to text, so that none is lost; the second of a meaning is
    field#2. Records with broken structure aren't
    rows; rejected_cells reports them.
    """
    r = parse_files(lines).where("reason is null and headings is not null").join(files.select("file_name").distinct(), "file_name", "left_semi")
    r = r.withColumn("_fields", _field_names(aliases))
    cell = lambda f: F.when(F.array_position("_fields", f) > 0, F.get("cells", (F.array_position("_fields", f) - 1).cast("int")))
    return r.select("file_name", "line_no", *[coerce(cell(f), k).alias(f) for f, k in fields.items()], _others(fields).alias("others"))
