"""Queries of the general training-data problems: 1 (column profiles), 3 (rows that fail), 5 (drift), 7 (timestamps)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import column_profile as cp
from quern.operators import feeds
from quern.operators.instants import normalise_instants
from quern.plans.customer_tables import COLUMNS, FEED_HEADINGS, FEED_KINDS, FIELD_SPECS, FIELDS, customers, feed_aliases
from quern.sources.records import parse_files
from quern.sources.tables import table

#: When a load's measure is a case.
BOUNDS = {
    "completeness": cp.Bound(apart=0.20),
    "validity": cp.Bound(apart=0.20),
    "distribution": cp.Bound(apart=0.20),
    "range": cp.Bound(times=4.0, part=0.25),
    "distinct": cp.Bound(part=0.65),
}


NAMES = {(t, f): c for t, columns in COLUMNS.items() for f, c in zip(FIELDS, columns, strict=False)}


def _named(df: DataFrame) -> DataFrame:
    """With each table's own name for a field; the fields that a table doesn't have are left out."""
    pairs = F.create_map(*[F.lit(x) for (t, f), c in NAMES.items() for x in (f"{t} {f}", c)])
    own = F.try_element_at(pairs, F.concat_ws(" ", "_load.table_name", "column_name"))
    fields = [c for c in df.columns if c not in ("_load", "column_name")]
    return df.select("_load.table_name", "_load.load_id", F.col("column_name").alias("role"), own.alias("column_name"), *fields).where("column_name is not null")


def _customers(spark: SparkSession, folder: str) -> DataFrame:
    """The three tables as one, each load known by its table and id."""
    tables = [table(spark, folder, t).select(F.struct(F.lit(t).alias("table_name"), "load_id").alias("_load"), *[F.col(NAMES[t, f]).alias(f) if (t, f) in NAMES else F.lit(None).cast("string").alias(f) for f in FIELDS]) for t in COLUMNS]
    return reduce(DataFrame.unionByName, tables)


def p1_profile(spark: SparkSession, folder: str) -> DataFrame:
    """What is known of every column of every load."""
    df = _customers(spark, folder)
    m = cp.number_medians(df, "_load", ["lifetime_value"]).withColumnsRenamed({"_load": "_l", "column_name": "_c"})
    p = cp.profile_columns(df, "_load", FIELD_SPECS).join(m, F.col("_load").eqNullSafe(F.col("_l")) & (F.col("column_name") == F.col("_c")), "left").drop("_l", "_c")
    return _named(p).drop("role").withColumns({c: F.col(c).cast("string") for c in ("s1", "s2", "s3", "s4")})


def p1_shifts(spark: SparkSession, folder: str) -> DataFrame:
    """Standardised difference of each load's numbers from those of the table's other loads."""
    p = cp.profile_columns(_customers(spark, folder), "_load", [c for c in FIELD_SPECS if c.kind == "float"], types=False, distinct=False, moments=True)
    return cp.standardised_shifts(_named(p), "load_id", "table_name")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    """load_id, column_name, measure of each departure from the table's other loads or from the recorded profile."""
    df = _customers(spark, folder)
    p = _named(cp.profile_columns(df, "_load", FIELD_SPECS, types=False, distinct=False))
    share = lambda a, b: F.when(b > 0, a.cast("double") / b)
    n = F.col("non_empty")
    rows = p.select("table_name", "load_id", "column_name", F.explode(F.array(
        F.struct(F.lit("completeness").alias("measure"), F.when(~F.col("role").isin("customer_id", "full_name"), share(n, F.col("rows"))).alias("x")),
        F.struct(F.lit("validity").alias("measure"), share(F.col("valid"), n).alias("x")),
        F.struct(F.lit("distribution").alias("measure"), share(F.col("trues"), F.col("valid")).alias("x")),
    )).alias("m")).select("table_name", "load_id", "column_name", "m.*")
    different = _named(cp.distinct_cells(df, "_load", ["email", "signup_date"]))
    different = different.select("table_name", "load_id", "column_name", F.lit("distinct").alias("measure"), share(F.col("distinct_values"), F.col("cells")).alias("x"))
    middle = _named(cp.number_medians(df, "_load", ["lifetime_value"])).select("table_name", "load_id", "column_name", F.lit("range").alias("measure"), F.col("median").alias("x"))
    found = cp.departures(rows.unionByName(different).unionByName(middle), "table_name", "load_id", BOUNDS).select("load_id", "column_name", "measure")
    recorded = cp.recorded_differences(p, "load_id", table(spark, folder, "column_profiles")).select("load_id", "column_name", F.lit("recorded").alias("measure"))
    return found.unionByName(recorded)


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """rec_id and norm of each readable text that isn't yet a plain ISO date."""
    sites = table(spark, folder, "sites").groupBy("site_code").agg(F.min("time_zone").alias("time_zone"))
    rows = customers(spark, folder, ["signup_date"]).select("rec_id", "site_code", "signup_date").where(~F.col("signup_date").rlike(r"^\d{4}-\d{2}-\d{2}$"))
    # No hint: the planner broadcasts the sites only if their size is known to be small.
    out = normalise_instants(rows.join(sites, "site_code", "left"), "signup_date", "time_zone")
    return out.select("rec_id", "instant.norm").where("norm is not null")


CUSTOMER_FIELDS = {"customer_id": "string", "full_name": "string", "email": "string", "signup_date": "date", "lifetime_value": "float", "active": "boolean", "notes": "string"}
EXCEPTION_FIELDS = {"file": "string", "row": "integer", "column": "string", "value": "string", "kind": "string", "severity": "string", "reason": "string"}


def _records(spark: SparkSession, folder: str) -> DataFrame:
    return feeds.rejected_cells(parse_files(table(spark, folder, "raw_lines")), feed_aliases(spark, folder), FEED_KINDS)


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, line_no, reason of each line that can't be loaded."""
    return _records(spark, folder).select("file_name", "line_no", F.explode("reasons").alias("reason"))


def p3_rejects(spark: SparkSession, folder: str) -> DataFrame:
    """As p3_found, and with the reason headings each line of a file without readable headings."""
    return feeds.reported_lines(table(spark, folder, "raw_lines"), feed_aliases(spark, folder), FEED_KINDS)


def p3_customers(spark: SparkSession, folder: str) -> DataFrame:
    """The customer lines that can be loaded, as typed rows."""
    return feeds.loaded_rows(_records(spark, folder).where("array_contains(headings, 'kind') = false"), CUSTOMER_FIELDS, feed_aliases(spark, folder))


def p3_exceptions(spark: SparkSession, folder: str) -> DataFrame:
    """The lines of exception logs that can be loaded, as typed rows."""
    return feeds.loaded_rows(_records(spark, folder).where("array_contains(headings, 'kind')"), EXCEPTION_FIELDS, feed_aliases(spark, folder))


def _feed_files(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    files = table(spark, folder, "raw_files").where(F.col("feed_code").rlike("^(nth|sth|est)-"))
    return table(spark, folder, "raw_lines").join(files.select("file_name"), "file_name", "left_semi"), files


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    """file_name, change, heading of each change between a customer feed's files."""
    return feeds.column_changes(feeds.column_catalogue(*_feed_files(spark, folder), feed_aliases(spark, folder))).select("file_name", "change", "heading")


def p5_catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """Every column of every file of the customer feeds, with meaning and type."""
    return feeds.column_catalogue(*_feed_files(spark, folder), feed_aliases(spark, folder))


def p5_table(spark: SparkSession, folder: str) -> DataFrame:
    """All files of the customer feeds as one table."""
    return feeds.unified_table(*_feed_files(spark, folder), CUSTOMER_FIELDS, feed_aliases(spark, folder))


QUERIES = {
    "p1_profile": p1_profile,
    "p1_shifts": p1_shifts,
    "p1_found": p1_found,
    "p3_found": p3_found,
    "p3_rejects": p3_rejects,
    "p3_customers": p3_customers,
    "p3_exceptions": p3_exceptions,
    "p5_found": p5_found,
    "p5_catalogue": p5_catalogue,
    "p5_table": p5_table,
    "p7_found": p7_found,
}


# ---- the same in SQL, where SQL can express it

_BLANK_FREE = "nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '')"
_NUMBER = "case when regexp_full_match({x}, '[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') then try_cast(replace({x}, ',', '') as double) when regexp_full_match({x}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then try_cast({x} as double) end"
_TRUTH = "case when lower({x}) in ('true', 't', 'yes', 'y', '1') then true when lower({x}) in ('false', 'f', 'no', 'n', '0') then false end"
_MAIL = "regexp_full_match({x}, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')"


# Cells of a record whose quoting is whole: cut at the commas outside quotes, then unquoted.
_WHOLE = r"""regexp_full_match(raw_line, '(?:"(?:[^"]|"")*"|[^",]*)(?:,(?:"(?:[^"]|"")*"|[^",]*))*', 's')"""
_CUT = r"""[case when starts_with(c, '"') then replace(c[2:-2], '""', '"') else c end for c in regexp_extract_all(',' || raw_line, ',("(?:[^"]|"")*"|[^",]*)', 1)]"""
_SQUEEZE = "regexp_replace(lower({x}), '[^a-z0-9]+', '', 'g')"
_OWN = ", ".join(f"('{f}', '{''.join(n.split())}')" for f, names in FEED_HEADINGS.items() for n in names)
#: al: the alias table; m: meaning of the heading whose letters and digits are k.
_ALIASES = f"""al as (select min(f) as f, k from (select field_name as f, {_SQUEEZE.format(x="unnest(string_split(field_name || ';' || coalesce(synonyms, ''), ';'))")} as k from canonical_fields where field_name in ({", ".join(f"'{f}'" for f in FEED_HEADINGS)}) union all select * from (values {_OWN}) v(f, k)) where k <> '' group by k)"""
_MEANS = "coalesce((select al.f from al where al.k = s.k), s.k)"
_MOMENT = "coalesce(" + ", ".join(
    f"case when regexp_full_match({{x}}, '{p}') then try_strptime({{x}}, '{f}') end"
    for p, f in [
        ("\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}", "%Y-%m-%d"), ("\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}", "%d/%m/%Y"), ("\\d{{1,2}}/\\d{{1,2}}/\\d{{4}}", "%m/%d/%Y"), ("\\d{{1,2}}-\\d{{1,2}}-\\d{{4}}", "%d-%m-%Y"),
        ("\\d{{4}}/\\d{{1,2}}/\\d{{1,2}}", "%Y/%m/%d"), ("\\d{{1,2}} [A-Za-z]{{3}} \\d{{4}}", "%d %b %Y"), ("\\d{{1,2}} [A-Za-z]+ \\d{{4}}", "%d %B %Y"),
        ("\\d{{4}}-\\d{{1,2}}-\\d{{1,2}}T\\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}", "%Y-%m-%dT%H:%M:%S"), ("\\d{{4}}-\\d{{1,2}}-\\d{{1,2}} \\d{{1,2}}:\\d{{1,2}}:\\d{{1,2}}", "%Y-%m-%d %H:%M:%S"), ("\\d{{1,2}}/\\d{{1,2}}/\\d{{4}} \\d{{1,2}}:\\d{{1,2}}", "%d/%m/%Y %H:%M"),
    ]
) + ")"
#: f: each file's headings; q: each record below them with its cells; x: each cell with its heading, meaning and stripped text.
_LINES = f"""{_ALIASES}, f as (select file_name, {_CUT} as heads from raw_lines where line_no = 1),
q as (select r.file_name, line_no, heads, {_WHOLE} as whole, {_CUT} as cells from raw_lines r join f using (file_name) where line_no > 1 and trim(raw_line) <> ''),
x as (select file_name, line_no, position, heads[position] as heading, {_MEANS} as field, nullif(trim(cells[position]), '') as x from (select *, unnest(range(1, len(heads) + 1)) as position, regexp_replace(lower(heads[position]), '[^a-z0-9]+', '', 'g') as k from q where whole and len(cells) = len(heads)) s)"""


def _cells() -> str:
    """Every cell of the three tables: table_name, load_id, column_name, role, x (null if blank)."""
    parts = [f"select '{t}' as table_name, load_id, '{c}' as column_name, '{f}' as role, {_BLANK_FREE.format(c=c)} as x from {t}" for (t, f), c in NAMES.items()]
    return " union all ".join(parts)


SQL: dict[str, str] = {
    "p1_found": f"""
with cells as ({_cells()}), v as (select *, case role when 'email' then {_MAIL.format(x="x")} when 'lifetime_value' then {_NUMBER.format(x="x")} is not null when 'active' then {_TRUTH.format(x="x")} is not null end as ok,
  case role when 'lifetime_value' then {_NUMBER.format(x="x")} end as number, case role when 'active' then {_TRUTH.format(x="x")} end as truth from cells),
p as (select table_name, load_id, column_name, role, count(*) as rows, count(x) as filled, count(*) filter (ok) as valid, count(*) filter (truth) as trues, median(number) as middle, count(distinct x) as different from v group by all),
m as (select table_name, load_id, column_name, 'completeness' as measure, filled / rows as value from p where role not in ('customer_id', 'full_name')
  union all select table_name, load_id, column_name, 'validity', valid / filled from p where role in ('email', 'lifetime_value', 'active') and filled > 0
  union all select table_name, load_id, column_name, 'distribution', trues / valid from p where role = 'active' and valid > 0
  union all select table_name, load_id, column_name, 'range', middle from p where role = 'lifetime_value'
  union all select table_name, load_id, column_name, 'distinct', different / filled from p where role in ('email', 'signup_date') and filled > 0),
c as (select *, median(value) over (partition by table_name, column_name, measure) as mid from m where value is not null),
r as (select load_id, column_name, arg_max(non_empty, (coalesce(profiled_at, timestamp '0001-01-01'), non_empty)) as non_empty from column_profiles where non_empty is not null group by all)
select load_id, column_name, measure from c where case measure when 'range' then value > 4 * mid or value < 0.25 * mid when 'distinct' then value < 0.65 * mid else abs(value - mid) > 0.20 end
union all select p.load_id, p.column_name, 'recorded' from p join r on p.load_id = r.load_id and p.column_name = r.column_name where p.filled <> r.non_empty""",
    "p3_found": f"""
with {_LINES}
select file_name, line_no, 'quoting' as reason from q where not whole
union all select file_name, line_no, 'field_count' from q where whole and len(cells) <> len(heads)
union all select distinct file_name, line_no, case field when 'signup_date' then 'date' when 'active' then 'boolean' else 'number' end from x where x is not null and case field
  when 'lifetime_value' then {_NUMBER.format(x="x")} is null when 'row' then not regexp_full_match(x, '[0-9]+') when 'signup_date' then {_MOMENT.format(x="x")} is null when 'active' then {_TRUTH.format(x="x")} is null else false end""",
    "p5_found": f"""
with {_LINES}, t as (select file_name, position, case when regexp_full_match(x, '[+-]?[0-9]+') then 1 when {_NUMBER.format(x="x")} is not null then 2 when {_TRUTH.format(x="x")} is not null then 3
  when {_MOMENT.format(x="x")} is not null then case when x like '%:%' then 5 else 4 end else 6 end as type, count(*) as n from x where x is not null group by all),
m as (select file_name, position, arg_max(type, (n, -type)) as type from t group by all),
s as (select file_name, feed_code, row_number() over (partition by feed_code order by file_month nulls first, file_name) as seq from raw_files where regexp_matches(feed_code, '^(nth|sth|est)-')),
h as (select file_name, position, heads[position] as heading, {_MEANS} as field from (select *, unnest(range(1, len(heads) + 1)) as position, regexp_replace(lower(heads[position]), '[^a-z0-9]+', '', 'g') as k from f) s),
c as (select feed_code, seq, file_name, heading, field, type from h join s using (file_name) left join m using (file_name, position)),
p as (select now.*, old.heading as old_heading, old.type as old_type from c now left join c old on now.feed_code = old.feed_code and now.field = old.field and old.seq = now.seq - 1)
select file_name, 'added' as change, heading from p where old_heading is null and seq > 1
union all select file_name, 'renamed', heading from p where old_heading <> heading
union all select file_name, 'type_changed', heading from p where old_type <> type
union all select s.file_name, 'removed', old.heading from c old join s on s.feed_code = old.feed_code and s.seq = old.seq + 1 where not exists (select 1 from c now where now.feed_code = old.feed_code and now.seq = old.seq + 1 and now.field = old.field)""",
}
