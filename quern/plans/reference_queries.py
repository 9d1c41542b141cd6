"""Queries of the consolidation operators over the standard tables, each with the SQL that must give the same rows.

Dirty text is made from the clean tables by the same expressions on both sides; every table is used whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.config import Config, config_from
from quern.functions.coerce import coerce, failed
from quern.functions.text import clean, normalise_heading
from quern.operators import metrics, profiling, remediate, rules
from quern.operators.reconcile import reconcile
from quern.session import cut_lineage
from quern.sources.tables import spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


# ---- raw orders: every field as people type it

_RAW = """
select 'part_' || (o_orderkey % 4) || '.csv' as _source_file, o_orderkey as _row,
  case when o_orderkey % 97 = 0 then ' ' else 'O-' || o_orderkey end as id,
  case o_orderkey % 7 when 0 then (cents // 100) || '.' || lpad((cents % 100)::varchar, 2, '0')
    when 1 then case when cents >= 100000 then (cents // 100000) || ',' || lpad((cents // 100 % 1000)::varchar, 3, '0') || '.' || lpad((cents % 100)::varchar, 2, '0') else (cents // 100)::varchar end
    when 2 then ' ' || (cents // 100) || ' ' when 3 then '-' || (cents // 100) || '.5' when 4 then 'n/a' when 5 then '' else '+' || (cents // 100) end as amount,
  case when o_orderkey % 101 = 0 then 'soon' else case o_orderkey % 6 when 0 then strftime(o_orderdate, '%Y-%m-%d') when 1 then strftime(o_orderdate, '%d/%m/%Y')
    when 2 then strftime(o_orderdate, '%d-%m-%Y') when 3 then strftime(o_orderdate, '%Y/%m/%d') when 4 then strftime(o_orderdate, '%d %b %Y') else strftime(o_orderdate, '%m/%d/%Y') end end as day,
  (['Yes', 'no', 'TRUE', 'f', '1', '0', 'maybe', ''])[o_orderkey % 8 + 1] as active,
  o_orderpriority as priority, o_orderstatus as status
from (select *, cast(round(o_totalprice * 100) as bigint) as cents from orders)
"""
_TRIMMED = "nullif(trim(amount), '')"
_AMOUNT = f"case when regexp_full_match({_TRIMMED}, '[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') then try_cast(replace({_TRIMMED}, ',', '') as double) when regexp_full_match({_TRIMMED}, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then try_cast({_TRIMMED} as double) end"
_DAY = "coalesce(" + ", ".join(f"case when regexp_full_match(day, '{p}') then try_strptime(day, '{f}') end" for p, f in [("\\d{4}-\\d{1,2}-\\d{1,2}", "%Y-%m-%d"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "%d/%m/%Y"), ("\\d{1,2}/\\d{1,2}/\\d{4}", "%m/%d/%Y"), ("\\d{1,2}-\\d{1,2}-\\d{4}", "%d-%m-%Y"), ("\\d{4}/\\d{1,2}/\\d{1,2}", "%Y/%m/%d"), ("\\d{1,2} \\w{3} \\d{4}", "%d %b %Y")]) + ")::date"
_BOOL = "case when lower(active) in ('true', 't', 'yes', 'y', '1') then true when lower(active) in ('false', 'f', 'no', 'n', '0') then false end"
_TYPED = f"select _source_file, _row, nullif(trim(id), '') as id, {_AMOUNT} as amount, {_DAY} as day, {_BOOL} as active, priority, status, amount as amount_text, day as day_text, active as active_text from ({_RAW})"

CONFIG: Config = config_from({
    "fields": [
        {"name": "id", "type": "string", "required": True},
        {"name": "amount", "type": "float", "rules": [{"rule": "range", "min": 0, "max": 400000, "severity": "warning"}]},
        {"name": "day", "type": "date", "rules": [{"rule": "range", "min": "1993-01-01"}]},
        {"name": "active", "type": "boolean"},
        {"name": "priority", "type": "string", "rules": [{"rule": "allowed_values", "values": ["1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED"], "severity": "warning"}]},
        {"name": "status", "type": "string", "rules": [{"rule": "regex", "pattern": "[OF]"}]},
    ],
    "validation": {"keys": ["id"]},
})
HEADINGS = {f.name: f.name for f in CONFIG.fields}


def raw_orders(spark: SparkSession, folder: str) -> DataFrame:
    o = spread(table(spark, folder, "orders")).withColumn("cents", F.round(F.col("o_totalprice") * 100).cast("bigint"))
    return o.selectExpr(
        "concat('part_', o_orderkey % 4, '.csv') as _source_file", "o_orderkey as _row", "case when o_orderkey % 97 = 0 then ' ' else concat('O-', o_orderkey) end as id",
        """case o_orderkey % 7 when 0 then concat(cents div 100, '.', lpad(cast(cents % 100 as string), 2, '0'))
           when 1 then case when cents >= 100000 then concat(cents div 100000, ',', lpad(cast(cents div 100 % 1000 as string), 3, '0'), '.', lpad(cast(cents % 100 as string), 2, '0')) else cast(cents div 100 as string) end
           when 2 then concat(' ', cents div 100, ' ') when 3 then concat('-', cents div 100, '.5') when 4 then 'n/a' when 5 then '' else concat('+', cents div 100) end as amount""",
        """case when o_orderkey % 101 = 0 then 'soon' else case o_orderkey % 6 when 0 then date_format(o_orderdate, 'yyyy-MM-dd') when 1 then date_format(o_orderdate, 'dd/MM/yyyy')
           when 2 then date_format(o_orderdate, 'dd-MM-yyyy') when 3 then date_format(o_orderdate, 'yyyy/MM/dd') when 4 then date_format(o_orderdate, 'dd MMM yyyy') else date_format(o_orderdate, 'MM/dd/yyyy') end end as day""",
        "element_at(array('Yes', 'no', 'TRUE', 'f', '1', '0', 'maybe', ''), cast(o_orderkey % 8 + 1 as int)) as active", "o_orderpriority as priority", "o_orderstatus as status",
    )


def checked_orders(spark: SparkSession, folder: str) -> DataFrame:
    """Coerced and validated in one pass: _v holds what is wrong with each row."""
    return rules.validate(rules.typed(raw_orders(spark, folder), CONFIG, HEADINGS, ["_source_file", "_row"]), CONFIG)


# ---- coercion


@query(f"select _row, id, amount, cast(day as varchar) as day, active from ({_TYPED})")
def coerce_orders(spark: SparkSession, folder: str) -> DataFrame:
    columns, _ = rules.coerced(CONFIG, HEADINGS)
    return raw_orders(spark, folder).select("_row", *columns).select("_row", "id", "amount", F.col("day").cast("string").alias("day"), "active")


_INTS = "(['12', ' 34 ', '1,234', '12.7', '1e3', 'x', '', '-7', '+5', '1,23', '99999999999999999999'])[(s_suppkey % 11 + 1)::int]"


@query(
    f"select s_suppkey, case when regexp_full_match(t, '[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') and regexp_full_match(replace(t, ',', ''), '[+-]?\\d+') then try_cast(replace(t, ',', '') as bigint) when regexp_full_match(t, '[+-]?\\d+') then try_cast(t as bigint) end as n from (select s_suppkey, nullif(trim({_INTS}), '') as t from supplier)"
)
def coerce_integer(spark: SparkSession, folder: str) -> DataFrame:
    texts = F.expr("element_at(array('12', ' 34 ', '1,234', '12.7', '1e3', 'x', '', '-7', '+5', '1,23', '99999999999999999999'), cast(s_suppkey % 11 + 1 as int))")
    return table(spark, folder, "supplier").select("s_suppkey", coerce(texts, "integer").alias("n"))


@query("""select event_id, cast(coalesce(case when event_id % 4 = 0 then date_trunc('second', ts) end, case when event_id % 4 = 1 then date_trunc('minute', ts) end, case when event_id % 4 = 2 then date_trunc('day', ts) end) as varchar) as at from events""")
def coerce_datetime(spark: SparkSession, folder: str) -> DataFrame:
    """Times, day-first times, dates as midnights, and what doesn't read."""
    text = F.expr("""case event_id % 4 when 0 then date_format(ts, "yyyy-MM-dd'T'HH:mm:ss") when 1 then date_format(ts, 'dd/MM/yyyy HH:mm') when 2 then date_format(ts, 'yyyy/MM/dd') else date_format(ts, 'yyyy-MM-dd HH') end""")
    return table(spark, folder, "events").select("event_id", coerce(text, "datetime").cast("string").alias("at"))


@query("select c_custkey, nullif(trim(case c_custkey % 4 when 0 then '  ' when 1 then c_name || ' ' when 2 then '' else ' ' || c_mktsegment end), '') as t from customer")
def coerce_string(spark: SparkSession, folder: str) -> DataFrame:
    text = F.expr("case c_custkey % 4 when 0 then '  ' when 1 then concat(c_name, ' ') when 2 then '' else concat(' ', c_mktsegment) end")
    return table(spark, folder, "customer").select("c_custkey", coerce(text, "string").alias("t"))


@query(f"""select sum((amount is null and nullif(trim(amount_text), '') is not null)::int)::bigint as amount, sum((day is null)::int)::bigint as day, sum((active is null and active_text <> '')::int)::bigint as active from ({_TYPED})""")
def coerce_failures(spark: SparkSession, folder: str) -> DataFrame:
    return raw_orders(spark, folder).agg(*[F.count_if(failed(F.col(c), k)).alias(c) for c, k in (("amount", "float"), ("day", "date"), ("active", "boolean"))])


# ---- validation

_COERCION = " union all ".join(
    f"select _source_file as file, _row as row, '{c}' as \"column\", {c}_text as value, 'coercion' as kind, 'error' as severity, 'cannot coerce to {k} for field ''{c}''' as reason from t where {c} is null and nullif(trim({c}_text), '') is not null"
    for c, k in (("amount", "float"), ("day", "date"), ("active", "boolean"))
)
_RULES = """
select _source_file, _row, 'id', null, 'rule_required', 'error', 'required field ''id'' is empty' from ok where id is null union all
select _source_file, _row, 'amount', cast(amount as varchar), 'rule_range', 'warning', 'out of range for field ''amount'' (min 0, max 400000)' from ok where amount < 0 or amount > 400000 union all
select _source_file, _row, 'day', cast(day as varchar), 'rule_range', 'error', 'out of range for field ''day'' (min 1993-01-01)' from ok where day < date '1993-01-01' union all
select _source_file, _row, 'priority', priority, 'rule_allowed_values', 'warning', 'value not in allowed values for field ''priority''' from ok where priority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED') union all
select _source_file, _row, 'status', status, 'rule_regex', 'error', 'value does not match pattern for field ''status''' from ok where not regexp_full_match(status, '[OF]')"""
_CHECKED = f"with t as ({_TYPED}), c as ({_COERCION}), ok as (select t.* from t where not exists (select 1 from c where c.file = t._source_file and c.row = t._row)), r as (select * from c union all {_RULES})"


@query(f"{_CHECKED} select file, row, \"column\", value, kind, severity, reason from r")
def validate_all(spark: SparkSession, folder: str) -> DataFrame:
    return rules.records(checked_orders(spark, folder))


@query(f"{_CHECKED} select kind, count(*) filter (severity = 'error') as errors, count(*) filter (severity = 'warning') as warnings from r group by kind")
def exceptions_by_kind(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.by_kind(rules.records(checked_orders(spark, folder)))


@query(f"{_CHECKED} select count(*) filter (severity = 'error') as error, count(*) filter (severity = 'warning') as warning from r")
def severity_counts(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.severity_counts(rules.records(checked_orders(spark, folder)))


@query(f"{_CHECKED} select _source_file, _row from t where not exists (select 1 from r where r.file = t._source_file and r.row = t._row and severity = 'error')")
def clean_rows(spark: SparkSession, folder: str) -> DataFrame:
    return rules.clean_rows(checked_orders(spark, folder)).select("_source_file", "_row")


@query(f"{_CHECKED} select _source_file, _row from t where not exists (select 1 from r where r.file = t._source_file and r.row = t._row and severity = 'error')")
def held_anti_join(spark: SparkSession, folder: str) -> DataFrame:
    """The same by an anti join with the records, as records from elsewhere need."""
    checked = checked_orders(spark, folder)
    return rules.drop_held(checked, rules.records(checked)).select("_source_file", "_row")


_OPS = {"eq": ("==", "="), "ne": ("!=", "<>"), "lt": ("<", "<"), "le": ("<=", "<="), "gt": (">", ">"), "ge": (">=", ">=")}


@query(
    " union all ".join(
        f"select '{n}' as operator, count(*) as violations from lineitem l join orders o on l.l_orderkey = o.o_orderkey where not (cast(l_shipdate as date) {sql} cast(o_orderdate as date))" for n, (_, sql) in _OPS.items()
    )
)
def rule_cross_field(spark: SparkSession, folder: str) -> DataFrame:
    """Violations of each of the six comparisons of two dates, in one pass."""
    j = table(spark, folder, "lineitem").join(table(spark, folder, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("l_shipdate").cast("date").alias("ship"), F.col("o_orderdate").cast("date").alias("placed"), F.lit("l").alias("_source_file"), F.lit(1).cast("bigint").alias("_row"))
    config = config_from({"fields": [{"name": "ship", "type": "date"}, {"name": "placed", "type": "date"}], "validation": {"cross_field": [{"field": "ship", "operator": op, "other": "placed"} for op, _ in _OPS.values()]}})
    counts = rules.validate(j, config).select(F.explode("_v.reason").alias("reason")).groupBy("reason").agg(F.count(F.lit(1)).alias("n"))
    names = spark.createDataFrame([(n, f"'ship' must be {op} 'placed'") for n, (op, _) in _OPS.items()], "operator string, r string")
    return names.join(counts, F.col("r") == F.col("reason"), "left").select("operator", F.coalesce("n", F.lit(0)).alias("violations"))


# ---- reconciliation: order lines, whose key of order and number often repeats

_LINES = """select 'part_' || (l_suppkey % 4) || '.csv' as _source_file, l_orderkey * 1000 + row_number() over (partition by l_orderkey order by l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) as _row,
 l_orderkey as k, l_linenumber::bigint as line, {quantity} as quantity, {flag} as flag from lineitem"""
_FIRM = _LINES.format(quantity="l_quantity", flag="l_returnflag")
_LOOSE = _LINES.format(quantity="case when l_partkey % 2 = 0 then cast(l_orderkey % 9 as double) end", flag="case when l_suppkey % 3 = 0 then 'Z' end")


def lines_config(strategy: dict | None = None) -> Config:
    return config_from({"fields": [{"name": "k", "type": "integer"}, {"name": "line", "type": "integer"}, {"name": "quantity", "type": "float"}, {"name": "flag", "type": "string"}], "validation": {"keys": ["k", "line"]} | ({"survivorship": strategy} if strategy else {})})


def lines(spark: SparkSession, folder: str, loose: bool = False) -> DataFrame:
    """Rows numbered within their order, in a total order; every tie is between equal rows."""
    from pyspark.sql import Window

    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    t = table(spark, folder, "lineitem").withColumn("_row", F.col("l_orderkey") * 1000 + F.row_number().over(w))
    quantity, flag = ("case when l_partkey % 2 = 0 then cast(l_orderkey % 9 as double) end", "case when l_suppkey % 3 = 0 then 'Z' end") if loose else ("l_quantity", "l_returnflag")
    return t.selectExpr("concat('part_', l_suppkey % 4, '.csv') as _source_file", "_row", "l_orderkey as k", "cast(l_linenumber as bigint) as line", f"{quantity} as quantity", f"{flag} as flag", "_row as _ord")


_GROUPS = "select k, line, count(*) as n, count(distinct quantity) > 1 or count(distinct flag) > 1 as clash from l group by k, line"


@query(f"with l as ({_FIRM}), g as ({_GROUPS}) select l._source_file, l._row, l.k, l.line, l.quantity, l.flag from l join g using (k, line) where n = 1")
def reconcile_unique(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile(lines(spark, folder), lines_config()).frame.where("not _grouped").drop("_ord", "_grouped", "_rows")


@query(f"""with l as ({_LOOSE}), g as ({_GROUPS}), f as (select k, line, _source_file, min(_row) as r from l group by all)
select string_agg(_source_file, '; ' order by r) as _source_file, min(r)::bigint as _row, k, line, (select arg_min(quantity, _row) from l where l.k = f.k and l.line = f.line and quantity is not null) as quantity, (select arg_min(flag, _row) from l where l.k = f.k and l.line = f.line and flag is not null) as flag
from f join g using (k, line) where n > 1 and not clash group by k, line""")
def reconcile_merge(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile(lines(spark, folder, loose=True), lines_config()).frame.where("_grouped").drop("_ord", "_grouped", "_rows")


_FILES = "(select string_agg(_source_file, ', ' order by r) from (select _source_file, min(_row) as r from l x where x.k = l.k and x.line = l.line group by _source_file))"


@query(f"""with l as ({_FIRM}), g as ({_GROUPS}), d as (select k, line, count(distinct quantity) > 1 as q, count(distinct flag) > 1 as f from l group by k, line),
o as (select k, line, string_agg(_source_file, ', ' order by r) as file from (select k, line, _source_file, min(_row) as r from l group by all) group by k, line)
select o.file, c as "column", string_agg(_source_file || ' row ' || _row || ': ' || case c when 'quantity' then cast(quantity as varchar) else flag end, ' | ' order by _row) as value, 'error' as severity, 'conflicting values for key ''' || k || '/' || line || '''; no survivorship strategy configured; rows held for review' as reason
from l join d using (k, line) join o using (k, line) cross join (values ('quantity'), ('flag')) v(c) where (c = 'quantity' and d.q) or (c = 'flag' and d.f) group by k, line, c, o.file""")
def reconcile_conflicts(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile(lines(spark, folder), lines_config()).exceptions.where("kind = 'conflict'").select("file", "column", "value", "severity", "reason")


@query(f"""with l as ({_LOOSE}), g as ({_GROUPS}), o as (select k, line, string_agg(_source_file, ', ' order by r) as file from (select k, line, _source_file, min(_row) as r from l group by all) group by k, line)
select file, 'k, line' as "column", k || '/' || line as value, 'warning' as severity, 'key ''' || k || '/' || line || ''' appears in ' || n || ' rows with no disagreement; merged into one' as reason from g join o using (k, line) where n > 1 and not clash""")
def reconcile_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile(lines(spark, folder, loose=True), lines_config()).exceptions.where("kind = 'duplicate_key'").select("file", "column", "value", "severity", "reason")


_MTIMES = {"part_0.csv": 10.0, "part_1.csv": 30.0, "part_2.csv": 20.0, "part_3.csv": 30.0}


@query(f"""with l as ({_FIRM}), g as ({_GROUPS}), m as (select *, case _source_file when 'part_0.csv' then 10 when 'part_2.csv' then 20 else 30 end as t from l),
b as (select k, line, max(t) as t, count(distinct _source_file) as files from m group by k, line), c as (select m.*, count(*) over (partition by k, line) as cand from m join b using (k, line, t) where files > 1)
select c._source_file, c._row, c.k, c.line, c.quantity, c.flag from c join g using (k, line) where cand = 1 and clash""")
def survivor_newest(spark: SparkSession, folder: str) -> DataFrame:
    r = reconcile(lines(spark, folder), lines_config({"strategy": "newest_file"}), _MTIMES)
    clash = lines(spark, folder).groupBy("k", "line").agg((F.count_distinct("quantity") + F.count_distinct("flag")).alias("d")).where("d > 2")
    return r.frame.where("_grouped").join(clash, ["k", "line"], "left_semi").select("_source_file", "_row", "k", "line", "quantity", "flag")


@query(f"""with l as ({_FIRM}), g as ({_GROUPS}), m as (select *, case _source_file when 'part_2.csv' then 0 when 'part_1.csv' then 1 else 2 end as t from l),
b as (select k, line, min(t) as t from m group by k, line), c as (select m.*, count(*) over (partition by k, line) as cand from m join b using (k, line, t) where t < 2)
select c._source_file, c._row, c.k, c.line, c.quantity, c.flag from c join g using (k, line) where cand = 1 and clash""")
def survivor_priority(spark: SparkSession, folder: str) -> DataFrame:
    r = reconcile(lines(spark, folder), lines_config({"strategy": "priority_list", "priority": ["part_2.csv", "part_1.csv"]}))
    clash = lines(spark, folder).groupBy("k", "line").agg((F.count_distinct("quantity") + F.count_distinct("flag")).alias("d")).where("d > 2")
    return r.frame.where("_grouped").join(clash, ["k", "line"], "left_semi").select("_source_file", "_row", "k", "line", "quantity", "flag")


@query(f"with l as ({_FIRM}), g as ({_GROUPS}) select coalesce(sum(n) filter (clash), 0)::bigint as rows_held, coalesce(sum(n - 1) filter (not clash), 0)::bigint as rows_superseded, count(*) filter (clash) as conflicts_held from g")
def reconcile_counters(spark: SparkSession, folder: str) -> DataFrame:
    return reconcile(lines(spark, folder), lines_config()).counters


@query("select 'c' as file, c_custkey as row, 'segment' as \"column\", 'missing_key' as kind, 'empty key column ''segment''; row held' as reason from customer where c_mktsegment = 'BUILDING'")
def missing_keys(spark: SparkSession, folder: str) -> DataFrame:
    c = table(spark, folder, "customer").select(F.lit("c").alias("_source_file"), F.col("c_custkey").alias("_row"), F.col("c_custkey").alias("key"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("segment"), F.col("c_custkey").alias("_ord"))
    config = config_from({"fields": [{"name": "key", "type": "integer"}, {"name": "segment", "type": "string"}], "validation": {"keys": ["key", "segment"]}})
    return reconcile(c, config).exceptions.where("kind = 'missing_key'").select("file", "row", "column", "kind", "reason")


# ---- remediation


@query(f"{_CHECKED} select file, row, \"column\", kind, substr(sha256(file || '|' || row || '|' || \"column\" || '|' || coalesce(value, '') || '|' || kind || '|' || reason), 1, 16) as id from r")
def fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    r = rules.records(checked_orders(spark, folder))
    return r.select("file", "row", "column", "kind", remediate.fingerprint().alias("id"))


_LOG = "select event_id as line, 'u' || (user_id % 50) as id, event_type as action, 'n' || event_id as note from events"


@query(f"select id, action, note from (select *, row_number() over (partition by id order by line desc) as rn from ({_LOG})) where rn = 1")
def latest_resolution(spark: SparkSession, folder: str) -> DataFrame:
    log = table(spark, folder, "events").selectExpr("event_id as line", "concat('u', user_id % 50) as id", "event_type as action", "concat('n', event_id) as note")
    return remediate.latest_resolutions(log).select("id", "action", "note")


def _corrections(records: DataFrame) -> DataFrame:
    """A correction for each coercion error of a row that isn't one in three: the amount to 5, the day to a date, active to yes."""
    fix = "case column when 'amount' then map('amount', case when row % 5 = 0 then 'bad' else '5' end) when 'day' then map('day', '2001-02-03') else map('active', 'yes') end"
    return records.where("kind = 'coercion' and row % 3 <> 0").select(remediate.fingerprint().alias("id"), F.expr(fix).alias("values"))


_FIXED = f"""{_CHECKED}, e as (select * from r where severity = 'error'), fixable as (select file, row, count(*) as n, bool_and(kind = 'coercion') as all_read, bool_or(kind = 'coercion' and "column" = 'amount') as fix_amount,
bool_or(kind = 'coercion' and "column" = 'day') as fix_day, bool_or(kind = 'coercion' and "column" = 'active') as fix_active from e where row % 3 <> 0 group by file, row having bool_or(kind = 'coercion')),
fixed as (select t._source_file, t._row, t.id, case when fix_amount then 5.0 else amount end as amount, case when fix_day then date '2001-02-03' else day end as day, case when fix_active then true else active end as active, priority, status, fix_amount, all_read
from t join fixable f on f.file = t._source_file and f.row = t._row)"""


@query(f"{_FIXED} select _source_file, _row, id, amount, cast(day as varchar) as day, active from fixed where all_read and not (fix_amount and _row % 5 = 0) and id is not null and (day is null or day >= date '1993-01-01') and regexp_full_match(status, '[OF]')")
def apply_corrections(spark: SparkSession, folder: str) -> DataFrame:
    checked = cut_lineage(checked_orders(spark, folder))  # read four times below
    records = rules.records(checked)
    frame, _ = remediate.apply_corrections(checked.drop("_v"), records, CONFIG, _corrections(records))
    return frame.select("_source_file", "_row", "id", "amount", F.col("day").cast("string").alias("day"), "active")


_GOOD = "select * from fixed where all_read and not (fix_amount and _row % 5 = 0) and id is not null and (day is null or day >= date '1993-01-01') and regexp_full_match(status, '[OF]')"


@query(f"""{_FIXED}, good as ({_GOOD}) select kind, severity, count(*) as n from (
select kind, severity from r where not (severity = 'error' and exists (select 1 from good where good._source_file = r.file and good._row = r.row))
union all select 'remediated', 'warning' from good
union all select 'rule_range', 'warning' from good where amount < 0 or amount > 400000
union all select 'rule_allowed_values', 'warning' from good where priority not in ('1-URGENT', '2-HIGH', '3-MEDIUM', '4-NOT SPECIFIED')
union all select 'remediation_failed', 'error' from fixed where not exists (select 1 from good where good._source_file = fixed._source_file and good._row = fixed._row)) group by kind, severity""")
def remediation_records(spark: SparkSession, folder: str) -> DataFrame:
    """All records after remediation, by kind and severity."""
    checked = cut_lineage(checked_orders(spark, folder))
    records = rules.records(checked)
    return remediate.apply_corrections(checked.drop("_v"), records, CONFIG, _corrections(records))[1].groupBy("kind", "severity").agg(F.count(F.lit(1)).alias("n"))


_ID = "substr(sha256(file || '|' || row || '|' || \"column\" || '|' || coalesce(value, '') || '|' || kind || '|' || reason), 1, 16)"


@query(f"""{_CHECKED}, n as (select *, row % 3 = 0 or row % 7 = 0 as logged from r) select file, row, "column", kind, {_ID} as id, case when logged then case when row % 7 = 0 then 'reopened' else 'corrected' end end as action,
case when logged then case when row % 7 = 0 then 'second' else 'first' end end as note, "column" as target_field from n""")
def exceptions_left_resolutions(spark: SparkSession, folder: str) -> DataFrame:
    """Every record with its latest resolution, if any, and the field a correction would set."""
    records = rules.records(cut_lineage(checked_orders(spark, folder)))
    own = records.withColumn("id", remediate.fingerprint())
    entry = lambda line, action, note: (F.lit(line).alias("line"), "id", F.lit(action).alias("action"), F.lit(note).alias("note"))
    log = own.where("row % 3 = 0").select(*entry(1, "corrected", "first")).unionByName(own.where("row % 7 = 0").select(*entry(2, "reopened", "second")))
    return remediate.with_resolutions(records, remediate.latest_resolutions(log), CONFIG).select("file", "row", "column", "kind", "id", "action", "note", "target_field")


# ---- metrics


@query(f"{_CHECKED}, p as (select t.* from t where not exists (select 1 from r where r.file = t._source_file and r.row = t._row and severity = 'error')) " + " union all ".join(f"select '{c}' as field, count(*) as rows, count({c}) as filled from p" for c in ("id", "amount", "day", "active", "priority", "status")))
def field_completeness(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.completeness(rules.clean_rows(checked_orders(spark, folder)), [f.name for f in CONFIG.fields])


@query(f"{_CHECKED} select \"column\" as field, count(distinct (file, row)) as rows from r group by \"column\"")
def field_validity(spark: SparkSession, folder: str) -> DataFrame:
    return metrics.violating_rows(rules.records(checked_orders(spark, folder)))


@query(f"{_CHECKED}, n as (select _source_file as file, count(*) as rows from t group by 1), s as (select file, count(distinct row) filter (severity = 'error') as error_rows, count(*) filter (severity = 'warning') as warnings from r group by file) select file, rows, error_rows, warnings::bigint as warnings, greatest(0, round_even(100.0 * (1.0 - (error_rows + 0.25 * warnings) / rows), 0))::bigint as score from n join s using (file)")
def source_score(spark: SparkSession, folder: str) -> DataFrame:
    checked = checked_orders(spark, folder)
    return metrics.source_scores(checked.groupBy(F.col("_source_file").alias("file")).agg(F.count(F.lit(1)).alias("rows")), rules.records(checked))


@query("select run_id, rows_in, rows_published, case when rows_in > 0 then rows_published * 100.0 / rows_in end as quality from (select strftime(ts, '%Y%m%d') as run_id, count(*) as rows_in, count(*) filter (event_type <> 'error') as rows_published from events group by 1 order by 1 desc limit 30)")
def trends_topk(spark: SparkSession, folder: str) -> DataFrame:
    """The last 30 days of events as runs; the limit is the report's."""
    runs = table(spark, folder, "events").groupBy(F.date_format("ts", "yyyyMMdd").alias("run_id")).agg(F.count(F.lit(1)).alias("rows_in"), F.count_if(F.col("event_type") != "error").alias("rows_published"))
    return metrics.trends(runs)


@query("select run_id from (select *, lag(sha256) over (order by run_id) as before from (select n_nationkey as run_id, sha256(n_name) as sha256, case when n_nationkey % 7 = 3 then 'tampered' else lag(sha256(n_name)) over (order by n_nationkey) end as previous from nation)) where previous is distinct from before")
def chain_verify(spark: SparkSession, folder: str) -> DataFrame:
    from pyspark.sql import Window

    n = table(spark, folder, "nation").select(F.col("n_nationkey").alias("run_id"), F.sha2("n_name", 256).alias("sha256"))
    before = F.lag("sha256").over(Window.orderBy("run_id"))
    return metrics.broken_links(n.withColumn("previous_sha256", F.when(F.col("run_id") % 7 == 3, "tampered").otherwise(before)))


# ---- headings, profiles, relational pieces


@query("select heading_id, trim(regexp_replace(lower(source_column), '[^a-z0-9]+', ' ', 'g')) as heading from source_headings")
def normalised_headings(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "source_headings").select("heading_id", normalise_heading(F.col("source_column")).alias("heading"))


@query()
def heading_matches(spark: SparkSession, folder: str) -> DataFrame:
    """Each file's headings against the canonical fields, best first, one heading for a field."""
    from quern.config import Field
    from quern.operators.mapping import map_columns

    known = [(r.field_name, tuple(x.strip() for x in (r.synonyms or "").split(";"))) for r in table(spark, folder, "canonical_fields").orderBy("field_id").collect()]
    fields = tuple(Field(n, "string", synonyms=s) for n, s in known)

    def per_file(pdf):
        import pandas as pd

        headings = list(dict.fromkeys(pdf.sort_values("heading_id")["source_column"]))
        return pd.DataFrame([(pdf["file_name"].iloc[0], m.source, m.target, m.method, m.score, m.reason) for m in map_columns(headings, fields)], columns=["file_name", "source", "target", "method", "score", "reason"])

    h = table(spark, folder, "source_headings").where(clean(F.col("source_column")).isNotNull()).select("heading_id", "file_name", "source_column")
    return h.groupBy("file_name").applyInPandas(per_file, "file_name string, source string, target string, method string, score double, reason string")


_CLASS = """case when regexp_full_match(x, '[+-]?\\d+') then 'integer' when regexp_full_match(x, '[+-]?\\d+\\.\\d+') then 'float' when regexp_full_match(x, '[+-]?\\d{1,3}(,\\d{3})+(\\.\\d+)?') then 'thousands'
when lower(x) in ('true', 'false', 'yes', 'no', 'y', 'n', 't', 'f') then 'boolean' when regexp_full_match(x, '\\d{4}-\\d\\d-\\d\\d') then 'date:%Y-%m-%d' when regexp_full_match(x, '\\d\\d/\\d\\d/\\d{4}') and try_strptime(x, '%d/%m/%Y') is not null then 'date:%d/%m/%Y'
when regexp_full_match(x, '\\d\\d/\\d\\d/\\d{4}') then 'date:%m/%d/%Y' when regexp_full_match(x, '\\d\\d-\\d\\d-\\d{4}') then 'date:%d-%m-%Y' when regexp_full_match(x, '\\d{4}/\\d\\d/\\d\\d') then 'date:%Y/%m/%d' when regexp_full_match(x, '\\d\\d \\w{3} \\d{4}') then 'date:%d %b %Y' else 'text' end"""
_CELLS = f"select 'amount' as column_name, nullif(trim(amount), '') as x from ({_RAW}) union all select 'day', nullif(trim(day), '') from ({_RAW}) union all select 'active', nullif(trim(active), '') from ({_RAW})"


@query(f"select column_name, {_CLASS} as class, count(*) as n from ({_CELLS}) where x is not null group by all")
def profile_classes(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.class_counts(raw_orders(spark, folder), ["amount", "day", "active"])


_DATES = "case when o_orderkey % 2 = 0 then strftime(o_orderdate, '%Y-%m-%d') else strftime(o_orderdate, '%d/%m/%Y') end"


@query(f"""with c as (select 'k' as column_name, o_orderkey::varchar as x from orders union all select 'price', o_orderkey || '.5' from orders union all select 'priority', o_orderpriority from orders
union all select 'flag', case o_orderkey % 3 when 0 then 'Yes' when 1 then 'no' else '' end from orders union all select 'day', {_DATES} from orders union all select 'mixed', case when o_orderkey % 2 = 0 then 'yes' else '7' end from orders),
k as (select column_name, {_CLASS} as class from c where x <> '')
select column_name, count(*) as non_empty, case when bool_and(class = 'integer') then 'integer' when bool_and(class in ('integer', 'float', 'thousands')) then 'float' when bool_and(class = 'boolean') then 'boolean' when bool_and(class like 'date:%') then 'date' else 'string' end as inferred_type from k group by column_name""")
def profile_infer(spark: SparkSession, folder: str) -> DataFrame:
    p = spread(table(spark, folder, "orders")).selectExpr(
        "cast(o_orderkey as string) as k", "concat(o_orderkey, '.5') as price", "o_orderpriority as priority", "case o_orderkey % 3 when 0 then 'Yes' when 1 then 'no' else '' end as flag",
        "case when o_orderkey % 2 = 0 then date_format(o_orderdate, 'yyyy-MM-dd') else date_format(o_orderdate, 'dd/MM/yyyy') end as day", "case when o_orderkey % 2 = 0 then 'yes' else '7' end as mixed",
    )
    return profiling.inferred_types(profiling.class_counts(p, p.columns))


_TYPED_TEXTS = ["full_name", "email", "signup_date", "lifetime_value", "active"]
_EDGES = "' ' || chr(9) || chr(10) || chr(13)"


@query("select column_name, lower(v) as value, count(distinct v) as variants from (" + " union all ".join(f"select '{c}' as column_name, nullif(trim({c}, {_EDGES}), '') as v from customers_north" for c in _TYPED_TEXTS) + ") where v is not null group by column_name, lower(v) having count(distinct v) > 1")
def profile_case_variants(spark: SparkSession, folder: str) -> DataFrame:
    return profiling.case_variants(table(spark, folder, "customers_north"), _TYPED_TEXTS)


@query("select n_nationkey as key, n_name as name, 'nation' as source from nation union all select r_regionkey, r_name, 'region' from region union all select s_suppkey, s_name, 'supplier' from supplier")
def union_sources(spark: SparkSession, folder: str) -> DataFrame:
    part = lambda t, p: table(spark, folder, t).select(F.col(f"{p}key").cast("bigint").alias("key"), F.col(f"{p[0]}_name").alias("name"), F.lit(t).alias("source"))
    return part("nation", "n_nation").unionByName(part("region", "r_region")).unionByName(part("supplier", "s_supp"))


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey)")
def anti_join(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "customer").join(table(spark, folder, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")
