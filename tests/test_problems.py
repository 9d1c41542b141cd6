"""The general training-data operators: brute force, and nulls, empty and long texts, ties, repeated rows, empty tables, odd columns."""

import csv
import io
import random
import statistics
from collections import Counter, defaultdict
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from quern.operators import column_profile as cp
from quern.operators import feeds
from quern.operators.instants import normalise_instants
from quern.operators.quantile import exact_median
from quern.plans.customer_tables import FEED_KINDS
from quern.sources.records import parse_files, parse_records, split_record

csv.field_size_limit(1 << 30)

#: An alias table as feeds.alias_table gives it.
ALIASES = {
    "customer_id": ["customer_id", "cust id", " client id", "Account Code"], "full_name": ["full_name", "name", "customer name"], "email": ["email", "E-Mail Address", "mail"],
    "signup_date": ["signup_date", "date joined", "joined"], "lifetime_value": ["lifetime_value", "ltv", "total spend"], "active": ["active", "is active"],
}

# ---- medians


def test_median_is_exact(spark):
    rng = random.Random(1)
    rows = [(k, rng.choice([None, 0.0, -1.5, 7.25, float("nan"), rng.uniform(-1e6, 1e6), rng.uniform(0, 1), 1e308, -1e308])) for k in "aabbbcdef" * 97 + "gg"]
    rows += [("hot", rng.randint(0, 3) / 4) for _ in range(5000)] + [("null", None), (None, 3.0), (None, 5.0)]
    want = defaultdict(list)
    for k, x in rows:
        if x is not None and x == x:
            want[k].append(x)
    got = {r.k: r.median for r in exact_median(spark.createDataFrame(rows, "k string, x double"), ["k"], "x").collect()}
    assert set(got) == set(want)
    for k, xs in want.items():
        xs = sorted(xs)
        assert got[k] == (xs[(len(xs) - 1) // 2] + xs[len(xs) // 2]) / 2, k
    assert exact_median(spark.createDataFrame([], "k string, x double"), ["k"], "x").count() == 0


# ---- 1: profiles

SPECS = [cp.ColumnSpec("mail", pattern=cp.EMAIL, checked=True), cp.ColumnSpec("v", "float", checked=True), cp.ColumnSpec("b", "boolean", checked=True)]


def test_profile(spark):
    rows = [("L1", "a@b.c", "1.5", "yes"), ("L1", " a@b.c ", "x", "no"), ("L1", "", "-2", None), ("L1", "a@b", " ", "maybe"), ("L2", None, None, None), (None, "q@r.s", "1,000.25", "t"), (None, "q@r.s", "1,000.25", "t")]
    df = spark.createDataFrame(rows, "load string, mail string, v string, b string").withColumn("rows", F.lit("clash"))
    p = {(r.load, r.column_name): r for r in cp.profile_columns(df, "load", SPECS).collect()}
    m = p["L1", "mail"]
    assert (m.rows, m.non_empty, m.valid, m.distinct_values, m.completeness_pct) == (4, 3, 2, 2, 75.0)
    v = p["L1", "v"]
    assert (v.non_empty, v.valid, v.min_number, v.max_number, v.numbers, v.s1, v.s2) == (3, 2, -2.0, 1.5, 2, -50, 62500)
    assert p["L1", "b"].trues == 1 and p["L1", "b"].valid == 2
    e = p["L2", "mail"]
    assert (e.rows, e.non_empty, e.validity_pct, e.distinct_values) == (1, 0, None, None)
    assert p[None, "v"].inferred_type == "float" and p[None, "v"].s1 == 200050
    assert cp.profile_columns(df.limit(0), "load", SPECS).count() == 0
    assert {(r.load, r.column_name): r.median for r in cp.number_medians(df, "load", ["v"]).collect()} == {("L1", "v"): -0.25, (None, "v"): 1000.25}


def test_power_sums_merge(spark):
    """Sums of parts add up to the sums of the whole, exactly, in any order; a sum beyond 38 digits is null."""
    rng = random.Random(2)
    xs = [round(rng.uniform(-1e4, 1e4), 2) for _ in range(2000)]
    df = spark.createDataFrame([(str(i % 7), str(x)) for i, x in enumerate(xs)], "load string, v string")
    one = [cp.ColumnSpec("v", "float", checked=True)]
    parts = cp.profile_columns(df, "load", one).agg(F.sum("s1"), F.sum("s2"), F.sum("s3")).first()
    cents = [round(x * 100) for x in xs]
    assert [int(x) for x in parts] == [sum(c**p for c in cents) for p in (1, 2, 3)]
    huge = spark.createDataFrame([("a", "1e16")], "load string, v string")
    r = cp.profile_columns(huge, "load", one).first()
    assert r.s1 == 10**18 and r.s2 == 10**36 and r.s3 is None


def test_shifts(spark):
    rng = random.Random(3)
    loads = {k: [round(rng.gauss(m, s), 2) for _ in range(200)] for k, m, s in (("a", 10, 2), ("b", 10, 2), ("c", 30, 4))}
    df = spark.createDataFrame([(k, str(x)) for k, xs in loads.items() for x in xs], "load string, v string")
    got = {r.load: r for r in cp.standardised_shifts(cp.profile_columns(df, "load", [cp.ColumnSpec("v", "float")]), "load").collect()}
    for k, xs in loads.items():
        rest = [x for j, ys in loads.items() if j != k for x in ys]
        pooled = ((statistics.pvariance(xs) + statistics.pvariance(rest)) / 2) ** 0.5
        assert got[k].shift == pytest.approx((statistics.fmean(xs) - statistics.fmean(rest)) / pooled, rel=1e-6)
    assert got["c"].shift > 3


def test_no_decimal_is_rounded_away(spark):
    """Numbers with more decimals than the sums hold make them null; mean and shift then come from the moments."""
    loads = {"a": [0.001, 0.002], "b": [1.25, 1.5, 1.0], "c": [1e30, 5.0], "d": [1.0, 2.0, 1e11]}
    df = spark.createDataFrame([(k, repr(x)) for k, xs in loads.items() for x in xs], "load string, v string")
    p = cp.profile_columns(df, "load", [cp.ColumnSpec("v", "float")], moments=True)
    got = {r.load: r for r in p.collect()}
    assert (got["a"].s1, got["a"].numbers, got["b"].s1, got["c"].s1) == (None, 2, 375, None)
    assert got["d"].s1 == 10**13 + 300 and got["d"].s3 is None and got["d"].s4 is None
    shifts = {r.load: r for r in cp.standardised_shifts(p, "load").collect()}
    for k, xs in loads.items():
        rest = [x for j, ys in loads.items() if j != k for x in ys]
        assert shifts[k].mean == pytest.approx(statistics.fmean(xs), rel=1e-9) and shifts[k].mean_of_others == pytest.approx(statistics.fmean(rest), rel=1e-9)


def test_huge_values_are_not_left_out(spark):
    """A sum that can't hold one of its numbers is null, and shifts count the number all the same."""
    loads = {"a": [1.0, 2.0, 1e8, 1e18], "b": [1.0, 2.0, 3.0], "c": [2.0, 3.0, 7.0], "d": [1e18, 2e18], "e": [1e12, 1.0, 2.0]}
    df = spark.createDataFrame([(k, str(x)) for k, xs in loads.items() for x in xs], "load string, v string")
    one = [cp.ColumnSpec("v", "float")]
    p = {r.load: r for r in cp.profile_columns(df, "load", one).collect()}
    assert (p["a"].numbers, p["a"].s1, p["a"].s2, p["a"].s3, p["a"].s4) == (4, None, None, None, None)
    assert (p["b"].s1, p["b"].s4) == (600, (1 + 16 + 81) * 10**8)
    assert p["e"].s2 == 10**28 + 5 * 10**4 and p["e"].s3 is None
    for held in (set("abcde"), set("abce"), set("bcd"), set("bc")):
        some = df.where(F.col("load").isin(sorted(held)))
        got = {r.load: r for r in cp.standardised_shifts(cp.profile_columns(some, "load", one, moments=True), "load").collect()}
        assert set(got) == held
        for k in held:
            xs, rest = loads[k], [x for j in held if j != k for x in loads[j]]
            v, w = statistics.pvariance(xs), statistics.pvariance(rest)
            assert got[k].mean == pytest.approx(statistics.fmean(xs), rel=1e-9)
            assert got[k].mean_of_others == pytest.approx(statistics.fmean(rest), rel=1e-9)
            assert got[k].shift == pytest.approx((statistics.fmean(xs) - statistics.fmean(rest)) / ((v + w) / 2) ** 0.5, rel=1e-6)
            assert got[k].spread == pytest.approx((v / w) ** 0.5, rel=1e-6)
            third = statistics.fmean([(x - statistics.fmean(xs)) ** 3 for x in xs])
            assert got[k].skew == pytest.approx(third / v**1.5, rel=1e-6, abs=1e-6)


# ---- 3: records


def test_records(spark):
    lines = {
        2: 'a,"b, c",d', 3: 'a,"say ""x""",d', 4: 'a,"two\nlines",d', 5: "a,b", 6: "a,b,c,d", 7: 'a,"b,c', 8: 'a,"b" x,c', 9: 'a,24" pipe,c', 10: ",,", 11: "  ", 12: None, 13: 'a,"",é ', 14: "x" * 300_000 + ",b,c", 15: '"' + "y,\n" * 50_000 + '",b,c', 16: "a,b\r,c", 17: '"a","b","c"', 18: '"a""',
    }
    df = spark.createDataFrame([("f", n, t) for n, t in lines.items()], "file_name string, line_no int, raw_line string")
    got = {r.line_no: r for r in parse_records(df, "raw_line", F.lit(3)).collect()}
    want = {5: "field_count", 6: "field_count", 7: "quoting", 8: "quoting", 9: "quoting", 11: "blank", 12: "blank", 18: "quoting"}
    assert {n: r.reason for n, r in got.items() if r.reason} == want
    for n, r in got.items():
        if n not in want:
            assert r.cells == next(csv.reader(io.StringIO(lines[n], newline=""))) if n != 16 else r.cells == ["a", "b\r", "c"]
    assert parse_records(df.limit(0), "raw_line", F.lit(3)).count() == 0
    assert split_record('a,"b""c",') == ["a", 'b"c', ""]


def table(spark, files):
    return spark.createDataFrame([(f, i + 1, t) for f, ts in files.items() for i, t in enumerate(ts)], "file_name string, line_no int, raw_line string")


def test_rejects_and_loads(spark):
    lines = table(spark, {
        "n.csv": ["customer_id,LTV,Date Joined,ACTIVE?,Extra", "1,5.5,2024-01-02,yes,z", "2,x,soon,maybe,z", "3, ,,,", "4,1,2024-01-02", "", "5,1,02/30/2024,1,q"],
        "e.csv": ["file,row,value,kind", "a,12,,k", "a,12a,v,k", "a,-3,v,k"],
        "none.csv": [],
    })
    extra = spark.createDataFrame([("lost.csv", 2, "a,b")], lines.schema)
    r = feeds.rejected_cells(parse_files(lines.unionByName(extra).unionByName(lines.where("line_no = 1"))), ALIASES, FEED_KINDS)
    got = {(x.file_name, x.line_no): x.reasons for x in r.collect()}
    assert got == {("n.csv", 2): [], ("n.csv", 3): ["number", "date", "boolean"], ("n.csv", 4): [], ("n.csv", 5): ["field_count"], ("n.csv", 7): ["date"], ("e.csv", 2): [], ("e.csv", 3): ["number"], ("e.csv", 4): ["number"], ("lost.csv", 2): []}
    rows = feeds.loaded_rows(r.where("file_name = 'n.csv'"), {"customer_id": "string", "lifetime_value": "float", "active": "boolean", "notes": "string"}, ALIASES).collect()
    assert sorted((x.customer_id, x.lifetime_value, x.active, x.notes) for x in rows) == [("1", 5.5, True, None), ("3", None, None, None)]


def test_no_cell_of_a_loaded_row_is_lost(spark):
    lines = table(spark, {"n.csv": ["customer_id,Depot,LTV,Phone Ext", "1,north,5.5, 12 ", "2,,x,3", "3,south,,"], "m.csv": ["customer_id", "4"]})
    rows = feeds.loaded_rows(feeds.rejected_cells(parse_files(lines), ALIASES, FEED_KINDS), {"customer_id": "string", "lifetime_value": "float"}, ALIASES).collect()
    assert {r.customer_id: r.others for r in rows} == {"1": {"depot": "north", "phoneext": " 12 "}, "3": {"depot": "south", "phoneext": ""}, "4": {}}


def test_files_without_headings_are_reported(spark):
    lines = table(spark, {"ok.csv": ["customer_id,LTV", "1,2", "1,x"], "blank.csv": [" ", "1,2", ""], "quote.csv": ['"id,LTV', "1,2", '"3'], "null.csv": [None, "1"]})
    lost = spark.createDataFrame([("lost.csv", 2, "a,b"), ("lost.csv", 3, "c")], lines.schema)
    got = sorted(tuple(r) for r in feeds.reported_lines(lines.unionByName(lost), ALIASES, FEED_KINDS).collect())
    assert got == [
        ("blank.csv", 1, "headings"), ("blank.csv", 2, "headings"), ("lost.csv", 2, "headings"), ("lost.csv", 3, "headings"), ("null.csv", 1, "headings"), ("null.csv", 2, "headings"),
        ("ok.csv", 3, "number"), ("quote.csv", 1, "headings"), ("quote.csv", 2, "headings"), ("quote.csv", 3, "headings"), ("quote.csv", 3, "quoting"),
    ]


# ---- 5: drift


def test_drift(spark):
    files = {
        "a1": ["Cust ID,Name,Joined,Depot", "1,Ann,2024-01-01,d", "2,Bob,2024-01-02 03:04:05,d", "3,Cy,2024-01-03,d"],
        "a2": ["Client ID,Name,Joined,Notes", "K1,Ann,2024-01-01 00:00:00,see", 'K2,Bob,"broken,n', "K3,Cy,2024-01-01 01:00:00,see"],
        "a3": ["Name,Client ID,Joined,Notes,Notes", "Ann,K1,,,"],
        "a4": ["Name,Client ID,Joined,Notes", ""],
        "b1": ["Name", "x"],
    }
    meta = spark.createDataFrame([("a1", "nth-1", "2024-01"), ("a2", "nth-1", "2024-02"), ("a3", "nth-1", "2024-05"), ("a4", "nth-1", "2024-06"), ("b1", "nth-2", None)], "file_name string, feed_code string, file_month string")
    c = feeds.column_catalogue(table(spark, files), meta, ALIASES)
    got = sorted((r.file_name, r.change, r.heading) for r in feeds.column_changes(c).collect())
    assert got == [
        ("a2", "added", "Notes"), ("a2", "removed", "Depot"), ("a2", "renamed", "Client ID"), ("a2", "type_changed", "Client ID"), ("a2", "type_changed", "Joined"),
        ("a3", "added", "Notes"), ("a4", "removed", "Notes"),
    ]
    assert feeds.column_changes(feeds.column_catalogue(table(spark, files).limit(0), meta, ALIASES)).count() == 0
    t = feeds.unified_table(table(spark, files), meta, {"customer_id": "string", "signup_date": "date"}, ALIASES).collect()
    assert len(t) == 7 and {r.others.get("depot") for r in t if r.file_name == "a1"} == {"d"}


def test_drift_types(spark):
    cells = ["1", "0", "1.5", "1,200.00", "yes", "2024-01-02", "5 May 2024", "2024-01-02 03:04:05", "02/01/2024 10:00", "x", " ", None]
    df = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string").orderBy("i")
    assert [r[0] for r in df.select(feeds.drift_type(F.col("c"))).collect()] == ["integer", "integer", "float", "float", "boolean", "date", "date", "datetime", "datetime", "string", None, None]


def test_second_column_of_a_meaning_is_kept(spark):
    lines = table(spark, {"a": ["Name,e-mail,Mail,Depot,Customer Name,Depot,depot", "Ann,a@b.c,d@e.f,1,Ann B,2,3"]})
    fields = {"full_name": "string", "email": "string"}
    want = {"email#2": "d@e.f", "depot": "1", "full_name#2": "Ann B", "depot#2": "2", "depot#3": "3"}
    for r in (feeds.unified_table(lines, lines, fields, ALIASES).first(), feeds.loaded_rows(feeds.rejected_cells(parse_files(lines), ALIASES, FEED_KINDS), fields, ALIASES).first()):
        assert (r.full_name, r.email, r.others) == ("Ann", "a@b.c", want)


# ---- 7: timestamps

CASES = [
    ("2024-03-05", "2024-03-05"), ("05/03/2024", "2024-03-05"), ("03/25/2024", "2024-03-25"), ("5.3.2024", "2024-03-05"), ("31/02/2024", None), ("2024-13-45", None), ("24-03-05", None),
    ("May 30, 2022", "2022-05-30"), ("01-MAY-2023", "2023-05-01"), ("1 September 2020", "2020-09-01"), ("20120618", "2012-06-18"), ("20121345", None), ("42994", "2017-09-16"), ("1417137890", "2014-11-28T01:24:50.000000Z"),
    ("1508288520923", "2017-10-18T01:02:00.923000Z"), ("2017-04-01T13:55:13Z", "2017-04-01T13:55:13.000000Z"), ("2013-03-22 02:51:22 +0530", "2013-03-21T21:21:22.000000Z"), ("2021-11-25T23:50:28+11", "2021-11-25T12:50:28.000000Z"),
    ("2024-01-01 10:00 +25:00", None), ("08/12/2019 15:22 NZDT", "2019-12-08T02:22:00.000000Z"), ("13/8/2023 12:05 AM", "2023-08-12T14:05:00.000000Z"), ("13/8/2023 13:05 AM", None), ("13/8/2023 25:05", None),
    ("Thu, 19 Sep 2013 22:19:40 GMT", "2013-09-19T22:19:40.000000Z"), ("2013-08-07 00:59:26 America/Denver", "2013-08-07T06:59:26.000000Z"), ("2013-08-07 00:59:26[Europe/Berlin]", "2013-08-06T22:59:26.000000Z"), ("2013-08-07 00:59:26 Mars/Base", None),
    ("2024-04-07 02:30:00", "2024-04-06T15:30:00.000000Z"),  # twice in Sydney: the earlier
    ("2024-10-06 02:30:00", "2024-10-05T16:30:00.000000Z"),  # skipped in Sydney: forward by the gap, to 03:30
    ("2019-11-21T19:11:32.615124", "2019-11-21T08:11:32.615124Z"), (" 05/03/2024 ", "2024-03-05"), ("n/a", None), ("", None), (None, None), ("last week", None), ("9" * 100_000, None), ("12345", "1933-10-18"), ("20240102T030405", "2024-01-01T16:04:05.000000Z"),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_instants(spark, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, t, "Australia/Sydney") for i, (t, _) in enumerate(CASES)], "i int, t string, z string").withColumn("norm", F.lit("kept"))
        got = {r.i: r for r in normalise_instants(df, "t", "z").collect()}
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for i, (text, want) in enumerate(CASES):
        assert got[i].instant.norm == want if got[i].instant else want is None, (text, got[i].instant)
        assert got[i].norm == "kept"
    assert normalise_instants(df.limit(0), "t", "z").count() == 0


def test_short_epochs(spark):
    cases = {
        "999999999": "2001-09-09T01:46:39.000000Z", "100000000": "1973-03-03T09:46:40.000000Z", "999999999999": "2001-09-09T01:46:39.999000Z", "915148800123": "1999-01-01T00:00:00.123000Z",
        "915148800123456": "1999-01-01T00:00:00.123456Z", "915148800123456789": "1999-01-01T00:00:00.123456Z", "1508288520923456999": "2017-10-18T01:02:00.923456Z",
        "202401020304": "2024-01-01T16:04:00.000000Z", "199912312359": "1999-12-31T12:59:00.000000Z", "202413020304": "1976-05-31T17:50:20.304000Z", "12345678901": None, "12345678": None,
    }
    df = spark.createDataFrame([(t, "Australia/Sydney") for t in cases], "t string, z string")
    assert {r.t: r.instant and r.instant.norm for r in normalise_instants(df, "t", "z").collect()} == cases


def test_instants_without_zone(spark):
    df = spark.createDataFrame([("2024-01-02 03:04:05", None), ("2024-01-02", None), ("2024-01-02 03:04:05", "No/Where"), ("2024-01-02 03:04:05Z", None)], "t string, z string")
    assert [r.instant.norm for r in normalise_instants(df, "t", "z").collect()] == [None, "2024-01-02", None, "2024-01-02T03:04:05.000000Z"]


def test_instants_round_trip(spark):
    """Random instants written in random offsets come back."""
    rng = random.Random(4)
    rows = []
    for _ in range(300):
        at = datetime(2000, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=rng.randrange(10**15))
        off = rng.randrange(-14 * 4, 14 * 4 + 1) * 15
        local = at + timedelta(minutes=off)
        sign = "-" if off < 0 else "+"
        text = local.strftime("%Y-%m-%dT%H:%M:%S.%f") + f"{sign}{abs(off) // 60:02d}:{abs(off) % 60:02d}"
        rows.append((text, at.strftime("%Y-%m-%dT%H:%M:%S.%fZ")))
    got = normalise_instants(spark.createDataFrame(rows, "t string, w string").withColumn("z", F.lit(None).cast("string")), "t", "z").collect()
    assert all(r.instant.norm == r.w for r in got)
    assert Counter(r.instant.form for r in got) == {"ymd": 300}


def test_alias_table(spark):
    df = spark.createDataFrame([("a", " X Y; z ;;"), ("b", None), (None, "q"), ("a", "w"), (" ", "u")], "field string, also string")
    got = feeds.alias_table(df, "field", "also", {"b": ["z"], "c": ["v"]})
    heads = spark.createDataFrame([(h,) for h in ("x-y", "Z", "B", "V", "q", "other one", "!", None)], "h string")
    assert [r[0] for r in heads.select(feeds.meaning(F.col("h"), got)).collect()] == ["a", "a", "b", "c", "q", "otherone", "!", None]
    assert [r[0] for r in heads.select(feeds.meaning(F.col("h"), {})).collect()][:3] == ["xy", "z", "b"]
    with pytest.raises(ValueError):
        feeds.alias_table(df, "field", "also", most_rows=2)
