from datetime import date

import pytest
from pyspark.sql import functions as F

from quern.config import Config, ConfigError, config_from
from quern.operators import metrics, profiling, remediate, rules
from quern.operators.mapping import map_columns, ratio
from quern.operators.reconcile import in_order, reconcile


def config(fields, **more) -> Config:
    return config_from({"fields": fields, **more})


# ---- rules


def test_rules(spark):
    c = config(
        [
            {"name": "id", "type": "string", "required": True, "rules": [{"rule": "regex", "pattern": "A\\d+"}]},
            {"name": "n", "type": "float", "rules": [{"rule": "range", "min": 0, "max": 10, "severity": "warning"}]},
            {"name": "d", "type": "date", "rules": [{"rule": "range", "min": "2024-01-01"}]},
            {"name": "e", "type": "date"},
            {"name": "k", "type": "integer", "rules": [{"rule": "allowed_values", "values": [1, 2]}]},
        ],
        validation={"cross_field": [{"field": "d", "operator": "<=", "other": "e", "severity": "warning"}]},
    )
    df = spark.createDataFrame([("f", 2, "A1", 0.0, date(2024, 1, 1), date(2024, 1, 1), 1), ("f", 3, None, None, None, None, None), ("f", 4, "A1\n", 10.5, date(2023, 1, 1), date(2022, 1, 1), 3)], "_source_file string, _row long, id string, n double, d date, e date, k long")
    checked = rules.validate(df, c)
    got = sorted((r.row, r["column"], r.value, r.kind, r.severity) for r in rules.records(checked).collect())
    assert got == [
        (3, "id", None, "rule_required", "error"),
        (4, "d", "2023-01-01", "rule_range", "error"),
        (4, "d", "d=2023-01-01, e=2022-01-01", "rule_cross_field", "warning"),
        (4, "id", "A1\n", "rule_regex", "error"),
        (4, "k", "3", "rule_allowed_values", "error"),
        (4, "n", "10.5", "rule_range", "warning"),
    ]
    assert [r._row for r in rules.clean_rows(checked).collect()] == [2]
    assert rules.drop_held(df, rules.records(checked)).count() == 1
    assert rules.records(rules.validate(df.limit(0), c)).count() == 0


@pytest.mark.parametrize(
    "fields,more",
    [
        ([{"name": "a", "type": "money"}], {}),
        ([{"name": "a", "type": "float", "rules": [{"rule": "regex", "pattern": "x"}]}], {}),
        ([{"name": "a", "type": "string", "rules": [{"rule": "range", "min": 1}]}], {}),
        ([{"name": "a", "type": "boolean", "rules": [{"rule": "allowed_values", "values": [True]}]}], {}),
        ([{"name": "a", "type": "date", "rules": [{"rule": "range", "min": "soon"}]}], {}),
        ([{"name": "_row", "type": "string"}], {}),
        ([{"name": "a", "type": "string"}, {"name": "a", "type": "string"}], {}),
        ([{"name": "a", "type": "string"}], {"validation": {"keys": ["b"]}}),
        ([{"name": "a", "type": "string"}], {"validations": {}}),
        ([{"name": "a", "type": "string"}], {"validation": {"survivorship": {"strategy": "priority_list"}}}),
        ([{"name": "a", "type": "string"}, {"name": "b", "type": "float"}], {"validation": {"cross_field": [{"field": "a", "operator": "<", "other": "b"}]}}),
    ],
)
def test_config_refused(fields, more):
    with pytest.raises(ConfigError):
        config(fields, **more)


# ---- mapping

FIELDS = config([{"name": "customer_id", "type": "string", "synonyms": ["client id"]}, {"name": "full_name", "type": "string", "synonyms": ["name"]}, {"name": "signup_date", "type": "date", "synonyms": ["数量"]}]).fields


def test_mapping():
    m = {x.source: x for x in map_columns(["customer_id", "Client-ID", "FullName", "signup dat", "Notes", "%"], FIELDS)}
    assert (m["customer_id"].method, m["FullName"].method, m["signup dat"].target) == ("exact", "fuzzy", "signup_date")
    assert "already mapped" in m["Client-ID"].reason
    assert m["Notes"].target is None and m["%"].target is None
    assert round(ratio("fullname", "full name"), 1) == 94.1
    assert map_columns(["Purchaser"], FIELDS, accepted={"purchaser": "full_name"})[0].method == "assist"
    tie = config([{"name": "abcd1", "type": "string"}, {"name": "abcd2", "type": "string"}]).fields
    assert "ambiguous" in map_columns(["abcd3"], tie, 70)[0].reason


# ---- reconciliation

ROWS = [
    ("a.csv", 2, "1", 5.0, None), ("b.csv", 2, "1", None, "x"),  # agree
    ("a.csv", 3, "2", 1.0, "p"), ("b.csv", 3, "2", 2.0, "p"),  # conflict
    ("a.csv", 4, "3", 1.0, "q"),  # alone
    ("a.csv", 5, None, 1.0, "q"),  # no key
    ("b.csv", 6, "4", 1.0, "r"), ("b.csv", 7, "4", 2.0, "r"),  # conflict within a file
]


def reconciled(spark, survivorship=None, mtimes=None, rows=ROWS):
    c = config([{"name": "id", "type": "string"}, {"name": "amount", "type": "float"}, {"name": "city", "type": "string"}], validation={"keys": ["id"]} | ({"survivorship": survivorship} if survivorship else {}))
    df = spark.createDataFrame([(f, r, i, a, s, k) for k, (f, r, i, a, s) in enumerate(rows)], "_source_file string, _row long, id string, amount double, city string, _ord long")
    return reconcile(df, c, mtimes)


def test_reconcile_holds(spark):
    r = reconciled(spark)
    got = [tuple(x) for x in in_order(r.frame).select("_source_file", "id", "amount", "city").collect()]
    assert got == [("a.csv", "3", 1.0, "q"), ("a.csv; b.csv", "1", 5.0, "x")]
    assert tuple(r.counters.first()) == (5, 1, 2)
    e = {(x.kind, x.value): x for x in r.exceptions.collect()}
    assert e["missing_key", None].row == 5
    assert e["duplicate_key", "1"].file == "a.csv, b.csv"
    assert e["conflict", "a.csv row 3: 1.0 | b.csv row 3: 2.0"].severity == "error"


def test_reconcile_survivors(spark):
    r = reconciled(spark, {"strategy": "newest_file"}, {"a.csv": 1.0, "b.csv": 2.0})
    assert {x.id: x.amount for x in r.frame.collect()} == {"1": 5.0, "2": 2.0, "3": 1.0}
    reasons = [x.reason for x in r.exceptions.where("kind = 'conflict'").collect()]
    assert any("resolved by newest_file: kept b.csv" in x for x in reasons) and any("come from one file" in x for x in reasons)
    same = reconciled(spark, {"strategy": "newest_file"}, {"a.csv": 1.0, "b.csv": 1.0})
    assert "share a modification time" in " ".join(x.reason for x in same.exceptions.collect())
    p = reconciled(spark, {"strategy": "priority_list", "priority": ["a.csv"]})
    assert {x.id: x.amount for x in p.frame.collect()}["2"] == 1.0
    assert "no conflicting source appears" in " ".join(x.reason for x in p.exceptions.collect())
    assert reconciled(spark, {"strategy": "manual"}).counters.first().conflicts_held == 2


def test_reconcile_edges(spark):
    assert reconciled(spark, rows=[]).frame.count() == 0
    assert tuple(reconciled(spark, rows=[]).counters.first()) == (0, 0, 0)
    twice = [("a.csv", 2, "1", None, None), ("a.csv", 2, "1", None, None)]
    assert reconciled(spark, rows=twice).counters.first().rows_superseded == 1
    hot = [("a.csv", i, "k", 1.0, "x") for i in range(5000)] + [("b.csv", 1, "other", 1.0, "x")]
    assert reconciled(spark, rows=hot).counters.first().rows_superseded == 4999


# ---- remediation


def test_remediation(spark):
    c = config([{"name": "id", "type": "string", "required": True}, {"name": "spend", "type": "float", "rules": [{"rule": "range", "min": 0, "max": 100}]}, {"name": "visits", "type": "integer"}])
    raw = spark.createDataFrame([("f", 2, "a", "5", "1"), ("f", 3, "b", "n/a", "1"), ("f", 4, "c", "500", "1"), ("f", 5, "d", "x", "y"), ("f", 6, "e", "q", "2")], "_source_file string, _row long, id string, spend string, visits string")
    columns, bad = rules.coerced(c, {n: n for n in ("id", "spend", "visits")})
    checked = rules.validate(raw.select("_source_file", "_row", *columns, bad.alias("_v")), c)
    records = rules.records(checked).persist()
    ids = {(r.row, r["column"]): r.id for r in records.select("*", remediate.fingerprint().alias("id")).collect()}
    fixes = spark.createDataFrame([(ids[3, "spend"], {"spend": "7.5"}), (ids[4, "spend"], {"spend": "900"}), (ids[5, "spend"], {"spend": "1"}), (ids[6, "spend"], {"spend": "", "nope": "1"})], "id string, values map<string,string>")
    frame, after = remediate.apply_corrections(checked.drop("_v"), records, c, fixes)
    assert [(r.id, r.spend) for r in frame.collect()] == [("b", 7.5)]
    got = {(r.row, r.kind): r for r in after.collect()}
    assert (3, "coercion") not in got and got[3, "remediated"].severity == "warning"
    assert "still fail(s) validation" in got[4, "remediation_failed"].reason
    assert "cover only some" in got[5, "remediation_failed"].reason
    assert "unknown field 'nope'" in got[6, "remediation_failed"].reason
    assert remediate.check_correction(spark, c, {"spend": "7"}) == []
    assert remediate.check_correction(spark, c, {"spend": "700"})[0].startswith("out of range")
    assert remediate.check_correction(spark, c, {"spend": "x"})[0].startswith("'x' cannot be coerced")
    assert remediate.check_correction(spark, c, {}) and remediate.check_correction(spark, c, {"zz": "1"}) == ["unknown field 'zz'"]
    records.unpersist()


def test_fingerprint_is_sha256(spark):
    import hashlib

    df = spark.createDataFrame([("f", 1, None, "v", "k", "error", "r|s")], rules.RECORD)
    assert df.select(remediate.fingerprint()).first()[0] == hashlib.sha256(b"f|1||v|k|r|s").hexdigest()[:16]


# ---- metrics and profiles


def test_metrics(spark):
    e = spark.createDataFrame([("f", 2, "a", None, "coercion", "error", ""), ("f", 2, "b", None, "rule_range", "error", ""), ("f", 3, "a", None, "rule_range", "warning", ""), ("g", None, None, None, "file_unreadable", "error", "")], rules.RECORD)
    rows = spark.createDataFrame([("f", 10), ("g", 5), ("h", 0)], "file string, rows long")
    assert {r.file: r.score for r in metrics.source_scores(rows, e).collect()} == {"f": 88, "g": 0, "h": 100}
    assert tuple(metrics.severity_counts(e.limit(0)).first()) == (0, 0)


def test_profile(spark):
    df = spark.createDataFrame([(2, "1", "2024-01-02", "Yes"), (3, "1,200", "05/01/2024", "yes"), (4, None, " ", "no")], "_row long, n string, d string, b string")
    p = {x["name"]: x for x in profiling.profile_table(df, ["n", "d", "b"])}
    assert (p["n"]["inferred_type"], p["d"]["inferred_type"], p["b"]["inferred_type"]) == ("float", "date", "boolean")
    assert p["n"]["issues"] == ["thousands separators in 1 value(s)"] and "mixed date formats" in p["d"]["issues"][0] and "Yes / yes" in p["b"]["issues"][0]
    assert profiling.profile_table(df.limit(0), ["n"])[0]["issues"] == ["no values"]
    assert profiling.class_counts(df, ["n"]).agg(F.sum("n")).first()[0] == 2
