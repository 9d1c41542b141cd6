from datetime import date, datetime

import pytest
from pyspark.sql import functions as F

from quern.functions.coerce import cell_class, coerce, failed
from quern.functions.pytext import py_text

CASES = {
    "integer": [("1,234", 1234), ("56", 56), ("-7", -7), ("+5", 5), ("not a number", None), ("12.7", None), ("1e3", None), ("1_000", None), ("99999999999999999999", None), ("", None), (None, None)],
    "float": [("1,204.50", 1204.5), ("88.00", 88.0), ("n/a", None), (".5", 0.5), ("5.", 5.0), ("1e3", 1000.0), ("1d", None), ("0x1p3", None), ("nan", None), ("1,20.5", None), (" 7 ", 7.0)],
    "boolean": [("true", True), ("No", False), ("Y", True), ("0", False), ("T", True), ("maybe", None), ("2", None)],
    "date": [("2024-01-02", date(2024, 1, 2)), ("14/02/2023", date(2023, 2, 14)), ("05 Mar 2024", date(2024, 3, 5)), ("05/03/2024", date(2024, 3, 5)), ("03/25/2024", date(2024, 3, 25)), ("5 march 2024", date(2024, 3, 5)), ("2024/1/2", date(2024, 1, 2)), ("03/04/05", None), ("30/02/2024", None), ("12 Sept 2024", None), ("2024-01-02T03:04:05", date(2024, 1, 2)), ("14-02-2023", date(2023, 2, 14))],
    "datetime": [("2024-01-02T03:04:05", datetime(2024, 1, 2, 3, 4, 5)), ("14/02/2023", datetime(2023, 2, 14)), ("12 June 2023", datetime(2023, 6, 12)), ("2024-03-10 02:30:00", datetime(2024, 3, 10, 2, 30)), ("2024-01-02 03:04:05.25", datetime(2024, 1, 2, 3, 4, 5, 250000)), ("14/02/2023 09:05", datetime(2023, 2, 14, 9, 5)), ("2024", None), ("2024-01-02T03:04:05+05:00", None), ("nope", None)],
    "string": [(" a ", "a"), ("", None), (" \t\xa0 ", None), (None, None), (" x", "x")],
}


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
@pytest.mark.parametrize("kind", list(CASES))
def test_coerce(spark, kind, zone):
    before = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        df = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(CASES[kind])], "i int, t string")
        got = [r for r in df.select("i", coerce(F.col("t"), kind).alias("v"), failed(F.col("t"), kind).alias("f")).orderBy("i").collect()]
    finally:
        spark.conf.set("spark.sql.session.timeZone", before)
    for (text, want), r in zip(CASES[kind], got, strict=True):
        assert r.v == want, (text, r.v)
        blank = text is None or not text.strip()
        assert r.f == (want is None and not blank), text


def test_long_text(spark):
    df = spark.createDataFrame([("x" * 2_000_000,), ("1" * 100_000,)], "t string")
    assert [r[0] for r in df.select(coerce(F.col("t"), "float")).collect()] == [None, float("inf")]
    assert df.where(failed(F.col("t"), "date")).count() == 2


def test_classes(spark):
    texts = ["12", "-3", "1.5", "1,234", "yes", "1", "2024-01-02", "25/12/2024", "12/25/2024", "5 May 2024", "5 June 2024", "2024-01-02T03:04:05", "2024-01-02 03:04:05.5", "x", " ", None]
    want = ["integer", "integer", "float", "thousands", "boolean", "integer", "date:%Y-%m-%d", "date:%d/%m/%Y", "date:%m/%d/%Y", "date:%d %b %Y", "date:%d %B %Y", "date:%Y-%m-%dT%H:%M:%S", "date:%Y-%m-%d %H:%M:%S.%f", "text", None, None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    assert [r[0] for r in df.orderBy("i").select(cell_class(F.col("t"))).collect()] == want


def test_python_text(spark):
    values = [0.0, -0.0, 1.0, 0.1, 1e7, 12345678.9, 1e15, 1e16, 1.5e16, 1e-3, 1e-4, 1.25e-4, 1e-5, 123456789012345.6, 2.5e-7, 1e100, -1e-10, float("inf"), float("nan"), 1.7976931348623157e308]
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v double")
    assert [r[0] for r in df.orderBy("i").select(py_text(F.col("v"), "float")).collect()] == [str(v) for v in values]
    row = spark.range(1).select(py_text(F.lit(True), "boolean"), py_text(F.lit("2024-01-02 03:04:05.5").cast("timestamp_ntz"), "datetime"), py_text(F.lit("2024-01-02").cast("date"), "date")).first()
    assert list(row) == ["True", "2024-01-02 03:04:05.500000", "2024-01-02"]
