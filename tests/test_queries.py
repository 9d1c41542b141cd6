"""Every query with SQL gives the same rows as its SQL; every other one runs."""

import numpy as np
import pandas as pd
import pytest

from quern.plans import problem_queries, reference_queries
from tests.conftest import DATA

QUERIES = {**reference_queries.QUERIES, **problem_queries.QUERIES}
SQL = {**reference_queries.SQL, **problem_queries.SQL}


def cell(v):
    if v is None or v is pd.NA or v is pd.NaT or (isinstance(v, float) and v != v):
        return "null"
    if isinstance(v, bool | np.bool_):
        return str(bool(v))
    try:
        return repr(round(float(v), 6)) if not isinstance(v, str) else v
    except (TypeError, ValueError):
        return str(v)


def rows(df):
    df = df[sorted(df.columns)]
    return sorted(tuple(map(cell, r)) for r in df.itertuples(index=False, name=None))


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    got = QUERIES[name](spark, DATA).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_partitions_dont_matter(spark):
    from quern.operators import rules
    from quern.plans.reference_queries import checked_orders

    one = checked_orders(spark, DATA).coalesce(1)
    assert sorted(map(str, rules.records(one).collect())) == sorted(map(str, rules.records(checked_orders(spark, DATA).repartition(8)).collect()))
