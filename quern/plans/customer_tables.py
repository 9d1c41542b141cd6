"""The three customer tables: what each of their columns is, and what they have in common."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators.column_profile import EMAIL, ColumnSpec
from quern.operators.feeds import Aliases, alias_table
from quern.sources.tables import table

#: Typed columns by table, in order of id, name, e-mail, date, value, active, then notes.
COLUMNS = {
    "customers_north": ["customer_id", "full_name", "email", "signup_date", "lifetime_value", "active"],
    "clients_south": ["client_id", "customer_name", "e_mail", "date_joined", "total_spend", "is_active", "notes"],
    "customers_east": ["cust_id", "name", "e_mail", "date_joined", "ltv", "is_active"],
}
FIELDS = ["customer_id", "full_name", "email", "signup_date", "lifetime_value", "active", "notes"]


#: What is measured of each field.
FIELD_SPECS = [
    ColumnSpec("customer_id"),
    ColumnSpec("full_name"),
    ColumnSpec("email", pattern=EMAIL, checked=True),
    ColumnSpec("signup_date", "date"),
    ColumnSpec("lifetime_value", "float", checked=True),
    ColumnSpec("active", "boolean", checked=True),
    ColumnSpec("notes"),
]


#: What the feeds call the fields besides the names in canonical_fields.
FEED_HEADINGS = {
    "customer_id": ["cust id", "customer no"],
    "full_name": ["name", "client"],
    "email": ["mail"],
    "signup_date": ["joined"],
    "lifetime_value": ["spend to date"],
    "active": ["currently active"],
}
#: What the cells of a field must be.
FEED_KINDS = {"lifetime_value": "number", "row": "digits", "signup_date": "date", "active": "boolean"}


def feed_aliases(spark: SparkSession, folder: str) -> Aliases:
    """The alias table of the customer feeds: canonical_fields' names and synonyms of their fields, and FEED_HEADINGS."""
    return alias_table(table(spark, folder, "canonical_fields").where(F.col("field_name").isin(list(FEED_HEADINGS))), "field_name", "synonyms", FEED_HEADINGS)


def customers(spark: SparkSession, folder: str, fields: list[str]) -> DataFrame:
    """Rows of all three tables with ``fields`` (of FIELDS, as typed), rec_id, load_id, site_code, district and updated_at."""

    def one(name: str) -> DataFrame:
        own = dict(zip(FIELDS, COLUMNS[name], strict=False))
        return table(spark, folder, name).select("rec_id", "load_id", "site_code", "district", "updated_at", *[F.col(own[f]).alias(f) if f in own else F.lit(None).cast("string").alias(f) for f in fields])

    return reduce(DataFrame.unionByName, map(one, COLUMNS))
