"""Queries of the problems on texts and entities, and the SQL of those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.coerce import coerce
from quern.functions.text import clean, strip
from quern.llm import canonical, garbled, golden, mixing, names
from quern.llm.tokenize import decode_ids, encode_texts
from quern.operators.column_profile import EMAIL
from quern.plans.customer_tables import customers
from quern.session import cut_lineage
from quern.sources.tables import table

# ---- 2: best representative


def _claims(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id, field_name, rec_id, value, valid, trust_rank, updated_at, site_code: one row for each record and field."""
    sites = table(spark, folder, "sites").groupBy("site_code").agg(F.min("trust_rank").alias("trust_rank"))
    rows = customers(spark, folder, ["customer_id", "email", "lifetime_value"]).withColumn("customer_id", F.upper(strip(F.col("customer_id")))).where("customer_id <> ''")
    email, value = clean(F.col("email")), coerce(F.col("lifetime_value"), "float")
    fields = F.array(
        F.struct(F.lit("email").alias("field_name"), F.lower(email).alias("value"), F.coalesce(email.rlike(rf"(?Ud)\A(?:{EMAIL})\z"), F.lit(False)).alias("valid")),
        F.struct(F.lit("lifetime_value").alias("field_name"), value.cast("string").alias("value"), F.coalesce(value >= 0, F.lit(False)).alias("valid")),
    )
    return rows.join(sites, "site_code", "left").select("customer_id", "rec_id", "site_code", "trust_rank", "updated_at", F.explode(fields).alias("f")).select("*", "f.*").drop("f")


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id, field_name, rec_id: the record whose value survives, in the stated order of preference."""
    order = [-F.col("trust_rank"), F.col("updated_at"), -F.col("rec_id")]
    return golden.survivors(_claims(spark, folder), "customer_id", "field_name", order, "rec_id")


def _fused(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    # Blank codes go before the cut, so that more than 64 sites always reach the check of fuse_values.
    sites = [r.site_code for r in table(spark, folder, "sites").where("site_code <> ''").select("site_code").distinct().limit(65).collect()]
    return golden.fuse_values(_claims(spark, folder).where("valid"), ["customer_id", "field_name"], "value", "site_code", sites)


def p2_fused(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id, field_name, value, posterior, votes: the value of the largest posterior, copied votes discounted."""
    return golden.best_values(_fused(spark, folder)[0], ["customer_id", "field_name"], "value")


def p2_sources(spark: SparkSession, folder: str) -> DataFrame:
    """source, accuracy, most_copying: what the fusion has learnt of each site."""
    return _fused(spark, folder)[1]


# ---- 4: canonical values


def _mapped(spark: SparkSession, folder: str) -> DataFrame:
    entries = canonical.reference_entries(table(spark, folder, "canonical_fields"))
    return canonical.map_values(table(spark, folder, "source_headings"), "source_column", entries)


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    """heading_id, field_id of each non-blank heading; -1 where none is meant."""
    return _mapped(spark, folder).where("entry is not null").select("heading_id", F.col("entry").alias("field_id"))


def p4_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    """source_column, headings: the values that mean no entry, with how often each stands."""
    return _mapped(spark, folder).where("entry = -1").groupBy("source_column").agg(F.count(F.lit(1)).alias("headings"))


# ---- 6: names


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    """customer_id_a, customer_id_b: pairs of ids of one district that mean the same party."""
    return names.party_pairs(names.party_members(customers(spark, folder, ["customer_id", "full_name"]), "customer_id", "full_name", "district"))


def p6_parties(spark: SparkSession, folder: str) -> DataFrame:
    """district, id, party: each linked id with the smallest id of its party."""
    return names.link_parties(customers(spark, folder, ["customer_id", "full_name"]), "customer_id", "full_name", "district")


# ---- 8: tokens


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and ids of each document by byte_bpe_50k."""
    return encode_texts(table(spark, folder, "documents"), "text", ["doc_id"])


def p8_decoded(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id and text of each document, encoded and decoded again; null texts come back empty."""
    return decode_ids(p8_ids(spark, folder), "ids", ["doc_id"])


# ---- 9: mixing


def _mix(spark: SparkSession, folder: str) -> tuple[DataFrame, list[mixing.Plan]]:
    sized = cut_lineage(encode_texts(table(spark, folder, "documents"), "text", ["doc_id", "source"], count_only=True))
    plans = mixing.plan_mix(mixing.source_totals(sized, "source", "n_tokens"), mixing.weights_of(table(spark, folder, "source_weights")))
    return cut_lineage(mixing.round_copies(sized, plans, "doc_id", "source", "n_tokens")), plans


def p9_mix(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id, source, n_tokens, copies: how often each document of a weighted source is taken."""
    return _mix(spark, folder)[0].select(F.col("key").cast("bigint").alias("doc_id"), "source", "n_tokens", "copies")


def p9_shares(spark: SparkSession, folder: str) -> DataFrame:
    """Shares wanted and reached by source."""
    return mixing.shares_reached(*_mix(spark, folder))


# ---- 10: garbled text


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    """doc_id of each document that holds garbled text."""
    return garbled.restore_texts(table(spark, folder, "documents"), "text", ["doc_id"]).where("spans + relettered + lost > 0").select("doc_id")


def p10_restored(spark: SparkSession, folder: str) -> DataFrame:
    """Every document with its text restored as far as it can be."""
    return garbled.restore_texts(table(spark, folder, "documents"), "text", ["doc_id"])


QUERIES = {
    f.__name__: f
    for f in (p2_found, p2_fused, p2_sources, p4_found, p4_unmatched, p6_found, p6_parties, p8_ids, p8_decoded, p9_mix, p9_shares, p10_found, p10_restored)
}

_TRIM = "nullif(trim({c}, ' ' || chr(9) || chr(10) || chr(13)), '')"
_RECORDS = " union all ".join(
    f"select rec_id, upper({_TRIM.format(c=i)}) as id, {_TRIM.format(c=e)} as email, {_TRIM.format(c=v)} as v, site_code, updated_at from {t}"
    for t, i, e, v in (("customers_north", "customer_id", "email", "lifetime_value"), ("clients_south", "client_id", "e_mail", "total_spend"), ("customers_east", "cust_id", "e_mail", "ltv"))
)
SQL: dict[str, str] = {
    "p2_found": f"""
with r as ({_RECORDS}), n as (select id from r where id is not null group by id having count(*) >= 2),
f as (select id, 'email' as field_name, rec_id, site_code, updated_at from r where regexp_full_match(email, '[^@\\s]+@[^@\\s]+\\.[^@\\s]+')
  union all select id, 'lifetime_value', rec_id, site_code, updated_at from (select *, case when regexp_full_match(v, '[+-]?\\d{{1,3}}(,\\d{{3}})+(\\.\\d+)?') then try_cast(replace(v, ',', '') as double)
    when regexp_full_match(v, '[+-]?(\\d+\\.?\\d*|\\.\\d+)([eE][+-]?\\d+)?') then try_cast(v as double) end as x from r) where x >= 0),
o as (select f.*, row_number() over (partition by f.id, field_name order by trust_rank nulls last, updated_at desc nulls last, rec_id) as k from f join n using (id) left join sites using (site_code))
select id as customer_id, field_name, rec_id from o where k = 1""",
    "p8_decoded": "select doc_id, coalesce(text, '') as text from documents",
}
