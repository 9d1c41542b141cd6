"""The best representative of each group of duplicate records, field by field.

Two ways to choose a field's value. fuse_values is Bayesian fusion with copy detection: it estimates how accurate each source is and which
sources copy, from false values that they share, discounts copied votes and takes the value of the largest posterior. survivors takes the
record that a stated order of preference puts first.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.session import cut_lineage

#: Rounds of estimating accuracies and posteriors in turn.
ROUNDS = 3
#: Accuracy that a source is given before anything is known of it, and the bounds that estimates keep within.
FIRST_ACCURACY, LEAST_ACCURACY, MOST_ACCURACY = 0.8, 0.05, 0.99
#: False values that an item may take, of equal chance.
FALSE_VALUES = 50
#: Chance, before looking, that one of two sources copies the other; share of its values that a copier copies.
COPYING, COPY_RATE = 0.1, 0.8


def survivors(claims: DataFrame, entity: str, field: str, order: list[Column], record: str, least_records: int = 2) -> DataFrame:
    """entity, field, record: for each entity of ``least_records`` records or more and each field the record that comes first.

    ``claims``: entity, field, record, valid (Boolean), one row for each record and field. Only valid claims count; a field without any
    has no row. ``order``: columns of which the preferred record has the largest, the first counting most; a null is below everything. Records
    that are equal in all of them are decided by the larger ``record``, so let the order end in what tells records apart. It is one
    aggregation that combines before the shuffle, so an entity with a third of all rows is a row of a few bytes for each task.
    """
    key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(order)], F.col(record).alias("_record"))
    best = claims.groupBy(entity, field).agg(F.max(F.when(F.col("valid"), key)).alias("_best"), F.count(F.lit(1)).alias("_n"))
    return best.where((F.col("_n") >= least_records) & F.col("_best").isNotNull()).select(entity, field, F.col("_best._record").alias(record))


def fuse_values(claims: DataFrame, item: list[str], value: str, source: str, sources: list[str], rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """(posteriors, accuracies): for each item and value its votes, score and posterior; for each source its accuracy.

    ``claims``: item columns, value, source; null values, items and sources count for nothing. ``sources``: all sources, a list of bounded
    length (at most 64), as pairs of them are compared. Claims are first reduced to one row for each item and value, holding the set of its
    sources, so no list of records is ever gathered and repeated rows add nothing.

    Round by round: the independence of a source's vote is the chance that it doesn't copy any other source that claims the same value,
    by the posterior of copying given how many true, false and different values the two have in common; a value's score is the sum over
    its sources of independence times log(FALSE_VALUES * a / (1 - a)); its posterior is the score's share among the item's values and
    FALSE_VALUES unseen ones; a source's accuracy is the mean posterior of its values.
    """
    if len(sources) > 64:
        raise ValueError("more than 64 sources: group them first")
    names = sorted(sources)
    votes = cut_lineage(claims.where(F.col(value).isNotNull() & F.col(source).isin(names)).groupBy(*item, value).agg(F.array_sort(F.collect_set(source)).alias("sources")))  # read in every round
    spark = claims.sparkSession
    accuracy = dict.fromkeys(names, FIRST_ACCURACY)
    copied: dict[tuple[str, str], float] = {}

    def lookup(values: dict[str, float]) -> Column:
        return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])

    def scored() -> DataFrame:
        weight = {s: float(_log_odds(accuracy[s])) for s in names}
        pairs = {f"{a}\x1f{b}": copied.get((min(a, b), max(a, b)), 0.0) for a in names for b in names if copied.get((min(a, b), max(a, b)), 0.0) > 0}
        w = lookup(weight)
        # Votes are taken from the most accurate source on; each is discounted by those before it.
        order = F.array_sort(F.transform("sources", lambda s: F.struct((-w[s]).alias("w"), s.alias("s"))))
        if pairs:
            p = lookup(pairs)
            score = F.aggregate(
                order,
                F.struct(F.lit(0.0).alias("sum"), F.array().cast("array<string>").alias("before")),
                lambda acc, x: F.struct(
                    (acc["sum"] - x["w"] * F.aggregate(acc["before"], F.lit(1.0), lambda i, b: i * (1.0 - COPY_RATE * F.coalesce(F.try_element_at(p, F.concat_ws("\x1f", x["s"], b)), F.lit(0.0))))).alias("sum"),
                    F.concat(acc["before"], F.array(x["s"])).alias("before"),
                ),
                lambda acc: acc["sum"],
            )
        else:
            score = F.aggregate(order, F.lit(0.0), lambda acc, x: acc - x["w"])
        s = votes.withColumn("score", score)
        # Scores are small numbers (at most 64 sources of at most log(50 * 99)), so exponentials need no shift beyond a constant.
        total = s.groupBy(*item).agg(F.sum(F.exp(F.col("score"))).alias("_sum"), F.count(F.lit(1)).alias("_values"), F.max("score").alias("_top"))
        total = total.withColumnsRenamed({k: f"_k{i}" for i, k in enumerate(item)})
        same = None
        for i, k in enumerate(item):
            same = F.col(k) == F.col(f"_k{i}") if same is None else same & (F.col(k) == F.col(f"_k{i}"))
        unseen = F.greatest(F.lit(0), FALSE_VALUES + 1 - F.col("_values"))
        return s.join(total, same).withColumn("posterior", F.exp("score") / (F.col("_sum") + unseen)).withColumn("best", F.col("score") == F.col("_top")).drop("_sum", "_values", "_top", *[f"_k{i}" for i in range(len(item))])

    # In how many items two sources both claim something; a set of at most 64 sources for each item.
    met = votes.select(*item, F.explode("sources").alias("s")).groupBy(*item).agg(F.array_sort(F.collect_set("s")).alias("all"))
    together = {(r.a, r.b): r.n for r in met.select(F.explode(_pairs_of(F.col("all"))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()}
    # Before anything is known of truth, sources that agree far more often than their accuracy explains are taken to copy; else a source
    # and its copies would outvote the others in the first round and be believed ever after.
    agreed = {(r.a, r.b): r.n for r in votes.select(F.explode(_pairs_of(F.col("sources"))).alias("p")).groupBy("p.a", "p.b").agg(F.count(F.lit(1)).alias("n")).collect()} if rounds else {}
    copied = {k: _copying(n, 0, max(0, together.get(k, 0) - n), FIRST_ACCURACY, FIRST_ACCURACY) for k, n in agreed.items()}
    for _ in range(rounds):
        post = scored()
        by_source = post.select(F.explode("sources").alias("s"), "posterior").groupBy("s").agg(F.avg("posterior").alias("a")).collect()  # at most 64 rows
        if len(names) > 1:
            # Pairs of sources of one value (at most 64 * 63 / 2), counted before the shuffle: never pairs of records.
            both = post.select("best", F.explode(_pairs_of(F.col("sources"))).alias("p")).groupBy("p.a", "p.b").agg(F.count_if("best").alias("true"), F.count_if(~F.col("best")).alias("false")).collect()
            copied = {(r.a, r.b): _copying(r.true, r.false, max(0, together.get((r.a, r.b), 0) - r.true - r.false), accuracy[r.a], accuracy[r.b]) for r in both}
        accuracy |= {r.s: min(MOST_ACCURACY, max(LEAST_ACCURACY, r.a)) for r in by_source}
    final = scored()
    known = spark.createDataFrame([(s, float(a), float(max([copied.get((min(s, o), max(s, o)), 0.0) for o in names if o != s], default=0.0))) for s, a in sorted(accuracy.items())], "source string, accuracy double, most_copying double")
    return final.withColumn("votes", F.size("sources")).drop("sources", "best"), known


def _log_odds(a: float) -> float:
    return math.log(FALSE_VALUES * a / (1 - a))


def _pairs_of(sources: Column) -> Column:
    """Each pair of different members of a sorted array, the smaller first."""
    return F.flatten(F.transform(sources, lambda a: F.transform(F.filter(sources, lambda b: b > a), lambda b: F.struct(a.alias("a"), b.alias("b")))))


def _copying(true: int, false: int, different: int, a: float, b: float) -> float:
    """Posterior that one of two sources copies, from the true, false and different values of the items that both claim.

    Independent sources agree on a true value with chance a * b and on a false one with (1 - a)(1 - b) / FALSE_VALUES; a copier says what
    the other says at COPY_RATE. So a shared false value speaks for copying far more than a shared true one, and a different one against.
    """
    both_true, both_false = a * b, (1 - a) * (1 - b) / FALSE_VALUES
    apart, mean = 1 - both_true - both_false, (a + b) / 2
    log = (
        true * math.log((COPY_RATE * mean + (1 - COPY_RATE) * both_true) / both_true)
        + false * math.log((COPY_RATE * (1 - mean) + (1 - COPY_RATE) * both_false) / both_false)
        + different * math.log(1 - COPY_RATE) * (apart > 0)
    )
    odds = COPYING / (1 - COPYING) * math.exp(max(-700.0, min(700.0, log)))
    return odds / (1 + odds)


def best_values(posteriors: DataFrame, item: list[str], value: str) -> DataFrame:
    """item, value, posterior, votes: the value of the largest posterior; of equal ones the most votes, then the smallest value."""
    best = posteriors.groupBy(*item).agg(F.min(F.struct((-F.col("posterior")).alias("p"), (-F.col("votes")).alias("v"), F.col(value).alias("x"))).alias("_b"))
    return best.select(*item, F.col("_b.x").alias(value), (-F.col("_b.p")).alias("posterior"), (-F.col("_b.v")).alias("votes"))
