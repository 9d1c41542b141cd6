"""Mixing sources to target weights: how often each record is taken, so that sources reach their shares of the total size.

Each source's records share one fractional number of copies. Whole copies are certain; the fractions are rounded by the pivotal method:
two records meet, one of the two gives all it can to the other, by a draw that keeps each record's expectation, until one is whole. In
chunks of bounded size all but one record become whole; what is left of the chunks meets in a reduction tree. So a source's number of
copies comes out as wanted to within one record, and as records of like size meet, so does its size.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Records that one task rounds together, about.
CHUNK = 20_000
#: Residuals that meet at one node of the tree, about.
FAN_IN = 1_000
#: Records of a source that may change after rounding, to bring its size to what is wanted.
SETTLE = 5


@dataclass(frozen=True)
class Plan:
    """For a source: records, tokens, the target share, that among the sources that have tokens, copies of each record."""

    source: str
    records: int
    tokens: int
    target_share: float
    wanted_share: float
    copies: float


def plan_mix(totals: dict[str, tuple[int, int]], weights: dict[str, tuple[float, int]], total: int | None = None) -> list[Plan]:
    """Copies by source. ``totals``: records and tokens by source; ``weights``: target share and most repeats.

    A source without tokens can't have its share; the others take it in proportion. Without ``total`` the mix is as large as it can be
    with every share met and no source repeated beyond its cap. A ``total`` beyond that leaves the sources that have too little at their
    cap, and the others fill up in proportion as far as theirs allow.
    """
    have = {s: w for s, w in weights.items() if w[0] > 0 and totals.get(s, (0, 0))[1] > 0 and w[1] > 0}
    whole = sum(w[0] for w in have.values())
    share = {s: w[0] / whole for s, w in have.items()}
    room = {s: totals[s][1] * have[s][1] for s in have}
    most = min((room[s] / share[s] for s in have), default=0.0)
    aim = most if total is None else float(total)
    size: dict[str, float] = {}
    free, left = dict(share), aim
    while free:
        unit = left / sum(free.values())
        full = [s for s in free if free[s] * unit > room[s] * (1 + 1e-12)]
        if not full:
            size |= {s: x * unit for s, x in free.items()}
            break
        for s in full:
            size[s] = room[s]
            left -= room[s]
            del free[s]
    return [Plan(s, *totals.get(s, (0, 0)), w[0], share.get(s, 0.0), min(size.get(s, 0.0) / totals[s][1], float(w[1])) if s in have else 0.0) for s, w in sorted(weights.items())]


def _draw(*key: object) -> float:
    """A number in [0, 1) that depends on its key only, so that a task that runs again draws the same."""
    return int.from_bytes(hashlib.blake2b("\x1f".join(map(str, key)).encode(), digest_size=7).digest(), "big") / 2**56


def pivot(rows: list[tuple[str, float]], seed: int, whole: Callable[[str, int], None]) -> tuple[str, float] | None:
    """Rounds probabilities in order; calls ``whole`` with each key that becomes 0 or 1; the one that is left fractional, if any."""
    held: tuple[str, float] | None = None
    for key, p in rows:
        if p <= 1e-12 or p >= 1 - 1e-12:
            whole(key, round(p))
            continue
        if held is None:
            held = (key, p)
            continue
        other, q = held
        u = _draw(seed, other, key)
        both = p + q
        if both < 1 - 1e-12:  # one gives all to the other
            loser, winner = (other, key) if u < p / both else (key, other)
            whole(loser, 0)
            held = (winner, both)
        elif both > 1 + 1e-12:  # one is filled up by the other
            winner, rest = (other, key) if u < (1 - p) / (2 - both) else (key, other)
            whole(winner, 1)
            held = (rest, both - 1)
        else:
            winner, loser = (other, key) if u < q else (key, other)
            whole(winner, 1)
            whole(loser, 0)
            held = None
    return held


_ROUNDED = T.StructType([T.StructField("source", T.StringType()), T.StructField("key", T.StringType()), T.StructField("n_tokens", T.LongType()), T.StructField("node", T.LongType()), T.StructField("p", T.DoubleType())])


def _level(seed: int, level: int) -> Callable[[pa.Table], pa.Table]:
    """One node: p of 0 or 1 for what became whole, the residual with its p."""

    def run(t: pa.Table) -> pa.Table:
        rows = sorted(zip(t.column("n_tokens").to_pylist(), t.column("key").to_pylist(), t.column("p").to_pylist(), strict=True))
        out: dict[str, float] = {}
        left = pivot([(k, p) for _, k, p in rows], seed + level, lambda k, v: out.__setitem__(k, float(v)))
        if left:
            out[left[0]] = left[1]
        n = len(rows)
        return pa.table({"source": pa.array([t.column("source")[0].as_py()] * n, pa.string()), "key": pa.array([k for _, k, _ in rows], pa.string()), "n_tokens": pa.array([x for x, _, _ in rows], pa.int64()), "node": pa.array([t.column("node")[0].as_py()] * n, pa.int64()), "p": pa.array([out[k] for _, k, _ in rows], pa.float64())})

    return run


def round_copies(records: DataFrame, plans: list[Plan], key: str, source: str, size: str, seed: int = 0) -> DataFrame:
    """key, source, size, copies: whole numbers of copies whose expectation is the source's fractional one.

    ``records`` must have unique keys; those of a source that isn't planned (or null) are left out. A source of any size is cut into
    chunks of about CHUNK records (of like size, so far as hashing within ranges of size allows); each level of the tree brings FAN_IN
    residuals together, and the last residual of a source is drawn by itself. The number of levels follows from the record counts.
    """
    from quern.session import cut_lineage

    chosen = [p for p in plans if p.copies > 0]
    if not chosen:
        return records.select(F.col(key).cast("string").alias("key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens"), F.lit(0).cast("int").alias("copies")).limit(0)
    lookup = lambda f: F.try_element_at(F.create_map(*[F.lit(x) for p in chosen for x in (p.source, f(p))]), F.col("source"))
    base = records.select(F.col(key).cast("string").alias("key"), F.col(source).alias("source"), F.col(size).cast("bigint").alias("n_tokens")).where(F.col("source").isin([p.source for p in chosen]))
    base = base.withColumn("whole", lookup(lambda p: math.floor(p.copies + 1e-12)).cast("int")).withColumn("p", lookup(lambda p: max(0.0, p.copies - math.floor(p.copies + 1e-12))))
    chunks = {p.source: math.ceil(p.records / CHUNK) for p in chosen}
    most = max(chunks.values())
    node = F.pmod(F.xxhash64("key", F.lit(seed)), lookup(lambda p: chunks[p.source]).cast("bigint"))
    now = base.select("source", "key", "n_tokens", node.cast("bigint").alias("node"), "p")
    done, level, pending = [], 0, most
    while True:
        out = now.groupBy("source", "node").applyInArrow(_level(seed, level), _ROUNDED)
        if pending <= 1:
            last = F.when((F.col("p") > 0) & (F.col("p") < 1), ((F.pmod(F.xxhash64("key", F.lit(seed + 1)), F.lit(1 << 30)) / (1 << 30)) < F.col("p")).cast("double")).otherwise(F.col("p"))
            done.append(out.withColumn("p", last))
            break
        out = cut_lineage(out)
        done.append(out.where("p = 0 or p = 1"))
        now = out.where("p > 0 and p < 1").withColumn("node", F.floor(F.col("node") / FAN_IN))
        pending = math.ceil(pending / FAN_IN)
        level += 1
    rounded = done[0]
    for d in done[1:]:
        rounded = rounded.unionByName(d)
    return rounded.select("key", "source", "n_tokens", (F.col("p") + lookup(lambda p: math.floor(p.copies + 1e-12))).cast("int").alias("copies"))


def settle(rounded: DataFrame, plans: list[Plan], key: str = "key", rounds: int = SETTLE) -> DataFrame:
    """``rounded`` with a few records' copies raised or lowered by one, so that each source's size comes nearer to what was wanted.

    Rounding keeps a source's number of copies; where sizes differ much, its size may still be off by about its largest record. In each
    round every source gives up or takes one copy of the record whose size is nearest to what it has too much or too little, if that helps.
    A record stays within the whole numbers next to its fractional copies, so no cap is passed. Each round is one aggregation; at most
    ``rounds`` records of a source change, whatever its size.
    """
    wanted = {p.source: p.copies * p.tokens for p in plans if p.copies > 0}
    floors = {p.source: math.floor(p.copies + 1e-12) for p in plans if p.copies > 0}
    fractional = {p.source: p.copies - floors[p.source] > 1e-12 for p in plans if p.copies > 0}
    if not wanted:
        return rounded
    lookup = lambda values: F.try_element_at(F.create_map(*[F.lit(x) for pair in values.items() for x in pair]), F.col("source"))
    got = {r.source: int(r.n or 0) for r in rounded.groupBy("source").agg(F.sum(F.col("copies") * F.col("n_tokens")).alias("n")).collect()}
    off = {s: float(got.get(s, 0) - wanted[s]) for s in wanted}
    changed: dict[str, int] = {}
    for _ in range(rounds):
        open_ones = {s: d for s, d in off.items() if fractional[s] and abs(d) >= 1}
        if not open_ones:
            break
        d, floor = lookup(open_ones), lookup({s: floors[s] for s in open_ones})
        can = F.col("source").isin(list(open_ones)) & F.when(d > 0, F.col("copies") > floor).otherwise(F.col("copies") == floor) & ~F.col(key).isin(list(changed)) & (F.col("n_tokens") > 0) & (F.col("n_tokens") < 2 * F.abs(d))
        near = F.struct(F.abs(F.col("n_tokens") - F.abs(d)).alias("d"), F.col(key).alias("key"), F.col("n_tokens").alias("n"))
        found = rounded.where(can).groupBy("source").agg(F.min(near).alias("best")).collect()  # one row a source
        for r in found:
            step = -1 if off[r.source] > 0 else 1
            changed[r.best.key] = step
            off[r.source] += step * r.best.n
        if not found:
            break
    if not changed:
        return rounded
    steps = F.create_map(*[F.lit(x) for pair in changed.items() for x in pair])
    return rounded.withColumn("copies", (F.col("copies") + F.coalesce(F.try_element_at(steps, F.col(key)), F.lit(0))).cast("int"))


def source_totals(records: DataFrame, source: str, size: str, most_sources: int = 10_000) -> dict[str, tuple[int, int]]:
    """Records and size by source; a list of bounded length, or an error."""
    rows = records.where(F.col(source).isNotNull()).groupBy(source).agg(F.count(F.lit(1)), F.sum(size)).limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    return {r[0]: (r[1], int(r[2] or 0)) for r in rows}


def weights_of(table: DataFrame, most_sources: int = 10_000) -> dict[str, tuple[float, int]]:
    """Target share and most repeats by source; a null share counts 0, a null cap 1."""
    rows = table.where("source is not null").limit(most_sources + 1).collect()
    if len(rows) > most_sources:
        raise ValueError(f"more than {most_sources} sources")
    return {r.source: (float(r.target_share or 0.0), int(1 if r.max_repeats is None else r.max_repeats)) for r in rows}


def shares_reached(rounded: DataFrame, plans: list[Plan]) -> DataFrame:
    """source, target_share, wanted_share, records, copies, tokens, actual_share for each listed source, those without records too."""
    spark = rounded.sparkSession
    got = rounded.groupBy("source").agg(F.sum("copies").alias("copies"), F.sum(F.col("copies") * F.col("n_tokens")).alias("tokens"))
    listed = spark.createDataFrame([(p.source, p.target_share, p.wanted_share, p.records) for p in plans], "source string, target_share double, wanted_share double, records long")
    total = got.agg(F.sum("tokens").alias("_all"))
    zero = {"copies": F.coalesce("copies", F.lit(0)), "tokens": F.coalesce("tokens", F.lit(0))}
    return listed.join(got, "source", "left").withColumns(zero).crossJoin(F.broadcast(total)).withColumn("actual_share", F.when(F.col("_all") > 0, F.col("tokens") / F.col("_all")).otherwise(0.0)).drop("_all")
