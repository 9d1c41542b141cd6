"""Values typed by people, each mapped to the entry of a reference list that it means, or reported as meaning none.

The list's labels are paths of a trie: names and synonyms, with their words in several orders and with usual short forms in place of long
ones, all ending at the entry. A Levenshtein automaton runs over the trie and gives every entry within a distance that grows with
the label's length; the nearest is the decision.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import product

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Short forms by word, as people write them in headings.
SHORT_FORMS = {
    "customer": ["cust"], "account": ["acct"], "number": ["no", "num", "nr"], "address": ["addr"], "registration": ["reg"],
    "receival": ["rcvl"], "received": ["rcvd"], "weight": ["wt"], "protein": ["prot"], "moisture": ["moist"], "percent": ["pct"], "payment": ["pmt"], "invoice": ["inv"],
    "category": ["cat"], "discount": ["disc"], "telephone": ["tel"], "language": ["lang"], "preferred": ["pref"], "commodity": ["commod"], "maximum": ["max"],
    "lifetime": ["life"], "date": ["dt"], "vehicle": ["veh"], "reference": ["ref"], "delivered": ["deliv"], "quantity": ["qty"],
}
#: What people put round a heading without meaning anything by it.
_AROUND = re.compile(r"[ _.-]*\([^()]*\)\s*$|[ _]*[-–]+[ _]*t{1,2}e?xt[-–_ ]*$|[ _.-]*[*:#]+\s*$|(?<=[a-z])[ _.-]*\d\s*$", re.I)
_FILLERS = ("the", "our", "your", "my")
#: A label of fewer letters must match in full if it is a short form.
LEAST_FUZZY = 5


def allowed(length: int) -> int:
    """Greatest distance for a label of so many letters."""
    return 0 if length <= 3 else 1 if length <= 7 else 2 if length <= 11 else 3


def words_of(text: str) -> list[str]:
    """Lower-case words: cut at anything but letters and digits, and where a capital follows a small letter."""
    text = unicodedata.normalize("NFKC", text)
    text = re.sub(r"(?<=[a-z])(?=[A-Z])", " ", text)
    return [w for w in re.split(r"[^\w]|_", text.lower()) if w]


State = tuple[tuple[int, ...], tuple[int, ...], int]


class Automaton:
    """The Levenshtein automaton of a greatest distance, for all words at once; swapping two neighbours counts one.

    After a path of d letters only the word's prefixes of d - most to d + most letters can lie within reach, so a state holds just their
    distances (those before the last letter too, and where that letter stood in the word, for swaps). A transition depends on the state
    and on where the letter stands in that window of the word, not on the word: each is computed once and kept for every word and path.
    """

    def __init__(self, most: int):
        self.most, self.width = most, 2 * most + 1
        far = (most + 1,) * self.width
        self.start: State = (tuple(abs(i) if i >= 0 else most + 1 for i in range(-most, most + 1)), far, 0)
        self.known: dict[tuple[State, int], State | None] = {}

    def step(self, state: State, bits: int) -> State | None:
        """The state after one more letter, null if nothing is within reach. ``bits``: bit i is set if the letter stands where entry i of the new
        window ends."""
        try:
            return self.known[state, bits]
        except KeyError:
            pass
        (row, above, before), most, new = state, self.most, []
        for i in range(self.width):
            # The window moves along by one: entry i of the new one ends a letter further on than entry i of the old one.
            d = min(row[i] + (not bits >> i & 1), (row[i + 1] + 1) if i + 1 < self.width else most + 1, new[i - 1] + 1 if i else most + 1)
            if i and before >> i & 1 << 1 and bits >> (i - 1) & 1:
                d = min(d, above[i] + 1)
            new.append(min(d, most + 1))
        out = (tuple(new), row, bits) if min(new) <= most else None
        self.known[state, bits] = out
        return out


@lru_cache(maxsize=8)
def automaton(most: int) -> Automaton:
    return Automaton(most)


@dataclass
class _Node:
    next: dict[str, _Node] = field(default_factory=dict)
    ends: dict[int, bool] = field(default_factory=dict)  # entry: whether it may match fuzzily


class Trie:
    """The reference entries with their alias paths: each label's words in their own order, backwards and in order of the alphabet, with
    short forms in place of any of them."""

    def __init__(self, entries: dict[int, list[str]], short_forms: dict[str, list[str]] | None = None):
        self.root = _Node()
        short_forms = SHORT_FORMS if short_forms is None else short_forms
        for entry, labels in entries.items():
            for label in labels:
                words = words_of(label)
                for i, choice in enumerate(product(*[[w, *short_forms.get(w, [])] for w in words])):
                    for order in {choice, choice[::-1], tuple(sorted(choice))}:
                        path = "".join(order)
                        self.add(path, entry, i == 0 or len(path) >= LEAST_FUZZY)

    def add(self, path: str, entry: int, fuzzy: bool) -> None:
        node = self.root
        for c in path:
            node = node.next.setdefault(c, _Node())
        node.ends[entry] = fuzzy or node.ends.get(entry, False)

    def search(self, word: str) -> list[tuple[int, int, int]]:
        """(distance, -length, entry) of each entry within the distance allowed to one of its labels, the nearest first."""
        n, most = len(word), allowed(len(word) + 3)
        a = automaton(most)
        window = (1 << a.width) - 1
        at: dict[str, int] = {}
        for i, c in enumerate(word):
            at[c] = at.get(c, 0) | 1 << (i + most)  # shifted, so that windows may begin before the word
        out: dict[int, tuple[int, int]] = {}
        stack: list[tuple[_Node, int, State]] = [(self.root, 0, a.start)]
        while stack:
            node, depth, state = stack.pop()
            if node.ends and 0 <= (i := n - depth + most) < a.width and (d := state[0][i]) <= allowed(max(depth, 1)):
                for entry, fuzzy in node.ends.items():
                    if (fuzzy or d == 0) and (d, -depth) < out.get(entry, (n + 1, 0)):
                        out[entry] = (d, -depth)
            for c, child in node.next.items():
                after = a.step(state, at.get(c, 0) >> depth & window)
                if after is not None:
                    stack.append((child, depth + 1, after))
        return sorted((d, size, entry) for entry, (d, size) in out.items())


def readings(value: str) -> list[str]:
    """The value as letters and digits only, without what stands round it, then without a leading filler word."""
    bare = value
    for _ in range(3):
        bare = _AROUND.sub(" ", bare.strip())
    words = words_of(bare) or words_of(value)
    joined = "".join(words)
    core = list(words)
    while len(core) > 1 and (core[0] in _FILLERS or core[-1] in _FILLERS):
        core = core[1:] if core[0] in _FILLERS else core[:-1]
    out = list(dict.fromkeys(["".join(core), "".join(sorted(core))]))
    for f in _FILLERS:
        if joined.startswith(f) and len(joined) - len(f) >= 4 and joined[len(f) :] not in out:
            out.append(joined[len(f) :])
    return out


def matches(trie: Trie, value: str) -> list[tuple[int, int, int]]:
    """All entries within reach of any reading of the value, the nearest first."""
    best: dict[int, tuple[int, int]] = {}
    for r in readings(value):
        for d, size, entry in trie.search(r):
            best[entry] = min(best.get(entry, (99, 0)), (d, size))
    return sorted((d, size, entry) for entry, (d, size) in best.items())


@lru_cache(maxsize=4)
def _trie(entries: tuple[tuple[int, tuple[str, ...]], ...], short_forms: tuple[tuple[str, tuple[str, ...]], ...]) -> Trie:
    return Trie({e: list(labels) for e, labels in entries}, {w: list(s) for w, s in short_forms})


def _map_batches(batches: Iterator[pa.RecordBatch], entries: tuple, short_forms: tuple) -> Iterator[pa.RecordBatch]:
    trie = _trie(entries, short_forms)
    known: dict[tuple[str, ...], list[tuple[int, int, int]]] = {}  # of this batch's readings only
    for batch in batches:
        known.clear()
        found = []
        for v in batch.column(0).to_pylist():
            key = tuple(readings(v))
            if key not in known:
                known[key] = matches(trie, v)
            found.append(known[key])
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), pa.array([m[0][2] if m else -1 for m in found], pa.int64()), pa.array([m[0][0] if m else None for m in found], pa.int32()), pa.array([[x[2] for x in m] for m in found], pa.list_(pa.int64()))],
            names=["_value", "entry", "distance", "candidates"],
        )


def map_values(df: DataFrame, value: str, entries: dict[int, list[str]], most_entries: int = 100_000, short_forms: dict[str, list[str]] | None = None) -> DataFrame:
    """``df`` with entry (-1 where none is meant), distance and candidates (every entry within reach, the nearest first).

    ``entries``: labels by entry, a list of bounded size that every task holds; more than ``most_entries`` labels raise an error.
    Blank values (null, empty, white space) get a null entry and are never mapped. Equal values are looked up once. Of entries as
    near, that of the longer label counts, then the smaller number. ``short_forms``: how words are shortened (SHORT_FORMS if null).
    """
    if sum(map(len, entries.values())) > most_entries:
        raise ValueError(f"more than {most_entries} labels: too many for each task to hold")
    frozen = tuple((e, tuple(labels)) for e, labels in sorted(entries.items()))
    short = tuple((w, tuple(x)) for w, x in sorted((SHORT_FORMS if short_forms is None else short_forms).items()))
    v = F.col(value)
    # Looking up is far dearer than moving a value, so the values are spread evenly rather than by the size of their text.
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions", "200")), df.sparkSession.sparkContext.defaultParallelism)
    distinct = df.where(v.rlike(r"\S")).select(v.alias("_value")).distinct().repartition(tasks)
    schema = T.StructType([T.StructField("_value", T.StringType()), T.StructField("entry", T.LongType()), T.StructField("distance", T.IntegerType()), T.StructField("candidates", T.ArrayType(T.LongType()))])
    found = distinct.mapInArrow(lambda it: _map_batches(it, frozen, short), schema)
    return df.join(found, v == F.col("_value"), "left").drop("_value")


def reference_entries(fields: DataFrame, most_rows: int = 10_000) -> dict[int, list[str]]:
    """Labels by field_id of a table of field_id, field_name, synonyms (separated by semicolons), which must be of bounded size."""
    rows = fields.select("field_id", "field_name", "synonyms").limit(most_rows + 1).collect()
    if len(rows) > most_rows:
        raise ValueError(f"a reference list of more than {most_rows} entries")
    return {r.field_id: [x for x in [r.field_name, *(r.synonyms or "").split(";")] if x and x.strip()] for r in rows if r.field_id is not None}
