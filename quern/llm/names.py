"""Variant spellings of names, linked to the party they mean.

What a word tells is learnt from the table itself (see Lexicon): how common it is, whether it stands in names of firms or of persons, and which
other word people write in its place. Names become vectors of character n-grams weighted over the whole table; a sparse product gives
every pair of spellings of a district whose cosine reaches a threshold; an exact comparison of the names' parts follows (typing errors,
short forms, initials, order of parts); spellings are then grouped by average linkage, and ids follow their spellings.
"""

from __future__ import annotations

import copy
import heapq
import math
import re
import unicodedata
import zlib
from collections import defaultdict
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quern.functions.text import clean, strip
from quern.session import cut_lineage

#: Letters in an n-gram; each word is marked at both ends.
N = 3
#: Least cosine of a pair that is compared part by part.
COSINE = 0.36
#: Least average similarity at which two groups of spellings are joined.
LINKAGE = 0.34
#: Counters of n-grams, which share one where their hashes meet: the table of weights has a fixed size.
GRAM_BUCKETS = 1 << 18
#: N-grams in a smaller share of the names weigh alike: those that only an error made would otherwise outweigh all others of a name.
RARE_GRAM = 0.001
#: A word in a greater share of the names is common: alone it doesn't tell a party. At most words per name / COMMON words are.
COMMON = 0.004
#: Names that a word's share is reckoned over in addition to those there are, so that no word of a short table seems common.
PRIOR = 2000
#: A common word is a firm's if this share of its names has a legal form, and a person's below PERSON.
FIRM, PERSON = 0.3, 0.05
#: Least share of all observed exchanges that a pair of words needs to count as one: with it there are at most 1 / RARE_PAIR pairs.
RARE_PAIR = 1e-5
#: Spellings that one task compares with each other. How many tasks share the work, never its result.
BLOCK = 2000
#: Products that similar_pairs holds at a time.
PAIRS = 2_000_000
#: Links of a district that one task groups; a district of more is cut into its connected parts first, which changes no group.
PART = 200_000

# Forms of address, words between names, and legal forms by their words, as registers of companies write them.
TITLES = frozenset("mr mrs ms miss mx dr prof sir rev hon".split())
_UNSAID = TITLES | {"and", "the"}
LEGAL = {"ltd": "ltd", "limited": "ltd", "pty": "pty", "proprietary": "pty", "coop": "coop", "cooperative": "coop", "operative": "coop", "op": "coop", "company": "company", "co": "company", "sons": "sons", "son": "sons", "inc": "inc", "incorporated": "inc", "corp": "corp", "corporation": "corp", "llc": "llc", "llp": "llp", "plc": "plc", "gmbh": "gmbh", "ag": "ag", "sa": "sa", "bv": "bv", "trading": ""}
_LONG_LEGAL = [w for w in LEGAL if len(w) >= 6]
_WORD = re.compile(r"[a-z0-9]+")
#: Accents of Latin, Greek and Cyrillic letters; marks of other scripts are part of the word.
_ACCENTS = re.compile("[̀-ͯ]")
_SONS, _POSSESSIVE, _HYPHEN, _PTY_LTD = re.compile(r"\bson's\b"), re.compile(r"'s\b"), re.compile(r"(?<=[a-z])-(?=[a-z])"), re.compile(r"\bp\s*/\s*l\b")
_LETTERS = str.maketrans({"ø": "o", "ł": "l", "ß": "ss", "æ": "ae", "đ": "d", "ð": "d", "þ": "th", "œ": "oe", "ı": "i"})
_VOWELS = re.compile("(?<=.)[aeiou]")


@dataclass(frozen=True)
class Lexicon:
    """What a table's names tell of its words.

    shares: share of the names of each common word; firms, persons: common words that stand in names of one kind; aliases: for a word the
    words it is written for, the likeliest first; weights: square of the logarithmic weight of the n-grams, by bucket, in whole numbers;
    total: names there are.
    """

    shares: dict[str, float] = field(default_factory=dict)
    firms: frozenset[str] = frozenset()
    persons: frozenset[str] = frozenset()
    aliases: dict[str, tuple[str, ...]] = field(default_factory=dict)
    weights: np.ndarray | None = None
    total: int = 0

    def share(self, word: str) -> float:
        return self.shares.get(word, COMMON)

    def weight(self, grams: np.ndarray) -> np.ndarray:
        return np.ones(len(grams)) if self.weights is None else self.weights[grams].astype(np.float64)


#: A lexicon that knows nothing: every word is rare, none stands for another, all n-grams weigh the same.
UNKNOWN = Lexicon()


@lru_cache(maxsize=1 << 17)
def _letters(w: str) -> frozenset[str]:
    return frozenset(w)


@lru_cache(maxsize=1 << 17)
def _bits(w: str) -> int:
    """A bit for each letter of the word; some letters share one, so two words may only seem more alike."""
    return sum({1 << ord(c) % 64 for c in w})


@lru_cache(maxsize=1 << 18)
def edits(a: str, b: str, most: int) -> int:
    """Insertions, deletions, substitutions and swaps of neighbours between two words; ``most`` + 1 if there are more."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > most or len(_letters(a) ^ _letters(b)) > 2 * most:  # an edit brings one letter in and takes one out
        return most + 1
    before, row = [0] * (len(b) + 1), list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            d = min(row[j] + 1, new[j - 1] + 1, row[j - 1] + (x != y))
            if i > 1 and j > 1 and x == b[j - 2] and a[i - 2] == y:
                d = min(d, before[j - 2] + 1)
            new.append(d)
        if min(new) > most:
            return most + 1
        before, row = row, new
    return row[-1]


_NO_INITIALS: frozenset[str] = frozenset()


class Name(NamedTuple):
    """What a name says: full words in order of the alphabet, initials, legal form; kind: f for a firm's, p for a person's, empty if unknown."""

    words: tuple[str, ...]
    initials: frozenset[str]
    legal: str
    kind: str = ""

    def key(self) -> str:
        """What the name says as text: equal for equal names only. No part holds the bar."""
        return "|".join((" ".join(self.words), " ".join(sorted(self.initials)), self.legal, self.kind))

    @staticmethod
    def of(key: str) -> Name:
        words, initials, legal, kind = key.split("|")
        return Name(tuple(words.split()), frozenset(initials.split()) if initials else _NO_INITIALS, legal, kind)


def _consonants(w: str) -> str:
    """The word without the vowels after its first letter: how people shorten long words."""
    return _VOWELS.sub("", w)


#: Long legal forms, without their vowels, their first and their last two letters.
_LEGAL_PARTS = [(w, _consonants(w), w[:2], w[-2:]) for w in _LONG_LEGAL]


@lru_cache(maxsize=1 << 16)
def _legal(w: str) -> str | None:
    """The legal form a word stands for: known words, long ones with one typing error, and ones without their vowels; null if none."""
    if w in LEGAL:
        return LEGAL[w]
    for known, bare, head, tail in _LEGAL_PARTS if len(w) >= 4 else ():
        if w == bare or (len(w) >= 5 and (w.startswith(head) or w.endswith(tail)) and edits(w, known, 1) <= 1):
            return LEGAL[known]
    return None


def _words(s: str) -> list[str]:
    """Runs of letters, marks and digits of any script."""
    return _WORD.findall(s) if s.isascii() else "".join(c if unicodedata.category(c)[0] in "LMN" else " " for c in s).split()


def parse_key(text: str) -> str:
    """The key (see Name.key) of what a name says, before any word is written out; no words: the name says nothing."""
    s = text.lower()
    if not s.isascii():
        s = _ACCENTS.sub("", unicodedata.normalize("NFKD", s.translate(_LETTERS)).replace("’", "'"))
    if "'" in s:
        s = _POSSESSIVE.sub("", _SONS.sub("sons", s)).replace("'", "")
    if "-" in s:
        s = _HYPHEN.sub("", s)  # a name that is sometimes hyphenated; also co-op
    if "/" in s:
        s = _PTY_LTD.sub("pty", s)
    words, initials, legal = [], [], []
    for w in _words(s):
        if len(w) == 1:
            initials.append(w)
        elif w not in _UNSAID:
            form = _legal(w)
            if form is None:
                words.append(w)
            else:
                legal.append(form)
    if len(initials) > 1:
        initials = sorted(set(initials))
    if len(words) > 1:
        words.sort()
    kind = ""
    if legal:
        kind, forms = "f", set(legal)
        if "coop" in forms:
            forms.discard("company")  # co-op, co-operative
        if "pty" in forms:
            forms.discard("ltd")
        forms.discard("")
        legal = sorted(forms)
    # A name of initials only has them for words.
    return f"{' '.join(words or initials)}|{' '.join(initials)}|{' '.join(legal)}|{kind}"


def parse_name(text: str, lexicon: Lexicon = UNKNOWN) -> Name:
    return written_out(Name.of(parse_key(text)), lexicon)


def written_out(name: Name, lexicon: Lexicon) -> Name:
    """The name with each word that stands for another replaced by it, and its kind told by its words where no legal form does."""
    words = name.words
    if not lexicon.aliases.keys().isdisjoint(words):
        words = tuple(sorted(lexicon.aliases[w][0] if w in lexicon.aliases else w for w in words))
    kind = name.kind or ("p" if lexicon.firms.isdisjoint(words) and not lexicon.persons.isdisjoint(words) else "" if lexicon.firms.isdisjoint(words) else "f")
    return name if words == name.words and kind == name.kind else Name(words, name.initials, name.legal, kind)


def _near(a: str, b: str) -> bool:
    """Whether two words may be one, mistyped: one edit from four letters on, two from nine on, but not both in one place.

    A stretch of one or two letters that stands for another is as a rule another syllable, hence another name, and not two errors.
    """
    longest = max(len(a), len(b))
    most = 0 if longest < 4 else 1 if longest < 9 else 2
    if not most or abs(len(a) - len(b)) > most or len(_letters(a) ^ _letters(b)) > 2 * most:
        return a == b
    found = edits(a, b, most) if a < b else edits(b, a, most)
    if found < 2:
        return found <= most
    if found > most:
        return False
    start = next((i for i, (x, y) in enumerate(zip(a, b, strict=False)) if x != y), min(len(a), len(b)))
    end = next((i for i, (x, y) in enumerate(zip(reversed(a[start:]), reversed(b[start:]), strict=False)) if x != y), min(len(a), len(b)) - start)
    return longest - start - end > 2


def _shortened(a: str, b: str, lexicon: Lexicon) -> bool:
    """Whether one word is short for the other: known to stand for it, its beginning, or some of its letters in their order.

    A common word isn't short for one that isn't much more common, and letters in order are enough for common words only.
    """
    if b in lexicon.aliases.get(a, ()) or a in lexicon.aliases.get(b, ()):
        return True
    short, full = sorted((a, b), key=len)
    if short[0] != full[0] or len(full) < len(short) + 2 or (short in lexicon.shares and lexicon.shares[short] * 5 > lexicon.share(full)):
        return False
    if len(short) >= 3 and full.startswith(short):
        return True
    letters = iter(full)
    return full in lexicon.shares and all(c in letters for c in short)


def same_party(a: Name, b: Name, lexicon: Lexicon = UNKNOWN) -> bool:
    """Whether two names may denote one party: every full word of either has its match in the other, in whatever order.

    Matches are equal, near or shortened words, or, with persons, a word and an initial that the other has in its place. Middle initials that
    differ, and legal forms that differ, tell two parties apart; one that is missing doesn't. The words that both hold must be too rare,
    together, to meet by chance.
    """
    if (a.kind != b.kind and a.kind and b.kind) or not a.words or not b.words or (a.legal and b.legal and a.legal != b.legal):
        return False
    firm = "f" in (a.kind, b.kind)
    if not a.initials and not b.initials and len(a.words) != len(b.words):
        return False  # a word without its match
    left, right, off, chance = list(a.words), list(b.words), 0, 1.0
    for w in a.words:
        if w in right:
            left.remove(w)
            right.remove(w)
            chance *= lexicon.share(w)
    met = len(a.words) - len(left)
    near_long = False
    for w in list(left):
        close = [x for x in right if _near(w, x)]
        if close:
            best = min(close, key=lambda x: edits(*sorted((w, x)), 2))
            left.remove(w)
            right.remove(best)
            off += 1
            near_long |= max(len(w), len(best)) >= 9
            chance *= max(lexicon.share(w), lexicon.share(best))  # an error of a common word is no rare word
    for w in list(left):
        full = next((x for x in right if _shortened(w, x, lexicon)), None)
        if full:
            left.remove(w)
            right.remove(full)
    free_a, free_b = set(a.initials), set(b.initials)
    for words, initials in ((left, free_b), (right, free_a)):
        for w in words:
            if w[0] not in initials or firm:
                return False
            initials.discard(w[0])
    if free_a and free_b and not (free_a & free_b):
        return False
    if not met and off > 1 and not near_long:
        return False  # nothing stands in both as it is
    return chance <= COMMON


@lru_cache(maxsize=1 << 17)
def grams(word: str) -> tuple[int, ...]:
    """Buckets of the word's n-grams."""
    marked = f"#{word}#"
    return tuple(zlib.crc32(marked[i : i + N].encode()) % GRAM_BUCKETS for i in range(len(marked) - N + 1))


def vector(name: Name) -> np.ndarray:
    """Buckets of a name's different n-grams."""
    return np.array(list(set().union(*map(grams, name.words))), np.int32)


def heaviest(own: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The n-grams, heaviest first, that a partner must share one of: with none of them no cosine reaches COSINE."""
    order = np.lexsort((own, -weights))
    w = weights[order]
    rest = w.sum() - np.concatenate(([0.0], np.cumsum(w)[:-1]))
    return own[order[rest >= COSINE * COSINE * w.sum() * 0.9999]]  # cosines are rounded


def _byte_sums() -> np.ndarray:
    """Checksums of N bytes are the exclusive or of these, by place and byte."""
    none = zlib.crc32(bytes(N))
    return np.array([[zlib.crc32(bytes(i) + bytes([c]) + bytes(N - 1 - i)) ^ (none if i else 0) for c in range(128)] for i in range(N)], np.uint32)


_BYTE_SUMS = _byte_sums()


class Words:
    """Words with what is looked up of each: n-grams as of grams (grams, begin, size), letters as of _bits, and the first letter (first)."""

    def __init__(self, words: list[str]):
        text = f"#{'#'.join(words)}#"
        codes = np.frombuffer(text.encode("ascii", "replace"), np.uint8)  # a letter a byte; others are put right below
        sums = np.zeros(max(0, len(codes) - N + 1), np.uint32)
        for i in range(N):
            sums ^= _BYTE_SUMS[i][codes[i : i + len(sums)]]
        length = np.array([len(w) for w in words], np.int64)
        self.grams = (sums % GRAM_BUCKETS).astype(np.int64)
        self.begin, self.size = np.cumsum(length + 1) - length - 1, np.maximum(length + 3 - N, 0)
        letters = np.uint64(1) << (codes % 64).astype(np.uint64)
        letters[codes == ord("#")] = 0
        self.letters = np.bitwise_or.reduceat(letters, self.begin + 1) if len(words) else np.zeros(0, np.uint64)
        self.first = codes[self.begin + 1].astype(np.int64)
        for k in () if text.isascii() else [k for k, w in enumerate(words) if not w.isascii()]:
            self.grams[self.begin[k] : self.begin[k] + self.size[k]] = grams(words[k])
            self.letters[k], self.first[k] = _bits(words[k]), ord(words[k][0])

    def vectors(self, word: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The different n-grams of names and the name of each, rising. ``word``: the words of all names, one name after the other; ``many``: words of each."""
        size = self.size[word]
        place = np.arange(size.sum()) + np.repeat(self.begin[word] - np.cumsum(size) + size, size)
        name = np.repeat(np.repeat(np.arange(len(many)), many), size)
        codes = np.unique(name * GRAM_BUCKETS + self.grams[place])
        return codes % GRAM_BUCKETS, codes // GRAM_BUCKETS


class TwoWords:
    """What tells, for many pairs of names at a time, that same_party would refuse them: legal forms that differ, and, of two names of two
    words each, not both with initials, one word that is equal while the others can neither be near (their letters or lengths differ too much,
    see _near and edits) nor be one short for the other (they begin differently, or each has a letter that the other hasn't)."""

    def __init__(self, names: list[Name], lexicon: Lexicon):
        ids: dict[str, int] = {}
        self.all = np.array([ids.setdefault(x, len(ids)) for n in names for x in n.words], np.int64)
        self.many = np.array([len(n.words) for n in names], np.int64)
        self.words = Words(list(ids))
        self.length = np.array([len(x) for x in ids], np.int64)
        forms: dict[str, int] = {"": 0}
        self.legal = np.array([forms.setdefault(n.legal, len(forms)) for n in names], np.int64)
        self.initials = np.array([bool(n.initials) for n in names], bool)
        stands = np.zeros(len(ids), bool)
        stands[[ids[x] for x in lexicon.aliases.keys() & ids.keys()]] = True
        self.plain = self.many == 2
        self.word = np.zeros((len(names), 2), np.int64)
        self.word[self.plain] = self.all[np.repeat(self.plain, self.many)].reshape(-1, 2)
        self.plain &= ~stands[self.word].any(1)

    def of(self, at: np.ndarray) -> TwoWords:
        """The same of some of the names only."""
        some = copy.copy(self)
        some.plain, some.word, some.legal, some.initials = self.plain[at], self.word[at], self.legal[at], self.initials[at]
        return some

    def vectors(self) -> tuple[np.ndarray, np.ndarray]:
        """See Words.vectors."""
        return self.words.vectors(self.all, self.many)

    def refused(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        (a, b), (c, d), letters = self.word[i].T, self.word[j].T, self.words.letters
        met = np.stack((a == c, a == d, b == c, b == d))
        x = np.where(met[0] | met[1], b, a)  # the word that isn't met, if one is
        y = np.where(met[0] | met[2], d, c)
        longest = np.maximum(self.length[x], self.length[y])
        most = np.where(longest < 4, 0, np.where(longest < 9, 1, 2))
        far = (np.bitwise_count(letters[x] ^ letters[y]) > 2 * most) | (np.abs(self.length[x] - self.length[y]) > most)
        unlike = (self.words.first[x] != self.words.first[y]) | ((letters[x] & ~letters[y] != 0) & (letters[y] & ~letters[x] != 0))
        differ = self.plain[i] & self.plain[j] & (met.sum(0) == 1) & far & unlike & ~(self.initials[i] & self.initials[j])
        return differ | ((self.legal[i] != self.legal[j]) & (self.legal[i] > 0) & (self.legal[j] > 0))


@lru_cache(maxsize=64)
def _few(length: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(length, 1)


def similar_pairs(vectors: list[np.ndarray], lexicon: Lexicon, sides: np.ndarray | None = None, least: float = COSINE, words: TwoWords | None = None) -> Iterator[tuple[int, int, float]]:
    """Index pairs (i < j) with a cosine of at least ``least``: the sparse product of the vectors with themselves, through inverted lists.

    Every partner above the threshold comes out: a number of nearest ones beyond which none is looked at would lose links. With
    ``sides`` only pairs of different sides count; those that ``words`` refuses are left out. Weights are whole numbers, so sums are exact and a cosine depends on its two names only.
    """
    if vectors:
        row = np.repeat(np.arange(len(vectors)), [len(v) for v in vectors])
        for found in _similar(np.concatenate(vectors), row, len(vectors), lexicon, sides, least, words):
            yield from zip(*(x.tolist() for x in found), strict=True)


def _similar(flat: np.ndarray, row: np.ndarray, n: int, lexicon: Lexicon, sides: np.ndarray | None, least: float, words: TwoWords | None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """What similar_pairs gives, in arrays. ``flat``, ``row``: the n-grams of the names and the name of each, rising, of ``n`` names."""
    if n < 2:
        return
    row = row.astype(np.int32 if n < 46_000 else np.int64)  # n * n must fit
    w = lexicon.weight(flat)
    norm = np.bincount(row, w, n)
    root = np.sqrt(norm)
    root[root == 0] = 1.0
    # Candidates: names that share one of their heaviest n-grams (see heaviest), for all rows at a time.
    order = np.lexsort((flat, -w, row))
    upto = np.cumsum(w[order])
    rest = norm[row] - (upto - w[order]) + (np.cumsum(norm) - norm)[row]
    heavy = order[rest >= least * least * norm[row] * 0.9999]
    heavy = heavy[np.lexsort((row[heavy], flat[heavy]))]  # inverted lists: the rows of each n-gram, rising
    lists, gram = row[heavy], flat[heavy]
    begin = np.flatnonzero(np.concatenate(([True], gram[1:] != gram[:-1])))
    lengths = np.diff(np.concatenate((begin, [len(gram)])))
    # What each pair's heavy n-grams add up to; the others add at most what is light in either name.
    partial, codes, values, held = None, [], [], 0
    weight = w[heavy]

    def add() -> None:
        nonlocal held, partial
        if codes or partial is None:
            sums = np.bincount(np.concatenate([np.zeros(0, row.dtype), *codes]), np.concatenate([np.zeros(0), *values]), n * n)
            partial = sums if partial is None else partial + sums
            codes.clear()
            values.clear()
            held = 0

    for length in np.unique(lengths[lengths > 1]):  # all lists of one length at a time
        first, second = _few(int(length)) if length < 64 else np.triu_indices(length, 1)
        starts = begin[lengths == length]
        for at in np.array_split(starts, max(1, len(starts) * len(first) // PAIRS)):
            rows = lists[at[:, None] + np.arange(length)]
            codes.append((rows[:, first] * n + rows[:, second]).ravel())
            values.append(np.repeat(weight[at], len(first)))
            held += len(codes[-1])
            if held > PAIRS:
                add()
    add()
    candidates = np.flatnonzero(partial)
    light = norm - np.bincount(row[heavy], weight, n)
    i, j = candidates // n, candidates % n
    candidates = candidates[partial[candidates] + light[i] + light[j] >= least * root[i] * root[j] * 0.9999]
    # Their products, over the n-grams of the first of each pair.
    known, at = np.unique(flat, return_inverse=True)
    has = np.zeros((n, len(known)), bool)
    has[row, at] = True
    has, width = has.ravel(), len(known)
    sizes = np.bincount(row, minlength=n)
    ends = np.cumsum(sizes)
    for chunk in np.array_split(candidates, max(1, len(candidates) * 32 // PAIRS)):
        i, j = chunk // n, chunk % n
        if sides is not None:
            apart = sides[i] != sides[j]
            i, j = i[apart], j[apart]
        if words is not None:
            open_ones = ~words.refused(i, j)
            i, j = i[open_ones], j[open_ones]
        if not len(i):
            continue
        many = sizes[i]
        stops = np.cumsum(many)
        place = np.arange(stops[-1]) + np.repeat(ends[i] - stops, many)
        dots = np.add.reduceat(w[place] * has.take(np.repeat(j * width, many) + at[place]), stops - many)
        cosine = dots / (root[i] * root[j])
        kept = cosine >= least
        yield i[kept], j[kept], cosine[kept]


def average_linkage(size: int, links: dict[tuple[int, int], float], least: float = LINKAGE, weights: list[int] | None = None) -> list[int]:
    """Group of each of ``size`` nodes; two groups join while the mean similarity of their pairs (0 where no link is) is ``least``.

    ``weights``: how many members a node stands for; its links are then sums over the pairs of members.
    """
    group = list(range(size))
    members = dict(enumerate(weights or [1] * size))
    total: dict[int, dict[int, float]] = defaultdict(dict)
    for (i, j), s in links.items():
        total[i][j] = total[j][i] = s
    heap = [(-s / (members[i] * members[j]), i, j) for (i, j), s in sorted(links.items())]
    heapq.heapify(heap)
    joined: dict[int, list[int]] = {i: [i] for i in range(size)}
    while heap:
        s, i, j = heapq.heappop(heap)
        if i not in members or j not in members or -s < least:
            continue
        now = total[i].get(j, 0.0) / (members[i] * members[j])
        if abs(now + s) > 1e-9:
            continue  # one of the groups has grown since; its newer entry stands in the heap
        for k, v in total.pop(j).items():
            total[k].pop(j, None)
            if k != i:
                total[i][k] = total[k][i] = total[i].get(k, 0.0) + v
        members[i] += members.pop(j)
        joined[i] += joined.pop(j)
        for k, v in total[i].items():
            heapq.heappush(heap, (-v / (members[i] * members[k]), min(i, k), max(i, k)))
    for i, nodes in joined.items():
        for k in nodes:
            group[k] = i
    return group


def _components(size: int, links: Iterable[tuple[int, int]]) -> list[int]:
    parent = list(range(size))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in links:
        a, b = root(i), root(j)
        if a != b:
            parent[max(a, b)] = min(a, b)
    return [root(i) for i in range(size)]


def group_spellings(size: int, links: dict[tuple[int, int], float], one: list[tuple[int, int]]) -> list[int]:
    """Group of each spelling: those of one id (pairs ``one``) are together, the rest by average linkage within each connected part."""
    fixed = _components(size, one)
    sizes: dict[int, int] = defaultdict(int)
    for f in fixed:
        sizes[f] += 1
    sums: dict[tuple[int, int], float] = defaultdict(float)
    for (i, j), s in sorted(links.items()):
        a, b = fixed[i], fixed[j]
        if a != b:
            sums[min(a, b), max(a, b)] += s
    part = _components(size, sums)
    inside: dict[int, list[int]] = defaultdict(list)
    for i in sorted(sizes):
        inside[part[i]].append(i)
    own: dict[int, dict[tuple[int, int], float]] = defaultdict(dict)
    for (i, j), s in sums.items():
        own[part[i]][i, j] = s
    out = list(range(size))
    for p, nodes in inside.items():
        at = {x: k for k, x in enumerate(nodes)}
        groups = average_linkage(len(nodes), {(at[i], at[j]): s for (i, j), s in own[p].items()}, weights=[sizes[x] for x in nodes])
        for x, g in zip(nodes, groups, strict=True):
            out[x] = nodes[g]
    return [out[f] for f in fixed]


# ---- what the words tell


def _field(name: str, kind: str) -> T.StructField:
    return T.StructField(name, {"s": T.StringType(), "l": T.LongType(), "d": T.DoubleType(), "b": T.BooleanType(), "i": T.IntegerType()}[kind])


def _rows(names: list[str], types: list[pa.DataType], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """district, id and the key of what the name says; names without words are left out."""
    for batch in batches:
        keys = [parse_key(text) for text in batch.column("name").to_pylist()]
        rows = pa.RecordBatch.from_arrays([batch.column("district"), batch.column("id"), pa.array(keys, pa.string())], names=["district", "id", "key"])
        yield rows.filter(pa.array([key[0] != "|" for key in keys], pa.bool_()))


def _gram_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bucket, n: in how many names the n-grams of a bucket stand, of the words of a task."""
    counts = np.zeros(GRAM_BUCKETS, np.int64)
    for batch in batches:
        words = Words(batch.column("word").to_pylist())
        own, word = words.vectors(np.arange(len(words.size)), np.ones(len(words.size), np.int64))
        np.add.at(counts, own, batch.column("n").to_numpy()[word])
    at = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], names=["bucket", "n"])


def _part(key: Column, i: int) -> Column:
    return F.split_part(key, F.lit("|"), F.lit(i))


def _meetings(spelled: DataFrame, common: list[str]) -> DataFrame:
    """spot, word, others: the words that meet in a remainder, each once, and how many others it meets there. A remainder is all of a name
    but one word, and holds a word that isn't common; one that only a single word completes is left out."""
    words = spelled.select("district", F.split(_part(F.col("key"), 1), " ").alias("words")).where(F.size("words") > 1)
    telling = F.size(F.filter("words", lambda w: ~w.isin(common))) if common else F.size("words")
    each = words.select("district", "words", telling.alias("telling"), F.posexplode("words").alias("i", "word"))
    each = each.where(F.col("telling") > (F.when(F.col("word").isin(common), 0).otherwise(1) if common else F.lit(1)))
    rest = F.concat(F.slice("words", F.lit(1), F.col("i")), F.slice("words", F.col("i") + 2, F.size("words")))
    spots = each.select(F.xxhash64("district", rest).alias("spot"), "word").repartition("spot").distinct()
    return spots.withColumn("others", F.count(F.lit(1)).over(Window.partitionBy("spot")) - 1).where("others > 0")


def _exchanged(met: DataFrame, least: int) -> DataFrame:
    """a, b (words, a < b), n: in how many remainders both stand, of every pair that meets in ``least`` or more. ``met``: see _meetings.

    No pair is passed over: a word that stands in fewer remainders than ``least`` can't be part of one, and of the others every pair counts.
    With ``least`` as in _aliases these are at most 2 / RARE_PAIR words, and the pairs to be counted at most 1 / sqrt(2 * RARE_PAIR) a row of ``met``,
    however many words meet in one remainder.
    """
    often = met.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least).select(F.col("word").alias("_w"))
    kept = met.join(often, F.col("word") == F.col("_w"), "left_semi")
    both = kept.select("spot", F.col("word").alias("a")).join(kept.select("spot", F.col("word").alias("b")), "spot").where("a < b")
    return both.groupBy("a", "b").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= least)


def _aliases(met: DataFrame) -> dict[str, tuple[str, ...]]:
    """For a word the words it stands for: those that take its place far more often than their own frequency explains. Of two words that are
    one but for a typing error neither stands for the other, and where they meet counts for neither."""
    total = (met.agg(F.sum("others").alias("n")).first().n or 0) // 2
    least = max(3, math.ceil(total * RARE_PAIR))
    longest = F.greatest(F.length("a"), F.length("b"))
    mistyped = (longest >= 4) & (F.levenshtein("a", "b") <= F.when(longest < 9, 1).otherwise(2))
    pairs = _exchanged(met, least).withColumn("mistyped", mistyped).collect()  # at most 1 / RARE_PAIR rows
    ends = {r.word: r.all for r in met.groupBy("word").agg(F.count(F.lit(1)).alias("n"), F.sum("others").alias("all")).where(F.col("n") >= least).collect()} if pairs else {}
    for r in pairs:
        if r.mistyped:
            ends[r.a], ends[r.b], total = ends[r.a] - r.n, ends[r.b] - r.n, total - r.n
    found: dict[str, list[tuple[int, str]]] = defaultdict(list)
    for r in pairs:
        if r.mistyped:
            continue
        (short, n_short), (full, n_full) = sorted(((r.a, ends[r.a]), (r.b, ends[r.b])), key=lambda x: (x[1], x[0]))
        expected = n_short * n_full / (2 * total)
        if r.n >= 0.2 * n_short and r.n >= 2 + expected + 4 * math.sqrt(expected) and n_short * 2 <= n_full:
            found[short].append((r.n, full))
    return {w: tuple(full for _, full in sorted(x, key=lambda y: (-y[0], y[1]))) for w, x in found.items()}


def learn(spelled: DataFrame, nicknames: dict[str, list[str]] | None = None) -> Lexicon:
    """The Lexicon of a table's names. ``spelled``: district, key, each once, and n, how many names say it; ``nicknames``: short forms known
    beforehand, by word.

    Everything is counted over all rows; what comes to the driver is bounded by COMMON, RARE_PAIR and GRAM_BUCKETS.
    """
    legal = _part(F.col("key"), 4) == "f"
    split = spelled.select(F.explode(F.array_distinct(F.split(_part(F.col("key"), 1), " "))).alias("word"), "n", F.when(legal, F.col("n")).otherwise(0).alias("firm"))
    words = cut_lineage(split.groupBy("word").agg(F.sum("n").alias("n"), F.sum("firm").alias("firms")))
    total = spelled.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
    usual = words.where(F.col("n") > COMMON * (total + PRIOR)).collect()
    counted = words.mapInArrow(_gram_counts, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(GRAM_BUCKETS)
    counts[counted.column("bucket").to_numpy()] = counted.column("n").to_numpy()
    weights = np.round(64 * np.log1p(1 / np.maximum(counts / max(total, 1), RARE_GRAM)) ** 2)
    aliases = _aliases(cut_lineage(_meetings(spelled, [r.word for r in usual])))
    for short, full in (nicknames or {}).items():
        aliases[short] = tuple(dict.fromkeys([*aliases.get(short, ()), *full]))
    # A word that stands for one that stands for a third stands for the third.
    aliases = {w: tuple(dict.fromkeys(aliases.get(f, (f,))[0] if f != w else f for f in full)) for w, full in aliases.items()}
    return Lexicon(
        shares={r.word: r.n / (total + PRIOR) for r in usual},
        firms=frozenset(r.word for r in usual if r.firms >= FIRM * r.n),
        persons=frozenset(r.word for r in usual if r.firms <= PERSON * r.n),
        aliases=aliases,
        weights=weights.astype(np.int32),
        total=total,
    )


# ---- links between spellings


def _spread(lexicon, block: int):
    """Each spelling once for each bucket that holds one of its heaviest n-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for district, key, n in zip(*(batch.column(c).to_pylist() for c in ("district", "key", "n")), strict=True):
                own = vector(written_out(Name.of(key), lexicon.value))
                buckets = -(-8 * n // block)
                rows += [(district, key, b) for b in sorted({int(g) % buckets for g in heaviest(own, lexicon.value.weight(own))})]
            yield _rows(["district", "key", "bucket"], [pa.string(), pa.string(), pa.int32()], rows)

    return run


_LINK = T.StructType([_field("district", "s"), _field("a", "s"), _field("b", "s"), _field("similarity", "d")])


def _block(lexicon):
    def run(table: pa.Table) -> pa.Table:
        keys, own = table.column("key").to_pylist(), table.column("own").to_numpy()
        order = sorted(range(len(keys)), key=keys.__getitem__)  # in one order wherever a pair meets
        keys = [keys[k] for k in order]
        names = [written_out(Name.of(k), lexicon.value) for k in keys]
        across = table.column("i")[0].as_py() != table.column("j")[0].as_py()
        words, found = TwoWords(names, lexicon.value), []
        grams, name = words.vectors()
        kinds, own = np.array([n.kind for n in names]), own[order]
        for kind in "fp":  # a firm is never a person
            ours = (kinds == kind) | (kinds == "")
            at, held = np.flatnonzero(ours), ours[name]
            for i, j, s in _similar(grams[held], (np.cumsum(ours) - 1)[name[held]], len(at), lexicon.value, own[at] if across else None, COSINE, words.of(at)):
                i, j = at[i], at[j]
                new = (kind == "f") | (kinds[i] != "") | (kinds[j] != "")  # pairs of two unknown kinds come out with firms
                for a, b, x in zip(i[new].tolist(), j[new].tolist(), s[new].tolist(), strict=True):
                    if same_party(names[a], names[b], lexicon.value):
                        found.append((keys[a], keys[b], x))
        district = pa.array([table.column("district")[0].as_py()] * len(found), pa.string())
        return pa.table([district, *(pa.array([r[c] for r in found], t) for c, t in enumerate((pa.string(), pa.string(), pa.float64())))], names=_LINK.names)

    return run


def spelling_links(spelled: DataFrame, lexicon: Lexicon, block: int = BLOCK) -> DataFrame:
    """district, a, b (keys, a < b), similarity: every pair of a district's spellings with a cosine of COSINE that same_party accepts.

    ``spelled``: district and key, each once. A district of up to ``block`` spellings is one bucket; in others a spelling goes once into each
    bucket that holds one of its heaviest n-grams, as a partner must share one of them. Buckets of more than 2 * ``block`` are salted, and
    each pair of salts is a block of its own. How the spellings are cut decides which task compares a pair, never whether it is.
    """
    shared = spelled.sparkSession.sparkContext.broadcast(lexicon)
    # Comparing takes longer than its bytes suggest: tasks are cut by names, so that the longest doesn't grow with the table.
    tasks = min(max(spelled.sparkSession.sparkContext.defaultParallelism, lexicon.total // (4 * BLOCK)), 50_000)
    sizes = spelled.groupBy("district").agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("district", "_d")
    zero = lambda c: F.lit(0).alias(c)
    at = ["district", "bucket", "i", "j"]
    if (sizes.agg(F.max("n").alias("n")).first().n or 0) <= block:
        return spelled.select("district", "key", *map(zero, at[1:]), zero("own")).repartition(tasks, "district").groupBy("district").applyInArrow(_block(shared), _LINK).distinct()
    sized = spelled.join(sizes, F.col("district") == F.col("_d")).drop("_d")
    small = sized.where(F.col("n") <= block).select("district", "key", *map(zero, ("bucket", "own", "i", "j")))
    spread = sized.where(F.col("n") > block).mapInArrow(_spread(shared, block), T.StructType([_field("district", "s"), _field("key", "s"), _field("bucket", "i")]))
    filled = spread.groupBy(F.col("district").alias("_d"), F.col("bucket").alias("_b")).agg(F.count(F.lit(1)).alias("_m"))
    salts = F.when(F.col("_m") > 2 * block, F.ceil(F.col("_m") / block)).otherwise(1).cast("int")
    salted = spread.join(filled, (F.col("district") == F.col("_d")) & (F.col("bucket") == F.col("_b"))).withColumn("salts", salts).withColumn("own", F.pmod(F.xxhash64("key"), F.col("salts")).cast("int"))
    large = salted.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).select("district", "key", "bucket", "own", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
    return small.unionByName(large).repartition(tasks, *at).groupBy(*at).applyInArrow(_block(shared), _LINK).distinct()


# ---- groups


def components(edges: DataFrame) -> DataFrame:
    """node, part: connected parts of ``edges`` (u, v: bigint), each known by one of its nodes.

    Each round every node gives way to the neighbour, or itself, that comes first in an order drawn anew; the edges between those that
    are left go on. In expectation a fixed part of the nodes goes in each round, whatever the graph's shape.
    """
    edges = cut_lineage(edges.where("u <> v").select("u", "v").distinct())
    nodes = cut_lineage(edges.select(F.explode(F.array("u", "v")).alias("node")).distinct().withColumn("part", F.col("node")))
    turn = 0
    while not edges.isEmpty():
        turn += 1
        draw = lambda c: F.struct(F.xxhash64(c, F.lit(turn)).alias("h"), F.col(c).alias("x"))  # noqa: B023, E731
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        first = cut_lineage(both.groupBy("u").agg(F.min(draw("v")).alias("m")).select("u", F.least(draw("u"), F.col("m"))["x"].alias("to")))
        edges = edges.join(first.withColumnRenamed("to", "u2"), "u").join(first.select(F.col("u").alias("v"), F.col("to").alias("v2")), "v")
        edges = cut_lineage(edges.select(F.least("u2", "v2").alias("u"), F.greatest("u2", "v2").alias("v")).where("u <> v").distinct())
        nodes = cut_lineage(nodes.join(first.select(F.col("u").alias("part"), "to"), "part", "left").select("node", F.coalesce("to", "part").alias("part")))
    return nodes


_GROUPED = T.StructType([_field("node", "l"), _field("party", "l")])


def _grouped(table: pa.Table) -> pa.Table:
    a, b, s = (table.column(c).to_pylist() for c in ("a", "b", "similarity"))
    nodes = sorted({*a, *b})
    at = {x: i for i, x in enumerate(nodes)}
    links, one = {}, []
    for x, y, z in zip(a, b, s, strict=True):
        if z is None:
            one.append((at[x], at[y]))
        else:
            links[min(at[x], at[y]), max(at[x], at[y])] = z
    groups = group_spellings(len(nodes), links, one)
    many = np.bincount(groups, minlength=len(nodes)) if nodes else np.zeros(0, int)
    kept = [(x, nodes[g]) for x, g in zip(nodes, groups, strict=True) if many[g] > 1]
    return pa.table([pa.array([k[0] for k in kept], pa.int64()), pa.array([k[1] for k in kept], pa.int64())], names=_GROUPED.names)


def _node(key: str) -> Column:
    """A spelling's number: the hash of district and key."""
    return F.xxhash64("district", key)


def grouped_spellings(links: DataFrame, part: int = PART) -> DataFrame:
    """node, party of each spelling that shares its party with another; a party is known by one of its nodes.

    ``links``: district, a, b (nodes), similarity (null: spellings of one id). A district with more than ``part`` links is cut into its
    connected parts, so that no task holds it whole; groups never span such parts.
    """
    links = cut_lineage(links)
    counts = links.groupBy("district").agg(F.count(F.lit(1)).alias("n"))
    if counts.where(F.col("n") > part).isEmpty():
        return links.groupBy("district").applyInArrow(_grouped, _GROUPED)
    sized = links.join(counts.select(F.col("district").alias("_d"), "n"), F.col("district") == F.col("_d")).drop("_d")
    small = sized.where(F.col("n") <= part).groupBy("district").applyInArrow(_grouped, _GROUPED)
    cut = sized.where(F.col("n") > part)
    parts = components(cut.select(F.col("a").alias("u"), F.col("b").alias("v")))
    whole = cut.join(parts.withColumnRenamed("node", "a"), "a")
    return small.unionByName(whole.groupBy("district", "part").applyInArrow(_grouped, _GROUPED))


def party_members(df: DataFrame, id: str, name: str, district: str, nicknames: dict[str, list[str]] | None = None, block: int = BLOCK, part: int = PART) -> DataFrame:
    """district, id, party (a number) for every id that has a name; see link_parties."""
    rows = df.select(F.col(district).cast("string").alias("district"), F.upper(strip(F.col(id))).alias("id"), clean(F.col(name)).alias("name")).where("district is not null and id <> '' and name is not null").distinct()
    parsed = cut_lineage(rows.mapInArrow(_parsed, T.StructType([_field(c, "s") for c in ("district", "id", "key")])))
    spelled = cut_lineage(parsed.groupBy("district", "key").agg(F.count(F.lit(1)).alias("n")))
    links = spelling_links(spelled.select("district", "key"), learn(spelled, nicknames), block)
    links = links.select("district", _node("a").alias("a"), _node("b").alias("b"), "similarity")
    known = parsed.select("district", "id", _node("key").alias("node"))
    # Spellings of one id belong together: each of an id's spellings is tied to its smallest, by a join that no id's rows gather for.
    ends = known.groupBy("district", "id").agg(F.min("node").alias("a"), F.max("node").alias("z")).where("a <> z").select(F.col("district").alias("_d"), F.col("id").alias("_i"), "a")
    tied = known.join(ends, (F.col("district") == F.col("_d")) & (F.col("id") == F.col("_i")) & (F.col("node") != F.col("a"))).select("district", "a", F.col("node").alias("b"), F.lit(None).cast("double").alias("similarity")).distinct()
    groups = grouped_spellings(links.unionByName(tied), part).withColumnRenamed("node", "_n")
    return known.join(groups, F.col("node") == F.col("_n"), "left").select("district", "id", F.coalesce("party", "node").alias("party"))


def link_parties(df: DataFrame, id: str, name: str, district: str, nicknames: dict[str, list[str]] | None = None, block: int = BLOCK, part: int = PART) -> DataFrame:
    """district, id, party (the smallest id of the party in its district) for each id that shares a party with another id.

    Ids count stripped and in capitals; blank ids, names and null districts link nothing. Names that say the same are compared once, and ids
    follow their names: a spelling under very many ids costs no more than one under a single id. All spellings of an id mean one
    party. ``nicknames``: words and the words they are short for, in addition to what the table teaches.
    """
    own = party_members(df, id, name, district, nicknames, block, part)
    named = own.groupBy("district", "party").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first <> last").select(F.col("district").alias("_d"), F.col("party").alias("_p"), "first")
    return own.join(named, (F.col("district") == F.col("_d")) & (F.col("party") == F.col("_p"))).select("district", "id", F.col("first").alias("party")).distinct()


def party_pairs(groups: DataFrame) -> DataFrame:
    """customer_id_a, customer_id_b: each pair of different ids with one party, the smaller first. ``groups``: district, party, id."""
    a = groups.select("district", "party", F.col("id").alias("customer_id_a"))
    b = groups.select("district", "party", F.col("id").alias("customer_id_b"))
    return a.join(b, ["district", "party"]).where("customer_id_a < customer_id_b").select("customer_id_a", "customer_id_b").distinct()
