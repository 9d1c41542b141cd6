"""Text that was decoded with a wrong character encoding: found, and restored where it can be.

Characters are mapped back to the bytes they have in a legacy encoding; an automaton over those bytes finds maximal spans that are
well-formed multibyte UTF-8, and only those spans are decoded. A second kind of damage, legacy bytes read by another legacy
encoding, has no byte structure and is told by its letters (see _relettered). Lost characters (U+FFFD) are found, not restored.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Legacy encodings through which UTF-8 bytes may have been read, in the order in which they are tried.
ENCODINGS = ["cp1252", "latin-1", "cp1250", "cp1251", "mac_roman", "cp437", "cp850", "iso8859_2", "cp1254", "cp866", "koi8_r", "iso8859_15"]
_LOST = "�"


@lru_cache(maxsize=None)
def _table(encoding: str) -> dict[int, int]:
    """Code point to byte, as a table for str.translate; bytes that the encoding leaves undefined are controls of the same number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            c = bytes([b]).decode(encoding)
        except UnicodeDecodeError:
            c = chr(b)
        out[ord(c)] = b
    return out


def _characters(encoding: str, low: int, high: int) -> str:
    """A class of the characters that stand for the bytes from ``low`` to ``high``."""
    return "[" + "".join(re.escape(chr(c)) for c, b in _table(encoding).items() if low <= b <= high) + "]"


@lru_cache(maxsize=None)
def _automaton(encoding: str) -> re.Pattern[str]:
    """The automaton of well-formed multibyte UTF-8, over characters in place of the bytes that an encoding reads as them."""
    c = lambda low, high=None: _characters(encoding, low, low if high is None else high)
    more = c(0x80, 0xBF)
    sequences = [
        c(0xC2, 0xDF) + more, c(0xE0) + c(0xA0, 0xBF) + more, f"(?:{c(0xE1, 0xEC)}|{c(0xEE, 0xEF)}){more}{{2}}", c(0xED) + c(0x80, 0x9F) + more,
        c(0xF0) + c(0x90, 0xBF) + more + "{2}", c(0xF1, 0xF3) + more + "{3}", c(0xF4) + c(0x80, 0x8F) + more + "{2}",
    ]
    return re.compile("(?:" + "|".join(sequences) + ")+")


#: A sequence is two characters at least, none of them ASCII: without such neighbours there is no span.
_NEIGHBOURS = re.compile("[^\x00-\x7f]{2}")
#: Characters a span must restore to be damage by its length alone: so many well-formed sequences don't meet by chance.
LONG = 3
# Scripts that stand beside one another in one language's text, by the first word of their characters' names.
_TOGETHER = {"HIRAGANA": "CJK", "KATAKANA": "CJK", "KATAKANA-HIRAGANA": "CJK", "IDEOGRAPHIC": "CJK"}
_QUOTES = "\"'“”„«»‘’‹›`"


def _mention(text: str, a: int, b: int, restored: str) -> bool:
    """Whether a span is spoken of rather than damage: a lone sign in quotation marks, or a mark that never stands alone."""
    before, after = text[a - 1 : a], text[b : b + 1]
    if len(restored) != 1:
        return False
    if before and after and before in _QUOTES and after in _QUOTES:
        return True
    alone = (not before or before.isspace()) and (not after or after.isspace() or after in ".,;:!?)")
    return alone and restored in "’‘﻿" and bool(before) and bool(after)


_COMMON = regex.compile(r"[\p{Script=Common}\p{Script=Inherited}]")


@lru_cache(maxsize=1 << 16)
def _script(c: str) -> str:
    """Script of a character, by its Unicode name; empty for what all scripts share, a question mark for what isn't assigned."""
    if c < "\u0180" and c.isalpha():
        return "LATIN"
    if unicodedata.category(c) in ("Cn", "Co", "Cs"):
        return "?"
    if _COMMON.match(c):
        return ""
    name = unicodedata.name(c, "?").split(" ")[0]
    return _TOGETHER.get(name, name)


@lru_cache(maxsize=1 << 16)
def _accented(c: str) -> bool:
    """Whether a letter is a Latin one with a mark, or of the Latin letters without that European languages add, or stands in the most
    frequent legacy encoding: text garbled twice holds those."""
    return ord(c) < 0x180 or ord(c) in _table("cp1252") or unicodedata.normalize("NFKD", c)[0].isascii()


def _scripts(restored: str) -> set[str]:
    return {x for c in restored if (x := _script(c))}


def _believable(text: str, a: int, b: int, restored: str, encoding: str, known: set[str]) -> bool:
    """Whether a well-formed span is damage rather than chance: real text has such neighbours now and then.

    A span of LONG characters of one script is; a shorter one if it gives signs, Latin letters with marks, or letters of a script of
    which the text holds a long span too (``known``), whatever script that is.
    """
    scripts = _scripts(restored)
    if "?" in scripts:
        return False
    span = text[a:b]
    if len(restored) < LONG or len(scripts - {"LATIN"}) > 1:
        if unicodedata.category(restored[0])[0] == "M" and not text[a - 1 : a].isalpha() and restored[0] != "\ufe0f":
            return False  # a mark on nothing
        if not scripts <= known | {"LATIN"} or not all(_accented(c) for c in restored if _script(c) == "LATIN"):
            return False
    if "CJK" in scripts and span.isalpha() and encoding not in ("latin-1", "cp1252"):
        return False
    if encoding == "cp850" and span.isalpha():
        return len(restored) > 3
    if encoding in ("cp1251", "koi8_r", "cp866", "iso8859_5"):
        if span.isalpha():
            # Words of a Cyrillic text: only letters that such words don't hold make damage likely.
            return encoding == "cp1251" and (len(restored) > 1 or span[1] not in "Ёё")
        # A capital before a closing sign, as in «РФ», is how real text comes to hold a sequence of two.
        if len(restored) == 1 and len(span) == 2 and span[0].isalpha() and span[1] in "»”“’…–—•°§©®™€·":
            return any(c.isalpha() and c.isascii() for c in text[max(0, a - 1) : a] + text[b : b + 1])
    return True


def _spans(text: str, encoding: str) -> list[tuple[int, int, str]]:
    table = _table(encoding)
    met = [(m.start(), m.end(), bytes(table[ord(c)] for c in m[0]).decode("utf-8")) for m in _automaton(encoding).finditer(text)]
    known = {"CYRILLIC", "GREEK"} if encoding in ("latin-1", "cp1252") else set()
    for _, _, restored in met:
        if len(restored) >= LONG and len(x := _scripts(restored)) == 1:
            known |= x
    return [x for x in met if _believable(text, *x, encoding, known)]


def _once(text: str) -> tuple[str, int]:
    """``text`` with the spans of the encoding that explains most of it decoded, and their number; mentions stay."""
    best: tuple[int, list, str] = (0, [], "")
    if not _NEIGHBOURS.search(text):
        return text, 0
    for e in ENCODINGS:
        spans = [s for s in _spans(text, e) if not _mention(text, *s)]
        gain = sum(b - a for a, b, _ in spans)
        if gain > best[0]:
            best = (gain, spans, e)
    out, end = [], 0
    for a, b, restored in best[1]:
        out += [text[end:a], restored]
        end = b
    return "".join([*out, text[end:]]), len(best[1])


#: Single-byte encodings that are taken for one another: the one read, the one meant. The order decides where several would do.
CONFUSED = [
    ("mac_roman", "cp1252"), ("cp1252", "cp1251"), ("cp1251", "koi8_r"), ("koi8_r", "cp1251"), ("cp1252", "cp1250"), ("latin-1", "cp1250"),
    ("latin-1", "iso8859_2"), ("cp1252", "koi8_r"), ("cp1252", "mac_roman"), ("cp437", "cp1252"), ("cp850", "cp1252"), ("cp1252", "cp437"),
    ("cp1252", "cp850"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("latin-1", "cp1252"), ("cp1251", "cp1252"), ("cp1250", "cp1252"),
    ("mac_cyrillic", "cp1251"), ("cp1251", "mac_cyrillic"), ("iso8859_5", "cp1251"), ("cp1251", "iso8859_5"),
]
# Letters of the languages that the operator knows as natural inside words.
_LETTERS = "àâæçéèêëîïôœùûüÿäöüßáéíñóúãõąćęłńóśźżøåðþýščžřěůťďňľĺŕăâîșțşğığőű"
_UPPER = _LETTERS.upper().replace("SS", "ẞ")
_KNOWN = _LETTERS + _UPPER
_LATIN = "[a-zA-Z" + _KNOWN + "]"
_LOWER = "[a-z" + _LETTERS + "]"
_CYRILLIC = "\u0410-\u044f\u0401\u0451"
_SIGNS = "\xa1-\xa9\xab-\xac\xae-\xb1\xb4-\xb9\xbb-\xbf\u02d9\u02dd\u02c7\u02db\u2021\u2020\u2030\u221e\u222b\u2202\u220f\u2211\u25ca\u2248\u2265\u2264\u2260\u2320-\u2321\u2500-\u25a0"
#: Places that real text doesn't have: controls, signs or foreign letters inside a word, capitals after small letters, long runs of
#: letters with marks, lone letters that are no word.
_ODD = re.compile(
    "[\x80-\x9f]"
    f"|(?<={_LATIN})[{_SIGNS}\xaa\xba\u201a\u201e\u0192\u02c6\u02dc](?={_LATIN})"
    f"|(?<=[a-z])[{_SIGNS}\u201a\u2021]+(?=[a-z])"
    f"|(?<=[a-z{_LETTERS}])[{_UPPER}]"
    f"|(?<=[{_CYRILLIC}])[{_SIGNS}](?=[{_CYRILLIC}])"
    "|(?<=[\u0430-\u044f])[\u0410-\u042f]"
    f"|[{_KNOWN}\xd7\xf7]{{4,}}"
    "|[\u0402\u0403\u0409\u040a\u040b\u040c\u040e\u040f\u0452\u0453\u0459-\u045f\u0405\u0408\u0455\u0458]"
    "|[\xec\xf2\xcc\xd2](?=[A-Za-z_0-9])"
    "|(?<=[a-z])[\xb3\xb9]+(?=[a-z])|(?<=[a-z]{3})[\xb3\xb9](?![\\w\xb2\xb3])"
    "|\xc4(?=[0-9])"
    f"|(?<![\\w’'])[ñíìîêëûÛïõãåßþðýÿø](?!\\w)"
    f"|(?<=[a-z])[\u0410-\u044f](?=[a-z])"
    "|(?:^|(?<=\\s))[\xb4\xaa\xba\u0160\u0161\u0152\u2021](?=\\s)"
    f"|(?<={_LOWER})[\xaa\xba\u2021\xb7\u02d9](?={_LOWER}|\\s|$)"
)
_SEGMENT = re.compile(r"[^\n.!?]+[\n.!?]*|[\n.!?]+")


@lru_cache(maxsize=None)
def _pairs() -> list[dict[int, str]]:
    """For each confusion, from the characters seen to those meant."""
    out = []
    for seen, meant in CONFUSED:
        table = {}
        for c, b in _table(seen).items():
            try:
                table[c] = bytes([b]).decode(meant)
            except UnicodeDecodeError:
                pass
        out.append(table)
    return out


def _odd(text: str) -> int:
    return sum(len(m[0]) for m in _ODD.finditer(text))


_STRANGE = re.compile("[^\x00-\x7f]+")


def _any_odd(text: str) -> bool:
    """Whether there is an odd place. Each begins at a character that isn't ASCII and looks one further at most."""
    return any(_ODD.search(text, m.start(), m.end() + 2) for m in _STRANGE.finditer(text))


def relettered(text: str) -> tuple[str, int]:
    """``text`` with the segments that read as if one legacy encoding was taken for another put right, and their number.

    A segment is put right if it has odd places and one confusion removes three quarters of them or more; the confusion is that
    which leaves the fewest in all odd segments together. Segments that speak of garbled signs are left alone.
    """
    if not _any_odd(text):
        return text, 0
    segments = [m[0] for m in _SEGMENT.finditer(text)]
    odd = {i: n for i, x in enumerate(segments) if not x.isascii() and (n := _odd(x)) and not any(_mention(x, *s) for e in ENCODINGS[:2] for s in _spans(x, e))}
    best: tuple[int, dict[int, str]] = (0, {})
    for table in _pairs():
        fixed, gain = {}, 0
        for i, n in odd.items():
            if all(c < "\x80" or ord(c) in table for c in segments[i]):
                new = segments[i].translate(table)
                left = _odd(new)
                if left * 4 <= n:
                    fixed[i] = new
                    gain += n - left
        if gain > best[0]:
            best = (gain, fixed)
    for i, new in best[1].items():
        segments[i] = new
    return "".join(segments), len(best[1])


#: The second byte of a garbled à is a no-break space, which programs that tidy white space turn into a plain one.
_TIDIED = re.compile("(?<=[a-z\xe0-\xff])\xc3 |(?<= )\xc3  ")


class Restored(NamedTuple):
    """text; spans: places decoded by the automaton; relettered: segments put right by their letters; lost: characters lost for good."""

    text: str | None
    spans: int = 0
    relettered: int = 0
    lost: int = 0


def restore(text: str | None) -> Restored:
    """The restored text and what was done to it.

    Null and empty texts come back as they are. Text that only speaks of garbled signs is left alone. Text garbled several times is
    decoded as often: each round makes it shorter, so there is a last one.
    """
    if not text or text.isascii():
        return Restored(text)
    spans = 0
    while True:
        text, n = _once(text)
        if not n:
            break
        spans += n
    text, tidied = _TIDIED.subn(lambda m: "à" + m[0][2:], text)
    text, n = relettered(text)
    lost = sum(1 for m in re.finditer(_LOST, text) if not _mention(text, m.start(), m.end(), _LOST))
    return Restored(text, spans, n + tidied, lost)


def _restore_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [restore(x) for x in batch.column("_text").to_pylist()]
        keys = [(n, c) for n, c in zip(batch.schema.names, batch.columns, strict=True) if n != "_text"]
        columns = [pa.array([r[i] for r in rows], f) for i, f in enumerate((pa.string(), pa.int32(), pa.int32(), pa.int32()))]
        yield pa.RecordBatch.from_arrays([*(c for _, c in keys), *columns], names=[*(n for n, _ in keys), "restored", "spans", "relettered", "lost"])


def restore_texts(df: DataFrame, text: str, keep: list[str]) -> DataFrame:
    """``keep`` with restored (text), spans, relettered (see Restored) and lost (characters that can't be restored).

    Every row comes back, whatever its text; no rows are exchanged. A text is garbled if one of the three numbers isn't 0.
    """
    src = df.select(*keep, F.col(text).cast("string").alias("_text"))
    extra = [T.StructField("restored", T.StringType()), *(T.StructField(c, T.IntegerType()) for c in ("spans", "relettered", "lost"))]
    return src.mapInArrow(_restore_batches, T.StructType([*(f for f in src.schema.fields if f.name != "_text"), *extra]))
