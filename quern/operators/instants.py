"""Timestamps typed in many forms, brought to one calendar date or one instant in UTC.

An ordered cascade of anchored forms with strict parsing; a time without zone or offset is local to its record's zone. A local
time that occurs twice means the earlier instant; one skipped by a clock change moves forward by the gap. All of it stays in the
JVM and doesn't depend on the session's zone.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.functions.coerce import MONTHS, month_number
from quern.functions.text import clean, let

# Abbreviations of zones as computers and people write them, with their offsets.
ABBREVIATIONS = {
    "Z": "+00:00", "UTC": "+00:00", "GMT": "+00:00", "WET": "+00:00", "WEST": "+01:00", "BST": "+01:00", "CET": "+01:00",
    "CEST": "+02:00", "EET": "+02:00", "EEST": "+03:00", "MSK": "+03:00", "SAST": "+02:00", "EAT": "+03:00", "CAT": "+02:00",
    "WAT": "+01:00", "PKT": "+05:00", "IST": "+05:30", "HKT": "+08:00", "SGT": "+08:00", "JST": "+09:00", "KST": "+09:00",
    "AWST": "+08:00", "ACST": "+09:30", "ACDT": "+10:30", "AEST": "+10:00", "AEDT": "+11:00", "NZST": "+12:00", "NZDT": "+13:00",
    "NST": "-03:30", "NDT": "-02:30", "AST": "-04:00", "ADT": "-03:00", "EST": "-05:00", "EDT": "-04:00", "CST": "-06:00",
    "CDT": "-05:00", "MST": "-07:00", "MDT": "-06:00", "PST": "-08:00", "PDT": "-07:00", "AKST": "-09:00", "AKDT": "-08:00",
    "HST": "-10:00",
}
#: Abbreviations that mean something else where the record's own zone uses them so.
LOCAL_ABBREVIATIONS = {
    ("IST", "Europe/Dublin"): "+01:00", ("IST", "Asia/Jerusalem"): "+02:00", ("CST", "Asia/Shanghai"): "+08:00", ("CST", "Asia/Taipei"): "+08:00",
    ("EST", "Australia/Sydney"): "+10:00", ("EST", "Australia/Melbourne"): "+10:00", ("EST", "Australia/Brisbane"): "+10:00", ("CST", "Australia/Adelaide"): "+09:30",
}

_MON = "(?:" + "|".join(f"{m[:3]}(?:{m[3:]})?" if m[3:] else m for m in MONTHS).replace("sep(?:tember)?", "sept?(?:ember)?") + ")"
_DAY = r"(?:(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?,?\s+)?"
_TIME = (
    r"(?:(?:T|\s*,\s*|\s+)(?<h>\d{1,2}):(?<mi>\d{2})(?::(?<s>\d{2})(?:[.,](?<f>\d{1,6})\d*)?)?(?:\s*(?<ap>[ap])\.?m\b\.?)?"
    r"\s*(?<z>[a-z]{1,5}|[+-]\d{2}(?::?\d{2})?|\[?[a-z]+(?:/[a-z_+-]+)+\]?)?)?"
)
#: Name, date part, and the rewritings to year-month-day in the order in which they are tried.
FORMS: list[tuple[str, str, list[str]]] = [
    ("ymd", r"(?<a>\d{4})-(?<b>\d{1,2})-(?<c>\d{1,2})", ["${a}-${b}-${c}"]),
    ("ymd_slash", r"(?<a>\d{4})/(?<b>\d{1,2})/(?<c>\d{1,2})", ["${a}-${b}-${c}"]),
    ("dmy", r"(?<a>\d{1,2})(?<q>[/.-])(?<b>\d{1,2})\k<q>(?<c>\d{4})", ["${c}-${b}-${a}", "${c}-${a}-${b}"]),
    ("d_month_y", rf"(?<a>\d{{1,2}})(?:st|nd|rd|th)?[ -]+(?<b>{_MON})[. ,-]+(?<c>\d{{4}})", ["${c}-${b}-${a}"]),
    ("month_d_y", rf"(?<b>{_MON})\.?[ -]+(?<a>\d{{1,2}})(?:st|nd|rd|th)?(?:,\s*|\s+|-)(?<c>\d{{4}})", ["${c}-${b}-${a}"]),
]
COMPACT = r"^(\d{4})(\d{2})(\d{2})$"
COMPACT_TIME = r"^(\d{4})(\d{2})(\d{2})T?(\d{2})(\d{2})(\d{2})$"
#: Twelve digits that can be a minute of these two centuries; as milliseconds they would all lie in 1976.
COMPACT_MINUTE = r"^((?:19|20)\d{2})(\d{2})(\d{2})([01]\d|2[0-3])([0-5]\d)$"
SERIAL = r"^\d{5}(?:\.\d+)?$"
#: Epoch numbers by their digits: units a second.
EPOCHS = {9: 1, 10: 1, 12: 1_000, 13: 1_000, 15: 1_000_000, 16: 1_000_000, 18: 1_000_000_000, 19: 1_000_000_000}


def known_zones(spark: SparkSession) -> list[str]:
    """Every zone name that the engine's clock rules know."""
    try:
        return sorted(z for z in spark._jvm.java.time.ZoneId.getAvailableZoneIds() if "/" in z)
    except AttributeError:  # no JVM beside this process
        import zoneinfo

        return sorted(z for z in zoneinfo.available_timezones() if "/" in z)


def normalise_instants(df: DataFrame, text: str, zone: str, into: str = "instant") -> DataFrame:
    """``df`` with the struct ``into``: norm (YYYY-MM-DD, or YYYY-MM-DDTHH:MM:SS.ffffffZ, or null) and form (that which matched).

    ``zone``: column with the IANA zone of the record, for times without one; may be null, and then such times are unreadable.
    Null, blank and unreadable texts give null, as do impossible dates, times, offsets and zones. Day before month unless that is
    impossible. Digits alone are read as YYYYMMDD, YYYYMMDDHHMM from 1900 to 2099, YYYYMMDDHHMMSS, a spreadsheet's day number (5
    digits) or seconds, milliseconds, microseconds or nanoseconds since 1970 (9 or 10, 12 or 13, 15 or 16, 18 or 19 digits: from 1973
    on); 12 digits are milliseconds where they are no such minute. Rows and other columns are kept.
    """
    zones = F.split(F.lit("|".join(known_zones(df.sparkSession))), "\\|")  # a constant, folded into one literal
    known = F.map_from_arrays(zones, zones)
    abbreviations = F.create_map(*[F.lit(y) for pair in ABBREVIATIONS.items() for y in pair])
    local_ones = F.create_map(*[F.lit(y) for (k, z), v in LOCAL_ABBREVIATIONS.items() for y in (f"{k} {z}", v)])

    def parts(x: Column) -> Column:
        """Form, date, other reading of the date, h, mi, s, f, ap, z as an array of texts; null if no form matches."""
        rewritten = []
        for name, date, orders in FORMS:
            full = rf"(?i)^{_DAY}{date}{_TIME}$"
            target = f"{name}|{orders[0]}|{orders[-1]}|${{h}}|${{mi}}|${{s}}|${{f}}|${{ap}}|${{z}}"
            rewritten.append((x.rlike(full), F.regexp_replace(x, full, target)))
        by_digits = [
            (x.rlike(COMPACT), F.regexp_replace(x, COMPACT, "compact|$1-$2-$3|$1-$2-$3||||||")),
            (x.rlike(COMPACT_TIME), F.regexp_replace(x, COMPACT_TIME, "compact|$1-$2-$3|$1-$2-$3|$4|$5|$6|||")),
            (x.rlike(COMPACT_MINUTE) & F.regexp_replace(x, COMPACT_MINUTE, "$1-$2-$3").try_cast("date").isNotNull(), F.regexp_replace(x, COMPACT_MINUTE, "compact|$1-$2-$3|$1-$2-$3|$4|$5||||")),
            (x.rlike(SERIAL), F.concat(F.lit("serial|"), x)),
            (x.rlike(r"^\d+$") & F.length(x).isin(list(EPOCHS)), F.concat(F.lit("epoch|"), x)),
        ]
        case = lambda pairs: reduce(lambda acc, w: F.when(*w) if acc is None else acc.when(*w), pairs, None)
        return F.split(F.when(x.rlike(r"^[\d.T]+$") & ~x.rlike(r"^\d+\.\d+\.\d+"), case(by_digits)).otherwise(case(rewritten)), "\\|", -1)

    def date(p: Column) -> Column:
        form, at = F.get(p, F.lit(0)), lambda i: F.get(p, F.lit(i))
        named = let(F.split(at(1), "-"), lambda v: F.concat_ws("-", F.get(v, F.lit(0)), month_number(F.get(v, F.lit(1))), F.get(v, F.lit(2))))
        return (
            F.when(form.isin("d_month_y", "month_d_y"), named.try_cast("date"))
            .when(form == "dmy", F.coalesce(at(1).try_cast("date"), at(2).try_cast("date")))
            .when(form == "serial", F.date_add(F.lit("1899-12-30").cast("date"), F.substring_index(at(1), ".", 1).cast("int")))
            .when(form != "epoch", at(1).try_cast("date"))
        )

    def local(p: Column, day: Column) -> Column:
        """The local time of day on ``day``; null if there is none or it doesn't exist."""
        at = lambda i: F.get(p, F.lit(i))
        h = at(3).try_cast("int")
        hour = F.when(at(7) == "", F.when(h < 24, h)).when((h >= 1) & (h <= 12), h % 12 + F.when(F.lower(at(7)) == "p", 12).otherwise(0))
        second = F.concat_ws(".", F.when(at(5) == "", "00").otherwise(at(5)), F.rpad(at(6), 6, "0"))
        typed = F.concat(day.cast("string"), F.lit(" "), F.lpad(hour.cast("string"), 2, "0"), F.lit(":"), at(4), F.lit(":"), second).try_cast("timestamp_ntz")
        share = F.round(F.concat(F.lit("0."), F.substring_index(at(1), ".", -1)).try_cast("double") * 86_400_000).cast("bigint")
        return F.when(at(0) == "serial", F.when(at(1).contains("."), F.timestamp_add("MILLISECOND", share, day.cast("timestamp_ntz")))).when(at(3) != "", typed)

    def zone_of(token: Column) -> Column:
        offset = F.when(token.rlike(r"^[+-]\d{2}$"), F.concat(token, F.lit(":00"))).otherwise(F.regexp_replace(token, r"^([+-]\d{2}):?(\d{2})$", "$1:$2"))
        valid = let(offset, lambda o: F.when(o.rlike(r"^[+-](?:(?:0\d|1[0-7]):[0-5]\d|18:00)$"), o))
        short = F.coalesce(F.try_element_at(local_ones, F.concat_ws(" ", F.upper(token), F.col(zone))), F.try_element_at(abbreviations, F.upper(token)))
        return F.when(token == "", F.try_element_at(known, F.col(zone))).when(token.rlike(r"^[+-]\d"), valid).when(token.contains("/"), F.try_element_at(known, token)).otherwise(short)

    def epoch(digits: Column) -> Column:
        """Whole numbers since 1970, added to a local time in UTC, which no session zone can shift."""
        start = F.lit("1970-01-01 00:00:00").cast("timestamp_ntz")
        n = digits.try_cast("bigint")
        sized = [F.when(F.length(digits) == k, n * (1_000_000 // v) if v <= 1_000_000 else F.substring(digits, 1, k - 3).try_cast("bigint")) for k, v in EPOCHS.items()]
        return F.timestamp_add("MICROSECOND", F.coalesce(*sized), start)

    def iso(instant: Column) -> Column:
        # Not date_format, which goes through the session's zone.
        return let(instant.cast("string"), lambda s: F.when(s.isNotNull(), F.concat(F.substring(s, 1, 10), F.lit("T"), F.substring(s, 12, 8), F.lit("."), F.rpad(F.substring(s, 21, 6), 6, "0"), F.lit("Z"))))

    def result(p: Column) -> Column:
        form, at = F.get(p, F.lit(0)), lambda i: F.get(p, F.lit(i))
        timed = F.when(form == "serial", at(1).contains(".")).otherwise(at(3) != "")
        token = F.when(form == "serial", "").otherwise(F.regexp_replace(at(8), r"[\[\]]", ""))
        utc = lambda day: let(local(p, day), lambda t: let(let(token, zone_of), lambda z: F.when(t.isNotNull() & z.isNotNull(), F.convert_timezone(z, F.lit("UTC"), t))))
        norm = F.when(form == "epoch", iso(epoch(at(1)))).otherwise(let(date(p), lambda day: F.when(timed, iso(utc(day))).otherwise(day.cast("string"))))
        return F.struct(norm.alias("norm"), form.alias("form"))

    read = let(let(clean(F.col(text)), parts), lambda p: F.when(p.isNotNull(), result(p)))
    return df.withColumn(into, read)
