"""Reading moments from text as column expressions: no UDF, one regular expression per form."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Zone abbreviations and minutes east of UTC, by what a publisher's country means
# by them. "" holds those with one usual meaning everywhere.
ABBREVIATIONS = {
    "": {"UTC": 0, "GMT": 0, "Z": 0, "UT": 0, "CET": 60, "CEST": 120, "MEZ": 60, "MESZ": 120, "WET": 0, "WEST": 60, "EET": 120, "EEST": 180, "MSK": 180, "JST": 540, "KST": 540, "HKT": 480, "SGT": 480, "NZST": 720, "NZDT": 780, "AEST": 600, "AEDT": 660, "ACST": 570, "ACDT": 630, "AWST": 480, "BRT": -180, "BRST": -120, "EDT": -240, "CDT": -300, "MDT": -360, "PDT": -420, "AKST": -540, "AKDT": -480, "HST": -600, "NST": -210, "NDT": -150, "ADT": -180, "SAST": 120, "PKT": 300, "EST": -300, "CST": -360, "MST": -420, "PST": -480, "BST": 60, "IST": 330, "AST": -240},
    "Ireland": {"IST": 60, "BST": 60},
    "Israel": {"IST": 120, "IDT": 180},
    "China": {"CST": 480},
    "Taiwan": {"CST": 480},
    "Australia": {"EST": 600, "EDT": 660, "CST": 570, "CDT": 630, "WST": 480},
    "Bangladesh": {"BST": 360},
    "Philippines": {"PST": 480},
    "Malaysia": {"MST": 480},
}
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]

_TIME = r"(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?(?:\s?([AaPp])\.?\s?[Mm](?![A-Za-z])\.?)?"
_ZONE = r"\s?\[?([A-Za-z][A-Za-z_]*(?:/[A-Za-z_+\-0-9]+)+|[A-Za-z]{1,5}|(?:GMT|UTC|gmt|utc)?\s?[+\-−]\d{1,2}(?::?\d{2})?)?\]?(?:\s?\([A-Za-z ]+\))?$"
_MONTH = r"([A-Za-z]{3,9})\.?"
_DAY_NAME = r"(?:[A-Za-z]{3,9}\.?,? )?"
_AT = r"(?:,? at|,)? "
# form -> (pattern, replacement giving year|month|day|hour|minute|second|fraction|am or pm|zone)
_FORMS = {
    "iso": (r"^(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?:[Tt]|,? )" + _TIME + _ZONE, "$1|$2|$3|$4|$5|$6|$7|$8|$9"),
    "day_month": ("^" + _DAY_NAME + r"(\d{1,2})(?:st|nd|rd|th)?\.? " + _MONTH + r",? (\d{4})" + _AT + _TIME + _ZONE, "$3|$2|$1|$4|$5|$6|$7|$8|$9"),
    "month_day": ("^" + _DAY_NAME + _MONTH + r" (\d{1,2})(?:st|nd|rd|th)?,? (\d{4})" + _AT + _TIME + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "numeric": (r"^(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4})" + _AT + _TIME + _ZONE, "$3|$1|$2|$4|$5|$6|$7|$8|$9"),
    "compact": (r"^(\d{4})(\d{2})(\d{2})[Tt ]?(\d{2})(\d{2})(\d{2})?(?:[.,](\d{1,9}))?[Zz]?$", "$1|$2|$3|$4|$5|$6|$7||Z"),
}


def squeeze(text: Column) -> Column:
    """White space of any kind, control and invisible characters at the ends dropped, inner runs one space."""
    return F.trim(F.regexp_replace(text, r"[\s\p{Z}\p{C}]+", " "))


def moment_parts(text: Column) -> Column:
    """struct(form, p) of a squeezed text: p is the nine parts as strings, or epoch digits; form is
    null where the text has none of the known shapes (then it gives no moment)."""
    t = text
    nothing = F.lit(None).cast("struct<form:string,p:array<string>>")
    out = nothing
    for form, (pattern, parts) in reversed(_FORMS.items()):
        out = F.when(t.rlike(pattern), F.struct(F.lit(form).alias("form"), F.split(F.regexp_replace(t, pattern, parts), r"\|").alias("p"))).otherwise(out)
    epoch = F.struct(F.lit("epoch").alias("form"), F.array(t).alias("p"))
    return F.when(t.rlike(r"^(\d{10}|\d{13})$"), epoch).otherwise(out)


def _days(y: Column, m: Column, d: Column) -> Column:
    """Days since 1970-01-01 of a proleptic Gregorian date (integer arithmetic, never an error)."""
    yy = F.when(m <= 2, y - 1).otherwise(y)
    mm = F.when(m <= 2, m + 9).otherwise(m - 3)
    whole = 365 * yy + F.floor(yy / 4) - F.floor(yy / 100) + F.floor(yy / 400)
    return (whole + F.floor((153 * mm + 2) / 5) + d - 1 - 719468).cast("long")


def _days_in_month(y: Column, m: Column) -> Column:
    leap = ((y % 4 == 0) & (y % 100 != 0)) | (y % 400 == 0)
    return F.when(m == 2, F.when(leap, 29).otherwise(28)).when(m.isin(4, 6, 9, 11), 30).otherwise(31)


def wall_clock(parts: Column, date_order: Column) -> Column:
    """struct(wall bigint, zone string): microseconds of the written date and time as if it were
    UTC, and the written zone ('' for none). Null wall: an impossible date or time. For epoch digits
    wall is the moment and the zone is Z."""
    p = parts["p"]

    def at(i: int) -> Column:
        return F.get(p, F.lit(i))

    def num(c: Column) -> Column:
        return F.coalesce(c.try_cast("int"), F.lit(0))

    form = parts["form"]
    first, second = at(1), at(2)
    swap = (form == "numeric") & (F.lower(F.coalesce(date_order, F.lit("dmy"))) != "mdy")
    month_text = F.when(swap, second).otherwise(first)
    day_text = F.when(swap, first).otherwise(second)
    named = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.substring(month_text, 1, 3))).cast("int")
    full = "^(jan(uary)?|feb(ruary)?|mar(ch)?|apr(il)?|may|june?|july?|aug(ust)?|sept?(ember)?|oct(ober)?|nov(ember)?|dec(ember)?)$"
    month = F.when(form.isin("day_month", "month_day"), F.when(F.lower(month_text).rlike(full), named).otherwise(0)).otherwise(num(month_text))
    y, d, h, mi, s = num(at(0)), num(day_text), num(at(3)), num(at(4)), num(at(5))
    half = F.lower(F.coalesce(at(7), F.lit("")))
    hour = F.when(half == "", h).when(half == "a", h % 12).otherwise(h % 12 + 12)
    fits = (month >= 1) & (month <= 12) & (d >= 1) & (d <= _days_in_month(y, month)) & (hour <= 23) & (mi <= 59) & (s <= 59) & ((half == "") | ((h >= 1) & (h <= 12)))
    micros = F.rpad(F.substring(F.coalesce(at(6), F.lit("")), 1, 6), 6, "0").try_cast("int")
    wall = ((_days(y, month, d) * 24 + hour) * 60 + mi) * 60_000_000 + s * 1_000_000 + F.coalesce(micros, F.lit(0))
    digits = at(0).try_cast("long")
    epoch = F.when(F.length(at(0)) == 13, digits * 1000).otherwise(digits * 1_000_000)
    return F.struct(
        F.when(form == "epoch", epoch).when(form.isNotNull() & fits, wall).cast("long").alias("wall"),
        F.when(form == "epoch", F.lit("Z")).otherwise(F.coalesce(at(8), F.lit(""))).alias("zone"),
    )


def _abbreviation_minutes(zone: Column, country: Column) -> Column:
    z = F.upper(zone)
    maps = {c: F.create_map(*[F.lit(x) for kv in m.items() for x in kv]) for c, m in ABBREVIATIONS.items()}
    out = F.try_element_at(maps[""], z)
    for c, m in maps.items():
        if c:
            out = F.when((country == c) & F.try_element_at(m, z).isNotNull(), F.try_element_at(m, z)).otherwise(out)
    return out


def zone_offset_minutes(zone: Column, country: Column) -> Column:
    """Minutes east of UTC that a written zone fixes; null for an IANA name, none or an unknown zone."""
    bare = F.regexp_replace(F.regexp_replace(zone, r"^(?i:GMT|UTC)(?=\s?[+\-−])", ""), "−", "-")
    sign = F.when(bare.startswith("-"), -1).otherwise(1)
    digits = F.regexp_replace(bare, r"[^\d]", "")
    hh = F.when(F.length(digits) <= 2, digits).otherwise(F.substring(digits, F.lit(1), F.length(digits) - 2))
    mm = F.when(F.length(digits) <= 2, F.lit("0")).otherwise(F.substring(digits, F.length(digits) - 1, F.lit(2)))
    minutes = hh.try_cast("int") * 60 + mm.try_cast("int")
    numeric = F.when((minutes <= 14 * 60) & (mm.try_cast("int") <= 59), sign * minutes)
    return F.when(bare.rlike(r"^\s?[+\-]"), numeric).otherwise(_abbreviation_minutes(zone, country))


def wall_to_utc(wall: Column, tz: Column) -> Column:
    """UTC microseconds of a wall time at an IANA zone; null where a clock change skips the time or
    makes it happen twice."""
    local = F.timestamp_micros(wall)
    utc = F.to_utc_timestamp(local, tz)
    exact = F.unix_micros(F.from_utc_timestamp(utc, tz)) == wall
    twice = F.lit(False)
    for minutes in (-120, -60, -30, 30, 60, 120):
        other = F.timestamp_micros(F.unix_micros(utc) + minutes * 60_000_000)
        twice = twice | (F.unix_micros(F.from_utc_timestamp(other, tz)) == wall)
    return F.when(exact & ~twice, F.unix_micros(utc))
