"""Dates found in page text, written as ISO 8601.

The parts (date, time, offset) are cut out of the text by pattern, so words
around them do not matter.  A missing year, month or day is taken from
``as_of``; a missing time is midnight.  The offset is written only if the text
has one.  A text with two complete dates has none.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from .arrays import fixed_map, let

# Time-zone abbreviations and their offsets from UTC in minutes.
ZONE_MINUTES = {
    "UTC": 0,
    "EST": -300,
    "EDT": -240,
    "CST": -360,
    "CDT": -300,
    "MST": -420,
    "MDT": -360,
    "PST": -480,
    "PDT": -420,
    "GMT": 0,
    "BST": 60,
    "IST": 330,
    "CET": 60,
    "CEST": 120,
    "AEST": 600,
    "AEDT": 660,
    "ACST": 570,
    "ACDT": 630,
    "AWST": 480,
}

_MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
_WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]
_MONTH = (
    r"(jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?"
    r"|sept?(?:ember)?|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
_WEEKDAY = r"(mon(?:day)?|tue(?:s|sday)?|wed(?:nesday)?|thu(?:rs|r|rsday)?|fri(?:day)?|sat(?:urday)?|sun(?:day)?)"

_TIME = r"(?i)(?<![\d:])(\d{1,2}):(\d{2})(?::(\d{2})(?:[.,](\d{1,9}))?)?\s*(?:(a|p)\.?\s?m\b\.?)?"
_HOUR_ONLY = r"(?i)(?<![\d:.])(\d{1,2})\s*(a|p)\.?\s?m\b"
_ISO = r"(?<!\d)(\d{4})[-/.](\d{1,2})[-/.](\d{1,2})(?!\d)"
_COMPACT = r"(?<!\d)((?:19|20)\d{2})(0[1-9]|1[0-2])(0[1-9]|[12]\d|3[01])(?=\D|$|\d{4}(?:\d{2})?(?!\d))"
_COMPACT_TIME = r"(?<!\d)(?:19|20)\d{6}T?(\d{2})(\d{2})(\d{2})?(?!\d)"
_LETTER_TIME = r"(?i)(?<!\d)(\d{1,2})\s*h\s*(\d{1,2})\s*m(?:\s*(\d{1,2})\s*s)?\b"
_YEAR_FIRST = rf"(?i)(?<!\d)(\d{{4}})[\s\-/.]+{_MONTH}\b\.?[\s\-/.]+(\d{{1,2}})(?![\d:])"
_YEAR_MONTH = r"(?<![\d:.+\-/])((?:19|20)\d{2})-(0?[1-9]|1[0-2])(?![\d\-:.])"
#: A year on its own: not a part of a time, an offset or another date.
_YEAR = r"(?<![\d:.+\-/])((?:19|20)\d{2})(?![\d:/\-])"
_MONTH_FIRST = rf"(?i)\b{_MONTH}\b\.?\s*(0?[1-9]|[12]\d|3[01])(?:st|nd|rd|th)?\b(?!:)(?:\s*,?\s*'?(\d{{4}})(?![\d:]))?"
_DAY_FIRST = rf"(?i)(?<![\d:])(\d{{1,2}})(?:st|nd|rd|th)?(?:\s+of)?[\s\-]*{_MONTH}\b\.?(?:[\s,\-]*'?(\d{{4}}|\d{{2}}(?!:))(?![\d:]))?"
_MONTH_YEAR = rf"(?i)\b{_MONTH}\b\.?\s*,?\s*(\d{{4}})(?![\d:])"
_NUMERIC = r"(?<!\d)(\d{1,2})[/.\-](\d{1,2})[/.\-](\d{4}|\d{2})(?!\d)"
#: Complete dates, to see that a text has only one.
_COMPLETE = "(?i)" + "|".join(
    re.sub(r"\((?!\?)", "(?:", p).replace("(?i)", "")
    for p in (_ISO, _YEAR_FIRST, _DAY_FIRST, _MONTH_FIRST, _NUMERIC)
)
_SIGNED = r"\d:\d{2}(?::\d{2}(?:[.,]\d+)?)?\s*(?i:[ap]m)?\s*([+-])(\d{2}):?(\d{2})?"
_ZONE_HOURS = r"\b(?:GMT|UTC)\s*([+-])(\d{1,2})(?::?(\d{2}))?(?!\d)"
_ZULU = r"\d\s*Z\b"
_ZONE = r"\b(" + "|".join(sorted(ZONE_MINUTES, key=len, reverse=True)) + r")\b"


def _int(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, pattern, group).try_cast("int")


def _month(text: Column, pattern: str, group: int) -> Column:
    name = F.lower(F.substring(F.regexp_extract(text, pattern, group), 1, 3))
    numbers = fixed_map({m: i + 1 for i, m in enumerate(_MONTHS)}, "map<string,int>")
    return F.try_element_at(numbers, name)


def _full_year(y: Column, as_of: Column) -> Column:
    """Two digits mean the year within fifty years of ``as_of``."""
    base = F.year(as_of)
    guess = y + F.floor(base / 100).cast("int") * 100
    near = (
        F.when(guess >= base + 50, guess - 100).when(guess < base - 50, guess + 100).otherwise(guess)
    )
    return F.when(y < 100, near).otherwise(y)


def _ymd(y: Column, m: Column, d: Column) -> Column:
    return F.struct(y.alias("y"), m.alias("m"), d.alias("d"))


def _date(x: Column, as_of: Column) -> Column:
    """``struct<y, m, d>`` with nulls for what the text does not say; null if it says nothing."""
    none = F.lit(None).cast("int")

    def numeric() -> Column:
        a, b = _int(x, _NUMERIC, 1), _int(x, _NUMERIC, 2)
        y = _full_year(_int(x, _NUMERIC, 3), as_of)
        # month first, unless that is impossible
        return F.when(a > 12, _ymd(y, b, a)).otherwise(_ymd(y, a, b))

    return (
        F.when(x.rlike(_ISO), _ymd(_int(x, _ISO, 1), _int(x, _ISO, 2), _int(x, _ISO, 3)))
        .when(
            x.rlike(_YEAR_FIRST),
            _ymd(_int(x, _YEAR_FIRST, 1), _month(x, _YEAR_FIRST, 2), _int(x, _YEAR_FIRST, 3)),
        )
        .when(
            x.rlike(_DAY_FIRST),
            _ymd(
                F.coalesce(_full_year(_int(x, _DAY_FIRST, 3), as_of), _int(x, _YEAR, 1)),
                _month(x, _DAY_FIRST, 2),
                _int(x, _DAY_FIRST, 1),
            ),
        )
        .when(
            x.rlike(_MONTH_FIRST),
            _ymd(
                # a year may stand behind the time
                F.coalesce(_int(x, _MONTH_FIRST, 3), _int(x, _YEAR, 1)),
                _month(x, _MONTH_FIRST, 1),
                _int(x, _MONTH_FIRST, 2),
            ),
        )
        .when(
            x.rlike(_MONTH_YEAR), _ymd(_int(x, _MONTH_YEAR, 2), _month(x, _MONTH_YEAR, 1), none)
        )
        .when(x.rlike(_NUMERIC), numeric())
        .when(
            x.rlike(_COMPACT),
            _ymd(_int(x, _COMPACT, 1), _int(x, _COMPACT, 2), _int(x, _COMPACT, 3)),
        )
        .when(x.rlike(_YEAR_MONTH), _ymd(_int(x, _YEAR_MONTH, 1), _int(x, _YEAR_MONTH, 2), none))
        .when(x.rlike(_YEAR), _ymd(_int(x, _YEAR, 1), none, none))
    )


def _time(x: Column) -> Column:
    """``struct<h, mi, s, us>`` or null."""

    def clock(h: Column, half: Column) -> Column:
        half = F.lower(half)
        return F.when((half == "p") & (h < 12), h + 12).when((half == "a") & (h == 12), 0).otherwise(h)

    def parts(h: Column, mi: Column, s: Column, us: Column) -> Column:
        return F.struct(h.alias("h"), mi.alias("mi"), s.alias("s"), us.alias("us"))

    fraction = F.rpad(F.substring(F.regexp_extract(x, _TIME, 4), 1, 6), 6, "0").cast("int")
    zero = F.lit(0)

    def three(pattern: str) -> Column:
        return parts(_int(x, pattern, 1), _int(x, pattern, 2), F.coalesce(_int(x, pattern, 3), zero), zero)

    return F.when(
        x.rlike(_TIME),
        parts(
            clock(_int(x, _TIME, 1), F.regexp_extract(x, _TIME, 5)),
            _int(x, _TIME, 2),
            F.coalesce(_int(x, _TIME, 3), zero),
            fraction,
        ),
    ).when(
        x.rlike(_HOUR_ONLY),
        parts(clock(_int(x, _HOUR_ONLY, 1), F.regexp_extract(x, _HOUR_ONLY, 2)), zero, zero, zero),
    ).when(x.rlike(_COMPACT_TIME), three(_COMPACT_TIME)).when(x.rlike(_LETTER_TIME), three(_LETTER_TIME))


def _offset_minutes(x: Column) -> Column:
    """Offset from UTC, or null.  ``GMT+2`` reads 'my time plus 2 is GMT', hence -02:00."""

    def signed(pattern: str) -> Column:
        minutes = _int(x, pattern, 2) * 60 + F.coalesce(_int(x, pattern, 3), F.lit(0))
        return F.when(F.regexp_extract(x, pattern, 1) == "-", -minutes).otherwise(minutes)

    named = fixed_map(ZONE_MINUTES, "map<string,int>")
    return (
        F.when(x.rlike(_ZONE_HOURS), -signed(_ZONE_HOURS))
        .when(x.rlike(_SIGNED), signed(_SIGNED))
        .when(x.rlike(_ZONE), F.try_element_at(named, F.regexp_extract(x, _ZONE, 1)))
        .when(x.rlike(_ZULU), F.lit(0))
    )


def _offset_text(minutes: Column) -> Column:
    size = F.abs(minutes)
    sign = F.when(minutes < 0, F.lit("-")).otherwise(F.lit("+"))
    text = F.concat(sign, F.format_string("%02d:%02d", F.floor(size / 60), size % 60))
    return F.when(minutes.isNotNull(), text)


def _weekday_shift(x: Column, day: Column) -> Column:
    """A weekday without a date means the next such day, counted from ``day``."""
    word = F.lower(F.substring(F.regexp_extract(x, rf"(?i)\b{_WEEKDAY}\b", 1), 1, 3))
    numbers = fixed_map({w: i for i, w in enumerate(_WEEKDAYS)}, "map<string,int>")
    ahead = F.pmod(F.try_element_at(numbers, word) - F.weekday(day), F.lit(7))
    return F.when(ahead.isNotNull(), F.date_add(day, ahead))


def parse_date(text: Column, as_of: Column) -> Column:
    """A date in free text as an ISO string; null if there is none."""

    def build(p: Column) -> Column:
        d, t, off, x = p["d"], p["t"], p["off"], p["x"]
        today = F.to_date(as_of)
        has_weekday = x.rlike(rf"(?i)\b{_WEEKDAY}\b")
        year = F.coalesce(d["y"], F.year(today))
        month = F.coalesce(d["m"], F.month(today))
        # a day taken from as_of must exist in the month that was given
        month_end = F.day(F.last_day(F.try_make_timestamp(year, month, F.lit(1), F.lit(0), F.lit(0), F.lit(0)).cast("date")))
        day = F.coalesce(d["d"], F.least(F.day(today), month_end))
        given = F.format_string("%04d-%02d-%02d", year, month, day)
        date = F.when(
            d.isNull() & has_weekday, F.date_format(_weekday_shift(x, today), "yyyy-MM-dd")
        ).otherwise(given)
        clock = F.format_string(
            "T%02d:%02d:%02d",
            F.coalesce(t["h"], F.lit(0)),
            F.coalesce(t["mi"], F.lit(0)),
            F.coalesce(t["s"], F.lit(0)),
        )
        us = F.when(t["us"] > 0, F.format_string(".%06d", t["us"])).otherwise(F.lit(""))
        offset = F.coalesce(_offset_text(off), F.lit(""))
        real = (
            date.try_cast("date").isNotNull()
            & (F.coalesce(t["h"], F.lit(0)) < 24)
            & (F.coalesce(t["mi"], F.lit(0)) < 60)
            & (F.coalesce(t["s"], F.lit(0)) < 60)
        )
        one = F.regexp_count(x, F.lit(_COMPLETE)) < 2
        real = real & one
        says_something = d.isNotNull() | t.isNotNull() | has_weekday
        return F.when(says_something & real, F.concat(date, clock, us, offset))

    return let(
        text,
        lambda x: let(
            F.struct(
                x.alias("x"),
                _date(x, as_of).alias("d"),
                _time(x).alias("t"),
                _offset_minutes(x).alias("off"),
            ),
            build,
        ),
    )


def epoch_iso(text: Column) -> Column:
    """Epoch seconds, or milliseconds, as a naive ISO string in the session time zone."""
    seconds = F.substring(text, 1, 10).try_cast("bigint")
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss")


def iso_date(text: Column, as_of: Column | None = None) -> Column:
    """Epoch digits or a date in free text as ISO 8601."""
    now = F.current_timestamp() if as_of is None else as_of
    is_epoch = text.rlike(r"^\d+$") & F.length(text).isin(10, 13)
    return F.when(is_epoch, epoch_iso(text)).otherwise(parse_date(text, now))
