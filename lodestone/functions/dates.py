"""Dates in text: month-day-year order, US Eastern time, missing day = first, missing month = last."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import as_col, let, normalize_ws

# Fixed values
ZONE = "America/New_York"
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
MONTH = (
    "(?:jan(?:uary)?|feb(?:ruary)?|mar(?:ch)?|apr(?:il)?|may|june?|july?|aug(?:ust)?|sept?(?:ember)?"
    "|oct(?:ober)?|nov(?:ember)?|dec(?:ember)?)"
)
WEEKDAY = "(?:mon|tues?|wed(?:nes)?|thu(?:rs)?|fri|sat(?:ur)?|sun)(?:day)?"
UNITS = ["second", "minute", "hour", "day", "week", "month", "year"]
UNIT = "(?:" + "|".join(UNITS) + ")"

TIME = r"(\d{1,2}):(\d{2})(?::(\d{2}))?(?:\.\d+)?(?: ?([ap])\.?m\.?)?"
SEARCH = (
    rf"(?i)(?<![\p{{L}}\p{{N}}/.-])(?:{MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?,? \d{{4}}"
    rf"|\d{{1,2}}(?:st|nd|rd|th)? (?:of )?{MONTH}\.?,? \d{{4}}"
    rf"|{MONTH}\.? \d{{4}}"
    rf"|{MONTH}\.? \d{{1,2}}(?:st|nd|rd|th)?"
    rf"|\d{{1,2}}(?:st|nd|rd|th)? (?:of )?{MONTH}"
    r"|\d{4}-\d{1,2}-\d{1,2}"
    r"|\d{1,2}/\d{1,2}/(?:\d{4}|\d{2})"
    rf"|\d+ {UNIT}s? ago|in \d+ {UNIT}s?"
    r"|yesterday|today|tomorrow)(?![\p{L}\p{N}/])"
)


def _int(c: Column) -> Column:
    return F.nullif(c, F.lit("")).try_cast("int")


def _month(c: Column) -> Column:
    """1..12 out of a month name, NULL for other text."""
    position = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.substring(c, 1, 3)).cast("int")
    return F.nullif(position, F.lit(0))


def _moment(year: Column, month: Column, day: Column, clock: Column) -> Column:
    """Wall time of the parts; the clock text may hold ``h:mm[:ss] [am|pm]``. NULL for impossible dates."""
    field = lambda i: F.when(F.contains(clock, F.lit(":")), F.regexp_extract(clock, TIME, i))
    hour, half = _int(field(1)), field(4)
    hour = F.when(half == "p", hour % 12 + 12).when(half == "a", hour % 12).otherwise(hour)
    zero = F.lit(0)
    seconds = F.coalesce(_int(field(3)), zero).cast("decimal(16,6)")
    return F.try_make_timestamp_ntz(
        year, month, day, F.coalesce(hour, zero), F.coalesce(_int(field(2)), zero), seconds
    )


def base_column(base: Column | dt.datetime | str | None) -> Column:
    """The moment relative words refer to, as Eastern wall time. It is always an explicit argument."""
    if base is None:
        return F.lit(None).cast("timestamp_ntz")
    if isinstance(base, dt.datetime):
        return F.lit(base.replace(tzinfo=None).isoformat(sep=" ")).cast("timestamp_ntz")
    if isinstance(base, str):
        return parse_wall_time(F.lit(base))
    return base.cast("timestamp_ntz")


def _plain(c: Column | str) -> Column:
    """Lower case, without ordinal endings, weekdays, filler words, zone names and commas."""
    s = F.regexp_replace(F.lower(normalize_ws(c)), r"(\d)(?:st|nd|rd|th)\b", "$1")
    return normalize_ws(F.regexp_replace(s, rf"\b{WEEKDAY}\b\.?,?|\b(?:e[sd]?t|at|on)\b|,", " "))


def _instant(s: Column) -> Column:
    """Eastern wall time of an ISO timestamp that has a zone."""
    signed = lambda group: _int(F.concat(
        F.regexp_extract(s, r"([+-])\d{2}:?\d{2}$", 1), F.regexp_extract(s, r"[+-](\d{2}):?(\d{2})$", group)
    ))
    ahead = F.coalesce(signed(1) * 60 + signed(2), F.lit(0))
    stamp = F.translate(F.substring(s, 1, 19), "t", " ").try_cast("timestamp_ntz")
    wall = F.convert_timezone(F.lit("UTC"), F.lit(ZONE), stamp - F.make_dt_interval(mins=ahead))
    zoned = r"^\d{4}-\d{2}-\d{2}[t ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:z|[+-]\d{2}:?\d{2})$"
    return F.when(s.rlike(zoned), wall)


def _calendar(s: Column, ref: Column) -> Column:
    """Wall time of a calendar date, with or without a clock time; missing parts get their defaults."""

    def read(day: Column) -> Column:
        def parts(pattern: str, year: int | None, month: int | None, dom: int | None, named: bool) -> Column:
            pattern = f"^{pattern}$"
            get = lambda i: F.regexp_extract(day, pattern, i)
            m = F.lit(12) if month is None else (_month(get(month)) if named else _int(get(month)))
            d = F.lit(1) if dom is None else _int(get(dom))
            # Two-digit years: 69..99 are 19xx, 00..68 are 20xx.
            full = lambda y: F.when(y < 69, y + 2000).when(y < 100, y + 1900).otherwise(y)
            y = F.year(ref) if year is None else let(_int(get(year)), full)
            return F.when(day.rlike(pattern), _moment(y, m, d, s))

        return F.coalesce(
            parts(r"(\d{4})-(\d{1,2})-(\d{1,2})", 1, 2, 3, False),
            parts(r"(\d{1,2})[/.-](\d{1,2})[/.-](\d{4}|\d{2})", 3, 1, 2, False),
            parts(rf"({MONTH})\.? (\d{{1,2}}) (\d{{4}})", 3, 1, 2, True),
            parts(rf"(\d{{1,2}}) (?:of )?({MONTH})\.? (\d{{4}})", 3, 2, 1, True),
            parts(rf"({MONTH})\.? (\d{{4}})", 2, 1, None, True),
            parts(rf"({MONTH})\.? (\d{{1,2}})", None, 1, 2, True),
            parts(rf"(\d{{1,2}}) (?:of )?({MONTH})\.?", None, 2, 1, True),
            parts(rf"({MONTH})\.?", None, 1, None, True),
            parts(r"(\d{4})", 1, None, None, False),
        )

    return let(F.trim(F.regexp_replace(F.regexp_replace(s, rf"t?{TIME}", ""), r"[-,]+$", "")), read)


def _relative(s: Column, ref: Column) -> Column:
    """The reference moment moved by words such as "yesterday", "3 days ago" or "in a week"."""
    phrase = rf"^(?:in )?(\d+|an?) ({UNIT})s?(?: ago)?$"
    number, unit = F.regexp_extract(s, phrase, 1), F.regexp_extract(s, phrase, 2)
    count = F.when(number.isin("a", "an"), F.lit(1)).otherwise(_int(number))
    count = F.when(s.endswith("ago"), -count).when(s.startswith("in "), count)
    days = F.when(s.isin("today", "now"), 0).when(s == "yesterday", -1).when(s == "tomorrow", 1)
    days = F.coalesce(days, F.when(unit == "day", count), F.when(unit == "week", count * 7))
    seconds = F.when(unit == "second", count).when(unit == "minute", count * 60).when(unit == "hour", count * 3600)
    months = F.when(unit == "month", count).when(unit == "year", count * 12)
    return F.coalesce(
        ref + F.make_dt_interval(days=days),
        ref + F.make_dt_interval(secs=seconds.cast("decimal(18,6)")),
        ref + F.make_ym_interval(months=months),
    )


def parse_wall_time(c: Column | str, base: Column | dt.datetime | str | None = None) -> Column:
    """Eastern wall time (timestamp without zone) of one date phrase, NULL if it is none."""
    ref = base_column(base)
    return let(_plain(c), lambda s: F.coalesce(_instant(s), _calendar(s, ref), _relative(s, ref)))


def eastern_iso(wall: Column) -> Column:
    """ISO text with the Eastern offset of a wall time."""
    utc = F.convert_timezone(F.lit(ZONE), F.lit("UTC"), wall)
    minutes = F.timestamp_diff("MINUTE", utc, wall)
    offset = F.format_string(
        "%s%02d:%02d",
        F.when(minutes < 0, "-").otherwise("+"),
        F.floor(F.abs(minutes) / 60).cast("int"),
        (F.abs(minutes) % 60).cast("int"),
    )
    return F.concat(F.replace(wall.cast("string"), F.lit(" "), F.lit("T")), offset)


def parse_date(
    c: Column | str, base: Column | dt.datetime | str | None = None, strict: bool = False
) -> Column:
    """ISO text of one date phrase. Text that is no date gives NULL, or an error in strict mode."""
    iso = let(parse_wall_time(c, base), eastern_iso)
    if not strict:
        return iso
    return F.coalesce(iso, F.raise_error(F.concat(F.lit("not a date: "), F.coalesce(as_col(c), F.lit("NULL")))))


def find_dates(c: Column | str, base: Column | dt.datetime | str | None = None) -> Column:
    """Array of the ISO forms of every date phrase in the text, in text order."""
    found = F.regexp_extract_all(normalize_ws(c), F.lit(SEARCH), F.lit(0))
    return F.filter(F.transform(found, lambda d: parse_date(d, base)), lambda d: d.isNotNull())


def date_term(c: Column | str) -> Column:
    """``yyyy-MM-dd`` of an ISO date text, NULL if it is none."""
    return F.substring(as_col(c), 1, 10).try_cast("date").cast("string")


def date_terms(c: Column | str, base: Column | dt.datetime | str | None = None) -> Column:
    """Day-granular terms of the dates in a text."""
    return F.transform(find_dates(c, base), date_term)
