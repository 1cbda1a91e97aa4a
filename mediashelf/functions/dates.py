"""Date columns: capture time, searchable date words, and date phrases in queries.

Timestamps are read and written in the session time zone, which the library pins to UTC.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed_values as fv


def parse_exif_ts(c: Column) -> Column:
    """'2024:03:16 18:30:12', '2024-03-16 18:30:12' or '2024:03:16'; null for anything else."""
    v = F.replace(F.trim(c), F.lit("\u0000"), F.lit(""))
    return F.coalesce(
        F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy:M:d H:m:s")),
        F.try_to_timestamp(F.substring(v, 1, 19), F.lit("yyyy-M-d H:m:s")),
        F.try_to_timestamp(F.substring(v, 1, 10), F.lit("yyyy:M:d")),
    )


def date_from_name(name: Column) -> Column:
    """The first date written in a file name; null when it is not a calendar day."""
    y, m, d = (F.regexp_extract(name, fv.FILENAME_DATE, i) for i in (1, 2, 3))
    return F.try_to_timestamp(F.concat_ws("-", y, m, d), F.lit("yyyy-MM-dd"))


def taken_at(original: Column, modified: Column, name: Column) -> Column:
    """Capture time: EXIF original, else EXIF date, else the file name."""
    stamp = F.coalesce(F.nullif(original, F.lit("")), modified)
    return F.coalesce(parse_exif_ts(stamp), date_from_name(name))


def event_time(taken: Column, created: Column) -> Column:
    return F.coalesce(taken, created)


def season_of(month: Column) -> Column:
    return (
        F.when(month.isin(3, 4, 5), "spring")
        .when(month.isin(6, 7, 8), "summer")
        .when(month.isin(9, 10, 11), "autumn")
        .otherwise("winter")
    )


def date_words(ts: Column) -> Column:
    """Words a photo of that moment should be found by; [] for null.

    A small hour with minutes is called "night" (the work this follows says "afternoon" before 5 a.m.).
    """
    holiday = F.get(
        F.map_values(
            F.map_filter(
                F.create_map(*[F.lit(x) for pair in fv.HOLIDAY_WORDS.items() for x in pair]),
                lambda k, _: k == F.date_format(ts, "MM-dd"),
            )
        ),
        F.lit(0),
    )
    hour = F.hour(ts)
    part_of_day = (
        F.when(hour.between(5, 11), "morning")
        .when(hour.between(12, 16), "afternoon")
        .when(hour.between(17, 20), "evening")
        .otherwise("night")
    )
    base = F.array(
        F.year(ts).cast("string"),
        F.lower(F.date_format(ts, "MMMM")),
        F.lower(F.date_format(ts, "MMM")),
        F.lower(F.date_format(ts, "EEEE")),
        season_of(F.month(ts)),
        F.date_format(ts, "yyyy-MM"),
        F.when(F.weekday(ts) >= 5, "weekend"),
    )
    clock = F.array(F.when((hour > 0) | (F.minute(ts) > 0), part_of_day))
    words = F.concat(base, F.coalesce(F.split(holiday, " "), F.array().cast("array<string>")), clock)
    return F.when(ts.isNull(), F.array().cast("array<string>")).otherwise(F.filter(words, F.isnotnull))


# ---------------------------------------------------------------- date phrases in queries
def _month_number(word: Column) -> Column:
    pairs = {m: i for i, m in enumerate(fv.MONTHS, 1)} | {m[:3]: i for i, m in enumerate(fv.MONTHS, 1)}
    pairs |= fv.MONTH_ALIASES
    table = F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair])
    return F.try_element_at(table, word)


_MONTH_WORDS = sorted([*fv.MONTHS, *(m[:3] for m in fv.MONTHS if m != "may"), *fv.MONTH_ALIASES], key=len, reverse=True)
_ANY_MONTH = "|".join(_MONTH_WORDS)
_NOT_MAY = "|".join(m for m in _MONTH_WORDS if m != "may")


def _day(year: Column, month: int | Column, day: int | Column) -> Column:
    month, day = (F.lit(v) if isinstance(v, int) else v for v in (month, day))
    return F.make_date(year, month, day)


def season_range(season: Column, year: Column) -> Column:
    """struct(date_from, date_to) of a season; winter starts in December and ends in February."""
    first = last = F.lit(None).cast("int")
    for name, (a, b) in fv.SEASON_MONTHS.items():
        first = F.when(season == name, F.lit(a)).otherwise(first)
        last = F.when(season == name, F.lit(b)).otherwise(last)
    end_year = F.when(first > last, year + 1).otherwise(year)
    return F.struct(
        _day(year, first, 1).alias("date_from"), F.last_day(_day(end_year, last, 1)).alias("date_to")
    )


def bind(value: Column, body) -> Column:
    """Evaluate `value` once and use it in `body`: a one-element array stands in for a local variable."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


DATE_PATTERNS = {
    "christmas": r"\b(christmas|xmas)( eve)?\s+(\d{4})\b",
    "new year": r"\bnew year'?s?( eve)?\s+(\d{4})\b",
    "halloween": r"\bhalloween\s+(\d{4})\b",
    "month and year": rf"\b({_ANY_MONTH})\s+(\d{{4}})\b",
    "season": r"\b(last|this|past)?\s*(spring|summer|autumn|fall|winter)(?:\s+(\d{4}))?\b",
    "today": r"\btoday\b",
    "yesterday": r"\byesterday\b",
    "this week": r"\bthis week\b",
    "last week": r"\blast week\b",
    "this month": r"\bthis month\b",
    "last month": r"\blast month\b",
    "this year": r"\bthis year\b",
    "last year": r"\blast year\b",
    "last n": r"\b(?:last|past)\s+(\d+)\s+(day|week|month|year)s?\b",
    "years ago": r"\b(\d+|a|one|two|three)\s+years?\s+ago\b",
    "year": r"\b(19[5-9]\d|20\d{2})\b",
    "month": rf"\b(?:(?:in|during|from)\s+(may)|({_NOT_MAY}))\b",
}


def date_phrase(text: Column, today: Column) -> Column:
    """The first date rule (in the order of DATE_PATTERNS) that matches a lower-case text.

    Returns struct(pattern, date_from, date_to, month): the matched rule's regex (null when none matches),
    its inclusive range, or a month meant in any year. Holidays without a year match nothing: every year
    has one, so the word stays in the text.
    """
    rule = F.lit(None).cast("struct<name:string,pattern:string>")
    for name, pattern in reversed(DATE_PATTERNS.items()):
        hit = F.struct(F.lit(name).alias("name"), F.lit(pattern).alias("pattern"))
        rule = F.when(text.rlike(f"(?U){pattern}"), hit).otherwise(rule)

    def groups(r: Column) -> Column:
        # three empty groups at the end make every group number valid
        regex = F.concat(F.lit(f"(?U){fv.PREPOSITION}"), r["pattern"], F.lit("()()()"))
        found = [F.call_function("regexp_extract", text, regex, F.lit(i)).alias(f"g{i}") for i in (1, 2, 3)]
        return F.struct(r["name"].alias("name"), r["pattern"].alias("pattern"), *found)

    return F.when(rule.isNotNull(), bind(bind(rule, groups), lambda m: _range(m, today)))


def _range(m: Column, today: Column) -> Column:
    """Dates of a matched rule m(name, pattern, g1, g2, g3)."""
    year = F.year(today)
    monday, this_month = F.trunc(today, "week"), F.trunc(today, "month")
    last_month_end = F.date_sub(this_month, 1)
    n1, n2, n3 = (m[g].try_cast("int") for g in ("g1", "g2", "g3"))

    # a season is over, or has begun, or belongs to the year before
    now = season_range(m["g2"], year)
    current = F.when(m["g1"].isin("last", "past"), now.date_to < today).otherwise(now.date_from <= today)
    season = season_range(m["g2"], F.coalesce(n3, F.when(current, year).otherwise(year - 1)))
    season_end = F.when(n3.isNotNull(), season.date_to).otherwise(F.least(season.date_to, today))

    month_year = _day(n2, _month_number(m["g1"]), 1)
    unit = F.when(m["g2"] == "day", 1).when(m["g2"] == "week", 7).when(m["g2"] == "month", 30).otherwise(365)
    back = F.when(m["g1"].isin("a", "one"), 1).when(m["g1"] == "two", 2).when(m["g1"] == "three", 3).otherwise(n1)

    ranges = {
        "christmas": (_day(n3, 12, 24), _day(n3, 12, F.when(m["g2"] != "", 24).otherwise(26))),
        "new year": (_day(n2 - 1, 12, 31), _day(n2, 1, 1)),
        "halloween": (_day(n1, 10, 31), _day(n1, 10, 31)),
        "month and year": (month_year, F.last_day(month_year)),
        "season": (season.date_from, season_end),
        "today": (today, today),
        "yesterday": (F.date_sub(today, 1), F.date_sub(today, 1)),
        "this week": (monday, today),
        "last week": (F.date_sub(monday, 7), F.date_sub(monday, 1)),
        "this month": (this_month, today),
        "last month": (F.trunc(last_month_end, "month"), last_month_end),
        "this year": (_day(year, 1, 1), today),
        "last year": (_day(year - 1, 1, 1), _day(year - 1, 12, 31)),
        "last n": (F.date_sub(today, n1 * unit), today),
        "years ago": (_day(year - back, 1, 1), _day(year - back, 12, 31)),
        "year": (_day(n1, 1, 1), _day(n1, 12, 31)),
    }
    none = F.lit(None).cast("date")
    span = F.struct(none.alias("date_from"), none.alias("date_to"))
    for name, (start, end) in ranges.items():
        span = F.when(m["name"] == name, F.struct(start.alias("date_from"), end.alias("date_to"))).otherwise(span)
    month = F.when(m["name"] == "month", _month_number(F.coalesce(F.nullif(m["g1"], F.lit("")), m["g2"])))
    return bind(
        span,
        lambda d: F.struct(
            m["pattern"].alias("pattern"), d["date_from"].alias("date_from"), d["date_to"].alias("date_to"), month.alias("month")
        ),
    )


def remove_first(text: Column, pattern: Column, preposition: bool = True) -> Column:
    """Replace the first match of a regex (a Column), with the preposition before it, by one blank."""
    lead = F.lit("(?Us)^(.*?)" + (fv.PREPOSITION if preposition else ""))
    return F.regexp_replace(text, F.concat(lead, F.lit("(?:"), pattern, F.lit(")")), F.lit("$1 "))


def strip_dates(text: Column, today: Column) -> Column:
    """Remove date phrases one after the other until none is left (each removal takes at least one word)."""

    def one(acc: Column, _: Column) -> Column:
        found = date_phrase(acc, today).pattern
        return F.when(found.isNull(), acc).otherwise(remove_first(acc, found))

    return F.aggregate(F.split(text, " "), text, one)
