"""Days, windows, relative dates and freshness as columns. Sessions run in UTC."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Naive times of the library belong to this zone.
HOME = "Asia/Shanghai"
ISO = r"^\d{4}-\d{2}-\d{2}([T ]\d{2}:\d{2}(:\d{2}(\.\d{1,6})?)?(Z|[+-]\d{2}:?\d{2})?)?$"


def instant(text: Column, home: str = HOME) -> Column:
    """ISO text as a timestamp; what names no zone is read in ``home``; other text is null."""
    t = F.trim(text)
    zoned = t.rlike(r"(Z|[+-]\d{2}:?\d{2})$") & t.rlike("T| ")
    parsed = F.try_to_timestamp(t)
    return F.when(t.rlike(ISO), F.when(zoned, parsed).otherwise(F.to_utc_timestamp(parsed, home)))


def end_of_day(day: date, home: str = HOME) -> Column:
    """The last instant that belongs to a day at ``home``."""
    midnight = F.to_utc_timestamp(F.lit((day + timedelta(days=1)).isoformat()).cast("timestamp"), home)
    return midnight - F.expr("INTERVAL 1 MICROSECOND")


def utc_day(text: Column) -> Column:
    """The UTC day of ISO text, a naive time being UTC; null for anything else, 'yesterday' too."""
    return F.when(F.trim(text).rlike(ISO), F.to_date(F.try_to_timestamp(F.trim(text))))


def research_window(as_of: date, days: int = 30) -> tuple[date, date]:
    """The inclusive window of ``days`` calendar days that ends on ``as_of``."""
    return as_of - timedelta(days=days - 1), as_of


def window_status(published: Column, earliest: Column, latest: Column, window: tuple[date, date]) -> Column:
    """in_window, out_of_window, uncertain or unknown, by UTC day.

    A date decides alone; an interval only where there is no date, and is uncertain where it
    crosses an end of the window. ``published`` is a day, null for unknown.
    """
    low, high = F.lit(window[0]), F.lit(window[1])
    span = (
        F.when(earliest.isNull() | latest.isNull() | (earliest > latest), "unknown")
        .when((earliest >= low) & (latest <= high), "in_window")
        .when((latest < low) | (earliest > high), "out_of_window")
        .otherwise("uncertain")
    )
    return F.when(published.isNotNull(), F.when(published.between(low, high), "in_window").otherwise("out_of_window")).otherwise(span)


def coverage_window(published: Column, earliest: Column, latest: Column, window: tuple[date, date]) -> Column:
    """The coverage rule: an interval counts by its two ends, which must agree."""
    low, high = F.lit(window[0]), F.lit(window[1])
    place = lambda d: F.when(d.between(low, high), "in_window").otherwise("out_of_window")
    ends = F.when(earliest.isNull() | latest.isNull(), "unknown").when(place(earliest) == place(latest), place(earliest)).otherwise("uncertain")
    return F.when(published.isNotNull(), place(published)).otherwise(ends)


#: Units of relative dates, each with days at least and at most (fixed values).
UNITS = {
    r"min(?:ute)?s?|分钟": (0, 1), r"h(?:ou)?rs?|h|小时": (0, 1), r"days?|d|天|日": (1, 1), r"weeks?|w|周|星期": (7, 7),
    r"mo(?:nth)?s?|个?月": (28, 31), r"y(?:ea)?rs?|年": (365, 366),
}


def relative_interval(text: Column, observed: Column) -> Column:
    """'2 days ago' or 昨天, seen on day ``observed``, as struct(earliest, latest) of days.

    Conservative: a unit's shortest and longest length, and a day's slack for the clock's zone.
    """
    t = F.lower(F.trim(text))
    span = lambda least, most: F.struct(F.date_sub(observed, most).alias("earliest"), F.date_sub(observed, least).alias("latest"))
    rule = F.when(t.rlike("^(just now|today|刚刚|今天)$"), span(F.lit(0), F.lit(1)))
    rule = rule.when(t.rlike("^(yesterday|昨天)"), span(F.lit(1), F.lit(2))).when(t.rlike("^前天"), span(F.lit(2), F.lit(3)))
    for unit, (least, most) in UNITS.items():
        pattern = rf"^(\d+)\s*(?:{unit})\s*(?:ago|前)?$"
        n = F.regexp_extract(t, pattern, 1).try_cast("int")
        if most <= 1 and not least:
            hours = n / (1440 if unit.startswith("min") else 24)
            rule = rule.when(t.rlike(pattern), span(F.floor(hours).cast("int"), (F.ceil(hours) + 1).cast("int")))
        else:
            rule = rule.when(t.rlike(pattern), span(n * least, n * most + 1))
    return F.when(text.isNotNull() & observed.isNotNull(), rule)


def any_date(text: Column) -> Column:
    """A timestamp from epoch seconds or milliseconds, ISO, RFC 2822 or compact text."""
    t = F.trim(text)
    number = t.try_cast("decimal(20,0)")
    epoch = F.when(t.rlike(r"^\d{9,10}$"), F.timestamp_seconds(number)).when(t.rlike(r"^\d{12,13}$"), F.timestamp_millis(number.cast("long")))
    iso = F.when(t.rlike(ISO), F.try_to_timestamp(t))
    mail = F.regexp_replace(F.regexp_replace(t, r"^[A-Za-z]{3},\s*", ""), r"\b(GMT|UTC)$", "+0000")
    forms = [F.try_to_timestamp(mail, F.lit("d MMM yyyy HH:mm:ss Z")), F.try_to_timestamp(F.when(t.rlike(r"^\d{8}$"), t), F.lit("yyyyMMdd"))]
    return F.coalesce(epoch, iso, *forms)


def freshness(source_day: Column, semantic_day: Column, as_of: date, days: int = 30, soon: int = 7) -> Column:
    """struct(verified_on, due_on, status): fresh, due within ``soon`` days, overdue, or unknown.

    What was verified last counts by the earlier of the two days; one missing makes it unknown.
    """
    verified = F.when(source_day.isNotNull() & semantic_day.isNotNull(), F.least(source_day, semantic_day))
    due, day = F.date_add(verified, days), F.lit(as_of)
    status = F.when(verified.isNull(), "unknown").when(day > due, "overdue").when(day >= F.date_sub(due, soon), "due").otherwise("fresh")
    return F.struct(verified.alias("verified_on"), due.alias("due_on"), status.alias("status"))


def ordinal_day(day: Column) -> Column:
    """Days since the day before 0001-01-01."""
    return F.datediff(day, F.to_date(F.lit("0001-01-01"))) + 1
