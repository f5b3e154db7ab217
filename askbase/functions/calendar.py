"""Turkish date and time answers (D1-D6) on an explicit ``as_of`` column.

The wall clock is never read: every answer is a function of a timestamp
column, so replays and retries give the same text.  Fields are extracted
directly (day, month, year, hour, ...), so a ``timestamp_ntz`` column gives
the same text under any session time zone.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from askbase.constants import DAY_NAMES_TR, MONTH_NAMES_TR, WEEKDAYS_FROM_SUNDAY


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def month_name_tr(month) -> Column:
    """1-12 -> Turkish month name (null outside the range)."""
    names = F.array(*[F.lit(m) for m in MONTH_NAMES_TR])
    return F.try_element_at(names, _c(month).cast("int"))


def day_name_tr(day) -> Column:
    """English weekday -> Turkish; unknown input comes back unchanged."""
    m = F.create_map(*[x for k, v in DAY_NAMES_TR.items() for x in (F.lit(k), F.lit(v))])
    d = _c(day)
    return F.coalesce(F.try_element_at(m, d), d)


def _two(x: Column) -> Column:
    return F.lpad(x.cast("string"), 2, "0")


def english_day_name(ts) -> Column:
    """Weekday name in English (what ``%A`` gives), from the day of week, so
    the result never depends on the session time zone."""
    names = F.array(*[F.lit(d) for d in WEEKDAYS_FROM_SUNDAY])
    return F.element_at(names, F.dayofweek(_c(ts)))


def _date_words(ts: Column) -> list[Column]:
    return [_two(F.dayofmonth(ts)), month_name_tr(F.month(ts)), F.lpad(F.year(ts).cast("string"), 4, "0"),
            day_name_tr(english_day_name(ts))]


def today_sentence(as_of) -> Column:
    """D3: 'Bugün DD Month YYYY Weekday' (no final dot)."""
    return F.concat_ws(" ", F.lit("Bugün"), *_date_words(_c(as_of)))


def weekday_sentence(as_of) -> Column:
    """The same sentence with a final dot."""
    return F.concat(today_sentence(as_of), F.lit("."))


def tomorrow_sentence(as_of) -> Column:
    """D5: 'Yarın ...' for the next calendar day."""
    nxt = F.date_add(F.to_date(_c(as_of)), 1)
    return F.concat_ws(" ", F.lit("Yarın"), *_date_words(nxt))


def time_string(as_of) -> Column:
    """HH:MM:SS, 24-hour clock (field extraction, no time-zone cast)."""
    ts = _c(as_of)
    return F.concat_ws(":", _two(F.hour(ts)), _two(F.minute(ts)), _two(F.second(ts)))
