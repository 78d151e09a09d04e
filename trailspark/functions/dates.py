"""Date parsing for ``"%b %d, %a"`` journal dates and week buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailspark.functions.text import WS

# English month and weekday abbreviations accepted by "%b"/"%a".
MONTHS = ["jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec"]
WEEKDAYS = ["mon", "tue", "wed", "thu", "fri", "sat", "sun"]

# Python's strptime turns each space of the format into "one or more
# whitespace" and anchors the whole string; day is 1-2 digits.
_PATTERN = "^([A-Za-z]{3})" + WS + r"(\d{1,2}),"  + WS + "([A-Za-z]{3})$"
DEFAULT_YEAR = 2016


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parse_month_day(c, year: int = DEFAULT_YEAR, strict_leap: bool = False) -> Column:
    """Parse ``'Mar 05, Sat'`` into a date in ``year``; anything else -> null.

    Month and weekday names are case-insensitive abbreviations.  The
    weekday must be a valid name but is not checked against the date.
    ``strict_leap`` rejects Feb 29 (the reference parses with the default
    year 1900 before replacing it, so Feb 29 fails there).
    """
    s = _col(c)
    mon = F.lower(F.regexp_extract(s, _PATTERN, 1))
    day = F.regexp_extract(s, _PATTERN, 2)
    dow = F.lower(F.regexp_extract(s, _PATTERN, 3))
    month_no = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), mon)
    ok = (month_no > 0) & F.array_contains(F.array(*[F.lit(w) for w in WEEKDAYS]), dow)
    if strict_leap:
        ok = ok & ~((month_no == 2) & (day.cast("int") == 29))
    text = F.concat(F.lit(str(year)), F.lit("-"), month_no.cast("string"), F.lit("-"), day)
    return F.when(ok, F.try_to_date(text, "yyyy-M-d"))


def week_end_sunday(d) -> Column:
    """Sunday that closes the Monday..Sunday week containing ``d``."""
    return F.next_day(F.date_sub(_col(d), 1), "Sun")
