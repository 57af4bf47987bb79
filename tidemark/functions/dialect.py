"""Date and time expressions that do not depend on the session time zone."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def day(ts) -> Column:
    return _c(ts).cast("date")


def epoch_second(ts) -> Column:
    """Whole seconds since 1970 of a zone-less timestamp; fractions are cut off."""
    ts = _c(ts)
    return (
        F.unix_date(day(ts)).cast("bigint") * 86400
        + F.hour(ts) * 3600
        + F.minute(ts) * 60
        + F.second(ts)
    )


def seconds_between(start, end) -> Column:
    """Number of second boundaries crossed between two timestamps."""
    return epoch_second(end) - epoch_second(start)


def days_between(start, end) -> Column:
    """Number of midnights crossed between two timestamps or dates."""
    return F.datediff(day(end), day(start)).cast("bigint")


def days(n: int) -> Column:
    return F.expr(f"INTERVAL {int(n)} DAY")


def week_start(d) -> Column:
    """Monday of the week a date lies in."""
    d = day(d)
    return F.date_sub(d, F.weekday(d))


def midnight(d) -> Column:
    return _c(d).cast("timestamp_ntz")


def count_where(cond: Column) -> Column:
    return F.count_if(cond).cast("bigint")


def ratio(num, den, scale: float = 1.0) -> Column:
    """``num / den * scale`` as double, NULL when the denominator is 0 or NULL."""
    num, den = _c(num).cast("double"), _c(den).cast("double")
    return F.when(den != 0, num / den * F.lit(float(scale)))


def index_range(lo: Column, hi: Column) -> Column:
    """``[lo .. hi]`` as an array, empty when lo > hi or either bound is NULL."""
    empty = F.array().cast("array<bigint>")
    return F.when(lo <= hi, F.sequence(lo.cast("bigint"), hi.cast("bigint"))).otherwise(empty)


def parse_vector(text) -> Column:
    """``"[1 2 3]"`` to ``array<float>``; an unreadable element becomes NULL."""
    body = F.trim(F.regexp_replace(_c(text), r"[\[\]]", " "))
    parts = F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, r"\s+"))
    return F.transform(parts, lambda p: p.try_cast("float"))
