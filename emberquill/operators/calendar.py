"""Calendar expressions: double-hour blocks, lunar phases, seasons."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The twelve double hours from 23:00, and solar terms by season.
BRANCHES = "子丑寅卯辰巳午未申酉戌亥"
SEASONS = {
    "春": ["立春", "雨水", "驚蟄", "春分", "清明", "穀雨"],
    "夏": ["立夏", "小滿", "芒種", "夏至", "小暑", "大暑"],
    "秋": ["立秋", "處暑", "白露", "秋分", "寒露", "霜降"],
    "冬": ["立冬", "小雪", "大雪", "冬至", "小寒", "大寒"],
}


def branch(ts) -> Column:
    """The double hour of a local time: 23 and 0 are the first."""
    place = F.floor((F.hour(ts) + 1) / 2) % 12
    return F.element_at(F.array(*map(F.lit, BRANCHES)), (place + 1).cast("int"))


def valid_until(ts) -> Column:
    """The end of the double hour, but midnight for what starts at 23:00."""
    hour, day = F.hour(ts), F.date_trunc("day", ts)
    end = F.when(hour == 23, 24).when(hour == 0, 1).otherwise(F.floor((hour - 1) / 2) * 2 + 3)
    return day + F.make_interval(hours=F.least(end, F.lit(24)).cast("int"))


def max_age(ts) -> Column:
    """Whole seconds until ``valid_until``."""
    return (F.unix_timestamp(valid_until(ts)) - F.unix_timestamp(ts)).cast("int")


def lunar_phase(day) -> Column:
    """new to day 7, waxing to 14, full to 21, waning after."""
    d = F.col(day) if isinstance(day, str) else day
    return F.when(d <= 7, "new").when(d <= 14, "waxing").when(d <= 21, "full").when(d.isNotNull(), "waning")


def season(term) -> Column:
    """春, 夏, 秋 or 冬 of a solar term; any other value fails the query, null stays null."""
    t = F.col(term) if isinstance(term, str) else term
    out = F.when(t.isNull(), F.lit(None).cast("string"))
    for name, terms in SEASONS.items():
        out = out.when(t.isin(terms), name)
    return out.otherwise(F.raise_error(F.concat(F.lit("unsupported solar term: "), t)))
