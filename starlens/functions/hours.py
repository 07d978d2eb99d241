"""Opening-hours expressions over dict-like strings ``{'Monday': '9:0-17:0'}``."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from starlens.functions._util import as_col

# Day labels in week order, Monday first (weekday 0).
DAY_NAMES = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]


def parse_hours(c) -> Column:
    """Parse a (single- or double-quoted) JSON object to map<string,string>.

    NULL, malformed text and non-string values give an empty map.
    """
    col = as_col(c)
    parsed = F.from_json(col, "map<string,string>", {"allowSingleQuotes": "true", "mode": "PERMISSIVE"})
    return F.coalesce(parsed, F.create_map().cast("map<string,string>"))


def _range_hours(v: Column, wrap_midnight: bool) -> Column:
    """Whole hours of one ``'h:m-h:m'`` range; NULL when it can't be read."""
    parts = F.split(v, "-")
    start, end = F.get(parts, 0), F.get(parts, 1)
    s_h = F.split(start, ":").getItem(0).try_cast("int")
    e_h = F.split(end, ":").getItem(0).try_cast("int")
    ok = (F.size(parts) == 2) & start.contains(":") & end.contains(":")
    diff = e_h - s_h
    if wrap_midnight:
        diff = F.when(diff < 0, diff + F.lit(24)).otherwise(diff)
    return F.when(ok, diff)


def total_hours(c, wrap_midnight: bool = False) -> Column:
    """Sum over days of (end hour - start hour); minutes ignored.

    Ranges crossing midnight count negative unless ``wrap_midnight``.  Days
    whose range lacks ``:`` on a side are skipped; unreadable ranges count 0.
    ``c`` is a map<string,string> column (see :func:`parse_hours`).
    """
    vals = F.map_values(as_col(c))
    return F.aggregate(
        vals, F.lit(0),
        lambda acc, v: acc + F.coalesce(_range_hours(v, wrap_midnight), F.lit(0)),
    )


def hours_of_day(c, day: str) -> Column:
    """The raw range string of one day (one column per day, R3)."""
    return as_col(c).getItem(day)
