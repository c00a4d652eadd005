"""Dates in the reference-time style of layouts: ``2006-01-02`` stands for year, month, day."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RFC3339 = "2006-01-02T15:04:05Z07:00"
_PARTS = [
    ("2006", "yyyy"), ("January", "MMMM"), ("Monday", "EEEE"), ("Jan", "MMM"), ("Mon", "EEE"), ("MST", "z"), ("Z07:00", "XXX"), ("-07:00", "xxx"), ("-0700", "xx"), (".000", ".SSS"),
    ("01", "MM"), ("02", "dd"), ("15", "HH"), ("03", "hh"), ("04", "mm"), ("05", "ss"), ("06", "yy"), ("PM", "a"), ("1", "M"), ("2", "d"), ("3", "h"), ("4", "m"), ("5", "s"),
]


def java_pattern(layout: str) -> str:
    out, i, quoted = "", 0, ""
    while i < len(layout):
        for a, b in _PARTS:
            if layout.startswith(a, i):
                if quoted:
                    out, quoted = out + _quote(quoted), ""
                out += b
                i += len(a)
                break
        else:
            quoted += layout[i]
            i += 1
    return out + _quote(quoted) if quoted else out


def _quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'" if any(c.isalpha() or c == "'" for c in s) else s


def parse_date(text: Column, layout: str = RFC3339) -> Column:
    """Unix seconds; a text that doesn't follow the layout is an error."""
    return F.coalesce(F.unix_timestamp(F.try_to_timestamp(text, F.lit(java_pattern(layout)))), F.raise_error(F.concat(F.lit("Could not parse date: "), F.coalesce(text, F.lit("<nil>")))).cast("bigint"))
