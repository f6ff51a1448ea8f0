"""Date scalar functions (SCA-1, SCA-2, SCA-3, SCA-7, SCA-17) as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def next_business_day(d: Column) -> Column:
    """SCA-3: +1 day; a Saturday moves on to Monday (+3), a Sunday to Monday (+2).

    ``weekday`` is 0 = Monday ... 6 = Sunday. No holiday calendar (Q17).
    """
    nxt = F.date_add(d, 1)
    wd = F.weekday(nxt)
    return F.date_add(d, F.when(wd == 5, 3).when(wd == 6, 2).otherwise(1))


def split_date(d: Column) -> tuple[Column, Column, Column]:
    """SCA-1: date -> Year, Month, Day integers."""
    return F.year(d).alias("Year"), F.month(d).alias("Month"), F.dayofmonth(d).alias("Day")


def join_date(y: Column, m: Column, day: Column) -> Column:
    """SCA-2: three ints -> unpadded ``Y-M-D`` text (e.g. ``2023-9-5``)."""
    return F.concat_ws("-", y.cast("string"), m.cast("string"), day.cast("string"))


def date_to_text(ts: Column, fmt: str = "yyyy-MM-dd HH:mm:ss") -> Column:
    """SCA-7: timestamp/date -> text."""
    return F.date_format(ts, fmt)


def parse_date(text: Column) -> Column:
    """SCA-17 on raw input: ``try_to_date`` (NULL instead of an error under ANSI)."""
    return F.try_to_date(text, "yyyy-MM-dd")
