"""Column functions on times. A clock is always given, never read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Korean relative times; a month has 30 days, a year 365.
UNIT_SECONDS = {"초": 1, "분": 60, "시간": 3600, "일": 86400, "주": 604800, "개월": 2592000, "년": 31536000}
RELATIVE = r"(\d+)\s*(초|분|시간|일|주|개월|년)\s*전"
JUST_NOW = "방금"


def relative_time(c: Column, now: Column) -> Column:
    """The moment that the first relative time in the text tells; null where there is none."""
    number = F.nullif(F.regexp_extract(c, RELATIVE, 1), F.lit("")).try_cast("long")
    unit = F.regexp_extract(c, RELATIVE, 2)
    seconds = F.coalesce(*[F.when(unit == u, F.lit(s)) for u, s in UNIT_SECONDS.items()])
    return F.when(number.isNotNull(), (now - F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), (number * seconds).cast("decimal(18,6)")))).when(F.contains(c, F.lit(JUST_NOW)), now)


def utc_naive(c: Column) -> Column:
    """An ISO time with zone as time without zone in UTC; bad input is null."""
    return F.try_to_timestamp(c).cast("timestamp_ntz")


def any_format(c: Column, *formats: str) -> Column:
    """The time by the first format that fits; null where none does."""
    return F.coalesce(*[F.try_to_timestamp(c, F.lit(f)) for f in formats]).cast("timestamp_ntz")


def iso_or_epoch(c: Column) -> Column:
    """The first space becomes T; blank becomes the epoch."""
    return F.when(F.coalesce(F.trim(c), F.lit("")) == "", "1970-01-01T00:00:00").otherwise(F.regexp_replace(c, r"^([^ ]*) ", "$1T"))


def bootstrap(now: Column, days: int = 90) -> Column:
    return F.date_trunc("day", now - F.make_dt_interval(F.lit(days))).cast("timestamp_ntz")
