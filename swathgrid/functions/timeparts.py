"""Time expressions on naive UTC timestamps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY = 86400


def day(c: Column | str) -> Column:
    return F.to_date(c)


def month_start(c: Column | str) -> Column:
    return F.trunc(F.to_date(c), "month")


def epoch(c: Column | str) -> Column:
    """Seconds since 1970 with fractions; independent of the session's time zone."""
    c = F.col(c) if isinstance(c, str) else c
    return F.datediff(F.to_date(c), F.lit("1970-01-01")).cast("double") * DAY + F.hour(c) * 3600 + F.minute(c) * 60 + F.extract(F.lit("second"), c).cast("double")


def fiscal_year(c: Column | str) -> Column:
    """Years that begin in December."""
    c = F.col(c) if isinstance(c, str) else c
    return F.year(c) + F.when(F.month(c) == 12, 1).otherwise(0)


def seconds_of_day(c: Column | str) -> Column:
    return F.hour(c) * 3600 + F.minute(c) * 60 + F.second(c)


def circular_seconds(a: Column, b: Column) -> Column:
    """Distance of two times of day, the short way round midnight."""
    d = F.abs(a - b)
    return F.least(d, DAY - d)


def iso_utc(c: Column | str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def plus_hours(c: Column | str, hours: Column) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    return c + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), F.round(hours * 3600, 6).cast("decimal(18,6)"))


def parse_iso(c: Column | str, lenient: bool = False) -> Column:
    zone_free = F.regexp_replace(c, r"(Z|[+-]00:?00)$", "")
    return zone_free.try_cast("timestamp_ntz") if lenient else zone_free.cast("timestamp_ntz")


def equation_of_time(c: Column | str) -> Column:
    """Minutes by which the sun runs ahead of the clock: Spencer's series (1971), within half a minute."""
    c = F.col(c) if isinstance(c, str) else c
    b = 2 * F.lit(3.141592653589793) * (F.dayofyear(c) - 1 + (F.hour(c) - 12) / F.lit(24.0)) / 365
    return 229.18 * (0.000075 + 0.001868 * F.cos(b) - 0.032077 * F.sin(b) - 0.014615 * F.cos(2 * b) - 0.040849 * F.sin(2 * b))


def solar_time(c: Column | str, lon: Column) -> Column:
    return plus_hours(c, equation_of_time(c) / 60 + lon / 15)


def solar_offset_seconds(solar: Column | str) -> Column:
    """Seconds since solar midnight."""
    s = F.col(solar) if isinstance(solar, str) else solar
    return F.hour(s) * 3600 + F.minute(s) * 60 + F.extract(F.lit("second"), s).cast("double")
