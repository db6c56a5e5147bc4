"""Calendar functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geo import _col

# The day-of-year period and the two season windows.
DAY_PERIOD = 366.0
MONTH_PERIOD = 12.0
SEASON_MONTHS = {"winter_jfm": (1, 2, 3), "summer_jas": (7, 8, 9)}
DATE_PATTERNS = (
    "yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd", "yyyyMMdd", "yyyy/MM/dd", "dd-MMM-yyyy",
)

__all__ = [
    "cyclic_time", "season_label", "season_flags", "month_first", "month_last",
    "canonical_date", "parse_timestamp", "SEASON_MONTHS",
]


def parse_timestamp(text) -> Column:
    text = _col(text)
    return F.coalesce(*[F.try_to_timestamp(text, F.lit(p)) for p in DATE_PATTERNS])


def cyclic_time(ts) -> dict[str, Column]:
    """Day and month on the unit circle; NULL where the timestamp is NULL."""
    ts = _col(ts)
    day = F.dayofyear(ts) * (2.0 * 3.141592653589793) / DAY_PERIOD
    month = F.month(ts) * (2.0 * 3.141592653589793) / MONTH_PERIOD
    return {"day_sin": F.sin(day), "day_cos": F.cos(day), "month_sin": F.sin(month), "month_cos": F.cos(month)}


def season_label(month) -> Column:
    month = _col(month)
    out = F.when(month.isin(*SEASON_MONTHS["winter_jfm"]), "winter_jfm")
    return out.when(month.isin(*SEASON_MONTHS["summer_jas"]), "summer_jas").otherwise("other")


def season_flags(month) -> dict[str, Column]:
    label = season_label(month)
    return {f"is_{n}": (label == n).cast("int") for n in ("winter_jfm", "summer_jas", "other")}


def month_first(year, month) -> Column:
    return F.make_date(_col(year), _col(month), F.lit(1))


def month_last(year, month) -> Column:
    return F.last_day(month_first(year, month))


def canonical_date(text) -> Column:
    return F.date_format(parse_timestamp(text), "yyyy-MM-dd")
