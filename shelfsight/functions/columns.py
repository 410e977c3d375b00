"""Column helpers with the null and division rules of the source dialect."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import ACCURACY, HIGH_SEASON_WEEKS


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ratio(a: Column | str, b: Column | str) -> Column:
    """Null where the divisor is zero or null."""
    return F.try_divide(col(a).cast("double"), col(b).cast("double"))


def _any_null(cols: list[Column]) -> Column:
    return reduce(lambda x, y: x | y, [c.isNull() for c in cols])


def greatest_strict(*cols: Column) -> Column:
    """Null where any argument is."""
    return F.when(~_any_null(list(cols)), F.greatest(*cols))


def least_strict(*cols: Column) -> Column:
    return F.when(~_any_null(list(cols)), F.least(*cols))


def positive(x: Column) -> Column:
    """max(x, 0), null for null."""
    return F.when(x > 0, x).when(x.isNotNull(), F.lit(0.0))


def clip(x: Column, low: float, high: float) -> Column:
    return F.when(x < low, F.lit(low)).when(x > high, F.lit(high)).otherwise(x)


def quantile(x: Column | str, percent: float) -> Column:
    """The value of rank ceil(p n) among the non-null values."""
    return F.percentile_approx(col(x), F.lit(percent / 100.0), F.lit(ACCURACY))


def monday(d: Column | str) -> Column:
    return F.date_trunc("week", col(d)).cast("date")


def iso_week(d: Column | str) -> Column:
    return F.weekofyear(col(d))


def iso_year(d: Column | str) -> Column:
    return F.extract(F.lit("YEAROFWEEK"), col(d)).cast("int")


def season_group(week: Column) -> Column:
    return F.when(week.between(*HIGH_SEASON_WEEKS), "HIGH_SEASON").otherwise("REST")


def segment(season: Column, decile: Column, bucket: Column | None = None) -> Column:
    parent = F.concat(season, F.lit("_D"), F.lpad(decile.cast("string"), 2, "0"))
    return parent if bucket is None else F.concat(parent, F.lit("_V"), bucket.cast("string"))


def share(condition: Column) -> Column:
    """Share of rows where the condition holds; unknown counts as no."""
    return F.avg(F.when(condition, 1.0).otherwise(0.0))


def fixed(x: Column | str, digits: int) -> Column:
    """Rounded to so many digits, half away from zero, after scaling: exact at halves on any engine."""
    unit = 10.0**digits
    return F.round(col(x) * F.lit(unit)) / F.lit(unit)


def rounded(df, *keys: str, digits: int = 6):
    """Doubles rounded for reports and comparison; other columns as they are."""
    return df.select(*(fixed(c, digits).alias(c) if t == "double" and c not in keys else c for c, t in df.dtypes))
