"""Column expressions shared by the operators; all of them stay on the JVM."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MICROS = 86_400_000_000


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def micros(ts: Column | str) -> Column:
    """Microseconds since the epoch, for timestamps with or without a zone."""
    return F.unix_micros(_col(ts).cast("timestamp"))


def elapsed(start: Column | str, end: Column | str, unit_micros: int = DAY_MICROS) -> Column:
    """Whole elapsed units between two timestamps (floored, not midnights crossed)."""
    return F.floor((micros(end) - micros(start)) / F.lit(unit_micros)).cast("int")


def elapsed_days(start: Column | str, end: Column | str) -> Column:
    return elapsed(start, end)


def minus_months(ts: Column | str, months: int) -> Column:
    """Calendar shift: clamps to the month's end and keeps the time of day."""
    return _col(ts) - F.expr(f"INTERVAL {int(months)} MONTHS")


def shift_days(ts: Column | str, days: int) -> Column:
    return _col(ts) + F.expr(f"INTERVAL {int(days)} DAYS")


def parse_ts(col: Column | str, fmt: str | None = None, strict: bool = True) -> Column:
    """String to timestamp; raises on a bad value, or yields NULL when not strict."""
    c = _col(col)
    args = (c, F.lit(fmt)) if fmt else (c,)
    return F.to_timestamp(*((c, fmt) if fmt else (c,))) if strict else F.try_to_timestamp(*args)


def clip(col: Column | str, lo: float | None = None, hi: float | None = None) -> Column:
    """Bound a value and keep NULL as NULL (``greatest`` and ``least`` skip it)."""
    c = _col(col)
    out = c
    if lo is not None:
        out = F.greatest(out, F.lit(lo))
    if hi is not None:
        out = F.least(out, F.lit(hi))
    return F.when(c.isNotNull(), out)


def safe_ratio(a: Column | str, b: Column | str, floor: float = 1.0) -> Column:
    """a / max(b, floor)."""
    return _col(a) / clip(_col(b).cast("double"), lo=float(floor))


def ratio_or(a: Column | str, b: Column | str, default: float) -> Column:
    """a / b where b is positive, else a default."""
    return F.when(_col(b) > 0, F.try_divide(_col(a), _col(b))).otherwise(F.lit(float(default)))


def finite(col: Column | str) -> Column:
    """NaN and infinities to NULL."""
    c = _col(col).cast("double")
    return F.when(~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))), c)


def money_sum(col: Column | str) -> Column:
    """Exact sum of money: the same total for any partitioning of the rows."""
    return F.sum(_col(col).cast("decimal(18,4)")).cast("double")


def bin_right_closed(col: Column | str, edges: Sequence[float], labels: Sequence[str]) -> Column:
    """Label of the interval (edge, next edge] a value falls in; NULL outside. A last edge of infinity is open."""
    if len(edges) != len(labels) + 1:
        raise ValueError("one label per interval")
    c = _col(col)
    out = None
    for lo, hi, label in zip(edges, edges[1:], labels):
        cond = c > F.lit(lo)
        if hi != float("inf"):
            cond = cond & (c <= F.lit(hi))
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out


def map_values(col: Column | str, mapping: Mapping) -> Column:
    """Look a code up in a small dictionary; unknown codes become NULL."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.try_element_at(F.create_map(*pairs), _col(col))


def date_parts(ts: Column | str, prefix: str = "") -> dict[str, Column]:
    """Hour, Monday-based weekday, weekend, month and holiday-season flags."""
    t = _col(ts)
    return {
        f"{prefix}hour": F.hour(t),
        f"{prefix}day_of_week": F.weekday(t),
        f"{prefix}is_weekend": F.weekday(t).isin(5, 6).cast("int"),
        f"{prefix}month": F.month(t),
        f"{prefix}is_holiday_season": F.month(t).isin(11, 12).cast("int"),
    }


def month_of(ts: Column | str) -> Column:
    return F.date_trunc("month", _col(ts))


def country_group(country: Column | str, home: str, groups: Mapping[str, Sequence[str]],
                  home_label: str = "UK", other: str = "Non_Europe") -> Column:
    c = _col(country)
    out = F.when(c == home, home_label)
    for label, members in groups.items():
        out = out.when(c.isin(*members), label)
    return out.otherwise(other)


def first_token(text: Column | str) -> Column:
    """First whitespace-separated token in upper case; NULL for blank text."""
    t = F.trim(F.regexp_replace(F.upper(F.coalesce(_col(text), F.lit(""))), r"\s+", " "))
    return F.when(t != "", F.split(t, " ")[0])


def matches(text: Column | str, pattern: str) -> Column:
    return F.upper(F.coalesce(_col(text), F.lit(""))).rlike(pattern)


# Chebyshev coefficients of the complementary error function (fixed values, published
# rational approximation with a relative error below 1.2e-7).
_ERFC = (-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806,
         0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277)


def norm_cdf(z: Column | str) -> Column:
    """Standard normal distribution function as a built-in expression."""
    x = _col(z).cast("double")
    u = F.abs(x) / F.lit(2.0 ** 0.5)
    t = F.lit(1.0) / (F.lit(1.0) + u * 0.5)
    poly = F.lit(_ERFC[-1])
    for c in reversed(_ERFC[:-1]):
        poly = F.lit(c) + t * poly
    erfc = t * F.exp(-u * u + poly)
    return F.when(x >= 0, 1.0 - 0.5 * erfc).otherwise(0.5 * erfc)


def one_hot(df: DataFrame, col: str, prefix: str, levels: Sequence[str] | None = None,
            drop_first: bool = True) -> DataFrame:
    """Indicator columns in alphabetical order of levels, the first one dropped.

    Levels become columns, so their number must be small; they are read from the
    data only when not given.
    """
    if levels is None:
        levels = [r[0] for r in df.select(col).where(F.col(col).isNotNull()).distinct().collect()]
    ordered = sorted(levels)[1 if drop_first else 0:]
    return df.withColumns({f"{prefix}_{v}": (F.col(col) == v).cast("int") for v in ordered})
