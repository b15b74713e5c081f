"""Calendar slices of a dated table."""

from __future__ import annotations

from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import column, require_columns


def _next(day: date, freq: str) -> date:
    """The first day of the period after that of ``day``; weeks begin on Sunday."""
    if freq == "D":
        return day + timedelta(1)
    if freq == "W":
        return day + timedelta(7 - (day.weekday() + 1) % 7)
    months = {"M": 1, "Q": 3, "Y": 12}[freq]
    m = day.year * 12 + (day.month - 1) // months * months + months
    return date(m // 12, m % 12 + 1, 1)


def _label(day: date, freq: str) -> str:
    return {"D": f"{day:%Y-%m-%d}", "W": f"{day:%Y-W%U}", "M": f"{day:%Y-%m}", "Q": f"{day.year}-Q{(day.month + 2) // 3}", "Y": f"{day.year}"}[freq]


def temporal_slices(df: DataFrame, date_col: str, freq: str = "M") -> list[tuple[str, date, date, DataFrame]]:
    """``(label, start, end, rows)`` of each calendar period (D, W, M, Q, Y), clipped to the dates that occur; the rows are lazy filters."""
    freq = str(freq).upper()
    if freq not in ("D", "W", "M", "Q", "Y"):
        raise ValueError("freq must be D, W, M, Q or Y")
    require_columns(df, [date_col])
    day = column(df, date_col).cast("date")
    low, high = df.agg(F.min(day), F.max(day)).first()
    out = []
    while low is not None and low <= high:
        nxt = _next(low, freq)
        end = min(nxt - timedelta(1), high)
        out.append((_label(low, freq), low, end, df.where(day.between(F.lit(low), F.lit(end)))))
        low = nxt
    return out


def label_slices(df: DataFrame, date_col: str, freq: str = "M") -> DataFrame:
    """The same as one table with a ``slice`` start column: no job a period, for long ranges."""
    freq = str(freq).upper()
    d = column(df, date_col).cast("date")
    if freq == "D":
        start = d
    elif freq == "W":
        start = F.date_sub(d, F.dayofweek(d) - 1)
    else:
        start = F.trunc(d, {"M": "month", "Q": "quarter", "Y": "year"}[freq])
    return df.withColumn("slice", start)
