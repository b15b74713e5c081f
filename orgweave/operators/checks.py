"""Checks of keys: one aggregation for all counts of a table."""

from __future__ import annotations

from datetime import date, datetime, timezone

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import column, require_columns


def as_date(value: object) -> date | None:
    """A date from a date, datetime or ISO string; None if it is none of them."""
    if isinstance(value, datetime):
        return value.date()
    if isinstance(value, date):
        return value
    try:
        return datetime.fromisoformat(str(value)).date()
    except ValueError:
        return None


def today() -> date:
    return datetime.now(timezone.utc).date()


def check_key(df: DataFrame, key: str, others: tuple[str, ...] = ()) -> None:
    """Columns exist, ``key`` is never null and never repeated."""
    require_columns(df, (key, *others))
    c = column(df, key)
    row = df.agg(F.count_if(c.isNull()).alias("nulls"), (F.count(c) - F.countDistinct(c)).alias("repeated")).first()
    if row["nulls"]:
        raise ValueError(f"column {key!r} has {row['nulls']} NULL value(s)")
    if row["repeated"]:
        raise ValueError(f"column {key!r} has {row['repeated']} duplicate value(s)")


def validate_keys(df: DataFrame, id_col: str = "employee_id", date_col: str | None = None, *, date_lower: object = None, date_upper: object = None, name: str = "table") -> None:
    """Raise on null or blank ids, repeated ids (by date, where a date column is there), future dates and dates out of bounds."""
    require_columns(df, [id_col])
    dated = date_col is not None and date_col in df.columns
    bounds = {"lower": date_lower, "upper": date_upper}
    for k, v in bounds.items():
        if v is not None:
            if not dated:
                raise ValueError(f"{name}: a date bound needs a date column")
            bounds[k] = as_date(v)
            if bounds[k] is None:
                raise ValueError(f"{name}: the {k} date bound {v!r} is no date")
    i = column(df, id_col)
    counts = {"blank": F.count_if(i.isNull() | (i.cast("string") == ""))}
    if dated:
        d = column(df, date_col)
        day = d.cast("date")
        counts |= {"repeated": F.count("*") - F.countDistinct(F.struct(i, d)), "future": F.count_if(day > F.lit(today()))}
        if bounds["lower"]:
            counts["low"] = F.count_if(day < F.lit(bounds["lower"]))
        if bounds["upper"]:
            counts["high"] = F.count_if(day > F.lit(bounds["upper"]))
    else:
        counts["repeated"] = F.count(i) - F.countDistinct(i)
    row = df.agg(*(c.alias(k) for k, c in counts.items())).first().asDict()
    says = {
        "blank": f"NULL or empty value(s) in {id_col!r}",
        "repeated": f"duplicate row(s) of ({id_col}, {date_col})" if dated else f"duplicate value(s) in {id_col!r}",
        "future": f"future date(s) in {date_col!r}",
        "low": f"date(s) before {bounds['lower']} in {date_col!r}",
        "high": f"date(s) after {bounds['upper']} in {date_col!r}",
    }
    for k in says:
        if row.get(k):
            raise ValueError(f"{name}: {row[k]} {says[k]}")
