"""Names of columns and tables."""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SAFE = re.compile(r"^[A-Za-z_][A-Za-z0-9_]*$")


def quote(name: str) -> str:
    """A column name in backticks."""
    if not isinstance(name, str) or not name:
        raise ValueError("a column name must be a non-empty string")
    return "`" + name.replace("`", "``") + "`"


def column(df: DataFrame, name: str) -> Column:
    return df[quote(name)]


def table_name(name: str) -> str:
    if not isinstance(name, str) or not SAFE.match(name):
        raise ValueError(f"invalid table name {name!r}: letters, digits and underscores only")
    return name


def require_frame(df: object) -> DataFrame:
    """``df`` if it is a DataFrame of classic Spark or Connect."""
    if not (isinstance(df, DataFrame) or all(hasattr(df, a) for a in ("sparkSession", "schema", "groupBy"))):
        raise TypeError(f"expected a Spark DataFrame, got {type(df).__name__}")
    return df


def require_columns(df: DataFrame, names: Iterable[str]) -> None:
    for n in names:
        quote(n)
    missing = [n for n in names if n not in df.columns]
    if missing:
        raise ValueError(f"column(s) not found in relation: {missing}; available: {sorted(df.columns)}")


def blank_to_null(c: Column) -> Column:
    """Null where the value is null or prints as an empty string; the type stays."""
    return F.when(c.isNull() | (c.cast("string") == ""), None).otherwise(c)
