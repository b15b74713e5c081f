"""Cleaning of tables and assembly of edges and metrics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ident import blank_to_null, column, require_columns
from .checks import as_date, today


def filter_noise(df: DataFrame, *, id_col: str = "employee_id", date_col: str | None = None, test_ids: Sequence | None = None, bots: Sequence | None = None, min_records: int = 1) -> DataFrame:
    """Rows with an id that is no test id or bot, a known past date (if ``date_col`` is there), and enough rows left."""
    require_columns(df, [id_col])
    i = column(df, id_col)
    keep = i.isNotNull()
    for ids in (test_ids, bots):
        if ids:
            keep &= ~i.isin(list(ids))
    if date_col is not None and date_col in df.columns:
        keep &= F.coalesce(column(df, date_col).try_cast("date") <= F.lit(today()), F.lit(False))
    out = df.where(keep)
    if min_records > 1:  # a semi join with partial counts: no row moves to count it
        many = out.groupBy(column(out, id_col).alias("_id")).agg(F.count("*").alias("_n")).where(F.col("_n") >= min_records)
        out = out.join(many, column(out, id_col) == many["_id"], "left_semi")
    return out


def deduplicate(df: DataFrame, *, id_col: str = "employee_id", date_col: str | None = None, keep: str | bool = "last", order_by: str | Column | None = None) -> DataFrame:
    """One row a key, the first or last by ``order_by``, or with ``keep=False`` only rows whose key is alone.  Null keys are equal.

    Without ``order_by`` the rows' order in their partitions decides, which a file scan
    fixes but a shuffle does not.
    """
    keys = [id_col] if date_col is None else [id_col, date_col]
    require_columns(df, keys)
    cols = [F.col(f"`{k}`") for k in keys]
    if keep is False:
        return df.withColumn("_n", F.count("*").over(Window.partitionBy(*cols))).where("_n = 1").drop("_n")
    if keep not in ("first", "last"):
        raise ValueError("keep must be 'first', 'last' or False")
    order = F.monotonically_increasing_id() if order_by is None else F.col(order_by) if isinstance(order_by, str) else order_by
    df2 = df.withColumn("_o", order)
    w = Window.partitionBy(*cols).orderBy(F.asc("_o") if keep == "first" else F.desc("_o"))
    return df2.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n", "_o")


def build_org_edges(df: DataFrame, employee_id_col: str = "employee_id", supervisor_id_col: str = "supervisor_id", active_as_of: object = None, date_col: str | None = None) -> DataFrame:
    """Distinct (employee, supervisor) pairs, both columns under their own names; optionally only of rows dated up to a day."""
    require_columns(df, [employee_id_col, supervisor_id_col])
    if active_as_of is not None:
        day = as_date(active_as_of)
        if day is None:
            raise ValueError(f"active_as_of {active_as_of!r} is no date")
        date_col = date_col or next((c for c in df.columns if "date" in c.lower()), None)
        if date_col is None:
            raise ValueError("active_as_of needs a date column")
        df = df.where(column(df, date_col).cast("date") <= F.lit(day))
    sup = blank_to_null(column(df, supervisor_id_col))
    return df.where(sup.isNotNull()).select(column(df, employee_id_col), column(df, supervisor_id_col)).distinct()


def join_metrics(hris: DataFrame, metrics: DataFrame, hris_id: str = "employee_id", metric_id: str = "node_id", how: str = "inner") -> DataFrame:
    """HR rows with their metrics; the metrics' id column is left out.  Spark broadcasts whichever side its size allows."""
    require_columns(hris, [hris_id])
    require_columns(metrics, [metric_id])
    m = metrics.withColumnRenamed(metric_id, "_metric_id")
    return hris.join(m, column(hris, hris_id) == m["_metric_id"], how).drop("_metric_id")
