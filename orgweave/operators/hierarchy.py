"""Operators on the reporting table: validation, long and wide form, span of control."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import SAFE, require_frame
from .checks import check_key
from .closure import ancestors, in_loops, reporting


def _checked(df: DataFrame, employee_id: str, supervisor_id: str) -> DataFrame:
    check_key(require_frame(df), employee_id, (supervisor_id,))
    return df


def hierarchy_valid(df: DataFrame, employee_id: str, supervisor_id: str) -> DataFrame:
    """``(issue_type, employee_id, detail)``: self references, broken chains, several roots, loops.

    ``employee_id`` is a string.  Who is in a cycle or below one is in a loop, so a self
    reference is reported as both.
    """
    rows = reporting(_checked(df, employee_id, supervisor_id), employee_id, supervisor_id)
    text = lambda c: F.col(c).cast("string")
    issue = lambda kind, who, detail: (F.lit(kind).alias("issue_type"), who.alias("employee_id"), detail.alias("detail"))
    own = rows.where("emp = sup").select(*issue("self_reference", text("emp"), F.lit("Employee reports to themselves")))
    known = rows.select(F.col("emp").alias("sup"))
    broken = rows.where("sup is not null").join(known, "sup", "left_anti")
    broken = broken.select(*issue("broken_chain", text("emp"), F.concat(F.lit("Supervisor ID "), text("sup"), F.lit(" does not appear as any employee"))))
    roots = rows.agg(F.count_if(F.col("sup").isNull()).alias("n")).where("n > 1")
    roots = roots.select(*issue("multiple_roots", F.lit(None).cast("string"), F.concat(F.lit("Found "), text("n"), F.lit(" employees with no supervisor"))))
    n = rows.count()
    loops = in_loops(df, employee_id, supervisor_id).select(*issue("loop", text("emp"), F.lit(f"Cycle detected \N{EM DASH} walk exceeded {n} levels")))
    return own.unionByName(broken).unionByName(roots).unionByName(loops)


def hierarchy_long(df: DataFrame, employee_id: str, supervisor_id: str, max_depth: int = 50) -> DataFrame:
    """``(employee_id, supervisor_id, depth, path)``: a row for each employee and proper ancestor."""
    rows = ancestors(_checked(df, employee_id, supervisor_id), employee_id, supervisor_id, max_depth, with_path=True)
    path = F.concat(F.col("emp").cast("string"), F.col("tail"))
    return rows.select(F.col("emp").alias("employee_id"), F.col("anc").alias("supervisor_id"), "depth", path.alias("path")).orderBy("employee_id", "depth")


def hierarchy_wide(df: DataFrame, employee_id: str, supervisor_id: str, max_depth: int = 15, level_prefix: str = "Level_", include_roots: bool = False) -> DataFrame:
    """The caller's id column and ``{prefix}1 .. {prefix}N``: an employee's ancestors, nearest first.

    Deeper chains are cut; employees without a supervisor are left out unless ``include_roots``.
    """
    if not isinstance(max_depth, int) or not 1 <= max_depth <= 100:
        raise ValueError("max_depth must be 1 to 100 (default 15)")
    if not SAFE.match(level_prefix or ""):
        raise ValueError(f"invalid level_prefix {level_prefix!r}")
    rows = ancestors(_checked(df, employee_id, supervisor_id), employee_id, supervisor_id, max_depth)
    levels = [F.first(F.when(F.col("depth") == k, F.col("anc")), ignorenulls=True).alias(f"{level_prefix}{k}") for k in range(1, max_depth + 1)]
    wide = rows.groupBy("emp").agg(*levels)
    if include_roots:
        wide = reporting(df, employee_id, supervisor_id).select("emp").join(wide, "emp", "left")
    return wide.withColumnRenamed("emp", employee_id).orderBy(f"`{employee_id}`")


def hierarchy_stats(df: DataFrame, employee_id: str, supervisor_id: str, max_depth: int = 50) -> DataFrame:
    """``(manager_id, direct_reports, indirect_reports, total_reports, team_size, levels_below)`` of everyone named as supervisor."""
    rows = ancestors(_checked(df, employee_id, supervisor_id), employee_id, supervisor_id, max_depth)
    per = rows.groupBy(F.col("anc").alias("manager_id")).agg(
        F.countDistinct(F.when(F.col("depth") == 1, F.col("emp"))).alias("direct_reports"),
        F.countDistinct("emp").alias("total_reports"),
        F.max("depth").alias("levels_below"),
    )
    out = per.select("manager_id", "direct_reports", (F.col("total_reports") - F.col("direct_reports")).alias("indirect_reports"), "total_reports", F.col("total_reports").alias("team_size"), "levels_below")
    return out.orderBy(F.desc("total_reports"), "manager_id")


valid, long, wide, stats = hierarchy_valid, hierarchy_long, hierarchy_wide, hierarchy_stats
