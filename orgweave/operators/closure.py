"""All ancestors of every employee, by pointer doubling.

A reporting table points each employee to one supervisor, so the rows of depth s joined
with all rows of depth up to s give all of depth up to 2s: log2(max_depth) joins.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.ident import blank_to_null, column
from .staging import stage, unstage


def reporting(df: DataFrame, employee: str, supervisor: str) -> DataFrame:
    """``(emp, sup)``, blank supervisors as null."""
    return df.select(column(df, employee).alias("emp"), blank_to_null(column(df, supervisor)).alias("sup"))


def ancestors(df: DataFrame, employee: str, supervisor: str, max_depth: int, with_path: bool = False) -> DataFrame:
    """``(emp, anc, depth[, tail])``: every proper ancestor up to ``max_depth``; cycles repeat up to it.

    ``tail`` is ``->mgr->...->anc``.  Depth 1 is there whatever ``max_depth``.
    """
    base = reporting(df, employee, supervisor).where("sup is not null")
    cols = [F.col("emp"), F.col("sup").alias("anc"), F.lit(1).alias("depth")]
    if with_path:
        cols.append(F.concat(F.lit("->"), F.col("sup").cast("string")).alias("tail"))
    every, span = stage(base.select(*cols), "closure"), 1
    parts = [every]
    while span < max_depth:
        edge = every.where(F.col("depth") == span).alias("j")
        step = edge.join(every.alias("l"), F.col("j.anc") == F.col("l.emp")).where(F.lit(span) + F.col("l.depth") <= max_depth)
        cols = [F.col("j.emp"), F.col("l.anc"), (F.lit(span) + F.col("l.depth")).alias("depth")]
        if with_path:
            cols.append(F.concat("j.tail", "l.tail").alias("tail"))
        more = stage(step.select(*cols), "closure")
        if not more.limit(1).count():
            unstage(more)
            break
        parts.append(more)
        every = parts[0]
        for p in parts[1:]:
            every = every.union(p)
        span *= 2
    return every


def in_loops(df: DataFrame, employee: str, supervisor: str) -> DataFrame:
    """``(emp)``: employees whose upward walk never ends, as they are in a cycle or below one.

    Jump pointers are doubled; who has no pointer left drops out at each round, so rounds
    past the depth of the tree see only what hangs on cycles.
    """
    rows = reporting(df, employee, supervisor)
    state = stage(rows.where("sup is not null").select("emp", F.col("sup").alias("to")), "jump")
    n = rows.count()
    for _ in range(max(1, n).bit_length()):
        nxt = stage(state.alias("a").join(state.alias("b"), F.col("a.to") == F.col("b.emp")).select("a.emp", "b.to"), "jump")
        unstage(state)
        state = nxt
        if not state.limit(1).count():
            break
    return state.select("emp")
