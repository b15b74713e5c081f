"""Helpers that several operators share: staged tables, size-checked joins, arrow plumbing, components."""

from __future__ import annotations

import ctypes
import functools
import re
import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.graph import component_labels as components
from ..operators.staging import shared_dir, stage, unstage

#: A side of a join is broadcast only when its counted rows times its row width, as a hashed relation holds it, stay below this.
BROADCAST_BYTES = 24 << 20
#: What a hashed relation adds to a row.
ROW_OVERHEAD = 48

#: ``[^\x20\x09-\x0D]+``: a word of the contracts.
WORD = re.compile(r"[^\x20\x09-\x0D]+")

U64 = np.uint64

#: Bits of a row of marks, and the most bits that marks take (8 MB, which is broadcast).
MARK_ROW, MARKS = 1 << 15, 1 << 26

__all__ = ["WORD", "components", "counted_broadcasts", "fresh", "give_back", "join_counted", "mix64", "planned_with", "shared_dir", "sized", "slices", "small_batches", "split_by_marks", "stage", "unstage", "whole_row", "windows_hash"]


def sized(df: DataFrame, row_bytes: int) -> DataFrame:
    """``df`` with a broadcast hint if its counted size is below ``BROADCAST_BYTES``, else ``df`` for a shuffled join.

    ``df`` should be a staged table: counting it must be cheap.
    """
    return F.broadcast(df) if df.count() * (row_bytes + ROW_OVERHEAD) <= BROADCAST_BYTES else df


def join_counted(rows: DataFrame, table: DataFrame, keys: list[str], total: int, hot: int = 1000) -> DataFrame:
    """``rows`` joined with ``table``, which has one row a key with the key's count of rows in ``k``; no task gets all rows of a hot key.

    ``table`` is a staged table.  Hot keys are those with more than ``hot`` rows and a
    ten-thousandth of all; they are at most 10,000, are broadcast, and their rows stay where they are.
    """
    bound = max(hot, total // 10_000)
    if table.count() <= 10_000:
        return rows.join(F.broadcast(table.drop("k")), keys)
    many, few = table.where(F.col("k") > bound).drop("k"), table.where(F.col("k") <= bound).drop("k")
    return rows.join(F.broadcast(many), keys).unionByName(rows.join(F.broadcast(many.select(*keys)), keys, "left_anti").join(few, keys))


def split_by_marks(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` whose doc_id may be in ``ids``, and the rest; no row is shuffled.

    The first part has all rows whose doc_id is there and about one in sixteen of the others
    (more beyond 4 million ids), so a join must follow; the rest has none.  ``ids`` is a staged
    table with a doc_id of type long; what is broadcast is a bitmap of its hashes, two bytes an id.
    """
    ids = ids.select("doc_id").distinct()
    n_bits = min(MARKS, max(1, -(-16 * ids.count() // MARK_ROW)) * MARK_ROW)
    at = F.pmod(F.xxhash64("doc_id"), F.lit(n_bits)) + 1  # the bitmap functions count from 1
    bits = stage(ids.select(at.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("_slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("_bits")), "marks")
    place = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring("_bits", (F.floor(place / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    marked = F.col("doc_id").isNotNull() & F.coalesce(F.getbit(byte, (place % 8).cast("int")) == 1, F.lit(False))
    both = rows.withColumn("_slot", F.bitmap_bucket_number(at)).join(F.broadcast(bits), "_slot", "left")
    return both.where(marked).select(*rows.columns), both.where(~marked).select(*rows.columns)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that ``df`` doesn't have, made of ``names``."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n += "_"
        taken.add(n.lower())
        out.append(n)
    return out


def whole_row(df: DataFrame) -> Column:
    """All columns of ``df``, whatever their names, as one struct."""
    return F.struct(*(F.col(f"`{c.replace('`', '``')}`") for c in df.columns))


def planned_with(**settings: str):
    """Run what ``operator(df, ...)`` plans and stages with these SQL settings of the session, and put them back."""
    names = {f"spark.sql.{k.replace('__', '.')}": v for k, v in settings.items()}

    def wrap(operator):
        @functools.wraps(operator)
        def run(df: DataFrame, *args, **kwargs):
            conf = df.sparkSession.conf
            before = {k: conf.get(k, None) for k in names}
            try:
                for k, v in names.items():
                    conf.set(k, v)
                return operator(df, *args, **kwargs)
            finally:
                for k, v in before.items():
                    if v is None:
                        conf.unset(k)
                    else:
                        conf.set(k, v)

        return run

    return wrap


#: Small Arrow batches: wide rows would else fill them with tens of MB a task.
small_batches = planned_with(execution__arrow__maxBytesPerBatch=str(8 << 20))
#: Joins are broadcast by a hint behind a count only.  A hashed relation with a key of two columns
#: takes at least a page (16 MB or more on an executor) however small it is, and an operator of
#: many joins would hold dozens of them until the driver collects its garbage.
counted_broadcasts = planned_with(autoBroadcastJoinThreshold="-1", adaptive__autoBroadcastJoinThreshold="-1")


def slices(batches: Iterator[pa.RecordBatch], text: str | None = None, max_bytes: int = 4 << 20, max_rows: int = 4096, owner: str | None = None) -> Iterator[pa.RecordBatch]:
    """Cut batches so that the text in one piece stays near ``max_bytes`` (a longer single row is a piece of its own).

    The worker process lives on for other tasks and operators, so before and after a
    task it gives back what only others, or nobody, can use again; see ``give_back``.
    """
    give_back(owner)
    try:
        yield from _slices(batches, text, max_bytes, max_rows)
    finally:
        give_back(owner)


#: Caches of this worker process that are cheap to fill again.
CACHES: list[dict] = []
#: What takes longer to make: by owner, how to drop it.
HOLDERS: dict[str, Callable[[], None]] = {}


def give_back(owner: str | None = None) -> None:
    """Empty the cheap caches, drop what others than ``owner`` hold, and return freed memory to the system."""
    for c in CACHES:
        c.clear()
    for name, release in HOLDERS.items():
        if name != owner:
            release()
    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def _slices(batches: Iterator[pa.RecordBatch], text: str | None, max_bytes: int, max_rows: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if text is None:
            for i in range(0, b.num_rows, max_rows):
                yield b.slice(i, max_rows)
            continue
        col = b.column(b.schema.names.index(text))
        n = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        i, total = 0, 0
        for j in range(len(n)):
            if j > i and (total + n[j] > max_bytes or j - i >= max_rows):
                yield b.slice(i, j - i)
                i, total = j, 0
            total += int(n[j])
        if i < len(n):
            yield b.slice(i)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(33))
    x = x * U64(0xFF51AFD7ED558CCD)
    x ^= x >> U64(33)
    x *= U64(0xC4CEB9FE1A85EC53)
    x ^= x >> U64(33)
    return x


def windows_hash(h: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of ``k`` consecutive entries of ``h``; depends on nothing else."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    mul, out, span, at = U64(0x9E3779B97F4A7C15), None, h, 0
    width, factor = 1, mul
    left = k
    while left:  # binary powering: the hash of a run is the hash of its left part times a power plus that of its right part
        if left & 1:
            part = span[at : at + n]
            out = part.copy() if out is None else out * factor + part
            at += width
        left >>= 1
        if left:
            span = span[: len(span) - width] * factor + span[width:]
            with np.errstate(over="ignore"):
                factor = factor * factor
            width *= 2
    return mix64(out)
