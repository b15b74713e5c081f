"""Best-fit packing (operator 7): hierarchical residual packing.

1. Every scan task tokenises its documents, cuts those longer than a sequence, and
   best-fits its pieces in blocks of ``block_items``, longest first.  Bins that are nearly
   full are final.
2. The underfull bins become items.  In each round of a tree, groups of ``fan_in``
   partitions are dealt together and best-fitted again, and nearly full bins leave, until
   one partition is left or nothing is underfull.

What goes up the tree is bounded whatever the lengths are.  Of two bins at least one is over
half full, so a bin in which the least of all open bins (a count on each staged round)
has no place is final; and as each block leaves at most one bin that is not over half
full, there are few bins to place: of bins with equal room a task passes ``fan_in`` on
and the others are final.  A task thus reads at most ``fan_in ** 2`` bins a room, and
documents of which no two fit together all leave at once.

A bin is one row with its pieces in an array, at most one entry a token.  Within a block the
items are sorted by (length, doc_id, piece) first, so a task that is run again gives the
same bins.  A task holds the lengths and ids of a block, never token ids of more than a
batch.

Nulls: a null text is an empty text (one token, the end mark); a null doc_id is passed
on.  Repeated rows are packed as separate documents.  An empty table gives an empty
result.  Other columns are ignored.  A text of any length is encoded whole, as one Python
string, and cut.  Ties (equal lengths) go by doc_id, then piece.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, small_batches, stage
from .tokens import token_ids

PIECE = "struct<doc_id:long,piece:int,start:long,length:long,ids_crc32:long,offset:long>"
BIN = f"level int, task long, used int, final boolean, pieces array<{PIECE}>"


def best_fit(items: Iterable[tuple[int, list]], capacity: int) -> list[list]:
    """Bins ``[room, members]`` of ``(length, members)`` items, each put where it leaves least room.

    Rooms are small integers: a bit mask tells which rooms some open bin has, so that the
    smallest one that suffices is found by bit operations.
    """
    bins: list[list] = []
    with_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    mask = 0
    for length, members in items:
        fit = mask >> length
        if fit:
            room = length + (fit & -fit).bit_length() - 1
            at = with_room[room].pop()
            if not with_room[room]:
                mask &= ~(1 << room)
            bins[at][1].extend(members)
        else:
            at, room = len(bins), capacity
            bins.append([0, list(members)])
        bins[at][0] = room = room - length
        if room:
            with_room[room].append(at)
            mask |= 1 << room
    return bins


#: A piece: doc_id, piece, start, length, crc32 of its ids.
Piece = tuple[int | None, int, int, int, int]
KIND = pa.struct([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("offset", pa.int64())])


def _order(item: tuple[int, list[Piece]]) -> tuple:
    doc, piece, _, _, crc = item[1][0]
    return -item[0], doc is None, doc or 0, piece, crc


def _bins(items: list[tuple[int, list[Piece]]], capacity: int, slack: int, level: int, task: int, passed: int) -> Iterator[pa.RecordBatch]:
    """Best-fitted items; of the open bins of each room ``passed`` are not final."""
    items.sort(key=_order)
    found = best_fit(items, capacity)
    open_bins, final = Counter(), []
    for room, _ in found:
        final.append(room <= slack or open_bins[room] >= passed)
        open_bins[room] += 1
    for i in range(0, len(found), 2000):
        part = found[i : i + 2000]
        ends = list(accumulate(len(m) for _, m in part))
        cols = list(zip(*(p for _, m in part for p in m), strict=True))
        places = [x for _, m in part for x in accumulate((p[3] for p in m[:-1]), initial=0)]
        pieces = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip([*cols, places], KIND, strict=True)], fields=list(KIND))
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([level] * len(part), pa.int32()),
                pa.array(range(task + i, task + i + len(part)), pa.int64()),
                pa.array([capacity - room for room, _ in part], pa.int32()),
                pa.array(final[i : i + 2000], pa.bool_()),
                pa.ListArray.from_arrays(pa.array([0, *ends], pa.int32()), pieces),
            ],
            ["level", "task", "used", "final", "pieces"],
        )


def cut(doc_id: int | None, ids: bytes, capacity: int) -> Iterator[Piece]:
    """Pieces of a document's ids (four bytes each); only the first may be shorter than ``capacity``."""
    n = len(ids) // 4
    start, piece, length = 0, 0, (n - 1) % capacity + 1
    while start < n:
        yield doc_id, piece, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])
        start, piece, length = start + length, piece + 1, capacity


@small_batches
def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, slack: int | None = None, fan_in: int = 8, block_items: int = 1 << 16) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32, sequence_id, offset)`` of each piece."""
    slack = capacity // 256 if slack is None else slack

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, end, items = token_ids(tokenizer), np.array([end_id], "<u4").tobytes(), []
        at = TaskContext.get().partitionId() << 32
        for b in slices(batches, "text", 2 << 20, owner="tokens"):
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                items += ((p[3], [p]) for p in cut(doc_id, enc.encode(text or "") + end, capacity))
            if len(items) >= block_items:
                yield from _bins(items, capacity, slack, 0, at, fan_in)
                at, items = at + len(items), []
        if items:
            yield from _bins(items, capacity, slack, 0, at, fan_in)

    def again(level: int, passed: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyspark import TaskContext

            items = []
            for b in slices(batches, owner="tokens"):
                for used, pieces in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    items.append((used, [(p["doc_id"], p["piece"], p["start"], p["length"], p["ids_crc32"]) for p in pieces]))
            if items:
                yield from _bins(items, capacity, slack, level, TaskContext.get().partitionId() << 32, passed)

        return run

    got = stage(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(local, BIN), "bins")
    facts = got.agg(F.max(F.shiftright("task", 32)).alias("width"), F.min(F.when(~F.col("final"), F.col("used"))).alias("least")).first()
    width, done, level = (facts["width"] or 0) + 1, [], 0
    while facts["least"] is not None and width > 1:
        useful = ~F.col("final") & (capacity - F.col("used") >= facts["least"])
        done.append(got.where(~useful))
        level += 1
        width = -(-width // fan_in)
        open_bins = got.where(useful).select("used", "pieces", F.shiftright("task", 32).alias("from"))
        dealt = open_bins.repartitionByRange(width, F.col("from")) if width > 1 else open_bins.coalesce(1)
        got = stage(dealt.select("used", "pieces").mapInArrow(again(level, fan_in), BIN), "bins")
        facts = got.agg(F.min(F.when(~F.col("final"), F.col("used"))).alias("least")).first()
    bins = got
    for x in done:
        bins = bins.union(x)
    placed = bins.select((F.col("task") + F.shiftleft(F.col("level").cast("long"), 56)).alias("sequence_id"), F.explode("pieces").alias("p"))
    return placed.select("p.doc_id", "p.piece", "p.start", "p.length", "p.ids_crc32", "sequence_id", "p.offset")
