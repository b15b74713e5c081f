"""Token-ID / binary output (operator 4): training-order materialisation.

1. Each document's ids and an end mark are cut into sequences of ``length`` tokens; the last
   is padded.  A task numbers its sequences; the tasks' counts give every sequence an
   ordinal below n.  This table is staged, so the numbering is fixed once.
2. A keyed Feistel network over the smallest even-bit domain that holds n, with cycle
   walking (a value of n or more goes through the network again), is a permutation of
   0 .. n-1: the sequence's global slot, known without any sort.
3. Slots are split in ranges of ``shard_rows``.  Each range becomes one shard, written as
   pages of fixed-stride sequences in slot order: sequence j of a page lies at byte
   j * stride.  ``read_slots`` resumes at any slot, ``export_files`` writes plain files.

Nulls: a null text is an empty text (one sequence with the end mark); a null doc_id is
passed on.  Repeated rows are separate documents.  An empty table gives an empty
result.  Other columns are ignored.  Texts of any length are cut, never dropped.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import U64, give_back, mix64, shared_dir, slices, small_batches, stage, unstage
from .tokens import token_ids

PAGE_ROWS = 512


def feistel(x: np.ndarray, n: int, key: int, rounds: int = 6) -> np.ndarray:
    """A keyed permutation of ``0 .. n-1``, applied to ``x``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, shift = U64((1 << half) - 1), U64(half)
    subkeys = mix64(np.arange(1, rounds + 1, dtype=np.uint64) * U64(0x9E3779B97F4A7C15) + U64(key & 0xFFFFFFFFFFFFFFFF))
    out = x.astype(np.uint64)
    todo = np.arange(len(out))
    while len(todo):
        left, right = out[todo] >> shift, out[todo] & mask
        for k in subkeys:
            left, right = right, left ^ (mix64(right + k) & mask)
        out[todo] = (left << shift) | right
        todo = todo[out[todo] >= U64(n)]
    return out.astype(np.int64)


PAGES = "shard long, page int, first_slot long, n int, stride int, data binary, doc_ids array<long>, starts array<long>, lengths array<int>"


@small_batches
def write_shards(docs: DataFrame, tokenizer: str, path: str | None = None, key: int = 20260101, length: int = 512, shard_rows: int = 8192, end_id: int = 0) -> DataFrame:
    """Write the shards as a Parquet table of pages at ``path`` (default: the shared folder) and return it."""
    spark = docs.sparkSession
    kind = np.dtype("<u2")
    stride = length * kind.itemsize

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        enc, pid, idx = token_ids(tokenizer), TaskContext.get().partitionId(), 0
        if enc.lib.get_vocab_size() > 1 << 16:
            raise ValueError("ids need more than two bytes")
        for b in slices(batches, "text", 2 << 20, owner="tokens"):
            ids, starts, data = [], [], []
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = np.frombuffer(enc.encode(text or ""), "<u4").astype(kind).tobytes() + np.array([end_id], kind).tobytes()
                for at in range(0, len(x), stride):
                    ids.append(doc)
                    starts.append(at // kind.itemsize)
                    data.append(x[at : at + stride])
            yield pa.RecordBatch.from_arrays([pa.array([pid] * len(ids), pa.int32()), pa.array(range(idx, idx + len(ids)), pa.int64()), pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(data, pa.binary())], ["pid", "idx", "doc_id", "start", "data"])
            idx += len(ids)

    staged = stage(docs.select("doc_id", "text").mapInArrow(cut, "pid int, idx long, doc_id long, start long, data binary"), "sequences", "zstd")
    # one count a task
    counts = {r["pid"]: r["n"] for r in staged.groupBy("pid").agg(F.count("*").alias("n")).collect()}
    pids = sorted(counts)
    total = sum(counts.values())
    firsts = np.zeros(max(pids, default=0) + 1, np.int64)
    firsts[pids] = np.cumsum([0] + [counts[p] for p in pids])[:-1] if pids else 0

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        import zstandard

        z = zstandard.ZstdCompressor(level=3)
        for b in slices(batches, "data", 16 << 20, 65536):
            slot = feistel(firsts[b.column(0).to_numpy()] + b.column(1).to_numpy(), total, key)
            shard = slot // shard_rows
            o = np.argsort(shard, kind="stable")
            cuts = np.flatnonzero(np.r_[True, shard[o][1:] != shard[o][:-1], True])
            data, ids, starts = b.column(4).to_pylist(), b.column(2).to_pylist(), b.column(3).to_pylist()
            rows = []
            for a, e in zip(cuts[:-1], cuts[1:], strict=True):
                part = o[a:e].tolist()
                rows.append((int(shard[part[0]]), z.compress(pickle.dumps([(int(slot[i]), ids[i], starts[i], data[i]) for i in part]))))
            yield pa.RecordBatch.from_arrays([pa.array([s for s, _ in rows], pa.int64()), pa.array([d for _, d in rows], pa.binary())], ["shard", "blob"])

    def lay(t: pa.Table) -> pa.Table:
        import pickle

        import zstandard

        give_back()
        z = zstandard.ZstdDecompressor()
        shard = t.column("shard")[0].as_py()
        rows = sorted((r for blob in t.column("blob") for r in pickle.loads(z.decompress(blob.as_py()))), key=lambda r: r[0])
        pages = [rows[i : i + PAGE_ROWS] for i in range(0, len(rows), PAGE_ROWS)]
        n = len(pages)
        return pa.table(
            {
                "shard": pa.array([shard] * n, pa.int64()),
                "page": pa.array(range(n), pa.int32()),
                "first_slot": pa.array([p[0][0] for p in pages], pa.int64()),
                "n": pa.array([len(p) for p in pages], pa.int32()),
                "stride": pa.array([stride] * n, pa.int32()),
                "data": pa.array([b"".join(r[3].ljust(stride, b"\0") for r in p) for p in pages], pa.binary()),
                "doc_ids": pa.array([[r[1] for r in p] for p in pages], pa.list_(pa.int64())),
                "starts": pa.array([[r[2] for r in p] for p in pages], pa.list_(pa.int64())),
                "lengths": pa.array([[len(r[3]) // kind.itemsize for r in p] for p in pages], pa.list_(pa.int32())),
            }
        )

    pages = staged.mapInArrow(deal, "shard long, blob binary").groupBy("shard").applyInArrow(lay, PAGES)
    if path is None:
        import uuid

        path = f"{shared_dir(spark)}/shards-{uuid.uuid4().hex}"
    pages.write.option("compression", "zstd").parquet(path)
    unstage(staged)
    return spark.read.schema(pages.schema).parquet(path)


def read_slots(pages: DataFrame, first: int = 0) -> DataFrame:
    """``(slot, shard, doc_id, start, length, ids_crc32)`` of the written sequences from slot ``first`` on.

    Pages before it are skipped by their statistics.  ``ids_crc32`` is over the ids as
    little-endian unsigned 32-bit integers.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, None, max_rows=8):
            out = []
            for shard, at, stride, data, ids, starts, lengths in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for j, (doc, start, n) in enumerate(zip(ids, starts, lengths, strict=True)):
                    x = np.frombuffer(data, "<u2", n, j * stride).astype("<u4")
                    out.append((at + j, shard, doc, start, n, zlib.crc32(x.tobytes())))
            cols = list(zip(*out, strict=True)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["slot", "shard", "doc_id", "start", "length", "ids_crc32"])

    picked = pages.where(F.col("first_slot") + F.col("n") > first).select("shard", "first_slot", "stride", "data", "doc_ids", "starts", "lengths")
    return picked.mapInArrow(run, "slot long, shard long, doc_id long, start long, length long, ids_crc32 long").where(F.col("slot") >= first)


def export_files(pages: DataFrame, uri: str) -> DataFrame:
    """Write each shard as one plain file of fixed-stride sequences below ``uri`` (file, hdfs, s3, ... as pyarrow.fs knows them).

    A shard is written under a name of its own task and then renamed, so a task that runs
    again leaves a whole file.  Returns ``(shard, file, n)``.
    """

    def run(t: pa.Table) -> pa.Table:
        import uuid

        from pyarrow import fs

        system, base = fs.FileSystem.from_uri(uri)
        shard = t.column("shard")[0].as_py()
        name = f"{base.rstrip('/')}/shard-{shard:08d}.bin"
        own = f"{name}.{uuid.uuid4().hex}"
        t = t.sort_by("page")
        system.create_dir(base, recursive=True)
        with system.open_output_stream(own) as f:
            for x in t.column("data"):
                f.write(x.as_buffer())
        system.move(own, name)
        return pa.table({"shard": pa.array([shard], pa.int64()), "file": [name], "n": pa.array([sum(t.column("n").to_pylist())], pa.int64())})

    return pages.select("shard", "page", "n", "data").groupBy("shard").applyInArrow(run, "shard long, file string, n long")
