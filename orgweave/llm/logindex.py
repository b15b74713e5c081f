"""Substring dedup (operator 8) over a log-structured fingerprint index.

A word goes when it is covered by a window of ``width`` words that also starts in a
document with a smaller doc_id.

The index.  Every window of ``width`` words has an anchor: the leftmost least of the hashes
of its ``GRAM``-word grams.  Equal windows have equal anchors, so the index needs one
fingerprint (64 bits) and doc_id for each anchor of a document, about one in seventeen
words.  A batch of documents becomes a sorted immutable run (a bucketed, sorted
table).  The new run is merge-joined with the runs of history, which needs no shuffle; the
fingerprints that two documents share are its hits, of both the batch and history.  When
``fan_in`` runs of a level have gathered, they are compacted into one of the next level.

Verification.  Of the hits, each document sends the words that the anchor's windows
span.  Texts without hits stay where they are, and so do those without verdicts when the
others are cut.  Windows are compared word by word in buckets of the fingerprint.  Where a slice of a
task holds equal contexts, only that of the least doc_id is sent, so a passage of a third
of all documents is an entry a slice.  The least doc_id of each window decides, whatever
batches its documents came in.

Calls.  Without a name the index lives for one call.  With one it stays, and a later call
with the same name judges its documents against all earlier ones, too: ``history`` must
hold their texts for the verification, of which only documents with hits are sent.  Earlier
documents are not judged again, so an incremental corpus should count its doc_ids upwards.

Nulls: a null text has no words; a row with a null doc_id neither removes nor loses
anything.  Rows with the same doc_id count as one document.  Texts under ``width`` words
lose nothing.  An empty table gives an empty result.  Other columns are ignored by
``substring_dedup``.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections import defaultdict
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import WORD, counted_broadcasts, give_back, mix64, slices, small_batches, split_by_marks, stage, windows_hash
from .flat import word_hashes

GRAM = 16
U64 = np.uint64


def word_anchors(h: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``(fingerprint, q, first, last)`` of the anchors of one document's word hashes: place, and first and last window."""
    none = np.zeros(0, np.int64)
    if len(h) < width:
        return np.zeros(0, np.uint64), none, none, none
    g = windows_hash(h, GRAM)
    w = width - GRAM + 1
    x = (g & U64(0xFFFFFFFF00000000)) | np.arange(len(g), dtype=np.uint64)
    span = 1
    while span * 2 <= w:
        x = np.minimum(x[:-span], x[span:])
        span *= 2
    if w > span:
        x = np.minimum(x[: len(x) - (w - span)], x[w - span :])
    q = (x & U64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]])
    return mix64(g[q[first]]), q[first], first, np.r_[first[1:] - 1, len(q) - 1]


class LogIndex:
    """Runs of ``(fp, doc_id)`` by level, each bucketed and sorted by fp; tables of the session's warehouse.

    A table's name holds the index's name, buckets and the run's level, so an index is
    found again by its name; ``n_buckets`` then is that of its runs.  A call that is lost between writing a
    compacted run and dropping its parts leaves both, which changes no hit.
    """

    def __init__(self, spark: SparkSession, n_buckets: int, fan_in: int = 3, name: str | None = None):
        if name is not None and not re.fullmatch("[a-z][a-z0-9_]*", name):
            raise ValueError(f"index name {name!r} must be lower-case letters, digits and _")
        self.spark, self.n_buckets, self.fan_in = spark, n_buckets, fan_in
        self.levels: dict[int, list[str]] = defaultdict(list)
        self.keeps = name is not None
        self.name = f"run_{name or uuid.uuid4().hex[:12]}"
        for table in spark.catalog.listTables(pattern=f"{self.name}_b*") if self.keeps else ():
            if found := re.fullmatch(rf"{self.name}_b(\d+)_l(\d+)_[0-9a-f]+", table.name):
                self.n_buckets = int(found[1])
                self.levels[int(found[2])].append(table.name)

    def _write(self, rows: DataFrame, level: int) -> str:
        name = f"{self.name}_b{self.n_buckets}_l{level}_{uuid.uuid4().hex[:12]}"
        rows.repartition(self.n_buckets, "fp").write.bucketBy(self.n_buckets, "fp").sortBy("fp").format("parquet").saveAsTable(name)
        self.levels[level].append(name)
        return name

    def runs(self) -> list[str]:
        return [x for level in sorted(self.levels) for x in self.levels[level]]

    def append(self, rows: DataFrame) -> DataFrame:
        """Add a batch as a run; returns its hits ``(fp, doc_id)``, the partners in history included."""
        history = self.runs()
        new = self.spark.table(self._write(rows, 0)).withColumn("new", F.lit(1))
        alive = new
        for name in history:
            alive = alive.unionByName(self.spark.table(name).withColumn("new", F.lit(0)))
        stats = self._grouped(new, history)
        hits = alive.join(stats, "fp", "left_semi").select("fp", "doc_id")
        return stage(hits, "hits")

    def _grouped(self, new: DataFrame, history: list[str]) -> DataFrame:
        """Fingerprints of the new run that two doc_ids have; each run is reduced by itself first, without a shuffle."""
        low = new.groupBy("fp").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"))
        for i, name in enumerate(history):
            old = self.spark.table(name).groupBy("fp").agg(F.min("doc_id").alias("l"), F.max("doc_id").alias("h"))
            low = low.join(old, "fp", "left").select("fp", F.least("lo", "l").alias("lo"), F.greatest("hi", "h").alias("hi"))
        return low.where("lo < hi").select("fp")

    def compact(self) -> None:
        """Merge full levels; old runs go after the new one is there."""
        level = 0
        while level in self.levels:
            old = self.levels[level]
            if len(old) >= self.fan_in:
                rows = self.spark.table(old[0])
                for name in old[1:]:
                    rows = rows.union(self.spark.table(name))
                self._write(rows.distinct(), level + 1)
                self.levels[level] = []
                for name in old:
                    self.spark.sql(f"DROP TABLE {name}")
            level += 1

    def drop(self) -> None:
        for name in self.runs():
            self.spark.sql(f"DROP TABLE IF EXISTS {name}")
        self.levels.clear()


def fingerprints(docs: DataFrame, width: int) -> DataFrame:
    """``(fp, doc_id)``: distinct anchors of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text", 2 << 20):
            ids, fps = [], []
            h, at = word_hashes(b.column(1))
            for doc, i, j in zip(b.column(0).to_pylist(), at.tolist(), at[1:].tolist()):
                if j - i >= width:
                    fp = np.unique(word_anchors(h[i:j], width)[0])
                    fps.append(fp)
                    ids.append(np.full(len(fp), doc, np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(fps).view(np.int64)), pa.array(np.concatenate(ids))], ["fp", "doc_id"])

    return docs.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "fp long, doc_id long")


CONTEXTS = "bucket int, data binary"
VERDICTS = "doc_id long, th long, q int, bits long"


def _verify(docs: DataFrame, hits: DataFrame, width: int, n_buckets: int) -> DataFrame:
    """``(doc_id, th, q, bits)``: of each hit anchor at word q, which of its windows are covered; th tells rows of one doc_id apart.

    ``docs`` has doc_id, th and text.
    """
    per_doc = hits.distinct().groupBy("doc_id").agg(F.collect_list("fp").alias("fps"))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pickle

        for b in slices(batches, "text", 2 << 20):
            found = defaultdict(list)
            h, at = word_hashes(b.column(2))
            for n, (doc, th, text, fps) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
                words = WORD.findall(text or "")
                if len(words) < width:
                    continue
                fp, q, first, last = word_anchors(h[at[n] : at[n + 1]], width)
                for i in np.flatnonzero(np.isin(fp.view(np.int64), np.array(fps, np.int64))).tolist():
                    found[int(fp[i]), int(q[i] - first[i]), " ".join(words[first[i] : last[i] + width])].append((doc, th, int(q[i])))
            # of equal contexts only the least doc_id's are open questions; the others are covered by it
            out = defaultdict(lambda: ([], []))
            for (f, left, text), entries in found.items():
                low, full = min(e[0] for e in entries), (1 << (text.count(" ") + 2 - width)) - 1
                out[(f * n_buckets) >> 64][0].append((f, left, text, [e for e in entries if e[0] == low]))
                for e in entries:
                    if e[0] > low:
                        out[e[1] % n_buckets][1].append((*e, full))
            rows = [(k, pickle.dumps(v)) for k, v in out.items()]
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int32()), pa.array([v for _, v in rows], pa.binary())], ["bucket", "data"])

    def match(t: pa.Table) -> pa.Table:
        import pickle

        give_back()
        by_fp: dict[int, dict[tuple, list]] = defaultdict(lambda: defaultdict(list))
        out = []
        for data in t.column("data"):
            contexts, settled = pickle.loads(data.as_buffer())
            out += settled
            for f, left, text, entries in contexts:
                by_fp[f][left, text] += entries
        for by_text in by_fp.values():
            least = {c: min(e[0] for e in es) for c, es in by_text.items()}
            window: dict[tuple, int] = {}
            if len(by_text) > 1:  # contexts that differ may share windows
                for (left, text), doc in least.items():
                    words = text.split(" ")
                    for j in range(len(words) - width + 1):
                        k = (left - j, *words[j : j + width])
                        if window.get(k, doc) >= doc:
                            window[k] = doc
            for (left, text), es in by_text.items():
                low = least[left, text]
                n = text.count(" ") + 2 - width
                full, part = (1 << n) - 1, 0
                if window:
                    words = text.split(" ")
                    part = sum(1 << j for j in range(n) if window[(left - j, *words[j : j + width])] < low)
                for doc, th, q in es:
                    bits = full if doc > low else part
                    if bits:
                        out.append((doc, th, q, bits))
        cols = list(zip(*out, strict=True)) or [()] * 4
        return pa.table({"doc_id": pa.array(cols[0], pa.int64()), "th": pa.array(cols[1], pa.int64()), "q": pa.array(cols[2], pa.int32()), "bits": pa.array(cols[3], pa.int64())})

    found = split_by_marks(docs, hits)[0].join(per_doc, "doc_id").select("doc_id", "th", "text", "fps", "_row")
    return found.mapInArrow(send, CONTEXTS).groupBy("bucket").applyInArrow(match, VERDICTS)


@counted_broadcasts
@small_batches
def substring_dedup(
    docs: DataFrame, width: int = 50, n_batches: int = 4, fan_in: int = 3, with_text: bool = False, carry: Sequence[str] = (), index_name: str | None = None, history: DataFrame | None = None
) -> DataFrame:
    """``(doc_id, n_words, n_removed, kept_sha256[, kept][, carried columns])`` of each row.

    The documents come to the index in ``n_batches`` ranges of doc_id.  ``kept`` is the text
    without the removed words and the white space after each of them.  ``index_name`` and
    ``history`` (doc_id and text of all documents of earlier calls) make the dedup incremental.
    """
    if not GRAM <= width <= GRAM + 62:
        raise ValueError(f"width must be {GRAM} to {GRAM + 62}")
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text")).alias("n"), F.percentile_approx("doc_id", [i / n_batches for i in range(1, n_batches)], 1000).alias("cuts")).first()
    n_buckets = max(8, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-(size["n"] or 0) // (32 << 20)))
    cuts = [None, *sorted(set(size["cuts"] or [])), None]
    index, hits = LogIndex(spark, n_buckets, fan_in, index_name), []
    try:
        for low, high in zip(cuts, cuts[1:]):
            batch = docs
            if low is not None:
                batch = batch.where(F.col("doc_id") > low)
            if high is not None:
                batch = batch.where(F.col("doc_id") <= high)
            hits.append(index.append(fingerprints(batch, width)))
            index.compact()
    finally:
        if not index.keeps:
            index.drop()
    found = hits[0]
    for h in hits[1:]:
        found = found.union(h)
    # of texts only those with hits, and then those with verdicts, are shuffled
    if dict(docs.dtypes)["doc_id"] != "bigint":
        docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text", F.struct(*carry).alias("_row") if carry else F.lit(0).alias("_row"))
    known = rows.where("doc_id is not null")
    compared = known
    if history is not None:
        old = history.where("doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
        compared = known.unionByName(old.withColumn("_row", F.lit(None).cast(known.schema["_row"].dataType)))
    settled = stage(_verify(compared, found, width, 4 * n_buckets), "verdicts")
    verdicts = settled.groupBy("doc_id").agg(F.collect_list(F.struct("th", "q", "bits")).alias("v"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "n_words", "n_removed", "kept_sha256"] + ["kept"] * with_text
        for b in slices(batches, "text", 2 << 20):
            out = []
            h, bounds = word_hashes(b.column(2))
            for row_at, (doc, th, text, v) in enumerate(zip(*(b.column(i).to_pylist() for i in range(4)), strict=True)):
                words = WORD.findall(text or "")
                n = len(words)
                v = [x for x in v or () if x["th"] == th]
                if not v:
                    out.append((doc, n, 0, hashlib.sha256(" ".join(words).encode()).hexdigest()) + ((text,) if with_text else ()))
                    continue
                fp, q, first, last = word_anchors(h[bounds[row_at] : bounds[row_at + 1]], width)
                at = {int(x): (int(a), int(z)) for x, a, z in zip(q, first, last, strict=True)}
                edge = np.zeros(n + 1, np.int64)
                for x in v:
                    a, z = at[x["q"]]
                    bits = x["bits"]
                    if bits == (1 << (z - a + 1)) - 1:
                        edge[a] += 1
                        edge[z + width] -= 1
                    else:
                        for j in range(z - a + 1):
                            if bits >> j & 1:
                                edge[a + j] += 1
                                edge[a + j + width] -= 1
                gone = np.cumsum(edge)[:n] > 0
                kept = [w for w, g in zip(words, gone.tolist(), strict=True) if not g]
                row = (doc, n, int(gone.sum()), hashlib.sha256(" ".join(kept).encode()).hexdigest())
                if with_text:
                    spans = [m.start() for m in WORD.finditer(text)] + [len(text)]
                    row += (text[: spans[0]] + "".join(text[spans[i] : spans[i + 1]] for i in np.flatnonzero(~gone).tolist()),)
                out.append(row)
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string()] + [pa.string()] * with_text
            yield pa.RecordBatch.from_arrays([*(pa.array(c, k) for c, k in zip(list(zip(*out, strict=True)) or [()] * len(kinds), kinds, strict=True)), b.column(4)], [*names, "_row"])

    some, rest = split_by_marks(rows, settled)
    judged = some.join(verdicts, "doc_id", "left").select("doc_id", "th", "text", "v", "_row")
    judged = judged.union(rest.select("doc_id", "th", "text", F.lit(None).cast(judged.schema["v"].dataType), "_row"))
    out = judged.mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept_sha256 string" + ", kept string" * with_text + f", _row {judged.schema['_row'].dataType.simpleString()}")
    return out.select("*", "_row.*").drop("_row") if carry else out.drop("_row")


def remove_repeated(docs: DataFrame, width: int = 50) -> DataFrame:
    """``docs`` with its own columns and repeated passages cut from ``text``; ``n_chars``, if there, is the new length."""
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    named = docs.select("doc_id", "text", *(F.col(f"`{c}`").alias(f"_c{i}") for i, c in enumerate(rest)))
    done = substring_dedup(named, width, with_text=True, carry=[f"_c{i}" for i in range(len(rest))])
    back = {"doc_id": F.col("doc_id"), "text": F.col("kept")} | {c: F.col(f"_c{i}") for i, c in enumerate(rest)}
    if "n_chars" in rest:
        back["n_chars"] = F.coalesce(F.length("kept").cast(docs.schema["n_chars"].dataType), back["n_chars"])
    return done.select(*(back[c].alias(c) for c in docs.columns))


SQL = r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\x0B\f\r]+'), lambda s: s <> '') AS ws FROM documents),
g AS (SELECT r, doc_id, i, array_to_string(ws[i:i+49], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - 48)) AS i FROM t WHERE doc_id IS NOT NULL)),
m AS (SELECT g, min(doc_id) AS d FROM g GROUP BY g),
c AS (SELECT r, list(i ORDER BY i) AS starts FROM g JOIN m USING (g) WHERE g.doc_id > m.d GROUP BY r),
k AS (SELECT r, doc_id, ws, u.w AS w, u.i AS i FROM (SELECT r, doc_id, ws, unnest(list_transform(ws, lambda w, i: {'w': w, 'i': i})) AS u FROM t)),
x AS (SELECT DISTINCT r, s + j AS i FROM (SELECT r, unnest(starts) AS s FROM c), range(50) AS o(j)),
y AS (SELECT k.r, string_agg(w, ' ' ORDER BY k.i) FILTER (WHERE x.i IS NULL) AS kept, count(x.i) AS n FROM k LEFT JOIN x ON k.r = x.r AND k.i = x.i GROUP BY k.r)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM t LEFT JOIN y USING (r)
"""
