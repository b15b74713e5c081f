"""Suffix-array dedup (operator 2).

A byte goes when it is covered by a ``width``-byte string that also starts in a
document with a smaller doc_id.  The suffixes of the corpus are partitioned, only those
that can have a partner are gathered, and each partition is sorted deep-shallow.

1. Documents are dealt once to groups of bounded size.  Every window of ``width`` bytes
   has an anchor: the leftmost least of the hashes of its 16-byte grams.  Equal windows
   have equal anchors, so each group sends the distinct anchor grams' 64-bit keys to
   key buckets and hears which of them other groups have too.
2. For each shared anchor a group sorts the suffixes that start at the anchor's windows'
   first byte, cut where its last window ends (its contexts), and sends one entry for
   equal ones with their least doc_id.  A passage that occurs in a third of all documents
   is thus an entry a group, not an entry a document.
3. A bucket sorts the contexts in the same way; equal ones share all their windows.  Of
   contexts that differ but share an anchor it then sorts the windows (suffixes cut at
   ``width`` bytes).  Equal neighbours are one class with one least doc_id.
4. Each group applies the verdicts to its documents.

Every sort is deep-shallow: multikey quicksort over 8-byte symbols to ``SHALLOW`` bytes,
then blind tries for the groups with longer common prefixes.  Hashes only propose
anchors; every equality is decided by the sort, on bytes.

Nulls: a null text is empty; a row with a null doc_id neither removes nor loses
anything.  Rows with the same doc_id count as one document: they don't remove each
other's bytes.  Texts under ``width`` bytes lose nothing.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, give_back, mix64

GRAM = 16
#: Depth of the multikey quicksort, a multiple of 8.
SHALLOW = 16
PART = 2 << 20
C1, C2, C3 = U64(0x9E3779B97F4A7C15), U64(0xC2B2AE3D27D4EB4F), U64(0xD6E8FEB86659FD93)


def words_at(buf: np.ndarray) -> np.ndarray:
    """Little-endian 8-byte words that start at every byte; ``buf`` needs 8 bytes of padding at its end."""
    return np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,))


def sliding_min(a: np.ndarray, w: int) -> np.ndarray:
    span = 1
    while span * 2 <= w:
        a = np.minimum(a[:-span], a[span:])
        span *= 2
    return np.minimum(a[: len(a) - (w - span)], a[w - span :]) if w > span else a


def anchors(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, width: int) -> tuple[np.ndarray, ...]:
    """``(doc, q, first, last)``: each anchor's document, place, and first and last window start.

    ``buf`` holds the documents one after the other and padding; ``starts`` and ``ends`` are ascending.
    """
    out = []
    i = 0
    while i < len(starts):
        j = max(i + 1, int(np.searchsorted(ends, starts[i] + PART, "right")))
        lo, hi = int(starts[i]), int(ends[j - 1])
        if hi - lo >= width:
            w = words_at(buf[lo : hi + 8])
            n = hi - lo
            x = w[: n - GRAM + 1] * C1
            x += w[8 : n - GRAM + 9] * C2
            x ^= x >> U64(29)
            x *= C3
            x &= U64(0xFFFFFFFF00000000)
            x |= np.arange(len(x), dtype=np.uint64)
            q = (sliding_min(x, width - GRAM + 1) & U64(0xFFFFFFFF)).astype(np.int64)
            doc = np.repeat(np.arange(i, j), ends[i:j] - starts[i:j])[: len(q)]
            ok = np.arange(lo, lo + len(q)) + width <= ends[doc]
            p = np.flatnonzero(ok)
            if len(p):
                q = q[p]
                new = np.flatnonzero(np.r_[True, (q[1:] != q[:-1]) | (p[1:] != p[:-1] + 1)])
                last = np.r_[new[1:] - 1, len(p) - 1]
                out.append((doc[p[new]], q[new] + lo, p[new] + lo, p[last] + lo))
        i = j
    if not out:
        return (np.zeros(0, np.int64),) * 4
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def gram_keys(words: np.ndarray, q: np.ndarray) -> np.ndarray:
    return mix64(mix64(words[q] + C2) + words[q + 8] * C1)


def deep_shallow(words: np.ndarray, starts: np.ndarray, segment: np.ndarray, depth: np.ndarray | int, shallow: int = SHALLOW) -> tuple[np.ndarray, np.ndarray]:
    """Sort suffixes by (segment, first ``depth`` bytes); suffixes of a segment have one depth.

    Returns the order and, for each place in it, whether a new class begins there (the
    suffix differs from the one before in its segment or its first ``depth`` bytes).
    """
    order = np.argsort(segment, kind="stable")
    s = segment[order]
    new = np.ones(len(order), bool)
    new[1:] = s[1:] != s[:-1]
    deep = np.broadcast_to(depth, order.shape)[order]  # by place: a segment's places stay its own

    def alone() -> np.ndarray:
        """Whether a place is a segment of its own."""
        return new & np.r_[new[1:], True]

    def tail(suffix: np.ndarray, d: np.ndarray | int, end: np.ndarray) -> np.ndarray:
        """The 8 bytes from depth d on, zero beyond ``end``."""
        left = np.clip(end - d, 0, 8).astype(np.uint64) * U64(8)
        w = words[starts[suffix] + np.where(left > 0, d, 0)]
        return np.where(left == 64, w, w & ((U64(1) << (left & U64(63))) - U64(1)))

    _multikey_quicksort(order, new, deep, shallow, alone, tail)
    _blind_tries(order, new, deep, shallow, alone, tail)
    return order, new


def _multikey_quicksort(order: np.ndarray, new: np.ndarray, deep: np.ndarray, shallow: int, alone: Callable, tail: Callable) -> None:
    """Three-way partition of every open segment by its middle suffix's symbol, all segments in a round.

    The part equal to the pivot goes on with the next symbol, the others with the same.
    """
    at = np.zeros(len(order), np.int64)
    stop = np.minimum(deep, shallow)
    while len(act := np.flatnonzero(~alone() & (at < stop))):
        head = np.flatnonzero(new[act])
        size = np.diff(np.r_[head, len(act)])
        symbol = tail(order[act], at[act], deep[act]).byteswap()
        pivot = np.repeat(symbol[head + size // 2], size)
        side = (symbol > pivot).astype(np.int64) - (symbol < pivot) + 1
        o = np.argsort(np.repeat(np.arange(len(head)) * 3, size) + side, kind="stable")
        order[act], side = order[act][o], side[o]
        new[act[1:]] |= side[1:] != side[:-1]
        at[act] += 8 * (side == 1)


def _blind_tries(order: np.ndarray, new: np.ndarray, deep: np.ndarray, shallow: int, alone: Callable, tail: Callable) -> None:
    """Order what is equal to ``shallow`` bytes, all groups in a round.

    A group's first suffix is the spine of its trie; the others hang on it at their common
    prefix with it, branch by the next byte, and are groups of the next round.
    """
    done = alone() | (deep <= shallow)
    big = (int(deep.max(initial=0)) + 1) << 9
    while len(act := np.flatnonzero(~done)):
        head = np.flatnonzero(new[act])
        size = np.diff(np.r_[head, len(act)])
        own, spine, end = order[act], np.repeat(order[act[head]], size), deep[act]
        lcp, char, at_spine = end.copy(), np.zeros(len(act), np.int64), np.zeros(len(act), np.int64)
        open_ = np.arange(len(act))
        for d in range(shallow, int(end.max()), 8):
            a, b = tail(own[open_], d, end[open_]), tail(spine[open_], d, end[open_])
            x = a ^ b
            hit = np.flatnonzero(x)
            if len(hit):
                y = x[hit]
                byte = (np.log2((y & (~y + U64(1))).astype(np.float64)).astype(np.int64)) // 8
                k = open_[hit]
                lcp[k] = d + byte
                sh = (byte * 8).astype(np.uint64)
                char[k] = ((a[hit] >> sh) & U64(255)).astype(np.int64)
                at_spine[k] = ((b[hit] >> sh) & U64(255)).astype(np.int64)
            open_ = open_[x == 0]
        equal = lcp == end
        key = np.where(equal, big, np.where(char < at_spine, (lcp << 8) + char, big + ((end + 1 - lcp) << 8) + char))
        seg = np.repeat(np.arange(len(head)), size)
        o = np.lexsort((key, seg))
        order[act], key = own[o], key[o]
        new[act[1:]] |= (key[1:] != key[:-1]) | (seg[1:] != seg[:-1])
        done[act] = equal[o]
        done |= alone()


def equal_spans(words: np.ndarray, at: np.ndarray, size: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class number of the bytes ``at .. at + size`` within their segment, and each class's first row."""
    order, new = deep_shallow(words, at, segment * (int(size.max(initial=0)) + 1) + size, size)
    cls = np.empty(len(order), np.int64)
    cls[order] = np.cumsum(new) - 1
    return cls, np.unique(cls, return_index=True)[1]


class _Group:
    """The anchors of one group of documents; documents are ordered by (doc_id, text) to be the same in every task."""

    def __init__(self, t: pa.Table, width: int):
        doc, text = t.column("doc_id").to_pylist(), t.column("text").cast(pa.binary()).to_pylist()
        text = [x or b"" for x in text]
        rows = sorted(range(len(doc)), key=lambda i: (doc[i] is None, doc[i] or 0, text[i]))
        self.doc_id = [doc[i] for i in rows]
        self.known = np.array([x is not None for x in self.doc_id], bool)
        self.ids = np.array([x or 0 for x in self.doc_id], np.int64)
        text = [text[i] for i in rows]
        size = np.fromiter(map(len, text), np.int64, len(text))
        self.ends = np.cumsum(size)
        self.starts = self.ends - size
        self.buf = np.frombuffer(b"".join(text) + bytes(16), np.uint8)
        self.words = words_at(self.buf)
        doc, q, first, last = anchors(self.buf, self.starts, self.ends, width)
        ok = self.known[doc]
        self.doc, self.q, self.first, self.last = doc[ok], q[ok], first[ok], last[ok]
        self.key = gram_keys(self.words, self.q)
        self.width = width

    def several(self) -> np.ndarray:
        """Keys that more than one doc_id of the group has."""
        o = np.lexsort((self.ids[self.doc], self.key))
        k, d = self.key[o], self.ids[self.doc][o]
        return np.unique(k[1:][(k[1:] == k[:-1]) & (d[1:] != d[:-1])])

    def classes(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of the anchors ``rows``, ascending: class of equal contexts, and each class's entry with the least doc_id (as rows go by doc_id, its first)."""
        return equal_spans(self.words, self.first[rows], self.last[rows] + self.width - self.first[rows], np.unique(self.key[rows], return_inverse=True)[1])


def _by_bucket(bucket: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    o = np.argsort(bucket, kind="stable")
    at = np.searchsorted(bucket[o], np.arange(n + 1))
    for b in range(n):
        if at[b] < at[b + 1]:
            yield b, o[at[b] : at[b + 1]]


def _ragged(at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The indices ``at[i] .. at[i] + size[i]`` of all i, one after the other."""
    end = np.cumsum(size)
    return np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size) + np.repeat(at, size)


def _table(schema: pa.Schema, rows: list[tuple]) -> pa.Table:
    return pa.table([pa.array(x, f.type) for x, f in zip(zip(*rows, strict=True), schema, strict=True)] if rows else [pa.array([], f.type) for f in schema], schema=schema)


KEYS = pa.schema([("bucket", pa.int32()), ("pid", pa.int32()), ("data", pa.binary())])
REPLY = pa.schema([("pid", pa.int32()), ("data", pa.binary())])


def _cover(g: _Group, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    n = len(g.buf) + 1
    return np.cumsum(np.bincount(start, minlength=n) - np.bincount(end, minlength=n))[:-1] > 0


def suffix_dedup(docs: DataFrame, width: int = 50, group_bytes: int = 8 << 20, with_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256[, kept])`` of each document; ``kept`` holds the remaining bytes."""
    if not GRAM <= width <= GRAM + 62:
        raise ValueError(f"width must be {GRAM} to {GRAM + 62}")
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // group_bytes))
    n_buckets = n_groups
    dealt = docs.select(F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_groups)).cast("int").alias("pid"), F.col("doc_id").cast("long").alias("doc_id"), "text")
    bucket_of = lambda key: ((key >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)

    def send_keys(t: pa.Table) -> pa.Table:
        give_back()
        pid = t.column("pid")[0].as_py()
        key = np.unique(_Group(t, width).key)
        at = np.searchsorted(bucket_of(key), np.arange(n_buckets + 1))
        return _table(KEYS, [(b, pid, key[at[b] : at[b + 1]].tobytes()) for b in range(n_buckets) if at[b] < at[b + 1]])

    def match_keys(t: pa.Table) -> pa.Table:
        give_back()
        pid = np.array(t.column("pid").to_pylist(), np.int64)
        parts = [np.frombuffer(x, "<u8") for x in t.column("data").to_pylist()]
        key, who = np.concatenate(parts), np.repeat(pid, [len(x) for x in parts])
        o = np.argsort(key, kind="stable")
        k = key[o]
        same = np.r_[False, k[1:] == k[:-1]]
        o = o[same | np.r_[same[1:], False]]
        return _table(REPLY, [(int(p), key[o[rows]].tobytes()) for p, rows in _by_pid(who[o])])

    def _by_pid(who: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
        o = np.argsort(who, kind="stable")
        cut = np.flatnonzero(np.r_[True, who[o][1:] != who[o][:-1], True]) if len(o) else np.zeros(1, int)
        for a, b in zip(cut[:-1], cut[1:], strict=True):
            yield who[o[a]], o[a:b]

    def send_contexts(t: pa.Table, reply: pa.Table) -> pa.Table:
        give_back()
        if not t.num_rows:
            return _table(KEYS, [])
        pid = t.column("pid")[0].as_py()
        g = _Group(t, width)
        wanted = np.unique(np.concatenate([g.several(), *(np.frombuffer(x, "<u8") for x in reply.column("data").to_pylist())]))
        rows = np.flatnonzero(np.isin(g.key, wanted))
        rows = np.sort(rows[g.classes(rows)[1]])
        out = []
        for b, k in _by_bucket(bucket_of(g.key[rows]), n_buckets):
            r = rows[k]
            size = g.last[r] + width - g.first[r]
            data = b"".join((np.int64(len(r)).tobytes(), g.ids[g.doc[r]].tobytes(), r.astype(np.int32).tobytes(), (g.q[r] - g.first[r]).astype(np.uint8).tobytes(), (g.last[r] - g.first[r] + 1).astype(np.uint8).tobytes(), g.buf[_ragged(g.first[r], size)].tobytes()))
            out.append((b, pid, data))
        return _table(KEYS, out)

    def match_contexts(t: pa.Table) -> pa.Table:
        give_back()
        pid, doc, row, left, count, text = [], [], [], [], [], []
        for p, data in zip(t.column("pid").to_pylist(), t.column("data").to_pylist(), strict=True):
            n = int(np.frombuffer(data, np.int64, 1)[0])
            pid.append(np.full(n, p))
            doc.append(np.frombuffer(data, np.int64, n, 8))
            row.append(np.frombuffer(data, np.int32, n, 8 + 8 * n))
            left.append(np.frombuffer(data, np.uint8, n, 8 + 12 * n))
            count.append(np.frombuffer(data, np.uint8, n, 8 + 13 * n))
            text.append(data[8 + 14 * n :])
        pid, doc, row, left, count = (np.concatenate(x).astype(np.int64) for x in (pid, doc, row, left, count))
        buf = np.frombuffer(b"".join(text) + bytes(16), np.uint8)
        words = words_at(buf)
        size = count - 1 + width
        at = np.cumsum(size) - size
        anchor = np.unique(gram_keys(words, at + left), return_inverse=True)[1]
        cls, chosen = equal_spans(words, at, size, anchor)
        least = np.full(len(chosen), np.iinfo(np.int64).max)
        np.minimum.at(least, cls, doc)
        mask = np.zeros(len(doc), np.uint64)
        later = doc > least[cls]
        mask[later] = ((U64(1) << count.astype(np.uint64)) - U64(1))[later]
        # contexts that differ but share an anchor: sort their windows
        group = anchor[chosen]
        many = np.bincount(group)[group] > 1
        rep, grp, low = chosen[many], group[many], least[many]
        if len(rep):
            n = count[rep]
            win, own = _ragged(np.zeros(len(rep), np.int64), n), np.repeat(np.arange(len(rep)), n)
            order, fresh = deep_shallow(words, at[rep][own] + win, grp[own] * 64 + (left[rep][own] - win), width)
            c = np.cumsum(fresh) - 1
            first = np.full(c[-1] + 1, np.iinfo(np.int64).max)
            np.minimum.at(first, c, low[own[order]])
            hit = order[first[c] < low[own[order]]]
            bits = np.zeros(len(rep), np.uint64)
            np.bitwise_or.at(bits, own[hit], U64(1) << win[hit].astype(np.uint64))
            per_cls = np.zeros(len(chosen), np.uint64)
            per_cls[many] = bits
            mask[~later] |= per_cls[cls[~later]]
        r = np.flatnonzero(mask)
        return _table(REPLY, [(int(p), row[r[k]].astype(np.int32).tobytes() + mask[r[k]].tobytes()) for p, k in _by_pid(pid[r])])

    out_schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text
    out_arrow = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())] + [("kept", pa.binary())] * with_text)

    def apply(t: pa.Table, verdicts: pa.Table) -> pa.Table:
        give_back()
        if not t.num_rows:
            return _table(out_arrow, [])
        g = _Group(t, width)
        found = verdicts.column("data").to_pylist()
        row = np.concatenate([np.zeros(0, np.int32), *(np.frombuffer(x, np.int32, len(x) // 12) for x in found)])
        mask = np.concatenate([np.zeros(0, np.uint64), *(np.frombuffer(x, "<u8", len(x) // 12, len(x) // 3) for x in found)])
        rows = np.flatnonzero(np.isin(g.key, np.concatenate([g.key[row], g.several()])))
        cls, chosen = g.classes(rows)
        ids = g.ids[g.doc[rows]]
        later = ids > ids[chosen][cls]
        start, end = [g.first[rows[later]]], [g.last[rows[later]] + width]
        per_cls = np.zeros(len(chosen), np.uint64)
        per_cls[cls[np.searchsorted(rows, row)]] = mask
        bits = per_cls[cls]
        part = np.flatnonzero(~later & (bits != 0))
        n = (g.last - g.first + 1)[rows[part]]
        win, own = _ragged(np.zeros(len(part), np.int64), n), np.repeat(part, n)
        on = ((bits[own] >> win.astype(np.uint64)) & U64(1)) == 1
        s = g.first[rows[own[on]]] + win[on]
        start.append(s)
        end.append(s + width)
        gone = _cover(g, np.concatenate(start), np.concatenate(end))
        total = np.r_[0, np.cumsum(gone)]
        removed = total[g.ends] - total[g.starts]
        edge = gone.copy()
        edge[1:] &= ~gone[:-1]
        inner = g.starts[g.starts < len(gone)]
        edge[inner] |= gone[inner]
        total = np.r_[0, np.cumsum(edge)]
        spans = total[g.ends] - total[g.starts]
        out = []
        for i, doc in enumerate(g.doc_id):
            a, b = g.starts[i], g.ends[i]
            kept = g.buf[a:b] if not removed[i] else g.buf[a:b][~gone[a:b]]
            out.append((doc, int(b - a), int(removed[i]), int(spans[i]), hashlib.sha256(kept).hexdigest()) + ((kept.tobytes(),) if with_text else ()))
        return _table(out_arrow, out)

    keys, reply = "bucket int, pid int, data binary", "pid int, data binary"
    replies = dealt.groupBy("pid").applyInArrow(send_keys, keys).groupBy("bucket").applyInArrow(match_keys, reply)
    contexts = dealt.groupBy("pid").cogroup(replies.groupBy("pid")).applyInArrow(send_contexts, keys)
    verdicts = contexts.groupBy("bucket").applyInArrow(match_contexts, reply)
    return dealt.groupBy("pid").cogroup(verdicts.groupBy("pid")).applyInArrow(apply, out_schema)


SQL = """
WITH t AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS b FROM documents),
g AS (SELECT r, doc_id, p, array_slice(b, p, p + 49) AS w FROM (SELECT *, unnest(range(1, octet_length(b) - 48)) AS p FROM t WHERE doc_id IS NOT NULL)),
c AS (SELECT r, p FROM (SELECT r, p, doc_id > min(doc_id) OVER (PARTITION BY w) AS hit FROM g) WHERE hit),
s AS (SELECT r, min(p) AS a, max(p) + 49 AS z FROM (SELECT r, p, sum(CASE WHEN p > before + 50 OR before IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY p) AS k FROM (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM c)) GROUP BY r, k),
k AS (SELECT r, a, lag(z, 1, 0) OVER (PARTITION BY r ORDER BY a) + 1 AS x, a - 1 AS y FROM s UNION ALL SELECT r, max(z) + 1, max(z) + 1, 2147483647 FROM s GROUP BY r),
x AS (SELECT t.r, sha256(unhex(string_agg(hex(array_slice(b, x, y)), '' ORDER BY a))) AS h FROM k JOIN t USING (r) GROUP BY t.r),
n AS (SELECT r, sum(z - a + 1) AS n, count(*) AS m FROM s GROUP BY r)
SELECT doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(m, 0) AS n_spans, coalesce(h, sha256(b)) AS kept_sha256 FROM t LEFT JOIN n USING (r) LEFT JOIN x USING (r)
"""
