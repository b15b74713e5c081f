"""Quality classifier (operator 5): hierarchical empirical Bayes.

Evidence.  For each target (low quality, toxic) a ridge logistic regression over a few
text statistics and the presence of its most telling words.  The words are chosen by
their document counts in all labelled rows; the regression is fitted on a bounded
sample of them (``SAMPLE_ROWS``, by a hash of doc_id).  It gives every document a
log-odds.

Sites.  The mean predicted probability of all documents is the global prior.  A host's
posterior is a Beta mean, shrunk to the global prior, and a path's is shrunk to its
host's; the prior strengths come from the variance between sites (method of moments),
so sparse sites move little.  Sums are grouped aggregations with partial sums first.
A document's own probability is left out of its sites.  Its final log-odds are its
evidence plus its path's log-odds less the global ones.

Nulls: a null text is empty, a null host or path belongs to no site and uses the level
above; a null doc_id is passed on.  Labels that are null, or of unknown documents, are
ignored; a document with several labels has the larger of each.  Without labels of both
kinds a target has no evidence against any document.  Repeated rows are judged
alike and count in their sites.  An empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import string
from collections import Counter
from collections.abc import Iterator, Sequence
from itertools import chain
from operator import eq
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import CACHES, WORD, fresh, sized, slices, small_batches, stage, unstage

#: Rows on which the regressions are fitted, at most.
SAMPLE_ROWS = 8000
#: Words chosen for each target.
WORDS = 256
BUCKETS = 1 << 18
#: Outer punctuation that is no part of a word.
OUTER = string.punctuation
SYMBOL = re.compile(r"[#*$%&|<>]|!!")
TARGETS = ("low", "toxic")


#: Word beginnings of these lengths are features beside the whole word, as related forms share them.
PREFIXES = (5, 6)


class WordBuckets(dict):
    """word -> buckets of its lower-cased form without outer punctuation and of its beginnings; the first is whether it has a symbol."""

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) > 150_000:
            self.clear()
        plain = word.isalnum()
        core = (word if plain else word.strip(OUTER)).lower()
        # 1, 2, ...: the same letters as a word and as a beginning are different features
        v = self[word] = (int(not plain and bool(SYMBOL.search(word))), crc32(core.encode()) % BUCKETS, *(crc32(core[:k].encode(), k) % BUCKETS for k in PREFIXES if len(core) >= k))
        return v


_buckets = WordBuckets()
CACHES.append(_buckets)


def features(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """Statistics of a text, and the distinct buckets of its words; a bucket that several different words hit counts as another one, too."""
    words = WORD.findall(text or "")
    n = len(words)
    if not n:
        return np.zeros(6), np.zeros(0, np.int64)
    found = Counter(words)
    keys = list(map(_buckets.__getitem__, found))
    symbols = sum(c for k, c in zip(keys, found.values(), strict=True) if k[0])
    b, c = np.unique(np.fromiter(chain.from_iterable(k[1:] for k in keys), np.int64), return_counts=True)
    b = np.unique(np.r_[b, (b[c > 1] * 2654435761 + 1) % BUCKETS])
    lines = text.split("\n")
    same = sum(map(eq, words, words[1:]))
    return np.array([math.log1p(n) / 10, len(found) / n, symbols / n, same / n, (len(lines) - len(set(lines))) / len(lines), min(len(text) / n, 50) / 10]), b


def fit(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 30) -> np.ndarray:
    """Ridge logistic regression by Newton's method; the first column of ``x`` is the constant and not shrunk."""
    w, penalty = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    penalty[0] = 1e-6
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * np.maximum(p * (1 - p), 1e-6)[:, None]) + np.diag(penalty), x.T @ (p - y) + penalty * w)
        w -= step * min(1.0, 5 / max(np.abs(step).max(), 1e-9))
        if np.abs(step).max() < 1e-6:
            break
    return w


class Evidence:
    """Trained weights: for each target the constant, the statistics' and the chosen buckets'."""

    def __init__(self, dense: np.ndarray, table: np.ndarray):
        self.dense, self.table = dense, table  # (targets, 1 + statistics), (targets, BUCKETS)

    def score(self, text: str | None) -> np.ndarray:
        s, b = features(text)
        return self.dense[:, 0] + self.dense[:, 1:] @ s + self.table[:, b].sum(axis=1)


def train(docs: DataFrame, labels: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Evidence:
    marked = labels.where("doc_id is not null").groupBy("doc_id").agg((1 - F.max("quality")).cast("int").alias("low"), F.max("toxic").cast("int").alias("toxic"))
    marked = stage(marked.where("low is not null and toxic is not null"), "labels")
    texts = docs.select("doc_id", "text")
    kinds = len(TARGETS)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = np.zeros((kinds + 1, BUCKETS), np.int64)
        for b in slices(batches, "text"):
            for text, *marks in zip(*(b.column(i).to_pylist() for i in range(1 + kinds)), strict=True):
                f = features(text)[1]
                c[0, f] += 1
                for k, m in enumerate(marks):
                    if m:
                        c[k + 1, f] += 1
        for k in range(0, BUCKETS, BUCKETS // 64):
            yield pa.RecordBatch.from_arrays([pa.array([k], pa.int32()), pa.array([c[:, k : k + BUCKETS // 64].tobytes()], pa.binary())], ["k", "counts"])

    def add(t: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_buffer(), np.int64) for x in t.column("counts"))
        return pa.table({"k": t.column("k")[:1], "counts": pa.array([total.tobytes()], pa.binary())})

    labelled = texts.join(sized(marked, 24), "doc_id").select("text", *TARGETS)
    size = marked.agg(F.count("*").alias("n"), *(F.sum(t).alias(t) for t in TARGETS)).first()
    parts = {r["k"]: r["counts"] for r in labelled.mapInArrow(count, "k int, counts binary").groupBy("k").applyInArrow(add, "k int, counts binary").collect()}
    dense, table = np.zeros((kinds, 7)), np.zeros((kinds, BUCKETS))
    dense[:, 0] = -20.0
    if not parts:
        return Evidence(dense, table)
    counts = np.concatenate([np.frombuffer(parts[k], np.int64).reshape(kinds + 1, -1) for k in sorted(parts)], axis=1)
    chosen = []
    for k, t in enumerate(TARGETS):
        pos, neg = size[t] or 0, size["n"] - (size[t] or 0)
        a, b = counts[k + 1], counts[0] - counts[k + 1]
        odds = np.log((a + 0.5) / (np.maximum(pos - a, 0) + 0.5)) - np.log((b + 0.5) / (np.maximum(neg - b, 0) + 0.5))
        z = np.abs(odds) / np.sqrt(1 / (a + 0.5) + 1 / (b + 0.5))
        chosen.append(np.sort(np.argsort(-z, kind="stable")[:WORDS]))

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = [{int(b): i for i, b in enumerate(c)} for c in chosen]
        for b in slices(batches, "text"):
            out = []
            for text, *marks in zip(*(b.column(i).to_pylist() for i in range(1 + kinds)), strict=True):
                s, f = features(text)
                f = f.tolist()
                out.append((s.tolist(), *([p[x] for x in f if x in p] for p in place), *marks))
            cols = list(zip(*out, strict=True)) or [()] * (1 + 2 * kinds)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.float64())), *(pa.array(c, pa.list_(pa.int32())) for c in cols[1 : 1 + kinds]), *(pa.array(c, pa.int32()) for c in cols[1 + kinds :])], ["s", *(f"w_{t}" for t in TARGETS), *TARGETS])

    picked = marked.orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows)
    sample = texts.join(F.broadcast(picked), "doc_id").select("text", *TARGETS)
    rows = sample.mapInArrow(vectors, "s array<double>, " + ", ".join(f"w_{t} array<int>" for t in TARGETS) + ", " + ", ".join(f"{t} int" for t in TARGETS)).collect()
    for k, t in enumerate(TARGETS):
        y = np.array([r[t] for r in rows], float)
        if len(y) and 0 < y.sum() < len(y):
            x = np.zeros((len(rows), 7 + WORDS))
            x[:, 0] = 1
            for i, r in enumerate(rows):
                x[i, 1:7] = r["s"]
                x[i, [7 + j for j in r[f"w_{t}"]]] = 1
            w = fit(x, y)
            dense[k], table[k, chosen[k]] = w[:7], w[7:]
    unstage(marked)
    return Evidence(dense, table)


def _strength(sites: DataFrame, p: str, n: str, prior: float) -> float:
    """Strength (pseudo-documents) of the Beta prior from the variance between sites."""
    r = sites.where(f"{n} > 0").agg(F.sum(n).alias("n"), F.count("*").alias("k"), F.sum(F.col(n) * (F.col(p) / F.col(n) - F.lit(prior)) ** 2).alias("v"), F.sum(F.col(n) * F.col(n)).alias("n2")).first()
    spread = prior * (1 - prior)
    if not r["n"] or spread <= 0 or r["k"] < 2:
        return 1e6
    between = (r["v"] - (r["k"] - 1) * spread) / max(r["n"] - r["n2"] / r["n"], 1e-9)
    return min(max(spread / between - 1, 1.0), 1e6) if between > 0 else 1e6


def shrink(scored: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``_row``'s columns, ``p_low``, ``p_toxic`` and ``kept`` from a staged table ``(_host, _path, _row, e_low, e_toxic)`` of evidence."""
    kinds = list(TARGETS)
    p = {t: 1 / (1 + F.exp(-F.col(f"e_{t}"))) for t in kinds}
    scored = scored.withColumns({f"p_{t}": p[t] for t in kinds})
    whole = scored.agg(*(F.avg(f"p_{t}").alias(t) for t in kinds)).first()
    prior = {t: min(max(whole[t] or 0.0, 1e-6), 1 - 1e-6) for t in kinds}
    paths = stage(scored.where("_host is not null").groupBy("_host", "_path").agg(F.count("*").alias("n"), *(F.sum(f"p_{t}").alias(f"s_{t}") for t in kinds)), "paths")
    hosts = paths.groupBy("_host").agg(F.sum("n").alias("hn"), *(F.sum(f"s_{t}").alias(f"h_{t}") for t in kinds))
    real = paths.where("_path is not null")
    host_m = {t: _strength(hosts, f"h_{t}", "hn", prior[t]) for t in kinds}
    path_m = {t: _strength(real, f"s_{t}", "n", prior[t]) for t in kinds}
    sites = stage(paths.join(hosts, "_host").withColumn("_path_key", F.coalesce("_path", F.lit(""))).withColumn("no_path", F.col("_path").isNull()).drop("_path"), "sites")
    named = scored.withColumn("_path_key", F.coalesce("_path", F.lit(""))).withColumn("no_path", F.col("_path").isNull())
    joined = named.join(sized(sites, 120), ["_host", "_path_key", "no_path"], "left")
    logit = lambda x: F.log(x) - F.log(1 - x)
    out = {}
    for t in kinds:
        own = F.col(f"p_{t}")
        at_host = F.when(F.col("hn").isNull(), F.lit(prior[t])).otherwise((F.col(f"h_{t}") - own + host_m[t] * prior[t]) / (F.col("hn") - 1 + host_m[t]))
        at_path = F.when(F.col("n").isNull() | F.col("no_path"), at_host).otherwise((F.col(f"s_{t}") - own + path_m[t] * at_host) / (F.col("n") - 1 + path_m[t]))
        at_path = F.least(F.greatest(at_path, F.lit(1e-6)), F.lit(1 - 1e-6))
        out[t] = 1 / (1 + F.exp(-(F.col(f"e_{t}") + logit(at_path) - math.log(prior[t] / (1 - prior[t])))))
    final = joined.select("_row.*", *(out[t].alias(f"p_{t}") for t in kinds))
    return final.withColumn("kept", F.greatest(*(F.col(f"p_{t}") for t in kinds)) < threshold)


@small_batches
def classify(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5, sample_rows: int = SAMPLE_ROWS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep``, ``p_low``, ``p_toxic`` and ``kept`` of each document; ``host`` and ``path`` name the site columns."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, sample_rows))
    kinds = [t for t in TARGETS]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        for b in slices(batches, "text"):
            e = np.array([m.score(t) for t in b.column(0).to_pylist()]).reshape(-1, len(kinds))
            yield pa.RecordBatch.from_arrays([*b.columns[1:], *(pa.array(e[:, i]) for i in range(len(kinds)))], [*b.schema.names[1:], *(f"e_{t}" for t in kinds)])

    row = F.struct(*(F.col(c) for c in keep)).alias("_row")
    plain = docs.select("text", F.col(host).cast("string").alias("_host"), F.col(path).cast("string").alias("_path"), row)
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plain.schema.fields[1:]) + "".join(f", e_{t} double" for t in kinds)
    scored = stage(plain.mapInArrow(score, schema), "evidence")
    return shrink(scored, threshold)


def filter_classified(docs: DataFrame, labels: DataFrame, host: str = "source", path: str = "lang", threshold: float = 0.5) -> DataFrame:
    """The documents that pass, with their own columns; texts aren't moved, only the names of the rejected.

    A row is named by its doc_id, text and site, which are all that its verdict depends on:
    one document on two sites may stay on one of them.
    """
    th, *gone = fresh(docs, "_th", "_doc", "_gone", "_host_", "_path_")
    named = docs.withColumn(th, F.xxhash64("text"))
    names = ["doc_id", th, host, path]
    judged = classify(named, labels, host, path, threshold, keep=list(dict.fromkeys(names)))
    rejected = stage(judged.where("not kept").select(*(F.col(f"`{n}`").alias(g) for n, g in zip(names, gone, strict=True))).distinct(), "rejected")
    same = F.lit(True)
    for n, g in zip(names, gone, strict=True):
        same &= named[f"`{n}`"].eqNullSafe(rejected[g])
    return named.join(sized(rejected, 160), same, "left_anti").drop(th)
