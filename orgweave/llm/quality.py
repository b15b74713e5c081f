"""Quality rules (operator 3), DataFrame functions only.

Counts of each whole text are plain expressions; the remaining rules form a
short-circuit cascade.  Some rules compare counts that are there anyway, others read the
text again.  Each rule's own cost (seconds beyond those of a job without it) and
selectivity (share of rows it rejects) are estimated on a bounded sample, staged once,
and the cascade asks the rules by rejection per cost, so that dear rules see few rows.
The order never changes which rows are kept.

Nulls: a null text has no words and fails the base rules; a null doc_id is passed on.
Very long and empty texts are counted whole.  Repeated rows give repeated results; an
empty table gives an empty result and leaves the rules in the order given.  Other
columns are ignored by ``quality_rules`` and kept by ``filter_quality``.
"""

from __future__ import annotations

import time
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage, whole_row

#: Fixed by the contract.
WS = r"[ \t\n\x0B\f\r]+"
NOT_WS = r"[^ \t\n\x0B\f\r]+"
NOT_SYMBOL = r"[^#*$%&|<>]+"

#: Rows of the sample on which rules are measured.
SAMPLE_ROWS = 2000
#: Times that each row of the sample is judged within one timed job.
REPEATS = 10


def _shl(x: Column, bits: Column) -> Column:
    return F.call_function("shiftleft", x, bits)


def _shr(x: Column, bits: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, bits)


def _words(text: Column) -> Column:
    return F.filter(F.split(text, WS), lambda w: w != "")


def _let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once."""
    return F.transform(F.array(value), body)[0]


def n_repeat_words(words: Column, n: Column) -> Column:
    """Words covered by a 3-word window that occurs twice or more, the first included.

    A window becomes one long: high bits of its hash, low bits its place.  After a
    sort equal hashes are neighbours; neighbours are then compared word by word, so a
    chance collision of the high bits is not taken for a repeat.
    """

    def over(w: Column) -> Column:
        # bound once, as nothing in a lambda may be computed anew for each element
        return _let(F.greatest(F.lit(1), F.ceil(F.log2(F.size(w) + 2)).cast("int")), lambda bits: with_bits(w, bits))

    def with_bits(w: Column, bits: Column) -> Column:
        keys = F.sort_array(
            F.transform(
                F.sequence(F.lit(0), F.size(w) - 3),
                lambda i: _shl(_shr(F.xxhash64(F.get(w, i), F.get(w, i + 1), F.get(w, i + 2)), bits), bits).bitwiseOR(i.cast("long")),
            )
        )

        def repeats(s: Column) -> Column:
            place = lambda x: x.bitwiseAND(_shl(F.lit(1).cast("long"), bits) - 1).cast("int")
            same = lambda x, y: y.isNotNull() & (_shr(x, bits) == _shr(y, bits)) & (F.slice(w, place(x) + 1, 3) == F.slice(w, place(y) + 1, 3))
            starts = F.sort_array(F.transform(F.filter(s, lambda x, t: F.coalesce(same(x, F.when(t > 0, F.get(s, t - 1))), F.lit(False)) | F.coalesce(same(x, F.get(s, t + 1)), F.lit(False))), place))
            covered = lambda p: F.aggregate(F.transform(p, lambda x, t: F.least(F.lit(3), F.coalesce(F.get(p, t + 1) - x, F.lit(3)))), F.lit(0).cast("long"), lambda a, x: a + x)
            return _let(starts, covered)

        return _let(keys, repeats)

    return F.when(n < 4, F.lit(0).cast("long")).otherwise(_let(words, over))


def text_counts(docs: DataFrame, keep: Sequence[str] = ("doc_id",), with_text: bool = False) -> DataFrame:
    """``keep`` and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of each text, and the text as ``_t``."""
    text = F.coalesce(F.col("text"), F.lit(""))
    with_words = docs.select(*keep, text.alias("_t"), _words(text).alias("_w"))
    lines = F.filter(F.split("_t", "\n"), lambda x: x.rlike(NOT_WS))
    n = F.size("_w")
    return with_words.select(
        *keep,
        n.cast("long").alias("n_words"),
        F.length(F.regexp_replace("_t", WS, "")).cast("long").alias("word_chars"),
        F.length(F.regexp_replace("_t", NOT_SYMBOL, "")).cast("long").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("n_dup_lines"),
        n_repeat_words(F.col("_w"), n).alias("n_repeat_words"),
        *["_t"] * with_text,
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


#: Rejecting rules of the cascade over the counts and the text ``_t``, in integers so that any engine agrees on them.
RULES: dict[str, str] = {
    "symbols": "100 * n_symbols > 20 * n_words",
    "duplicate_lines": "10 * n_dup_lines > 3 * n_words",
    "short_words": "word_chars < 2 * n_words",
    "long_words": "word_chars > 14 * n_words",
    "repeated_text": "100 * n_repeat_words > 30 * n_words",
    # over three links in ten words
    "links": "10 * (length(_t) - length(replace(_t, '://', ''))) > 9 * n_words",
    # over three lines in ten are cut off by an ellipsis
    "cut_lines": "10 * (length(_t) - length(replace(_t, concat('...', chr(10)), chr(10)))) > 9 * (length(_t) - length(replace(_t, chr(10), '')) + 1)",
    # a brace for every five words
    "braces": "5 * (length(_t) - length(translate(_t, '{}', ''))) > n_words",
}


def measure(sample: DataFrame, rules: dict[str, str]) -> list[tuple[str, float, float]]:
    """``(rule, share rejected, own seconds)`` on a staged sample of counts and texts."""
    often = sample.withColumn("_i", F.explode(F.sequence(F.lit(1), F.lit(REPEATS))))

    def timed(rule: str) -> tuple[float, float]:
        took = []
        for _ in range(3):  # the first compiles
            began = time.perf_counter()
            row = often.agg(F.count("*").alias("n"), F.sum(F.when(F.expr(rule), 1).otherwise(0)).alias("r")).first()
            took.append(time.perf_counter() - began)
        return (row["r"] or 0) / max(row["n"], 1), min(took[1:])

    idle = timed("_t IS NULL AND n_words + word_chars + n_symbols + n_dup_lines + n_repeat_words < 0")[1]
    found = [(name, *timed(rule)) for name, rule in rules.items()]
    return [(name, share, max(took - idle, 1e-4)) for name, share, took in found]


def cascade_order(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejection per cost on a sample of at most about ``sample_rows`` rows; ties keep the given order."""
    total = docs.count()
    if not total:
        return list(rules)
    sample = docs.select("doc_id", "text").sample(fraction=min(1.0, sample_rows / total), seed=7)
    staged = stage(text_counts(sample, with_text=True).where(~base_failed()), "rule-sample")
    found = measure(staged, rules)
    unstage(staged)
    return [name for name, *_ in sorted(found, key=lambda x: -x[1] / x[2])]


def cascade(order: Sequence[str], rules: dict[str, str] = RULES) -> Column:
    """The first rule that rejects, or null; a CASE stops at the first match."""
    verdict = None
    for name in order:
        verdict = (F if verdict is None else verdict).when(F.expr(rules[name]), F.lit(name))
    return verdict if verdict is not None else F.lit(None).cast("string")


def quality_rules(docs: DataFrame, rules: dict[str, str] = RULES, sample_rows: int = SAMPLE_ROWS, keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """Counts, ``base_failed`` and ``kept`` of each document."""
    order = cascade_order(docs, rules, sample_rows)
    failed = base_failed()
    counts = text_counts(docs, keep, with_text=True)
    return counts.withColumns({"base_failed": failed, "kept": F.when(failed, F.lit(False)).otherwise(cascade(order, rules).isNull())}).drop("_t")


def filter_quality(docs: DataFrame, rules: dict[str, str] = RULES) -> DataFrame:
    """The documents that pass, with their own columns."""
    judged = quality_rules(docs.select("doc_id", "text", whole_row(docs).alias("_row")), rules, keep=("_row",))
    # the row number keeps the optimiser from moving the filter below the counts, which it would compute once a rule
    return judged.withColumn("_n", F.monotonically_increasing_id()).where("kept and _n >= 0").select("_row.*")


def sql() -> str:
    """The same for DuckDB."""
    ws = r"[ \t\n\x0B\f\r]+"
    return rf"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS x FROM documents),
w AS (SELECT r, doc_id, x, list_filter(regexp_split_to_array(x, '{ws}'), lambda s: s <> '') AS ws FROM t),
g AS (SELECT r, i, ws[i:i+2] AS g FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
d AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM g) WHERE n > 1),
c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM d) GROUP BY r),
b AS (SELECT doc_id, x AS _t, CAST(len(ws) AS BIGINT) AS n_words,
  CAST(length(regexp_replace(x, '{ws}', '', 'g')) AS BIGINT) AS word_chars,
  CAST(length(regexp_replace(x, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
  CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
  coalesce(n, 0) AS n_repeat_words
  FROM (SELECT *, list_filter(string_split(x, chr(10)), lambda s: regexp_matches(s, '[^ \t\n\x0B\f\r]')) AS l FROM w) LEFT JOIN c USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM b)
SELECT * EXCLUDE (_t), NOT base_failed AND NOT ({" OR ".join(f"({r})" for r in RULES.values())}) AS kept FROM f
"""
