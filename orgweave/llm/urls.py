"""URL filters (operator 6), DataFrame functions only.

A listed rule decides the pages it fits.  All other pages get their host's verdict
from the link graph: trust is a personalised PageRank from trusted hosts along host
links, distrust one from blocked hosts against them (who links to a blocked host
shares its distrust).  A host is blocked when its distrust is at least ``threshold``
and greater than its trust.

Seeds: a host is a trusted or blocked seed by the balance of its pages that rules
allow and block, as a share of all its pages.  With the default threshold a host
without links is blocked when rules block over a third of its pages (0.0501 rather than 0.05, so that a third itself is no matter of rounding).

Nulls: a null url, or one without ``://``, has an empty host and path, fits no rule
and is allowed; a null page_id is passed on; a null html has no links.  Repeated rows
are judged alike and count as pages of their own.  An empty table gives an empty
result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stage, unstage

#: (verdict, host, path) of the contract.
RULES = (
    ("block", "com", "/en/"),
    ("allow", "example.com", "/en/7"),
    ("allow", "net", "/de/"),
    ("block", "example.net", "/de/8"),
    ("block", "org", "/es/"),
)

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z lower-cased."""
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(url.isNull() | (F.locate("://", url) == 0), F.lit("")).otherwise(F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), UPPER, LOWER))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    rest = F.substr(url, F.locate("://", url) + 3)
    return F.when(url.isNull() | (F.locate("://", url) == 0), F.lit("")).otherwise(F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str, str]] = RULES) -> Column:
    """``struct(rule, verdict)`` of the longest rule that fits, or null.  ``rules`` is configuration held by the driver."""
    out = None
    for verdict, h, p in sorted(rules, key=lambda r: -len(r[1] + r[2])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = (F if out is None else out).when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict")))
    return out if out is not None else F.lit(None).cast("struct<rule:string,verdict:string>")


def host_links(pages: DataFrame) -> DataFrame:
    """``(src, dst, n)``: links in html between different hosts, counted; they are absolute or begin with ``//`` (the page's own scheme)."""
    urls = F.regexp_extract_all("html", F.lit(r"(?i)href\s*=\s*[\"']?((?:[a-z][a-z0-9+.-]*:)?//[^\"'\s>]+)"), F.lit(1))
    links = pages.select(host_of(F.col("url")).alias("src"), F.explode(urls).alias("to"))
    links = links.select("src", host_of(F.when(F.col("to").startswith("//"), F.concat(F.lit(":"), "to")).otherwise(F.col("to"))).alias("dst"))
    return links.where("src <> '' and dst <> '' and src <> dst").groupBy("src", "dst").agg(F.count("*").alias("n"))


def propagate(links: DataFrame, seeds: DataFrame, damping: float = 0.85, rounds: int = 20, every: int = 5) -> DataFrame:
    """``(host, trust, distrust)`` by power iteration from ``seeds (host, trusted, blocked)`` with weights in 0..1.

    Both walks run in one table (kind, host, score): score = (1 - damping) * seed +
    damping * what links bring.  Scores are in units of a seed host, so a threshold
    means the same for any number of hosts.  A hub's incoming links are summed before
    they are shuffled; the state is staged every few rounds.
    """
    seed = seeds.select(F.explode(F.array(*(F.struct(F.lit(k).alias("kind"), "host", F.col(c).cast("double").alias("w")) for k, c in (("t", "trusted"), ("d", "blocked"))))).alias("x")).select("x.*")
    seed = stage(seed.where("w > 0").select("kind", "host", (F.col("w") * (1 - damping)).alias("score")), "seeds")
    both = links.select(F.lit("t").alias("kind"), "src", "dst", "n").union(links.select(F.lit("d").alias("kind"), F.col("dst"), F.col("src"), "n"))
    out = both.groupBy("kind", "src").agg(F.sum("n").alias("all"))
    edges = stage(both.join(out, ["kind", "src"]).select("kind", F.col("src").alias("host"), "dst", (F.col("n") / F.col("all")).alias("share")), "edges")
    state, old = seed, None
    if edges.limit(1).count():
        for i in range(rounds):
            moved = state.join(edges, ["kind", "host"]).select("kind", F.col("dst").alias("host"), (F.col("score") * F.col("share") * damping).alias("score"))
            state = moved.union(seed).groupBy("kind", "host").agg(F.sum("score").alias("score"))
            if (i + 1) % every == 0:
                state = stage(state, "walk")
                if old is not None:
                    unstage(old)
                old = state
    return state.groupBy("host").agg(
        F.coalesce(F.sum(F.when(F.col("kind") == "t", F.col("score"))), F.lit(0.0)).alias("trust"),
        F.coalesce(F.sum(F.when(F.col("kind") == "d", F.col("score"))), F.lit(0.0)).alias("distrust"),
    )


def url_filter(pages: DataFrame, rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.0501, damping: float = 0.85, rounds: int = 20) -> DataFrame:
    """``(page_id, host, path, rule, verdict, trust, distrust)`` of each page."""
    url = F.col("url")
    parsed = pages.select("page_id", host_of(url).alias("host"), path_of(url).alias("path"))
    ruled = parsed.select("*", rule_of(F.col("host"), F.col("path"), rules).alias("r"))
    n = lambda v: F.sum(F.when(F.col("r.verdict") == v, 1).otherwise(0))
    share = ruled.where("host <> ''").groupBy("host").agg(((n("allow") - n("block")) / F.count("*")).alias("d"))
    seeds = share.select("host", F.greatest("d", F.lit(0.0)).alias("trusted"), F.greatest(-F.col("d"), F.lit(0.0)).alias("blocked"))
    scores = stage(propagate(host_links(pages), seeds, damping, rounds).select("host", "trust", "distrust"), "hosts")
    scores = scores.withColumn("bad", (F.col("distrust") >= threshold) & (F.col("distrust") > F.col("trust")))
    judged = ruled.join(scores, "host", "left")
    return judged.select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce(F.col("r.verdict"), F.when(F.col("bad"), F.lit("block")).otherwise(F.lit("allow"))).alias("verdict"),
        F.coalesce("trust", F.lit(0.0)).alias("trust"),
        F.coalesce("distrust", F.lit(0.0)).alias("distrust"),
    )


def sql(rules: Sequence[tuple[str, str, str]] = RULES, threshold: float = 0.0501, damping: float = 0.85, rounds: int = 20) -> str:
    """The same for DuckDB, the rounds written out."""

    def host(u: str) -> str:
        return f"CASE WHEN {u} IS NULL OR strpos({u}, '://') = 0 THEN '' ELSE translate(regexp_extract(substr({u}, strpos({u}, '://') + 3), '^([^/?#]*)', 1), '{UPPER}', '{LOWER}') END"

    listed = ", ".join(f"('{v}', '{h}', '{p}')" for v, h, p in rules)
    steps = ["s0 AS MATERIALIZED (SELECT kind, host, score FROM seed)"]
    for i in range(1, rounds + 1):
        steps.append(
            f"s{i} AS MATERIALIZED (SELECT kind, host, sum(score) AS score FROM (SELECT s.kind, e.dst AS host, s.score * e.share * {damping} AS score FROM s{i - 1} s JOIN e ON s.kind = e.kind AND s.host = e.src UNION ALL SELECT kind, host, score FROM seed) GROUP BY ALL)"
        )
    return f"""
WITH g AS (SELECT row_number() OVER () AS n, page_id, url, html, {host("url")} AS host, CASE WHEN url IS NULL OR strpos(url, '://') = 0 THEN '' ELSE regexp_extract(substr(url, strpos(url, '://') + 3), '^[^/?#]*([^?#]*)', 1) END AS path FROM pages),
l AS (SELECT * FROM (VALUES {listed}) AS l(v, h, p)),
r AS (SELECT g.*, v, h || p AS rule FROM g LEFT JOIN l ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) QUALIFY row_number() OVER (PARTITION BY n ORDER BY length(h || p) DESC) = 1),
d AS (SELECT host, (count(*) FILTER (WHERE v = 'allow') - count(*) FILTER (WHERE v = 'block')) / count(*) AS d FROM r WHERE host <> '' GROUP BY host),
seed AS MATERIALIZED (SELECT 't' AS kind, host, d * (1 - {damping}) AS score FROM d WHERE d > 0 UNION ALL SELECT 'd', host, -d * (1 - {damping}) FROM d WHERE d < 0),
k AS (SELECT src, dst, count(*) AS n FROM (SELECT host AS src, {host("CASE WHEN starts_with(u, '//') THEN ':' || u ELSE u END")} AS dst FROM (SELECT host, unnest(regexp_extract_all(html, '(?i)href\\s*=\\s*["'']?((?:[a-z][a-z0-9+.-]*:)?//[^"''\\s>]+)', 1)) AS u FROM g)) WHERE src <> '' AND dst <> '' AND src <> dst GROUP BY ALL),
b AS (SELECT 't' AS kind, src, dst, n FROM k UNION ALL SELECT 'd', dst, src, n FROM k),
e AS MATERIALIZED (SELECT kind, src, dst, n / sum(n) OVER (PARTITION BY kind, src) AS share FROM b),
{", ".join(steps)},
w AS (SELECT host, coalesce(sum(score) FILTER (WHERE kind = 't'), 0) AS t, coalesce(sum(score) FILTER (WHERE kind = 'd'), 0) AS x FROM s{rounds} GROUP BY host)
SELECT page_id, r.host, path, rule, coalesce(v, CASE WHEN x >= {threshold} AND x > t THEN 'block' ELSE 'allow' END) AS verdict FROM r LEFT JOIN w USING (host)
"""
