"""N-gram Jaccard join (operator 10) over a token-group matrix.

Two documents link when 100 * |A & B| >= 75 * |A | B| of their distinct word shingles; the
result is each document's connected component.  All links count, none is estimated.

1. Each text becomes a set of 64-bit shingle hashes.  Equal sets (128 bits) are one node,
   which gets a number.
2. Tokens have a global order: by hash, but the most frequent ones (found on a sixteenth
   of the documents; they only order, they don't decide) come last and are called heavy.
   A node posts the light tokens of the first 2/7 of the hash range, or as many of its first
   tokens as any partner must meet, if those are more.  Two nodes' common tokens up to the
   lesser of their ends are all posted by both, so shared postings plus the rest beyond the
   end bound the overlap.  Nodes whose postings are shared too seldom for any partner drop
   out first.
3. Similar nodes are gathered in groups: each node is bounded against, and then compared
   with, the first and last node of every light token it posts, and of every heavy one the
   node with the fewest light tokens; found links give groups, each a part of one component,
   of at most ``GROUP`` nodes.
4. The matrix: (token, group) holds if a token is in the union of a group.  A
   node's overlap with any member of a group is at most its tokens in the group's union plus
   its rest.  Only groups of other components that may qualify are opened, and their
   members compared one by one.

Heavy tokens would bring all documents of a common passage together, so they are met in
another way.  A linked pair either shares a light token, and then posts a common light one
as its first; those pairs come from the matrix over light tokens.  Or its whole overlap
is heavy: with h heavy of n shingles, 7 * min(h) >= 3 * (n + n').  The smaller of
the two then has 7 * h >= 6 * n, it is nearly all heavy; and the larger is of a size that
the smaller's h allows.  The matrix over heavy tokens holds groups of such smaller nodes
only, by token and component, so a passage in a third of all documents, which is a small
part of each, meets none.

Nulls and short texts: a null text, or one without words, has an empty set and links with
nothing; with fewer words than a shingle the whole sequence is the one shingle.  A null
doc_id has a null component and gives none to others.  Rows with the same doc_id are one
document of all their links.  Ties go to the smaller doc_id.  An empty table gives an
empty result.  Other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import components, counted_broadcasts, fresh, give_back, join_counted, mix64, sized, slices, small_batches, stage, windows_hash
from .flat import word_hashes

U64 = np.uint64
#: Share of the hash range whose tokens every node posts, in 64ths.
RANGE = U64(18 << 58)
#: Tokens that may be ordered last; bounds what is broadcast.
HEAVY = 1 << 16
GROUP = 256


def shingle_sets(texts: pa.Array, n: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of each text's shingles, A-Z lower-cased."""
    h, bounds = word_hashes(texts, lower=True)
    every = mix64(windows_hash(h, n) + U64(n))
    for a, z in zip(bounds.tolist(), bounds[1:].tolist()):
        if z - a >= n:
            yield np.unique(every[a : z - n + 1])
        elif z > a:
            yield mix64(windows_hash(h[a:z], z - a) + U64(z - a))
        else:
            yield np.zeros(0, np.uint64)


def shingles(text: str | None, n: int = 5) -> np.ndarray:
    return next(shingle_sets(pa.array([text], pa.string()), n))


def overlap_needed(a, b):
    """7 * |A & B| must reach this."""
    return 3 * (a + b)


def _heavy_tokens(docs: DataFrame, n: int) -> np.ndarray:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0

        def flush() -> pa.RecordBatch:
            t, c = np.unique(np.concatenate(parts), return_counts=True)
            t, c = t[c > 1], c[c > 1]
            return pa.RecordBatch.from_arrays([pa.array(t.view(np.int64)), pa.array(c.astype(np.int64))], ["token", "n"])

        for b in slices(batches, "text", 2 << 20):
            for s in shingle_sets(b.column(0), n):
                parts.append(s)
                size += len(s)
            if size > 1_000_000:
                yield flush()
                parts, size = [], 0
        if parts:
            yield flush()

    part = docs.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(16)) == 0).select("text")
    found = part.mapInArrow(count, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).where("n >= 4")
    rows = found.orderBy(F.desc("n"), "token").limit(HEAVY).select("token").toPandas()
    return np.sort(rows["token"].to_numpy(np.int64).view(np.uint64))


def posted(tokens: np.ndarray, heavy: np.ndarray) -> tuple[np.ndarray, int, int, int]:
    """The tokens that a node posts, and how many of them are in the common range, how many are light, and how many of all its tokens are heavy."""
    if len(heavy):
        at = np.minimum(np.searchsorted(heavy, tokens), len(heavy) - 1)
        last = heavy[at] == tokens
        light = tokens[~last]
    else:
        last, light = np.zeros(len(tokens), bool), tokens
    s0 = int(np.searchsorted(light, RANGE))
    least = len(tokens) - (3 * len(tokens) + 3) // 4 + 1
    p = light[:s0] if s0 >= least else np.concatenate([light, tokens[last]])[:least]
    return p, s0, min(len(p), len(light)), len(tokens) - len(light)


#: What a posting tells of its node: shingles, posted in the range, posted, posted light, heavy of all.
FACTS = ("n", "s0", "sp", "lp", "h")


def _wide(x: str = "") -> Column:
    return F.col(f"{x}sp") > F.col(f"{x}s0")


def _bound(c: Column, a: str, b: str) -> Column:
    """An upper bound of the overlap of nodes a and b that share c light postings."""
    rest = lambda x: F.col(f"{x}_n") - F.col(f"{x}_s0")
    low = lambda x: F.col(f"{x}_n") - F.col(f"{x}_lp")
    return c + F.when(_wide(f"{a}_") & _wide(f"{b}_"), F.least(F.greatest(low(a), low(b)), rest(a), rest(b))).otherwise(F.least(rest(a), rest(b)))


def jaccard_components(docs: DataFrame, n: int = 5, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, n_shingles, component_id)`` of each row."""
    return _located(docs, n, bucket_bytes).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


@counted_broadcasts
@small_batches
def _located(docs: DataFrame, n: int = 5, bucket_bytes: int = 8 << 20) -> DataFrame:
    """``(doc_id, th, n, node, check, component_id)`` of each row; th is the hash of its text, node and check are its set's."""
    spark = docs.sparkSession
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // bucket_bytes))
    heavy = _heavy_tokens(docs, n)
    heavy_b = spark.sparkContext.broadcast(heavy)

    # -- sets, nodes and postings in one pass over the texts
    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        hv = heavy_b.value
        for b in slices(batches, "text", 3 << 20, 16384):
            rows, tok, idx = [], [], []
            nodes: dict[tuple[int, int], int] = {}
            facts = []
            for doc, th, s in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), shingle_sets(b.column(2), n), strict=True):
                digest = xxhash.xxh3_128_intdigest(s.tobytes()) if len(s) else 0
                node, check = ((digest >> 64) - (1 << 63), (digest & ((1 << 64) - 1)) - (1 << 63)) if len(s) else (None, None)
                rows.append((doc, th, len(s), node, check))
                if node is not None and doc is not None and (node, check) not in nodes:
                    nodes[node, check] = len(nodes)
                    p, s0, lp, h = posted(s, hv)
                    tok.append(p)
                    idx.append(np.full(len(p), nodes[node, check], np.uint16))
                    facts.append((node, check, len(s), s0, len(p), lp, h))
            cols = list(zip(*rows, strict=True)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(len(rows), pa.int32()), pa.nulls(len(rows), pa.binary()), *(pa.array(c, pa.int64()) for c in cols)],
                ["bucket", "data", "doc_id", "th", "n", "node", "check"],
            )
            if tok:
                t, i = np.concatenate(tok), np.concatenate(idx)
                at = ((t >> U64(32)) * U64(n_buckets) >> U64(32)).astype(np.int64)
                o = np.argsort(at, kind="stable")
                cut = np.searchsorted(at[o], np.arange(n_buckets + 1))
                f = np.array(facts, np.int64)
                out = []
                for k in range(n_buckets):
                    r = o[cut[k] : cut[k + 1]]
                    if len(r):
                        who, local = np.unique(i[r], return_inverse=True)
                        out.append((k, b"".join((np.array([len(who), len(r)], np.int64).tobytes(), f[who, :2].tobytes(), f[who, 2:].astype(np.int32).tobytes(), t[r].tobytes(), local.astype(np.uint16).tobytes()))))
                none = pa.nulls(len(out), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([d for _, d in out], pa.binary()), none, none, none, none, none], ["bucket", "data", "doc_id", "th", "n", "node", "check"])

    def match(t: pa.Table) -> pa.Table:
        """Postings of a bucket that several nodes share; rows of documents pass."""
        give_back()
        plain = t.filter(pc.is_valid(t.column("th")))
        tok, own, names, known, k0 = [np.zeros(0, np.uint64)], [np.zeros(0, np.int32)], [np.zeros((0, 2), np.int64)], [np.zeros((0, 5), np.int32)], 0
        for d in t.column("data"):
            if d.is_valid:
                d = d.as_py()
                k, m = np.frombuffer(d, np.int64, 2).tolist()
                names.append(np.frombuffer(d, np.int64, 2 * k, 16).reshape(k, 2))
                known.append(np.frombuffer(d, np.int32, 5 * k, 16 + 16 * k).reshape(k, 5))
                tok.append(np.frombuffer(d, "<u8", m, 16 + 36 * k))
                own.append(np.frombuffer(d, np.uint16, m, 16 + 36 * k + 8 * m).astype(np.int32) + np.int32(k0))
                k0 += k
        names, known = np.concatenate(names), np.concatenate(known)
        order = np.lexsort((names[:, 1], names[:, 0]))  # copies in other tasks are one node
        place = np.empty(len(order), np.int32)
        place[order] = np.cumsum(np.r_[False, (names[order][1:] != names[order][:-1]).any(axis=1)][: len(order)])
        at = np.empty(place.max(initial=-1) + 1, np.int64)
        at[place] = np.arange(len(place))
        tok, own = np.concatenate(tok), place[np.concatenate(own)]
        o = np.lexsort((own, tok))
        tok, own = tok[o], own[o]
        first = np.r_[True, (tok[1:] != tok[:-1]) | (own[1:] != own[:-1])][: len(tok)]
        tok, own = tok[first], own[first]
        same = np.r_[False, tok[1:] == tok[:-1]][: len(tok)]
        keep = same | np.r_[same[1:], False][: len(tok)]
        tok, own = tok[keep], at[own[keep]]
        node, facts = names[own], known[own]
        m, hv = len(tok), heavy_b.value
        is_heavy = np.isin(tok, hv)
        col = lambda name, x: pa.concat_arrays([plain.column(name).combine_chunks().cast(pa.int64()) if plain.num_rows else pa.array([], pa.int64()), x])
        none, num = pa.nulls(m, pa.int64()), lambda x: pa.array(x.astype(np.int64))
        return pa.table(
            {
                "doc_id": col("doc_id", none),
                "th": col("th", none),
                "n": col("n", num(facts[:, 0])),
                "node": col("node", pa.array(node[:, 0])),
                "check": col("check", pa.array(node[:, 1])),
                "token": pa.concat_arrays([pa.nulls(plain.num_rows, pa.int64()), pa.array(tok.view(np.int64))]),
                **{f: pa.concat_arrays([pa.nulls(plain.num_rows, pa.int64()), num(facts[:, i])]) for i, f in enumerate(FACTS) if i},
                "heavy": pa.concat_arrays([pa.nulls(plain.num_rows, pa.bool_()), pa.array(is_heavy)]),
            }
        )

    raw = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(post, "bucket int, data binary, doc_id long, th long, n long, node long, check long")
    spread = raw.withColumn("bucket", F.coalesce("bucket", F.pmod(F.xxhash64("doc_id", "th"), F.lit(n_buckets)).cast("int")))
    both = stage(spread.groupBy("bucket").applyInArrow(match, "doc_id long, th long, n long, node long, check long, token long, s0 long, sp long, lp long, h long, heavy boolean"), "postings")
    rows = both.where("token is null").select("doc_id", "th", "n", "node", "check")
    # a node is numbered once, in a staged table, so that equal 64-bit halves do no harm
    named = rows.where("node is not null and doc_id is not null").groupBy("node", "check").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.count("*").alias("k"))
    nodes = stage(named.withColumn("id", F.monotonically_increasing_id()), "nodes")

    # -- nodes whose postings are shared too seldom drop out; twice, as partners drop too
    shared, key = both.where("token is not null").select("token", "node", "check", *FACTS, "heavy"), ["node", "check"]
    wide = _wide()
    # A link of a (n_a shingles, s0 posted in the range) needs common postings with its partner b:
    # at least 3/28 n_a if b posts only its range (its rest is under 3/4 n_b), at least
    # s0 - n_a/4 if b posts beyond it, and one in any case.
    for _ in range(2):
        w = F.when(wide, 1).otherwise(0)
        per_token = shared.groupBy("token").agg(F.sum(w).alias("mw"), F.sum(1 - w).alias("ml"))
        counts = shared.join(per_token, "token").groupBy(*key, "n", "s0", "sp")
        counts = counts.agg(F.sum(F.when(F.col("ml") > 1 - w, 1).otherwise(0)).alias("cl"), F.sum(F.when(F.col("mw") > w, 1).otherwise(0)).alias("cw"))
        enough = F.when(wide, F.col("cl") + F.col("cw") > 0).otherwise(((F.col("cl") > 0) & (28 * F.col("cl") >= 3 * F.col("n"))) | ((F.col("cw") > 0) & (4 * F.col("cw") >= 4 * F.col("s0") - F.col("n"))))
        alive = counts.where(enough).select(*key)
        if len(key) == 2:  # from here on nodes go by number
            alive = alive.join(nodes.select(*key, "id"), key)
            left = shared.join(sized(stage(alive, "alive"), 24), key).drop(*key).withColumnRenamed("id", "node")
            key = ["node"]
        else:
            left = shared.join(sized(stage(alive, "alive"), 8), key, "left_semi")
        multi = left.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
        shared = stage(left.join(multi, "token", "left_semi").select("token", "node", *FACTS, "heavy"), "shared")

    # -- sets of what is left
    alive = stage(shared.select("node").distinct().join(nodes.select(F.col("id").alias("node"), "rep"), "node").select("node", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")), "survivors")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, "text"):
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([s.tobytes() for s in shingle_sets(b.column(1), n)], pa.binary())], ["node", "set"])

    texts = docs.where("doc_id is not null").withColumn("th", F.xxhash64("text")).join(sized(alive, 40), ["doc_id", "th"])
    sets = stage(texts.dropDuplicates(["node"]).select("node", "text").mapInArrow(sets_of, "node long, set binary"), "sets")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches, None, max_rows=256):
            out = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                s, t = np.frombuffer(x.as_buffer(), "<u8"), np.frombuffer(y.as_buffer(), "<u8")
                out.append(7 * len(np.intersect1d(s, t, assume_unique=True)) >= overlap_needed(len(s), len(t)))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], ["a", "b"]).filter(pa.array(out, pa.bool_()))

    def links_of(pairs: DataFrame) -> DataFrame:
        x = pairs.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a")
        return x.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), "b").select("a", "b", "x", "y").mapInArrow(compare, "a long, b long")

    fits = 7 * _bound(F.col("c"), "a", "b") >= overlap_needed(F.col("a_n"), F.col("b_n"))
    sizes = (4 * F.col("a_n") >= 3 * F.col("b_n")) & (4 * F.col("b_n") >= 3 * F.col("a_n"))

    # -- groups of similar nodes: each node against the first and last node of its light tokens,
    # and of heavy ones the one nearest to all heavy
    light, heavy_part = shared.where("not heavy"), shared.where("heavy")
    ends = light.groupBy("token").agg(F.min(F.struct("node", *FACTS)).alias("lo"), F.max(F.struct("node", *FACTS)).alias("hi"))
    a_side = lambda rows: rows.select("token", *(F.col(c).alias(f"a_{c}" if c != "node" else "a") for c in ("node", *FACTS)))
    both_sides = ["a", "b", *(f"{x}_{c}" for x in "ab" for c in FACTS)]
    flat_b = lambda rows: rows.select("*", F.col("e.node").alias("b"), *(F.col(f"e.{c}").alias(f"b_{c}") for c in FACTS)).drop("e").where((F.col("a") != F.col("b")) & sizes)
    star = flat_b(a_side(light).join(ends, "token").withColumn("e", F.explode(F.array("lo", "hi"))).drop("lo", "hi"))
    star = star.groupBy(*both_sides).agg(F.count("*").alias("c")).where(fits).select("a", "b")
    pivots = heavy_part.groupBy("token").agg(F.min(F.struct((F.col("n") - F.col("h")).alias("far"), "node", *FACTS)).alias("e"))
    all_heavy = flat_b(a_side(heavy_part).join(pivots, "token")).where(7 * (F.least("a_h", "b_h") + F.least(F.col("a_n") - F.col("a_h"), F.col("b_n") - F.col("b_h"))) >= overlap_needed(F.col("a_n"), F.col("b_n")))
    star = star.union(all_heavy.select("a", "b")).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    links = stage(links_of(star), "links")
    parts = stage(components(links), "parts")

    # -- the token-group matrix over what is not yet connected
    members = shared.join(parts.withColumnRenamed("component", "part"), "node", "left").withColumn("part", F.coalesce("part", "node"))
    width = parts.groupBy("component").agg(F.count("*").alias("w")).withColumnRenamed("component", "part")
    members = members.join(width, "part", "left").withColumn("w", F.coalesce("w", F.lit(1)))
    members = members.withColumn("grp", F.pmod(F.xxhash64("node"), F.ceil(F.col("w") / GROUP)))
    cross = members.groupBy("token").agg(F.min("part").alias("p0"), F.max("part").alias("p1")).where("p0 <> p1").select("token")
    members = stage(members.join(cross, "token", "left_semi"), "members")
    facts = members.select("part", "grp", "node", *FACTS).distinct()
    q, g = members.where("not heavy").alias("q"), members.where("not heavy").groupBy("token", "part", "grp", "w").agg(F.min("n").alias("lo"), F.max("n").alias("hi")).alias("g")
    meets = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.struct("q.w", "q.part") < F.struct("g.w", "g.part")) & (4 * F.col("g.hi") >= 3 * F.col("q.n")) & (4 * F.col("q.n") >= 3 * F.col("g.lo")))
    meets = meets.groupBy(F.col("q.node").alias("a"), F.col("q.n").alias("a_n"), F.col("q.s0").alias("a_s0"), F.col("q.sp").alias("a_sp"), F.col("q.lp").alias("a_lp"), F.col("g.part").alias("part"), F.col("g.grp").alias("grp")).agg(F.count("*").alias("c"))
    span = facts.groupBy("part", "grp").agg(F.min("n").alias("lo"), F.max(F.col("n") - F.col("lp")).alias("rest_wide"), F.min(wide).alias("all_wide"))
    rest_q = F.col("a_n") - F.col("a_s0")
    room = F.when(_wide("a_") & F.col("all_wide"), F.least(rest_q, F.greatest(F.col("a_n") - F.col("a_lp"), F.col("rest_wide")))).otherwise(rest_q)
    # no member can be smaller than 3/4 of the query
    opened = meets.join(span, ["part", "grp"]).where(7 * (F.col("c") + room) >= overlap_needed(F.col("a_n"), F.greatest(F.col("lo"), F.ceil(F.col("a_n") * 3 / 4))))

    # heavy tokens: queries that can have a heavy overlap only, against groups of nodes nearly all heavy and not larger
    reach = F.floor((7 * F.col("h") - 3 * F.col("n")) / 3)  # the largest partner
    unposted = F.col("h") - (F.col("sp") - F.col("lp"))
    q = members.where("heavy and 4 * h >= 3 * n").withColumns({"reach": reach, "unposted": unposted}).alias("q")
    g = members.where("heavy and 7 * h >= 6 * n").groupBy("token", "part", "grp").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(reach).alias("far"), F.max(unposted).alias("unposted")).alias("g")
    dense = q.join(g, (F.col("q.token") == F.col("g.token")) & (F.col("q.part") != F.col("g.part")) & (F.col("g.lo") <= F.least("q.n", "q.reach")) & (4 * F.col("g.hi") >= 3 * F.col("q.n")) & (F.col("q.n") <= F.col("g.far")))
    dense = dense.groupBy(F.col("q.node").alias("a"), F.col("q.n").alias("a_n"), F.col("q.h").alias("a_h"), F.col("q.unposted").alias("a_un"), F.col("g.part").alias("part"), F.col("g.grp").alias("grp")).agg(F.count("*").alias("c"), F.min("g.lo").alias("lo"), F.max("g.unposted").alias("un"))
    dense = dense.where(7 * F.least(F.col("a_h"), F.col("c") + F.greatest("a_un", "un")) >= overlap_needed(F.col("a_n"), F.greatest(F.col("lo"), F.ceil(F.col("a_n") * 3 / 4))))

    # each opened group meets its queries in one place, in blocks of queries; as its members are
    # connected, a query is done at its first link
    opened = stage(opened.select("a", "part", "grp").union(dense.select("a", "part", "grp")).distinct(), "opened")
    blocks = opened.groupBy("part", "grp").agg(F.ceil(F.count("*") / 1000).alias("k"))
    asked = opened.join(blocks, ["part", "grp"]).withColumn("block", F.pmod(F.xxhash64("a"), F.col("k")))
    asked = asked.join(sets.select(F.col("node").alias("a"), F.col("set").alias("x")), "a").select("part", "grp", "block", "a", "x")
    inside = facts.select("part", "grp", "node").join(blocks, ["part", "grp"]).select("part", "grp", "node", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)).alias("block"))
    inside = inside.join(sets.select(F.col("node").alias("b"), F.col("set").alias("y")), F.col("node") == F.col("b")).select(F.col("part").alias("part2"), F.col("grp").alias("grp2"), F.col("block").alias("block2"), "b", "y")

    def first_links(queries: pa.Table, group: pa.Table) -> pa.Table:
        members = sorted(((len(x) // 8, node, np.frombuffer(x, "<u8")) for node, x in zip(group.column("b").to_pylist(), group.column("y").to_pylist(), strict=True)), key=lambda m: m[:2])
        found = []
        for q, x in zip(queries.column("a").to_pylist(), queries.column("x").to_pylist(), strict=True):
            s = np.frombuffer(x, "<u8")
            for n_m, node, t in sorted(members, key=lambda m: abs(m[0] - len(s))):
                if 4 * min(n_m, len(s)) < 3 * max(n_m, len(s)):
                    continue  # a larger member may still qualify: the ratio allows it a larger difference
                if 7 * len(np.intersect1d(s, t, assume_unique=True)) >= overlap_needed(len(s), n_m):
                    found.append((q, node))
                    break
        return pa.table({"a": pa.array([f[0] for f in found], pa.int64()), "b": pa.array([f[1] for f in found], pa.int64())})

    more = asked.groupBy("part", "grp", "block").cogroup(inside.groupBy("part2", "grp2", "block2")).applyInArrow(first_links, "a long, b long")
    final = stage(components(stage(parts.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more), "all-links")), "node-components")

    # -- back to documents: a component's smallest doc_id comes from its nodes' smallest
    low = nodes.select("node", "check", "k", "id", F.col("rep.doc_id").alias("doc")).join(final.select(F.col("node").alias("id"), "component"), "id", "left").withColumn("component", F.coalesce("component", "id"))
    low = stage(low, "node-names")
    least = stage(low.groupBy("component").agg(F.min("doc").alias("component_id"), F.count("*").alias("k")), "least")
    found = stage(join_counted(low.withColumnRenamed("k", "copies"), least, ["component"], low.count()).select("node", "check", "component_id", F.col("copies").alias("k")), "found")
    known = rows.where("node is not null and doc_id is not null")
    total = rows.count()
    placed = join_counted(known, found, ["node", "check"], total).select("doc_id", "th", "n", "node", "check", "component_id")
    lone = rows.where("node is null or doc_id is null").withColumn("component_id", F.col("doc_id"))
    several = known.groupBy("doc_id").agg(F.count("*").alias("k")).where("k > 1").limit(1).count() + lone.where("doc_id is not null").select("doc_id").join(known.select("doc_id"), "doc_id", "left_semi").limit(1).count()
    if several:  # one doc_id with different texts joins their components
        placed = stage(placed, "placed")
        by_doc = stage(placed.groupBy("doc_id").agg(F.min("component_id").alias("first"), F.count("*").alias("k")), "by-doc")
        pairs = join_counted(placed, by_doc, ["doc_id"], total).where("component_id <> first").select(F.col("component_id").alias("a"), F.col("first").alias("b"))
        merged = stage(components(pairs), "merged")
        by_doc = stage(by_doc.join(merged.select(F.col("node").alias("first"), "component"), "first", "left").select("doc_id", F.coalesce("component", "first").alias("named"), "k"), "by-doc")
        placed = join_counted(placed.drop("component_id"), by_doc, ["doc_id"], total).withColumnRenamed("named", "component_id")
        lone = lone.drop("component_id").join(by_doc.select("doc_id", "named"), "doc_id", "left").withColumn("component_id", F.coalesce("named", "doc_id")).drop("named")
    out = placed.unionByName(lone)
    return out.select("doc_id", "th", "n", "node", "check", "component_id")


def drop_near_duplicates(docs: DataFrame, n: int = 5) -> DataFrame:
    """The documents that are their component's smallest doc_id, or have none, with their own columns.

    Of rows with equal sets under one doc_id, or under none, one stays; a row without
    doc_id goes if a doc_id has its set.  Rows without words all stay.
    """
    found = stage(_located(docs, n), "located")
    doc, text, first = fresh(docs, "_doc", "_th", "_first")
    gone = stage(found.where("doc_id <> component_id").select(F.col("doc_id").alias(doc)).distinct(), "duplicates")
    left = docs.join(sized(gone, 24), docs["doc_id"] == gone[doc], "left_anti")

    stays = found.where("node is not null and (doc_id is null or doc_id = component_id)")
    sets = stays.groupBy("doc_id", "node", "check").agg(F.count("*").alias("k"), F.min("th").alias("keep"))
    known = found.where("doc_id is null and node is not null").select("node", "check").join(found.where("doc_id is not null").select("node", "check"), ["node", "check"], "left_semi").distinct()
    sets = sets.join(known.withColumn("known", F.lit(True)), ["node", "check"], "left").withColumn("known", F.col("doc_id").isNull() & F.coalesce("known", F.lit(False)))
    sets = stage(sets.where("k > 1 or known").select(F.col("doc_id").alias("d"), F.col("node").alias("s"), F.col("check").alias("c"), "keep", "known"), "repeated")
    if not sets.limit(1).count():
        return left
    again = stays.join(sized(sets, 40), F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("node") == F.col("s")) & (F.col("check") == F.col("c")))
    again = stage(again.select(F.col("doc_id").alias(doc), F.col("th").alias(text), (~F.col("known") & (F.col("th") == F.col("keep"))).alias(first)).distinct(), "repeats")
    rows = left.join(sized(again, 32), left["doc_id"].eqNullSafe(again[doc]) & (F.xxhash64(left["text"]) == again[text]), "left")
    once = rows.where(F.col(first)).dropDuplicates([doc, text])
    return rows.where(F.col(first).isNull()).union(once).drop(doc, text, first)


SQL = r"""
WITH RECURSIVE t AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[ \t\n\x0B\f\r]+'), lambda s: s <> '') AS ws FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(ws[i:i+4], ' ') AS g FROM (SELECT *, unnest(range(1, greatest(len(ws) - 3, 2))) AS i FROM t WHERE len(ws) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
c AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM c JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT doc_id AS a, doc_id AS b FROM t UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a)
SELECT t.doc_id, coalesce(n, 0) AS n_shingles, (SELECT min(b) FROM r WHERE r.a = t.doc_id) AS component_id FROM t LEFT JOIN n USING (doc_id)
"""
