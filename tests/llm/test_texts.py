"""Operators over documents against brute force."""

import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pytest

from orgweave.llm import bayes, bpe, common, jaccard, logindex, packing, quality, shards, suffix

from .conftest import corpus, prose

WORD = re.compile(r"[^\x20\x09-\x0D]+")
key = lambda r: tuple((x is None, str(x)) for x in r)


def same(df, want):
    assert sorted(map(tuple, df.collect()), key=key) == sorted(want, key=key)


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()


def test_bpe_is_the_librarys(odd, none, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers["word_bpe_49k.json"]
    lib, want = Tokenizer.from_file(path), []
    for d, t in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids
        want.append((d, len(ids), sha(np.array(ids, "<u4").tobytes()), sha(lib.decode(ids, skip_special_tokens=False))))
    same(bpe.bpe_round_trip(odd, path), want)
    assert bpe.bpe_round_trip(none, path).count() == 0
    assert "ids" in bpe.bpe_round_trip(odd, path, with_ids=True).columns


def test_bpe_merges_skip_stale_entries(tokenizers):
    c = bpe.BpeCodec(tokenizers["word_bpe_49k.json"])
    for word in ("a", "banana", "aaaaaaaaaaaa", "antidisestablishmentarianism"):
        assert "".join(c.strings[i] for i in c.merge(word)) == word + "</w>"


def brute_spans(rows, width, parts, join):
    """Units of each row and whether each is covered by a window of a smaller doc_id."""
    first, out = {}, []
    units = [(d, parts(t or "")) for d, t in rows]
    for d, u in units:
        for p in range(len(u) - width + 1 if d is not None else 0):
            k = join(u[p : p + width])
            first[k] = min(d, first.get(k, d))
    for d, u in units:
        gone = [False] * len(u)
        for p in range(len(u) - width + 1 if d is not None else 0):
            if first[join(u[p : p + width])] < d:
                gone[p : p + width] = [True] * width
        out.append((d, u, gone))
    return out


@pytest.mark.parametrize("group_bytes", [12 << 20, 3000])
def test_suffix_dedup(odd, none, group_bytes):
    want = []
    for d, u, gone in brute_spans(corpus(), 50, str.encode, bytes):
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        want.append((d, len(u), sum(gone), spans, sha(bytes(b for b, g in zip(u, gone, strict=True) if not g))))
    same(suffix.suffix_dedup(odd, group_bytes=group_bytes), want)
    assert suffix.suffix_dedup(none).count() == 0
    assert sum(w[2] for w in want) > 10_000


def test_suffix_texts(odd):
    kept = suffix.suffix_dedup(odd, with_text=True).collect()
    assert all(sha(bytes(r["kept"])) == r["kept_sha256"] for r in kept)


@pytest.mark.parametrize("depth", [20, 50])
def test_deep_shallow_sorts(depth):
    r = np.random.default_rng(0)
    buf = np.concatenate([r.integers(97, 99, 800).astype(np.uint8), np.tile(r.integers(97, 99, 30).astype(np.uint8), 20), np.zeros(64, np.uint8)])
    at, seg = r.permutation(1300), r.integers(0, 3, 1300)
    order, new = suffix.deep_shallow(suffix.words_at(buf), at, seg, depth)
    keys = [(seg[i], buf.tobytes()[at[i] : at[i] + depth]) for i in order]
    assert keys == sorted(keys) and new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]


@pytest.mark.parametrize("shallow", [8, 16, 64])
def test_deep_shallow_sorts_by_each_segments_depth(shallow):
    r = np.random.default_rng(1)
    buf = np.concatenate([r.integers(97, 99, 300).astype(np.uint8), np.tile(r.integers(97, 256, 40).astype(np.uint8), 30), np.zeros(140, np.uint8)])
    at, seg = r.integers(0, 1400, 3000), r.integers(0, 5, 3000)
    depth = np.array([1, 16, 33, 50, 112])[seg]
    order, new = suffix.deep_shallow(suffix.words_at(buf), at, seg, depth, shallow)
    keys = [(seg[i], buf.tobytes()[at[i] : at[i] + depth[i]]) for i in order]
    assert keys == sorted(keys) and new.tolist() == [i == 0 or keys[i] != keys[i - 1] for i in range(len(keys))]
    cls, first = suffix.equal_spans(suffix.words_at(buf), at, depth, np.zeros(3000, np.int64))
    texts = [buf.tobytes()[a : a + d] for a, d in zip(at, depth)]
    assert len({*zip(cls.tolist(), texts, strict=True)}) == len(set(texts)) == len(first) and all(texts.index(texts[i]) == i for i in first)


def test_suffix_dedup_of_a_passage_between_varying_neighbours(spark):
    shared = prose(40, 90)
    rows = [(i, prose(30, i) + (" " + shared + " " if i % 3 else " ") + prose(30, 200 + i)) for i in range(30)]
    want = []
    for d, u, gone in brute_spans(rows, 50, str.encode, bytes):
        want.append((d, len(u), sum(gone), sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone)), sha(bytes(b for b, g in zip(u, gone, strict=True) if not g))))
    assert sum(w[2] for w in want) > 1000
    for group_bytes in (1 << 20, 2000):
        same(suffix.suffix_dedup(spark.createDataFrame(rows, "doc_id long, text string"), group_bytes=group_bytes), want)


@pytest.mark.parametrize("batches", [1, 4])
def test_substring_dedup(odd, none, batches):
    want = [(d, len(u), sum(gone), sha(" ".join(w for w, g in zip(u, gone, strict=True) if not g))) for d, u, gone in brute_spans(corpus(), 50, WORD.findall, tuple)]
    same(logindex.substring_dedup(odd, n_batches=batches, fan_in=2), want)
    assert logindex.substring_dedup(none).count() == 0
    assert sum(w[2] for w in want) > 1000


def test_substring_dedup_of_two_calls_is_that_of_one(spark):
    shared = prose(70, 90)
    rows = [(i, prose(40, i) + (f" {shared} " if i % 3 else " ") + prose(40, 300 + i % 7)) for i in range(40)] + [(40, None), (41, ""), (42, prose(30, 1))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    index = logindex.LogIndex(spark, 8, name="two_calls")
    index.drop()
    try:
        whole = sorted(map(tuple, logindex.substring_dedup(docs).collect()))
        parts, done = [], None
        for low, high in ((0, 20), (20, 30), (30, 43)):
            part = docs.where(f"doc_id >= {low} and doc_id < {high}")
            parts += map(tuple, logindex.substring_dedup(part, n_batches=2, fan_in=2, index_name="two_calls", history=done).collect())
            done = docs.where(f"doc_id < {high}")
        assert sorted(parts) == whole and sum(r[2] for r in whole) > 1000
        left = logindex.LogIndex(spark, 3, name="two_calls")
        assert left.runs() and left.n_buckets == 8
    finally:
        logindex.LogIndex(spark, 8, name="two_calls").drop()
    assert not logindex.LogIndex(spark, 8, name="two_calls").runs()
    with pytest.raises(ValueError, match="index name"):
        logindex.LogIndex(spark, 8, name="no-hyphen")


def test_removed_passages_leave_the_rest_alone(odd):
    out = logindex.remove_repeated(odd)
    assert out.columns == odd.columns and out.count() == odd.count()
    got = {r["doc_id"]: r for r in out.collect() if r["doc_id"] != 5}
    assert got[1]["text"] == dict(corpus())[1] and got[20]["text"] == "" and got[20]["n_chars"] == 0
    assert got[21]["text"].startswith(prose(30, 4)) and got[40]["text"] is None


def brute_components(rows):
    def grams(t):
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()

    sets = [(d, grams(t)) for d, t in rows]
    parent = {d: d for d, _ in sets if d is not None}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, s in sets:
        for b, t in sets:
            if a is not None and b is not None and s and t and 100 * len(s & t) >= 75 * len(s | t):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else find(d)) for d, s in sets]


def test_jaccard_components(odd, none):
    same(jaccard.jaccard_components(odd), brute_components(corpus()))
    assert jaccard.jaccard_components(none).count() == 0
    kept = jaccard.drop_near_duplicates(odd)
    assert kept.columns == odd.columns and {31, 33} & {r["doc_id"] for r in kept.collect()} == set()


def test_jaccard_of_a_large_group_of_near_copies(spark, monkeypatch):
    import random

    monkeypatch.setattr(jaccard, "GROUP", 4)
    r, base, rows = random.Random(1), prose(80, 7, "abcdefgh").split(" "), []
    for i in range(60):
        w = list(base)
        for _ in range(r.randint(0, 5)):
            w[r.randrange(80)] = f"w{r.randrange(30)}"
        rows.append((i, " ".join(w[r.randint(0, 4) :])))
    rows += [(100 + i, prose(30, 50 + i) + " " + " ".join(base[:12])) for i in range(20)]
    same(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), brute_components(rows))


def test_jaccard_of_a_group_of_mixed_sizes(spark):
    """The first has a link only to the largest, which differs more in size than the smallest, which is too small."""
    rows = []
    for i in range(24):
        w = prose(134, 200 + i, "abcdefghijklmnop").split(" ")
        rows += [(4 * i + k, " ".join(w[at:end])) for k, (at, end) in enumerate([(0, 104), (56, 134), (32, 134), (0, 134)])]
    want = brute_components(rows)
    assert {n for _, n, _ in want} == {74, 98, 100, 130} and {c for _, _, c in want} == set(range(0, 96, 4))
    same(jaccard.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")), want)


def test_one_row_of_repeated_ones_stays(spark):
    a, b, c, d = (prose(90, 300 + i, "abcdefghijklmnop") for i in range(4))
    rows = [(1, a), (1, a), (1, a.upper()), (2, a + " tail"), (7, a), (None, a), (None, b), (None, b), (3, c), (3, d), (3, d), (4, None), (4, ""), (None, None)]
    kept = jaccard.drop_near_duplicates(spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "doc_id long, text string, `_th` long"))
    assert kept.columns == ["doc_id", "text", "_th"]
    got = [(r["doc_id"], r["text"] and r["text"].lower()) for r in kept.collect()]
    assert sorted(got, key=key) == sorted([(1, a), (None, b), (3, c), (3, d), (4, None), (4, ""), (None, None)], key=key)
    assert all(tuple(r)[:2] == rows[r["_th"]] for r in kept.collect())


def test_quality_rules_against_sql(odd, none):
    pdf = pd.DataFrame(corpus(), columns=["doc_id", "text"]).astype({"doc_id": "Int64"})
    con = duckdb.connect()
    con.register("documents", pdf)
    out = quality.quality_rules(odd)
    want = con.execute(quality.sql()).df()[out.columns].astype(object)
    same(out, [tuple(None if x is pd.NA or x != x else x for x in r) for r in want.itertuples(index=False)])
    assert quality.quality_rules(none).count() == 0


def test_quality_counts_by_hand(spark):
    rows = [(1, "a b c a b c\n#x y\n#x y\n\n"), (2, None), (3, "a a a a"), (4, "x")]
    got = {r["doc_id"]: r for r in quality.quality_rules(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert (got[1]["n_words"], got[1]["word_chars"], got[1]["n_symbols"], got[1]["n_dup_lines"], got[1]["n_repeat_words"]) == (10, 12, 2, 1, 6)
    assert got[2]["n_words"] == 0 and got[2]["base_failed"] and got[3]["n_repeat_words"] == 4


def test_quality_rules_that_read_the_text(spark):
    plain = prose(60, 1)
    rows = [(1, plain), (2, plain + " https://a.b/c" * 30), (3, plain.replace(" ", "...\n", 30)), (4, plain + " {" + "}" * 20), (5, plain + " https://a.b/c..."), (6, plain.replace(" ", "...\n", 2) + "\nx" * 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"]: (r["base_failed"], r["kept"]) for r in quality.quality_rules(docs, {k: quality.RULES[k] for k in ("links", "cut_lines", "braces")}).collect()}
    assert got == {1: (False, True), 2: (False, False), 3: (False, False), 4: (False, False), 5: (False, True), 6: (False, True)}


def test_cascade_orders_by_rejection_per_cost_and_keeps_the_verdict(odd, none, monkeypatch):
    with monkeypatch.context() as m:
        m.setattr(quality, "measure", lambda sample, rules: [("a", 0.5, 1.0), ("b", 0.4, 0.1), ("c", 0.0, 0.01)])
        assert quality.cascade_order(odd, {"a": "true", "b": "true", "c": "true"}) == ["b", "a", "c"]
    assert quality.cascade_order(none) == list(quality.RULES) and set(quality.cascade_order(odd)) == set(quality.RULES)
    kept = quality.filter_quality(odd)
    assert kept.columns == odd.columns
    assert kept.count() == quality.quality_rules(odd).where("kept").count()


def test_packing(odd, none, tokenizers):
    from tokenizers import Tokenizer

    path = tokenizers["byte_bpe_50k.json"]
    lib = Tokenizer.from_file(path)
    want = Counter()
    for d, t in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        head = (len(ids) - 1) % 2048 + 1
        for piece, at in enumerate([0, *range(head, len(ids), 2048)]):
            part = ids[at : at + (head if not at else 2048)]
            want[d, piece, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())] += 1
    rows = packing.pack(odd.repartition(5), path, fan_in=2).collect()
    assert Counter(tuple(r)[:5] for r in rows) == want
    bins = {}
    for r in rows:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        end = 0
        for at, n in sorted(b):
            assert at == end
            end += n
        assert end <= 2048
    assert len(bins) <= -(-sum(r["length"] for r in rows) // 2048) + 2
    assert packing.pack(none, path).count() == 0


def test_best_fit_takes_the_tightest_bin():
    bins = packing.best_fit([(6, ["a"]), (7, ["b"]), (3, ["c"]), (4, ["d"])], 10)
    assert [m for _, m in bins] == [["a", "d"], ["b", "c"]]


def test_feistel_is_a_permutation():
    for n in (1, 2, 5, 1000):
        x = shards.feistel(np.arange(n), n, 42)
        assert sorted(x.tolist()) == list(range(n))
    assert (shards.feistel(np.arange(1000), 1000, 1) != shards.feistel(np.arange(1000), 1000, 2)).mean() > 0.9


def test_shards_round_trip(odd, none, tokenizers, tmp_path):
    from tokenizers import Tokenizer

    path = tokenizers["byte_bpe_50k.json"]
    lib = Tokenizer.from_file(path)
    pages = shards.write_shards(odd, path, length=64, shard_rows=100)
    rows = shards.read_slots(pages).collect()
    assert sorted(r["slot"] for r in rows) == list(range(len(rows))) and {r["shard"] for r in rows} == {r["slot"] // 100 for r in rows}
    want = Counter()
    for d, t in corpus():
        ids = lib.encode(t or "", add_special_tokens=False).ids + [0]
        for at in range(0, len(ids), 64):
            want[d, at, len(ids[at : at + 64]), zlib.crc32(np.array(ids[at : at + 64], "<u4").tobytes())] += 1
    assert Counter((r["doc_id"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    assert min(r["slot"] for r in shards.read_slots(pages, 150).collect()) == 150
    files = shards.export_files(pages, "file://" + str(tmp_path / "bin")).collect()
    assert sum((tmp_path / "bin" / f["file"].split("/")[-1]).stat().st_size for f in files) == len(rows) * 128
    assert shards.read_slots(shards.write_shards(none, path)).count() == 0


def test_classifier_learns_and_shrinks(spark):
    import random

    r, docs, labels = random.Random(3), [], []
    for i in range(900):
        kind = "toxic" if i % 9 == 0 else "low" if i % 7 == 0 else "ok"
        words = prose(r.randint(30, 120), i).split(" ")
        if kind == "toxic":
            words[r.randrange(len(words))] = "scum,"
            words[r.randrange(len(words))] = "Scum"
        if kind == "low":
            words = [w + "$$$" for w in words]
        docs.append((i, " ".join(words), "en", f"s{i % 5}"))
        if i % 2:
            labels.append((i, int(kind != "low"), int(kind == "toxic")))
    d = spark.createDataFrame(docs + [(None, None, None, None), (-1, None, None, "s1")], "doc_id long, text string, lang string, source string")
    out = {x["doc_id"]: x for x in bayes.classify(d, spark.createDataFrame(labels + [(3, None, 1), (None, 1, 1)], "doc_id long, quality int, toxic int")).collect()}
    held = [i for i in range(0, 900, 2)]
    right = sum(out[i]["kept"] == (i % 9 != 0 and i % 7 != 0) for i in held) / len(held)
    assert right > 0.97 and len(out) == 902


def test_classifier_without_labels_keeps_everything(odd, none, spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert bayes.classify(odd, labels).where("kept").count() == odd.count()
    assert bayes.classify(none, labels).count() == 0
    kept = bayes.filter_classified(odd, labels)
    assert kept.columns == odd.columns and kept.count() == odd.count()


def test_shrinking_against_brute_force(spark):
    """Posteriors of sites, each document left out of its own, recomputed by the formulas of the docstring; ties, null sites, sparse and hot sites."""
    from orgweave.llm import bayes

    r = np.random.default_rng(8)
    rows = [(h, p, float(e), float(t)) for (h, p), n, m in ((("a", "x"), 60, -3), (("a", "y"), 5, 2), (("b", "x"), 12, 1), (("c", None), 7, 0), (("d", "x"), 1, 4), ((None, "x"), 3, 1), ((None, None), 2, 1)) for e, t in zip(r.normal(m, 1, n), r.normal(-m, 2, n))]
    rows += rows[:3]
    df = spark.createDataFrame([(h, p, (i,), e, t) for i, (h, p, e, t) in enumerate(rows)], "_host string, _path string, _row struct<doc_id:long>, e_low double, e_toxic double")
    got = {x["doc_id"]: x for x in bayes.shrink(df).collect()}
    sure = lambda x: 1 / (1 + np.exp(-x))
    worst = np.zeros(len(rows))
    for at, name in ((2, "p_low"), (3, "p_toxic")):
        p = sure(np.array([x[at] for x in rows]))
        prior = p.mean()

        def strength(groups):
            n, s = np.array([len(g) for g in groups]), np.array([p[g].sum() for g in groups])
            spread = prior * (1 - prior)
            between = ((n * (s / n - prior) ** 2).sum() - (len(n) - 1) * spread) / (n.sum() - (n * n).sum() / n.sum())
            return min(max(spread / between - 1, 1.0), 1e6) if between > 0 else 1e6

        members = lambda f: [i for i, x in enumerate(rows) if f(x)]
        hosts = {h: members(lambda x: x[0] == h) for h in "abcd"}
        paths = {k: members(lambda x: x[:2] == k) for k in {x[:2] for x in rows if x[0] and x[1]}}
        host_m, path_m = strength(list(hosts.values())), strength(list(paths.values()))
        for i, x in enumerate(rows):
            site = prior
            if x[0]:
                g = hosts[x[0]]
                site = (p[g].sum() - p[i] + host_m * prior) / (len(g) - 1 + host_m)
                if x[1]:
                    g = paths[x[:2]]
                    site = (p[g].sum() - p[i] + path_m * site) / (len(g) - 1 + path_m)
            want = sure(x[at] + np.log(site / (1 - site)) - np.log(prior / (1 - prior)))
            assert got[i][name] == pytest.approx(want, abs=1e-9)
            worst[i] = max(worst[i], want)
    assert [got[i]["kept"] for i in range(len(rows))] == (worst < 0.5).tolist() and 0 < (worst < 0.5).sum() < len(rows)


def test_one_document_on_two_sites_is_judged_on_each(spark):
    from orgweave.llm import bayes

    good, bad = "plain words of a good page " * 9, "spam $$$ buy now " * 9
    rows = [(i, good if i % 2 else bad, "en", "good" if i % 2 else "bad") for i in range(120)] + [(500, "plain words buy now of a " * 9, "en", s) for s in ("good", "bad")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(0, 80)], "doc_id long, quality int, toxic int")
    kept = {(x["doc_id"], x["source"]) for x in bayes.filter_classified(docs, labels).collect()}
    verdicts = {(x["doc_id"], x["source"]): x["kept"] for x in bayes.classify(docs, labels, keep=("doc_id", "source")).collect()}
    assert kept == {k for k, v in verdicts.items() if v}


@pytest.mark.parametrize("sizes", [[1100, 1500], [900, 1200], [2048, 2047]])
def test_packing_of_long_documents_passes_little_on(sizes, spark, tokenizers):
    from orgweave.llm import packing

    docs = spark.range(400).selectExpr("id AS doc_id", f"repeat(' a', cast(if(id % 2 = 0, {sizes[0]}, {sizes[1]}) as int) - 1) AS text").repartition(4)
    got = packing.pack(docs, tokenizers["byte_bpe_50k.json"]).toPandas()
    assert got["length"].sum() == 200 * sum(sizes) and len(got) == 400
    whole = got.groupby("sequence_id")["length"].sum()
    # no two bins that fit together are left, but for what each task passes on at most
    loose = sorted(whole[whole <= 1024])
    assert whole.max() <= 2048 and len(loose) <= 1
    for _, g in got.groupby("sequence_id"):
        o = g.sort_values("offset")
        assert o["offset"].tolist() == [0, *o["length"].cumsum().tolist()[:-1]]


def shuffled(spark):
    """Bytes written by all shuffles so far."""
    sc = spark.sparkContext
    store, none = sc._jsc.sc().statusStore(), sc._gateway.new_array(sc._jvm.double, 0)
    return sum(x.shuffleWriteBytes() for x in sc._jvm.scala.jdk.javaapi.CollectionConverters.asJava(store.stageList(None, False, False, none, sc._jvm.java.util.ArrayList())))


def test_texts_without_repeats_are_not_shuffled(spark):
    passage = prose(60, 1000, "abcdefghij")
    rows = [(i, prose(4000, i, "abcdefghij") + (" " + passage if i in (7, 90) else "")) for i in range(100)] + [(None, passage), (90, passage)]
    docs = common.stage(spark.createDataFrame(rows, "doc_id long, text string"), "texts")
    before = shuffled(spark)
    got = {(d, n): gone for d, n, gone, _ in logindex.substring_dedup(docs).collect()}
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    assert got == {(d, len(t.split(" "))): 60 if d == 90 else 0 for d, t in rows}
    anchors = 16 * sum(len(t.split(" ")) for _, t in rows) // 17
    assert shuffled(spark) - before < 1.5 * anchors + 0.25 * sum(len(t) for _, t in rows)


def test_marks_keep_all_that_may_be_there(spark):
    ids = spark.range(0, 3000, 3).withColumnRenamed("id", "doc_id")
    rows = spark.range(-10, 3010).selectExpr("id as doc_id", "id as x").union(spark.sql("select cast(null as bigint), 1L"))
    some, rest = ([r["doc_id"] for r in part.collect()] for part in common.split_by_marks(rows, ids))
    assert set(range(0, 3000, 3)) <= set(some) and len(some) < 1400 and None in rest
    assert sorted(some + [x for x in rest if x is not None]) == list(range(-10, 3010))
    some, rest = common.split_by_marks(rows, ids.limit(0))
    assert some.count() == 0 and rest.count() == 3021
