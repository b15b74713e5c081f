import random

import pytest

pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="session")
def tokenizers():
    import public_tokenizers

    return {n: str(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json")}


def prose(n, seed, alphabet="abcde"):
    r = random.Random(seed)
    return " ".join("".join(r.choice(alphabet) for _ in range(r.randint(1, 7))) for _ in range(n))


#: (doc_id, text): copies, near copies, shared passages, repeats, nulls, blanks, other scripts, a very long text, and one doc_id twice.
def corpus():
    passage, long = prose(70, 1), prose(6000, 2)
    near = prose(200, 3).split(" ")
    rows = [(i, prose(40 + 17 * i, 10 + i)) for i in range(8)]
    rows += [(20, passage), (21, prose(30, 4) + " " + passage + "\n" + prose(20, 5)), (22, passage + "  " + passage), (19, "x " + passage)]
    rows += [(30, " ".join(near)), (31, " ".join(near[:100] + ["zz"] + near[101:])), (32, " ".join(near[:20] + ["q", "r"] + near[22:180])), (33, " ".join(near))]
    rows += [(40, None), (41, ""), (42, " \n\t "), (43, "one two three"), (44, "One TWO three"), (None, passage), (None, None)]
    rows += [(50, "é日本 " * 80), (51, "ab " * 300), (52, "ab " * 200 + "c"), (53, long), (54, long[:9000]), (55, prose(60, 6) + "<|endoftext|> Σ" + "\x1c x\x0b" * 60)]
    rows += [(5, rows[5][1]), (6, passage + " tail"), (60, "a\nb b b\n\na\n a | # $ | * <" * 9)]
    return rows


@pytest.fixture(scope="session")
def odd(spark):
    """The corpus with columns whose names operators use inside."""
    rows = [(d, t, "en", f"src{(d or 0) % 3}" if d != 7 else None, len(t or ""), 1, "x", 2, True, "y", 0) for d, t in corpus()]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, th long, node string, n long, kept boolean, `_row` string, `_th` int")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
