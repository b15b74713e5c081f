"""The pipeline's stages against brute force on a small table."""

import corpus_pipeline
from orgweave.llm import common, packing, registry

from .conftest import prose


def test_stages_take_effect(spark, tmp_path):
    near = prose(150, 90, "abcdefghij").split(" ")
    passage = prose(60, 91, "abcdefghij")
    docs = [(i, prose(90, i, "abcdefghij"), "en", f"s{i % 3}", 0) for i in range(40)]
    docs += [(100, " ".join(near), "en", "s0", 0), (101, " ".join(near[:70] + ["new"] + near[71:]), "en", "s0", 0)]
    docs += [(110, prose(60, 92, "abcdefghij") + " " + passage, "en", "s1", 0), (111, passage + "\n" + prose(60, 93, "abcdefghij"), "en", "s1", 0)]
    docs += [(120, "short", "en", "s1", 0), (121, None, "en", "s1", 0), (122, "ab " * 90, "en", "s1", 0)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    spark.createDataFrame([(0, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "quality_rules", "near_duplicates", "repeated_passages", "packed_sequences"]
    frame, seen = registry.table(spark, folder, "documents"), {}
    columns = frame.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        frame = common.stage(stage(spark, frame, folder), name)
        assert frame.columns == columns
        seen[name] = {r["doc_id"]: r["text"] for r in frame.collect()}
    clean = {*range(40), 100, 101, 110, 111}
    assert set(seen["quality_classifier"]) == clean | {120, 121, 122}
    assert set(seen["quality_rules"]) == clean
    assert set(seen["near_duplicates"]) == clean - {101}
    texts = seen["repeated_passages"]
    assert texts[110] == dict((d[0], d[1]) for d in docs)[110] and texts[111] == prose(60, 93, "abcdefghij")
    rows = corpus_pipeline.run(spark, folder).collect()
    path = registry.tokenizer("byte_bpe_50k.json")
    want = packing.pack(frame, path).collect()
    cut = lambda rs: sorted((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rs)
    assert cut(rows) == cut(want)
