"""The pipeline's stages on awkward rows: nulls, ties, repeated rows, clashing columns and no rows at all."""

import corpus_pipeline

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size int, component_id long, node long, row long, base_found string"
TEXT = "A plain sentence of the old town stands here and says what it has to say. Another one follows it, with other words in it."
ROWS = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (1, TEXT + " More.", "en", "a"), (2, None, None, None), (None, "", "en", "b"), (None, "Short but good.", "en", None), (3, "short but good.", "en", "b"), (4, "The key is token=Zx9kQ2mLp0Rt7Vb here, all of it, and nothing else is.", "en", "b")]


def test_awkward_rows(spark):
    data = [(*r, len(r[1] or ""), "x", 7, 9, 1, 2, "y") for r in ROWS]
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    none = df.where("false")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        df, none = stage(spark, df, "").cache(), stage(spark, none, "").cache()
        assert none.count() == 0
        seen[name] = df.collect()
        if name != "bpe":
            assert df.columns == SCHEMA.replace(" long", "").replace(" string", "").replace(" int", "").split(", ")
            assert all(r.n_chars == len(r.text) and (r.kept, r["size"], r.component_id) == ("x", 7, 9) for r in seen[name])
    assert sorted((r.doc_id or 0, r.text) for r in seen["quality_rules"]) == sorted((r[0] or 0, r[1]) for r in ROWS if r[1])
    kept = seen["near_duplicates"]
    assert sorted(r.doc_id for r in kept) == [1, 3, 4]
    assert [r.text for r in seen["secrets"] if r.doc_id == 4] == ["The key is [SECRET] here, all of it, and nothing else is."]
    words = sum(len(r.text.split()) for r in seen["secrets"])
    assert sum(len(r.text.split()) for r in seen["mixing"]) == words
    assert len(seen["bpe"]) == len(seen["mixing"]) and all(r.n_tokens * 4 == len(r.ids) for r in seen["bpe"])
