"""The near-duplicate stage of the pipeline takes pairs from a similarity of 0.8 on."""

import corpus_pipeline


def test_near_duplicate_stage_from_four_fifths(spark):
    base = [f"t{i}" for i in range(104)]  # 100 runs of five words
    near, far = list(base), [f"u{i}" for i in range(104)]
    near[20], near[60] = "x", "y"  # 90 of 110 runs are common: 0.818
    further = list(far)
    further[20] = further[40] = further[60] = "z"  # 85 of 115: 0.739
    rows = [(i, " ".join(t), "en", "s", 1) for i, t in enumerate((base, near, far, further))]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()) == [0, 2, 3]
