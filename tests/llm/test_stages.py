"""Rules of the pipeline's stages that differ from the queries' contracts."""

import corpus_pipeline as P

DOCS = "doc_id long, text string, lang string, source string, n_chars int"


def test_a_document_with_one_benchmark_item_goes(spark, tmp_path):
    item = " ".join(f"q{i}" for i in range(15))
    other = " ".join(f"r{i}" for i in range(15))
    at = f"file://{tmp_path}"
    spark.createDataFrame([(1, item), (2, other)], "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    texts = {1: f"before it {item.upper()} and after it", 2: "nothing of the kind is here in this text at all", 3: " ".join(item.split()[:7]), 4: item, 5: None}
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in texts.items()], DOCS)
    assert sorted(r.doc_id for r in P.decontamination(spark, docs, at).collect()) == [2, 3, 5]


def test_near_copies_are_linked_from_080_on(spark):
    """One word of a text changed in the middle: 5 of n shingles differ, similarity (n - 5) / (n + 5)."""
    rows = []
    for k, n in enumerate([45, 48, 55, 44, 40]):  # 0.80, 0.811, 0.833, 0.796, 0.778
        words = [f"t{k}w{i}" for i in range(n + 4)]
        rows.append((2 * k, " ".join(words), "en", "s", 0))
        words[n // 2] = "changed"
        rows.append((2 * k + 1, " ".join(words), "en", "s", 0))
    got = P.near_dedup(spark, spark.createDataFrame(rows, DOCS), "")
    assert sorted(r.doc_id for r in got.collect()) == [0, 2, 4, 6, 7, 8, 9]
