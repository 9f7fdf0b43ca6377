import random
import zlib

import numpy as np

from tabflow.llm import langid


def test_a_hot_id_leaves_rows_to_all_languages(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 12)
    rng = random.Random(5)
    word = lambda letters: "".join(rng.choice(letters) for _ in range(6))
    rows = [(None, " ".join(word("abcd") for _ in range(9)), "aa") for _ in range(300)]
    rows += [(None, rows[0][1], "aa")] * 300
    rows += [(i, " ".join(word(letters) for _ in range(9)), lang) for lang, letters in (("bb", "efgh"), ("cc", "ijkl")) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").coalesce(1)
    seen = {}
    fit = langid.fit
    monkeypatch.setattr(langid, "fit", lambda x, labels: seen.update(labels=labels, rows=len(np.unique(x, axis=0))) or fit(x, labels))
    assert langid.learn(df).langs == ["aa", "bb", "cc"]
    assert sorted(seen["labels"]) == ["aa"] * 4 + ["bb"] * 4 + ["cc"] * 4 and seen["rows"] == 12


def test_every_language_is_learnt(spark):
    rows = [(4 * k + j, f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 3} text", f"l{k:03}") for k in range(203) for j in range(4)]
    langs = {r[2] for r in rows if not _held(r[0])}
    model = _learn_labels(spark, rows)
    assert len(langs) > 200 and set(model) == langs


def _held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def _learn_labels(spark, rows):
    """The languages of the sample; pairwise classifiers of so many take long."""
    found = []
    fit, langid.fit = langid.fit, lambda x, labels: found.extend(labels)
    try:
        langid.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    finally:
        langid.fit = fit
    return found
