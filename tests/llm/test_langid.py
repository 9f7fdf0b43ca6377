import zlib

import numpy as np

from tabflow.llm import langid as M


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_held_out_accuracy(rows, docs):
    got = M.identify(docs).collect()
    assert len(got) == len(rows)
    truth = {r[0]: r for r in rows}
    long = [r for r in got if truth[r.doc_id][1] and len(truth[r.doc_id][1].split()) >= 5 and truth[r.doc_id][2]]
    right = [r.lang_pred == truth[r.doc_id][2] for r in long if r.held_out and r.doc_id < 900]
    assert len(right) > 20 and np.mean(right) >= 0.95
    for r in got:
        assert r.held_out == held(r.doc_id)
        assert 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in truth[r.doc_id][1] or ""))


def test_predictions_use_the_text_alone(spark, docs):
    model = M.learn(docs)
    text = "the and ing ion entver therall"
    df = spark.createDataFrame([(1, text, "fr", "a"), (2, text, None, "b")], "doc_id long, text string, lang string, source string")
    a, b = M.predictions(df, model, ["doc_id"]).collect()
    assert (a.lang_pred, a.score) == (b.lang_pred, b.score) == ("en", a.score)


def test_families_come_first(docs):
    model = M.learn(docs)
    assert model.families == [["de", "en"], ["es", "fr"]]
    assert [p[0] for p in model.pairs] == ["family", "lang", "lang"]


def test_whole_texts_count(spark, docs):
    model = M.learn(docs)
    df = spark.createDataFrame([(1, "the and ing " * 50 + "que los ado ció ñas rra " * 4000)], "doc_id long, text string")
    assert M.predictions(df, model, ["doc_id"]).first().lang_pred == "es"


def test_nothing_to_learn(spark, empty):
    assert M.identify(empty).count() == 0
    df = spark.createDataFrame([(1, "words", None), (2, None, "en")], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in M.identify(df).collect()} <= {"und", "en"}
    one = spark.createDataFrame([(i, "the and ing", "en") for i in range(20)], "doc_id long, text string, lang string")
    assert {(r.lang_pred, r.score) for r in M.identify(one).collect()} == {("en", 1.0)}


def test_accepted_documents(rows, docs):
    got = M.accepted_documents(docs)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows if any(c.isalpha() for c in r[1] or ""))


def brute(model, text):
    """The language by counting trigrams one by one, margins as plain sums, and votes of all duels."""
    data = f" {text} ".encode()
    data = bytes(b + 32 if 65 <= b <= 90 else b for b in data)
    letter = [b - 96 if 97 <= b <= 122 else b - 128 + 27 if b >= 128 else 0 for b in data]
    bins = [(((a * 155 + b) * 155 + c) * 2654435761 % 2**32) >> (32 - M.BIN_BITS) for a, b, c in zip(letter, letter[1:], letter[2:]) if a or b or c]
    margins = [sum(float(model.weights[b, k]) for b in bins) / len(bins) + model.bias[k] for k in range(len(model.pairs))]

    def winner(level, family, n):
        votes = [0] * n
        for (at, f, a, b), m in zip(model.pairs, margins, strict=True):
            if (at, f) == (level, family):
                votes[a if m >= 0 else b] += 1
        best = [i for i in range(n) if votes[i] == max(votes)]
        return best

    out = set()
    for f in winner("family", -1, len(model.families)):
        out |= {model.families[f][i] for i in winner("lang", f, len(model.families[f]))}
    return out


def test_votes_against_brute_force(spark, rows, docs):
    model = M.learn(docs)
    got = {r.doc_id: r.lang_pred for r in M.predictions(docs.dropDuplicates(["doc_id"]), model, ["doc_id"]).collect()}
    text = {r[0]: r[1] for r in rows}
    assert sum(p != "und" for p in got.values()) > 150
    for i, p in got.items():
        if p != "und":
            assert p in brute(model, text[i]), i


def test_repeated_ids(spark):
    """Rows of one id, also of the null id, are drawn by their texts, so one id can't crowd a language out, and reruns agree."""
    rng = np.random.default_rng(0)
    words = {"en": "the and ing ion ent".split(), "de": "der die und sch ein".split()}
    made = [(None, " ".join(rng.choice(words["en"], 12)), "en") for _ in range(900)] + [(i, " ".join(rng.choice(words["de"], 12)), "de") for i in range(60)]
    df = spark.createDataFrame(made, "doc_id long, text string, lang string")
    a, b = (sorted((r.doc_id or -1, r.lang_pred, round(r.score, 6)) for r in M.identify(x).collect()) for x in (df.repartition(5), df.coalesce(1)))
    assert a == b and {p for _, p, _ in a} == {"en", "de"}
