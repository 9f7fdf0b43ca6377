import random

import pytest

SYLLABLES = {
    "en": "the and ing ion ent her tha ere ate ver ter all".split(),
    "de": "der die und sch ein ich gen ung ver che ßen äst".split(),
    "fr": "que les ent ait our éta ans eau ement ère çon oui".split(),
    "es": "que los ado nte ció ñas mente rra ías por aba llo".split(),
}


def sentence(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid long, size string, shard int, score string, words string"


def frame(spark, rows):
    """Documents with extra columns whose names operators use inside."""
    return spark.createDataFrame([(i, t, g, s, None if t is None else len(t), 7, "x", 99, "y", "z") for i, t, g, s in rows], SCHEMA)


def corpus(n=160, seed=3):
    """Texts of four languages with exact copies, near copies, empty, blank, null, very short and long ones, and repeated rows."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        words = sentence(rng, lang, rng.choice([1, 3, 5, 6, 40, 60, 120])).split()
        rows.append([i, " ".join(words), lang, f"s{rng.randint(0, 4)}"])
    for i in range(20):  # exact and near copies
        base = rows[rng.randint(60, n - 1)]
        words = base[1].split()
        if i % 2 and len(words) > 30:
            words[rng.randrange(len(words))] = "edited"
        rows.append([n + i, "  ".join(words).upper() if i % 4 == 0 else " ".join(words), base[2], "s9"])
    rows += [[900, None, "en", "s1"], [901, "", "en", None], [902, " \t\n ", None, None], [903, "12 34 --", "en", "s0"], [904, "é", "fr", "ZZ"], [905, sentence(rng, "en", 4000), "en", "s0"]]
    rows += [list(rows[5]), list(rows[70]), list(rows[70])]
    rng.shuffle(rows)
    return [tuple(r) for r in rows]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return frame(spark, rows).repartition(5).cache()


@pytest.fixture(scope="session")
def empty(spark):
    return frame(spark, [])
