import random

import pytest

from tabflow.llm import minhash as M

SEPARATORS = " \t\n\v\f\r"


def shingles(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for s in SEPARATORS:
        t = t.replace(s, " ")
    w = [x for x in t.split(" ") if x]
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(rows, per_hundred=85):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= per_hundred * len(a | b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    return sorted(((d, len(sets[i]), min(least[find(i)]), d == min(least[find(i)])) for i, (d, _) in enumerate(rows)), key=str)


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_agrees_with_brute_force(rows, docs):
    assert result(M.near_duplicates(docs)) == brute([(r[0], r[1]) for r in rows])


@pytest.mark.parametrize("seed", [1, 2])
def test_dense_groups(spark, seed):
    """Copies of one text with up to nine edits each: chains of links, and members that no hub reaches."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(150)]
    rows = []
    for i in range(150):
        words = list(base[: rng.choice([150, 148, 140])])
        for _ in range(rng.randint(0, 5)):
            words[rng.randrange(len(words))] = f"x{rng.randint(0, 6)}"
        rows.append((i, " ".join(words)))
    got = result(M.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)))
    assert got == brute(rows)
    assert 1 < len({r[2] for r in got}) < 150


def test_signatures_estimate_similarity():
    a = M.shingle_sets([" ".join(f"w{i}" for i in range(1000))])[0]
    b = M.shingle_sets([" ".join(f"w{i}" for i in range(100, 1100))])[0]
    keys = M.signatures([a, b, a], bands=400, rows=1)
    true = len(set(a) & set(b)) / len(set(a) | set(b))
    assert abs((keys[0] == keys[1]).mean() - true) < 0.08
    assert (keys[0] == keys[2]).all()


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 150), (7, 300)]
    got = dict(map(tuple, M.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in [*range(41), 300]} | {100: 100, 200: 100, 150: 100}
    assert M.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_one_of_each_group_stays(rows, docs, empty):
    got = M.kept_documents(docs)
    assert got.columns == docs.columns
    want = {r[0] for r in brute([(r[0], r[1]) for r in rows]) if r[3]}
    ids = [r.doc_id for r in got.collect()]
    assert len(set(ids)) == len(ids)
    assert set(ids) == want
    assert M.near_duplicates(empty).count() == 0
    assert M.kept_documents(empty).count() == 0


def test_null_ids(spark):
    df = spark.createDataFrame([(None, "a b c d e f"), (5, "A b c d e f"), (None, "other")], "doc_id long, text string")
    got = sorted([tuple(r) for r in M.near_duplicates(df).collect()], key=str)
    assert got == sorted([(None, 2, 5, False), (5, 2, 5, True), (None, 1, None, True)], key=str)


def test_ids_of_text(spark, rows):
    """One document of each group stays, the smallest by its id's text; a null id only where there is no other."""
    named = [(None if i == 900 else f"id-{i}", t) for i, t, *_ in rows]
    df = spark.createDataFrame(named, "doc_id string, text string")
    got = sorted(str(r.doc_id) for r in M.kept_documents(df).collect())
    groups = {}
    for i, _, c, _ in brute([(k, t) for k, (_, t) in enumerate(named)]):
        groups.setdefault(c, []).append(named[i][0])
    assert got == sorted(str(min((d for d in g if d is not None), default=None)) for g in groups.values())
