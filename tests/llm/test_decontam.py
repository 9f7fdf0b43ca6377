import hashlib
import random
import re

import pytest

from tabflow.llm import decontam as M

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def split(t):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))


def brute(docs, items):
    wins = {}
    for item, text in items:
        w = split(text)
        for s in range(max(1, len(w) - 7) if w else 0):
            wins.setdefault(tuple(w[s : s + 8]), set()).add(item)
    out = []
    for doc, text in docs:
        w = split(text)
        hit, found = set(), set()
        for s in range(len(w)):
            for k in range(1, 9):
                if tuple(w[s : s + k]) in wins and len(w[s : s + k]) == k:
                    hit |= set(range(s, s + k))
                    found |= wins[tuple(w[s : s + k])]
        text = ",".join(sorted(str(f) for f in found))
        out.append((doc, len(w), len(hit), len(found), hashlib.sha256(text.encode()).hexdigest(), len(found) >= 2))
    return sorted(out, key=str)


@pytest.fixture(scope="module")
def items(rows):
    texts = [t for _, t, *_ in rows if t and len(split(t)) > 20]
    cut = [" ".join(split(t)[k : k + n]).upper() for k, (t, n) in enumerate(zip(texts, [8, 9, 12, 20, 7, 3, 1, 30, 8, 15] * 2, strict=False))]
    return [(i, c) for i, c in enumerate(cut)] + [(100, None), (101, "--"), (102, cut[0]), (103, "not in any text of these"), (11, "Other, words")]


def result(df):
    return sorted([tuple(r) for r in df.collect()], key=str)


def test_agrees_with_brute_force(spark, rows, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute([(r[0], r[1]) for r in rows], items)
    assert sum(w[5] for w in want) >= 2
    assert result(M.decontaminate(docs, bench)) == want


def test_the_shuffled_path_agrees(spark, rows, docs, items, monkeypatch):
    monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert result(M.decontaminate(docs, bench)) == brute([(r[0], r[1]) for r in rows], items)


def brute_matches(docs, items, slop):
    wins = {tuple(w[s : s + 8]) for _, t in items for w in [split(t)] for s in range(max(1, len(w) - 7) if w else 0)}
    out = []
    for doc, text in docs:
        w = split(text)
        for win in wins:
            exact = sum(tuple(w[s : s + len(win)]) == win for s in range(len(w) - len(win) + 1))
            run = len(win) + slop
            if any(set(win) <= set(w[s : s + run]) for s in range(max(1, len(w) - run + 1))):
                out.append((doc, " ".join(win), exact, True))
    return sorted(out, key=str)


@pytest.mark.parametrize("broadcast", [True, False])
@pytest.mark.parametrize("slop", [0, 1, 4])
def test_proximity(spark, slop, broadcast, monkeypatch):
    if not broadcast:
        monkeypatch.setattr(M, "BROADCAST_ROWS", 0)
    rng = random.Random(5)
    texts = ["x a b q c d y", "d c b a", "a b x x x c d", "a b c d a b c d", None, "", "a", *[" ".join(rng.choice("abcdefgh") for _ in range(rng.choice([3, 12, 60]))) for _ in range(25)]]
    docs = list(enumerate(texts))
    items = [(1, "a b c d"), (2, "a"), (3, "a a"), (4, "a b a c a d"), (5, "zz a"), (6, None), (7, " ".join(rng.choice("abcdefgh") for _ in range(12)))]
    got = M.matches(spark.createDataFrame(docs, "doc_id long, text string").repartition(3), spark.createDataFrame(items, "item_id long, text string"), slop)
    assert result(got) == brute_matches(docs, items, slop)


def test_the_index(spark, rows, docs):
    """Every place of every word once, files sorted by term, document and position; a document's length and id at the empty term."""
    index = M.postings(docs)
    assert index.where("term <> ''").count() == sum(len(split(r[1])) for r in rows)
    assert sorted(tuple(r) for r in M.lengths(index).select("doc_id", "n_words").collect()) == sorted((r[0], len(split(r[1]))) for r in rows)
    text = {r["rid"]: split({x[0]: x[1] for x in rows}[r["doc_id"]]) for r in M.lengths(index).collect()}
    assert all(text[r["rid"]][r["pos"]] == r["term"] for r in index.where("term <> ''").collect())
    for path in index.inputFiles():
        part = [(r["term"].encode(), r["rid"], r["pos"]) for r in spark.read.parquet(path).collect()]
        assert part == sorted(part)


def test_empty_tables(spark, docs, empty):
    none = spark.createDataFrame([], "item_id long, text string")
    got = M.decontaminate(docs, none)
    assert got.where("n_hit > 0 or n_items > 0 or contaminated").count() == 0
    assert got.count() == docs.count()
    assert M.decontaminate(empty, spark.createDataFrame([(1, "a b")], "item_id long, text string")).count() == 0


def test_clean_documents_keep_their_columns(spark, rows, docs, items):
    bench = spark.createDataFrame(items, "item_id long, text string")
    bad = [r[0] for r in brute([(r[0], r[1]) for r in rows], items) if r[5]]
    got = M.clean_documents(docs, bench)
    assert got.columns == docs.columns
    assert sorted(r.doc_id for r in got.collect()) == sorted(r[0] for r in rows if r[0] not in bad)


def test_near_matches_move_no_list_for_each_window(spark, monkeypatch):
    """Eight windows share a rare word: its list is held once for each next rarest word, and only what is near both goes on."""
    words = [f"w{i}" for i in range(15)]
    docs = [(i, "w7 other text") for i in range(200)] + [(200 + i, " ".join(words[:7] + words[9:])) for i in range(300)] + [(600 + i, "w8 alone") for i in range(250)] + [(900, " ".join(words))]
    rows, kept = {}, M.materialise

    def counted(df, name, *args, **named):
        out = kept(df, name, *args, **named)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(M, "materialise", counted)
    items = [(1, " ".join(words))]
    got = M.matches(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in got.collect()} == {900} and got.count() == 8
    assert rows["anchors"] == 2 * 201 and rows["candidates"] == 8
