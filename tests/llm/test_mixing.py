import hashlib
import math
import random

from tabflow.llm import mixing as M

SEPARATORS = " \t\n\v\f\r"


def size(t):
    t = t or ""
    for s in SEPARATORS:
        t = t.replace(s, " ")
    return len([x for x in t.split(" ") if x])


def targets(rows):
    sizes = {}
    for _, t, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size(t)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(order)}
    left, open_, target = sum(sizes.values()), set(order), {}
    while True:
        level = left / sum(weight[s] for s in open_) if open_ else 0
        over = {s for s in open_ if weight[s] * level > 3 * sizes[s]}
        if not over:
            return sizes, target | {s: weight[s] * level for s in open_}
        for s in over:
            target[s] = 3 * sizes[s]
            left -= 3 * sizes[s]
        open_ -= over


def test_agrees_with_brute_force(rows, docs):
    sizes, target = targets(rows)
    got = M.mix_documents(docs).collect()
    assert len(got) == len(rows)
    taken = {}
    by_id = {}
    for i, t, _, s in rows:
        by_id.setdefault(i, []).append((size(t), s))
    for r in got:
        n, s = by_id[r.doc_id][0]
        assert (r["size"], r.source_size) == (n, sizes[s])
        assert math.isclose(r.target, target[s], rel_tol=1e-9)
        assert 0 <= r.taken <= 3 * n
        taken[s] = taken.get(s, 0) + r.taken
    for s, want in target.items():
        assert abs(taken[s] - want) <= 1, s
    assert sorted(map(tuple, M.mix_documents(docs).collect())) == sorted(map(tuple, got))


def test_the_schedule_is_spread(spark, docs, monkeypatch):
    """Any stretch of the schedule has about each source's share of slots, and takes blocks in rank order."""
    monkeypatch.setattr(M, "BLOCK", 5)
    sizes = M.document_sizes(docs)
    _, t, taken = M.mix(sizes)
    rows = taken.select("slot", "src", "rank").distinct().orderBy("slot").collect()
    total = len(rows)
    share = {}
    for r in rows:
        share[r.src] = share.get(r.src, 0) + 1
    for begin in range(0, total - 200, max(1, total // 7)):
        part = rows[begin : begin + 200]
        for s, n in share.items():
            assert abs(sum(r.src == s for r in part) - 200 * n / total) < 12
    for s in share:
        ranks = [r["rank"] for r in rows if r.src == s]
        assert ranks == sorted(ranks) and ranks == list(range(len(ranks)))


def test_small_buckets_and_chunks_agree(docs, monkeypatch):
    want = sorted(map(tuple, M.mix_documents(docs).collect()))
    monkeypatch.setattr(M, "DOCS_A_BUCKET", 3)
    monkeypatch.setattr(M, "SLOTS_A_CHUNK", 64)
    assert sorted(map(tuple, M.mix_documents(docs).collect())) == want
    monkeypatch.setattr(M, "BLOCK", 7)
    assert sorted(tuple(r)[:5] for r in M.mix_documents(docs).collect()) == [w[:5] for w in want]


def test_documents_come_in_the_schedules_order(spark, monkeypatch):
    """Any prefix of the mix has about the target shares, and each copy stands at its first slot."""
    monkeypatch.setattr(M, "BLOCK", 50)
    monkeypatch.setattr(M, "DOCS_A_PART", 300)
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randint(20, 60)), rng.choice("aaaaabbc")) for i in range(1500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(4)
    slots = {r.doc_id: r.slot for r in M.mix_documents(df).collect()}
    target = {r.source: r.target for r in M.mix_documents(df).join(df.select("doc_id", "source"), "doc_id").select("source", "target").distinct().collect()}
    got = M.mixed_documents(df).collect()
    total = sum(size(r.text) for r in got)
    taken = dict.fromkeys(target, 0)
    done = 0
    first = {}
    for n, r in enumerate(got):
        taken[r.source] += size(r.text)
        done += size(r.text)
        first.setdefault(r.doc_id, n)
        if done > total / 10:
            for s, t in target.items():
                assert abs(taken[s] / done - t / total) < 0.03
    order = sorted(first, key=first.get)
    assert order == sorted(order, key=lambda d: slots[d])
    assert set(first) == {d for d, s in slots.items() if s is not None}


def test_documents_of_the_mix(rows, docs, empty):
    got = M.mixed_documents(docs)
    assert got.columns == docs.columns
    counts = {r.doc_id: 0 for r in docs.collect()}
    for r in got.collect():
        counts[r.doc_id] += size(r.text)
        assert r.n_chars == len(r.text)
    want = {}
    for r in M.mix_documents(docs).collect():
        want[r.doc_id] = want.get(r.doc_id, 0) + r.taken
    assert counts == want
    assert M.mixed_documents(empty).count() == 0
    assert M.mix_documents(empty).count() == 0


def test_order_is_by_md5(spark):
    """The shuffled order that the SQL of this query uses."""
    ids = sorted(range(20), key=lambda i: (hashlib.md5(f"mix|{i}".encode()).hexdigest(), i))
    df = spark.createDataFrame([(i, "a b", "s") for i in range(20)], "doc_id long, text string, source string")
    stream, _, _ = M.mix(M.document_sizes(df))
    assert [r.doc_id for r in stream.orderBy("start").collect()] == ids
