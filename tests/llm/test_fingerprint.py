import hashlib
import random

import numpy as np
import pytest

from tabflow.llm import fingerprint as M


def test_equal_texts_and_batches():
    rng = random.Random(1)
    texts = ["".join(rng.choice("abcd é") for _ in range(rng.randint(0, 400))) for _ in range(50)] + ["", None, "a", "aa", "aaaa" * 50, "ab" * 90]
    together = M.fingerprints(texts)
    for t, f in zip(texts, together, strict=True):
        assert np.array_equal(M.fingerprints([t])[0], f)
        assert (len(f) > 0) == bool(t)


@pytest.mark.parametrize("seed", range(5))
def test_shared_substrings_share_names_at_any_offset(seed):
    """A long passage is named alike in different surroundings, but for its margins."""
    rng = random.Random(seed)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(3000))
    a, b = (M.fingerprints([x], keep=10**6)[0] for x in ("zq" * seed + passage, "other start, " + passage + " and an end"))
    alone = M.fingerprints([passage], keep=10**6)[0]
    assert len(np.intersect1d(a, alone)) >= 0.97 * len(alone)
    assert len(np.intersect1d(a, b)) >= 0.97 * len(alone)


def test_labels_of_neighbours_differ():
    rng = np.random.default_rng(0)
    s = rng.integers(0, 4, 5000).astype(np.uint64)
    s = s[np.append(True, s[1:] != s[:-1])]
    labels = s
    for _ in range(4):
        labels = M._toss(labels, np.array([0]))
        assert (labels[1:] != labels[:-1]).all()
    assert labels.max() < 6


def brute(rows):
    order = sorted(rows, key=lambda r: -r[0])
    return {r[0]: (len(r[1] or ""), hashlib.sha256(M.edited_text(r[1] or "", order[(i + 1) % len(order)][1] or "").encode()).hexdigest()) for i, r in enumerate(order)}


@pytest.mark.parametrize("size", [7, 10_000])
def test_edited_texts(spark, rows, size, monkeypatch):
    monkeypatch.setattr(M, "DOCS_A_PARTITION", size)
    unique = list({r[0]: r for r in rows}.values())
    df = spark.createDataFrame([(r[0], r[1], "x") for r in unique], "doc_id long, text string, part string").repartition(3)
    got = M.compare_with_edits(df).collect()
    assert {r.doc_id: (r.n_chars, r.edited_sha256) for r in got} == brute([(r[0], r[1]) for r in unique])
    own = [r for r in got if r.n_chars > 200]
    assert min(r.near_edited for r in own) > 0.05
    assert np.mean([r.near_edited > r.near_next for r in own]) > 0.95
    again = {r.doc_id: tuple(r) for r in M.compare_with_edits(df).collect()}
    assert again == {r.doc_id: tuple(r) for r in got}


def test_ties_nulls_and_small_tables(spark, empty):
    assert M.compare_with_edits(empty).count() == 0
    one = M.compare_with_edits(spark.createDataFrame([(5, "abcd")], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.edited_sha256) for r in one] == [(5, hashlib.sha256(b"abab").hexdigest())]
    assert one[0].near_next == 1.0
    tied = M.compare_with_edits(spark.createDataFrame([(1, "same text"), (1, "same text"), (None, "abc"), (None, None), (2, "")], "doc_id long, text string")).collect()
    assert sorted(str(r.doc_id) for r in tied) == ["1", "1", "2", "None", "None"]
    assert len({r.fingerprint for r in tied if r.doc_id == 1}) == 1


def test_column(docs):
    got = M.fingerprint_column(docs, ["doc_id"])
    assert got.columns == ["doc_id", "fingerprint"] and got.count() == docs.count()


MASK = 2**64 - 1


def mixed(x):
    x ^= x >> 30
    x = x * 0xBF58476D1CE4E5B9 & MASK
    x ^= x >> 27
    x = x * 0x94D049BB133111EB & MASK
    return x ^ (x >> 31)


def plain_level(symbols):
    """One round of parsing of one text, symbol by symbol."""
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [mixed((s + n * 0xA24BAED4963EE407) & MASK) if n > 1 else s for s, n in runs]
    labels = symbols
    for _ in range(4):
        tossed = []
        for i, s in enumerate(labels):
            low = (s ^ (labels[i - 1] if i else s ^ 1)) & -(s ^ (labels[i - 1] if i else s ^ 1))
            tossed.append(2 * (low.bit_length() - 1) + (1 if s & low else 0))
        labels = tossed
    n = len(symbols)
    starts = [i for i in range(n) if i == 0 or (1 < i < n - 1 and labels[i] < labels[i - 1] and labels[i] < labels[i + 1])]
    base = 0x9E3779B97F4A7C15 | 1
    out = []
    for a, b in zip(starts, [*starts[1:], n], strict=True):
        total = sum(mixed((s + 1) & MASK) * pow(base, k, 2**64) for k, s in enumerate(symbols[a:b]))
        out.append(mixed((total + b - a) & MASK))
    return out


def plain_names(text):
    symbols = list((text or "").encode())
    if not symbols:
        return set()
    for _ in range(M.LEVELS):
        symbols = plain_level(symbols)
    return {mixed(s ^ 0xA24BAED4963EE407) >> 32 for s in symbols}


def test_fingerprints_against_brute_force(spark, rows):
    """Names, likenesses and printed fingerprints of documents and edited texts, by plain parsing."""
    unique = list({r[0]: r for r in rows}.values())
    got = {r.doc_id: r for r in M.compare_with_edits(spark.createDataFrame([(r[0], r[1]) for r in unique], "doc_id long, text string")).collect()}
    order = sorted(unique, key=lambda r: -r[0])
    shown = lambda names: "".join(f"{n:08x}" for n in sorted(names))
    like = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for k, (i, text, *_) in enumerate(order):
        if text and len(text) > 5000:
            continue  # too long for plain loops; test_equal_texts covers long ones
        following = order[(k + 1) % len(order)][1] or ""
        own, edited, other = plain_names(text), plain_names(M.edited_text(text or "", following)), plain_names(following) if len(following) <= 5000 else None
        r = got[i]
        assert (r.fingerprint, r.edited_fingerprint) == (shown(own), shown(edited))
        assert abs(r.near_edited - like(own, edited)) < 1e-12
        if other is not None:
            assert abs(r.near_next - like(own, other)) < 1e-12


def test_ids_of_text(spark, monkeypatch):
    """The next document is that of the next smaller id by its bytes, also where ids begin alike; null ids come last."""
    monkeypatch.setattr(M, "DOCS_A_PARTITION", 4)
    large = [(2**53 + 2 * i + 1, f"{i} " * 9) for i in range(30)]  # ids that doubles don't tell apart
    assert len(M.compare_with_edits(spark.createDataFrame(large, "doc_id long, text string")).collect()) == 30
    ids = [*[f"same-prefix-{i:03d}" for i in range(20)], "a", "", "é", "zz", None]
    df = spark.createDataFrame([(d, f"text of {d} " * 5) for d in ids], "doc_id string, text string").repartition(3)
    order = sorted((d for d in ids if d is not None), key=lambda d: d.encode(), reverse=True) + [None]
    text = {d: f"text of {d} " * 5 for d in ids}
    want = {d: hashlib.sha256(M.edited_text(text[d], text[order[(k + 1) % len(order)]]).encode()).hexdigest() for k, d in enumerate(order)}
    assert {r.doc_id: r.edited_sha256 for r in M.compare_with_edits(df).collect()} == want
