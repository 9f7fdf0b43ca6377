import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tabflow.llm import lm as M

SEPARATORS = " \t\n\v\f\r"


def tokens(t):
    t = "".join(c.lower() if "A" <= c <= "Z" else c for c in t or "")
    for s in SEPARATORS:
        t = t.replace(s, " ")
    return [x for x in t.split(" ") if x] + [None]


def plain(t):
    return b" ".join(x.encode() for x in tokens(t)[:-1]) + b"\0"


def held(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


@pytest.fixture(scope="module")
def got(docs):
    return M.score(docs).collect()


def test_base_scores(rows, got):
    counts = Counter(x for i, t, *_ in rows if not held(i) for x in tokens(t))
    total, distinct = sum(counts.values()), len(counts)
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    for r in got:
        toks = tokens(text[r.doc_id])
        want = sum(math.log10((counts[x] + 1) / (total + distinct + 1)) for x in toks)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held(r.doc_id), len(toks), sum(counts[x] > 0 for x in toks), total)
        assert math.isclose(r.base_score, want, rel_tol=1e-9)


class Brute:
    """The model's probability of a text, byte by byte and bit by bit, with counts gathered position by position."""

    def __init__(self, texts, model):
        self.model, self.counts = model, Counter()
        for t in texts:
            for contexts, byte in self.places(plain(t)):
                for c in set(contexts):  # the sixth of a short word is one of the others
                    for b in range(9):
                        self.counts[c, b, byte >> (8 - b)] += 1

    @staticmethod
    def places(data):
        """Of each byte its six contexts: the last 1 to 5 bytes, and the word so far with what stands before it, if short."""
        before = bytes(5)
        word = b""
        for i, byte in enumerate(data):
            past = before + data[:i]
            contexts = [past[-k:] for k in range(1, 6)]
            contexts.append(("word", word) if len(word) >= 5 else contexts[len(word)])
            yield contexts, byte
            word = b"" if byte == 32 else word + bytes([byte])

    def log10(self, t, own=0):
        return sum(self.byte(contexts, byte, own) for contexts, byte in self.places(plain(t)))

    def byte(self, contexts, byte, own=0):
        total = 0.0
        for bit in range(8):
            all_ = [self.counts[c, bit, byte >> (8 - bit)] for c in contexts]
            same = [self.counts[c, bit + 1, byte >> (7 - bit)] for c in contexts]
            sign = 1 if byte >> (7 - bit) & 1 else -1
            x = [math.log((s + M.PRIOR) / (a - s + M.PRIOR)) for s, a in zip(same, all_, strict=True)] + [0.3 * sign]
            longest = max((k for k in range(1, 6) if all_[k - 1]), default=0)
            gate = ((isinstance(contexts[5], tuple) and all_[5] > 0) * 6 + longest) * 8 + bit
            s = min(7.99, max(-7.99, float(np.dot(x, self.model.weights[gate]))))
            place = (s * sign + 8) * 2
            knot = int(place)
            curve = self.model.curves[gate, knot] * (1 - place + knot) + self.model.curves[gate, knot + 1] * (place - knot)
            p = (1 / (1 + math.exp(-s)) + 1 / (1 + math.exp(-curve * sign))) / 2
            total += math.log10(min(1 - 1e-6, max(1e-6, p)))
        return total


@pytest.mark.parametrize("small", [False, True])
def test_scores_against_brute_force(docs, rows, monkeypatch, small):
    """Every score is the model's by plain counting, whatever the sizes of blocks, parts, pieces and buckets."""
    if small:
        for name, value in (("BLOCK", 4000), ("PART", 1500), ("PIECE", 300), ("BUCKET_BYTES", 3000), ("CHUNK", 200)):
            monkeypatch.setattr(M, name, value)
    learnt = []
    train = M.train
    monkeypatch.setattr(M, "train", lambda *a: learnt.append(train(*a)) or learnt[-1])
    found = M.score(docs).collect()
    brute = Brute([t for i, t, *_ in rows if not held(i)], learnt[0])
    text = {r[0]: r[1] for r in rows}
    assert not np.allclose(learnt[0].weights, M.Model().weights)
    for r in found:
        assert math.isclose(r.score, brute.log10(text[r.doc_id]), rel_tol=3e-5)  # probabilities travel with 16 bits
        assert math.isclose(r.bits_per_byte, -r.score * math.log2(10) / len(plain(text[r.doc_id])), rel_tol=1e-9)


def test_probabilities_sum_to_one():
    """Over all 256 values of the next byte, in seen and unseen contexts, and after learning."""
    texts = ["the cat sat on the international mat", "the dog sat", "internal matters"]
    rng = np.random.default_rng(1)
    brute = Brute(texts, M.Model(rng.normal(0.3, 0.2, (M.GATES, M.INPUTS)), rng.normal(0, 2, (M.GATES, M.KNOTS))))
    for t in ("the mat", "internationally", "zq"):
        for contexts, _ in list(brute.places(plain(t)))[-4:]:
            assert abs(sum(10 ** brute.byte(contexts, b) for b in range(256)) - 1) < 1e-3  # probabilities of bits are kept off 0 and 1


def test_learning_lowers_the_loss():
    """Predicted from all other occurrences, the bits of the training texts get likelier round by round."""
    texts = ["the cat sat on the international mat " * 3, "the dog sat on the internal mat", "a cat and a dog matter"] * 4
    part = M.Part(np.zeros(len(texts), np.int64), np.array([len(plain(t)) for t in texts]), np.frombuffer(b"".join(map(plain, texts)), np.uint8), len(texts))
    later, names, counts, _ = M.later_grams(part.words, part.times)
    keys, grams, counts = (np.concatenate(p) for p in ((part.grams, M.key_of(later, names)), (part.grams, later), (part.counts, counts)))
    assert counts.sum() == len(b"".join(map(plain, texts)))
    low = [M.bit_sums(*M.summed(grams & np.uint64((1 << (8 * (k + 1))) - 1), counts.astype(float))) for k in (1, 2)]
    c = M.Contexts(keys, grams, counts, low)

    def loss(model):
        total = 0.0
        for bit in range(8):
            x, gate, _ = c.inputs(bit, own=False)
            total -= float((c.n * np.log2(M.squash(model.mixed(x, gate)))).sum())
        return total / c.n.sum()

    model, losses = M.Model(), []
    for _ in range(4):
        losses.append(loss(model))
        mass = model.learn(c)
    assert losses[-1] < losses[0] and mass.sum() == 8 * c.n.sum()


def test_scores(got, rows):
    text = {r[0]: r[1] for r in rows}
    by_text = {}
    for r in got:
        assert r.score < 0 and math.isfinite(r.score) and r.bits_per_byte > 0
        by_text.setdefault(" ".join(x or "" for x in tokens(text[r.doc_id])), set()).add(round(r.score, 2))
    assert all(len(s) == 1 for s in by_text.values())  # equal token sequences score alike
    own = [r for r in got if r.held_out and r.doc_id < 900]
    assert np.mean([r.bits_per_byte for r in own]) < 3.5  # far from the 8 bits of a uniform model


def test_nonsense_is_less_likely(spark, docs):
    out = [i for i in range(5000, 6000) if held(i)][:2]
    extra = spark.createDataFrame([*zip(out, ["zqx jvk wqz xxq zzj qqv " * 5, "the ing ion ent her tha " * 5], strict=True)], "doc_id long, text string")
    found = {r.doc_id: r for r in M.score(docs.select("doc_id", "text").unionByName(extra)).collect()}
    assert found[out[0]].bits_per_byte > found[out[1]].bits_per_byte + 1


def test_pieces():
    texts = ["Ab  cd", "", None, " x ", "é\nÉ", "word " * 500, "w" * 4000 + " tail " * 300]
    M.PIECE, before = 300, M.PIECE
    try:
        for t in texts:
            data = M.normalised(t)
            assert data == plain(t)
            parts = list(M.pieces(data))
            assert b"".join(body for _, body in parts) == data
            at = 0
            for lead, body in parts:
                assert lead == data[max(0, at - 5) : at]
                at += len(body)
                assert body[-1:] in b" \0"
    finally:
        M.PIECE = before


def test_packing():
    rng = np.random.default_rng(0)
    keys = np.unique(rng.integers(0, 2**64, 1000, np.uint64))
    arrays = [M.steps(keys), rng.integers(0, 9, 50), np.zeros(0, np.uint64), rng.random(7).astype(np.float32), np.frombuffer(b"abc", np.uint8)]
    back = M.unpacked(M.packed(*arrays))
    assert all(np.array_equal(a, b) and a.dtype == b.dtype for a, b in zip(arrays, back, strict=True))
    assert np.array_equal(np.cumsum(back[0], dtype=np.uint64), keys)
    wanted = rng.choice(keys, 5000)
    assert np.array_equal(keys[M.looked_up(keys, wanted)], wanted)


def test_held_out_texts_teach_nothing(spark, rows):
    plain_rows = [(r[0], r[1]) for r in rows]
    changed = [(i, "completely different" if held(i) else t) for i, t in plain_rows]
    a, b = ({r.doc_id: (round(r.base_score, 6), round(r.score, 2)) for r in M.score(spark.createDataFrame(x, "doc_id long, text string").coalesce(1)).collect() if not r.held_out} for x in (plain_rows, changed))
    assert a == b


def test_empty(spark, empty):
    assert M.score(empty).count() == 0
    r = M.score(spark.createDataFrame([(3, None)], "doc_id long, text string")).first()
    assert r.n_tokens == 1
