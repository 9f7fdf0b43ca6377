"""Operator 5: language-model scores by logistic mixing of hashed-context bit predictors.

All that is learnt grows with the corpus: the counts of every context of every training text
are kept exactly, dealt over the cluster by context, and no table of them is ever whole in
one place.  Texts don't travel to the counts; each block of texts sends the distinct grams
and words that it holds, and gets back their probabilities:

1. ``analyse`` the parts of a block of some MB: their grams (a byte with the five before it),
   and their words, whose bytes from the sixth on are left to the word; write the block's
   dictionaries, grams dealt by the last three context bytes and words by their hash, and its
   texts as places in the dictionary of words;
2. merge the words of each word bucket, and send on the grams of their later bytes, each
   together with a hash of the whole word so far;
3. merge each gram bucket: the counts of a context of three bytes or more, or of a word, are
   all in one bucket; those of one and two bytes form a table of at most 2**24 rows;
4. learn the mixer's weights and the refinement's curves online over all distinct grams, each
   weighing as often as it occurs, predicted from all other occurrences; buckets learn side by
   side and their weights are averaged, for some rounds;
5. compute each distinct gram's log probability once, in its bucket; answer the word buckets,
   which add up words, and the blocks, which add up texts.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import Broadcast, TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tabflow.llm.common import _powers, bounded_batches, finished, materialise, mix64, scratch, tidy
from tabflow.llm.langid import held_out

#: Contexts: the last 1 to 5 bytes, and as the sixth the whole word so far.
REACH = 5
INPUTS = REACH + 2
#: Bit predictors' prior, the learning rates, keys of a step, and rounds over all keys.
PRIOR = 0.02
RATE, CURVE_RATE, STEP, ROUNDS = 0.03, 0.03, 1024, 2
#: Bytes of text of a block, of a part of it, and of a piece of a long text (cut after a space).
BLOCK, PART, PIECE = 8 << 20, 1 << 20, 1 << 19
#: Training bytes a bucket, about, and buckets at most; keys that are computed at once.
BUCKET_BYTES, BUCKETS, CHUNK = 24 << 20, 4096, 1 << 15
MODULUS, REMAINDER = 7, 2
GATES = 2 * (REACH + 1) * 8
KNOTS = 33
END = b"\0"
_TOP, _LOW = np.uint64(1 << 63), np.uint64(255)
_MULT = np.uint64(0x9E3779B97F4A7C15)
_CLOSED = np.uint64(0xA24BAED4963EE407)
#: Kinds of rows: a part's text, the grams of a bucket, the words of a bucket.
TEXT, GRAMS, WORDS = 0, 1, 2


# --- arrays as bytes -------------------------------------------------------------------


def packed(*arrays: np.ndarray) -> bytes:
    """Arrays as compressed bytes; ascending whole numbers should come as differences."""
    parts = []
    for a in arrays:
        # bytes of equal weight stand together, so that small numbers compress to little
        raw = np.ascontiguousarray(a.view(np.uint8).reshape(len(a), a.itemsize).T).tobytes() if len(a) else b""
        parts.append(a.dtype.str.encode().ljust(4) + len(a).to_bytes(8, "little") + raw)
    whole = b"".join(parts)
    return len(whole).to_bytes(8, "little") + pa.compress(whole, "zstd").to_pybytes()


def unpacked(data: bytes) -> list[np.ndarray]:
    whole = pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd").to_pybytes()
    out, at = [], 0
    while at < len(whole):
        kind, n = np.dtype(whole[at : at + 4].strip().decode()), int.from_bytes(whole[at + 4 : at + 12], "little")
        at += 12
        raw = np.frombuffer(whole, np.uint8, n * kind.itemsize, at)
        out.append(np.ascontiguousarray(raw.reshape(kind.itemsize, n).T).view(kind).ravel())
        at += n * kind.itemsize
    return out


def rounded(values: np.ndarray) -> np.ndarray:
    """Floats with the 16 highest bits of their fraction, which compress better: off by at most a part in 2**16."""
    return (values.astype(np.float32).view(np.uint32) + np.uint32(64) & np.uint32(0xFFFFFF80)).view(np.float32)


def steps(a: np.ndarray) -> np.ndarray:
    """Ascending keys as differences; ``np.cumsum`` gives them back."""
    out = a.copy()
    out[1:] -= a[:-1]
    return out


# --- blocks of texts -------------------------------------------------------------------


def normalised(text: str | None) -> bytes:
    """The lower-cased words, joined by one space and closed by a zero byte; ASCII alone has case and white space."""
    return b" ".join((text or "").encode("utf-8", "surrogatepass").lower().split()) + END


def pieces(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """A normalised text in pieces that end after a space, each with the five bytes before it."""
    at = 0
    while len(data) - at > 2 * PIECE:
        cut = data.find(b" ", at + PIECE) + 1
        if not cut:
            break
        yield data[max(0, at - REACH) : at], data[at:cut]
        at = cut
    yield data[max(0, at - REACH) : at], data[at:]


def shifted(s: np.ndarray) -> np.ndarray:
    """Each byte with the five before it, the byte itself lowest."""
    g = s.astype(np.uint64)
    for k in range(1, REACH + 1):
        g[k:] |= s[:-k].astype(np.uint64) << np.uint64(8 * k)
    return g


class Spans:
    """Hashes of spans of some bytes: equal spans have equal hashes wherever they stand."""

    def __init__(self, s: np.ndarray):
        p, self.q = _powers(len(s) + 1)
        with np.errstate(over="ignore"):
            self.total = np.zeros(len(s) + 1, np.uint64)
            np.cumsum((s.astype(np.uint64) + np.uint64(1)) * p[: len(s)], out=self.total[1:])

    def __call__(self, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return mix64((self.total[end] - self.total[begin]) * self.q[begin] + (end - begin).astype(np.uint64))


class Part:
    """What some pieces of texts hold: bytes ``lead`` before each piece, ``size`` of it, all in ``stream``; the
    first ``trained`` pieces are learnt from.

    ``grams``: the distinct grams of the first five bytes of words (the byte that closes a word is its last), ascending,
    and ``counts``, how often each occurs where it is learnt; ``words``: the distinct words with the byte that closes
    each, and ``times``.
    """

    def __init__(self, lead: np.ndarray, size: np.ndarray, stream: np.ndarray, trained: int):
        self.lead, self.size, self.stream, self.trained = lead, size, stream, trained
        s, n = stream, len(stream)
        begin = np.concatenate([[0], np.cumsum(lead + size)])
        body, end = begin[:-1] + lead, begin[1:]
        g = shifted(s)
        for j in range(REACH):  # what stands before a text counts as zero
            at = begin[:-1] + j
            at = at[at < end]
            g[at] &= np.uint64((1 << (8 * (j + 1))) - 1)
        # words: from the piece's begin or after a space, up to a space or the end
        space = np.flatnonzero(s == 32)
        of = np.searchsorted(end, space, "right")
        inner = space[(space >= body[of]) & (space + 1 < end[of])] + 1
        start = np.sort(np.concatenate([body, inner]))
        piece = np.searchsorted(body, start, "right") - 1
        last = np.append(piece[1:] != piece[:-1], True)
        stop = np.where(last, end[piece] - 1, np.append(start[1:], n) - 1)
        piece, start, stop = (x[stop > start] for x in (piece, start, stop))
        # the later bytes of long words are the words' own
        late = np.zeros(n + 1, np.int8)
        wide = stop - start >= REACH
        late[start[wide] + REACH] = 1
        late[stop[wide] + 1] -= 1
        early = np.cumsum(late[:-1], dtype=np.int8) == 0
        for a, b in zip(begin[:-1][lead > 0], body[lead > 0], strict=True):
            early[a:b] = False
        self.piece = piece
        self.before = s[np.repeat(begin[:-1] - np.cumsum(lead) + lead, lead) + np.arange(lead.sum())]
        early_at = np.flatnonzero(early)
        g = g[early_at]
        closed = Spans(s)(start, stop + 1)
        order = np.argsort(closed)
        new = np.append(True, closed[order][1:] != closed[order][:-1]) if len(order) else np.zeros(0, bool)
        self.word = np.empty(len(order), np.int64)
        self.word[order] = np.cumsum(new) - 1
        first = order[new]
        whole = s.tobytes()
        self.words = [whole[a : b + 1] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        self.times = np.bincount(self.word[piece < trained], minlength=len(first))
        cut = np.searchsorted(early_at, end[trained - 1]) if trained else 0
        seen = np.sort(g)
        self.grams = seen[np.append(True, seen[1:] != seen[:-1])] if len(seen) else seen
        known = np.sort(g[:cut])
        self.counts = np.searchsorted(known, self.grams, "right") - np.searchsorted(known, self.grams)


@dataclass
class Spelt:
    """The texts of a part, put together again from the block's words.

    ``words``: the place of each word among the block's; ``many``: words of each piece, whose
    own bytes are a zero alone if there is none; ``lead``, ``before``: bytes before each piece.
    """

    words: np.ndarray
    many: np.ndarray
    lead: np.ndarray
    before: np.ndarray

    def sums(self, text: np.ndarray, length: np.ndarray, grams: np.ndarray, logs: np.ndarray, word_logs: np.ndarray, word_counts: np.ndarray, divisor: float) -> tuple[np.ndarray, ...]:
        """By piece: log probability of its bytes, base score, tokens and known tokens, without the end token, and bytes.

        ``text``, ``length``: of the block's words, one after the other; ``grams``, ``logs``: the block's, ascending.
        """
        n = len(self.many)
        begin = np.cumsum(length) - length
        every = np.concatenate([text, self.before, np.zeros(1, np.uint8)])
        # what stands beside words: leads, and the zeros of pieces without words
        place = np.cumsum(self.many) - self.many
        led, bare = np.flatnonzero(self.lead), np.flatnonzero(self.many == 0)
        at = np.concatenate([place[led], place[bare]])
        order = np.argsort(np.concatenate([led, bare]), kind="stable")
        extra = np.concatenate([len(text) + np.cumsum(self.lead)[led] - self.lead[led], np.full(len(bare), len(every) - 1)])
        size = np.concatenate([self.lead[led], np.ones(len(bare), np.int64)])
        starts, sizes = np.insert(begin[self.words], at[order], extra[order]), np.insert(length[self.words].astype(np.int64), at[order], size[order])
        own = np.insert(np.ones(len(self.words), bool), at[order], False)
        upto = np.cumsum(sizes)
        first = upto - sizes
        s = every[np.repeat(starts - first, sizes) + np.arange(upto[-1])]
        piece = np.repeat(np.arange(n), self.many)
        total_size = np.bincount(piece, length[self.words], n).astype(np.int64) + (self.many == 0)
        ends = np.cumsum(self.lead + total_size)
        g = shifted(s)
        for j in range(REACH):
            where = ends - self.lead - total_size + j
            where = where[where < ends]
            g[where] &= np.uint64((1 << (8 * (j + 1))) - 1)
        # the first five bytes of words, and the zeros
        early = np.zeros(len(s) + 1, np.int8)
        words_at, words_end = first[own], upto[own]
        early[words_at] += 1
        early[np.minimum(words_at + REACH, words_end)] -= 1
        early = np.cumsum(early[:-1], dtype=np.int8) > 0
        zeros = ends[bare] - 1
        early[zeros] = True
        early_at = np.flatnonzero(early)
        total = np.bincount(np.searchsorted(ends, early_at, "right"), logs[looked_up(grams, g[early_at])], n) + np.bincount(piece, word_logs[self.words], n)
        base = np.bincount(piece, np.log10((word_counts + 1) / divisor)[self.words], n)
        known = np.bincount(piece, word_counts[self.words] > 0, n).astype(np.int64)
        return total, base, self.many, known, total_size


def packed_words(words: list[bytes], *columns: np.ndarray) -> bytes:
    return packed(np.frombuffer(b"".join(words), np.uint8), np.array([len(w) for w in words], np.int32), *columns)


def unpacked_words(data: bytes) -> tuple[list[bytes], list[np.ndarray]]:
    text, lengths, *columns = unpacked(data)
    whole, cuts = text.tobytes(), np.concatenate([[0], np.cumsum(lengths)]).tolist()
    return [whole[a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)], columns


def gram_bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    return (mix64((grams >> np.uint64(8)) & np.uint64(0xFFFFFF)) % np.uint64(buckets)).astype(np.int64)


def _dealt(bucket: np.ndarray, buckets: int) -> Iterator[tuple[int, np.ndarray]]:
    """Places of each bucket that has any, in their order."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(cuts)):
        yield int(b), order[cuts[b] : cuts[b + 1]]


def block_rows(parts: list[Part], buckets: int) -> Iterator[tuple[int, int, bytes]]:
    """(kind, bucket, data) of a block's dictionaries, grams and words of its parts with their counts, and of each part's texts.

    A word's place in the block is that in the words of all buckets, one after the other.
    """
    grams, counts = summed(np.concatenate([p.grams for p in parts]), np.concatenate([p.counts for p in parts]))
    for b, at in _dealt(gram_bucket(grams, buckets), buckets):
        yield GRAMS, b, packed(steps(grams[at]), np.zeros(0, np.uint32), counts[at])
    words: dict[bytes, int] = {}
    for p in parts:
        for w, n in zip(p.words, p.times.tolist(), strict=True):
            words[w] = words.get(w, 0) + n
    held: list[list[bytes]] = [[] for _ in range(buckets)]
    for w in sorted(words):  # words that begin alike compress together
        held[zlib.crc32(w[:-1]) % buckets].append(w)
    place: dict[bytes, int] = {}
    for b, own in enumerate(held):
        if own:
            yield WORDS, b, packed_words(own, np.array([words[w] for w in own], np.int64))
            place.update(zip(own, range(len(place), len(place) + len(own)), strict=True))
    for p in parts:
        at = np.array([place[w] for w in p.words], np.int32)
        yield TEXT, -1, packed(at[p.word], np.bincount(p.piece, minlength=len(p.size)).astype(np.int32), p.lead.astype(np.int8), p.before)


def later_grams(words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of words from the sixth on: distinct (gram, hash of the word so far), their counts, and of each such
    byte, word by word, the place among the distinct ones."""
    s = np.frombuffer(b"".join(words), np.uint8)
    length = np.array([len(w) for w in words], np.int64)
    start = np.cumsum(length) - length
    many = np.maximum(0, length - REACH)
    at = np.repeat(start + REACH - (np.cumsum(many) - many), many) + np.arange(many.sum())
    grams, names = shifted(s)[at], (Spans(s)(np.repeat(start, many), at) >> np.uint64(32)).astype(np.uint32)
    order = np.lexsort((names, grams))
    g, h = grams[order], names[order]
    new = np.append(True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])) if len(g) else np.zeros(0, bool)
    place = np.empty(len(g), np.int64)
    place[order] = np.cumsum(new) - 1
    return g[new], h[new], np.bincount(place, np.repeat(counts, many), int(new.sum())).astype(np.int64), place


def key_of(grams: np.ndarray, names: np.ndarray) -> np.ndarray:
    """What tells entries apart: a gram of a word's first bytes itself, else a hash of context and word, and the byte."""
    if not len(names):
        return grams
    with np.errstate(over="ignore"):
        return (mix64((grams >> np.uint64(8)) * _MULT + names.astype(np.uint64)) | _TOP) & ~_LOW | grams & _LOW


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Keys, grams and counts of a bucket's part of a dictionary."""
    grams, names, counts = unpacked(data)
    grams = np.cumsum(grams, dtype=np.uint64)
    return key_of(grams, names), grams, counts


def looked_up(keys: np.ndarray, wanted: np.ndarray) -> np.ndarray:
    """Places of the wanted ones among ascending keys that hold them all; most are found by a table of hashes."""
    if not len(keys):
        return np.zeros(0, np.int64)
    bits = np.uint64(64 - (4 * len(keys)).bit_length())
    with np.errstate(over="ignore"):
        table = np.zeros(1 << int(64 - bits), np.int32)
        table[(keys * _MULT) >> bits] = np.arange(len(keys), dtype=np.int32)
        at = table[(wanted * _MULT) >> bits]
    miss = np.flatnonzero(keys[at] != wanted)
    at[miss] = np.searchsorted(keys, wanted[miss])
    return at


# --- the model --------------------------------------------------------------------------


def squash(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -20, 20)))


def bit_sums(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of distinct ascending (context, byte) keys with counts: for 0 to 8 leading bits of the byte, the count of
    all keys of the context that share them; a row for each number of bits."""
    out = np.empty((9, len(keys)))
    out[8] = n
    for b in range(8):
        part = keys >> np.uint64(8 - b)
        heads = np.flatnonzero(np.append(True, part[1:] != part[:-1])) if len(part) else np.zeros(0, np.int64)
        sums = np.add.reduceat(out[8], heads) if len(heads) else np.zeros(0)
        out[b] = np.repeat(sums, np.diff(np.append(heads, len(part))))
    return keys, out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ascending keys and their counts."""
    order = np.argsort(keys)
    ordered = keys[order]
    heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
    return ordered[heads], np.add.reduceat(n[order], heads) if len(heads) else n[:0]


class Contexts:
    """Bit counts of all contexts of the keys of some whole three-byte contexts."""

    def __init__(self, keys: np.ndarray, grams: np.ndarray, n: np.ndarray, low: list[tuple[np.ndarray, np.ndarray]]):
        self.keys, self.grams, self.n = keys, grams, n.astype(np.float64)
        self.byte = (grams & _LOW).astype(np.int64)
        self.tables, self.at = [], []
        for order in range(1, REACH + 1):
            own = grams & np.uint64((1 << (8 * (order + 1))) - 1)
            table = low[order - 1] if order <= 2 else bit_sums(*summed(own, self.n))
            self.tables.append(table[1])
            self.at.append(np.searchsorted(table[0], own))
        # the word so far: of over four bytes by its hash, else the context that begins at its space
        self.whole = (keys & _TOP) > 0
        found = bit_sums(*summed(keys[self.whole], self.n[self.whole]))
        self.tables.append(found[1])
        self.at.append(np.searchsorted(found[0], keys[self.whole]))
        self.begun = np.full(len(grams), REACH - 1)
        for k in range(REACH - 1, -1, -1):
            before = (grams >> np.uint64(8 * (k + 1))) & _LOW
            self.begun[(before == 32) | (before == 0)] = k

    def inputs(self, bit: int, own: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Stretched predictions of the keys' own bit (a row each context, and a bias), the gate, and the sign of the
        bit.  ``own``: with the occurrence itself; learning leaves it out."""
        same, all_ = (np.empty((REACH + 1, len(self.grams)), np.float32) for _ in range(2))
        for k in range(REACH):
            same[k], all_[k] = self.tables[k][bit + 1][self.at[k]], self.tables[k][bit][self.at[k]]
        for out in (same, all_):
            out[REACH] = np.take_along_axis(out[:REACH], self.begun[None], 0)[0]
        same[REACH, self.whole], all_[REACH, self.whole] = self.tables[REACH][bit + 1][self.at[REACH]], self.tables[REACH][bit][self.at[REACH]]
        if not own:
            same -= 1
            all_ -= 1
        x = np.empty((INPUTS, len(self.grams)), np.float32)
        np.log((same + np.float32(PRIOR)) / (all_ - same + np.float32(PRIOR)), out=x[: REACH + 1])
        sign = (2 * ((self.byte >> (7 - bit)) & 1) - 1).astype(np.float32)
        x[REACH + 1] = np.float32(0.3) * sign
        longest = np.zeros(len(self.grams), np.int64)
        for k in range(REACH):
            longest[all_[k] > 0] = k + 1
        longest[self.whole & (all_[REACH] > 0)] += REACH + 1
        return x, longest * 8 + bit, sign


@dataclass
class Model:
    """The mixer's weights and the refinement's curves, both by gate: the longest context that has been seen, whether
    the word has, and the bit's place."""

    weights: np.ndarray = field(default_factory=lambda: np.full((GATES, INPUTS), 0.3))
    curves: np.ndarray = field(default_factory=lambda: np.tile(np.linspace(-8, 8, KNOTS), (GATES, 1)))

    def mixed(self, x: np.ndarray, gate: np.ndarray) -> np.ndarray:
        """The stretched probability of the own bit."""
        return np.clip(np.einsum("ij,ij->j", x, self.weights.T[:, gate]), -7.99, 7.99)

    def refine(self, s: np.ndarray, gate: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The gate's curve at the stretched probability of a one; the knot below and the way to the next."""
        place = (s + 8) * ((KNOTS - 1) / 16)
        knot = place.astype(np.int64)
        way = place - knot
        return self.curves[gate, knot] * (1 - way) + self.curves[gate, knot + 1] * way, knot, way

    def log10(self, c: Contexts) -> np.ndarray:
        """The log10 probability of each key's byte in its context."""
        total = np.zeros(len(c.grams))
        for bit in range(8):
            x, gate, sign = c.inputs(bit)
            s = self.mixed(x, gate)
            curve, _, _ = self.refine(s * sign, gate)
            total += np.log10(np.clip((squash(s) + squash(curve * sign)) / 2, 1e-6, 1 - 1e-6))
        return total

    def learn(self, c: Contexts) -> np.ndarray:
        """Online, key by key in a fixed random order: predict a byte's bits from its contexts' other occurrences, then
        move weights and curves along the errors, as often as the byte occurs there.

        Rates fall with the squares of the gradients so far (AdaGrad).  Returns the occurrences by gate.
        """
        mass = np.zeros(GATES)
        order = np.argsort(mix64(c.keys))
        n = c.n[order]
        bits = [tuple(v[..., order] for v in c.inputs(bit, own=False)) for bit in range(8)]
        seen, bent = np.full(self.weights.shape, 1.0), np.full(self.curves.size, 1.0)
        for begin in range(0, len(order), STEP):
            at = slice(begin, begin + STEP)
            times = n[at]
            for xs, gates, signs in bits:
                x, gate, sign = xs[:, at], gates[at], signs[at]
                s = self.mixed(x, gate)
                off = times * (1 - squash(s))
                slope = np.stack([np.bincount(gate, off * row, GATES) for row in x], axis=1)
                seen += slope * slope
                self.weights += RATE * slope / np.sqrt(seen)
                curve, knot, way = self.refine(s * sign, gate)
                off = times * ((sign > 0) - squash(curve))
                place = gate * KNOTS + knot
                bend = np.bincount(place, off * (1 - way), self.curves.size) + np.bincount(place + 1, off * way, self.curves.size)
                bent += bend * bend
                self.curves += (CURVE_RATE * bend / np.sqrt(bent)).reshape(self.curves.shape)
                mass += np.bincount(gate, times, GATES)
        np.clip(self.curves, -10, 10, out=self.curves)
        return mass


# --- training and scoring over tables -----------------------------------------------------


def text_column(df: DataFrame) -> Column:
    return F.coalesce(F.col("text").cast("string"), F.lit(""))


def _parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[Part, list[tuple]]]:
    """Parts with what names their pieces: (rid, doc_id, held_out, whether the text ends there).  Learnt texts come first."""
    held: list[list[tuple]] = [[], []]
    size = 0

    def made() -> tuple[Part, list[tuple]]:
        rows = held[0] + held[1]
        stream = np.frombuffer(b"".join(part for r in rows for part in r[:2]), np.uint8)
        part = Part(np.array([len(r[0]) for r in rows]), np.array([len(r[1]) for r in rows]), stream, len(held[0]))
        return part, [r[2:] for r in rows]

    for batch in batches:
        for rid, doc_id, out, text in zip(*[batch.column(c).to_pylist() for c in ("rid", "doc_id", "held_out", "text")], strict=True):
            data = normalised(text)
            left = len(data)
            for lead, body in pieces(data):
                left -= len(body)
                held[bool(out)].append((lead, body, rid, doc_id, bool(out), not left))
                size += len(body)
                if size >= PART:
                    yield made()
                    held, size = [[], []], 0
    if size:
        yield made()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _rows(batch: pa.RecordBatch, *names: str) -> Iterator[tuple]:
    return zip(*[batch.column(c).to_pylist() for c in names], strict=True)


def dictionaries(docs: DataFrame, training: Column, buckets: int) -> DataFrame:
    """Rows of blocks (block, kind, bucket, data, names): the texts of their parts, and their dictionaries by bucket."""
    names = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", docs.schema["doc_id"].dataType), T.StructField("held_out", T.BooleanType()), T.StructField("ends", T.BooleanType())])
    schema = T.StructType([T.StructField("block", T.LongType()), *[T.StructField(c, T.IntegerType()) for c in ("kind", "bucket")], T.StructField("data", T.BinaryType()), T.StructField("names", T.ArrayType(names))])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = to_arrow_schema(schema)
        context = TaskContext.get()
        number = (context.partitionId() if context else 0) << 32
        held: list[Part] = []
        names_of: list[list[tuple]] = []
        size = 0

        def made() -> pa.RecordBatch:
            rows, texts = [], iter(names_of)
            for kind, bucket, data in block_rows(held, buckets):
                rows.append((number, kind, bucket, data, [dict(zip(names.names, r, strict=True)) for r in next(texts)] if kind == TEXT else None))
            return _batch(rows, arrow)

        for part, rows in _parts(batches):
            part.stream = None  # not needed any more
            held.append(part)
            names_of.append(rows)
            size += part.size.sum()
            if size >= BLOCK:
                yield made()
                number, held, names_of, size = number + 1, [], [], 0
        if held:
            yield made()

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", (~training).alias("held_out"), text_column(docs).alias("text"))
    return materialise(rows.mapInArrow(work, schema), "lm_blocks")


def by_bucket(batches: Iterator[pa.RecordBatch], key: str, *names: str) -> Iterator[tuple[int, list[tuple]]]:
    """Rows of each key, whose rows come together.  What is held of a key is compressed."""
    now, held = None, []
    for batch in batches:
        for bucket, *row in _rows(batch, key, *names):
            if bucket != now:
                if held:
                    yield now, held
                now, held = bucket, []
            held.append(tuple(row))
    if held:
        yield now, held


def merged_words(blocks: DataFrame, buckets: int) -> DataFrame:
    """(block, kind, bucket, data, total, distinct): each word bucket's words with their counts, the sum of the counts
    and the number of words that occur; and the grams that it asks gram buckets for, as block ``-1 - bucket``."""
    arrow = pa.schema([("block", pa.int64()), ("kind", pa.int32()), ("bucket", pa.int32()), ("data", pa.binary()), ("total", pa.int64()), ("distinct", pa.int64())])

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches, "bucket", "data"):
            found: dict[bytes, int] = {}
            for (data,) in rows:
                words, (counts,) = unpacked_words(data)
                for w, n in zip(words, counts.tolist(), strict=True):
                    found[w] = found.get(w, 0) + n
            words = sorted(found)
            counts = np.array([found[w] for w in words], np.int64)
            distinct = len({w[:-1] for w, n in found.items() if n})
            out = [(-1 - bucket, WORDS, bucket, packed_words(words, counts), int(counts.sum()), distinct)]
            grams, names, n, _ = later_grams(words, counts)
            out += [(-1 - bucket, GRAMS, b, packed(steps(grams[at]), names[at], n[at]), 0, 0) for b, at in _dealt(gram_bucket(grams, buckets), buckets)]
            yield _batch(out, arrow)

    dealt = blocks.where(F.col("kind") == WORDS).select("bucket", "data").repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket")
    return materialise(dealt.mapInArrow(work, "block long, kind int, bucket int, data binary, total long, distinct long"), "lm_words")


def merged_entries(parts: Iterable[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys, ascending, their grams and summed counts; what is held is sorted out whenever it has doubled."""
    held: list[tuple[np.ndarray, ...]] = []
    size, limit = 0, 1 << 18

    def merged() -> tuple[np.ndarray, ...]:
        keys, grams, counts = (np.concatenate(c) for c in zip(*held, strict=True))
        order = np.argsort(keys, kind="stable")
        ordered = keys[order]
        heads = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1])) if len(keys) else np.zeros(0, np.int64)
        return ordered[heads], grams[order][heads], np.add.reduceat(counts[order], heads) if len(heads) else counts

    for data in parts:
        held.append(entries(data))
        size += len(held[-1][0])
        if size > limit:
            held = [merged()]
            size = len(held[0][0])
            limit = max(limit, 2 * size)
    return merged()


def asked_grams(blocks: DataFrame, words: DataFrame, buckets: int) -> DataFrame:
    """All entries, those of a bucket together: (bucket, block, data)."""
    asked = blocks.where(F.col("kind") == GRAMS).select("bucket", "block", "data").unionByName(words.where(F.col("kind") == GRAMS).select("bucket", "block", "data"))
    return asked.repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "block")


def merged_buckets(asked: DataFrame) -> DataFrame:
    """A row for each gram bucket: its keys, with grams and counts."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for bucket, rows in by_bucket(batches, "bucket", "data"):
            keys, grams, counts = merged_entries(data for (data,) in rows)
            data = packed(steps(keys), grams, counts)
            yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([data], pa.binary())], names=["bucket", "data"])

    return materialise(asked.select("bucket", "data").mapInArrow(work, "bucket int, data binary"), "lm_buckets")


def _merged(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, grams, counts = unpacked(data)
    return np.cumsum(keys, dtype=np.uint64), grams, counts


def low_orders(merged: DataFrame) -> list[tuple[np.ndarray, np.ndarray]]:
    """Bit counts of the contexts of one and two bytes: at most 2**24 pairs of a context and a byte, whatever the input."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column("data").to_pylist():
                _, grams, counts = _merged(data)
                keys, n = summed(grams & np.uint64(0xFFFFFF), counts)
                yield pa.RecordBatch.from_arrays([pa.array(keys.astype(np.int32)), pa.array(n)], names=["key", "n"])

    found = merged.select("data").mapInArrow(work, "key int, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = np.asarray(found.column("key")).astype(np.uint64), np.asarray(found.column("n")).astype(np.float64)
    return [bit_sums(*summed(keys & np.uint64(0xFFFF), n)), bit_sums(*summed(keys, n))]


def chunks(keys: np.ndarray, grams: np.ndarray, n: np.ndarray) -> Iterator[np.ndarray]:
    """Places of whole three-byte contexts, about ``CHUNK`` keys at a time."""
    near = (grams >> np.uint64(8)) & np.uint64(0xFFFFFF)
    order = np.argsort(near, kind="stable")
    heads = np.flatnonzero(np.append(True, near[order][1:] != near[order][:-1])) if len(order) else np.zeros(0, np.int64)
    begin = 0
    for head in [*heads[1:], len(order)]:
        if head - begin >= CHUNK or (head == len(order) and head > begin):
            yield order[begin:head]
            begin = head


def train(merged: DataFrame, low: list[tuple[np.ndarray, np.ndarray]]) -> Model:
    """Weights and curves learnt over all keys of all buckets: each bucket goes on from the same model, and the next
    round from the mean of the buckets' models, weighed by the occurrences that each has seen."""
    spark = merged.sparkSession
    model = Model()
    size = GATES * (INPUTS + KNOTS + 1)

    def learner(shared: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
        @tidy
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            low, weights, curves = shared.value
            for batch in batches:
                for bucket, data in zip(batch.column("bucket").to_pylist(), batch.column("data").to_pylist(), strict=True):
                    keys, grams, n = _merged(data)
                    learnt = n > 0
                    keys, grams, n = keys[learnt], grams[learnt], n[learnt]
                    own = Model(weights.copy(), curves.copy())
                    mass = np.zeros(GATES)
                    for at in chunks(keys, grams, n):
                        mass += own.learn(Contexts(keys[at], grams[at], n[at], low))
                    sums = np.concatenate([(own.weights * mass[:, None]).ravel(), (own.curves * mass[:, None]).ravel(), mass])
                    yield pa.RecordBatch.from_arrays([pa.array([bucket], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names=["bucket", "sums"])

        return work

    def add(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        rows = sorted(zip(table.column("bucket").to_pylist(), table.column("sums").to_pylist(), strict=True))
        total = sum((np.frombuffer(r[1]) for r in rows), np.zeros(size))
        return pa.table({"lot": pa.array([key[0].as_py()], pa.int32()), "sums": pa.array([total.tobytes()], pa.binary())})

    for _ in range(ROUNDS):
        shared = spark.sparkContext.broadcast((low, model.weights, model.curves))
        rows = merged.mapInArrow(learner(shared), "bucket int, sums binary").withColumn("lot", F.col("bucket") % 64)
        lots = sorted(rows.groupBy("lot").applyInArrow(add, "lot int, sums binary").collect(), key=lambda r: r["lot"])  # 64 rows at most
        total = sum((np.frombuffer(r["sums"]) for r in lots), np.zeros(size))
        mass = total[-GATES:]
        full = mass > 0
        for name, table, width, at in (("weights", model.weights, INPUTS, 0), ("curves", model.curves, KNOTS, GATES * INPUTS)):
            mean = total[at : at + GATES * width].reshape(GATES, width)
            new = table.copy()
            new[full] = mean[full] / mass[full, None]
            setattr(model, name, new)
        shared.unpersist()
    return model


def answers(asked: DataFrame, model: Model, low: list[tuple[np.ndarray, np.ndarray]]) -> DataFrame:
    """(block, bucket, data): to blocks their grams with the log probabilities, to word buckets the latter in the order asked."""
    shared = asked.sparkSession.sparkContext.broadcast((low, model))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, model = shared.value
        for bucket, rows in by_bucket(batches, "bucket", "block", "data"):
            keys, grams, n = merged_entries(data for _, data in rows)
            values = np.zeros(len(keys), np.float32)
            for at in chunks(keys, grams, n):
                values[at] = model.log10(Contexts(keys[at], grams[at], n[at], low))
            for block, data in rows:
                own, wanted, _ = entries(data)
                found = rounded(values[looked_up(keys, own)])
                reply = packed(found) if block < 0 else packed(steps(wanted), found)
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([reply], pa.binary())], names=["block", "bucket", "data"])

    return materialise(asked.mapInArrow(work, "block long, bucket int, data binary"), "lm_answers")


def answered_words(blocks: DataFrame, words: DataFrame, replies: DataFrame, buckets: int) -> DataFrame:
    """(block, bucket, data): the words that a block asks for, with the log probabilities of their later bytes and their
    training counts as tokens, whatever closes them."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        logs: dict[bytes, float] = {}
        tokens: Counter[bytes] = Counter()
        parts: list[tuple[int, bytes]] = []
        own: list[bytes] = []
        for batch in batches:
            for bucket, step, block, part, data in _rows(batch, "bucket", "step", "block", "part", "data"):
                if step == 0:  # the bucket's words, then the replies to them, then the blocks that ask
                    own, (counts,) = unpacked_words(data)
                    tokens = Counter()
                    for w, n in zip(own, counts.tolist(), strict=True):
                        tokens[w[:-1]] += n
                    parts, logs = [], {}
                    continue
                if step == 1:
                    parts.append((part, data))
                    continue
                if not logs:
                    grams, _, _, place = later_grams(own, np.zeros(len(own), np.int64))
                    values, found = np.zeros(len(grams), np.float32), dict(parts)
                    for b, at in _dealt(gram_bucket(grams, buckets), buckets):
                        values[at] = unpacked(found[b])[0]
                    many = np.maximum(0, np.array([len(w) for w in own], np.int64) - REACH)
                    sums = np.bincount(np.repeat(np.arange(len(own)), many), values[place], len(own))
                    logs = dict(zip(own, sums.tolist(), strict=True))
                wanted, _ = unpacked_words(data)
                reply = packed_words(wanted, rounded(np.array([logs[w] for w in wanted])), np.array([tokens[w[:-1]] for w in wanted], np.int64))
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int64()), pa.array([bucket], pa.int32()), pa.array([reply], pa.binary())], names=["block", "bucket", "data"])

    held = words.where(F.col("kind") == WORDS).select("bucket", F.lit(0).alias("step"), "block", F.lit(0).alias("part"), "data")
    back = replies.where("block < 0").select((-1 - F.col("block")).cast("int").alias("bucket"), F.lit(1).alias("step"), "block", F.col("bucket").alias("part"), "data")
    asked = blocks.where(F.col("kind") == WORDS).select("bucket", F.lit(2).alias("step"), "block", F.lit(0).alias("part"), "data")
    dealt = held.unionByName(back).unionByName(asked).repartitionById(buckets, F.col("bucket")).sortWithinPartitions("bucket", "step", "block", "part")
    return dealt.mapInArrow(work, "block long, bucket int, data binary")


@finished("lm_scores")
def score(docs: DataFrame) -> DataFrame:
    """Per document: held_out, n_tokens, n_known, train_tokens, base_score and score (both log10).

    ``base_score`` is the add-one unigram score of the tokens (words and one end); ``score``
    the model's log10 probability of the text, that is of the bytes of the lower-cased words
    joined by single spaces and of their end, so ``-score * log2(10) / bytes`` is bits per
    byte.  Null texts are empty and have the end alone.  With nothing to learn from, counts
    are 0 and predictions rest on the prior.  Repeated rows are scored each; long texts go in
    pieces that are cut after a space, with the bytes before them as context.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    training = ~held_out(F.col("doc_id"), MODULUS, REMAINDER)
    texts, volume = docs.where(training).agg(F.count(F.lit(1)), F.sum(F.octet_length(text_column(docs)))).first()
    buckets = max(1, min(BUCKETS, -(-(volume or 0) // BUCKET_BYTES)))
    blocks = dictionaries(docs, training, buckets)
    words = merged_words(blocks, buckets)
    tokens, distinct = words.agg(F.sum("total"), F.sum("distinct")).first()
    total, divisor = int(tokens or 0) + texts, float(int(tokens or 0) + texts + int(distinct or 0) + (texts > 0) + 1)
    with scratch(spark):
        merged = merged_buckets(asked_grams(blocks, words, buckets))
        low = low_orders(merged)
        model = train(merged, low)
    replies = answers(asked_grams(blocks, words, buckets), model, low)
    kind = docs.schema["doc_id"].dataType
    none = F.lit(None).cast(blocks.schema["names"].dataType)
    spoken = answered_words(blocks, words, replies, buckets)
    both = blocks.where(F.col("kind") == TEXT).select("block", F.lit(0).alias("step"), "bucket", "data", "names")
    both = both.unionByName(replies.where("block >= 0").select("block", F.lit(1).alias("step"), "bucket", "data", none.alias("names")))
    both = both.unionByName(spoken.select("block", F.lit(2).alias("step"), "bucket", "data", none.alias("names")))
    dealt = both.repartition(buckets, "block").sortWithinPartitions("block", "step", "bucket")
    end_base = float(np.log10((texts + 1) / divisor))

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def finish(held: list[tuple], found: list[bytes], said: list[bytes]) -> Iterator[pa.RecordBatch]:
            parts = [unpacked(f) for f in found]
            grams = np.concatenate([np.zeros(0, np.uint64), *[np.cumsum(p[0], dtype=np.uint64) for p in parts]])
            order = np.argsort(grams)
            grams, logs = grams[order], np.concatenate([np.zeros(0), *[p[1] for p in parts]])[order]
            # the words of all buckets, one after the other
            spoken = [unpacked(data) for data in said]
            text, length, word_logs, word_counts = (np.concatenate([np.zeros(0, k), *[p[i] for p in spoken]]) for i, k in enumerate((np.uint8, np.int64, np.float64, np.int64)))
            for names, data in held:
                words, many, lead, before = unpacked(data)
                spelt = Spelt(words, many.astype(np.int64), lead.astype(np.int64), before)
                total, own, n, seen, size = spelt.sums(text, length, grams, logs, word_logs, word_counts, divisor)
                ends = names.field("ends").to_numpy(zero_copy_only=False).astype(np.int64)
                named = [names.field(c) for c in ("rid", "doc_id", "held_out")]
                yield pa.RecordBatch.from_arrays([*named, pa.array(n + ends), pa.array(seen + ends * (texts > 0)), pa.array(own + ends * end_base), pa.array(total), pa.array(size)], names=["rid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "n_bytes"])

        now, held, found, said = None, [], [], []
        for batch in batches:
            for i, (block, step, data) in enumerate(_rows(batch, "block", "step", "data")):
                if block != now:
                    if held:
                        yield from finish(held, found, said)
                    now, held, found, said = block, [], [], []
                if step == 0:
                    held.append((batch.column("names")[i].values, data))
                else:
                    (found if step == 1 else said).append(data)
        if held:
            yield from finish(held, found, said)

    schema = T.StructType([T.StructField("rid", T.LongType()), T.StructField("doc_id", kind), T.StructField("held_out", T.BooleanType()), *[T.StructField(c, T.LongType()) for c in ("n_tokens", "n_known")], *[T.StructField(c, T.DoubleType()) for c in ("base_score", "score")], T.StructField("n_bytes", T.LongType())])
    found = dealt.mapInArrow(work, schema)
    texts_ = found.groupBy("rid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score", "n_bytes")])
    return texts_.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(total).cast("long").alias("train_tokens"), "base_score", "score", (-F.col("score") * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"))
