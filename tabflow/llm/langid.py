"""Operator 4: language identification, family first, then one-versus-one linear SVMs within the family."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.llm.common import bounded_batches, by_volume, lower_bytes, text_bytes, tidy

UNDETERMINED = "und"
#: Families of language codes; a code that isn't listed belongs to the family "other".
FAMILIES = {
    "germanic": "en de nl sv da no nb nn is af lb fy",
    "romance": "es fr it pt ro ca gl oc",
    "slavic": "ru uk be pl cs sk bg sr hr sl mk",
    "uralic": "fi et hu",
    "turkic": "tr az kk uz",
    "sinitic": "zh yue",
}
#: The classifiers are fit on at most so many labelled rows in all (but one a language at least), and a language.
SAMPLE_ROWS, SAMPLE_PER_LANG = 3000, 400
#: Hash bins of the letter trigrams.
BIN_BITS = 12
BATCH_CHARS = 1 << 20
_MULT = np.uint32(2654435761)

#: Bytes to letter classes: a-z, bytes above ASCII each their own, all else a gap.
_CLASS = np.zeros(256, np.uint32)
_CLASS[97:123] = np.arange(1, 27)
_CLASS[128:] = np.arange(27, 155)


def trigram_bins(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The hash bin of each letter trigram of the whole texts, with gaps at both ends, and where each text's begin."""
    data, offsets = text_bytes([f" {t or ''} " for t in texts])
    c = _CLASS[lower_bytes(data)]
    codes = np.zeros(len(c), np.uint32)
    codes[:-2] = (c[:-2] * 155 + c[1:-1]) * 155 + c[2:]
    at = np.arange(len(c))
    bins = (codes * _MULT) >> np.uint32(32 - BIN_BITS)
    # trigrams of gaps only, and those that reach into the next text, go
    keep = codes > 0
    keep[offsets[1:] - 1] = False
    keep[offsets[1:] - 2] = False
    kept = at[keep]
    return bins[keep].astype(np.int64), np.searchsorted(kept, offsets)


@dataclass
class Model:
    """Weights of all pairwise classifiers over trigram bins, columns in the order of ``pairs``."""

    langs: list[str]
    families: list[list[str]]
    pairs: list[tuple[str, int, int, int]]  # level ("family" or "lang"), family, one, other
    weights: np.ndarray
    bias: np.ndarray

    def margins(self, bins: np.ndarray, first: np.ndarray) -> np.ndarray:
        """The margin of each pairwise classifier for each text: its mean weight over the text's trigrams."""
        n = len(first) - 1
        out = np.zeros((n, len(self.pairs)))
        counts = np.diff(first)
        full = np.flatnonzero(counts)
        if len(full) and self.pairs:
            for k in range(len(self.pairs)):
                out[full, k] = np.add.reduceat(self.weights[bins, k], first[:-1][full], dtype=np.float64)
            out[full] /= counts[full, None]
        return out + self.bias

    def predict(self, margins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The language's number and a score for each row of margins."""
        n = len(margins)
        family, sure = self._duel(margins, "family", -1, len(self.families))
        lang, score = np.zeros(n, np.int64), np.zeros(n)
        for f, members in enumerate(self.families):
            rows = np.flatnonzero(family == f)
            won, by = self._duel(margins[rows], "lang", f, len(members))
            lang[rows] = np.array([self.langs.index(m) for m in members])[won]
            score[rows] = np.minimum(sure[rows], by)
        return lang, score

    def _duel(self, margins: np.ndarray, level: str, family: int, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Pairwise votes; ties go to the larger sum of squashed margins.  The score is the least certain duel that the winner won or lost."""
        rows = len(margins)
        if n == 1:
            return np.zeros(rows, np.int64), np.ones(rows)
        votes = np.zeros((rows, n))
        least = np.ones((rows, n))
        for k, (at, f, a, b) in enumerate(self.pairs):
            if (at, f) == (level, family):
                m = margins[:, k]
                p = 1 / (1 + np.exp(np.clip(-3 * m, -50, 50)))
                votes[:, a] += (m >= 0) + 1e-3 * np.tanh(m)
                votes[:, b] += (m < 0) - 1e-3 * np.tanh(m)
                least[:, a], least[:, b] = np.minimum(least[:, a], p), np.minimum(least[:, b], 1 - p)
        won = np.argmax(votes, axis=1)
        return won, least[np.arange(rows), won]


def svm(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3, rounds: int = 200) -> tuple[np.ndarray, float]:
    """A linear SVM with squared hinge loss, by accelerated gradient descent over all rows; deterministic."""
    n, d = x.shape
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum())).astype(np.float32)
    v = np.ones(d, np.float32) / np.sqrt(d)
    for _ in range(10):
        v = x.T @ (share * (x @ v))
        size = float(np.linalg.norm(v)) or 1.0
        v /= size
    step = 1 / (2 * (size + 1) * 1.1 + penalty)
    w, u = np.zeros(d, np.float32), np.zeros(d, np.float32)
    b = ub = 0.0
    for t in range(rounds):
        short = np.maximum(0, 1 - y * (x @ u + ub)) * share * y
        w2, b2 = u + step * (2 * (x.T @ short) - penalty * u), ub + step * 2 * float(short.sum())
        m = t / (t + 3)
        u, ub, w, b = w2 + m * (w2 - w), b2 + m * (b2 - b), w2, b2
    return w, b


def fit(x: np.ndarray, labels: list[str], families: dict[str, str] | None = None) -> Model:
    """Classifiers from rows of bin frequencies (overwritten) and their languages."""
    named = {code: f for f, codes in (families or FAMILIES).items() for code in codes.split()}
    langs = sorted(set(labels))
    groups: dict[str, list[str]] = {}
    for lang in langs:
        groups.setdefault(named.get(lang, "other"), []).append(lang)
    members = [groups[f] for f in sorted(groups)]
    mean = x.mean(axis=0) if len(x) else np.zeros(x.shape[1], np.float32)
    scale = 1 / (x.std(axis=0) + 1e-4) if len(x) else np.ones(x.shape[1], np.float32)
    z = x  # standardised in place: the sample is the driver's largest table
    z -= mean
    z *= scale / np.sqrt(x.shape[1], dtype=np.float32)
    lab = np.array(labels)
    pairs, weights, bias = [], [], []

    def duel(level: str, family: int, a: int, b: int, one: list[str], other: list[str]) -> None:
        rows = np.isin(lab, one + other)
        y = np.where(np.isin(lab[rows], one), 1, -1).astype(np.float32)
        w, c = svm(z[rows], y)
        w = w * scale / np.sqrt(x.shape[1], dtype=np.float32)
        pairs.append((level, family, a, b))
        weights.append(w.astype(np.float32))
        bias.append(c - float(w @ mean))

    for a, b in combinations(range(len(members)), 2):
        duel("family", -1, a, b, members[a], members[b])
    for f, own in enumerate(members):
        for a, b in combinations(range(len(own)), 2):
            duel("lang", f, a, b, [own[a]], [own[b]])
    table = np.stack(weights, axis=1) if weights else np.zeros((x.shape[1], 0), np.float32)
    return Model(langs, members, pairs, np.asfortranarray(table), np.array(bias))


@tidy
def _bin_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bins of each (lang, h) that the task meets, once."""
    seen: set[tuple[str, int]] = set()
    for batch in batches:
        keys = list(zip(batch.column("lang").to_pylist(), batch.column("h").to_pylist(), strict=True))
        new = [i for i, k in enumerate(keys) if k not in seen and not seen.add(k)]
        batch = batch.take(pa.array(new, pa.int64()))
        texts = batch.column("text").to_pylist()
        for part in by_volume(texts, BATCH_CHARS):
            bins, first = trigram_bins(texts[part])
            found = [np.unique(bins[a:b], return_counts=True) for a, b in zip(first[:-1], first[1:], strict=True)]
            own = [batch.column(c).slice(part.start, part.stop - part.start) for c in ("lang", "h")]
            packed = [pa.array([f[k].astype(np.int32).tobytes() for f in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*own, *packed], names=["lang", "h", "bins", "counts"])


def held_out(doc_id: Column, modulus: int = 4, remainder: int = 2) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(modulus)) == remainder


def learn(docs: DataFrame) -> Model:
    """Fit on a bounded sample of every language: the rows whose id and text have the smallest hashes.

    Rows with equal id and text are drawn as one, so neither a frequent id nor a null one
    takes more than its texts' share, and the sample follows from the rows alone.
    """
    bounded_batches(docs.sparkSession)
    labelled = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id")))
    known = labelled.select("lang", F.col("text").cast("string").alias("text"), F.xxhash64("doc_id", F.col("text").cast("string")).alias("h"))
    counts = known.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()
    if not counts:
        return fit(np.zeros((0, 1 << BIN_BITS), np.float32), [])
    per = max(1, min(SAMPLE_PER_LANG, SAMPLE_ROWS // len(counts)))
    # more than the rows wanted pass by their hash, so that no window sees a language's rows all
    shares = docs.sparkSession.createDataFrame([(r["lang"], min(1.0, (2 * per + 20) / r["n"])) for r in counts], "lang string, share double")
    ids = known.select("lang", "h").join(F.broadcast(shares), "lang").where(F.pmod("h", F.lit(1 << 31)) < F.col("share") * (1 << 31))
    order = Window.partitionBy("lang").orderBy("h")
    picked = ids.select("lang", "h").distinct().withColumn("r", F.row_number().over(order)).where(F.col("r") <= per).select("lang", "h")
    rows = known.join(F.broadcast(picked), ["lang", "h"], "left_semi")  # picked: at most SAMPLE_ROWS rows
    binned = rows.select("lang", "text", "h").mapInArrow(_bin_batches, "lang string, h long, bins binary, counts binary")
    sample = binned.dropDuplicates(["lang", "h"]).drop("h").collect()
    sample = sorted((r for r in sample if r["bins"]), key=lambda r: (r["lang"], r["bins"], r["counts"]))
    x = np.zeros((len(sample), 1 << BIN_BITS), np.float32)
    for i, r in enumerate(sample):
        counts = np.frombuffer(r["counts"], np.int32).astype(np.float32)
        x[i, np.frombuffer(r["bins"], np.int32)] = counts / counts.sum()
    return fit(x, [r["lang"] for r in sample])


def predictions(docs: DataFrame, model: Model, carry: list[str], named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``carry`` columns with the predicted language and its score (columns ``named``) for the whole text of each row.  Only the text enters a prediction."""
    bounded_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    text = "text" if "text" in carry and isinstance(docs.schema["text"].dataType, T.StringType) else "__tf_text"
    rows = docs.select(*carry) if text in carry else docs.select(*carry, F.col("text").cast("string").alias(text))

    @tidy
    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            texts = batch.column(text).to_pylist()
            for part in by_volume(texts, BATCH_CHARS):
                own = texts[part]
                bins, first = trigram_bins(own)
                names, scores = [UNDETERMINED] * len(own), np.zeros(len(own))
                if m.langs:
                    lang, score = m.predict(m.margins(bins, first))
                    for i, t in enumerate(own):
                        if t and first[i + 1] > first[i] and (t.isascii() or any(c.isalpha() for c in t)):
                            names[i], scores[i] = m.langs[lang[i]], score[i]
                rows = batch.slice(part.start, part.stop - part.start)
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carry], pa.array(names, pa.string()), pa.array(scores)], names=[*carry, *named])

    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField(named[0], T.StringType()), T.StructField(named[1], T.DoubleType())])
    return rows.mapInArrow(predict, schema)


def identify(docs: DataFrame) -> DataFrame:
    """Per document: held_out, lang_pred and score.

    Learns from text and language of rows that aren't held out.  A null text or one without
    letters is ``und`` with score 0; so is every text if there is nothing to learn from.
    """
    model = learn(docs)
    rows = docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return predictions(rows, model, ["doc_id", "held_out"])


def accepted_documents(docs: DataFrame) -> DataFrame:
    """The documents whose text has a language; those that are ``und`` go.  All columns are kept."""
    model = learn(docs)
    return predictions(docs, model, docs.columns, ("__tf_lang", "__tf_score")).where(F.col("__tf_lang") != UNDETERMINED).select(*docs.columns)
