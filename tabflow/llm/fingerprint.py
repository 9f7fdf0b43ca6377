"""Operator 6: document fingerprints by locally consistent parsing with deterministic coin tossing."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from tabflow.llm.common import _powers, bounded_batches, by_volume, cut_array, cuts_below, mix64, text_bytes, tidy

#: Phrases are named over LEVELS rounds of parsing, which makes them about 15 bytes long.
LEVELS = 3
#: Names of a sketch for callers that bound its size (``keep``); fingerprints hold all names, 8 hex digits each.
SKETCH = 64
BATCH_CHARS = 1 << 20
#: Documents that a range of ids holds, about, and ranges at most.
DOCS_A_PARTITION, MOST_PARTITIONS = 4096, 1 << 15
_RUN = np.uint64(0xA24BAED4963EE407)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Deterministic coin tossing: twice the lowest bit place where a symbol differs from the one before, plus its bit there.

    Neighbours differ before and after.  A text's first symbol counts as differing in bit 0.
    """
    kind = symbols.dtype.type
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[first] = symbols[first] ^ kind(1)
    low = symbols ^ before
    low &= ~low + kind(1)
    return (np.bitwise_count(low - kind(1)).astype(np.uint8) << np.uint8(1)) + ((symbols & low) != 0)


def _level(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One round of parsing.  ``first``: where the (non-empty) texts begin.  Gives the phrase names and where texts begin among them.

    Runs of a symbol become one symbol, coin tossing shrinks the alphabet to six labels of
    which neighbours differ, a phrase begins at each local minimum, and its name is a hash
    of its symbols.  All this looks at a few symbols around a place, so equal substrings
    are cut and named alike but for their margins.
    """
    n = len(symbols)
    new = np.ones(n, bool)
    new[1:] = symbols[1:] != symbols[:-1]
    new[first] = True
    if not new.all():
        heads = np.flatnonzero(new)
        runs = np.diff(heads, append=n)
        first = np.searchsorted(heads, first)
        symbols = symbols[heads].astype(np.uint64)
        long = runs > 1
        symbols[long] = mix64(symbols[long] + runs[long].astype(np.uint64) * _RUN)
        n = len(symbols)
    labels = symbols
    for _ in range(4):  # 64 bits, then 128 labels, 14, 8, 6
        labels = _toss(labels, first)
    starts = np.zeros(n, bool)
    if n > 2:
        starts[1:-1] = (labels[1:-1] < labels[:-2]) & (labels[1:-1] < labels[2:])
    ends = np.append(first[1:], n) - 1
    starts[ends] = False
    starts[first] = True
    after = first + 1
    starts[after[after <= ends]] = False  # the first phrase has two symbols at least
    at = np.flatnonzero(starts)
    p, q = _powers(n + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(n + 1, np.uint64)
        np.cumsum(mix64(symbols.astype(np.uint64) + np.uint64(1)) * p[:n], out=total[1:])
        upto = np.append(at[1:], n)
        names = mix64((total[upto] - total[at]) * q[at] + (upto - at).astype(np.uint64))
    return names, np.searchsorted(at, first)


def fingerprints(texts: list[str | None], levels: int = LEVELS, keep: int | None = None) -> list[np.ndarray]:
    """All distinct 32-bit phrase names of the last level of each text, or the ``keep`` smallest, ascending; none for an empty text."""
    data, offsets = text_bytes(texts)
    full = np.flatnonzero(np.diff(offsets))
    out = [np.zeros(0, np.uint32)] * len(texts)
    if not len(full):
        return out
    symbols, first = data, offsets[:-1][full]
    for _ in range(levels):
        symbols, first = _level(symbols, first)
    names = (mix64(symbols ^ _RUN) >> np.uint64(32)).astype(np.uint32)
    for i, a, b in zip(full, first, np.append(first[1:], len(names)), strict=True):
        out[i] = np.unique(names[a:b])[:keep]
    return out


def likeness(a: np.ndarray, b: np.ndarray, keep: int | None = None) -> float:
    """The share of the names of both together, or of the ``keep`` smallest, that both have; 1 for two empty fingerprints."""
    both = np.union1d(a, b)[:keep]
    return float(np.count_nonzero(np.isin(both, a) & np.isin(both, b)) / len(both)) if len(both) else 1.0


def printed(names: np.ndarray) -> str:
    return names.astype(">u4").tobytes().hex()


def fingerprint_column(docs: DataFrame, carry: list[str], text_col: str = "text") -> DataFrame:
    """``carry`` columns with ``fingerprint`` of each row's whole text; equal texts have equal fingerprints."""

    @tidy
    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column("__tf_text").to_pylist()
            for part in by_volume(texts, BATCH_CHARS):
                rows = batch.slice(part.start, part.stop - part.start)
                prints = pa.array([printed(f) for f in fingerprints(texts[part])], pa.string())
                yield pa.RecordBatch.from_arrays([*[rows.column(c) for c in carry], prints], names=[*carry, "fingerprint"])

    bounded_batches(docs.sparkSession)
    schema = T.StructType([*[docs.schema[c] for c in carry], T.StructField("fingerprint", T.StringType())])
    return docs.select(*carry, F.col(text_col).cast("string").alias("__tf_text")).mapInArrow(work, schema)


def edited_text(text: str, following: str) -> str:
    """The last half (rounded down) of the code points replaced by the first as many of the following text, or all of it."""
    k = len(text) // 2
    return text[: len(text) - k] + following[:k]


def _compare_batches(batches: Iterator[pa.RecordBatch], named: pa.DataType) -> Iterator[pa.RecordBatch]:
    names = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        """Of rows (part, ghost, doc_id, text) all but the last, each with the one after it, unless that begins another part."""
        own = [i for i in range(len(rows) - 1) if not rows[i][1]]
        edited = [edited_text(rows[i][3], rows[i + 1][3]) for i in own]
        prints = fingerprints([r[3] for r in rows])
        changed = fingerprints(edited)
        cols = [
            pa.array([rows[i][2] for i in own], named),
            pa.array([len(rows[i][3]) for i in own], pa.int64()),
            pa.array([hashlib.sha256(e.encode("utf-8", "surrogatepass")).hexdigest() for e in edited], pa.string()),
            pa.array([printed(prints[i]) for i in own], pa.string()),
            pa.array([printed(c) for c in changed], pa.string()),
            pa.array([likeness(prints[i], c) for i, c in zip(own, changed, strict=True)], pa.float64()),
            pa.array([likeness(prints[i], prints[i + 1]) for i in own], pa.float64()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=names)

    rows: list[tuple] = []
    size = 0
    for batch in batches:
        for r in zip(*[batch.column(c).to_pylist() for c in ("part", "ghost", "doc_id", "text")], strict=True):
            rows.append(r)
            size += len(r[3])
            if size >= BATCH_CHARS and len(rows) > 1:
                yield finish(rows)
                rows, size = rows[-1:], len(r[3])
    if len(rows) > 1:
        yield finish(rows)


def compare_with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprint each document and its edited text, and compare both and the next document's.

    The next document is the one of the next smaller doc_id, after the last the first; of
    repeated ids the order is by a hash of the text, and a null id comes last.  Documents are
    dealt to ranges of ids; the largest of each range is also sent to the range above, which
    needs it as the next of its smallest, so texts are shuffled once and no order is global.
    """
    bounded_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType
    key = F.col("doc_id")
    if isinstance(kind, T.StringType):  # ranges follow the first seven bytes
        key = F.conv(F.hex(F.rpad(F.substring(F.encode("doc_id", "UTF-8"), 1, 7), 7, b"\0")), 16, 10)
    key = F.coalesce(key.cast("long"), F.lit(-(1 << 63)))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), key.alias("key"))
    count, top = docs.agg(F.count(F.lit(1)), F.max(key)).first()
    parts = max(1, min(MOST_PARTITIONS, math.ceil(count / DOCS_A_PARTITION)))
    found = docs.agg(F.percentile_approx(key, [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("b")).first()["b"] if parts > 1 else []
    # percentiles are sketched, and as doubles: the cuts are the largest keys that the ranges between them have
    near = cuts_below(cut_array(sorted(set(found or [])), "bigint"), key, equal=False)
    cuts = sorted({r["k"] for r in docs.groupBy(near.alias("p")).agg(F.max(key).alias("k")).collect()} - {top})
    held = cut_array(cuts, "bigint")
    part = cuts_below(held, F.col("key"), equal=False)
    none = F.array().cast("array<int>")
    # the largest id of each range but the highest is a cut
    above = F.when(cuts_below(held, F.col("key"), equal=True) > part, F.array(part + 1)).otherwise(none)
    ghosts = F.when(F.col("key") == F.lit(top), F.array(F.lit(0))).otherwise(above)
    placed = rows.withColumn("at", F.concat(F.array(F.struct(part.alias("part"), F.lit(False).alias("ghost"))), F.transform(ghosts, lambda g: F.struct(g.alias("part"), F.lit(True).alias("ghost")))))
    dealt = placed.select("doc_id", "text", "key", F.explode("at").alias("at")).select("at.part", "at.ghost", "doc_id", "text", "key")
    ordered = dealt.repartitionById(len(cuts) + 1, F.col("part")).sortWithinPartitions("part", "ghost", F.col("key").desc(), F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    schema = f"doc_id {kind.simpleString()}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    return ordered.select("part", "ghost", "doc_id", "text").mapInArrow(tidy(lambda batches: _compare_batches(batches, to_arrow_type(kind))), schema)
