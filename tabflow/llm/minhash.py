"""Operator 2: near-duplicate documents by circulant MinHash, banding and exact Jaccard verification."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.llm.common import bounded_batches, by_volume, finished, keyed, lower_bytes, materialise, mix64, scratch, span_hashes, tested, text_bytes, tidy, without, word_spans

SHINGLE = 5
#: Links: PER_HUNDRED percent of the union at least, unless a caller says otherwise.
PER_HUNDRED = 85
#: 16 bands of 4 coordinates: a pair at the threshold shares no band with probability 7e-6, at 0.9 with 3e-8.
BANDS, ROWS = 16, 4
#: For links at 80 percent: a pair at 0.8 shares none of 24 bands with probability 3e-6.
LOOSE_PER_HUNDRED, LOOSE_BANDS = 80, 24
#: Buckets of the frequency sketch that orders shingles (it bears on speed alone).
SKETCH_BITS = 20
BATCH_CHARS = 1 << 18

_STEP = np.uint64(0x9E3779B97F4A7C15)
_SIGMA, _PI = np.uint64(0xD1B54A32D192ED03), np.uint64(0x8CB92BA72F3D8DD7)
_PLACES = mix64(np.arange(1, SHINGLE + 1, dtype=np.uint64) * _STEP) | np.uint64(1)


def shingle_sets(texts: list[str | None], size: int = SHINGLE) -> list[np.ndarray]:
    """The sorted distinct 64-bit shingle hashes of each text.

    A text with fewer words than ``size`` has one shingle, its whole sequence; one without
    words has none.
    """
    data, offsets = text_bytes(texts)
    data = lower_bytes(data)
    starts, ends, first = word_spans(data, offsets)
    hashes = span_hashes(data, starts, ends)
    with np.errstate(over="ignore"):
        n = max(0, len(hashes) - size + 1)
        rolled = np.zeros(n, np.uint64)
        for i in range(size):
            rolled += hashes[i : n + i] * _PLACES[i]
        rolled = mix64(rolled + np.uint64(size))
        out = []
        for a, b in zip(first[:-1], first[1:], strict=True):
            if b - a >= size:
                out.append(np.unique(rolled[a : b - size + 1]))
            elif b > a:
                out.append(mix64(np.array([np.sum(hashes[a:b] * _PLACES[: b - a], dtype=np.uint64)]) + np.uint64(b - a)))
            else:
                out.append(np.zeros(0, np.uint64))
    return out


def signatures(sets: list[np.ndarray], bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Circulant MinHash (C-MinHash): a row of ``bands`` band keys for each non-empty set.

    Two fixed permutations of the 64-bit universe do for all coordinates: the first shuffles
    the elements, and coordinate k is the least value of the second after the shuffled
    elements are shifted by k steps around the circle.
    """
    lengths = np.array([len(s) for s in sets])
    full = np.flatnonzero(lengths)
    keys = np.zeros((len(sets), bands), np.uint64)
    if not len(full):
        return keys
    with np.errstate(over="ignore"):
        values = mix64(np.concatenate([sets[i] for i in full]) ^ _SIGMA)
        begins = np.concatenate([[0], np.cumsum(lengths[full])[:-1]])
        for band in range(bands):
            key = np.full(len(full), np.uint64(band + 1))
            for row in range(rows):
                shift = np.uint64(band * rows + row + 1) * _STEP
                key = mix64(key * _STEP + np.minimum.reduceat(mix64((values + shift) ^ _PI), begins))
            keys[full, band] = key
    return keys


def _fold(values: np.ndarray, salt: int) -> np.uint64:
    with np.errstate(over="ignore"):
        return np.bitwise_xor.reduce(mix64(values + np.uint64(salt))) + np.uint64(len(values)) if len(values) else np.uint64(0)


def _signed(values: np.ndarray) -> np.ndarray:
    return np.asarray(values, np.uint64).view(np.int64)


def _sign_batches(batches: Iterator[pa.RecordBatch], bands: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column("text").to_pylist()
        for part in by_volume(texts, BATCH_CHARS):
            sets = shingle_sets(texts[part])
            keys = signatures(sets, bands)
            rows = batch.slice(part.start, part.stop - part.start)
            yield pa.RecordBatch.from_arrays(
                [
                    rows.column("rid"),
                    rows.column("doc_id"),
                    pa.array([len(s) for s in sets], pa.int64()),
                    pa.array(_signed([_fold(s, 1) for s in sets])),
                    pa.array(_signed([_fold(s, 2) for s in sets])),
                    pa.array(list(_signed(keys.ravel()).reshape(keys.shape)), pa.list_(pa.int64())),
                    pa.array([s.tobytes() for s in sets], pa.binary()),
                ],
                names=["rid", "doc_id", "n", "f1", "f2", "bands", "shingles"],
            )


def signed(docs: DataFrame, bands: int = BANDS) -> DataFrame:
    """rid, doc_id, set size, 128-bit set name, band keys and the full set of each document; written once."""
    bounded_batches(docs.sparkSession)
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.col("text").cast("string").alias("text"))
    schema = f"rid long, doc_id {kind}, n long, f1 long, f2 long, bands array<long>, shingles binary"
    return materialise(rows.mapInArrow(tidy(lambda batches: _sign_batches(batches, bands)), schema), "minhash")


def members_only(sets: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of ``sets`` whose gid is in ``ids``, and a few others, without moving any row: a later join drops those."""
    return tested(sets.select("gid", "n", "shingles"), ids, "gid").where("__tf_maybe").drop("__tf_maybe")


def _verify_batches(batches: Iterator[pa.RecordBatch], per_hundred: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        a, b = batch.column("sa").to_pylist(), batch.column("sb").to_pylist()
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(a, b, strict=True)):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            if len(x) > len(y):
                x, y = y, x
            at = np.minimum(np.searchsorted(y, x), len(y) - 1)
            both = int(np.count_nonzero(y[at] == x))
            keep[i] = 100 * both >= per_hundred * (len(x) + len(y) - both)
        yield batch.select(["a", "b"]).filter(pa.array(keep))


def verified(pairs: DataFrame, sets: DataFrame, per_hundred: int = PER_HUNDRED) -> DataFrame:
    """The pairs (a, b) whose full sets reach the threshold.  Only sets that are in a pair are moved."""
    sets = members_only(sets, pairs.select(F.explode(F.array("a", "b")).alias("gid")))
    left = sets.select(F.col("gid").alias("a"), F.col("shingles").alias("sa"), F.col("n").alias("na"))
    right = sets.select(F.col("gid").alias("b"), F.col("shingles").alias("sb"), F.col("n").alias("nb"))
    sized = (100 * F.least("na", "nb")) >= (per_hundred * F.greatest("na", "nb"))
    held = pairs.join(left, "a").join(right, "b").where(sized).select("a", "b", "sa", "sb")
    return held.mapInArrow(tidy(lambda batches: _verify_batches(batches, per_hundred)), "a long, b long")


def connected_components(edges: DataFrame, name: str = "components") -> DataFrame:
    """(node, comp) for each node of the edges (a, b): comp is the smallest node that it reaches.

    Large-star and small-star alternate until the edges stand still.  Each round is written
    to the shared folder; nothing but a count and a checksum comes to the driver.
    """
    edges = materialise(edges.where("a != b").select("a", "b").distinct(), name)
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(least, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e"))
        edges = materialise(small.select("e.a", "e.b").where("a != b").distinct(), name)
        now = edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("a", "b")), F.sum(F.pmod(F.xxhash64("b", "a"), F.lit(1 << 31)))).first()
        if now == state:
            break
        state = now
    return edges.select(F.col("a").alias("node"), F.col("b").alias("comp")).unionByName(edges.select(F.col("b").alias("node"), F.col("b").alias("comp")).distinct())


@tidy
def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts = np.zeros(1 << SKETCH_BITS, np.uint32)
    for batch in batches:
        for s in batch.column("shingles").to_pylist():
            np.add.at(counts, np.frombuffer(s, np.uint64) >> np.uint64(64 - SKETCH_BITS), 1)
    part = 1 << 14
    yield pa.RecordBatch.from_arrays(
        [pa.array(range(len(counts) // part), pa.int32()), pa.array([counts[i : i + part].tobytes() for i in range(0, len(counts), part)], pa.binary())], names=["part", "counts"]
    )


def _add_counts(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in table.column("counts").to_pylist())
    return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([np.minimum(total, 2**32 - 1).astype(np.uint32).tobytes()], pa.binary())})


def frequency_sketch(sets: DataFrame) -> np.ndarray:
    """How many sets hold a shingle, summed over ``2**SKETCH_BITS`` hash buckets: a few MB whatever the input."""
    parts = sets.select("shingles").mapInArrow(_sketch_batches, "part int, counts binary")
    rows = parts.groupBy("part").applyInArrow(_add_counts, "part int, counts binary").collect()
    return np.concatenate([np.frombuffer(r["counts"], np.uint32) for r in sorted(rows, key=lambda r: r["part"])]) if rows else np.zeros(1 << SKETCH_BITS, np.uint32)


def _overlap(n: Column, m: Column, per_hundred: int) -> Column:
    """The least number of common shingles of linked sets of these sizes."""
    return F.ceil(per_hundred * (n + m) / (100.0 + per_hundred) - 1e-9)


def prefix_candidates(sets: DataFrame, per_hundred: int = PER_HUNDRED) -> DataFrame:
    """Pairs (a, b) of sets (gid, comp, n, shingles) of different components that may be linked; no linked pair is lost.

    In an order of shingles from rare to frequent, linked sets share one among the first few
    of each: with sizes n >= m and a threshold t the larger need show n - ceil(t n) + 1
    shingles, the smaller m - ceil(2 t m / (1 + t)) + 1.  What follows the shared one must suffice for the
    overlap, which drops copies that differ in too many places although all share the rest.
    """
    sketch = sets.sparkSession.sparkContext.broadcast(frequency_sketch(sets))

    @tidy
    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list[np.ndarray]] = [[], [], [], [], []]
            for gid, comp, s in zip(batch.column("gid").to_pylist(), batch.column("comp").to_pylist(), batch.column("shingles").to_pylist(), strict=True):
                values = np.frombuffer(s, np.uint64)
                n = len(values)
                show = n - -(-per_hundred * n // 100) + 1
                frequency = sketch.value[values >> np.uint64(64 - SKETCH_BITS)]
                order = np.lexsort((values, frequency))[:show]
                for c, x in zip(cols, (np.full(show, gid), np.full(show, comp), np.full(show, n), _signed(values[order]), np.arange(show)), strict=True):
                    c.append(x)
            if cols[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c).astype(np.int64)) for c in cols], names=["gid", "comp", "n", "shingle", "pos"])

    shown = materialise(sets.select("gid", "comp", "shingles").mapInArrow(prefixes, "gid long, comp long, n long, shingle long, pos long"), "prefixes")
    larger, smaller = shown.alias("x"), shown.where(F.col("pos") <= F.col("n") - _overlap(F.col("n"), F.col("n"), per_hundred)).alias("y")
    x, y = (lambda c: F.col(f"x.{c}")), (lambda c: F.col(f"y.{c}"))
    rest = F.least(x("n") - x("pos"), y("n") - y("pos"))
    on = (x("shingle") == y("shingle")) & (x("comp") != y("comp")) & ((x("n") > y("n")) | ((x("n") == y("n")) & (x("gid") > y("gid"))))
    on = on & (100 * y("n") >= per_hundred * x("n")) & (rest >= _overlap(x("n"), y("n"), per_hundred))
    return larger.join(smaller, on).select(x("gid").alias("a"), y("gid").alias("b")).distinct()


def links(table: DataFrame, per_hundred: int = PER_HUNDRED) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of signed documents: the distinct sets (gid, f1, f2, n), and the links between them as stars and as found pairs.

    Equal sets are one node.  In each bucket of a band every node is held against the
    bucket's most central one (whose bands have the largest buckets), which is linear in the
    bucket and joins most of a group of copies.  Nodes whose buckets still hold several
    components then meet all others that could be linked to them, by ``prefix_candidates``.
    """
    full = table.where("n > 0")
    nodes = materialise(full.groupBy("f1", "f2", "n").agg(F.min("rid").alias("gid"), F.min("doc_id").alias("least_doc")), "nodes")
    own = materialise(full.join(nodes.select(F.col("gid").alias("rid")), "rid", "left_semi").select(F.col("rid").alias("gid"), F.posexplode("bands").alias("band", "key")), "bands")
    sizes = own.groupBy("band", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    buckets = materialise(own.join(sizes, ["band", "key"]), "buckets")
    central = buckets.groupBy("gid").agg(F.sum("size").alias("central"))
    hubs = buckets.join(central, "gid").groupBy("band", "key").agg(F.max(F.struct("central", -F.col("gid"))).alias("h")).select("band", "key", (-F.col("h")["col2"]).alias("hub"))
    pairs = materialise(buckets.join(hubs, ["band", "key"]).where("gid != hub").select(F.col("gid").alias("a"), F.col("hub").alias("b")).distinct(), "star_pairs")
    sets = full.select(F.col("rid").alias("gid"), "n", "shingles")
    stars = materialise(verified(pairs, sets, per_hundred), "stars")
    comps = connected_components(stars, "star_components")
    placed = buckets.join(comps.withColumnRenamed("node", "gid"), "gid", "left").select("band", "key", "gid", F.coalesce("comp", "gid").alias("comp"))
    mixed = placed.groupBy("band", "key").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo != hi").select("band", "key")
    open_ = materialise(placed.join(mixed, ["band", "key"], "left_semi").select("gid", "comp").distinct(), "open")
    near = materialise(prefix_candidates(members_only(sets, open_).join(open_, "gid"), per_hundred), "candidates")
    more = verified(near, sets, per_hundred)
    return nodes, stars, materialise(more, "pairs")


@finished("near_duplicates")
def near_duplicates(docs: DataFrame, per_hundred: int = PER_HUNDRED, bands: int = BANDS) -> DataFrame:
    """Per document: set size, smallest doc_id that it reaches by links, and whether that is its own.

    Documents are linked from ``per_hundred`` percent of the union of their shingles on;
    a lower threshold needs more ``bands``.

    Texts without words (null, empty, blank) are linked with nothing.  Repeated rows share a
    component.  A null doc_id is the smallest only where its component has no other.
    """
    table = signed(docs, bands)
    nodes, stars, more = links(table, per_hundred)
    comps = connected_components(stars.unionByName(more))
    placed = nodes.join(comps.withColumnRenamed("node", "gid"), "gid", "left").withColumn("comp", F.coalesce("comp", "gid"))
    least = placed.groupBy("comp").agg(F.min("least_doc").alias("component_id"))
    named = placed.join(least, "comp").select("f1", "f2", "n", "component_id")
    narrow = table.select("doc_id", "f1", "f2", "n")
    out = narrow.where("n > 0").join(named, ["f1", "f2", "n"]).select("doc_id", "n", "component_id")
    out = out.unionByName(narrow.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def kept_documents(docs: DataFrame, per_hundred: int = PER_HUNDRED, bands: int = BANDS) -> DataFrame:
    """One document of each group, a row of its smallest doc_id; all columns are kept.

    Rows are compared by doc_id first (null last) and by their own name then, so that of
    repeated rows one stays.
    """
    named = keyed(docs)
    whole = F.col("doc_id")
    if not isinstance(docs.schema["doc_id"].dataType, T.StringType):  # as text whose order is that of the numbers
        whole = F.lpad((whole.cast("decimal(20,0)") + F.lit(str(1 << 63)).cast("decimal(20,0)")).cast("string"), 20, "0")
    ordered = named.withColumn("__tf_key", F.concat(F.when(F.col("doc_id").isNull(), "1").otherwise("0"), F.coalesce(whole, F.lit("")), F.lit("\0"), F.col("__tf_key")))
    with scratch(docs.sparkSession):
        found = near_duplicates(ordered.select(F.col("__tf_key").alias("doc_id"), "text"), per_hundred, bands)
        dropped = materialise(found.where(~F.col("kept")).select(F.col("doc_id").alias("__tf_key")), "dropped", keep=True)
    return without(ordered, dropped, "__tf_key").select(*docs.columns)
