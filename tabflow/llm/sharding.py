"""Operator 10: shards along a Hilbert curve over quantised metadata (DataFrame functions only)."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tabflow.llm.common import finished, materialise

#: Rows that one (curve index, salt) cell holds on average at most, however many rows share the index.
ROWS_A_CELL = 50_000


def hilbert_index(point: Sequence[int], bits: int) -> int:
    """Position of a grid point on the Hilbert curve of ``len(point)`` dimensions with ``bits`` bits each.

    Skilling's transform (AIP Conf. Proc. 707, 381): undo the excess rotations from the
    highest bit down, Gray-decode, then interleave the bits.
    """
    x, n = list(point), len(point)
    q = 1 << (bits - 1)
    while q > 1:
        low = q - 1
        for i in range(n):
            if x[i] & q:
                x[0] ^= low
            else:
                t = (x[0] ^ x[i]) & low
                x[0] ^= t
                x[i] ^= t
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = 0, 1 << (bits - 1)
    while q > 1:
        if x[n - 1] & q:
            t ^= q - 1
        q >>= 1
    x = [v ^ t for v in x]
    index = 0
    for b in range(bits - 1, -1, -1):
        for v in x:
            index = index << 1 | (v >> b & 1)
    return index


def curve_table(dims: int, bits: int) -> list[int]:
    """The curve index of each grid cell, cells numbered with the first dimension highest."""
    if dims * bits > 15:
        raise ValueError("at most 15 bits of curve resolution")
    side = 1 << bits
    return [hilbert_index([cell // side ** (dims - 1 - d) % side for d in range(dims)], bits) for cell in range(side**dims)]


def quantile_bounds(df: DataFrame, name: str, bits: int) -> list:
    """At most ``2**bits - 1`` ascending values that cut the rows into about equal runs of the column's order.

    Numbers use ``approx_percentile``.  Strings are counted by value first, so only distinct
    values meet in the running sum.
    """
    parts = 1 << bits
    if not isinstance(df.schema[name].dataType, T.StringType):
        found = df.agg(F.percentile_approx(name, [i / parts for i in range(1, parts)], 10_000).alias("b")).first()["b"]
        return sorted(set(found or []))
    counted = df.where(F.col(name).isNotNull()).groupBy(F.col(name).alias("v")).agg(F.count(F.lit(1)).alias("n"))
    running = counted.select("v", (F.sum("n").over(Window.orderBy("v")) - F.col("n")).alias("before"), F.sum("n").over(Window.partitionBy()).alias("all"))
    cell = F.floor(F.col("before") * parts / F.col("all"))
    return sorted(r["b"] for r in running.groupBy(cell.alias("c")).agg(F.min("v").alias("b")).where("c > 0").collect())


def _at_most(value: Column) -> Callable[[Column], Column]:
    return lambda bound: bound <= value


def grid_cell(df: DataFrame, dims: Sequence[str], bits: int) -> Column:
    """The row's cell number: each dimension's count of bounds at or below the value; null is 0."""
    cell = F.lit(0)
    for name in dims:
        bounds = quantile_bounds(df, name, bits)
        if bounds:
            value = F.col(name)
            below = F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), _at_most(value)))
            cell = cell * (1 << bits) + F.when(F.col(name).isNull(), 0).otherwise(below)
        else:
            cell = cell * (1 << bits)
    return cell


def hilbert_order(df: DataFrame, dims: Sequence[str], ties: Sequence[str], bits: int = 4) -> DataFrame:
    """Add ``hilbert`` (curve index) and ``rank`` (gapless from 0 along the curve) to ``df``.

    ``ties`` break ties within an index; rows that tie there too are interchangeable.  No
    step orders all rows in one task: rows are counted by (index, salt), offsets are summed
    over salts within each index and over the at most ``2**(bits*len(dims))`` indexes, and
    row numbers are drawn within the cells, so an index that holds a third of the rows is
    spread over as many tasks as its size needs.  Null sorts first, an empty table gives an
    empty result, and columns named ``hilbert`` or ``rank`` are replaced.
    """
    table = F.array(*[F.lit(v) for v in curve_table(len(dims), bits)])
    salts = max(1, math.ceil(df.count() / ROWS_A_CELL))
    tie = F.xxhash64(*ties)
    df = df.drop("hilbert", "rank")
    placed = df.select(*df.columns, F.get(table, grid_cell(df, dims, bits)).alias("hilbert"), tie.alias("__tf_tie"), F.pmod(tie, F.lit(salts)).cast("int").alias("__tf_salt"))
    cells = placed.groupBy("hilbert", "__tf_salt").agg(F.count(F.lit(1)).alias("n"))
    in_index = Window.partitionBy("hilbert").orderBy("__tf_salt")
    salted = cells.select("hilbert", "__tf_salt", (F.sum("n").over(in_index) - F.col("n")).alias("within"))
    totals = cells.groupBy("hilbert").agg(F.sum("n").alias("n"))
    ahead = totals.select("hilbert", (F.sum("n").over(Window.orderBy("hilbert")) - F.col("n")).alias("ahead"))
    offsets = salted.join(ahead, "hilbert").select("hilbert", "__tf_salt", (F.col("within") + F.col("ahead")).alias("__tf_off"))
    order = Window.partitionBy("hilbert", "__tf_salt").orderBy("__tf_tie", *ties)
    return placed.join(offsets, ["hilbert", "__tf_salt"]).withColumn("rank", F.col("__tf_off") + F.row_number().over(order) - 1).drop("__tf_tie", "__tf_salt", "__tf_off")


def hilbert_shards(df: DataFrame, dims: Sequence[str], ties: Sequence[str], n_shards: int, bits: int = 4) -> DataFrame:
    """Cut the Hilbert order into ``n_shards`` runs whose row counts differ by one at most.

    Adds ``hilbert``, ``shard`` and ``slot`` (gapless from 0 within the shard).
    """
    total = df.count()
    ordered = hilbert_order(df, dims, ties, bits).drop("shard", "slot")
    shard = F.expr(f"(rank * {n_shards}L) div {max(1, total)}L").cast("int")
    start = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    return ordered.withColumn("shard", shard).withColumn("slot", F.col("rank") - start).drop("rank")


def write_shards(sharded: DataFrame, path: str, n_shards: int) -> None:
    """Write one folder per shard, rows in slot order, so that file statistics prune on every dimension."""
    sharded.repartition(n_shards, "shard").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)


@finished("shards")
def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """All documents to shards 0 to ``n_shards - 1`` by the law ``rows``.

    Dimensions are source, language and size.  The texts are read once; only ids, sizes and
    checksums move.  Null text: size 16 and the checksum of no bytes.
    """
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    narrow = materialise(docs.select("doc_id", "lang", "source", (F.octet_length(raw).cast("long") + 16).alias("size"), F.crc32(raw).alias("text_crc32")), "sharding_narrow")
    out = hilbert_shards(narrow, ["source", "lang", "size"], ["doc_id", "text_crc32", "size"], n_shards)
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")
