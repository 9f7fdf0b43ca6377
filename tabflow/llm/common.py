"""Helpers that several operators of this package share.

Conventions that all operators follow unless their docstring says otherwise:

* a null text counts as the empty text;
* repeated rows, also with equal ids, are separate rows and each gets its result;
* columns that an operator doesn't name are ignored or carried through untouched;
* intermediate results that are read more than once are written as Parquet in the
  cluster's shared folder (``spark.checkpoint.dir``), so a lost executor costs only
  the tasks that it ran and row ids drawn once stay the same.
"""

from __future__ import annotations

import ctypes
import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator, Sequence
from contextlib import contextmanager, suppress
from functools import wraps

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from py4j.java_gateway import JavaObject
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabflow.workers import importable

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = UPPER.lower()
#: What separates words: ASCII white space.
SPACES = r"[\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``; set only where unset."""
    at = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not at:
        at = "file://" + os.path.join(tempfile.gettempdir(), "checkpoints", f"tabflow-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", at)
    return at.rstrip("/")


def work_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/tabflow/{uuid.uuid4().hex}/{name}"


#: Bytes of an Arrow batch between the JVM and Python; both sides hold a batch or two.
BATCH_BYTES = 1 << 20


def bounded_batches(spark: SparkSession) -> None:
    """From now on, rows go to Python about a MB at a time, however long texts are.

    This lowers a session setting, which stays: plans are lazy and read it when they run.
    """
    importable(spark)
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key).removesuffix("b")
    if not before.isdigit() or int(before) > BATCH_BYTES:
        spark.conf.set(key, f"{BATCH_BYTES}b")


def cut_array(cuts: Sequence, kind: str) -> tuple[Column, Column] | None:
    """Ascending cuts as two literals: every 256th, and arrays of the 256 that begin at each; see ``cuts_below``."""
    if not cuts:
        return None
    parts = [cuts[i : i + CUTS] for i in range(0, len(cuts), CUTS)]
    first = F.from_json(F.lit(json.dumps([p[0] for p in parts])), f"array<{kind}>")
    return first, F.from_json(F.lit(json.dumps(parts)), f"array<array<{kind}>>")


CUTS = 256


def cuts_below(cuts: tuple[Column, Column] | None, value: Column, equal: bool) -> Column:
    """How many cuts are below the value (with ``equal``, or equal to it); looks at two short arrays, however many cuts there are."""
    if cuts is None:
        return F.lit(0)
    first, parts = cuts

    def below(cut: Column) -> Column:
        return cut <= value if equal else cut < value

    part = F.size(F.filter(first, below))
    return F.when(part == 0, 0).otherwise((part - 1) * CUTS + F.size(F.filter(F.get(parts, part - 1), below)))


#: Bytes of a row group of an intermediate table: what a writing or reading task holds of it.
ROW_GROUP = 16 << 20
#: Paths that each ``scratch`` is to delete, the innermost last.
_SCOPES: list[list[str]] = []


def _filed(spark: SparkSession, path: str) -> tuple[JavaObject, JavaObject]:
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Tables materialised within are deleted at the end; what is to last is written with ``keep=True``."""
    _SCOPES.append([])
    try:
        yield
    finally:
        for path in _SCOPES.pop():
            at, system = _filed(spark, path)
            system.delete(at, True)


def materialise(df: DataFrame, name: str, keep: bool = False, **options: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: lineage ends there and nothing is computed twice.

    The table goes with the innermost ``scratch``, kept ones with the next outer one, and what
    is in none when the driver ends.
    """
    spark = df.sparkSession
    path = work_path(spark, name)
    scopes = _SCOPES[:-1] if keep else _SCOPES
    if scopes:
        scopes[-1].append(path)
    else:
        at, system = _filed(spark, path)
        system.deleteOnExit(at)
    df.write.options(**{"parquet.block.size": ROW_GROUP} | options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def finished(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For an operator whose first argument is a table: its result is written, and the tables in between are deleted."""

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @wraps(operator)
        def run(df: DataFrame, *args: object, **named: object) -> DataFrame:
            with scratch(df.sparkSession):
                return materialise(operator(df, *args, **named), name, keep=True)

        return run

    return wrap


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed(docs: DataFrame, name: str = "__tf_key") -> DataFrame:
    """``docs`` with a column that names each row, the same whenever the plan runs again.

    Rows of Parquet files are named by file and place, so nothing is written; of another
    plan the rows are numbered once and written.
    """
    try:
        return docs.withColumn(name, F.concat(F.hex(F.xxhash64("_metadata.file_path")), F.lit(":"), F.col("_metadata.row_index").cast("string")))
    except AnalysisException:
        return materialise(docs.withColumn(name, F.monotonically_increasing_id().cast("string")), "keyed", keep=True)


#: Bits of the filters of hashed ids: so many at least, and at most, for about 16 bits an id between.
FILTER_BITS, MOST_FILTER_BITS = 20, 24


def filter_bits(n: int) -> int:
    return min(MOST_FILTER_BITS, max(FILTER_BITS, (16 * n).bit_length()))


def hashed_bits(ids: DataFrame, name: str, bits: int) -> DataFrame:
    """A bitmap of the hashes of ``ids.name``: words of 64 bits, ``2**bits`` bits in all, so its size has a bound (some MB)."""
    at = F.pmod(F.xxhash64(name), F.lit(1 << bits))
    marked = ids.select(at.alias("at")).select(F.shiftright("at", 6).alias("__tf_word"), _bit(F.col("at")).alias("bit"))
    return marked.groupBy("__tf_word").agg(F.bit_or("bit").alias("__tf_bits"))


def _bit(at: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), at.bitwiseAND(F.lit(63)).cast("int"))


def tested(df: DataFrame, ids: DataFrame, name: str) -> DataFrame:
    """``df`` with ``__tf_maybe``: false only if ``ids`` doesn't have the row's ``name``.  No row moves."""
    bits = filter_bits(ids.count())
    at = F.pmod(F.xxhash64(name), F.lit(1 << bits))
    tagged = df.withColumn("__tf_at", at).withColumn("__tf_word", F.shiftright("__tf_at", 6))
    joined = tagged.join(F.broadcast(hashed_bits(ids, name, bits)), "__tf_word", "left")
    maybe = F.coalesce(F.col("__tf_bits").bitwiseAND(_bit(F.col("__tf_at"))) != 0, F.lit(False))
    return joined.withColumn("__tf_maybe", maybe).drop("__tf_at", "__tf_word", "__tf_bits")


def without(df: DataFrame, gone: DataFrame, name: str) -> DataFrame:
    """The rows whose ``name`` isn't in ``gone``.  Only rows that may be in it are shuffled for the exact test."""
    marked = tested(df, gone, name)
    sure = marked.where(~F.col("__tf_maybe")).drop("__tf_maybe")
    open_ = marked.where("__tf_maybe").drop("__tf_maybe").join(gone.hint("merge"), name, "left_anti")
    return sure.unionByName(open_.select(*sure.columns))


def committed(system: pafs.FileSystem, temp: str, final: str) -> None:
    """Give a whole file its name.  A name that an earlier attempt of the task has given is given anew: equal rows make
    equal files, so either may stay, also where a store refuses to rename onto a file."""
    try:
        system.move(temp, final)
    except OSError:
        if system.get_file_info(final).type != pafs.FileType.File:
            raise
        system.delete_file(temp)


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z and nothing else; texts that are ASCII throughout take the faster ``lower``."""
    return F.when(F.octet_length(text) == F.char_length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def words(text: Column, separators: str = SPACES) -> Column:
    """What stands between the separators; an empty array for null.  Splitting is many times faster than matching words."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def tidy(work: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A function over Arrow batches that gives freed memory back to the system when a partition ends.

    Workers are kept between tasks, and what they keep counts against the executor.
    """

    @wraps(work)
    def run(batches: Iterator) -> Iterator:
        yield from work(batches)
        pa.default_memory_pool().release_unused()
        with suppress(OSError, AttributeError):
            ctypes.CDLL(None).malloc_trim(0)

    return run


# --- vectorised bytes: whole Arrow batches at a time ------------------------------------

_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BASE = 0x9E3779B97F4A7C15 | 1
_POWERS: dict[str, np.ndarray] = {}


def mix64(x: np.ndarray) -> np.ndarray:
    """A fixed bijection of 64-bit words whose outputs look random (the finaliser of splitmix64)."""
    x = x ^ (x >> np.uint64(30))
    x *= _MIX1
    x ^= x >> np.uint64(27)
    x *= _MIX2
    x ^= x >> np.uint64(31)
    return x


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, kept for the longest batch so far."""
    if len(_POWERS.get("p", ())) < n:
        m = max(n, 1 << 20)
        inverse = pow(_BASE, -1, 1 << 64)
        with np.errstate(over="ignore"):
            _POWERS["p"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, _BASE, np.uint64)]), dtype=np.uint64)
            _POWERS["q"] = np.cumprod(np.concatenate([[np.uint64(1)], np.full(m - 1, inverse, np.uint64)]), dtype=np.uint64)
    return _POWERS["p"], _POWERS["q"]


def text_bytes(texts: Iterable[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts in one array, and the offsets of the texts in it."""
    parts = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    offsets = np.zeros(len(parts) + 1, np.int64)
    np.cumsum([len(p) for p in parts], out=offsets[1:])
    return np.frombuffer(b"".join(parts), np.uint8), offsets


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return data + ((data >= 65) & (data <= 90)).astype(np.uint8) * np.uint8(32)


def word_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words between ASCII white space, and the first word of each text.

    Separators are single bytes in UTF-8, so bytes and code points give the same words.
    """
    n = len(data)
    inside = ~((data == 32) | ((data >= 9) & (data <= 13)))
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | first[:n]))
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | first[1:])) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span: equal bytes give equal hashes wherever they stand."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    p, q = _powers(len(data) + 1)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=total[1:])
        return mix64((total[ends] - total[starts]) * q[starts] + (ends - starts).astype(np.uint64))


def by_volume(texts: Sequence[str | None], limit: int) -> Iterable[slice]:
    """Runs of rows of about ``limit`` characters, at least one row each: bounds the memory of a step."""
    begin = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= limit:
            yield slice(begin, i + 1)
            begin, size = i + 1, 0
    if begin < len(texts):
        yield slice(begin, len(texts))
