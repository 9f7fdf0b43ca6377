"""Operator 9: token ids packed into fixed rows by best-fit decreasing, as binary files."""

from __future__ import annotations

import base64
import hashlib
import json
import math
import re
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from tabflow.llm.common import bounded_batches, committed, tidy, work_path

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the public pattern that splits text before this vocabulary's merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END = 50256
ROW = 2048
#: UTF-8 bytes of text that a packing shard holds, about, and at most; shards are packed each by itself, in one
#: task's memory, and grow with the input up to the most, so that files don't get too many.
SHARD_BYTES, MOST_SHARD_BYTES, SHARDS = 8 << 20, 48 << 20, 4096
#: Runs of white space from this length on are found here: the tokenizer's search for pieces fails on very long ones.
RUN = 2000
#: White space as the tokenizer's pattern has it.
_RUNS = re.compile(rf"[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{{{RUN},}}")
_ENCODINGS: dict[str, object] = {}


def encoding(path: str):
    """The tokenizer of a rank file, loaded once in a process."""
    if path not in _ENCODINGS:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        _ENCODINGS[path] = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _ENCODINGS[path]


def encode(text: str, path: str = TOKENIZER) -> np.ndarray:
    """The tokenizer's ids of the whole text; decoding them gives its bytes back.

    A run of white space begins a piece; the piece ends with the run at the end of the text,
    else before the run's last character, which may belong to the word that follows.
    """
    e = encoding(path)
    ids: list[int] = []
    done = 0
    for run in _RUNS.finditer(text):
        end = run.end() - (run.end() < len(text))
        ids += e.encode_ordinary(text[done : run.start()])
        ids += e._encode_single_piece(text[run.start() : end])
        done = end
    return np.array(ids + e.encode_ordinary(text[done:]), np.uint32)


class CapacityTree:
    """Open bins by the room they have left, in a segment tree over the possible capacities.

    A node is set if a capacity below it has a bin; the least capacity that suffices is
    found in one walk up and down.
    """

    def __init__(self, capacity: int):
        self.size = 1 << capacity.bit_length()
        self.full = bytearray(2 * self.size)
        self.bins: dict[int, list[int]] = {}

    def add(self, room: int, number: int) -> None:
        held = self.bins.setdefault(room, [])
        held.append(number)
        if len(held) == 1:
            i = self.size + room
            while i and not self.full[i]:
                self.full[i] = 1
                i >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """Remove and return (room, bin) with the smallest room of at least ``least``."""
        i = self.size + least
        if not self.full[i]:
            while i > 1 and (i & 1 or not self.full[i + 1]):
                i >>= 1
            if i <= 1:
                return None
            i += 1
            while i < self.size:
                i = 2 * i if self.full[2 * i] else 2 * i + 1
        room = i - self.size
        held = self.bins[room]
        number = held.pop()
        if not held:
            self.full[i] = 0
            i >>= 1
            while i and not (self.full[2 * i] or self.full[2 * i + 1]):
                self.full[i] = 0
                i >>= 1
        return room, number


def best_fit(lengths: Sequence[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: the items of each bin.  Lengths are at most ``capacity``; ties keep their order."""
    tree, bins = CapacityTree(capacity), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        found = tree.take(n)
        if found is None:
            room, number = capacity, len(bins)
            bins.append([])
        else:
            room, number = found
        bins[number].append(item)
        if room > n:
            tree.add(room - n, number)
    return bins


PACKED = "shard int, row long, n_tokens int, doc_ids array<{0}>, pieces array<int>, starts array<long>, cu_seqlens array<int>, resets array<int>, file string, sha256 string"


def pack(docs: DataFrame, root: str, path: str = TOKENIZER, row: int = ROW, end: int = END) -> DataFrame:
    """Tokenise, split, pack and write all documents; returns one row per packed row of ids.

    Each text's ids and one ``end`` id are cut into pieces of at most ``row`` ids, so nothing
    is lost; pieces are dealt evenly to shards, and each shard is packed by itself.  A shard
    is written to ``root`` as ``<shard>.ids`` (a matrix of little-endian unsigned ids of 2 or
    4 bytes, ``row`` wide, filled up with ``end``), ``<shard>.cu`` (int32 cumulative segment
    lengths from 0 of each row, one row after the other), ``<shard>.pos`` (of each row the
    number of places at which positions begin at 0 again, and the places, int32) and
    ``<shard>.json``, each under a temporary name first.  ``starts``: where a piece begins in its document's ids.  ``resets``: where
    positions begin again.  Null and empty texts have only the ``end`` id; an empty table
    gives no rows; a null doc_id stays null.
    """
    spark = docs.sparkSession
    bounded_batches(spark)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    total = docs.agg(F.sum(F.octet_length(text) + 4)).first()[0] or 0
    shards = max(1, math.ceil(total / min(MOST_SHARD_BYTES, max(SHARD_BYTES, total // SHARDS))))
    kind = np.dtype("<u2") if end < 1 << 16 else np.dtype("<u4")
    ids_of, named = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    schema = PACKED.format(ids_of)

    @tidy
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cols: list[list] = [[], [], [], [], []]
            size = 0

            def out(cols: list[list]) -> pa.RecordBatch:
                kinds = [pa.int64(), named, pa.int32(), pa.int64(), pa.binary()]
                return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=["rid", "doc_id", "piece", "start", "ids"])

            for rid, doc_id, t in zip(*[batch.column(c).to_pylist() for c in ("rid", "doc_id", "text")], strict=True):
                ids = np.append(encode(t, path), np.uint32(end))
                for piece, start in enumerate(range(0, len(ids), row)):
                    for c, v in zip(cols, (rid, doc_id, piece, start, ids[start : start + row].astype(kind).tobytes()), strict=True):
                        c.append(v)
                size += len(ids)
                if size > 1 << 20:
                    yield out(cols)
                    cols, size = [[], [], [], [], []], 0
            if cols[0]:
                yield out(cols)

    rows = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"))
    pieces = rows.mapInArrow(split, f"rid long, doc_id {ids_of}, piece int, start long, ids binary")
    shard = F.pmod(F.xxhash64("rid", "piece"), F.lit(shards)).cast("int")
    dealt = pieces.withColumn("shard", shard).repartitionById(shards, F.col("shard"))
    system, at = pafs.FileSystem.from_uri(root)
    system.create_dir(f"{at}/shards", recursive=True)

    def write(name: str, data: bytes) -> None:
        fs, base = pafs.FileSystem.from_uri(f"{root}/shards")
        context = TaskContext.get()
        temp = f"{base}/.{name}.{context.taskAttemptId() if context else 0}.tmp"
        with fs.open_output_stream(temp, compression=None) as f:
            f.write(data)
        committed(fs, temp, f"{base}/{name}")

    def finish(number: int, held: list[tuple]) -> pa.RecordBatch:
        held.sort(key=lambda p: (p[0], p[2]))
        lengths = [len(p[4]) // kind.itemsize for p in held]
        bins = best_fit(lengths, row)
        matrix = np.full((len(bins), row), end, kind)
        positions = np.zeros((len(bins), row), np.int32)
        cus = []
        for r, items in enumerate(bins):
            cu = np.concatenate([[0], np.cumsum([lengths[i] for i in items])]).astype(np.int32)
            for i, a, b in zip(items, cu[:-1], cu[1:], strict=True):
                matrix[r, a:b] = np.frombuffer(held[i][4], kind)
                positions[r, a:b] = np.arange(b - a)
            positions[r, cu[-1] :] = np.arange(row - cu[-1])
            cus.append(cu)
        name, data = f"{number:06d}", matrix.tobytes()
        write(f"{name}.ids", data)
        write(f"{name}.cu", np.concatenate(cus).astype("<i4").tobytes())
        write(f"{name}.pos", b"".join(zip_positions(positions)))
        digest = hashlib.sha256(data).hexdigest()
        facts = {"rows": len(bins), "row": row, "ids": kind.str, "cu": "<i4", "pos": "<i4 resets", "pad": end, "sha256": digest}
        write(f"{name}.json", json.dumps(facts, sort_keys=True).encode())
        cols = [
            pa.array([number] * len(bins), pa.int32()),
            pa.array(range(len(bins)), pa.int64()),
            pa.array([int(cu[-1]) for cu in cus], pa.int32()),
            pa.array([[held[i][1] for i in items] for items in bins], pa.list_(named)),
            pa.array([[held[i][2] for i in items] for items in bins], pa.list_(pa.int32())),
            pa.array([[held[i][3] for i in items] for items in bins], pa.list_(pa.int64())),
            pa.array(cus, pa.list_(pa.int32())),
            pa.array([np.flatnonzero(p[: cu[-1]] == 0).astype(np.int32) for p, cu in zip(positions, cus, strict=True)], pa.list_(pa.int32())),
            pa.array([f"{name}.ids"] * len(bins), pa.string()),
            pa.array([digest] * len(bins), pa.string()),
        ]
        return pa.RecordBatch.from_arrays(cols, names=[c.split()[0] for c in PACKED.split(", ")])

    @tidy
    def pack_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list[tuple]] = {}
        for batch in batches:
            for number, *piece in zip(*[batch.column(c).to_pylist() for c in ("shard", "rid", "doc_id", "piece", "start", "ids")], strict=True):
                held.setdefault(number, []).append(tuple(piece))
        for number in sorted(held):
            yield finish(number, held.pop(number))

    dealt.select("shard", "rid", "doc_id", "piece", "start", "ids").mapInArrow(pack_shard, schema).write.parquet(f"{root}/rows")
    return spark.read.schema(schema).parquet(f"{root}/rows")


def zip_positions(positions: np.ndarray) -> Iterator[bytes]:
    """For each row the number of places where positions begin again at 0, then these places (int32)."""
    for p in positions:
        resets = np.flatnonzero(p == 0).astype("<i4")
        yield np.array([len(resets)], "<i4").tobytes() + resets.tobytes()


def pack_documents(docs: DataFrame) -> DataFrame:
    """All documents packed with production parameters, files in the shared folder."""
    return pack(docs, work_path(docs.sparkSession, "packed"))
