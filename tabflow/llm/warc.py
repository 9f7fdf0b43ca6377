"""Operator 8: a deterministic sharded WARC writer and its reader."""

from __future__ import annotations

import base64
import hashlib
import math
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabflow.llm.common import bounded_batches, committed, cut_array, cuts_below, materialise, scratch, tidy, work_path

#: Payload bytes of a shard, about, shards at most, and compressed bytes at which a file is closed and the next begun.
SHARD_BYTES, MOST_SHARDS, ROLL_BYTES = 8 << 20, 1 << 15, 4 << 20
LEVEL = 5
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
MANIFEST = "shard int, seq int, file string, records long, bytes long, sha256 string"
RECORD = "page_id {0}, url string, record_type string, payload_bytes long, payload_digest string, refers_to {0}, payload binary, file string, intact boolean"


def digest32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: object, digest: str, ordinal: int = 0) -> str:
    return f"<{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{ordinal}').urn}>"


def _clean(value: str) -> str:
    """A header value on one line: control characters, spaces and what isn't ASCII are percent-encoded."""
    return quote(value, safe="!#$%&'()*+,/:;=?@[]~-._|{}^`\"<>\\")


def warc_record(kind: str, headers: list[tuple[str, str]], block: bytes) -> bytes:
    lines = ["WARC/1.1", f"WARC-Type: {kind}", *[f"{k}: {v}" for k, v in headers], f"WARC-Block-Digest: sha1:{digest32(block)}", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def page_record(page_id: object, url: str | None, payload: bytes, refers_to: object, is_revisit: bool, ordinal: int) -> bytes:
    digest = digest32(payload)
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    headers = [("WARC-Record-ID", record_id(page_id, digest, ordinal)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        headers.append(("WARC-Target-URI", _clean(url)))
    if page_id is not None:
        headers.append(("X-Page-Id", _clean(str(page_id))))
    if not is_revisit:
        return warc_record("response", headers, head + payload)
    headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id(refers_to, digest))]
    if refers_to is not None:
        headers.append(("X-Refers-To-Page-Id", _clean(str(refers_to))))
    return warc_record("revisit", headers, head)


def _gzip(data: bytes) -> bytes:
    c = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)  # no time stamp: equal records give equal members
    return c.compress(data) + c.flush()


class _Roll:
    """Writes members to ``shard-seq.warc.gz`` files: each under a temporary name of this attempt, renamed when whole."""

    def __init__(self, root: str, shard: int, attempt: str, most: int):
        self.fs, self.root = pafs.FileSystem.from_uri(root)
        self.most = most
        self.shard, self.attempt, self.seq, self.out, self.done = shard, attempt, 0, None, []

    def add(self, data: bytes) -> None:
        if self.out is None:
            self.name = f"{self.shard:06d}-{self.seq:05d}.warc.gz"
            self.temp = f"{self.root}/.{self.name}.{self.attempt}.tmp"
            self.out, self.size, self.records, self.hash = self.fs.open_output_stream(self.temp, compression=None), 0, 0, hashlib.sha256()
            info = f"software: tabflow\r\nformat: WARC File Format 1.1\r\nisPartOf: shard {self.shard}\r\n".encode()
            head = [("WARC-Record-ID", record_id(self.name, "warcinfo")), ("WARC-Date", DATE), ("WARC-Filename", self.name), ("Content-Type", "application/warc-fields")]
            self._put(_gzip(warc_record("warcinfo", head, info)))
        self._put(_gzip(data))
        self.records += 1
        if self.size >= self.most:
            self.close()

    def _put(self, member: bytes) -> None:
        self.out.write(member)
        self.hash.update(member)
        self.size += len(member)

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            committed(self.fs, self.temp, f"{self.root}/{self.name}")
            self.done.append((self.shard, self.seq, self.name, self.records, self.size, self.hash.hexdigest()))
            self.seq, self.out = self.seq + 1, None


def write_archives(pages: DataFrame, root: str, min_revisit_bytes: int = 0) -> DataFrame:
    """Write each row (page_id, url, html) as a WARC record under ``root`` and return the manifest, which is written there too.

    Rows are dealt to shards by ranges of page_id and sorted within (then by url and html),
    so the same pages give the same files byte for byte, whatever task writes them.  Of
    equal payloads of at least ``min_revisit_bytes`` the row with the smallest page_id is
    the response (among repeated rows of that id the first) and all others revisit it.
    Payload: the html in UTF-8, null as empty.  A null page_id sorts first, and is a
    response only if no equal payload has an id.  The manifest is the commit: files that it
    doesn't name don't count.
    """
    spark = pages.sparkSession
    bounded_batches(spark)
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), payload.alias("payload"))
    facts = materialise(rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").cast("long").alias("size")), "warc_facts")
    total, count = facts.agg(F.sum("size"), F.count(F.lit(1))).first()
    most = ROLL_BYTES  # as it is here, for all tasks
    shards = max(1, min(count, MOST_SHARDS, math.ceil((total or 0) / SHARD_BYTES)))
    bounds = facts.agg(F.percentile_approx("page_id", [i / shards for i in range(1, shards)], max(10_000, 10 * shards)).alias("b")).first()["b"] if shards > 1 else []
    cuts = sorted(set(bounds or []))
    copies = facts.where(F.col("size") >= min_revisit_bytes).groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "first_id")
    # payloads move once: which rows revisit travels beside them as marks
    marks = facts.join(copies, "digest").where(~F.col("page_id").eqNullSafe(F.col("first_id"))).select("page_id", "digest", "first_id").distinct()
    held = cut_array(cuts, dict(pages.dtypes)["page_id"])
    shard = F.when(F.col("page_id").isNull(), 0).otherwise(cuts_below(held, F.col("page_id"), equal=True))
    none = F.lit(None)
    records = rows.select(shard.alias("shard"), "page_id", F.lit(1).alias("kind"), "url", "payload", none.cast("string").alias("digest"), none.cast(rows.schema["page_id"].dataType).alias("first_id"))
    marked = marks.select(shard.alias("shard"), "page_id", F.lit(0).alias("kind"), none.cast("string").alias("url"), none.cast("binary").alias("payload"), "digest", "first_id")
    dealt = records.unionByName(marked).repartitionById(len(cuts) + 1, F.col("shard")).sortWithinPartitions("shard", "page_id", "kind", "url", "payload")
    system, at = pafs.FileSystem.from_uri(root)
    system.create_dir(f"{at}/archive", recursive=True)

    @tidy
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        attempt = f"{context.stageId()}-{context.taskAttemptId()}" if context else "0"
        roll, last, seen, first = None, None, {}, {}
        done: list[tuple] = []
        for batch in batches:
            for r in batch.to_pylist():
                if roll is None or roll.shard != r["shard"]:
                    if roll is not None:
                        roll.close()
                        done += roll.done
                    roll = _Roll(f"{root}/archive", r["shard"], attempt, most)
                if (r["shard"], r["page_id"]) != last:
                    last, seen, first = (r["shard"], r["page_id"]), {}, {}
                if not r["kind"]:
                    first[r["digest"]] = r["first_id"]
                    continue
                digest = hashlib.sha1(r["payload"]).hexdigest()
                ordinal = seen.get(digest, 0)  # of rows with this id and payload
                seen[digest] = ordinal + 1
                again = ordinal > 0 and len(r["payload"]) >= min_revisit_bytes
                roll.add(page_record(r["page_id"], r["url"], r["payload"], first.get(digest, r["page_id"]), again or digest in first, ordinal))
        if roll is not None:
            roll.close()
            done += roll.done
        cols = list(zip(*done, strict=True)) if done else [[]] * 6
        kinds = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(cols, kinds, strict=True)], names=["shard", "seq", "file", "records", "bytes", "sha256"])

    dealt.mapInArrow(write, MANIFEST).write.parquet(f"{root}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{root}/manifest")


def members(data: Iterator[bytes]) -> Iterator[bytes]:
    """The gzip members of a stream of bytes, one after the other."""
    d, out = zlib.decompressobj(31), []
    for chunk in data:
        while chunk:
            out.append(d.decompress(chunk))
            chunk = d.unused_data if d.eof else b""
            if d.eof:
                yield b"".join(out)
                d, out = zlib.decompressobj(31), []


def parse_record(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and block of a record; ValueError if it isn't one."""
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8").split("\r\n")
    headers = dict(line.split(": ", 1) for line in lines[1:])
    if lines[0] != "WARC/1.1" or not {"WARC-Type", "Content-Length"} <= headers.keys():
        raise ValueError("not a WARC record")
    return headers, rest[: int(headers["Content-Length"])]


def read_archives(manifest: DataFrame, root: str, id_type: str = "long") -> DataFrame:
    """The page records of the files that the manifest names; ``intact`` says whether digests and the file's hash hold."""
    whole = id_type in ("long", "bigint", "int", "integer", "smallint")
    arrow = {"int": pa.int32(), "integer": pa.int32(), "smallint": pa.int16()}.get(id_type, pa.int64() if whole else pa.string())

    def ident(value: str | None) -> object:
        return int(value) if whole and value is not None else value

    @tidy
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = pafs.FileSystem.from_uri(f"{root}/archive")
        names = ["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to", "payload", "file", "intact"]
        kinds = [arrow, pa.string(), pa.string(), pa.int64(), pa.string(), arrow, pa.binary(), pa.string(), pa.bool_()]
        for batch in batches:
            for r in batch.to_pylist():
                with system.open_input_stream(f"{at}/{r['file']}", compression=None) as f:
                    seen, rows, size = hashlib.sha256(), [], 0

                    def chunks(f=f, seen=seen) -> Iterator[bytes]:
                        while chunk := f.read(1 << 20):
                            seen.update(chunk)
                            yield chunk

                    for member in members(chunks()):
                        try:
                            headers, block = parse_record(member)
                        except ValueError as e:
                            raise OSError(f"{r['file']} isn't the file that the manifest names: {e}") from e
                        if headers["WARC-Type"] == "warcinfo":
                            continue
                        http, _, payload = block.partition(b"\r\n\r\n")
                        length = int(http.rpartition(b"Content-Length: ")[2])
                        digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                        response = headers["WARC-Type"] == "response"
                        intact = headers["WARC-Block-Digest"] == f"sha1:{digest32(block)}" and (not response or (digest32(payload) == digest and len(payload) == length))
                        rows.append((ident(headers.get("X-Page-Id")), headers.get("WARC-Target-URI"), headers["WARC-Type"], length, digest, ident(headers.get("X-Refers-To-Page-Id")), payload if response else None, r["file"], intact))
                        size += len(payload)
                        if size >= 4 << 20:
                            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                            rows, size = [], 0
                    if seen.hexdigest() != r["sha256"]:
                        raise OSError(f"{r['file']} isn't the file that the manifest names")
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    files = max(1, manifest.count())
    return manifest.select("file", "sha256").repartition(files).mapInArrow(read, RECORD.format(id_type if whole else "string"))


def archived_pages(pages: DataFrame, min_revisit_bytes: int = 0) -> DataFrame:
    """Write all pages as archives in the shared folder, read them back, and return a row per page."""
    spark = pages.sparkSession
    root = work_path(spark, "warc")
    manifest = write_archives(pages, root, min_revisit_bytes)
    records = read_archives(manifest, root, dict(pages.dtypes)["page_id"].replace("bigint", "long"))
    return records.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
