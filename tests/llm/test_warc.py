import base64
import gzip
import hashlib
from pathlib import Path

import pytest

from tabflow.llm import warc as M
from tabflow.llm.common import work_path

PAGES = [(1, "http://a/x y", "<p>é</p>"), (2, None, "same"), (3, "http://b", "same"), (4, "http://b\r\nX: y", None), (5, "", ""), (6, "u", "same"), (7, "u", "long " * 4000)]


def local(root):
    return Path(root.removeprefix("file://"))


def brute(pages, least=0):
    out = []
    seen = {}
    for i, _, h in sorted(pages, key=lambda p: p[0]):
        data = (h or "").encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = seen.setdefault(digest, i)
        again = first != i and len(data) >= least
        out.append((i, len(data), digest, "revisit" if again else "response", first if again else None))
    return out


def result(df):
    return sorted(tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect())


@pytest.mark.parametrize("least", [0, 1, 100])
def test_round_trip(spark, least):
    df = spark.createDataFrame([(*p, "extra") for p in PAGES], "page_id long, url string, html string, digest string")
    assert result(M.archived_pages(df, least)) == brute(PAGES, least)


def test_files(spark, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 200)
    monkeypatch.setattr(M, "ROLL_BYTES", 1500)
    pages = [(i, f"http://h/{i}", f"<p>{i % 40} " + hashlib.md5(str(i % 40).encode()).hexdigest() * 20) for i in range(200)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    roots = [work_path(spark, "w") for _ in range(2)]
    manifests = [M.write_archives(x, r).orderBy("file").collect() for x, r in zip((df, df.repartition(7)), roots, strict=True)]
    assert manifests[0] == manifests[1]  # the same bytes from other partitions
    assert len(manifests[0]) > 20 and sum(r.records for r in manifests[0]) == 200
    assert len({r.shard for r in manifests[0]}) > 10
    at = local(roots[0]) / "archive"
    assert sorted(p.name for p in at.iterdir() if not p.name.endswith(".crc")) == [r.file for r in manifests[0]]
    for r in manifests[0]:
        data = (at / r.file).read_bytes()
        assert (len(data), hashlib.sha256(data).hexdigest()) == (r.bytes, r.sha256)
        assert gzip.decompress(data).startswith(b"WARC/1.1\r\nWARC-Type: warcinfo\r\n")
    back = M.read_archives(spark.createDataFrame(manifests[0], M.MANIFEST), roots[0])
    assert back.where("not intact").count() == 0
    assert result(back) == brute(pages)
    text = {r.page_id: bytes(r.payload).decode() for r in back.collect() if r.record_type == "response"}
    assert all(pages[i][2] == t for i, t in text.items())
    (at / manifests[0][0].file).write_bytes(gzip.compress(b""))
    with pytest.raises(Exception, match="isn't the file"):
        M.read_archives(spark.createDataFrame(manifests[0], M.MANIFEST), roots[0]).collect()


def test_ties_and_nulls(spark):
    pages = [(3, "b", "t"), (3, "a", "t"), (3, "a", "t"), (None, "n", "t"), (None, "n", "only"), (None, "m", "only")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    got = [tuple(r) for r in M.archived_pages(df).select("page_id", "record_type", "refers_to").collect()]
    assert sorted(got, key=str) == sorted([(3, "response", None), (3, "revisit", 3), (3, "revisit", 3), (None, "revisit", 3), (None, "response", None), (None, "revisit", None)], key=str)
    assert M.archived_pages(df.limit(0)).count() == 0


def test_files_roll_by_their_size(spark, monkeypatch):
    """A shard's file is closed by the record with which it reaches the size, and the next one begins."""
    monkeypatch.setattr(M, "ROLL_BYTES", 1500)
    pages = [(i, "u", hashlib.sha256(str(i).encode()).hexdigest() * 4) for i in range(60)]
    root = work_path(spark, "w")
    made = M.write_archives(spark.createDataFrame(pages, "page_id long, url string, html string"), root).orderBy("seq").collect()
    assert [r.seq for r in made] == list(range(len(made))) and len(made) > 5
    assert all(r.bytes >= 1500 for r in made[:-1]) and all(r.bytes < 1500 + 800 for r in made)
    assert result(M.read_archives(spark.createDataFrame(made, M.MANIFEST), root)) == brute(pages)


def test_very_long_payloads(spark):
    pages = [(1, "u", "<p>x</p>" * 2_000_000), (2, "u", "<p>x</p>" * 2_000_000), (3, "u", "short")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    assert result(M.archived_pages(df)) == brute(pages)


def test_a_name_that_an_earlier_attempt_gave(tmp_path):
    """Where a store refuses to rename onto a file, the file of the earlier attempt stays and the temporary one goes."""
    from pyarrow import fs

    from tabflow.llm.common import committed

    class Refusing:
        def __init__(self):
            self.own = fs.LocalFileSystem()

        def move(self, a, b):
            raise OSError("exists")

        def __getattr__(self, name):
            return getattr(self.own, name)

    (tmp_path / "t").write_text("new")
    with pytest.raises(OSError, match="exists"):
        committed(Refusing(), str(tmp_path / "t"), str(tmp_path / "f"))
    (tmp_path / "f").write_text("old")
    committed(Refusing(), str(tmp_path / "t"), str(tmp_path / "f"))
    assert not (tmp_path / "t").exists() and (tmp_path / "f").read_text() == "old"


def test_many_cuts(spark):
    from pyspark.sql import functions as F

    from tabflow.llm.common import cut_array, cuts_below

    cuts = list(range(0, 3000, 3))
    df = spark.range(-5, 3010)
    held = cut_array(cuts, "bigint")
    got = df.select("id", cuts_below(held, F.col("id"), True).alias("a"), cuts_below(held, F.col("id"), False).alias("b")).collect()
    assert all((r.a, r.b) == (sum(c <= r.id for c in cuts), sum(c < r.id for c in cuts)) for r in got)
    assert cut_array([], "bigint") is None and df.select(cuts_below(None, F.col("id"), True)).first()[0] == 0
