import random
import zlib

import pytest

from tabflow.llm import sharding as M


@pytest.mark.parametrize(("dims", "bits"), [(2, 1), (2, 4), (3, 2), (3, 4), (1, 5)])
def test_the_curve_visits_neighbours(dims, bits):
    table = M.curve_table(dims, bits)
    assert sorted(table) == list(range(len(table)))
    at = {index: cell for cell, index in enumerate(table)}
    side = 1 << bits
    point = lambda c: [c // side**d % side for d in range(dims)]
    for i in range(len(table) - 1):
        assert sum(abs(a - b) for a, b in zip(point(at[i]), point(at[i + 1]), strict=True)) == 1


@pytest.mark.parametrize("cell", [3, 50_000])
def test_shards(rows, docs, cell, monkeypatch):
    monkeypatch.setattr(M, "ROWS_A_CELL", cell)
    got = M.shard_documents(docs).collect()
    text = {r[0]: r[1] for r in rows}
    assert len(got) == len(rows)
    counts = [sum(r["shard"] == s for r in got) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    for s in range(40):
        assert sorted(r.slot for r in got if r["shard"] == s) == list(range(counts[s]))
    for r in got:
        data = (text[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(data) + 16, zlib.crc32(data), "rows", None)
    # runs of the curve: indexes never fall along shards and slots
    line = [r.hilbert for r in sorted(got, key=lambda r: (r["shard"], r.slot))]
    assert line == sorted(line)
    assert sorted(map(tuple, M.shard_documents(docs.repartition(2)).collect()), key=str) == sorted(map(tuple, got), key=str)


def test_bounds_agree_with_counting(spark, rows, docs):
    bounds = M.quantile_bounds(docs, "source", 2)
    values = sorted(r[3] for r in rows if r[3] is not None)
    parts = {}
    for v in values:
        parts.setdefault(sum(b <= v for b in bounds), []).append(v)
    assert len(bounds) <= 3 and len(parts) == len(bounds) + 1
    want = {}
    for k, v in enumerate(values):
        before = values.index(v)
        want.setdefault(before * 4 // len(values), v)
        assert k >= 0
    assert bounds == sorted(v for c, v in want.items() if c > 0)


def test_one_hot_index(spark):
    df = spark.createDataFrame([(i, "same", "en", "s") for i in range(500)], "doc_id long, text string, lang string, source string")
    got = M.shard_documents(df).collect()
    assert {sum(r["shard"] == s for r in got) for s in range(40)} == {12, 13}


def test_small_tables(spark, empty):
    assert M.shard_documents(empty).count() == 0
    few = spark.createDataFrame([(None, None, None, None), (1, "a", "en", "s")], "doc_id long, text string, lang string, source string")
    assert sorted((r["size"], r.slot) for r in M.shard_documents(few).collect()) == [(16, 0), (17, 0)]


def test_written_shards_prune(spark, tmp_path):
    """A condition on any one of the dimensions leaves most files out by their statistics."""
    import pyarrow.parquet as pq

    rng = random.Random(4)
    rows = [(i, f"s{rng.randint(0, 15):02d}", f"l{rng.randint(0, 15):02d}", rng.randint(0, 10**6)) for i in range(8000)]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long")
    M.write_shards(M.hilbert_shards(df, ["source", "lang", "n_chars"], ["doc_id"], 64), f"file://{tmp_path}/s", 64)
    back = spark.read.parquet(f"file://{tmp_path}/s")
    assert sorted(r.doc_id for r in back.collect()) == list(range(8000))
    files = [pq.ParquetFile(p).metadata for p in (tmp_path / "s").rglob("*.parquet")]
    assert len(files) == 64

    def read(column, value):
        """Files whose statistics don't rule the value out."""
        kept = 0
        for f in files:
            at = f.schema.to_arrow_schema().get_field_index(column)
            spans = [f.row_group(g).column(at).statistics for g in range(f.num_row_groups)]
            kept += any(x.min <= value <= x.max for x in spans)
        return kept

    for column, values in (("source", ["s03", "s08", "s12"]), ("lang", ["l02", "l09", "l14"]), ("n_chars", [100_000, 480_000, 900_000])):
        assert sum(read(column, v) for v in values) / len(values) <= 32, column
