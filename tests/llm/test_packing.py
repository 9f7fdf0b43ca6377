import json
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tabflow.llm import packing as M
from tabflow.llm.common import work_path

if not Path(M.TOKENIZER).is_file():
    pytest.skip("no tokenizer files", allow_module_level=True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60), st.integers(50, 64))
def test_best_fit_agrees_with_a_plain_search(lengths, capacity):
    bins = M.best_fit(lengths, capacity)
    assert sorted(i for b in bins for i in b) == list(range(len(lengths)))
    rooms = []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        fits = [r for r in rooms if r >= lengths[item]]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - lengths[item])
        else:
            rooms.append(capacity - lengths[item])
    assert sorted(capacity - sum(lengths[i] for i in b) for b in bins) == sorted(rooms)


@pytest.mark.parametrize(("row", "end"), [(64, 50256), (257, 70_000)])
def test_round_trip_through_the_files(spark, rows, docs, row, end, monkeypatch):
    monkeypatch.setattr(M, "SHARD_BYTES", 20_000)
    root = work_path(spark, "packed")
    got = M.pack(docs, root, row=row, end=end).collect()
    at = Path(root.removeprefix("file://")) / "shards"
    kind = "<u2" if end < 1 << 16 else "<u4"
    texts = {}
    for r in got:
        facts = json.loads((at / r.file.replace(".ids", ".json")).read_text())
        ids = np.fromfile(at / r.file, kind).reshape(facts["rows"], facts["row"])[r["row"]]
        assert facts["ids"] == kind and r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens <= row
        assert r.resets == r.cu_seqlens[:-1]
        assert (ids[r.n_tokens :] == end).all()
        for doc, start, a, b in zip(r.doc_ids, r.starts, r.cu_seqlens[:-1], r.cu_seqlens[1:], strict=True):
            texts.setdefault(doc, []).append((start, ids[a:b]))
    decode = M.encoding(M.TOKENIZER).decode
    want = {}
    for i, t, *_ in rows:
        want.setdefault(i, []).append(t or "")
    for doc, pieces in texts.items():
        ids = [int(x) for _, p in sorted(pieces, key=lambda p: p[0]) for x in p]
        if len(want[doc]) == 1:
            assert ids[-1] == end and decode(ids[:-1]) == want[doc][0]
    assert set(texts) == set(want)
    files = sorted(p.name for p in at.iterdir() if p.suffix != ".crc")
    assert not [f for f in files if f.endswith(".tmp")] and len(files) == 4 * len({r.shard for r in got}) > 8
    for name in {r.file.removesuffix(".ids") for r in got}:
        cu = np.fromfile(at / f"{name}.cu", "<i4")
        assert cu.tolist() == [c for r in sorted((r for r in got if r.file == f"{name}.ids"), key=lambda r: r["row"]) for c in r.cu_seqlens]
    again = M.pack(docs, work_path(spark, "packed"), row=row, end=end).collect()
    assert sorted((r.shard, r["row"], r.sha256) for r in again) == sorted((r.shard, r["row"], r.sha256) for r in got)


def test_rows_are_full(spark, sf):
    got = M.pack(spark.read.parquet(f"{sf}/documents.parquet"), work_path(spark, "packed")).collect()
    assert sum(r.n_tokens for r in got) / (len(got) * M.ROW) > 0.97


def test_odd_texts(spark, empty):
    assert M.pack(empty, work_path(spark, "packed")).count() == 0
    texts = [None, "", "x" * 30_000, " " * 9000, "\n" * 5000 + "é", "日本語" * 3000, "<|endoftext|>"]
    decode = M.encoding(M.TOKENIZER).decode
    for t in texts:
        assert decode([int(i) for i in M.encode(t or "")]) == (t or "")
    df = spark.createDataFrame([(None, None), (None, "a"), (1, "a"), (1, "a")], "doc_id long, text string")
    assert sorted(str(i) for r in M.pack(df, work_path(spark, "packed")).collect() for i in r.doc_ids) == ["1", "1", "None", "None"]


def test_ids_are_the_tokenizers(spark):
    """Texts with long runs have the ids that the tokenizer gives to the whole text."""
    plain = M.encoding(M.TOKENIZER).encode_ordinary
    prose = "A text of ordinary prose, with 12 numbers and words. " * 20
    for t in (prose + "x" * 2500 + prose, prose + " " * 2500 + "word" + prose, prose + "\n" * 2100, "日本語テキスト" * 700 + prose, prose + "=" * 3000):
        assert M.encode(t).tolist() == plain(t)


def test_ids_of_any_type(spark):
    got = M.pack(spark.createDataFrame([("a", "x y"), (None, "z")], "doc_id string, text string"), work_path(spark, "packed")).collect()
    assert sorted(str(i) for r in got for i in r.doc_ids) == ["None", "a"]
