
import pytest
from oracle import same
from pyspark.sql import functions as F

import corpus_pipeline as P
from tabflow.llm import queries as Q
from tabflow.llm.common import keyed, materialise


def test_stages_in_order():
    assert [n for n, _ in P.STAGES] == ["language_id", "near_dedup", "decontamination", "source_mix", "token_packing"]


@pytest.fixture(scope="module")
def folder(spark, sf, tmp_path_factory):

    at = tmp_path_factory.mktemp("sf")
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumn("extra", F.lit("x"))
    item = spark.read.parquet(f"{sf}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = spark.createDataFrame([(9001, None, "en", "src1", None, "x"), (9002, "", "en", None, 0, "x"), (9003, "1 2 3", None, "src1", 5, "x"), (9004, f"before it {item} and after it", "en", "src1", 1, "x")], docs.schema)
    docs.unionByName(odd).write.parquet(f"file://{at}/documents.parquet")
    spark.read.parquet(f"{sf}/benchmark.parquet").write.parquet(f"file://{at}/benchmark.parquet")
    return f"file://{at}"


def test_each_stage_against_brute_force(spark, folder):
    import test_decontam
    import test_minhash
    import test_mixing

    docs = spark.read.parquet(f"{folder}/documents.parquet")
    bench = spark.read.parquet(f"{folder}/benchmark.parquet")
    held = [(r.doc_id, r.text) for r in docs.collect()]
    for k, (name, stage) in enumerate(P.STAGES[:-1]):
        out = materialise(stage(spark, docs, folder), name)
        assert out.columns == docs.columns
        rows = out.collect()
        got = sorted(r.doc_id for r in rows)
        if k == 0:
            want = sorted(i for i, t in held if any(c.isalpha() for c in t or ""))
        elif k == 1:
            want = sorted(r[0] for r in test_minhash.brute(held, 80) if r[3])
        elif k == 2:
            want = sorted(r[0] for r in test_decontam.brute(held, [tuple(r) for r in bench.select("item_id", "text").collect()]) if not r[3])
        else:
            _, target = test_mixing.targets([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
            for s, n in target.items():
                assert abs(sum(test_mixing.size(r.text) for r in rows if r.source == s) - n) <= 1
            want = got
        assert got == want, name
        assert k < 2 or 9004 not in got  # it holds one whole item
        docs, held = out, [(r.doc_id, r.text) for r in rows]
    packed = P.STAGES[-1][1](spark, docs, folder)
    assert {i for r in packed.collect() for i in r.doc_ids} == {i for i, _ in held}


def test_run_is_the_stages(spark, folder):
    a, b = (sorted((r.shard, r["row"], r.sha256) for r in P.run(spark, folder).collect()) for _ in range(2))
    assert a == b and len(a) > 10


def test_row_names(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    a, b = ({(r.doc_id, r["__tf_key"]) for r in keyed(d).collect()} for d in (docs, docs.select("doc_id")))
    assert a == b and len({k for _, k in a}) == docs.count()
    twice = docs.unionByName(docs)
    assert len({r["__tf_key"] for r in keyed(twice).collect()}) == 2 * docs.count()


@pytest.mark.parametrize("name", sorted(Q.ORACLES))
def test_sql(spark, sf, name):
    same(Q.QUERIES[name](spark, sf), Q.ORACLES[name], sf)


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_query_runs(spark, sf, name):
    df = Q.QUERIES[name](spark, sf)
    assert df.count() > 0
    assert len(set(df.columns)) == len(df.columns)


