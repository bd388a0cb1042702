"""The pipeline's stages one by one, and all registered queries of the subpackage."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry_points
import corpus_pipeline
from sieveline.llm.queries import ORACLES, QUERIES
from sieveline.llm.samples import held_out
from sieveline.plans.check import duck, rows_of
from test_groups import brute_fingerprint, check_packing, near, union
from test_scans import brute_hits, brute_spans

pytestmark = pytest.mark.skipif(not Path("/root/testdata/sf0.001").exists(), reason="test tables not present")
SF_DIR = "/root/testdata/sf0.001"


def test_names():
    numbers = [f"op{n}_" for n in range(1, 11)]
    assert all(sum(q.startswith(n) for q in QUERIES) == 1 for n in numbers) and "pipeline" in QUERIES
    assert set(QUERIES) <= set(entry_points.queries()) and set(ORACLES) <= set(entry_points.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql_twin(spark, name):
    got, want = QUERIES[name](spark, SF_DIR).toPandas(), duck(SF_DIR).execute(ORACLES[name]).df()
    assert sorted(got.columns) == sorted(want.columns) and rows_of(got) == rows_of(want)


def test_stages_equal_brute_force(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    bench = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    stages = [f for _, f in corpus_pipeline.STAGES]
    rows = lambda df: {r.doc_id: r for r in df.collect()}
    before = rows(docs)
    first = stages[0](spark, docs, SF_DIR)
    after = rows(first)
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    right = [(k in after) == bool(q) for k, q in labels.items() if k in before]
    assert sum(right) >= 0.97 * len(right) and all(after[k] == before[k] for k in after)

    second = stages[1](spark, first, SF_DIR)
    ids = sorted(after)
    groups = union(near([brute_fingerprint(after[k].text) for k in ids]), range(len(ids)))
    want = {ids[g] for g in groups.values()}
    assert rows(second) == {k: after[k] for k in want}

    third = stages[2](spark, second, SF_DIR)
    hit = brute_hits([(k, after[k].text) for k in want], bench)
    clean = {k for (k, _), v in hit.items() if not v[4]}
    assert rows(third) == {k: after[k] for k in clean}

    fourth = stages[3](spark, third, SF_DIR)
    got = rows(fourth)
    assert set(got) == clean and fourth.columns == docs.columns and fourth.dtypes == docs.dtypes
    for k in clean:
        assert brute_spans(got[k].text) == "" and got[k].n_chars == len(got[k].text)
        assert got[k] == after[k] or brute_spans(after[k].text)

    pieces = stages[4](spark, fourth, SF_DIR).withColumn("ids", F.lit(b""))
    at = {}
    for p in pieces.collect():
        at.setdefault(p.doc_id, []).append((p.start, p.length, p.doc_tokens))
    assert set(at) == clean and all(sum(n for _, n, _ in v) == v[0][2] for v in at.values())
    assert corpus_pipeline.run(spark, SF_DIR).count() == pieces.count()


def test_stages_of_awkward_rows(spark, awkward, tmp_path):
    from pyspark.sql import Row

    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint"
    docs = spark.createDataFrame([(i, t, None, None, None) for i, t in awkward], schema)
    spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([Row(item_id=1, text="nothing of this"), Row(item_id=None, text=None)]).write.parquet(f"{tmp_path}/benchmark.parquet")
    for given in (docs, docs.limit(0)):
        out = given
        for _, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, out, str(tmp_path))
            assert out.columns == docs.columns
        assert (out.count() > 0) == (given is docs)
        packed = corpus_pipeline.STAGES[-1][1](spark, out, str(tmp_path))
        assert packed.select("doc_id").distinct().count() == out.select("doc_id").distinct().count()


def test_sequences_of_the_packing_query(spark):
    import public_tokenizers

    from sieveline.llm import pack

    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    pieces = pack.pack_texts(docs, public_tokenizers.path(corpus_pipeline.TOKENIZER)).collect()
    lengths = check_packing([(r.doc_id, r.text) for r in docs.collect()], pieces)
    assert sum(4096 - n for n in lengths if n & (n - 1)) == 0
    assert docs.where(held_out(F.col("doc_id"))).count() > 0
