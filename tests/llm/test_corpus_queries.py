"""The registered corpus queries and the pipeline, on the smallest tables."""
import pytest

from __spark_entry__ import oracle_sql, queries
from check_oracle import compare, connect
from corpus_pipeline import STAGES
from ptrack.llm.common import stored, table
from ptrack.llm.queries import ORACLE

NAMES = ["op1_vector_dedup", "op2_token_files", "op3_mix_sources", "op4_language_model", "op5_toxicity", "op6_licence_scan", "op7_secret_scan",
         "op8_shingle_join", "op9_best_fit_packing", "op10_simhash", "op11_centroid_clusters", "op12_rendezvous_shards", "op13_importance_resampling", "pipeline"]


def test_registered():
    assert set(NAMES) <= set(queries())
    assert set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_against_duckdb(spark, sf, name):
    assert compare(queries()[name](spark, sf).toPandas(), connect(sf).execute(ORACLE[name]).df()) == "ok"


def test_stages(spark, sf):
    docs = table(spark, sf, "documents")
    sizes = [docs.count()]
    for name, stage in STAGES[:-1]:
        out = stored(stage(spark, docs, sf), name)
        assert out.dtypes == docs.dtypes, name
        docs = out
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] == sizes[3] > sizes[4] > 0
    assert docs.where("text like '%token = %'").count() == 0
    packed = STAGES[-1][1](spark, docs, sf)
    assert {r.doc_id for r in packed.select("doc_id").distinct().collect()} == {r.doc_id for r in docs.select("doc_id").collect()}


def test_stages_on_nothing(spark, sf):
    docs = table(spark, sf, "documents").limit(0)
    for name, stage in STAGES:
        docs = stage(spark, docs, sf)
        assert docs.count() == 0, name
