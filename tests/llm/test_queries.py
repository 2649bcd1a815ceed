"""The registered text queries on the smallest tables: columns, whole tables, SQL where there is some, and the pipeline."""

import os

import duckdb
import pytest

import corpus_pipeline
from acremark.llm import queries
from acremark.llm.common import stored

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")

COLUMNS = {
    "op1_imatch_fingerprints": "doc_id n_chars edited_sha256 fingerprint edited_fingerprint near_edited near_next",
    "op2_quality_neighbours": "doc_id held_out score predicted",
    "op3_histogram_sharding": "doc_id size text_crc32 law shard slot grown_shard",
    "op4_toxicity_machine": "doc_id held_out score predicted",
    "op5_language_kernel": "doc_id held_out lang_pred score",
    "op6_simhash_components": "doc_id fingerprint component_id",
    "op7_hierarchical_mixture": "doc_id domain lang source n_tokens copies",
    "op8_benchmark_passages": "doc_id n_words n_hit n_items items_sha256 contaminated",
    "op9_licence_notices": "doc_id notice coverage density first_word n_words passages",
    "op10_partial_matching": "doc_id held_out n_tokens n_known train_tokens base_score score",
    "op11_automaton_search": "item_id rank doc_id score",
    "op12_tiled_collocations": "lang rank phrase a l r n score",
    "op13_boosted_url_filter": "page_id host path rule verdict score",
}


def test_all_queries():
    assert set(queries.QUERIES) == set(COLUMNS)
    assert set(queries.ORACLE) <= set(queries.QUERIES)


@pytest.mark.parametrize("name", COLUMNS)
def test_query_gives_its_columns_for_all_documents(spark, name):
    frame = queries.QUERIES[name](spark, SF)
    assert set(COLUMNS[name].split()) <= set(frame.columns)
    rows = frame.collect()
    if name == "op13_boosted_url_filter":
        assert len(rows) == spark.read.parquet(f"{SF}/pages.parquet").count()
    elif name not in ("op7_hierarchical_mixture", "op9_licence_notices", "op11_automaton_search", "op12_tiled_collocations"):
        assert len(rows) == len({r.doc_id for r in rows}) == queries.documents(spark, SF).count()
    if name in queries.ORACLE:
        connection = duckdb.connect()
        for table in ("documents", "benchmark"):
            connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
        cursor = connection.execute(queries.ORACLE[name])
        given = [d[0] for d in cursor.description]
        want = sorted(repr(tuple(r[given.index(c)] for c in frame.columns)) for r in cursor.fetchall())
        assert sorted(repr(tuple(r)) for r in rows) == want


def test_pipeline_stages_take_effect(spark):
    docs = queries.documents(spark, SF)
    columns = docs.columns
    labels = {r.analysis_number: r.offensive for r in queries.labels(spark, SF).collect()}
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = stored(stage(spark, before, SF), name)
        if name != "sharding":
            assert docs.columns == columns
        assert docs.select(columns).exceptAll(before.select(columns)).count() == 0
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "toxicity":
            assert sum(labels.get(i) == 1 for i in ids) < sum(v == 1 for v in labels.values())
        if name == "near_duplicates":
            assert docs.select("text").distinct().count() == docs.count() == len(ids)
    assert docs.where("shard between 0 and 7").count() == docs.count() > 0


def test_pipeline_stages_take_odd_rows(spark):
    schema = "doc_id long, text string, lang string, source string, n_chars long, score string, shard string"
    rows = [(1, None, None, None, None, "a", "b"), (2, "", "pl", "src1", 0, None, None), (None, "meadow", "pl", None, 6, None, None),
            (3, "meadow by the road", "pl", "src1", 18, None, None), (3, "meadow by the road", "pl", "src1", 18, None, None)]
    for given in (rows, []):
        docs = spark.createDataFrame(given, schema)
        for _, stage in corpus_pipeline.STAGES[:-1]:
            got = stage(spark, docs, SF)
            assert got.columns == docs.columns
            got.collect()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() == len(given)
    kept = corpus_pipeline.drop_near_duplicates(spark, spark.createDataFrame(rows, schema), SF).collect()
    assert sorted(r.doc_id or 0 for r in kept) == [0, 1, 3]
