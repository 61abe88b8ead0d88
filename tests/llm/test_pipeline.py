"""The pipeline's stages on whole small tables, against what their operators say."""

import corpus_pipeline
from quillmark.llm import decontaminate, language, quality, simhash
from quillmark.llm.common import read_table, stash
from test_llm_operators import near_copy_groups

DATA = "/root/testdata/sf0.001"


def test_stages_keep_what_their_operators_keep(spark):
    docs = read_table(spark, DATA, "documents")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        ids = {r.doc_id for r in docs.select("doc_id").collect()}
        if name == "language_id":
            kept = {r.doc_id for r in language.identify_documents(docs).where("not rejected").collect()}
        elif name == "quality_rules":
            kept = {r.doc_id for r in quality.judge(docs, read_table(spark, DATA, "labels")).where("kept").collect()}
        elif name == "near_dedup":
            first = {r.component_id for r in simhash.near_duplicates(docs).collect()}
            kept = set(near_copy_groups([(r.doc_id, r.text) for r in docs.collect() if r.doc_id in first]).values())
        else:
            kept = {r.doc_id for r in decontaminate.leaks_by_document(docs, read_table(spark, DATA, "benchmark")).where("not contaminated").collect()}
        docs = stash(stage(spark, docs, DATA))
        assert docs.columns == columns and {r.doc_id for r in docs.select("doc_id").collect()} == kept <= ids and docs.count() == len(kept)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == kept


def test_empty_tables_pass_through(spark):
    docs = read_table(spark, DATA, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stash(stage(spark, docs, DATA))
        assert docs.count() == 0
