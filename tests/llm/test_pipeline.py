from __future__ import annotations

import corpus_pipeline
from costurero.llm.common import stored, table

SF = "/root/testdata/sf0.001"


def test_stages_keep_the_columns_and_only_drop(spark):
    docs = table(spark, SF, "documents")
    columns, ids = docs.columns, {r.doc_id for r in docs.select("doc_id").collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stored(stage(spark, docs, SF))
        assert docs.columns == columns
        left = {r.doc_id for r in docs.select("doc_id").collect()}
        assert left <= ids and len(left) > 0.8 * len(ids), name
        ids = left
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == ids


def test_names_of_the_stages():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash_dedup", "decontamination", "packing"]
