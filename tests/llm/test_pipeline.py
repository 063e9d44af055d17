"""The pipeline against its stages' rules, one after the other."""

from test_operators import brute_components, brute_items

import corpus_pipeline
from tallyforge.llm import pii, sp_codec, toxicity
from tallyforge.llm.queries import model_path

SF = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    scored = toxicity.toxicity(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r.doc_id: docs[r.doc_id] for r in scored.where("predicted = 0").collect()}
    left = {i: left[i] for i, (_, c) in brute_components(left.items()).items() if c == i}
    keep = {}
    for i, t in left.items():
        n, hit, _ = brute_items(t, items)
        if not (hit and 20 * hit >= n):
            keep[i] = pii.redact(t, pii.find(t))
    rows = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in rows.collect()} == {*keep}
    assert {r.doc_id: r.text for r in sp_codec.decoded(rows, model_path()).collect()} == keep
