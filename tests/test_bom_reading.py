"""Wrapped documents, and how often a plan reads a text."""

import json

from lodestack.operators import boms, payloads


def test_a_document_is_read_once_for_itself_and_its_wrappers(spark):
    bom = {"bomFormat": "CycloneDX", "components": [{"name": "a"}, {"name": "b"}], "vulnerabilities": [{"id": "v", "affects": [{"ref": "x"}, {"ref": ""}, {"ref": "y"}]}, {"id": "w"}]}
    docs = [json.dumps(bom), json.dumps({"bom": "text", "document": bom}), json.dumps({"cyclonedx": {"bomFormat": "other"}, "sbom": bom}), json.dumps({"bomFormat": "CycloneDX"}), json.dumps({"x": bom}), "no", None, "[]"]
    parsed = boms.parsed(spark.createDataFrame(list(enumerate(docs)), "k int, doc string"))
    assert {(r["k"], r["n_components"], r["n_findings"]) for r in boms.counts(parsed).collect()} == {(0, 2, 3), (1, 2, 3), (2, 2, 3), (3, 0, 0)}
    assert boms.findings(parsed).count() == 9
    rows = boms.components(parsed)
    assert rows.count() == 6
    assert rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1 + 1  # the text, and the list in the column cpe


def test_a_batch_is_read_once(spark):
    docs = spark.createDataFrame([(1, '{"packages":[{"name":"p"}]}'), (2, None)], "k int, doc string")
    rows = payloads.endpoint_usages(payloads.batches(docs))
    assert rows.count() == 1 and rows._jdf.queryExecution().optimizedPlan().toString().count("from_json(") == 1
