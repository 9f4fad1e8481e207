"""Decoders on documents made by hand."""

import json
import uuid

from pyspark.sql import functions as F

from lodestack.functions.scalars import stable_id
from lodestack.operators import boms
from lodestack.operators.runs import run_states


def bom(spark, *docs):
    return boms.parsed(spark.createDataFrame([(k, d if isinstance(d, str) or d is None else json.dumps(d)) for k, d in enumerate(docs)], "k int, doc string"))


def test_components_fall_back(spark):
    full = {"bomFormat": "CycloneDX", "components": [{"name": "a", "version": "1", "purl": "pkg:npm/a@1", "cpe": ["", "cpe:x"], "supplier": "S", "licenses": ["MIT", {"license": {"name": "L"}}], "hashes": [{"alg": "h", "content": "1"}, {"alg": "h", "content": "2"}, {"alg": "", "content": "3"}], "properties": [{"name": "path", "value": ""}, {"name": "location", "value": "x"}, {"name": "location", "value": "y"}]}, {}]}
    rows = boms.components(bom(spark, full, {"document": full}, {"bomFormat": "other"}, "no json", None, {"bomFormat": "CycloneDX"})).collect()
    assert [r["k"] for r in rows] == [0, 0, 1, 1]
    a, b = rows[:2]
    assert (a["ref"], a["ecosystem"], a["package_manager"], a["cpe"], a["supplier"], a["license"], a["licenses"], a["evidence_path"]) == ("pkg:npm/a@1", "npm", "npm", "cpe:x", "S", "MIT", "MIT, L", "y")
    assert a["hashes"] == {"h": "2"} and (b["ref"], b["name"], b["version"], b["ecosystem"]) == ("component-1", "component-1", "", "")


def test_findings_per_reference(spark):
    doc = {"bomFormat": "CycloneDX", "vulnerabilities": [{"id": "V", "ratings": [{"severity": "NEGLIGIBLE"}], "affects": [{"ref": "a"}, {"ref": ""}, {"ref": "b"}]}, {"affects": []}]}
    rows = [tuple(r)[1:4] for r in boms.findings(bom(spark, doc)).collect()]
    assert rows == [("a", "low", "V"), ("b", "low", "V"), (None, "info", "Vulnerability")]


def test_advisories(spark):
    item = {"package": {"name": " p ", "ecosystem": "crates.io:x"}, "versions": [], "ranges": [{"events": [{"introduced": "0"}]}]}
    ended = item | {"ranges": [{"events": [{"introduced": "0"}, {"fixed": "2"}]}]}
    docs = [{"id": "A", "affected": [item, ended, {"package": {"name": ""}}]}, {"id": "B", "withdrawn": "2024", "affected": [item]}]
    rows = boms.advisory_specs(spark.createDataFrame([(json.dumps(d),) for d in docs] + [(None,)], "record string")).collect()
    assert [tuple(r) for r in rows] == [("A", "p", "cargo", [], True), ("A", "p", "cargo", [], False)]


def test_run_states(spark):
    logs = {"queued": "n", "running": "kc", "succeeded": "cxd", "canceled": "xcd"}
    names = {"c": "claim", "x": "cancel", "d": "complete", "n": "none", "k": "none"}
    rows = [(run, at, names[a]) for run, text in logs.items() for at, a in enumerate(text)]
    got = run_states(spark.createDataFrame(rows, "run string, at int, action string"), ["run"], "at").collect()
    assert {r["run"]: r["state"] for r in got} == {k: k for k in logs}


def test_stable_id_is_uuid5(spark):
    row = spark.range(1).select(stable_id("n", F.lit("a"), F.lit(None).cast("string"), F.lit("é")).alias("u")).first()
    assert row["u"] == str(uuid.uuid5(uuid.NAMESPACE_URL, "lodestack:n:a::é"))
