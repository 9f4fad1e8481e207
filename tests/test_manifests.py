"""Structured files: nulls, empty and malformed texts, repeated rows, empty tables; globs with classes."""

import fnmatch
import json

import pytest
from pyspark.sql import functions as F

from lodestack.functions.scalars import any_glob
from lodestack.operators import manifests

ODD = [("a", None), ("b", ""), ("c", "{"), ("d", "[]"), ("e", "null"), ("f", '{"packages":[1]}'), ("g", '{"packages":{"x":{"scripts":{"install":"i"}}}}'), ("g", '{"packages":{"x":{"scripts":{"install":"i"}}}}'), ("h", "packages:\n")]


def frame(spark, rows, schema="path string, content string"):
    return spark.createDataFrame(rows, schema)


def test_odd_lockfiles(spark):
    for read, n in ((manifests.npm_hooks, 2), (manifests.bun_hooks, 2), (manifests.pnpm_hooks, 0)):
        assert read(frame(spark, ODD)).count() == n
        assert read(frame(spark, [])).count() == 0


def test_odd_configurations(spark):
    deep = '{"a":' * 3000 + '{"mcpServers":{"s":{"url":"http://u"}}}' + "}" * 3000
    rows = [*ODD, ("x", '{"mcpServers":{"s":{"command":" "},"t":{"command":"npx","args":"no list"},"u":{"url":7},"v":"text"}}'), ("y", '{"mcpServers":{"s":{"url":"http://u"},"t":{"url":"http://u"}}}'), ("z", deep)]
    got = [tuple(r) for r in manifests.server_findings(frame(spark, rows)).collect()]
    assert [r for r in got if r[0] != "z"] == [("y", "server-remote-url", "http://u", "high")]
    assert manifests.server_findings(frame(spark, [])).count() == 0


@pytest.mark.parametrize(
    ("command", "args", "want"),
    [
        ("docker", ["run", "-it", "-v", "/a:/b", "--env=X", "--network", "host", "img:1"], ("server-image", "img:1", "high")),
        ("docker", ["run", "-p8080:80", "reg:5000/img"], ("server-image", "reg:5000/img", "critical")),
        ("docker", ["run", "img@sha256:ab"], ("server-image", "img@sha256:ab", "high")),
        ("docker", ["build", "."], ("server-command", "docker", "medium")),
        ("npm", ["exec", "--no-install", "x"], None),
        ("npm", ["x", "-y", "./local"], None),
        ("npm", ["exec", "-p", "q", "--", "r"], ("server-package", "q", "high")),
        ("npm", ["exec", "--", "r", "-p", "q"], ("server-package", "r", "high")),
        ("pnpm", ["dlx", "--cache", "c", "p@next"], ("server-package", "p@next", "critical")),
        ("uvx", ["--from=s", "t"], ("server-package", "s", "high")),
        ("NPX", ["-p", "other", "tool"], ("server-package", "tool", "high")),
        ("python3", ["x.py"], None),
    ],
)
def test_commands(command, args, want):
    found = list(manifests._server_findings("f.json", json.dumps({"mcpServers": {"s": {"command": command, "args": args}}})))
    assert found == ([want] if want else [])


def test_manifest_urls_of_fixtures_and_nulls(spark):
    formula = 'url "https://u"\n'
    rows = [("tests/fixtures/a.rb", formula), ("tests/a.rb", formula), ("fixtures/a.rb", formula), ("n", None), ("e", "")]
    files = frame(spark, rows).withColumn("file_type", F.lit("homebrew_formula"))
    assert sorted(r.path for r in manifests.manifest_urls(files).collect()) == ["fixtures/a.rb", "tests/a.rb"]
    broken = frame(spark, [("s", '{"url":"https://u"'), ("t", None)]).withColumn("file_type", F.lit("scoop_manifest"))
    assert manifests.manifest_urls(broken).count() == 0


def test_sniffs_are_never_null(spark):
    rows = frame(spark, ODD).select(manifests.bucket_manifest(F.col("content")).alias("m"), manifests.agent_document(F.col("path"), F.col("content")).alias("d"))
    assert all(r.m is False and r.d is False for r in rows.collect())


def test_second_look_without_findings(spark):
    files = frame(spark, [("a", None), ("b", None)]).withColumn("file_type", F.when(F.col("path") == "a", "ci").otherwise("html"))
    none = frame(spark, [], "path string, severity string, dependency string")
    assert [tuple(r) for r in manifests.second_look(files, none).collect()] == [("a", "unclassified")]
    unnamed = frame(spark, [("a", "low", None)], "path string, severity string, dependency string")
    assert manifests.second_look(files, unnamed).count() == 0


def test_globs(spark):
    values = ["abc", "bbc", "a-c", "a]c", "a^c", "a\\c", "a[c", "a.c", "ab\nc", "", "a&&c"]
    for pattern in ("[ab]bc", "[!a]*", "a[-x]c", "a[]x]c", "a[^x]c", "a[.\\]c", "a[&]*c", "a?c", "*", "[ab", "a[[]c", "[a-b]?c"):
        got = {r.v for r in spark.createDataFrame([(v,) for v in values], "v string").where(any_glob(F.col("v"), [pattern])).collect()}
        assert got == {v for v in values if fnmatch.fnmatchcase(v, pattern)}, pattern


@pytest.mark.parametrize("args, image", [(["--new-flag", "img"], "img"), (["--rm", "-it", "img"], "img"), (["--env", "A", "img"], "img"), (["--env=A", "img"], "img"), (["-e", "A", "img"], "img"), (["-eA", "img"], "img"), (["-c", "img"], "img"), (["--pull", "always", "img:1", "x"], "img:1"), (["--volume", "/a:/b", "./local"], None)])
def test_image_behind_options(args, image):
    assert manifests._image(["run", *args]) == image
