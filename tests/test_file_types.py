"""Types of files: how often a plan tells them, and globs with several stars."""

import re

from pyspark.sql import functions as F

from lodestack.functions.scalars import glob_regex
from lodestack.operators import files


def test_several_stars_are_one():
    assert glob_regex("**/x.?s*") == r"^(?s:.*/x\..s.*)$"
    for glob in ("**/a*.**", "***", "[*]**[*]", "a.**b", r"\**c"):
        plain = re.sub(r"(?<!\[)\*+", "*", glob)
        assert glob_regex(glob) == glob_regex(plain)


def test_types_are_told_once(spark):
    rows = spark.createDataFrame([("a/Dockerfile", "x"), ("b/c/run.sh", "x"), ("zzz", "#!/bin/sh"), ("none", "x"), (None, "x"), ("Makefile", None)], "path string, content string")
    rows = rows.withColumn("length", F.length("content").cast("long")).withColumn("file_type", F.lit("old"))
    got = files.classified(rows)
    assert {(r["path"], r["file_type"]) for r in got.collect()} == {("a/Dockerfile", "dockerfile"), ("b/c/run.sh", "script"), ("zzz", "script"), ("Makefile", "build")}
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Pods") == 0 and len(re.findall(r"THEN iac", plan)) == 1
