"""The text-rule engine on lines with several matches."""

import json
import re

import pytest

from lodestack.operators import relational, rule_catalogue, text_rules
from lodestack.operators.text_rules import Rule, scan
from lodestack.plans.text import engine


class Documents:
    def __init__(self, df):
        self.df = df

    def table(self, name):
        return self.df


def test_all_matches_of_a_line(spark):
    line = "see https://a.example and https://b.example, mail x@c.example y@d.example"
    df = spark.createDataFrame([("p", "text", "none\n" + line)], "path string, file_type string, content string")
    got = sorted((r["rule"], r["line_number"], r["dependency"]) for r in scan(df).collect())
    assert got == [("link-host", 2, "a.example"), ("link-host", 2, "b.example"), ("mail-host", 2, "c.example"), ("mail-host", 2, "d.example")]
    first = [Rule("one", r"https?://([A-Za-z0-9.-]+)", 1, "c", "low")]
    assert [r["dependency"] for r in scan(df, first).collect()] == ["a.example"]


def test_engine_finds_every_secret_of_a_line(spark):
    df = spark.createDataFrame([(1, 'token = "abc" password = "def" secret = "abc"')], "doc_id long, text string")
    got = {r["dependency"]: r["matched"] for r in engine(Documents(df)).collect()}
    assert got == {"abc": 'token = "abc"', "def": 'password = "def"'}


def test_reports_of_bounded_size(spark):
    """A repository of many findings has several documents; together they hold each finding once, a file's in one document."""
    rows = [("r", f"f{k % 40}", k, "rule", "c", "high", f"d{k}") for k in range(300)] + [("s", "x", 1, "rule", "c", "low", "d")]
    found = spark.createDataFrame(rows, "repository string, path string, line_number int, rule string, category string, severity string, dependency string")
    docs = [(r["repository"], r["part"], json.loads(r["document"])["runs"][0]) for r in text_rules.sarif(found, "repository", most=50).collect()]
    assert sum(1 for r, _, _ in docs if r == "r") > 3 and all(len(d["results"]) < 300 for _, _, d in docs)
    held = [(r, p, x["locations"][0]["physicalLocation"]["artifactLocation"]["uri"], x["message"]["text"]) for r, p, d in docs for x in d["results"]]
    assert sorted((r, u, m) for r, _, u, m in held) == sorted((r[0], r[1], f"c: {r[6]}") for r in rows)
    assert len({(r, u) for r, _, u, _ in held}) == len({(r, p, u) for r, p, u, _ in held})


def test_heredocs_end_at_their_own_mark(spark):
    text = "cat <<A\nB\npip install x\n A done\ncat <<'B'\ny\nB\necho <<C\nz\ncat <<A >f\nkept\nA\ncat <<D\nq"
    rows = spark.createDataFrame([("p", "script", text)], "path string, file_type string, content string")
    got = text_rules.without_heredocs(rows).first()["content"].split("\n")
    assert got == ["cat <<A", "", "", " A done", "cat <<'B'", "", "B", "echo <<C", "z", "cat <<A >f", "kept", "A", "cat <<D", "q"]
    many = "cat <<E\n" * 20_000
    assert text_rules.without_heredocs(spark.createDataFrame([("p", "script", many)], rows.schema)).first()["content"] == many


def test_numbered_by_ranges(spark):
    names = [f"{p}{k}" for p in ("", "a", "ab", "abc", "é", "日本") for k in range(30)]
    got = relational.numbered(spark.createDataFrame([(g, n) for g in "xy" for n in names], "g string, n string"), ["g"], "n", "at")
    want = {n: k for k, n in enumerate(sorted(names, key=str.encode))}
    assert {(r["g"], r["n"]): r["at"] for r in got.collect()} == {(g, n): k for g in "xy" for n, k in want.items()}


@pytest.mark.parametrize("rule", rule_catalogue.CATALOGUE, ids=lambda r: r.id)
def test_examples_of_the_catalogue(rule):
    line, found, none = rule_catalogue.EXAMPLES[rule.id].about("word")
    m = re.search(rule.pattern, line)
    assert m and m[1] == found and not re.search(rule.pattern, none)
    assert any(h in line for h in rule.hints)


def test_catalogue_in_spark(spark):
    """Every example is found in a file of its rule's type, and no line without a name is."""
    rows = []
    for r in rule_catalogue.CATALOGUE:
        line, _, none = rule_catalogue.EXAMPLES[r.id].about("word")
        rows.append((r.id, "text" if "*" in r.file_types else r.file_types[0], f"x\n{line}\n{none}"))
    found = text_rules.scan(spark.createDataFrame(rows, "path string, file_type string, content string"), rule_catalogue.CATALOGUE, helpful=()).where("path = rule")
    got = {(r["rule"], r["line_number"], r["dependency"]) for r in found.collect()}
    assert got == {(r.id, 2, rule_catalogue.EXAMPLES[r.id].about("word")[1]) for r in rule_catalogue.CATALOGUE}
    assert len({r.id for r in [*rule_catalogue.CATALOGUE, *text_rules.RULES]}) == len(rule_catalogue.CATALOGUE) + len(text_rules.RULES)


def test_heredocs_go_to_python_in_bounded_batches(spark):
    """Batches were of up to 10,000 rows or 64 MB; long texts must come a few at a time."""
    import pyarrow as pa

    from lodestack.operators import batches

    text = "cat <<EOF\n" + "x" * (1 << 20) + "\nEOF\n"
    rows = spark.range(24).coalesce(1).selectExpr("cast(id as string) AS path", "'script' AS file_type", f"concat('cat <<EOF\n', repeat('x', {1 << 20}), '\nEOF\n') AS content")
    sizes = batches.arrow_rows(rows, lambda b: pa.RecordBatch.from_arrays([pa.array([b.num_rows])], names=["n"]), "n long").collect()
    assert sum(r["n"] for r in sizes) == 24 and max(r["n"] for r in sizes) <= 5
    done = text_rules.without_heredocs(rows)
    plan = done._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan
    assert {r["content"] for r in done.collect()} == {text.replace("x" * (1 << 20), "")}


def test_contents_are_made_once_for_all_hints(spark):
    """Tests for hints were moved in front of the content, which was made anew for each of them."""
    rows = spark.createDataFrame([("a", "script", "npm i -g zzz\npip install b"), ("b", "text", None)], "path string, file_type string, content string")
    made = rows.selectExpr("path", "file_type", "regexp_replace(content, 'zzz', 'y') AS content")
    found = scan(made, [r for r in text_rules.RULES if r.id in ("pip-install", "npm-global", "cargo-install", "system-package")])
    assert found._jdf.queryExecution().optimizedPlan().toString().count("zzz") == 1
    assert {(r["line_number"], r["dependency"]) for r in found.collect()} == {(1, "y"), (2, "b")}


def test_first_words_are_those_of_all_words(spark):
    from lodestack.plans.programs import _words

    class Tables:
        def __init__(self, df):
            self.df = df

        def table(self, name):
            return self.df

    texts = ["abc defg hij kl", "", None, "ab cd", "xabcX\nyyy", "aaaa", "Aabc9def", "a" * 5000 + " " + "b" * 5000, "один two\u0085three four"]
    got = {r["doc_id"]: (r["a"], r["b"], r["c"]) for r in _words(Tables(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))).collect()}
    for k, text in enumerate(texts):
        words = re.findall("[a-z]{3,}", text or "")[:3]
        assert got[k] == (*words, *("one", "two", "three")[len(words) :])


def test_the_policy_judges_every_document(spark, tmp_path):
    """Documents of odd ids were left out in front of the policy."""
    from lodestack import plans

    texts = [(2, "a"), (3, "b\nc"), (5, None), (10, "d"), (17, "e"), (21, "")]
    spark.createDataFrame(texts, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = plans.QUERIES["txt_policy"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == [(k, "info", "bash") for k in (2, 3, 5, 21)]
