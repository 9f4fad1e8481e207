"""Queries over programs, agent documents and manifests that are built from the lines and words of the tables; the SQL works on the same texts."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from lodestack.operators import agents, clusters, references, yaml_docs
from lodestack.operators.rule_catalogue import CATALOGUE, EXAMPLES
from lodestack.operators.source_shell import command_findings, source_commands
from lodestack.operators.text_rules import RULES, scan
from lodestack.plans.registry import query

#: Every line of every document, numbered from 0; c: the second line of the document.
LINES = "ls AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS e, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS i, string_split(coalesce(text, ''), chr(10))[2] AS c FROM documents)"


def programs(inv, suffix: str, statements: list[str], head: str = ""):
    """One program per document: its k-th line stands in the k-th statement (they take turns) as E, escaped; I is its number."""
    quoted = lambda e: F.replace(F.replace(F.replace(e, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit("\r"), F.lit("\\r"))

    def statement(e, i):
        form = F.element_at(F.array(*map(F.lit, statements)), (i % len(statements) + 1).cast("int"))
        return F.replace(F.replace(form, F.lit("$I"), i.cast("string")), F.lit("$E"), F.replace(quoted(e), F.lit("`"), F.lit("\\`")) if suffix == ".js" else quoted(e))

    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), statement)
    return inv.table("documents").select(F.concat(F.lit("src/d"), F.col("doc_id").cast("string"), F.lit(suffix)).alias("path"), F.lit("source_code").alias("file_type"), F.concat(F.lit(head), F.array_join(lines, "\n")).alias("content"))


def _document(path="path"):
    return F.regexp_extract(path, r"(\d+)\.\w+$", 1).cast("long").alias("doc_id")


PYTHON = ['os.system("$E")', 'c$I = "$E"; subprocess.run(["bash", "-c", c$I])', 'subprocess.run(["curl", "$E"])', 'subprocess.check_call(f"pip install {c1}", shell=True)', 'run_command({"command": "$E"})']
SCRIPT = ['exec("$E");', 'const c$I = "$E"; execSync(c$I);', 'spawn("curl", ["-fsSL", "$E"]);', "a = /[\"'(]/g; /* exec(\"no\") */ execa(\"bash\", [\"-c\", \"$E\"]); // exec(\"no\")", "sendText(`$E`);"]


@query("txt_source_shell_py", f"""WITH {LINES} SELECT doc_id, CAST(i + 2 AS INTEGER) AS line_number,
CASE i % 5 WHEN 2 THEN 'curl ' || e WHEN 3 THEN 'pip install ' || coalesce(nullif(c, ''), '$c1') ELSE e END AS command, CASE i % 5 WHEN 2 THEN 'argv' ELSE 'literal' END AS origin
FROM ls WHERE e <> '' OR i % 5 = 3""", views=False)
def python_shell(inv):
    """The commands of Python programs whose calls hold the lines of the documents, by literals, names, argument lists and f-strings."""
    return source_commands(programs(inv, ".py", PYTHON, "import os, subprocess\n")).select(_document(), "line_number", "command", "origin")


@query("txt_source_shell_js", f"""WITH {LINES} SELECT doc_id, CAST(i + 1 AS INTEGER) AS line_number,
CASE WHEN i % 5 = 2 THEN 'curl -fsSL ' || e WHEN i % 5 = 3 AND e = '' THEN 'bash' ELSE e END AS command, CASE WHEN i % 5 = 2 OR i % 5 = 3 AND e <> '' THEN 'argv' ELSE 'literal' END AS origin
FROM ls WHERE e <> '' OR i % 5 IN (2, 3)""", views=False)
def javascript_shell(inv):
    """The commands of scripts whose calls hold the lines of the documents, beside comments and regular expressions that look like calls."""
    return source_commands(programs(inv, ".js", SCRIPT)).select(_document(), "line_number", "command", "origin")


@query("txt_source_shell_findings", f"""WITH {LINES} SELECT doc_id, CAST(i + 2 AS INTEGER) AS line_number, 'pip-install' AS rule, d AS dependency, 'medium' AS severity
FROM (SELECT *, regexp_extract('pip install ' || c, '\\bpip3?\\s+install\\s+(?:-\\S+\\s+)*([A-Za-z0-9._-]+)', 1) AS d FROM ls WHERE i % 5 = 3 AND c <> '') WHERE d <> ''""", views=False)
def shell_findings(inv):
    """What one text rule finds in the commands of the Python programs: packages named by a constant."""
    rule = [r for r in RULES if r.id == "pip-install"]
    found = command_findings(source_commands(programs(inv, ".py", [PYTHON[0].replace("$E", "x"), *PYTHON[1:2], *["pass"], PYTHON[3], "pass"], "import os, subprocess\n")).where(F.col("command").startswith("pip install ")), rule)
    return found.select(_document(), "line_number", "rule", "dependency", "severity")


#: The first three words of a document, and a skill that grants two of them and installs the third in a block behind the text.
WORDS = "ws AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[a-z]{3,}') AS w FROM documents), ts AS (SELECT doc_id, t, coalesce(w[1], 'one') AS a, coalesce(w[2], 'two') AS b, coalesce(w[3], 'three') AS c FROM ws)"
SKILL_SQL = "'---' || chr(10) || 'name: d' || doc_id || chr(10) || 'allowed-tools: Read, Bash(' || a || ':*), Bash(' || b || ')' || chr(10) || '---' || chr(10) || t || chr(10) || '```bash' || chr(10) || 'pip install ' || c || chr(10) || '```' || chr(10)"


def _words(inv):
    # the word behind n others, each taken whole and never given back
    word = lambda n, other: F.coalesce(F.nullif(F.regexp_extract("text", "(?s)^" + "(?>.*?[a-z]{3,}+)" * n + "(?>.*?([a-z]{3,}+))", 1), F.lit("")), F.lit(other))
    return inv.table("documents").select("doc_id", F.coalesce("text", F.lit("")).alias("t"), word(0, "one").alias("a"), word(1, "two").alias("b"), word(2, "three").alias("c"))


@query("txt_agent_instructions", f"""WITH {WORDS}, fs AS (SELECT *, {SKILL_SQL} AS f FROM ts),
tools AS (SELECT DISTINCT doc_id, f, unnest([a, b]) AS d FROM fs)
SELECT doc_id, CAST(length(left(f, strpos(f, d) - 1)) - length(replace(left(f, strpos(f, d) - 1), chr(10), '')) + 1 AS INTEGER) AS line_number, 'skill-tool-runner' AS rule, d AS dependency FROM tools
UNION ALL SELECT doc_id, CAST(len(string_split(t, chr(10))) + 6 AS INTEGER), 'pip-install', c FROM ts""", views=False)
def skills(inv):
    """Programs that the front matter of a skill grants, and packages that its fenced blocks install, with their lines."""
    n = F.lit("\n")
    content = F.concat(F.lit("---\nname: d"), F.col("doc_id").cast("string"), F.lit("\nallowed-tools: Read, Bash("), "a", F.lit(":*), Bash("), "b", F.lit(")\n---\n"), "t", F.lit("\n```bash\npip install "), "c", n, F.lit("```\n"))
    files = _words(inv).select(F.concat(F.lit("s"), F.col("doc_id").cast("string"), F.lit("/SKILL.md")).alias("path"), F.lit("agent_instruction").alias("file_type"), content.alias("content"))
    granted = agents.skill_findings(files).select("path", "line_number", "rule", "dependency")
    installed = agents.block_findings(files, [r for r in RULES if r.id == "pip-install"]).select("path", "line_number", "rule", "dependency")
    return granted.unionByName(installed).select(F.regexp_extract("path", r"^s(-?\d+)/", 1).cast("long").alias("doc_id"), "line_number", "rule", "dependency")


@query("txt_agent_plugins", f"""WITH {LINES} SELECT doc_id, CAST(i + 2 AS INTEGER) AS line_number,
['plugin-source-unpinned', 'plugin-source-url', 'plugin-source-moving-ref'][i % 4 + 1] AS rule, 'https://h.example/' || i || '/' || md5(e) AS dependency, ['critical', 'high', 'medium'][i % 4 + 1] AS severity
FROM ls WHERE i % 4 < 3""", views=False)
def plugins(inv):
    """Sources of plugin listings that name every line of a document: bare, pinned, pinned beside a moving name, and local."""
    entry = ['{"source":"https://h.example/$I/$E"}', '{"source":{"url":"https://h.example/$I/$E","sha":"$E","ref":"v1"}}', '{"deep":[{"source":{"ref":" Main ","url":"https://h.example/$I/$E","sha":"$E"}}]}', '{"source":"./plugins/$E"}']
    form = lambda e, i: F.replace(F.replace(F.element_at(F.array(*map(F.lit, entry)), (i % 4 + 1).cast("int")), F.lit("$I"), i.cast("string")), F.lit("$E"), F.md5(e.cast("binary")))
    lines = F.transform(F.split(F.coalesce("text", F.lit("")), "\n", -1), form)
    content = F.concat(F.lit('{"plugins":[\n'), F.array_join(lines, ",\n"), F.lit("\n]}"))
    files = inv.table("documents").select(F.concat(F.lit("d"), F.col("doc_id").cast("string"), F.lit("/marketplace.json")).alias("path"), F.lit("agent_plugin").alias("file_type"), content.alias("content"))
    found = agents.plugin_findings(agents.plugin_sources(files))
    return found.select(F.regexp_extract("path", r"^d(-?\d+)/", 1).cast("long").alias("doc_id"), "line_number", "rule", "dependency", "severity")


@query("src_k8s_manifests", """WITH ds AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) - 1 AS document, l_returnflag = 'A' AND l_linenumber = 1 AS failed FROM lineitem)
SELECT l_orderkey AS id, CAST(document AS INTEGER) AS document, CASE WHEN NOT failed THEN 'ns' || l_suppkey END AS namespace, CASE WHEN NOT failed THEN 'w' || l_partkey END AS name,
CASE WHEN NOT failed THEN 'r.example/' || lower(l_linestatus) || ':' || l_linenumber END AS image, CASE WHEN NOT failed THEN CAST(l_quantity AS INTEGER) END AS replicas, CASE WHEN NOT failed THEN l_returnflag END AS flag, failed FROM ds""", views=False)
def manifests(inv):
    """Workloads of YAML manifests: a file per order, a document per line of it with an anchor and nested lists, and documents that are cut off."""
    t = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))

    def document(x):
        good = t("apiVersion: apps/v1\nkind: Deployment\nmetadata: &m\n  name: w", x["l_partkey"], "\n  namespace: ns", x["l_suppkey"], "\n  labels: {flag: ", x["l_returnflag"], "}\nspec:\n  replicas: ", x["l_quantity"].cast("int"), "\n  template:\n    metadata: *m\n    spec:\n      containers:\n      - name: main  # the only one\n        args: [[a, b], [c]]\n        image: 'r.example/", F.lower(x["l_linestatus"]), ":", x["l_linenumber"], "'\n")
        return F.when((x["l_returnflag"] == "A") & (x["l_linenumber"] == 1), t("kind: [Deployment, ", x["l_partkey"], "\n")).otherwise(good)

    rows = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")))  # an order has a few lines
    files = inv.table("lineitem").groupBy("l_orderkey").agg(rows.alias("rows")).select(t("o", F.col("l_orderkey"), ".yaml").alias("path"), F.concat(F.lit("# order\n---\n"), F.array_join(F.transform("rows", document), "---\n")).alias("content"))
    found = yaml_docs.manifest_resources(files).withColumn("id", F.regexp_extract("path", r"(\d+)", 1).cast("long"))
    # one pass: documents that failed go along with the workloads
    rows = clusters.workloads(found.select("id", "document", "error", "doc"), error="error")
    own = lambda c: F.when(F.col("error").isNull(), F.col(c)).alias(c)
    return rows.select("id", "document", own("namespace"), own("name"), F.get("containers", F.lit(0))["image"].alias("image"), "replicas", F.try_element_at("labels", F.lit("flag")).alias("flag"), F.col("error").isNotNull().alias("failed"))


@query("txt_engine_references", f"""WITH {WORDS} SELECT doc_id, 'ci/run.sh' AS path, CAST(2 AS INTEGER) AS line_number, a AS dependency, false AS late FROM ts
UNION ALL SELECT doc_id, 'tools/t' || doc_id, CAST(len(string_split(t, chr(10))) + 1 AS INTEGER), b, true FROM ts WHERE doc_id % 3 <> 0""", views=False)
def late_references(inv):
    """Packages that scripts install, and those that files install which only the scripts name; a repository per document."""
    tool = F.concat(F.lit("tools/t"), F.col("doc_id").cast("string"))
    named = F.when(F.col("doc_id") % 3 != 0, tool).otherwise("tools/missing")
    first = F.struct(F.lit("ci/run.sh").alias("path"), F.concat(F.lit("bash ./"), named, F.lit(" && sh ../../outside\npip install "), "a").alias("content"))
    second = F.struct(tool.alias("path"), F.concat("t", F.lit("\npip install "), "b").alias("content"))
    files = _words(inv).select(F.col("doc_id").alias("repository"), F.inline(F.array(first, second))).withColumn("length", F.length("content").cast("long"))
    found = references.scan_repositories(files, [r for r in RULES if r.id == "pip-install"]).where("rule = 'pip-install'")
    return found.select(F.col("repository").cast("long").alias("doc_id"), "path", "line_number", "dependency", "late")


def _expected() -> list[tuple[str, str, str, str, str]]:
    """(rule, line, dependency, file type, severity) of the example of each rule."""
    out = []
    for r in CATALOGUE:
        e = EXAMPLES[r.id]
        whole = re.search(r.pattern, e.about("word")[0])[0]
        out.append((r.id, e.line, e.found, "text" if "*" in r.file_types else r.file_types[0], next((s for p, s in r.escalate if re.search(p, whole)), r.severity)))
    return out


_SQL_LIST = ", ".join("({})".format(", ".join("'" + x.replace("'", "''") + "'" for x in (e[0], e[2], e[4]))) for e in _expected())


@query("txt_rule_catalogue", f"""WITH {WORDS}, rs AS (SELECT row_number() OVER () - 1 AS k, * FROM (VALUES {_SQL_LIST}) AS v(rule, found, severity))
SELECT doc_id, CAST(len(string_split(t, chr(10))) + 1 AS INTEGER) AS line_number, rule, regexp_replace(found, '\\bW\\b', a, 'g') AS dependency, severity FROM ts JOIN rs ON k = doc_id % {len(CATALOGUE)}""", views=False)
def catalogue(inv):
    """All rules of the catalogue over all texts, each with one line about its first word behind it, of another rule for each document."""
    every = _expected()
    pick = lambda n: F.get(F.array(*(F.lit(e[n]) for e in every)), (F.col("doc_id") % len(every)).cast("int"))
    line = F.regexp_replace(pick(1), F.lit(r"\bW\b"), F.col("a"))
    files = _words(inv).select(F.concat(pick(0), F.lit("/"), F.col("doc_id").cast("string")).alias("path"), pick(3).alias("file_type"), F.concat("t", F.lit("\n"), line).alias("content"))
    found = scan(files, CATALOGUE, helpful=()).where(F.col("rule") == F.substring_index("path", "/", 1))
    return found.select(F.substring_index("path", "/", -1).cast("long").alias("doc_id"), "line_number", "rule", "dependency", "severity")
