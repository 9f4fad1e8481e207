"""Documents that steer coding agents: plugin listings and their sources, front matter of skills, and commands in fenced blocks."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.files import contained
from lodestack.operators.text_rules import Rule, scan
from lodestack.operators.yaml_docs import yaml_json

# Names of branches and channels that move; languages of blocks that hold commands.
MOVING = ("main", "master", "develop", "dev", "latest", "edge", "nightly", "canary", "next", "alpha", "beta")
SHELL_BLOCKS = ("", "bash", "sh", "shell", "zsh", "console")

_SOURCE = "path string, line_number int, source string, sha string, ref string"


def line_of(content: Column, token: Column) -> Column:
    """The line of a token's first place in a text; 1 if it isn't there."""
    at = F.position(token, content)
    before = F.substr(content, F.lit(1), at - 1)
    return F.when(at > 0, F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).otherwise(1)


def _sources(value) -> Iterator:
    """What stands under the key source, at any depth, outer ones first."""
    level = [value]
    while level:
        below = []
        for v in level:
            if isinstance(v, dict):
                if "source" in v:
                    yield v["source"]
                below += v.values()
            elif isinstance(v, list):
                below += v
        level = below


def _listed(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        rows = []
        for path, content in zip(frame["path"], frame["content"], strict=True):
            try:
                data = json.loads(content)
            except (ValueError, RecursionError):
                continue
            for s in _sources(data):
                url, sha, ref = (s.get("url"), s.get("sha"), s.get("ref")) if isinstance(s, dict) else (s, None, None)
                if isinstance(url, str):
                    at = content.find(json.dumps(url))
                    at = content.find(url) if at < 0 else at
                    rows.append((path, content.count("\n", 0, max(at, 0)) + 1, url, *(x if isinstance(x, str) else None for x in (sha, ref))))
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in _SOURCE.split(", ")])


def plugin_sources(files: DataFrame) -> DataFrame:
    """files: (path, file_type, content). One row per source of a plugin listing: path, line_number, source, sha, ref.

    Sources are what stands under the key source at any depth of agent_plugin files: a text, or an object with a url. Files
    that are no JSON give no rows.
    """
    return files.where((F.col("file_type") == "agent_plugin") & F.col("content").contains('"source"')).select("path", "content").mapInPandas(_listed, _SOURCE)


def plugin_findings(sources: DataFrame) -> DataFrame:
    """Remote sources by how they are pinned: path, line_number, rule, dependency, severity, each once. Local sources are no findings."""
    moving = F.coalesce(F.trim("ref").rlike(f"(?i)^(?:{'|'.join(MOVING)})$"), F.lit(False))
    pinned = F.coalesce(F.trim("sha") != "", F.lit(False))
    rule = F.when(~pinned, "plugin-source-unpinned").when(moving, "plugin-source-moving-ref").otherwise("plugin-source-url")
    severity = F.when(~pinned, "critical").when(moving, "medium").otherwise("high")
    remote = sources.where(F.col("source").rlike(r"(?i)^https?://"))
    return remote.select("path", "line_number", rule.alias("rule"), F.substring("source", 1, 200).alias("dependency"), severity.alias("severity")).distinct()


def plugin_files(sources: DataFrame, files: DataFrame) -> DataFrame:
    """The files that local sources bring in: listing, source, path. A source is a path from the repository's root; those that leave it are left out.

    Every file is looked up by each folder it lies in, so the join is one of equal keys.
    """
    local = sources.where(~F.col("source").rlike(r"(?i)^[a-z][a-z0-9+.-]*:")).select(F.col("path").alias("listing"), "source", contained(F.col("source")).alias("folder")).where("folder is not null").distinct()
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(0), F.size(parts)), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    return files.select("path", F.explode(folders).alias("folder")).join(local, "folder").select("listing", "source", "path")


def front_matter(content: Column) -> Column:
    """The YAML between the --- lines that a text starts with; null without."""
    found = F.regexp_extract(content, r"(?s)\A---\n(.*?)\n---", 1)
    return F.when(found != "", found)


def _strings(doc: Column, path: str) -> Column:
    """A text, or the texts of a list, at a path of a JSON document."""
    value = F.variant_get(F.parse_json(doc), path, "variant")
    kind = F.schema_of_variant(value)
    each = F.filter(F.transform(F.try_variant_get(value, "$", "array<variant>"), lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))), lambda s: s.isNotNull())
    return F.coalesce(F.when(kind == "STRING", F.array(F.try_variant_get(value, "$", "string"))).when(kind.startswith("ARRAY"), each), F.array().cast("array<string>"))


def skill_findings(files: DataFrame) -> DataFrame:
    """files: (path, file_type, content). What the front matter of SKILL.md files grants or installs: path, line_number, rule, category, severity, dependency, each once.

    Granted programs stand as Bash(program:...) in allowed-tools; metadata.openclaw names required and installed programs and a
    package. Front matter that can't be decoded, or is no mapping, gives no rows.
    """
    some = files.where((F.col("file_type") == "agent_instruction") & (F.element_at(F.split("path", "/"), -1) == "SKILL.md"))
    some = some.select("path", "content", front_matter(F.col("content")).alias("head")).where("head is not null")
    docs = some.withColumn("doc", yaml_json(F.col("head"))["json"]).where(F.col("doc").startswith("{"))
    tools = F.flatten(F.transform(_strings(F.col("doc"), '$["allowed-tools"]'), lambda t: F.regexp_extract_all(t, F.lit(r"\bBash\(([^:)\s]+)(?::[^)]*)?\)"), F.lit(1))))
    package = F.filter(F.transform(F.slice(_strings(F.col("doc"), "$.metadata.openclaw.install.package"), 1, 1), lambda p: F.trim(p)), lambda p: p != "")
    kinds = [
        ("skill-tool-runner", "agent_plugin", "medium", tools),
        ("skill-required-program", "agent_plugin", "medium", _strings(F.col("doc"), "$.metadata.openclaw.requires.bins")),
        ("skill-installed-package", "unmanaged_package", "high", package),
        ("skill-installed-program", "agent_plugin", "medium", _strings(F.col("doc"), "$.metadata.openclaw.install.bins")),
    ]
    made = lambda rule, category, severity: lambda d: F.struct(F.lit(rule).alias("rule"), F.lit(category).alias("category"), F.lit(severity).alias("severity"), d.alias("dependency"))
    hits = F.concat(*(F.transform(deps, made(rule, category, severity)) for rule, category, severity, deps in kinds))
    found = docs.select("path", "content", F.explode(hits).alias("h"))
    return found.select("path", line_of(F.col("content"), F.col("h.dependency")).cast("int").alias("line_number"), "h.rule", "h.category", "h.severity", F.substring("h.dependency", 1, 200).alias("dependency")).distinct()


_FENCE = re.compile(r"^ {0,3}(`{3,}|~{3,})[ \t]*([^\s`{]*)([^`]*)$")


def _blocks(text: str) -> Iterator[tuple[int, str, str]]:
    """(first line, language, body) of the fenced blocks; a block ends with a fence of its sign that is as long, or with the text."""
    lines, k = text.split("\n"), 0
    while k < len(lines):
        opened = _FENCE.match(lines[k])
        k += 1
        if opened:
            mark, start = opened[1], k
            while k < len(lines) and not ((m := _FENCE.match(lines[k])) and m[1][0] == mark[0] and len(m[1]) >= len(mark) and not m[2] and not m[3].strip()):
                k += 1
            yield start + 1, opened[2].lower(), "\n".join(lines[start:k])
            k += 1


def _fenced(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for frame in frames:
        yield pd.DataFrame([(p, *b) for p, c in zip(frame["path"], frame["content"], strict=True) for b in _blocks(c)], columns=["path", "first_line", "language", "body"])


def fenced_blocks(files: DataFrame) -> DataFrame:
    """files: (path, content). One row per fenced block: path, first_line (of its body), language (lower case, may be empty), body."""
    some = files.where(F.col("content").contains("```") | F.col("content").contains("~~~")).select("path", "content")
    return some.mapInPandas(_fenced, "path string, first_line int, language string, body string")


def block_findings(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """What the text rules find in the fenced blocks of commands of agent_instruction files; line_number is that of the file."""
    blocks = fenced_blocks(files.where("file_type = 'agent_instruction'")).where(F.col("language").isin(*SHELL_BLOCKS))
    body = F.regexp_replace("body", r"(?m)^[ \t]*\$ ", "")  # prompts
    at = F.concat(F.col("first_line").cast("string"), F.lit("\n"), "path")
    found = scan(blocks.select(at.alias("path"), F.lit("script").alias("file_type"), body.alias("content")), rules)
    line = F.substring_index("path", "\n", 1)
    return found.select(F.substr("path", F.length(line) + 2).alias("path"), (line.cast("int") + F.col("line_number") - 1).alias("line_number"), "rule", "category", "severity", "dependency")
