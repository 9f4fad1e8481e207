"""Evidence rules over text: a registry of regular expressions, applied per line or per file, with their file types.

A rule names a pattern, the group that holds the dependency, a category and a severity. All rules of a run become one
array expression over lines, so a text is split once and no row leaves the JVM; files and lines without any of the strings
that the rules name as hints are left out first. Rules may also be rows of a table (`rules_of`).
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestack.functions.scalars import any_glob, severity_rank
from lodestack.operators.batches import arrow_rows

#: Most rules that a table may hold; they become expressions of one plan.
MAX_RULES = 2_000
#: Rules of one pass over the texts; more would outgrow the code of one expression.
RULES_TOGETHER = 24


@dataclass(frozen=True)
class Rule:
    id: str
    pattern: str
    group: int
    category: str
    severity: str
    file_types: tuple[str, ...] = ("*",)
    multiple: bool = False  # all matches of a line, else the first
    multiline: bool = False  # over the whole content
    escalate: tuple[tuple[str, str], ...] = ()  # (pattern within the match, severity): the first that fits holds
    dependency: str = ""  # template of $0, $1, ... in place of the group
    hints: tuple[str, ...] = ()  # one of these stands in every match; lines without any are not tested


#: Evidence of undeclared dependencies, secrets and licences in prose, markup and scripts; own rules.
RULES = [
    Rule("assign-secret", r"(?i)\b(token|secret|password|api_key)\s*=\s*[\"']([^\"']+)[\"']", 2, "secret", "critical", hints=("=",)),
    Rule("licence-named", r"licensed under (?:the )?([^.\n]+)", 1, "licence", "low", hints=("licensed under",)),
    Rule("pipe-to-shell", r"(?:curl|wget)\s+[^|\n]*\|\s*(?:sudo\s+)?((?:ba|z)?sh)\b", 1, "script_installation", "high", escalate=((r"\bsudo\b", "critical"), (r"http://", "critical")), hints=("curl", "wget")),
    Rule("process-substitution", r"(?:ba|z)?sh\s+<\(\s*(?:curl|wget)\s+(?:-\S+\s+)*([^\s)]+)", 1, "script_installation", "critical", hints=("curl", "wget")),
    Rule("powershell-web", r"(?i)\b(?:iwr|irm|invoke-webrequest)\s+(?:-\S+\s+)*([^\s|]+)[^\n]*\|\s*(?:iex|invoke-expression)\b", 1, "script_installation", "critical", hints=("|",)),
    Rule("download-binary", r"\b(?:curl|wget)\s+(?:-\S+\s+)*(https?://\S+\.(?:tar\.gz|tgz|zip|deb|rpm|exe|dmg|pkg|jar|whl))\b", 1, "binary_download", "high", multiple=True, escalate=((r"http://", "critical"),), hints=("curl", "wget")),
    Rule("pip-install", r"\bpip3?\s+install\s+(?:-\S+\s+)*([A-Za-z0-9._-]+)", 1, "unmanaged_package", "medium", hints=("pip",)),
    Rule("pip-from-url", r"\bpip3?\s+install\s+(?:-\S+\s+)*((?:git\+)?https?://\S+)", 1, "unmanaged_package", "high", hints=("pip",)),
    Rule("npm-global", r"\bnpm\s+(?:install|i)\s+(?:-g|--global)\s+([@A-Za-z0-9/._-]+)", 1, "unmanaged_package", "medium", hints=("npm",)),
    Rule("npx-run", r"\bnpx\s+(?:-y\s+|--yes\s+)?([@A-Za-z0-9/._-]+(?:@[\w.-]+)?)", 1, "unmanaged_package", "medium", escalate=((r"@latest\b", "high"),), hints=("npx",)),
    Rule("go-install", r"\bgo\s+install\s+([\w./-]+@[\w.-]+)", 1, "unmanaged_package", "medium", hints=("go",)),
    Rule("cargo-install", r"\bcargo\s+install\s+(?:-\S+\s+)*([\w-]+)", 1, "unmanaged_package", "medium", hints=("cargo",)),
    Rule("gem-install", r"\bgem\s+install\s+([\w-]+)", 1, "unmanaged_package", "medium", hints=("gem",)),
    Rule("system-package", r"\b(?:apt-get|apt|yum|dnf|apk|brew)\s+(?:-\S+\s+)*(?:install|add)\s+(?:-\S+\s+)*([\w.+-]+)", 1, "unmanaged_package", "low", hints=("install", "add")),
    Rule("image-from", r"(?i)^\s*FROM\s+(\S+:\S+|\S+)", 1, "container_image", "medium", ("dockerfile",), escalate=((r":latest\b", "high"),), hints=("O", "o")),
    Rule("image-run", r"\bdocker\s+(?:run|pull)\s+(?:-\S+\s+)*([\w./-]+(?::[\w.-]+)?)", 1, "container_image", "medium", hints=("docker",)),
    Rule("workflow-action", r"\buses:\s*([\w.-]+/[\w.-]+@\S+)", 1, "cicd_tool", "medium", ("ci", "github_action"), escalate=((r"@(?:main|master)\b", "high"),), hints=("uses:",)),
    Rule("submodule", r"(?m)\[submodule\s+\"([^\"]+)\"\][^\[]*?url\s*=\s*(\S+)", 2, "git_submodule", "medium", ("gitmodules",), multiline=True),
    Rule("named-remote", r"(?s)Copyright[^\n]*\n[^\n]*All rights reserved", 0, "licence", "low", multiline=True),
    Rule("script-cdn", r"(?i)<script[^>]+src=[\"'](https?://[^\"']+)", 1, "cdn", "medium", multiple=True, hints=("<",)),
    Rule("link-host", r"https?://([A-Za-z0-9.-]+)", 1, "remote_reference", "low", multiple=True, hints=("://",)),
    Rule("mail-host", r"[A-Za-z0-9._%+-]+@([A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+)", 1, "remote_reference", "low", multiple=True, hints=("@",)),
]

# File types whose # lines are comments, whose backslash lines are joined, and whose printed heredocs are blanked.
HASH_COMMENTS = (
    "ci", "script", "build", "dockerfile", "iac", "k8s", "gitmodules", "pip_config", "precommit_config", "build_wrapper", "toolversions", "nix",
    "github_action", "npmrc", "pip_conf", "meson_wrap", "sbt_build", "rebar_config", "agent_instruction",
)
CONTINUED = ("script", "ci", "build", "dockerfile")
#: Categories whose matches inside printed help are no evidence.
HELPFUL = ("script_installation", "binary_download", "unmanaged_package")


def register_rule(rule: Rule, rules: list[Rule] | None = None) -> list[Rule]:
    """The rules with one more; a rule of the same id is replaced."""
    return [r for r in (RULES if rules is None else rules) if r.id != rule.id] + [rule]


def rules_of(table: DataFrame) -> list[Rule]:
    """Rules from rows (id, pattern, group, category, severity, file_types, multiple, multiline); at most MAX_RULES, else an error."""
    rows = table.orderBy("id").limit(MAX_RULES + 1).collect()
    if len(rows) > MAX_RULES:
        raise ValueError(f"more than {MAX_RULES} rules")
    for r in rows:
        re.compile(r["pattern"])
    return [Rule(r["id"], r["pattern"], r["group"], r["category"], r["severity"], tuple(r["file_types"] or ("*",)), bool(r["multiple"]), bool(r["multiline"])) for r in rows]


def applies(rule: Rule, file_type: Column) -> Column:
    """Whether a rule is for a file type; * is for all."""
    return F.lit(True) if "*" in rule.file_types else file_type.isin(*rule.file_types)


def joined_lines(content, file_type=None):
    """Lines that end in a backslash are joined with the next in shell-like types (all, without a type); numbers are those after joining."""
    joined = F.regexp_replace(content, r"\\\n", " ")
    return joined if file_type is None else F.when(file_type.isin(*CONTINUED), joined).otherwise(content)


def is_comment(line: Column, file_type: Column) -> Column:
    """Empty lines, # lines but for #!, rem and :: of scripts, <!-- of builds."""
    s = F.regexp_replace(line, r"^\s+|\s+$", "")
    return (s == "") | (file_type.isin(*HASH_COMMENTS) & s.rlike(r"^#(?!!)")) | ((file_type == "script") & s.rlike(r"(?i)^(?:rem(?:\s|$)|::)")) | ((file_type == "build") & s.startswith("<!--"))


def in_help(before: Column) -> Column:
    """Whether what stands before a match on its line opens a printed text that is not closed: echo, printf or print with a quote."""
    opened = before.rlike(r"""(?:\becho\b|\bprintf\b|\bprint\w*\s*\(|\b(?:die|usage|warn|info|log|error)\b)[^"']*(?:"[^"]*|'[^']*)$""")
    return opened & ~before.rlike(r"\|\s*$")


def is_placeholder_url(dependency: Column) -> Column:
    """Urls that stand for others: an ellipsis for a host, or a part in angle brackets."""
    return F.trim(dependency).rlike(r"(?i)^https?://(?:\.{3}(?:[/?#:]|$)|\S*<[^>\s]+>\S*)")


def _blanking():
    """The map of batches that blanks heredocs; it is made of inner functions alone, so that workers need not have this library."""
    first_word = re.compile(r"\s*([A-Za-z_]\w*)")
    begins = re.compile(r"^\s*(?:cat|echo|printf)(?:\s+-\w+)*\s*<<-?\s*['\"]?([A-Za-z_]\w*)['\"]?(.*)$")

    def blank(text: str | None) -> str | None:
        if text is None:
            return None
        lines, k = text.split("\n"), 0
        # where each first word stands, the last place first: an end mark is looked up, not searched
        ends: dict[str, list[int]] = {}
        for j in range(len(lines) - 1, -1, -1):
            if word := first_word.match(lines[j]):
                ends.setdefault(word[1], []).append(j)
        while k < len(lines):
            m = begins.match(lines[k])
            k += 1
            if m and not set(">|") & set(m[2]):
                at = ends.get(m[1], [])
                while at and at[-1] < k:
                    at.pop()
                if at:
                    lines[k : at[-1]] = [""] * (at[-1] - k)
                    k = at[-1] + 1
        return "\n".join(lines)

    def rows(batch: pa.RecordBatch) -> pa.RecordBatch:
        at = batch.schema.get_field_index("content")
        return batch.set_column(at, "content", pa.array((blank(x.as_py()) for x in batch.column(at)), pa.string()))

    return rows


def without_heredocs(files: DataFrame) -> DataFrame:
    """files with the bodies of heredocs that are only printed blanked, so lines keep their numbers; only such files go to Python, a few MB at a time."""
    has = F.coalesce(F.col("file_type").isin(*CONTINUED) & F.col("content").contains("<<"), F.lit(False))
    return files.where(~has).unionByName(arrow_rows(files.where(has), _blanking(), files.schema))


def _hit(k: int, r: Rule, whole: Column, dependency: Column) -> Column:
    severity = F.lit(r.severity)
    for pattern, s in reversed(r.escalate):
        severity = F.when(whole.rlike(pattern), F.lit(s)).otherwise(severity)
    if r.dependency:
        dependency = F.regexp_replace(whole, f"(?s)^.*?{r.pattern}.*$", r.dependency)
    return F.struct(F.lit(k).alias("rule_order"), F.lit(r.id).alias("rule"), F.lit(r.category).alias("category"), severity.alias("severity"), F.substring(whole, 1, 500).alias("matched"), F.substring(F.trim(dependency), 1, 200).alias("dependency"))


def _hinted(text: Column, rules: list[Rule], file_type: Column) -> Column:
    """Whether a text of a type may hold a match of these rules by their hints; a rule without hints leaves it open."""
    hints: dict[tuple[str, ...], dict[str, Rule]] = {}
    for r in rules:
        hints.setdefault(r.file_types, {}).update(dict.fromkeys(r.hints or ("",), r))
    # each type and each of its hints is tested once, however many rules share them
    each = (applies(next(iter(hs.values())), file_type) & reduce(Column.__or__, (F.contains(text, F.lit(h)) for h in hs)) for hs in hints.values())
    return reduce(Column.__or__, each, F.lit(False))


def scan(files: DataFrame, rules: list[Rule] | None = None, helpful: tuple[str, ...] = HELPFUL) -> DataFrame:
    """files: (path, file_type, content). One row per line and rule that matches: its first match, or each match (nth, from 0) of a rule with multiple.

    Comment lines of the file type are skipped, and matches inside printed help for the categories of helpful. matched is cut to 500
    characters, dependency trimmed and cut to 200. Rules with multiline are left to scan_whole. Null content gives no
    rows. Repeated files give repeated rows; `distinct_findings` keeps the first.
    """
    rules = [(k, r) for k, r in enumerate(RULES if rules is None else rules) if not r.multiline]
    parts = [_scan(files, rules[k : k + RULES_TOGETHER], helpful) for k in range(0, max(1, len(rules)), RULES_TOGETHER)]
    return reduce(DataFrame.unionByName, parts)


def _scan(files: DataFrame, rules: list[tuple[int, Rule]], helpful: tuple[str, ...]) -> DataFrame:
    kind, line = F.col("file_type"), F.col("line")
    # from a generator: the tests for hints are not moved in front of it, where each would make the whole content once more
    some = files.select("path", "file_type", F.explode(F.array(joined_lines(F.col("content"), kind))).alias("content")).where(F.col("content").isNotNull() & _hinted(F.col("content"), [r for _, r in rules], kind))
    lines = some.select("path", "file_type", F.posexplode(F.split("content", "\n", -1)).alias("at", "line")).where(_hinted(line, [r for _, r in rules], kind) & ~is_comment(line, kind))
    made, hits = lambda k, r: lambda whole, part: _hit(k, r, whole, part), []
    for k, r in rules:
        texts = lambda g, r=r: F.regexp_extract_all("line", F.lit(r.pattern), F.lit(g)) if r.multiple else F.array(F.regexp_extract("line", r.pattern, g))
        found = F.transform(F.zip_with(texts(0), texts(r.group), made(k, r)), lambda x, i: x.withField("nth", i))
        fits = applies(r, kind) & _hinted(line, [r], kind) & line.rlike(r.pattern)
        if r.category in helpful:
            fits &= ~in_help(F.split_part(line, F.regexp_extract("line", r.pattern, 0), F.lit(1)))
        hits.append(F.when(fits, found))
    found = lines.select("path", "file_type", (F.col("at") + 1).alias("line_number"), F.explode(F.flatten(F.array_compact(F.array(*hits)))).alias("hit"))
    return found.select("path", "file_type", "line_number", "hit.*")


def scan_whole(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """Every match of the rules with multiline over whole contents, with the lines where it begins and ends (null if that is the same)."""
    rules = [(k, r) for k, r in enumerate(RULES if rules is None else rules) if r.multiline]
    count = lambda c: F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    content, hits = joined_lines(F.col("content"), F.col("file_type")), []
    for k, r in rules:
        some = files.select("path", "file_type", content.alias("content")).where(applies(r, F.col("file_type")) & F.col("content").rlike(r.pattern))
        whole = F.regexp_extract_all("content", F.lit(r.pattern), F.lit(0))
        parts = F.arrays_zip(whole.alias("whole"), F.regexp_extract_all("content", F.lit(r.pattern), F.lit(r.group)).alias("part"), F.slice(F.split("content", r.pattern, -1), 1, F.size(whole)).alias("before"))
        rows = some.withColumn("file", F.xxhash64("path", "content")).select("path", "file_type", "file", F.posexplode(parts).alias("nth", "m"))
        before, own = count(F.col("m.before")), count(F.col("m.whole"))
        upto = Window.partitionBy("path", "file").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumn("first", (1 + F.sum(before + own).over(upto) - own).cast("int")).withColumn("last", (F.col("first") + own).cast("int"))
        hits.append(rows.select("path", "file_type", F.col("first").alias("line_number"), F.when(F.col("last") > F.col("first"), F.col("last")).alias("end_line"), _hit(k, r, F.col("m.whole"), F.col("m.part")).alias("hit"), "nth").select("path", "file_type", "line_number", "end_line", "hit.*", "nth"))
    out = hits[0]
    for h in hits[1:]:
        out = out.unionByName(h)
    return out


def distinct_findings(found: DataFrame) -> DataFrame:
    """One finding of each (path, line, rule, dependency)."""
    return found.groupBy("path", "line_number", "rule", "dependency").agg(F.min_by(F.struct("category", "severity", "matched"), F.struct("rule_order", "nth")).alias("f")).select("path", "line_number", "rule", "dependency", "f.*")


def with_policy(found: DataFrame, ignored: list[str] | None = None, severities: dict[str, str] | None = None, excluded: list[str] | None = None) -> DataFrame:
    """Findings after a policy: dependencies that a pattern ignores and paths under excluded globs go; severities by rule change."""
    ignored = checked_patterns(ignored or [])
    if ignored:
        found = found.where(~F.col("dependency").rlike("|".join(f"(?:{p})" for p in ignored)))
    if excluded:
        found = found.where(~any_glob(F.col("path"), excluded))
    severity = F.col("severity")
    for rule, s in (severities or {}).items():
        severity = F.when(F.col("rule") == rule, F.lit(s)).otherwise(severity)
    return found.withColumn("severity", severity)


def checked_patterns(patterns: list[str] | tuple[str, ...], most: int = 100, length: int = 512) -> list[str]:
    """The patterns, if they are within the bounds of a policy and compile; else an error."""
    if len(patterns) > most:
        raise ValueError(f"more than {most} patterns")
    for p in patterns:
        if not p or len(p) > length:
            raise ValueError(f"a pattern has 1 to {length} characters")
        re.compile(p)
    return list(patterns)


def ordered(found: DataFrame) -> DataFrame:
    """By severity, the worst first, then by path and line."""
    return found.orderBy(F.desc(severity_rank(F.col("severity"))), "path", "line_number", "rule", "dependency")


LEVELS = {"critical": "error", "high": "error", "medium": "warning", "low": "note", "info": "note"}


def sarif(found: DataFrame, key: str, tool: str = "lodestack", most: int = 10_000) -> DataFrame:
    """SARIF 2.1.0 documents of each key (a repository): key, part (from 0), document. A rule for each rule id (its first finding wins), and all results.

    A key of more than most findings has several documents, each with all rules and the findings of some of its files, so
    that none outgrows a row; a file's findings stay together.
    """
    level = F.lit("note")
    for severity, name in LEVELS.items():
        level = F.when(F.col("severity") == severity, F.lit(name)).otherwise(level)
    place = F.struct(F.struct(F.struct(F.col("path").alias("uri")).alias("artifactLocation"), F.struct(F.col("line_number").alias("startLine")).alias("region")).alias("physicalLocation"))
    message = F.struct(F.concat("category", F.lit(": "), "dependency").alias("text"))
    rows = found.select(key, "path", "line_number", "rule", "dependency", level.alias("level"), F.struct(F.col("rule").alias("ruleId"), level.alias("level"), message.alias("message"), F.array(place).alias("locations"), F.struct("category", "severity").alias("properties")).alias("result"), "category")
    sizes = rows.groupBy(key).agg(F.ceil(F.count(F.lit(1)) / most).alias("parts"))
    rows = rows.join(sizes, key).withColumn("part", F.pmod(F.xxhash64("path"), F.col("parts")).cast("int"))
    rules = rows.groupBy(key, "rule").agg(F.min_by(F.struct("category", "level"), F.struct("path", "line_number", "dependency")).alias("f"))
    rule = F.struct(F.col("rule").alias("id"), F.struct(F.col("f.category").alias("text")).alias("shortDescription"), F.struct(F.col("f.level").alias("level")).alias("defaultConfiguration"))
    rules = rules.groupBy(key).agg(F.array_sort(F.collect_list(rule)).alias("rules"))
    results = rows.groupBy(key, "part").agg(F.transform(F.array_sort(F.collect_list(F.struct("path", "line_number", "rule", "dependency", "result"))), lambda x: x["result"]).alias("results"))
    run = F.struct(F.struct(F.struct(F.lit(tool).alias("name"), "rules").alias("driver")).alias("tool"), "results")
    return results.join(rules, key).select(key, "part", F.to_json(F.struct(F.lit("2.1.0").alias("version"), F.array(run).alias("runs"))).alias("document"))


# Forms of credentials, masked whole; contexts whose value is masked.
CREDENTIALS = (
    r"AKIA[0-9A-Z]{16}",
    r"gh[pousr]_[A-Za-z0-9]{36,}",
    r"github_pat_[A-Za-z0-9_]{22,}",
    r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}",
    r"xox[baprs]-[A-Za-z0-9-]{10,}",
    r"(?:sk|rk)_live_[A-Za-z0-9]{16,}",
    r"AIza[0-9A-Za-z_\-]{35}",
    r"sk-(?:proj-)?[A-Za-z0-9_\-]{20,}",
    r"npm_[A-Za-z0-9]{36}",
    r"pypi-[A-Za-z0-9_\-]{16,}",
    r"-----BEGIN (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----[\s\S]*?-----END (?:RSA |EC |OPENSSH |DSA |PGP )?PRIVATE KEY-----",
)
MASK = "[REDACTED]"
CONTEXTS = (
    (r"(?i)(api[_-]?key|access[_-]?key|secret[_-]?key|client[_-]?secret|token|password|passwd|pwd|secret)\s*[=:]\s*['\"]?[A-Za-z0-9/+=_\-]{20,}['\"]?", "$1=" + MASK),
    (r"(?i)(mongodb|mongodb\+srv|postgres|postgresql|mysql|redis|amqp)://([^:\s/@]+):[^@\s/]+@", "$1://$2:" + MASK + "@"),
    (r"(?i)(\b(?:https?|git\+https?)://)[^/@\s]+@", "$1" + MASK + "@"),
    (r"(?i)(//\S+/:_authToken\s*=\s*)[^\s'\"]+", "$1" + MASK),
    (r"(?i)([?&](?:access[_-]?token|auth[_-]?token|api[_-]?key|client[_-]?secret|password|passwd|secret|signature|sig|token|x-amz-credential|x-amz-security-token|x-amz-signature)=)[^&#\s'\"<>]+", "$1" + MASK),
    (r"(?i)(\b(?:_authToken|access[_-]?token|auth[_-]?token|api[_-]?key|client[_-]?secret|password|passwd|secret|secret[_-]?access[_-]?key|token)\b\s*(?:=|:)\s*)(?:\"(?:\[REDACTED\]|[^\s,'\"}\]]+)\"|'(?:\[REDACTED\]|[^\s,'\"}\]]+)'|\[REDACTED\]|[^\s,'\"}\]]+)", "$1" + MASK),
    (r"(?i)(\bAuthorization\s*:\s*(?:Basic|Bearer)\s+)[^\s'\"]+", "$1" + MASK),
)


def redact(text: Column) -> Column:
    """Credentials of known forms, and values of secrets in assignments, urls, queries and headers, masked; masking again changes nothing."""
    for pattern in CREDENTIALS:
        text = F.regexp_replace(text, pattern, MASK)
    for pattern, kept in CONTEXTS:
        text = F.regexp_replace(text, pattern, kept)
    return text


def redact_all(df: DataFrame) -> DataFrame:
    """df with every text column masked, also inside structs, arrays and map values."""

    def masked(value: Column, kind) -> Column:
        name = kind.typeName()
        if name == "string":
            return redact(value)
        if name == "array":
            return F.transform(value, lambda x: masked(x, kind.elementType))
        if name == "map":
            return F.transform_values(value, lambda k, v: masked(v, kind.valueType))
        if name == "struct":
            return F.when(value.isNotNull(), F.struct(*(masked(value[f.name], f.dataType).alias(f.name) for f in kind.fields)))
        return value

    return df.select(*(masked(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))
