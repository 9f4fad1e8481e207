"""Lockfiles, tool-server configurations and package manifests: structured files to findings.

files has the columns path and content (text); the results are rows of path and what was found. Spark's JSON and regular
expressions do all but the walk through objects at any depth of a configuration, a small helper over Arrow batches.
Null, empty or malformed contents give no rows; repeated paths are told apart by nothing and give their rows each.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Scripts that a package manager runs at install, launchers of packages, plain interpreters, moving labels.
HOOKS = ("postinstall", "preinstall", "install", "prepare", "prepublish", "prepublishOnly", "postpack", "prepack")
RUNNERS = ("npx", "pnpx", "uvx", "bunx", "pnpm", "dnx")
INTERPRETERS = ("sh", "bash", "zsh", "python", "python3", "node", "deno")
MOVING = ("latest", "alpha", "beta", "next", "canary", "nightly", "edge")
# Keys of a download in a bucket manifest; words that leave a finding open; types worth a second look.
DOWNLOAD_KEYS = ("hash", "bin", "shortcuts", "extract_dir", "extract_to", "installer", "pre_install", "post_install")
OPEN_WORDS = ("curl", "wget", "install", "fetch", "download")
SECOND_LOOK = ("script", "ci", "dockerfile", "build")
# Folders of documentation; paths and words of instructions for agents.
DOC_FOLDERS = "/(docs?|documentation|blogs?|vendor)/"
AGENT_PATH = r"(?i)(?:^|[/_-])(?:agent|agents|mcp|skills?|claude|codex|openclaw|llms?|modelcontextprotocol)(?:[/_.-]|$)"
AGENT_WORDS = r"(?i)\bmcpServers\b|Model Context Protocol|\bOpenCLAW\b|\ballowed-tools\b|\bClaude Code\b|\bCodex\b|\bnpx\s+skills\s+add\b|\bllms\.txt\b"
# Folders of tests, and of what tests read.
TEST_FOLDER = r"(?i)(^|/)(test|testing|[^/]*tests)/"
FIXTURE_FOLDER = r"(?i)(^|/)(fixtures?|__fixtures__|resources?|snapshots?|testdata|test-data)/"
# Options of a container's run command whose value is the next argument, and short ones. All others take none.
VALUED = (
    "--add-host", "--annotation", "--attach", "--blkio-weight", "--cap-add", "--cap-drop", "--cgroup-parent", "--cidfile", "--cpuset-cpus", "--cpuset-mems", "--device", "--device-cgroup-rule",
    "--device-read-bps", "--device-read-iops", "--device-write-bps", "--device-write-iops", "--dns", "--dns-option", "--dns-search", "--entrypoint", "--env", "--env-file", "--expose", "--gpus", "--group-add",
    "--health-cmd", "--health-interval", "--health-retries", "--health-start-period", "--health-timeout", "--hostname", "--ip", "--ip6", "--ipc", "--isolation", "--kernel-memory", "--label", "--label-file",
    "--link", "--link-local-ip", "--log-driver", "--log-opt", "--mac-address", "--memory", "--memory-reservation", "--memory-swap", "--memory-swappiness", "--mount", "--name", "--network", "--network-alias",
    "--oom-score-adj", "--pid", "--platform", "--publish", "--pull", "--restart", "--runtime", "--security-opt", "--shm-size", "--stop-signal", "--stop-timeout", "--storage-opt", "--sysctl", "--tmpfs",
    "--ulimit", "--user", "--userns", "--volume", "--volumes-from", "--workdir",
)
SHORT_VALUES = "aehlmpuvw"

_META = "version string, hasInstallScript boolean, scripts map<string,string>"
_TEXTS = "map<string,string>"


def _declared(scripts: Column) -> Column:
    """The hooks among these scripts that are not empty, with their commands."""
    pairs = F.array(*(F.struct(F.lit(h).alias("hook"), F.try_element_at(scripts, F.lit(h)).alias("command")) for h in HOOKS))
    return F.filter(pairs, lambda p: p["command"] != "")


def _hook_rows(rows: DataFrame, name: Column, version: Column, hooks: Column) -> DataFrame:
    rows = rows.select("path", name.alias("name"), version.alias("version"), F.explode(hooks).alias("h"))
    return rows.select("path", "name", "version", "h.hook", F.substring("h.command", 1, 200).alias("command"))


def npm_hooks(files: DataFrame) -> DataFrame:
    """path, name, version, hook, command of packages that run a script at install; a flag without scripts gives one row."""
    rows = files.select("path", F.explode(F.from_json(F.get_json_object("content", "$.packages"), _TEXTS)).alias("place", "meta"))
    rows = rows.where("place <> ''").withColumn("m", F.from_json("meta", _META))
    flag = F.array(F.struct(F.lit("(hasInstallScript)").alias("hook"), F.lit("known at install").alias("command")))
    inline = _declared(F.col("m.scripts"))
    hooks = F.when(F.size(inline) > 0, inline).when(F.col("m.hasInstallScript"), flag)
    return _hook_rows(rows, F.element_at(F.split("place", "node_modules/"), -1), F.coalesce("m.version", F.lit("?")), hooks)


def pnpm_hooks(files: DataFrame) -> DataFrame:
    """The same of the packages that a lockfile of indented lines marks as built at install."""
    section = F.get(F.split(F.regexp_extract("content", r"(?s)(?:^|\n)packages:[^\n]*\n(.*)", 1), r"\n(?=\S)"), F.lit(0))
    rows = files.select("path", F.explode(F.split(section, r"\n(?=  \S)")).alias("entry")).where(F.col("entry").rlike(r"\n    requiresBuild:\s*true\s*(\n|$)"))
    key = F.regexp_extract("entry", r"^\s*['\"]?([^\n]+?)['\"]?:\s*\n", 1)
    pattern = r"^/?((?:@[\w.-]+/)?[\w.-]+)@([\w.+-]+)"
    known = key.rlike(pattern)
    hooks = F.array(F.struct(F.lit("(requiresBuild)").alias("hook"), F.lit("known at install").alias("command")))
    return _hook_rows(rows, F.when(known, F.regexp_extract(key, pattern, 1)).otherwise(key), F.when(known, F.regexp_extract(key, pattern, 2)).otherwise("?"), hooks)


def bun_hooks(files: DataFrame) -> DataFrame:
    """The same of a lockfile in JSON with trailing commas, whose entries are objects or lists of texts and objects."""
    text = F.regexp_replace("content", r",(\s*[}\]])", "$1")
    rows = files.select("path", F.explode(F.from_json(F.get_json_object(text, "$.packages"), _TEXTS)).alias("key", "entry"))
    rows = rows.select("path", "key", F.explode(F.when(F.col("entry").startswith("["), F.from_json("entry", "array<string>")).otherwise(F.array("entry"))).alias("item"))
    rows = rows.where(F.col("item").startswith("{")).withColumn("m", F.from_json("item", _META))
    pattern = r"^(@[^@]+|[^@].*)@(.*)$"
    known = F.col("key").rlike(pattern)
    return _hook_rows(rows, F.when(known, F.regexp_extract("key", pattern, 1)).otherwise(F.col("key")), F.when(known, F.regexp_extract("key", pattern, 2)).otherwise("?"), _declared(F.col("m.scripts")))


def hooks(files: DataFrame) -> DataFrame:
    """The rows of every kind of lockfile by its name; a kind that does not record scripts gives none."""
    name = F.element_at(F.split("path", "/"), -1)
    return npm_hooks(files.where(name == "package-lock.json")).unionByName(pnpm_hooks(files.where(name == "pnpm-lock.yaml"))).unionByName(bun_hooks(files.where(name == "bun.lock")))


def _tolerant(text: str) -> object:
    """JSON, if need be without comments and trailing commas; None if it is neither."""
    quoted = r'("(?:\\.|[^"\\])*")'
    bare = lambda t, what: re.sub(rf"{quoted}|{what}", lambda m: m.group(1) or "", t, flags=re.S)
    for clean in (lambda t: t, lambda t: bare(bare(t, r"//[^\n]*|/\*.*?\*/"), r",(?=\s*[}\]])")):
        try:
            return json.loads(clean(text))
        except (ValueError, RecursionError):
            continue
    return None


def _servers(value: object, everywhere: bool) -> Iterator[dict]:
    """Objects under any mcpServers key, or all objects; a stack, as files may nest deeply."""
    stack = [value]
    while stack:
        v = stack.pop()
        if isinstance(v, dict):
            if everywhere:
                yield v
            for k, child in v.items():
                if k == "mcpServers" and not everywhere:
                    entries = child.values() if isinstance(child, dict) else child if isinstance(child, list) else ()
                    yield from (e for e in entries if isinstance(e, dict))
                else:
                    stack.append(child)
        elif isinstance(v, list):
            stack += v


def _operand(args: list[str], valued) -> str | None:
    """The first argument that is neither an option nor the value of one."""
    rest = iter(args)
    for a in rest:
        if valued(a):
            next(rest, None)
        elif a and not a.startswith("-"):
            return a
    return None


def _package(command: str, args: list[str]) -> str | None:
    """What a launcher of packages is told to run."""
    options = {"--registry", "--cache", "--prefix"}
    if command == "npm":
        if args[:1] not in (["exec"], ["x"]) or {"--no", "--no-install", "--yes=false"} & set(args):
            return None
        args, options = args[1:], options | {"--call", "-c"}
        own = args[: args.index("--")] if "--" in args else args
        for a, b in zip(own, [*own[1:], None]):
            if a in ("--package", "-p") or a.startswith("--package="):
                return b if "=" not in a else a.partition("=")[2]
        found = _operand(args, options.__contains__)
        return None if found and found[0] in "./$" else found
    if command == "uvx":
        for a, b in zip(args, [*args[1:], None]):
            if a.startswith("--from=") or (a == "--from" and b):
                return b if a == "--from" else a[7:]
    if command == "pnpm" and args[:1] == ["dlx"]:
        args = args[1:]
    return _operand(args, (options | {"--package", "-p"}).__contains__)


def _image(args: list[str]) -> str | None:
    if args[:1] != ["run"]:
        return None
    valued = lambda a: a in VALUED or (len(a) == 2 and a[0] == "-" and a[1] in SHORT_VALUES)
    found = _operand(args[1:], valued)
    return None if not found or found[0] in "./$" else found.strip("\"'")


def _server_findings(path: str, text: str) -> Iterator[tuple[str, str, str]]:
    """(rule, dependency, severity) of each server of one configuration."""
    value = _tolerant(text)
    found = list(_servers(value, False))
    if not found and path.replace("\\", "/").lower().rpartition("/")[2] in ("mcp.json", ".mcp.json"):
        found = list(_servers(value, True))
    for server in found:
        url = next((u for k in ("url", "endpoint", "sseUrl", "httpUrl") if isinstance(u := server.get(k), str) and u), "")
        if url.startswith(("http://", "https://")):
            yield "server-remote-url", url, "high"
        command, given = server.get("command"), server.get("args")
        if not isinstance(command, str) or not command.strip():
            continue
        name, args = command.split()[0].lower(), [a for a in given if isinstance(a, str)] if isinstance(given, list) else []
        if name == "docker" and (image := _image(args)):
            tag = image.rpartition("/")[2].partition(":")[2].lower()
            yield "server-image", image, "high" if "@sha256:" in image or (tag and tag not in MOVING) else "critical"
        elif name == "npm" or name in RUNNERS:
            if package := _package(name, args):
                moving = name != "npm" and re.search(rf"@(?:{'|'.join(MOVING)})\b", package, re.I)
                yield "server-package", package, "critical" if moving else "high"
        elif name not in INTERPRETERS:
            yield "server-command", command, "medium"


def server_findings(files: DataFrame) -> DataFrame:
    """path, rule, dependency, severity of the tool servers that configurations start or call, each once in a file.

    Comments and trailing commas are allowed. Objects under mcpServers count; in files named mcp.json all objects, if there are
    none. Placeholders in fixtures are reported as others are.
    """

    def batch(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = [(p, *found) for p, t in zip(f["path"], f["content"]) if t for found in dict.fromkeys(_server_findings(p or "", t))]
            yield pd.DataFrame(rows, columns=["path", "rule", "dependency", "severity"], dtype=object)

    kind = files.schema["path"].dataType.simpleString()
    return files.select("path", "content").mapInPandas(batch, f"path {kind}, rule string, dependency string, severity string")


def manifest_urls(files: DataFrame) -> DataFrame:
    """path, rule, line_number, dependency, severity of downloads that package manifests name, each once in a file.

    files has file_type as well. The severity is low if the manifest gives a hash anywhere, else medium. Fixtures of tests
    are left out.
    """
    files = files.where(~(F.col("path").rlike(TEST_FOLDER) & F.col("path").rlike(FIXTURE_FOLDER)))
    c, kind = F.col("content"), F.col("file_type")
    every = lambda p: F.regexp_extract_all(c, F.lit(p), F.lit(1))
    listed = F.flatten(F.transform(every(r'"url"\s*:\s*\[([^\]]*)\]'), lambda x: F.regexp_extract_all(x, F.lit(r'"(https?://[^"]+)"'), F.lit(1))))
    bucket = F.when(F.try_parse_json(c).isNotNull(), F.concat(every(r'"url"\s*:\s*"(https?://[^"]+)"'), listed))
    urls = F.when(kind == "homebrew_formula", every(r"(?m)^\s*url\s+['\"](https?://[^'\"]+)['\"]")).when(kind == "scoop_manifest", bucket)
    urls = urls.when(kind == "winget_manifest", every(r"(?m)^[\s-]*InstallerUrl\s*:\s*['\"]?(https?://[^\s'\"]+)"))
    hashed = F.when(kind == "homebrew_formula", c.rlike(r"(?im)^\s*sha256\s+['\"][a-f0-9]{32,}['\"]")).when(kind == "scoop_manifest", c.rlike(r'"hash"\s*:')).otherwise(c.rlike(r"(?m)^[\s-]*InstallerSha256\s*:"))
    rule = F.concat(F.regexp_extract(kind, "^[a-z]+", 0), F.lit("-url"))
    rows = files.select("path", "content", rule.alias("rule"), F.when(hashed, "low").otherwise("medium").alias("severity"), F.explode(F.array_distinct(urls)).alias("dependency"))
    quoted = F.position(F.concat(F.lit('"'), "dependency", F.lit('"')), c)
    before = F.substring(c, F.lit(1), F.when(quoted > 0, quoted).otherwise(F.position("dependency", c)) - 1)
    line = F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1
    return rows.select("path", "rule", line.cast("int").alias("line_number"), F.substring("dependency", 1, 200).alias("dependency"), "severity")


def bucket_manifest(content: Column) -> Column:
    """Whether a text is a manifest with a version and a download, at the top or for an architecture; null gives false."""

    def download(m: Column) -> Column:
        return F.coalesce(F.try_element_at(m, F.lit("url")).rlike(r'(?s)^(https?://|\[.*"https?://)') & F.arrays_overlap(F.map_keys(m), F.array(*map(F.lit, DOWNLOAD_KEYS))), F.lit(False))

    top = F.from_json(content, _TEXTS)
    builds = F.map_values(F.from_json(F.try_element_at(top, F.lit("architecture")), _TEXTS))
    any_build = F.coalesce(F.exists(builds, lambda b: download(F.from_json(b, _TEXTS))), F.lit(False))
    version = F.try_element_at(top, F.lit("version"))
    return F.coalesce(version.isNotNull() & ~version.rlike(r"^[{\[]") & (download(top) | any_build), F.lit(False))


def agent_document(path: Column, content: Column) -> Column:
    """Whether prose instructs agents, by its path or its words; not in folders of documentation or of others' code."""
    return ~F.concat(F.lit("/"), F.lower(path)).rlike(DOC_FOLDERS) & (path.rlike(AGENT_PATH) | F.coalesce(content.rlike(AGENT_WORDS), F.lit(False)))


def second_look(files: DataFrame, findings: DataFrame) -> DataFrame:
    """path, reason of files to be examined again: findings below critical that name an open word, or no finding in a type worth it.

    findings (path, severity, dependency) are counted per path before the join, so no file is repeated.
    """
    by_path = findings.groupBy("path").agg(F.max(F.col("severity") == "critical").alias("_sure"), F.max(F.coalesce(F.lower("dependency").rlike("|".join(OPEN_WORDS)), F.lit(False))).alias("_open"))
    rows = files.join(by_path, "path", "left")
    reason = F.when(~F.col("_sure") & F.col("_open"), "ambiguous").when(F.col("_sure").isNull() & F.col("file_type").isin(*SECOND_LOOK), "unclassified")
    return rows.select("path", reason.alias("reason")).where("reason is not null")
