"""Queries over lockfiles, tool-server configurations and manifests. Their input is made from parts; the SQL states the rows by key."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestack.operators import manifests
from lodestack.operators.text_rules import Rule, scan
from lodestack.plans.registry import query

def key():
    return F.col("p_partkey")


def text(*parts):
    """A text in which K stands for the key of the part."""
    return F.replace(F.lit("".join(parts)), F.lit("K"), key().cast("string"))


def files(inv, content, path="{}"):
    """One file per part: its key as path (or within one), and this content."""
    named = key() if path == "{}" else F.format_string(path.replace("{}", "%d"), key())
    return inv.table("part").select(named.alias("path"), content.alias("content"))


@query("txt_lockfile_npm", """SELECT p_partkey AS path, 'p' || p_partkey AS name, '1' AS version, 'postinstall' AS hook, 'node x' AS command FROM part WHERE p_partkey % 3 = 0
UNION ALL SELECT p_partkey, 'p' || p_partkey, '1', 'install', 'make' FROM part WHERE p_partkey % 3 = 0 UNION ALL SELECT p_partkey, '@s/q', '?', '(hasInstallScript)', 'known at install' FROM part WHERE p_partkey % 3 <> 2""", views=False)
def npm(inv):
    flagged = '"node_modules/a/node_modules/@s/q":{"hasInstallScript":true},"node_modules/clean":{"version":"2","scripts":{"test":"x","install":""}},"node_modules/odd":[1]'
    inline = '"node_modules/pK":{"version":"1","scripts":{"postinstall":"node x","install":"make","build":"y"},"hasInstallScript":true},'
    top = '{"packages":{"":{"scripts":{"install":"own"}},'
    return manifests.npm_hooks(files(inv, F.when(key() % 3 == 0, text(top, inline, flagged, "}}")).when(key() % 3 == 1, text(top, flagged, "}}")).otherwise("{broken")))


@query("txt_lockfile_pnpm", "SELECT p_partkey AS path, name, version, '(requiresBuild)' AS hook, 'known at install' AS command FROM part, LATERAL (SELECT 'p' || p_partkey AS name, '1.0' AS version UNION ALL SELECT '@s/q', '2.1') WHERE p_partkey % 2 = 0", views=False)
def pnpm(inv):
    lock = "lockfileVersion: 5\n\npackages:\n\n  /pK@1.0:\n    resolution: {x: y}\n    requiresBuild: true\n\n  '@s/q@2.1(peer@3)':\n    dependencies:\n      z: 1\n    requiresBuild: true\n    dev: false\n\n  clean@1:\n    dev: true\n\nsettings:\n  late@1:\n    requiresBuild: true\n"
    return manifests.pnpm_hooks(files(inv, F.when(key() % 2 == 0, text(lock)).otherwise("settings:\n  x@1:\n    requiresBuild: true\n")))


@query("txt_lockfile_bun", "SELECT p_partkey AS path, '@s/q' AS name, '2' AS version, 'install' AS hook, 'm' || p_partkey AS command FROM part UNION ALL SELECT p_partkey, 'plain', '?', 'prepare', 'x' FROM part", views=False)
def bun(inv):
    return manifests.bun_hooks(files(inv, text('{"packages":{"@s/q@2":["q@2","",{"scripts":{"install":"mK",},},],"plain":{"scripts":{"prepare":"x"}},"clean@1":["clean@1"],},}')))


@query("txt_lockfile_yarn", "SELECT CASE p_partkey % 3 WHEN 0 THEN 'a' || p_partkey || '/package-lock.json' ELSE 'a' || p_partkey || '/bun.lock' END AS path, 'plain' AS name, '?' AS version, 'prepare' AS hook, 'x' AS command FROM part WHERE p_partkey % 3 <> 2", views=False)
def by_lockfile(inv):
    """All kinds by name; this one records no scripts, so its files give no rows."""
    name = F.concat(F.lit("a"), key().cast("string"), F.when(key() % 3 == 0, "/package-lock.json").when(key() % 3 == 1, "/bun.lock").otherwise("/yarn.lock"))
    return manifests.hooks(inv.table("part").select(name.alias("path"), F.lit('{"packages":{"plain":{"scripts":{"prepare":"x"}}}}').alias("content")))


@query("txt_mcp_json", """SELECT 'c' || p_partkey || '/mcp.json' AS path, rule, dependency, severity FROM part, LATERAL (SELECT unnest(CASE p_partkey % 4
WHEN 0 THEN [{'rule': 'server-package', 'dependency': 'p' || p_partkey || '@latest', 'severity': 'critical'}, {'rule': 'server-remote-url', 'dependency': 'https://h/' || p_partkey, 'severity': 'high'}, {'rule': 'server-package', 'dependency': 'tool', 'severity': 'high'}]
WHEN 1 THEN [{'rule': 'server-image', 'dependency': 'r/i' || p_partkey, 'severity': 'critical'}, {'rule': 'server-image', 'dependency': 'r/i:1', 'severity': 'high'}, {'rule': 'server-command', 'dependency': '/bin/own --x', 'severity': 'medium'}]
WHEN 2 THEN [{'rule': 'server-package', 'dependency': 'git+u' || p_partkey, 'severity': 'high'}] ELSE [] END, recursive := true))""", views=False)
def tool_servers(inv):
    first = '{"mcpServers":{"a":{"command":"npx","args":["-y","--registry","r","pK@latest"]},"b":{"url":"https://h/K"},"c":{"command":"npm","args":["exec","--package=tool","--","x"]},"d":{"command":"bash","args":["x"]}}}'
    second = '{"deep":[{"mcpServers":[{"command":"docker","args":["run","-i","--rm","-e","A","--name","n","r/iK"]},{"command":"docker","args":["run","r/i:1"]},{"command":"/bin/own --x"}]}]}'
    third = '{ // a "comment"\n "x": {"command": "uvx", "args": ["--from", "git+uK", "tool"],}, /* more */ "y": "http://kept//", }'
    content = F.when(key() % 4 == 0, text(first)).when(key() % 4 == 1, text(second)).when(key() % 4 == 2, text(third)).otherwise("no json")
    return manifests.server_findings(files(inv, content, "c{}/mcp.json"))


@query("txt_package_catalogs", """SELECT p_partkey AS path, rule, CAST(line_number AS INTEGER) AS line_number, dependency, severity FROM part, LATERAL (SELECT unnest(CASE p_partkey % 3
WHEN 0 THEN [{'rule': 'homebrew-url', 'line_number': 2, 'dependency': 'https://h/' || p_partkey, 'severity': 'low'}]
WHEN 1 THEN [{'rule': 'scoop-url', 'line_number': 2, 'dependency': 'https://s/' || p_partkey, 'severity': 'medium'}, {'rule': 'scoop-url', 'line_number': 3, 'dependency': 'https://s/arch', 'severity': 'medium'}]
ELSE [{'rule': 'winget-url', 'line_number': 3, 'dependency': 'https://w/' || p_partkey, 'severity': 'low'}] END, recursive := true))""", views=False)
def catalogues(inv):
    formula = "class P < Formula\n  url \"https://h/K\"\n  sha256 \"" + "ab" * 32 + "\"\nend\n"
    bucket = '{"version":"1",\n"url":"https://s/K","bin":"x","note":"https://no",\n"architecture":{"64bit":{"url":["https://s/arch","https://s/K"]}}}'
    winget = "PackageIdentifier: P\nInstallers:\n- InstallerUrl: https://w/K\n  InstallerSha256: AB\n"
    kind = F.when(key() % 3 == 0, "homebrew_formula").when(key() % 3 == 1, "scoop_manifest").otherwise("winget_manifest")
    content = F.when(key() % 3 == 0, text(formula)).when(key() % 3 == 1, text(bucket)).otherwise(text(winget))
    return manifests.manifest_urls(inv.table("part").select(key().alias("path"), kind.alias("file_type"), content.alias("content")))


@query("src_scoop_sniff", "SELECT p_partkey AS id, p_partkey % 5 IN (0, 1) AS found FROM part", views=False)
def bucket_manifests(inv):
    content = F.when(key() % 5 == 0, text('{"version":K,"url":"http://x","bin":"y"}')).when(key() % 5 == 1, '{"version":"1","architecture":{"32bit":{},"64bit":{"url":["x","https://x"],"hash":"h"}}}')
    content = content.when(key() % 5 == 2, '{"url":"http://x","bin":"y"}').when(key() % 5 == 3, '{"version":"1","url":"ftp://x","hash":"y"}')
    return inv.table("part").select(key().alias("id"), manifests.bucket_manifest(content).alias("found"))


@query("src_markdown_sniff", "SELECT p_partkey AS id, p_partkey % 4 IN (0, 1) AS found FROM part", views=False)
def agent_documents(inv):
    path = F.when(key() % 4 == 0, text("x/skills/K.md")).when(key() % 4 == 2, text("docs/skills/K.md")).otherwise(text("x/readme-K.md"))
    return inv.table("part").select(key().alias("id"), manifests.agent_document(path, F.when(key() % 4 != 3, "see llms.txt")).alias("found"))


@query("txt_ai_candidates", "SELECT p_partkey AS path, CASE p_partkey % 5 WHEN 1 THEN 'ambiguous' ELSE 'unclassified' END AS reason FROM part WHERE p_partkey % 5 IN (0, 4) AND p_partkey % 2 = 0 OR p_partkey % 5 = 1", views=False)
def candidates(inv):
    every = inv.table("part").select(key().alias("path"), F.when(key() % 2 == 0, "script").otherwise("html").alias("file_type"))
    rank, found = key() % 5, inv.table("part").where("p_partkey % 5 > 0")
    rows = found.select(key().alias("path"), F.explode(F.array(F.lit("high"), F.when(rank == 2, "critical").otherwise("low"))).alias("severity"), F.when(rank != 3, "Download.sh").otherwise("x").alias("dependency"))
    return manifests.second_look(every, rows.where("path % 5 < 4"))


@query("txt_template_fields", "SELECT p_partkey AS path, 'masked:p' || p_partkey AS dependency FROM part", views=False)
def templates(inv):
    """A rule's template puts the dependency in place of the matched text, so what lies around it does not leave the rule."""
    rule = Rule("marked", r"key=(\S+) for (p\d+)", 1, "secret", "low", dependency="masked:$2")
    lines = inv.table("part").select(key().alias("path"), F.lit("text").alias("file_type"), text("key=hidden for pK").alias("content"))
    return scan(lines, [rule]).select("path", "dependency")
