"""Files as a source: which are read, and of which type they are, by path, content or first line.

The table of globs is a parameter: an ordered list of (type, globs), the first that fits holds. `**/x` also fits at the root.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.functions.scalars import glob_regex

# Folders that are never read; the usual names of files by type.
SKIPPED = (
    ".git", "__pycache__", ".venv", "venv", ".tox", ".mypy_cache", ".ruff_cache", ".pytest_cache", "node_modules", "dist", "build", "target", ".gradle", ".pio", ".cache",
    ".terraform", ".pulumi", ".dart_tool", "_build", "deps", "Pods", "Carthage", "_site",
)
FILE_TYPES = [
    ("lockfile", ["**/package-lock.json", "**/yarn.lock", "**/pnpm-lock.yaml", "**/bun.lock", "**/poetry.lock", "**/Cargo.lock"]),
    ("ci", [".github/workflows/*.yml", ".github/workflows/*.yaml", ".gitlab-ci.yml", "**/Jenkinsfile", ".circleci/*.yml", "azure-pipelines.yml"]),
    ("github_action", ["**/action.yml", "**/action.yaml"]),
    ("dockerfile", ["**/Dockerfile", "**/Dockerfile.*", "**/*.dockerfile", "**/Containerfile"]),
    ("k8s", ["**/k8s/*.yaml", "**/kubernetes/*.yaml", "**/charts/*.yaml"]),
    ("iac", ["**/*.tf", "**/*.tfvars", "**/*.bicep"]),
    ("gitmodules", [".gitmodules"]),
    ("npmrc", ["**/.npmrc"]),
    ("pip_conf", ["**/pip.conf", "**/pip.ini"]),
    ("precommit_config", [".pre-commit-config.yaml"]),
    ("build", ["**/Makefile", "**/makefile", "**/*.mk", "**/CMakeLists.txt", "**/pom.xml", "**/*.gradle"]),
    ("script", ["**/*.sh", "**/*.bash", "**/*.zsh", "**/*.ps1", "**/*.bat", "**/*.cmd"]),
    ("html", ["**/*.html", "**/*.htm"]),
    ("source_code", ["**/*.py", "**/*.js", "**/*.ts", "**/*.rb", "**/*.pl"]),
]
#: Files over so many bytes have no first line read.
SHEBANG_BYTES = 1 << 20


def read_files(spark: SparkSession, folder: str, limit: int = 64 << 20) -> DataFrame:
    """path, length, content of the files under a folder, skipped folders left out; content of files over the limit is null."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.where(~skipped(F.col("path"))).select("path", "modificationTime", "length", F.when(F.col("length") <= limit, F.col("content")).alias("content"))


def skipped(path: Column) -> Column:
    """Whether a folder of the path is one of those never read."""
    return F.arrays_overlap(F.split(F.coalesce(path, F.lit("")), "/"), F.array(*map(F.lit, SKIPPED)))


def type_by_path(path: Column, table: list[tuple[str, list[str]]] = FILE_TYPES) -> Column:
    """The first type one of whose globs fits the path or the name; null if none does."""
    name, out = F.substring_index(path, "/", -1), None
    for kind, globs in table:
        either = "|".join(f"(?:{glob_regex(g)})" for g in dict.fromkeys(x for g in globs for x in (g, g.removeprefix("**/"))))
        fits = path.rlike(either) | name.rlike(either)
        out = F.when(fits, kind) if out is None else out.when(fits, kind)
    return out


def type_by_content(path: Column, content: Column) -> Column:
    """Types that only the content of a .json, .rb or .yaml file tells; null for others."""
    low = F.lower(path)
    servers = (low.endswith(".json")) & ~low.endswith(".i18n.json") & content.rlike(r'"mcpServers"\s*:')
    scoop = low.endswith(".json") & content.rlike(r'"version"\s*:') & content.rlike(r'"(?:url|architecture)"\s*:') & content.rlike(r'"(?:bin|hash|installer)"\s*:')
    formula = low.endswith(".rb") & content.rlike(r"(?m)^\s*class\s+\w+\s*<\s*Formula\b")
    winget = low.rlike(r"\.ya?ml$") & content.rlike(r"(?m)^PackageIdentifier:\s*\S") & content.rlike(r"(?m)^ManifestType:\s*\S")
    return F.when(servers, "mcp_config").when(scoop, "scoop_manifest").when(formula, "homebrew_formula").when(winget, "winget_manifest")


def type_by_first_line(content: Column, length: Column) -> Column:
    """Scripts and programs by their #! line (of the first 80 bytes); programs are told first, as their paths may hold sh."""
    line = F.lower(F.substring_index(F.substring(content, 1, 80), "\n", 1))
    runs = line.startswith("#!") & (length > 0) & (length <= SHEBANG_BYTES)
    return F.when(runs & line.rlike("python|node|deno|bun|ruby|perl"), "source_code").when(runs & line.rlike("/env sh|/bin/sh|bash|zsh|dash"), "script")


def classified(files: DataFrame, default: str | None = None, table: list[tuple[str, list[str]]] = FILE_TYPES) -> DataFrame:
    """files: (path, content, length) with file_type, by path, then content, then first line, then the default; others go without one."""
    kind = F.coalesce(type_by_path(F.col("path"), table), type_by_content(F.col("path"), F.col("content")), type_by_first_line(F.col("content"), F.col("length")), F.lit(default).cast("string"))
    # from a generator: a condition on the type would be moved in front of it and tell each type once more
    return files.select(*(f"`{c}`" for c in files.columns if c != "file_type"), F.explode(F.array(kind)).alias("file_type")).where("file_type is not null")


def contained(path: Column) -> Column:
    """A path with its . and .. steps resolved; null if it leaves the root or is absolute."""
    parts = F.filter(F.split(path, "/"), lambda p: ~p.isin("", "."))
    empty = F.array().cast("array<string>")
    up = lambda a, p: F.when(p != "..", F.concat(a, F.array(p))).when(F.size(a) == 0, F.lit(None)).otherwise(F.slice(a, 1, F.size(a) - 1))
    done = F.aggregate(parts, empty, lambda a, p: F.when(a.isNotNull(), up(a, p)))
    return F.when(~path.startswith("/") & done.isNotNull(), F.array_join(done, "/"))


def binary_findings(files: DataFrame, large: int = 100_000) -> DataFrame:
    """Vendored binaries: files of executable or archive extensions, and files over large bytes with a zero byte in their first 8 KB.

    files: (path, length, content as binary). Files under test fixtures are left out.
    """
    low = F.lower("path")
    fixture = low.rlike(r"(^|/)(tests?|fixtures?|testdata)/")
    listed = low.rlike(r"\.(exe|dll|so|dylib|jar|war|whl|deb|rpm|msi|bin|a|o|class|pyc)$")
    zero = F.position(F.lit("00"), F.regexp_replace(F.hex(F.substring("content", 1, 8192)), "(..)", "$1 ")) > 0
    kind = F.when(listed, "binary_extension").when((F.col("length") > large) & zero, "large_binary")
    return files.where(~fixture).select("path", "length", kind.alias("kind")).where("kind is not null")
