"""Files that others name: a second pass over what the first one's findings refer to."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.operators.files import classified, contained
from lodestack.operators.text_rules import RULES, Rule, scan, without_heredocs

#: Own rules for files that commands and settings name.
REFERENCE_RULES = [
    Rule("runs-script", r"(?:^|[\s;&|(])(?:bash|sh|zsh|source|\.)\s+(?:-\w+\s+)*([\w./-]*[\w-])(?=$|[\s;&|)\"'])", 1, "script_reference", "info", ("script", "ci", "dockerfile", "build", "github_action"), multiple=True, hints=("sh ", "source ", ". ")),
    Rule("runs-path", r"(?:^|[;&|]\s*|run:\s*)(\./[\w./-]+)", 1, "script_reference", "info", ("script", "ci", "dockerfile", "build", "github_action"), multiple=True, hints=("./",)),
    Rule("names-file", r"(?:--file|--requirement|-r|-f)[ =]([\w./-]+\.[A-Za-z]\w*)", 1, "file_reference", "info", multiple=True, hints=("-",)),
]
#: Categories whose dependency is a path.
REFERRING = ("script_reference", "file_reference")


def referenced_path(dependency: Column) -> Column:
    """The path within the repository that a finding names, from its root; null if it leaves the root."""
    return contained(F.regexp_replace(dependency, r"^[./]+", ""))


def late_files(found: DataFrame, files: DataFrame) -> DataFrame:
    """The rows of files (repository, path, content, length) that findings of their repository name, with a type (script, if nothing tells it)."""
    named = found.where(F.col("category").isin(*REFERRING)).select("repository", referenced_path(F.col("dependency")).alias("path")).where("path is not null").distinct()
    return classified(files.join(named, ["repository", "path"], "left_semi"), default="script")


def scan_repositories(files: DataFrame, rules: list[Rule] | None = None) -> DataFrame:
    """files: (repository, path, content, length). Findings of all files with a type of their own, then of those that findings name.

    A named file is looked up in the repository of the finding and scanned if the first pass left it out; late tells which
    pass found a row. Paths that leave the repository, and files that are not there, give no rows. Repositories are never
    held together: both passes join and scan by rows.
    """
    rules = [*(RULES if rules is None else rules), *REFERENCE_RULES]
    key = F.concat_ws("\n", "repository", "path")

    def found(some: DataFrame, late: bool) -> DataFrame:
        hits = scan(without_heredocs(some.select(key.alias("path"), "file_type", "content")), rules)
        repository = F.substring_index("path", "\n", 1)
        return hits.select(repository.alias("repository"), F.substr("path", F.length(repository) + 2).alias("path"), "line_number", "rule", "category", "severity", "dependency", F.lit(late).alias("late"))

    files = files.withColumn("repository", F.col("repository").cast("string"))
    typed = classified(files)
    first = found(typed, False)
    rest = files.join(typed.select("repository", "path"), ["repository", "path"], "left_anti")
    return first.unionByName(found(late_files(first, rest), True))
