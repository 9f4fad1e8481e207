"""A walk of a repository as a source: folders are listed level by level by Spark, those that are skipped are never opened.

Links that lead out of the root are left out, and so is what lies behind them; a link within the root is followed once for
each name. Contents are read in tasks and up to a bound.
"""

from __future__ import annotations

import os
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.operators.files import SKIPPED
from lodestack.sources.shared import shared_path

#: Levels of folders that a walk goes down; a circle of links within the root ends here with an error.
MOST_LEVELS = 200
#: Tasks that list the folders of one level.
TASKS = 32
ENTRY = "path string, folder boolean, length long, reason string"
# Endings of files that are binaries by their name.
BINARY_ENDINGS = (".exe", ".dll", ".so", ".dylib", ".jar", ".war", ".whl", ".deb", ".rpm", ".msi", ".bin", ".a", ".o", ".class", ".pyc", ".zip", ".tar", ".tar.gz", ".tgz", ".apk", ".ipa")


def _opened(root: str):
    return fs.FileSystem.from_uri(root) if "://" in root or root.startswith("file:") else (fs.LocalFileSystem(), root)


def _lister(root: str, skipped: tuple[str, ...]):
    """The entries of each folder of a level; reason: why one is not read (outside, skipped, unreadable)."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _opened(root)
        local = isinstance(files, fs.LocalFileSystem)
        real = os.path.realpath(base) if local else ""
        for frame in frames:
            for folder in frame["path"]:
                rows = []
                try:
                    entries = files.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
                except OSError:
                    yield pd.DataFrame([(folder, True, 0, "unreadable")], columns=["path", "folder", "length", "reason"])
                    continue
                for e in entries:
                    path = f"{folder}/{e.base_name}".lstrip("/")
                    where = os.path.realpath(f"{base}/{path}") if local else ""
                    outside = local and where != real and not where.startswith(real + os.sep)
                    is_folder = e.type == fs.FileType.Directory
                    if e.type in (fs.FileType.File, fs.FileType.Directory):
                        rows.append((path, is_folder, 0 if is_folder else e.size, "outside" if outside else "skipped" if is_folder and e.base_name in skipped else None))
                yield pd.DataFrame(rows, columns=["path", "folder", "length", "reason"]).astype({"folder": bool, "length": "int64"})

    return run


def walk(spark: SparkSession, root: str, skipped: tuple[str, ...] = SKIPPED) -> DataFrame:
    """path (from the root), length, reason of the files under a root. reason is null for files that may be read.

    Entries that lead outside, folders that are skipped and those that can't be opened are rows too, with their reason, and
    nothing below them is listed. No files give no rows.
    """
    level, parts = spark.createDataFrame([("",)], "path string"), []
    for depth in range(MOST_LEVELS + 1):
        # written in the shared folder, so that a level is listed once however many levels follow
        path = shared_path(spark, "walk")
        level.repartition(TASKS).mapInPandas(_lister(root, skipped), ENTRY).write.parquet(path)
        found = spark.read.schema(ENTRY).parquet(path)
        parts.append(found.where("not folder or reason is not null"))
        level = found.where("folder and reason is null").select("path")
        if level.isEmpty():
            break
        if depth == MOST_LEVELS:
            raise ValueError(f"folders lie more than {MOST_LEVELS} deep")
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.select("path", "length", "reason")


def _reader(root: str, limit: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        files, base = _opened(root)
        for frame in frames:
            for path, length in zip(frame["path"], frame["length"], strict=True):
                body, reason = None, None
                try:
                    with files.open_input_stream(f"{base}/{path}", compression=None) as stream:
                        body = stream.read(limit + 1)
                except OSError:
                    reason = "unreadable"
                if body is not None and len(body) > limit:
                    body, reason = None, "too large"
                yield pd.DataFrame([(path, length, body, reason)], columns=["path", "length", "content", "reason"])

    return run


def contents(spark: SparkSession, root: str, files: DataFrame, limit: int = 64 << 20) -> DataFrame:
    """path, length, content (binary), reason of the files of a walk that may be read; content is null where reason tells why (too large, unreadable)."""
    some = files.where("reason is null").select("path", "length").repartition(TASKS)
    return some.mapInPandas(_reader(root, limit), "path string, length long, content binary, reason string")


def binaries(files: DataFrame) -> DataFrame:
    """The files of a walk that are binaries by the ending of their names; they are never opened."""
    low, any_end = F.lower("path"), F.lit(False)
    for end in BINARY_ENDINGS:
        any_end = any_end | low.endswith(end)
    return files.where(F.col("reason").isNull() & any_end).select("path", "length")
