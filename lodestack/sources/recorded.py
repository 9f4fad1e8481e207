"""Listings of remote services as data sources, read from recorded answers: a folder `key=<sha1 of the request>` for each answer.

An answer is one JSON line {"status", "headers", "body"}. The folder may be in any store that pyarrow opens. Each owner or region is
a partition of its own, whose pages are followed one after another by one task; others go on beside it.
"""

from __future__ import annotations

import fnmatch
import hashlib
import json
import re
from collections.abc import Iterator
from urllib.parse import quote

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Pages of one listing that are followed at most; a listing that has more fails, as a circle of links would.
MOST_PAGES = 10_000
_NEXT = re.compile(r'<([^>]*)>\s*;[^,]*\brel="?next"?')


def request_key(request: str) -> str:
    return hashlib.sha1(request.encode()).hexdigest()


def record(answers: DataFrame, path: str) -> None:
    """Write answers (request, status, headers as a map, body as JSON text) where the sources find them."""
    body = F.to_json(F.struct("status", "headers", "body"))
    answers.select(F.sha1(F.col("request").cast("binary")).alias("key"), body.alias("value")).write.partitionBy("key").text(path)


def _answer(path: str, request: str) -> dict:
    """The recorded answer to a request; 404 if there is none."""
    files, root = fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)
    found = files.get_file_info(fs.FileSelector(f"{root}/key={request_key(request)}", allow_not_found=True))
    for f in sorted(found, key=lambda f: f.path):
        if f.is_file and f.size and not f.base_name.startswith(("_", ".")):
            with files.open_input_stream(f.path) as stream:
                return json.loads(stream.read())
    return {"status": 404, "headers": {}, "body": "{}"}


def next_link(header: str | None) -> str | None:
    """The url of the link named next in a Link header."""
    found = _NEXT.search(header or "")
    return found[1] if found else None


class _Part(InputPartition):
    def __init__(self, name: str):
        super().__init__(name)
        self.name = name


class _Names:
    """A partition for each of the comma-separated names of an option."""

    option = ""

    def __init__(self, options):
        self.options, self.path = options, options["path"]

    def partitions(self) -> list[_Part]:
        return [_Part(n.strip()) for n in self.options[self.option].split(",") if n.strip()]


class RepositoryListing(DataSource):
    """Repositories of owners, page by page along the Link header.

    Options: path, owners (comma-separated), kind (orgs or users), type, base. Rows: owner, position, repository (JSON), error. If
    the first page of an owner fails, its one row tells the error; if a later one fails, the listing ends there.
    """

    @classmethod
    def name(cls) -> str:
        return "repository_listing"

    def schema(self) -> str:
        return "owner string, position int, repository string, error string"

    def reader(self, schema):
        return _Repositories(self.options)


class _Repositories(_Names, DataSourceReader):
    option = "owners"

    def read(self, part: _Part) -> Iterator[tuple]:
        owner, position = part.name, 0
        url = f"{self.options.get('base', 'https://api.example')}/{self.options.get('kind', 'orgs')}/{quote(owner)}/repos?per_page=100&type={self.options.get('type', 'all')}"
        for page in range(MOST_PAGES + 1):
            if page == MOST_PAGES:
                raise ValueError(f"{owner} has more than {MOST_PAGES} pages")
            answer = _answer(self.path, url)
            if answer["status"] != 200:
                if page == 0:
                    yield owner, None, None, f"status {answer['status']}"
                return
            items = json.loads(answer["body"])
            for item in items if isinstance(items, list) else ():
                yield owner, position, json.dumps(item, separators=(",", ":")), None
                position += 1
            headers = {k.lower(): v for k, v in (answer.get("headers") or {}).items()}
            url = next_link(headers.get("link"))
            if not url:
                return


class ClusterListing(DataSource):
    """Resources of the clusters of regions whose names fit a glob.

    Options: path, regions, clusters (globs, comma-separated; without a * or ? in any of them the names are taken as they
    are, and clusters are not listed). Rows: region, cluster, doc (JSON of what the cluster's dump holds), error.
    """

    @classmethod
    def name(cls) -> str:
        return "cluster_listing"

    def schema(self) -> str:
        return "region string, cluster string, doc string, error string"

    def reader(self, schema):
        return _Clusters(self.options)


class _Clusters(_Names, DataSourceReader):
    option = "regions"

    def read(self, part: _Part) -> Iterator[tuple]:
        region = part.name
        globs = [g.strip() for g in self.options.get("clusters", "*").split(",")]
        names = globs
        if any(set("*?") & set(g) for g in globs):
            answer = _answer(self.path, f"{region}/list-clusters")
            if answer["status"] != 200:
                yield region, None, None, f"status {answer['status']}"
                return
            names = [n for n in json.loads(answer["body"]).get("clusters", []) if any(fnmatch.fnmatchcase(n, g) for g in globs)]
        for name in names:
            answer = _answer(self.path, f"{region}/{name}")
            good = answer["status"] == 200
            yield region, name, answer["body"] if good else None, None if good else f"status {answer['status']}"


def register(spark: SparkSession) -> None:
    """Make both sources known to a session: `spark.read.format("repository_listing")`."""
    for source in (RepositoryListing, ClusterListing):
        spark.dataSource.register(source)
