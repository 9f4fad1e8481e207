"""A sink that pushes one compressed payload per key, and bodies that are read back within a bound.

`push` writes with a data source whose tasks put each payload, gzip-compressed, where the receiver takes it (a folder; the name follows
from the key, so a task that is run again puts the same). A payload that can't be pushed is recorded and does not end the job. The
driver gets a count from each task, and the commit names the record files of those tasks alone whose results count. `received` reads
what arrived: each payload by the task that has its key, so the driver never lists the payloads.
"""

from __future__ import annotations

import gzip
import hashlib
import json
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pandas as pd
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StringType, StructField, StructType

#: Bytes of a body as it is sent, and after decompression.
MOST_BODY, MOST_INFLATED = 64 << 20, 256 << 20
#: Bytes that are inflated at once.
STEP = 1 << 20
#: Bytes of bodies that a task gathers before it hands them on.
GATHERED = 4 << 20
OUTCOME = "key string, status int, bytes long, error string"


def _opened(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def _place(key: str | None, ending: str) -> str:
    """Where the payload of a key is put."""
    return f"payloads/{hashlib.sha1((key or '').encode()).hexdigest()}{ending}"


@dataclass
class _Done(WriterCommitMessage):
    file: str
    pushed: int
    failed: int


class PayloadSink(DataSource):
    """Writes rows (key, payload). Options: path, most_body (bytes of a payload before compression), ending (of the names)."""

    @classmethod
    def name(cls) -> str:
        return "payload_sink"

    def writer(self, schema, overwrite):
        return _Pusher(self.options)


class _Pusher(DataSourceWriter):
    def __init__(self, options):
        self.path, self.most = options["path"], int(options.get("most_body", MOST_BODY))
        self.ending = options.get("ending", ".json.gz")

    def write(self, rows: Iterator) -> _Done:
        files, root = _opened(self.path)
        task = TaskContext.get()
        name, counts = f"outcomes/part-{task.partitionId()}-{task.taskAttemptId()}.json", [0, 0]
        for folder in ("payloads", "outcomes"):
            files.create_dir(f"{root}/{folder}", recursive=True)
        with files.open_output_stream(f"{root}/{name}") as log:
            for row in rows:
                raw, status, error = (row["payload"] or "").encode(), 200, None
                try:
                    if len(raw) > self.most:
                        status, error = 413, f"more than {self.most} bytes"
                    else:
                        with files.open_output_stream(f"{root}/{_place(row['key'], self.ending)}", compression=None) as out:
                            out.write(gzip.compress(raw, mtime=0))
                except OSError as e:
                    status, error = 503, str(e)
                counts[status != 200] += 1
                log.write((json.dumps({"key": row["key"], "status": status, "bytes": len(raw), "error": error}) + "\n").encode())
        return _Done(name, *counts)

    def commit(self, messages) -> None:
        files, root = _opened(self.path)
        done = [m for m in messages if m]
        with files.open_output_stream(f"{root}/_receipt.json") as out:
            out.write(json.dumps({"files": [m.file for m in done], "pushed": sum(m.pushed for m in done), "failed": sum(m.failed for m in done)}).encode())

    def abort(self, messages) -> None:
        """Payloads stay: pushing them again changes nothing. Without a receipt no outcome counts."""


def push(payloads: DataFrame, path: str, most_body: int = MOST_BODY, ending: str = ".json.gz") -> DataFrame:
    """Push payloads (key, payload) and return what became of each: key, status, bytes, error. Null payloads are empty ones."""
    spark = payloads.sparkSession
    spark.dataSource.register(PayloadSink)
    payloads.select(F.col("key").cast("string").alias("key"), "payload").write.format("payload_sink").mode("append").options(path=path, most_body=most_body, ending=ending).save()
    return outcomes(spark, path)


def outcomes(spark: SparkSession, path: str) -> DataFrame:
    """The outcomes that the receipt of a push counts."""
    files, root = _opened(path)
    with files.open_input_stream(f"{root}/_receipt.json") as f:
        names = json.loads(f.read())["files"]
    return spark.read.schema(OUTCOME).json([f"{path}/{n}" for n in names]) if names else spark.createDataFrame([], OUTCOME)


def received(told: DataFrame, path: str, ending: str = ".json.gz", most_inflated: int = MOST_INFLATED) -> DataFrame:
    """Outcomes of a push (key, status, bytes, error) with what the receiver holds of each that arrived: body, null for others and for what is no whole text."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _opened(path)
        for batch in batches:
            start, held, bodies = 0, 0, []
            for key, status in zip(batch["key"].to_pylist(), batch["status"].to_pylist(), strict=True):
                body = None
                if status == 200:
                    try:
                        with files.open_input_stream(f"{root}/{_place(key, ending)}", compression=None) as f:
                            body = inflated(f.read(), most_inflated)[0]
                    except FileNotFoundError:
                        pass
                bodies.append(body)
                held += len(body or "")
                if held > GATHERED:
                    yield _with_bodies(batch.slice(start, len(bodies)), bodies)
                    start, held, bodies = start + len(bodies), 0, []
            if bodies:
                yield _with_bodies(batch.slice(start), bodies)

    return told.select("key", "status", "bytes", "error").mapInArrow(read, f"{OUTCOME}, body string")


def _with_bodies(batch: pa.RecordBatch, bodies: list[str | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(bodies, pa.string())], names=[*batch.schema.names, "body"])


def inflated(raw: bytes | None, limit: int) -> tuple[str | None, str | None]:
    """(text, error) of a gzip body, inflated in steps and no further than the limit."""
    if not raw:
        return None, "empty"
    work, out, left = zlib.decompressobj(16 + zlib.MAX_WBITS), [], raw
    try:
        while left and not work.eof:
            out.append(work.decompress(left, min(STEP, limit + 1)))
            left = work.unconsumed_tail
            limit -= len(out[-1])
            if limit < 0:
                return None, "too large"
        return (b"".join(out).decode(), None) if work.eof else (None, "cut off")
    except zlib.error:
        return None, "no gzip"
    except UnicodeDecodeError:
        return None, "no UTF-8"


def gzip_json(body: Column, most_body: int = MOST_BODY, most_inflated: int = MOST_INFLATED) -> Column:
    """struct(json, error) of gzip-compressed JSON bodies: json is null where error tells why: empty, too large, no gzip, cut off, no UTF-8, no JSON."""

    @F.pandas_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
    def read(bodies: pd.Series) -> pd.DataFrame:
        rows = [(None, "too large") if b is not None and len(b) > most_body else _checked(*inflated(b, most_inflated)) for b in bodies]
        return pd.DataFrame(rows, columns=["json", "error"], index=bodies.index)

    return read(body)


def _checked(text: str | None, error: str | None) -> tuple[str | None, str | None]:
    try:
        if text is not None:
            json.loads(text)
    except (ValueError, RecursionError):
        return None, "no JSON"
    return text, error


@F.udf(StringType(), useArrow=True)
def _merged(base: str | None, over: str | None) -> str | None:
    def merge(a, b):
        return {**a, **{k: merge(a[k], v) if isinstance(v, dict) and isinstance(a.get(k), dict) else v for k, v in b.items()}}

    a, b = json.loads(base) if base else {}, json.loads(over) if over else {}
    if not (isinstance(a, dict) and isinstance(b, dict)):
        return None
    return json.dumps(merge(a, b), ensure_ascii=False, separators=(",", ":"))


def deep_merge(base: Column, over: Column) -> Column:
    """One JSON object laid over another at any depth: objects are merged, everything else is replaced, null too. Empty or null text is no change; what is no object gives null."""
    return _merged(base, over)
