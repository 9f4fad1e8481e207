"""YAML files of several documents as rows of JSON. Documents are split in the JVM; one is decoded at a time, and a bad one is a row of its own."""

from __future__ import annotations

import datetime
import json
import math
import re
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from lodestack.operators.batches import arrow_rows

try:  # decoding needs it; everything else works without
    import yaml
except ImportError:
    yaml = None

#: Most values of one document, aliases written out: anchors can stand for more than memory holds.
MOST_VALUES = 1_000_000
#: Where a document ends or begins; the text on the line of a begin belongs to the document.
_BREAK = r"(?m)^(?:---|\.\.\.)(?=\s|\z)"


def _plain(value, left: list[int]):
    """What JSON can hold of a decoded value: dates and others as text, not a number as null."""
    left[0] -= 1
    if left[0] < 0:
        raise ValueError(f"more than {MOST_VALUES} values")
    if isinstance(value, dict):
        return {k if isinstance(k, str) else json.dumps(k, default=str): _plain(v, left) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [_plain(v, left) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        return None
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value if value is None or isinstance(value, str | int | float | bool) else str(value)


class _Other(Exception):
    """A document holds what only the package's own constructors know."""


#: Tags of the usual kinds.
_STR, _INT, _BOOL, _NULL, _MAP, _SEQ = (f"tag:yaml.org,2002:{k}" for k in ("str", "int", "bool", "null", "map", "seq"))
#: Scalars that are remembered, each no longer than this.
_MOST_KNOWN, _LONGEST_KNOWN = 1 << 16, 64

if yaml is not None:
    _Loader = getattr(yaml, "CSafeLoader", yaml.SafeLoader)

    class _Composer(_Loader):
        """Composes nodes as its base does, and remembers the tags of short plain scalars."""

        known: dict[str, str] = {}

        def resolve(self, kind, value, implicit):
            if kind is not yaml.ScalarNode:
                return _MAP if kind is yaml.MappingNode else _SEQ
            if not implicit[0]:
                return _STR
            tag = self.known.get(value)
            if tag is None:
                tag = _Loader.resolve(self, kind, value, implicit)
                if len(value) <= _LONGEST_KNOWN:
                    if len(self.known) >= _MOST_KNOWN:
                        self.known.clear()
                    self.known[value] = tag
            return tag

        # the safe loader has no resolvers by path
        def descend_resolver(self, node, index):
            pass

        def ascend_resolver(self):
            pass


def _value(node, left: list[int]):
    """What _plain gives of a node, made without the package's constructors; _Other if that needs them."""
    left[0] -= 1
    if left[0] < 0:
        raise _Other
    kind, tag = type(node), node.tag
    if kind is yaml.ScalarNode:
        text = node.value
        if tag == _STR:
            return text
        # octal, binary, grouped and sexagesimal numbers are left to the package
        if tag == _INT and text.isascii() and text.isdigit() and (text[0] != "0" or text == "0"):
            return int(text)
        if tag == _BOOL and text in ("true", "false"):
            return text == "true"
        if tag == _NULL:
            return None
    elif kind is yaml.MappingNode and tag == _MAP:
        out = {}
        for k, v in node.value:
            if k.tag != _STR or type(k) is not yaml.ScalarNode:
                raise _Other
            out[k.value] = _value(v, left)
        return out
    elif kind is yaml.SequenceNode and tag == _SEQ:
        return [_value(x, left) for x in node.value]
    raise _Other


def _loaded(text: str):
    """The plain value of a document: from its nodes where they are of the usual kinds, else by the package's constructors."""
    loader = _Composer(text)
    try:
        node = loader.get_single_node()
        return None if node is None else _value(node, [MOST_VALUES])
    except (_Other, RecursionError):
        return _plain(yaml.load(text, _Loader), [MOST_VALUES])
    finally:
        loader.dispose()


#: Compact JSON; made once, as json.dumps makes it anew for each text.
_written = json.JSONEncoder(ensure_ascii=False, separators=(",", ":")).encode


#: A value that fills its line behind a key: letters and digits (always text) or a plain number (always that number), so where it stands
#: another of its kind gives the same document but for the value.
_VALUE = re.compile(r"(?m)^( *(?:- +)*[A-Za-z_][A-Za-z0-9_./-]*: )(?:([a-z]{1,32}[0-9]{1,18})|([1-9][0-9]{0,17}))$")
#: What takes the place of such values, and how their places are found in the JSON.
_WORD, _NUMBER, _MOST_PLACES = "zqjxv", "98765432109876", 1000
_PLACES = [(f"{_WORD}{k:03}", f"{_NUMBER}{k:03}") for k in range(_MOST_PLACES)]
_PLACE = re.compile(f"(?:{_WORD}|{_NUMBER})([0-9]{{3}})")
#: Forms that are remembered, each no longer than this: JSON in parts, between which the values go by their numbers, and whether it is a
#: resource (a value of one kind is one with all of them); None: no JSON.
_forms: dict[str, tuple[list[str], list[int], bool] | None] = {}
_MOST_FORMS, _LONGEST_FORM = 1 << 10, 1 << 13


def _is_resource(value) -> bool:
    """Whether a document has a kind and a version, or is a list of items."""
    if not isinstance(value, dict) or (kind := value.get("kind")) is None:
        return False
    return value.get("apiVersion") is not None or value.get("items") is not None and isinstance(kind, str) and kind.endswith("List")


def _by_form(text: str) -> tuple[str, bool] | None:
    """JSON of a document and whether it is a resource, by its form, which is decoded once for all documents that differ in such values alone; None if it has to be decoded itself.

    Equal values have one place, so what depends on whether they are equal stays. Tags can turn text into anything: texts with them have no form.
    """
    if len(text) > _LONGEST_FORM or "!" in text or _WORD in text or _NUMBER in text:
        return None
    seen: dict[str, int] = {}

    def place(m: re.Match) -> str:
        k = seen.setdefault(m[2] or m[3], len(seen))
        return m[1] + _PLACES[k][m[2] is None] if k < _MOST_PLACES else m[0]

    form = _VALUE.sub(place, text)
    if not seen or len(seen) > _MOST_PLACES:
        return None
    if form not in _forms:
        if len(_forms) >= _MOST_FORMS:
            _forms.clear()
        try:
            value = _loaded(form)
            parts = _PLACE.split(_written(value))
            _forms[form] = parts, [int(k) for k in parts[1::2]], _is_resource(value)
        except _FAULTS:
            _forms[form] = None
    if (made := _forms[form]) is None:
        return None
    parts, values = made[0].copy(), list(seen)
    parts[1::2] = [values[k] for k in made[1]]
    return "".join(parts), made[2]


#: Values that a tag does not fit raise what the package does not name.
_FAULTS = (*(() if yaml is None else (yaml.YAMLError,)), ValueError, TypeError, LookupError, AttributeError, ArithmeticError, RecursionError)


def _decode(text: str | None) -> tuple[str | None, str | None, bool]:
    """(JSON, error, whether it is a resource) of one YAML document."""
    if yaml is None:
        raise ImportError("decoding YAML needs the package yaml")
    try:
        if made := _by_form(text or ""):
            return made[0], None, made[1]
        value = _loaded(text or "")
        return _written(value), None, _is_resource(value)
    except _FAULTS as e:
        return None, f"{type(e).__name__}: {str(e).splitlines()[0] if str(e) else ''}", False


def decode(text: str | None) -> tuple[str | None, str | None]:
    """(JSON, error) of one YAML document; an empty one is null."""
    return _decode(text)[:2]


@F.pandas_udf(StructType([StructField("json", StringType()), StructField("error", StringType())]))
def _decoded(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for some in texts:
        yield pd.DataFrame([decode(t) for t in some], columns=["json", "error"], index=some.index)


def yaml_json(text: Column) -> Column:
    """struct(json, error) of a column of single YAML documents."""
    return _decoded(text)


def _decoded_rows(batch: pa.RecordBatch) -> pa.RecordBatch:
    done = [_decode(t) for t in batch.column(2).to_pylist()]
    made = (pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.string(), pa.bool_())))
    return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *made], names=["path", "document", "json", "error", "resource"])


def _documents(files: DataFrame, path: str, content: str) -> DataFrame:
    """The rows of yaml_documents, and whether each is a resource."""
    # a line that is no comment or directive holds more than white space; line ends other than \n and \r are no white space
    held = lambda p: p.rlike(r"[\u0085\u2028\u2029]|(?m)^(?![ \t]*[#%]).*?\S")
    pieces = F.filter(F.split(F.regexp_replace(content, "^\ufeff", ""), _BREAK, -1), held)
    rows = files.select(F.col(path).cast("string").alias("path"), F.posexplode(pieces).alias("document", "_text"))
    # a map over batches, not a column: conditions on json and error would be moved in front of a column and decode each document once more
    return arrow_rows(rows, _decoded_rows, "path string, document int, json string, error string, resource boolean")


def yaml_documents(files: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """One row per document of YAML files: path, document (from 0), json, error.

    A document that can't be decoded has its error and no json; the others of its file are not touched. Documents of
    white space, comments and directives alone are left out, as are null contents. Anchors hold within their document.
    """
    return _documents(files, path, content).drop("resource")


def manifest_resources(files: DataFrame) -> DataFrame:
    """Resources of cluster manifests: path, document, doc (JSON), error.

    files: (path, content). Of .yaml and .yml files every document, of .json files the whole content; others are left out. Decoded
    documents without a kind and an apiVersion are left out, unless they are lists of items.
    """
    low = F.lower("path")
    decoded = _documents(files.where(low.rlike(r"\.ya?ml$")), "path", "content").where("error is not null or resource").select("path", "document", F.col("json").alias("doc"), "error")
    whole = files.where(low.endswith(".json") & F.col("content").isNotNull()).select("path", F.lit(0).alias("document"), F.col("content").alias("doc"))
    bad = F.when(F.try_parse_json("doc").isNull(), F.lit("no JSON"))
    rows = whole.withColumn("error", bad).withColumn("doc", F.when(F.col("error").isNull(), F.col("doc")))
    field = lambda n: F.get_json_object("doc", f"$.{n}")
    listed = field("items").isNotNull() & F.coalesce(field("kind"), F.lit("")).endswith("List")
    return decoded.unionByName(rows.where(F.col("error").isNotNull() | listed | field("kind").isNotNull() & field("apiVersion").isNotNull()))
