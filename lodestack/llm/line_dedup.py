"""Line deduplication with DataFrame functions alone."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import NO_ID, attach, cut, public_id

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line):
    """The line without ASCII white space at both ends, A-Z lower-cased."""
    return F.btrim(F.translate(line, UPPER, LOWER), F.lit(" \t\n\x0b\x0c\r"))


def _text():
    return F.coalesce("_text", F.lit(""))


def prints(value) -> tuple:
    """128 bits of a string: two hashes, of which neither is a function of the other, for the seed comes before the string."""
    return F.xxhash64(F.lit(1), value), F.xxhash64(F.lit(2), value)


def _named(value, *names):
    return (p.alias(n) for p, n in zip(prints(value), names, strict=True))


def dedup_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = 10, min_docs: int = 2, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: id, n_lines, n_dropped, kept (its other lines, joined by a line feed).

    Lines whose key has min_chars code points or more and is found in min_docs documents or more go, but for the document
    of the smallest id that holds it, which keeps all of them. A null or empty text is one empty line. A null id is larger
    than all others; rows of one id are one document. Repeated rows stay and are treated alike. Other columns are
    ignored, but for those named in carry, which must not be named as those of the result.
    """
    own = [F.col(c).alias(f"_c{k}") for k, c in enumerate(carry)]
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"), *own).select("*", *_named(F.col("_text"), "t1", "t2"))
    lines = docs.select("_id", "t1", "t2", F.posexplode(F.split(_text(), "\n", -1)).alias("at", "line")).withColumn("key", line_key("line"))
    lines = lines.where(F.length("key") >= min_chars)
    lines = cut(lines.select("_id", "t1", "t2", "at", *_named(F.col("key"), "k1", "k2")))
    if min_docs == 2:
        common = lines.groupBy("k1", "k2").agg(F.min("_id").alias("first"), F.max("_id").alias("last")).where("first < last")
    else:
        each = lines.select("k1", "k2", "_id").distinct()
        common = each.groupBy("k1", "k2").agg(F.min("_id").alias("first"), F.count(F.lit(1)).alias("n")).where(F.col("n") >= min_docs)
    common = cut(common.select("k1", "k2", "first"))
    gone = attach(lines, common, ["k1", "k2"], "inner").where("_id > first")
    gone = cut(gone.groupBy("_id", "t1", "t2").agg(F.collect_set("at").alias("gone")))
    marked = attach(docs, gone, ["_id", "t1", "t2"], size=F.size("gone") * 4)
    split = F.split(_text(), "\n", -1)
    # runs of kept lines between dropped ones: linear in the lines, whatever their number
    ends = F.concat(F.array_sort("gone"), F.array(F.size(split)))
    starts = F.concat(F.array(F.lit(0)), F.transform(F.array_sort("gone"), lambda x: x + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(F.col("lines"), a + 1, b - a))
    kept = F.when(F.col("gone").isNull(), _text()).otherwise(F.array_join(F.flatten(runs), "\n"))
    done = marked.withColumn("lines", split).withColumn("kept", kept)
    return done.select(public_id().alias(id_col), F.size("lines").cast("long").alias("n_lines"), F.coalesce(F.size("gone"), F.lit(0)).cast("long").alias("n_dropped"), "kept", *(F.col(f"_c{k}").alias(c) for k, c in enumerate(carry)))


def dedup_documents(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars") -> DataFrame:
    """The rows of df with the text that is left (null stays null) and its length, where lines went."""
    others = tuple(c for c in df.columns if c not in (id_col, text_col))
    done = dedup_lines(df.withColumnsRenamed({c: f"_o_{c}" for c in others}), id_col, text_col, carry=(*(f"_o_{c}" for c in others), text_col))
    less = F.col("n_dropped") > 0
    new = {text_col: F.when(less, F.col("kept")).otherwise(F.col(text_col)), **{c: F.col(f"_o_{c}") for c in others}}
    if length_col in others:
        new[length_col] = F.when(less, F.length("kept").cast(df.schema[length_col].dataType)).otherwise(F.col(f"_o_{length_col}"))
    return done.select(*(new.get(c, F.col(c)).alias(c) for c in df.columns))
