"""Removal of repeated passages: Rabin-Karp hashes of every window of words, counted over the corpus.

Every window has an anchor: of the half-length runs of words in it, the one of least hash. Equal windows have equal
anchors, so windows whose anchor occurs once in the corpus cannot repeat; they are settled before the shuffle. The rest
are counted by their whole Rabin-Karp hash together with the anchor's. All but the earliest of equal windows are
removed, as maximal intervals of words. Hashes travel as packed records; each task forwards one record per hash.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import FLUSH_RECORDS, WordHash, arrow_map, attach, buckets, column, cut, fmix, keyed, public_id, record_batch, rolling, scattered, texts

ANCHOR_BASE = 0x9E3779B97F4A7C15
WINDOW_BASE = 0xC2B2AE3D27D4EB4F
REPEATED = np.uint32(1 << 31)
#: Rows that a task remembers, to send repeated ones once.
REMEMBERED = 200_000

_CLASS = pa.schema([("_id", pa.int64()), ("t1", pa.int64()), ("t2", pa.int64())])
_ROUTED = pa.schema([("bucket", pa.int32()), ("known", pa.bool_()), ("blob", pa.binary())])
_PLACES = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_HITS = pa.schema([("_id", pa.int64()), ("blob", pa.binary())])
_DONE = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string())])
_PLACE = np.dtype([("id", "<i8"), ("pos", "<u4")])
_ANCHOR = np.dtype([("key", "<u8"), ("id", "<i8"), ("pos", "<u4")])
ROUTED, PLACES, HITS = "bucket int, known boolean, blob binary", "bucket int, blob binary", "_id long, blob binary"


def word_class(words: list[bytes]) -> tuple[int, int]:
    """128-bit hash of a word sequence."""
    h = xxhash.xxh3_128_digest(b" ".join(words))
    return int.from_bytes(h[:8], "little", signed=True), int.from_bytes(h[8:], "little", signed=True)


def _classes(width: int):
    def run(batches):
        for batch in batches:
            found = [(i, *word_class(w)) for i, t in zip(column(batch, "_id"), texts(batch), strict=True) if len(w := t.split()) >= width]
            yield record_batch(_CLASS, *zip(*found, strict=True)) if found else record_batch(_CLASS, [], [], [])

    return run


def anchors(w: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of half a window, and for each window where its anchor starts."""
    k = max(1, width // 2)
    h = rolling(w, k, ANCHOR_BASE)
    at = sliding_window_view(h, width - k + 1).argmin(axis=1)
    return h, at + np.arange(len(at))


def _by_id(rec: np.ndarray, n_buckets: int):
    """The places of records, packed by buckets of their ids."""
    if len(rec):
        place = np.empty(len(rec), _PLACE)
        place["id"], place["pos"] = rec["id"], rec["pos"] & ~REPEATED
        yield from scattered((fmix(rec["id"].view(np.uint64)) % np.uint64(n_buckets)).astype(np.int64), place)


def _route(rec: np.ndarray, n_buckets: int):
    """Of equal keys, the earliest goes to the key's bucket; the others are known to repeat and go on by their id."""
    rec = rec[np.lexsort((rec["pos"] & ~REPEATED, rec["id"], rec["key"]))]
    first = np.concatenate(([True], rec["key"][1:] != rec["key"][:-1]))
    alone = np.concatenate((first[1:], [True]))
    rest = rec[~first]
    sent = rec[first]
    sent["pos"] |= np.where(alone[first], np.uint32(0), REPEATED)
    rows = [(b, False, x) for b, x in scattered((sent["key"] >> np.uint64(40)).astype(np.int64) % n_buckets, sent)]
    rows += [(b, True, x) for b, x in _by_id(rest, n_buckets)]
    for i in range(0, len(rows), 2048):
        yield record_batch(_ROUTED, *zip(*rows[i : i + 2048], strict=True))


def _emit(width: int, n_buckets: int, whole: bool):
    """whole: records of the windows whose anchor is among the positions that repeat; else of the anchors."""

    def records(w: np.ndarray, i: int, hits) -> np.ndarray:
        h, at = anchors(w, width)
        if whole:
            starts = np.flatnonzero(np.isin(at, hits))
            windows = rolling(w, width, WINDOW_BASE)[starts]
            rec = np.empty(len(starts), _ANCHOR)
            rec["key"], rec["pos"] = fmix(windows ^ fmix(h[at[starts]] + np.uint64(1))), starts
        else:
            at = np.unique(at)
            rec = np.empty(len(at), _ANCHOR)
            rec["key"], rec["pos"] = h[at], at
        rec["id"] = i
        return rec

    def run(batches):
        hashes, seen, held, size = WordHash(), set(), [], 0
        for batch in batches:
            extra = column(batch, "hits") if whole else column(batch, "skip")
            for i, t, x in zip(column(batch, "_id"), texts(batch), extra, strict=True):
                words = t.split()
                if len(words) < width:
                    continue
                c = word_class(words)
                if (i, c) in seen or (not whole and x and c[0] in x):
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add((i, c))
                hits = np.frombuffer(x, "<u4") if whole else None
                held.append(records(hashes.of(words), i, hits))
                size += len(held[-1])
                if size > FLUSH_RECORDS:
                    yield from _route(np.concatenate(held), n_buckets)
                    held, size = [], 0
        if size:
            yield from _route(np.concatenate(held), n_buckets)

    return run


def _repeats(every: bool, n_buckets: int):
    """Places that repeat, packed by buckets of ids. every: all of equal keys; else all but the earliest."""

    def run(batches):
        parts = []
        for batch in batches:
            known = column(batch, "known")
            parts += [np.frombuffer(x, _ANCHOR) for k, x in zip(known, column(batch, "blob"), strict=True) if not k]
            if any(known):
                part = batch.filter(pa.array(known))
                yield record_batch(_PLACES, column(part, "bucket"), column(part, "blob"))
        if parts:
            rec = np.concatenate(parts)
            del parts
            key = np.sort(rec["key"])
            twice = np.unique(key[1:][key[1:] == key[:-1]])
            at = np.minimum(np.searchsorted(twice, rec["key"]), max(0, len(twice) - 1))
            shared = twice[at] == rec["key"] if len(twice) else np.zeros(len(rec), bool)
            if every:
                rec = rec[shared | (rec["pos"] >= REPEATED)]
            else:
                rec = rec[shared]
                rec = rec[np.lexsort((rec["pos"] & ~REPEATED, rec["id"], rec["key"]))]
                later = np.concatenate(([False], rec["key"][1:] == rec["key"][:-1])) if len(rec) else np.zeros(0, bool)
                # a key of one document and start, in rows that repeat, isn't later than itself
                later[1:] &= ~_all_equal_to_first(rec)[1:] if len(rec) else later[1:]
                rec = rec[later]
            rows = list(_by_id(rec, n_buckets))
            for i in range(0, len(rows), 2048):
                yield record_batch(_PLACES, *zip(*rows[i : i + 2048], strict=True))

    return run


def _gathered(width: int | None):
    """One row per id with its places; with a width, with the intervals of words that windows there cover."""

    def run(batches):
        parts = [np.frombuffer(x, _PLACE) for batch in batches for x in column(batch, "blob")]
        if not parts:
            return
        rec = np.concatenate(parts)
        del parts
        rows = []
        for i, x in scattered(rec["id"], rec["pos"]):
            rows.append((i, intervals(np.frombuffer(x, "<u4").astype(np.int64), width).astype("<u4").tobytes() if width else x))
        for i in range(0, len(rows), 4096):
            yield record_batch(_HITS, *zip(*rows[i : i + 4096], strict=True))

    return run


def _all_equal_to_first(rec: np.ndarray) -> np.ndarray:
    """Whether each record, sorted by key, starts where the first of its key starts, in the same document."""
    first = np.concatenate(([True], rec["key"][1:] != rec["key"][:-1]))
    lead = np.maximum.accumulate(np.where(first, np.arange(len(rec)), 0))
    return (rec["id"] == rec["id"][lead]) & ((rec["pos"] & ~REPEATED) == (rec["pos"][lead] & ~REPEATED))


def intervals(starts: np.ndarray, width: int) -> np.ndarray:
    """Maximal intervals of words (first, end) that windows at these starts cover."""
    starts = np.unique(starts)
    gap = np.flatnonzero(np.diff(starts) > width) + 1
    return np.stack((starts[np.concatenate(([0], gap)).astype(int)], starts[np.append(gap, len(starts)) - 1] + width), axis=1)


def _finish(width: int):
    def run(batches):
        for batch in batches:
            out = [[] for _ in range(4)]
            for i, t, cover, skip in zip(*(column(batch, "_id"), texts(batch), column(batch, "blob"), column(batch, "skip")), strict=True):
                words = t.split()
                kept, n = words, len(words)
                if n >= width and skip and word_class(words)[0] in skip:
                    kept = []
                elif cover:
                    kept, last = [], 0
                    for lo, hi in np.frombuffer(cover, "<u4").reshape(-1, 2).tolist():
                        kept += words[last:lo]
                        last = hi
                    kept += words[last:]
                for c, x in zip(out, (i, n, n - len(kept), b" ".join(kept).decode("utf-8", "replace")), strict=True):
                    c.append(x)
            yield record_batch(_DONE, *out)

    return run


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 20) -> DataFrame:
    """One row per document: id, n_words, n_removed, kept (the words left, joined by one space).

    A word goes if a window of width words covers it whose words also start earlier: in a document of smaller id, or in
    the same one. A null or empty text has no words; texts under width words lose none. A null id is larger than all
    others. Repeated rows count once and all keep what the first keeps; rows of one id with different texts are one
    document at that id's place, told apart only by where a window starts. Other columns are ignored.
    """
    if width < 2:
        raise ValueError("a window has two words or more")
    spark, docs = df.sparkSession, keyed(df, id_col, text_col)
    n = buckets(spark)
    classes = cut(arrow_map(docs, _classes(width), "_id long, t1 long, t2 long"))
    least = classes.groupBy("t1", "t2").agg(F.min("_id").alias("first"))
    copies = classes.join(least, ["t1", "t2"]).where(F.col("_id") > F.col("first"))
    skip = cut(copies.groupBy("_id").agg(F.collect_set("t1").alias("skip")))
    docs = attach(docs, skip, "_id", size=F.size("skip") * 8)

    found = arrow_map(docs, _emit(width, n, False), ROUTED).repartition("bucket")
    places = arrow_map(found, _repeats(True, n), PLACES).repartition("bucket")
    hits = cut(arrow_map(places, _gathered(None), HITS).withColumnRenamed("blob", "hits"))
    near = attach(docs, hits, "_id", "inner", size=F.length("hits"))
    windows = arrow_map(near, _emit(width, n, True), ROUTED).repartition("bucket")
    places = arrow_map(windows, _repeats(False, n), PLACES).repartition("bucket")
    cover = cut(arrow_map(places, _gathered(width), HITS))
    done = arrow_map(attach(docs, cover, "_id", size=F.length("blob")), _finish(width), "_id long, n_words long, n_removed long, kept string")
    return done.select(public_id().alias(id_col), "n_words", "n_removed", "kept")
