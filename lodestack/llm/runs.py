"""Periodic runs of words after Ellert and Fischer (2021): Lyndon arrays on an ordered alphabet, no suffix structures or hashes.

A run's Lyndon root is, for one of the two orders of the words, the longest Lyndon word at its start, so every run shows as
a position i and its next smaller suffix j: the period is j - i. Words are only compared with each other. The common
extensions of i and j are found while the suffixes are compared. An extension that lies within an earlier match is read off the
edge that the match copies; only what goes beyond the earlier match is compared, so matched words are not read again.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.common import arrow_map, column, keyed, public_id, record_batch, texts

RUN = "struct<start: bigint, length: bigint, period: bigint>"
_OUT = pa.schema([("_id", pa.int64()), ("n_words", pa.int64()), ("runs", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))), ("collapsed", pa.string())])


def next_smaller(w: list, up: bool) -> tuple[list[int], list[int]]:
    """For each position, that of the next smaller suffix (len(w): none), and how far both suffixes agree.

    up: the order of the words, else the reverse; the end is smaller than all words in both.
    """
    n = len(w)
    after, agree, before, agreed = [n] * n, [0] * n, [-1] * n, [0] * n
    # w[y:end] equals w[y - d : end - d], the match that reaches furthest
    y = end = d = 0
    for i in range(1, n):
        j, b, least = i - 1, w[i], -1
        while True:
            a = w[j]
            if a != b:
                length, smaller = 0, (b < a) is up
            else:
                if least >= 0 and agreed[top] != least:  # noqa: F821 - the suffix just passed tells
                    length, more = min(agreed[top], least), False  # noqa: F821
                else:
                    length, more = max(least, 1), True
                    if i + length < end:
                        p, q = (j - d if j >= y else j), i - d
                        known = -1 if p < 0 or p >= q else agree[p] if after[p] == q else agreed[q] if before[q] == p else -1
                        if known >= 0:
                            more = known >= end - i
                            length = end - i if more else known
                if more:
                    x, z = j + length, i + length
                    while z < n and w[x] == w[z]:
                        x += 1
                        z += 1
                    length = z - i
                    if z > end:
                        y, end, d = i, z, i - j
                smaller = i + length == n or (w[i + length] < w[j + length]) is up
            if not smaller:
                before[i], agreed[i] = j, length
                break
            after[j], agree[j] = i, length
            top, least = j, length
            j = before[j]
            if j < 0:
                break
    return after, agree


def runs_of(w: list, shortest: int = 12) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of at least max(shortest, 2 * period) words, by start, then period."""
    found = set()
    for up in (True, False):
        after, agree = next_smaller(w, up)
        back = {}
        # w[start:stop] equals w[start + d : stop + d], the match that reaches furthest to the left
        start, stop, d = len(w), len(w), 0
        for i in range(len(w) - 1, -1, -1):
            if not agree[i]:  # the first root of a run is followed by a word of the next
                continue
            j, length, more = after[i], 0, True
            if start < i <= stop and after[i + d] == j + d:
                known = back.get(i + d, -1)
                if known >= 0:
                    more = known >= i - start
                    length = i - start if more else known
            if more:
                x, z = i - 1 - length, j - 1 - length
                while x >= 0 and w[x] == w[z]:
                    x -= 1
                    z -= 1
                length = i - 1 - x
                if x + 1 < start:
                    start, stop, d = x + 1, i, j - i
            back[i] = length
            p = j - i
            whole = length + p + agree[i]
            if whole >= 2 * p and whole >= shortest:
                found.add((i - length, whole, p))
    return sorted(found, key=lambda r: (r[0], r[2]))


def collapsed(w: list, runs: list[tuple[int, int, int]]) -> list:
    """The words that no run holds after its first period."""
    if not runs:
        return w
    out, at, gone = [], 0, sorted((s + p, s + n) for s, n, p in runs)
    for lo, hi in gone:
        if hi > at:
            out += w[at : max(at, lo)]
            at = hi
    return out + w[at:]


def _found(batches: Iterator[pa.RecordBatch], shortest: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for i, text in zip(column(batch, "_id"), texts(batch), strict=True):
            w = text.split()  # bytes: ASCII white space alone
            runs = runs_of(w, shortest)
            rows.append((i, len(w), [{"start": s, "length": n, "period": p} for s, n, p in runs], b" ".join(collapsed(w, runs)).decode()))
        yield record_batch(_OUT, *zip(*rows, strict=True) if rows else ([], [], [], []))


def periodic_runs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shortest: int = 12) -> DataFrame:
    """One row per document: id, n_words, runs (array of start, length, period by start, then period), collapsed.

    A run is a stretch of consecutive words of smallest period p, at least max(shortest, 2 * p) words long, that can't be made
    longer. collapsed: the words, joined by one space, without those that a run holds after its first p words. A null
    or empty text, or one of white space, has no words, no runs and an empty collapsed text. Repeated rows and null ids are rows
    of their own; other columns are ignored. A text is treated whole by one worker, in time and memory linear in it.
    """
    done = arrow_map(keyed(df, id_col, text_col), lambda batches: _found(batches, shortest), f"_id bigint, n_words bigint, runs array<{RUN}>, collapsed string")
    return done.select(public_id().alias(id_col), "n_words", "runs", "collapsed")
