"""Line-first quality rules: judge every line, drop the failures, reject documents that lose too much."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from lodestack.llm.common import WordHash, arrow_map, column, keyed, public_id, record_batch, rolling, texts

SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOLS = bytes(b for b in range(256) if b not in SYMBOLS)
#: A line fails if this share of its words end in marks that prose hardly doubles.
MARKED_SHARE = 0.3
#: It fails as navigation if this share of its words are separators or menu words.
NAVIGATION_SHARE = 0.2
#: Documents that lose more than this share of their words are rejected.
LOSS_SHARE = 0.5
_MARKED = re.compile(rb"(?:!!+|\?\?+|[#*$%&~^=_]{2,})\.?$|^[#*$%&~^=_]{2,}")
_SEPARATORS = {b"|", b"||", b">", b">>", b"\xc2\xbb", b"\xe2\x80\xba", b"\xc2\xb7", b"\xe2\x80\xa2"}
_MENU = {b"home", b"login", b"menu", b"sitemap", b"contact", b"next", b"previous"}
_BOILERPLATE = re.compile(rb"(?i)lorem ipsum|enable javascript|use of cookies|cookie policy|privacy policy|all rights reserved|terms of (?:use|service)")

_STATS = pa.schema([("_id", pa.int64()), *((n, pa.int64()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lost")), ("base_failed", pa.bool_()), ("kept", pa.bool_()), ("cleaned", pa.string())])
_DDL = "_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost long, base_failed boolean, kept boolean, cleaned string"


def line_fails(line: bytes, words: list[bytes]) -> str | None:
    """The rule that a line with words fails, if any: punctuation, navigation or boilerplate."""
    n = len(words)
    if sum(c in line for c in (b"!!", b"??", b"**", b"##", b"$$", b"%%", b"&&", b"==", b"__", b"~~", b"^^")) and sum(1 for w in words if _MARKED.search(w)) > MARKED_SHARE * n:
        return "punctuation"
    if sum(1 for w in words if w in _SEPARATORS or w.lower() in _MENU) > NAVIGATION_SHARE * n and n > 1:
        return "navigation"
    if _BOILERPLATE.search(line):
        return "boilerplate"
    return None


def repeated_words(w: np.ndarray) -> int:
    """Words in three-word windows that are found twice or more."""
    if len(w) < 4:
        return 0
    h = rolling(w, 3, 0x9E3779B97F4A7C15)
    order = np.argsort(h, kind="stable")
    same = h[order][1:] == h[order][:-1]
    twice = np.zeros(len(h), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(w), bool)
    for k in range(3):
        covered[k : len(h) + k] |= twice
    return int(covered.sum())


def judge(text: bytes, hashes: WordHash) -> tuple:
    """Statistics of one text, whether it fails the base rules, whether it is kept, and its text without failed lines."""
    words = text.split()
    n = len(words)
    gaps = len(text) - sum(map(len, words))
    chars = len(text) - gaps - len(re.findall(rb"[\x80-\xbf]", text)) if not text.isascii() else len(text) - gaps
    symbols = len(text.translate(None, _NOT_SYMBOLS))
    lines, seen, dup, lost, kept = text.split(b"\n"), set(), 0, 0, []
    for line in lines:
        own = line.split()
        if own:
            dup += line in seen
            seen.add(line)
            if line_fails(line, own):
                lost += len(own)
                continue
        kept.append(line)
    repeats = repeated_words(hashes.of(words))
    failed = n < 50 or 100 * repeats > 50 * n
    return n, chars, symbols, dup, repeats, lost, failed, not failed and lost <= LOSS_SHARE * n, b"\n".join(kept).decode("utf-8", "replace")


def _judged(cleaned: bool):
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            got = [judge(t, hashes) for t in texts(batch)]
            if not cleaned:
                got = [(*g[:-1], None) for g in got]
            yield record_batch(_STATS, column(batch, "_id"), *(zip(*got, strict=True) if got else [[]] * 9))

    return run


def quality_lines(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", cleaned: bool = True) -> DataFrame:
    """One row per document: statistics, base_failed, kept, n_lost (words of failed lines) and the cleaned text.

    A null or empty text has no words and fails. Whole texts are judged whatever their length; repeated rows alike; null
    ids stay. Other columns are ignored.
    """
    done = arrow_map(keyed(df, id_col, text_col), _judged(cleaned), _DDL)
    return done.select(public_id().alias(id_col), *done.columns[1:])


def _filtered(at: int, length_at: int | None):
    def run(batches):
        hashes = WordHash()
        for batch in batches:
            raw = [x or b"" for x in batch.column(at).cast(pa.binary()).to_pylist()]
            got = [judge(t, hashes) for t in raw]
            keep = [k for k, g in enumerate(got) if g[-2]]
            part = batch.take(pa.array(keep, pa.int64()))
            columns = list(part.columns)
            text = [got[k][-1] for k in keep]
            columns[at] = pa.array(text, columns[at].type)
            if length_at is not None:
                columns[length_at] = pa.array([len(x) for x in text], columns[length_at].type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return run


def clean_documents(df: DataFrame, text_col: str = "text", length_col: str | None = "n_chars") -> DataFrame:
    """The rows of df that are kept, with their cleaned text (and its length in characters, if df has such a column).

    A null or empty text has no words and is rejected. Repeated rows are judged alike, null ids stay, other columns pass
    through. An empty table gives an empty one.
    """
    length = df.columns.index(length_col) if length_col in df.columns else None
    return arrow_map(df, _filtered(df.columns.index(text_col), length), df.schema)
