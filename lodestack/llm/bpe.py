"""Byte-level BPE over Arrow batches with the tokenizers library; decoding by the byte table."""

from __future__ import annotations

import base64
import functools
import json
import os
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import arrow_map, column, keyed, public_id, record_batch, texts

#: Units whose ids a worker remembers (up to twice as many), and the bytes of the longest of them.
CACHE, CHUNK = 320_000, 48
#: Bytes of texts or ids that are worked on at once.
SLICE = 1 << 20
#: The pattern of the public tokenizers, also that of the library's ByteLevel. Its matches end where the class of characters changes.
_CLASSES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Classes of bytes: unknown, space, other white space, letter, digit, ASCII mark, apostrophe, end of a text (a byte that UTF-8 never has).
_ODD, _SPACE, _WHITE, _LETTER, _DIGIT, _MARK, _QUOTE, _END = range(8)
#: Letters that every Unicode version knows, as UTF-8: ASCII, and U+00C0 to U+024F without the signs of times and division.
_LETTERS = rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|[\xc4-\xc8][\x80-\xbf]|\xc9[\x80-\x8f])+"
#: Units that are one match: of any pattern with a space and letters as one, and of the classes.
_PLAIN, _PLAIN_CLASS = re.compile(rb" " + _LETTERS), re.compile(rb" ?(?:" + _LETTERS + rb"|[0-9]+|[!-&(-/:-@\[-`{-~]+)")
_NO, _CUT, _IF_KNOWN = range(3)


def _byte_classes() -> np.ndarray:
    of = np.full(256, _ODD, np.uint8)
    of[33:127] = _MARK
    of[[*range(65, 91), *range(97, 123)]] = _LETTER
    of[48:58] = _DIGIT
    of[39], of[32], of[[9, 10, 13]], of[255] = _QUOTE, _SPACE, _WHITE, _END
    return of


def _cuts(classes: bool) -> np.ndarray:
    """Whether a unit begins between a byte of class a and one of class b, at 8 * a + b; _IF_KNOWN: if the next one is known and not white.

    White space before other characters begins a match: of it alone, or with them if it is a space. What is unknown may be
    white space, a letter or neither, so nothing begins beside it but such a space.
    """
    known, marks = {_LETTER, _DIGIT, _MARK, _QUOTE}, {_MARK, _QUOTE}
    of = np.full((8, 8), _NO, np.uint8)
    for a in range(_END):
        for b in range(_END):
            if not classes:
                of[a, b] = _IF_KNOWN if b == _SPACE else _NO
            elif b in (_SPACE, _WHITE):
                of[a, b] = _CUT if a in known else _IF_KNOWN
            elif b in known:
                of[a, b] = _CUT if a == _WHITE or (a in known and a != b and not {a, b} <= marks and (a, b) != (_QUOTE, _LETTER)) else _NO
    of[_END], of[:, _END] = _CUT, _CUT
    return of.ravel()


_BYTE_CLASSES = _byte_classes()


def unit_starts(joined: bytes, cuts: np.ndarray) -> np.ndarray:
    """Where units begin in texts that each end with the byte 255. Matches lie within units, and units split as they do in their text."""
    data = np.frombuffer(joined, np.uint8)
    of = _BYTE_CLASSES[data]
    at = np.flatnonzero((data >= 0xC3) & (data <= 0xC9))  # first of two bytes each
    lead, last = data[at], data[at + 1]
    at = at[~((lead == 0xC3) & ((last == 0x97) | (last == 0xB7)) | (lead == 0xC9) & (last > 0x8F))]
    of[at], of[at + 1] = _LETTER, _LETTER
    cut = cuts[(of[:-1] << 3) | of[1:]]
    starts = np.flatnonzero(cut)
    after = of[np.minimum(starts + 2, len(of) - 1)]
    starts = starts[(cut[starts] == _CUT) | (after >= _LETTER) & (after < _END)] + 1
    return np.concatenate(([0], starts))


@functools.cache
def byte_chars() -> list[str]:
    """The character that stands for each byte: itself if it prints in Latin-1, else the next free one from 256."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b) if b in prints else chr(next(free)) for b in range(256)]


def _merged(token: bytes, ranks: dict[bytes, int], below: int) -> list[bytes]:
    """Parts of a token by all merges of lower rank."""
    parts = [token[i : i + 1] for i in range(len(token))]
    while len(parts) > 1:
        rank, i = min((ranks.get(parts[i] + parts[i + 1], below), i) for i in range(len(parts) - 1))
        if rank >= below:
            break
        parts[i : i + 2] = [parts[i] + parts[i + 1]]
    return parts


def tokenizer_json(ranks: dict[bytes, int], pattern: str) -> str:
    """A tokenizer of the tokenizers library that merges by these ranks within each match of the pattern."""
    chars = byte_chars()
    name = lambda b: "".join(chars[x] for x in b)
    merges = []
    for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
        if len(token) > 1 and len(parts := _merged(token, ranks, rank)) == 2:
            merges.append([name(parts[0]), name(parts[1])])
    split = {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Isolated", "invert": False}
    level = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": False, "use_regex": False}
    model = {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "end_of_word_suffix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": True, "vocab": {name(b): r for b, r in ranks.items()}, "merges": merges}
    return json.dumps({"version": "1.0", "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "Sequence", "pretokenizers": [split, level]}, "post_processor": None, "decoder": level, "model": model})


def read_ranks(path: str) -> dict[bytes, int]:
    """Tokens and ids of a .tiktoken file."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


@functools.cache
def byte_table(path: str) -> list[bytes]:
    """The bytes of every id; the characters of a .json vocabulary are turned back into bytes."""
    if path.endswith(".tiktoken"):
        of = {i: t for t, i in read_ranks(path).items()}
    else:
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        back = {c: b for b, c in enumerate(byte_chars())}
        of = {i: bytes(back[c] for c in t) if all(c in back for c in t) else t.encode() for t, i in vocab.items()}
    return [of.get(i, b"") for i in range(max(of) + 1)]


def decode(path: str, ids: np.ndarray) -> bytes:
    """The bytes of the ids. They may end inside a character; then they are the front of it."""
    return b"".join(map(byte_table(path).__getitem__, ids.tolist()))


class ByteBPE:
    """Encoder and decoder of one vocabulary file (.json of tokenizers, or .tiktoken ranks with a pattern)."""

    def __init__(self, path: str, pattern: str | None = None):
        from tokenizers import Tokenizer, pre_tokenizers

        if path.endswith(".tiktoken"):
            self.tokenizer = Tokenizer.from_str(tokenizer_json(read_ranks(path), pattern))
        else:
            self.tokenizer = Tokenizer.from_file(path)
        self.path, self.table = path, byte_table(path)
        self.lengths = np.array([len(x) for x in self.table], np.int64)
        self.words: dict[bytes, bytes] = {}  # ids of a unit, 4 bytes each
        self.older: dict[bytes, bytes] = {}
        self.mapped = np.array([ord(c) for c in byte_chars()], np.uint32)
        self.mapped[10] = 10  # parts the units of a call
        #: Added tokens, which the library finds anywhere in a text before it splits.
        added = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(added)) if added else None
        setting = json.loads(self.tokenizer.to_str())
        split = setting["pre_tokenizer"] or {}
        own = setting["normalizer"] is None and split.get("type") == "ByteLevel" and split["use_regex"] and not split["add_prefix_space"]
        classes = pattern == _CLASSES if path.endswith(".tiktoken") else own
        self.cuts, self.plain = _cuts(classes), _PLAIN_CLASS if classes else _PLAIN
        self.bare = Tokenizer.from_str(self.tokenizer.to_str())
        self.bare.pre_tokenizer = pre_tokenizers.WhitespaceSplit()

    def encode(self, text: str) -> np.ndarray:
        """Token ids of one text."""
        return self.encode_all([text])[0]

    def encode_all(self, batch: list[str]) -> list[np.ndarray]:
        """Token ids. Texts are cut into units, which the library encodes once each; Arrow tells them apart and puts their ids in place."""
        if not batch:
            return []
        whole = {i: t for i, t in enumerate(batch) if self.added and self.added.search(t)}
        raw = [b"" if i in whole else t.encode() for i, t in enumerate(batch)]
        joined = b"\xff".join((*raw, b""))
        starts = unit_starts(joined, self.cuts)
        edges = np.append(starts, len(joined)).astype(np.int32)
        units = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(edges), pa.py_buffer(joined)]).dictionary_encode()
        ids = pa.array(self._ids(units.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(units.indices)
        ends = np.frombuffer(ids.buffers()[1], np.int64, len(ids) + 1) // 4
        packed = np.frombuffer(ids.buffers()[2] or b"", np.uint32)
        last = ends[np.searchsorted(starts, np.cumsum([len(x) + 1 for x in raw]) - 1)].tolist()
        out = [packed[lo:hi] for lo, hi in zip([0, *last], last, strict=False)]
        for i, x in zip(whole, self._fast([*whole.values()]), strict=True):
            out[i] = np.frombuffer(x, np.uint32)
        return out

    def _ids(self, units: list[bytes]) -> list[bytes]:
        """Ids of distinct units. Those of new ones are remembered, unless they are long."""
        if len(self.words) > CACHE:
            self.words, self.older = {}, self.words
        words, older = self.words, self.older
        found = [*map(words.get, units)]
        plain, others = [], []
        for k, x in enumerate(found):
            if x is None:
                w = units[k]
                if w in older:
                    found[k] = words[w] = older[w]
                elif w == b"\xff":
                    found[k] = b""
                elif len(w) <= CHUNK and self.plain.fullmatch(w):
                    plain.append(k)
                else:
                    others.append(k)
        for many, ids in ((plain, self._plain([units[k] for k in plain])), (others, self._fast([units[k].decode() for k in others]))):
            for k, x in zip(many, ids, strict=True):
                found[k] = x
                if len(units[k]) <= CHUNK:
                    words[units[k]] = x
        return found

    def _plain(self, units: list[bytes], together: int = 4096):
        """Ids of units that are one match each, mapped byte by byte."""
        for i in range(0, len(units), together):
            part = units[i : i + together]
            text = self.mapped[np.frombuffer(b"\n".join(part), np.uint8)].astype("<u4").tobytes().decode("utf-32-le")
            (e,) = self.bare.encode_batch_fast([text], add_special_tokens=False)
            ids = np.array(e.ids, np.uint32)
            last = (4 * (np.searchsorted(np.cumsum(self.lengths[ids]), np.cumsum([len(w) for w in part])) + 1)).tolist()
            packed = ids.tobytes()
            for lo, hi in zip([0, *last], last, strict=False):
                yield packed[lo:hi]

    def _fast(self, batch: list[str]):
        done = self.tokenizer.encode_batch_fast(batch, add_special_tokens=False) if batch else []
        return (np.array(e.ids, np.uint32).tobytes() for e in done)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of the ids."""
        return decode(self.path, ids)

    def decode_text(self, ids: np.ndarray) -> str:
        """Text of the ids; bytes that are no whole character become U+FFFD."""
        return self.decode(ids).decode("utf-8", "replace")

    def offsets(self, text: bytes, ids: np.ndarray) -> np.ndarray:
        """Start and end of every token in characters; a token inside a character spans that whole character."""
        ends = np.cumsum(self.lengths[ids])
        starts = ends - self.lengths[ids]
        lead = (np.frombuffer(text, np.uint8) & 0xC0) != 0x80
        chars = np.concatenate(([0], np.cumsum(lead)))
        first = chars[np.minimum(starts + 1, len(text))] - 1
        return np.stack((first, chars[ends]), axis=1).astype(np.int32)


@functools.cache
def loaded(path: str, pattern: str | None = None) -> ByteBPE:
    """One per worker process. Spark gives a worker one core, so the library starts no threads (each would hold an arena)."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return ByteBPE(path, pattern)


_ENCODED = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary())])
_DECODED = pa.schema([("_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("offsets", pa.binary()), ("decoded", pa.binary())])


def slices(values: list[bytes], limit: int = 4 << 20):
    """Ranges of a batch of a few MB each."""
    lo, size = 0, 0
    for i, x in enumerate(values):
        size += len(x)
        if size > limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(values):
        yield lo, len(values)


def _encode(path: str, pattern: str | None, offsets: bool):
    def run(batches):
        bpe = loaded(path, pattern)
        for batch in batches:
            raw, names = texts(batch), column(batch, "_id")
            for lo, hi in slices(raw, SLICE):
                ids = bpe.encode_all([x.decode("utf-8", "replace") for x in raw[lo:hi]])
                at = [bpe.offsets(t, x).tobytes() if offsets else None for t, x in zip(raw[lo:hi], ids, strict=True)]
                yield record_batch(_ENCODED, names[lo:hi], [len(x) for x in ids], [x.astype("<u4").tobytes() for x in ids], at)

    return run


def _decode(path: str):
    def run(batches):
        for batch in batches:
            ids = column(batch, "ids")
            for lo, hi in slices(ids, SLICE):
                part = batch.slice(lo, hi - lo)
                out = [decode(path, np.frombuffer(x, "<u4")) for x in ids[lo:hi]]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(out, pa.binary())], schema=_DECODED)

    return run


def bpe_encode(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text", offsets: bool = True) -> DataFrame:
    """One row per document: _id, n_tokens, ids (little-endian unsigned 32-bit), offsets (pairs of int32, in characters).

    A null text is empty and gives no tokens. Text of any length is encoded whole. Repeated rows give equal rows; null
    ids stay. Other columns are ignored.
    """
    return arrow_map(keyed(df, id_col, text_col), _encode(path, pattern, offsets), "_id long, n_tokens long, ids binary, offsets binary")


def bpe_decode(encoded: DataFrame, path: str) -> DataFrame:
    """The rows of bpe_encode with their decoded bytes.

    No ids decode to no bytes; ids that end inside a character decode to the front of it. Repeated rows and null ids stay;
    columns other than bpe_encode's are ignored. No rows give no rows.
    """
    return arrow_map(encoded.select("_id", "n_tokens", "ids", "offsets"), _decode(path), "_id long, n_tokens long, ids binary, offsets binary, decoded binary")


def bpe_round_trip(df: DataFrame, path: str, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of the ids and of the decoded bytes of every document."""
    done = bpe_decode(bpe_encode(df, path, pattern, id_col, text_col), path)
    return done.select(public_id().alias(id_col), "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
