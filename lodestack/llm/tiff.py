"""TIFF media columns: a reader of image directories (PackBits, LZW, deflate; strips, tiles; predictors) and a writer."""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.bpe import slices
from lodestack.llm.common import arrow_map, column, keyed, public_id, record_batch, texts

# Fixed values of the TIFF 6.0 specification.
WIDTH, LENGTH, BITS, COMPRESSION, PHOTOMETRIC, STRIP_OFFSETS, SAMPLES, ROWS, STRIP_BYTES = 256, 257, 258, 259, 262, 273, 277, 278, 279
PLANAR, PREDICTOR, TILE_WIDTH, TILE_LENGTH, TILE_OFFSETS, TILE_BYTES, SAMPLE_FORMAT, FILL_ORDER = 284, 317, 322, 323, 324, 325, 339, 266
NONE, LZW, DEFLATE, OLD_DEFLATE, PACKBITS = 1, 5, 8, 32946, 32773
TYPES = {1: "B", 2: "c", 3: "H", 4: "I", 6: "b", 8: "h", 9: "i", 11: "f", 12: "d"}

#: Most bytes of pixels that one page may hold; larger pages are reported as errors, not decoded.
MAX_PAGE_BYTES = 1 << 31


def packbits_encode(data: bytes) -> bytes:
    out, i, n = bytearray(), 0, len(data)
    while i < n:
        j = i + 1
        while j < n and j - i < 128 and data[j] == data[i]:
            j += 1
        if j - i > 1:
            out += bytes((257 - (j - i), data[i]))
        else:
            while j < n and j - i < 128 and not (j + 1 < n and data[j] == data[j + 1]):
                j += 1
            out.append(j - i - 1)
            out += data[i:j]
        i = j
    return bytes(out)


def packbits_decode(data: bytes, size: int) -> bytes:
    out, i = bytearray(), 0
    while len(out) < size:
        head = data[i]
        if head < 128:
            out += data[i + 1 : i + 2 + head]
            i += head + 2
        else:
            if head > 128:
                out += data[i + 1 : i + 2] * (257 - head)
            i += 2 if head > 128 else 1
    return bytes(out[:size])


def lzw_encode(data: bytes) -> bytes:
    bits, held, out = 0, 0, bytearray()
    table, width, word = {}, 9, b""

    def put(code: int) -> None:
        nonlocal bits, held
        held, bits = held << width | code, bits + width
        while bits >= 8:
            bits -= 8
            out.append(held >> bits & 255)
        held &= (1 << bits) - 1

    code = lambda w: w[0] if len(w) == 1 else table[w]
    put(256)
    for b in data:
        more = word + bytes((b,))
        if len(more) == 1 or more in table:
            word = more
            continue
        put(code(word))
        table[more] = 258 + len(table)
        if len(table) + 258 >= 1 << width and width < 12:
            width += 1
        if len(table) + 258 >= 4094:
            put(256)
            table, width = {}, 9
        word = bytes((b,))
    if word:
        put(code(word))
        if 258 + len(table) >= (1 << width) - 1 and width < 12:
            width += 1
    put(257)
    if bits:
        out.append(held << (8 - bits) & 255)
    return bytes(out)


def lzw_decode(data: bytes, size: int) -> bytes:
    base = [bytes((i,)) for i in range(256)] + [b"", b""]
    table, width, last = list(base), 9, b""
    held = bits = 0
    out, made = [], 0
    for b in data:
        held, bits = held << 8 | b, bits + 8
        if bits < width:
            continue
        bits -= width
        code, held = held >> bits, held & ((1 << bits) - 1)
        if code == 257:
            break
        if code == 256:
            table, width, last = list(base), 9, b""
            continue
        if code > len(table) or code == len(table) and not last:
            raise ValueError("LZW code outside the table")
        word = table[code] if code < len(table) else last + last[:1]
        out.append(word)
        made += len(word)
        if last:
            table.append(last + word[:1])
        last = word
        if len(table) >= (1 << width) - 1 and width < 12:
            width += 1
        if made >= size:
            break
    return b"".join(out)[:size]


def _unpack(data: bytes, how: int, size: int) -> bytes:
    if how == NONE:
        return data[:size]
    if how in (DEFLATE, OLD_DEFLATE):
        return zlib.decompressobj().decompress(data, size) if size else b""
    if how == LZW:
        return lzw_decode(data, size)
    if how == PACKBITS:
        return packbits_decode(data, size)
    raise ValueError(f"compression {how}")


def write_tiff(pages: list[np.ndarray], compression: int = DEFLATE, predictor: int = 1, rows_per_strip: int | None = None, tile: tuple[int, int] | None = None, order: str = "<", level: int = 6) -> bytes:
    """Little- or big-endian TIFF of pages of 8- or 16-bit samples, (rows, columns) or (rows, columns, samples)."""
    pack = {NONE: bytes, LZW: lzw_encode, PACKBITS: packbits_encode, DEFLATE: lambda x: zlib.compress(x, level), OLD_DEFLATE: lambda x: zlib.compress(x, level)}[compression]
    out = bytearray((b"II" if order == "<" else b"MM") + struct.pack(order + "HI", 42, 8))
    link = 4
    for page in pages:
        page = page[:, :, None] if page.ndim == 2 else page
        h, w, s = page.shape
        rows = rows_per_strip or h or 1
        size = tile or (rows, w)
        blocks = []
        for y in range(0, h, size[0]):
            for x in range(0, w, size[1]):
                block = page[y : y + size[0], x : x + size[1]]
                if tile:
                    block = np.pad(block, ((0, size[0] - block.shape[0]), (0, size[1] - block.shape[1]), (0, 0)))
                if predictor == 2:
                    block = np.concatenate((block[:, :1], np.diff(block, axis=1)), axis=1)
                blocks.append(pack(block.astype(block.dtype.newbyteorder(order)).tobytes()))
        offsets = []
        for b in blocks:
            offsets.append(len(out))
            out += b
            out += b"\0" * (len(out) % 2)
        where, sizes = (TILE_OFFSETS, TILE_BYTES) if tile else (STRIP_OFFSETS, STRIP_BYTES)
        tags = {WIDTH: [w], LENGTH: [h], BITS: [page.dtype.itemsize * 8] * s, COMPRESSION: [compression], PHOTOMETRIC: [2 if s == 3 else 1], where: offsets, SAMPLES: [s], sizes: [len(b) for b in blocks], PLANAR: [1], PREDICTOR: [predictor]}
        tags |= {TILE_WIDTH: [tile[1]], TILE_LENGTH: [tile[0]]} if tile else {ROWS: [rows]}
        entries = []
        for tag, values in sorted(tags.items()):
            kind = 3 if tag in (BITS, COMPRESSION, PHOTOMETRIC, SAMPLES, PLANAR, PREDICTOR) else 4
            raw = struct.pack(f"{order}{len(values)}{TYPES[kind]}", *values)
            if len(raw) > 4:
                at = len(out)
                out += raw + b"\0" * (len(raw) % 2)
                raw = struct.pack(order + "I", at)
            entries.append(struct.pack(order + "HHI", tag, kind, len(values)) + raw.ljust(4, b"\0"))
        struct.pack_into(order + "I", out, link, len(out))
        out += struct.pack(order + "H", len(entries)) + b"".join(entries)
        link = len(out)
        out += b"\0\0\0\0"
    return bytes(out)


def read_pages(data: bytes):
    """Every page as an array (rows, columns, samples), with its tags. Directories that loop end the walk."""
    for tags, order, failed in _directories(data):
        if failed:
            raise failed
        yield _page(data, tags, order), tags


def _directories(data: bytes):
    """The tags of every page, the byte order, and the error if they can't be read."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if not order or struct.unpack_from(order + "H", data, 2)[0] != 42:
        raise ValueError("no TIFF")
    at, seen = struct.unpack_from(order + "I", data, 4)[0], set()
    while at and at not in seen:
        seen.add(at)
        (n,) = struct.unpack_from(order + "H", data, at)
        tags, failed = {}, None
        try:
            for k in range(n):
                tag, kind, count = struct.unpack_from(order + "HHI", data, at + 2 + 12 * k)
                if kind in TYPES:
                    form = f"{order}{count}{TYPES[kind]}"
                    here = at + 10 + 12 * k
                    tags[tag] = struct.unpack_from(form, data, here if struct.calcsize(form) <= 4 else struct.unpack_from(order + "I", data, here)[0])
        except struct.error as e:
            failed = e
        if not failed:
            yield tags, order, None
        (at,) = struct.unpack_from(order + "I", data, at + 2 + 12 * n)
        if failed:
            yield tags, order, failed


def _samples(rows: np.ndarray, bits: int) -> np.ndarray:
    """Samples of 1, 2 or 4 bits, the highest bits first; every row starts a byte."""
    shifts = np.arange(8 - bits, -1, -bits, dtype=np.uint8)
    return ((rows[:, :, None] >> shifts) & np.uint8((1 << bits) - 1)).reshape(len(rows), -1)


def _floats(rows: np.ndarray, stride: int, size: int) -> np.ndarray:
    """Undo predictor 3: differences of bytes, and of each row first the highest bytes of all samples, then the next."""
    planes = np.cumsum(rows.reshape(len(rows), -1, stride), axis=1, dtype=np.uint8).reshape(len(rows), size, -1)
    return np.ascontiguousarray(planes.transpose(0, 2, 1)).view(f">f{size}")


def _page(data: bytes, tags: dict, order: str) -> np.ndarray:
    one = lambda tag, default: tags.get(tag, (default,))[0]
    w, h, s = one(WIDTH, 0), one(LENGTH, 0), one(SAMPLES, 1)
    bits, how, predictor = tags.get(BITS, (1,)), one(COMPRESSION, NONE), one(PREDICTOR, 1)
    real, small = one(SAMPLE_FORMAT, 1) == 3, bits[0] < 8
    if len(set(bits)) != 1 or bits[0] not in ((16, 32) if real else (1, 2, 4, 8, 16, 32)) or predictor not in ((1,) if small else (1, 2, 3) if real else (1, 2)):
        raise ValueError("unsupported samples")
    if small and one(FILL_ORDER, 1) != 1:
        raise ValueError("unsupported fill order")
    kind = np.dtype(f"{order}{'f' if real else 'u'}{max(bits[0], 8) // 8}")
    planes = s if one(PLANAR, 1) == 2 else 1
    own = s // planes
    if h * w * s * kind.itemsize > MAX_PAGE_BYTES:
        raise ValueError("page too large")
    page = np.zeros((h, w, s), kind.newbyteorder("="))
    tiled = TILE_OFFSETS in tags
    bh, bw = (one(TILE_LENGTH, h), one(TILE_WIDTH, w)) if tiled else (min(one(ROWS, h), h) or 1, w)
    offsets, sizes = (tags[TILE_OFFSETS], tags[TILE_BYTES]) if tiled else (tags.get(STRIP_OFFSETS, ()), tags.get(STRIP_BYTES, ()))
    across, down = -(-w // bw) if w else 0, -(-h // bh) if h else 0
    for k, (at, size) in enumerate(zip(offsets, sizes, strict=True)):
        plane, place = divmod(k, across * down)
        y, x = place // across * bh, place % across * bw
        rows = bh if tiled else min(bh, h - y)
        raw = _unpack(data[at : at + size], how, rows * -(-bw * own * bits[0] // 8))
        if small:
            block = _samples(np.frombuffer(raw, np.uint8).reshape(rows, -1), bits[0])[:, : bw * own].reshape(rows, bw, own)
        elif predictor == 3:
            block = _floats(np.frombuffer(raw, np.uint8).reshape(rows, -1), own, kind.itemsize).reshape(rows, bw, own)
        else:
            block = np.frombuffer(raw, kind).reshape(rows, bw, own)
        if predictor == 2:
            block = np.cumsum(block, axis=1, dtype=kind.newbyteorder("="))
        page[y : y + rows, x : x + bw, plane * own : (plane + 1) * own] = block[: h - y, : w - x]
    return page


_STORED = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary())])
_PAGES = pa.schema([("_id", pa.int64()), ("page", pa.int32()), ("width", pa.int32()), ("height", pa.int32()), ("samples", pa.int32()), ("pixels", pa.binary()), ("feature", pa.string()), ("error", pa.string())])
PAGES = "_id long, page int, width int, height int, samples int, pixels binary, feature string, error string"


def _stored(width: int, compression: int, predictor: int, rows: int):
    def run(batches):
        for batch in batches:
            raw, names = texts(batch), column(batch, "_id")
            for lo, hi in slices(raw, 2 << 20):
                media = []
                for t in raw[lo:hi]:
                    page = np.frombuffer(t + b"\0" * (-len(t) % width if t else width), np.uint8).reshape(-1, width)
                    media.append(write_tiff([page], compression, predictor, rows, level=1))
                yield record_batch(_STORED, names[lo:hi], [len(t) for t in raw[lo:hi]], media)

    return run


def feature(page: np.ndarray) -> str:
    """Mean, deviation and entropy of the samples, and a 64-bit difference hash of an 8 x 8 reduction."""
    if not page.size:
        return "empty"
    flat = page.reshape(page.shape[0], -1)
    counts = np.bincount(flat.ravel().astype(np.uint8), minlength=256)
    p = counts[counts > 0] / flat.size
    rows = np.minimum(np.arange(9) * flat.shape[0] // 8, flat.shape[0] - 1)
    grid = flat[rows[:8]][:, (np.arange(9) * (flat.shape[1] - 1) // 8)].astype(np.int64)
    bits = np.packbits((grid[:, 1:] > grid[:, :-1]).ravel()).tobytes().hex()
    return f"mean={flat.mean():.3f};dev={flat.std():.3f};entropy={-(p * np.log2(p)).sum():.3f};dhash={bits}"


def _rows(i, media: bytes | None):
    """One row per page, with the error of one that can't be read; such a row also ends a file whose next page isn't found."""
    k = 0
    wrong = lambda e: (i, k, None, None, None, None, None, f"{type(e).__name__}: {e}")
    try:
        for tags, order, failed in _directories(media or b""):
            try:
                if failed:
                    raise failed
                page = _page(media, tags, order)
                row = i, k, page.shape[1], page.shape[0], page.shape[2], page.tobytes(), feature(page), None
            except (ValueError, KeyError, IndexError, ZeroDivisionError, struct.error, zlib.error) as e:
                row = wrong(e)
            yield row
            k += 1
    except (ValueError, struct.error) as e:
        yield wrong(e)


def _walk(batches):
    for batch in batches:
        held, size = [], 0
        for i, media in zip(column(batch, "_id"), column(batch, "media"), strict=True):
            for row in _rows(i, media):
                held.append(row)
                size += len(row[5] or b"") + 64
                if size > 4 << 20:
                    yield record_batch(_PAGES, *zip(*held, strict=True))
                    held, size = [], 0
        if held:
            yield record_batch(_PAGES, *zip(*held, strict=True))


def tiff_pages(df: DataFrame, id_col: str = "_id", media_col: str = "media") -> DataFrame:
    """One row per page of every TIFF: id, page, width, height, samples, pixels (row by row), feature, error.

    A page that can't be read gives one row with the error, and so does a file (null and empty ones too) whose next page
    isn't found. A page of more than MAX_PAGE_BYTES (2 GiB, what a cell of a row can hold) unpacked is such an error; samples are
    whole numbers of 1 to 32 bits or floats of 16 or 32. Repeated rows give repeated pages. Other columns are ignored.
    """
    return arrow_map(df.select(F.col(id_col).alias("_id"), F.col(media_col).alias("media")), _walk, PAGES)


def store_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 64, compression: int = DEFLATE, predictor: int = 2, rows_per_strip: int = 1024) -> DataFrame:
    """(_id, n_bytes, media): the UTF-8 of every text, padded by zero bytes to full rows (one at least), as a TIFF page.

    A null or empty text is one row of zero bytes, with n_bytes 0. Texts up to MAX_PAGE_BYTES fit. Repeated rows give equal
    media, null ids stay (as NO_ID until media_digests), other columns are ignored. No rows give no rows.
    """
    return arrow_map(keyed(df, id_col, text_col), _stored(width, compression, predictor, rows_per_strip), "_id long, n_bytes long, media binary")


def _round(batches):
    """Pages of each stored text beside what was stored."""
    for batch in batches:
        out = [[] for _ in _DIGEST]
        for i, n, media in zip(*(column(batch, c) for c in ("_id", "n_bytes", "media")), strict=True):
            pages = list(_rows(i, media))
            if error := next((p[-1] for p in pages if p[-1]), None):
                raise ValueError(error)
            pixels = b"".join(p[5] for p in pages)
            row = i, n, len(pixels), hashlib.sha256(pixels).hexdigest(), zlib.crc32(pixels[-64:]), len(media), hashlib.sha256(media).hexdigest(), f"pages={len(pages)};" + ";".join(p[6] for p in pages)
            for c, x in zip(out, row, strict=True):
                c.append(x)
        yield record_batch(_DIGEST, *out)


_DIGEST = pa.schema([("_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())])


def media_digests(stored: DataFrame) -> DataFrame:
    """Digests of the pages that tiff_pages reads from stored texts; each text and its pages stay in one task.

    One row per row of store_texts, repeated and null ids included; a page that can't be read ends the job with its error.
    """
    ddl = "_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"
    return arrow_map(stored, _round, ddl).withColumn("_id", public_id())
