"""Exact Jaccard self-join of word n-gram sets by universe partition and the pigeonhole principle.

The universe of shingles is hashed into segments. The number of segments depends on the size band of a set (a power of
two). If two sets are similar, they differ in at most H = (1-t)/(1+t) * (|r|+|s|) shingles; so of segments whose
allowances add up to more than H, one matches. Allowance 0 asks for equal subsets; allowance 1 for subsets that differ in
one shingle at most, found through one-deletion neighbourhoods; shingles that many sets hold get allowance -1: they are
left out of the segments. A set indexes the shortest run of its own non-empty segments that adds up to more than the
largest H of any partner that it meets there. Two sets of neighbouring bands meet in the lower band.

Allowances are dealt by cost, in tiers: a set first takes allowance 0, whose keys are fewest. Only where its rare
segments do not add up, it also indexes segments of allowance 1, which count twice; and where those do not either, single
shingles, the rarest first, as many as a prefix filter needs. Of two sets at least one has enough at the tier where they
meet, so no link is lost. The number of segments of each band and tier is the one of least cost (keys, and expected
chance matches). Every candidate is verified on whole shingle sets.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import FLUSH_RECORDS, NO_ID, arrow_map, attach, buckets, column, cut, fmix, keyed, public_id, record_batch, scattered, texts, word_hashes
from lodestack.llm.components import stars

SIZE_BITS = 20
#: The largest bitmap has 2**16 bits.
SKETCH_BITS = 16
SIZE_MASK = (1 << SIZE_BITS) - 1
#: One text in so many lends its shingles to the statistics of common shingles.
SAMPLE = 16
#: A shingle found in so many sampled sets is common. It steers cost only: any choice gives the same links.
COMMON = 6
COMMON_LIMIT = 2_000_000
#: Cost of a chance match, in keys.
MATCH_COST = 4.0
#: Members of a group that one task compares at once; partners of a member that are tried before the rest are.
BLOCK, FIRST_TRIES = 4096, 3
#: Expected shingles per segment, for the largest sets of a band, that the allocation chooses from.
LOADS = (1.0, 1.5, 2.0, 2.5, 3.0, 4.0, 5.0)
#: Shingles whose keys are made at once, and texts that a task remembers to know copies again.
TOGETHER, REMEMBERED = 1 << 18, 50_000


def shingle_sets(raw: list[bytes], width: int) -> list[np.ndarray]:
    """Sorted distinct 64-bit hashes of the shingles of each text."""
    w, edges = word_hashes([x.lower() for x in raw])
    n = max(0, len(w) - width + 1)
    acc = w[:n].copy()
    for j in range(1, width):
        acc *= np.uint64(0x9E3779B97F4A7C15)
        acc += w[j : n + j]
    acc = fmix(acc)
    out = []
    for lo, hi in itertools.pairwise(edges.tolist()):
        if hi - lo >= width:
            s = np.sort(acc[lo : hi - width + 1])
            fresh = np.concatenate(([True], s[1:] != s[:-1]))
            out.append(s if fresh.all() else s[fresh])
        elif hi > lo:
            out.append(np.array([xxhash.xxh3_64_intdigest(w[lo:hi].tobytes(), seed=hi - lo)], np.uint64))
        else:
            out.append(np.empty(0, np.uint64))
    return out


def set_key(s: np.ndarray) -> tuple[int, int, int]:
    """128-bit hash of a set as two longs, and a short key that carries its size."""
    h = xxhash.xxh3_128_digest(s.tobytes())
    a, b = (int.from_bytes(h[i : i + 8], "little", signed=True) for i in (0, 8))
    return a, b, (((a & ((1 << 63) - 1)) >> SIZE_BITS) << SIZE_BITS) | min(len(s), SIZE_MASK)


def sketch(s: np.ndarray) -> bytes:
    """Bitmap of the parity of shingles by place; two sets differ in at least as many shingles as their bitmaps in bits.

    It has two to four bits per shingle, a power of two in all, up to a limit; the larger of two folds onto the smaller.
    """
    size = 1 << min(max(8, len(s).bit_length() + 1), SKETCH_BITS)
    at = (s % np.uint64(size)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=size) & 1).astype(np.uint8), bitorder="little").tobytes()


def folded(bits: bytes, size: int) -> np.ndarray:
    """A bitmap folded onto so many bytes, eight bytes at a time."""
    x = np.frombuffer(bits, np.uint64)
    while len(x) * 8 > size:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def apart(x: bytes, y: bytes) -> int:
    """A lower bound of the number of shingles in which two sets differ, from their bitmaps."""
    size = min(len(x), len(y))
    return int(np.bitwise_count(folded(x, size) ^ folded(y, size)).sum())


class Scheme:
    """Numbers of segments by size band and allowance, and the keys of sets under them."""

    def __init__(self, num: int, den: int, common: np.ndarray, recurring: float):
        self.num, self.den, self.common = num, den, common
        self.segments = np.array([[self._cheapest(j, one, recurring) for j in range(SIZE_BITS + 12)] for one in (0, 1)], np.int64)

    def differ(self, r, s):
        """The most shingles in which two similar sets of these sizes differ."""
        return (self.den - self.num) * (r + s) // (self.den + self.num)

    def _cheapest(self, j: int, one: int, recurring: float) -> int:
        """Segments of a band: the choice of least cost among those that nearly all of its sets have enough of."""
        n, best = (1 << (j + 1)) - 1, (math.inf, (1 << (j + 1)) - 1)
        need = self.differ(n, n * self.den // self.num) + 1
        for load in LOADS:
            m = max(1, math.ceil(n / load))
            filled, single = 1 - math.exp(-n / m), math.exp(-n / m) * n / m
            weight = filled + one * (filled - single)
            if m * weight < 1.15 * need + 1:
                continue
            used = need / weight
            chance = sum(math.exp(-n / m) * (n / m) ** k / math.factorial(k) * recurring**k for k in range(1, 12))
            cost = used * (filled + one * n / m) + MATCH_COST * used * chance * (1 + one * n / m)
            best = min(best, (cost, m))
        return best[1]

    def _tier(self, one: int, flat: np.ndarray, owner: np.ndarray, sets: np.ndarray, j: np.ndarray, most: np.ndarray):
        """Keys of sets in their bands with one allowance for all segments: (keys, their owners, which sets have enough).

        flat: shingles, owner: the place of their set in sets; j, most: band and largest difference of each set.
        """
        m = self.segments[one][j]
        salt = (2 * j + one + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = fmix(flat ^ salt[owner])
        base = np.cumsum(m) - m
        cell = base[owner] + (((mixed >> np.uint64(33)) * m[owner].astype(np.uint64)) >> np.uint64(31)).astype(np.int64)
        total, cells = np.zeros(int(m.sum()), np.uint64), int(m.sum())
        np.add.at(total, cell, mixed)
        count = np.bincount(cell, minlength=cells)
        weight = np.minimum(count, 1 + one)
        upto = np.concatenate(([0], np.cumsum(weight)))
        of = np.repeat(np.arange(len(sets)), m)
        used = (count > 0) & (upto[:-1] - upto[base][of] <= most[of])
        tag = fmix((np.arange(cells) - base[of]).astype(np.uint64) + salt[of])
        keys, owners = [fmix(total ^ tag)[used]], [sets[of[used]]]
        if one:
            near = used[cell] & (count[cell] > 1)
            at = cell[near]
            keys.append(fmix((total[at] - mixed[near]) ^ tag[at]))
            owners.append(sets[owner[near]])
        return keys, owners, upto[base + m] - upto[base] > most

    def keys(self, flat: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Keys of non-empty sets: (keys, the place of their set, the last tier of each set: 0, 1, or 2 for single shingles).

        flat: the sorted shingles of all sets, one set after the other; n: their numbers.
        """
        common = np.zeros(len(flat), bool)
        if len(self.common):
            at = np.minimum(np.searchsorted(self.common, flat), len(self.common) - 1)
            common = self.common[at] == flat
        owner = np.repeat(np.arange(len(n)), n)
        rare, mine = flat[~common], owner[~common]
        band = np.frexp(n.astype(np.float64))[1].astype(np.int64) - 1
        least = -(-n * self.num // self.den)
        lower = (band > 0) & (least <= (1 << band) - 1)
        ways = [(np.ones(len(n), bool), band, self.differ(n, n * self.den // self.num)), (lower, band - 1, self.differ(n, (1 << band) - 1))]
        left, tier = np.ones(len(n), bool), np.zeros(len(n), np.int64)
        keys, owners = [], []
        for one in (0, 1):
            enough = np.ones(len(n), bool)
            for who, j, most in ways:
                sets = np.flatnonzero(who & left)
                if len(sets):
                    place = np.full(len(n), -1)
                    place[sets] = np.arange(len(sets))
                    its = place[mine] >= 0
                    k, o, ok = self._tier(one, rare[its], place[mine[its]], sets, j[sets], most[sets])
                    keys += k
                    owners += o
                    enough[sets] &= ok
            left &= ~enough
            tier[left] = one + 1
        edges = np.cumsum(n) - n
        for i in np.flatnonzero(left).tolist():
            own = slice(edges[i], edges[i] + n[i])
            first = np.concatenate((flat[own][~common[own]], flat[own][common[own]]))[: n[i] - least[i] + 1]
            keys.append(fmix(first + np.uint64(0xD6E8FEB86659FD93)))
            owners.append(np.full(len(first), i))
        return np.concatenate(keys), np.concatenate(owners), tier


_INDEXED = pa.schema([("bucket", pa.int32()), ("blob", pa.binary()), ("_id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("cid", pa.int64()), ("bits", pa.binary())])
_FOUND = pa.schema([*[_INDEXED.field(k) for k in range(2, 8)], ("a", pa.int64()), ("b", pa.int64()), ("gid", pa.int64()), ("part", pa.int32()), ("members", pa.list_(pa.int64()))])
_KEY = np.dtype([("key", "u1", 6), ("cid", "<i8")])
_BODY = pa.schema([("h1", pa.int64()), ("h2", pa.int64()), ("cid", pa.int64()), ("rep", pa.int64()), ("body", pa.binary())])
_PAIR = pa.schema([("a", pa.int64()), ("b", pa.int64())])
_NO_PRINT, INDEXED = [None] * 6, "bucket int, blob binary, _id long, n long, h1 long, h2 long, cid long, bits binary"
FOUND = "_id long, n long, h1 long, h2 long, cid long, bits binary, a long, b long, gid long, part int, members array<long>"


def _slices(raw: list[bytes], limit: int = 1 << 20) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, x in enumerate(raw):
        size += len(x)
        if size > limit:
            yield lo, i + 1
            lo, size = i + 1, 0
    if lo < len(raw):
        yield lo, len(raw)


def _sampled(width: int):
    """Shingle sets of texts, one row for each different set of a task's texts up to a number."""

    def run(batches):
        seen: set[tuple[int, int, int]] = set()
        for batch in batches:
            out, raw = [], list(dict.fromkeys(texts(batch)))
            for lo, hi in _slices(raw):
                for s in shingle_sets(raw[lo:hi], width):
                    if len(s) and (k := set_key(s)) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add(k)
                        out.append((k[0], k[1], s.view(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True) if out else ([], [], []), (pa.int64(), pa.int64(), pa.list_(pa.int64())), strict=True)], names=["h1", "h2", "s"])

    return run


def _index(width: int, common, num: int, den: int, recurring: float, n_buckets: int):
    """A row with the print of every document, and packed keys of the different sets of a task."""

    def flush(scheme, sets, cids) -> Iterator[pa.RecordBatch]:
        if sets:
            k, owner, _ = scheme.keys(np.concatenate(sets), np.array([len(s) for s in sets], np.int64))
            rec = np.empty(len(k), _KEY)
            rec["key"] = k.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6]
            rec["cid"] = np.array(cids, np.int64)[owner]
            bucket = ((k >> np.uint64(48)) * np.uint64(n_buckets) >> np.uint64(16)).astype(np.int32)
            yield bucket, rec

    def sent(held) -> Iterator[pa.RecordBatch]:
        if held:
            rows = list(scattered(np.concatenate([b for b, _ in held]), np.concatenate([r for _, r in held])))
            for i in range(0, len(rows), 512):
                part = rows[i : i + 512]
                yield record_batch(_INDEXED, *zip(*part, strict=True), *([x] * len(part) for x in _NO_PRINT))

    def run(batches):
        scheme = Scheme(num, den, common.value, recurring)
        seen: set[tuple[int, int]] = set()
        known: dict[bytes, tuple] = {}
        sets, cids, size, held, records = [], [], 0, [], 0
        for batch in batches:
            names, raw = column(batch, "_id"), texts(batch)
            for lo, hi in _slices(raw):
                prints = [xxhash.xxh3_128_digest(x) for x in raw[lo:hi]]
                new = {p: x for p, x in zip(prints, raw[lo:hi], strict=True) if p not in known}
                if len(known) > REMEMBERED:
                    known = {p: known[p] for p in prints if p in known}
                fresh = dict(zip(new, shingle_sets(list(new.values()), width), strict=True))
                bits = {p: sketch(s) for p, s in fresh.items()}
                known |= {p: (len(s), *set_key(s), bits[p] if len(bits[p]) <= 256 else None) for p, s in fresh.items()}
                out = []
                for i, p, x in zip(names[lo:hi], prints, raw[lo:hi], strict=True):
                    n, a, b, cid, sk = known[p]
                    sk = sk or bits.get(p) or sketch(shingle_sets([x], width)[0])
                    out.append(((i ^ int.from_bytes(p)) % n_buckets, None, i, n, a, b, cid, sk))
                yield record_batch(_INDEXED, *zip(*out, strict=True))
                for p, s in fresh.items():
                    n, a, b, cid, _ = known[p]
                    if n and (a, b) not in seen:
                        if len(seen) >= REMEMBERED:
                            seen.clear()
                        seen.add((a, b))
                        sets.append(s)
                        cids.append(cid)
                        size += n
                        if size >= TOGETHER:
                            held += flush(scheme, sets, cids)
                            records += len(held[-1][0])
                            sets, cids, size = [], [], 0
                            if records > FLUSH_RECORDS:
                                yield from sent(held)
                                held, records = [], 0
        yield from sent([*held, *flush(scheme, sets, cids)])

    return run


def _fits(n, m):
    """Whether sets of these sizes may be similar; sizes that the short key cannot hold may."""
    return (4 * np.minimum(n, m) >= 3 * np.maximum(n, m)) | (np.maximum(n, m) == SIZE_MASK)


def _groups(batches):
    """Prints pass through. Of the sets that share a key: pairs of the first with each other one, and for three or more the
    members in blocks, equal groups once."""
    parts = []
    for batch in batches:
        if batch.num_rows:
            blob = batch.column(1)
            mine = batch.filter(blob.is_null())
            none = pa.nulls(mine.num_rows)
            yield pa.RecordBatch.from_arrays([*mine.columns[2:], *(none.cast(f.type) for f in list(_FOUND)[6:])], schema=_FOUND)
            for b, x in zip(column(batch, "bucket"), blob.to_pylist(), strict=True):
                if x is not None:
                    rec = np.frombuffer(x, _KEY)
                    key = np.zeros((len(rec), 8), np.uint8)
                    key[:, :6] = rec["key"]
                    parts.append((key.view("<u8")[:, 0] | np.uint64(b) << np.uint64(48), rec["cid"]))
    if not parts:
        return
    k, c = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    order = np.argsort(k)
    k, c = k[order], c[order]
    same = k[1:] == k[:-1]
    many = np.concatenate(([False], same)) | np.concatenate((same, [False]))
    k, c = k[many], c[many]
    order = np.lexsort((c, k))
    k, c = k[order], c[order]
    fresh = np.concatenate(([True], (k[1:] != k[:-1]) | (c[1:] != c[:-1]))) if len(k) else np.zeros(0, bool)
    k, c = k[fresh], c[fresh]
    if not len(k):
        return
    lead = np.concatenate(([True], k[1:] != k[:-1]))
    first = np.flatnonzero(lead)
    count = np.diff(np.append(first, len(k)))
    a, b = np.repeat(c[first], count), c
    open_ = ~lead & _fits(a & SIZE_MASK, b & SIZE_MASK)
    pairs = np.unique(np.stack((a[open_], b[open_]), axis=1), axis=0)
    for i in range(0, len(pairs), 1 << 16):
        part = pairs[i : i + (1 << 16)]
        yield record_batch(_FOUND, *([None] * len(part) for _ in range(6)), part[:, 0], part[:, 1], *([None] * len(part) for _ in range(3)))
    seen, out = set(), []
    for lo, n in zip(first[count > 2].tolist(), count[count > 2].tolist(), strict=True):
        m = c[lo : lo + n]
        gid = int.from_bytes(xxhash.xxh3_64_digest(m.tobytes()), "little", signed=True)
        if gid not in seen:
            seen.add(gid)
            out += [(gid, i // BLOCK, m[i : i + BLOCK]) for i in range(0, n, BLOCK)]
            if len(out) >= 4096:
                yield record_batch(_FOUND, *([None] * len(out) for _ in range(8)), *zip(*out, strict=True))
                out = []
    if out:
        yield record_batch(_FOUND, *([None] * len(out) for _ in range(8)), *zip(*out, strict=True))


def _bodies(width: int):
    """Shingle sets of the wanted documents; want: the set hashes asked for of the id."""

    def run(batches):
        for batch in batches:
            names, raw, wants = column(batch, "_id"), texts(batch), column(batch, "want")
            for lo, hi in _slices(raw):
                out = []
                for i, s, want in zip(names[lo:hi], shingle_sets(raw[lo:hi], width), wants[lo:hi], strict=True):
                    a, b, cid = set_key(s)
                    if any(w["h1"] == a and w["h2"] == b for w in want):
                        out.append((a, b, cid, i, s.tobytes()))
                yield record_batch(_BODY, *zip(*out, strict=True)) if out else record_batch(_BODY, *[[]] * 5)

    return run


def _near(num: int, den: int):
    """Pairs whose bitmaps leave it open that they are similar."""

    def run(batches):
        for batch in batches:
            a, b = [], []
            for ca, cb, n, m, x, y in zip(*(column(batch, c) for c in ("a", "b", "n_a", "n_b", "bits_a", "bits_b")), strict=True):
                if apart(x, y) <= (den - num) * (n + m) // (den + num):
                    a.append(ca)
                    b.append(cb)
            yield record_batch(_PAIR, a, b)

    return run


def _verified(num: int, den: int):
    def run(batches):
        for batch in batches:
            a, b = [], []
            for ra, rb, x, y in zip(*(column(batch, c) for c in ("rep_a", "rep_b", "body_a", "body_b")), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = np.concatenate((x, y))
                both.sort(kind="stable")
                shared = int(np.count_nonzero(both[1:] == both[:-1]))
                if den * shared >= num * (len(x) + len(y) - shared):
                    a.append(ra)
                    b.append(rb)
            yield record_batch(_PAIR, a, b)

    return run


def _cross(num: int, den: int, last: bool):
    """Pairs of an outsider of a group with members of other components that bitmaps leave open.

    All but the last turn give the nearest few of each outsider, and a row (-1, -1) if there are more: those pairs mostly
    join the outsider to the component that holds most of the group.
    """

    def run(batches):
        left = False
        for batch in batches:
            found: set[tuple[int, int]] = set()
            for group in column(batch, "of"):
                group.sort(key=lambda x: len(x["bits"]))
                cid, comp = (np.array([x[k] for x in group], np.int64) for k in ("cid", "comp"))
                out, n, size = np.array([x["out"] for x in group]), cid & SIZE_MASK, np.array([len(x["bits"]) for x in group])
                tables: dict[int, np.ndarray] = {}
                for i in np.flatnonzero(out).tolist():
                    other = (comp != comp[i]) & _fits(n[i], n) & ~(out & (cid < cid[i]))
                    at = np.flatnonzero(other)
                    bound = (den - num) * (n[i] + n[at]) // (den + num)
                    bits = np.empty(len(at), np.int64)
                    for z in np.unique(np.minimum(size[at], size[i])).tolist():
                        if z not in tables:
                            tables[z] = np.stack([folded(x["bits"], z) if len(x["bits"]) >= z else np.zeros(z // 8, np.uint64) for x in group]) if z else np.zeros((len(group), 0), np.uint64)
                        here = np.minimum(size[at], size[i]) == z
                        bits[here] = np.bitwise_count(tables[z][at[here]] ^ tables[z][i]).sum(axis=1)
                    near = np.flatnonzero((bits <= bound) | (n[at] == SIZE_MASK) | (n[i] == SIZE_MASK))
                    if not last and len(near) > FIRST_TRIES:
                        left = True
                        near = near[np.argsort(bits[near] - bound[near], kind="stable")[:FIRST_TRIES]]
                    found.update((min(int(cid[i]), x), max(int(cid[i]), x)) for x in cid[at[near]].tolist())
            pairs = sorted(found)
            yield from (record_batch(_PAIR, *zip(*pairs[i : i + 65536], strict=True)) for i in range(0, len(pairs), 65536))
        if left:
            yield record_batch(_PAIR, [-1], [-1])

    return run


def _units(mixed: DataFrame) -> DataFrame:
    """Rows (gid, x, y) -> of: the members of a group that one task compares, at most twice BLOCK on the mean.

    mixed: (gid, cid, comp, out, n_group, n_out). A large group is cut into blocks of members and blocks of outsiders (by hashes
    of the member); each pair of blocks is a unit, so a member goes into as many units as there are blocks of outsiders.
    """
    blocks = lambda n: F.greatest(F.lit(1), F.ceil(F.col(n) / BLOCK)).cast("int")
    here = lambda n, seed: F.pmod(F.xxhash64("cid", F.lit(seed)), blocks(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), blocks(n) - 1))
    one = mixed.where(f"n_group <= {BLOCK}").select("gid", F.lit(0).alias("x"), F.lit(0).alias("y"), "cid", "comp", "bits", "out")
    big = mixed.where(f"n_group > {BLOCK}")
    members = big.where("not out").select("gid", here("n_group", 1).alias("x"), every("n_out").alias("y"), "cid", "comp", "bits", F.lit(False).alias("out"))
    # an outsider is compared as such in every unit of its block, and with the other outsiders where it is a member
    outside = big.where("out").select("gid", every("n_group").alias("x"), here("n_out", 2).alias("y"), "cid", "comp", "bits", F.lit(True).alias("out"))
    also = big.where("out and n_out > 1").withColumn("own", here("n_out", 2)).withColumn("y", every("n_out")).where("y <> own")
    also = also.select("gid", here("n_group", 1).alias("x"), "y", "cid", "comp", "bits", F.lit(False).alias("out"))
    return one.unionByName(members).unionByName(outside).unionByName(also).groupBy("gid", "x", "y").agg(F.collect_list(F.struct("cid", "comp", "bits", "out")).alias("of"))


def jaccard_classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> tuple[DataFrame, DataFrame]:
    """Membership and links.

    Returns ``(members, links)``: members has one row per document, ``(_id, n, h1, h2, rep)`` with the smallest id among
    documents of the same shingle set; links has one row ``(a, b)`` of representatives per pair of different sets with
    den * |intersection| >= num * |union|, as far as needed to join every component (pairs that earlier links join
    already are not verified again).

    A null or empty text, or one without words, has an empty set and no links. Text of fewer words than width is one
    shingle. Null ids count as one id larger than all others. Repeated rows and ties are members of one class. Other
    columns are ignored. No documents give no rows. num/den must be 3/4 or more.
    """
    return _classes(df, id_col, text_col, width, num, den)[:2]


def _classes(df: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Membership and links (see jaccard_classes), and the stars of the links."""
    if 4 * num < 3 * den:
        raise ValueError("similarities under 0.75 are not indexed")
    spark, docs = df.sparkSession, keyed(df, id_col, text_col)
    lent = docs.where(F.pmod(F.xxhash64("_text"), F.lit(SAMPLE)) == 0)
    lent = arrow_map(lent, _sampled(width), "h1 long, h2 long, s array<long>").dropDuplicates(["h1", "h2"])
    again = cut(lent.select(F.explode("s").alias("token")).groupBy("token").count())
    total, twice = again.agg(F.coalesce(F.sum("count"), F.lit(0)), F.coalesce(F.sum((F.col("count") > 1).cast("long")), F.lit(0))).first()
    common = again.where(F.col("count") >= COMMON).orderBy(F.desc("count"), "token").limit(COMMON_LIMIT).toPandas()["token"].to_numpy(np.int64)
    recurring = min(0.9, SAMPLE**0.5 * twice / max(1, total))
    common = spark.sparkContext.broadcast(np.sort(common.view(np.uint64)))

    indexed = arrow_map(docs, _index(width, common, num, den, recurring, buckets(spark)), INDEXED)
    found = cut(arrow_map(indexed.repartition("bucket"), _groups, FOUND))
    prints = found.where("h1 is not null").select("_id", "n", "h1", "h2", "cid", "bits")
    classes = prints.where("n > 0").groupBy("h1", "h2", "cid", "n").agg(F.min("_id").alias("rep"))
    pairs = found.where("a is not null").select("a", "b").distinct()
    groups = found.where("gid is not null").select("gid", "part", "members").distinct()
    members = groups.select("gid", F.explode("members").alias("cid"))
    wanted = found.where("a is not null or gid is not null").select(F.explode(F.when(F.col("gid").isNull(), F.array("a", "b")).otherwise(F.col("members"))).alias("cid")).distinct()
    seen = cut(classes.join(wanted, "cid"))
    own = prints.select(F.col("_id").alias("rep"), "h1", "h2", "bits")
    seen = attach(own, seen, ["rep", "h1", "h2"], "inner").groupBy("h1", "h2", "cid", "n", "rep").agg(F.first("bits").alias("bits"))
    seen = cut(seen)

    def verified(pairs: DataFrame) -> DataFrame:
        """Links between representatives among these pairs of short keys."""
        side = lambda x: seen.select(F.col("cid").alias(x), F.col("n").alias(f"n_{x}"), F.col("bits").alias(f"bits_{x}"))
        near = cut(arrow_map(pairs.join(side("b"), "b").join(side("a"), "a"), _near(num, den), "a long, b long"))
        asked = seen.join(near.select(F.explode(F.array("a", "b")).alias("cid")).distinct(), "cid", "left_semi")
        asked = cut(asked.groupBy(F.col("rep").alias("_id")).agg(F.collect_set(F.struct("h1", "h2")).alias("want")))
        bodies = arrow_map(attach(docs, asked, "_id", "inner", F.size("want") * 16), _bodies(width), "h1 long, h2 long, cid long, rep long, body binary")
        side = lambda x: bodies.select(F.col("cid").alias(x), F.col("rep").alias(f"rep_{x}"), F.col("body").alias(f"body_{x}"))
        return cut(arrow_map(near.join(side("b"), "b").join(side("a"), "a"), _verified(num, den), "a long, b long").distinct())

    links = verified(pairs)
    joined = stars(links)
    for last in (False, True):
        # numbers alone tell which groups hold several components; only those are compared
        labels = seen.select("cid", "rep", "n").join(joined, seen.rep == joined.a, "left").select("cid", F.coalesce("b", "rep").alias("comp"))
        labels = labels.groupBy("cid").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"))
        labels = cut(labels.select("cid", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(-F.col("cid") - 1).alias("comp")))
        told = cut(attach(members, labels, "cid", "inner"))
        each = told.groupBy("gid", "comp").agg(F.count(F.lit(1)).alias("k"))
        mixed = each.groupBy("gid").agg(F.max_by("comp", "k").alias("main"), F.max("k").alias("most"), F.sum("k").alias("n_group"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        mixed = cut(mixed.select("gid", "main", "n_group", (F.col("n_group") - F.col("most")).alias("n_out")))
        if mixed.isEmpty():
            break
        told = attach(told, mixed, "gid", "inner").withColumn("out", F.col("comp") != F.col("main"))
        bits = seen.groupBy("cid").agg(F.first("bits").alias("bits"), F.count(F.lit(1)).alias("k")).select("cid", F.when(F.col("k") == 1, F.col("bits")).otherwise(F.lit(b"")).alias("bits"))
        more = cut(arrow_map(_units(told.join(bits, "cid")).select("of"), _cross(num, den, last), "a long, b long").distinct())
        fresh = verified(more.where("a >= 0"))
        links = links.unionByName(fresh)
        joined = stars(joined.unionByName(fresh))
        if more.where("a < 0").isEmpty():
            break
    return prints.drop("bits").join(classes.drop("n"), ["h1", "h2", "cid"], "left"), links, joined


def jaccard_components(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 75, den: int = 100) -> DataFrame:
    """One row per document: id, n_shingles, component_id (the smallest id that links reach; see jaccard_classes)."""
    members, _, joined = _classes(df, id_col, text_col, width, num, den)
    joined = members.join(joined, F.col("rep") == F.col("a"), "left")
    joined = joined.withColumn("_component", F.coalesce("b", "rep", "_id"))
    return joined.select(
        public_id().alias(id_col),
        F.col("n").alias("n_shingles"),
        public_id("_component").alias("component_id"),
    )


def keep_one(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df, one document of each group: the one of the smallest id.

    Rows of one id (or of none) with different texts are documents of their own; of rows of equal id and text one stays.
    Null ids are larger than all others; of documents of one id in a group, the one of the smallest print stays. Columns
    may have any names.
    """
    own = {c: f"_o{k}" for k, c in enumerate(df.columns)}
    return _kept_rows(df.toDF(*own.values()), own[id_col], own[text_col]).toDF(*df.columns)


def _kept_rows(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    key = F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID))
    if df.groupBy(key.alias("_id")).count().where("count > 1").isEmpty():
        found = jaccard_components(df, id_col, text_col).select(F.coalesce(id_col, F.lit(NO_ID)).alias("_row"), F.coalesce("component_id", F.lit(NO_ID)).alias("_kept"))
        gone = cut(found.where("_row <> _kept").select("_row"))
        return attach(df.withColumn("_row", key), gone, "_row", "left_anti").drop("_row")
    # a print of id and text stands for the id, one that tells apart all that another print does
    of = lambda seed: F.xxhash64(F.lit(seed), key, F.col(text_col).isNull(), text_col)
    for seed in itertools.count(1):
        rows = df.withColumn("_row", F.least(of(seed), F.lit(NO_ID - 1)))
        named = cut(rows.groupBy("_row", key.alias("_id"), of(0).alias("_other")).agg(F.count(F.lit(1)).alias("k")))
        if named.groupBy("_row").count().where("count > 1").isEmpty():
            break
    found = jaccard_components(rows, "_row", text_col).select("_row", "component_id").distinct()
    found = cut(found.join(named.select("_row", "_id"), "_row"))
    first = cut(found.groupBy("component_id").agg(F.min(F.struct("_id", "_row"))["_row"].alias("_kept")))
    gone = cut(attach(found, first, "component_id", "inner").where("_row <> _kept").select("_row"))
    again = named.where("k > 1").select("_row")
    once = attach(rows, again, "_row", "left_anti").unionByName(attach(rows, again, "_row", "left_semi").dropDuplicates(["_row"]))
    return attach(once, gone, "_row", "left_anti").drop("_row")
