"""Best-fit packing of tokenized documents with matching of large items.

Only the lengths of the pieces decide the packing, and there are at most `capacity` of them. So the cluster counts
pieces by length, the driver packs the counts (a plan of patterns, whose size depends on the capacity alone), and every
piece finds its place by its rank among the pieces of its length.
"""

from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.bpe import loaded, slices
from lodestack.llm.common import arrow_map, column, cut, keyed, public_id, record_batch, texts

#: Pieces of one length that are ranked together in one task.
RANKED_TOGETHER = 1_000


def plan(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Bins as (lengths, number of such bins), for these numbers of pieces by length.

    Pieces over a third of the capacity are matched greedily: the largest takes the largest other one that fits, two in a
    bin at most. The others, largest first, go where they leave the least room; a new bin is opened only if none fits.
    """
    left = {n: c for n, c in counts.items() if c}
    bins: dict[int, list[list]] = defaultdict(list)  # by room left: [lengths, number]
    large = sorted((n for n in left if 3 * n > capacity), reverse=True)
    for n in large:
        while left[n]:
            mate = next((m for m in large if m <= capacity - n and m <= n and left[m] > (m == n)), None)
            if mate is None:
                bins[capacity - n].append([(n,), left[n]])
                left[n] = 0
            else:
                pairs = left[n] // 2 if mate == n else min(left[n], left[mate])
                bins[capacity - n - mate].append([(n, mate), pairs])
                left[n] -= pairs
                left[mate] -= pairs
    for n in sorted((n for n in left if 3 * n <= capacity), reverse=True):
        todo = left[n]
        while todo:
            room = min((r for r in bins if r >= n and bins[r]), default=None)
            if room is None:
                each = capacity // n
                full, rest = divmod(todo, each)
                if full:
                    bins[capacity - each * n].append([(n,) * each, full])
                if rest:
                    bins[capacity - rest * n].append([(n,) * rest, 1])
                break
            lengths, number = bins[room].pop()
            each = room // n
            full, rest = divmod(todo, each)
            used = min(number, full)
            todo -= used * each
            if used:
                bins[room - each * n].append([lengths + (n,) * each, used])
            number -= used
            if number and todo:
                bins[room - rest * n].append([lengths + (n,) * rest, 1])
                todo, number = 0, number - 1
            if number:
                bins[room].append([lengths, number])
    return [(lengths, number) for kept in bins.values() for lengths, number in kept]


def places(bins: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length, by first rank: (first rank, first sequence, offset). Equal lengths in a bin take runs of ranks."""
    taken: dict[int, int] = defaultdict(int)
    found = defaultdict(list)
    sequence = 0
    for lengths, number in bins:
        offset = 0
        for n in lengths:
            found[n].append((taken[n], sequence, offset))
            taken[n] += number
            offset += n
        sequence += number
    return {n: np.array(x, np.int64) for n, x in found.items()}


_PIECE = pa.schema([("_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())])
_PLACED = pa.schema([*_PIECE, ("sequence_id", pa.int64()), ("offset", pa.int64())])


def _pieces(path: str, end: int, capacity: int):
    def run(batches):
        bpe = loaded(path)
        for batch in batches:
            raw, names = texts(batch), column(batch, "_id")
            for lo, hi in slices(raw):
                out = []
                for i, ids in zip(names[lo:hi], bpe.encode_all([x.decode("utf-8", "replace") for x in raw[lo:hi]]), strict=True):
                    ids = np.append(ids, np.uint32(end)).astype("<u4")
                    cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
                    for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
                        out.append((i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())))
                yield record_batch(_PIECE, *zip(*out, strict=True))

    return run


def _place(found: dict[int, np.ndarray]):
    def run(batches):
        for batch in batches:
            rank = batch.column(batch.schema.get_field_index("rank")).to_numpy(zero_copy_only=False)
            length = batch.column(batch.schema.get_field_index("length")).to_numpy(zero_copy_only=False)
            sequence, offset = np.empty(len(rank), np.int64), np.empty(len(rank), np.int64)
            for n in np.unique(length):
                mine, runs = length == n, found[int(n)]
                at = np.searchsorted(runs[:, 0], rank[mine], side="right") - 1
                sequence[mine] = runs[at, 1] + rank[mine] - runs[at, 0]
                offset[mine] = runs[at, 2]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(f.name)) for f in _PIECE), pa.array(sequence), pa.array(offset)], schema=_PLACED)

    return run


def pack_best_fit(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = 1024, end: int = 2) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, sequence_id, offset.

    A document is its token ids and the end id; longer ones than capacity are cut into pieces of that many ids, the first
    may be shorter. A null or empty text is the end id alone. Every row is packed, repeated rows too; null ids stay.
    Other columns are ignored. No documents give no rows.
    """
    pieces = cut(arrow_map(keyed(df, id_col, text_col), _pieces(path, end, capacity), "_id long, piece int, start long, length long, ids_crc32 long"))
    # salts by length: at most capacity numbers, so the side is small
    salts = pieces.groupBy("length").agg((F.lit(1) + F.floor(F.count(F.lit(1)) / RANKED_TOGETHER)).alias("salts"))
    salted = pieces.join(F.broadcast(cut(salts)), "length").withColumn("salt", F.pmod(F.xxhash64("_id", "start", "ids_crc32"), "salts")).drop("salts")
    by_salt = cut(salted.groupBy("length", "salt").agg(F.count(F.lit(1)).alias("n")))
    counts = {int(r["length"]): int(r["n"]) for r in by_salt.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    before = Window.partitionBy("length").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)
    base = by_salt.select("length", "salt", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("length", "salt").orderBy("_id", "start", "ids_crc32")
    ranked = salted.withColumn("at", F.row_number().over(within)).join(base, ["length", "salt"])
    ranked = ranked.select("_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("at") - 1).alias("rank"))
    placed = arrow_map(ranked, _place(places(plan(counts, capacity))), "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.select(public_id().alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
