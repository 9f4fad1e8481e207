"""Sharding by a k-d tree over metadata, with DataFrame functions alone.

A node that is to hold k shards is split in the share of floor(k/2) to k at the weighted median (by bytes) of its widest
dimension. Widths are measured in the units of the whole table. Equal texts are one item, which no cut parts; only a group
of more bytes than a whole shard is to hold is dealt into several items by hashes of the id.
Every dimension is extended by hashes of the text and of the id, so ties have an order. A median is found by histograms
that are refined around the cut until what is left is small against the node, so no item moves before its shard is known,
and the driver holds a few numbers per node. In the end whole items are handed from shards above the mean to those below,
in rounds: each leaves at most a part of the surplus.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestack.llm.common import NO_ID, attach, cut, public_id

#: Bits of a dimension's value and of the hash that orders ties.
VALUE_BITS, TIE_BITS = 22, 40
BINS = 4096
#: A group of equal texts that is larger than a shard is dealt into so many items for each shard it fills.
ITEMS_OF_SHARD = 16
#: A cut is not refined within a bin of less than this part of the node's bytes; levelling does the rest.
FINE = 512
#: Shards are level if their sums are apart by less than this part of the mean, and how often items are handed over.
LEVEL, HANDED = 2000, 6
#: Rows of one shard that are numbered together.
NUMBERED_TOGETHER = 250_000


def _pick(values: list, index):
    """The value of a short list at a 0-based index."""
    return F.element_at(F.array(*(F.lit(v) for v in values)), (index + 1).cast("int"))


def _measured(docs: DataFrame, dims: dict) -> DataFrame:
    """Sizes and dimensions as non-negative longs: the value in the upper bits, the order of ties below."""
    text = F.coalesce("_text", F.lit(""))
    tie = F.shiftleft(F.shiftrightunsigned(F.xxhash64("_text"), 64 - TIE_BITS // 2), TIE_BITS // 2) + F.shiftrightunsigned(F.xxhash64("_id", F.lit(1)), 64 - TIE_BITS // 2)
    prints = F.xxhash64("_text").alias("t1"), F.xxhash64(F.lit(1), F.col("_text").isNull(), "_text").alias("t2")
    rows = docs.select("_id", (F.octet_length(text) + 8).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("crc"), tie.alias("tie"), *prints, *(e.cast("double").alias(d) for d, e in dims.items()))
    return cut(rows)


def _items(rows: DataFrame, shards: int, dims: list[str]) -> tuple[DataFrame, DataFrame]:
    """The rows with the item (t1, t2, part) of each, and the items: rows of equal texts; only groups beyond a shard have several parts."""
    target = max(1, (rows.agg(F.sum("size")).first()[0] or 0) // shards)
    # fewer groups than shards are so large
    large = rows.groupBy("t1", "t2").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("k")).where(f"k > 1 and bytes > {target}")
    large = cut(large.select("t1", "t2", F.ceil(F.col("bytes") * ITEMS_OF_SHARD / target).alias("parts")))
    rows = rows.join(F.broadcast(large), ["t1", "t2"], "left").withColumn("part", F.coalesce(F.pmod(F.xxhash64("_id", F.lit(2)), "parts"), F.lit(0))).drop("parts")
    items = rows.groupBy("t1", "t2", "part").agg(F.sum("size").alias("size"), F.min("_id").alias("_id"), F.min("tie").alias("tie"), *(F.min(d).alias(d) for d in dims))
    return rows.select("_id", "size", "crc", "tie", "t1", "t2", "part"), items


def kd_shards(df: DataFrame, shards: int = 24, id_col: str = "doc_id", text_col: str = "text", dims: dict | None = None) -> DataFrame:
    """One row per document: id, size, text_crc32, shard, slot.

    size is the UTF-8 length of the text (null: none) plus 8; shards hold near equal sums of it. Equal texts share a shard;
    only a group of more bytes than the mean of the shards is parted. slot numbers the rows of
    a shard from 0 without gaps. dims: named numeric expressions over the columns of df; by default length, id, source
    and language. Nulls in a dimension sort first. Repeated rows are rows of their own. A shard may stay empty if there
    are fewer rows than shards. Columns of df matter only as far as dims name them.
    """
    if dims is None:
        code = lambda c: F.pmod(F.xxhash64(F.col(c)), F.lit(4096))
        dims = {"length": F.log2(F.octet_length(F.coalesce(F.col(text_col), F.lit(""))) + 8), "place": F.col(id_col)}
        dims |= {c: code(c) for c in ("source", "lang") if c in df.columns and c not in (id_col, text_col)}
    own = {f"_d{k}": e for k, e in enumerate(dims.values())}
    docs = df.select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.col(text_col).alias("_text"), *(e.alias(d) for d, e in own.items()))
    every, rows = _items(_measured(docs, {d: F.col(d) for d in own}), shards, list(own))
    rows = cut(rows)
    ends = rows.agg(*(f(d).alias(f"{n}{d}") for d in own for n, f in (("lo", F.min), ("hi", F.max)))).first()
    scale = {d: (ends[f"lo{d}"] or 0.0, max((ends[f"hi{d}"] or 0.0) - (ends[f"lo{d}"] or 0.0), 1e-9)) for d in own}
    value = lambda d: F.floor((F.coalesce(F.col(d), F.lit(scale[d][0])) - scale[d][0]) / scale[d][1] * ((1 << VALUE_BITS) - 1)).cast("long")
    rows = rows.select("_id", "size", "tie", "t1", "t2", "part", *(F.shiftleft(value(d), TIE_BITS).bitwiseOR(F.col("tie")).alias(d) for d in own))

    open_nodes = [[*range(shards)]] if shards > 1 else []
    rows = rows.withColumn("node", F.lit(0 if shards > 1 else -1))
    while open_nodes:
        rows, open_nodes = _split(rows, open_nodes, list(own))
    placed = rows.select("_id", "size", "tie", "t1", "t2", "part", (-F.col("node") - 1).alias("shard"))
    placed = _levelled(placed, shards).select("t1", "t2", "part", "shard")
    placed = every.join(placed, ["t1", "t2", "part"])
    count = every.count()
    salted = placed.withColumn("salt", F.pmod(F.xxhash64("_id", "tie"), F.lit(1 + count // (shards * NUMBERED_TOGETHER))))
    salted = cut(salted)
    counts = salted.groupBy("shard", "salt").agg(F.count(F.lit(1)).alias("n"))
    base = counts.select("shard", "salt", (F.sum("n").over(Window.partitionBy("shard").orderBy("salt")) - F.col("n")).alias("base"))
    at = F.row_number().over(Window.partitionBy("shard", "salt").orderBy("_id", "tie"))
    done = attach(salted.withColumn("at", at), base, ["shard", "salt"])
    return done.select(public_id().alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("base") + F.col("at") - 1).alias("slot"))


def _split(rows: DataFrame, nodes: list[list[int]], dims: list[str]) -> tuple[DataFrame, list[list[int]]]:
    """Split every node (the shards it is to hold), and return the rows with their nodes and those of several shards.

    Column node: the place of a row's node in the list, or -1 - shard where the shard is known.
    """
    inner = rows.where("node >= 0")
    boxes = inner.groupBy("node").agg(F.sum("size").alias("bytes"), *(f(d).alias(f"{n}{d}") for d in dims for n, f in (("lo", F.min), ("hi", F.max)))).collect()
    dim, low, high, below, goal, fine = ([0] * len(nodes) for _ in range(6))
    for b in boxes:
        k = b["node"]
        dim[k] = max(range(len(dims)), key=lambda d: b[f"hi{dims[d]}"] - b[f"lo{dims[d]}"])
        low[k], high[k] = b[f"lo{dims[dim[k]]}"], b[f"hi{dims[dim[k]]}"]
        goal[k], fine[k] = b["bytes"] * (len(nodes[k]) // 2) / len(nodes[k]), b["bytes"] // FINE
    node = F.col("node")
    key = F.element_at(F.array(*dims), _pick([d + 1 for d in dim], node))
    while any(a < b for a, b in zip(low, high, strict=True)):
        step = [(b - a) // BINS + 1 for a, b in zip(low, high, strict=True)]
        binned = inner.select("node", "size", key.alias("key"), _pick(low, node).cast("long").alias("low"), _pick(high, node).cast("long").alias("high"), _pick(step, node).cast("long").alias("step"))
        binned = binned.where("low < high and key between low and high").selectExpr("node", "size", "(key - low) div step as bin")
        sums = binned.groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
        upto = F.sum("bytes").over(Window.partitionBy("node").orderBy("bin"))
        wanted = [float(g - x) for g, x in zip(goal, below, strict=True)]
        hit = sums.withColumn("upto", upto).where(F.col("upto") >= _pick(wanted, node))
        for r in hit.groupBy("node").agg(F.min_by(F.struct("bin", "bytes", "n", "upto"), "bin").alias("x")).collect():
            k, (b, size, n, total) = r["node"], r["x"]
            first, last = low[k] + b * step[k], min(high[k], low[k] + (b + 1) * step[k] - 1)
            if n == 1 or step[k] == 1 or size <= fine[k]:  # the cut is on its nearer side
                low[k] = high[k] = first - 1 if total - wanted[k] > size / 2 else last
            else:
                low[k], high[k], below[k] = first, last, below[k] + total - size
    children = [c for n in nodes for c in (n[: len(n) // 2], n[len(n) // 2 :])]
    more = [c for c in children if len(c) > 1]
    place = [more.index(c) if len(c) > 1 else -1 - c[0] for c in children]
    down = F.when(key <= _pick(high, node).cast("long"), _pick(place[::2], node)).otherwise(_pick(place[1::2], node))
    return cut(rows.withColumn("node", F.when(node < 0, node).otherwise(down))), more


def _levelled(placed: DataFrame, shards: int) -> DataFrame:
    """Hand items of shards above the mean to shards below it, while that brings the sums nearer to each other."""
    best, least = placed, None
    for _ in range(HANDED):
        sums = {r["shard"]: r["b"] for r in placed.groupBy("shard").agg(F.sum("size").alias("b")).collect()}
        sums = [sums.get(s, 0) for s in range(shards)]
        apart = max(sums) - min(sums)
        if least is None or apart < least:
            best, least = placed, apart
        moves = _moves(placed, sums) if apart > sum(sums) / shards / LEVEL else None
        if moves is None:
            break
        placed = cut(attach(placed, moves, ["_id", "tie"]).withColumn("shard", F.coalesce("to", "shard")).drop("to"))
    return best


def _moves(placed: DataFrame, sums: list[int]) -> DataFrame | None:
    """(_id, tie, to): the items that leave shards above the mean, the largest of at most the surplus first."""
    shards, mean = len(sums), sum(sums) / len(sums)
    surplus = [max(0.0, b - mean) for b in sums]
    extra = _pick(surplus, F.col("shard"))
    # a band of sizes that is sure to hold the surplus
    rank = placed.withColumn("extra", extra).where("size <= extra")
    rank = rank.groupBy("shard", "size").agg((F.sum("size")).alias("bytes"), F.first("extra").alias("extra"))
    taken = rank.withColumn("before", F.sum("bytes").over(Window.partitionBy("shard").orderBy(F.desc("size"))) - F.col("bytes")).where("before < extra")
    limit = {r["shard"]: r["m"] for r in taken.groupBy("shard").agg(F.min("size").alias("m")).collect()}
    if not limit:
        return None
    able = F.col("size").between(_pick([limit.get(s, 1 << 62) for s in range(shards)], F.col("shard")), extra)
    giving = placed.where(able).withColumn("extra", extra)
    own = Window.partitionBy("shard").orderBy(F.desc("size"), "_id", "tie")
    giving = giving.withColumn("run", F.sum("size").over(own)).where("run <= extra").select("_id", "tie", "shard", "size", "run")
    starts = [sum(surplus[:s]) for s in range(shards)]
    under = [(mean - b, s) for s, b in enumerate(sums) if b < mean]
    ends = [sum(x for x, _ in under[: k + 1]) for k in range(len(under))]
    to = F.lit(under[-1][1])
    for end, (_, s) in reversed([*zip(ends, under, strict=True)][:-1]):
        to = F.when(F.col("spot") < end, F.lit(s)).otherwise(to)
    spot = _pick(starts, F.col("shard")) + F.col("run") - F.col("size") / 2
    return cut(giving.withColumn("spot", spot).withColumn("to", to).groupBy("_id", "tie").agg(F.min("to").alias("to")))
