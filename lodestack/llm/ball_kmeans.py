"""Ball k-means (Xia et al., 2020) on integer vectors, exact in every comparison.

A cluster is a ball: its centroid and a bound of its radius. Another centroid can only win a member if it is no further from
the ball's centroid than twice the member's distance, so a ball's neighbours are the centroids within twice its radius,
sorted by distance. Members nearer than half the way to the first neighbour are the stable core and stay; the others lie in
annuli, and a member of the t-th annulus is compared with the first t neighbours alone. Balls whose centroid and neighbours did
not move keep all members unread. Vectors with their clusters are a table in the shared folder, written anew each round, so
a lost executor repeats its part of one round; the driver holds the centroids and sums of k balls.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestack.llm.common import NO_ID, arrow_map, column, public_id, record_batch, removed, stored

#: Components beyond this are refused: squared distances and their sums over a vector would not fit a long.
MOST = 1 << 27
_ROW = "_id bigint, v array<int>, cluster int, distance bigint"
_OUT = pa.schema([("_id", pa.int64()), ("v", pa.list_(pa.int32())), ("cluster", pa.int32()), ("distance", pa.int64())])


def integer_vectors(df: DataFrame, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """(_id, v): the rows whose vector has dims components, none null or non-finite, as integers floor(scale * x)."""
    x = F.col(vec_col).cast("array<double>")
    whole = (F.size(x) == dims) & F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    short = lambda e: F.when(F.abs(e * scale) <= MOST, F.floor(e * scale)).otherwise(F.raise_error(F.lit("a component is too large for exact distances")).cast("long"))
    return df.where(whole).select(F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("_id"), F.transform(x, lambda e: short(e).cast("int")).alias("v"))


def first_centroids(vectors: DataFrame, k: int, salt: str = "2") -> list[list[int]]:
    """The k vectors with the smallest sha256 of salt:id (null ids come last; ties by the vector)."""
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("_id").cast("string")).cast("binary"), 256)
    first = vectors.select((F.col("_id") == NO_ID).alias("null"), mark.alias("mark"), "v").orderBy("null", "mark", "v").limit(k)
    return [list(r["v"]) for r in first.collect()]


def _square(v: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((v - c) ** 2).sum(axis=1)


class Balls:
    """The centroids of a round, and for each ball its neighbours by distance.

    reach: for each ball a bound of the distance of its members to its centroid (None: no members are known, all centroids
    are neighbours). moved: which centroids changed.
    """

    def __init__(self, centroids: list[list[int]], reach: list[int | None], moved: list[bool]):
        self.centroids = np.array(centroids, np.int64)
        self.near, self.apart, self.still = [], [], []
        for i in range(len(centroids)):
            d = _square(self.centroids, self.centroids[i])
            order = np.lexsort((np.arange(len(d)), d))
            near = [int(j) for j in order if j != i and (reach[i] is None or int(d[j]) <= 4 * reach[i] ** 2)]
            self.near.append(near)
            self.apart.append(d[near])
            self.still.append(not moved[i] and not any(moved[j] for j in near))

    def assign(self, v: np.ndarray, cluster: np.ndarray, distance: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The nearest centroid (ties: the smaller number) and the squared distance of every vector."""
        cluster, distance = cluster.copy(), distance.copy()
        for i in np.unique(cluster).tolist():
            if self.still[i]:
                continue
            at = np.flatnonzero(cluster == i)
            own = _square(v[at], self.centroids[i])
            distance[at] = own
            annulus = np.searchsorted(self.apart[i], 4 * own, side="right")  # 0: the core
            out = np.flatnonzero(annulus)
            at, best, to, annulus = at[out], own[out], np.full(len(out), i), annulus[out]
            for t, j in enumerate(self.near[i]):
                live = np.flatnonzero(annulus > t)
                if not len(live):
                    break
                d = _square(v[at[live]], self.centroids[j])
                closer = (d < best[live]) | ((d == best[live]) & (j < to[live]))
                best[live[closer]], to[live[closer]] = d[closer], j
            cluster[at], distance[at] = -1 - to, best
        return np.where(cluster < 0, -1 - cluster, cluster), distance


def _round(vectors: DataFrame, balls: Balls) -> DataFrame:
    """Every vector under its ball of this round; vectors without a cluster column are first put into ball 0."""
    fresh = "cluster" not in vectors.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(batch.schema.get_field_index("v"))
            n = batch.num_rows
            v = raw.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(n, -1)
            old = (np.zeros(n, np.int32), np.zeros(n, np.int64)) if fresh else tuple(batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cluster", "distance"))
            yield record_batch(_OUT, column(batch, "_id"), raw, *balls.assign(v, *old))

    return arrow_map(vectors, each, _ROW)


def _sums(table: DataFrame, dims: int) -> dict:
    """For each ball with members: count, sums by component, greatest and total squared distance. Partial sums come before the shuffle."""
    parts = [F.sum(F.get("v", F.lit(d))).alias(f"s{d}") for d in range(dims)]
    rows = table.groupBy("cluster").agg(F.count(F.lit(1)).alias("n"), F.max("distance").alias("far"), F.sum(F.col("distance").cast("decimal(20,0)")).alias("inertia"), *parts).collect()
    return {r["cluster"]: (r["n"], [r[f"s{d}"] for d in range(dims)], r["far"], int(r["inertia"])) for r in rows}


def ball_kmeans(df: DataFrame, k: int = 40, rounds: int = 5, dims: int = 64, scale: int = 256, id_col: str = "vec_id", vec_col: str = "embedding", salt: str = "2") -> DataFrame:
    """One row per kept vector: id, cluster, distance (squared), cluster_inertia, inertia, centroid (array of long).

    Kept are vectors of dims components, none null or non-finite; x becomes floor(scale * x). The first centroids are those
    of first_centroids; with fewer than k kept vectors there are as many. Each round assigns all vectors to the nearest
    centroid (ties: the smaller number) and moves every centroid that has vectors to floor(sum / count); after the last round vectors
    are assigned once more. If no centroid moves, further rounds change nothing and are left out. Repeated rows, equal
    vectors and null ids are vectors of their own; no kept vectors give no rows. Other columns are ignored.
    """
    spark = df.sparkSession
    vectors = integer_vectors(df, dims, scale, id_col, vec_col)
    centroids = first_centroids(vectors, k, salt)
    if not centroids:
        return vectors.limit(0).select(public_id().alias(id_col), *(F.lit(None).cast(t).alias(c) for c, t in (("cluster", "int"), ("distance", "long"), ("cluster_inertia", "long"), ("inertia", "long"), ("centroid", "array<long>"))))
    table, path = stored(_round(vectors, Balls(centroids, [None] * len(centroids), [True] * len(centroids))), "balls")
    sums = _sums(table, dims)
    for _ in range(rounds):
        old, reach = centroids, [0] * len(centroids)
        centroids = [[s // sums[i][0] for s in sums[i][1]] if i in sums else c for i, c in enumerate(old)]
        moved = [a != b for a, b in zip(old, centroids, strict=True)]
        if not any(moved):
            break
        for i, (_, _, far, _) in sums.items():
            shift = sum((a - b) ** 2 for a, b in zip(old[i], centroids[i], strict=True))
            reach[i] = isqrt(far) + 1 + isqrt(shift) + 1
        before = path
        table, path = stored(_round(table, Balls(centroids, reach, moved)), "balls")
        removed(spark, before)
        sums = _sums(table, dims)
    total = sum(x[3] for x in sums.values())
    # one row for each of the k centroids
    known = [(i, sums[i][3] if i in sums else 0, total, c) for i, c in enumerate(centroids)]
    known = spark.createDataFrame(known, "cluster int, cluster_inertia long, inertia long, centroid array<long>")
    return table.join(F.broadcast(known), "cluster").select(public_id().alias(id_col), "cluster", "distance", "cluster_inertia", "inertia", "centroid")
