"""Reusable relational operators: keep-first, keep-last merge, as-of lookup, prioritised lookup, paging, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def keep_first(df: DataFrame, keys: list[str], *order: Column, n: int = 1) -> DataFrame:
    """The first n rows of every key. The order must be total for a defined result."""
    at = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn("_at", at).where(F.col("_at") <= n).drop("_at")


def merge_last(df: DataFrame, keys: list[str], order: list[str], first: dict[str, str] | None = None, latch: dict[str, Column] | None = None) -> DataFrame:
    """The state after all rows were merged by key in order: the last row's values.

    first: new column -> source column whose least value stays (first seen). latch: new column -> condition that, once
    true, stays true. One aggregation, combined before the shuffle; no row order is needed.
    """
    rest = [c for c in df.columns if c not in keys]
    last = F.max_by(F.struct(*rest), F.struct(*order)).alias("_last")
    firsts = [F.min(c).alias(n) for n, c in (first or {}).items()]
    latches = [F.bool_or(c).alias(n) for n, c in (latch or {}).items()]
    names = [*(first or {}), *(latch or {})]
    return df.groupBy(*keys).agg(last, *firsts, *latches).select(*keys, *(f"_last.{c}" for c in rest if c not in names), *names)


def counts_by(df: DataFrame, key: str, name: str, distinct: str | None = None) -> DataFrame:
    """Rows, or distinct values of a column, of each key; nulls of the key are left out."""
    count = F.countDistinct(distinct) if distinct else F.count(F.lit(1))
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(count.alias(name))


def with_count(left: DataFrame, key: str, counts: DataFrame, counts_key: str, name: str) -> DataFrame:
    """left with a count of its key, 0 where there is none; the counts hold a key once, so rows never multiply."""
    return left.join(counts.withColumnRenamed(counts_key, "_key"), F.col(key) == F.col("_key"), "left").drop("_key").withColumn(name, F.coalesce(name, F.lit(0)))


def counted_apart(members: DataFrame, used: DataFrame, keys: list[str], member: str, counts: dict[str, str], more: dict[str, Column] | None = None) -> DataFrame:
    """Groups of members with distinct counts of their columns (new name -> column), and asset_count: the distinct assets that use any.

    more: other aggregates of the members by name. Members and their columns are counted before assets are joined, so no distinct count is taken over multiplied rows.
    """
    own = members.groupBy(*keys).agg(*(F.countDistinct(c).alias(n) for n, c in counts.items()), *(c.alias(n) for n, c in (more or {}).items()))
    # null keys are a group too
    safe = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_{k}") for k in keys]
    pairs = members.select(F.col(member).alias("component_id"), *safe).join(used, "component_id").select(*(f"_{k}" for k in keys), "asset_id").distinct()
    assets = pairs.groupBy(*(f"_{k}" for k in keys)).agg(F.count(F.lit(1)).alias("asset_count"))
    return own.select("*", *safe).join(assets, [f"_{k}" for k in keys], "left").select(*keys, *counts, *(more or {}), F.coalesce("asset_count", F.lit(0)).alias("asset_count"))


def numbered(df: DataFrame, keys: list[str], text: str, name: str, chars: int = 3) -> DataFrame:
    """df with the place (from 0) of each row among those of its keys by a text column, which is unique within them.

    Rows are numbered within the first characters of the text, which keep its order, and the counts of these give where each
    range begins; so the rows of one key are sorted by many tasks.
    """
    parts = df.withColumn("_range", F.substring(text, 1, chars))
    inner = F.row_number().over(Window.partitionBy(*keys, "_range").orderBy(text))
    counts = df.groupBy(*keys, F.substring(text, 1, chars).alias("_range")).agg(F.count(F.lit(1)).alias("_n"))
    upto = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "_range", F.coalesce(F.sum("_n").over(upto), F.lit(0)).alias("_start"))
    return parts.withColumn("_at", inner).join(starts, [*keys, "_range"]).withColumn(name, F.col("_start") + F.col("_at") - 1).select(*df.columns, name)


def as_of(left: DataFrame, right: DataFrame, keys: list[str], at: str, value: str) -> DataFrame:
    """left with the value of the last right row of the same keys that stands before it, by one window, not by a range join."""
    both = left.withColumn("_side", F.lit(1)).withColumn("_value", F.lit(None).cast(right.schema[value].dataType)).unionByName(right.select(*keys, at, F.col(value).alias("_value"), F.lit(0).alias("_side")), allowMissingColumns=True)
    before = Window.partitionBy(*keys).orderBy(at, F.desc("_side")).rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn(value, F.last("_value", ignorenulls=True).over(before)).where("_side = 1").drop("_side", "_value")


def page(df: DataFrame, limit: int | None = None, offset: int | None = None, number: int | None = None, default: int = 50, most: int = 200) -> DataFrame:
    """One page of an ordered result; a page number overrides the offset, the limit is held between 1 and most."""
    limit = max(1, min(most, default if limit is None else limit))
    start = (max(1, number) - 1) * limit if number is not None else max(0, offset or 0)
    return df.offset(start).limit(limit)


def batches(df: DataFrame, order: list[str], size: int) -> DataFrame:
    """Batch numbers from 1, of a fixed size, per group column `group`."""
    at = F.row_number().over(Window.partitionBy("group").orderBy(*order))
    n = F.count(F.lit(1)).over(Window.partitionBy("group"))
    return df.withColumn("batch_index", F.floor((at - 1) / size).cast("long") + 1).withColumn("batch_count", F.greatest(F.lit(1).cast("long"), F.ceil(n / size).cast("long")))


def emptied(spark: SparkSession, tables: dict[str, StructType]) -> None:
    """Overwrite stored tables (path -> schema) with no rows, in this order: those that refer to others come first, so no row ever refers to one that is gone."""
    for path, schema in tables.items():
        spark.createDataFrame([], schema).write.mode("overwrite").parquet(path)
