"""Targets from registry listings: filter tags, expand tags, newest first, keep a few per repository, one of each digest."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestack.functions.scalars import any_glob
from lodestack.operators.relational import keep_first


def tag_targets(listing: DataFrame, keys: list[str], allowed: Column, pushed: str, most: int) -> DataFrame:
    """A listing of one tag per row: allowed tags, the newest of every repository; equal times go by tag."""
    return keep_first(listing.where(allowed), keys, F.desc_nulls_last(pushed), F.col("tag"), n=most)


def version_targets(listing: DataFrame, keys: list[str], pushed: str, most: int, untagged: bool = False) -> DataFrame:
    """A listing of one version with an array `tags` per row: the newest versions of every repository, one row per tag.

    Versions without tags count only if asked for; their tag is null then.
    """
    kept = listing if untagged else listing.where(F.size(F.coalesce("tags", F.array().cast("array<string>"))) > 0)
    newest = keep_first(kept, keys, F.desc_nulls_last(pushed), F.col("digest"), n=most)
    return newest.withColumn("tag", F.explode_outer("tags")).drop("tags")


def first_tag(tags: Column, allow: list[str]) -> Column:
    """The first tag that a pattern allows, else null."""
    return F.get(F.filter(tags, lambda t: any_glob(t, allow)), 0)


def one_per_digest(targets: DataFrame, order: list[str]) -> DataFrame:
    """One target of each digest (its reference where it has none), by order of the sources; one aggregation, no window."""
    key = F.coalesce(F.nullif("digest", F.lit("")), F.col("reference"))
    rest = [F.col(c) for c in targets.columns]
    return targets.groupBy(key.alias("_key")).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_t")).select("_t.*")


def advisory_feed(index: DataFrame, advisories: DataFrame, since, most: int = 5000) -> DataFrame:
    """Changed advisories of malicious packages, newest first and at most so many, without withdrawn ones.

    index: (advisory_id, changed_at). advisories: (advisory_id, withdrawn, ...). The limit counts before withdrawn ones
    are left out. The limited side is small by construction, so Spark broadcasts it if its size allows.
    """
    newest = index.where(F.col("advisory_id").startswith("MAL-") & (F.col("changed_at") > since)).orderBy(F.desc("changed_at"), "advisory_id").limit(most)
    return newest.join(advisories.where(F.col("withdrawn").isNull()), "advisory_id")
