"""States of scan runs from their log of events, by one aggregation per run that is combined before the shuffle."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_states(log: DataFrame, keys: list[str], order: str, action: str = "action") -> DataFrame:
    """state of every run: queued, running, succeeded or canceled.

    A run is claimed once, while queued; only an active run is canceled; completion counts after a claim and wins over an
    earlier cancellation. Unknown actions change nothing. The order is unique in a run.
    """
    at = lambda name: F.when(F.col(action) == name, F.col(order))
    seen = log.groupBy(*keys).agg(F.min(at("claim")).alias("claimed"), F.min(at("cancel")).alias("canceled"), F.max(at("complete")).alias("completed"))
    held = F.col("claimed").isNotNull() & F.coalesce(F.col("claimed") < F.col("canceled"), F.lit(True))
    done = held & F.coalesce(F.col("completed") > F.col("claimed"), F.lit(False))
    return seen.select(*keys, F.when(done, "succeeded").when(F.col("canceled").isNotNull(), "canceled").when(held, "running").otherwise("queued").alias("state"))


def run_table(log: DataFrame, keys: list[str], order: str, at: str, runner: str, now=None, stale: str = "1 hour", action: str = "action") -> DataFrame:
    """state, claimed_by, claimed_at and finished_at of every run, from its log of claims, cancellations, completions and failures.

    The rules of run_states hold; the last completion or failure after the claim counts, also after a cancellation. A run
    that is claimed and has no end by `now` (a timestamp expression) failed if its claim is older than `stale`; a later completion in
    the log still wins. One aggregation per run, combined before the shuffle.
    """
    event = lambda *names: F.when(F.col(action).isin(*names), F.struct(F.col(order).alias("o"), F.col(at).alias("at"), F.col(runner).alias("by"), F.col(action).alias("a")))
    seen = log.groupBy(*keys).agg(F.min(event("claim")).alias("c"), F.min(event("cancel")).alias("x"), F.max(event("complete", "fail")).alias("d"))
    held = F.col("c").isNotNull() & F.coalesce(F.col("c.o") < F.col("x.o"), F.lit(True))
    done = held & F.coalesce(F.col("d.o") > F.col("c.o"), F.lit(False))
    gone = F.lit(False) if now is None else F.col("c.at") < now - F.expr(f"interval {stale}")
    ended = F.when(F.col("d.a") == "complete", "succeeded").otherwise("failed")
    state = F.when(done, ended).when(F.col("x").isNotNull(), "canceled").when(held & gone, "failed").when(held, "running").otherwise("queued")
    return seen.select(*keys, state.alias("state"), F.when(held, F.col("c.by")).alias("claimed_by"), F.when(held, F.col("c.at")).alias("claimed_at"), F.when(done, F.col("d.at")).when(F.col("x").isNotNull(), F.col("x.at")).alias("finished_at"))


def runner_presence(beats: DataFrame, runs: DataFrame, now, live: str = "60 seconds", busy: str = "1800 seconds") -> DataFrame:
    """available and busy of every job type: busy if a run was claimed within `busy` and still runs, available if busy or a runner was seen
    within `live`. beats: (job_type, seen_at); runs: (job_type, state, claimed_at)."""
    seen = beats.select("job_type", (F.col("seen_at") >= now - F.expr(f"interval {live}")).alias("beat"), F.lit(False).alias("runs"))
    held = runs.select("job_type", F.lit(False).alias("beat"), ((F.col("state") == "running") & (F.col("claimed_at") >= now - F.expr(f"interval {busy}"))).alias("runs"))
    both = seen.unionByName(held).groupBy("job_type").agg(F.bool_or("beat").alias("beat"), F.bool_or("runs").alias("busy"))
    return both.select("job_type", (F.coalesce("beat", F.lit(False)) | F.coalesce("busy", F.lit(False))).alias("available"), F.coalesce("busy", F.lit(False)).alias("busy"))


def due(runs: DataFrame, key: str, at: str, now, every: str = "60 seconds") -> DataFrame:
    """Sources whose last run is at least so long ago and that have none active: they are to be queued again. runs: (key, at, state)."""
    last = runs.groupBy(key).agg(F.max(at).alias("last"), F.bool_or(F.col("state").isin("queued", "running")).alias("active"))
    return last.where(~F.col("active") & (F.col("last") <= now - F.expr(f"interval {every}"))).select(key, "last")


def changed_roots(files: DataFrame, root: str, at: str, markers: DataFrame) -> DataFrame:
    """Of each root of markers (root, marker): whether a file is newer than its marker; roots without a marker count as changed."""
    newest = files.groupBy(root).agg(F.max(at).alias("newest"))
    return newest.join(markers, root, "left").select(root, (F.col("marker").isNull() | (F.col("newest") > F.col("marker"))).alias("changed"))
