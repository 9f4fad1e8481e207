"""Stars of links, and the shuffle files that a checkpoint leaves."""

import random
import time

from pyspark.sql import functions as F

from lodestack.llm import common, components


def reached(edges):
    top = {}

    def find(x):
        while top.setdefault(x, x) != x:
            x = top[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {(x, find(x)) for x in top if find(x) != x}


def shuffle_files(spark):
    every = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n")
    return {x.rsplit("/", 1)[-1] for x in every.split("\n") if "/shuffle_" in x}


def left_over(spark, before):
    for _ in range(50):  # executors delete them soon, not at once
        if not (new := shuffle_files(spark) - before):
            break
        time.sleep(0.2)
    return new


def test_stars_are_the_components_of_old_stars_and_new_links(spark):
    rnd = random.Random(5)
    link = lambda n: (rnd.randrange(n), rnd.randrange(n))
    graphs = [
        [],
        [(3, 3)],
        [(i, i + 1) for i in range(40)],
        [(i + 1, i) for i in range(40)] * 2,
        [(99, i) for i in range(99)],
        [link(300) for _ in range(140)],
        [link(300) for _ in range(400)],
    ]
    make = lambda rows: spark.createDataFrame(rows, "a long, b long")
    pairs = lambda df: sorted(map(tuple, df.collect()))
    for edges in graphs:
        assert pairs(components.stars(make(edges))) == sorted(reached(edges))
        more = [link(300) for _ in range(30)]
        assert pairs(components.stars(components.stars(make(edges)).unionByName(make(more)))) == sorted(reached(edges + more))


def test_a_checkpoint_leaves_no_shuffle_files(spark):
    rows = spark.range(5000).groupBy((F.col("id") % 900).alias("k")).agg(F.sum("id").alias("s"))
    setting, before = spark.conf.get(common.FREED), shuffle_files(spark)
    kept = common.cut(rows)
    assert not left_over(spark, before)
    assert spark.conf.get(common.FREED) == setting
    # the rows can still be made again, with and without a checkpoint
    want = sorted((k, sum(range(k, 5000, 900))) for k in range(900))
    assert want == sorted(map(tuple, kept.collect())) == sorted(map(tuple, rows.collect())) == sorted(map(tuple, common.cut(rows).collect()))
