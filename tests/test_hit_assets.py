"""Assets by advisory, where an advisory has several packages."""

import duckdb

from lodestack import plans


def test_an_advisory_of_several_names_meets_an_asset_once(spark, tmp_path):
    con = duckdb.connect()
    con.execute("CREATE TABLE part AS SELECT CASE WHEN k < 40 THEN 0 WHEN k < 80 THEN 250 ELSE k END AS p_partkey, 'n' || (k % 3) AS p_name, 'b' AS p_brand, 't' AS p_type, CAST(k % 2 AS INTEGER) AS p_size, 1.0 AS p_retailprice FROM range(600) r(k)")
    con.execute("CREATE TABLE orders AS SELECT k AS o_orderkey, k % 9 AS o_custkey, 'O' AS o_orderstatus, 1.0 AS o_totalprice, TIMESTAMP '2024-01-01' AS o_orderdate, '5-LOW' AS o_orderpriority FROM range(50) r(k)")
    con.execute("CREATE TABLE lineitem AS SELECT k % 50 AS l_orderkey, (k * 7) % 600 AS l_partkey, k % 5 AS l_suppkey, CAST(1 AS INTEGER) AS l_linenumber, 1.0 AS l_quantity, 'A' AS l_returnflag, 'O' AS l_linestatus, TIMESTAMP '2024-01-01' AS l_shipdate FROM range(400) r(k)")
    for t in ("part", "orders", "lineitem"):
        con.execute(f"COPY {t} TO '{tmp_path}/{t}.parquet'")
    want = con.execute("SELECT DISTINCT s.p_partkey, o_custkey FROM part s JOIN part c ON c.p_name = s.p_name JOIN lineitem ON l_partkey = c.p_partkey JOIN orders ON o_orderkey = l_orderkey WHERE s.p_partkey % 250 = 0").fetchall()
    got = plans.QUERIES["jn_hit_assets"](spark, str(tmp_path))
    assert sorted(map(tuple, got.collect())) == sorted(want) and len({a for a, _ in want}) == 3
    # pairs are told apart before advisories meet them: no shuffle holds advisories beside assets but for those of several names
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join Inner") < plan.index("Aggregate")


def test_assets_that_were_told_apart_stay_in_their_parts(spark, monkeypatch):
    """Assets of all names were shuffled and sorted once more, to meet a few advisories."""
    from lodestack.plans import relations

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        rows = {}
        for most in (relations.BROADCAST_BYTES, 0):
            monkeypatch.setattr(relations, "BROADCAST_BYTES", most)
            got = plans.QUERIES["jn_hit_assets"](spark, "/root/testdata/sf0.01")
            plan = got._jdf.queryExecution().executedPlan().toString()
            assert ("hashpartitioning(name" in plan and "part#" in plan) == (most == 0)
            rows[most] = sorted(map(tuple, got.collect()))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    one, other = rows.values()
    assert one == other and len(one) > 1000
