"""Bodies around the bound of 3,000 bytes: the one without its first character is a byte shorter."""

import duckdb

from lodestack import plans


def test_sql_and_query_agree_at_the_bound(spark, tmp_path):
    con = duckdb.connect()
    con.execute(f"COPY (SELECT 1000 + k AS doc_id, repeat('a', CAST(2950 + k // 5 AS INTEGER)) AS text FROM range(400) r(k)) TO '{tmp_path}/documents.parquet'")
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet'")
    want = con.execute(f"SELECT doc_id, error, n FROM ({plans.ORACLES['src_gzip_json']})").fetchall()
    got = plans.QUERIES["src_gzip_json"](spark, str(tmp_path)).select("doc_id", "error", "n").collect()
    assert set(map(tuple, got)) == set(want) and {e for _, e, _ in want} == {None, "too large", "cut off", "no gzip", "no JSON"}
